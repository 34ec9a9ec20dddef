"""Command line: ``python -m caselode.cli index|search|sift``."""

from __future__ import annotations

import argparse
import math
import time

from pyspark.sql import SparkSession

from caselode.plans import retrieval


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="caselode")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index", help="index a CSV of cases")
    one.add_argument("-i", "--input", required=True)
    one.add_argument("-o", "--index", required=True)
    one = sub.add_parser("search", help="rank documents for query files")
    one.add_argument("-d", "--index", required=True)
    one.add_argument("-q", "--queries", required=True)
    one.add_argument("-o", "--output", required=True)
    one.add_argument("-m", "--mode", choices=("ranked", "feedback", "strict"), default="ranked")
    one = sub.add_parser("sift", help="ranks of a topic's relevant documents in a result")
    one.add_argument("-o", "--output", required=True)
    one.add_argument("-q", "--topic", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("caselode").getOrCreate()
    began = time.time()
    if args.command == "index":
        retrieval.index_cases(spark, args.input, args.index)
        print(f"indexed in {math.ceil(time.time() - began)} s")
    elif args.command == "search":
        retrieval.search_files(spark, args.index, args.queries, args.output, args.mode)
    else:
        for row in retrieval.sift(spark, args.output, args.topic).orderBy("document_id").collect():
            print(f"{row['document_id']} at index: {row['rank']}")


if __name__ == "__main__":
    main()
