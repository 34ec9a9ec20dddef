"""Term weights as columns: a term-frequency and a document-frequency part, chosen by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def tf_log(tf: Column) -> Column:
    """1 + log10 tf, and 0 for no occurrence."""
    return F.when(tf > 0, 1 + F.log10(tf.cast("double"))).otherwise(0.0)


def idf(n: Column, df: Column) -> Column:
    """log10(n / df), 0 for an unknown term; a term cannot be in more zones than there are."""
    value = F.when(df == 0, 0.0).otherwise(F.log10(n.cast("double") / df.cast("double")))
    return F.when(df > n, F.raise_error(F.lit("document frequency exceeds the number of documents")).cast("double")).otherwise(value)


TF = {"log": tf_log}
DF = {"no": lambda n, df: F.lit(1.0), "idf": idf}


@dataclass(frozen=True)
class TfIdf:
    """The product of both parts; ``QUERY`` and ``DOCUMENT`` are the settings of the engine."""

    tf: str
    df: str

    def __post_init__(self):
        if self.tf not in TF or self.df not in DF:
            raise ValueError(f"no such weighting: {self.tf}, {self.df}")

    def weight(self, tf: Column, n: Column | None = None, df: Column | None = None) -> Column:
        one = F.lit(1)
        return TF[self.tf](tf) * DF[self.df](one if n is None else n, one if df is None else df)


QUERY, DOCUMENT = TfIdf("log", "idf"), TfIdf("log", "no")
