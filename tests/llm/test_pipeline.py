"""The pipeline against a plain version of its five stages."""

import random
from collections import Counter

import plain

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "s")]


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def redacted(text):
    out, at = "", 0
    for a, _, b, name in plain.spans(text, plain.PII):
        if a >= at:
            out += text[at:a] + f"[{name.upper()}]"
        at = max(at, b)
    return out + text[at:]


def plain_pipeline(docs, items):
    docs = [d for d in docs if d[1] and not plain.quality(d[1])[-1] and plain.in_band(d[1])]
    groups = plain.near_groups([(d[0], d[1]) for d in docs], 5, 80)
    seen, once = set(), []
    for d in docs:
        if groups[d[0]][1] == d[0] and d[:2] not in seen:
            seen.add(d[:2])
            once.append(d)
    found = plain.decontaminate([d[:2] for d in once], items)
    clean = [(d[0], redacted(d[1]), *d[2:4]) for d, (_, _, i) in zip(once, found) if not i]
    taken = {d: k for d, _, _, _, k in plain.mix([(d, t, s) for d, t, _, s in clean])}
    return sorted((d, t, lang, s, len(t), taken[d]) for d, t, lang, s in clean if taken[d])


def test_stages_equal_the_plain_version(spark, tmp_path):
    rng = random.Random(6)
    items = [(i, prose(rng, 12)) for i in range(6)]
    texts = [prose(rng, rng.randrange(20, 400)) for _ in range(40)]
    texts += [texts[0]] * 3 + [texts[1] + " tail", texts[2] + f" {items[0][1]} {items[1][1]} end", texts[3] + " " + items[2][1], "too few words", "again and again the same " * 50, None, ""]
    texts += [prose(rng, 30) + " mail me@host.example.org or +1 (310) 555-4510 soon. " + prose(rng, 20), prose(rng, 3000), "x#$%" * 300]
    docs = [(i, t, "en", rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    docs.append(docs[5])
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_size", "mix_target", "mix_taken", "mix_slot"]
    slots = [r["mix_slot"] for r in got.collect()]
    assert slots == sorted(slots)
    assert sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["mix_taken"]) for r in got.collect()), key=repr) == sorted(plain_pipeline(docs, items), key=repr)


def test_stages_written_between_and_empty_tables(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "personal data", "mixing"]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0 and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(docs.columns)["mix_taken"] == 1


def test_benchmark_stage_drops_one_whole_item(spark, tmp_path):
    rng = random.Random(7)
    items = [(i, prose(rng, 40)) for i in range(2)]
    texts = [prose(rng, 50), prose(rng, 30) + f" {items[0][1]} " + prose(rng, 30), f"{items[0][1]} {items[1][1]}", " ".join(items[1][1].split()[:7]), None]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.benchmark(spark, docs, str(tmp_path)).collect()) == [0, 3, 4]
