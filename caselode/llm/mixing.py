"""Mixing sources to target weights by a low-discrepancy schedule.

Slot k of the schedule draws the point frac(k * golden ratio) and falls on the source whose interval
of cumulative target shares holds it; so any stretch of the schedule mixes the sources almost as the
targets say.  The slots of a source are ranked; rank r takes block r of the source's documents,
which are shuffled by hash and cut into blocks of equally many words (after the last block comes
the first again, so a pass repeats only when the source is used up).  The last slot of a source is
cut so that the source gets its target to the word.

A document's first slot is the one that reads its first word; sorting by it gives the mixture's order.

Native: DataFrame functions only.  Nothing runs over a source in one task: prefix sums and ranks are
made in two levels, inside hash-range chunks (one for every ``CHUNK_ROWS`` rows of the table) and
over the chunks' totals, so a source with a third of all rows spreads over all tasks.  Running sums
over more than ``FEW_SOURCES`` sources, and the meeting of points and intervals, work the same way over
value ranges (``before_each``, ``last_before``), so the sources may be many, too.

Defined cases: null and empty texts have size 0 and are never taken; the null source is a source,
last in order; equal rows are interchangeable; an empty table gives an empty schedule; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselode.llm.shared import checkpointed

#: Weights of the sources in order, repeating; words to take as a share of all; most repeats.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
GOLDEN = 0.6180339887498949
CHUNK_ROWS = 5_000
LARGEST_BLOCK, BLOCKS = 1024, 65536
#: So many sources' totals are summed up in one task; more in value ranges.
FEW_SOURCES = 10_000
WORD = r"[^ \t-\r]+"


def size_of(text: Column) -> Column:
    """Number of words.  Java's regex finds them without making the words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """Sorts by code point with null last; never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def ranges(df: DataFrame, *order) -> DataFrame:
    """``df`` dealt into value ranges, with the range's number; checkpointed, as a recomputed deal may differ."""
    return checkpointed(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def before_each(df: DataFrame, order: list[str], sums: dict[str, str], few: bool = False) -> DataFrame:
    """``df`` with running sums of what comes before each row: name -> SQL of the value.  Two levels, no single task, unless the rows are few."""
    if few:
        before = W.partitionBy(F.lit(0)).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)  # FEW_SOURCES rows at most
        return df.withColumns({n: F.coalesce(F.sum(F.expr(v)).over(before), F.lit(0)) for n, v in sums.items()})
    dealt = ranges(df, *order)
    totals = dealt.groupBy("range").agg(*[F.sum(F.expr(v)).alias(n) for n, v in sums.items()])
    earlier = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    base = totals.select("range", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias("base_" + n) for n in sums])
    inside = W.partitionBy("range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    named = dealt.join(base, "range")
    return named.withColumns({n: F.col("base_" + n) + F.coalesce(F.sum(F.expr(v)).over(inside), F.lit(0)) for n, v in sums.items()}).drop("range", *["base_" + n for n in sums])


def last_before(points: DataFrame, starts: DataFrame, at: str, name: str) -> DataFrame:
    """``points`` with the ``name`` of the last of ``starts`` at or below their ``at``; both sorted together in value ranges."""
    both = points.unionByName(starts, allowMissingColumns=True).withColumn("kind", F.when(F.col(name).isNull(), 1).otherwise(0))
    dealt = ranges(both, at, "kind")
    lasts = dealt.where("kind = 0").groupBy("range").agg(F.max_by(name, at).alias("last"))
    every = dealt.select("range").distinct().join(lasts, "range", "left")
    base = every.select("range", F.last("last", True).over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("base"))
    inside = W.partitionBy("range").orderBy(at, "kind").rowsBetween(W.unboundedPreceding, 0)
    found = dealt.join(base, "range").withColumn("found", F.coalesce(F.last(name, True).over(inside), "base"))
    return found.where("kind = 1").drop(name, "kind", "range", "base").withColumnRenamed("found", name)


def of_sources(rows: DataFrame, per: DataFrame, few: bool) -> DataFrame:
    """``rows`` with their source's columns; few sources are broadcast, so that no source's rows meet in one task."""
    return rows.join(F.broadcast(per) if few else per, "skey")


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(skey, source_size, source_rows, weight, target) per source, by water-filling in closed form.

    Sorted by capacity over weight, a source is capped exactly when its capacity does not exceed its
    weight's part of what the sources before it leave.
    """
    per = checkpointed(sized.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    few = per.count() <= FEW_SOURCES
    per = before_each(per, ["skey"], {"place": "1"}, few)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    per = before_each(per, ["ratio", "skey"], {"caps": "cap", "weights": "weight"}, few)
    whole = per.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))  # one row
    level = (F.col("all_words") * F.lit(share) - F.col("caps")) / (F.col("all_weights") - F.col("weights"))
    per = per.join(F.broadcast(whole)).withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # all capped sources precede the others; the level of the first that isn't capped holds for all of those
    free = per.agg(F.min(F.when(~F.col("capped"), F.struct("ratio", "skey", "level"))).alias("free"))  # one row
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("free.level") * F.col("weight"))
    return per.join(F.broadcast(free)).select("skey", "source_size", "source_rows", "weight", target.alias("target"))


def shuffled(sized: DataFrame, chunks: int) -> DataFrame:
    """(all columns of sized, begin): each row's first word in its source's shuffled stream.

    chunks: into how many hash ranges each source is cut; no source meets in one task.
    """
    draw = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    point = F.conv(F.substring("draw", 1, 8), 16, 10).cast("long")
    rows = sized.withColumn("draw", draw).withColumn("chunk", F.floor(point * chunks / F.lit(1 << 32)))
    totals = rows.groupBy("skey", "chunk").agg(F.sum("size").alias("words"))
    base = totals.select("skey", "chunk", (F.sum("words").over(W.partitionBy("skey").orderBy("chunk")) - F.col("words")).alias("base"))
    inside = W.partitionBy("skey", "chunk").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("inside", F.sum("size").over(inside) - F.col("size")).join(base, ["skey", "chunk"]).withColumn("begin", F.col("base") + F.col("inside")).drop("draw", "chunk", "inside", "base")


def block_words(total: int) -> int:
    """Words of a block: small corpora get small blocks, so rounding never shows."""
    return max(1, min(LARGEST_BLOCK, total // BLOCKS))


def schedule(spark: SparkSession, per_source: DataFrame, total: int, words: int, share: float = SHARE, slots_per_chunk: int = 1 << 12) -> DataFrame:
    """(slot, skey, rank, block, pass, words): the order in which blocks are read.

    The points come from a distributed range and fall on the sources' intervals by sorting both.  Ranks
    are counts of the source's slots in earlier chunks plus the row number in the chunk.  A source
    that the points leave short of its target by a few slots gets those at the end.
    """
    need = per_source.where(F.col("target") > 0).select("skey", "source_size", "target", F.round("target").cast("long").alias("take"))
    need = need.withColumn("blocks", F.ceil(F.col("source_size") / words)).withColumn("passes", F.floor(F.col("take") / F.col("source_size"))).withColumn("rest", F.col("take") - F.col("passes") * F.col("source_size"))
    need = need.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / words))
    sums = need.agg(F.sum("target").alias("whole"), F.count(F.lit(1)).alias("sources")).first()
    whole, few = sums["whole"] or 1.0, sums["sources"] <= FEW_SOURCES
    low = before_each(need.select("skey", "target"), ["skey"], {"below": "target"}, few).select((F.col("below") / F.lit(whole)).alias("point"), "skey")
    n = int(total * share // words) + 1
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1.0)).alias("point"))
    drawn = last_before(slots, low, "point", "skey").where("skey is not null").select("slot", "skey", F.floor(F.col("slot") / slots_per_chunk).alias("chunk"))
    counts = drawn.groupBy("skey", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("skey", "chunk", (F.sum("n").over(W.partitionBy("skey").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = F.row_number().over(W.partitionBy("skey", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("inside", inside).join(before, ["skey", "chunk"]).select("slot", "skey", (F.col("before") + F.col("inside")).alias("rank"))
    made = counts.groupBy("skey").agg(F.sum("n").alias("drawn"))
    lacking = need.join(made, "skey", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where(F.col("drawn") < F.col("slots"))
    short = lacking.select("skey", F.explode(F.sequence(F.col("drawn"), F.col("slots") - 1)).alias("rank")).select((F.col("rank") + n).alias("slot"), "skey", "rank")
    keep = need.select("skey", "source_size", "blocks", "passes", "rest", "slots")
    out = of_sources(ranked.unionByName(short), keep, few).where(F.col("rank") < F.col("slots"))
    block = F.pmod(F.col("rank"), F.col("blocks"))
    end = F.when(F.col("rank") >= F.col("passes") * F.col("blocks"), F.col("rest")).otherwise(F.col("source_size"))
    return out.select("slot", "skey", "rank", block.alias("block"), F.floor(F.col("rank") / F.col("blocks")).alias("pass"), F.least(F.lit(words), end - block * words).alias("words"))


def sizes(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return checkpointed(docs.select(F.col(key).alias("key"), size_of(F.col(text)).alias("size"), source_key(F.col(source)).alias("skey")))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", *, weights=WEIGHTS, share: float = SHARE, most: int = MOST, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """((key, skey, size, taken, first_slot, source_size, target) per document; the schedule of slots).

    The word counts are the only pass over the texts; they are checkpointed, and all later joins
    carry keys and numbers.  One small action reads the sum of sizes to fix the block size.
    """
    spark = docs.sparkSession
    sized = sizes(docs, text, source, key)
    taken, plan, per, few = mix_sized(spark, sized, weights, share, most, chunk_rows)
    return of_sources(taken, per, few), plan


def mix_sized(spark: SparkSession, sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame, DataFrame, bool]:
    """(key, skey, size, taken, first_slot), the schedule, (skey, source_size, target), whether the sources are few."""
    per = checkpointed(targets(sized, weights, share, most))  # a row per source
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("source_rows").alias("rows"), F.count(F.lit(1)).alias("sources")).first()
    total, rows = int(whole["words"] or 0), int(whole["rows"] or 0)
    words = block_words(total)
    plan = schedule(spark, per, total, words, share)
    # one cut a pass: bounded by ``most``
    uses = plan.groupBy("skey", "block").agg(F.collect_list("words").alias("cuts"), F.min("slot").alias("slot"))
    stream = shuffled(sized.where("size > 0"), rows // chunk_rows + 1)
    last = F.floor((F.col("begin") + F.col("size") - 1) / words)
    pieces = stream.withColumn("piece", F.explode(F.sequence(F.floor(F.col("begin") / words), last)))
    lo = F.greatest(F.col("begin"), F.col("piece") * words) - F.col("piece") * words
    hi = F.least(F.col("begin") + F.col("size"), (F.col("piece") + 1) * words) - F.col("piece") * words
    got = pieces.select("key", "skey", "size", "begin", F.col("piece").alias("block"), lo.alias("lo"), hi.alias("hi")).join(uses, ["skey", "block"], "left")
    part = F.aggregate(F.coalesce("cuts", F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda acc, cut: acc + F.greatest(F.lit(0).cast("long"), F.least(cut, F.col("hi")) - F.col("lo")))
    got = got.withColumn("part", part)
    taken = got.groupBy("key", "skey", "size", "begin").agg(F.sum("part").alias("taken"), F.min(F.when(F.col("part") > 0, F.col("slot"))).alias("first_slot"))
    empty = sized.where("size = 0").select("key", "skey", "size", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"))
    taken = taken.select("key", "skey", "size", "taken", "first_slot").unionByName(empty)
    return taken, plan, per.select("skey", "source_size", "target"), whole["sources"] <= FEW_SOURCES


def take(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` of which the mixture takes words, with mix_size, mix_target, mix_taken and mix_slot, in slot order.

    Rows with the same key have the same hash, and are told apart by size; equal rows may swap.  Texts are
    counted a second time only where a key has several sizes.
    """
    p = "__mix_"
    taken, _, sources, few = mix_sized(docs.sparkSession, sizes(docs, text, source, key), **options)
    per = taken.groupBy("key", "skey", "size").agg(F.max("taken").alias("taken"), F.min("first_slot").alias("slot"))
    per = per.withColumn("sizes", F.count(F.lit(1)).over(W.partitionBy("key", "skey"))).where("taken > 0")  # a row per size of a key
    per = of_sources(per, sources, few)
    per = per.select(*[F.col(c).alias(p + c) for c in per.columns])
    same = (F.col(p + "sizes") == 1) | (size_of(F.col(text)) == F.col(p + "size"))
    on = F.col(key).eqNullSafe(F.col(p + "key")) & (source_key(F.col(source)) == F.col(p + "skey")) & same
    made = [F.col(p + c).alias("mix_" + c) for c in ("size", "target", "taken", "slot")]
    return docs.join(per, on).orderBy(p + "slot", F.col(p + "key")).select(*docs.columns, *made)
