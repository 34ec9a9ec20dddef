"""Chat formatting: quotation linking.

A message's lines carry a quote level, the number of leading ``>``.  Quoted lines of one level that
stand together are a passage.  A passage and each of its sentences, normalised (lower case, single
spaces), are hashed; so are the passages and sentences of what each message itself says (level 0).
A quoted hash links to the latest earlier message of the conversation that said it: one link each,
found by sorting quotes and originals together, so a phrase that thousands say and quote costs
its rows and not their pairs.  A message replies to the message with most of its shallowest linked
quotes (ties: the latest); without one it opens a thread.

Thread root and depth come from pointer doubling over the replies, and so does the message's
position in its thread, as the rank of its first visit on the Euler tour of the replies: every
reply follows its parent, branches one after the other, siblings by turn.  Sorting the rows by
(conversation, root, position) gives the conversations in reply order, without quotes and their
attribution lines.  The joins are as many as the logarithm of the largest thread, and nothing gathers
a conversation, a phrase or a message's replies in one task.

Defined cases: quotes of any level and passages of any length count; null and empty texts quote
nothing and say nothing; a message of quotes only has an empty text; quotes that no earlier message
said link to nothing; repeated rows are each returned, and count once as an original; a null
conversation or turn is kept but never linked.  Extra columns are carried through; columns of the
result's names are to be kept apart by ``prefix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselode.llm.shared import checkpointed

MARK = r"^[ \t]*((?:>[ \t]?)+)"
ATTRIBUTION = r"(?m)^[^\n>]*\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:[ \t]*\r?\n(?=[ \t]*>)"
QUOTED_LINE = r"(?m)^[ \t]*>[^\n]*\n?"
BREAK = "\x01"
#: Turns that are sorted in one task at most when one phrase or one message's replies are followed.
TURNS = 1024


def lines_of(text: Column) -> Column:
    """array<struct<level, body>> of a text's lines."""

    def one(line):
        mark = F.regexp_extract(line, MARK, 1)
        return F.struct(F.length(F.regexp_replace(mark, "[^>]", "")).alias("level"), F.regexp_replace(line, MARK, "").alias("body"))

    return F.transform(F.split(text, "\r?\n", -1), one)


def units(lines: Column, level) -> Column:
    """Distinct normalised passages, and their sentences, of one level."""
    body = F.array_join(F.transform(lines, lambda x: F.when(x["level"] == level, x["body"]).otherwise(F.lit(BREAK))), " ")
    flat = F.regexp_replace(F.lower(body), r"\s+", " ")
    parts = F.concat(F.split(flat, BREAK, -1), F.split(flat, rf"{BREAK}|(?<=[.!?]) ", -1))
    return F.array_distinct(F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != ""))


def said(text: Column) -> Column:
    """The text without quotes and attribution lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, ATTRIBUTION, ""), QUOTED_LINE, ""), F.lit(" \n\r\t"))


def latest_before(quoted: DataFrame, originals: DataFrame) -> DataFrame:
    """``quoted`` with ``original``, the latest turn before its own that said its hash.

    In two levels: inside stretches of ``TURNS`` turns, and over the stretches of a phrase.
    """
    both = quoted.withColumn("said_at", F.lit(None).cast("long")).unionByName(originals.select("conv", "turn", "hash", F.col("turn").alias("said_at")), allowMissingColumns=True)
    both = both.withColumn("stretch", F.floor(F.col("turn") / TURNS))
    tops = both.groupBy("conv", "hash", "stretch").agg(F.max("said_at").alias("top"))
    earlier = W.partitionBy("conv", "hash").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select("conv", "hash", "stretch", F.max("top").over(earlier).alias("carried"))
    inside = W.partitionBy("conv", "hash", "stretch").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    found = both.withColumn("near", F.max("said_at").over(inside)).where("said_at is null").join(tops, ["conv", "hash", "stretch"])
    return found.withColumn("original", F.coalesce("near", "carried")).where("original is not null").drop("said_at", "stretch", "near", "carried")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn, level, hash, original): quoted units and the latest earlier turns that said them."""
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("conv is not null and turn is not null")
    quoting = rows.where(F.col("text").rlike(r"(?m)" + MARK)).withColumn("lines", lines_of(F.col("text")))
    levels = quoting.withColumn("level", F.explode(F.array_distinct(F.transform("lines", lambda x: x["level"])))).where("level > 0")
    quoted = levels.select("conv", "turn", "level", F.explode(units(F.col("lines"), F.col("level"))).alias("s"))
    quoted = quoted.select("conv", "turn", "level", F.xxhash64("s", F.length("s")).alias("hash")).distinct()
    # only conversations that quote at all give originals: the join drops the rest before units are made
    talk = rows.join(quoting.select("conv").distinct(), "conv", "left_semi")
    own = F.explode(units(lines_of(F.regexp_replace(F.col("text"), ATTRIBUTION, "")), 0))
    originals = talk.select("conv", "turn", own.alias("s")).select("conv", "turn", F.xxhash64("s", F.length("s")).alias("hash")).distinct()
    return latest_before(quoted, originals).select("conv", "turn", "level", "hash", "original")


def parents(links: DataFrame) -> DataFrame:
    """(conv, turn, reply_to, n_linked): the shallowest linked level decides, by most links, then the latest."""
    votes = links.groupBy("conv", "turn", "level", "original").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "original")).alias("best"), F.sum("n").alias("n_linked"))
    return best.select("conv", "turn", F.col("best.original").alias("reply_to"), "n_linked")


def threads(replies: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) of the messages that reply, by pointer doubling."""
    now = checkpointed(replies.select("conv", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        step = now.join(up, ["conv", "root"], "left")
        now = checkpointed(step.select("conv", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")))
        if not now.where("moved").limit(1).count():
            return now.drop("moved")
        now = now.drop("moved")


def siblings(replies: DataFrame) -> DataFrame:
    """``replies`` with ``sibling``, the next turn that replies to the same message, in two levels as ``latest_before``."""
    dealt = replies.withColumn("stretch", F.floor(F.col("turn") / TURNS))
    firsts = dealt.groupBy("conv", "reply_to", "stretch").agg(F.min("turn").alias("low"))
    firsts = firsts.select("conv", "reply_to", "stretch", F.lead("low").over(W.partitionBy("conv", "reply_to").orderBy("stretch")).alias("beyond"))
    near = F.lead("turn").over(W.partitionBy("conv", "reply_to", "stretch").orderBy("turn"))
    return dealt.withColumn("near", near).join(firsts, ["conv", "reply_to", "stretch"]).withColumn("sibling", F.coalesce("near", "beyond")).drop("stretch", "near", "beyond")


def positions(replies: DataFrame) -> DataFrame:
    """(conv, turn, position): each message's place in its thread's preorder, by ranking the Euler tour.

    The tour enters and leaves every message once; ``rest`` is the number of messages entered from a
    step to the tour's end, and doubles its reach in every round.
    """
    tree = siblings(replies.select("conv", "turn", "reply_to"))
    down = tree.groupBy("conv", F.col("reply_to").alias("turn")).agg(F.min("turn").alias("child"))
    nodes = tree.select("conv", "turn", "reply_to", "sibling").join(down, ["conv", "turn"], "full")
    enter = nodes.select("conv", "turn", F.lit(False).alias("out"), F.coalesce("child", "turn").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).cast("long").alias("rest"))
    leave = nodes.select("conv", "turn", F.lit(True).alias("out"), F.coalesce("sibling", "reply_to").alias("to"), F.col("sibling").isNull().alias("to_out"), F.lit(0).cast("long").alias("rest"))
    now = checkpointed(enter.unionByName(leave))
    while now.where("to is not null").limit(1).count():
        ahead = now.select("conv", F.col("turn").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("next"), F.col("to_out").alias("next_out"), F.col("rest").alias("more"))
        step = now.join(ahead, ["conv", "to", "to_out"], "left")
        now = checkpointed(step.select("conv", "turn", "out", F.col("next").alias("to"), F.coalesce("next_out", "to_out").alias("to_out"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")))
    return now.where("not out").select("conv", "turn", "rest")


def relink(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", *, prefix: str = "") -> DataFrame:
    """``messages`` with said, max_level, n_linked, reply_to, root, depth and position (named with ``prefix``)."""
    p = "__quote_"
    replies = checkpointed(parents(link(messages, conv, turn, text)))
    rooted = threads(replies)
    rest = checkpointed(positions(replies))
    whole = rest.select("conv", F.col("turn").alias("root"), F.col("rest").alias("all"))
    tree = replies.join(rooted, ["conv", "turn"]).join(rest, ["conv", "turn"]).join(whole, ["conv", "root"]).withColumn("position", F.col("all") - F.col("rest"))
    tree = tree.select(*[F.col(c).alias(p + c) for c in ("conv", "turn", "reply_to", "n_linked", "root", "depth", "position")])
    own = messages.columns
    full = messages.join(tree, (F.col(conv) == F.col(p + "conv")) & (F.col(turn) == F.col(p + "turn")), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    deepest = F.when(F.contains(body, F.lit(">")), F.array_max(F.transform(lines_of(body), lambda x: x["level"]))).otherwise(0)
    made = {
        "said": F.when(F.col(text).isNotNull(), F.when(F.contains(body, F.lit(">")), said(body)).otherwise(F.trim(body, F.lit(" \n\r\t")))),
        "max_level": deepest.cast("long"),
        "n_linked": F.coalesce(F.col(p + "n_linked"), F.lit(0)).cast("long"),
        "reply_to": F.col(p + "reply_to"),
        "root": F.coalesce(F.col(p + "root"), F.col(turn).cast("long")),
        "depth": F.coalesce(F.col(p + "depth"), F.lit(0)).cast("long"),
        "position": F.coalesce(F.col(p + "position"), F.lit(0)).cast("long"),
    }
    return full.select(*own, *[c.alias(prefix + n) for n, c in made.items()])


def in_reply_order(linked: DataFrame, conv: str = "conv_id", prefix: str = "") -> DataFrame:
    """The result of ``relink``, sorted: each conversation's threads by root, each thread in reply order."""
    return linked.orderBy(conv, prefix + "root", prefix + "position")
