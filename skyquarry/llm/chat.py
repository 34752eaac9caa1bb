"""Operator 7, chat formatting: preference pairs. DataFrame functions only.

``formatted`` takes pairs of conversations, chosen and rejected. The longest common prefix of their
turns, short of either's last turn, is rendered once as the prompt; what follows on either side is
rendered as a completion, with a mask that says which characters are an assistant's words and so
are trained on. A pair whose conversations are equal, or differ in no turn of an assistant, teaches
nothing; it is returned with ``usable`` false.

``paired`` makes pairs where the table has none marked, in two steps, each the same at any size:

1. Conversations with the same first turn are put in order of the digests of their turns, and
   neighbours are paired, first with second, third with fourth; neighbours in that order have the
   longest prefixes in common. Of a pair the one with more words of the assistant is the chosen one,
   by order on a tie. No more than one conversation of a group stays without a partner.
2. A conversation without a partner, so each whose first turn nobody else has, is the chosen side
   of a pair whose rejected side is made: the same turns up to its last one of the assistant, and in
   place of that the reply that follows it among the distinct last replies of all conversations in
   order of words and digest, the first after the last. So the other reply is of near length and to
   another prompt: a negative for format and relevance, marked ``made``, not a human preference.

The order is one sort of digests by ranges. A group may lie across ranges; its place in a range then
goes on from the ranges before, whose first and last groups are all that is carried over. The made
replies are dealt in blocks, so a reply that a third of all conversations end with is no one task's.

Edge cases: a null role or text counts as empty; turns with equal numbers are taken in order of role
and text; equal rows are one turn; very long texts are moved whole, once to their conversation and
once for each side they stand on; ties of digests go by conv_id; a conversation with a null id is in
no group and gets a made side; one without a turn of the assistant, or in a table with one distinct
reply, gives a row without a rejected side; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, durable, table

OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
TRAINED = "assistant"
#: Rows to one range of the sort at least (no more ranges than shuffle partitions), and conversations to one block of a reply.
BLOCK = 64
OFTEN = 4096
_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cleaned(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, without nulls in the last two."""
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and ``turns``, in order."""
    one = F.struct("turn", "role", digest(F.col("text")).alias("key"), "text")
    drop = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))
    return cleaned(turns).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_set(one)), drop).cast(_TURN).alias("turns"))


def rendered(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def masks(turns: Column) -> Column:
    """array<struct<start, end>>: the trained characters of ``rendered(turns)``, end exclusive."""
    head = lambda t: F.length(t["role"]) + len(OPEN.format(""))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(a: Column, t: Column) -> Column:
        begin = (a["at"] + head(t)).cast("long")
        end = (begin + F.length(t["text"])).cast("long")
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + len(CLOSE)).cast("long").alias("at"), F.when(t["role"] == TRAINED, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def formatted(pairs: DataFrame) -> DataFrame:
    """``pairs``: chosen_id, rejected_id, chosen, rejected (arrays of turns, rejected may be null), made."""
    same = F.zip_with("chosen", "rejected", lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    run = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    most = F.least(F.size("chosen"), F.size("rejected"))
    common = F.when(run == 0, most).otherwise((run - 1).cast("int"))
    n = F.when(F.col("rejected").isNull(), F.size("chosen") - 1).otherwise(F.least(common, most - 1))
    cut = pairs.withColumn("n", F.greatest(n, F.lit(0)).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    cut = cut.select("chosen_id", "rejected_id", "made", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("prompt"), rest("chosen").alias("chosen"), F.when(F.col("rejected").isNotNull(), rest("rejected")).alias("rejected"))
    trained = lambda c: F.transform(F.filter(F.col(c), lambda t: t["role"] == TRAINED), lambda t: t["text"])
    return cut.select(
        "chosen_id", "rejected_id", F.col("n").cast("long").alias("prompt_turns"), rendered(F.col("prompt")).alias("prompt"),
        rendered(F.col("chosen")).alias("chosen"), masks(F.col("chosen")).alias("chosen_mask"),
        rendered(F.col("rejected")).alias("rejected"), masks(F.col("rejected")).alias("rejected_mask"),
        F.coalesce(trained("chosen") != trained("rejected"), F.lit(False)).alias("usable"), "made",
    )


def placed(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` with ``place``: where a row stands, from 0, among all with its ``first`` in the order."""
    ranges = min(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // BLOCK))
    sorted_ = keys.repartitionByRange(max(ranges, 1), "first", *order).sortWithinPartitions("first", *order)
    # another sample would give other ranges, so they are kept
    dealt = durable(sorted_.select("*", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().alias("at")))
    here = F.row_number().over(Window.partitionBy("block", "first").orderBy("at")).cast("long") - 1
    # only the first and last group of a range lie in others too: two rows a range
    runs = dealt.groupBy("block", "first").count().groupBy("block").agg(F.min(F.struct("first", "count")).alias("head"), F.max(F.struct("first", "count")).alias("tail"))
    edges = runs.select("block", F.explode(F.array_distinct(F.array("head", "tail"))).alias("run")).select("block", "run.first", "run.count")
    before = F.sum("count").over(Window.partitionBy("first").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(edges.select("block", "first", F.coalesce(before, F.lit(0)).alias("carried")))
    return dealt.withColumn("here", here).join(carried, ["block", "first"], "left").withColumn("place", F.col("here") + F.coalesce("carried", F.lit(0))).drop("block", "at", "here", "carried")


def dealt(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` in order by ranges, with the range (``_block``) and a number that rises in it (``_at``)."""
    ranges = min(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keys.count() // BLOCK))
    sorted_ = keys.repartitionByRange(max(ranges, 1), *order).sortWithinPartitions(*order)
    # another sample would give other ranges, so they are kept
    return durable(sorted_.select("*", F.spark_partition_id().alias("_block"), F.monotonically_increasing_id().alias("_at")))


def placed(keys: DataFrame, *order: str) -> DataFrame:
    """``keys`` with ``place``: where a row stands, from 0, among all with its ``first`` in the order."""
    here = Window.partitionBy("_block", "first")
    rows = dealt(keys, "first", *order).withColumns({"here": F.row_number().over(here.orderBy("_at")).cast("long") - 1, "n": F.count(F.lit(1)).over(here)})
    # only the first and last group of a range lie in others too: two rows a range
    run = F.struct("first", "n")
    edges = rows.filter("here = 0").groupBy("_block").agg(F.min(run).alias("head"), F.max(run).alias("tail"))
    edges = edges.select("_block", F.explode(F.array_distinct(F.array("head", "tail"))).alias("run")).select("_block", "run.first", "run.n")
    before = F.sum("n").over(Window.partitionBy("first").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = F.broadcast(edges.select("_block", "first", F.coalesce(before, F.lit(0)).alias("carried")))
    return rows.join(carried, ["_block", "first"], "left").withColumn("place", F.col("here") + F.coalesce("carried", F.lit(0))).drop("_block", "_at", "here", "n", "carried")


def followed(keys: DataFrame, name: str, *order: str) -> DataFrame:
    """``keys`` with ``next``: what ``name`` is in the row that follows, and in the first after the last."""
    by = Window.partitionBy("_block").orderBy("_at")
    rows = dealt(keys, *order).withColumns({"next": F.lead(name).over(by), "nth": F.row_number().over(by)})
    # a row a range: what its last row is followed by
    heads = rows.filter("nth = 1").select("_block", F.col(name).alias("head"))
    every = Window.orderBy("_block")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = F.broadcast(heads.select("_block", F.coalesce(F.lead("head").over(every), F.first("head").over(whole)).alias("_next")))
    return rows.join(heads, "_block").withColumn("next", F.coalesce("next", "_next")).drop("_block", "_at", "nth", "_next")


def outlines(turns: DataFrame) -> DataFrame:
    """What planning needs of each conversation, in place of its texts: conv_id, digests (of its turns), first, spoken
    (words of the assistant), at, reply and words (place, digest and words of the assistant's last turn, or null)."""
    key = digest(F.col("text"))
    one = F.struct("turn", "role", key.alias("key"), F.when(F.col("role") == TRAINED, words(F.col("text"))).alias("words"))
    convs = cleaned(turns).groupBy("conv_id").agg(F.array_sort(F.collect_set(one)).alias("turns"))
    replies = F.filter(F.transform("turns", lambda t, i: F.struct(i.alias("at"), t["role"].alias("role"), t["key"].alias("key"), t["words"].alias("words"))), lambda t: t["role"] == TRAINED)
    spoken = F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + F.coalesce(t["words"], F.lit(0)))
    digests = F.transform("turns", lambda t: F.concat(t["key"], t["role"]))
    last = F.get(replies, F.size(replies) - 1)
    return convs.select("conv_id", digests.alias("digests"), F.get(digests, F.lit(0)).alias("first"), spoken.alias("spoken"), last["at"].alias("at"), last["key"].alias("reply"), last["words"].alias("words"))


def sides(outline: DataFrame) -> DataFrame:
    """conv_id, chosen_id, rejected_id, at, reply, words: the pairs of each group, a row for each of their sides, and
    a row with a null rejected_id for each conversation without a partner."""
    places = placed(outline.filter(F.col("conv_id").isNotNull()), "digests", "conv_id").select("first", F.struct("place", "conv_id", "spoken", "at", "reply", "words").alias("side"))
    two = places.groupBy("first", F.shiftright("side.place", 1).alias("pair")).agg(F.min("side").alias("one"), F.max("side").alias("other"))
    met, swap = F.col("one.place") < F.col("other.place"), F.col("other.spoken") > F.col("one.spoken")
    two = two.select("one", "other", F.when(swap, F.col("other.conv_id")).otherwise(F.col("one.conv_id")).alias("chosen_id"), F.when(met, F.when(swap, F.col("one.conv_id")).otherwise(F.col("other.conv_id"))).alias("rejected_id"))
    each = two.select(F.explode(F.array_distinct(F.array("one", "other"))).alias("s"), "chosen_id", "rejected_id").select("s.conv_id", "chosen_id", "rejected_id", "s.at", "s.reply", "s.words")
    none = outline.filter("conv_id IS NULL").select("conv_id", F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), "at", "reply", "words")
    return each.union(none)


def other_replies(turns: DataFrame, plan: DataFrame) -> DataFrame:
    """_id and ``other``, the reply to set in the place of its last, of the conversations of ``plan`` without a partner."""
    alone = F.col("rejected_id").isNull()
    replies = plan.filter("reply IS NOT NULL").groupBy("reply").agg(F.max("words").alias("words"), F.count_if(alone).alias("asking"))
    # replies that more than 1 / OFTEN of the conversations ask for are at most OFTEN; theirs are dealt in blocks
    wanted = followed(replies, "reply", "words", "reply").filter("asking > 0 AND reply <> next").select("reply", "next", "asking")
    wanted = durable(wanted)
    bar = max(BLOCK, (wanted.agg(F.sum("asking")).first()[0] or 0) // OFTEN)
    wanted = wanted.withColumn("blocks", F.greatest(F.ceil(F.col("asking") / bar), F.lit(1)).cast("int"))
    hot = F.broadcast(wanted.filter("blocks > 1").select("reply", "blocks"))
    asked = plan.filter(alone & F.col("reply").isNotNull()).select(F.col("conv_id").alias("_id"), "reply")
    mine = asked.join(hot, "reply", "left").select("_id", "reply", F.pmod(F.xxhash64("_id"), F.coalesce("blocks", F.lit(1))).cast("int").alias("salt"))
    spoken = cleaned(turns).filter(F.col("role") == TRAINED).select("text", digest(F.col("text")).alias("next"))
    texts = spoken.groupBy("next").agg(F.max("text").alias("other"))
    given = wanted.join(texts, "next").select("reply", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("salt"))
    return mine.join(given, ["reply", "salt"]).select("_id", "other")


def paired(turns: DataFrame) -> DataFrame:
    """chosen_id, rejected_id, chosen, rejected, made; every conversation is in one row."""
    plan = durable(sides(durable(outlines(turns))))
    convs = conversations(turns)
    met = convs.join(plan.filter("rejected_id IS NOT NULL").select("conv_id", "chosen_id", "rejected_id"), "conv_id").groupBy("chosen_id", "rejected_id").agg(
        F.max(F.when(F.col("conv_id") == F.col("chosen_id"), F.col("turns"))).alias("chosen"), F.max(F.when(F.col("conv_id") == F.col("rejected_id"), F.col("turns"))).alias("rejected"), F.lit(False).alias("made")
    )
    alone = plan.filter("rejected_id IS NULL").select(F.col("conv_id").alias("_alone"), "at")
    mine = convs.join(alone, F.col("conv_id").eqNullSafe(F.col("_alone"))).join(other_replies(turns, plan), F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    reply = F.struct(F.get("turns", F.col("at"))["turn"].alias("turn"), F.lit(TRAINED).alias("role"), F.col("other").alias("text"))
    made = F.when(F.col("other").isNotNull(), F.concat(F.slice("turns", F.lit(1), F.coalesce("at", F.lit(0))), F.array(reply))).cast(_TURN)
    none = F.lit(None).cast(turns.schema["conv_id"].dataType)
    return met.unionByName(mine.select(F.col("conv_id").alias("chosen_id"), none.alias("rejected_id"), F.col("turns").alias("chosen"), made.alias("rejected"), made.isNotNull().alias("made")))


def listed(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",").alias(mask)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatted(paired(table(spark, sf_dir, "conversations")))
    return found.select("chosen_id", "rejected_id", "prompt_turns", "prompt", "chosen", listed("chosen_mask"), "rejected", listed("rejected_mask"), "usable", "made")
