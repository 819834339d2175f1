"""Chat formatting: collapse of logged conversations that are prefixes of longer ones, then rendering.

Every turn gets a hash of its place, role and text; the running sums of a conversation are the hashes of its prefixes. A
conversation whose whole hash is the hash of a proper prefix of another one is a snapshot of it and an anti-join drops it;
of equal conversations the smallest conv_id stays. Sums add up over blocks of turns, so that a conversation of any length
is never sorted in one task, and rendering is by turn, so that none is ever gathered.

The order of turns is that of `turn`, nulls first; turns that share a number follow by role and text. Repeated rows are one
turn. Null roles and texts are values of their own and render as empty. A row with a null conv_id belongs to no other: it is
a conversation of one turn, and of equal conversations one with an id stays before one without. Empty texts are turns. Other columns are ignored. Empty tables give no rows. Distinct turns of one conversation that share a
number, or have none, are sorted in one task, since only their text orders them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import written

#: Turns of one block of a conversation.
BLOCK = 4096
#: Bits of each of the three lanes of a hash; sums over a block stay far below 63 bits.
LANE_BITS = 42
LANES = 3


def conversation() -> Column:
    """What tells conversations apart, as a struct, where a null equals itself; a row without an id is told by its content."""
    own = F.when(F.col("conv_id").isNull(), F.md5(F.to_json(F.struct("turn", "role", "text"))))
    return F.struct(F.col("conv_id").isNull().alias("nameless"), "conv_id", own.alias("own")).alias("_conv")


def numbered(turns: DataFrame) -> DataFrame:
    """_conv, turn, role, text, block and position (from 0) of each distinct turn."""
    rows = turns.select(conversation(), F.col("turn").cast("bigint").alias("turn"), "role", "text").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / F.lit(BLOCK)), F.lit(-(1 << 62))).cast("bigint"))
    whole = W.partitionBy("_conv", "block").orderBy("turn", "role", "text")
    before = W.partitionBy("_conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("_conv", "block").count().select("_conv", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    out = rows.withColumn("_nth", F.row_number().over(whole)).join(blocks, ["_conv", "block"])
    return out.select("_conv", "turn", "role", "text", "block", (F.col("_ahead") + F.col("_nth") - 1).alias("position"))


def lane(k: int) -> Column:
    told = F.struct(F.col("role").isNull().alias("no_role"), "role", F.col("text").isNull().alias("no_text"), "text")
    return F.shiftrightunsigned(F.xxhash64(F.lit(k), "position", told), 64 - LANE_BITS)


def prefixes(turns: DataFrame) -> DataFrame:
    """_conv, n (turns of the prefix), the hash lanes of that prefix, and whether it is the whole conversation."""
    rows = turns.select("_conv", "block", "position", *(lane(k).alias(f"h{k}") for k in range(LANES)))
    lanes = [f"h{k}" for k in range(LANES)]
    own = W.partitionBy("_conv", "block").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("_conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("_conv", "block").agg(F.count("*").alias("_n"), *(F.sum(h).bitwiseAND((1 << LANE_BITS) - 1).alias(h) for h in lanes))
    size = F.sum("_n").over(W.partitionBy("_conv")).alias("n_turns")
    blocks = blocks.select("_conv", "block", size, *(F.coalesce(F.sum(h).over(ahead), F.lit(0)).alias(f"_{h}") for h in lanes))
    rows = rows.select("_conv", "block", "position", *(F.sum(h).over(own).alias(h) for h in lanes)).join(blocks, ["_conv", "block"])
    summed = [(F.col(h) + F.col(f"_{h}")).bitwiseAND((1 << LANE_BITS) - 1).alias(h) for h in lanes]
    n = F.col("position") + 1
    return rows.select("_conv", n.alias("n"), (n == F.col("n_turns")).alias("whole"), *summed)


def maximal(turns: DataFrame) -> DataFrame:
    """_conv, n_turns and n_copies of the conversations that are no proper prefix of another one."""
    key = ["n", *(f"h{k}" for k in range(LANES))]
    found = prefixes(turns)
    whole = found.filter("whole").groupBy(*key).agg(F.min("_conv").alias("_conv"), F.count("*").alias("n_copies"))
    parts = found.filter("NOT whole").select(*key).distinct()
    return whole.join(parts, key, "left_anti").select("_conv", F.col("n").alias("n_turns"), "n_copies")


def kept_turns(turns: DataFrame, opening: str, closing: str) -> DataFrame:
    rows = written(numbered(turns), "chat-turns")
    line = F.concat(F.lit(opening), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(closing))
    return rows.join(maximal(rows), "_conv").select("_conv", "position", "n_turns", "n_copies", line.alias("rendered"))


def rendered(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """One row for each turn of the conversations that stay: conv_id, position, n_turns, n_copies, rendered.

    A conversation's text is its rendered turns in the order of position.
    """
    return kept_turns(turns, opening, closing).select("_conv.conv_id", "position", "n_turns", "n_copies", "rendered")


def texts(turns: DataFrame, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n", turns_each: int = 4096) -> DataFrame:
    """The conversations that stay as whole texts: conv_id, part, n_turns, n_copies, text.

    A conversation is one part, unless it has more than turns_each turns, so that a row holds a bounded number of them.
    """
    rows = kept_turns(turns, opening, closing).withColumn("part", F.call_function("div", F.col("position"), F.lit(turns_each)))
    in_order = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    out = rows.groupBy("_conv", "part", "n_turns", "n_copies").agg(F.array_join(F.transform(in_order, lambda x: x["rendered"]), "").alias("text"))
    return out.select("_conv.conv_id", "part", "n_turns", "n_copies", "text")
