"""Chunks and order as relational operators over the input index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.sources import SEQ, sequenced
from rillflow.sources.folders import written

#: Bits of one bitmap of the built-in functions.
MOST_BITS = 1 << 15


def chunked(df: DataFrame, size: int, seq: str, *parts: Column) -> DataFrame:
    """Aggregates over each `size` consecutive items: chunk, n, first_seq, last_seq and parts; the last may be short."""
    if size < 1:
        raise ValueError("size must be at least 1")
    ends = (F.count("*").alias("n"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))
    return df.groupBy(F.floor(F.col(seq) / F.lit(size)).cast("bigint").alias("chunk")).agg(*ends, *parts)


def chunks(df: DataFrame, size: int, seq: str, value: str) -> DataFrame:
    """Each `size` consecutive items as one row: chunk and items, an array in input order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(value).alias("v"))))
    return chunked(df, size, seq, F.transform(pairs, lambda x: x["v"]).alias("items")).select("chunk", "items")


def whole(x: Column, by: int) -> Column:
    """x div by, exact for all integers."""
    return F.call_function("div", x.cast("bigint"), F.lit(by).cast("bigint"))


def first_gap(numbers: DataFrame, name: str) -> DataFrame:
    """One row, `name`: the first number from 0 that is missing in the column `at` of numbers, which holds few of them."""
    ranked = numbers.select("at").distinct().withColumn("_nth", F.row_number().over(W.orderBy("at")) - 1)
    return ranked.filter(F.col("_nth") == F.col("at")).agg(F.count("*").alias(name))


def gap_free(df: DataFrame, seq: str, block: int = MOST_BITS) -> DataFrame:
    """The rows before the first missing index, counting from 0: what can be released in order.

    Indices are gathered as bitmaps of `block` bits (MOST_BITS at most), in part before the shuffle. The first block that is
    not full is found by blocks of full blocks, and only its own indices are then looked at one by one.
    """
    block = min(block, MOST_BITS)
    own = df.filter(F.col(seq) >= 0).select(whole(F.col(seq), block).alias("_b"), (F.col(seq) % block).cast("bigint").alias("at"))
    bits = own.groupBy("_b").agg(F.bitmap_count(F.bitmap_construct_agg("at")).alias("_n"))
    full = bits.filter(F.col("_n") == block).select(whole(F.col("_b"), MOST_BITS).alias("_bb"), (F.col("_b") % MOST_BITS).alias("at"))
    far = first_gap(full.groupBy("_bb").count().filter(F.col("count") == MOST_BITS).select(F.col("_bb").alias("at")), "_far")
    near = first_gap(full.join(F.broadcast(far), F.col("_bb") == F.col("_far")), "_near")  # one row
    start = far.select((F.col("_far") * MOST_BITS + near.scalar()).alias("_start"))
    rest = first_gap(own.join(F.broadcast(start), F.col("_b") == F.col("_start")), "_rest")  # one row
    limit = start.select(F.col("_start") * block + rest.scalar())
    return df.filter((F.col(seq) >= 0) & (F.col(seq) < limit.scalar()))


def placed(df: DataFrame, seq: str) -> DataFrame:
    """df with seq replaced by each row's place from 0 in the order of seq; rows that share an index stay in the order they have.

    df is stored once, so that what made it runs once, and once more in order.
    """
    rows = written(df.withColumn("_at", F.monotonically_increasing_id()), "placed")
    return sequenced(rows.orderBy(seq, "_at").drop(seq, "_at")).withColumnRenamed(SEQ, seq)


def zipped(left: DataFrame, right: DataFrame, seq: str = SEQ) -> DataFrame:
    """Two results side by side, as many rows as both have: the first of one with the first of the other, and so on.

    What counts is the place in a result, not the index in the input, which filters and expansions leave gaps and repeats in.
    """
    if both := sorted({c.lower() for c in left.columns} & {c.lower() for c in right.columns} - {seq.lower()}):
        raise ValueError(f"rename columns that both sides have: {', '.join(both)}")
    return placed(left, seq).join(placed(right, seq), seq)
