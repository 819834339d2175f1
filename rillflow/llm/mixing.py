"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are laid out in the order of a digest and its words form a line, which may be walked several
times. A source's target is the length of line that the mix takes; that length is cut into blocks of equal word count, and
the number of blocks is the source's exact quota. A binary tree over the output shards splits the vector of quotas: each
node draws, from a multivariate hypergeometric distribution, how many blocks of each source go left. A leaf holds the
quota of one shard and its disjoint share of each source's blocks, which a permutation keyed by the seed has put in
order before. Shards are then shuffled locally.

The driver and every task of the tree hold one number for each source, and targets are windows over one row for each
source: that bears a million sources, not one for each document. Positions come from sums over buckets of the digest, so
that no source is ever sorted in one task; rows alike in doc_id, source and text are one row with a number of copies until
their draws are known. The first positions of buckets are joined by whichever join their size asks for.

A null text has size 0; a null source is a source of its own, last in order, and is no empty one; rows with a null doc_id
and repeated rows take part like any other. Empty tables give empty mixes. `mixed` keeps all columns, and of rows that
differ in further columns alone each is drawn by itself; names that begin with `_mix` are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rillflow.llm.common import columns_of, word_count, written

WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BLOCK_WORDS = 1 << 12
SHARD_WORDS = 1 << 22
#: Documents that one bucket of the digest holds on average.
BUCKET_ROWS = 8192
#: Copies of one row that a task hands out.
MANY_COPIES = 1 << 16
#: numpy draws from fewer than 10**9 blocks; blocks grow beyond this number.
MOST_BLOCKS = 1 << 29
#: Partitions of a mix's rows.
MOST_PARTITIONS = 1 << 16


def digest() -> Column:
    """What orders documents within their source: no two different triples are spelled alike."""
    spelled = lambda c: F.coalesce(F.concat(F.lit("s"), F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("n"))
    return F.md5(F.concat(*(spelled(F.col(c).cast("string")) for c in ("doc_id", "source", "text"))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, digest and number of copies of each distinct row."""
    name = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("_mix_size"), name.alias("_mix_name"), digest().alias("_mix_key"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("_mix_copies"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """sources (_mix_name, source, source_size) with _mix_at, its place by code point, and target.

    Sorted by how soon they reach their limit, the sources that stop at it are a prefix; the rest share what is left by
    weight. Windows run over one row for each source.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    table = F.array(*map(F.lit, weights))
    out = sources.withColumn("_mix_at", F.row_number().over(order) - 1)
    out = out.withColumn("_w", F.element_at(table, (F.col("_mix_at") % len(weights) + 1).cast("int")).cast("bigint"))
    out = out.withColumn("_cap", F.col("source_size") * max_repeat).withColumn("_total", F.sum("source_size").over(every))
    soon = W.orderBy(F.col("_cap") / F.col("_w"), "_mix_at")
    out = out.withColumn("_before", F.coalesce(F.sum("_cap").over(soon.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("_rest", F.sum("_w").over(soon.rowsBetween(0, W.unboundedFollowing)))
    full = (F.col("_total") - F.col("_before")).cast("double") * F.col("_w") >= F.col("_cap").cast("double") * F.col("_rest")
    out = out.withColumn("_full", full)
    out = out.withColumn("_taken", F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0)).over(every))
    out = out.withColumn("_share", F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(every))
    shared = (F.col("_w") * (F.col("_total") - F.col("_taken"))).cast("double") / F.expr("nullif(_share, 0)").cast("double")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.coalesce(shared, F.lit(0.0)))
    return out.select("_mix_name", "_mix_at", "source_size", target.alias("target"))


def leaf(quotas: np.ndarray, shard: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of blocks that a shard takes from each source: the walk from the root to its leaf."""
    total = int(quotas.sum())
    edge = lambda j: total * j // shards
    first, counts, low, high = np.zeros_like(quotas), quotas, 0, shards
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, low << 32 | high]))
        left = rng.multivariate_hypergeometric(counts, edge(middle) - edge(low), method="marginals")
        if shard < middle:
            counts, high = left, middle
        else:
            first, counts, low = first + left, counts - left, middle
    return first, counts


def permuted(places: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 puts places: a Feistel network over a few more numbers, walked until inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask, salt = (np.uint64(1) << half) - np.uint64(1), np.uint64(key & (1 << 64) - 1)

    def step(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for turn in range(6):
            z = (b + salt + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ (z ^ z >> np.uint64(32)) & mask
        return a << half | b

    out = step(places.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = step(out[far])
    return out.astype(np.int64)


def handed_out(rows: DataFrame, many: int = MANY_COPIES) -> DataFrame:
    """A row for each of _mix_copies, numbered by _mix_copy; those of a row with a great many come from many tasks."""
    last = F.col("_mix_copies") - 1
    out = rows.filter(F.col("_mix_copies") <= many).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_mix_copy"))
    hot = rows.filter(F.col("_mix_copies") > many)
    if hot.isEmpty():
        return out
    hot = hot.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(many).cast("bigint"))).alias("_least")).repartition("_mix_key", "_least")
    hot = hot.select("*", F.explode(F.sequence(F.col("_least"), F.least(F.col("_least") + many - 1, last))).alias("_mix_copy")).drop("_least")
    return out.unionByName(hot)


def plan(docs: DataFrame, weights=WEIGHTS, max_repeat=MAX_REPEAT, block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, seed=1) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, taken, draws, its digest _mix_key and _mix_copy.

    draws lists shard, place and pass of every time the mix takes the document; place orders a shard's documents.
    """
    spark = docs.sparkSession
    rows = written(sized(docs), "mix-sizes")
    n_rows, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("_mix_size") * F.col("_mix_copies")), F.lit(0))).first()
    digits = 0
    while digits < 7 and n_rows > BUCKET_ROWS * 16**digits:
        digits += 1
    rows = rows.withColumn("_bucket", F.substring("_mix_key", 1, digits) if digits else F.lit(""))
    words = F.col("_mix_size") * F.col("_mix_copies")
    buckets = written(rows.groupBy("_mix_name", "_bucket").agg(F.sum(words).alias("_sum"), F.first("source").alias("source")), "mix-buckets")
    sources = buckets.groupBy("_mix_name").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    sources = written(targets(sources, weights, max_repeat), "mix-sources")

    block = max(block_words, -(-total // MOST_BLOCKS))
    shards = max(1, -(-total // shard_words))
    length = F.floor(F.col("target") + 0.5).cast("bigint")
    quotas = np.array([r[0] for r in sources.orderBy("_mix_at").select(F.ceil(length / F.lit(block)).cast("bigint")).collect()], np.int64)

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                first, counts = leaf(quotas, int(shard), shards, seed)
                for at in np.flatnonzero(counts):
                    blocks = permuted(np.arange(first[at], first[at] + counts[at]), int(quotas[at]), (seed << 32) + int(at))
                    yield pd.DataFrame({"_mix_at": np.int32(at), "_block": blocks, "shard": int(shard)})

    places = spark.range(shards).mapInPandas(split, "_mix_at int, _block long, shard long")

    within = W.partitionBy("_mix_name", "_bucket").orderBy("_mix_key", "doc_id", "_mix_size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.coalesce(F.sum(words).over(within), F.lit(0)))
    ahead = W.partitionBy("_mix_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select("_mix_name", "_bucket", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_start")).join(sources, "_mix_name")
    rows = handed_out(rows).join(starts, ["_mix_name", "_bucket"])
    rows = rows.withColumn("_from", F.col("_start") + F.col("_from") + F.col("_mix_copy") * F.col("_mix_size"))
    passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeat - 1)), lambda p: p * F.col("source_size") + F.col("_from")), lambda x: x < length)
    draws = rows.select("*", F.posexplode_outer(passes).alias("_pass", "_at")).withColumn("_block", F.floor(F.col("_at") / F.lit(block)).cast("bigint"))
    drawn = draws.join(places, ["_mix_at", "_block"], "left")
    one = F.when(F.col("shard").isNotNull(), F.struct("shard", F.xxhash64(F.lit(seed), "_mix_key", "_mix_copy", "_pass").alias("place"), F.col("_pass").alias("pass")))
    unique = ["_mix_key", "_mix_copy", "doc_id", "source", "_mix_size", "source_size", "target"]
    out = drawn.groupBy(*unique).agg(F.array_sort(F.collect_list(one)).alias("draws"))
    taken = (F.col("_mix_size") * F.size("draws")).alias("taken")
    return out.select("doc_id", "source", F.col("_mix_size").alias("size"), "source_size", "target", taken, "draws", "_mix_key", "_mix_copy")


def copies_numbered(rows: DataFrame) -> DataFrame:
    """rows (with _mix_key and a unique _mix_row) with _mix_copy, from 0 in each key: sums over the partitions that rows came from."""
    rows = written(rows.withColumn("_mix_part", F.shiftright("_mix_row", 33)), "mix-copies")
    own = W.partitionBy("_mix_key", "_mix_part").orderBy("_mix_row")
    ahead = W.partitionBy("_mix_key").orderBy("_mix_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy("_mix_key", "_mix_part").count()
    starts = sizes.select("_mix_key", "_mix_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_mix_first"))
    numbers = rows.select("_mix_key", "_mix_part", "_mix_row", (F.row_number().over(own) - 1).alias("_mix_nth")).join(starts, ["_mix_key", "_mix_part"])
    return rows.join(numbers.select("_mix_row", (F.col("_mix_first") + F.col("_mix_nth")).alias("_mix_copy")), "_mix_row").drop("_mix_row", "_mix_part")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, shuffled in their output shards.

    A partition has one shard, or several whole ones, one after the other, where there are more than MOST_PARTITIONS.

    Draws meet the texts by digest, then texts go to their shards. Rows that share doc_id, source and text are first
    numbered, in the order of docs' partitions, for each is drawn by itself.
    """
    if clash := [c for c in docs.columns if c.lower().startswith("_mix")]:
        raise ValueError(f"reserved names: {', '.join(clash)}")
    found = written(plan(docs, **options).select("_mix_key", "_mix_copy", "draws"), "mix-draws")
    draws = found.select("_mix_key", "_mix_copy", F.explode("draws").alias("_mix_draw"))
    shards = draws.agg(F.coalesce(F.max("_mix_draw.shard"), F.lit(0)) + 1).first()[0]
    keyed, repeated = docs.withColumn("_mix_key", digest()), found.filter("_mix_copy = 1").select("_mix_key")
    if repeated.isEmpty():
        out = keyed.join(draws.drop("_mix_copy"), "_mix_key")
    else:
        copies = copies_numbered(keyed.withColumn("_mix_row", F.monotonically_increasing_id()).join(repeated, "_mix_key", "left_semi"))
        single = draws.join(repeated, "_mix_key", "left_anti").drop("_mix_copy")
        out = keyed.join(single, "_mix_key").unionByName(copies.join(draws, ["_mix_key", "_mix_copy"]).drop("_mix_copy"))
    each = -(-shards // MOST_PARTITIONS)
    return out.repartitionById(-(-shards // each), F.call_function("div", F.col("_mix_draw.shard"), F.lit(each)).cast("int")).sortWithinPartitions("_mix_draw.shard", "_mix_draw.place").select(*columns_of(docs))
