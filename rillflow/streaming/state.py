"""Order and chunks across micro-batches: buffers of rows, told apart by key and held as Spark's state.

What a key still holds when the input has ended is read from the state of the last batch, so that nothing is lost and a
later run goes on from there. A buffer is the rows themselves, as Arrow bytes; it is as long as items are out of order, or one
chunk, for each key in it. Batches may be cut anywhere. Rows with a null key are those of one key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from rillflow.sources.folders import exists, literal
from rillflow.streaming import run_available

#: Groups of keys whose state is one buffer. State that was stored with another number, or by key, cannot be gone on with.
BUCKETS = 1024
HELD = StructType([StructField("keys", BinaryType()), StructField("waiting", BinaryType())])
STATE = StructType([StructField("next", LongType()), StructField("waiting", BinaryType())])


def packed(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_all().to_pandas()


def joined(held: bytes | None, frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """What waited and what has come, as one frame; None if there is nothing."""
    found = [unpacked(held)] if held else []
    found += [frame for frame in frames if len(frame)]
    return pd.concat(found, ignore_index=True) if found else None


def stateful(rows: DataFrame, key: str, added: str, step: Callable, after_ms: int | None = None) -> DataFrame:
    """Apply step(next, rows, late) -> (next, rows to go on, rows that wait) to each key of each batch; added: further columns.

    With after_ms, a key that waits and gets nothing for so long is stepped with late = True.
    """
    out = StructType([*rows.schema.fields, *(StructField(name, LongType()) for name in added.split(", "))])
    names = out.fieldNames()

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, held = state.get if state.exists else (0, None)
        own = joined(held, frames)
        if own is None:
            return
        first, ready, rest = step(first, own, state.hasTimedOut)
        state.update((first, packed(rest) if len(rest) else None))
        if after_ms is not None and len(rest):
            state.setTimeoutDuration(after_ms)
        if len(ready):
            yield ready[names]

    timer = GroupStateTimeout.NoTimeout if after_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, STATE, "append", timer)


# -- many keys at a time ------------------------------------------------------------------------------------------------


def integers(schema: StructType, *apart: str) -> list[str]:
    """Columns of integers that, as floats, which pandas makes of integers and nulls, would not be exact."""
    return [f.name for f in schema.fields if isinstance(f.dataType, LongType) and f.name not in apart]


def halved(rows: DataFrame, names: list[str]) -> DataFrame:
    """rows with each of the columns as two numbers of 32 bits, in front of the others."""
    halves = [h for n in names for h in (F.shiftright(n, 32).alias(f"_high_{n}"), F.col(n).bitwiseAND(0xFFFFFFFF).alias(f"_low_{n}"))]
    return rows.select(*halves, *(rows[c] for c in rows.columns if c not in names))


def restored(rows: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    whole = {n: (F.shiftleft(F.col(f"`_high_{n}`"), 32) + F.col(f"`_low_{n}`")).alias(n) for n in names}
    return rows.select(*(whole.get(c, F.col(f"`{c}`")) for c in columns))


def by_bucket(rows: DataFrame, key: str, apart: tuple[str, ...], added: str, step: Callable) -> DataFrame:
    """Apply step(codes, next of each code, rows) -> (next of each code, rows to go on, rows that wait) to BUCKETS groups of keys.

    A call steps all keys of a bucket at once, since one call for each key costs far more than its rows; codes tell its keys
    apart. Null keys, which are one key, have a bucket of their own. apart: columns that are never null.
    """
    whole = integers(rows.schema, key, *apart)
    bucket = F.when(F.col(key).isNull(), BUCKETS).otherwise(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    dealt = halved(rows, whole)
    out = StructType([*dealt.schema.fields, *(StructField(name, LongType()) for name in added.split(", "))])
    names = out.fieldNames()

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told, held = state.get if state.exists else (None, None)
        known = unpacked(told) if told else pd.DataFrame({"key": [], "next": []})
        own = joined(held, (frame.drop(columns="_bucket") for frame in frames))
        if own is None:
            return
        keys = pd.concat([known["key"], own[key]], ignore_index=True) if len(known) else own[key]
        codes, found = pd.factorize(keys, use_na_sentinel=False)
        first = np.zeros(len(found), "int64")
        first[codes[: len(known)]] = known["next"]
        first, ready, rest = step(codes[len(known) :], first, own)
        begun = first > 0
        told = packed(pd.DataFrame({"key": keys.iloc[np.unique(codes, return_index=True)[1]].array[begun], "next": first[begun]})) if begun.any() else None
        state.update((told, packed(rest) if len(rest) else None))
        if len(ready):
            yield ready[names]

    done = dealt.withColumn("_bucket", bucket).groupBy("_bucket").applyInPandasWithState(run, out, HELD, "append", GroupStateTimeout.NoTimeout)
    return restored(done, whole, [*rows.columns, *added.split(", ")])


def places(codes: np.ndarray) -> np.ndarray:
    """The place of each row among those of its code, which lie side by side."""
    begins = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, "int64")
    return np.arange(len(codes)) - np.repeat(begins, np.diff(np.r_[begins, len(codes)]))


# -- order --------------------------------------------------------------------------------------------------------------


def reordered(rows: DataFrame, key: str, index: str) -> DataFrame:
    """Of each key the rows whose index follows on from 0 without a gap, as soon as that is so, with `place`, the same number.

    Other rows wait. An index that has been released, or waits already, is a repeat, whose first row counts; rows with a null or
    negative index never follow on and are passed over.
    """

    def step(codes: np.ndarray, first: np.ndarray, own: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, pd.DataFrame]:
        own = own.assign(_code=codes)
        own = own[own[index].to_numpy() >= first[codes]].drop_duplicates(["_code", index], keep="first").sort_values(["_code", index], ignore_index=True)
        codes, at = own["_code"].to_numpy(), own[index].to_numpy().astype("int64")
        follows = at - places(codes) == first[codes]  # indices of a key are different and rise: behind a gap none is so
        first = first + np.bincount(codes[follows], minlength=len(first))
        own = own.drop(columns="_code")
        return first, own[follows].assign(place=at[follows]), own[~follows].assign(next=first[codes[~follows]])

    return by_bucket(rows.filter(F.col(index) >= 0), key, (index,), "place", step)


def chunked_by_key(rows: DataFrame, key: str, size: int, order: str, flush_after_ms: int | None = None) -> DataFrame:
    """Of each key the rows in chunks of exactly `size`, as they come: `chunk` from 0 and `place` in the chunk.

    Rows of one batch come in the order of `order`. With flush_after_ms, a chunk goes on short when nothing has come for so long;
    each key then has a timer, and a buffer, of its own.
    """
    if size < 1:
        raise ValueError("size must be at least 1")

    def step(first: int, own: pd.DataFrame, late: bool) -> tuple[int, pd.DataFrame, pd.DataFrame]:
        if "_waited" not in own:
            own = own.assign(_waited=False)
        own = own.assign(_waited=own["_waited"].eq(True)).sort_values(["_waited", order], ascending=[False, True], kind="stable", ignore_index=True)
        n = len(own) if late else len(own) // size * size
        ready, chunks = own.iloc[:n].drop(columns="_waited"), -(-n // size)
        ready = ready.assign(chunk=first + ready.index // size, place=ready.index % size)
        return first + chunks, ready, own.iloc[n:].assign(_waited=True)

    def step_many(codes: np.ndarray, first: np.ndarray, own: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame, pd.DataFrame]:
        by = [order] if order in own else [f"_high_{order}", f"_low_{order}"]
        late = ~own["_waited"].eq(True) if "_waited" in own else True
        own = own.assign(_code=codes, _late=late).sort_values(["_code", "_late", *by], kind="stable", ignore_index=True)
        codes = own["_code"].to_numpy()
        at, full = places(codes), np.bincount(codes, minlength=len(first)) // size
        goes, chunk = at < full[codes] * size, first[codes] + at // size
        own = own.drop(columns=["_code", "_late", *(c for c in ("_waited", "next") if c in own)])
        ready = own[goes].assign(chunk=chunk[goes], place=at[goes] % size)
        return first + full, ready, own[~goes].assign(_waited=True, next=(first + full)[codes[~goes]])

    return by_bucket(rows, key, (), "chunk, place", step_many) if flush_after_ms is None else stateful(rows, key, "chunk, place", step, flush_after_ms)


# -- what still waits ---------------------------------------------------------------------------------------------------


def waiting(spark: SparkSession, checkpoint: str, schema: StructType, key: str, *apart: str) -> DataFrame:
    """The rows that wait in the state of buckets under checkpoint, with `next`, what their key would release next."""
    whole = integers(schema, key, *apart)
    after = StructType([*halved(spark.createDataFrame([], schema), whole).schema.fields, StructField("next", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        told = to_arrow_schema(after)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                if held:
                    yield pa.RecordBatch.from_pandas(unpacked(held)[told.names], schema=told, preserve_index=False)

    state = spark.read.format("statestore").load(checkpoint)
    value = "value.groupState" if "groupState" in state.schema["value"].dataType.fieldNames() else "value"
    return restored(state.select(F.col(f"{value}.waiting").alias("waiting")).mapInArrow(run, after), whole, [*schema.fieldNames(), "next"])


def with_waiting(spark: SparkSession, done: DataFrame, key: str, order: str, checkpoint: str, schema: StructType, added: dict[str, Column], *apart: str) -> DataFrame:
    """done and what waits behind it, told apart by `flushed`. added: the further columns of waiting rows, by `next` and `nth`."""
    done = done.withColumn("flushed", F.lit(False))
    if not exists(spark, f"{checkpoint}/state"):
        return done
    nth = F.row_number().over(W.partitionBy(key).orderBy(order)) - 1  # of what waits, which is little
    left = waiting(spark, checkpoint, schema, key, *apart).withColumn("nth", nth.cast("bigint"))
    return done.unionByName(left.select(*schema.fieldNames(), *(c.alias(n) for n, c in added.items()), F.lit(True).alias("flushed")))


def reorder_available(spark: SparkSession, folder: str, schema: StructType, key: str, index: str, out: str, checkpoint: str, files_per_batch: int = 64) -> DataFrame:
    """Run `reordered` over the files of a folder; what it released, and behind it, as `flushed`, what waits for an index that is missing.

    Run again, it goes on with new files: what waited then is released as soon as the gap is closed.
    """
    run_available(spark, folder, schema, lambda rows: reordered(rows, key, index), out, checkpoint, files_per_batch)
    done = spark.read.schema(StructType([*schema.fields, StructField("place", LongType())])).parquet(literal(out))
    return with_waiting(spark, done, key, index, checkpoint, schema, {"place": F.col("next") + F.col("nth")}, index)


def chunk_available(spark: SparkSession, folder: str, schema: StructType, key: str, size: int, order: str, out: str, checkpoint: str, files_per_batch: int = 64) -> DataFrame:
    """Run `chunked_by_key` over the files of a folder; full chunks, and as `flushed` the short one at the end of each key."""
    run_available(spark, folder, schema, lambda rows: chunked_by_key(rows, key, size, order), out, checkpoint, files_per_batch)
    done = spark.read.schema(StructType([*schema.fields, StructField("chunk", LongType()), StructField("place", LongType())])).parquet(literal(out))
    return with_waiting(spark, done, key, order, checkpoint, schema, {"chunk": F.col("next"), "place": F.col("nth")})
