"""Queries over the supplied tables, one or more for each operator, with the same results as DuckDB SQL.

Input order is the table's unique key, where an operator depends on it.
"""

from __future__ import annotations

import asyncio
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillflow.config import PipelineConfig, Workload
from rillflow.functions import affine_wrapping, failure
from rillflow.operators import Fence, PipelineError
from rillflow.operators.order import chunked, chunks, gap_free, zipped
from rillflow.plans import Pipe, StreamPipe, TryPipe, pipe, stream
from rillflow.plans.jobs import together
from rillflow.plans.scope import scope
from rillflow.sinks import to_files
from rillflow.sources import from_files, from_parquet, sequenced
from rillflow.sources.folders import fresh_folder, written
from rillflow.streaming import run_available
from rillflow.streaming.admission import admitted, run_by_rows
from rillflow.streaming.cancel import CancellationToken
from rillflow.streaming.state import chunk_available, reorder_available

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> Pipe:
    """Order keys as items."""
    return pipe(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value")), seq="value")


def events(spark: SparkSession, sf_dir: str) -> StreamPipe:
    """Event ids as items."""
    return stream(read(spark, sf_dir, "events").select(F.col("event_id").alias("value")), seq="value")


# -- sources, maps and filters ------------------------------------------------------------------------------------------


@query("SELECT (l_orderkey + 1) * 3 - 7 AS value FROM lineitem")
def map_chain(spark, sf_dir):
    """Three maps, which the optimizer collapses into one projection of one column."""
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("value"))
    return Pipe(keys).map("value + 1").map("value * 3").map("value - 7").to_df()


@query("SELECT o_orderkey * 10 AS value FROM orders WHERE o_orderkey % 3 = 0")
def filter_map(spark, sf_dir):
    """F1 and P1."""
    return orders(spark, sf_dir).filter("value % 3 = 0").map("value * 10").to_df()


@query("""
SELECT o_orderkey, CAST(list_reduce(list_prepend(CAST(o_orderkey AS HUGEINT), range(200)), lambda x, step: (x * 31 + 17) % 18446744073709551616) AS VARCHAR) AS value
FROM orders""")
def cpu_heavy(spark, sf_dir):
    """P1 with unsigned 64-bit wrap-around: 200 steps of x * 31 + 17."""
    keys = read(spark, sf_dir, "orders").select("o_orderkey")
    return Pipe(keys).map({"o_orderkey": F.col("o_orderkey"), "value": affine_wrapping(F.col("o_orderkey"), 31, 17, 200).cast("string")}).to_df()


@query("SELECT o_orderkey * 3 - 1 AS value FROM orders WHERE o_orderkey % 3 = 1")
def opaque_chain(spark, sf_dir):
    """P1 and F1 with Python callables: map, filter and map fused into one pass."""
    return orders(spark, sf_dir).map(lambda x: x - 1).filter(lambda x: x % 3 == 0).map(lambda x: (x + 1) * 3 - 1).to_df()


@query("SELECT l_orderkey * 2 AS value FROM lineitem")
def workload_unbalanced(spark, sf_dir):
    """The same rows, dealt to more and smaller tasks."""
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("value"))
    return Pipe(keys).with_workload(Workload.UNBALANCED).map("value * 2").to_df()


@query("SELECT o_orderkey + 5 AS value FROM orders")
def blocking_oversubscribed(spark, sf_dir):
    """A Python stage on several threads of each task."""
    return orders(spark, sf_dir).with_oversubscribe(4).map(lambda x: x + 5).to_df()


@query("SELECT doc_id, length(text)::BIGINT AS chars FROM documents")
def sized_collection(spark, sf_dir):
    """A pipe with a stage of the user's own."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return Pipe(docs).transform(lambda df: df.select("doc_id", F.length("text").cast("bigint").alias("chars"))).to_df()


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS seq, event_id FROM events")
def dense_sequence(spark, sf_dir):
    """Dense input indices, kept through a stage. The table is sorted first, since files have no order of their own."""
    rows = read(spark, sf_dir, "events").select("event_id").repartitionByRange("event_id").sortWithinPartitions("event_id")
    return stream(rows).to_df(keep_seq=True).select(F.col("_seq").alias("seq"), "event_id")


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS seq, o_orderkey FROM orders")
def dense_file(spark, sf_dir):
    """S2 and S4 over a table: dense indices from the row numbers that files know. This table is stored by order key."""
    rows = stream(from_parquet(spark, f"{sf_dir}/orders.parquet", "o_orderkey"))
    return rows.to_df(keep_seq=True).select(F.col("_seq").alias("seq"), "o_orderkey")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS seq, n_nationkey::BIGINT + 1 AS value FROM nation")
def driver_items(spark, sf_dir):
    """S1 and S3 over a collection of the driver, which keeps its order: the keys of nations, which are few at any size."""
    keys = sorted(r["n_nationkey"] for r in read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint")).collect())
    return pipe(iter(keys), spark).map("value + 1").to_df(keep_seq=True).select(F.col("_seq").alias("seq"), "value")


# -- fallible chains ----------------------------------------------------------------------------------------------------


def checked_events(spark: SparkSession, sf_dir: str) -> TryPipe:
    """Events whose id, from 300 on, is a multiple of 100 fail; those of small value are dropped."""
    rows = pipe(read(spark, sf_dir, "events").select("event_id", "value"), seq="event_id")
    bad = (F.col("event_id") >= 300) & (F.col("event_id") % 100 == 0)
    mapped = rows.try_map({"event_id": F.col("event_id"), "value": F.col("value") * 2}, error=F.when(bad, failure("Bad", F.concat(F.lit("bad "), F.col("event_id")))))
    return mapped.filter("value >= 10").map({"event_id": F.col("event_id") * 2, "value": F.col("value")})


@query("SELECT event_id AS seq, 'Bad' AS kind, 'bad ' || event_id AS msg FROM events WHERE event_id >= 300 AND event_id % 100 = 0 ORDER BY event_id LIMIT 1")
def try_first_err(spark, sf_dir):
    """The error of the smallest input index."""
    return checked_events(spark, sf_dir).first_error_df()


@query("SELECT event_id * 2 AS event_id, value * 2 AS value FROM events WHERE NOT (event_id >= 300 AND event_id % 100 = 0) AND value * 2 >= 10")
def try_ok_values(spark, sf_dir):
    """The values of a fallible chain."""
    return checked_events(spark, sf_dir).ok_df()


@query("""
SELECT kind, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 7 = 0 THEN 'Wrapped.Seven' WHEN (event_id + 1) % 5 = 0 THEN 'Five' END AS kind FROM events)
WHERE kind IS NOT NULL GROUP BY kind""")
def map_err_kinds(spark, sf_dir):
    """map_err rewrites the errors raised before it and leaves later ones alone."""
    rows = pipe(read(spark, sf_dir, "events").select(F.col("event_id").alias("value")), seq="value")
    chain = rows.try_map("value + 1", error=F.when(F.col("value") % 7 == 0, failure("Seven", "multiple of seven")))
    chain = chain.map_err(lambda e: failure(F.concat(F.lit("Wrapped."), e["kind"]), e["msg"]))
    chain = chain.try_map("value", error=F.when(F.col("value") % 5 == 0, failure("Five", "multiple of five")))
    return chain.errors_df().groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL")
def parse_try_cast(spark, sf_dir):
    """T1 on built-in fallible functions: a null is the failure."""
    rows = pipe(read(spark, sf_dir, "events").select("event_id", "props"), seq="event_id")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return rows.try_map({"k": k, "event_id": F.col("event_id")}, kind="NotANumber").ok_df().select("event_id", "k")


@query("SELECT event_id AS seq, 'ValueError' AS kind, 'odd ' || event_id AS msg FROM events WHERE event_id % 2 = 1 AND event_id >= 500 ORDER BY 1 LIMIT 1")
def opaque_try(spark, sf_dir):
    """T1 with a Python callable that raises."""

    def even(x: int) -> int:
        if x % 2 and x >= 500:
            raise ValueError(f"odd {x}")
        return x // 2

    rows = pipe(read(spark, sf_dir, "events").select(F.col("event_id").alias("value")), seq="value")
    return rows.try_map(even).first_error_df()


@query("""
SELECT (event_id * 2)::VARCHAR AS seq, 'Bad' AS kind, 'bad ' || event_id AS msg FROM events
WHERE event_id * 2 >= (SELECT count(*) FROM events) // 20 AND event_id % 10 = 7 ORDER BY event_id LIMIT 1""")
def try_collect_stops(spark, sf_dir):
    """T5: the first error ends the run early; the waves of input behind it are never started."""
    rows = read(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("seq"), F.col("event_id").alias("value"))
    late = rows.count() // 20
    chain = pipe(rows, seq="seq").map({"value": "value"}).try_map("value", error=F.when((F.col("value") * 2 >= late) & (F.col("value") % 10 == 7), failure("Bad", F.concat(F.lit("bad "), F.col("value")))))
    told = []
    try:
        chain.try_collect()
    except PipelineError as e:
        told.append((str(e.seq), e.kind, e.msg))
    return spark.createDataFrame(told, "seq string, kind string, msg string")


# -- expansion ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL")
def expand_words(spark, sf_dir):
    """Documents to words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = stream(docs, seq="doc_id").expand(F.split("text", " ")).to_df(keep_seq=True)
    return out.select(F.col("_seq").alias("doc_id"), F.col("value").alias("word"))


@query("SELECT (event_id * 10 + k) * 3 AS value FROM events, range(3) t(k)")
def expand_fixed(spark, sf_dir):
    """Every item to three, then a stage."""
    return events(spark, sf_dir).expand("array(value * 10, value * 10 + 1, value * 10 + 2)").stage("value * 3").to_df()


@query("SELECT (event_id * 10 + k) * 3 AS value FROM events, range(3) t(k) WHERE event_id % 4 <> 0")
def opaque_expand(spark, sf_dir):
    """E1 with a Python generator; a fourth of the items gives none."""
    return events(spark, sf_dir).expand(lambda x: [x * 10 + k for k in range(3)] if x % 4 else []).stage(lambda x: x * 3).to_df()


@query("SELECT event_id AS value FROM events WHERE event_id % 3 = 0")
def stream_filter(spark, sf_dir):
    """A filter inside a stream is an expansion to none or one."""
    return events(spark, sf_dir).expand("CASE WHEN value % 3 = 0 THEN array(value) ELSE array() END").to_df()


@query("SELECT '`.ordered()` is incompatible with `.expand()`; see ordered_by_position' AS message, count(*) AS n FROM events")
def expansion_refused(spark, sf_dir):
    """An ordered stream that expands is refused before anything runs; its items are as they were."""
    rows = events(spark, sf_dir).expand("array(value, value)").ordered()
    try:
        message = f"{rows.run()}"
    except ValueError as e:
        message = str(e)
    return rows.source.agg(F.count("*").alias("n")).select(F.lit(message).alias("message"), "n")


# -- fences, order, asynchronous calls ----------------------------------------------------------------------------------


@query("SELECT event_id // 64 AS chunk, count(*) AS n, min(event_id) AS first_seq, max(event_id) AS last_seq, sum(user_id)::BIGINT AS users FROM events GROUP BY 1")
def fence_chunk(spark, sf_dir):
    """Chunks of consecutive items."""
    return chunked(read(spark, sf_dir, "events"), 64, "event_id", F.sum("user_id").alias("users"))


@query("SELECT (l_orderkey + 1) * 2 AS value FROM lineitem")
def barrier_two_stage(spark, sf_dir):
    """B1 and B2: what precedes the fence is stored in the shared folder before what follows starts."""
    keys = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("value"))
    return StreamPipe(keys).stage("value + 1").fence(Fence.BARRIER).stage("value * 2").to_df()


@query("SELECT (event_id + 1) * 5 AS value FROM events")
def chunked_fence(spark, sf_dir):
    """A chunked fence between two Python stages leaves rows as they are."""
    return events(spark, sf_dir).stage(lambda x: x + 1).fence(Fence.CHUNKED, 25).stage(lambda x: x * 5).to_df()


@query("SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS place, event_id * 2 + 1 AS value FROM events")
def ordered_stream(spark, sf_dir):
    """The rows of an ordered stream, numbered as they come out, since a comparison of tables has no order."""
    shuffled = stream(read(spark, sf_dir, "events").select(F.col("event_id").alias("value")).repartition("value"), seq="value")
    return sequenced(shuffled.stage("value * 2 + 1").ordered().to_df()).select(F.col("_seq").alias("place"), "value")


@query("SELECT (event_id * 10 + k) AS value, (row_number() OVER (ORDER BY event_id, k) - 1)::BIGINT AS place FROM events, range(3) t(k)")
def ordered_expansion(spark, sf_dir):
    """The items of each expansion stay together and in their order."""
    rows = events(spark, sf_dir).expand("array(value * 10, value * 10 + 1, value * 10 + 2)").ordered_by_position()
    return sequenced(rows.to_df()).select("value", F.col("_seq").alias("place"))


@query("SELECT (event_id + 1) * 2 AS value FROM events")
def cancellable_run(spark, sf_dir):
    """A run under a token that nobody cancels, a job before the barrier and one behind it, committed task by task."""
    rows = events(spark, sf_dir).with_cancel(CancellationToken()).stage("value + 1").fence(Fence.BARRIER).stage(lambda x: x * 2)
    return rows.to_df()


@query("SELECT event_id // 64 AS chunk, string_agg(user_id::VARCHAR, ',' ORDER BY event_id) AS users FROM events GROUP BY 1")
def chunk_items(spark, sf_dir):
    """Each 64 consecutive items as one row, in input order."""
    return chunks(read(spark, sf_dir, "events"), 64, "event_id", "user_id").select("chunk", F.array_join("items", ",").alias("users"))


@query("SELECT event_id, value FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id % 500 = 499)")
def reorder_prefix(spark, sf_dir):
    """What can be released in order before the first gap."""
    return gap_free(read(spark, sf_dir, "events").filter("event_id % 500 <> 499").select("event_id", "value"), "event_id")


@query("SELECT o_orderkey * 2 + 1 AS value FROM orders")
def async_enrich(spark, sf_dir):
    """A coroutine for each item, which waits a millisecond; many wait at once, in all tasks that cores allow."""

    async def looked_up(x: int) -> int:
        await asyncio.sleep(0.001)
        return x * 2

    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value"))
    rows = StreamPipe(keys, config=PipelineConfig(io_concurrency=2048)).with_workload(Workload.UNBALANCED)
    return rows.stage_async(looked_up).stage(lambda x: x + 1).to_df()


@query("SELECT o_orderkey * 2 AS value FROM orders")
def async_uneven(spark, sf_dir):
    """P5: nine calls of ten wait 1 ms, one waits 8 ms, and holds back no other; each has a time limit and a second try."""

    async def looked_up(x: int) -> int:
        await asyncio.sleep(0.001 if x % 10 else 0.008)
        return x * 2

    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value"))
    rows = StreamPipe(keys, config=PipelineConfig(io_concurrency=2048)).with_workload(Workload.UNBALANCED)
    return rows.stage_async(looked_up, timeout=30.0, retries=1).to_df()


@query("SELECT doc_id, length(text)::BIGINT AS chars, len(string_split(text, ' '))::BIGINT AS words FROM documents WHERE text IS NOT NULL")
def cost_balanced(spark, sf_dir):
    """A Python stage whose work grows with the text, in tasks of nearly equal numbers of characters."""
    docs = pipe(read(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL"), seq="doc_id")
    measured = lambda d: {"doc_id": d["doc_id"], "chars": len(d["text"]), "words": len(d["text"].split(" "))}
    return docs.with_cost(F.length("text")).map(measured, "doc_id long, chars long, words long").to_df()


@query("""
WITH u AS (SELECT user_id, event_id, value, event_id % 97 = 13 AS gone, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events),
g AS (SELECT *, min(CASE WHEN gone THEN idx END) OVER (PARTITION BY user_id) AS gap FROM u),
k AS (SELECT *, gap IS NOT NULL AND idx > gap AS flushed FROM g WHERE NOT gone)
SELECT user_id, event_id, value, flushed,
       (CASE WHEN flushed THEN gap - 1 + row_number() OVER (PARTITION BY user_id, flushed ORDER BY idx) ELSE idx END)::BIGINT AS place FROM k""")
def reorder_stream(spark, sf_dir):
    """B6 over micro-batches: events out of order, a buffer for each user; behind a missing one the rest is flushed at the end."""
    index = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    rows, top = read(spark, sf_dir, "events").select("user_id", "event_id", "value").withColumn("idx", index).filter("event_id % 97 <> 13"), fresh_folder(spark, "reorder")
    rows.repartition(4, F.crc32(F.col("event_id").cast("string"))).write.parquet(f"{top}/in")
    done = reorder_available(spark, f"{top}/in", rows.schema, "user_id", "idx", f"{top}/out", f"{top}/offsets", 1)
    return done.select("user_id", "event_id", "value", "flushed", "place")


@query("""
SELECT user_id, c AS chunk, least(7, n - 7 * c)::BIGINT AS n, n < 7 * (c + 1) AS flushed
FROM (SELECT user_id, n, unnest(range((n + 6) // 7)) AS c FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id))""")
def chunk_stream(spark, sf_dir):
    """B4 over micro-batches: chunks of exactly seven events of each user, wherever batches are cut, and the short one at the end."""
    rows, top = read(spark, sf_dir, "events").select("user_id", "event_id"), fresh_folder(spark, "chunks")
    rows.repartition(3, "event_id").write.parquet(f"{top}/in")
    done = chunk_available(spark, f"{top}/in", rows.schema, "user_id", 7, "event_id", f"{top}/out", f"{top}/offsets", 1)
    return done.groupBy("user_id", "chunk", "flushed").agg(F.count("*").alias("n"))


@query("SELECT n, count(*) AS batches, sum(total)::BIGINT AS total FROM (SELECT count(*) AS n, sum(event_id + 1) AS total FROM events GROUP BY event_id // 4000) GROUP BY n")
def admitted_rows(spark, sf_dir):
    """B3 over micro-batches: batches of 4000 consecutive events, the last one the rest, many of them taken side by side."""
    rows, top = read(spark, sf_dir, "events").select(F.col("event_id").alias("_seq"), F.col("event_id").alias("value")), fresh_folder(spark, "admitted")
    admitted(rows, 4000, f"{top}/in")
    done = run_by_rows(spark, f"{top}/in", rows.schema, lambda df: StreamPipe(df).stage("value + 1").to_df(keep_seq=True), f"{top}/out", f"{top}/offsets", 4000)
    return done.groupBy("batch").agg(F.count("*").alias("n"), F.sum("value").alias("t")).groupBy("n").agg(F.count("*").alias("batches"), F.sum("t").alias("total"))


@query("SELECT event_id * 3 + 1 AS value FROM events")
def stream_available_now(spark, sf_dir):
    """S2 in micro-batches: a file source read to its end."""
    rows, top = read(spark, sf_dir, "events"), fresh_folder(spark, "available")
    rows.select("event_id").write.parquet(f"{top}/in")

    def stages(df: DataFrame) -> DataFrame:
        return StreamPipe(df.withColumnRenamed("event_id", "value")).stage("value * 3").stage("value + 1").to_df()

    return run_available(spark, f"{top}/in", rows.select("event_id").schema, stages, f"{top}/out", f"{top}/offsets")


# -- scopes and terminals -----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, length(n_name)::BIGINT AS size FROM customer JOIN nation ON c_nationkey = n_nationkey")
def scoped_lookup(spark, sf_dir):
    """A lookup that fails on a miss; the table is broadcast after its size is checked."""
    with scope(spark) as s:
        left = s.pipe(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), seq="c_custkey")
        found = s.lookup(left, read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
        return found.map({"c_custkey": F.col("c_custkey"), "size": F.length("n_name").cast("bigint")}).to_df()


@query("SELECT c_custkey, c_nationkey + length(n_name)::BIGINT AS size FROM customer JOIN nation ON c_nationkey = n_nationkey")
def shared_table(spark, sf_dir):
    """A table that Python stages read by position, one copy on each machine; nation keys are positions."""
    with scope(spark) as s:
        names = s.table(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
        rows = s.pipe(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), seq="c_custkey")
        sized = lambda c: {"c_custkey": c["c_custkey"], "size": c["c_nationkey"] + len(names.value(c["c_nationkey"], "n_name"))}
        return written(rows.map(sized, "c_custkey long, size long").to_df(), "shared-table")


@query("SELECT sum(o_orderkey)::BIGINT AS total, count(*) AS n FROM orders")
def for_each_sum(spark, sf_dir):
    """K2: what a shared counter adds up, as an aggregate with partial sums."""
    return orders(spark, sf_dir).aggregate(total=F.sum("value"), n=F.count("*"))


@query("SELECT bit_xor((o_orderkey + 1) * 2)::BIGINT AS checksum FROM orders")
def for_each_xor(spark, sf_dir):
    """K2."""
    return orders(spark, sf_dir).map("(value + 1) * 2").aggregate(checksum=F.bit_xor("value"))


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def two_jobs_at_once(spark, sf_dir):
    """Two actions that the cluster works on side by side."""
    names = ["events", "orders"]
    counts = together(*(read(spark, sf_dir, n).count for n in names))
    return spark.createDataFrame(list(zip(names, counts)), "name string, n long")


@query("""
SELECT a, b FROM (SELECT event_id * 2 AS a, row_number() OVER (ORDER BY event_id) AS k FROM events)
JOIN (SELECT o_orderkey + 1 AS b, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) USING (k)""")
def zip_two_runs(spark, sf_dir):
    """Two results side by side by place."""
    a = events(spark, sf_dir).stage("value * 2").to_df(keep_seq=True).withColumnRenamed("value", "a")
    b = orders(spark, sf_dir).map("value + 1").to_df(keep_seq=True).withColumnRenamed("value", "b")
    return zipped(a, b).select("a", "b")


@query("""
WITH a AS (SELECT event_id AS a, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_id % 2 = 1),
b AS (SELECT o_orderkey * 10 + t.j AS b, row_number() OVER (ORDER BY o_orderkey, t.j) AS k FROM orders, range(2) t(j) WHERE o_orderkey % 3 = 0)
SELECT a, b FROM a JOIN b USING (k)""")
def zip_by_place(spark, sf_dir):
    """Zip of a filtered with a filtered and expanded result: by place, since their input indices have gaps and repeats."""
    a = events(spark, sf_dir).transform(lambda df: df.filter("value % 2 = 1")).to_df(keep_seq=True).withColumnRenamed("value", "a")
    kept = events_of_orders(spark, sf_dir).expand("array(value * 10, value * 10 + 1)").to_df(keep_seq=True).withColumnRenamed("value", "b")
    return zipped(a, kept).select("a", "b")


def events_of_orders(spark: SparkSession, sf_dir: str) -> StreamPipe:
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value")).filter("value % 3 = 0")
    return stream(keys, seq="value")


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS size, md5(text) AS digest, doc_id % 1000 AS part FROM documents")
def doc_pipeline(spark, sf_dir):
    """Read, compute, write: an asynchronous stage, a declarative one and an asynchronous one.

    The coroutines get the columns that they need; texts pass by in Arrow.
    """

    async def located(doc_id: int) -> int:
        await asyncio.sleep(0.001)
        return doc_id % 1000

    async def acknowledged(doc_id: int) -> int:
        await asyncio.sleep(0.001)
        return doc_id

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = StreamPipe(docs, config=PipelineConfig(io_concurrency=2048)).with_workload(Workload.SPREAD).stage_async(located, "part long", columns=("doc_id",))
    rows = rows.stage({"doc_id": F.col("doc_id"), "size": F.length("text").cast("bigint"), "digest": F.md5("text"), "part": F.col("part")})
    return rows.stage_async(acknowledged, "doc_id long", columns=("doc_id",)).to_df()


@query("SELECT sum(o_orderkey)::BIGINT AS total, count(*) AS n FROM orders")
def for_each_calls(spark, sf_dir):
    """K2 and K5: a call on each item where it is, here on shared counters."""
    total, n = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    with scope(spark) as s:
        s.pipe(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value")), seq="value").for_each(lambda x: (total.add(x), n.add(1)))
    return spark.createDataFrame([(total.value, n.value)], "total long, n long")


@query("SELECT sum(o_orderkey)::BIGINT AS total, count(*) AS n, max(o_orderkey) AS most, bit_xor(o_orderkey)::BIGINT AS checksum FROM orders")
def for_each_once(spark, sf_dir):
    """K2 and K5: effects of all items on one shared value, each once however often a task is tried."""
    add = lambda s, x: (s[0] + x, s[1] + 1, max(s[2], x), s[3] ^ x)
    both = lambda s, t: (s[0] + t[0], s[1] + t[1], max(s[2], t[2]), s[3] ^ t[3])
    return spark.createDataFrame([orders(spark, sf_dir).fold((0, 0, 0, 0), add, both)], "total long, n long, most long, checksum long")


@query("SELECT custkey, n, md5(custkey || ':' || n) AS receipt FROM (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
def staged_effects(spark, sf_dir):
    """K5: effects as rows, staged by the attempt that commits, then applied by a job of their own."""
    rows = pipe(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), seq="o_orderkey")
    staged = rows.effects(lambda o: {"custkey": o["o_custkey"], "n": 1}, "custkey long, n long")
    return staged.groupBy("custkey").agg(F.sum("n").alias("n")).withColumn("receipt", F.md5(F.concat_ws(":", "custkey", "n")))


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, md5(coalesce(text, '')) AS digest FROM documents")
def files_there_and_back(spark, sf_dir):
    """S1 over files: documents packed and written as a file each, found there, unpacked and compared byte for byte."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))
    packed = Pipe(docs).map(lambda d: {"name": f"{d['doc_id'] % 16:02d}/{d['doc_id']}.z", "content": zlib.compress(d["content"])}, "name string, content binary")
    place = fresh_folder(spark, "files")
    to_files(packed.to_df(), place)
    found = Pipe(from_files(spark, place, "*.z")).map(lambda f: {"doc_id": int(f["path"].rpartition("/")[2][:-2]), "content": zlib.decompress(f["content"])}, "doc_id long, content binary")
    return found.map({"doc_id": "doc_id", "bytes": F.octet_length("content").cast("bigint"), "digest": F.md5("content")}).to_df()


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS place, n_nationkey * 2 AS value FROM nation")
def collected_values(spark, sf_dir):
    """K1, K3 and T5: the values of a fallible chain on the driver, in input order; nations are few at any size."""
    rows = pipe(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("value")), seq="value")
    values = rows.try_map("value * 2", error=F.when(F.col("value") < 0, failure("Negative", "below zero"))).try_collect()
    return spark.createDataFrame(list(enumerate(values)), "place long, value int")


@query("SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS place, n_nationkey + 1 AS value FROM nation")
def run_values(spark, sf_dir):
    """K6 and K7: an ordered run with a chunked fence, whose items come to the driver."""
    rows = stream(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("value")), seq="value")
    return spark.createDataFrame(list(enumerate(rows.stage(lambda x: x + 1).fence(Fence.CHUNKED, 7).ordered().try_run())), "place long, value int")


@query("SELECT count(*) AS n, min(o_orderkey) * 3 AS first, max(o_orderkey) * 3 AS last, sum(o_orderkey * 3)::BIGINT AS total, true AS in_order FROM orders")
def collect_iterated(spark, sf_dir):
    """K1 and K4: all results in input order through an iterator, of which the driver holds a bounded part; here they are only looked at."""
    dealt = pipe(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value")).repartition("value"), seq="value")
    return looked_through(spark, dealt.map("value * 3").iterate(rows_each=20_000))


@query("SELECT 2 * count(*) AS n, min(event_id) * 10 AS first, max(event_id) * 10 + 1 AS last, sum(event_id * 20 + 1)::BIGINT AS total, true AS in_order FROM events")
def run_iterated(spark, sf_dir):
    """K6: a stream that expands, in the order of its input, through an iterator."""
    return looked_through(spark, events(spark, sf_dir).expand("array(value * 10, value * 10 + 1)").ordered_by_position().iterate(rows_each=20_000))


def looked_through(spark: SparkSession, values: Iterator[int]) -> DataFrame:
    """One row about values as they come by."""
    n, total, first, last, in_order = 0, 0, None, None, True
    for value in values:
        in_order = in_order and (last is None or last < value)
        n, total, first, last = n + 1, total + value, value if first is None else first, value
    return spark.createDataFrame([(n, first, last, total, in_order)], "n long, first long, last long, total long, in_order boolean")


@query("SELECT o_orderkey + 100 AS value FROM orders WHERE o_orderkey % 7 IN (1, 2, 4)")
def scoped_filter(spark, sf_dir):
    """Python stages that read a shared value."""
    with scope(spark) as s:
        wanted, plus = frozenset((1, 2, 4)), 100
        rows = s.pipe(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value")), seq="value")
        return rows.filter(lambda x: x % 7 in wanted).map(lambda x: x + plus).to_df()


@query("SELECT event_id AS value FROM events")
def untouched(spark, sf_dir):
    """No stage."""
    return events(spark, sf_dir).to_df()


@query("SELECT event_id * 2 + 1 AS value FROM events")
def configured(spark, sf_dir):
    """Options change how the work is dealt out, not what comes out."""

    async def twice(x: int) -> int:
        await asyncio.sleep(0.001)
        return x * 2

    options = PipelineConfig().with_compute_workers(3).with_async_workers(2).with_buffer_size(100).with_io_concurrency(64)
    return events(spark, sf_dir).with_config(options).stage_async(twice).stage(lambda x: x + 1).with_compute_pool(5).with_async_pool(3).to_df()
