"""Results that come task by task, in order, in waves, by place and by cost."""

import asyncio
import os
import subprocess
import sys
import threading
import time
from collections import Counter
from pathlib import Path
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.functions import failure
from rillflow.operators import Fence, PipelineError
from rillflow.operators.balance import balanced, dealt
from rillflow.operators.opaque import awaited
from rillflow.operators.order import zipped
from rillflow.plans import Pipe, pipe, stream
from rillflow.plans import results as stored
from rillflow.streaming.cancel import CancellationToken

HERE = str(Path(__file__).resolve().parents[1])


def ran(script, *args):
    """A script in a session of its own."""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([HERE, os.environ.get("PYTHONPATH", "")])}
    done = subprocess.run([sys.executable, "-c", script, *map(str, args)], capture_output=True, text=True, timeout=400, env=env)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout


# -- cancellation -------------------------------------------------------------------------------------------------------


def test_cancelled_midway_every_committed_task_comes_back_once(spark):
    token, tracker, over = CancellationToken(), spark.sparkContext.statusTracker(), threading.Event()

    def slow(x):
        time.sleep(0.002)
        return x

    def watch():
        while not over.wait(0.05):
            if any(info.numCompletedTasks >= 8 for info in map(tracker.getStageInfo, tracker.getActiveStageIds()) if info):
                return token.cancel()

    threading.Thread(target=watch, daemon=True).start()
    try:
        got = stream(spark.range(0, 16_000, 1, 80).withColumnRenamed("id", "value"), seq="value").stage(slow).with_cancel(token).run()
    finally:
        over.set()
    assert token.is_cancelled() and 8 * 200 <= len(got) < 16_000
    parts = Counter(x // 200 for x in got)  # whole tasks, none twice
    assert set(parts.values()) == {200} and len(set(got)) == len(got)


def test_any_keys_under_a_token(spark):
    keys = [*range(300), 10**15, -(2**63), 2**63 - 1, None]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, value string").repartition(5)
    for p in (stream(df, seq="k"), stream(df, seq="k").fence(Fence.BARRIER)):
        got = p.with_cancel(CancellationToken()).stage("value").run()
        assert sorted(got) == sorted(map(str, keys))
    ordered = stream(df, seq="k").with_cancel(CancellationToken()).stage("value").ordered().run()
    assert ordered == ["None", *(str(k) for k in sorted(k for k in keys if k is not None))]


def test_a_task_tried_again_commits_once(tmp_path):
    script = """
import os, sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from rillflow.plans import stream
from rillflow.streaming.cancel import CancellationToken
spark = SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
def flaky(x):
    if x % 100 == 50 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")
    return x
got = stream(spark.range(0, 1000, 1, 10).withColumnRenamed("id", "value"), seq="value").stage(flaky).with_cancel(CancellationToken()).run()
print(sorted(got) == list(range(1000)))
"""
    assert "True" in ran(script, tmp_path)


# -- first errors -------------------------------------------------------------------------------------------------------


def test_an_error_in_front_leaves_most_of_the_input_unread(spark, monkeypatch):
    calls, n = spark.sparkContext.accumulator(0), 400_000

    def checked(x):
        calls.add(1)
        if x in (17, 30, 399_000):
            raise ValueError(f"bad {x}")
        return x

    from rillflow import plans

    monkeypatch.setattr(plans, "in_order", lambda *a, **k: pytest.fail("a value was asked for"))
    rows = spark.range(n).withColumnRenamed("id", "value").repartition(7)  # partitions are in no order
    with pytest.raises(PipelineError, match="bad 17") as e:
        pipe(rows, seq="value").try_map(checked).map("value + 1").try_collect()
    assert e.value.seq == 17 and 0 < calls.value < n / 5


def test_waves_cover_the_input_once_and_in_order(spark):
    rows = spark.range(60_000).withColumnRenamed("id", "value").repartition(5)
    got = [sorted(r["value"] for r in wave.collect()) for wave in stored.waves(rows, "value")]
    assert len(got) > 1 and [x for own in got for x in own] == list(range(60_000))
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x * 2

    out = pipe(rows, seq="value").try_map(counted).filter("value % 3 = 0").try_collect()
    assert out == [x * 2 for x in range(60_000) if x % 3 == 0] and calls.value == 60_000
    with pytest.raises(PipelineError, match="late"):
        pipe(rows, seq="value").try_map("value", error=F.when(F.col("value") == 59_999, failure("Late", "late"))).try_iterate()


# -- iterators ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows_each", [64, 100_000])
def test_iterators_in_order(spark, rows_each):
    df = spark.range(1000).select(F.col("id").alias("value")).repartition(6)
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return -x

    assert list(pipe(df, seq="value").map(counted).iterate(rows_each)) == [-x for x in range(1000)] and calls.value == 1000
    got = stream(df, seq="value").expand("array(value, -value)").ordered_by_position().iterate(rows_each)
    assert list(got) == [y for x in range(1000) for y in (x, -x)]
    assert sorted(stream(df, seq="value").stage("value + 1").iterate(rows_each)) == list(range(1, 1001))
    assert list(pipe([(1, "a"), (2, None)], spark, schema="i long, t string").iterate(rows_each)) == [(1, "a"), (2, None)]
    assert list(pipe([], spark, schema="value long").iterate(rows_each)) == []


def test_parts_of_numbers_are_fetched_ahead_and_in_order(spark, monkeypatch):
    from rillflow.plans import results

    plain, at_once, most = results.read, [0], [0]

    def slow(session, schema, *paths):
        at_once[0] += 1
        most[0] = max(most[0], at_once[0])
        time.sleep(0.1)
        at_once[0] -= 1
        return plain(session, schema, *paths)

    monkeypatch.setattr(results, "read", slow)
    df = spark.range(1000).selectExpr("id value", "IF(id % 3 = 0, NULL, id / 4) more", "id % 2 = 0 even").repartition(6)
    want = [(None if x % 3 == 0 else x / 4, x % 2 == 0) for x in range(1000)]
    assert list(pipe(df, seq="value").map({"more": "more", "even": "even"}).iterate(50)) == want
    assert 1 < most[0] <= 6
    text = pipe(df, seq="value").map({"t": "concat('t', value)", "d": "date_add(date'2020-01-01', int(value))"}).iterate(400)
    assert [t for t, _ in text] == [f"t{x}" for x in range(1000)]
    some = pipe(df, seq="value").map("value * 2").iterate(50)
    assert [next(some) for _ in range(60)] == [2 * x for x in range(60)]


def test_what_an_iterator_stored_goes_with_it(spark):
    top = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(top))
    some = pipe(spark.range(500).withColumnRenamed("id", "value"), seq="value").iterate(50)
    assert [next(some) for _ in range(3)] == [0, 1, 2] and set(os.listdir(top)) > before
    rows = some.gi_frame.f_locals[".0"]  # the generator of rows below the one of values
    some.close()
    rows.close()
    assert set(os.listdir(top)) == before


def test_more_items_than_the_driver_holds(tmp_path):
    script = """
import sys
from pyspark.sql import SparkSession
from rillflow.plans import pipe
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "512m").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
n, last = 0, -1
for value in pipe(spark.range(0, 1_500_000, 1, 8).selectExpr("id value", "id k").repartition(8, "k").select("value", "k"), seq="k").map({"value": "value", "text": "repeat(md5(string(value)), 8)"}).iterate():
    assert value[0] == last + 1
    n, last = n + 1, value[0]
print(n)
"""
    assert ran(script, tmp_path).strip().endswith("1500000")


# -- zip by place -------------------------------------------------------------------------------------------------------


def test_zip_after_filters_and_expansions(spark):
    items = lambda n: stream(spark.range(n).withColumnRenamed("id", "value").repartition(3), seq="value")
    named = lambda p, name: p.to_df(keep_seq=True).withColumnRenamed("value", name)
    odd = named(items(10).expand("filter(array(value), x -> x % 2 = 1)"), "a")
    even = named(items(10).expand("filter(array(value), x -> x % 2 = 0)"), "b")
    assert sorted((r["a"], r["b"]) for r in zipped(odd, even).collect()) == [(2 * k + 1, 2 * k) for k in range(5)]
    twice = named(items(10).expand("array(value, value + 100)"), "a")
    four = named(items(10).expand("array(value, value + 1, value + 2, value + 3)"), "b")
    want = list(zip([y for x in range(10) for y in (x, x + 100)], [x + k for x in range(10) for k in range(4)]))
    got = zipped(twice, four)
    assert sorted((r["_seq"], r["a"], r["b"]) for r in got.collect()) == [(k, *pair) for k, pair in enumerate(want)]
    assert zipped(odd.limit(0), even).count() == 0
    with pytest.raises(ValueError, match="rename"):
        zipped(odd, odd)


# -- failures -----------------------------------------------------------------------------------------------------------


def test_words_of_a_stage_are_no_cluster_failure(spark):
    for words in ("No active session", "SparkContext was shut down", "ExecutorLostFailure", "Could not connect"):
        with pytest.raises(Exception, match=words) as e:
            stream(spark.range(3).withColumnRenamed("id", "value"), seq="value").stage(F.raise_error(F.lit(words)).cast("long")).try_run()
        assert not isinstance(e.value, OSError)


def test_lost_executors_are_a_cluster_failure(spark):
    from rillflow.plans.failures import is_cluster_failure

    lost = "Job aborted due to stage failure: Task 0 in stage 1.0 failed 4 times, most recent failure: Lost task 0.3 in stage 1.0 (TID 7) (10.0.0.1 executor 2): {}\nDriver stacktrace:"
    assert is_cluster_failure(RuntimeError(lost.format("ExecutorLostFailure (executor 2 exited caused by one of the running tasks)")), spark)
    assert not is_cluster_failure(RuntimeError(lost.format("java.lang.RuntimeException: ExecutorLostFailure (")), spark)
    assert is_cluster_failure(RuntimeError("Job 4 cancelled because SparkContext was shut down"), spark)
    assert is_cluster_failure(ConnectionRefusedError(), spark)


# -- tasks by cost ------------------------------------------------------------------------------------------------------


def sums(df, cost):
    return [r["c"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.expr(cost)).alias("c")).collect()]


def test_tasks_of_equal_cost(spark):
    rng = np.random.default_rng(6)
    lengths = [int(x) for x in np.sort(rng.lognormal(6, 1.5, 6000)).clip(1, 50_000)]  # the dear ones together
    df = spark.createDataFrame(list(enumerate(lengths)), "_seq long, n long").repartitionByRange(16, "_seq")
    uneven = sums(df, "n")
    assert max(uneven) > 3 * median(uneven)
    out = balanced(df, "n", "_seq", tasks=16)
    even = sums(out, "n")
    assert len(even) == 16 and max(even) <= 1.5 * median(even) and sorted(r["_seq"] for r in out.collect()) == list(range(6000))
    assert out.columns == df.columns


def test_even_rows_stay_where_they_are(spark):
    df = spark.range(0, 1000, 1, 8).selectExpr("id _seq", "1 n")
    assert balanced(df, F.col("n"), "_seq") is df
    p = Pipe(df.withColumnRenamed("n", "value")).with_cost("value").map("value + 1")
    assert "Exchange" not in p.to_df()._jdf.queryExecution().executedPlan().toString()


def test_a_very_dear_item_is_alone(spark):
    df = spark.createDataFrame([(k, 10_000.0 if k == 5 else None if k == 7 else -3.0 if k == 8 else 1.0) for k in range(400)], "_seq long, n double").coalesce(1)
    out = balanced(df, "n", "_seq", tasks=6)
    parts = Counter(r["p"] for r in out.select(F.spark_partition_id().alias("p"), "_seq").collect())
    own = out.filter("_seq = 5").select(F.spark_partition_id()).first()[0]
    assert parts[own] <= 80 and sum(parts.values()) == 400  # only items that cost nothing may be with it
    assert out.filter(f"spark_partition_id() = {own} AND n > 0").count() == 1


def test_dealt():
    assert sorted(dealt([5, 1, 1, 1, 1, 1], 2)) == [0, 1, 1, 1, 1, 1] and dealt([], 3) == []


# -- calls in the order they end ----------------------------------------------------------------------------------------


def test_a_slow_call_holds_back_nothing(spark):
    async def slow(x):
        await asyncio.sleep(0.5 if x == 0 else 0.001)
        return x

    got = [v for _, _, v in awaited(((i, None, i) for i in range(200)), slow, 8)]
    assert got[-1] == 0 and sorted(got) == list(range(200))


def test_uneven_calls_take_little_longer_than_they_must():
    calls = [0]

    async def uneven(x):
        calls[0] += 1
        await asyncio.sleep(0.01 if x % 10 else 0.08)
        return x

    n, wide = 1000, 40
    begun = time.perf_counter()
    assert len(list(awaited(((i, None, i) for i in range(n)), uneven, wide))) == n and calls[0] == n
    assert time.perf_counter() - begun < 1.5 * n * (0.9 * 0.01 + 0.1 * 0.08) / wide + 0.1


def test_calls_go_on_while_results_are_used():
    running = []

    async def call(x):
        running.append(x)
        await asyncio.sleep(0.01)
        return x

    results = awaited(((i, None, i) for i in range(100)), call, 4)
    next(results)
    time.sleep(0.1)  # nothing is asked for meanwhile, but what was handed over ends
    assert len(running) >= 4
    results.close()
    assert len(running) < 100 and threading.active_count() < 50


def test_time_limits_and_second_tries():
    tries = Counter()

    async def flaky(x):
        tries[x] += 1
        if x % 5 == 0 and tries[x] <= 2:
            if x % 2:
                await asyncio.sleep(5)
            raise OSError("not yet")
        return x

    assert sorted(v for _, _, v in awaited(((i, None, i) for i in range(40)), flaky, 8, timeout=0.05, retries=2)) == list(range(40))
    assert all(n == (3 if x % 5 == 0 else 1) for x, n in tries.items())
    tries.clear()
    with pytest.raises(OSError, match="not yet"):
        list(awaited(((i, None, i) for i in range(40)), flaky, 8, timeout=0.05, retries=1))


def test_short_calls_follow_each_other_closely():
    async def short(x):
        await asyncio.sleep(0.001)
        return x

    n, wide, took = 6000, 20, []
    for _ in range(3):
        begun = time.perf_counter()
        assert len(list(awaited(((i, None, i) for i in range(n)), short, wide))) == n
        took.append(time.perf_counter() - begun)
    assert min(took) < 1.5 * n * 0.001 / wide


def test_a_call_that_is_cancelled_fails_its_item():
    async def call(x):
        if x == 50:
            raise asyncio.CancelledError("given up")
        return x

    got = []
    thread = threading.Thread(target=lambda: got.append(pytest.raises(asyncio.CancelledError, list, awaited(((i, None, i) for i in range(100)), call, 4))), daemon=True)
    thread.start()
    thread.join(10)
    assert got


def test_rows_are_dealt_evenly_to_tasks_that_make_calls(spark):
    async def same(x):
        return x

    rows = stream(spark.range(0, 3000, 1, 4).withColumnRenamed("id", "value"), seq="value").with_compute_pool(5).with_async_pool(3)
    sizes = [r["count"] for r in rows.stage_async(same).to_df().groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) == 3 and max(sizes) < 1100
    assert rows.fence().stage(lambda x: x).to_df().rdd.getNumPartitions() == 5


def test_batches_wait_for_their_own_calls_only(spark):
    async def called(i):
        await asyncio.sleep(0.3 if i == 3 else 0.0005)
        return i * 2

    rows = spark.range(0, 25_000, 1, 1).withColumnRenamed("id", "i")
    got = stream(rows, seq="i").stage_async(called, "d long", columns=("i",), timeout=10, retries=1).to_df()
    assert got.filter("d <> 2 * i").isEmpty() and got.count() == 25_000


# -- effects, files, shared tables, pools -------------------------------------------------------------------------------


def test_effects_of_a_task_tried_again_count_once(tmp_path):
    script = """
import sys
from pyspark import TaskContext
from pyspark.sql import SparkSession
from rillflow.plans import pipe
from rillflow.sinks import to_files
from rillflow.plans import Pipe
spark = SparkSession.builder.master("local[4,3]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1] + "/shared").getOrCreate()
def flaky(x):
    if x % 100 == 50 and TaskContext.get().attemptNumber() == 0:
        raise RuntimeError("first attempt")
    return x
items = pipe(spark.range(0, 1000, 1, 10).withColumnRenamed("id", "value"), seq="value").map(flaky)
print("sum", items.fold(0, lambda a, x: a + x, lambda a, b: a + b) == sum(range(1000)))
staged = items.effects(lambda x: x, "value long")
print("staged", sorted(r["value"] for r in staged.collect()) == list(range(1000)), staged.select("_effect").distinct().count() == 1000)
files = Pipe(spark.range(0, 200, 1, 4).withColumnRenamed("id", "value")).map(lambda x: {"name": f"{x % 3}/f {x} [%].bin", "content": bytes([x])} if flaky(x + 0) is not None else None, "name string, content binary")
to_files(files.to_df(), sys.argv[1] + "/out files")
import glob, os
found = {p: open(p, "rb").read() for p in glob.glob(sys.argv[1] + "/out files/*/*")}
print("files", len(found) == 200, all(os.path.basename(p) == f"f {c[0]} [%].bin" for p, c in found.items()), os.path.exists(sys.argv[1] + "/out files/_SUCCESS"), not [n for _, _, names in os.walk(sys.argv[1] + "/out files") for n in names if n.startswith("._aside")])
"""
    told = ran(script, tmp_path)
    assert "False" not in told and all(word in told for word in ("sum True", "staged True", "files True"))


def test_fold(spark):
    items = pipe(spark.range(100).withColumnRenamed("id", "value"), seq="value")
    assert items.filter("value % 2 = 0").fold(0, lambda n, _: n + 1, lambda a, b: a + b) == 50
    assert items.filter("value < 0").fold((), lambda a, x: (*a, x), lambda a, b: a + b) == ()
    words = pipe([(1, "a"), (2, "b")], spark, schema="i long, t string")
    assert sorted(words.fold("", lambda s, r: s + r["t"], lambda a, b: a + b)) == ["a", "b"]


def test_names_of_files_are_checked(spark, tmp_path):
    from rillflow.sinks import to_files

    for name in ("../up", "/root", "", "a//b", None):
        with pytest.raises(Exception, match="not the name of a file"):
            to_files(spark.createDataFrame([(name, bytearray(b"x"))], "name string, content binary"), str(tmp_path / "out"))
    to_files(spark.createDataFrame([("a", None), ("b", bytearray(b""))], "name string, content binary"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a").read_bytes() == b"" == (tmp_path / "out" / "b").read_bytes()


def test_a_table_read_by_position(spark):
    from rillflow.plans.scope import scope

    df = spark.range(25_000).selectExpr("24999 - id AS place", "concat('row ', 24999 - id) AS text", "named_struct('a', id) AS more")
    with scope(spark) as s:
        table = s.table(df, "place")
        assert len(table) == 25_000 and table.row(3) == {"place": 3, "text": "row 3", "more": {"a": 24_996}}
        got = s.pipe(spark.range(0, 25_000, 7).withColumnRenamed("id", "value"), seq="value").map(lambda i: table.value(i, "text"), "value string").collect()
        assert got == [f"row {i}" for i in range(0, 25_000, 7)]
        with pytest.raises(Exception, match="row 25000 of 25000"):
            s.pipe([25_000]).map(lambda i: table.value(i, "text"), "value string").collect()
        with pytest.raises(ValueError, match="use lookup"):
            s.table(df, "place", most_bytes=1000)


def test_a_shared_table_is_one_copy(tmp_path):
    """Four workers that read all of a large table hold little of their own."""
    script = """
import os, sys
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from rillflow.plans.scope import scope
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
with scope(spark) as s:
    table = s.table(spark.range(0, 200_000, 1, 8).select("id", F.repeat(F.md5(F.col("id").cast("string")), 32).alias("text")), "id")
    def private(i):
        total = sum(len(table.value(k, "text")) for k in range(i, 200_000, 4))
        lines = dict(line.split(":")[:2] for line in open("/proc/self/smaps_rollup") if ":" in line)
        return {"total": total, "own": sum(int(lines[k].split()[0]) for k in ("Private_Dirty",)) // 1024}
    rows = s.pipe(spark.range(0, 4, 1, 4).withColumnRenamed("id", "value"), seq="value").map(private, "total long, own long").collect()
    print(sum(r[0] for r in rows) == 200_000 * 1024, max(r[1] for r in rows))
"""
    told = ran(script, tmp_path).split()
    assert told[-2] == "True" and int(told[-1]) < 150  # MB; the table has 205


def test_jobs_in_pools_and_so_many_at_once(spark):
    from rillflow.plans.jobs import together

    seen, running, most = [], [0], [0]
    lock = threading.Lock()

    def job():
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        seen.append(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
        n = spark.range(1000).count()
        time.sleep(0.05)
        with lock:
            running[0] -= 1
        return n

    assert together(*[job] * 6, at_once=2, pools=["a", "b"]) == [1000] * 6
    assert most[0] == 2 and sorted(seen) == ["a", "a", "a", "b", "b", "b"]
    assert together() == []


def test_resources_are_seen_in_the_plan(spark):
    from pyspark.resource import ExecutorResourceRequests, ResourceProfileBuilder, TaskResourceRequests

    profile = ResourceProfileBuilder().require(ExecutorResourceRequests().cores(2).memory("3g")).require(TaskResourceRequests().cpus(2)).build

    async def same(x):
        return x

    items = stream(spark.range(10).withColumnRenamed("id", "value"), seq="value").with_resources(profile)
    for p in (items.stage(lambda x: x + 1), items.stage_async(same), items.stage_async(same, "more long", columns=("value",))):
        plan = p.to_df()._jdf.queryExecution().executedPlan().toString()
        assert "cpus, amount: 2.0" in plan and "memory, amount: 3072" in plan
    assert "amount" not in items.stage("value + 1").to_df()._jdf.queryExecution().executedPlan().toString()


def test_pools_share_cores_as_weighted(tmp_path):
    (tmp_path / "pools.xml").write_text('<allocations><pool name="much"><weight>3</weight></pool><pool name="little"><weight>1</weight></pool></allocations>')
    script = """
import sys, time
from pyspark.sql import SparkSession
from rillflow.plans import Pipe
from rillflow.plans.jobs import together
conf = {"spark.scheduler.mode": "FAIR", "spark.scheduler.allocation.file": "file://" + sys.argv[1] + "/pools.xml", "spark.ui.enabled": "false"}
builder = SparkSession.builder.master("local[4]")
for k, v in conf.items():
    builder = builder.config(k, v)
spark = builder.getOrCreate()
def late(x):
    time.sleep(0.1)
    return time.time()
job = lambda: [r["value"] for r in Pipe(spark.range(0, 60, 1, 60).withColumnRenamed("id", "value")).map(late, "value double").to_df().collect()]
job()  # workers are there now
much, little = together(job, job, pools=["much", "little"])
print(sum(t <= max(much) for t in little))
"""
    assert int(ran(script, tmp_path).split()[-1]) < 40  # 20 of 60 by the weights, 60 without
