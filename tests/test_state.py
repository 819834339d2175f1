"""Order, chunks and admission across micro-batches."""

from collections import Counter, defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillflow.streaming import state as st
from rillflow.streaming.admission import admitted, run_by_rows
from rillflow.streaming.state import chunk_available, reorder_available

SCHEMA = "user long, idx long, text string, at timestamp"


def rows_of(spark, rows):
    return spark.createDataFrame([(u, i, t) for u, i, t in rows], "user long, idx long, text string").withColumn("at", F.timestamp_seconds(F.coalesce("idx", F.lit(0)) + 1_700_000_000))


def arrive(spark, rows, place):
    rows_of(spark, rows).coalesce(1).write.mode("append").parquet(place)


def test_reordering_across_batches_and_restarts(spark, tmp_path):
    places = (str(tmp_path / "out"), str(tmp_path / "offsets"), 1)
    schema = rows_of(spark, [(1, 1, "")]).schema
    go = lambda: reorder_available(spark, str(tmp_path / "in"), schema, "user", "idx", *places).collect()
    told = lambda rows: sorted((str(r["user"]), r["place"], r["idx"], r["text"], r["flushed"]) for r in rows)
    arrive(spark, [(1, 2, "c"), (1, 0, "a"), (2, 1, "y"), (None, 0, "n")], str(tmp_path / "in"))
    arrive(spark, [(1, 4, "e"), (1, 5, "f"), (2, 3, "?")], str(tmp_path / "in"))
    first = told(go())
    assert first == [("1", 0, 0, "a", False), ("1", 1, 2, "c", True), ("1", 2, 4, "e", True), ("1", 3, 5, "f", True), ("2", 0, 1, "y", True), ("2", 1, 3, "?", True), ("None", 0, 0, "n", False)]
    assert told(go()) == first  # nothing new, nothing twice
    arrive(spark, [(1, 1, "b"), (1, 3, "d"), (1, 0, "again"), (1, 5, "again"), (2, 0, "x"), (3, None, "no index"), (3, -1, "neither")], str(tmp_path / "in"))
    got = go()
    assert told(got) == [*(("1", k, k, t, False) for k, t in enumerate("abcdef")), ("2", 0, 0, "x", False), ("2", 1, 1, "y", False), ("2", 2, 3, "?", True), ("None", 0, 0, "n", False)]
    assert all(r["at"].timestamp() == 1_700_000_000 + r["idx"] for r in got)


def test_reordering_by_a_plain_buffer(spark, tmp_path):
    import random

    rng, rows = random.Random(3), []
    for user in range(12):
        rows += [(user, i, f"{user}:{i}") for i in range(rng.randrange(40)) if rng.random() < 0.93]
    rng.shuffle(rows)
    batches = [rows[k::5] for k in range(5)]
    for batch in batches:
        arrive(spark, batch, str(tmp_path / "in"))
    got = defaultdict(dict)
    for r in reorder_available(spark, str(tmp_path / "in"), rows_of(spark, rows).schema, "user", "idx", str(tmp_path / "out"), str(tmp_path / "offsets"), 1).collect():
        got[r["user"]][r["place"]] = (r["idx"], r["flushed"])
    for user in {u for u, _, _ in rows}:
        own = sorted(i for u, i, _ in rows if u == user)
        gap = next(k for k in range(len(own) + 1) if k not in own)
        assert [got[user][k] for k in range(len(own))] == [(i, i > gap) for i in own]


@pytest.mark.parametrize("cuts", [1, 4])
def test_chunks_over_any_cut(spark, tmp_path, cuts):
    rows = [(u, i, f"{u}:{i}") for u in range(6) for i in range(u * 5)]
    for k in range(cuts):
        arrive(spark, rows[k::cuts], str(tmp_path / "in"))
    schema = rows_of(spark, rows).schema
    go = lambda: chunk_available(spark, str(tmp_path / "in"), schema, "user", 4, "idx", str(tmp_path / "out"), str(tmp_path / "offsets"), 1).collect()
    got = go()
    assert sorted((r["user"], r["idx"]) for r in got) == sorted((u, i) for u, i, _ in rows)
    sizes = Counter((r["user"], r["chunk"], r["flushed"]) for r in got)
    assert sizes == {(u, c, c == u * 5 // 4): 4 if c < u * 5 // 4 else u * 5 % 4 for u in range(6) for c in range(-(-u * 5 // 4))}
    assert sorted((r["user"], r["chunk"], r["place"]) for r in got) == sorted((u, i // 4, i % 4) for u, i, _ in rows)
    if cuts == 1:
        assert [r["idx"] for r in sorted((r for r in got if r["user"] == 5), key=lambda r: (r["chunk"], r["place"]))] == list(range(25))
    arrive(spark, [(1, 100, "new"), (1, 101, "new"), (1, 102, "new")], str(tmp_path / "in"))  # the short chunk fills up
    after = Counter((r["chunk"], r["flushed"]) for r in go() if r["user"] == 1)
    assert after == {(0, False): 4, (1, False): 4}


def test_a_timer_flushes_a_short_chunk(monkeypatch):
    """The step under a state of our own: three items wait, then the time is up."""
    held = {}

    class State(SimpleNamespace):
        exists = property(lambda self: bool(held))
        get = property(lambda self: held["value"])

        def update(self, value):
            held["value"] = value

        def setTimeoutDuration(self, ms):
            held["timer"] = ms

    found = {}
    rows = SimpleNamespace(schema=st.StructType([st.StructField("idx", st.LongType())]), groupBy=lambda key: SimpleNamespace(applyInPandasWithState=lambda run, *rest: found.update(run=run, rest=rest)))
    st.chunked_by_key(rows, "user", 2, "idx", flush_after_ms=5000)
    assert found["rest"][-1] == st.GroupStateTimeout.ProcessingTimeTimeout
    step = lambda items, late=False: [list(zip(f["idx"], f["chunk"], f["place"])) for f in found["run"]((1,), iter([pd.DataFrame({"idx": items})] if items else []), State(hasTimedOut=late))]
    assert step([2, 1, 3]) == [[(1, 0, 0), (2, 0, 1)]] and held["timer"] == 5000
    assert step([], late=True) == [[(3, 1, 0)]] and held["value"] == (2, None)
    assert step([4]) == [] and step([0]) == [[(4, 2, 0), (0, 2, 1)]]
    with pytest.raises(ValueError):
        st.chunked_by_key(rows, "user", 0, "idx")


def test_batches_of_so_many_rows(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b, 1, 5).selectExpr("id _seq", "concat('t', id) value")
    place = str(tmp_path / "in [x]")
    admitted(rows(0, 1050), 100, place)
    go = lambda: run_by_rows(spark, place, rows(0, 1).schema, lambda df: df.selectExpr("_seq", "upper(value) value"), str(tmp_path / "out"), str(tmp_path / "offsets"))
    got = go()
    assert Counter(r["count"] for r in got.groupBy("batch").count().collect()) == {100: 10, 50: 1}
    assert all(r["hi"] - r["lo"] + 1 == r["n"] for r in got.groupBy("batch").agg(F.max("_seq").alias("hi"), F.min("_seq").alias("lo"), F.count("*").alias("n")).collect())
    assert go().count() == 1050  # run again: nothing new
    admitted(rows(1100, 1200), 100, place)
    got = go()
    assert got.count() == 1150 and got.select("batch").distinct().count() == 12
    assert got.filter("value <> concat('T', _seq)").isEmpty()
    with pytest.raises(ValueError):
        admitted(rows(0, 1), 0, place)


def test_many_chunks_in_one_micro_batch(spark, tmp_path):
    rows = lambda a, b: spark.range(a, b, 1, 5).selectExpr("id _seq", "concat('t', id) value")
    place, out = str(tmp_path / "in"), tmp_path / "out"
    admitted(rows(0, 1050), 25, place)
    go = lambda: run_by_rows(spark, place, rows(0, 1).schema, lambda df: df.filter("_seq <> 30").selectExpr("_seq", "upper(value) value"), str(out), str(tmp_path / "offsets"), 25, 16)
    sizes = lambda df: {r["batch"]: (r["n"], r["lo"], r["hi"]) for r in df.groupBy("batch").agg(F.count("*").alias("n"), F.min("_seq").alias("lo"), F.max("_seq").alias("hi")).collect()}
    got = go()
    assert got.columns == ["_seq", "value", "batch"] and got.filter("value <> concat('T', _seq)").isEmpty()
    assert sizes(got) == {k: (24 if k == 1 else 25, 25 * k, 25 * k + 24) for k in range(42)}
    assert len(list(out.glob("_taken=*"))) == 3  # 42 chunks, 16 at once
    admitted(rows(1050, 1060), 25, place)
    assert sizes(go())[42] == (10, 1050, 1059) and len(list(out.glob("_taken=*"))) == 4
    with pytest.raises(ValueError, match="_seq"):
        run_by_rows(spark, place, rows(0, 1).schema, lambda df: df.select("value"), str(out), str(tmp_path / "others"), 25)
    with pytest.raises(ValueError):
        run_by_rows(spark, place, rows(0, 1).schema, lambda df: df, str(out), str(tmp_path / "others"), at_once=4)


def test_keys_of_a_bucket_are_stepped_together(spark, tmp_path):
    """Large integers beside nulls, text keys, null keys: told apart and exact, and few calls for many keys."""
    big = (1 << 62) + 1
    rows = [(None if u == 3 else f"u{u}", i, None if (u + i) % 5 == 0 else (-1) ** i * (big + u * 100 + i)) for u in range(3000) for i in range(4)]
    df = spark.createDataFrame(rows, "user string, idx long, more long")
    for k in range(2):
        df.filter(F.col("idx") % 2 == 1 - k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    place = lambda name: str(tmp_path / name)
    ordered = reorder_available(spark, place("in"), df.schema, "user", "idx", place("out"), place("offsets"), 1)
    assert Counter(map(tuple, ordered.select("user", "idx", "more", "place", "flushed").collect())) == Counter((*r, r[1], False) for r in rows)
    assert spark.read.format("statestore").load(place("offsets")).count() <= st.BUCKETS + 1
    chunked = chunk_available(spark, place("in"), df.schema, "user", 3, "more", place("out3"), place("offsets3"), 1)
    got = chunked.select("user", "idx", "more").collect()
    assert Counter(map(tuple, got)) == Counter(rows)
    sizes = Counter((r["user"], r["chunk"], r["flushed"]) for r in chunked.collect())
    assert sizes == {(None if u == 3 else f"u{u}", c, c == 1): 1 if c else 3 for u in range(3000) for c in range(2)}
