import numpy as np
from oracle import SF

from rillflow.llm import ann


def brute(ids, e, k=20):
    out = {}
    for i in ids[ids % 20 == 0]:
        s = np.einsum("ij,j->i", e, e[np.flatnonzero(ids == i)[0]])
        s[ids == i] = -np.inf
        out[int(i)] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k] if np.isfinite(s[j])]
    return out


def found(spark, df, k=20):
    index = ann.build(df)
    got = {}
    for r in ann.search(index, index.rows.filter("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    return got


def test_recall_and_exact_scores(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.collect()
    ids, e = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    want, got = brute(ids, e), found(spark, df)
    assert set(want) == set(got)
    recall = np.mean([len({x for x, _ in want[q]} & {r["vec_id"] for r in got[q]}) / len(want[q]) for q in want])
    assert recall >= 0.9
    for q, own in got.items():
        assert [r["rank"] for r in own] == list(range(1, len(want[q]) + 1))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        for r in own:
            assert abs(r["score"] - e[ids == q][0] @ e[ids == r["vec_id"]][0]) < 1e-12


def test_lengths_count_and_hot_vectors_tie_by_id(spark):
    rng = np.random.default_rng(5)
    e = rng.standard_normal((3000, 12)) * rng.lognormal(0, 0.7, (3000, 1))
    e[::3] = 40 * e[0] / np.linalg.norm(e[0])  # a third of all rows are one vector, the longest
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(e)], "vec_id long, embedding array<double>")
    want, got = brute(np.arange(3000), e), found(spark, df)
    recall = np.mean([len({x for x, _ in want[q]} & {r["vec_id"] for r in got[q]}) / 20 for q in want])
    assert recall >= 0.9
    assert [r["vec_id"] for r in got[60]] == [x for x, _ in want[60]]


def test_scan_loses_next_to_nothing():
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((50, 64))
    d = ann.apart(q, x)
    limit = np.sort(d, axis=1)[:, 19]
    who, what = ann.scan(x, q, limit, 20)
    kept = np.zeros_like(d, bool)
    kept[who, what] = True
    assert kept[d <= limit[:, None]].mean() > 0.98 and kept.mean() < 0.05


def test_two_levels_of_centres_and_cut_lists(spark, monkeypatch):
    for name, n in (("FIT_ROWS", 512), ("MOST_CENTRES", 8), ("CHUNK_ROWS", 64), ("CHUNK_QUERIES", 16)):
        monkeypatch.setattr(ann, name, n)
    rng = np.random.default_rng(8)
    e = rng.standard_normal((4000, 24)) + 4 * rng.standard_normal((60, 24))[rng.integers(0, 60, 4000)]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(e)], "vec_id long, embedding array<float>")
    index = ann.build(df)
    part = index.parts[24]
    assert len(part.first) == 8 and len(part.second) == 16 and part.sizes.sum() == 4000 and part.sizes.max() > 64
    e = e.astype(np.float32).astype(float)
    want, got = brute(np.arange(4000), e), found(spark, df)
    assert np.mean([len({x for x, _ in want[q]} & {r["vec_id"] for r in got[q]}) / 20 for q in want]) >= 0.9


def test_groups_meet_in_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_ROWS", 128)
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = np.random.default_rng(10)
    e = rng.standard_normal((3000, 32))
    df = session.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(e)], "vec_id long, embedding array<double>")
    want, got = brute(np.arange(3000), e), found(session, df)
    assert np.mean([len({x for x, _ in want[q]} & {r["vec_id"] for r in got[q]}) / 20 for q in want]) >= 0.9


def test_copies_of_an_id_find_each_other_and_dimensions_stay_apart(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.9, 0.1]), (3, [0.5, 0.0]), (40, [1.0, 2.0, 3.0]), (5, [1.0, 1.0, 1.0]), (6, [3.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(df)
    out = ann.search(index, index.rows.filter("vec_id % 20 = 0"), 20).collect()
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in out) == [(20, 3, 2), (20, 3, 2), (20, 20, 1), (20, 20, 1), (40, 5, 2), (40, 6, 1)]
    lone = ann.search(index, spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, vector array<double>"), 2).collect()
    assert [r["vec_id"] for r in sorted(lone, key=lambda r: r["rank"])] == [20, 20]


def test_short_answers_go_on_to_all_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "tuned", lambda *a: (1, np.ones(1)))
    rng = np.random.default_rng(9)
    e = rng.standard_normal((400, 6))
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(e)], "vec_id long, embedding array<double>")
    assert all(len(own) == 60 for own in found(spark, df, 60).values())


def test_awkward_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [1.0, float("inf")]), (120, [1.0, None]), (140, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id AS list", "vec_id AS score")
    got = found(spark, df)
    assert {q: [r["vec_id"] for r in own] for q, own in got.items()} == {0: [1, 1, 20], 20: [0, 1, 1]}
    assert ann.build(df.filter("vec_id = 40")) is None and ann.search(None, df).count() == 0


def test_far_longer_vectors_spoil_nothing(spark):
    rng = np.random.default_rng(11)
    e = rng.standard_normal((2000, 16))
    e[7], e[20], e[40], e[41] = 1e200 * e[7], 1e300 * np.abs(e[20]), 1e12 * e[40], 1e-200 * e[41]
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(e)], "vec_id long, embedding array<double>")
    index = ann.build(df)
    assert set(index.parts) == {16, -16} and index.parts[-16].n == 3
    with np.errstate(over="ignore", invalid="ignore"):
        want, got = brute(np.arange(2000), e), found(spark, df)
    assert set(got) == set(range(0, 2000, 20))
    tame = [q for q in want if len(want[q]) == 20 and q not in (20,)]
    assert np.mean([len({x for x, _ in want[q]} & {r["vec_id"] for r in got[q]}) / 20 for q in tame]) >= 0.9
    for q in (0, 60, 100):  # the longest come first or not at all
        assert [r["vec_id"] for r in got[q]][0] == want[q][0][0]
