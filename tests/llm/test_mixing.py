from collections import Counter

import numpy as np
import pytest

from rillflow.llm import mixing


def test_targets_stop_and_reshare(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 1, None: 300}
    rows = [("n" if s is None else "s" + s, s, n) for s, n in sizes.items()]
    got = {r["_mix_name"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "_mix_name string, source string, source_size long")).collect()}
    weights, left, target = dict(zip(sizes, [1, 2, 3, 1, 2])), set(sizes), {}
    while True:
        rest = sum(sizes.values()) - sum(target.values())
        over = {s for s in left if rest * weights[s] / sum(weights[x] for x in left) > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= over
    target |= {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
    assert all(abs(got["n" if s is None else "s" + s] - target[s]) < 1e-9 for s in sizes)


def test_tree_is_exact_and_disjoint():
    quotas = np.array([1000, 7, 0, 333])
    for shards in (1, 2, 5, 16):
        leaves = [mixing.leaf(quotas, j, shards, 3) for j in range(shards)]
        assert (sum(c for _, c in leaves) == quotas).all()
        sizes = [int(c.sum()) for _, c in leaves]
        assert max(sizes) - min(sizes) <= 1
        for k, q in enumerate(quotas):
            assert sorted(b for f, c in leaves for b in range(f[k], f[k] + c[k])) == list(range(q))


def corpus(spark):
    return spark.range(3000).selectExpr("id doc_id", "repeat('w ', int(1 + id * 7 % 50)) text", "CASE WHEN id < 2000 THEN 'hot' WHEN id < 2900 THEN 'mid' WHEN id < 2990 THEN 'low' END source")


def test_taken_is_near_target_and_reruns_agree(spark):
    options = dict(block_words=64, shard_words=8000)
    plan = mixing.plan(corpus(spark), **options).collect()
    assert len(plan) == 3000
    for s in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == s]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50
        assert all(r["taken"] <= 3 * r["size"] for r in own)
    again = mixing.plan(corpus(spark).repartition(7), **options).collect()
    assert Counter(map(repr, plan)) == Counter(map(repr, again))
    shards = Counter(d["shard"] for r in plan for d in r["draws"])
    assert len(shards) == -(-sum(r["size"] for r in plan) // 8000)


def test_permutation():
    for n in (1, 2, 3, 10, 64, 1000, 4097):
        got = [mixing.permuted(np.arange(n), n, key).tolist() for key in (1, 2)]
        assert all(sorted(g) == list(range(n)) for g in got)
        assert n < 10 or got[0] != got[1] != list(range(n))
    parts = np.concatenate([mixing.permuted(np.arange(a, b), 1000, 5) for a, b in ((0, 10), (10, 999), (999, 1000))])
    assert (parts == mixing.permuted(np.arange(1000), 1000, 5)).all()


def test_blocks_go_whole_to_one_shard_and_passes_mix(spark):
    """Every block of a source's line lies in one shard, each shard holds its exact quota, and shards hold all passes."""
    options = dict(block_words=64, shard_words=8000, seed=3)
    plan = mixing.plan(corpus(spark), **options).collect()
    shards = 1 + max(d["shard"] for r in plan for d in r["draws"])
    names = sorted({r["source"] for r in plan if r["source"]}) + [None]
    quotas = np.array([-(-int(next(r["target"] for r in plan if r["source"] == s) + 0.5) // 64) for s in names])
    want = [mixing.leaf(quotas, j, shards, 3)[1] for j in range(shards)]
    for k, s in enumerate(names):
        own, at, of = sorted((r for r in plan if r["source"] == s), key=lambda r: (r["_mix_key"], r["_mix_copy"])), 0, {}
        for r in own:
            for d in r["draws"]:
                block = (at + d["pass"] * r["source_size"]) // 64
                assert of.setdefault(block, d["shard"]) == d["shard"]
            at += r["size"]
        # a block in which no document begins has no draw of its own
        got = Counter(of.values())
        assert all(got[j] <= want[j][k] for j in range(shards)) and sum(got.values()) >= 0.9 * quotas[k]
    low = [r for r in plan if r["source"] == "low"]
    assert len({d["shard"] for r in low for d in r["draws"] if d["pass"] == 0}) > 1 and {d["pass"] for r in low for d in r["draws"]} == {0, 1, 2}


def test_draws_add_up_to_what_is_taken(spark):
    from oracle import SF

    from rillflow.llm import registry

    drawn, places = Counter(), set()
    for r in registry.QUERIES["mixing_draws"](spark, SF).collect():
        drawn[r["doc_id"]] += r["size"]
        places.add((r["shard"], r["place"], r["doc_id"]))
        assert r["shard"] >= 0 and 0 <= r["pass"] < mixing.MAX_REPEAT
    taken = {r["doc_id"]: r["taken"] for r in registry.QUERIES["op2_mixing"](spark, SF).collect()}
    assert drawn == Counter(taken) and len(places) > 1


def key(r):
    """The digest in plain Python."""
    import hashlib

    spelled = ("n" if v is None else f"s{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["text"]))
    return hashlib.md5("".join(spelled).encode()).hexdigest()


def slow(rows, targets, block):
    """How often each distinct (doc_id, text, source) is drawn: a walk along each source's line."""
    out = Counter()
    for s, target in targets.items():
        own = sorted((r for r in rows if r["source"] == s), key=key)
        sizes = [len((r["text"] or "").split()) for r in own]
        for n in range(3):
            at = n * sum(sizes)
            for r, size in zip(own, sizes):
                if at < int(target + 0.5):
                    out[r["doc_id"], r["text"], r["source"]] += 1
                at += size
    return out


def test_mixed_by_brute_force(spark, monkeypatch):
    """Null, empty and clashing sources, copies, and copies that differ in another column."""
    monkeypatch.setattr(mixing.handed_out, "__defaults__", (4,))
    rows = [(1, "one text", None, 0), (1, "one text", "", 1), (2, "b c", "a\x1f", 2), (2, "\x1fb c", "a", 3), (None, None, "a", 4), (None, "", "a", 5)]
    rows += [(7, "same words here", "hot", k) for k in range(50)] + [(k, f"w{k} " * (k % 9), "cd"[k % 2], k) for k in range(10, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more long").repartition(5)
    options = dict(block_words=8, shard_words=100)
    plan = mixing.plan(docs, **options).collect()
    assert len(plan) == len(rows)
    want = slow([r.asDict() for r in docs.collect()], {r["source"]: r["target"] for r in plan}, 8)
    got = mixing.mixed(docs, **options).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == +want
    hot = Counter(r["more"] for r in got if r["source"] == "hot")
    assert max(hot.values()) - min(hot[k] for k in range(50)) <= 1 and sum(hot.values()) == want[7, "same words here", "hot"]
    with pytest.raises(ValueError, match="reserved"):
        mixing.mixed(docs.withColumn("_mix_size", docs.more))


def test_mixed_rows(spark):
    docs, options = corpus(spark), dict(block_words=64, shard_words=8000)
    want = Counter()
    for r in mixing.plan(docs, **options).collect():
        want[r["doc_id"]] += len(r["draws"])
    got = Counter(r["doc_id"] for r in mixing.mixed(docs, **options).collect())
    assert got == +want


def test_awkward_rows(spark, docs, no_docs):
    plan = mixing.plan(docs).collect()
    assert len(plan) == docs.count() and all(r["taken"] <= 3 * r["size"] for r in plan)
    assert {r["source"] for r in plan} == {"a", "b", "c", "", None}
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == sum(len(r["draws"]) for r in plan)
    assert mixing.plan(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
