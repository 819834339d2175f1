import numpy as np
from oracle import SF

from rillflow.llm import toxicity


def test_label_model_recovers_voters():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.1
    rates = [(0.6, 0.01), (0.4, 0.02), (0.5, 0.005), (0.1, 0.1)]
    hits = np.array([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in rates])
    hits[2] = np.where(rng.random(len(y)) < 0.9, hits[0], hits[2])  # a voter that mostly copies another
    votes = (hits * (1 << np.arange(4))[:, None]).sum(0)
    patterns, counts = np.unique(votes, return_counts=True)
    anchor = votes[:300], y[:300].astype(float)
    posterior, cliques, right = toxicity.label_model(patterns, counts.astype(float), 4, anchor, toxicity.Settings())
    assert any({0, 2} <= set(c) for c in cliques) and right[0] > 0.7 > 0.4 > right[3]
    said = dict(zip(patterns, posterior > 0.5))
    assert np.mean([said[v] == t for v, t in zip(votes, y)]) > 0.93


def planted(spark, n):
    """Two kinds of toxic texts: an English insult, and words on a stem that ordinary texts hold now and then."""
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    rows, labels = [], []
    for k in range(n):
        words, toxic = [word() for _ in range(80)], int(rng.random() < 0.3)
        for _ in range(4 if toxic else 0):
            words[rng.integers(80)] = "moron" if k % 2 else "grumbol" + word()[:2]
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels, truth = planted(spark, 1200)
    got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    out = [r for r in got if r["held_out"]]
    assert 150 < len(out) < 350
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - toxic ELSE toxic END toxic")
    again = toxicity.score(docs, toxicity.fit(docs, flipped)).collect()
    assert {r["doc_id"]: r["score"] for r in got} == {r["doc_id"]: r["score"] for r in again}


def test_awkward_rows(spark, docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for some in (labels, labels.limit(0)):
        model = toxicity.fit(docs, some)
        got = toxicity.score(docs, model).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
        assert toxicity.accepted(docs, model).columns == docs.columns
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_lexicon_alone_still_tells(spark):
    texts = [(k, "you idiot what a stupid moron " * 3 if k % 5 == 0 else "a calm and ordinary sentence about birds") for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.score(texts[0][1]) > 0.5 > model.score(texts[1][1])


def test_sample_is_bounded_by_documents(spark):
    docs, labels, _ = planted(spark, 300)
    again = docs.unionAll(docs.filter("doc_id = 3").crossJoin(spark.range(500)).select("doc_id", "text"))
    one, other = (sorted(map(tuple, toxicity.labelled(d, labels, 10_000).collect())) for d in (docs, again))
    assert one == other
    few = toxicity.labelled(again, labels, 60).count()
    assert 20 < few < 120


def slow_score(model, text):
    """The classifier's output from its weights, with words and patterns looked for one by one."""
    import re

    low = (text or "").lower()
    n = max(len(low.split()), 1)

    def hits(marker):
        stem, count, at = marker.lstrip("="), 0, low.find(marker.lstrip("="))
        while at >= 0:
            end = at + len(stem)
            count += (at == 0 or not low[at - 1].isalpha()) and not (marker[0] == "=" and end < len(low) and low[end].isalpha())
            at = low.find(stem, at + 1)
        return count

    counts, m = [hits(marker) for marker in model.markers], len(model.markers)
    z = model.bias
    for k, c in enumerate(counts):
        z += np.log1p(200 * c / n) * model.weights[k] + (c > 0) * model.weights[m + k]
    for j, group in enumerate(model.groups):
        z += np.log1p(200 * sum(counts[k] for k in group) / n) * model.weights[2 * m + j]
    said = [re.search(toxicity.INSULT, low), re.search(toxicity.THREAT, low), text is not None and len(text) > 20 and text.isupper()]
    z += sum(w for w, hit in zip(model.weights[-3:], said) if hit)
    z = model.calibration[0] * z + model.calibration[1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def test_scores_by_brute_force(spark):
    import zlib

    from oracle import SF

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        want = slow_score(model, texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-9 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
