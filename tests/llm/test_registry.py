import inspect
import re

import pytest
from oracle import SF, same

import corpus_pipeline
from rillflow.llm import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_thirteen_operators():
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in registry.QUERIES) if m)
    assert numbers == list(range(1, 14))


def test_pipeline_contract(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_and_bear_awkward_rows(spark, docs, stage):
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, SF)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    assert out.count() <= 3 * docs.count()
    assert f(spark, docs.limit(0), SF).count() == 0


def test_stages_by_brute_force(spark):
    """What each stage keeps of the smallest table, against what its operator says of the same rows."""
    from test_simhash import jaccard, shingles

    from rillflow.llm import secrets, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = corpus_pipeline.reject_toxic(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in docs.collect() if model.score(r["text"]) < 0.5)
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}  # five words, a similarity of 0.8 or more
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            alike = sets[a] == sets[b] or (sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8)
            if alike and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(group.values()))
    for r in corpus_pipeline.redact_secrets(spark, docs, SF).collect():
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])


def test_mixing_and_packing_of_the_pipeline_by_brute_force(spark):
    """Every id of every document that the first three stages keep is packed as often as a plain walk draws the document."""
    import zlib
    from collections import Counter, defaultdict

    import numpy as np
    from test_mixing import slow
    from test_packing import whole

    from rillflow.llm import mixing
    from rillflow.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = written(stage(spark, docs, SF), "stage")
    rows = [r.asDict() for r in docs.collect()]
    targets = {r["source"]: r["target"] for r in mixing.plan(docs).select("source", "target").distinct().collect()}
    want = {d: n for (d, _, _), n in slow(rows, targets, mixing.BLOCK_WORDS).items() if n}
    ids = {r["doc_id"]: np.array(whole().encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4") for r in rows}
    mix = written(corpus_pipeline.mix_sources(spark, docs, SF), "stage")
    assert Counter(r["doc_id"] for r in mix.collect()) == want
    covered, sequences = {d: np.zeros(len(x), int) for d, x in ids.items()}, defaultdict(list)
    for r in corpus_pipeline.pack_sequences(spark, mix, SF).collect():
        part = slice(r["start"], r["start"] + r["length"])
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][part].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]][part] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all((x == want.get(d, 0)).all() for d, x in covered.items())
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)])]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
