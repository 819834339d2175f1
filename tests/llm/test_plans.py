"""Shapes of plans: what must not shuffle, and what must stay out of Python."""

import pytest
from oracle import SF

from rillflow.llm import mixing, registry, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op4_quality_rules", "op5_packing", "op9_secret_scan", "op10_license_scan"])
def test_narrow_operators_do_not_shuffle(spark, name):
    plan = plan_of(registry.QUERIES[name](spark, SF))
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_sharding_is_native(spark):
    plan = plan_of(registry.QUERIES["op1_sharding"](spark, SF))
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_texts_are_not_shuffled_for_fingerprints_or_sizes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "text" not in plan_of(simhash.classes(docs)) and "text" not in plan_of(mixing.plan(docs))


def test_no_cartesian_products(spark):
    for name in ("op2_mixing", "op6_chat_format", "op7_simhash", "op8_nearest_neighbours"):
        plan = plan_of(registry.QUERIES[name](spark, SF))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_labelled_sample_is_broadcast(spark, monkeypatch):
    from rillflow.llm import toxicity

    monkeypatch.setattr(toxicity, "written", lambda df, what: df)
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    read = lambda name: session.read.parquet(f"{SF}/{name}.parquet")
    plan = plan_of(toxicity.labelled(read("documents"), read("labels"), 12_000))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_partitions_of_a_mix_are_bounded(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id doc_id", "repeat('word ', 40) text", "string(id % 3) source")
    whole = mixing.mixed(docs, shard_words=200, block_words=50)
    monkeypatch.setattr(mixing, "MOST_PARTITIONS", 5)
    few = mixing.mixed(docs, shard_words=200, block_words=50)
    assert whole.rdd.getNumPartitions() > 50 and few.rdd.getNumPartitions() <= 5
    assert [r["doc_id"] for r in few.collect()] == [r["doc_id"] for r in whole.collect()]  # the same order, shard by shard
