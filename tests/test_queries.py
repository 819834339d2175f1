import pytest
from oracle import SF, same

from rillflow import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["doc_pipeline"](spark, SF).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_prune_and_push_down(spark):
    plan = catalog.QUERIES["filter_map"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "PushedFilters: [IsNotNull(o_orderkey)]" in plan
    assert "Exchange" not in plan
    plan = catalog.QUERIES["opaque_chain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
