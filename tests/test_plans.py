import pytest

from quern import plans
from tests.twins import SF, same


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_twin(spark, name):
    same(plans.queries()[name](spark, SF).toPandas(), plans.oracles()[name])


def test_every_query_has_a_twin():
    assert set(plans.queries()) == set(plans.oracles())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from quern.plans.tables import members, runs

    plan = runs(spark, SF).where(F.col("bytes") > 5).select("platform")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_extendedprice), GreaterThan(l_extendedprice,5.0)]" in plan and "l_quantity" not in plan
    plan = members(spark, SF).select("name")._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "value" not in plan.split("ReadSchema")[1]
