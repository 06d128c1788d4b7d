from __future__ import annotations

import pytest
from compare import oracle, rows

from lumenfold.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = oracle(sf, registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_merge_does_not_depend_on_partitions(spark, sf, parts):
    from lumenfold.operators import exposure
    from lumenfold.plans.exposure import samples

    one = rows(exposure.merge(samples(spark, sf).repartition(parts), ["l_orderkey"]).selectExpr("l_orderkey", "round(radiance, 9) r", "saturated").toPandas())
    assert one == rows(exposure.merge(samples(spark, sf), ["l_orderkey"]).selectExpr("l_orderkey", "round(radiance, 9) r", "saturated").toPandas())
