"""Every registered query against the SQL it stands for, on the smallest tables."""

import pytest
from conftest import SF, rows_of

from webstrata.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, oracle, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    if name in catalog.oracle_sql():
        want = oracle.execute(catalog.oracle_sql()[name]).fetch_df()
        assert rows_of(got) == rows_of(want)
    else:
        assert len(got)


def test_time_filters_reach_the_scan(spark):
    frame = catalog.queries()["filter_before_after"](spark, SF)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts)" in plan and "LessThan(ts" in plan


@pytest.mark.parametrize("name, pushed", [("scan_filter_prefix", "StringStartsWith(url"), ("filter_not_before", "GreaterThanOrEqual(ts"), ("filter_conjunction", "GreaterThan(n_chars"), ("range_visits", "LessThanOrEqual(ts")])
def test_filters_are_pushed_down(spark, name, pushed):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert pushed in plan.split("PushedFilters: ")[1]


def test_bundles_keep_order_and_limit(spark):
    packed = catalog.queries()["bundle_bin_pack"](spark, SF).toPandas().sort_values(["bucket", "seq"])
    for _, one in packed.groupby("bucket"):
        assert one["bundle"].is_monotonic_increasing
        sizes = one.groupby("bundle")["size"]
        assert all(total <= 64 << 10 or count == 1 for total, count in zip(sizes.sum(), sizes.count()))
