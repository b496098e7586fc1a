"""Registered dashboards over a log that is older than any cleanup."""

from datetime import datetime

import pytest

from adlumen.plans import queries

# Two views and a click of tenant 1, one view of tenant 2; the first ones long before the others.
EVENTS = [
    (1, datetime(2023, 6, 1, 8), 7, "view", 1.0, '{"k": 3}'),
    (2, datetime(2023, 6, 2, 8), 7, "click", 1.0, '{"k": 3}'),
    (3, datetime(2024, 1, 29, 8), 8, "view", 2.0, '{"k": 3}'),
    (4, datetime(2023, 6, 1, 8), 9, "view", 3.0, '{"k": 1}'),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("dashboards"))
    spark.createDataFrame(
        EVENTS, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame(
        [(k, f"part {k}", "b", "t", 1, 10.0) for k in (1, 3)],
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double").write.parquet(f"{path}/part.parquet")
    return path


def test_bundle_counts_old_events(spark, folder):
    found = queries.QUERIES["dashboard_bundle"](spark, folder)
    assert sorted(map(tuple, found.collect())) == [(1, 3, 2, 2), (2, 1, 1, 1)]


@pytest.mark.parametrize("kind", ["realtime", "overview"])
def test_page_counts_old_events(spark, folder, kind):
    found = queries.QUERIES[f"dashboard_{kind}"](spark, folder)
    totals = found.filter("part = 'totals'").select("a", "b", "c")
    assert list(map(tuple, totals.collect())) == [(3.0, 2.0, 2.0)]
