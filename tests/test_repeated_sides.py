"""Sides that are repeated for neighbouring blocks, and tables of all records, are never collected on the driver."""

import pytest
from test_alert_ranks import _feeds

from geoweave.operators import candidates as cand
from geoweave.operators import proximity
from geoweave.session import cut_lineage


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("work", [500, 4_000_000])
def test_block_joins_shuffle_small_files(spark, exact, work):
    events, points = (cut_lineage(df) for df in _feeds(spark))
    plan = _plan(proximity.near_pairs(events, points, 75.0, 60.0, exact=exact, work=work))
    # the grid of heavy blocks alone may be broadcast, and is joined before the pairs
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == (2 if work == 500 else 0)


def test_ends_and_winners_shuffle_small_files(spark):
    events, points = (cut_lineage(df) for df in _feeds(spark))
    assert "BroadcastHashJoin" not in _plan(proximity.near_ends(events, points, 75.0, 60.0))
    fields = "n bigint, s bigint, source_key string, id string, kind string, t double, lat double, lon double, rid string"
    table = cut_lineage(spark.createDataFrame([(i, i, f"k{i}", f"i{i}", "gdelt", 0.0, 0.0, 0.0, f"r{i}") for i in range(4)], fields))
    pairs = spark.createDataFrame([(0, 1, 0, 1, 0, 0.5, 1.0, 1.0, "topic", ["x"], ["y"])], "l_n bigint, r_n bigint, l_s bigint, r_s bigint, rule int, score double, km double, minutes double, match_type string, overlap array<string>, why array<string>")
    best = cand.best_per_coverage(pairs, table)
    assert "BroadcastHashJoin" not in _plan(best) and [(r.l_rid, r.r_rid) for r in best.collect()] == [("r0", "r1")]
