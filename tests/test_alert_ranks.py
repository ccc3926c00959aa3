"""Alerts by packed ranks against the pairs they stand for."""

import re

import pytest
from pyspark.sql import functions as F

from geoweave.operators import proximity


def _feeds(spark):
    ids = spark.range(400)
    events = ids.select(F.concat(F.lit("e"), "id").alias("id"), (F.col("id") * 37 % 9000).cast("double").alias("t"), (25 + F.col("id") % 9 / 20).alias("lat"), (55 + F.col("id") % 7 / 20).alias("lon"),
                        (F.col("id") % 3 == 0).alias("is_conflict"), (F.col("id") % 21 - 10).cast("double").alias("goldstein"), F.lit(-5.0).alias("tone"), (F.col("id") % 60).cast("int").alias("num_mentions"),
                        F.lit("P").alias("place"), F.lpad((1 + F.col("id") % 20).cast("string"), 2, "0").alias("root_code"), F.lit(4).alias("geo_type"))
    points = ids.select(F.concat(F.lit("h"), F.col("id") % 6).alias("hex"), (F.col("id") * 53 % 9000).cast("double").alias("t"), (25 + F.col("id") % 11 / 25).alias("lat"), (55 + F.col("id") % 5 / 25).alias("lon"),
                        (F.col("id") % 2 == 0).alias("military"), F.when(F.col("id") % 4 > 0, (F.col("id") * 97 % 40000).cast("int")).alias("alt_ft"),
                        F.lit(None).cast("string").alias("emergency"), F.lit(None).cast("string").alias("squawk"))
    return events, points


@pytest.mark.parametrize("longs", [2 ** 63, 0])
def test_alerts_are_the_best_pairs_ties_included(spark, monkeypatch, longs):
    monkeypatch.setattr(proximity, "LONG_RANKS", longs)
    events, points = _feeds(spark)
    plain = proximity.dedupe_alerts(proximity.near_pairs(events, points, 75.0, 60.0))
    mine = proximity.alerts(events, points, 75.0, 60.0)
    assert mine.columns == plain.columns
    want = sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, mine.collect())) == want and len(want) > 100
    top = proximity.alerts(events, points, 75.0, 60.0, limit=20).collect()
    assert [tuple(r) for r in top] == sorted(want, key=lambda r: (-r[plain.columns.index("score")], r[1], r[0]))[:20]


def test_alerts_are_aggregated_without_sorting_pairs(spark):
    events, points = _feeds(spark)
    plan = proximity.BestAlerts(events, points, 75.0, 60.0).ranked._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert re.search(r"HashAggregate\(keys=\[aircraft_id", plan) and "SortAggregate" not in plan


def test_no_events_give_no_alerts(spark):
    events, points = _feeds(spark)
    assert proximity.alerts(events.filter("false"), points).count() == 0 == proximity.alerts(events, points.filter("false")).count()


@pytest.mark.parametrize("exact", [False, True])
def test_cut_blocks_give_one_row_per_place_and_aircraft(spark, exact):
    events, points = _feeds(spark)
    want = sorted(map(tuple, proximity.alerts(events, points, 75.0, 60.0, exact=exact).collect()))
    best = proximity.BestAlerts(events, points, 75.0, 60.0, exact=exact, work=200)
    assert sorted(map(tuple, best.shown(best.ranked).collect())) == want
    pairs = best._pairs(best.places).withColumn("task", F.spark_partition_id())
    fields = pairs.groupBy("aircraft_id", "_lat1", "_lon1", "r_t", "r_lat", "r_lon").agg(F.count_distinct("task").alias("n"))
    assert fields.agg(F.max("n")).first()[0] == 1


def test_alerts_of_one_event_need_its_place_only(spark):
    events, points = _feeds(spark)
    best = proximity.BestAlerts(events, points, 75.0, 60.0)
    rows = [tuple(r) for r in best.ranked.collect()]
    e = max({r[2] for r in rows}, key=[r[2] for r in rows].count)
    assert sorted(tuple(r) for r in best.of_event(e).collect()) == sorted(r for r in rows if r[2] == e)
