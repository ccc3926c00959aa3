"""Reasons by key against the pairs they stand for."""

from pyspark.sql import functions as F

from geoweave.functions import aircraft
from test_alert_ranks import _feeds


def test_reasons_by_hour_equal_reasons_by_pair(spark):
    events, points = _feeds(spark)
    hour = F.floor(F.col("t") / 600).alias("hour")
    left, right = points.select("hex", "t", "military", "alt_ft", hour), events.select(hour, "is_conflict", "goldstein", "root_code")
    right = right.unionByName(right.limit(5).select((F.col("hour") + 99).alias("hour"), F.lit(False).alias("is_conflict"), F.lit(0.0).alias("goldstein"), "root_code"))
    left = left.unionByName(left.limit(20).withColumn("hour", F.col("hour") + 99))
    reason = aircraft.alert_reason(F.col("military"), F.col("alt_ft"), F.col("is_conflict"), F.col("root_code"), F.col("goldstein"))
    keys = ["hex", "t", "hour", "military", "alt_ft"]
    plain = left.join(right, "hour").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(reason).alias("reason"))
    told = aircraft.fleet_reasons(left, right, ["hour"])
    assert "_said" not in told.columns and told.count() == left.join(right.select("hour").distinct(), "hour").count()
    mine = {tuple(r)[:5]: tuple(r)[5:] for r in told.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("reason").alias("reason")).collect()}
    assert mine == {tuple(r)[:5]: tuple(r)[5:] for r in plain.collect()}
