"""Thermal detections from provider CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions.news import stamp_seconds

# ---- fixed values: columns of the provider file -----------------------------------------------
CSV_SCHEMA = ("latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, "
              "instrument string, confidence string, version string, bright_ti5 string, frp string, daynight string")


def parse_hotspots(rows: DataFrame) -> DataFrame:
    """CSV text columns to hotspots; the acquisition time may lack leading zeros."""
    hhmm = F.lpad("acq_time", 4, "0")

    def number(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")).try_cast("double"), F.lit(0.0))

    return rows.select(
        F.concat(F.lit("firms:"), "satellite", F.lit(":"), "acq_date", hhmm, F.lit(":"), "latitude", F.lit(","), "longitude").alias("id"),
        stamp_seconds(F.concat(F.replace("acq_date", F.lit("-"), F.lit("")), hhmm, F.lit("00"))).alias("t"), F.col("latitude").try_cast("double").alias("lat"),
        F.col("longitude").try_cast("double").alias("lon"), "satellite", number("frp").alias("frp"), number("bright_ti4").alias("bright"),
        F.coalesce("confidence", F.lit("n")).alias("confidence"), F.coalesce("daynight", F.lit("?")).alias("daynight"))


def read_hotspots(spark: SparkSession, paths) -> DataFrame:
    return parse_hotspots(spark.read.schema(CSV_SCHEMA).csv(paths, header=True))
