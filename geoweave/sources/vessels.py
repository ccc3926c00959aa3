"""Vessel position messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import VESSEL_REPORT_TYPES
from geoweave.functions.geo import finite_in_range

_BODY = ("struct<Valid:boolean,UserID:bigint,Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:double,NavigationalStatus:double>")
MESSAGE_SCHEMA = f"MessageType string, MetaData map<string,string>, Message map<string,{_BODY}>"


def parse_messages(messages: DataFrame, received: Column | None = None) -> DataFrame:
    """`value` messages to positions. The body is nested under its type; positions fall back to the metadata.

    A report without a provider time counts as received now: `received` is that time in epoch seconds.
    """
    received = F.unix_micros(F.current_timestamp()) / 1e6 if received is None else received
    m = messages.select("*", F.from_json("value", MESSAGE_SCHEMA).alias("m")).withColumn("_received", received)
    m = m.filter(F.col("m.MessageType").isin(*VESSEL_REPORT_TYPES))
    body, meta = F.try_element_at(F.col("m.Message"), F.col("m.MessageType")), F.col("m.MetaData")

    def said(name: str) -> Column:
        return F.try_element_at(meta, F.lit(name))

    mmsi = F.coalesce(said("MMSI").try_cast("bigint"), body["UserID"])
    lat = finite_in_range(F.coalesce(body["Latitude"], said("Latitude").try_cast("double"), said("latitude").try_cast("double")), -90, 90)
    lon = finite_in_range(F.coalesce(body["Longitude"], said("Longitude").try_cast("double"), said("longitude").try_cast("double")), -180, 180)
    shown = F.regexp_replace(F.regexp_replace(said("time_utc"), r" UTC$", ""), r"(\.\d{1,6})\d*", "$1")
    zoned = F.when(shown.rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.regexp_replace(shown, r" ([+-]\d\d)(\d\d)$", "$1:$2")).otherwise(F.concat(shown, F.lit("Z")))
    t = F.coalesce(F.unix_micros(F.try_to_timestamp(zoned)) / 1e6, F.col("_received"))
    rows = m.select(mmsi.alias("mmsi"), t.alias("t"), lat.alias("lat"), lon.alias("lon"), F.trim(said("ShipName")).alias("name"),
                    finite_in_range(body["Sog"], 0, 102.2).alias("sog"), finite_in_range(body["Cog"], 0, 359.9).alias("cog"),
                    finite_in_range(body["TrueHeading"], 0, 359).alias("heading"), finite_in_range(body["NavigationalStatus"], 0, 14).alias("nav_status"),
                    F.coalesce(body["Valid"], F.lit(True)).alias("_valid"), F.col("_received").alias("received"))
    good = F.col("_valid") & F.col("mmsi").between(100000000, 999999999) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return rows.filter(good).drop("_valid").withColumn("id", F.concat(F.lit("ais:"), F.col("mmsi").cast("string")))


def fresh(reports: DataFrame) -> DataFrame:
    """Reports at most an hour old and at most a minute ahead of their receipt."""
    return reports.filter((F.col("received") - F.col("t") <= 3600) & (F.col("t") - F.col("received") <= 60))
