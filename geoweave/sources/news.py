"""News event files: tab-separated exports and their entity companions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.functions.news import is_conflict_root, offset_list, root_label, stamp_seconds, url_domain

# ---- fixed values: column positions in the two provider files (0-based) -----------------------
EXPORT_COLUMNS = 61
EXPORT = {"event": 0, "actor1": 6, "actor1_cc": 7, "actor2": 16, "actor2_cc": 17, "event_code": 26, "root_code": 28, "quad_class": 29,
          "goldstein": 30, "num_mentions": 31, "num_sources": 32, "tone": 34, "geo_type": 51, "place": 52, "country": 53, "lat": 56, "lon": 57,
          "added": 59, "url": 60}
ENTITY_COLUMNS = 16
ENTITY = {"url": 4, "themes": 8, "persons": 12, "orgs": 14}
ENTITY_LIMITS = {"themes": 25, "persons": 15, "orgs": 15}


def _number(text: Column, kind: str) -> Column:
    """Blank counts as zero; anything unreadable becomes null."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0).cast(kind)).otherwise(text.try_cast(kind))


def parse_export(lines: DataFrame, only_geo: bool = True) -> DataFrame:
    """`value` lines of an export file to events; short lines and lines without a readable position are dropped."""
    fields = F.split("value", "\t")
    rows = lines.withColumn("_f", fields).filter(F.size("_f") >= EXPORT_COLUMNS)
    f = {name: F.col("_f")[pos] for name, pos in EXPORT.items()}
    lat, lon = f["lat"].try_cast("double"), f["lon"].try_cast("double")
    out = rows.select(
        F.concat(F.lit("gdelt:"), f["event"]).alias("id"), stamp_seconds(f["added"]).alias("t"), lat.alias("lat"), lon.alias("lon"),
        f["place"].alias("place"), f["country"].alias("country"), _number(f["geo_type"], "int").alias("geo_type"),
        *[F.nullif(f[n], F.lit("")).alias(n) for n in ("actor1", "actor2", "actor1_cc", "actor2_cc")],
        f["event_code"].alias("event_code"), f["root_code"].alias("root_code"), root_label(f["root_code"]).alias("root_label"),
        _number(f["quad_class"], "int").alias("quad_class"), _number(f["goldstein"], "double").alias("goldstein"),
        _number(f["tone"], "double").alias("tone"), _number(f["num_mentions"], "int").alias("num_mentions"),
        _number(f["num_sources"], "int").alias("num_sources"), f["url"].alias("url"), url_domain(f["url"]).alias("source_domain"),
        is_conflict_root(f["root_code"]).alias("is_conflict"), F.lit(False).alias("is_social"))
    return out.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()) if only_geo else out


def parse_entities(lines: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """`value` lines of an entity file to (url, themes, persons, orgs), whole or cut to `limits` (ENTITY_LIMITS: what a list shows).

    A `pos` column, when present, is kept: it decides which row of an address is the last.
    """
    rows = lines.withColumn("_f", F.split("value", "\t")).filter(F.size("_f") >= ENTITY_COLUMNS)
    keep, limits = ["pos"] if "pos" in lines.columns else [], limits or {}
    lists = {n: offset_list(F.col("_f")[ENTITY[n]]) for n in ("themes", "persons", "orgs")}
    return rows.select(*keep, F.col("_f")[ENTITY["url"]].alias("url"),
                       *[(F.slice(names, 1, limits[n]) if n in limits else names).alias(n) for n, names in lists.items()])


def attach_entities(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity lists onto events by address; of several rows for one address the last by `pos` counts."""
    names = ("themes", "persons", "orgs")
    last = entities.groupBy("url").agg(F.max_by(F.struct(*names), "pos").alias("_e"))
    none = F.array().cast("array<string>")
    joined = events.drop(*names).join(last, "url", "left")
    return joined.select(*[c for c in joined.columns if c != "_e"], *[F.coalesce(F.col(f"_e.{n}"), none).alias(n) for n in names])


def read_export(spark: SparkSession, paths, entity_paths=None) -> DataFrame:
    """Events of export files, with entities when their files are given. Lines are split after the scan, so any number
    of trailing columns is accepted; Spark reads gzip and plain text alike. The last line of an address is the last by file, split and place in it."""
    events = parse_export(spark.read.text(paths))
    if entity_paths is None:
        none = F.array().cast("array<string>")
        return events.withColumns({n: none for n in ("themes", "persons", "orgs")})
    lines = spark.read.text(entity_paths).withColumn("pos", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return attach_entities(events, parse_entities(lines))


def window_stamps(instants: DataFrame, hours: float, column: str = "t") -> DataFrame:
    """The quarter-hour stamps of the `hours` before each instant, newest first excluded itself."""
    n = int(hours * 60 // 15)
    base = F.floor(F.col(column) / 900) * 900
    rows = instants.select(column, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("back"))
    return rows.select(column, "back", stamp_text(base - F.col("back") * 900).alias("stamp"))


def stamp_text(seconds: Column) -> Column:
    """yyyyMMddHHmmss of epoch seconds in UTC, whatever the session time zone is."""
    when = F.timestamp_add("SECOND", seconds.cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return F.date_format(when, "yyyyMMddHHmmss")


def day_stamps(days: DataFrame, column: str = "day_start") -> DataFrame:
    """The 96 stamps of each UTC day given by its start in epoch seconds."""
    rows = days.select(column, F.explode(F.sequence(F.lit(0), F.lit(95))).alias("slot"))
    return rows.select(column, "slot", stamp_text(F.col(column) + F.col("slot") * 900).alias("stamp"))


def previous_stamp(stamp: Column) -> Column:
    return stamp_text(stamp_seconds(stamp) - 900)
