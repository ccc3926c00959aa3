"""Counts and summaries users read first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import RADAR_CORE_BOX, RADAR_CORE_MIN
from geoweave.operators.filters import new_thermal


def radar_scenes(detections: DataFrame, core=RADAR_CORE_BOX, at_least: int = RADAR_CORE_MIN) -> DataFrame:
    """Per scene: detections, how many lie in the core box, and whether the scene images the core well enough."""
    la0, lo0, la1, lo1 = core
    inside = F.col("lat").between(la0, la1) & F.col("lon").between(lo0, lo1)
    return (detections.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("core"))
            .withColumn("usable", F.col("core") >= at_least))


def source_counts(events: DataFrame, tracks: DataFrame, hotspots: DataFrame, social: DataFrame, alerts: DataFrame, verdicts: DataFrame,
                  clusters: DataFrame | None = None) -> DataFrame:
    """(measure, n): one pass per source, no join."""
    def measures(df: DataFrame, **wanted) -> DataFrame:
        one = df.agg(*[c.alias(n) for n, c in wanted.items()])
        return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("bigint").alias("n")) for n in wanted])).alias("m")).select("m.*")

    every = F.count(F.lit(1))
    out = measures(events, events=every, conflict_events=F.count_if("is_conflict"))
    parts = [measures(tracks, tracks=every, military_tracks=F.count_if("military")),
             measures(hotspots, firms=every, firms_novel=F.count_if(new_thermal())), measures(social, social=every), measures(alerts, alerts=every),
             measures(verdicts, assessments=every, supported=F.count_if(F.col("verdict") == "SUPPORTED"), plausible=F.count_if(F.col("verdict") == "PLAUSIBLE"))]
    if clusters is not None:
        parts.append(measures(clusters, clusters=every))
    for part in parts:
        out = out.unionByName(part)
    return out


def platform_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform")).agg(F.count(F.lit(1)).alias("n"))


def coverage_counts(points: DataFrame) -> DataFrame:
    """One row: aircraft, military aircraft, aircraft that report integrity at least once."""
    reports = F.col("nic").isNotNull() | F.col("nac_p").isNotNull()
    per_craft = points.groupBy("hex").agg(F.bool_or("military").alias("military"), F.bool_or(reports).alias("reports"))
    return per_craft.agg(F.count(F.lit(1)).alias("n_aircraft"), F.count_if("military").alias("n_military"), F.count_if("reports").alias("n_navint_aircraft"))


def map_clusters(records: DataFrame, zoom: int) -> DataFrame:
    """Marker groups for a zoom level: count and mean position per square; single records from zoom 7 on."""
    if zoom >= 7:
        return records.select(F.col("lat"), F.col("lon"), F.lit(1).cast("bigint").alias("n"))
    degrees = max(2.0, 360.0 / 2 ** zoom * 1.5)
    key = [F.floor((F.col("lat") + 90.0) / degrees).alias("_r"), F.floor((F.col("lon") + 180.0) / degrees).alias("_c")]
    return records.groupBy(*key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("n")).drop("_r", "_c")
