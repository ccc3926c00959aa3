"""Activity over time: replay bins, backfilled flows and the live merge of both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import STREAMS
from geoweave.functions.aircraft import is_degraded
from geoweave.functions.geo import round_to
from geoweave.operators.baseline import BinWindow, stream_keys, total_z
from geoweave.operators.filters import new_thermal, not_centroid
from geoweave.operators.joins import inside_any_region

STEP_S = 900


def _per_bin(df: DataFrame, window: BinWindow, *counts) -> DataFrame:
    i = window.bin_of(F.col("t"))
    return df.withColumn("bin", i).filter((i >= 0) & (i < window.n)).groupBy("bin").agg(*counts)


def craft_per_bin(points: DataFrame, window: BinWindow) -> DataFrame:
    """Distinct aircraft, military aircraft, integrity reporters and degraded ones per bin."""
    i = window.bin_of(F.col("t"))
    degraded = is_degraded(F.col("nic"), F.col("nac_p"))
    once = points.withColumn("bin", i).filter((i >= 0) & (i < window.n)).groupBy("bin", "hex").agg(
        F.max("military").alias("mil"), F.max(degraded.isNotNull()).alias("known"), F.max(F.coalesce(degraded, F.lit(False))).alias("deg"))
    return once.groupBy("bin").agg(F.count(F.lit(1)).alias("tracks"), F.count_if("mil").alias("military"), F.count_if("known").alias("navint_known"),
                                   F.count_if("deg").alias("navint_degraded"))


def replay_timeline(events: DataFrame, points: DataFrame, hotspots: DataFrame, t_min: float, t_max: float, step_s: float = STEP_S,
                    scenes: DataFrame | None = None, with_z: bool = True) -> DataFrame:
    """Every bin of the window with its activity, the hourly z of each stream and the number of radar scenes in it."""
    window = BinWindow(t_min, t_max, step_s)
    every = F.count(F.lit(1))
    news = _per_bin(events, window, F.count_if(~F.col("is_social")).alias("events"), F.count_if(~F.col("is_social") & F.col("is_conflict")).alias("conflict"),
                    F.count_if("is_social").alias("social"))
    out = events.sparkSession.range(window.n).select(F.col("id").cast("int").alias("bin"))
    parts = [news, craft_per_bin(points, window), _per_bin(hotspots.filter(new_thermal()), window, every.alias("firms_new"))]
    if scenes is not None:
        parts.append(_per_bin(scenes.select("t").distinct(), window, every.alias("scenes")))
    for part in parts:
        out = out.join(part, "bin", "left")
    out = out.fillna(0).withColumn("t", window.start_of(F.col("bin")))
    if with_z:
        hourly = BinWindow(t_min, t_max, 3600.0)
        z = total_z(stream_keys(hourly, events, points, hotspots), hourly).groupBy(F.col("bin").alias("_hour")).agg(
            *[F.max(F.when(F.col("stream") == s, F.col("z"))).alias(f"z_{s}") for s in STREAMS])
        out = out.withColumn("_hour", hourly.bin_of(F.col("t"))).join(z, "_hour", "left").drop("_hour")
    return out


def backfill_counts(events: DataFrame, posts: DataFrame, regions: DataFrame | None, step_s: int = STEP_S) -> DataFrame:
    """Per slot: geocoded news and conflict news inside the circles (centroids left out), and geolocated posts inside them."""
    slot = (F.floor(F.col("t") / step_s) * step_s).alias("slot")
    news = inside_any_region(events.filter(not_centroid()), regions).groupBy(slot).agg(
        F.count(F.lit(1)).alias("events"), F.count_if("is_conflict").alias("conflict"))
    social = inside_any_region(posts.filter(F.col("lat").isNotNull()), regions).groupBy(slot).agg(F.count(F.lit(1)).alias("social"))
    return news.join(social, "slot", "full")


def live_timeline(backfill: DataFrame, hotspots: DataFrame, history: DataFrame, now: float, hours: float, step_s: int = STEP_S) -> DataFrame:
    """Slots of the last `hours`: backfilled flows, new thermal detections, and own history (levels averaged, flows summed).

    Levels stay null where nothing was recorded. Flows of unprimed points do not count, and history may raise conflict only
    where no backfill exists.
    """
    start = int((now - hours * 3600) // step_s * step_s)
    n = int((now - start) // step_s) + 1
    slots = backfill.sparkSession.range(n).select((F.col("id") * step_s + start).alias("slot"))
    slot = (F.floor(F.col("t") / step_s) * step_s).alias("slot")
    fires = hotspots.filter(new_thermal()).groupBy(slot).agg(F.count(F.lit(1)).alias("firms_new"))
    primed = F.coalesce("primed", F.lit(False))
    own = history.groupBy(slot).agg(
        F.avg("ais").alias("ais"), F.bround(F.avg(F.coalesce("tracks", F.lit(0)))).cast("bigint").alias("tracks"),
        F.bround(F.avg(F.coalesce("military", F.lit(0)))).cast("bigint").alias("military"),
        F.sum(F.when(primed, F.coalesce("d_alerts", F.lit(0))).otherwise(0)).alias("alerts"),
        F.sum(F.when(primed, F.coalesce("d_conflict", F.lit(0))).otherwise(0)).alias("own_conflict"))
    joined = slots.join(backfill, "slot", "left").join(fires, "slot", "left").join(own, "slot", "left")
    filled = F.col("conflict").isNotNull()
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "slot", F.coalesce("events", zero).alias("events"),
        F.when(filled, F.col("conflict")).otherwise(F.coalesce("own_conflict", zero)).alias("conflict"), F.coalesce("social", zero).alias("social"),
        "tracks", "military", round_to(F.col("ais"), 1).alias("ais"), F.coalesce("alerts", zero).alias("alerts"), F.coalesce("firms_new", zero).alias("firms_new"),
        filled.alias("backfilled"))


def vessel_level(vessels: DataFrame, feed_state: DataFrame) -> DataFrame:
    """(at, ais): vessels known at each feed report, null unless the feed was ready and areas existed.

    feed_state(at, ready, n_regions); vessels(mmsi, slot_at) are the vessels current at a report.
    """
    counts = vessels.groupBy("at").agg(F.count_distinct("mmsi").alias("_n"))
    ready = F.col("ready") & (F.col("n_regions") > 0)
    return feed_state.join(counts, "at", "left").select("at", F.when(ready, F.coalesce("_n", F.lit(0).cast("bigint"))).alias("ais"))


def first_seen_flow(sightings: DataFrame) -> DataFrame:
    """(batch, n_new): ids per batch that no earlier batch held. sightings(id, batch)."""
    return sightings.groupBy("id").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count(F.lit(1)).alias("n_new"))
