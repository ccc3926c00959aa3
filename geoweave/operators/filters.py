"""Row filters and gates shared by the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import CENTROID_TYPES, GULF_BBOX, NOVELTY_NEW, POSITIVE_VERDICTS
from geoweave.functions.geo import explode_ring, in_box, with_cell
from geoweave.functions.news import is_dateline


def in_view(records: DataFrame, box: tuple[float, float, float, float] | None = None, limit: int | None = None,
            order: list | None = None) -> DataFrame:
    """Records in a map view (west, south, east, north); west may exceed east. The limit needs an order to be stable."""
    out = records if box is None else records.filter(in_box(F.col("lat"), F.col("lon"), *box))
    if limit is None:
        return out
    return (out.orderBy(*order) if order else out).limit(limit)


def tails_in_view(ends: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Tails whose last position is in the view: rows of `tail_ends`, before any path is collected."""
    return ends.filter(in_box(F.col("lat"), F.col("lon"), *box))


def day_loader(events: DataFrame, bbox: tuple[float, float, float, float] = GULF_BBOX, keywords: tuple[str, ...] = (),
               drop_centroids: bool = True) -> DataFrame:
    """Keep events inside the box (south, west, north, east) or whose address names a keyword."""
    south, west, north, east = bbox
    keep = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    if keywords:
        lowered = F.lower(F.coalesce("url", F.lit("")))
        for word in keywords:
            keep = keep | F.contains(lowered, F.lit(word.lower()))
    out = events.filter(keep)
    return out.filter(not_centroid()) if drop_centroids else out


def not_centroid() -> Column:
    return ~F.col("geo_type").isin(*CENTROID_TYPES)


def severe_enough(minimum: float) -> Column:
    """Severity gate: 0.35 on the live path, 0.3 on replay."""
    return (F.col("severity") >= F.lit(float(minimum))) & not_centroid()


def retrieval_worthy() -> Column:
    """Thermal records need novelty; aircraft need a reason to look: military, emergency or low."""
    craft = (F.coalesce("military", F.lit(False)) | F.coalesce(F.col("emergency") != "", F.lit(False))
             | F.coalesce(F.col("alt_ft") < 10000, F.lit(False)))
    return (F.when(F.col("kind") == "firms", F.coalesce("novelty", F.lit(0.0)) >= 0.5)
            .when(F.col("kind") == "adsb", craft).otherwise(F.lit(True)))


def new_thermal() -> Column:
    return F.coalesce("novelty", F.lit(0.0)) >= NOVELTY_NEW


def departed_gate(records: DataFrame, departed_cells: DataFrame) -> DataFrame:
    """Records in departed cells or their neighbours, without dateline news."""
    hot = explode_ring(departed_cells.select("row", "col")).select(F.col("nrow").alias("_row"), F.col("ncol").alias("_col")).distinct()
    place = F.regexp_extract("label", r"^(?:.*?: )?(.*)$", 1)
    dateline = (F.col("kind") == "gdelt") & is_dateline(place)
    placed = with_cell(records.filter(~F.coalesce(dateline, F.lit(False))), row="_row", col="_col")
    return placed.join(hot, ["_row", "_col"], "left_semi").drop("_row", "_col")


def between(df: DataFrame, start: float, end: float) -> DataFrame:
    return df.filter(F.col("t").between(float(start), float(end)))


def visible_verdicts(verdicts: DataFrame, include_rejected: bool = False) -> DataFrame:
    if include_rejected:
        return verdicts
    same_article = F.coalesce("same_article", F.lit(False))
    return verdicts.filter(F.col("verdict").isin(*POSITIVE_VERDICTS) | same_article)


def matches_text(columns: list[str], needle: str) -> Column:
    wanted = needle.strip().lower()
    return F.lit(True) if not wanted else F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(wanted))


def newest_on_platform(posts: DataFrame, platform: str | None, limit: int | None = None) -> DataFrame:
    """Posts of one platform, or all; `limit` takes the newest."""
    out = posts.filter(F.col("platform") == platform.strip().lower()) if platform else posts
    return out if limit is None else out.orderBy(F.col("t").desc(), "id").limit(limit)
