"""Aircraft tracks: tails, thinned paths, newest positions per slot, merges and carry-forward.

Orderings inside one aircraft are computed over (aircraft, time segment) pieces joined by a small per-segment summary, so a
single aircraft that holds a large share of all points is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_S = 6 * 3600.0
BIN_S = 900.0


def _in_span(points: DataFrame, t_from: float, t_to: float, present: DataFrame | None) -> DataFrame:
    p = points.filter(F.col("t").between(float(t_from), float(t_to)))
    return p if present is None else p.join(present.select("hex").distinct(), "hex", "left_semi")


def tail_ends(points: DataFrame, t_from: float, t_to: float, present: DataFrame | None = None, at_least: int = 2) -> DataFrame:
    """(hex, callsign, military, t, lat, lon, n_points): the last position of each aircraft in the span and how many timestamps it has, by aggregates with a partial step; no path is collected."""
    once = _in_span(points, t_from, t_to, present).groupBy("hex", "t").agg(F.max(F.struct("lat", "lon", "flight", "military")).alias("_p"))
    ends = once.groupBy("hex").agg(F.max_by(F.struct("t", "_p"), "t").alias("_e"), F.count(F.lit(1)).alias("n_points")).filter(F.col("n_points") >= at_least)
    return ends.select("hex", F.col("_e._p.flight").alias("callsign"), F.col("_e._p.military").alias("military"), "_e.t", "_e._p.lat", "_e._p.lon", "n_points")


def tails(points: DataFrame, t_from: float, t_to: float, present: DataFrame | None = None, at_least: int = 2, ends: DataFrame | None = None) -> DataFrame:
    """Path per aircraft over a short span: one position per timestamp, in time order, at least two of them.

    A path holds the distinct timestamps of the span, so the span bounds it. `present` limits the result to aircraft seen now, `ends` to those whose `tail_ends` are wanted, such as
    the ones in view: then only their positions are collected.
    """
    p = _in_span(points, t_from, t_to, present)
    p = p if ends is None else p.join(ends.select("hex"), "hex", "left_semi")
    once = p.groupBy("hex", "t").agg(F.max(F.struct("lat", "lon", "flight", "military")).alias("_p"))
    path = F.array_sort(F.collect_list(F.struct("t", F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))))
    last = F.max_by("_p", "t")
    out = once.groupBy("hex").agg(path.alias("coords"), last.alias("_last"))
    return (out.filter(F.size("coords") >= at_least)
            .select("hex", F.col("_last.flight").alias("callsign"), F.col("_last.military").alias("military"), "coords"))


def _segmented(points: DataFrame, by: str, segment_s: float) -> DataFrame:
    return points.withColumn("_seg", F.floor(F.col("t") / F.lit(segment_s)))


def numbered(points: DataFrame, by: str = "hex", tie: tuple[str, ...] = ("lat", "lon"), segment_s: float = SEGMENT_S) -> DataFrame:
    """Adds `rn` (0-based position in time) and `n_points` per aircraft without ordering a whole aircraft in one task."""
    p = _segmented(points, by, segment_s)
    sizes = p.groupBy(by, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(by).orderBy("_seg")
    sizes = sizes.withColumns({
        "_before": F.sum("_n").over(whole.rowsBetween(Window.unboundedPreceding, -1)),
        "n_points": F.sum("_n").over(Window.partitionBy(by))}).drop("_n")
    local = F.row_number().over(Window.partitionBy(by, "_seg").orderBy("t", *tie)) - 1
    return (p.withColumn("_local", local).join(sizes, [by, "_seg"])
            .withColumn("rn", F.col("_local") + F.coalesce("_before", F.lit(0))).drop("_local", "_before", "_seg"))


def thinned_paths(points: DataFrame, t_from: float, t_to: float, max_points: int = 400) -> DataFrame:
    """Every floor(n / max_points)-th position of each aircraft in the span, as rows, with its last known callsign."""
    p = points.filter(F.col("t").between(float(t_from), float(t_to)))
    rows = numbered(p).filter(F.col("n_points") >= 2)
    step = F.greatest(F.lit(1), F.floor(F.col("n_points") / max_points))
    last_flight = F.max_by("flight", F.when(F.coalesce("flight", F.lit("")) != "", F.struct("t", "lat", "lon")))
    named = p.groupBy("hex").agg(last_flight.alias("callsign"))
    kept = rows.filter(F.col("rn") % step == 0).select("hex", "rn", "t", "lat", "lon", "military")
    return kept.join(named, "hex")


def carry_forward(points: DataFrame, columns: list[str], by: str = "hex", order: str = "t", tie: tuple[str, ...] = (),
                  segment_s: float = SEGMENT_S) -> DataFrame:
    """Fill nulls of `columns` with the last earlier value of the same aircraft."""
    p = points.withColumn("_seg", F.floor(F.col(order) / F.lit(segment_s)))
    at = F.struct(order, *tie)
    lasts = p.groupBy(by, "_seg").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{c}") for c in columns])
    before = Window.partitionBy(by).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(by, "_seg", *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    inside = Window.partitionBy(by, "_seg").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, 0)
    filled = p.select(*[c for c in p.columns if c not in columns], *[F.last(c, ignorenulls=True).over(inside).alias(c) for c in columns])
    out = filled.join(lasts, [by, "_seg"])
    return out.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in points.columns])


def newest_per_slot(points: DataFrame, slot_s: float = BIN_S) -> DataFrame:
    """Newest position per aircraft and time slot."""
    payload = [c for c in points.columns if c != "hex"]
    p = points.withColumn("slot", F.floor(F.col("t") / slot_s))
    best = p.groupBy("hex", "slot").agg(F.max_by(F.struct(*payload), F.struct("t", "lat", "lon")).alias("_p"))
    return best.select("hex", "slot", *[F.col(f"_p.{c}").alias(c) for c in payload])


def merge_days(day_tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(aircraft, points) of several days: points united, military if any day says so, other fields from the first day (of
    several values there the least, a missing one last)."""
    points = None
    for day, table in enumerate(day_tables):
        tagged = table.withColumn("_day", F.lit(day))
        points = tagged if points is None else points.unionByName(tagged, allowMissingColumns=True)
    fields = [c for c in ("reg", "ac_type", "desc", "ownop") if c in points.columns]
    craft = points.groupBy("hex").agg(
        F.bool_or("military").alias("military"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.max("t").alias("t_last"),
        *[F.min_by(c, F.struct("_day", F.col(c).isNull().alias("none"), c)).alias(c) for c in fields])
    return craft, points.drop("_day")


def civil_not_military(military: DataFrame, civil: DataFrame) -> DataFrame:
    """The military feed plus the aircraft only the regional queries saw."""
    return military.unionByName(civil.join(military.select("hex").distinct(), "hex", "left_anti"), allowMissingColumns=True)


def union_first(parts: list[DataFrame], key: str = "id", position: str | None = None) -> DataFrame:
    """Union in precedence order, first occurrence of each key kept.

    Inside one part the first is the one with the least `position` (a column of the parts, such as file and line); rows without one, or at one position, are
    told apart by a hash of their content, so the choice does not depend on how Spark reads them.
    """
    return _union_by(parts, key, True, position)


def union_last(parts: list[DataFrame], key: str = "id", position: str | None = None) -> DataFrame:
    """Union in order, last occurrence of each key kept; ties as in `union_first`."""
    return _union_by(parts, key, False, position)


def _union_by(parts: list[DataFrame], key: str, first: bool, position: str | None) -> DataFrame:
    both = None
    for i, part in enumerate(parts):
        tagged = part.withColumn("_prec", F.lit(i))
        both = tagged if both is None else both.unionByName(tagged, allowMissingColumns=True)
    payload = [c for c in both.columns if c not in (key, "_prec")]
    pick = F.min_by if first else F.max_by
    rank = F.struct("_prec", *[position] * (position is not None), F.xxhash64(F.to_json(F.struct(*payload))).alias("_tie"))
    return (both.groupBy(key).agg(pick(F.struct(*payload), rank).alias("_p"))
            .select(key, *[F.col(f"_p.{c}").alias(c) for c in payload]))
