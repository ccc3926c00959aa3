"""Joins that Spark has no single operator for: space-time proximity, as-of, nearest, circles and phrases.

All of them become equi-joins on block keys followed by the exact test, so the work is shuffled by block and never a
Cartesian product. Blocks with too many pairs to test are cut into grids (see `balanced_join`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.fixed_values import EARTH_KM, KM_PER_NM
from geoweave.functions.geo import cell_index, circle_boxes, explode_ring, haversine_km, with_cell
from geoweave.session import cut_lineage, shuffled

#: Pair tests of one block that a task may get before the block is split.
BLOCK_WORK = 4_000_000
#: Most partitions a join asks for; beyond it each of them tests more pairs.
MOST_PARTS = 4096
BROADCAST_BYTES = 32 << 20
#: A table of heavy blocks is broadcast below this; unions of block joins hold several at once.
GRID_BYTES = 4 << 20


def block_work(probe: DataFrame, build: DataFrame, keys: list[str], work: int = BLOCK_WORK) -> DataFrame:
    """The blocks in which probe rows x build rows exceed `work`, with the grid each is cut into: (keys, _cuts_b, _cuts_p).

    The grid has about product / `work` fields. Build rows go to one of _cuts_b rows of it and are repeated along it, probe rows the other way round; the two numbers keep the
    sum of repeated rows least, so whichever side is larger is cut more. One aggregate over the keys of both sides, counted before the shuffle.
    """
    return _grids(_block_counts(probe, build, keys), keys, work)


def _block_counts(probe: DataFrame, build: DataFrame, keys: list[str]) -> DataFrame:
    sides = probe.select(*keys, F.lit(1).cast("bigint").alias("_np"), F.lit(0).cast("bigint").alias("_nb")).unionByName(
        build.select(*keys, F.lit(0).cast("bigint").alias("_np"), F.lit(1).cast("bigint").alias("_nb")))
    return sides.groupBy(*keys).agg(F.sum("_np").cast("double").alias("_np"), F.sum("_nb").cast("double").alias("_nb"))


def _grids(counts: DataFrame, keys: list[str], work: int) -> DataFrame:
    fields = F.ceil(F.col("_np") * F.col("_nb") / float(work))
    best = F.greatest(F.lit(1.0), F.round(F.sqrt(fields * F.col("_nb") / F.col("_np"))))
    cuts_b = F.least(best, fields, F.col("_nb"))
    heavy = counts.filter(F.col("_np") * F.col("_nb") > float(work)).withColumn("_cuts_b", cuts_b.cast("int"))
    return heavy.select(*keys, "_cuts_b", F.least(F.ceil(fields / F.col("_cuts_b")), F.col("_np")).cast("int").alias("_cuts_p"))


def balanced_join(probe: DataFrame, build: DataFrame, keys: list[str], condition: Column | None = None, *, probe_id: Column | None = None,
                  build_id: Column | None = None, work: int = BLOCK_WORK, keep_grid: bool = False) -> DataFrame:
    """Inner equi-join on `keys` in which no block gives a task more than about `work` pairs to test, whichever side is frequent.

    Blocks within the bound are joined as they are. The others become grids (`block_work`), so a block is spread even if its other side has one row. Each side is read twice: for the
    keys and for the join. The table of heavy blocks is written, counted, and broadcast only while it is small; beyond that it is joined by shuffle.

    What such a join costs is its pair tests, not its bytes, by which the adaptive planner sizes partitions: so beyond `work` tests the rows are parted by the number of tests. With `keep_grid` the pairs
    keep _grid_b and _grid_p: rows with equal keys and equal ids are in one field, so an aggregate by keys, grid and ids needs no shuffle.

    The sides are always shuffled: the planner goes by the size of the files read and knows nothing of rows repeated for neighbouring blocks, so it would broadcast sides far beyond its threshold.
    """
    tests = F.col("_np") * F.col("_nb")
    counts = _block_counts(probe, build, keys).filter(tests > 0).withColumn("_heavy", tests > float(work))
    # a row for each heavy block, and one for all others together
    light = counts.groupBy("_heavy", *[F.when(F.col("_heavy"), F.col(k)).alias(k) for k in keys]).agg(F.max("_np").alias("_np"), F.max("_nb").alias("_nb"), F.sum(tests).alias("_tests"))
    told = cut_lineage(light)
    n, total = told.agg(F.count_if("_heavy"), F.coalesce(F.sum("_tests"), F.lit(0.0))).first()
    heavy = _grids(told.filter("_heavy"), keys, work)
    parts = int(min(MOST_PARTS, -(-total // work)))

    def parted(df: DataFrame, names: list[str]) -> DataFrame:
        return df.repartition(parts, *names) if parts > 1 else df

    if n == 0:
        joined = parted(probe, keys).join(shuffled(parted(build, keys)), keys)
        if keep_grid:
            joined = joined.withColumns({"_grid_b": F.lit(0), "_grid_p": F.lit(0)})
        return joined.filter(condition) if condition is not None else joined
    grid = F.broadcast(heavy) if n * (32 * len(keys) + 16) <= GRID_BYTES else shuffled(heavy)

    def dealt(df: DataFrame, row_id: Column | None, own: str, other: str) -> DataFrame:
        spread = row_id if row_id is not None else F.xxhash64(*[F.col(c) for c in df.columns])
        cut = df.join(grid, keys, "left").withColumn(f"_grid_{own}", F.pmod(spread, F.coalesce(F.col(f"_cuts_{own}"), F.lit(1))).cast("int"))
        return cut.withColumn(f"_grid_{other}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_cuts_{other}"), F.lit(1)) - 1))).drop("_cuts_b", "_cuts_p")

    fields = [*keys, "_grid_b", "_grid_p"]
    joined = parted(dealt(probe, probe_id, "p", "b"), fields).join(shuffled(parted(dealt(build, build_id, "b", "p"), fields)), fields)
    joined = joined.filter(condition) if condition is not None else joined
    return joined if keep_grid else joined.drop("_grid_b", "_grid_p")


def in_order(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Rows with numbers from 0 in `order`: sorted over all partitions and written once, numbered by partition sizes (a row per partition)."""
    rows = cut_lineage(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    sizes = rows.groupBy(F.shiftright("_id", 33).alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_part", F.shiftright("_id", 33)).join(F.broadcast(before), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_id") - F.shiftleft("_part", 33)).drop("_part", "_before", "_id")


# ---- space x time --------------------------------------------------------------------------------

def _with_unit(df: DataFrame, side: str) -> DataFrame:
    """Adds the unit vector of a position, so that most pairs are told apart by three differences."""
    lat, lon = F.radians(f"{side}_lat"), F.radians(f"{side}_lon")
    return df.withColumns({f"_{side}x": F.cos(lat) * F.cos(lon), f"_{side}y": F.cos(lat) * F.sin(lon), f"_{side}z": F.sin(lat)})


_UNITS = ("_lx", "_ly", "_lz", "_rx", "_ry", "_rz")


def _within(radius_km: Column) -> Column:
    """km <= radius. The haversine is worked out only where the chord is within about a centimetre of the limit."""
    chord = F.lit(2.0) * F.sin(F.least(radius_km / F.lit(2.0 * EARTH_KM), F.lit(math.pi / 2.0)))
    square = sum(((F.col(f"_l{c}") - F.col(f"_r{c}")) * (F.col(f"_l{c}") - F.col(f"_r{c}")) for c in "yz"), (F.col("_lx") - F.col("_rx")) * (F.col("_lx") - F.col("_rx")))
    inner, outer = F.greatest(F.lit(0.0), chord - 2e-9), chord + 2e-9
    exact = haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")) <= radius_km
    return (square < inner * inner) | ((square <= outer * outer) & exact)


def _may_reach(radius_km: float) -> Column:
    """Whether the cell (_r, _c) may hold a position within the radius of (l_lat, l_lon); most of a ring may not where the radius is below a degree."""
    up, across = F.lit(math.degrees(radius_km / EARTH_KM) + 1e-6), _reach_across(F.lit(radius_km), F.col("l_lat")) + 1e-6
    return F.col("l_lat").between(F.col("_r") - up, F.col("_r") + 1 + up) & F.col("l_lon").between(F.col("_c") - across, F.col("_c") + 1 + across)


def near_join(left: DataFrame, right: DataFrame, radius_km: float, window_min: float, *, right_id: str | Column = "r_id", left_id: Column | None = None,
              only: Column | None = None, work: int = BLOCK_WORK, keep_blocks: bool = False) -> DataFrame:
    """Pairs in neighbouring one-degree cells within a radius and a time span.

    Needs l_lat, l_lon, l_t and r_lat, r_lon, r_t. The 3x3 neighbourhood is part of the rule: far from the equator it is
    narrower than the radius, and it does not wrap at the date line. `radius_join` has neither limit.
    The left side is the repeated one (9 cells x 3 time slots), so pass the smaller side there. `only` is a further condition. With `keep_blocks` the pairs keep NEAR_BLOCK: an aggregate by it and by
    what the ids (expressions) are made of needs no shuffle.
    """
    span = float(window_min) * 60.0
    probe = with_cell(_with_unit(left, "l"), "l_lat", "l_lon", row="_row", col="_col")
    probe = explode_ring(probe, "_row", "_col", "_r", "_c").drop("_row", "_col").filter(_may_reach(float(radius_km)))
    slot = F.floor(F.col("l_t") / span)
    probe = probe.withColumn("_slot", F.explode(F.sequence(slot - 1, slot + 1)))
    build = with_cell(_with_unit(right, "r"), "r_lat", "r_lon", row="_r", col="_c").withColumn("_slot", F.floor(F.col("r_t") / span))
    wanted = F.abs(F.col("r_t") - F.col("l_t")) <= span
    wanted = (wanted if only is None else wanted & only) & _within(F.lit(float(radius_km)))
    pairs = balanced_join(probe, build, ["_r", "_c", "_slot"], wanted, probe_id=left_id, build_id=right_id if isinstance(right_id, Column) else F.xxhash64(F.col(right_id), F.col("r_t")),
                          work=work, keep_grid=keep_blocks).drop(*_UNITS)
    pairs = pairs.withColumn("km", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    pairs = pairs.withColumn("minutes", F.abs(F.col("r_t") - F.col("l_t")) / 60.0)
    return pairs if keep_blocks else pairs.drop("_r", "_c", "_slot")


def near_met(left: DataFrame, right: DataFrame, radius_km: float, window_min: float) -> tuple[DataFrame, DataFrame]:
    """The rows of `left`, and those of `right`, that are in any pair of `near_join`; left rows come once per block in which they have a partner. A semi-join stops at the first one."""
    span = float(window_min) * 60.0
    probe = explode_ring(with_cell(_with_unit(left, "l"), "l_lat", "l_lon", row="_row", col="_col"), "_row", "_col", "_r", "_c").drop("_row", "_col").filter(_may_reach(float(radius_km)))
    slot = F.floor(F.col("l_t") / span)
    probe = probe.withColumn("_slot", F.explode(F.sequence(slot - 1, slot + 1)))
    build = with_cell(_with_unit(right, "r"), "r_lat", "r_lon", row="_r", col="_c").withColumn("_slot", F.floor(F.col("r_t") / span))
    keys = ["_r", "_c", "_slot"]
    other_b, other_p = (df.withColumnsRenamed({k: f"{k}2" for k in keys}) for df in (build, probe))
    same = (F.col("_r") == F.col("_r2")) & (F.col("_c") == F.col("_c2")) & (F.col("_slot") == F.col("_slot2"))
    wanted = same & (F.abs(F.col("r_t") - F.col("l_t")) <= span) & _within(F.lit(float(radius_km)))
    return tuple(own.join(shuffled(other), wanted, "left_semi").select(*df.columns) for own, other, df in ((probe, other_b, left), (build, other_p, right)))


#: The columns of a block and its fields.
NEAR_BLOCK = ("_r", "_c", "_slot", "_grid_b", "_grid_p")


def _band_height(radius_km: Column) -> Column:
    return radius_km / F.lit(111.0)


def _columns_in_band(band: Column, radius_km: Column) -> Column:
    """How many longitude blocks a latitude band is cut into: each at least one radius wide at the band's narrow edge."""
    height = _band_height(radius_km)
    edge = F.least(F.lit(90.0), F.greatest(F.abs(band * height), F.abs((band + 1) * height)))
    return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height)).cast("bigint")


def radius_block(lat: Column, lon: Column, radius_km: Column) -> Column:
    """The one block holding a position."""
    band = F.floor(lat / _band_height(radius_km))
    n = _columns_in_band(band, radius_km)
    return F.struct(band.alias("band"), F.pmod(F.floor((lon + 180.0) * n / 360.0), n).cast("bigint").alias("slice"))


def _reach_across(radius_km: Column, lat: Column) -> Column:
    """Degrees of longitude that a circle spans to either side."""
    narrow = F.sin(radius_km / F.lit(EARTH_KM)) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    return F.when(narrow >= 1.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), narrow))) + 1e-9)


def radius_blocks(lat: Column, lon: Column, radius_km: Column) -> Column:
    """All blocks that may hold a position within the radius, across the date line and at the poles."""
    band = F.floor(lat / _band_height(radius_km))
    reach = _reach_across(radius_km, lat)

    def slices(b: Column) -> Column:
        n = _columns_in_band(b, radius_km)
        first = F.floor((lon - reach + 180.0) * n / 360.0)
        last = F.least(F.floor((lon + reach + 180.0) * n / 360.0), first + n - 1)
        return F.transform(F.sequence(first, last), lambda s: F.struct(b.alias("band"), F.pmod(s, n).cast("bigint").alias("slice")))

    return F.flatten(F.transform(F.sequence(band - 1, band + 1), slices))


def radius_join(left: DataFrame, right: DataFrame, radius_km: Column | float, window_min: Column | float | None = None, *,
                on: list[str] | None = None, right_id: str | Column = "r_id", left_id: str | Column | None = None,
                work: int = BLOCK_WORK) -> DataFrame:
    """Exact pairs within a radius (and a time span), wrapping in longitude and valid at the poles.

    `on` names further equality keys present on both sides; radius and span may be columns that these keys determine.
    """
    radius = radius_km if isinstance(radius_km, Column) else F.lit(float(radius_km))
    on = list(on or [])
    probe = _with_unit(left, "l").withColumn("_b", F.explode(radius_blocks(F.col("l_lat"), F.col("l_lon"), radius)))
    probe = probe.withColumns({"_band": F.col("_b.band"), "_slice": F.col("_b.slice")}).drop("_b")
    build = _with_unit(right, "r").withColumn("_b", radius_block(F.col("r_lat"), F.col("r_lon"), radius))
    build = build.withColumns({"_band": F.col("_b.band"), "_slice": F.col("_b.slice")}).drop("_b")
    keys = [*on, "_band", "_slice"]
    condition = _within(F.col("_radius"))
    if window_min is not None:
        span = (window_min if isinstance(window_min, Column) else F.lit(float(window_min))) * 60.0
        slot = F.floor(F.col("l_t") / span)
        probe = probe.withColumn("_slot", F.explode(F.sequence(slot - 1, slot + 1))).withColumn("_span", span)
        build = build.withColumn("_slot", F.floor(F.col("r_t") / span))
        keys.append("_slot")
        condition = (F.abs(F.col("r_t") - F.col("l_t")) <= F.col("_span")) & condition
    probe = probe.withColumn("_radius", radius)
    shared = [c for c in build.columns if c in probe.columns and c not in keys]
    pairs = balanced_join(probe, build.drop(*shared), keys, condition, probe_id=F.xxhash64(F.col(left_id)) if isinstance(left_id, str) else left_id,
                          build_id=right_id if isinstance(right_id, Column) else F.xxhash64(F.col(right_id)), work=work).drop(*_UNITS)
    pairs = pairs.withColumn("km", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    if window_min is not None:
        pairs = pairs.withColumn("minutes", F.abs(F.col("r_t") - F.col("l_t")) / 60.0)
    return pairs.drop("_band", "_slice", "_slot", "_span", "_radius")


def sided(df: DataFrame, side: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Prefix columns with `l_` or `r_` for the pair joins."""
    names = columns or {c: c for c in df.columns}
    return df.select(*[F.col(old).alias(f"{side}_{new}") for old, new in names.items()])


# ---- circles -------------------------------------------------------------------------------------

def region_cells(regions: DataFrame) -> DataFrame:
    """One row per (region, one-degree cell its circle may touch)."""
    boxes = regions.withColumn("_box", F.explode(circle_boxes(F.col("lat"), F.col("lon"), F.col("radius_nm"))))
    rows = F.sequence(cell_index(F.col("_box.south")), cell_index(F.col("_box.north")))
    cols = F.sequence(cell_index(F.col("_box.west")), cell_index(F.col("_box.east")))
    return (boxes.withColumn("row", F.explode(rows)).withColumn("col", F.explode(cols))
            .select(F.col("id").alias("region_id"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"),
                    (F.col("radius_nm") * F.lit(KM_PER_NM)).alias("g_km"), "row", "col").distinct())


def _inside(records: DataFrame, cells: DataFrame) -> Column:
    return ((records["_row"] == cells["row"]) & (records["_col"] == cells["col"])
            & (haversine_km(records["lat"], records["lon"], cells["g_lat"], cells["g_lon"]) <= cells["g_km"]))


def inside_any_region(records: DataFrame, regions: DataFrame | None) -> DataFrame:
    """Records inside at least one circle; no regions table at all means no restriction."""
    if regions is None:
        return records
    cells = region_cells(regions)
    placed = with_cell(records, row="_row", col="_col")
    return placed.join(cells, _inside(placed, cells), "left_semi").drop("_row", "_col")


def inside_regions(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records repeated per circle that holds them, with `region_id`."""
    cells = region_cells(regions)
    placed = with_cell(records, row="_row", col="_col")
    return placed.join(cells, _inside(placed, cells)).drop("_row", "_col", "row", "col", "g_lat", "g_lon", "g_km")


# ---- time ----------------------------------------------------------------------------------------

def asof_snapshot(points: DataFrame, t: float, max_age_s: float = 300.0) -> DataFrame:
    """Latest point of each aircraft at or before `t`, no older than `max_age_s`."""
    fresh = points.filter(F.col("t").between(float(t) - max_age_s, float(t)))
    payload = [c for c in points.columns if c not in ("hex",)]
    best = F.max_by(F.struct(*payload), F.struct("t", "lat", "lon"))
    return fresh.groupBy("hex").agg(best.alias("_p")).select("hex", *[F.col(f"_p.{c}").alias(c) for c in payload])


def asof_snapshots(points: DataFrame, instants: DataFrame, max_age_s: float = 300.0, work: int = BLOCK_WORK) -> DataFrame:
    """`asof_snapshot` for a table of instants (`at`).

    A point counts from its time until the next point of its aircraft, or until it is too old. The next point comes from a window over (aircraft, time segment) and, for the last point of
    a segment, from a summary of one row a segment, so an aircraft with a third of the points is spread. Then every (instant, aircraft) meets exactly one such span: an equi-join on time
    slots with the exact test, busy slots cut into grids, and nothing to aggregate afterwards.
    """
    payload = [c for c in points.columns if c != "hex"]
    once = points.groupBy("hex", "t").agg(F.max(F.struct(*[c for c in ("lat", "lon") if c in payload], *[c for c in payload if c not in ("lat", "lon")])).alias("_p"))
    once = once.withColumn("_seg", F.floor(F.col("t") / (max_age_s * 64)))
    firsts = once.groupBy("hex", "_seg").agg(F.min("t").alias("_first"))
    follows = firsts.select("hex", "_seg", F.lead("_first").over(Window.partitionBy("hex").orderBy("_seg")).alias("_next_seg"))
    spans = once.withColumn("_next", F.lead("t").over(Window.partitionBy("hex", "_seg").orderBy("t"))).join(follows, ["hex", "_seg"])
    spans = spans.withColumn("_next", F.coalesce("_next", "_next_seg"))
    slots = F.sequence(F.floor(F.col("t") / max_age_s), F.floor(F.least("_next", F.col("t") + max_age_s) / max_age_s))
    build = spans.withColumn("_slot", F.explode(slots))
    probe = instants.select("at").distinct().withColumn("_slot", F.floor(F.col("at") / max_age_s))
    within = (F.col("t") <= F.col("at")) & (F.col("at") <= F.col("t") + max_age_s) & (F.col("_next").isNull() | (F.col("at") < F.col("_next")))
    met = balanced_join(probe, build, ["_slot"], within, build_id=F.xxhash64("hex", "t"), work=work)
    return met.select("at", "hex", *[F.col("_p." + c if c != "t" else "t").alias(c) for c in payload])


def nearest_scene(detections: DataFrame, instants: DataFrame, max_age_h: float = 72.0) -> DataFrame:
    """For each instant (`at`) the scene closest in time, before or after, within the limit; ties go to the earlier one.

    Returns at, scene_t, age_h (positive when the scene lies before the instant) and n, its number of detections.
    """
    scenes = detections.groupBy("t").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("t", "scene_t")
    span = max_age_h * 3600.0
    slot = F.floor(F.col("at") / span)
    probe = instants.withColumn("_slot", F.explode(F.sequence(slot - 1, slot + 1)))
    pairs = scenes.withColumn("_slot", F.floor(F.col("scene_t") / span)).join(probe, "_slot")
    pairs = pairs.filter(F.abs(F.col("scene_t") - F.col("at")) <= span)
    best = F.min_by(F.struct("scene_t", "n"), F.struct(F.abs(F.col("scene_t") - F.col("at")).alias("gap"), "scene_t"))
    picked = pairs.groupBy("at").agg(best.alias("_s"))
    return picked.select("at", "_s.scene_t", ((F.col("at") - F.col("_s.scene_t")) / 3600.0).alias("age_h"), "_s.n")


def core_scenes(detections: DataFrame, core: tuple[float, float, float, float], at_least: int) -> DataFrame:
    """Detections of the scenes that image the core box well enough."""
    la0, lo0, la1, lo1 = core
    inside = F.col("lat").between(la0, la1) & F.col("lon").between(lo0, lo1)
    good = detections.groupBy("t").agg(F.count_if(inside).alias("_core")).filter(F.col("_core") >= at_least).select("t")
    return detections.join(good, "t", "left_semi")


# ---- thermal novelty -----------------------------------------------------------------------------

def thermal_novelty(hotspots: DataFrame, baseline: DataFrame, radius_km: float = 2.0) -> DataFrame:
    """0 for a detection on a known hot place, 1 beyond `radius_km` from any; 0.5 when there is no baseline at all."""
    from geoweave.functions.geo import round_to
    left = hotspots.select(F.col("id").alias("l_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"))
    right = baseline.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    nearest = radius_join(left, right, radius_km).groupBy(F.col("l_id").alias("id")).agg(F.min("km").alias("_km"))
    known = baseline.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    scored = F.coalesce(round_to(F.least(F.lit(1.0), F.col("_km") / float(radius_km)), 3), F.lit(1.0))
    return (hotspots.drop("novelty").join(nearest, "id", "left")
            .withColumn("novelty", F.when(known > 0, scored).otherwise(F.lit(0.5))).drop("_km"))


# ---- phrases in texts ----------------------------------------------------------------------------

def phrase_hits(texts: DataFrame, phrases: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(rid, phrase) for every phrase that occurs as whole words in a text.

    texts(rid, text_norm, tokens) hold normalised padded text; phrases(phrase) normalised phrases. Each phrase is looked
    up through its rarest word only, so a common word never becomes a join key unless it is a whole phrase by itself.
    While the phrases are within `broadcast_bytes` the texts meet them where they are read and nothing of them is shuffled; beyond that their words are.
    """
    words = texts.select("rid", F.explode("tokens").alias("token"))
    parts = phrases.filter(F.trim("phrase") != "").select("phrase").distinct()
    parts = cut_lineage(parts.withColumn("token", F.explode(F.array_distinct(F.split("phrase", " ")))))
    weight = parts.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.octet_length("token") + 64), F.lit(0))).first()[0]
    small = weight <= broadcast_bytes
    counted = words.join(F.broadcast(parts.select("token").distinct()), "token", "left_semi") if small else words
    frequency = counted.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    # a phrase with a word that occurs nowhere cannot occur: such words rank first and then find no text
    ranked = parts.join(frequency, "token", "left").groupBy("phrase").agg(
        F.min_by("token", F.struct(F.coalesce("_df", F.lit(0)), "token")).alias("token"))
    single = F.instr("phrase", " ") == 0
    inside = F.expr("instr(text_norm, concat(' ', phrase, ' ')) > 0")
    if small:
        met = texts.select("rid", "text_norm", F.explode("tokens").alias("token")).join(F.broadcast(ranked), "token")
        return met.filter(single | inside).select("rid", "phrase")
    # a phrase that is one frequent word brings all texts that hold it to one key
    maybe = balanced_join(words, ranked, ["token"], probe_id=F.xxhash64("rid")).select("rid", "phrase")
    sure = maybe.filter(single)
    check = maybe.filter(~single).join(texts.select("rid", "text_norm"), "rid")
    checked = check.filter(inside).select("rid", "phrase")
    return sure.unionByName(checked)
