"""Events near aircraft: pairs, alerts and military aircraft sharing a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.functions.aircraft import aircraft_weight, alert_reason
from geoweave.functions.geo import cell_index, haversine_km, round_to, with_cell
from geoweave.functions.news import event_severity, root_label
from geoweave.operators.filters import severe_enough
from geoweave.operators.joins import BLOCK_WORK, NEAR_BLOCK, balanced_join, in_order, near_join, near_met, radius_join
from geoweave.session import cut_lineage, shuffled

#: Packed ranks below this are longs. Beyond it they are decimals of 10 digits for the score and 14 for each of two row numbers.
LONG_RANKS = 2 ** 63
_DIGITS = 14


def with_severity(events: DataFrame) -> DataFrame:
    return events.withColumn("severity", event_severity(F.col("is_conflict"), F.col("goldstein"), F.col("tone"), F.col("num_mentions")))


def _sides(events: DataFrame, tracks: DataFrame, min_severity: float) -> tuple[DataFrame, DataFrame]:
    """What a pair is made of: severe events (l_) and aircraft positions (r_)."""
    severe = with_severity(events).filter(severe_enough(min_severity))
    label = F.coalesce("root_label", root_label(F.col("root_code"))) if "root_label" in events.columns else root_label(F.col("root_code"))
    left = severe.select(F.col("id").alias("event_id"), F.col("lat").alias("l_lat"), F.col("lon").alias("l_lon"), F.col("t").alias("l_t"),
                         "severity", "is_conflict", "goldstein", "place", label.alias("root_label"))
    weight = aircraft_weight(F.col("military"), F.col("alt_ft"), F.col("emergency"), F.col("squawk"))
    right = tracks.select(F.concat(F.lit("adsb:"), "hex").alias("aircraft_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"),
                          F.col("t").alias("r_t"), "military", "alt_ft", weight.alias("weight"))
    return left, right


def _pair_score(km: Column, radius_km: float) -> Column:
    return round_to((F.lit(1.0) - km / F.lit(float(radius_km))) * F.col("severity") * F.col("weight"), 3)


def _shown(pairs: DataFrame, score: Column) -> DataFrame:
    """The columns of a pair that alerts show; needs both sides, km and minutes."""
    return pairs.select("event_id", "aircraft_id", score.alias("score"), round_to(F.col("km"), 1).alias("distance_km"),
                        round_to(F.col("minutes"), 1).alias("dt_min"), F.col("l_lat").alias("lat"), F.col("l_lon").alias("lon"),
                        F.col("r_t").alias("aircraft_t"), "place", F.concat("root_label", F.lit(": "), "place").alias("event_label"),
                        alert_reason(F.col("military"), F.col("alt_ft"), F.col("is_conflict"), F.col("root_label"), F.col("goldstein")).alias("reason"))


def near_pairs(events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35,
               exact: bool = False, work: int = BLOCK_WORK) -> DataFrame:
    """Scored event-aircraft pairs. `exact=True` drops the 3x3 cell limit and wraps at the date line."""
    left, right = _sides(events, tracks, min_severity)
    join = radius_join if exact else near_join
    pairs = join(left, right, radius_km, window_min, right_id="aircraft_id", work=work)
    return _shown(pairs, _pair_score(F.col("km"), radius_km))


class NearLinks:
    """The links of `near_pairs` (src the aircraft, dst the event, score) for who needs the strongest of them or those between a few nodes: only `all` makes every pair."""

    def __init__(self, events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35, work: int = BLOCK_WORK):
        left, right = _sides(events, tracks, min_severity)
        self.left = cut_lineage(left.select("event_id", "l_lat", "l_lon", "l_t", "severity"))
        self.right = cut_lineage(right.select("aircraft_id", "r_lat", "r_lon", "r_t", "weight"))
        self.radius_km, self.window_min, self.work = float(radius_km), float(window_min), work

    def _links(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("aircraft_id").alias("src"), F.col("event_id").alias("dst"), _pair_score(F.col("km"), self.radius_km).alias("score"))

    def all(self) -> DataFrame:
        return self._links(near_join(self.left, self.right, self.radius_km, self.window_min, right_id="aircraft_id", work=self.work))

    def among(self, ids: DataFrame) -> DataFrame:
        """The links between nodes of ids(id): others are left before anything meets."""
        left = self.left.join(ids.withColumnRenamed("id", "event_id"), "event_id", "left_semi")
        right = self.right.join(ids.withColumnRenamed("id", "aircraft_id"), "aircraft_id", "left_semi")
        return self._links(near_join(left, right, self.radius_km, self.window_min, right_id="aircraft_id", work=self.work))

    def strongest(self, nodes: int) -> tuple[DataFrame, bool]:
        """All links from some score on that have `nodes` nodes or more, and True; or all links there are, and False.

        The score falls with distance, so a pair farther apart than a part of the radius stays below that part of the highest severity and weight; blocks of that part are small, and events and positions
        that cannot reach the score are left out. The part grows until there are enough nodes.
        """
        severity, weight = self.left.agg(F.max("severity")).first()[0] or 0.0, self.right.agg(F.max("weight")).first()[0] or 0.0
        beside = lambda c: F.abs(cell_index(F.col(f"l_{c}")) - cell_index(F.col(f"r_{c}"))) <= 1  # noqa: E731  (the cells of `near_join`)
        for part in (64, 16, 4):
            least = (1.0 - 1.0 / part) * severity * weight + 0.0006  # above what rounding to three places may make of a pair farther away
            left, right = self.left.filter(F.col("severity") * weight >= least - 0.002), self.right.filter(F.col("weight") * severity >= least - 0.002)
            pairs = radius_join(left, right, self.radius_km / part, self.window_min, right_id="aircraft_id", work=self.work).filter(beside("lat") & beside("lon"))
            links = cut_lineage(self._links(pairs).filter(F.col("score") >= least))
            if links.select(F.explode(F.array("src", "dst")).alias("id")).distinct().count() >= nodes:
                return links, True
        return self.all(), False


class BestAlerts:
    """The best pair per aircraft and rounded place, found without a row of payload per pair.

    Events are numbered by id and positions by time, so a pair's rank (score, event, time) is one number and the aggregate holds fixed-width values only: Spark keeps it in a hash map and pairs are
    neither sorted nor written. `ranked` has a row per alert: aircraft_id, score, the numbers _e and _p. `shown` joins what alerts show of the event and the position.
    Busy blocks are cut by place and aircraft, so all pairs of a position and a place are in one field: its task gives one row for them, however many there are and however often the block is cut.
    """

    def __init__(self, events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35,
                 exact: bool = False, work: int = BLOCK_WORK):
        left, right = _sides(events, tracks, min_severity)
        self.left, self.right = in_order(left, "_e", "event_id"), in_order(right, "_p", "r_t", "r_lat", "r_lon", "aircraft_id")
        events_n, most = self.left.agg(F.count(F.lit(1)), F.max("severity")).first()
        craft_n, top = self.right.agg(F.count(F.lit(1)), F.max("weight")).first()
        short = (int((most or 0.0) * (top or 0.0) * 1000) + 2) * max(events_n, 1) * max(craft_n, 1) < LONG_RANKS
        places = self.left.select("l_lat", "l_lon", "l_t", "severity", "_e", round_to(F.col("l_lat"), 1).alias("_lat1"), round_to(F.col("l_lon"), 1).alias("_lon1"))
        craft = self.right.select("aircraft_id", "r_lat", "r_lon", "r_t", "weight", "_p")
        self.places = places
        dealt = {"left_id": F.xxhash64("_lat1", "_lon1"), "right_id": F.xxhash64("aircraft_id")}
        self._pairs = lambda p: (radius_join if exact else near_join)(p, craft, radius_km, window_min, **dealt, work=work)
        milli = F.round(_pair_score(F.col("km"), radius_km) * 1000).cast("bigint")
        first = lambda n, c: F.lit(n - 1) - F.col(c)  # noqa: E731  (the smaller number ranks higher)
        if short:
            rank = (milli * events_n + first(events_n, "_e")) * craft_n + first(craft_n, "_p")
            parts = [F.expr(f"_r div {max(events_n * craft_n, 1)}"), F.expr(f"_r div {max(craft_n, 1)} % {max(events_n, 1)}"), F.expr(f"_r % {max(craft_n, 1)}")]
        else:
            whole, base = "decimal(38,0)", F.lit(10 ** _DIGITS).cast("decimal(15,0)")
            rank = (((milli.cast(whole) * base).cast(whole) + first(events_n, "_e")).cast(whole) * base).cast(whole) + first(craft_n, "_p")
            digits = F.lpad(F.col("_r").cast("string"), 10 + 2 * _DIGITS, "0")
            parts = [F.substring(digits, a, n).cast("bigint") for a, n in ((1, 10), (11, _DIGITS), (11 + _DIGITS, _DIGITS))]
        self._rank = rank if short else rank.cast(whole)
        self._told = [(parts[0] / 1000.0).alias("score"), (F.lit(events_n - 1) - parts[1]).alias("_e"), (F.lit(craft_n - 1) - parts[2]).alias("_p")]
        self.ranked = self._ranked(places)

    def _ranked(self, places: DataFrame) -> DataFrame:
        return self._pairs(places).groupBy("aircraft_id", "_lat1", "_lon1").agg(F.max(self._rank).alias("_r")).select("aircraft_id", *self._told)

    def of_event(self, e: int) -> DataFrame:
        """The rows of `ranked` of the event with number e. Only events of its place can take an alert from it, so no others meet positions."""
        place = self.places.filter(F.col("_e") == e).select("_lat1", "_lon1")
        return self._ranked(self.places.join(F.broadcast(place), ["_lat1", "_lon1"], "left_semi")).filter(F.col("_e") == e)

    def shown(self, ranked: DataFrame) -> DataFrame:
        """What alerts show, for any number of them."""
        return self._shown(ranked.join(shuffled(self.left), "_e").join(shuffled(self.right.drop("aircraft_id")), "_p"))

    def shown_few(self, ranked: DataFrame) -> DataFrame:
        """The same for a list; neither events nor positions are shuffled."""
        return self._shown(self.right.drop("aircraft_id").join(F.broadcast(self.left.join(F.broadcast(ranked), "_e")), "_p"))

    def _shown(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"km": haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")), "minutes": F.abs(F.col("r_t") - F.col("l_t")) / 60.0})
        out = _shown(rows, F.col("score"))
        return out.select("aircraft_id", *[c for c in out.columns if c != "aircraft_id"])

    def named(self, ranked: DataFrame) -> DataFrame:
        """(aircraft_id, event_id, score): the events' table alone is joined."""
        return ranked.join(self.left.select("_e", "event_id"), "_e").select("aircraft_id", "event_id", "score")


def alerts_of_positions(events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35, work: int = BLOCK_WORK) -> DataFrame:
    """(t, aircraft_id, event_id, score): the best pair per position and rounded place, of events not later than the position. Positions are told apart by aircraft and time.

    All pairs of a position and a place meet in one field of one block (the grids go by place and position), so the best rank is taken where the pair is made: no pair is shuffled, and the table of a
    task holds the places of its own block only. Ties go to the smaller event id.
    """
    left, right = _sides(events, tracks, min_severity)
    left, right = in_order(left.select("event_id", "l_lat", "l_lon", "l_t", "severity"), "_e", "event_id"), in_order(right.select("aircraft_id", "r_lat", "r_lon", "r_t", "weight"), "_p", "r_t", "aircraft_id")
    most = 1 << 33  # of events; a rank is below 1001 * 2 ** 33
    lat, lon = round_to(F.col("l_lat"), 1), round_to(F.col("l_lon"), 1)
    places = left.select("l_lat", "l_lon", "l_t", "severity", "_e", (F.floor(lat * 10 + 0.5) * 10000 + F.floor(lon * 10 + 0.5)).cast("bigint").alias("_place"))
    craft = right.select("r_lat", "r_lon", "r_t", "weight", "_p")
    pairs = near_join(places, craft, radius_km, window_min, left_id=F.xxhash64("_place"), right_id=F.xxhash64("_p"), only=F.col("l_t") <= F.col("r_t"), work=work, keep_blocks=True)
    milli = F.round(_pair_score(F.col("km"), radius_km) * 1000).cast("bigint")
    best = pairs.groupBy(*NEAR_BLOCK, "_p", "_place").agg(F.max(milli * most + (most - 1 - F.col("_e"))).alias("_rank"))
    ranked = best.select("_p", (F.expr(f"_rank div {most}") / 1000.0).alias("score"), (F.lit(most - 1) - F.expr(f"_rank % {most}")).alias("_e"))
    return ranked.join(right.select("_p", F.col("r_t").alias("t"), "aircraft_id"), "_p").join(left.select("_e", "event_id"), "_e", "left").select("t", "aircraft_id", "event_id", "score")


def alerts_per_instant(events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35, work: int = BLOCK_WORK) -> DataFrame:
    """(t, n): how many rows `alerts_of_positions` has at each time. Only the place of an event counts here, so events of one place and one exact position and time are one."""
    left, right = _sides(events, tracks, min_severity)
    lat, lon = round_to(F.col("l_lat"), 1), round_to(F.col("l_lon"), 1)
    places = left.select("l_lat", "l_lon", "l_t", (F.floor(lat * 10 + 0.5) * 10000 + F.floor(lon * 10 + 0.5)).cast("bigint").alias("_place")).distinct()
    craft = in_order(right.select("aircraft_id", "r_lat", "r_lon", "r_t"), "_p", "r_t", "aircraft_id").select("r_lat", "r_lon", "r_t", "_p")
    pairs = near_join(places, craft, radius_km, window_min, left_id=F.xxhash64("_place"), right_id=F.xxhash64("_p"), only=F.col("l_t") <= F.col("r_t"), work=work, keep_blocks=True)
    once = pairs.groupBy(*NEAR_BLOCK, "_p", "_place", "r_t").agg(F.lit(1).alias("_one"))
    return once.groupBy(F.col("r_t").alias("t")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_alerts(pairs: DataFrame) -> DataFrame:
    """Best pair per aircraft and rounded place. A partial `max_by` runs before the shuffle; ties go to the smaller id."""
    key = [F.col("aircraft_id"), round_to(F.col("lat"), 1).alias("lat1"), round_to(F.col("lon"), 1).alias("lon1")]
    payload = [c for c in pairs.columns if c != "aircraft_id"]
    rank = F.struct((-F.col("score")).alias("s"), "event_id", "aircraft_t")
    best = pairs.groupBy(*key).agg(F.min_by(F.struct(*payload), rank).alias("_p"))
    return best.select("aircraft_id", *[F.col(f"_p.{c}").alias(c) for c in payload])


def alerts(events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35,
           min_score: float = 0.0, limit: int | None = None, **join_options) -> DataFrame:
    """Deduplicated proximity alerts, best first. A limit is applied to the ranks, so only what is shown meets its event and position."""
    best = BestAlerts(events, tracks, radius_km, window_min, min_severity, **join_options)
    found = best.ranked.filter(F.col("score") >= min_score)
    if limit is None:
        return best.shown(found)
    top = cut_lineage(found.orderBy(F.col("score").desc(), "_e", "aircraft_id").limit(limit))
    return best.shown_few(top).orderBy(F.col("score").desc(), "event_id", "aircraft_id").limit(limit)


def alerts_of_event(found: DataFrame, event_id: str) -> DataFrame:
    return found.filter(F.col("event_id") == event_id).orderBy(F.col("score").desc(), "aircraft_id")


def co_located(tracks: DataFrame, following: int = 5, chunk_chars: int = 3) -> DataFrame:
    """Military aircraft in one cell, each paired with the next few in id order: pairs grow with the fleet, not squared.

    A cell is ordered in chunks of ids sharing a prefix; a chunk continues with the first ids of the chunks after it, which
    come from a small per-chunk summary. No task ever orders a whole cell.
    """
    fleet = with_cell(tracks.filter("military").select("hex", "lat", "lon")).select("row", "col", "hex").distinct()
    fleet = fleet.withColumn("_chunk", F.substring("hex", 1, chunk_chars))
    inside = Window.partitionBy("row", "col", "_chunk").orderBy("hex")
    heads = fleet.withColumn("_rn", F.row_number().over(inside)).filter(F.col("_rn") <= following)
    heads = heads.groupBy("row", "col", "_chunk").agg(F.array_sort(F.collect_list("hex")).alias("_head"))
    chunks = Window.partitionBy("row", "col").orderBy("_chunk")
    empty = F.array().cast("array<string>")
    after = F.concat(*[F.coalesce(F.lead("_head", k).over(chunks), empty) for k in range(1, following + 1)])
    heads = heads.select("row", "col", "_chunk", F.slice(after, 1, following).alias("_after"))
    own = F.array_compact(F.array(*[F.lead("hex", k).over(inside) for k in range(1, following + 1)]))
    rows = fleet.withColumn("_own", own).join(heads, ["row", "col", "_chunk"])
    pairs = rows.withColumn("b", F.explode(F.slice(F.concat("_own", "_after"), 1, following)))
    return pairs.select("row", "col", F.concat(F.lit("adsb:"), "hex").alias("a"), F.concat(F.lit("adsb:"), "b").alias("b"))


def co_located_all(tracks: DataFrame, work: int = BLOCK_WORK) -> DataFrame:
    """Every pair a < b in one cell: the graph-store rule. Output itself is quadratic in the fleet of a cell; a cell is cut into grids, so no task gets more than about `work` pairs at once."""
    fleet = with_cell(tracks.filter("military").select(F.concat(F.lit("adsb:"), "hex").alias("a"), "lat", "lon")).select("row", "col", "a").distinct()
    fleet = cut_lineage(fleet)
    other = fleet.withColumnRenamed("a", "b")
    return balanced_join(fleet, other, ["row", "col"], F.col("a") < F.col("b"), probe_id=F.xxhash64("a"), build_id=F.xxhash64("b"), work=work).select("row", "col", "a", "b")


def near_ends(events: DataFrame, tracks: DataFrame, radius_km: float = 75.0, window_min: float = 180.0, min_severity: float = 0.35) -> DataFrame:
    """Ids of the events and aircraft that are in any near pair. A row that has met one partner is not compared with more, so no pair is made."""
    left, right = _sides(events, tracks, min_severity)
    met = near_met(left.select("event_id", "l_lat", "l_lon", "l_t"), right.select("aircraft_id", "r_lat", "r_lon", "r_t"), radius_km, window_min)
    return met[0].select(F.col("event_id").alias("id")).unionByName(met[1].select(F.col("aircraft_id").alias("id"))).distinct()
