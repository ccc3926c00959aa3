"""Aircraft feeds: snapshots, trace archives and the position log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweave.fixed_values import GULF_BBOX
from geoweave.operators.tracks import carry_forward

_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()
SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("now", T.DoubleType()),
    T.StructField("ac", T.ArrayType(T.StructType([
        T.StructField("hex", _S), T.StructField("lat", _D), T.StructField("lon", _D), T.StructField("flight", _S), T.StructField("r", _S),
        T.StructField("t", _S), T.StructField("alt_baro", _S), T.StructField("gs", _D), T.StructField("track", _D), T.StructField("squawk", _S),
        T.StructField("emergency", _S), T.StructField("category", _S), T.StructField("dbFlags", T.LongType()), T.StructField("type", _S),
        T.StructField("rssi", _D), T.StructField("messages", T.LongType()), T.StructField("nic", _I), T.StructField("nac_p", _I)]))),
])
# a trace row is a JSON array of mixed types, so its items are read as text and cast by position
TRACE_SCHEMA = T.StructType([
    T.StructField("icao", _S), T.StructField("r", _S), T.StructField("t", _S), T.StructField("desc", _S), T.StructField("dbFlags", T.LongType()),
    T.StructField("ownOp", _S), T.StructField("timestamp", _D), T.StructField("trace", T.ArrayType(T.ArrayType(_S)))])
LOG_SCHEMA = T.StructType([T.StructField("h", _S), T.StructField("t", _D), T.StructField("la", _D), T.StructField("lo", _D), T.StructField("a", _I),
                           T.StructField("m", T.BooleanType()), T.StructField("n", _I), T.StructField("p", _I)])


def parse_snapshots(messages: DataFrame, military_feed: Column | bool = False) -> DataFrame:
    """`value` JSON snapshots to one row per aircraft that has a position."""
    feed = military_feed if isinstance(military_feed, Column) else F.lit(military_feed)
    rows = messages.withColumn("_m", F.from_json("value", SNAPSHOT_SCHEMA)).withColumn("_mil", feed)
    rows = rows.select(F.col("_mil"), (F.col("_m.now") / 1000.0).alias("t_feed"), F.explode("_m.ac").alias("a"))
    a = {f: F.col(f"a.{f}") for f in ("hex", "lat", "lon", "flight", "r", "t", "alt_baro", "gs", "track", "squawk", "emergency", "category", "dbFlags",
                                      "type", "rssi", "messages", "nic", "nac_p")}
    ground = F.coalesce(a["alt_baro"] == "ground", F.lit(False))
    return rows.filter(a["lat"].isNotNull() & a["lon"].isNotNull()).select(
        F.concat(F.lit("adsb:"), a["hex"]).alias("id"), a["hex"].alias("hex"), F.col("t_feed").alias("t"), a["lat"].alias("lat"), a["lon"].alias("lon"),
        F.nullif(F.trim(a["flight"]), F.lit("")).alias("callsign"), a["r"].alias("registration"), a["t"].alias("ac_type"),
        F.when(~ground, a["alt_baro"].try_cast("double").cast("int")).alias("alt_ft"), ground.alias("on_ground"), a["gs"].alias("gs_kt"),
        a["track"].alias("track_deg"), a["squawk"].alias("squawk"), F.nullif(a["emergency"], F.lit("none")).alias("emergency"),
        a["category"].alias("category"), (F.col("_mil") | (F.coalesce(a["dbFlags"], F.lit(0)).bitwiseAND(1) == 1)).alias("military"),
        F.coalesce(a["type"], F.lit("unknown")).alias("source"), a["rssi"].alias("rssi"), a["messages"].alias("messages"), a["nic"].alias("nic"),
        a["nac_p"].alias("nac_p"))


def keep_in_box(points: DataFrame, bbox: tuple[float, float, float, float] = GULF_BBOX, margin_deg: float = 0.5) -> DataFrame:
    """Positions inside (south, west, north, east) widened by a margin."""
    south, west, north, east = bbox
    return points.filter(F.col("lat").between(south - margin_deg, north + margin_deg) & F.col("lon").between(west - margin_deg, east + margin_deg))


def parse_traces(messages: DataFrame, bbox=GULF_BBOX, margin_deg: float = 0.5) -> DataFrame:
    """`value` trace documents to points inside the box, with callsign and integrity carried forward over those points.

    A text test for a coordinate pair with matching whole degrees skips most documents before any JSON is parsed.
    """
    south, west, north, east = bbox
    lats = "|".join(str(i) for i in range(int(south - margin_deg), int(north + margin_deg) + 1))
    lons = "|".join(str(i) for i in range(int(west - margin_deg), int(east + margin_deg) + 1))
    maybe = messages.filter(F.col("value").rlike(rf",\s*(?:{lats})(?:\.\d+)?,\s*(?:{lons})(?:\.\d+)?,"))
    doc = maybe.select(F.from_json("value", TRACE_SCHEMA).alias("d"))
    rows = doc.select("d.icao", "d.r", "d.t", "d.desc", "d.dbFlags", "d.ownOp", "d.timestamp", F.posexplode("d.trace").alias("pos", "p"))

    def item(i: int) -> Column:
        return F.get("p", F.lit(i))

    extra = F.from_json(item(8), "flight string, nic int, nac_p int")
    alt = item(3)
    points = rows.select(
        F.col("icao").alias("hex"), (F.floor((F.coalesce("timestamp", F.lit(0.0)) + item(0).cast("double")) * 10 + 0.5) / 10.0).alias("t"), "pos",
        item(1).try_cast("double").alias("lat"), item(2).try_cast("double").alias("lon"),
        F.when(alt != "ground", alt.try_cast("double").cast("int")).alias("alt_ft"), F.coalesce(alt == "ground", F.lit(False)).alias("on_ground"),
        item(4).try_cast("double").alias("gs"), item(5).try_cast("double").alias("trk"), F.nullif(F.trim(extra["flight"]), F.lit("")).alias("flight"),
        item(9).alias("src"), extra["nic"].alias("nic"), extra["nac_p"].alias("nac_p"),
        (F.coalesce("dbFlags", F.lit(0)).bitwiseAND(1) == 1).alias("military"), F.col("r").alias("reg"), F.col("t").alias("ac_type"), "desc",
        F.col("ownOp").alias("ownop"))
    inside = keep_in_box(points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()), bbox, margin_deg)
    return carry_forward(inside, ["flight", "nic", "nac_p"], tie=("pos",))


def read_traces(spark: SparkSession, paths, bbox=GULF_BBOX, margin_deg: float = 0.5) -> DataFrame:
    """One whole trace document per file, compressed or not."""
    return parse_traces(spark.read.text(paths, wholetext=True), bbox, margin_deg)


def parse_log(lines: DataFrame) -> DataFrame:
    """`value` lines of the position log to points; unreadable lines are dropped."""
    r = lines.select(F.from_json("value", LOG_SCHEMA).alias("r")).filter(F.col("r.t").isNotNull() & F.col("r.h").isNotNull())
    return r.select(F.col("r.h").alias("hex"), F.col("r.t").alias("t"), F.col("r.la").alias("lat"), F.col("r.lo").alias("lon"),
                    F.col("r.a").alias("alt_ft"), F.coalesce("r.m", F.lit(False)).alias("military"), F.col("r.n").alias("nic"), F.col("r.p").alias("nac_p"))


def load_log(points: DataFrame, t_from: float, t_to: float) -> tuple[DataFrame, DataFrame]:
    """(points in the span with the aircraft's flag set if any row sets it, one-row covered span)."""
    inside = points.filter(F.col("t").between(float(t_from), float(t_to)))
    flags = inside.groupBy("hex").agg(F.bool_or("military").alias("military"))
    return inside.drop("military").join(flags, "hex"), inside.agg(F.min("t").alias("t_from"), F.max("t").alias("t_to"))
