"""Writers: position log, history points, snapshots and replay datasets with a manifest."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.operators.tracks import newest_per_slot
from geoweave.session import ensure_checkpoint_dir


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder on the shared storage that also holds checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def by_day(df: DataFrame, column: str = "t") -> DataFrame:
    return df.withColumn("day", F.date_format(F.timestamp_add("DAY", F.floor(F.col(column) / 86400).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd"))


def retained(points: DataFrame, now: float, keep_hours: float = 72.0) -> DataFrame:
    return points.filter(F.col("t") >= float(now) - keep_hours * 3600.0)


def append_positions(points: DataFrame, path: str) -> None:
    """Newest position per aircraft and quarter hour, partitioned by day; old days are dropped as whole partitions."""
    by_day(newest_per_slot(points)).write.mode("append").partitionBy("day").parquet(path)


def sightings(events: DataFrame, social: DataFrame, tracks: DataFrame, alerts: DataFrame, hotspots: DataFrame) -> DataFrame:
    """(kind, id) of what one fuse sees and counts as flows: conflict events, posts, alerts, new thermal detections and aircraft, once each."""
    alert = F.col("id") if "id" in alerts.columns else F.concat_ws("|", "event_id", "aircraft_id")
    parts = {"conflict": events.filter("is_conflict").select("id"), "social": social.select("id"), "alerts": alerts.select(alert.alias("id")),
             "firms_new": hotspots.filter(F.col("novelty") >= 0.9).select("id"), "tracks": tracks.select(F.col("hex").alias("id"))}
    out = None
    for kind, ids in parts.items():
        part = ids.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def renewed_memory(t: float, current: DataFrame, seen: DataFrame | None, keep_hours: float = 24.0) -> DataFrame:
    """(kind, id, last_t) after a fuse at `t`: every sighting renews an id, and ids silent for longer are forgotten."""
    now = current.select("kind", "id", F.lit(float(t)).alias("last_t"))
    both = now if seen is None else now.unionByName(seen.select("kind", "id", "last_t"))
    return both.groupBy("kind", "id").agg(F.max("last_t").alias("last_t")).filter(F.col("last_t") >= float(t) - keep_hours * 3600.0)


def fuse_point(t: float, events: DataFrame, social: DataFrame, tracks: DataFrame, alerts: DataFrame, hotspots: DataFrame, seen: DataFrame | None = None,
               ais: int | None = None) -> DataFrame:
    """One row for the history of a fuse: levels (what is present), flows `d_*` (ids that the memory `seen` does not hold), `primed` (whether it held any) and `ais`.

    `seen(kind, id, last_t)` is what `renewed_memory` returned after the fuse before; without it the point is not primed and its flows say nothing.
    """
    def one(df: DataFrame, **wanted):
        return df.agg(*[c.cast("bigint").alias(n) for n, c in wanted.items()])
    every = F.count(F.lit(1))
    parts = [one(events, events=every, conflict=F.count_if("is_conflict")), one(social, social=every), one(tracks, tracks=every, military=F.count_if("military")),
             one(alerts, alerts=every), one(hotspots, firms_new=F.count_if(F.col("novelty") >= 0.9))]
    current = sightings(events, social, tracks, alerts, hotspots)
    fresh = current if seen is None else current.join(seen.select("kind", "id"), ["kind", "id"], "left_anti")
    parts.append(one(fresh, **{f"d_{k}": F.count_if(F.col("kind") == k) for k in ("conflict", "social", "alerts", "firms_new", "tracks")}))
    row = parts[0].sparkSession.range(1).select(F.lit(float(t)).alias("t"))
    for part in parts:
        row = row.withColumns({n: part.select(n).scalar() for n in part.columns})
    primed = F.lit(False) if seen is None else seen.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.col("n") > 0).scalar()
    return row.withColumns({"primed": primed, "ais": F.lit(ais).cast("bigint")})


def append_history(point: DataFrame, path: str) -> None:
    by_day(point).write.mode("append").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str, now: float, keep_hours: float = 168.0) -> DataFrame:
    """History points of the last week; the day filter prunes partitions before any file is opened."""
    return retained(spark.read.parquet(path), now, keep_hours)


def export_snapshot(tables: dict[str, DataFrame], path: str, t: float) -> DataFrame:
    """Write every table of a picture below one folder and return (table, records)."""
    return build_dataset(tables, path, force=True).select("layer", "records").withColumn("t", F.lit(float(t)))


def _present(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except AnalysisException:
        return False


def build_dataset(layers: dict[str, DataFrame], path: str, force: bool = False, strict: bool = False) -> DataFrame:
    """Write each layer as parquet unless it exists, and return the manifest.

    The checksum, a sum of row hashes, does not depend on row order but notices repeated rows; it is one aggregate over the written files. A failing layer is recorded
    and the others still run; `strict` raises instead.
    """
    spark = next(iter(layers.values())).sparkSession
    out = None
    for name, df in layers.items():
        target = f"{path}/{name}"
        status, error = "written", None
        try:
            if not force and _present(spark, target):
                status = "already present"
            else:
                df.write.mode("overwrite").parquet(target)
            stored = spark.read.parquet(target)
            files = stored.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).distinct()
            hashed = "xxhash64(" + ", ".join(f"`{c}`" for c in stored.columns) + ")"
            row = stored.agg(F.count(F.lit(1)).alias("records"), F.expr(f"cast(pmod(coalesce(sum(cast({hashed} as decimal(38,0))), 0), 9223372036854775807) as bigint)").alias("checksum")).withColumn(
                "bytes", F.coalesce(files.agg(F.sum("s").alias("s")).scalar(), F.lit(0).cast("bigint")))
        except Exception as problem:
            if strict:
                raise
            status, error = "failed", str(problem)[:200]
            row = spark.range(1).select(*[F.lit(None).cast("bigint").alias(n) for n in ("records", "checksum", "bytes")])
        row = row.select(F.lit(name).alias("layer"), F.lit(status).alias("status"), "records", "bytes", "checksum", F.lit(error).cast("string").alias("error"))
        out = row if out is None else out.unionByName(row)
    return out
