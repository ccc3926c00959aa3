"""Curated evidence: vessels, sources, claims and leads, with every rule as a reason to reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweave.fixed_values import TIME_PRECISIONS

_S = T.StringType()
SEED_SCHEMA = T.StructType([
    T.StructField("schema_version", _S), T.StructField("prepared_date", _S), T.StructField("notes", T.ArrayType(_S)),
    T.StructField("vessels", T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("id", "name", "imo", "vessel_type", "flag", "mmsi", "callsign")]))),
    T.StructField("sources", T.ArrayType(T.StructType([T.StructField(n, _S) for n in (
        "id", "publisher", "url", "source_type", "publication_date", "publication_time_utc", "as_of_date", "retrieved_date")]))),
    T.StructField("claims", T.ArrayType(T.StructType([
        *[T.StructField(n, _S) for n in ("id", "vessel_id", "event_date", "event_time_utc", "time_precision", "claim", "evidence_class", "attacker", "location_text")],
        T.StructField("source_ids", T.ArrayType(_S)), T.StructField("coordinates", T.ArrayType(T.DoubleType()))])))])
LEADS_SCHEMA = T.StructType([
    T.StructField("retrieved_date", _S), T.StructField("scope", _S), T.StructField("notes", T.ArrayType(_S)),
    T.StructField("items", T.ArrayType(T.StructType([T.StructField(n, _S) for n in (
        "platform", "url", "publisher", "publication_time_utc", "original_language", "summary_en", "summary_kind", "status")])))])


def _why(*rules: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(text)) for bad, text in rules]))


def _missing(columns: DataFrame, names: tuple[str, ...]) -> list[tuple[Column, str]]:
    return [(F.col(n).isNull(), f"missing {n}") for n in names]


def _bad_time(name: str) -> Column:
    return F.col(name).isNotNull() & F.try_to_timestamp(F.col(name)).isNull()


def checked_vessels(vessels: DataFrame) -> DataFrame:
    rules = [*_missing(vessels, ("id", "name")), (~F.startswith("id", F.lit("imo:")), "id not imo-anchored")]
    rules += [(F.col(n).isNotNull(), f"bare {n}") for n in ("mmsi", "callsign") if n in vessels.columns]
    return vessels.withColumn("reasons", _why(*rules))


def checked_sources(sources: DataFrame) -> DataFrame:
    return sources.withColumn("reasons", _why(*_missing(sources, ("id", "publisher", "url")), (_bad_time("publication_time_utc"), "bad publication time")))


def checked_claims(claims: DataFrame, vessels: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims with the reasons to reject them; foreign keys are joins, so the tables may be of any size."""
    known_vessel = vessels.select(F.col("id").alias("vessel_id"), F.lit(True).alias("_vessel")).distinct()
    known_source = sources.select(F.col("id").alias("_sid"), F.lit(True).alias("_known")).distinct()
    cited = claims.select("id", F.explode("source_ids").alias("_sid")).join(known_source, "_sid", "left")
    resolved = cited.groupBy("id").agg(F.every(F.coalesce("_known", F.lit(False))).alias("_sources"))
    c = claims.join(known_vessel, "vessel_id", "left").join(resolved, "id", "left")
    dated = F.col("time_precision").isin("date_only", "ambiguous_overnight")
    coordinates = F.col("coordinates").isNotNull() & ~((F.size("coordinates") == 2) & F.get("coordinates", F.lit(0)).between(-90, 90) & F.get("coordinates", F.lit(1)).between(-180, 180))
    rules = [*_missing(claims, ("id", "vessel_id", "time_precision")), (~F.col("time_precision").isin(*TIME_PRECISIONS), "unknown time_precision"),
             (F.col("_vessel").isNull(), "unknown vessel_id"), (~F.coalesce("_sources", F.lit(False)), "source_ids do not resolve"), (_bad_time("event_time_utc"), "bad event time"),
             (dated & F.col("event_time_utc").isNotNull(), "time on a dated claim"),
             ((F.col("time_precision") == "minute_as_reported") & F.col("event_time_utc").isNull(), "no time on a timed claim"), (coordinates, "bad coordinates")]
    return c.withColumn("reasons", _why(*rules)).drop("_vessel", "_sources")


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def read_seed(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """vessels, sources, claims (checked, in id order) and rejects of a seed document."""
    doc = spark.read.schema(SEED_SCHEMA).json(path, multiLine=True)
    table = {n: doc.select(F.explode(n).alias("r")).select("r.*") for n in ("vessels", "sources", "claims")}
    vessels, sources = checked_vessels(table["vessels"]), checked_sources(table["sources"])
    claims = checked_claims(table["claims"], accepted(vessels), accepted(sources))
    bad = [rejects(c).select(F.lit(n).alias("table"), "id", "reasons") for n, c in (("vessels", vessels), ("sources", sources), ("claims", claims))]
    return {"vessels": accepted(vessels).orderBy("id"), "sources": accepted(sources).orderBy("id"), "claims": accepted(claims).orderBy("id"),
            "rejects": bad[0].unionByName(bad[1]).unionByName(bad[2])}


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    items = spark.read.schema(LEADS_SCHEMA).json(path, multiLine=True).select(F.explode("items").alias("r")).select("r.*")
    return items.filter(~_bad_time("publication_time_utc")).orderBy(F.coalesce("publication_time_utc", F.lit("")), "url")


def curated_ids(vessels: DataFrame, sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Every id a curated record carries."""
    ids = vessels.select("id").union(sources.select("id")).union(claims.select("id")).union(vessels.filter(F.coalesce("imo", F.lit("")) != "").select("imo"))
    return ids.select(F.col("id").cast("string").alias("id")).distinct()


def leaked(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerts that refer to a curated record; must be empty."""
    return alerts.join(ids.select(F.col("id").alias("event_id")), "event_id", "left_semi")
