"""Text normalisation and retrieval features of evidence records.

ASCII text stays in the JVM. Only rows holding other characters visit Python, in Arrow batches, because Spark has no
compatibility normalisation or case folding of its own; the other rows are sent as nulls.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoweave.fixed_values import BROAD_ENTITIES, GENERIC_NAMES, NEWS_KINDS, TOPIC_TERMS

def _fold(value: str) -> str:
    return re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", value).casefold()).strip()


@F.pandas_udf(T.StringType())
def _fold_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda v: None if v is None else _fold(v))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_list(lists: pd.Series) -> pd.Series:
    return lists.map(lambda values: None if values is None else [_fold(v) for v in values])


def _ascii_normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def _beyond_ascii(text: Column) -> Column:
    """Whether any character takes more than a byte; lengths are known without looking at characters by a pattern."""
    return F.octet_length(text) > F.char_length(text)


def normalize_text(text: Column) -> Column:
    """Lower-case words separated by single blanks, equal for texts that differ in width, case or punctuation."""
    folded = _fold_text(F.when(_beyond_ascii(text), text))
    return F.when(_beyond_ascii(text), folded).otherwise(_ascii_normal(text))


def normalize_list(values: Column) -> Column:
    joined = F.array_join(values, "")
    folded = _fold_list(F.when(_beyond_ascii(joined), values))
    return F.when(_beyond_ascii(joined), folded).otherwise(F.transform(values, _ascii_normal))


def _literal_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _text_or_blank(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


RECORD_FIELDS = {
    "actor1": "string", "actor2": "string", "persons": "array<string>", "orgs": "array<string>", "title": "string",
    "headline": "string", "text": "string", "summary": "string", "description": "string", "themes": "array<string>",
    "keywords": "array<string>", "root_label": "string", "url": "string", "mmsi": "bigint", "imo": "string", "name": "string",
    "registration": "string", "callsign": "string", "hex": "string", "vessel_name": "string", "document_text": "string",
    "event_code": "string", "channel": "string", "squawk": "string", "emergency": "string", "military": "boolean",
    "novelty": "double", "frp": "double", "nav_status": "double", "on_ground": "boolean", "alt_ft": "int", "geo_type": "int",
}


def complete_record(records: DataFrame) -> DataFrame:
    """Add the optional evidence fields that a source did not carry, as typed nulls."""
    missing = {n: F.lit(None).cast(t) for n, t in RECORD_FIELDS.items() if n not in records.columns}
    return records.withColumns(missing) if missing else records


def record_features(records: DataFrame) -> DataFrame:
    """Adds `text_norm` (padded), `tokens`, `entities`, `actors`, `topics` and `identities` to evidence records."""
    df = complete_record(records)
    empty = F.array().cast("array<string>")
    named = F.filter(F.concat(F.coalesce("persons", empty), F.coalesce("orgs", empty)), lambda v: v.isNotNull() & (v != ""))
    actors = F.filter(F.array("actor1", "actor2"), lambda v: v.isNotNull() & (v != ""))
    is_news = F.col("kind").isin(*NEWS_KINDS)
    url_path = F.regexp_extract(_text_or_blank("url"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    slug = F.coalesce(F.try_url_decode(F.replace(url_path, F.lit("+"), F.lit("%2B"))), url_path)
    tagged = F.concat_ws(" ", *[F.when(F.col(k).isNotNull(), F.concat(F.lit(k + " "), F.col(k).cast("string")))
                                for k in ("mmsi", "imo", "registration", "callsign", "hex", "vessel_name")])
    body = F.concat_ws(
        " ", F.col("actor1"), F.col("actor2"), F.array_join(F.coalesce("persons", empty), " "),
        F.array_join(F.coalesce("orgs", empty), " "), F.col("title"), F.col("headline"), F.col("text"), F.col("summary"),
        F.col("description"), F.array_join(F.coalesce("themes", empty), " "), F.array_join(F.coalesce("keywords", empty), " "),
        F.col("root_label"), F.when(is_news, F.concat_ws(" ", slug, F.col("document_text"), tagged)))
    compact = F.transform(
        F.regexp_extract_all(F.col("_body"), F.lit(r"(?<![A-Za-z0-9])([A-Za-z0-9]{1,3}-[A-Za-z0-9]{2,6})(?![A-Za-z0-9])"), 1),
        lambda v: F.replace(v, F.lit("-"), F.lit("")))
    df = df.withColumn("_body", body)
    # one projection for all normalised fields: their Python part then runs as one Arrow exchange
    df = df.withColumns({"_text": F.concat_ws(" ", "_body", F.array_join(compact, " ")), "_raw_named": named, "_raw_actors": actors,
                         "_raw_name": F.coalesce("name", F.lit(""))})
    df = df.withColumns({"_named": normalize_list(F.col("_raw_named")), "_actors": normalize_list(F.col("_raw_actors")),
                         "_name": normalize_text(F.col("_raw_name")), "text_norm": normalize_text(F.col("_text"))})
    df = df.withColumn("text_norm", F.concat(F.lit(" "), "text_norm", F.lit(" ")))
    df = df.withColumn("tokens", F.array_distinct(F.filter(F.split("text_norm", " "), lambda v: v != "")))
    entities = F.filter(F.array_distinct("_named"), lambda v: F.length(v) >= 3)
    df = df.withColumn("entities", F.array_except(entities, _literal_array(GENERIC_NAMES + BROAD_ENTITIES)))
    df = df.withColumn("actors", F.array_except(F.array_distinct("_actors"), _literal_array(GENERIC_NAMES)))
    topics = F.filter(F.array(*[F.when(F.arrays_overlap("tokens", _literal_array(terms)), F.lit(name))
                                for name, terms in TOPIC_TERMS.items()]), lambda v: v.isNotNull())
    df = df.withColumn("topics", topics).withColumn("identities", _identities())
    return df.drop("_body", "_named", "_actors", "_name", "_text", "_raw_named", "_raw_actors", "_raw_name")


def _identity(phrase: Column, label: Column, kind: str, maritime: Column) -> Column:
    return F.struct(phrase.alias("phrase"), label.alias("label"), F.lit(kind).alias("kind"), maritime.alias("maritime_context"))


def _identities() -> Column:
    """Identity phrases an asset may be reported under, most specific kinds only."""
    no = F.lit(False)
    mmsi = _text_or_blank("mmsi")
    imo = _text_or_blank("imo")
    name = F.regexp_replace("_name", r"^(?:m v|m t|mv|mt|ss)\s+", "")
    vessel = F.array(
        F.when(mmsi.rlike(r"^[1-9]\d{8}$"), _identity(mmsi, F.concat(F.lit("MMSI "), mmsi), "identifier", no)),
        F.when(imo.rlike(r"^\d{7}$"), _identity(F.concat(F.lit("imo "), imo), F.concat(F.lit("IMO "), imo), "identifier", no)),
        F.when((F.length(name) >= 4) & ~name.isin(*GENERIC_NAMES),
               _identity(name, F.concat(F.lit("vessel name "), F.upper(name)), "name", F.instr(name, " ") == 0)))

    def aircraft(key: str) -> Column:
        value = F.lower(F.regexp_replace(_text_or_blank(key), r"[^A-Za-z0-9]", ""))
        usable = (F.length(value) >= 4) & ~value.isin(*GENERIC_NAMES) & (F.lit(key == "registration") | value.rlike(r"\d"))
        phrase = F.when(F.lit(key == "hex") & value.rlike(r"^\d+$"), F.concat(F.lit("icao "), value)).otherwise(value)
        return F.when(usable, _identity(phrase, F.concat(F.lit(key + " "), F.upper(value)), "identifier", no))

    craft = F.array(*[aircraft(k) for k in ("registration", "callsign", "hex")])
    none = F.filter(vessel, lambda v: F.lit(False))
    return F.filter(F.when(F.col("kind") == "ais", vessel).when(F.col("kind") == "adsb", craft).otherwise(none),
                    lambda v: v.isNotNull())
