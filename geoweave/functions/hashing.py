"""Stable fingerprints of records and pairs. Equal content gives equal keys; nothing else is promised."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.fixed_values import CLAIM_FIELDS
from geoweave.functions.text import RECORD_FIELDS

_UNIT = "\u001f"


def _field(name: str) -> Column:
    kind = RECORD_FIELDS[name]
    if kind.startswith("array"):
        shown = F.when(F.size(name) > 0, F.array_join(name, "\u001e"))
    else:
        shown = F.when(F.col(name).cast("string") != "", F.col(name).cast("string"))
    return F.when(shown.isNotNull(), F.concat(F.lit(name + "="), shown))


def claim_fingerprint() -> Column:
    """What a record claims, without where or when it was observed."""
    parts = [_field(name) for name in sorted(CLAIM_FIELDS)] + [F.concat(F.lit("label="), F.col("label"))]
    return F.substring(F.sha2(F.concat_ws(_UNIT, *parts), 256), 1, 16)


def record_fingerprint() -> Column:
    """The observation as a whole: claims plus time and position."""
    return F.substring(F.sha2(F.concat_ws(_UNIT, "kind", "id", claim_fingerprint(), F.col("t").cast("string"),
                                          F.col("lat").cast("string"), F.col("lon").cast("string")), 256), 1, 24)


def pair_key(left: Column, right: Column) -> Column:
    """Order-free key of two strings."""
    return F.array_join(F.array_sort(F.array(left, right)), "|")


def candidate_id(left_key: Column, right_key: Column) -> Column:
    return F.concat(F.lit("candidate:"), F.substring(F.sha2(pair_key(left_key, right_key), 256), 1, 24))


def cluster_id(members: Column) -> Column:
    return F.concat(F.lit("cluster:"), F.substring(F.sha2(F.array_join(F.array_sort(members), "|"), 256), 1, 20))


_REFRESH = {"ais": ("mmsi", "imo", "name", "nav_status"),
            "adsb": ("hex", "registration", "callsign", "emergency", "military", "on_ground")}
_REFRESH_OTHER = ("text", "persons", "orgs", "themes", "keywords", "novelty", "frp")


def refresh_facts() -> Column:
    """Facts whose change makes a pair worth assessing again; routine movement is not among them."""
    def joined(names):
        return F.concat_ws(_UNIT, *[_field(n) for n in names])
    return (F.when(F.col("kind") == "ais", joined(_REFRESH["ais"])).when(F.col("kind") == "adsb", joined(_REFRESH["adsb"]))
            .otherwise(joined(_REFRESH_OTHER)))


def refresh_signature(left_source: Column, left_facts: Column, right_source: Column, right_facts: Column,
                      match_type: Column, overlap: Column) -> Column:
    sides = F.array_sort(F.array(F.concat_ws(_UNIT, left_source, left_facts), F.concat_ws(_UNIT, right_source, right_facts)))
    return F.sha2(F.concat_ws("\u001d", F.array_join(sides, "\u001d"), match_type, F.array_join(overlap, "\u001e")), 256)
