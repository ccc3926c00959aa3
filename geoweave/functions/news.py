"""Scalar rules for news events: domains, coded labels, actors, places, severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.fixed_values import ACTOR_ALIASES, ACTOR_STOP, CONFLICT_ROOTS, DATELINE_PLACES, EXPECTED_COOCCURRENCE, ROOT_LABELS
from geoweave.functions.geo import round_to


def lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def url_host(url: Column) -> Column:
    """Lower-case host part of an http(s) address, '' when there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/]+)", 1))


def url_domain(url: Column) -> Column:
    return F.replace(url_host(url), F.lit("www."), F.lit(""))


def stamp_seconds(stamp: Column) -> Column:
    """Epoch seconds of a yyyyMMddHHmmss stamp read as UTC, whatever the session time zone is."""
    when = F.to_timestamp_ntz(stamp, F.lit("yyyyMMddHHmmss"))
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), when).cast("double")


def root_label(code: Column) -> Column:
    return F.coalesce(lookup(ROOT_LABELS, code), code)


def is_conflict_root(code: Column) -> Column:
    return F.coalesce(code.isin(*CONFLICT_ROOTS), F.lit(False))


def offset_list(cell: Column) -> Column:
    """'Name,offset;Name,offset' to the distinct names in order."""
    names = F.transform(F.split(F.coalesce(cell, F.lit("")), ";"), lambda item: F.trim(F.element_at(F.split(item, ","), 1)))
    return F.array_distinct(F.filter(names, lambda name: name != ""))


def _squeezed(name: Column) -> Column:
    letters = F.regexp_replace(F.upper(F.trim(name)), r"[^A-Z0-9 ]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def resolve_actor(name: Column) -> Column:
    squeezed = _squeezed(name)
    known = F.coalesce(lookup(ACTOR_ALIASES, squeezed), squeezed)
    return F.when((known != "") & ~known.isin(*ACTOR_STOP), known)


def resolve_actors(names: Column) -> Column:
    """`resolve_actor` of an array, without those that resolve to nothing. Each step is an array of its own, so no name is read by patterns twice."""
    known = F.transform(F.transform(F.array_compact(names), _squeezed), lambda s: F.coalesce(lookup(ACTOR_ALIASES, s), s))
    return F.filter(known, lambda k: (k != "") & ~k.isin(*ACTOR_STOP))


def location_id(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("loc:"), round_to(lat, 1).cast("string"), F.lit(","), round_to(lon, 1).cast("string"))


def event_severity(is_conflict: Column, goldstein: Column, tone: Column, mentions: Column) -> Column:
    score = (F.lit(0.15) + F.when(is_conflict, F.lit(0.35)).otherwise(F.lit(0.0))
             + F.greatest(F.lit(0.0), -goldstein) / F.lit(10.0) * F.lit(0.3)
             + F.greatest(F.lit(0.0), -tone) / F.lit(15.0) * F.lit(0.1)
             + F.least(mentions, F.lit(50)).cast("double") / F.lit(50.0) * F.lit(0.1))
    return F.least(score, F.lit(1.0))


def is_dateline(place: Column, places: tuple[str, ...] = DATELINE_PLACES) -> Column:
    """Place names that outlets use as datelines rather than as the site of the event."""
    text = F.lower(F.trim(place))
    hit = F.lit(False)
    for prefix in places:
        hit = hit | F.startswith(text, F.lit(prefix.lower()))
    return F.coalesce(hit, F.lit(False))


def is_expected_cooccurrence(row: Column, col: Column, cells=EXPECTED_COOCCURRENCE) -> Column:
    hit = F.lit(False)
    for r, c in cells:
        hit = hit | ((row == F.lit(r)) & (col == F.lit(c)))
    return hit
