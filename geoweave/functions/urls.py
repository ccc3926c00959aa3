"""Two article-identity rules over URLs. They differ on purpose and must not be merged."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.fixed_values import ARTICLE_ID_PARAMS, LANDING_PATHS, LENIENT_TRACKING, NEWS_KINDS, STRICT_TRACKING

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), _URL, group)


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_pairs(query: Column) -> Column:
    """Decoded (name, value) structs of a query string, blank values kept, empty items skipped."""
    items = F.filter(F.split(query, "&"), lambda item: item != "")

    def pair(item: Column) -> Column:
        at = F.instr(item, "=")
        name = F.substring_index(item, "=", 1)
        value = F.when(at > 0, F.substring(item, at + 1, F.length(item))).otherwise(F.lit(""))
        return F.struct(_decode(name).alias("name"), _decode(value).alias("value"))

    return F.transform(items, pair)


def _join_pairs(pairs: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encode(p["name"]), F.lit("="), _encode(p["value"]))), "&")


def article_url_key(url: Column) -> Column:
    """Strict key: null unless the address identifies one article on the web."""
    scheme = F.lower(_part(url, 1))
    authority = _part(url, 2)
    host = F.lower(F.regexp_replace(authority, r":[^:\]]*$", ""))
    port_text = F.regexp_extract(authority, r":([^:\]]*)$", 1)
    port = port_text.try_cast("int")
    bad_port = (port_text != "") & (port.isNull() | ~port.between(0, 65535))
    usual = ((scheme == "http") & (port == 80)) | ((scheme == "https") & (port == 443)) | (port == 0)
    shown_host = F.when((port_text != "") & ~usual, F.concat(host, F.lit(":"), port.cast("string"))).otherwise(host)
    full_path = _part(url, 3)
    params = F.regexp_extract(full_path, r"(;[^/]*)$", 1)
    path = F.regexp_replace(F.regexp_replace(full_path, r";[^/]*$", ""), r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    kept = F.filter(query_pairs(_part(url, 4)),
                    lambda p: ~F.startswith(F.lower(p["name"]), F.lit("utm_")) & ~F.lower(p["name"]).isin(*STRICT_TRACKING))
    landing = F.lower(path).isin(*LANDING_PATHS) & ~F.exists(kept, lambda p: F.lower(p["name"]).isin(*ARTICLE_ID_PARAMS))
    query = _join_pairs(kept)
    key = F.concat(scheme, F.lit("://"), shown_host, path, params, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    usable = scheme.isin("http", "https") & (host != "") & (F.instr(authority, "@") == 0) & ~bad_port & ~landing
    return F.when(usable, key)


def article_group_key(url: Column) -> Column:
    """Lenient key used to group rows of one article; never null for a non-null address."""
    text = F.trim(url)
    has_scheme = text.rlike(_URL)
    scheme = F.when(has_scheme, F.lower(_part(url, 1))).otherwise(F.lit("https"))
    rest = F.regexp_extract(text, r"^([^?#]*)(?:\?([^#]*))?(?:#.*)?$", 1)
    bare_query = F.regexp_extract(text, r"^([^?#]*)(?:\?([^#]*))?(?:#.*)?$", 2)
    host = F.regexp_replace(F.lower(F.when(has_scheme, _part(url, 2)).otherwise(F.lit(""))), r"^www\.", "")
    path = F.regexp_replace(F.when(has_scheme, _part(url, 3)).otherwise(rest), r"/+$", "")
    path = F.when(~has_scheme & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)).otherwise(path)
    kept = F.filter(query_pairs(F.when(has_scheme, _part(url, 4)).otherwise(bare_query)),
                    lambda p: ~F.startswith(F.lower(p["name"]), F.lit("utm_")) & ~F.lower(p["name"]).isin(*LENIENT_TRACKING))
    query = _join_pairs(kept)
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def source_key(kind: Column, record_id: Column, url: Column) -> Column:
    """One key per reporting source: the article for news kinds, else the record itself."""
    own = F.concat(kind, F.lit(":"), record_id)
    article = F.concat(F.lit("article:"), article_url_key(F.coalesce(url, F.lit(""))))
    return F.when(kind.isin(*NEWS_KINDS), F.coalesce(article, own)).otherwise(own)
