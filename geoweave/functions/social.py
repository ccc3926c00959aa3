"""Scalar rules for social posts: places, keywords, platforms, engagement, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from geoweave.fixed_values import COORDINATE_PATTERN, GAZETTEER, HOT_KEYWORDS, KEYWORDS, SOCIAL_PLATFORMS
from geoweave.functions.news import url_host

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
             ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
             ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&amp;", "&"))


def unescape_entities(text: Column) -> Column:
    """Character references of the common named and numeric kinds; '&amp;' goes last so nothing is decoded twice."""
    for name, char in _ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def geolocate(text: Column, gazetteer: dict[str, tuple[float, float]] | None = None) -> Column:
    """struct(lat, lon, place): explicit coordinates when in range, else the longest gazetteer name in the text.

    The gazetteer is configuration (tens of names), so it is a literal array scanned per row: no join.
    """
    names = GAZETTEER if gazetteer is None else gazetteer
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(len(n)).alias("len"), F.lit(i).alias("pos"),
                               F.lit(float(ll[0])).alias("lat"), F.lit(float(ll[1])).alias("lon"))
                      for i, (n, ll) in enumerate(names.items())])
    lowered = F.lower(F.coalesce(text, F.lit("")))
    shape = "struct<lat:double,lon:double,place:string>"
    lat = F.regexp_extract(text, COORDINATE_PATTERN, 1).try_cast("double")
    lon = F.regexp_extract(text, COORDINATE_PATTERN, 2).try_cast("double")
    by_number = F.struct(lat.alias("lat"), lon.alias("lon"), F.format_string("%.3f,%.3f", lat, lon).alias("place")).cast(shape)
    hits = F.filter(table, lambda g: F.contains(lowered, g["name"]))
    longest = F.array_max(F.transform(hits, lambda g: F.struct(g["len"], (-g["pos"]).alias("rank"), g["lat"].alias("lat"),
                                                              g["lon"].alias("lon"), g["name"].alias("name"))))
    by_name = F.struct(longest["lat"].alias("lat"), longest["lon"].alias("lon"), F.initcap(longest["name"]).alias("place")).cast(shape)
    nowhere = F.lit(None).cast(shape)
    in_range = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
    return F.when(F.coalesce(in_range, F.lit(False)), by_number).when(F.size(hits) > 0, by_name).otherwise(nowhere)


def extract_keywords(text: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    lowered = F.lower(F.coalesce(text, F.lit("")))
    words = F.array(*[F.lit(k) for k in keywords])
    return F.filter(words, lambda k: F.contains(lowered, k))


def infer_platform(post_id: Column, url: Column) -> Column:
    pid, link = F.coalesce(post_id, F.lit("")), F.coalesce(url, F.lit(""))

    def starts(*prefixes: str) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.startswith(pid, F.lit(p))
        return hit

    return (F.when(starts("tg:") | F.contains(link, F.lit("t.me/")), "telegram")
            .when(starts("reddit:") | F.contains(link, F.lit("reddit.com")), "reddit")
            .when(starts("bsky:") | F.contains(link, F.lit("bsky.app")), "bluesky")
            .when(starts("mastodon:", "md:") | F.contains(link, F.lit("mastodon")), "mastodon")
            .otherwise("unknown"))


def platform_of(platform: Column, post_id: Column, url: Column) -> Column:
    """The stated platform when known, else inferred; null when the record is not social."""
    guess = infer_platform(post_id, url)
    return F.when(platform.isin(*SOCIAL_PLATFORMS), platform).when(guess.isin(*SOCIAL_PLATFORMS), guess)


def is_social_event(root_code: Column, event_code: Column, domain: Column, url: Column) -> Column:
    coded = F.coalesce(root_code == "SOCIAL", F.lit(False)) | F.coalesce(event_code == "SOCIAL", F.lit(False))
    by_domain = F.lower(F.coalesce(domain, F.lit(""))).rlike(r"t\.me|reddit\.com|bsky\.app|mastodon")
    by_url = F.lower(F.coalesce(url, F.lit(""))).rlike(r"t\.me/|reddit\.com/|bsky\.app/|mastodon")
    return coded | by_domain | by_url


def views_count(shown: Column) -> Column:
    """'1.2K' -> 1200, '3M' -> 3000000, '1,234' -> 1234; null when unreadable."""
    text = F.replace(F.upper(F.trim(shown)), F.lit(","), F.lit(""))
    factor = F.when(F.endswith(text, F.lit("K")), 1000.0).when(F.endswith(text, F.lit("M")), 1000000.0).otherwise(1.0)
    number = F.regexp_replace(text, "[KM]+$", "").try_cast("double")
    return (number * factor).cast("bigint")


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, r"<[^>]+>", "")


def html_to_text(markup: Column, limit: int | None = None) -> Column:
    """Paragraph and line breaks become newlines, other tags go, references are decoded."""
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?i)</p\s*>", "\n")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(unescape_entities(strip_tags(text)), r"^\s+|\s+$", "")
    return F.substring(text, 1, limit) if limit else text


def plain_text(markup: Column) -> Column:
    """References first, then tags: the rule for listing titles and self texts."""
    return F.regexp_replace(strip_tags(unescape_entities(F.coalesce(markup, F.lit("")))), r"^\s+|\s+$", "")


def post_source_domain(platform: Column, channel: Column, url: Column) -> Column:
    ch = F.coalesce(channel, F.lit(""))
    sub = F.when(F.startswith(ch, F.lit("r/")), ch).when(ch != "", F.concat(F.lit("r/"), ch)).otherwise(F.lit("r/unknown"))
    host = url_host(url)
    return (F.when(platform == "telegram", F.when(ch != "", F.concat(F.lit("t.me/"), ch)).otherwise(F.lit("t.me")))
            .when(platform == "reddit", F.concat(F.lit("reddit.com/"), sub))
            .when(platform == "bluesky", F.lit("bsky.app"))
            .when(platform == "mastodon", F.when(host != "", host).otherwise(F.lit("mastodon.social")))
            .otherwise(F.concat(platform, F.lit(".social"))))


def post_to_event(posts, hot_keywords: tuple[str, ...] = HOT_KEYWORDS):
    """Geolocated posts as events, with severity proxies from hot keywords and engagement."""
    hot = F.size(F.array_intersect(F.coalesce(F.col("keywords"), F.array().cast("array<string>")),
                                   F.array(*[F.lit(k) for k in hot_keywords])))
    no_names = F.array().cast("array<string>")
    platform = F.lower(F.coalesce(F.col("platform"), infer_platform(F.col("id"), F.col("url"))))
    n = F.col("_hot").cast("double")
    return (posts.withColumns({"platform": platform, "_hot": hot})
            .select(
                "id", "t", "lat", "lon", F.coalesce("place", F.lit("")).alias("place"), F.lit("").alias("country"),
                F.lit(4).alias("geo_type"), F.lit(None).cast("string").alias("actor1"), F.lit(None).cast("string").alias("actor2"),
                F.lit("SOCIAL").alias("event_code"), F.lit("SOCIAL").alias("root_code"), F.lit("Social post").alias("root_label"),
                F.when(F.col("_hot") > 0, 4).otherwise(1).alias("quad_class"),
                F.when(F.col("_hot") > 0, -F.least(F.lit(10.0), n * 3.0)).otherwise(F.lit(0.0)).alias("goldstein"),
                F.when(F.col("_hot") > 0, n * -2.0).otherwise(F.lit(0.0)).alias("tone"),
                F.greatest(F.lit(1), F.floor(F.coalesce("views", F.lit(0)) / 1000)).cast("int").alias("num_mentions"),
                F.lit(1).alias("num_sources"), "url",
                post_source_domain(F.col("platform"), F.col("channel"), F.col("url")).alias("source_domain"),
                (F.col("_hot") > 0).alias("is_conflict"),
                F.transform(F.coalesce("keywords", no_names), lambda k: F.upper(k)).alias("themes"),
                no_names.alias("persons"), no_names.alias("orgs"), "platform", "channel", "text", "keywords"))
