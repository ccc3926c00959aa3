"""Social feeds: listings, searches, statuses and preview pages to one post shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import KEYWORDS
from geoweave.functions.social import (extract_keywords, geolocate, html_to_text, infer_platform, plain_text, strip_tags, unescape_entities,
                                       views_count)
from geoweave.operators.tracks import union_first

POST_COLUMNS = ("id", "platform", "t", "channel", "text", "url", "lat", "lon", "place", "keywords", "views", "has_media")


def _finish(rows: DataFrame, gazetteer=None, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    g = rows.withColumn("_g", geolocate(F.col("text"), gazetteer))
    return g.withColumns({"lat": F.col("_g.lat"), "lon": F.col("_g.lon"), "place": F.col("_g.place"),
                          "keywords": extract_keywords(F.col("text"), keywords)}).select(*POST_COLUMNS)


def _iso_seconds(text: Column) -> Column:
    """Epoch seconds of an ISO time with an offset or 'Z'; a time without either reads as UTC."""
    zoned = F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.unix_micros(F.try_to_timestamp(zoned)) / 1e6


def _whole(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0))


def _cut(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)


def parse_listing(payloads: DataFrame, max_chars: int | None = None, **options) -> DataFrame:
    """(channel, value) listing payloads to posts."""
    item = ("struct<id:string,created_utc:double,title:string,selftext:string,permalink:string,score:bigint,num_comments:bigint,post_hint:string,"
            "preview:string,url_overridden_by_dest:string>")
    doc = F.from_json("value", f"data struct<children:array<struct<data:{item}>>>")
    d = payloads.select("channel", F.explode(doc["data"]["children"]).alias("c")).select("channel", "c.data.*")
    d = d.filter((F.coalesce("id", F.lit("")) != "") & (F.coalesce("created_utc", F.lit(0.0)) != 0.0))
    title, body = plain_text(F.col("title")), plain_text(F.col("selftext"))
    sub = F.concat(F.lit("r/"), "channel")
    link = F.coalesce(F.nullif(F.col("permalink"), F.lit("")), F.concat(F.lit("/"), sub, F.lit("/comments/"), "id", F.lit("/")))
    media = (F.col("preview").isNotNull() | F.coalesce(F.col("post_hint").isin("image", "hosted:video", "rich:video"), F.lit(False))
             | F.coalesce(F.lower("url_overridden_by_dest").rlike(r"\.(jpg|png|gif|mp4)$"), F.lit(False)))
    return _finish(d.select(
        F.concat(F.lit("reddit:"), sub, F.lit("/"), "id").alias("id"), F.lit("reddit").alias("platform"), F.col("created_utc").alias("t"),
        sub.alias("channel"), _cut(F.when(body != "", F.concat(title, F.lit("\n"), body)).otherwise(title), max_chars).alias("text"),
        F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit("https://www.reddit.com"), link)).alias("url"),
        (_whole(F.col("score")) + _whole(F.col("num_comments"))).alias("views"), media.alias("has_media")), **options)


def parse_search(payloads: DataFrame, max_chars: int | None = None, **options) -> DataFrame:
    """`value` search payloads to posts."""
    item = "struct<uri:string,author:struct<handle:string>,record:struct<text:string,createdAt:string>,indexedAt:string,likeCount:bigint,repostCount:bigint,embed:string>"
    p = payloads.select(F.explode(F.from_json("value", f"posts array<{item}>")["posts"]).alias("p")).select("p.*")
    author = F.coalesce(F.nullif(F.col("author.handle"), F.lit("")), F.lit("unknown"))
    key = F.regexp_extract("uri", r"([^/]*)/*$", 1)
    t = _iso_seconds(F.coalesce(F.nullif(F.col("record.createdAt"), F.lit("")), F.col("indexedAt")))
    rows = p.filter(F.coalesce("uri", F.lit("")) != "").select(
        F.concat(F.lit("bsky:"), author, F.lit("/"), key).alias("id"), F.lit("bluesky").alias("platform"), t.alias("t"), author.alias("channel"),
        _cut(F.coalesce("record.text", F.lit("")), max_chars).alias("text"),
        F.concat(F.lit("https://bsky.app/profile/"), author, F.lit("/post/"), key).alias("url"),
        (_whole(F.col("likeCount")) + _whole(F.col("repostCount")) * 2).alias("views"), F.col("embed").isNotNull().alias("has_media"))
    return _finish(rows.filter(F.col("t").isNotNull()), **options)


def parse_statuses(payloads: DataFrame, instance: str = "mastodon.social", max_chars: int | None = None, **options) -> DataFrame:
    """`value` arrays of statuses to posts."""
    item = ("struct<id:string,created_at:string,content:string,spoiler_text:string,account:struct<acct:string>,url:string,favourites_count:bigint,"
            "reblogs_count:bigint,media_attachments:array<string>>")
    s = payloads.select(F.explode(F.from_json("value", f"array<{item}>")).alias("s")).select("s.*")
    text, spoiler = html_to_text(F.col("content"), max_chars), F.trim(F.coalesce("spoiler_text", F.lit("")))
    acct = F.regexp_replace(F.coalesce(F.nullif(F.col("account.acct"), F.lit("")), F.lit("unknown")), "^@+", "")
    whole = F.when(spoiler == "", text).when(text == "", spoiler).otherwise(F.concat(spoiler, F.lit("\n"), text))
    rows = s.filter(F.coalesce("id", F.lit("")) != "").select(
        F.concat(F.lit("mastodon:"), acct, F.lit("/"), "id").alias("id"), F.lit("mastodon").alias("platform"),
        _iso_seconds(F.col("created_at")).alias("t"), acct.alias("channel"), whole.alias("text"),
        F.coalesce(F.nullif(F.col("url"), F.lit("")), F.concat(F.lit(f"https://{instance.lower()}/@"), acct, F.lit("/"), "id")).alias("url"),
        (_whole(F.col("favourites_count")) + _whole(F.col("reblogs_count"))).alias("views"),
        (F.coalesce(F.size("media_attachments"), F.lit(0)) > 0).alias("has_media"))
    return _finish(rows.filter(F.col("t").isNotNull()), **options)


def statuses_in_range(posts: DataFrame, t_from: float, t_to: float | None = None) -> DataFrame:
    """Public timelines are mostly chatter: over a range only geolocated posts are kept."""
    inside = (F.col("t") >= float(t_from)) & (F.lit(True) if t_to is None else F.col("t") < float(t_to))
    return posts.filter(F.col("lat").isNotNull() & inside)


def parse_preview_pages(pages: DataFrame, **options) -> DataFrame:
    """(channel, html) channel preview pages to posts, one per message block."""
    blocks = F.filter(F.split("html", '<div class="tgme_widget_message_wrap'), lambda b, i: i > 0)
    b = pages.select("channel", F.explode(blocks).alias("b"))
    number = F.regexp_extract("b", r'data-post="[^"/]+/(\d+)"', 1)
    shown = F.regexp_extract("b", r'(?s)<div class="tgme_widget_message_text[^"]*"[^>]*>(.*?)</div>', 1)
    text = F.regexp_replace(strip_tags(unescape_entities(F.regexp_replace(shown, r"<br\s*/?>", "\n"))), r"^\s+|\s+$", "")
    t = _iso_seconds(F.regexp_extract("b", r'<time datetime="([^"]+)"', 1))
    rows = b.filter(number != "").select(
        F.concat(F.lit("tg:"), "channel", F.lit("/"), number).alias("id"), F.lit("telegram").alias("platform"), t.alias("t"), "channel",
        text.alias("text"), F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), number).alias("url"),
        views_count(F.nullif(F.regexp_extract("b", r'<span class="tgme_widget_message_views">([^<]+)</span>', 1), F.lit(""))).alias("views"),
        F.col("b").rlike("tgme_widget_message_(photo|video)").alias("has_media"))
    return _finish(rows.filter(F.col("t").isNotNull()), **options)


def lenient_posts(posts: DataFrame) -> DataFrame:
    """Posts written by older versions: the platform is inferred where it is missing."""
    stated = F.nullif(F.col("platform"), F.lit("")) if "platform" in posts.columns else F.lit(None).cast("string")
    return posts.withColumn("platform", F.coalesce(stated, infer_platform(F.col("id"), F.col("url"))))


def placed_posts(posts: DataFrame) -> DataFrame:
    """Posts read from files with `place`: file, split and row in it, so that "first" means first in the file."""
    return posts.withColumn("place", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))


def merge_post_files(parts: list[DataFrame], position: str | None = None) -> DataFrame:
    """Several files in precedence order, first row per id kept, then only geolocated ones. Inside a file the first is the one with the least `position` (see `placed_posts`)."""
    return union_first(parts, position=position).filter(F.col("lat").isNotNull())
