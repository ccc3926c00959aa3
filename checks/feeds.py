"""Readers, writers and page extraction: raw shapes are rebuilt from the tables, parsed, and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.text import cell, rnd
from checks.views import T0
from geoweave.functions.geo import round_to
from geoweave.operators import tracks
from geoweave.sinks import tables as sinks
from geoweave.sources import aircraft, curated, news, pages, social, thermal, vessels


def _stamp(t):
    return news.stamp_text(F.floor(t))


def export_lines(v):
    """Export lines of the news table: 61 fields, the used ones filled; every 50th line is cut short, every 41st has no position."""
    n = F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint")
    used = {0: n.cast("string"), 6: F.coalesce("actor1", F.lit("")), 16: F.coalesce("actor2", F.lit("")), 26: F.concat("root_code", F.lit("0")), 28: F.col("root_code"),
            29: F.lit(""), 30: F.col("goldstein").cast("string"), 31: F.col("num_mentions").cast("string"), 34: F.col("tone").cast("string"), 51: F.col("geo_type").cast("string"),
            52: F.col("place"), 56: F.when(n % 41 == 0, F.lit("")).otherwise(F.col("lat").cast("string")), 57: F.col("lon").cast("string"), 59: _stamp(F.col("t")), 60: F.col("url")}
    fields = F.array(*[used.get(i, F.lit("")) for i in range(61)])
    return v.news.select(F.array_join(F.when(n % 50 == 0, F.slice(fields, 1, 40)).otherwise(fields), "\t").alias("value"))


@query("s01_news_export", "v_news", f"""select id, floor(t) as t, lat, lon, place, geo_type, actor1, root_code, goldstein, num_mentions, 0 as quad_class, source_domain, is_conflict from v_news
    where split_part(id, ':', 2)::bigint % 50 <> 0 and split_part(id, ':', 2)::bigint % 41 <> 0""")
def _(v):
    return news.parse_export(export_lines(v)).select("id", "t", "lat", "lon", "place", "geo_type", "actor1", "root_code", "goldstein", "num_mentions", "quad_class",
                                                     F.regexp_replace("source_domain", "^www", "").alias("source_domain"), "is_conflict")


@query("s02_entity_file", "v_news", """select id, persons[1] || '|' || persons[2] as persons, orgs[1] || '|' || orgs[2] as orgs, array_to_string(themes, '|') as themes from v_news
    where split_part(id, ':', 2)::bigint % 50 <> 0""")
def _(v):
    n = F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint")

    def coded(name):
        return F.array_join(F.transform(name, lambda x: F.concat(x, F.lit(",17"))), ";")
    used = {4: F.col("id"), 8: coded("themes"), 12: coded("persons"), 14: coded("orgs")}
    fields = F.array(*[used.get(i, F.lit("")) for i in range(27)])
    lines = v.news.select(F.array_join(F.when(n % 50 == 0, F.slice(fields, 1, 12)).otherwise(fields), "\t").alias("value"))
    return news.parse_entities(lines, news.ENTITY_LIMITS).select(F.col("url").alias("id"), *[F.array_join(c, "|").alias(c) for c in ("persons", "orgs", "themes")])


@query("s04_window_stamps", "v_news", """with days as (select distinct floor(t / 86400) * 86400e0 as day_start from v_news)
    select day_start, strftime(to_timestamp(day_start + s.range * 900) at time zone 'UTC', '%Y%m%d%H%M%S') as stamp from days, range(96) s""")
def _(v):
    days = v.news.select((F.floor(F.col("t") / 86400) * 86400.0).alias("day_start")).distinct()
    return news.day_stamps(days).select("day_start", "stamp")


@query("s04_recent_stamps", "v_news", """with i as (select distinct floor(t / 3600) * 3600 as h from v_news) select cast(h as double) as t, count(*) as n,
    min(strftime(to_timestamp(h - s.range * 900) at time zone 'UTC', '%Y%m%d%H%M%S')) as oldest, max(strftime(to_timestamp(h - s.range * 900) at time zone 'UTC', '%Y%m%d%H%M%S')) as newest from i, range(1, 9) s group by h""")
def _(v):
    hours = v.news.select((F.floor(F.col("t") / 3600) * 3600.0).alias("t")).distinct()
    return news.window_stamps(hours, 2.0).groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.min("stamp").alias("oldest"), F.max("stamp").alias("newest"))


@query("s06_aircraft_snapshot", "v_points", """select hex, t, nullif(trim(coalesce(flight, '  ')), '') as callsign, alt_ft, alt_ft is null as on_ground, military, squawk, nic, nac_p from v_points""")
def _(v):
    one = F.struct("hex", "lat", "lon", F.coalesce("flight", F.lit("  ")).alias("flight"), F.coalesce(F.col("alt_ft").cast("string"), F.lit("ground")).alias("alt_baro"), "squawk",
                   F.lit("none").alias("emergency"), F.when(F.col("military"), 3).otherwise(2).alias("dbFlags"), "nic", "nac_p")
    lost = F.struct(*[F.lit(None).cast("double").alias(c) if c in ("lat", "lon") else F.col(c) for c in ("hex", "lat", "lon")])
    messages = v.points.select(F.to_json(F.struct((F.col("t") * 1000).alias("now"), F.array(one).alias("ac"))).alias("value")).unionByName(
        v.points.select(F.to_json(F.struct(F.lit(0.0).alias("now"), F.array(lost).alias("ac"))).alias("value")))
    return aircraft.parse_snapshots(messages).select("hex", round_to(F.col("t"), 6).alias("t"), "callsign", "alt_ft", "on_ground", "military", "squawk", "nic", "nac_p")


@query("s07_trace_archive", "v_points", f"""select hex, {rnd('t', 1)} as t, lat, lon, alt_ft, military from v_points where lat between 24.5 and 27 and lon between 54.5 and 57""")
def _(v):
    point = F.concat(F.lit("["), F.lit("12.5,"), F.col("lat").cast("string"), F.lit(","), F.col("lon").cast("string"), F.lit(","), F.coalesce(F.col("alt_ft").cast("string"), F.lit('"ground"')),
                     F.lit(',300.5,90.0,0,null,{"flight":"AB '), F.col("hex"), F.lit('","nic":8},"adsb_icao"]'))
    doc = F.concat(F.lit('{"icao":"'), "hex", F.lit('","dbFlags":'), F.when(F.col("military"), "1").otherwise("0"), F.lit(',"timestamp":'),
                   F.format_string("%.6f", F.col("t") - 12.5), F.lit(',"trace":['), point, F.lit("]}"))
    return aircraft.parse_traces(v.points.select(doc.alias("value")), (25.0, 55.0, 26.5, 56.5), 0.5).select("hex", "t", "lat", "lon", "alt_ft", "military")


@query("s09_thermal_csv", "v_firms", """select floor(t / 60) * 60e0 as t, lat, lon, frp, 'n' as confidence from v_firms""")
def _(v):
    stamp = _stamp(F.col("t"))
    rows = v.firms.select(
        F.col("lat").cast("string").alias("latitude"), F.col("lon").cast("string").alias("longitude"), F.lit("").alias("bright_ti4"),
        F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)).alias("acq_date"),
        F.substring(stamp, 9, 4).cast("int").cast("string").alias("acq_time"), F.lit("N").alias("satellite"), F.lit(None).cast("string").alias("confidence"),
        F.col("frp").cast("string").alias("frp"), F.lit("D").alias("daynight"))
    return thermal.parse_hotspots(rows).select("t", "lat", "lon", "frp", "confidence")


@query("s10_vessel_messages", "v_vessels", f"""select mmsi, {rnd('t', 3)} as t, lat, lon, name, case when sog <= 102.2 then sog end as sog from v_vessels where mmsi % 10 <> 3""")
def _(v):
    kind = F.when(F.col("mmsi") % 2 == 0, "PositionReport").otherwise("StandardClassBPositionReport")
    stamp = F.date_format(F.timestamp_add("MICROSECOND", F.floor(F.col("t") * 1e6).cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    meta = F.concat(F.lit('{"MMSI":'), F.col("mmsi").cast("string"), F.lit(',"ShipName":" '), "name", F.lit(' ","latitude":'), F.col("lat").cast("string"), F.lit(',"time_utc":"'), stamp, F.lit('000 +0000 UTC"}'))
    body = F.concat(F.lit('{"Valid":'), F.when(F.col("mmsi") % 10 == 3, "false").otherwise("true"), F.lit(',"Longitude":'), F.col("lon").cast("string"), F.lit(',"Sog":'), F.col("sog").cast("string"), F.lit(',"Cog":360}'))
    message = F.concat(F.lit('{"MessageType":"'), kind, F.lit('","MetaData":'), meta, F.lit(',"Message":{"'), kind, F.lit('":'), body, F.lit("}}"))
    out = vessels.parse_messages(v.vessels.select(message.alias("value")))
    return out.select("mmsi", round_to(F.col("t"), 3).alias("t"), "lat", "lon", "name", "sog")


def _platform(v, name):
    return v.posts.filter(F.col("platform") == name)


_GAZ = {"thing": (26.57, 56.25), "ering": (25.12, 56.34), "nicht": (25.20, 55.27)}
_POST_SQL = "(select id, name, pos, la from v_posts, (values ('thing', 2, 26.57e0), ('ering', 1, 25.12e0), ('nicht', 0, 25.2e0)) z(name, pos, la) where contains(lower({text}), name))"


@query("s11_listing_posts", "v_posts", """select concat('reddit:r/', channel, '/', doc_id) as id, t, views + 7 as views, length(concat('T', chr(10), regexp_replace(text, '^\\s+|\\s+$', '', 'g'))) as n
    from v_posts where platform = 'reddit'""")
def _(v):
    data = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("t").alias("created_utc"), F.lit("<b>T</b> ").alias("title"), F.col("text").alias("selftext"), F.col("views").alias("score"), F.lit(7).alias("num_comments"))
    value = F.to_json(F.struct(F.struct(F.array(F.struct(data.alias("data"))).alias("children")).alias("data")))
    return social.parse_listing(_platform(v, "reddit").select("channel", value.alias("value")), gazetteer=_GAZ).select("id", "t", "views", F.length("text").cast("bigint").alias("n"))


@query("s12_search_posts", "v_posts", """select concat('bsky:', channel, '/k', doc_id) as id, t, views + 4 as views, length(text) as n from v_posts where platform = 'bluesky'""")
def _(v):
    p = _platform(v, "bluesky")
    iso = F.concat(F.date_format(F.timestamp_add("SECOND", F.col("t").cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    post = F.struct(F.concat(F.lit("at://did/app.bsky.feed.post/k"), F.col("doc_id").cast("string"), F.lit("/")).alias("uri"), F.struct(F.col("channel").alias("handle")).alias("author"),
                    F.struct("text", iso.alias("createdAt")).alias("record"), F.col("views").alias("likeCount"), F.lit(2).alias("repostCount"))
    return social.parse_search(p.select(F.to_json(F.struct(F.array(post).alias("posts"))).alias("value")), gazetteer=_GAZ).select("id", "t", "views", F.length("text").cast("bigint").alias("n"))


@query("s13_statuses", "v_posts", """select concat('mastodon:', channel, '/', doc_id) as id, t, views + 3 as views, concat('https://mastodon.social/@', channel, '/', doc_id) as url from v_posts where platform = 'mastodon'""")
def _(v):
    p = _platform(v, "mastodon")
    iso = F.concat(F.date_format(F.timestamp_add("SECOND", F.col("t").cast("bigint"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    status = F.struct(F.col("doc_id").cast("string").alias("id"), iso.alias("created_at"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("content"), F.lit("warn").alias("spoiler_text"),
                      F.struct(F.concat(F.lit("@"), "channel").alias("acct")).alias("account"), F.col("views").alias("favourites_count"), F.lit(3).alias("reblogs_count"))
    return social.parse_statuses(p.select(F.to_json(F.array(status)).alias("value")), gazetteer=_GAZ).select("id", "t", "views", "url")


@query("s14_preview_pages", "v_posts", """select concat('tg:', channel, '/', doc_id) as id, t, cast(trunc(views / 1e1 * 1000) as bigint) as views, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as text from v_posts where platform = 'telegram'""")
def _(v):
    p = _platform(v, "telegram")
    iso = F.concat(F.date_format(F.timestamp_add("SECOND", F.col("t").cast("bigint") + 7200, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    block = F.concat(F.lit('<div class="tgme_widget_message_wrap js"><div data-post="'), "channel", F.lit("/"), F.col("doc_id").cast("string"), F.lit('"><div class="tgme_widget_message_text js" dir="auto">'),
                     F.replace("text", F.lit("\n"), F.lit("<br/>")), F.lit('</div><span class="tgme_widget_message_views">'), (F.col("views") / 10.0).cast("string"), F.lit('K</span><time datetime="'), iso, F.lit('"></time></div></div>'))
    return social.parse_preview_pages(p.select("channel", F.concat(F.lit("<html>"), block, F.lit("</html>")).alias("html")), gazetteer=_GAZ).select("id", "t", "views", "text")


@query("s15_lenient_posts", "v_posts", "select id, platform from v_posts")
def _(v):
    return social.lenient_posts(v.posts.withColumn("platform", F.when(F.col("doc_id") % 2 == 0, F.lit("")))).select("id", "platform")


_CLAIMS = """claims as (select o_orderkey as id, case when o_orderkey % 17 = 0 then 'imo:0' else concat('imo:', o_custkey) end as vessel_id, o_custkey % 30 as sid, case o_orderkey % 4 when 0 then 'date_only' when 1 then 'ambiguous_overnight' when 2 then 'minute_as_reported' else 'guess' end as p,
    case when o_orderkey % 6 = 0 then null else 'x' end as tm, case when o_orderkey % 5 = 0 then 95 when o_orderkey % 5 = 1 then 25 end as la from orders)"""


@query("s17_curated_rules", "", f"""with {_CLAIMS}, vs as (select concat('imo:', c_custkey) as id from customer where c_custkey % 3 <> 0), ss as (select n_nationkey as id from nation)
    select id, concat_ws(';', case when p = 'guess' then 'unknown time_precision' end, case when vessel_id not in (select id from vs) then 'unknown vessel_id' end,
        case when sid not in (select id from ss) then 'source_ids do not resolve' end, case when p in ('date_only', 'ambiguous_overnight') and tm is not null then 'time on a dated claim' end,
        case when p = 'minute_as_reported' and tm is null then 'no time on a timed claim' end, case when la = 95 then 'bad coordinates' end) as reasons from claims""")
def _(v):
    claims, vs, ss = _claims(v)
    return curated.checked_claims(claims, vs, ss).select(F.col("id").cast("bigint").alias("id"), F.array_join("reasons", ";").alias("reasons"))


def _claims(v):
    n = F.col("o_orderkey")
    prec = F.when(n % 4 == 0, "date_only").when(n % 4 == 1, "ambiguous_overnight").when(n % 4 == 2, "minute_as_reported").otherwise("guess")
    claims = v.raw("orders").select(
        n.cast("string").alias("id"), F.when(n % 17 == 0, "imo:0").otherwise(F.concat(F.lit("imo:"), F.col("o_custkey").cast("string"))).alias("vessel_id"),
        F.array((F.col("o_custkey") % 30).cast("string")).alias("source_ids"), prec.alias("time_precision"),
        F.when(n % 6 != 0, F.lit("2024-01-05T10:00:00Z")).alias("event_time_utc"), F.when(n % 5 == 0, F.array(F.lit(95.0), F.lit(50.0))).when(n % 5 == 1, F.array(F.lit(25.0), F.lit(50.0))).alias("coordinates"))
    vs = v.raw("customer").filter("c_custkey % 3 <> 0").select(F.concat(F.lit("imo:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_custkey").cast("string").alias("imo"))
    return claims, vs, v.raw("nation").select(F.col("n_nationkey").cast("string").alias("id"))


@query("s18_curated_ids", "", """select distinct id from (select concat('imo:', c_custkey) as id from customer where c_custkey % 3 <> 0 union all select cast(c_custkey as varchar) from customer where c_custkey % 3 <> 0
    union all select cast(n_nationkey as varchar) from nation union all select cast(o_orderkey as varchar) from orders)""")
def _(v):
    claims, vs, ss = _claims(v)
    return curated.curated_ids(vs, ss, claims)


@query("q10_curated_bundle", "", f"""with {_CLAIMS}, vs as (select concat('imo:', c_custkey) as id from customer where c_custkey % 3 <> 0), ss as (select n_nationkey as id from nation)
    select cast(id as varchar) as id, vessel_id from claims where p <> 'guess' and vessel_id in (select id from vs) and sid in (select id from ss) and not (p in ('date_only', 'ambiguous_overnight') and tm is not null)
        and not (p = 'minute_as_reported' and tm is null) and coalesce(la, 0) <> 95""")
def _(v):
    claims, vs, ss = _claims(v)
    return curated.accepted(curated.checked_claims(claims, vs, ss)).select("id", "vessel_id")


@query("s19_position_log", "v_points", f"""with l as (select * from v_points where {rnd('t', 1)} between {T0} + 86400 and {T0} + 864000), f as (select hex, bool_or(military) as military from l group by hex)
    select l.hex, {rnd('l.t', 1)} as t, f.military, alt_ft, nic, nac_p from l join f using (hex)""")
def _(v):
    row = F.to_json(F.struct(F.col("hex").alias("h"), round_to(F.col("t"), 1).alias("t"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.col("alt_ft").alias("a"), F.col("military").alias("m"), F.col("nic").alias("n"), F.col("nac_p").alias("p")))
    lines = v.points.select(row.alias("value")).unionByName(v.points.select(F.lit('{"h": broken').alias("value")))
    points, _span = aircraft.load_log(aircraft.parse_log(lines), T0 + 86400, T0 + 864000)
    return points.select("hex", "t", "military", "alt_ft", "nic", "nac_p")


def history_of(v):
    """Fuse history rebuilt from the purchase events: levels, flows and whether the process was primed."""
    return v.vessels.select("t", (F.col("mmsi") % 50).alias("tracks"), (F.col("mmsi") % 7).alias("military"), F.when(F.col("mmsi") % 5 != 0, F.col("mmsi") % 11).alias("ais"),
                            (F.col("mmsi") % 3).alias("d_alerts"), (F.col("mmsi") % 4).alias("d_conflict"), (F.col("mmsi") % 2 == 0).alias("primed"))


@query("s20_history", "v_vessels", f"select t, mmsi % 50 as tracks from v_vessels where t >= {T0} + 2592000 - 604800")
def _(v):
    folder = sinks.scratch_folder(v.spark, "history")
    sinks.append_history(history_of(v), folder)
    return sinks.read_history(v.spark, folder, T0 + 2592000.0).select("t", "tracks")


@query("k01_position_log", "v_points", f"""select hex, cast(floor(t / 900) as bigint) as slot, max(t) as t from v_points where t >= {T0} + 2592000 - 259200 group by 1, 2""")
def _(v):
    folder = sinks.scratch_folder(v.spark, "positions")
    sinks.append_positions(v.points, folder)
    return sinks.retained(v.spark.read.parquet(folder), T0 + 2592000.0).select("hex", "slot", "t")


_HALF = "t < 1705363200"


@query("k02_fuse_point", "v_news v_points v_firms v_posts", f"""with now as (select 'conflict' as kind, id, {_HALF} as old from v_news where is_conflict union all select 'alerts', id, {_HALF} from v_news where is_conflict
        union all select 'social', id, {_HALF} from v_posts union all select 'firms_new', id, {_HALF} from v_firms where novelty >= 0.9 union all select 'tracks', hex, {_HALF} from v_points),
    fresh as (select kind, id from now group by 1, 2 having not bool_or(old))
    select (select count(*) from v_news) as events, (select count(*) from v_news where is_conflict) as conflict, (select count(*) from v_posts) as social,
    (select count(*) from v_points) as tracks, (select count(*) from v_points where military) as military, (select count(*) from v_news where is_conflict) as alerts, (select count(*) from v_firms where novelty >= 0.9) as firms_new,
    (select count(*) from fresh where kind = 'conflict') as d_conflict, (select count(*) from fresh where kind = 'social') as d_social, (select count(*) from fresh where kind = 'alerts') as d_alerts,
    (select count(*) from fresh where kind = 'firms_new') as d_firms_new, (select count(*) from fresh where kind = 'tracks') as d_tracks, exists (select 1 from now where old) as primed, cast(7 as bigint) as ais""")
def _(v):
    def views(keep):
        news = v.news.filter(keep)
        return news, v.posts.filter(keep), v.points.filter(keep), news.filter("is_conflict"), v.firms.filter(keep)
    memory = sinks.renewed_memory(T0, sinks.sightings(*views(_HALF)), None)
    return sinks.fuse_point(T0 + 900.0, *views("true"), seen=memory, ais=7).drop("t")


@query("k03_snapshot_export", "v_news v_points", "select 'events' as layer, count(*) as records from v_news union all select 'tracks', count(*) from v_points")
def _(v):
    return sinks.export_snapshot({"events": v.news, "tracks": v.points}, sinks.scratch_folder(v.spark, "snapshot"), T0).select("layer", "records")


@query("k04_dataset_manifest", "v_news v_firms", "select 'news' as layer, count(*) as records, 'written' as status from v_news union all select 'thermal', count(*), 'written' from v_firms")
def _(v):
    return sinks.build_dataset({"news": v.news, "thermal": v.firms}, sinks.scratch_folder(v.spark, "dataset")).select("layer", "records", "status")


@query("f30_page_previews", "", """select page_id, url, nullif(trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')), '') as title from pages""")
def _(v):
    return pages.page_previews(v.raw("pages")).select("page_id", "url", "title")


@query("f31_article_texts")
def _(v):
    return pages.article_texts(v.raw("pages")).select("page_id", "title", "text", "n_blocks", "truncated")
