"""Scalar functions and filters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.text import DEGRADED, SEVERITY, WEIGHT, cell, km, rnd, values
from geoweave import fixed_values as fv
from geoweave.functions import aircraft, geo, hashing, news, social, text, urls
from geoweave.operators import filters, joins

WORDS = ("thing", "ering", "nicht", "ention")
HOT = ("thing", "nicht")
PLACES = {"thing": (26.57, 56.25), "ering": (25.12, 56.34), "nicht": (25.20, 55.27)}


@query("f01_haversine", "obs", f"select event_id, {rnd(km('lat', 'lon', '26e0', '56e0'), 6)} as km from obs")
def _(v):
    return v.obs.select("event_id", geo.round_to(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(26.0), F.lit(56.0)), 6).alias("km"))


@query("f02_cell_of", "obs", f"select event_id, {cell('lat')} as row, {cell('lon')} as col, "
       "cast(floor((lat - 30) / 0.5e0) as bigint) as half_row from obs")
def _(v):
    return geo.with_cell(v.obs).select("event_id", "row", "col", geo.cell_index(F.col("lat") - 30, 0.5).alias("half_row"))


@query("f03_neighbour_cells", "obs", f"""select {cell('lat')} + dr as row, {cell('lon')} + dc as col, count(*) as n
    from obs, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc) group by 1, 2""")
def _(v):
    around = geo.explode_ring(geo.with_cell(v.obs).select("row", "col"))
    return around.groupBy(F.col("nrow").alias("row"), F.col("ncol").alias("col")).agg(F.count(F.lit(1)).alias("n"))


@query("f04_url_domain", "v_news", """
    with addresses as (select id, url from v_news union all select cast(page_id as varchar), url from pages)
    select id, replace(lower(regexp_extract(url, '^https?://([^/]+)', 1)), 'www.', '') as domain from addresses""")
def _(v):
    pages = v.raw("pages").select(F.col("page_id").cast("string").alias("id"), "url")
    return v.news.select("id", "url").unionByName(pages).select("id", news.url_domain(F.col("url")).alias("domain"))


@query("f05_stamp_time", "obs", """select event_id, cast(epoch(strptime(strftime(ts, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')) as double) as t from events""")
def _(v):
    stamp = F.date_format(F.col("ts"), "yyyyMMddHHmmss")
    return v.raw("events").select("event_id", news.stamp_seconds(stamp).alias("t"))


_ROOTS = ", ".join(f"('{k}', '{v}')" for k, v in fv.ROOT_LABELS.items())


@query("f06_root_label", "v_news", f"""select id, coalesce(label, root_code) as root_label, root_code in {values(fv.CONFLICT_ROOTS)} as conflict
    from v_news left join (values {_ROOTS}) r(code, label) on code = root_code""")
def _(v):
    return v.news.select("id", news.root_label(F.col("root_code")).alias("root_label"), news.is_conflict_root(F.col("root_code")).alias("conflict"))


_ALIASES = ", ".join(f"('{k}', '{v}')" for k, v in fv.ACTOR_ALIASES.items())
_RESOLVE = """trim(regexp_replace(regexp_replace(upper(trim({x})), '[^A-Z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"""


@query("f07_resolve_actor", "v_news", f"""
    with named as (select id, 1 as slot, actor1 as raw from v_news union all select id, 2, actor2 from v_news
                   union all select cast(n_nationkey as varchar), 3, n_name from nation),
    flat as (select id, slot, {_RESOLVE.format(x='raw')} as name from named)
    select id, slot, case when coalesce(target, name) in {values(fv.ACTOR_STOP)} or name = '' then null else coalesce(target, name) end as actor
    from flat left join (values {_ALIASES}) a(alias, target) on alias = name""")
def _(v):
    pieces = [v.news.select("id", F.lit(1).alias("slot"), F.col("actor1").alias("raw")),
              v.news.select("id", F.lit(2).alias("slot"), F.col("actor2").alias("raw")),
              v.raw("nation").select(F.col("n_nationkey").cast("string").alias("id"), F.lit(3).alias("slot"), F.col("n_name").alias("raw"))]
    named = pieces[0].unionByName(pieces[1]).unionByName(pieces[2])
    return named.select("id", "slot", news.resolve_actor(F.col("raw")).alias("actor"))


@query("f08_location_id", "obs", f"select event_id, concat('loc:', {rnd('lat', 1)}, ',', {rnd('lon', 1)}) as loc from obs")
def _(v):
    return v.obs.select("event_id", news.location_id(F.col("lat"), F.col("lon")).alias("loc"))


@query("f09_event_severity", "v_news", f"select id, {rnd(SEVERITY, 6)} as severity from v_news")
def _(v):
    sev = news.event_severity(F.col("is_conflict"), F.col("goldstein"), F.col("tone"), F.col("num_mentions"))
    return v.news.select("id", geo.round_to(sev, 6).alias("severity"))


@query("f10_aircraft_weight", "v_points", f"select hex, t, {rnd(WEIGHT, 6)} as weight from v_points")
def _(v):
    w = aircraft.aircraft_weight(F.col("military"), F.col("alt_ft"), F.col("emergency"), F.col("squawk"))
    return v.points.select("hex", "t", geo.round_to(w, 6).alias("weight"))


@query("f11_is_degraded", "v_points", f"select hex, t, {DEGRADED} as degraded from v_points")
def _(v):
    return v.points.select("hex", "t", aircraft.is_degraded(F.col("nic"), F.col("nac_p")).alias("degraded"))


_GAZ = ", ".join(f"('{n}', {i}, {ll[0]}e0, {ll[1]}e0)" for i, (n, ll) in enumerate(PLACES.items()))


@query("f12_geolocate", "v_posts", f"""
    with shown as (select id, case when doc_id % 3 = 0 then concat('at ', lat + 1e-3, ', ', lon + 1e-3, ' ', text) else text end as body from v_posts),
    found as (select id, body, nullif(regexp_extract(body, '(-?\\d{{1,2}}\\.\\d{{3,}})[,\\s]+(-?\\d{{1,3}}\\.\\d{{3,}})', 1), '') as a,
        nullif(regexp_extract(body, '(-?\\d{{1,2}}\\.\\d{{3,}})[,\\s]+(-?\\d{{1,3}}\\.\\d{{3,}})', 2), '') as b from shown),
    named as (select id, arg_max(struct_pack(name := name, lat := la, lon := lo), length(name) * 100 - pos) as g
        from found, (values {_GAZ}) z(name, pos, la, lo) where contains(lower(body), name) group by id)
    select f.id, {rnd("case when a <> '' and abs(cast(a as double)) <= 90 and abs(cast(b as double)) <= 180 then cast(a as double) else g.lat end", 4)} as lat,
        {rnd("case when a <> '' and abs(cast(a as double)) <= 90 and abs(cast(b as double)) <= 180 then cast(b as double) else g.lon end", 4)} as lon,
        case when a <> '' and abs(cast(a as double)) <= 90 and abs(cast(b as double)) <= 180
             then concat(printf('%.3f', cast(a as double)), ',', printf('%.3f', cast(b as double)))
             else concat(upper(substr(g.name, 1, 1)), substr(g.name, 2)) end as place
    from found f left join named n on f.id = n.id""".replace("else concat(upper(substr(g.name, 1, 1)), substr(g.name, 2)) end",
                                                              "when g is not null then concat(upper(substr(g.name, 1, 1)), substr(g.name, 2)) end"))
def _(v):
    with_number = F.concat(F.lit("at "), (F.col("lat") + 1e-3).cast("string"), F.lit(", "), (F.col("lon") + 1e-3).cast("string"), F.lit(" "), F.col("text"))
    body = F.when(F.col("doc_id") % 3 == 0, with_number).otherwise(F.col("text"))
    g = v.posts.select("id", social.geolocate(body, PLACES).alias("g"))
    return g.select("id", geo.round_to(F.col("g.lat"), 4).alias("lat"), geo.round_to(F.col("g.lon"), 4).alias("lon"), F.col("g.place").alias("place"))


_KW = ", ".join(f"('{w}', {i})" for i, w in enumerate(WORDS))


@query("f13_keywords", "v_posts", f"""select id, string_agg(w, ',' order by pos) as keywords
    from v_posts, (values {_KW}) k(w, pos) where contains(lower(text), w) group by id""")
def _(v):
    out = v.posts.select("id", F.array_join(social.extract_keywords(F.col("text"), WORDS), ",").alias("keywords"))
    return out.filter(F.col("keywords") != "")


@query("f14_platform_of", "v_posts v_news", """
    with both_kinds as (select id, url from v_posts union all select id, url from v_news union all select concat('x:', id), url from v_posts)
    select id, case when starts_with(id, 'tg:') or contains(url, 't.me/') then 'telegram'
        when starts_with(id, 'reddit:') or contains(url, 'reddit.com') then 'reddit'
        when starts_with(id, 'bsky:') or contains(url, 'bsky.app') then 'bluesky'
        when starts_with(id, 'mastodon:') or starts_with(id, 'md:') or contains(url, 'mastodon') then 'mastodon' end as platform from both_kinds""")
def _(v):
    rows = v.posts.select("id", "url").unionByName(v.news.select("id", "url")).unionByName(v.posts.select(F.concat(F.lit("x:"), "id").alias("id"), "url"))
    return rows.select("id", social.platform_of(F.lit(None).cast("string"), F.col("id"), F.col("url")).alias("platform"))


@query("f15_is_social", "v_posts v_news", """
    with both_kinds as (select id, url, root_code, source_domain from v_news
                        union all select id, url, case when doc_id % 2 = 0 then 'SOCIAL' else '01' end, channel from v_posts)
    select id, root_code = 'SOCIAL' or regexp_matches(lower(source_domain), 't\\.me|reddit\\.com|bsky\\.app|mastodon')
        or regexp_matches(lower(url), 't\\.me/|reddit\\.com/|bsky\\.app/|mastodon') as social from both_kinds""")
def _(v):
    code = F.when(F.col("doc_id") % 2 == 0, "SOCIAL").otherwise("01")
    rows = v.news.select("id", "url", "root_code", "source_domain").unionByName(
        v.posts.select("id", "url", code.alias("root_code"), F.col("channel").alias("source_domain")))
    return rows.select("id", social.is_social_event(F.col("root_code"), F.lit(None).cast("string"), F.col("source_domain"), F.col("url")).alias("social"))


@query("f16_post_to_event", "v_posts", f"""
    with tagged as (select *, (select count(*) from (values {", ".join(f"('{w}')" for w in HOT)}) h(w) where contains(lower(text), w)) as hot,
        (select string_agg(upper(w), ',' order by pos) from (values {_KW}) k(w, pos) where contains(lower(text), w)) as tags from v_posts)
    select id, case when hot > 0 then -least(10e0, 3e0 * hot) else 0e0 end as goldstein, case when hot > 0 then -2e0 * hot else 0e0 end as tone,
        cast(greatest(1, views // 1000) as int) as num_mentions, case when hot > 0 then 4 else 1 end as quad_class, hot > 0 as is_conflict,
        case platform when 'telegram' then concat('t.me/', channel) when 'reddit' then concat('reddit.com/r/', channel)
             when 'bluesky' then 'bsky.app' else 'mastodon.example.org' end as source_domain, coalesce(tags, '') as themes from tagged""")
def _(v):
    posts = v.posts.withColumns({"keywords": social.extract_keywords(F.col("text"), WORDS), "place": F.lit(None).cast("string")})
    return social.post_to_event(posts, HOT).select("id", "goldstein", "tone", "num_mentions", "quad_class", "is_conflict", "source_domain",
                                                   F.array_join("themes", ",").alias("themes"))


@query("f17_views", "v_posts", """select id, case when doc_id % 3 = 0 then cast(trunc((views / 1e1) * 1000) as bigint)
    when doc_id % 3 = 1 then views * 1000000 else views * 1001 end as n from v_posts""")
def _(v):
    shown = (F.when(F.col("doc_id") % 3 == 0, F.concat((F.col("views") / 10.0).cast("string"), F.lit("k")))
             .when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), F.col("views").cast("string"), F.lit("M ")))
             .otherwise(F.format_number(F.col("views") * 1001, 0)))
    return v.posts.select("id", social.views_count(shown).alias("n"))


# the pages carry '?page=..&ref=..', the news '?utm_source=..&id=..': sorted, tracking removed, nothing to decode
_BASE = "regexp_extract(url, '^([a-z]+://[^/?#]*[^?#]*)', 1)"
_URLS = """with addresses as (select id, url from v_news union all select concat('p', page_id), url from pages
    union all select concat('l', page_id), concat('HTTPS://News.example.org:443/World/?utm_medium=a&p=', page_id, '&a=2#top') from pages
    union all select concat('h', page_id), 'http://example.org/news/' from pages
    union all select concat('q', page_id), concat('http://www.example.org:8080/a b/', page_id, ';v=1?x=%41%20b&x=a+b&y') from pages)"""


@query("f18_article_url_key", "v_news", f"""{_URLS}
    select id, case when id[1] = 'h' then null
        when id[1] = 'l' then concat('https://news.example.org/World?a=2&p=', substr(id, 2))
        when id[1] = 'q' then concat('http://www.example.org:8080/a b/', substr(id, 2), ';v=1?x=A+b&x=a+b&y=')
        else concat(regexp_replace({_BASE}, '/+$', ''),
            coalesce((select '?' || string_agg(p, '&' order by p) from unnest(string_split(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '&')) u(p)
                      where not starts_with(p, 'utm_')), '')) end as url_key from addresses""")
def _(v):
    return _addresses(v).select("id", urls.article_url_key(F.col("url")).alias("url_key"))


def _addresses(v):
    pages = v.raw("pages")
    key = F.col("page_id").cast("string")
    made = {"p": F.col("url"), "l": F.concat(F.lit("HTTPS://News.example.org:443/World/?utm_medium=a&p="), key, F.lit("&a=2#top")),
            "h": F.lit("http://example.org/news/"),
            "q": F.concat(F.lit("http://www.example.org:8080/a b/"), key, F.lit(";v=1?x=%41%20b&x=a+b&y"))}
    out = v.news.select("id", "url")
    for mark, url in made.items():
        out = out.unionByName(pages.select(F.concat(F.lit(mark), key).alias("id"), url.alias("url")))
    return out


@query("f19_article_group_key", "v_news", f"""{_URLS}
    select id, case when id[1] = 'h' then 'http://example.org/news'
        when id[1] = 'l' then concat('https://news.example.org:443/World?a=2&p=', substr(id, 2))
        when id[1] = 'q' then concat('http://example.org:8080/a b/', substr(id, 2), ';v=1?x=A+b&x=a+b&y=')
        else concat(regexp_replace(regexp_replace({_BASE}, '/+$', ''), '://www\\.', '://'),
            coalesce((select '?' || string_agg(p, '&' order by p) from unnest(string_split(nullif(regexp_extract(url, '\\?([^#]*)', 1), ''), '&')) u(p)
                      where not starts_with(p, 'utm_') and not starts_with(p, 'ref=')), '')) end as group_key from addresses""")
def _(v):
    return _addresses(v).select("id", urls.article_group_key(F.col("url")).alias("group_key"))


@query("f20_source_key", "v_news v_vessels", """
    select id, concat('article:', regexp_replace(url, '\\?.*$', ''), '?id=', regexp_extract(url, 'id=(\\d+)', 1)) as source from v_news
    union all select id, concat('ais:', id) from v_vessels""")
def _(v):
    rows = v.news.select(F.lit("gdelt").alias("kind"), "id", "url").unionByName(
        v.vessels.select(F.lit("ais").alias("kind"), "id", F.lit(None).cast("string").alias("url")))
    return rows.select("id", urls.source_key(F.col("kind"), F.col("id"), F.col("url")).alias("source"))


_NORM = "trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("f21_normalize", "v_posts", f"select id, {_NORM.format(x='text')} as norm from v_posts")
def _(v):
    return v.posts.select("id", text.normalize_text(F.col("text")).alias("norm"))


@query("f22_features", "v_news", """
    select id, concat('jane smith ', split_part(id, ':', 2)::bigint % 45, '|omar haddad ', split_part(id, ':', 2)::bigint % 89,
            '|gulf lines ', split_part(id, ':', 2)::bigint % 83) as entities,
        array_to_string(list_filter([case actor1 when 'U.S.' then 'u s' when 'Government' then null else lower(actor1) end, lower(actor2)], lambda x: x is not null), '|') as actors,
        case when split_part(id, ':', 2)::bigint % 8 = 0 then 'maritime' when split_part(id, ':', 2)::bigint % 8 = 1 then 'aviation|thermal' else '' end as topics
    from v_news""")
def _(v):
    f = text.record_features(v.news.withColumn("kind", F.lit("gdelt")))
    return f.select("id", F.array_join("entities", "|").alias("entities"), F.array_join("actors", "|").alias("actors"), F.array_join("topics", "|").alias("topics"))


@query("f23_identities", "v_vessels v_points", """
    select distinct id, phrase, label, kind, maritime from (
    select id, cast(mmsi as varchar) as phrase, concat('MMSI ', mmsi) as label, 'identifier' as kind, false as maritime from v_vessels
    union all select id, lower(name), concat('vessel name ', upper(name)), 'name', false from v_vessels
    union all select concat('adsb:', hex), lower(flight), concat('callsign ', flight), 'identifier', false from v_points where length(flight) >= 4
    union all select concat('adsb:', hex), hex, concat('hex ', upper(hex)), 'identifier', false from v_points where length(hex) >= 4)""")
def _(v):
    craft = v.points.select(F.concat(F.lit("adsb:"), "hex").alias("id"), F.lit("adsb").alias("kind"), "hex", F.col("flight").alias("callsign"))
    ships = v.vessels.select("id", F.lit("ais").alias("kind"), "mmsi", "name")
    both = ships.unionByName(craft, allowMissingColumns=True)
    rows = text.record_features(both).select("id", F.explode("identities").alias("i"))
    return rows.select("id", "i.phrase", "i.label", "i.kind", F.col("i.maritime_context").alias("maritime")).distinct()


@query("f24_fingerprint", "v_vessels", """select id, t,
    substr(sha256(concat(concat_ws(chr(31), 'mmsi=' || mmsi, 'name=' || name, 'label=' || name))), 1, 16) as claims from v_vessels""")
def _(v):
    rows = text.complete_record(v.vessels.withColumns({"kind": F.lit("ais"), "label": F.col("name")}))
    return rows.select("id", "t", hashing.claim_fingerprint().alias("claims"))


@query("f25_mission_gates", "v_news", f"""
    with named as (select id, lat, lon, case split_part(id, ':', 2)::bigint % 5 when 0 then 'Dubai, UAE' when 1 then ' kuwait city' when 2 then 'Old Dubai' else place end as place from v_news)
    select id, starts_with(lower(trim(place)), 'dubai') or starts_with(lower(trim(place)), 'kuwait') as dateline,
        ({cell('lat')} = 25 and {cell('lon')} = 55) or ({cell('lat')} = 24 and {cell('lon')} = 54) as expected from named""")
def _(v):
    n = F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint") % 5
    place = F.when(n == 0, "Dubai, UAE").when(n == 1, " kuwait city").when(n == 2, "Old Dubai").otherwise(F.col("place"))
    return geo.with_cell(v.news).select("id", news.is_dateline(place).alias("dateline"), news.is_expected_cooccurrence(F.col("row"), F.col("col")).alias("expected"))


@query("f26_number", "v_vessels", "select id, t, case when sog between 0 and 60 then sog end as sog from v_vessels")
def _(v):
    return v.vessels.select("id", "t", geo.finite_in_range(F.col("sog"), 0, 60).alias("sog"))


@query("f27_circle_boxes", "v_regions", f"""
    with around as (select id, lat, lon, radius_nm from v_regions union all select id + 100, lat, 179.9e0 - (id % 3) / 1e1, radius_nm from v_regions
        union all select id + 200, lat, -179.9e0, radius_nm from v_regions union all select id + 300, 89.9e0, lon, radius_nm from v_regions),
    sized as (select *, radius_nm * 1.852e0 / 6371.0088e0 as a from around),
    bounds as (select *, greatest(-90e0, lat - degrees(a)) as s, least(90e0, lat + degrees(a)) as n,
        degrees(asin(least(1e0, sin(a) / cos(radians(lat))))) as dx from sized),
    boxes as (select id, s, -180e0 as w, n, 180e0 as e from bounds where s = -90 or n = 90
        union all select id, s, lon - dx + 360, n, 180e0 from bounds where s > -90 and n < 90 and lon - dx < -180
        union all select id, s, -180e0, n, lon + dx from bounds where s > -90 and n < 90 and lon - dx < -180
        union all select id, s, lon - dx, n, 180e0 from bounds where s > -90 and n < 90 and lon - dx >= -180 and lon + dx > 180
        union all select id, s, -180e0, n, lon + dx - 360 from bounds where s > -90 and n < 90 and lon - dx >= -180 and lon + dx > 180
        union all select id, s, lon - dx, n, lon + dx from bounds where s > -90 and n < 90 and lon - dx >= -180 and lon + dx <= 180)
    select id, {rnd('s', 5)} as south, {rnd('w', 5)} as west, {rnd('n', 5)} as north, {rnd('e', 5)} as east from boxes""")
def _(v):
    r = v.regions.select("id", "lat", "lon", "radius_nm")
    around = (r.unionByName(r.withColumns({"lon": F.lit(179.9) - (F.col("id") % 3) / 10.0, "id": F.col("id") + 100}))
              .unionByName(r.withColumns({"id": F.col("id") + 200, "lon": F.lit(-179.9)}))
              .unionByName(r.withColumns({"id": F.col("id") + 300, "lat": F.lit(89.9)})))
    b = around.select("id", F.explode(geo.circle_boxes(F.col("lat"), F.col("lon"), F.col("radius_nm"))).alias("b"))
    return b.select("id", *[geo.round_to(F.col(f"b.{c}"), 5).alias(c) for c in ("south", "west", "north", "east")])


@query("f28_alert_reason", "v_news v_points", """
    with paired as (select p.hex, p.t, p.military, p.alt_ft, n.is_conflict, n.goldstein, n.root_code from v_points p join v_news n on floor(p.t / 3600) = floor(n.t / 3600))
    select hex, t, count(*) as n, max(coalesce(nullif(concat_ws('; ', case when military then 'military aircraft' end,
        case when alt_ft < 10000 then concat('low altitude ', alt_ft, ' ft') end,
        case when is_conflict then concat('conflict-coded event (', root_code, ')') end,
        case when goldstein <= -5 then concat('Goldstein ', printf('%+.1f', goldstein)) end), ''), 'spatial-temporal proximity')) as reason
    from paired group by hex, t""")
def _(v):
    hour = F.floor(F.col("t") / 3600)
    right = v.news.select(hour.alias("hour"), "is_conflict", "goldstein", "root_code")
    told = aircraft.fleet_reasons(v.points.select("hex", "t", "military", "alt_ft", hour.alias("hour")), right, ["hour"])
    return told.groupBy("hex", "t").agg(F.sum("n").alias("n"), F.max("reason").alias("reason"))


@query("f29_html_to_text", "", """select page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(html, '(?i)</p\\s*>', chr(10), 'g'), '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), chr(10) || chr(13) || chr(9) || ' ') as body from pages""")
def _(v):
    return v.raw("pages").select("page_id", social.html_to_text(F.col("html"), limit=None).alias("body"))


# ---- filters -------------------------------------------------------------------------------------

@query("p01_in_view", "obs", "select event_id from obs where lat between 24.5 and 27 and (lon >= 56.5 or lon <= 54.5)")
def _(v):
    return filters.in_view(v.obs, (56.5, 24.5, 54.5, 27.0)).select("event_id")


@query("p02_tails_in_view", "v_points", """
    with last_seen as (select hex, arg_max(lat, t) as la, arg_max(lon, t) as lo, count(*) as n from v_points group by hex)
    select hex, n from last_seen where la between 24.5 and 27 and lo between 54.5 and 57""")
def _(v):
    from geoweave.operators.tracks import tail_ends, tails
    ends = filters.tails_in_view(tail_ends(v.points, 0, 4e9, at_least=1), (54.5, 24.5, 57.0, 27.0))
    paths = tails(v.points, 0, 4e9, at_least=1, ends=ends)
    return ends.join(paths, "hex").filter(F.size("coords") == F.col("n_points")).select("hex", F.col("n_points").alias("n"))


@query("p03_in_circles", "obs v_regions", f"""select event_id from obs o where exists (select 1 from v_regions r
    where {km('o.lat', 'o.lon', 'r.lat', 'r.lon')} <= r.radius_nm * 1.852e0)""")
def _(v):
    return joins.inside_any_region(v.obs, v.regions).select("event_id")


@query("p04_record_flags", "v_news v_points", """select id from v_news where is_conflict
    union all select concat(hex, '@', cast(floor(t) as bigint)) from v_points where military""")
def _(v):
    mil = v.points.filter("military").select(F.concat("hex", F.lit("@"), F.floor("t").cast("string")).alias("id"))
    return v.news.filter("is_conflict").select("id").unionByName(mil)


@query("p05_severity_gate", "v_news", f"select id from v_news where {SEVERITY} >= 0.35e0 and geo_type not in (1, 2, 5)")
def _(v):
    from geoweave.operators.proximity import with_severity
    return with_severity(v.news).filter(filters.severe_enough(0.35)).select("id")


@query("p06_retrieval_worthy", "v_firms v_points", """select id from v_firms where novelty >= 0.5
    union all select concat(hex, '@', cast(floor(t) as bigint)) from v_points where military or alt_ft < 10000""")
def _(v):
    from geoweave.functions.text import complete_record
    fires = complete_record(v.firms.select("id", F.lit("firms").alias("kind"), "novelty"))
    craft = complete_record(v.points.select(F.concat("hex", F.lit("@"), F.floor("t").cast("string")).alias("id"), F.lit("adsb").alias("kind"), "military", "alt_ft"))
    return fires.unionByName(craft).filter(filters.retrieval_worthy()).select("id")


@query("p08_lookback", "v_news v_points v_firms", """select id from v_news where t between 1705312800 - 7200 and 1705312800
    union all select id from v_firms where t between 1705312800 - 43200 and 1705312800
    union all select hex from v_points where t between 1705312800 - 3600 and 1705312800""")
def _(v):
    t = 1705312800.0
    return (filters.between(v.news, t - 7200, t).select("id").unionByName(filters.between(v.firms, t - 43200, t).select("id"))
            .unionByName(filters.between(v.points, t - 3600, t).select(F.col("hex").alias("id"))))


@query("p09_visible_verdicts", "v_verdicts", "select id from v_verdicts where verdict in ('SUPPORTED', 'PLAUSIBLE') or same_article")
def _(v):
    return filters.visible_verdicts(v.verdicts).select("id")


@query("p10_platform_posts", "v_posts", "select id, t from v_posts where platform = 'reddit' order by t desc, id limit 500")
def _(v):
    return filters.newest_on_platform(v.posts, " Reddit ", 500).select("id", "t")


@query("p11_text_search", "v_posts", "select id from v_posts where contains(lower(concat_ws(' ', platform, channel, text)), 'thing')")
def _(v):
    return v.posts.filter(filters.matches_text(["platform", "channel", "text"], " Thing ")).select("id")


@query("p12_new_thermal", "v_firms", "select id from v_firms where novelty >= 0.9")
def _(v):
    return v.firms.filter(filters.new_thermal()).select("id")


@query("s03_offset_list", "v_news", """select id, concat('Jane Smith ', split_part(id, ':', 2)::bigint % 45, '|Omar Haddad ', split_part(id, ':', 2)::bigint % 89) as names from v_news""")
def _(v):
    raw = F.concat(F.col("persons")[0], F.lit(",12;"), F.lit(" "), F.col("persons")[1], F.lit(" ,7;;"), F.col("persons")[0], F.lit(",99; ,4"))
    return v.news.select("id", F.array_join(news.offset_list(raw), "|").alias("names"))


@query("s05_day_loader", "v_news", """select id from v_news where geo_type not in (1, 2, 5)
    and ((lat between 25 and 26.5 and lon between 55 and 56.5) or contains(lower(url), 's7.') or contains(lower(url), 's11.'))""")
def _(v):
    return filters.day_loader(v.news, (25.0, 55.0, 26.5, 56.5), ("S7.", "s11.")).select("id")
