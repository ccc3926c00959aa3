"""Space-time joins, as-of and nearest joins, tracks, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.text import SEVERITY, WEIGHT, cell, km, rnd
from geoweave.functions.geo import round_to
from geoweave.operators import joins, proximity, tracks

AT = 1705312800.0

# brute force: every event with every aircraft position that satisfies the rule
NEAR = f"""severe as (select *, {SEVERITY} as severity from v_news where {SEVERITY} >= 0.35e0 and geo_type not in (1, 2, 5)),
    craft as (select *, {WEIGHT} as weight from v_points),
    near as (select n.id as event_id, concat('adsb:', p.hex) as aircraft_id, p.t as aircraft_t, n.lat, n.lon, n.place,
        {km('n.lat', 'n.lon', 'p.lat', 'p.lon')} as d, abs(p.t - n.t) / 60e0 as m, n.severity, p.weight
        from severe n join craft p on abs(p.t - n.t) <= 240 * 60e0 and abs({cell('n.lat')} - {cell('p.lat')}) <= 1 and abs({cell('n.lon')} - {cell('p.lon')}) <= 1),
    pairs as (select *, {rnd('(1e0 - d / 75e0) * severity * weight', 3)} as score, {rnd('d', 1)} as distance_km, {rnd('m', 1)} as dt_min from near where d <= 75)"""
BEST = """ranked as (select *, row_number() over (partition by aircraft_id, floor(lat * 10 + 5e-1), floor(lon * 10 + 5e-1)
        order by score desc, event_id, aircraft_t) as rn from pairs)"""


@query("j02_near", "v_news v_points", f"with {NEAR} select event_id, aircraft_id, aircraft_t, score, distance_km, dt_min from pairs")
def _(v):
    return proximity.near_pairs(v.news, v.points, 75.0, 240.0, 0.35).select("event_id", "aircraft_id", "aircraft_t", "score", "distance_km", "dt_min")


@query("j02_near_exact", "v_news v_points", f"""with {NEAR.replace('and abs(' + cell('n.lat') + ' - ' + cell('p.lat') + ') <= 1 and abs(' + cell('n.lon') + ' - ' + cell('p.lon') + ') <= 1', '')}
    select event_id, aircraft_id, aircraft_t, score from pairs""")
def _(v):
    return proximity.near_pairs(v.news, v.points, 75.0, 240.0, 0.35, exact=True).select("event_id", "aircraft_id", "aircraft_t", "score")


@query("a15_alert_dedupe", "v_news v_points", f"with {NEAR}, {BEST} select aircraft_id, event_id, score, dt_min from ranked where rn = 1")
def _(v):
    found = proximity.alerts(v.news, v.points, 75.0, 240.0, 0.35)
    return found.select("aircraft_id", "event_id", "score", "dt_min")


@query("q01_alerts", "v_news v_points", f"""with {NEAR}, {BEST} select aircraft_id, event_id, score, distance_km, place from ranked
    where rn = 1 and score >= 0.1e0 order by score desc, event_id, aircraft_id limit 300""")
def _(v):
    return proximity.alerts(v.news, v.points, 75.0, 240.0, 0.35, min_score=0.1, limit=300).select(
        "aircraft_id", "event_id", "score", "distance_km", "place")


@query("l04_alerts_of_event", "v_news v_points", f"""with {NEAR}, {BEST}, kept as (select * from ranked where rn = 1),
    busiest as (select event_id from kept group by 1 order by count(*) desc, event_id limit 1)
    select aircraft_id, event_id, score from kept where event_id in (select event_id from busiest)""")
def _(v):
    best = proximity.BestAlerts(v.news, v.points, 75.0, 240.0, 0.35)
    busiest = best.ranked.groupBy("_e").count().orderBy(F.col("count").desc(), "_e").first()
    return best.named(best.ranked.limit(0) if busiest is None else best.of_event(busiest["_e"]))


_FLEET = f"fleet as (select distinct {cell('lat')} as row, {cell('lon')} as col, concat('adsb:', hex) as a from v_points where military)"


@query("j03_co_located", "v_points", f"""with {_FLEET}, numbered as (select *, row_number() over (partition by row, col order by a) as rn from fleet)
    select x.row, x.col, x.a, y.a as b from numbered x join numbered y on x.row = y.row and x.col = y.col and y.rn between x.rn + 1 and x.rn + 5""")
def _(v):
    return proximity.co_located(v.points)


@query("j03_co_located_all", "v_points", f"""with {_FLEET} select x.row, x.col, x.a, y.a as b from fleet x join fleet y
    on x.row = y.row and x.col = y.col and x.a < y.a""")
def _(v):
    return proximity.co_located_all(v.points)


@query("j07_thermal_novelty", "v_firms", f"""
    with pairs as (select a.id, min({km('a.lat', 'a.lon', 'b.lat', 'b.lon')}) as d from v_firms a, v_firms b
        where not a.is_baseline and b.is_baseline group by a.id)
    select id, {rnd('least(1e0, d / 2e0)', 3)} as novelty from pairs""")
def _(v):
    return joins.thermal_novelty(v.firms.filter("not is_baseline"), v.firms.filter("is_baseline")).select("id", "novelty")


@query("j08_asof_snapshot", "v_points", f"""select hex, max(t) as t, arg_max(lat, t) as lat, arg_max(lon, t) as lon from v_points
    where t between {AT} - 21600 and {AT} group by hex""")
def _(v):
    return joins.asof_snapshot(v.points, AT, 21600.0).select("hex", "t", "lat", "lon")


@query("j08_asof_many", "v_points", """with instants as (select distinct floor(t / 3600) * 3600e0 + 1800 as "at" from v_points)
    select "at", hex, max(t) as t, arg_max(lat, t) as lat from instants join v_points on t <= "at" and t >= "at" - 3600 group by "at", hex""")
def _(v):
    instants = v.points.select((F.floor(F.col("t") / 3600) * 3600.0 + 1800).alias("at")).distinct()
    return joins.asof_snapshots(v.points, instants, 3600.0).select("at", "hex", "t", "lat")


# radar scenes: thermal rows grouped into passes of five hours
_SCENES = "dets as (select floor(t / 18000) * 18000e0 as t, lat, lon from v_firms)"


@query("j09_nearest_scene", "v_firms v_news", f"""with {_SCENES}, scenes as (select t as scene_t, count(*) as n from dets group by t),
    instants as (select distinct floor(t / 7200) * 7200e0 as "at" from v_news),
    ranked as (select "at", scene_t, n, row_number() over (partition by "at" order by abs(scene_t - "at"), scene_t) as rn
        from instants join scenes on abs(scene_t - "at") <= 72 * 3600e0)
    select "at", scene_t, {rnd('("at" - scene_t) / 3600', 4)} as age_h, n from ranked where rn = 1""")
def _(v):
    dets = v.firms.select((F.floor(F.col("t") / 18000) * 18000.0).alias("t"), "lat", "lon")
    instants = v.news.select((F.floor(F.col("t") / 7200) * 7200.0).alias("at")).distinct()
    return joins.nearest_scene(dets, instants, 72.0).select("at", "scene_t", round_to(F.col("age_h"), 4).alias("age_h"), "n")


@query("a24_radar_scenes", "v_firms", f"""with {_SCENES}
    select t, count(*) as n, count(*) filter (where lat between 25 and 27 and lon between 55.0 and 57.0) as core,
        count(*) filter (where lat between 25 and 27 and lon between 55.0 and 57.0) >= 3 as usable from dets group by t""")
def _(v):
    from geoweave.plans.overview import radar_scenes
    dets = v.firms.select((F.floor(F.col("t") / 18000) * 18000.0).alias("t"), "lat", "lon")
    return radar_scenes(dets, (25.0, 55.0, 27.0, 57.0), 3).select("t", "n", "core", "usable")


@query("j01_gkg_entities", "v_news", """
    with gkg as (select url, split_part(id, ':', 2)::bigint as n, persons[1] as person from v_news where is_conflict),
    last_row as (select url, arg_max(person, n) as person from gkg group by url)
    select v.id, coalesce(person, '') as person from v_news v left join last_row g on v.url = g.url""")
def _(v):
    from geoweave.sources.news import attach_entities
    gkg = v.news.filter("is_conflict").select("url", F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint").alias("pos"),
                                              F.slice("persons", 1, 1).alias("persons"), "orgs", "themes")
    out = attach_entities(v.news.drop("persons", "orgs", "themes"), gkg)
    return out.select("id", F.array_join("persons", "|").alias("person"))


@query("j11_civil_and_durable", "v_points", """with mil as (select distinct hex from v_points where military and t < 1705312800),
    civ as (select distinct hex from v_points where t >= 1705312800) select hex from mil union all select hex from civ where hex not in (select hex from mil)""")
def _(v):
    mil = v.points.filter((F.col("t") < AT) & F.col("military")).select("hex").distinct()
    civ = v.points.filter(F.col("t") >= AT).select("hex").distinct()
    return tracks.civil_not_military(mil, civ).select("hex")


@query("s07_carry_forward", "v_points", """select hex, t, last_value(flight ignore nulls) over w as flight, last_value(nic ignore nulls) over w as nic,
    last_value(nac_p ignore nulls) over w as nac_p from v_points where lat between 24.5 and 27 and lon between 54.5 and 57
    window w as (partition by hex order by t, lat, lon rows between unbounded preceding and current row)""")
def _(v):
    from geoweave.sources.aircraft import keep_in_box
    inside = keep_in_box(v.points, (25.0, 55.0, 26.5, 56.5), 0.5)
    return tracks.carry_forward(inside, ["flight", "nic", "nac_p"], tie=("lat", "lon")).select("hex", "t", "flight", "nic", "nac_p")


@query("s08_merge_days", "v_points", """select hex, bool_or(military) as military, count(*) as n, min(t) as t_first, max(t) as t_last,
    arg_min(reg, d) as reg from (select *, case when t < 1705312800 then 0 else 1 end as d, concat('R', hex, case when t < 1705312800 then 0 else 1 end) as reg from v_points) group by hex""")
def _(v):
    first = v.points.filter(F.col("t") < AT).withColumn("reg", F.concat(F.lit("R"), "hex", F.lit("0")))
    second = v.points.filter(F.col("t") >= AT).withColumn("reg", F.concat(F.lit("R"), "hex", F.lit("1")))
    craft, _points = tracks.merge_days([first, second])
    return craft.select("hex", "military", "n", "t_first", "t_last", "reg")


@query("w02_carry_forward_vessels", "v_vessels", """select id, t, last_value(case when sog > 20 then sog end ignore nulls) over (partition by id order by t
    rows between unbounded preceding and current row) as sog from v_vessels""")
def _(v):
    sparse = v.vessels.withColumn("sog", F.when(F.col("sog") > 20, F.col("sog")))
    return tracks.carry_forward(sparse, ["sog"], by="id").select("id", "t", "sog")


@query("w03_tails", "v_points", """with span as (select * from v_points where t between 1705312800 - 864000 and 1705312800),
    kept as (select hex from span where hex in (select hex from v_points where t between 1705312800 - 86400 and 1705312800) group by hex having count(distinct t) >= 2)
    select hex, t, lat, lon from span where hex in (select hex from kept)""")
def _(v):
    present = v.points.filter(F.col("t").between(AT - 86400, AT))
    out = tracks.tails(v.points, AT - 864000, AT, present)
    return out.select("hex", F.explode("coords").alias("c")).select("hex", "c.t", "c.lat", "c.lon")


@query("w04_thinned_paths", "v_points", """with span as (select *, row_number() over (partition by hex order by t, lat, lon) - 1 as rn,
        count(*) over (partition by hex) as n from v_points where t between 1704067200 and 1706400000)
    select s.hex, rn, t, lat, lon, callsign from span s left join (select hex, arg_max(flight, t) as callsign from v_points
        where t between 1704067200 and 1706400000 and flight is not null group by hex) f on s.hex = f.hex
    where n >= 2 and rn % greatest(1, n // 4) = 0""")
def _(v):
    return tracks.thinned_paths(v.points, 1704067200, 1706400000, 4).select("hex", "rn", "t", "lat", "lon", "callsign")


@query("w05_newest_per_slot", "v_points", "select hex, cast(floor(t / 900) as bigint) as slot, max(t) as t, arg_max(lat, t) as lat from v_points group by 1, 2")
def _(v):
    return tracks.newest_per_slot(v.points).select("hex", "slot", "t", "lat")


@query("u02_union_dedupe", "v_posts", """with parts as (select id, t, channel, 0 as p from v_posts where views < 6000 union all select id, t + 1, upper(channel), 1 from v_posts where views > 3000)
    select id, arg_min(channel, p) as first_channel, arg_max(channel, p) as last_channel from parts group by id""")
def _(v):
    a = v.posts.filter("views < 6000").select("id", "t", "channel")
    b = v.posts.filter("views > 3000").select("id", (F.col("t") + 1).alias("t"), F.upper("channel").alias("channel"))
    first = tracks.union_first([a, b]).select("id", F.col("channel").alias("first_channel"))
    return first.join(tracks.union_last([a, b]).select("id", F.col("channel").alias("last_channel")), "id")


@query("s16_social_merge", "v_posts", """with parts as (select id, t, lat, channel, 0 as p from v_posts where platform = 'telegram'
        union all select id, t + 5, lat, channel, 1 from v_posts where platform in ('telegram', 'reddit') union all select id, t + 9, case when views % 2 = 0 then lat end, channel, 2 from v_posts),
    firsts as (select * from (select *, row_number() over (partition by id order by p) as rn from parts) where rn = 1)
    select id, t from firsts where lat is not null""")
def _(v):
    from geoweave.sources.social import merge_post_files
    base = v.posts.select("id", "t", "lat", "channel")
    a = v.posts.filter("platform = 'telegram'").select("id", "t", "lat", "channel")
    b = v.posts.filter("platform in ('telegram', 'reddit')").select("id", (F.col("t") + 5).alias("t"), "lat", "channel")
    c = base.select("id", (F.col("t") + 9).alias("t"), "lat", "channel")
    c = v.posts.select("id", (F.col("t") + 9).alias("t"), F.when(F.col("views") % 2 == 0, F.col("lat")).alias("lat"), "channel")
    return merge_post_files([a, b, c]).select("id", "t")
