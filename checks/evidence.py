"""Candidates, verdicts, clusters and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.scalars import _NORM
from checks.text import SEVERITY, cell, km, rnd, values
from geoweave import fixed_values as fv
from geoweave.functions.geo import round_to
from geoweave.functions.text import normalize_text
from geoweave.operators import candidates as cand
from geoweave.operators import graph, joins, proximity, verdicts
from geoweave.session import cut_lineage

VIEWS = "v_news v_points v_vessels v_firms"


def records_of(v):
    ships = v.vessels.select("id", "mmsi", "t", "lat", "lon", "name")
    return cand.records_from_sources(v.news, v.points, v.firms, ships)


def table_of(v):
    return v.shared("retrieval", lambda: cand.retrieval_table(records_of(v)))


def candidates_of(v):
    """The plan of the pairs, not a written table: each query reads them once and takes few of their columns."""
    return v.shared("pairs", lambda: cand.candidate_pairs(table_of(v)))


def best_of(v):
    return cand.best_candidates(candidates_of(v), table_of(v), 250)


@query("u01_evidence_records", VIEWS, """select id, 'gdelt' as kind, concat(root_code, ': ', place) as label, t, 'gdelt_date_added_not_incident_time' as timestamp_kind from v_news
    union all select concat('adsb:', hex), 'adsb', hex, t, 'aircraft_observation_time' from v_points
    union all select id, 'firms', 'FIRMS thermal anomaly ', t, 'satellite_acquisition_time' from v_firms
    union all select id, 'ais', name, t, 'vessel_position_report_time' from v_vessels""")
def _(v):
    return records_of(v).select("id", "kind", "label", "t", "timestamp_kind")


# texts exactly as the rule joins them, then brute-force containment
_TEXT = "concat_ws(' ', actor1, actor2, persons[1], persons[2], orgs[1], orgs[2], array_to_string(themes, ' '), regexp_extract(url, '^https?://[^/]*([^?#]*)', 1))"
FACTS = f"""reports as (select id, t, lat, lon, geo_type, concat('article:', regexp_replace(url, '\\?.*$', ''), '?id=', regexp_extract(url, 'id=(\\d+)', 1)) as src,
        concat(' ', {_NORM.format(x=_TEXT)}, ' ') as body, [lower(persons[1]), lower(persons[2]), lower(orgs[1])] as ents,
        list_filter([case actor1 when 'U.S.' then 'u s' when 'Government' then null else lower(actor1) end, lower(actor2)], lambda x: x is not null) as acts,
        case when list_contains(themes, 'MARITIME') then ['maritime'] when list_contains(themes, 'AIRSTRIKE') then ['aviation', 'thermal'] else [] end as topics from v_news),
    assets as (select id, 'ais' as kind, t, lat, lon, true as worthy, [cast(mmsi as varchar), lower(name)] as ids, 'maritime' as topic, 75e0 as r, 240e0 as w from v_vessels
        union all select concat('adsb:', hex), 'adsb', t, lat, lon, military or coalesce(alt_ft < 10000, false), case when length(hex) >= 4 then [hex] else [] end, 'aviation', 75e0, 240e0 from v_points
        union all select id, 'firms', t, lat, lon, novelty >= 0.5, [], 'thermal', 50e0, 720e0 from v_firms),
    mixed as (select n.id as l_id, a.id as r_id, n.t as l_t, a.t as r_t, 'gdelt' as l_kind, a.kind as r_kind, n.src as l_src, concat(a.kind, ':', a.id) as r_src, n.geo_type, a.worthy, r, w,
            {km('n.lat', 'n.lon', 'a.lat', 'a.lon')} as d, abs(n.t - a.t) / 60e0 as m, len(list_filter(ids, lambda x: contains(body, ' ' || x || ' '))) as n_ids,
            len(list_filter(ids, lambda x: contains(body, ' ' || x || ' ') and (a.kind = 'adsb' or x not like 'vessel%'))) as n_strong, list_contains(topics, topic) as on_topic
            from reports n join assets a on abs(n.t - a.t) <= w * 60),
    news as (select a.id as l_id, b.id as r_id, a.t as l_t, b.t as r_t, a.src as l_src, b.src as r_src, {km('a.lat', 'a.lon', 'b.lat', 'b.lon')} as d, abs(a.t - b.t) / 60e0 as m,
            list_distinct(list_filter(list_concat(a.ents, b.ents), lambda x: (list_contains(a.ents, x) or contains(a.body, ' ' || x || ' ')) and (list_contains(b.ents, x) or contains(b.body, ' ' || x || ' ')))) as shared,
            list_distinct(list_filter(list_concat(a.acts, b.acts), lambda x: (list_contains(a.acts, x) or contains(a.body, ' ' || x || ' ')) and (list_contains(b.acts, x) or contains(b.body, ' ' || x || ' ')))) as actors,
            len(list_intersect(a.topics, b.topics)) as n_topics from reports a join reports b on a.id < b.id and a.src <> b.src and abs(a.t - b.t) <= 720 * 60e0),
    solid as (select x.id as l_id, y.id as r_id, x.t as l_t, y.t as r_t, x.kind as l_kind, y.kind as r_kind, {km('x.lat', 'x.lon', 'y.lat', 'y.lon')} as d, abs(x.t - y.t) / 60e0 as m,
            case when x.kind = 'adsb' and y.kind = 'ais' then 60e0 else 180e0 end as w from assets x join assets y
            on ((x.kind in ('adsb', 'ais') and y.kind = 'firms' and abs(x.t - y.t) <= 180 * 60e0) or (x.kind = 'adsb' and y.kind = 'ais' and abs(x.t - y.t) <= 60 * 60e0)) where x.worthy and y.worthy),
    pairs as (select l_id, r_id, l_t, r_t, l_kind, r_kind, l_src, r_src, d, m, r, w, case when n_strong > 0 then 'identifier' when n_ids > 0 then 'name' when on_topic then 'topic' else 'proximity' end as tier, n_ids as ov
            from mixed where n_ids > 0 or (d <= r and worthy and (on_topic or geo_type not in (1, 2, 5)))
        union all select l_id, r_id, l_t, r_t, 'gdelt', 'gdelt', l_src, r_src, d, m, 100e0, 720e0, case when len(shared) > 0 then 'entity' else 'topic' end, case when len(shared) > 0 then len(shared) else len(actors) end from news
            where d <= 100 and (len(shared) > 0 or (n_topics > 0 and len(actors) > 0))
        union all select l_id, r_id, l_t, r_t, l_kind, r_kind, concat(l_kind, ':', l_id), concat(r_kind, ':', r_id), d, m, 30e0, w, 'proximity', 0 from solid where d <= 30),
    rated as (select *, greatest(0e0, 1 - d / r) as sp, greatest(0e0, 1 - m / w) as tm, case tier when 'identifier' then 0.92e0 when 'name' then 0.82e0 when 'entity' then 0.68e0 when 'topic' then 0.5e0 else 0e0 end as base from pairs),
    scored as (select *, {rnd('case when base > 0 then base + 0.03e0 * sp + 0.03e0 * tm else 0.22e0 * sp + 0.17e0 * tm end', 3)} as score,
        concat(least(l_src, r_src), '|', greatest(l_src, r_src)) as coverage_key from rated)"""
BEST = """best as (select * from (select *, row_number() over (partition by coverage_key order by score desc, concat(l_kind, ':', l_id, '@', l_t), concat(r_kind, ':', r_id, '@', r_t)) as rn from scored) where rn = 1)"""


@query("j04_candidate_pairs", VIEWS, f"with {FACTS} select l_id, r_id, l_t, r_t, tier as match_type, score from scored")
def _(v):
    return candidates_of(v).select("l_id", "r_id", "l_t", "r_t", "match_type", "score")


@query("j06_match_tiers", VIEWS, f"with {FACTS} select l_kind, r_kind, tier as match_type, count(*) as n, {rnd('sum(score)', 2)} as total from scored group by all")
def _(v):
    return candidates_of(v).groupBy("l_kind", "r_kind", "match_type").agg(F.count(F.lit(1)).alias("n"), round_to(F.sum("score"), 2).alias("total"))


@query("a16_best_candidates", VIEWS, f"with {FACTS}, {BEST} select coverage_key, score, tier as match_type from best order by score desc, coverage_key limit 250")
def _(v):
    return best_of(v).select("coverage_key", "score", "match_type")


_HOT = "hot(row, col) as (values (25, 55), (26, 56))"
_FLAG = f"""flagged as (select b.*, exists (select 1 from hot h, (select * from (select id, lat, lon, t from reports union all select id, lat, lon, t from assets)) p
    where ((p.id = b.l_id and p.t = b.l_t) or (p.id = b.r_id and p.t = b.r_t)) and h.row = {cell('p.lat')} and h.col = {cell('p.lon')}) as hot from top b)"""


@query("j17_hot_candidates", VIEWS, f"with {FACTS}, {BEST}, {_HOT}, top as (select * from best), {_FLAG} select coverage_key, hot from flagged")
def _(v):
    return _flagged(v).select("coverage_key", "hot")


def _flagged(v):
    dense = v.spark.sql("select * from values (25, 55), (26, 56) as t(row, col)")
    return cand.with_hot_flag(cand.best_candidates(candidates_of(v), table_of(v)), dense)


_ORDERED = "hot desc, score desc, coverage_key"


@query("w08_review_batch", VIEWS, f"""with {FACTS}, {BEST}, {_HOT}, top as (select * from best), {_FLAG},
    turned as (select *, case tier when 'identifier' then 0 when 'name' then 1 when 'entity' then 2 when 'topic' then 3 else 4 end as level,
        row_number() over (partition by tier, least(l_kind, r_kind), greatest(l_kind, r_kind) order by {_ORDERED}) as turn from flagged),
    spotted as (select *, row_number() over (partition by level order by turn, {_ORDERED}) as spot from turned where turn <= 12)
    select coverage_key, tier as match_type, score, cast(turn as int) as turn from spotted where tier <> 'proximity' or spot <= 2 order by level, spot limit 12""")
def _(v):
    return cand.select_batch(_flagged(v)).select("coverage_key", "match_type", "score", "turn")


@query("w09_adjudication_order", VIEWS, f"""with {FACTS}, {BEST}, {_HOT}, top as (select * from best), {_FLAG}
    select coverage_key, tier as match_type, score from flagged order by hot desc, ov desc, (l_kind = 'gdelt' and r_kind = 'gdelt') desc, score desc, coverage_key limit 12""")
def _(v):
    return cand.adjudication_order(_flagged(v)).select("coverage_key", "match_type", "score")


@query("j05_phrases_in_texts", "", f"""
    with phrases as (select distinct trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) as phrase from nation
        union select distinct {_NORM.format(x="concat_ws(' ', split_part(text, ' ', 1), split_part(text, ' ', 2))")} from benchmark),
    bodies as (select doc_id, concat(' ', {_NORM.format(x='text')}, ' ') as body from documents)
    select doc_id as rid, phrase from bodies, phrases where phrase <> '' and contains(body, ' ' || phrase || ' ')""")
def _(v):
    nations = v.raw("nation").select(normalize_text(F.col("n_name")).alias("phrase"))
    starts = v.raw("benchmark").select(normalize_text(F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))).alias("phrase"))
    bodies = v.raw("documents").select(F.col("doc_id").alias("rid"), F.concat(F.lit(" "), normalize_text(F.col("text")), F.lit(" ")).alias("text_norm"))
    bodies = bodies.withColumn("tokens", F.array_distinct(F.filter(F.split("text_norm", " "), lambda w: w != "")))
    return joins.phrase_hits(cut_lineage(bodies), nations.union(starts).distinct())


@query("e01_prompt_payload", VIEWS)
def _(v):
    return verdicts.prompt_payload(cand.best_candidates(candidates_of(v), table_of(v)), records_of(v))


# ---- verdicts ------------------------------------------------------------------------------------

_RAW = """raw as (select id, left_id, case when id % 3 = 0 then 'gdelt' else 'adsb' end as right_kind, 'gdelt' as left_kind, right_id,
        case id % 7 when 0 then 'MAYBE' when 1 then 'CONTRADICTED' else verdict end as v, case id % 5 when 0 then 'NONE' when 1 then 'CAUSES' else 'SUPPORTS' end as r,
        case id % 6 when 0 then 'SAME_INCIDENT' when 1 then 'RELATED_INCIDENTS' when 2 then 'UNRELATED' when 3 then 'NOT_APPLICABLE' else 'SAME_INCIDENT' end as i,
        evidence_strength * 1.5e0 - 0.2e0 as s from v_verdicts)"""


@query("e02_verdict_rules", "v_verdicts", f"""with {_RAW},
    a as (select id, right_kind = 'gdelt' as news, case when v in {values(fv.VERDICTS)} then v else 'INSUFFICIENT_EVIDENCE' end as v, case when r in {values(fv.RELATIONS)} then r else 'NONE' end as r,
        case when right_kind <> 'gdelt' then 'NOT_APPLICABLE' when i in ('SAME_INCIDENT', 'RELATED_INCIDENTS', 'UNRELATED', 'UNCERTAIN') then i else 'UNCERTAIN' end as i, {rnd('greatest(0e0, least(1e0, s))', 3)} as s from raw),
    b as (select id, news, i, v, r, s, news and (i in ('UNCERTAIN', 'UNRELATED') or v not in ('SUPPORTED', 'PLAUSIBLE')) as lost from a),
    c as (select id, case when lost and i not in ('UNCERTAIN', 'UNRELATED') then 'UNCERTAIN' else i end as i, case when lost then 'INSUFFICIENT_EVIDENCE' else v end as v,
        case when lost then 'NONE' when news and i = 'SAME_INCIDENT' then 'SAME_INCIDENT' when news then 'OPERATIONALLY_RELATED' else r end as r, case when lost then 0e0 else s end as s from b)
    select id, i as incident_relationship, case when v not in ('INSUFFICIENT_EVIDENCE', 'CONTRADICTED') and r = 'NONE' then 'INSUFFICIENT_EVIDENCE' else v end as verdict,
        case v when 'INSUFFICIENT_EVIDENCE' then 'NONE' when 'CONTRADICTED' then 'CONTRADICTS' else r end as relation, s as evidence_strength from c""")
def _(v):
    n = F.col("id")
    raw = v.verdicts.select("id", "left_id", "right_id", "left_kind", F.when(n % 3 == 0, "gdelt").otherwise("adsb").alias("right_kind"),
                            F.when(n % 7 == 0, "MAYBE").when(n % 7 == 1, "CONTRADICTED").otherwise(F.col("verdict")).alias("verdict"),
                            F.when(n % 5 == 0, "NONE").when(n % 5 == 1, "CAUSES").otherwise("SUPPORTS").alias("relation"),
                            F.when(n % 6 == 1, "RELATED_INCIDENTS").when(n % 6 == 2, "UNRELATED").when(n % 6 == 3, "NOT_APPLICABLE").otherwise("SAME_INCIDENT").alias("incident_relationship"),
                            (F.col("evidence_strength") * 1.5 - 0.2).alias("evidence_strength"))
    return verdicts.normalize_verdicts(raw).select("id", "incident_relationship", "verdict", "relation", "evidence_strength")


_RECENT = "recent as (select concat(least(left_id, right_id), '|', greatest(left_id, right_id)) as k, max(created_at) as at_t, arg_max(id % 4, created_at) as sig from v_verdicts group by 1)"


@query("e03_cooldown", "v_verdicts", f"""with {_RECENT}, c as (select id, concat(least(left_id, right_id), '|', greatest(left_id, right_id)) as k, id % 4 as sig from v_verdicts where verdict <> 'SUPPORTED')
    select id from c left join recent on c.k = recent.k and at_t > 40000 - 1800 where recent.k is null or recent.sig <> c.sig""")
def _(v):
    from geoweave.functions.hashing import pair_key
    keyed = v.verdicts.withColumn("coverage_key", pair_key(F.col("left_id"), F.col("right_id"))).withColumn("signature", F.col("id") % 4)
    recent = keyed.groupBy("coverage_key").agg(F.max("created_at").alias("at"), F.max_by("signature", "created_at").alias("signature"))
    waiting = keyed.withColumn("candidate_id", F.col("id"))
    return verdicts.eligible(waiting, waiting.filter("verdict = 'SUPPORTED'"), recent, 40000.0).select("id")


@query("e04_latest_per_pair", "v_verdicts", """with r as (select *, row_number() over (partition by least(left_id, right_id), greatest(left_id, right_id) order by created_at desc, id desc) as rn from v_verdicts)
    select id, created_at from r where rn = 1 order by created_at desc, id limit 500""")
def _(v):
    return verdicts.latest_per_pair(v.verdicts, 500).select("id", "created_at")


@query("a29_best_per_pair", "v_verdicts", """select id from (select *, row_number() over (partition by left_id, right_id order by verdict = 'SUPPORTED' desc, evidence_strength desc, created_at desc) as rn
    from v_verdicts where verdict in ('SUPPORTED', 'PLAUSIBLE')) where rn = 1""")
def _(v):
    return verdicts.best_per_pair(v.verdicts).select("id")


@query("j12_still_valid", "v_verdicts v_news v_points", """with rec as (select 'gdelt' as kind, id, root_code as claims from v_news union all select distinct 'adsb', concat('adsb:', hex), 'x' from v_points),
    stored as (select *, case id % 4 when 0 then null else lpad(cast(1 + o % 20 as varchar), 2, '0') end as lc, case when id % 9 = 0 then 'y' else 'x' end as rc from (select *, split_part(left_id, ':', 2)::bigint as o from v_verdicts))
    select s.id from stored s join rec a on a.kind = 'gdelt' and a.id = s.left_id join rec b on b.kind = 'adsb' and b.id = concat('adsb:h', s.id % 150)
    where created_at >= 30000 - 20000 and (lc is null or lc = a.claims) and rc = b.claims""")
def _(v):
    rec = v.news.select(F.lit("gdelt").alias("kind"), "id", F.col("root_code").alias("claims")).unionByName(
        v.points.select(F.lit("adsb").alias("kind"), F.concat(F.lit("adsb:"), "hex").alias("id"), F.lit("x").alias("claims")).distinct())
    o = F.split_part("left_id", F.lit(":"), F.lit(2)).cast("bigint")
    stored = v.verdicts.withColumns({"left_claims": F.when(F.col("id") % 4 != 0, F.lpad((1 + o % 20).cast("string"), 2, "0")),
                                     "right_claims": F.when(F.col("id") % 9 == 0, "y").otherwise("x"),
                                     "right_id": F.concat(F.lit("adsb:h"), (F.col("id") % 150).cast("string"))})
    return verdicts.still_valid(stored, rec, 30000.0, 20000.0).select("id")


@query("j13_verdict_reuse", "v_verdicts", """select c.id, s.created_at from v_verdicts c join v_verdicts s on s.left_id = c.left_id and s.right_id = c.right_id and s.left_group = c.left_group and s.right_group = c.right_group
    where s.id % 3 <> 0 and (s.id % 5 <> 0 or s.created_at > 50000 - 300)""")
def _(v):
    base = v.verdicts.withColumns({"candidate_id": F.concat("left_id", F.lit("|"), "right_id"), "left_claims": F.col("left_group"), "right_claims": F.col("right_group")})
    cached = base.select("candidate_id", "left_claims", "right_claims", "created_at", F.when(F.col("id") % 3 == 0, "old").otherwise("v3").alias("prompt_version"),
                         F.lit("m").alias("model"), (F.col("id") % 5 != 0).alias("documents_ok"))
    hits = verdicts.reuse_cached(base.select("id", "candidate_id", "left_claims", "right_claims"), cached, "v3", "m", 50000.0).distinct()
    return base.select("id", "candidate_id").join(hits, "candidate_id").select("id", "created_at")


@query("j14_article_identity", "v_news", """with n as (select id, url, t, regexp_replace(url, '\\?.*$', '') || '?id=' || regexp_extract(url, 'id=(\\d+)', 1) as own, regexp_extract(url, '/a/(\\d+)', 1)::bigint as a from v_news),
    docs as (select distinct url, 'https://www.example.net/story/' || (a // 2) as dest from n where a % 3 <> 0)
    select x.id as left_id, y.id as right_id, case when x.own = y.own or (dx.dest = dy.dest) then 'SAME_ARTICLE' else 'NOT_ESTABLISHED' end as status,
        case when x.own = y.own then 'normalized_url' when dx.dest = dy.dest then 'redirect_url' end as basis
    from n x join n y on x.id < y.id and floor(x.t / 1800) = floor(y.t / 1800) left join docs dx on dx.url = x.url left join docs dy on dy.url = y.url""")
def _(v):
    n = v.news.select("id", "url", F.floor(F.col("t") / 1800).alias("slot"))
    a = F.regexp_extract("url", r"/a/(\d+)", 1).cast("bigint")
    docs = n.select("url").distinct().filter(a % 3 != 0).select("url", F.concat(F.lit("https://www.example.net/story/"), F.floor(a / 2).cast("string"), F.lit("/")).alias("resolved_url"), F.lit(True).alias("available"))
    return verdicts.article_pairs(n, docs, ["slot"])


_BESTV = """bestv as (select * from (select *, row_number() over (partition by left_id, right_id order by verdict = 'SUPPORTED' desc, evidence_strength desc, created_at desc) as rn
    from v_verdicts where verdict in ('SUPPORTED', 'PLAUSIBLE')) where rn = 1)"""
# components in SQL by repeated minimum over the links, to a fixed point
_COMP = """e{n} as (select a, b from {src} union select b, a from {src}),
    reach{n} as (select a as node, a as label from e{n} union select e.b, r.label from reach{n} r join e{n} e on e.a = r.node where r.label < e.b),
    comp{n} as (select node, min(label) as component from reach{n} group by node)"""


def _sparse(v):
    """The same verdicts with records spread wider, so that components stay apart."""
    return v.verdicts.withColumns({"left_id": F.concat(F.lit("gdelt:"), (F.col("id") * 7 % 90001).cast("string")),
                                   "right_id": F.concat(F.lit("adsb:"), (F.col("id") * 13 % 70001).cast("string"))})


_SPARSE = """sparse as (select id, concat('gdelt:', id * 7 % 90001) as left_id, concat('adsb:', id * 13 % 70001) as right_id, left_kind, right_kind, verdict, evidence_strength, created_at, left_group, right_group from v_verdicts),
    bests as (select * from (select *, row_number() over (partition by left_id, right_id order by verdict = 'SUPPORTED' desc, evidence_strength desc, created_at desc) as rn from sparse where verdict in ('SUPPORTED', 'PLAUSIBLE')) where rn = 1)"""


_MEMBERS = _COMP.format(n="1", src="(select left_id as a, right_id as b from bests)")
_SOURCES = """links as (select distinct a, b from (select 'record:' || left_id as a, left_group as b from sparse union all select 'record:' || right_id, right_group from sparse) where b is not null),
    shared_ as (select distinct x.b as a, y.b as b from links x join links y on x.a = y.a),
    reach2 as (select a as node, a as label from shared_ union select g.b, r.label from reach2 r join shared_ g on g.a = r.node where r.label < g.b),
    groups_ as (select node, min(label) as c from reach2 group by node), placed2 as (select l.a, l.b, g.c from links l join groups_ g on g.node = l.b),
    named2 as (select c, least(min(a), min(b)) as source from placed2 group by c),
    sources as (select distinct substring(p.a, 8) as record_id, n.source from placed2 p join named2 n using (c))"""


@query("g03_clusters_of_records", "v_verdicts", f"with {_SPARSE}, {_MEMBERS} select node, component from comp1")
def _(v):
    return verdicts.cluster_members(verdicts.best_per_pair(_sparse(v)))


@query("g04_sources_of_records", "v_verdicts", f"with {_SPARSE}, {_SOURCES} select record_id, source from sources")
def _(v):
    return verdicts.provenance(_sparse(v))


@query("g04_provenance", "v_verdicts", f"""with {_SPARSE}, links as (select distinct a, b from (select 'record:' || left_id as a, left_group as b from sparse union all select 'record:' || right_id, right_group from sparse)),
    sizes as (select b, count(*) as n from links group by b) select count(distinct a) as n_records, count(distinct b) as n_groups from links""")
def _(v):
    s = _sparse(v)
    p = verdicts.provenance(s)
    groups = s.select("left_group").union(s.select("right_group")).distinct()
    return p.agg(F.count_distinct("record_id").alias("n_records")).withColumn("n_groups", groups.agg(F.count(F.lit(1)).alias("n")).scalar())


@query("a28_cluster_scores", "v_verdicts", f"""with {_SPARSE}, {_MEMBERS}, {_SOURCES},
    linked as (select m.component, b.*, coalesce(x.source, 'record:' || b.left_id) as ls, coalesce(y.source, 'record:' || b.right_id) as rs from bests b join comp1 m on m.node = b.left_id
        left join sources x on x.record_id = b.left_id left join sources y on y.record_id = b.right_id),
    by_source as (select component, least(ls, rs) as p, greatest(ls, rs) as q, max(evidence_strength) as s from linked group by 1, 2, 3),
    strength as (select component, coalesce(avg(s) filter (where p <> q), avg(s)) as strength, count(*) filter (where p <> q) as n from by_source group by 1),
    kinds as (select distinct component, node, kind from (select left_id as node, left_kind as kind from bests union all select right_id, right_kind from bests) join comp1 using (node)),
    size_ as (select component, count(distinct node) as n_records, count(distinct coalesce(source, 'record:' || node)) as n_sources, count(distinct kind) as modalities from kinds left join sources on record_id = node group by 1),
    review as (select component, bool_or(verdict = 'PLAUSIBLE') as needs_review from linked group by 1)
    select component, {rnd('least(1.0e0, 0.18e0 * modalities + 0.55e0 * strength + 0.05e0 * least(n, 4))', 3)} as score, n_records, n_sources, needs_review from size_ join strength using (component) join review using (component)""")
def _(v):
    return verdicts.clusters(_sparse(v)).select("component", "score", "n_records", "n_sources", "needs_review")


_ENT = """ents as (select id, left_id, right_id, case when id % 4 = 0 then 'gdelt:other' when id % 2 = 0 then left_id else right_id end as rid, case id % 3 when 0 then 'PERSON' when 1 then 'VEHICLE' else 'COUNTRY' end as ty,
    case when id % 11 = 0 then ' ' else concat(' blue star ', id % 50) end as nm from v_verdicts)"""


@query("g05_resolved_entities", "v_verdicts", f"""with {_ENT} select rid as src, concat(case when ty = 'VEHICLE' then 'entity:VEHICLE:' else 'actor:' end, upper(trim(nm))) as dst, id as assessment_id
    from ents where rid in (left_id, right_id) and trim(nm) <> ''""")
def _(v):
    n = F.col("id")
    e = F.struct(F.when(n % 4 == 0, "gdelt:other").when(n % 2 == 0, F.col("left_id")).otherwise(F.col("right_id")).alias("record_id"),
                 F.when(n % 11 == 0, " ").otherwise(F.concat(F.lit(" blue star "), (n % 50).cast("string"))).alias("canonical_name"),
                 F.when(n % 3 == 0, "PERSON").when(n % 3 == 1, "VEHICLE").otherwise("COUNTRY").alias("entity_type"), F.lit(0.5).alias("confidence"))
    return verdicts.resolved_entity_edges(v.verdicts.withColumn("resolved_entities", F.array(e))).select("src", "dst", "assessment_id")


# ---- graph ---------------------------------------------------------------------------------------

_RESOLVED = """case when raw is null or raw = 'Government' then null when raw in ('U.S.') then 'UNITED STATES' when raw = 'Kyiv' then 'UKRAINE' when raw = 'Tehran' then 'IRAN' when raw = 'Moscow' then 'RUSSIA' else upper(raw) end"""
_EDGES = f"""names as (select id, actor1 as raw from v_news union all select id, actor2 from v_news union all select id, unnest(persons) from v_news union all select id, unnest(orgs) from v_news),
    edges as (select id as src, concat('loc:', {rnd('lat', 1)}, ',', {rnd('lon', 1)}) as dst, 'LOCATED_AT' as kind from v_news
        union all select id, concat('src:', source_domain), 'REPORTED_BY' from v_news
        union all select id, concat('actor:', {_RESOLVED}), 'INVOLVES' from names where {_RESOLVED} is not null)"""


@query("g01_event_edges", "v_news", f"with {_EDGES} select src, dst, kind from edges")
def _(v):
    return graph.event_edges(v.news)


@query("g06_graph_stats", "v_news v_points", f"""with {_EDGES} select concat('edge:', kind) as measure, count(*) as n from edges group by 1
    union all select 'node:event', count(distinct id) from v_news union all select 'node:location', count(distinct dst) from edges where kind = 'LOCATED_AT'
    union all select 'node:source', count(distinct dst) from edges where kind = 'REPORTED_BY' union all select 'node:actor', count(distinct dst) from edges where kind = 'INVOLVES'
    union all select 'node:aircraft', count(distinct hex) from v_points""")
def _(v):
    return graph.graph_stats(graph.base_nodes(v.news, v.points), graph.event_edges(v.news))


@query("k05_graph_upsert", "v_news", f"""with rows_ as (select concat('loc:', {rnd('lat', 1)}, ',', {rnd('lon', 1)}) as id, place as label, cast(floor(t / 86400) as bigint) as batch from v_news)
    select id, max(batch) as batch from rows_ group by id""")
def _(v):
    from geoweave.functions.news import location_id
    rows = v.news.select(location_id(F.col("lat"), F.col("lon")).alias("id"), F.col("place").alias("label"), F.floor(F.col("t") / 86400).alias("batch"))
    old, new = rows.filter(F.col("batch") % 2 == 0), rows.filter(F.col("batch") % 2 != 0)
    once = graph.upsert(old, new)
    return graph.upsert(once, new).select("id", "batch")


@query("k06_fusion_artefacts", "v_verdicts", "select concat('assessment:', id) as src, left_id as dst, 'left' as role from v_verdicts union all select concat('assessment:', id), right_id, 'right' from v_verdicts")
def _(v):
    return graph.verdict_edges(v.verdicts).select("src", "dst", "role")


@query("k07_prune", "v_points v_verdicts", """with o as (select concat(floor(t / 86400), '|', hex) as id, case when floor(t / 86400) % 2 = 0 then concat('replay:', floor(t / 86400)) else concat('live:', floor(t / 86400)) end as batch, t from v_points),
    alive as (select * from o where t >= 1705312800 or batch like 'replay:%'), e as (select distinct 'NEAR' as kind, id as observation_id, batch from o union all select distinct 'CO_LOCATED', id, batch from o)
    select kind, observation_id, batch from e where (kind = 'NEAR' and observation_id in (select id from alive)) or (kind = 'CO_LOCATED' and batch in (select batch from alive))""")
def _(v):
    day = F.floor(F.col("t") / 86400)
    text = day.cast("double").cast("string")
    o = v.points.select(F.concat(text, F.lit("|"), "hex").alias("id"), F.concat(F.when(day % 2 == 0, "replay:").otherwise("live:"), text).alias("batch"), "t")
    once = o.select(F.col("id").alias("observation_id"), "batch").distinct()
    e = once.withColumn("kind", F.lit("NEAR")).unionByName(once.withColumn("kind", F.lit("CO_LOCATED")))
    return graph.prune(o, e, 1705312800.0)[1].select("kind", "observation_id", "batch")


@query("j15_entity_neighbourhood", "v_news", f"""with {_EDGES} select distinct src as neighbour, kind from edges where dst = 'actor:IRAN' order by kind, src limit 250""")
def _(v):
    edges = graph.event_edges(v.news, once=True)
    return graph.neighbourhood(edges, graph.base_nodes(v.news), "actor:IRAN", 250).select("neighbour", "kind")


@query("j16_asserted_context", "v_news v_points", f"""with {_EDGES}, once as (select distinct src, dst, kind from edges),
    both_ways as (select src as id, dst as other, kind, 'outgoing' as direction from once union all select dst, src, kind, 'incoming' from once),
    ranked as (select *, row_number() over (partition by id order by kind, direction, other) as rn from both_ways) select id, other, kind, direction from ranked where rn <= 30""")
def _(v):
    nodes = graph.base_nodes(v.news)
    return graph.asserted_context(nodes, graph.event_edges(v.news), nodes, 30).select("id", "other", "kind", "direction")


@query("l02_bounded_graph", "v_news v_points")
def _(v):
    near = proximity.NearLinks(v.news, v.points, 75.0, 240.0)
    out = graph.bounded_graph(near, proximity.co_located(v.points), graph.event_edges(v.news, once=True))
    return out.select("src", "dst", "kind", "tier")


@query("l02_trimmed_graph", "v_news v_points")
def _(v):
    ends = proximity.near_ends(v.news, v.points, 75.0, 240.0)
    return graph.trimmed_graph(graph.event_edges(v.news), graph.base_nodes(v.news, v.points), graph.actor_mentions(v.news), near_ends=ends)


@query("l01_top_lists", "v_news v_verdicts", f"""(select id, t as rank from v_news order by t desc, id limit 3000)
    union all (select cast(id as varchar), evidence_strength from v_verdicts where verdict in ('SUPPORTED', 'PLAUSIBLE') order by evidence_strength desc, id limit 300)""")
def _(v):
    from geoweave.operators.filters import visible_verdicts
    newest = v.news.orderBy(F.col("t").desc(), "id").limit(3000).select("id", F.col("t").alias("rank"))
    best = visible_verdicts(v.verdicts.withColumn("same_article", F.lit(False))).orderBy(F.col("evidence_strength").desc(), "id").limit(300)
    return newest.unionByName(best.select(F.col("id").cast("string"), F.col("evidence_strength").alias("rank")))


@query("u04_set_intersection", VIEWS, f"with {FACTS} select l_id, r_id from scored where tier = 'entity'")
def _(v):
    return candidates_of(v).filter("match_type = 'entity'").select("l_id", "r_id")
