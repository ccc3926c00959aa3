"""Incident operators against SQL over the same chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.baseline import COUNTS, DEPARTED, GRID, KEYS, REFS, STATS, VIEWS, WINDOW
from checks.registry import query
from checks.text import cell, rnd
from checks.views import T0
from geoweave.fixed_values import EXPLANATIONS, STREAMS
from geoweave.operators import incidents as inc
from geoweave.plans.analysis import Analysis


def events_of(v):
    none = F.array().cast("array<string>")
    post = v.posts.select("id", "t", "lat", "lon", "url", F.lit(False).alias("is_conflict"), F.lit(True).alias("is_social"), F.lit(None).cast("string").alias("place"),
                          F.lit("Social post").alias("root_label"), none.alias("themes"), none.alias("persons"), none.alias("orgs"))
    news = v.news.select("id", "t", "lat", "lon", "url", "is_conflict", "is_social", "place", F.col("root_code").alias("root_label"), "themes", "persons", "orgs")
    return news.unionByName(post)


def analysis_of(v) -> Analysis:
    return v.shared("analysis", lambda: Analysis(WINDOW, events_of(v), v.points, v.firms))


def components_of(v):
    return analysis_of(v).components


_AROUND = "(values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc)"
_RINGED = f"cells as (select distinct row + dr as row, col + dc as col from counts, {_AROUND})"
CHAIN = f"with {KEYS}, {COUNTS}, {GRID.replace('@OUT@', 'false').replace('cells as (select distinct row, col from counts)', _RINGED)}, {REFS}, {STATS}, {DEPARTED}"
COMPONENTS = """nodes as (select bin, row, col, (cast(bin as bigint) * 181 + row + 90) * 361 + col + 180 as node from departed),
    touching as (select a.node as x, b.node as y from nodes a join nodes b on a.bin = b.bin and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
    reach as (select node as x, node as label from nodes union select t.y, r.label from reach r join touching t on t.x = r.x),
    comps as (select n.bin, n.row, n.col, min(r.label) as component from nodes n join reach r on r.x = n.node group by n.bin, n.row, n.col)"""
RING = f"""ring as (select component, bin, row + dr as row, col + dc as col, max(dr = 0 and dc = 0) as own from comps, {_AROUND} group by all),
    around as (select r.component, r.own, s.*, s.state in ('new_change', 'persistent') as dep, {rnd('s.z', 2)} as zr, coalesce(case when s.state = 'insufficient' then s.v else {rnd('s.v', 3)} end, 0) as shown
        from ring r join states s on s.bin = r.bin and s.row = r.row and s.col = r.col),
    st as (select component, bin, stream, bool_or(dep) as departed, bool_or(state <> 'insufficient') as adequate from around group by all),
    bests as (select * from (select *, row_number() over (partition by component, stream order by zr desc, row, col) as rn from around where dep) where rn = 1)"""


@query("g02_cell_components", VIEWS, f"{CHAIN}, {COMPONENTS} select bin, row, col, component from comps")
def _(v):
    return components_of(v).select("bin", "row", "col", "component")


@query("i01_stream_states", VIEWS, f"""{CHAIN}, {COMPONENTS}, {RING},
    kept as (select * from (select *, row_number() over (partition by component, stream order by state <> 'insufficient' desc, own desc, k desc, coalesce(cov, 0) desc, shown desc, row, col) as rn from around) where rn = 1)
    select st.component, st.stream, st.departed, st.adequate, coalesce(b.row, kept.row) as row, coalesce(b.col, kept.col) as col, coalesce(b.state, kept.state) as state,
        coalesce(b.zr, case when kept.state = 'insufficient' then null else kept.zr end) as z
    from st left join bests b using (component, stream) join kept using (component, stream)""")
def _(v):
    return analysis_of(v).states.select("component", "stream", "departed", "adequate", "detail.row", "detail.col", "detail.state", "detail.z")


_TEXT = "lower(concat_ws(' ', place, root_code, array_to_string(themes, ' '), array_to_string(persons, ' '), array_to_string(orgs, ' ')))"
_SPOKEN = f"""spoken as (select cast(floor((t - {T0}) / 3600) as int) as bin, {cell('lat')} as row, {cell('lon')} as col, {_TEXT} as body from v_news
        union all select cast(floor((t - {T0}) / 3600) as int), {cell('lat')}, {cell('lon')}, 'social post' from v_posts),
    words as (select r.component, count(*) as n, count(*) filter (where regexp_matches(body, 'vessel|tanker|ship|strait|hormuz|projectile|attack')) as sea,
        count(*) filter (where regexp_matches(body, 'missile|drone|airspace|notam|strike')) as air from ring r join spoken s using (bin, row, col) group by 1)"""
_PRIOR = """firsts as (select component, arg_min(stream, case stream when 'tracks' then 0 when 'military' then 1 when 'firms_new' then 2 else 3 end) as stream from st
        where departed and stream in ('tracks', 'military', 'firms_new', 'navint') group by component),
    sums as (select c.component, c.bin, sum(coalesce(x.v, 0)) as now_v, sum(coalesce(y.v, 0)) as before_v from comps c join firsts f using (component)
        join grid x on x.stream = f.stream and x.row = c.row and x.col = c.col and x.bin = c.bin left join grid y on y.stream = f.stream and y.row = c.row and y.col = c.col and y.bin = c.bin - 24 group by 1, 2),
    prior as (select component, case when bin < 24 then 'untested' when now_v > 0 and before_v >= 0.6e0 * now_v then 'supported' else 'contradicted' end as status from sums)"""
_DROP = """now_sum as (select component, any_value(bin) as bin, sum(coalesce(v, 0)) as n from around where stream = 'tracks' group by 1),
    ref_sum as (select r.component, o.ref, sum(coalesce(g.v, 0)) as s from ring r join offsets o on o.bin = r.bin join grid g on g.stream = 'tracks' and g.row = r.row and g.col = r.col and g.bin = o.ref group by 1, 2),
    typical as (select component, count(*) as k, median(s) as med from ref_sum group by 1),
    drops as (select n.component, case when coalesce(k, 0) < 4 or med <= 0 then 'untested' when n < 0.5e0 * med then 'supported' else 'contradicted' end as status from now_sum n left join typical using (component))"""
_PREDS = """templates(tpl, pos, prediction) as (values (0, 0, 'departed:navint'), (0, 1, 'departed:military'), (0, 2, 'keywords:sea'), (0, 3, 'departed:news'), (1, 0, 'departed:military'), (1, 1, 'departed:navint'), (1, 2, 'keywords:air'),
        (1, 3, 'departed:social'), (2, 0, 'departed:news'), (2, 1, 'quiet:military'), (2, 2, 'quiet:navint'), (2, 3, 'quiet:firms_new'), (3, 0, 'prior_day_same'), (3, 1, 'quiet:news'), (4, 0, 'coverage_drop:tracks')),
    tested as (select g.component, t.tpl, t.pos, case when prediction like 'departed:%' then case when st.departed then 'supported' when st.adequate then 'contradicted' else 'untested' end
            when prediction like 'quiet:%' then case when st.departed then 'contradicted' when st.adequate then 'supported' else 'untested' end
            when prediction = 'keywords:sea' then case when coalesce(w.n, 0) = 0 then 'untested' when w.sea > 0 then 'supported' else 'contradicted' end
            when prediction = 'keywords:air' then case when coalesce(w.n, 0) = 0 then 'untested' when w.air > 0 then 'supported' else 'contradicted' end
            when prediction = 'prior_day_same' then coalesce(p.status, 'untested') else coalesce(d.status, 'untested') end as status,
            starts_with(prediction, 'quiet:') as quiet, case prediction when 'keywords:sea' then 'keywords:vessel|tanker|ship|strait|hormuz|projectile|attack' when 'keywords:air' then 'keywords:missile|drone|airspace|notam|strike' else prediction end as prediction
        from (select distinct component from comps) g cross join templates t left join st on st.component = g.component and st.stream = split_part(prediction, ':', 2)
        left join words w on w.component = g.component left join prior p on p.component = g.component left join drops d on d.component = g.component),
    told as (select component, tpl, count(*) filter (where status = 'supported') as s, count(*) filter (where status = 'contradicted') as c, count(*) as n, count(*) filter (where status = 'untested' and not quiet) = 0 as ok from tested group by 1, 2),
    placed_ as (select *, row_number() over (partition by component order by ok desc, s - 2 * c desc, s / cast(n as double) desc, c, tpl) as place from told)"""
_TITLE = "case tpl " + " ".join(f"when {i} then '{e[1]}'" for i, e in enumerate(EXPLANATIONS)) + " end"
_STREAM_ORDER = "case stream " + " ".join(f"when '{s}' then {i}" for i, s in enumerate(STREAMS)) + " end"
FULL = f"{CHAIN}, {COMPONENTS}, {RING}, {_SPOKEN}, {_PRIOR}, {_DROP}, {_PREDS}"


@query("a19_keywords_present", VIEWS, f"{CHAIN}, {COMPONENTS}, {RING}, {_SPOKEN} select component, n, sea::bigint as sea, air::bigint as air from words")
def _(v):
    c = components_of(v)
    k = inc.keywords_present(c, events_of(v), WINDOW, inc.keyword_sets())
    sea, air = list(inc.keyword_sets())
    return k.groupBy("component").agg(F.max("n").alias("n"), F.max(F.when(F.col("prediction") == sea, F.col("hits"))).alias("sea"), F.max(F.when(F.col("prediction") == air, F.col("hits"))).alias("air"))


@query("a20_prior_day_same", VIEWS, f"{CHAIN}, {COMPONENTS}, {RING}, {_PRIOR} select component, status from prior")
def _(v):
    a = analysis_of(v)
    return inc.prior_day_same(a.components, a.states, a.scores, WINDOW)


@query("a21_coverage_drop", VIEWS, f"{CHAIN}, {COMPONENTS}, {RING}, {_DROP} select component, status from drops")
def _(v):
    a = analysis_of(v)
    return inc.coverage_drop(a.components, a.series, WINDOW)


@query("i02_predictions", VIEWS, f"{FULL} select component, tpl, pos, prediction, status from tested")
def _(v):
    return analysis_of(v).predictions.select("component", "tpl", "pos", "prediction", "status")


@query("i03_explanation_rank", VIEWS, f"{FULL} select component, tpl, s as supported, c as contradicted, ok as eligible, cast(place as int) as place from placed_")
def _(v):
    return analysis_of(v).ranked.select("component", "tpl", "supported", "contradicted", "eligible", "place")


@query("i04_next_check", VIEWS, f"""{FULL}, shared as (select component, prediction, count(*) as k from tested where status = 'untested' group by 1, 2),
    best_shared as (select * from (select *, row_number() over (partition by component order by k desc, prediction desc) as rn from shared) where rn = 1),
    leads as (select component, tpl, c from placed_ where place = 1), seconds as (select component, tpl from placed_ where place = 2),
    unmet as (select s.component, arg_min(t.prediction, t.pos) as p from seconds s join tested t on t.component = s.component and t.tpl = s.tpl where status <> 'supported' group by 1),
    against as (select l.component, arg_min(t.prediction, t.pos) as p from leads l join tested t on t.component = l.component and t.tpl = l.tpl where status = 'contradicted' group by 1),
    picked as (select l.component, coalesce(b.prediction, case when l.c = 0 then u.p else a.p end) as prediction, coalesce(b.k, 1) as separates from leads l left join best_shared b using (component)
        left join unmet u using (component) left join against a using (component))
    select component, prediction, separates from picked where prediction is not null""")
def _(v):
    return analysis_of(v).next_checks.select("component", "prediction", "separates")


_ROWS = f"""marks2 as (select id, t, cast(floor((t - {T0}) / 3600) as int) as bin, {cell('lat')} as row, {cell('lon')} as col, regexp_replace(url, '^https://www\\.([^?]*)\\?.*id=(\\d+)$', 'https://\\1?id=\\2') as k, false as social, is_conflict from v_news
        union all select id, t, cast(floor((t - {T0}) / 3600) as int), {cell('lat')}, {cell('lon')}, id, true, false from v_posts),
    scope as (select component, bin, row, col, min(nb) as nb from (select component, bin, row, col, false as nb from comps union all
        select component, bin, row, col, true from bests where stream in ('news', 'conflict', 'social')) group by 1, 2, 3, 4),
    rolled as (select s.component, m.k, case when bool_or(social) then 'social' when bool_or(is_conflict) then 'conflict' else 'news' end as stream, count(*) as mentions, min(m.t) as t, arg_min(m.id, m.t) as id
        from scope s join marks2 m using (bin, row, col) group by 1, 2),
    numbered as (select *, count(*) over (partition by component) as total, row_number() over (partition by component, stream order by t desc, id) as rn from rolled)"""


@query("a17_evidence_rollup", VIEWS, f"{CHAIN}, {COMPONENTS}, {RING}, {_ROWS} select component, stream, id, t, mentions, total from numbered")
def _(v):
    return analysis_of(v).evidence.select("component", "stream", "id", "t", "mentions", "total")


@query("w07_evidence_cap", VIEWS, f"{CHAIN}, {COMPONENTS}, {RING}, {_ROWS} select component, stream, count(*) as n, max(rn)::int as last_rn from numbered where rn <= 2 group by 1, 2")
def _(v):
    a = analysis_of(v)
    rows = inc.evidence_rollup(a.components, a.states, a.events, WINDOW, per_stream=2)
    return rows.groupBy("component", "stream").agg(F.count(F.lit(1)).alias("n"), F.max("rn").alias("last_rn"))


@query("a18_place", VIEWS, f"""{CHAIN}, {COMPONENTS}, said as (select cast(floor((t - {T0}) / 3600) as int) as bin, {cell('lat')} as row, {cell('lon')} as col, place from v_news),
    c as (select component, place, count(*) as n from comps k join said s on s.row = k.row and s.col = k.col and s.bin in (k.bin, k.bin - 1) group by 1, 2)
    select component, place from (select *, row_number() over (partition by component order by n desc, place) as rn from c) where rn = 1""")
def _(v):
    return inc.most_reported_place(components_of(v), events_of(v), WINDOW)


def _turns(name: str, takers: str, offers: str) -> str:
    """CTEs that let takers(grp, k, taker) choose in order of k from offers(taker, thing, o): {name}(grp, k, taker, got)."""
    return f"""{name}_l as (select t.grp, t.k, t.taker, coalesce(l.things, []) as things from {takers} t left join (select taker, list(thing order by o) as things from {offers} group by taker) l on l.taker = t.taker),
    {name}_r as (select grp, k, taker, things[1] as got, case when len(things) > 0 then [things[1]] else [] end as used from {name}_l where k = 1
        union all select l.grp, l.k, l.taker, list_filter(l.things, lambda x: not list_contains(r.used, x))[1], list_concat(r.used, list_filter(l.things, lambda x: not list_contains(r.used, x))[1:1])
        from {name}_r r join {name}_l l on l.grp = r.grp and l.k = r.k + 1),
    {name} as (select grp, k, taker, got from {name}_r)"""


TRACKED = f"""{CHAIN}, {COMPONENTS}, {RING}, cs as (select component, bin, list([row, col] order by row, col) as cells from comps group by 1, 2),
    touch1 as (select distinct a.component as a, b.component as b from comps a join comps b on b.bin = a.bin + 1 and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
    quiet as (select component, bin from cs where component not in (select a from touch1)),
    touch2 as (select distinct a.component as a, b.component as b from quiet q join comps a on a.component = q.component join comps b on b.bin = a.bin + 2 and abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1),
    asks as (select b as taker, a as thing, a as o from touch1 union all select b, a, a + 1000000000000 from touch2),
    order_ as (select bin as grp, row_number() over (partition by bin order by component) as k, component as taker from cs),
    {_turns('took', 'order_', 'asks')},
    chain as (select taker as component, taker as incident, grp as first_bin from took where got is null union all select t.taker, c.incident, c.first_bin from chain c join took t on t.got = c.component),
    pers as (select component, bool_or(state = 'persistent') as p from bests group by 1),
    tracked as (select c.incident, c.first_bin, t.taker as component, t.grp as bin, case when t.got is not null and p.p then 'persistent' else 'new_change' end as state from took t join chain c on c.component = t.taker left join pers p on p.component = t.taker
        union all select c.incident, c.first_bin, q.component, q.bin + 1, 'recovering' from quiet q join chain c using (component) where q.bin + 1 < {WINDOW.n}),
    gone_ as (select component, list(stream order by {_STREAM_ORDER}) as dep from st where departed group by 1),
    inc_ as (select 'incident:' || t.incident as incident_id, t.*, s.cells, coalesce(g.dep, []) as dep from tracked t join cs s using (component) left join gone_ g using (component))"""
REVISED = f"""lead_ as (select component, {_TITLE} as title from placed_ where place = 1),
    lagged as (select i.*, lag(dep) over w as dep0, lag(cells) over w as cells0, l.title from inc_ i left join lead_ l using (component) window w as (partition by incident_id order by bin)),
    steps as (select *, case when state = 'recovering' then [] when dep0 is null then dep else list_filter(dep, lambda x: not list_contains(dep0, x)) end as added,
        case when state = 'recovering' then dep when dep0 is null then [] else list_filter(dep0, lambda x: not list_contains(dep, x)) end as lost from lagged),
    revised as (select incident_id, bin, added, lost, len(cells) as n_cells, case when state <> 'recovering' then title end as lead_title from steps
        where dep0 is null or state = 'recovering' or len(added) > 0 or len(lost) > 0 or cells <> cells0)"""
_AT = f"cast({T0} + 3600 * bin as double)"
_WITH_TITLES = TRACKED.replace(RING, f"{RING}, {_SPOKEN}, {_PRIOR}, {_DROP}, {_PREDS}")


@query("i05_incident_tracks", VIEWS, f"{TRACKED} select incident_id, component, bin, state, cast({T0} + 3600 * first_bin as double) as first_t, {_AT} as last_t from inc_")
def _(v):
    return analysis_of(v).incidents.select("incident_id", "component", "bin", "state", "first_t", "last_t")


@query("i06_revisions", VIEWS, f"{_WITH_TITLES}, {REVISED} select incident_id, {_AT} as t, array_to_string(added, ',') as added, array_to_string(lost, ',') as gone, cast(n_cells as int) as n_cells, lead_title as \"leading\" from revised")
def _(v):
    return analysis_of(v).revisions.select("incident_id", "t", F.array_join("added", ",").alias("added"), F.array_join("gone", ",").alias("gone"), "n_cells", "leading")


@query("u03_stream_changes", VIEWS, f"{_WITH_TITLES}, {REVISED} select {_AT} as t, cast(sum(len(added)) as bigint) as n_added, cast(sum(len(lost)) as bigint) as n_gone from revised group by bin")
def _(v):
    return analysis_of(v).revisions.groupBy("t").agg(F.sum(F.size("added")).alias("n_added"), F.sum(F.size("gone")).alias("n_gone"))


_NEAR = "exists (select 1 from unnest(a.cells) x(c), unnest(b.cells) y(c) where abs(x.c[1] - y.c[1]) <= 1 and abs(x.c[2] - y.c[2]) <= 1)"


@query("i07_durable_ids", VIEWS, f"""{_WITH_TITLES}, {REVISED}, final as (select max(bin) as bin from inc_),
    was as (select i.*, row_number() over (order by state = 'recovering', component) as k from inc_ i, final f where i.bin = f.bin - 1),
    now_ as (select i.*, row_number() over (order by state = 'recovering', component) as k from inc_ i, final f where i.bin = f.bin),
    asks2 as (select a.k as taker, b.k as thing, b.k as o from now_ a, was b where {_NEAR}), order2 as (select 0 as grp, k, k as taker from now_), {_turns('claim', 'order2', 'asks2')},
    fresh as (select taker, row_number() over (order by taker) + (select count(*) from was) as id from claim where got is null),
    hist as (select a.k, count(*) filter (where r.bin <= a.bin) as n, min(r.bin) as b0 from now_ a join revised r using (incident_id) group by 1),
    hist0 as (select b.k, r.bin from was b join revised r on r.incident_id = b.incident_id and r.bin <= b.bin),
    out_ as (select a.incident_id, coalesce(c.got, f.id) as id, a.k as place, a.cells, least(a.first_bin, coalesce(b.first_bin, a.first_bin)) as first_bin, a.bin,
        coalesce(h.n, 0) + (select count(*) from hist0 o where o.k = c.got and o.bin < coalesce(h.b0, a.bin + 2)) as n
        from now_ a join claim c on c.taker = a.k left join fresh f on f.taker = a.k left join was b on b.k = c.got left join hist h on h.k = a.k
        union all select null, b.k, (select count(*) from now_) + row_number() over (order by b.k), b.cells, b.first_bin, b.bin, (select count(*) from hist0 o where o.k = b.k) from was b where b.k not in (select got from claim where got is not null))
    select incident_id, 'incident:' || lpad(cast(id as varchar), 4, '0') as durable_id, cast(place as bigint) as place, cast({T0} + 3600 * first_bin as double) as first_t, cast({T0} + 3600 * (bin + 1) + 10 as double) as last_t,
        cast(len(cells) as int) as n_cells, cast(n as int) as n_revisions from out_""")
def _(v):
    """Two rebuilds, one bin apart: the second goes on from what the first stored."""
    a = analysis_of(v)
    last = _last_instant(a)
    store = v.spark.createDataFrame([], inc.STORED)
    for t in (last - WINDOW.step, last):
        store = a.durable(t, store)
    return store.select("incident_id", "durable_id", "place", "first_t", "last_t", F.size("cells").alias("n_cells"), F.size("revisions").alias("n_revisions"))


def _last_instant(a) -> float:
    """Just after the last bin that has an incident: one number, to ask for that moment."""
    return WINDOW.t_min + (a.incidents.agg(F.max("bin")).first()[0] + 1) * WINDOW.step + 10


@query("i08_assessments", VIEWS)
def _(v):
    return analysis_of(v).assessments.drop("changes")


@query("f32_headlines", VIEWS)
def _(v):
    return analysis_of(v).assessments.select("component", "headline", "question", "next_source")


@query("l03_incident_order", VIEWS, f"{TRACKED} select incident_id, bin, state, cast(len(dep) as int) as n from inc_")
def _(v):
    a = analysis_of(v)
    return inc.display_order(a.incidents).select("incident_id", "bin", "state", F.size("departed").alias("n"))


@query("q04_incidents_snapshot", VIEWS)
def _(v):
    a = analysis_of(v)
    return a.snapshot(_last_instant(a)).select("incident_id", "state", "established", "headline", "question")
