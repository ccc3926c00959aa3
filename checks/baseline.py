"""Baseline chain, integrity and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import query
from checks.text import DEGRADED, cell, rnd
from checks.views import T0, T1
from geoweave.functions.geo import round_to
from geoweave.operators import baseline as bl
from geoweave.operators import navint
from geoweave.session import cut_lineage

WINDOW = bl.BinWindow(T0, T1)
AT = T0 + 200 * 3600 + 10
SPAN = (T0 + 5 * 3600.0, T0 + 650 * 3600.0)


def events_of(v):
    social = v.posts.select("id", "t", "lat", "lon", "url", F.lit(False).alias("is_conflict"), F.lit(True).alias("is_social"))
    return v.news.select("id", "t", "lat", "lon", "url", "is_conflict", "is_social").unionByName(social)


def keys_of(v):
    return bl.stream_keys(WINDOW, events_of(v), v.points, v.firms)


def counts_of(v):
    return bl.stream_counts(keys_of(v))


def scores_of(v, span=None):
    def build():
        return cut_lineage(bl.robust_scores(bl.dense_series(counts_of(v), WINDOW, span), WINDOW))
    return v.shared(f"scores {span}", build)


KEYS = f"""marks as (select id, t, lat, lon, url, is_conflict, false as social from v_news union all select id, t, lat, lon, url, false, true from v_posts),
    spots as (select 'social' as stream, t, lat, lon, id as key, false as deg from marks where social
        union all select 'news', t, lat, lon, url, false from marks where not social
        union all select 'conflict', t, lat, lon, url, false from marks where not social and is_conflict
        union all select 'tracks', t, lat, lon, hex, false from v_points union all select 'military', t, lat, lon, hex, false from v_points where military
        union all select 'navint', t, lat, lon, hex, {DEGRADED} from v_points where {DEGRADED} is not null
        union all select 'firms_new', t, lat, lon, id, false from v_firms where novelty >= 0.9),
    placed as (select stream, {cell('lat')} as row, {cell('lon')} as col, cast(floor((t - {T0}) / 3600) as int) as bin, key, deg from spots
        where t >= {T0} and t < {T0} + 720 * 3600)"""
COUNTS = """counts as (select stream, row, col, bin, count(distinct key) as n, count(distinct case when deg then key end) as d from placed group by all)"""
STREAM_ROWS = "streams(stream) as (values ('news'), ('conflict'), ('social'), ('tracks'), ('military'), ('firms_new'), ('navint'))"
GRID = f"""{STREAM_ROWS}, bins as (select cast(range as int) as bin from range(720)), cells as (select distinct row, col from counts),
    covered as (select distinct c.row + dr as row, c.col + dc as col, c.bin from counts c, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc)
        where c.stream = 'tracks' and {SPAN[0]} <= {T0} + c.bin * 3600 + 3599 and {T0} + c.bin * 3600 <= {SPAN[1]}),
    grid as (select s.stream, c.row, c.col, b.bin, case when s.stream = 'navint' then k.d / cast(k.n as double)
            when s.stream in ('tracks', 'military') and @OUT@ then null else coalesce(k.n, 0) * 1e0 end as v,
        case when s.stream = 'navint' then coalesce(k.n, 0) when s.stream in ('tracks', 'military') and @OUT@ then 0 end as cov
        from streams s cross join cells c cross join bins b
        left join counts k on k.stream = s.stream and k.row = c.row and k.col = c.col and k.bin = b.bin
        left join covered w on w.row = c.row and w.col = c.col and w.bin = b.bin)"""
REFS = """offsets as (select b.bin, d.range * 24 + b.bin % 24 + o.o as ref from bins b, range(30) d, (values (-3), (-2), (-1), (0), (1), (2)) o(o)
        where b.bin % 24 + o.o between 0 and 23 and ((d.range < b.bin // 24 and o.o between -2 and 2) or (d.range = b.bin // 24 and o.o in (-3, -2))))"""
STATS = """refv as (select g.stream, g.row, g.col, g.bin, r.v as x from grid g join offsets o on o.bin = g.bin
        join grid r on r.stream = g.stream and r.row = g.row and r.col = g.col and r.bin = o.ref where r.v is not null),
    meds as (select stream, row, col, bin, count(*) as k, median(x) as med from refv group by all),
    mads as (select v.stream, v.row, v.col, v.bin, any_value(m.k) as k, any_value(m.med) as med, median(abs(v.x - m.med)) * 1.4826e0 as mad
        from refv v join meds m using (stream, row, col, bin) group by v.stream, v.row, v.col, v.bin),
    scored as (select g.*, coalesce(m.k, 0) as k, m.med, case when g.stream = 'navint' then greatest(mad, 5e-2) else greatest(mad, sqrt(med + 1)) end as scale
        from grid g left join mads m using (stream, row, col, bin)),
    zs as (select *, case when k >= 4 then (v - med) / scale end as z from scored),
    flagged as (select *, coalesce(z >= 2, false) as hit from zs),
    runs as (select *, bin - coalesce(max(case when not hit then bin end) over w, -1) as run,
        coalesce(lag(hit) over (partition by stream, row, col order by bin), false) as was from flagged
        window w as (partition by stream, row, col order by bin rows between unbounded preceding and current row)),
    states as (select *, case when z is null or (stream = 'navint' and cov < 15) then 'insufficient' when hit and run >= 3 then 'persistent'
        when hit then 'new_change' when was then 'recovering' else 'normal' end as state from runs)"""


def chain(out="false"):
    return f"with {KEYS}, {COUNTS}, {GRID.replace('@OUT@', out)}, {REFS}, {STATS}"


VIEWS = "v_news v_posts v_points v_firms"


@query("a01_stream_counts", VIEWS, f"with {KEYS}, {COUNTS} select stream, row, col, bin, n from counts where stream <> 'navint'")
def _(v):
    return counts_of(v).filter("stream <> 'navint'").select("stream", "row", "col", "bin", "n")


@query("a02_navint_fraction", VIEWS, f"with {KEYS}, {COUNTS} select row, col, bin, n as known, d as degraded, {rnd('d / cast(n as double)', 3)} as frac from counts where stream = 'navint'")
def _(v):
    return navint.integrity_series(v.points, WINDOW).select("row", "col", "bin", "known", "degraded", "frac")


@query("a03_navint_window", "v_points", f"""with k as (select {cell('lat')} as row, {cell('lon')} as col, hex, bool_or({DEGRADED}) as deg from v_points
    where t between {T0} + 360000 and {T0} + 720000 and {DEGRADED} is not null group by all)
    select row, col, count(*) as known, count(*) filter (where deg) as degraded, {rnd("count(*) filter (where deg) / cast(count(*) as double)", 3)} as frac,
        case when count(*) < 15 then 'insufficient' else 'adequate' end as coverage from k group by row, col""")
def _(v):
    return navint.integrity_window(v.points, T0 + 360000, T0 + 720000).select("row", "col", "known", "degraded", "frac", "coverage")


@query("a04_navint_totals", "v_points", f"""select cast(floor((t - {T0}) / 900) as int) as bin, count(distinct hex) as known,
    count(distinct case when {DEGRADED} then hex end) as degraded from v_points where {DEGRADED} is not null group by 1""")
def _(v):
    return navint.integrity_totals(v.points, bl.BinWindow(T0, T1, 900.0)).select("bin", "known", "degraded")


@query("a05_dense_series", VIEWS, f"with {KEYS}, {COUNTS}, {GRID.replace('@OUT@', 'w.bin is null')} select stream, row, col, bin, {rnd('v', 6)} as v, cast(cov as bigint) as cov from grid")
def _(v):
    s = bl.dense_series(counts_of(v), WINDOW, SPAN)
    rows = s.select("stream", "row", "col", F.posexplode(F.arrays_zip("vals", "cov")).alias("bin", "s"))
    return rows.select("stream", "row", "col", "bin", round_to(F.col("s.vals"), 6).alias("v"), F.col("s.cov").alias("cov"))


@query("a06_reference_bins", VIEWS, f"""with {KEYS}, {COUNTS}, {GRID.replace('@OUT@', 'false')}, {REFS}
    select stream, row, col, g.bin, count(r) as n, {rnd('coalesce(sum(r), 0)', 4)} as total from (select g.stream, g.row, g.col, g.bin, x.v as r
        from grid g left join offsets o on o.bin = g.bin left join grid x on x.stream = g.stream and x.row = g.row and x.col = g.col and x.bin = o.ref) g group by all""")
def _(v):
    bins = F.explode(F.sequence(F.lit(0), F.lit(WINDOW.n - 1))).alias("bin")
    rows = bl.dense_series(counts_of(v), WINDOW).select("stream", "row", "col", "vals", bins)
    rows = rows.withColumn("r", F.filter(F.expr(bl.reference_slices(WINDOW, "bin")), lambda x: x.isNotNull()))
    total = F.aggregate("r", F.lit(0.0), lambda a, x: a + x)
    return rows.select("stream", "row", "col", "bin", F.size("r").cast("bigint").alias("n"), round_to(total, 4).alias("total"))


@query("a07_robust_z", VIEWS, f"{chain('w.bin is null')} select stream, row, col, bin, {rnd('z', 2)} as z, cast(k as int) as reference_n, {rnd('med', 3)} as median from states where state <> 'insufficient'")
def _(v):
    return scores_of(v, SPAN).filter("state <> 'insufficient'").select("stream", "row", "col", "bin", "z", "reference_n", "median")


@query("a08_states", VIEWS, f"{chain('w.bin is null')} select stream, row, col, bin, state from states")
def _(v):
    return scores_of(v, SPAN).select("stream", "row", "col", "bin", "state")


@query("a09_departures_at", VIEWS, f"""{chain()} select stream, row, col, bin, {rnd('z', 2)} as z, state, ((row = 25 and col = 55) or (row = 24 and col = 54)) as expected_cooccurrence
    from states where bin = 199 and state in ('new_change', 'persistent', 'recovering')""")
def _(v):
    return bl.departures_at(scores_of(v), WINDOW, AT).select("stream", "row", "col", "bin", "z", "state", "expected_cooccurrence")


DEPARTED = """families as (select bin, row, col, count(distinct case stream when 'conflict' then 'news' else stream end) as families from states
    where state in ('new_change', 'persistent') and stream <> 'tracks' group by all),
    departed as (select * from families where families >= case when (row = 25 and col = 55) or (row = 24 and col = 54) then 2 else 1 end)"""


@query("a10_departed_cells", VIEWS, f"{chain()}, {DEPARTED} select bin, row, col, families from departed")
def _(v):
    return bl.departed_cells(scores_of(v)).select("bin", "row", "col", "families")


TOTALS = f"""{STREAM_ROWS}, bins as (select cast(range as int) as bin from range(720)),
    totals as (select stream, bin, count(distinct key) as n, count(distinct case when deg then key end) as d from placed group by all),
    grid as (select s.stream, 0 as row, 0 as col, b.bin, coalesce(case when s.stream = 'navint' then d / cast(n as double) else n * 1e0 end, 0) as v, null as cov
        from streams s cross join bins b left join totals t on t.stream = s.stream and t.bin = b.bin)"""


@query("a11_total_z", VIEWS, f"with {KEYS}, {TOTALS}, {REFS}, {STATS} select stream, bin, {rnd('z', 2)} as z from zs")
def _(v):
    return bl.total_z(keys_of(v), WINDOW).select("stream", "bin", "z")


@query("j18_reference_pairs", VIEWS, f"""with {KEYS}, {COUNTS}, bins as (select cast(range as int) as bin from range(720)), {REFS}
    select o.bin, count(*) as n_refs, sum(coalesce(c.n, 0))::bigint as n_seen from offsets o left join (select bin, count(*) as n from counts group by bin) c on c.bin = o.ref group by o.bin""")
def _(v):
    seen = counts_of(v).groupBy(F.col("bin").alias("ref_bin")).agg(F.count(F.lit(1)).alias("n"))
    pairs = bl.reference_pairs(v.spark, WINDOW).join(seen, "ref_bin", "left")
    return pairs.groupBy("bin").agg(F.count(F.lit(1)).alias("n_refs"), F.sum(F.coalesce("n", F.lit(0))).alias("n_seen"))


@query("w01_run_length", VIEWS, f"""{chain()} select stream, state, count(*) as n from states group by 1, 2""")
def _(v):
    return scores_of(v).groupBy("stream", "state").agg(F.count(F.lit(1)).alias("n"))


@query("p07_departed_gate", VIEWS, f"""{chain()}, {DEPARTED}, hot as (select distinct row + dr as row, col + dc as col from departed, (values (-1), (0), (1)) a(dr), (values (-1), (0), (1)) b(dc))
    select id from v_news n where split_part(id, ':', 2)::bigint % 7 <> 0 and exists (select 1 from hot where row = {cell('n.lat')} and col = {cell('n.lon')})""")
def _(v):
    from geoweave.operators.filters import departed_gate
    cells = bl.departed_cells(scores_of(v))
    place = F.when(F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint") % 7 == 0, F.lit("Doha harbour")).otherwise(F.col("place"))
    records = v.news.withColumns({"kind": F.lit("gdelt"), "label": F.concat(F.lit("Fight: "), place)})
    return departed_gate(records, cells).select("id")


@query("j10_hot_cell_records", VIEWS, f"""{chain()}, {DEPARTED}, hot as (select distinct bin, row, col from departed)
    select hex, t from v_points p where exists (select 1 from hot where bin = cast(floor((p.t - {T0}) / 3600) as int) and row = {cell('p.lat')} and col = {cell('p.lon')})""")
def _(v):
    from geoweave.functions.geo import with_cell
    cells = bl.departed_cells(scores_of(v)).select("bin", "row", "col")
    placed = with_cell(v.points.withColumn("bin", WINDOW.bin_of(F.col("t"))))
    return placed.join(cells, ["bin", "row", "col"], "left_semi").select("hex", "t")
