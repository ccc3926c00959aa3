"""Near pairs where they are made: alerts of positions, ends without pairs, shared cells in grids, and the stream of pairs over several batches."""

import math

import pytest
from pyspark.sql import functions as F
from test_alert_ranks import _feeds

from geoweave.operators import graph, proximity
from geoweave.streaming.tables import NearPairs, SeenMemory


@pytest.mark.parametrize("work", [500, 4_000_000])
def test_alerts_of_positions_are_the_best_pairs(spark, work):
    events, points = _feeds(spark)
    times = events.select(F.col("id").alias("event_id"), F.col("t").alias("_t"))
    pairs = proximity.near_pairs(events, points, 75.0, 60.0).join(times, "event_id").filter("_t <= aircraft_t")
    best = {}
    for r in pairs.collect():
        key = (r.aircraft_t, r.aircraft_id, math.floor(r.lat * 10 + 0.5), math.floor(r.lon * 10 + 0.5))
        best[key] = min(best.get(key, (9.0, "")), (-r.score, r.event_id))
    got = proximity.alerts_of_positions(events, points, 75.0, 60.0, work=work)
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.t, r.aircraft_id, r.event_id, r.score) for r in got.collect()) == sorted((k[0], k[1], e, -s) for k, (s, e) in best.items()) and best
    counts = {r.t: r.n for r in proximity.alerts_per_instant(events, points, 75.0, 60.0, work=work).collect()}
    assert counts == {t: sum(k[0] == t for k in best) for t in {k[0] for k in best}}


def test_ends_of_pairs_without_pairs(spark):
    events, points = _feeds(spark)
    pairs = proximity.near_pairs(events, points, 20.0, 2.0).collect()
    ends = proximity.near_ends(events, points, 20.0, 2.0)
    assert "LeftSemi" in ends._jdf.queryExecution().optimizedPlan().toString()
    assert {r.id for r in ends.collect()} == {r.event_id for r in pairs} | {r.aircraft_id for r in pairs} and ends.count() == len({r.id for r in ends.collect()})


def test_a_crowded_cell_is_cut(spark):
    craft = spark.range(120).select(F.concat(F.lit("h"), "id").alias("hex"), F.lit(25.5).alias("lat"), F.lit(55.5).alias("lon"), (F.col("id") % 2 == 0).alias("military"))
    got = proximity.co_located_all(craft, work=200)
    ids = sorted(f"adsb:h{i}" for i in range(0, 120, 2))
    assert sorted((r.a, r.b) for r in got.collect()) == [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]]
    assert "_grid_b" in got._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("most", [1, 3, 4, 7, 60])
def test_bounded_graph_takes_nodes_by_first_links_ties_included(spark, most):
    near = spark.createDataFrame([(f"a{i % 5}", f"e{i % 7}", (i % 3) / 10) for i in range(20)], "src string, dst string, score double")
    shared = spark.createDataFrame([(f"a{i}", f"b{i}") for i in range(6)], "a string, b string")
    base = spark.createDataFrame([(f"e{i}", f"p{i % 3}", "AT") for i in range(9)], "src string, dst string, kind string")
    links = [(0, -r.score, r.src, r.dst, "NEAR") for r in near.collect()] + [(1, 0.0, r.a, r.b, "CO_LOCATED") for r in shared.collect()] + [(2, 0.0, r.src, r.dst, r.kind) for r in base.collect()]
    first = {}
    for t, k, s, d, _ in links:
        for side, i in enumerate((s, d)):
            first[i] = min(first.get(i, (9,)), (t, k, s, d, side))
    kept = {i for _, i in sorted((f, i) for i, f in first.items())[:most]}
    out = graph.bounded_graph(near, shared, base, max_nodes=most, max_links=1000)
    assert sorted((r.tier, r.rank, r.src, r.dst, r.kind) for r in out.collect()) == sorted(x for x in links if x[2] in kept and x[3] in kept)


def test_limited_neighbourhood_skips_unknown_ids(spark):
    edges = spark.createDataFrame([(f"e{i:03d}", "hub", "K") for i in range(40)], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(f"e{i:03d}", "event", "x") for i in range(0, 40, 5)], "id string, kind string, label string")
    assert [r.neighbour for r in graph.neighbourhood(edges, nodes, "hub", 3).collect()] == ["e000", "e005", "e010"]
    assert graph.neighbourhood(edges, nodes, "hub", 30).count() == 8 == graph.neighbourhood(edges, nodes, "hub").count()


def test_near_pairs_over_batches(spark, tmp_path):
    events, points = _feeds(spark)
    severe = events.filter("id is not null")
    rows = severe.select(F.lit(True).alias("news"), "id", "t", "lat", "lon").unionByName(points.select(F.lit(False).alias("news"), F.concat(F.lit("adsb:"), "hex").alias("id"), "t", "lat", "lon"))
    near = NearPairs(str(tmp_path / "near"), 75.0, 20.0, 600.0)
    for k in (0, 1, 2, 2):  # the last batch comes twice
        near.apply(rows.filter(F.col("t").between(3000 * k, 3000 * k + 2999)), k)
    left, right = severe.selectExpr("id as event_id", "lat as l_lat", "lon as l_lon", "t as l_t"), points.selectExpr("concat('adsb:', hex) as aircraft_id", "lat as r_lat", "lon as r_lon", "t as r_t")
    from geoweave.operators.joins import near_join
    want = sorted(map(tuple, near_join(left, right, 75.0, 20.0, right_id="aircraft_id").select("event_id", "aircraft_id", "km").collect()))
    assert sorted(map(tuple, near.read(spark).collect())) == want and len(want) > 100


def test_seen_memory_over_batches(spark, tmp_path):
    hours = [("steady", h) for h in range(0, 120, 6)] + [("gap", h) for h in (0, 12, 42, 48)] + [("twice", 60), ("twice", 60)]
    memory = SeenMemory(str(tmp_path / "seen"), "id", 86400.0)
    for k, h in enumerate([*range(0, 120, 6), 114]):
        rows = [(i, 1.7e9 + 3600.0 * x) for i, x in hours if h <= x < h + 6]
        memory.apply(spark.createDataFrame(rows, "id string, t double"), min(k, 19))
    assert sorted((r.id, (r.t - 1.7e9) / 3600) for r in memory.read(spark, "id string, t double").collect()) == [("gap", 0.0), ("gap", 42.0), ("steady", 0.0), ("twice", 60.0)]


def test_bounded_graph_makes_the_strongest_pairs_only(spark):
    events, points = _feeds(spark)
    shared = spark.createDataFrame([("adsb:h0", "adsb:h1")], "a string, b string")
    base = spark.createDataFrame([("e0", "p", "AT"), ("e3", "p", "AT")], "src string, dst string, kind string")
    links = proximity.NearLinks(events, points, 75.0, 60.0)
    every = {(r.src, r.dst, r.score) for r in links.all().collect()}
    pairs = proximity.near_pairs(events, points, 75.0, 60.0)
    assert every == {(r.aircraft_id, r.event_id, r.score) for r in pairs.collect()}
    few, enough = links.strongest(3)
    few = {(r.src, r.dst, r.score) for r in few.collect()}
    assert enough and 0 < len(few) < len(every) / 4 and few == {x for x in every if x[2] >= min(f[2] for f in few)}
    plain = pairs.select(F.col("aircraft_id").alias("src"), F.col("event_id").alias("dst"), "score")
    for most in (3, 10 ** 4):
        mine, want = (sorted(map(tuple, graph.bounded_graph(n, shared, base, max_nodes=most, max_links=10 ** 6).collect())) for n in (links, plain))
        assert mine == want and want
