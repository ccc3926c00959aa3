"""Joins against brute force, with skew handling forced on."""

import math
import random

from pyspark.sql import functions as F

from geoweave.operators import aoi, joins, proximity, tracks
from geoweave.operators.components import connected_components


def km(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


def test_radius_join_on_the_whole_sphere_with_hot_block(spark):
    rng = random.Random(3)

    def place(i):
        if i % 3 == 0:
            return 26.0 + rng.random() / 5, 56.0 + rng.random() / 5  # a third of the rows in one block
        return (rng.choice([rng.uniform(-90, 90), 89.5 + rng.random() / 2, -89.9]), rng.choice([rng.uniform(-180, 180), 179.9, -179.95]))

    left = [(f"l{i}", *place(i), rng.uniform(0, 9000)) for i in range(150)]
    right = [(f"r{i}", *place(i), rng.uniform(0, 9000)) for i in range(300)]
    l = spark.createDataFrame(left, "l_id string, l_lat double, l_lon double, l_t double")
    r = spark.createDataFrame(right, "r_id string, r_lat double, r_lon double, r_t double")
    want = {(a[0], b[0]) for a in left for b in right if km(a[1], a[2], b[1], b[2]) <= 80 and abs(a[3] - b[3]) <= 1800}
    for options in ({}, {"work": 40}):
        got = [tuple(x) for x in joins.radius_join(l, r, 80.0, 30.0, **options).select("l_id", "r_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_near_join_grids_change_nothing(spark):
    rng = random.Random(4)
    l = spark.createDataFrame([(f"e{i}", 26 + rng.random(), 56 + rng.random(), rng.uniform(0, 9000)) for i in range(60)], "l_id string, l_lat double, l_lon double, l_t double")
    r = spark.createDataFrame([(f"a{i}", 26 + rng.random(), 56 + rng.random(), rng.uniform(0, 9000)) for i in range(200)], "r_id string, r_lat double, r_lon double, r_t double")
    plain = sorted(map(tuple, joins.near_join(l, r, 40, 60).select("l_id", "r_id").collect()))
    for work in (50, 1000):
        assert sorted(map(tuple, joins.near_join(l, r, 40, 60, work=work).select("l_id", "r_id").collect())) == plain and plain


def test_hot_blocks_become_grids_on_either_side(spark):
    """A block with a hot probe side, one with a hot build side, one with both: no grid field tests more than about the bound."""
    sizes = {"probe": (3000, 2), "build": (1, 4000), "both": (300, 400), "cool": (20, 30)}
    p = spark.createDataFrame([(k, i) for k, (n, _) in sizes.items() for i in range(n)], "k string, p int")
    b = spark.createDataFrame([(k, i) for k, (_, n) in sizes.items() for i in range(n)], "k string, b int")
    grid = {r.k: (r._cuts_p, r._cuts_b) for r in joins.block_work(p, b, ["k"], 1000).collect()}
    assert set(grid) == {"probe", "build", "both"} and grid["probe"][0] > 1 and grid["probe"][1] <= 2 and grid["build"] == (1, 4)
    for k, (cuts_p, cuts_b) in grid.items():
        n, m = sizes[k]
        assert math.ceil(n / cuts_p) * math.ceil(m / cuts_b) <= 1.5 * 1000
    # repeated rows stay few: about the square root of the fields on each side where both are large
    n, m = sizes["both"]
    assert n * grid["both"][1] + m * grid["both"][0] <= 2.2 * math.sqrt(120 * n * m)
    got = joins.balanced_join(p, b, ["k"], work=1000)
    assert got.count() == sum(n * m for n, m in sizes.values()) == got.distinct().count()


def test_carry_forward_over_segments(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < .7 else "b", float(i * 977), rng.choice([None, None, i])) for i in range(200)]
    got = {(r.hex, r.t): r.v for r in tracks.carry_forward(spark.createDataFrame(rows, "hex string, t double, v int"), ["v"]).collect()}
    last = {}
    for h, t, x in rows:
        last[h] = x if x is not None else last.get(h)
        assert got[h, t] == last[h]


def test_numbering_over_segments(spark):
    rows = [("a", float(i * 5000), float(i), 0.0) for i in range(50)] + [("b", 3.0, 1.0, 1.0)]
    got = {(r.hex, r.t): (r.rn, r.n_points) for r in tracks.numbered(spark.createDataFrame(rows, "hex string, t double, lat double, lon double")).collect()}
    assert all(got["a", i * 5000.0] == (i, 50) for i in range(50)) and got["b", 3.0] == (0, 1)


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"h{i}") for i in range(60)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[root(a)] = root(b)
    groups = {}
    for n in list(parent):
        groups.setdefault(root(n), set()).add(n)
    want = {n: min(g) for g in groups.values() for n in g}
    assert dict(map(tuple, connected_components(spark.createDataFrame(edges, "a string, b string")).collect())) == want


def test_batches_break_at_the_budget(spark):
    rng = random.Random(8)
    rows = [(r, "k", f"{i:04d}", "x" * rng.choice([0, 3, 9, 20, 47, 48, 90])) for r, n in (("r", 400), ("s", 1), ("t", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "region_id string, kind string, id string, body string")
    got = {(r.region_id, r.id): (r.batch, r["size"]) for r in aoi.size_batches(df, 50, F.length("body") + 3).collect()}
    at = {}
    for region, _, i, body in sorted(rows):
        batch, used = at.get(region, (0, 0))
        n = len(body) + 3
        at[region] = (batch + 1, n) if used and used + n > 50 else (batch, used + n)
        assert got[region, i] == (at[region][0], n)
    assert aoi.size_batches(df.limit(0), 50, F.length("body") + 3).count() == 0


def test_co_located_pairs_next_five(spark):
    ids = sorted(f"{k:03x}" + c for k in range(7) for c in "ab")
    df = spark.createDataFrame([(h, 26.5, 56.5, True) for h in ids], "hex string, lat double, lon double, military boolean")
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, min(len(ids), i + 6))}
    assert {(r.a[5:], r.b[5:]) for r in proximity.co_located(df).collect()} == want


def test_alerts_ignore_curated_rows(spark):
    from geoweave.sources.curated import curated_ids, leaked
    events = spark.createDataFrame([("e1", 0.0, 26.0, 56.0, "Strait", 4, "19", -8.0, -3.0, 10, True)], "id string, t double, lat double, lon double, place string, geo_type int, root_code string, goldstein double, tone double, num_mentions int, is_conflict boolean")
    craft = spark.createDataFrame([("h1", 60.0, 26.1, 56.1, True, 5000, None, None)], "hex string, t double, lat double, lon double, military boolean, alt_ft int, emergency string, squawk string")
    found = proximity.alerts(events, craft)
    row = found.first()
    assert row.reason == "military aircraft; low altitude 5000 ft; conflict-coded event (Fight); Goldstein -8.0"
    seed = spark.createDataFrame([("imo:1", "1")], "id string, imo string")
    assert leaked(found, curated_ids(seed, seed, seed)).count() == 0


def test_asof_at_many_instants_with_a_frequent_aircraft(spark):
    rng = random.Random(12)
    rows = [("hot" if rng.random() < 0.6 else f"h{rng.randrange(6)}", float(rng.randrange(0, 60000, 7)), 1.0 + rng.randrange(5), 2.0, i) for i in range(600)]
    at = sorted({float(rng.randrange(0, 61000, 10)) for _ in range(150)})
    points = spark.createDataFrame(rows, "hex string, t double, lat double, lon double, n int")
    instants = spark.createDataFrame([(a,) for a in at], "at double")
    want = {}
    for a in at:
        for h, t, lat, lon, n in rows:
            if a - 300 <= t <= a:
                want[a, h] = max(want.get((a, h), (-1.0,)), (t, lat, lon, n))
    for work in (joins.BLOCK_WORK, 20):
        got = joins.asof_snapshots(points, instants, work=work).collect()
        assert {(r.at, r.hex): (r.t, r.lat, r.lon, r.n) for r in got} == want and len(got) == len(want)


def test_first_post_of_a_file_is_the_first_line(spark, tmp_path):
    from geoweave.sources.social import merge_post_files, placed_posts
    for name, rows in {"a": [("p1", "z"), ("p1", "a"), ("p2", "m")], "b": [("p2", "b"), ("p3", "y"), ("p3", "x")]}.items():
        (tmp_path / f"{name}.json").write_text("\n".join(f'{{"id": "{i}", "text": "{t}", "lat": 1.0}}' for i, t in rows))
    parts = [placed_posts(spark.read.schema("id string, text string, lat double").json(str(tmp_path / f"{n}.json"))) for n in "ab"]
    assert {r.id: r.text for r in merge_post_files(parts, "place").collect()} == {"p1": "z", "p2": "m", "p3": "y"}


def test_phrases_meet_texts_without_shuffling_them(spark):
    rng = random.Random(21)
    words = ["gulf", "of", "oman", "the", "ship", "émir"]
    texts = [(i, " " + " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) + " ") for i in range(60)] + [(60, None)]
    phrases = ["the", "gulf of oman", "of the", "émir", "oman oman", "nowhere", "the nowhere", " "]
    df = spark.createDataFrame(texts, "rid int, text_norm string").withColumn("tokens", F.array_distinct(F.filter(F.split("text_norm", " "), lambda w: w != "")))
    table = spark.createDataFrame([(p,) for p in phrases * 2], "phrase string")
    want = sorted((i, p) for i, t in texts if t for p in phrases if p.strip() and f" {p} " in t)
    small, large = joins.phrase_hits(df, table), joins.phrase_hits(df, table, broadcast_bytes=0)
    assert sorted(map(tuple, small.collect())) == want == sorted(map(tuple, large.collect()))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(rid" not in plan and "BroadcastHashJoin [token" in plan


def test_batches_are_found_in_chunks(spark, monkeypatch):
    rng = random.Random(31)
    sizes = {"mixed": [rng.choice([0, 3, 9, 20, 47, 48, 90]) for _ in range(130)], "still": [0] * 40 + [60] + [0] * 25, "single": [50], "own": [51] * 28, "full": [25] * 14}
    rows = [(r, "k", f"{i:04d}", n) for r, ns in sizes.items() for i, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "region_id string, kind string, id string, n int")
    want = {}
    for region, ns in sizes.items():
        batch, used, held = 0, 0, 0
        for i, n in enumerate(ns):
            batch, used, held = (batch + 1, n, 1) if held and used + n > 50 else (batch, used + n, held + 1)
            want[region, f"{i:04d}"] = batch
    for chunk in (7, 4096):
        got = aoi.size_batches(df, 50, F.col("n"), chunk=chunk).collect()
        assert {(r.region_id, r.id): r.batch for r in got} == want and len(got) == len(rows)
    # a table is written for every round: none are needed for the batches of one chunk
    written, real = [], aoi.cut_lineage
    monkeypatch.setattr(aoi, "cut_lineage", lambda t: written.append(1) or real(t))
    aoi.size_batches(df, 50, F.col("n"))
    assert len(written) <= 7
