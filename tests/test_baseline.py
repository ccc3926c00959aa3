"""Baseline counts, robust states and incidents: seeded data against short brute-force versions."""

import random
import statistics
import zlib

from pyspark.sql import functions as F

from geoweave.operators import baseline as bl
from geoweave.operators import incidents as inc
from geoweave.operators.components import cell_components
from geoweave.operators.matching import first_come
from geoweave.plans.analysis import Analysis

START, DAYS, BINS = 1_700_006_400.0, 3, 72  # a UTC midnight
SPAN = bl.BinWindow(START, START + DAYS * 86400 - 1)
NEWS = "id string, t double, lat double, lon double, url string, is_conflict boolean, is_social boolean, place string, root_label string, themes array<string>, persons array<string>, orgs array<string>"
TRACKS = "hex string, t double, lat double, lon double, military boolean, nic int, nac_p int"
HEAT = "id string, t double, lat double, lon double, novelty double"


def story(name, bin_, cell, url, conflict=False, social=False, themes=(), label="Consult"):
    return (name, START + 3600 * bin_ + zlib.crc32(url.encode()) % 3600, cell[0] + 0.2, cell[1] + 0.7, url, conflict, social, "Harbour", label, list(themes), [], [])


def seeded_news(seed, cells, surges):
    """Poisson-like article counts per cell and hour, with repeats of addresses, and `surges` {(cell, bin): extra articles}."""
    rng, rows = random.Random(seed), []
    for cell in cells:
        for b in range(BINS):
            for k in range(sum(rng.random() < 0.35 for _ in range(9)) + surges.get((cell, b), 0)):
                url = f"https://paper.example/{cell[0]}-{cell[1]}/{b}/{k}"
                rows += [story(f"n{len(rows) + r}", b, cell, url) for r in range(rng.choice((1, 1, 3)))]
    return rows


def brute_states(values):
    """The state of every bin of one count series: median and scaled deviation of the same hours of earlier days and of the hours just before."""
    states, runs, before = [], 0, False
    for b, v in enumerate(values):
        day, hour = divmod(b, 24)
        reference = [values[d * 24 + h] for d in range(day) for h in range(max(hour - 2, 0), min(hour + 2, 23) + 1)]
        reference += [values[day * 24 + h] for h in (hour - 3, hour - 2) if h >= 0]
        if len(reference) < bl.MIN_REFERENCE:
            states.append("insufficient")
            runs, before = 0, False
            continue
        middle = statistics.median(reference)
        spread = max(statistics.median(abs(x - middle) for x in reference) * bl.MAD_SCALE, (middle + 1) ** 0.5)
        hit = (v - middle) / spread >= bl.Z_THRESHOLD
        runs = runs + 1 if hit else 0
        states.append("persistent" if runs >= bl.PERSISTENT_BINS else "new_change" if hit else "recovering" if before else "normal")
        before = hit
    return states


def test_states_of_news_equal_brute_force(spark):
    cells = [(41, 12), (41, 13), (-7, 100)]
    rows = seeded_news(11, cells, {(cells[0], 50): 15, (cells[0], 51): 15, (cells[0], 52): 15, (cells[2], 60): 9})
    got = {}
    for r in bl.baseline_scores(SPAN, spark.createDataFrame(rows, NEWS), None).filter("stream = 'news'").collect():
        got.setdefault((r.row, r.col), {})[r.bin] = (r.raw_value, r.state)
    articles = {}
    for r in rows:
        articles.setdefault(((int(r[2] // 1), int(r[3] // 1)), int((r[1] - START) // 3600)), set()).add(r[4])
    for cell in cells:
        values = [len(articles.get((cell, b), ())) for b in range(BINS)]
        assert [got[cell][b] for b in range(BINS)] == list(zip(values, brute_states(values)))
    assert {"new_change", "persistent", "recovering"} <= {s for _, s in got[cells[0]].values()}


def test_navigation_needs_enough_reporters(spark):
    rng = random.Random(3)
    rows = [(f"x{b}-{k}", START + 3600 * b + 30 * k, 10.5, -3.5, False, 2 if b == 55 and k < n else 9, 9) for b in range(BINS) for n in [40 if b % 2 else 3] for k in range(n)]
    rng.shuffle(rows)
    s = {r.bin: r for r in bl.baseline_scores(SPAN, None, spark.createDataFrame(rows, TRACKS)).filter("stream = 'navint' and row = 10 and col = -4").collect()}
    assert s[55].state == "new_change" and s[55].raw_value == 1.0 and s[55].coverage == 40
    assert {s[b].state for b in range(30, BINS, 2)} == {"insufficient"} and {s[b].state for b in range(57, BINS, 2)} == {"normal"}


def test_analysis_joins_streams_to_one_incident(spark):
    cell = (33, 34)
    calm = seeded_news(21, [cell], {})
    loud = [story(f"c{k}", 54, cell, f"https://wire.example/{k}", conflict=True, label="Coerce") for k in range(18)]
    flights = [(f"m{b}-{k}", START + 3600 * b + 20 * k, 33.5, 34.5, True, 9, 9) for b in range(BINS) for k in range(22 if 53 <= b <= 55 else 3)]
    a = Analysis(SPAN, spark.createDataFrame(calm + loud, NEWS), spark.createDataFrame(flights, TRACKS), spark.createDataFrame([], HEAT))
    rows = {r.bin: r for r in a.incidents.collect() if 50 <= r.bin <= 60}
    assert len({rows[b].incident_id for b in (53, 54, 55)}) == 1 and rows[53].state == "new_change"
    assert "military" in rows[53].departed and "conflict" not in rows[53].departed and "conflict" in rows[54].departed
    evidence = a.evidence.collect()
    assert {r.url for r in evidence if r.stream == "conflict"} == {f"https://wire.example/{k}" for k in range(18)}  # all of them, not a first few
    assert a.ranked.filter("bin = 54").count() > 0


def touch(a, b):
    return any(abs(x["row"] - y["row"]) <= 1 and abs(x["col"] - y["col"]) <= 1 for x in a for y in b)


def by_turns(takers, things, touches):
    """{taker: thing}: takers in order, each the first thing in order that it touches and that is free."""
    got = {}
    for a in takers:
        got.update({a: x for x in [next((x for x in things if x not in got.values() and touches(a, x)), None)] if x is not None})
    return got


def test_tracking_equals_walking_the_bins(spark):
    """Random cells over 30 bins: matching all bins at once gives what one pass over the bins gives."""
    rng = random.Random(5)
    cells = {(b, rng.randrange(9), rng.randrange(9)) for b in range(30) for _ in range(rng.randrange(7))}
    comps = cell_components(spark.createDataFrame(sorted(cells), "bin int, row bigint, col bigint"))
    rows = comps.groupBy("component", "bin").agg(F.array_sort(F.collect_list(F.struct("row", "col"))).alias("cells"), (F.max("row") % 2 == 0).alias("persistent"))
    window = bl.BinWindow(0, 30 * 3600 - 1)
    got = sorted(map(tuple, inc.track_incidents(rows, window).select("incident", "component", "bin", "state", "first_bin").collect()))
    known = {r.component: r for r in rows.collect()}
    of = {b: sorted(c for c, r in known.items() if r.bin == b) for b in range(-2, 31)}
    meets = lambda a, x: touch(known[a].cells, known[x].cells)
    quiet = {b: [c for c in of[b] if not any(meets(d, c) for d in of[b + 1])] for b in range(-2, 30)}
    came, want = {}, []
    for b in range(30):
        came.update(by_turns(of[b], of[b - 1] + quiet[b - 2], meets))
        first = lambda c: first(came[c]) if c in came else c
        want += [(first(c), c, b, "persistent" if c in came and known[c].persistent else "new_change", known[first(c)].bin) for c in of[b]]
        want += [(first(c), c, b, "recovering", known[first(c)].bin) for c in quiet[b - 1]]
    assert got == sorted(want) and len(got) > 40 and len({g[0] for g in got}) < len(known)


def test_durable_ids_feed_themselves(spark):
    """Six rebuilds, each on the result of the last, against turns taken in plain Python."""
    rng = random.Random(9)
    shape = "incident_id string, component bigint, state string, cells array<struct<row:bigint,col:bigint>>, first_t double, revisions array<struct<t:double,added:array<string>,gone:array<string>,n_cells:int,leading:string>>"
    store, mine, high = spark.createDataFrame([], inc.STORED), [], 0
    for run in range(6):
        now = 7200.0 * run if run < 5 else 7200.0 * 4 + 6.5 * 3600
        rows = [(f"i{run}-{k}", k, rng.choice(["new_change", "recovering"]), [{"row": rng.randrange(8), "col": rng.randrange(8)} for _ in range(2)], now - 3600.0 * (k % 3),
                 [(now - 3600.0 * (k % 3), ["news"], [], 2, None)]) for k in range(7)]
        store = inc.durable_ids(spark.createDataFrame(rows, shape), store, now, most_revisions=3)
        turns = sorted(rows, key=lambda r: (r[2] == "recovering", r[1]))
        recent = [m for m in mine if now - m["last"] <= 6 * 3600]
        got = by_turns(range(len(turns)), range(len(recent)), lambda a, x: touch(turns[a][3], recent[x]["cells"]))
        fresh = []
        for k, r in enumerate(turns):
            old = recent[got[k]] if k in got else None
            high += old is None
            fresh.append({"i": r[0], "id": old["id"] if old else f"incident:{high:04d}", "cells": r[3], "first": min(r[4], old["first"]) if old else r[4], "last": now,
                          "rev": ([x for x in old["rev"] if x < r[5][0][0]] if old else [])[-2:] + [r[5][0][0]]})
        mine = fresh + [{**m, "i": None} for k, m in enumerate(recent) if k not in got.values()]
        out = sorted(store.collect(), key=lambda r: r.place)
        assert [(r.incident_id, r.durable_id, r.first_t, r.last_t, [x.t for x in r.revisions]) for r in out] == [(m["i"], m["id"], m["first"], m["last"], m["rev"]) for m in mine]
        store = spark.createDataFrame(store.drop("incident_id").collect(), inc.STORED)


def test_turns_in_one_crowded_group(spark):
    rng = random.Random(2)
    offers = sorted({(a, x) for a in range(120) for x in rng.sample(range(100), rng.randrange(1, 12))})
    got = dict(map(tuple, first_come(spark.createDataFrame([(a, x, (x * 37) % 100) for a, x in offers], "taker int, taken int, rank int")).collect()))
    want = by_turns(range(120), sorted(range(100), key=lambda x: (x * 37) % 100), lambda a, x: (a, x) in set(offers))
    assert got == want and len(got) > 80


def test_series_read_the_events_once_and_are_spread(spark):
    rows = seeded_news(5, [(41, 12), (41, 13), (-7, 100)], {})
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(t):
        read.add(1)
        return t

    events = spark.createDataFrame(rows, NEWS).withColumn("t", counted.asNondeterministic()("t"))
    series = Analysis(SPAN, events, spark.createDataFrame([], TRACKS), spark.createDataFrame([], HEAT)).series
    assert read.value == len(rows)
    assert len(series.inputFiles()) == int(spark.conf.get("spark.sql.shuffle.partitions"))
