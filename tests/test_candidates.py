"""Candidate retrieval on generated records, each expectation worked out by a plain function of the test."""

import itertools
import math
import random

import pytest

from geoweave.functions.text import RECORD_FIELDS
from geoweave.operators import candidates as cand

NOW = 1_690_000_000.0
FIRST, LAST = ("Ilse", "Tomas", "Noor", "Petra", "Olu"), ("Varga", "Lindqvist", "Okafor", "Moreau", "Hadzic")
SHIPS = ("Saga Fortuna", "Polar Wind", "Estrela do Mar", "Kestrel Venture")


def table(spark, rows):
    names = ["id", "kind", "label", "t", "lat", "lon", *RECORD_FIELDS]
    schema = "id string, kind string, label string, t double, lat double, lon double, " + ", ".join(f"{n} {t}" for n, t in RECORD_FIELDS.items())
    filled = [{"label": "-", "t": NOW, "lat": -12.0, "lon": 44.0} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in filled], schema)


def matches(spark, rows):
    return {(r.l_id, r.r_id): r for r in cand.candidate_pairs(cand.retrieval_table(table(spark, rows))).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_sharing_a_full_name(spark, seed):
    rng = random.Random(seed)
    rows = [{"id": f"r{i:02d}", "kind": "gdelt", "geo_type": 4, "url": f"https://daily.example/{seed}/{i}", "persons": sorted({f"{rng.choice(FIRST)} {rng.choice(LAST)}" for _ in range(rng.randrange(0, 8))})} for i in range(24)]
    got = matches(spark, rows)
    for a, b in itertools.combinations(rows, 2):
        pair = got.get((a["id"], b["id"])) or got.get((b["id"], a["id"]))
        shared = sorted(n.lower() for n in set(a["persons"]) & set(b["persons"]))
        assert (pair is not None and pair.match_type == "entity") == bool(shared)
        if shared:  # every shared name is listed, none is cut
            assert sorted(x.lower() for x in pair.overlap) == shared


def test_ship_names_in_reports(spark):
    rng = random.Random(8)
    ships = [{"id": f"s{i}", "kind": "ais", "name": n.upper(), "mmsi": 300_000_000 + i} for i, n in enumerate(SHIPS)]
    reports = []
    for i in range(12):
        named = rng.sample(range(len(SHIPS)), rng.randrange(0, 3))
        reports.append({"id": f"t{i}", "kind": "telegram", "text": "Port notice: vessel " + " and vessel ".join(SHIPS[k] for k in named) + " delayed" if named else "Port notice: quiet night", "_named": set(named)})
    got = matches(spark, [{k: v for k, v in r.items() if k != "_named"} for r in reports] + ships)
    for r in reports:
        assert {s for s in range(len(SHIPS)) if (r["id"], f"s{s}") in got and got[r["id"], f"s{s}"].match_type == "name"} == r["_named"]


def test_station_number_reaches_past_the_radius(spark):
    number = 412_345_678
    rows = [{"id": "w", "kind": "gdelt", "geo_type": 4, "text": f"Distress call, MMSI {number}"}]
    rows += [{"id": f"d{k}", "kind": "ais", "mmsi": number, "name": "ODESSA PEARL", "lat": -12.0 + k} for k in range(4)] + [{"id": "old", "kind": "ais", "mmsi": number, "t": NOW - 86400.0}]
    got = matches(spark, rows)
    found = {r for _, r in got}
    assert found == {f"d{k}" for k in range(4)} and {got["w", r].match_type for r in found} == {"identifier"}
    for k in range(4):
        assert math.isclose(got["w", f"d{k}"].km, 111.2 * k, rel_tol=0.01, abs_tol=0.2)


def test_coverage_counts_an_article_once(spark):
    rows = [{"id": f"x{i}", "kind": "gdelt", "geo_type": 4, "text": "Vessel Polar Wind aground", "url": f"https://daily.example/{i % 3}"} for i in range(18)]
    best = cand.generate_candidates(table(spark, rows + [{"id": "s", "kind": "ais", "name": "POLAR WIND"}])).collect()
    assert len([b for b in best if b.r_kind == "ais"]) == 3
    assert len(cand.generate_candidates(table(spark, rows + [{"id": "s", "kind": "ais", "name": "POLAR WIND"}]), 2).collect()) == 2


def test_batches_alternate_between_kinds(spark):
    rng = random.Random(4)
    rows = [(f"{kind}-{i}", "gdelt", kind, rng.choice(("topic", "proximity")), round(rng.random(), 3), f"l{kind}{i}", f"r{kind}{i}", f"{kind}|gdelt", False) for kind in ("ais", "adsb", "firms", "sar") for i in range(9)]
    c = spark.createDataFrame(rows, "coverage_key string, l_kind string, r_kind string, match_type string, score double, l_rid string, r_rid string, kind_pair string, hot boolean")
    got = cand.select_batch(c, limit=10, proximity_limit=3).collect()
    topic = [r for r in got if r.match_type == "topic"]
    assert len(got) <= 10 and sum(r.match_type == "proximity" for r in got) <= 3
    kinds = {r[2] for r in rows if r[3] == "topic"}
    assert {r.r_kind for r in topic[:len(kinds)]} == kinds  # one of each before the second of any
    for kind in kinds:
        scores = [r.score for r in topic if r.r_kind == kind]
        assert scores == sorted((r[4] for r in rows if r[2] == kind and r[3] == "topic"), reverse=True)[:len(scores)]


def test_best_pairs_are_aggregated_by_numbers_without_sorting_pairs(spark):
    rows = [{"id": f"r{i}", "kind": "gdelt", "geo_type": 4, "url": f"https://daily.example/{i}", "persons": ["Ilse Varga"]} for i in range(4)] + [{"id": "s", "kind": "ais", "name": "POLAR WIND"}]
    records = cand.retrieval_table(table(spark, rows))
    best = cand._ranked(cand.candidate_pairs(records), records).select("l_n", "r_n", "score", "match_type", "n_overlap")
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "l_source_key" not in plan.split("Aggregate")[1]
    kept = {tuple(sorted((r.l_n, r.r_n))) for r in best.collect()}
    assert len(kept) == 10
