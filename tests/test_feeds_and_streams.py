"""Readers on files in the providers' shapes, curated rules, and the stateful vessel stream."""

import json

from pyspark.sql import functions as F

from geoweave.sources import aircraft, curated, news, thermal, vessels
from geoweave.streaming import operators as st
from geoweave.streaming import runs


def test_news_files(spark, tmp_path):
    row = [""] * 61
    for i, v in {0: "1", 6: "NAVY", 28: "19", 30: "-5", 31: "12", 51: "4", 52: "Strait", 56: "26.5", 57: "56.5", 59: "20260818101500", 60: "https://www.x.test/a"}.items():
        row[i] = v
    bad = list(row)
    bad[56] = ""
    (tmp_path / "a.export.csv").write_text("\n".join("\t".join(r) for r in (row, bad, row[:30])))
    gkg = [""] * 27
    gkg[4], gkg[8], gkg[12] = "https://www.x.test/a", "T1,5;T2,9;T1,20", "Jane Smith,3"
    (tmp_path / "a.gkg.csv").write_text("\t".join(gkg))
    got = news.read_export(spark, str(tmp_path / "a.export.csv"), str(tmp_path / "a.gkg.csv")).collect()
    assert len(got) == 1
    e = got[0]
    assert (e.id, e.root_label, e.is_conflict, e.source_domain, e.goldstein, e.num_mentions, e.quad_class) == ("gdelt:1", "Fight", True, "x.test", -5.0, 12, 0)
    assert e.themes == ["T1", "T2"] and e.persons == ["Jane Smith"] and e.actor2 is None


def test_trace_archive_and_snapshot(spark, tmp_path):
    def trace(icao, points, flags=0):
        (tmp_path / f"trace_full_{icao}.json").write_text(json.dumps({"icao": icao, "r": "R1", "t": "A320", "dbFlags": flags, "timestamp": 1000.0, "trace": points}))
    trace("mil", [[0, 26.1, 56.1, "ground", 10, 90, 0, None, {"flight": "RCH1 ", "nic": 8}, "adsb"], [60, 26.2, 56.2, 3000, 10, 90, 0, None, None, "adsb"]], 1)
    trace("civ", [[0, 26.1, 56.1, 30000, 10, 90, 0, None, {"flight": "ABC2"}, "adsb"], [30, 10.0, 10.0, 30000, 10, 90, 0, None, {"flight": "XXX"}, "adsb"], [90, 26.3, 56.3, 31000, 10, 90, 0, None, None, "adsb"]])
    trace("out", [[0, 10.0, 10.0, 30000, 10, 90, 0, None, {"flight": "OUT"}, "adsb"]])
    rows = {(r.hex, r.t): r for r in aircraft.read_traces(spark, str(tmp_path / "*.json")).collect()}
    assert set(rows) == {("mil", 1000.0), ("mil", 1060.0), ("civ", 1000.0), ("civ", 1090.0)}
    assert rows["mil", 1060.0].flight == "RCH1" and rows["mil", 1060.0].nic == 8 and rows["mil", 1000.0].on_ground and rows["mil", 1000.0].military
    assert rows["civ", 1090.0].flight == "ABC2"  # points outside the box do not take part


def test_thermal_csv(spark, tmp_path):
    (tmp_path / "f.csv").write_text("latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,version,bright_ti5,frp,daynight\n26.5,56.5,330,1,1,2026-08-18,45,N,VIIRS,n,2,290,,D\n")
    r = thermal.read_hotspots(spark, str(tmp_path / "f.csv")).first()
    assert r.id == "firms:N:2026-08-180045:26.5,56.5" and r.frp == 0.0 and r.t % 86400 == 45 * 60


def test_vessel_messages(spark):
    def message(kind, lat=0.0, lon=0.0, mmsi=123456789, **body):
        return (json.dumps({"MessageType": kind, "MetaData": {"MMSI": mmsi, "latitude": lat, "longitude": lon, "ShipName": " A "}, "Message": {kind: body}}),)
    rows = [message("PositionReport", Sog=102.3, Cog=360, TrueHeading=511), message("StandardClassBPositionReport", lat=91.0, mmsi=222222222), message("PositionReport", mmsi=222222222, Valid=False),
            message("ShipStaticData"), message("PositionReport", mmsi=5)]
    got = vessels.parse_messages(spark.createDataFrame(rows, "value string")).collect()
    assert len(got) == 1 and got[0].name == "A" and (got[0].sog, got[0].cog, got[0].heading) == (None, None, None)


def test_curated_seed(spark, tmp_path):
    claim = {"id": "c1", "vessel_id": "imo:1", "source_ids": ["s1"], "event_date": "2026-08-17", "event_time_utc": None, "time_precision": "date_only", "coordinates": None, "claim": "x", "evidence_class": "press"}
    seed = {"schema_version": "1", "vessels": [{"id": "imo:1", "name": "A", "imo": "1"}, {"id": "mmsi:2", "name": "B"}], "sources": [{"id": "s1", "publisher": "p", "url": "u", "source_type": "t"}],
            "claims": [claim, {**claim, "id": "c2", "event_time_utc": "2026-08-17T10:00:00Z"}, {**claim, "id": "c3", "source_ids": ["s9"]}, {**claim, "id": "c4", "time_precision": "minute_as_reported"}]}
    (tmp_path / "seed.json").write_text(json.dumps(seed, indent=1))
    out = curated.read_seed(spark, str(tmp_path / "seed.json"))
    assert [r.id for r in out["claims"].collect()] == ["c1"] and [r.id for r in out["vessels"].collect()] == ["imo:1"]
    why = {r.id: r.reasons for r in out["rejects"].collect()}
    assert why == {"mmsi:2": ["id not imo-anchored"], "c2": ["time on a dated claim"], "c3": ["source_ids do not resolve"], "c4": ["no time on a timed claim"]}


def test_latest_vessel_stream(spark, tmp_path):
    schema = "mmsi bigint, t double, lat double, lon double, name string, sog double"
    regions = spark.createDataFrame([("a", 0.0, 0.0, 60.0)], "id string, lat double, lon double, radius_nm double")
    steps = [[(1, 1000.0, 0.0, 0.1, "A", 1.0), (2, 1000.0, 0.0, 0.2, "B", 1.0)], [(1, 900.0, 0.0, 0.5, "A", 1.0)], [(2, 1100.0, 0.9, 0.9, "B", 1.0)], [(3, 9000.0, 0.0, 0.0, "C", 1.0)]]
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.mmsi, r.change, r.t) for r in runs.drain(st.latest_vessels(source, regions, late="3 hours"), "append", "test").filter(F.col("mmsi") < 3).collect()}
    assert (1, "seen", 1000.0) in got and (1, "seen", 900.0) not in got and (2, "left", 1100.0) in got


def test_first_seen_is_renewed_by_every_sighting(spark, tmp_path):
    """One id every 6 hours for five days, another that is silent for 30 hours once, one file per micro-batch."""
    hours = [("steady", h) for h in range(0, 120, 6)] + [("gap", h) for h in (0, 12, 42, 48)] + [("twice", 60), ("twice", 60)]
    for h in range(0, 120, 6):
        rows = [(i, 1.7e9 + 3600.0 * x) for i, x in hours if h <= x < h + 6]
        spark.createDataFrame(rows, "id string, t double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted((r.id, (r.t - 1.7e9) / 3600) for r in runs.drain(st.first_seen(source), "append", "seen").collect())
    assert got == [("gap", 0.0), ("gap", 42.0), ("steady", 0.0), ("twice", 60.0)]


def test_own_history_feeds_the_timeline(spark, tmp_path):
    """Three fuses in a row: memory goes from one to the next, points are stored, and the timeline reads what was stored."""
    from geoweave.operators import timeline
    from geoweave.sinks import tables as sinks

    base, memory = 1_700_006_400.0, None
    seen_ids = [("a", "b"), ("b", "c", "d"), ("d",)]
    none = spark.createDataFrame([], "id string, novelty double, t double")
    for k, ids in enumerate(seen_ids):
        events = spark.createDataFrame([(i, True) for i in ids], "id string, is_conflict boolean")
        craft = spark.createDataFrame([(f"h{n}", n == 0) for n in range(k + 2)], "hex string, military boolean")
        parts = (events, none.select("id"), craft, events.select("id"), none)
        sinks.append_history(sinks.fuse_point(base + 900 * k + 10, *parts, seen=memory, ais=5 + k), str(tmp_path / "h"))
        memory = spark.createDataFrame(sinks.renewed_memory(base + 900 * k + 10, sinks.sightings(*parts), memory).collect(), "kind string, id string, last_t double")
    history = sinks.read_history(spark, str(tmp_path / "h"), base + 3600)
    points = history.orderBy("t").collect()
    assert [(p.primed, p.d_conflict, p.d_tracks, p.ais) for p in points] == [(False, 2, 2, 5), (True, 2, 1, 6), (True, 0, 1, 7)]
    backfill = spark.createDataFrame([], "slot double, events bigint, conflict bigint, social bigint")
    got = {r.slot: r for r in timeline.live_timeline(backfill, none.filter("t is not null"), history, base + 2700, 1.0).collect()}
    assert [(got[base + 900 * k].alerts, got[base + 900 * k].conflict, got[base + 900 * k].tracks, got[base + 900 * k].ais) for k in range(3)] == [(0, 0, 2, 5.0), (2, 2, 3, 6.0), (0, 0, 4, 7.0)]


def test_vessel_stream_refuses_stale_and_future_reports(spark, tmp_path):
    schema = "mmsi bigint, t double, lat double, lon double, name string, sog double, received double"
    regions = spark.createDataFrame([("a", 0.0, 0.0, 60.0)], "id string, lat double, lon double, radius_nm double")
    b = 1.7e9
    steps = [[(1, b, 0.0, 0.1, "A", 1.0, b)], [(7, b + 9e6, 0.0, 0.1, "Z", 1.0, b + 60)], [(1, b + 120, 0.0, 0.2, "A", 1.0, b + 121), (1, b + 60, 5.0, 5.0, "A", 1.0, b + 61)], [(8, b - 9000, 0.0, 0.1, "Y", 1.0, b + 130)]]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.mmsi, r.change, r.t - b) for r in runs.drain(st.latest_vessels(source, regions), "append", "fresh").collect()}
    assert got == {(1, "seen", 0.0), (1, "seen", 120.0)}  # the older report outside does not remove the newer one inside


def test_first_rows_and_checksum_are_defined(spark, tmp_path):
    from geoweave.operators.tracks import union_first, union_last
    from geoweave.sinks import tables as sinks

    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("b", 2, "w")]
    for order in (rows, rows[::-1]):
        part = spark.createDataFrame(order, "id string, line int, v string").repartition(3)
        first, last = ({r.id: r.v for r in pick([part], position="line").collect()} for pick in (union_first, union_last))
        assert first["a"] == "y" and last["a"] == "x" and (first["b"], last["b"]) in (("z", "w"), ("w", "z"))
        ties = ties if order is not rows else (first, last)
        assert ties == (first, last)
    sums = [sinks.build_dataset({"t": spark.createDataFrame(r, "id string, line int, v string")}, str(tmp_path / str(i))).first().checksum for i, r in enumerate((rows, rows[::-1], rows + rows[:1] * 2, rows[:0]))]
    assert sums[0] == sums[1] != sums[2] and sums[3] == 0
