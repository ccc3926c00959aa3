"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from checks.registry import QUERIES
from checks.views import Tables
from geoweave.session import build_session

HEADLINE = ["q01_alerts", "j02_near", "j04_candidate_pairs", "j05_phrases_in_texts", "j07_thermal_novelty", "j08_asof_many", "p03_in_circles", "a01_stream_counts", "a08_states",
            "a10_departed_cells", "a12_replay_timeline", "a25_evidence_pack", "a28_cluster_scores", "g01_event_edges", "i03_explanation_rank", "i05_incident_tracks", "s07_carry_forward",
            "w04_thinned_paths", "f21_normalize", "t04_newest_per_slot"]


def main() -> None:
    import checks.catalog  # noqa: F401

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus=cpus, shuffle_partitions=cpus)
    spark.read.parquet(f"{folder}/events.parquet").count()
    times = {}
    for name in wanted:
        Tables.forget()  # every query pays for its own derived tables
        start = time.time()
        QUERIES[name](Tables(spark, folder)).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
