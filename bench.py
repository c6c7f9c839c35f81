"""Headline queries, timed: one JSON line with seconds per query (second run, everything included)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortline.plans.registry import load_all  # noqa: E402
from cohortline.session import local_session  # noqa: E402

HEADLINE = (
    "phenotype_pair_counts", "item_unit_counts", "encounter_statistics", "concept_prevalence", "event_blocks", "merged_timeline",
    "forward_context", "emergency_tasks", "hospital_durations", "icu_lab_severity", "events_inside_stays", "hospital_measurements",
    "subject_tables", "harvested_texts", "graph_triples", "negative_triples", "stratified_split", "ranking_metrics",
    "concordance_index", "kaplan_meier", "cumulative_auc", "integrated_brier",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = tuple(sys.argv[1:]) or HEADLINE
    spark = local_session(cpus, app="bench")
    jobs = load_all()
    spent = {}
    for name in names:
        for _ in range(2):  # the first run warms the JVM and the file cache
            start = time.perf_counter()
            jobs[name].job(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries, warm", "value": round(sum(spent.values()), 3), "unit": "sec",
        "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
