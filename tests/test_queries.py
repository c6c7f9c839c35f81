"""Registered queries against their SQL on the smallest tables.

A spread of queries runs by default; set COMPARE_ALL=1 for every one (as tools/compare.py does).
"""

from __future__ import annotations

import os

import pytest

from cohortline.plans.registry import load_all
from tools.compare import database, rows_of

DEFAULT = (
    "phenotype_pair_counts", "encounter_statistics", "cross_center_phenotypes", "event_blocks", "merged_timeline", "forward_context",
    "between_discharges", "visit_slices", "discharge_tasks", "hospital_durations", "icu_cohort", "icu_lab_severity", "icu_durations",
    "diagnosis_hierarchy", "longest_prefix_codes", "events_inside_stays", "reference_ranges", "death_durations", "drug_level_durations",
    "ranking_metrics", "concordance_index", "kaplan_meier", "integrated_brier", "hospital_measurements", "omop_measurements",
    "next_row_targets", "vocabulary", "graph_triples", "stratified_split", "class_balanced_cap", "sampled_pairs", "mixed_encodings",
    "refreshed_counts", "streamed_encounter_support",
)
NAMES = tuple(load_all()) if os.environ.get("COMPARE_ALL") else DEFAULT


@pytest.fixture(scope="module")
def con(sf_dir):
    return database(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, sf_dir, name):
    q = load_all()[name]
    df = q.job(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0]
    if q.sql is None:
        return
    result = con.execute(q.sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert got == want


def test_contract(spark):
    import __spark_entry__ as entry

    jobs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(jobs) and len(jobs) > 150
    assert entry.entry(spark).columns == ["scope", "item", "unit", "count", "statistic", "eligible_encounters", "diagnosis_clusters", "pair_count"]
