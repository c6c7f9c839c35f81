"""Concordance by counted parts against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from cohortline.operators.dominance import above_before
from cohortline.operators.metrics_survival import TIE, concordance


def test_above_before():
    draw = np.random.default_rng(5)
    for size, top in ((0, 1), (1, 1), (50, 3), (300, 1000)):
        rank, weight = draw.integers(0, top, size), draw.integers(0, 4, size)
        want = [sum(weight[j] for j in range(i) if rank[j] > rank[i]) for i in range(size)]
        assert above_before(rank, weight).tolist() == want


def by_pairs(rows, strict):
    found = {}
    for key, t, e, r in rows:
        if e == 1 and t is not None and r is not None:
            lower = tied = all_ = 0
            for other, u, f, s in rows:
                if other == key and u is not None and s is not None and (u > t or (not strict and u == t and f != 1)):
                    all_ += 1
                    gap = r - s
                    lower += s < r - (0.0 if strict else TIE)
                    tied += (gap == 0) if strict else not s < r - TIE and s <= r + TIE
            a, b, c = found.get(key, (0, 0, 0))
            found[key] = (a + lower, b + tied, c + all_)
    return found


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("shape", ["mixed", "one risk", "one time", "near ties"])
def test_concordance_in_many_parts(spark, strict, shape):
    draw = np.random.default_rng(2)
    rows = []
    for i in range(400):
        key = None if i % 11 == 0 else "big" if i % 3 else f"k{i % 4}"
        t = float(draw.integers(0, 40)) / 2 if shape != "one time" else 3.0
        risk = {"one risk": 0.25, "near ties": 0.5 + float(draw.integers(-3, 4)) * 0.6e-8}.get(shape, float(draw.integers(0, 60)) / 60)
        rows.append((key, t, int(draw.integers(0, 2)), risk))
    rows += [("big", None, 1, 0.1), ("big", 2.0, 1, None)]
    df = spark.createDataFrame(rows, "stage string, time double, event int, risk double")
    want = {k: v for k, v in by_pairs(rows, strict).items() if k is not None}
    for part_rows in (20, 100_000):
        got = {r["stage"]: (r["concordant"], r["tied"], r["comparable"]) for r in concordance(df, ["stage"], strict=strict, part_rows=part_rows).collect()}
        assert {k: v for k, v in got.items() if k is not None} == want
