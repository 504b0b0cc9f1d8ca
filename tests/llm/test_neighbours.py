"""Nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaestio.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, cell long, at string"


def rows_of(x, ids=None):
    return [(int(i), [float(v) for v in r], None, None) for i, r in zip(range(len(x)) if ids is None else ids, x)]


def brute(rows, k, wanted):
    good = [(i, np.float32(v).astype(float)) for i, v, *_ in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if wanted(i) and i not in out:
            found = sorted((-float((v * q).sum()), j) for j, v in good if j != i)[:k]
            out[i] = [(j, -s) for s, j in found]
    return out


def compare(got, want, recall=0.9):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert by.keys() == {q for q in want if want[q]}
    hits = total = 0
    for q, found in by.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        scores = dict(want[q])
        hits += sum(i in scores and abs(scores[i] - s) < 1e-12 for _, i, s in found)
        total += len(want[q])
    assert hits >= recall * total
    return hits / total


@pytest.mark.parametrize("kind", ["clusters", "random", "lengths"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(N, "CELL_ROWS", 200)
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((2500, 24))
    if kind == "clusters":
        x = rnd.standard_normal((20, 24))[rnd.integers(0, 20, 2500)] + 0.1 * x
    if kind == "lengths":
        x *= rnd.lognormal(0, 0.5, (2500, 1))
    rows = rows_of(x)
    got = N.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    compare(got, brute(rows, 20, lambda i: i % 20 == 0))


def test_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 16)
    rnd = np.random.default_rng(2)
    rows = rows_of(np.tile(rnd.standard_normal(6), (300, 1))) + rows_of(rnd.standard_normal((60, 6)), range(1000, 1060))
    rows += [(2000, None, None, None), (2020, [0.0] * 6, None, None), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0], None, None),
             (2060, [float("nan")] + [1.0] * 5, None, None), (2080, [float("inf")] + [1.0] * 5, None, None), (None, [1.0] * 6, None, None),
             (2100, [], None, None)]
    got = N.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, 20).collect()
    want = brute(rows, 20, lambda i: i % 20 == 0)
    assert compare(got, want) > 0.95
    same = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 20)
    assert [i for _, i in same] == [i for i, _ in want[20]]


def test_few_and_none(spark):
    rows = rows_of(np.eye(4) + 1)
    got = N.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0, 20).collect()
    assert compare(got, brute(rows, 20, lambda i: i == 0)) == 1
    assert N.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert N.search(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_chi_square():
    assert abs(float(N.below(N.stop_at(0.9))) - 0.9) < 1e-9 and abs(float(N.below(13.3616)) - 0.9) < 1e-4
