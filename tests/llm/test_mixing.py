"""Mixing: budgets, epochs, odd input."""

from collections import defaultdict

from pyspark.sql import functions as F

from quaestio.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size long"


def water_fill(sizes, weights, total, epochs):
    out, open_ = {}, set(sizes)
    while open_:
        left = total - sum(out.values())
        share = {s: weights[s] * left / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= epochs * sizes[s]}
        if not over:
            return out | share
        out |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return out


def test_targets_and_cut(spark):
    rows = [(i, "w " * (i % 17), "abcdef"[i % 6] if i % 5 else "a", 0) for i in range(900)]
    rows += [(None, "one two", None, 0), (5, None, None, 0), (7, "x", None, 0), (7, "x", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(df).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    names = sorted(x for x in sizes if x is not None) + [None]
    want = water_fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    taken = defaultdict(int)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    again = M.mix(df.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = M.emit(df)
    assert copies.columns == df.columns
    assert copies.count() == sum(r.whole for r in got)


def test_ranges_of_a_hot_source(spark, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 16)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 9).cast("int")).alias("text"),
                                  F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("source"))
    split = sorted(map(str, M.mix(df).collect()))
    monkeypatch.setattr(M, "RANGE_ROWS", 1 << 20)
    assert split == sorted(map(str, M.mix(df).collect()))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert M.mix(df).count() == 0 and M.emit(df).count() == 0
    only = spark.createDataFrame([(1, None, "a", 0), (2, "", "a", 0)], SCHEMA)
    assert {r.taken for r in M.mix(only).collect()} == {0}
