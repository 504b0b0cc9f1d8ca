"""Line dedup against a brute-force version on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from quaestio.llm import line_dedup as L

SCHEMA = "doc_id long, text string, lang string, row_id string"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, k, least):
    places = []
    for d, text, *_ in rows:
        for pos, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" \t\n\v\f\r"):
                places.append(((-1 << 63) if d is None else d, pos, line))
    firsts = {}
    for d, pos, line in places:
        firsts[line] = min(firsts.get(line, (d, pos)), (d, pos))
    origin = {}
    for a in firsts:
        near = [firsts[b] for b in firsts if b == a or (min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= k
                                                        and edits(a, b) <= k)]
        origin[a] = min(near)
    out = {}
    for d, text, *_ in rows:
        if text is not None:
            key = (-1 << 63) if d is None else d
            out[(d, text)] = "\n".join(x for pos, x in enumerate(text.split("\n"))
                                       if not x.strip(" \t\n\v\f\r") or origin[x] >= (key, pos))
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abc dé") for _ in range(rnd.randint(8, 60))) for _ in range(25)] + ["", "x", "  "]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            line = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 2, 3])):
                at = rnd.randint(0, len(line))
                rnd.choice([lambda: line.insert(at, "z"), lambda: line and line.pop(at - 1)])()
            lines.append("".join(line))
        rows.append((i, "\n".join(lines), "en", "own"))
    return rows


@pytest.mark.parametrize("k,least,seed", [(1, 12, 1), (2, 10, 2), (3, 16, 3)])
def test_against_brute_force(spark, k, least, seed):
    rows = corpus(seed)
    rows += [rows[3], (None, rows[5][1], None, None), (7, "other text\n" + rows[8][1], None, None), (900, None, None, None)]
    got = L.dedup(spark.createDataFrame(rows, SCHEMA), k, least)
    assert set(got.columns) == {"doc_id", "text", "lang", "row_id", "n_lines", "n_dropped", "emptied"}
    got = got.collect()
    want = brute(rows, k, least)
    assert len(got) == len(rows)
    left = {}
    for r in got:
        left.setdefault(r.doc_id, []).append(r.text)
    wanted = {}
    for d, t, *_ in rows:
        wanted.setdefault(d, []).append(None if t is None else want[(d, t)])
    assert {d: sorted(map(str, x)) for d, x in left.items()} == {d: sorted(map(str, x)) for d, x in wanted.items()}


def test_empty_table(spark):
    assert L.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_line(spark):
    line = "ab " * 20_000
    rows = [(1, line, None, None), (2, line[:30_000] + "x" + line[30_000:], None, None), (3, line + "wxyz", None, None)]
    got = {r.doc_id: int(not r.emptied) for r in L.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


@pytest.mark.parametrize("k", [1, 2, 3])
def test_bit_parallel_distance(spark, k):
    rnd, rows = random.Random(k), []
    for _ in range(600):
        a = "".join(rnd.choice("abé") for _ in range(rnd.choice([0, 1, 2, 5, 40])))
        b = list(a)
        for _ in range(rnd.randint(0, 4)):
            at = rnd.randint(0, len(b))
            rnd.choice([lambda: b.insert(at, "b"), lambda: b and b.pop(at - 1)])()
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.filter(L.edit_distance_within(F.col("a"), F.col("b"), k) != (F.levenshtein("a", "b") <= k)).count() == 0
