"""The Jaccard join against all pairs, on small corpora."""

import random

import pytest
from pyspark.sql import functions as F

from quaestio.llm import jaccard as J
from quaestio.llm.components import components
from quaestio.llm.words import words

SCHEMA = "doc_id long, text string, node long, sketch string"


def shingles(text, width=3):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 90 * len(a | b):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if sets[i] and r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), low.get(find(i), r[0]) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, n, lengths, vocabulary=400):
    rnd, rows = random.Random(seed), []
    passage = [f"p{i}" for i in range(30)]
    for _ in range(n):
        if rows and rnd.random() < 0.6:
            w = rnd.choice(rows[-12:])[1].split(" ")
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                at = rnd.randrange(len(w) + 1)
                rnd.choice([lambda: w.insert(at, "new"), lambda: w and w.pop(at - 1),
                            lambda: w.__setitem__(at - 1, "X") if w else None])()
        else:
            w = [f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.choice(lengths))]
            if rnd.random() < 0.4:
                w = w[:3] + passage + w[3:]
        rows.append((len(rows), " ".join(w), None, None))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,lengths", [(1, range(0, 30)), (2, range(20, 140)), (3, [3, 9, 10, 11, 20, 21, 22, 23, 60])])
def test_against_all_pairs(spark, seed, lengths):
    rows = corpus(seed, 260, list(lengths))
    rows += [(None, rows[0][1], None, None), (5000, None, None, None), (5001, " \t\n", None, None), (5002, "Two words", None, None),
             (5003, "two  WORDS", None, None), rows[1], (rows[2][0], rows[3][1], None, None)]
    got = J.join(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("most", [0, 9, 24])
def test_any_boundary_gives_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(J, "boundary", lambda nodes: most)
    monkeypatch.setattr(J, "BLOCK_KEYS", 300)
    rows = corpus(11, 220, list(range(1, 45)), 60)
    assert sorted((tuple(r) for r in J.join(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_keep_one(spark):
    rows = corpus(4, 150, [5, 40, 80])
    rows += [rows[0], (None, rows[1][1], None, None), (900, None, None, None), (901, "", None, None), (901, "", None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = J.keep_one(df)
    assert kept.columns == df.columns
    got = sorted(r.doc_id for r in kept.collect())
    want = sorted({c for d, n, c in brute(rows) if n} | {d for d, n, c in brute(rows) if not n and d != 901}) + [901, 901]
    assert got == sorted(want)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert J.join(df).count() == 0 and J.keep_one(df).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def brute_roots(rows, width, p, q):
    """The class of each row with words, as the set of row numbers that are linked."""
    sets = [shingles(r[1], width) for r in rows]
    group = {i: {i} for i, x in enumerate(sets) if x}
    for i in group:
        for j in group:
            if j < i and group[i] is not group[j] and q * len(sets[i] & sets[j]) >= p * len(sets[i] | sets[j]):
                group[i] |= group[j]
                for k in group[j]:
                    group[k] = group[i]
    return group


@pytest.mark.parametrize("width,similarity,p,q,most", [(5, 0.8, 4, 5, None), (5, 0.8, 4, 5, 0), (5, 0.8, 4, 5, 12), (2, 0.65, 13, 20, 8)])
def test_other_widths_and_similarities(spark, monkeypatch, width, similarity, p, q, most):
    if most is not None:
        monkeypatch.setattr(J, "boundary", lambda nodes, similarity: most)
    rows = corpus(21, 200, [0, 3, 5, 9, 14, 20, 24, 29, 33, 60, 140])
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    group = brute_roots(rows, width, p, q)
    assert any(len(x) > len(y) for x, y in zip(group.values(), brute_roots(rows, 3, 9, 10).values()))
    want = {r[0]: min(rows[j][0] for j in group[i]) if i in group else r[0] for i, r in enumerate(rows)}
    assert {r.doc_id: r.component_id for r in J.join(df, width, similarity).collect()} == want
    kept = {r.doc_id for r in J.keep_one(df, width, similarity).collect()}
    assert kept == {r[0] for i, r in enumerate(rows) if i not in group or want[r[0]] == r[0]}


def test_similarity_is_exact(spark):
    assert J.as_fraction(0.8) == J.as_fraction("4/5") and J.as_fraction(J.SIMILARITY) == J.SIMILARITY
    for odd in (0, -0.1, 1.01):
        with pytest.raises(ValueError):
            J.as_fraction(odd)
    # 5-word sets of 9 shingles in common of 10, 8 of 10 and 7 of 10; op9's rule links the first alone
    for n, linked in ((1, True), (2, True), (3, False)):
        words_ = [f"w{i}" for i in range(14 - n)]
        a, b = " ".join(words_), " ".join(words_ + [f"x{i}" for i in range(n)])
        df = spark.createDataFrame([(1, a, None, None), (2, b, None, None)], SCHEMA)
        assert J.keep_one(df, 5, 0.8).count() == (1 if linked else 2)


def test_pipeline_stage_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline
    text = [f"w{i}" for i in range(300)]
    near = [f"x{i}" if i % 50 == 25 else w for i, w in enumerate(text)]
    a, b = shingles(" ".join(text), 5), shingles(" ".join(near), 5)
    assert (len(a & b), len(a | b)) == (266, 326)
    df = spark.createDataFrame([(1, " ".join(text), None, None), (2, " ".join(near), None, None)], SCHEMA)
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()] == [1]
    assert J.keep_one(df).count() == 2  # op9's contract
