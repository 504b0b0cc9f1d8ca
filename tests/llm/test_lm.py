"""Language-model scores against a plain version."""

import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np

from quaestio.llm import lm
from quaestio.llm.words import words

SCHEMA = "doc_id long, text string, block long, data string"


def tokens(text):
    return words("".join(c.lower() if c.isascii() else c for c in text or "")) + ["</end>"]


def corpus(n=300):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        w = ["start"]
        for _ in range(rnd.randrange(1, 60)):
            w.append(f"{w[-1][:1]}{rnd.randrange(4)}" if rnd.random() < 0.7 else f"x{rnd.randrange(200)}É")
        rows.append((i, " ".join(w), None, None))
    return rows + [(None, "start s1", None, None), (7, None, None, None), (8, "  ", None, None), rows[4], (9, "y" * 5000, None, None)]


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    rows = corpus()
    got = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    fold = lambda d: crc32(b"" if d is None else str(d).encode()) % 10
    one, two = Counter(), Counter()
    for d, t, *_ in rows:
        if fold(d):
            x = tokens(t)
            one.update(x)
            two.update(zip(["</end>"] + x, x))
    n, v = sum(one.values()), len(one)
    cells = Counter()
    for d, t, *_ in rows:
        if fold(d) == 1:
            x = tokens(t)
            o1, o2 = Counter(x), Counter(zip(["</end>"] + x, x))
            for h, w in zip(["</end>"] + x, x):
                ch = one[h] - o1[h]
                p2 = (two[h, w] - o2[h, w]) / ch if ch > 0 else 0
                q = [1 + math.floor(-2 * math.log2(p)) if p > 0 else 0 for p in (min(p2, 1), (one[w] - o1[w]) / (n - len(x)))]
                cells[((ch.bit_length()) * 1000 + q[0]) * 1000 + q[1]] += 1
    weights = lm.fit_weights(np.array(list(cells)), np.array(list(cells.values())), v)
    want = defaultdict(list)
    for d, t, *_ in rows:
        x = tokens(t)
        total = 0.0
        for h, w in zip(["</end>"] + x, x):
            a = weights[one[h].bit_length()]
            total += math.log10(a[0] * two[h, w] / max(one[h], 1) + a[1] * one[w] / n + a[2] / (v + 1))
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)
        want[d].append((fold(d) == 0, len(x), sum(one[w] > 0 for w in x), n, base, total))
    left = defaultdict(list)
    for r in got:
        left[r.doc_id].append(tuple(r)[1:])
    for d in want:
        for a, b in zip(sorted(left[d]), sorted(want[d])):
            assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], rtol=1e-9)


def test_better_than_base_on_held_out(spark):
    got = [r for r in lm.score(spark.createDataFrame(corpus(600), SCHEMA)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = lm.score(spark.createDataFrame([(None, "a b", None, None)], SCHEMA)).collect()
    assert only[0].held_out and only[0].train_tokens == 0 and only[0].n_known == 0
