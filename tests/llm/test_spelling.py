"""Spelling variants against a plain version: counts, near pairs, forms and roots."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from quaestio.llm import spelling as S

SCHEMA = "doc_id long, text string, word string, n string, root string"


def plain_words(rows, divisor, least_chars, least_n):
    total = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % divisor == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= least_chars and n >= least_n}


def edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    return out - {w}


def plain(words):
    letters = {c for w in words for c in w}
    forms, out = {}, []
    for w, n in words.items():
        near = sorted((-words[v], v) for v in edits(w, letters) if v in words)
        best = near[0] if near and -near[0][0] >= 2 * n else None
        forms[w] = best
        out.append([w, best and best[1], None, n, len(near), best and -best[0]])
    for r in out:
        root = r[0]
        while forms[root]:
            root = forms[root][1]
        r[2] = root
    return sorted(map(tuple, out))


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed, n_docs):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcéß×") for _ in range(rnd.choice([5, 5, 6, 7, 9, 12]))) for _ in range(60)]

    def variant(w):
        k = rnd.randrange(len(w) + 1)
        return rnd.choice([w, w, w.upper(), w[:k] + w[k + 1:], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abcé") + w[k + 1:]])
    rows = [(i, rnd.choice([" ", "-1", ", "]).join(variant(rnd.choice(base)) for _ in range(rnd.randrange(80))), None, None, None)
            for i in range(n_docs)]
    long = " ".join(variant(rnd.choice(base)) for _ in range(3000))
    return [*rows, (None, rows[1][1], None, None, None), rows[2], rows[2], (900, None, None, None, None), (901, "", None, None, None),
            (902, long, None, None, None), (903, "z" * 500 + " ÀÉÀÉÀ ÀÉÀÉÀ ÀÉÀÉÀ", None, None, None)]


@pytest.mark.parametrize("shard_words,piece", [(50_000, 1 << 20), (40, 64)])
def test_group(spark, monkeypatch, shard_words, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    rows = corpus(piece, 150)
    words = plain_words(rows, 7, 5, 3)
    assert len(words) > 300
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(S.group(df, divisor=7, shard_words=shard_words)) == plain(words)


def test_contract_values(spark):
    rows = corpus(3, 80)
    assert got(S.group(spark.createDataFrame(rows, SCHEMA))) == plain(plain_words(rows, 97, 5, 3))


@pytest.mark.parametrize("letters,least", [("a", 2), ("ab", 2), ("abc", 5)])
def test_near_pairs_of_all_short_words(letters, least):
    rnd = random.Random(least)
    words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(least, 9))) for _ in range(400)})
    index, found = S.Delimited(words), set()
    for first_half in (True, False):
        q, n = S.near(index, *S.symbols(words), first_half)
        assert (q != n).all()
        for w, v in zip(q.tolist(), n.tolist()):
            k = len(words[w]) // 2  # the half that the scheme matches stands unchanged
            assert words[v].startswith(words[w][:k]) if first_half else words[v].endswith(words[w][k:])
            found.add((words[w], words[v]))
    assert found == {(w, v) for w in words for v in edits(w, letters) if v in set(words)}


def test_intervals_stay_in_step():
    """The bidirectional index counts the same occurrences from both sides."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 8))) for _ in range(200)})
    index, text = S.Delimited(words), "$" + "$".join(words) + "$"
    import numpy as np
    code = {"$": 0, **{c: int(S._CODE[ord(c)]) for c in "abc"}}
    for _ in range(200):
        state, pattern = [np.array([x]) for x in (0, index.forward.n, 0)], ""
        for _ in range(rnd.randint(1, 7)):
            c = rnd.choice("aabbcc")
            if rnd.random() < 0.5:
                state, pattern = list(index.left(np.array([code[c]]), *state)), c + pattern
            else:
                state, pattern = list(index.right(np.array([code[c]]), *state)), pattern + c
            want = len(re.findall(f"(?={pattern})", text))
            assert state[1][0] - state[0][0] == want
            if not want:
                break


def test_empty(spark):
    assert S.group(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.group(spark.createDataFrame([(1, "only once here", None, None, None)], SCHEMA)).count() == 0
