"""Packing: ids against the tokenizer itself, places against the contract, and the search
against exhaustive packing."""

import random
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

from quaestio.llm import packing as P

SCHEMA = "doc_id long, text string, length string, salt string"


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.default_tokenizer())
    t.encode_special_tokens = True
    return t


TEXTS = ["", "  \n", "Hello, World! it's the élève's Straße.", "ÀÉ|x ... don't niño ñandú", "日本語 text 12345 <|endoftext|> a\x1cb c\xa0d",
         "İstanbul ΣΑΣ ﬁ é e ́x", "word " * 5000, "a" * 9000, "x​y \U0001F600 z", "ſtrange K ªº µ", "ABC,, de;f gh!?"]


def test_ids(monkeypatch):
    ids = P.token_ids(P.default_tokenizer())
    assert ids.ranked
    rnd = random.Random(1)
    more = ["".join(rnd.choice("abcéßÉZ .,'!0\n") for _ in range(60)) for _ in range(300)]
    words = [" ".join("".join(rnd.choice("aàbcdeéèßfghiñlmnoöprstuüvz") for _ in range(rnd.randint(1, 14))) + rnd.choice(["", ",", "."])
                      for _ in range(400)) for _ in range(10)]
    every = TEXTS + more + words
    for text, own in zip(every, ids.of_all(every), strict=True):
        assert np.frombuffer(own, "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids, text
    monkeypatch.setattr(P, "REMEMBERED", 50)
    assert [x for t in every for x in ids.of_all([t])] == ids.of_all(every)


def check(rows, got, capacity=P.CAPACITY):
    want = defaultdict(list)
    for d, t, *_ in rows:
        ids = np.array(tokenizer().encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            want[d].append((k, at, len(part), zlib.crc32(part.tobytes())))
    left, places = defaultdict(list), defaultdict(list)
    for r in got:
        left[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {d: sorted(x) for d, x in left.items()} == {d: sorted(x) for d, x in want.items()}
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= capacity
    return len(places)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 16)
    rnd = random.Random(2)
    rows = [(i, t, None, None) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "the cat sat " * rnd.randrange(700), None, None) for i in range(200)]
    rows += [(1000 + i, "same", None, None) for i in range(120)] + [(None, None, None, None), rows[2], rows[2]]
    got = P.pack(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    n = check(rows, got)
    assert n <= -(-sum(r.length for r in got) // P.CAPACITY) + 4  # odd lengths from few words


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def fewest(sizes, capacity):
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                bins[k] += sizes[i]
                go(i + 1, bins)
                bins[k] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])
    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_search_is_near_exhaustive(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randint(1, 30) for _ in range(rnd.randint(1, 11))]
    counts = np.bincount(sizes, minlength=31)
    kinds = P.complete(counts, 30)
    used = np.zeros_like(counts)
    for kind, times in kinds:
        assert sum(x * n for x, n in kind) <= 30
        for x, n in kind:
            used[x] += n * times
    assert (used == counts).all()
    n = sum(t for _, t in kinds)
    assert n == fewest(sizes, 30)


def test_search_of_a_full_histogram_reaches_whole_solutions(caplog):
    """Twice the usual lengths: 6000 fillings end before the first branch does."""
    caplog.set_level("INFO", "quaestio.llm.packing")
    capacity = 4096
    lengths = np.random.default_rng(1).lognormal(7.0, 0.7, 300_000)
    counts = np.bincount(np.clip(lengths, 1, capacity).astype(int), minlength=capacity + 1)
    kinds = P.complete(counts, capacity)
    used = np.zeros_like(counts)
    for kind, times in kinds:
        assert sum(x * n for x, n in kind) <= capacity
        for x, n in kind:
            used[x] += n * times
    assert (used == counts).all()
    assert sum(t for _, t in kinds) < sum(t for _, t in P.best_fit(counts, capacity))
    assert "packing search ended" in caplog.text and " 0 whole solutions" not in caplog.text
