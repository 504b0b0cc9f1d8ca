"""FM-index: suffix order, ranks, searches and located places against plain versions."""

import random

import numpy as np
import pytest

from quaestio.llm.fm_index import FMIndex, Wavelet, suffix_order


def text_of(rnd, chunks, symbols, longest):
    out = []
    for _ in range(chunks):
        out += [rnd.randint(1, symbols) for _ in range(rnd.randint(0, longest))] + [0]
    return np.array(out, np.int64)


def plain_order(text):
    def key(i):
        out = []
        while text[i]:
            out.append((1, text[i]))
            i += 1
        return [*out, (0, i)]  # closing symbols rank by place, before all others
    return sorted(range(len(text)), key=key)


@pytest.mark.parametrize("symbols,bits,longest", [(1, 1, 40), (2, 2, 30), (3, 7, 12), (500, 9, 50), (3, 40, 9)])
def test_suffix_order(symbols, bits, longest):
    rnd = random.Random(symbols)
    for chunks in (1, 2, 30):
        text = text_of(rnd, chunks, symbols, longest)
        if chunks == 30:
            text = np.concatenate((text, text))  # whole chunks again
        assert suffix_order(text, bits).tolist() == plain_order(text.tolist())


def test_wavelet():
    rnd = np.random.default_rng(1)
    for n, bits in ((0, 3), (1, 1), (64, 2), (1000, 5)):
        s = rnd.integers(0, 1 << bits, n)
        w = Wavelet(s, bits)
        lo = rnd.integers(0, n + 1, 50)
        hi = np.maximum(lo, rnd.integers(0, n + 1, 50))
        c = rnd.integers(0, 1 << bits, 50)
        a, b = w.rank(c, lo, hi)
        assert a.tolist() == [(s[:x] == y).sum() for x, y in zip(lo, c)]
        assert b.tolist() == [(s[:x] == y).sum() for x, y in zip(hi, c)]
        assert w.less(c, lo, hi).tolist() == [(s[x:y] < z).sum() for x, y, z in zip(lo, hi, c)]
        got = sorted(zip(*(x.tolist() for x in w.children(lo, hi))))
        assert got == sorted((i, int(y), int((s[:lo[i]] == y).sum()), int((s[:hi[i]] == y).sum()), int((s[lo[i]:hi[i]] < y).sum()))
                             for i in range(50) for y in np.unique(s[lo[i]:hi[i]]))
        if n:
            i = rnd.integers(0, n, 40)
            c, rank = w.access(i)
            assert c.tolist() == s[i].tolist() and rank.tolist() == [(s[:x] == s[x]).sum() for x in i]


@pytest.mark.parametrize("every", [1, 3, 8])
def test_search_and_locate(every):
    rnd = random.Random(every)
    for symbols in (1, 3, 20):
        text = text_of(rnd, 40, symbols, 25)
        index = FMIndex(text, max(1, symbols.bit_length()), every)
        lists = [[rnd.randint(1, symbols) for _ in range(rnd.randint(1, 5))] for _ in range(60)]
        patterns = np.zeros((len(lists), 5), np.int64)
        for i, x in enumerate(lists):
            patterns[i, 5 - len(x):] = x
        lo, hi = index.search(patterns, np.array([len(x) for x in lists]))
        for x, a, b in zip(lists, lo, hi):
            want = [i for i in range(len(text)) if text[i:i + len(x)].tolist() == x]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want
