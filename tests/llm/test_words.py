"""Word hashes against words found by a regular expression, whatever the size of a piece."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quaestio.llm import words as W


@pytest.mark.parametrize("inside,pattern", [(W.INSIDE, W.WORD), (W.ALPHANUMERIC, W.WORD_ALPHANUMERIC)])
@pytest.mark.parametrize("piece", [3, 16, 1 << 17])
def test_word_hashes(monkeypatch, piece, inside, pattern):
    monkeypatch.setattr(W, "PIECE_BYTES", piece)
    monkeypatch.setattr(W, "_powers", {})
    rnd = random.Random(piece)
    rows = ["".join(rnd.choice(["a", "B", "é", "日", "0", " ", "\n", "-", ".", "\x7f"]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    rows += ["", "x" * 100, " " * 50, "", "ab" * 40 + " c", "A", "b"]
    hashes, counts = W.word_hashes(W.texts(pa.array([*rows, None])), inside)
    found = [pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in rows]
    assert counts.tolist() == [*map(len, found), 0]
    flat = [w for f in found for w in f]
    by_word = {}
    for w, h in zip(flat, hashes.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert np.array_equal(W.word_hashes(W.texts(pa.array(flat)), inside)[0], hashes)
