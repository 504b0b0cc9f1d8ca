"""Alignment against the tokenizers themselves and a plain version of groups and counts."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from quaestio.llm import alignment as A

SCHEMA = "doc_id long, text string, block long, pairs string, n_a string"
TEXTS = ["Hello, world! it's the élève's Straße.", "  two  spaces\n\nand lines\t", "日本語 text 12345 <|endoftext|> </s> <unk> a\x1cb", "word " * 300,
         "a" * 700, "\U0001F600 z​y", "é é ﬁ Ⅳ ½", "I'll we've they're 'S 'LL x'y", " ", "\n", "x", "▁ under ▁▁line", "<0x41> <s>",
         "naïve café — “quotes” … №5", "ÀÉ|x ... don't niño ñandú\r\n", "tab\there   three", " nbsp　wide", "it's 3.14159, isn't it?"]


@lru_cache
def plain_encoders():
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = A.default_tokenizers()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


def plain_tokens(text):
    """[(id, bytes)] of both sides, or none."""
    if not text:
        return [], []
    t, sp = plain_encoders()
    letters = A.byte_letters()
    a = [(i, bytes(letters[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        piece = sp.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == want else ([], [])


def plain(rows):
    docs, counts = [], Counter()
    for doc, text, *_ in rows:
        a, b = plain_tokens(text)
        ends = []
        for side in (a, b):
            at, own = 0, {}
            for i, x in side:
                at += len(x)
                own[at] = i
            ends.append(own)
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, last = [], 0
        for c in common:
            groups.append("|".join(",".join(str(i) for e, i in own.items() if last < e <= c) for own in ends))
            last = c
        links = [(ends[0][c], ends[1][c]) for c in common]
        counts.update(links)
        docs.append((doc, len(a), len(b), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    highest = defaultdict(int)
    for (x, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(((d, na, nb, g, len(links), sum(counts[p] == highest[p[1]] for p in links), sum(counts[p] for p in links), h)
                   for d, na, nb, g, links, h in docs), key=repr)


def got(df):
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=repr)


def fuzz(seed, n):
    rnd = random.Random(seed)
    parts = [" ", "  ", "\n", "the", "Word", "naïve", "日", "é", "'s", "12", ".", "!?", "ab", "zzq", "\t", "▁", "<s>", "😀", "ing", "́"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_ids_and_bytes():
    both = A.encoders(*A.default_tokenizers())
    rows = TEXTS + fuzz(1, 400)
    ids_a, ids_b = both.encode(rows)
    n = 0
    for text, a, b in zip(rows, ids_a, ids_b):
        want = plain_tokens(text)
        assert (a, b) == tuple([i for i, _ in side] for side in want), text
        assert [both.bytes_a[i] for i in a] == [x for _, x in want[0]]
        n += bool(a)
    assert n > 150


@pytest.mark.parametrize("lane", [1, 2, 7, 64, 5000])
def test_gallop(lane):
    rng = np.random.default_rng(lane)
    for n, m, top in ((0, 5, 9), (5, 0, 9), (1, 1, 2), (50, 800, 1000), (800, 50, 1000), (300, 300, 301), (2000, 9000, 10000)):
        a, b = (np.sort(rng.choice(top, k, replace=False)).astype(np.int64) for k in (n, m))
        i, j = A.gallop(a, b, lane)
        want = np.intersect1d(a, b)
        assert a[i].tolist() == b[j].tolist() == want.tolist()
        i, j = A.intersect(a, b)
        assert a[i].tolist() == b[j].tolist() == want.tolist()


@pytest.mark.parametrize("block,slice_", [(8 << 20, 1 << 20), (200, 100)])
def test_report(spark, monkeypatch, block, slice_):
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    monkeypatch.setattr(A, "SLICE_BYTES", slice_)
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS + fuzz(2, 150))]
    rows += [(None, TEXTS[0], None, None, None), rows[3], rows[3], (500, None, None, None, None), (501, "", None, None, None),
             (502, " ".join(fuzz(3, 400)), None, None, None)]
    assert got(A.report(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)


def test_empty(spark):
    assert A.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (2, "", None, None, None)]
    assert got(A.report(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
