"""Operator 3: best-fit packing by bin completion.

Documents are tokenized, closed by a separator and cut into pieces of at most one
sequence. Pieces of one length are interchangeable, so the search runs on the number of
pieces of each length (2048 numbers, whatever the corpus holds): it completes the
sequence around the largest remaining piece, branching on undominated fillings in order
of waste, and prunes a branch as soon as its waste rules out fewer sequences than the
incumbent's. The first incumbent is the best-fit solution; a filling is repeated as often
as the counts allow. The search ends at the lower bound ceil(tokens / capacity) or after
``max_nodes`` fillings, a limit on effort alone: every piece is always placed. The limit
grows with the number of distinct lengths, so that several whole solutions are reached;
how the search ended is logged.

Every piece then gets its rank among those of its length (a distributed numbering, salted
so that a length shared by very many pieces is split) and with it its sequence and place.

Nulls and odd input: a null text is empty and consists of the separator; a null doc_id is
carried along. Rows may repeat: their pieces are equal, and which copy gets which place is
open. Pieces of equal length are told apart by a hash of their document, number and ids, so
a rerun gives the same places. A very long text is tokenized whole, in memory of some ten times
its size. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import logging
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestio.llm.shared import stored
from quaestio.llm.words import release, slices

CAPACITY = 2048
SEPARATOR = 0
#: Words whose ids a task remembers, and text whose new words are tokenized together.
REMEMBERED, GROUP_BYTES = 120_000, 1 << 19
#: Pieces of one length that a numbering group holds on average.
GROUP_ROWS = 1024

#: Fillings the search tries at least, and steps for each distinct length: a whole solution
#: of a full histogram takes about 1.3 steps a length.
LEAST_NODES, STEPS_A_LENGTH = 6000, 2

log = logging.getLogger(__name__)

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: Stands behind a word handed to the ranked vocabulary, where its tokens carry a word end.
END = "\x00"


class TokenIds:
    """Texts -> little-endian 32-bit ids, by pieces. White space and the tokenizer's own
    splitting rule cut a text into pieces that are tokenized apart; a text (or word) of
    Latin-1 characters is lower-cased and cut here, any other word is given to the tokenizer.
    Each distinct new piece of a group of texts is tokenized once, all in one call by the
    ranks of the vocabulary."""

    _odd = re.compile("[\x00\x1c-\x1f]")  # white space for Python alone, and the byte that marks a word end here
    _letters, _digits = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾"
    #: The tokenizer's splitting rule within Latin-1 (a fixed value of its file).
    _piece = re.compile(f"[{_letters}]+|[{_digits}]|'(?:[stmd]|re|ve|ll)|[^\\s{_letters}{_digits}]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.spaceless = "Replace" in str(self.tokenizer.normalizer) and self.encode("a b") == self.encode("a") + self.encode("b")
        self.ranked = self._ranked() if self.spaceless else None

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ranked(self):
        """The vocabulary as ranks of byte strings, a word end as the byte of END, if that agrees
        with the tokenizer on a probe. An id is the rank of its merge, those of a last letter
        with its word end come first."""
        import json

        import tiktoken
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix, own = model.get("end_of_word_suffix"), {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        byte_of = {(chr(b) if b in own else chr(next(rest))): b for b in range(256)}
        if not suffix:
            return None
        ranks, self.ends = {}, np.zeros(max(model["vocab"].values()) + 1, bool)
        for token, i in model["vocab"].items():
            letters = token.removesuffix(suffix)
            if all(c in byte_of for c in letters):
                data = bytes(byte_of[c] for c in letters)
                if 0 not in data:  # the byte that marks a word end here
                    ranks[data + (b"\0" if letters != token else b"")] = i
                    self.ends[i] = letters != token
        ranks[b"\0"] = next(i for t, i in model["vocab"].items() if byte_of.get(t) == 0)
        self.ranked = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        probe = "The straße, élève's zzqxj niño a àé 12½ don't; «x» it'll ªº µ¿..!"
        pieces = self._piece.findall(probe.lower())
        known = self._by_ranks(pieces)
        return self.ranked if b"".join(known[x] for x in pieces) == self.encode(probe) else None

    def _by_ranks(self, words: list[str]) -> dict[str, bytes]:
        ids = np.array(self.ranked.encode_ordinary(END.join([*words, ""])), "<u4")
        at = [0, *(np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()]
        data = ids.tobytes()
        return {w: data[lo:hi] for w, lo, hi in zip(words, at[:-1], at[1:], strict=True)}

    def cut(self, text: str) -> list[str] | None:
        """The pieces of a text, words that are not cut here among them; None where its white
        space is in doubt."""
        if self._odd.search(text):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            out = []
            for word in text.split():
                if max(word) <= "ÿ":
                    out += self._piece.findall(word.lower())
                else:
                    out.append(word)
            return out
        return self._piece.findall(text.lower())

    def learn(self, pieces: set[str]) -> None:
        own = []
        for piece in pieces:
            if max(piece) <= "ÿ":
                own.append(piece)
            else:
                self.known[piece] = self.encode(piece)
        if own:
            self.known.update(self._by_ranks(own))

    def of_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Pieces stay known up to REMEMBERED, then only those of the group in hand."""
        if not self.ranked:
            return [self.encode(t) for t in texts]
        lists = [self.cut(t) for t in texts]
        here = set(chain.from_iterable(x for x in lists if x))
        fresh = here.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known = {w: self.known[w] for w in here.intersection(self.known)}
        self.learn(fresh)
        return [self.encode(t) if x is None else b"".join(map(self.known.__getitem__, x)) for t, x in zip(texts, lists)]

    def forget(self) -> None:
        self.known = {}


_loaded: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """The tokenizer of a worker; its words are forgotten when a task ends (see _cut)."""
    if path not in _loaded:
        _loaded[path] = TokenIds(path)
    return _loaded[path]


def _salt(doc: int | None, piece: int, crc: int) -> int:
    """A number that splits large groups, the same in every run."""
    x = ((doc or 0) * 0x9E3779B97F4A7C15 + piece * 0xBF58476D1CE4E5B9 + crc * 0x94D049BB133111EB) % (1 << 64)
    x ^= x >> 31
    return x * 0xD6E8FEB86659FD93 % (1 << 64) >> 8


def _cut(path: str, capacity: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, closing = token_ids(path), np.array([SEPARATOR], "<u4").tobytes()
        try:
            for batch in rows:
                column, doc_ids = batch.column("text"), batch.column("doc_id").to_pylist()
                for first, last in slices(column, GROUP_BYTES):
                    out = []
                    for doc, own in zip(doc_ids[first:last], ids.of_all([x or "" for x in column.slice(first, last - first).to_pylist()])):
                        own += closing
                        for k, at in enumerate(range(0, len(own), 4 * capacity)):
                            piece = own[at:at + 4 * capacity]
                            crc = zlib.crc32(piece)
                            out.append((doc, k, at // 4, len(piece) // 4, crc, _salt(doc, k, crc)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 6,
                                                        (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                        names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        finally:
            ids.forget()
            release()
    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document; ``salt`` splits large groups. It is a hash of the piece, so
    that reruns agree; pieces of equal hash are copies of one row."""
    cut = _cut(tokenizer or default_tokenizer(), capacity)
    return stored(docs.select("doc_id", "text").mapInArrow(cut, PIECES), "pieces")


# --- the search: a filling is a list of (length, how many) -------------------------------


def fillings(counts: np.ndarray, space: int, want: int, effort: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Up to ``want`` undominated fillings of ``space`` as (waste, filling), least waste
    first. A filling is dominated if a larger available piece fits in place of one of its
    pieces, or a single available piece in place of two of them."""
    sizes = np.flatnonzero(counts[:space + 1])
    found: list[tuple[int, list[tuple[int, int]]]] = []
    nodes = 0

    def larger(x: int, slack: int, used: dict[int, int]) -> bool:
        lo = np.searchsorted(sizes, x, side="right")
        return any(counts[y] > used.get(int(y), 0) for y in sizes[lo:np.searchsorted(sizes, x + slack, side="right")])

    def dominated(chosen: list[tuple[int, int]], waste: int) -> bool:
        used = dict(chosen)
        if waste and any(larger(x, waste, used) for x, _ in chosen):
            return True
        flat = [x for x, n in chosen for _ in range(min(n, 2))][-6:]
        return any(larger(a + b - 1, waste + 1, used) for i, a in enumerate(flat) for b in flat[:i])

    def go(space: int, below: int, chosen: list[tuple[int, int]]) -> None:
        nonlocal nodes
        nodes += 1
        if nodes > effort or sum(w == 0 for w, _ in found) >= want:
            return
        at = np.searchsorted(sizes, min(space, below), side="right") - 1
        if at < 0:
            if not dominated(chosen, space):
                found.append((space, list(chosen)))
            return
        tried = 0
        while at >= 0 and tried < 3:  # the best fit first, then the next smaller lengths
            x = int(sizes[at])
            most = min(space // x, int(counts[x]))
            go(space - most * x, x - 1, [*chosen, (x, most)])
            if most > 1:
                go(space - (most - 1) * x, x - 1, [*chosen, (x, most - 1)])
            at -= 1
            tried += 1

    go(space, space, [])
    if not found:  # the best-fit filling is always there
        chosen, left, below = [], space, space
        while (at := np.searchsorted(sizes, min(left, below), side="right") - 1) >= 0:
            x = int(sizes[at])
            n = min(left // x, int(counts[x]))
            chosen.append((x, n))
            left, below = left - n * x, x - 1
        found = [(left, chosen)]
    return sorted(found, key=lambda f: (f[0], sum(n for _, n in f[1])))[:want]


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit from the largest piece on, one kind of sequence at a time."""
    counts, out = counts.copy(), []
    while (left := np.flatnonzero(counts)).size:
        largest = int(left[-1])
        counts[largest] -= 1
        filling = fillings(counts, capacity - largest, 1, 0)[0][1]
        counts[largest] += 1
        out.append(_repeat(counts, largest, filling))
    return out


def _repeat(counts: np.ndarray, largest: int, filling: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """Take the filling around ``largest`` out of the counts as often as they allow."""
    need: dict[int, int] = {largest: 1}
    for x, n in filling:
        need[x] = need.get(x, 0) + n
    times = min(int(counts[x]) // n for x, n in need.items())
    for x, n in need.items():
        counts[x] -= n * times
    return sorted(need.items(), reverse=True), times


def complete(counts: np.ndarray, capacity: int = CAPACITY, branches: int = 3, max_nodes: int | None = None,
             effort: int = 60) -> list[tuple[list[tuple[int, int]], int]]:
    """Kinds of sequences as (pieces, how often), using every piece of ``counts`` (index:
    length), by bin completion with the best-fit solution as the first incumbent."""
    if max_nodes is None:
        max_nodes = max(LEAST_NODES, STEPS_A_LENGTH * branches * int(np.count_nonzero(counts)))
    best = best_fit(counts, capacity)
    total = int((counts * np.arange(len(counts))).sum())
    least, first, nodes, whole = -(-total // capacity), sum(n for _, n in best), 0, 0
    n_best = first
    # of each open branch the pieces left and the kinds chosen, as (last, those before it)
    stack: list[tuple[np.ndarray, tuple | None, int, int]] = [(counts.copy(), None, 0, 0)]
    while stack and n_best > least and nodes < max_nodes:
        left, chosen, used, waste = stack.pop()
        if waste > (n_best - 1) * capacity - total:  # even without further waste not fewer sequences
            continue
        sizes = np.flatnonzero(left)
        if not sizes.size:
            whole += 1
            if used < n_best:
                best, n_best = [], used
                while chosen:
                    kind, chosen = chosen
                    best.append(kind)
                best.reverse()
            continue
        largest = int(sizes[-1])
        left[largest] -= 1
        options = fillings(left, capacity - largest, branches, effort)
        left[largest] += 1
        nodes += len(options)
        for spare, filling in reversed(options):
            rest = left.copy()
            kind, times = _repeat(rest, largest, filling)
            stack.append((rest, ((kind, times), chosen), used + times, waste + spare * times))
    ended = "at the lower bound" if n_best <= least else "with no branch left" if not stack else "at its limit"
    log.log(logging.WARNING if ended == "at its limit" else logging.INFO,
            "packing search ended %s: %d sequences (best fit %d, lower bound %d), %d whole solutions, %d of %d fillings",
            ended, n_best, first, least, whole, nodes, max_nodes)
    return best


def places(kinds: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), sorted."""
    rows, used, sequence = [], {}, 0
    for kind, times in kinds:
        offset = 0
        for x, n in kind:
            rows.append((x, used.get(x, 0), n, sequence, offset))
            used[x] = used.get(x, 0) + n * times
            offset += x * n
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(table: np.ndarray):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in rows:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            own = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            past = rank - own[:, 1]
            sequence, offset = own[:, 3] + past // own[:, 2], own[:, 4] + past % own[:, 2] * length
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")],
                                              pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def ranked(cut: DataFrame) -> DataFrame:
    """``cut`` (stored pieces) with ``rank``: their number from 0 among those of a length."""
    per = cut.groupBy("length").agg(F.count("*").alias("n_length"))
    sub = F.pmod("salt", F.ceil(F.col("n_length") / GROUP_ROWS))
    dealt = cut.join(F.broadcast(per), "length").withColumn("sub", sub).drop("n_length")  # at most one row per length
    upto = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (dealt.groupBy("length", "sub").agg(F.count("*").alias("n"))
              .withColumn("first", F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n"))
    inside = Window.partitionBy("length", "sub").orderBy("salt", "doc_id", "piece")
    return (dealt.join(firsts, ["length", "sub"])
            .withColumn("rank", (F.col("first") + F.row_number().over(inside) - 1).cast("long")))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = pieces(docs, tokenizer, capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    table = places(complete(counts, capacity))
    return ranked(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
