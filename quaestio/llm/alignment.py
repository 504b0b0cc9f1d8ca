"""Operator 13: cross-tokenizer alignment by galloping intersection.

Every text is encoded by a byte-level BPE (A: a space and the text) and by a sentence-piece
model (B: the text, to which it adds the space). Each token has a byte offset where it
ends; of the two sorted end lists the shorter one drives: for each of its ends the longer
list is searched exponentially from where the previous search stopped, then by bisection.
The common ends cut both sequences into groups; the differences of the ranks of common ends
are the ranges of tokens that a group spans on either side. Long lists are driven in
lanes of LANE ends that advance together.

Links are the pairs of token occurrences of A and B that end together. How many links a
pair of ids has in the corpus is counted in blocks: the documents of a block (about
BLOCK_BYTES of text) ask once for each distinct pair they hold, the counts are summed by
pair, and the answers return to the block. So a pair that stands in every document costs
one row a block, no key gathers more rows than there are blocks, and nothing is broadcast
or collected.

Defined results: a text that is null or empty, or whose tokens of either side do not join
to the bytes of space + text (the sentence-piece model rewrites some texts), has no tokens: all
numbers are 0 and the digest is ''. Repeated rows are counted each and get equal results; a
null doc_id is carried along. A very long text is a block of its own, encoded whole. Empty
tables give empty results; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm.counts import look_up, pack_counts, pack_sorted, summed, unpack_counts, unpack_sorted
from quaestio.llm.shared import stored
from quaestio.llm.words import slices, texts

#: Text that is encoded at a time, and text of the documents that ask for counts together.
SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
LANE = 64
#: Ids of B are below this, so that a pair is one 64-bit number.
IDS = 1 << 20


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- tokens --------------------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the rest from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: The pre-tokenizer's rule of byte-level vocabularies (a fixed value of the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoders:
    """Both tokenizers and the bytes of their ids. The byte-level one is run by ranks: in its
    vocabulary an id is the rank of its merge, which is checked when it is loaded."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"] for x in spec.get("added_tokens", ())}
        known = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {bytes(letters[c] for c in t): i for t, i in known.items()}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        if [known[t] for t in merged] != sorted(known[t] for t in merged) or spec.get("normalizer"):
            raise ValueError(f"{path_a}: ids are not the ranks of merges")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if len(self.bytes_b) > IDS:
            raise ValueError(f"{path_b}: more than {IDS} ids")
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, rows: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides of each text; none where they do not join to its bytes."""
        ids_b = self.b.encode(rows, num_threads=1)
        ids_a = []
        for k, text in enumerate(rows):
            want, own = (" " + text).encode(), self.a.encode_ordinary(" " + text) if text else []
            if not text or b"".join(map(self.bytes_b.__getitem__, ids_b[k])) != want or \
                    b"".join(map(self.bytes_a.__getitem__, own)) != want:
                own, ids_b[k] = [], []
            ids_a.append(own)
        return ids_a, ids_b


_loaded: dict[tuple[str, str], Encoders] = {}


def encoders(path_a: str, path_b: str) -> Encoders:
    """The encoders of a worker, loaded once (a few MB, whatever it reads)."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Encoders(path_a, path_b)
    return _loaded[path_a, path_b]


# --- alignment -------------------------------------------------------------------------------


def gallop(short: np.ndarray, long: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """(index in ``short``, index in ``long``) of the values that both sorted lists hold.
    Each lane of ``short`` starts where a bisection finds its first value; from then on every
    value is searched from the place of the one before: the bound doubles until it is not
    below the value, then the last interval is bisected."""
    n, m = len(short), len(long)
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.arange(0, n, lane)
    at = np.searchsorted(long, short[heads])
    place = np.empty(n, np.int64)
    place[heads] = at
    top = np.append(long, np.iinfo(long.dtype).max)
    for k in range(1, min(lane, n)):
        own = heads + k
        own = own[own < n]
        value, lo = short[own], at[:len(own)]
        bound = np.ones(len(own), np.int64)
        go = np.flatnonzero(top[np.minimum(lo + bound, m)] < value)
        while len(go):  # exponential search
            bound[go] *= 2
            go = go[top[np.minimum(lo[go] + bound[go], m)] < value[go]]
        lo, hi = lo + bound // 2, np.minimum(lo + bound, m)
        go = np.flatnonzero(lo < hi)
        while len(go):  # bisection: the first place that is not below the value
            mid = (lo[go] + hi[go]) >> 1
            below = top[mid] < value[go]
            lo[go] = np.where(below, mid + 1, lo[go])
            hi[go] = np.where(below, hi[go], mid)
            go = go[lo[go] < hi[go]]
        place[own] = at[:len(own)] = lo
    common = np.flatnonzero(top[place] == short)
    return common, place[common]


def intersect(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index in A, index in B) of the common ends; the shorter list drives."""
    if len(ends_a) <= len(ends_b):
        return gallop(ends_a, ends_b)
    in_b, in_a = gallop(ends_b, ends_a)
    return in_a, in_b


class Texts:
    """Digits of ids with what follows them, as 8 bytes each (0 where nothing stands)."""

    def __init__(self, most: int):
        rows = [f"{i}{sep}".encode().ljust(8, b"\0") for sep in ",|;" for i in range(most)]
        self.table, self.most = np.frombuffer(b"".join(rows), np.uint64), most

    def join(self, ids: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many each has."""
        grid = self.table[sep * self.most + ids].view(np.uint8).reshape(-1, 8)
        written = grid != 0
        return grid[written], written.sum(axis=1)


def _align(ids_a: list[list[int]], ids_b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray, names: Texts):
    """Of each text: tokens of A, of B, groups, digest; then the links as (text, a, b)."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
    a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(n.sum())) for x, n in ((ids_a, n_a), (ids_b, n_b)))
    # byte offsets run on from text to text: both sides of a text have equal bytes, so texts end together
    in_a, in_b = intersect(np.cumsum(size_a[a]), np.cumsum(size_b[b]))
    text_of = np.searchsorted(np.cumsum(n_a), in_a, side="right")
    n_groups = np.bincount(text_of, minlength=len(n_a))
    # rank differences: how many tokens of either side each group spans
    span_a, span_b = np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)
    group_a, group_b = (np.repeat(np.arange(len(s)), s) for s in (span_a, span_b))
    ids, sep = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + (in_b + 1 - span_b)[group_a] if len(a) else in_a
    at_b = np.arange(len(b)) + (in_a + 1)[group_b] if len(b) else in_b
    ids[at_a], ids[at_b] = a, b
    sep[at_a[in_a]], sep[at_b[in_b]] = 1, 2
    data, written = names.join(ids, sep)
    ends = np.concatenate(([0], np.cumsum(written)))[np.concatenate(([0], np.cumsum(n_a + n_b)))].tolist()
    digests = [hashlib.sha256(data[lo:hi - 1]).hexdigest() if hi > lo else "" for lo, hi in zip(ends, ends[1:])]
    return n_a, n_b, n_groups, digests, (text_of, a[in_a], b[in_b])


ALIGNED = "n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, counts binary, block long"


def _encode(path_a: str, path_b: str):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = encoders(path_a, path_b)
        names = Texts(max(len(both.size_a), len(both.size_b)))
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in rows:
            column = texts(batch.column("text"))
            for first, last in slices(column, SLICE_BYTES):
                part = column.slice(first, last - first).to_pylist()
                n_a, n_b, n_groups, digests, (of, a, b) = _align(*both.encode(part), both.size_a, both.size_b, names)
                pairs, counts, at = [], [], np.concatenate(([0], np.cumsum(n_groups))).tolist()
                code = (a * IDS + b).astype(np.uint64)
                for lo, hi in zip(at, at[1:]):
                    keys, n = summed(code[lo:hi])
                    pairs.append(pack_sorted(keys))
                    counts.append(pack_counts(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), *(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups)),
                     pa.array(digests, pa.string()), pa.array(pairs, pa.binary()), pa.array(counts, pa.binary()),
                     pa.array(np.full(len(part), block), pa.int64())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "counts", "block"])
                held += sum(map(len, part))
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0
    return run


def align(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """The stored alignments: per document doc_id, n_a, n_b, n_groups, groups_sha256, its
    distinct linked pairs (sorted, packed) with their counts, and the block it belongs to."""
    path_a, path_b = (x or y for x, y in zip((tokenizer_a, tokenizer_b), default_tokenizers()))
    kind = dict(docs.dtypes)["doc_id"]
    return stored(docs.select("doc_id", "text").mapInArrow(_encode(path_a, path_b), f"doc_id {kind}, {ALIGNED}"), "aligned")


def _ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block its distinct pairs and their counts. A block's rows stand together."""
    def flush(block: int, keys: list, counts: list) -> pa.RecordBatch:
        pair, n = summed(np.concatenate(keys), np.concatenate(counts))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block), pa.int64()), pa.array(pair.view(np.int64)), pa.array(n)],
                                          names=["block", "pair", "n"])
    block, keys, counts = None, [], []
    for batch in rows:
        own = batch.column("block").to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for lo, hi in zip(edge, edge[1:]):
            if hi == lo:
                continue
            if own[lo] != block and keys:
                yield flush(block, keys, counts)
                keys, counts = [], []
            block = int(own[lo])
            keys += [unpack_sorted(x.as_py()) for x in batch.column("pairs")[lo:hi]]
            counts += [unpack_counts(x.as_py()) for x in batch.column("counts")[lo:hi]]
            keys, counts = ([x] for x in summed(np.concatenate(keys), np.concatenate(counts)))
    if keys:
        yield flush(block, keys, counts)


def pair_counts(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the pairs each block holds, the links of each pair in the corpus: pair, total, best);
    ``best`` tells the pairs of the highest total of their id of B."""
    asked = stored(aligned.select("block", "pairs", "counts").mapInArrow(_ask, "block long, pair long, n long"), "alignment-asked")
    totals = stored(asked.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % IDS), "alignment-totals")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    return asked, totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def _answer(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
    pair = answers.column("pair").to_numpy().view(np.uint64)
    pair, first = np.unique(pair, return_index=True)
    total, best = (answers.column(c).to_numpy()[first].astype(np.int64) for c in ("total", "best"))
    sums, bests = [], []
    for keys, counts in zip(docs.column("pairs"), docs.column("counts")):
        keys, n = unpack_sorted(keys.as_py()), unpack_counts(counts.as_py())
        none = np.zeros(len(keys), np.int64)
        sums.append(int((look_up(keys, pair, total, none) * n).sum()))
        bests.append(int((look_up(keys, pair, best, none) * n).sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    return (out.append_column("n_links", docs.column("n_groups")).append_column("n_best", pa.array(bests, pa.int64()))
            .append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs.column("groups_sha256")))


def report(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """Per document doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    No token is empty, so one token of each side ends at a common end: a group is a link."""
    aligned = align(docs, tokenizer_a, tokenizer_b)
    asked, totals = pair_counts(aligned)
    answers = asked.select("block", "pair").join(totals, "pair")
    kind = dict(docs.dtypes)["doc_id"]
    return (aligned.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_answer, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                   "count_sum long, groups_sha256 string"))
