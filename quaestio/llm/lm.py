"""Operator 10: language-model scores by deleted interpolation.

Maximum-likelihood estimates of bigrams and unigrams, and the uniform distribution, are
mixed with weights that depend on how often the context was seen (a bucket per power of
two). The weights are learned by expectation-maximisation on held-out counts: documents
of one fold of the training part, each scored with its own counts taken out of the
totals. Every training document counts for the estimates; a bigram's context is the token
before, the context of a text's first token is the end token.

Documents are dealt to blocks of about BLOCK_BYTES of text by a hash of the row. A block
sends each distinct unigram and bigram once and gets the corpus totals back (``counts``).
For the weights, (context bucket, bigram estimate, unigram estimate) of every held-out
token is counted in half-octave cells, so the driver sees a table whose size depends on
the logarithm of the corpus alone.

Nulls and odd input: a null text is empty and has one token, the end; a null doc_id counts
as the empty text for the folds. Rows may repeat. Without training tokens the model is
uniform. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestio.llm import counts as C
from quaestio.llm.shared import stored
from quaestio.llm.words import mix, slices, texts, word_hashes

BLOCK_BYTES = 8 << 20
FOLDS = 10
#: The fold scored but not learned from, and the fold whose tokens fit the mixture weights.
SCORED, FITTED = 0, 1
BUCKETS = 64
_END = np.uint64(0x51C6E7F3A9D24B35)
_A, _B = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)

PACKED = "block long, fold_kind int, data binary"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double")


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def _pack(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that go to the same block as one compressed value."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in rows:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        names, first = np.unique(block[order], return_index=True)
        content = pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), texts(batch.column("text"))],
                                             names=["doc_id", "text"])
        out = []
        for rows_of in np.split(order, first[1:]):
            if len(rows_of):
                sink = pa.BufferOutputStream()
                part = content.take(pa.array(rows_of))
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(names % 3, pa.int32()), pa.array(out, pa.binary())],
                                         names=["block", "fold_kind", "data"])


def _unpack(table: pa.Table) -> pa.Table:
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["data"]]
    return pa.concat_tables(parts).combine_chunks()


def _tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram keys (odd) and bigram keys (even) of all texts in order, each text closed
    by the end token, and the number of tokens of each text."""
    column = texts(table["text"])
    parts, lengths = [], []
    for first, last in slices(column):
        hashes, n = word_hashes(column.slice(first, last - first))
        out = np.full(len(hashes) + len(n), _END, np.uint64)
        ends = np.cumsum(n + 1) - 1
        word = np.ones(len(out), bool)
        word[ends] = False
        out[word] = hashes | np.uint64(1)
        parts.append(out)
        lengths.append(n + 1)
    one = np.concatenate(parts)
    two = one * _B
    two[:1] += np.array([_END]) * _A
    two[1:] += one[:-1] * _A
    return one, mix(two) & ~np.uint64(1), np.concatenate(lengths)


def _ask(ranges: int):
    def run(table: pa.Table) -> pa.Table:
        one, two, _ = _tokens(_unpack(table))
        keys, n = C.summed(np.concatenate([one, two]))
        if table["fold_kind"][0].as_py() == SCORED:
            n = np.zeros_like(n)
        return pa.Table.from_batches([C.ask(table["block"][0].as_py(), keys, n, ranges)])
    return run


def _totals(keys: np.ndarray, counted: bool, answered) -> tuple[np.ndarray, np.ndarray]:
    """Position of each key among its distinct keys, and the corpus totals of those."""
    names, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return at, C.look_up(names, *answered, n if counted else np.zeros_like(n))


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + floor(log2(count))."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for 0, else the half-octave of a probability, from 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, 1 + np.floor(-2 * np.log2(p)), 0).astype(np.int64)


def _sizes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and tokens of the ranges' statistics, summed."""
    total = np.zeros(2, np.int64)
    for batch in rows:
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), "<i8")[:2]
    yield pa.RecordBatch.from_arrays([pa.array(total[:1]), pa.array(total[1:])], names=["n_words", "n_train"])


def _held_out(n_train: int):
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        one, two, lengths = _tokens(_unpack(table))
        answered = C.answers(asked)
        doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)

        def without_own(keys: np.ndarray) -> np.ndarray:
            at, total = _totals(keys, True, answered)
            pair = doc * np.uint64(len(total)) + at.astype(np.uint64)
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            return total[at] - own[back]
        c1, c2 = without_own(one), without_own(two)
        # the context's count without this text: the end stands before the first token
        context = np.empty_like(c1)
        context[1:] = c1[:-1]
        firsts = np.cumsum(lengths) - lengths
        context[firsts] = c1[firsts + lengths - 1]
        p2 = np.where(context > 0, np.minimum(c2 / np.maximum(context, 1), 1), 0)
        p1 = c1 / np.maximum(n_train - np.repeat(lengths, lengths), 1)
        cells, n = np.unique((bucket(context) * 1000 + _cell(p2)) * 1000 + _cell(np.minimum(p1, 1)), return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})
    return run


def fit_weights(cells: np.ndarray, n: np.ndarray, n_words: int, rounds: int = 50) -> np.ndarray:
    """BUCKETS x 3 mixture weights (bigram, unigram, uniform) by EM on counts of cells.
    Buckets start from, and are held to, two pseudo-tokens of the mean weights."""
    b, q2, q1 = cells // 1_000_000, cells // 1000 % 1000, cells % 1000
    p = np.stack([np.where(q2 > 0, 2.0 ** (-(q2 - 0.5) / 2), 0), np.where(q1 > 0, 2.0 ** (-(q1 - 0.5) / 2), 0),
                  np.full(len(cells), 1.0 / (n_words + 1))], axis=1)
    prior = np.array([0.3, 0.6, 0.1])
    weights = np.tile(prior, (BUCKETS, 1))
    for _ in range(rounds):
        part = weights[b] * p
        part *= (n / part.sum(axis=1))[:, None]
        total = np.zeros((BUCKETS, 3))
        np.add.at(total, b, part)
        if total.sum():
            prior = total.sum(axis=0) / total.sum()
        total += 2 * np.maximum(prior, 1e-6)
        weights = total / total.sum(axis=1, keepdims=True)
    # a context never seen has no bigram estimate: its share goes to the others
    weights[0, 0] = 0
    weights[0] /= weights[0].sum()
    return weights


def _score(weights: np.ndarray, n_train: int, n_words: int):
    def run(table: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(table):
            return pa.Table.from_batches([], schema=pa.schema([
                ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]))
        scored = table["fold_kind"][0].as_py() == SCORED
        rows = _unpack(table)
        one, two, lengths = _tokens(rows)
        answered = C.answers(asked)
        at, total = _totals(one, not scored, answered)
        c1 = total[at]
        base = np.log10((total + 0.1) / (n_train + 0.1 * (n_words + 1)))[at]
        end = total[np.searchsorted(np.unique(one), _END)]
        del at, total
        at, total = _totals(two, not scored, answered)
        c2 = total[at]
        del at, total
        context = np.concatenate(([end], c1[:-1]))  # the token before a text's first is the end of another
        w = weights[bucket(context)]
        p = w[:, 0] * (c2 / np.maximum(context, 1)) + w[:, 1] * (c1 / max(n_train, 1)) + w[:, 2] / (n_words + 1)
        if not n_train:
            p = np.full(len(one), 1.0)
        firsts = np.cumsum(lengths) - lengths
        n = len(lengths)
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": pa.array(np.full(n, scored)), "n_tokens": pa.array(lengths, pa.int64()),
            "n_known": pa.array(np.add.reduceat((c1 > 0).astype(np.int64), firsts)),
            "train_tokens": pa.array(np.full(n, n_train, np.int64)),
            "base_score": pa.array(np.add.reduceat(base, firsts)), "score": pa.array(np.add.reduceat(np.log10(p), firsts))})
    return run


def score(docs: DataFrame) -> DataFrame:
    """Per document doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score: the log10 probability of the text under the mixture."""
    rows = docs.select("doc_id", "text", fold(F.col("doc_id")).alias("fold"))
    kind = F.when(F.col("fold") == SCORED, 0).when(F.col("fold") == FITTED, 1).otherwise(2)
    sizes = rows.groupBy(kind.alias("kind")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
    size = {r.kind: r.n or 0 for r in sizes}
    blocks = F.element_at(F.array(*[F.lit(max(1, size.get(k, 0) // BLOCK_BYTES)) for k in range(3)]), kind + 1)

    def deal(part: DataFrame) -> DataFrame:
        return (part.withColumn("block", kind + 3 * F.pmod(F.xxhash64("doc_id", "text"), blocks)).select("doc_id", "text", "block")
                .mapInArrow(_pack, PACKED))
    dealt = deal(rows)
    ranges = C.n_ranges(sum(size.values()))
    asked = dealt.groupBy("block").applyInArrow(_ask(ranges), C.FIELDS)
    answered = stored(C.totals(asked), "lm-counts")
    n_words, n_train = (x or 0 for x in answered.filter("block = -1").select("counts").mapInArrow(_sizes, "n_words long, n_train long")
                        .agg(F.sum("n_words"), F.sum("n_train")).first())
    answered = answered.filter("block >= 0")
    cells = (deal(rows.filter(kind == FITTED)).groupBy("block").cogroup(
        answered.filter(F.col("block") % 3 == FITTED).groupBy("block"))
        .applyInArrow(_held_out(n_train), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect())
    weights = fit_weights(np.array([r.cell for r in cells], np.int64), np.array([r.n for r in cells], np.int64), n_words)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_score(weights, n_train, n_words), SCORES)
