"""Operator 4: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character n-grams
(1 to 3 characters of lower-cased words, with a space at word ends), trained by
follow-the-regularised-leader with elastic-net penalties, then calibrated by one
temperature on rows the training did not see.

Document frequencies come from every learning document. The classifier is fitted on a
bounded sample of labelled rows: at most ``rows_per_language`` per language, the smallest
by a hash of the row (a bound on fitting alone; every whole text is predicted).

Nulls and odd input: a null text or one without a letter is ``und`` with score 0; a null
lang is not learned from; a null doc_id counts as the empty text for the folds. Rows may
repeat. If nothing can be learned, every row is ``und``. Empty tables give empty
results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaestio.llm.lm import fold
from quaestio.llm.words import texts

FOLDS, HELD_OUT = 4, 2
BITS = 15
DIMS = 1 << BITS
UNDETERMINED = "und"
_M = [np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)]
_SHIFT = np.uint32(32 - BITS)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashed n-grams of a text and their counts; empty without a letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _is_letter()[code]
    code = np.where(letter, code, 32).astype(np.uint32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space behind a word
    code = code[keep]
    if not len(code) or not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.concatenate(([np.uint32(32)], code, [np.uint32(32)]))
    one = code * _M[0]
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * _M[1] + code[1:] * _M[2]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * _M[1] + code[2:] * _M[0]
    n = sum(np.bincount(x >> _SHIFT, minlength=DIMS) for x in (
        (one ^ (one >> np.uint32(16))) * _M[2], two * _M[0], (three ^ (three >> np.uint32(16))) * _M[2]))
    ids = np.flatnonzero(n)
    return ids, n[ids].astype(np.float64)


def tf_idf(ids: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[ids]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def _frequencies(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(DIMS, np.int64), 0
    for batch in rows:
        for text in texts(batch.column("text")):
            ids, _ = grams(text.as_py())
            total[ids] += 1
            docs += 1
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], docs))], names=["gram", "n"])


def _features(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        found = [grams(x.as_py()) for x in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank").cast(pa.int64()),
                                          pa.array([a.astype("<i4").tobytes() for a, _ in found], pa.binary()),
                                          pa.array([b.astype("<f8").tobytes() for _, b in found], pa.binary())],
                                         names=["lang", "rank", "ids", "n"])


class Model:
    """K x DIMS weights, bias and temperature."""

    def __init__(self, names: list[str], idf: np.ndarray):
        self.names, self.idf, self.temperature = names, idf, 1.0
        self.weights, self.bias = np.zeros((len(names), DIMS)), np.zeros(len(names))

    def logits(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.weights[:, ids] @ tf_idf(ids, n, self.idf) + self.bias

    def probabilities(self, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.logits(ids, n) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0,
            l1: float = 1e-3, l2: float = 1e-3, seed: int = 1) -> None:
        """FTRL-proximal: per coordinate, z gathers the gradients and n their squares;
        a weight is 0 while |z| <= l1."""
        k = len(self.names)
        z, s = np.zeros((k, DIMS)), np.zeros((k, DIMS))
        zb, sb = np.zeros(k), np.zeros(k)

        def weights(z, s):
            return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(s)) / alpha + l2))
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                label, ids, n = rows[i]
                x = tf_idf(ids, n, self.idf)
                w, b = weights(z[:, ids], s[:, ids]), weights(zb, sb)
                p = w @ x + b
                p = np.exp(p - p.max())
                p /= p.sum()
                p[label] -= 1
                g = p[:, None] * x
                sigma = (np.sqrt(s[:, ids] + g * g) - np.sqrt(s[:, ids])) / alpha
                z[:, ids] += g - sigma * w
                s[:, ids] += g * g
                sigma = (np.sqrt(sb + p * p) - np.sqrt(sb)) / alpha
                zb += p - sigma * b
                sb += p * p
        self.weights, self.bias = weights(z, s), weights(zb, sb)

    def calibrate(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The temperature of least log loss on ``rows``, by golden-section search."""
        if not rows:
            return
        z, y = np.stack([self.logits(i, n) for _, i, n in rows]), np.array([label for label, _, _ in rows])

        def loss(log_t: float) -> float:
            q = z / np.exp(log_t)
            q = q - q.max(axis=1, keepdims=True)
            return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())
        lo, hi, r = -3.0, 3.0, (5 ** 0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, rows_per_language: int = 600) -> Model | None:
    """A model from rows of ``docs`` (text, lang) with a lang."""
    rows = docs.filter(F.col("lang").isNotNull())
    seen = rows.select("text").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(DIMS), 0
    for r in seen:  # at most DIMS + 1 rows
        if r.gram < 0:
            total = r.n
        else:
            df[r.gram] = r.n
    # the rank is found on hashes alone; the texts of the few chosen rows follow by the hash.
    # Of a language, about 8 * rows_per_language of the smallest hashes are ranked (all where
    # it has fewer), so that the smallest rows_per_language are among them and no task ranks more.
    key = F.xxhash64("text", "lang")
    share = (F.shiftrightunsigned("h", 11) / float(1 << 53))  # 0 to 1, in the order of the unsigned hash
    hashes = rows.select("lang", key.alias("h"))
    sizes = F.broadcast(hashes.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))  # a row for each language
    pick = Window.partitionBy("lang").orderBy(share, "h")
    chosen = (hashes.join(sizes, "lang").filter(share * F.col("n") <= 8 * rows_per_language).select("lang", "h").distinct()
              .withColumn("rank", F.row_number().over(pick)).filter(F.col("rank") <= rows_per_language))
    chosen = F.broadcast(chosen.select(F.col("lang").alias("_lang"), F.col("h").alias("_h"), "rank"))  # bounded per language
    sample = rows.join(chosen, (key == F.col("_h")) & (F.col("lang") == F.col("_lang"))).dropDuplicates(["lang", "rank"])
    sample = sample.select("lang", "text", "rank").mapInArrow(_features, "lang string, rank long, ids binary, n binary").collect()
    sample = sorted(((r.lang, r["rank"], np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.n, "<f8")) for r in sample if r.ids),
                    key=lambda r: r[:2])
    names = sorted({r[0] for r in sample})
    if not names:
        return None
    model = Model(names, np.log((1 + total) / (1 + df)) + 1)
    rows_of = [(names.index(lang), ids, n, rank) for lang, rank, ids, n in sample]
    # every fifth row calibrates, unless a language has too few
    fitted = [r[:3] for r in rows_of if r[3] % 5 or len(rows_of) < 5 * len(names)]
    model.fit(fitted)
    model.calibrate([r[:3] for r in rows_of if r[3] % 5 == 0])
    return model


def _predict(model: Model | None):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for text in texts(batch.column("text")):
                ids, n = grams(text.as_py())
                if model is None or not len(ids):
                    out.append((UNDETERMINED, 0.0))
                else:
                    p = model.probabilities(ids, n)
                    out.append((model.names[int(p.argmax())], float(p.max())))
            names, scores = zip(*out) if out else ([], [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, rows_per_language: int = 600) -> DataFrame:
    """Per document doc_id, held_out, lang_pred and score, learning from the documents
    that are not held out."""
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = train(docs.filter(~held).select("text", "lang"), rows_per_language)
    kind = dict(docs.dtypes)["doc_id"]
    # only the columns of the prediction and the text reach it
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        _predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
