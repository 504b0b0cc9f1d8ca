"""Operator 2: quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. The votes of all documents are
counted by pattern (a few thousand patterns at most, whatever the corpus holds);
expectation-maximisation over the patterns estimates, for either class, how often each
rule votes which way, and the share of good documents. A document is kept if its
posterior probability of being good is at least ``threshold`` and it passes the two base
rules (at least 50 words; at most half of the words in repeated 3-word windows).

Counts are taken over whole texts. Nulls and odd input: a null text has no words and
fails the base rules; a null doc_id is carried along; rows that repeat get equal results.
Empty tables give empty results. ``keep`` returns the columns of its input.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm.shared import small, stored
from quaestio.llm.words import release, words

GOOD, BAD, ABSTAIN = 1, 0, 2

#: Rules as (name, feature, good if at most, bad if at least); between them they abstain.
#: Each kind of junk should trip several rules, since one good vote outweighs little.
RULES = (
    ("symbols in words", "odd_share", 0.06, 0.09),
    ("shapeless words", "shapeless_share", 0.15, 0.40),
    ("capitals", "upper_share", 0.20, 0.50),
    ("repeated windows", "repeat_share", 0.25, 0.55),
    ("commonest word", "top_word_share", 0.15, 0.25),
    ("few sentence ends", "missing_ends", 0.03, 0.045),
    ("long or short words", "mean_word_gap", 2.5, 4.5),
)
#: Sentence ends a text has per word at least; mean word length of running text.
ENDS_PER_WORD, USUAL_LENGTH = 0.05, 6.0
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_ODD = re.compile(r"[^\w\s]")
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]")
#: A word of running text: letters, a capital only in front, at most one mark behind.
_SHAPED = re.compile(r"(?<!\S)[^\W\d_][^\W\d_A-ZÀ-ÖØ-ÞΑ-ΩА-Я]*[.,;:!?]?(?!\S)")
_ENDS = re.compile(r"[.!?…。]['\")\]]*(?!\S)")

FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
            "votes string")


def measure(text: str) -> tuple:
    """The base counts of one text and the features of the rules."""
    w = words(text)
    n = len(w)
    chars = sum(map(len, w))
    symbols = len(_SYMBOLS.findall(text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\v\f\r"):
            seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            upto = 0  # words before this position are counted
            for i, x in enumerate(windows):
                if often[x] > 1:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    if not n:
        return (0, 0, symbols, dup, 0), {}
    tops = Counter(w).most_common(1)[0][1]
    return (n, chars, symbols, dup, repeat), {
        "odd_share": len(_ODD.findall(text)) / chars, "shapeless_share": 1 - len(_SHAPED.findall(text)) / n,
        "upper_share": len(_UPPER.findall(text)) / chars, "repeat_share": repeat / n,
        "top_word_share": tops / n if n >= 20 else 0.0, "mean_word_gap": abs(chars / n - USUAL_LENGTH),
        "missing_ends": max(0.0, ENDS_PER_WORD - len(_ENDS.findall(text)) / n),
    }


def vote(features: dict) -> str:
    """One digit per rule."""
    if not features:
        return str(ABSTAIN) * len(RULES)
    return "".join(str(GOOD if features[f] <= good else BAD if features[f] >= bad else ABSTAIN) for _, f, good, bad in RULES)


def _rows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    for batch in rows:
        out = []
        for text in batch.column("text"):
            base, features = measure(text.as_py() or "")
            n, repeat = base[0], base[4]
            out.append((*base, n < 50 or 100 * repeat > 50 * n, vote(features)))
        cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 7, [pa.int64()] * 5 + [pa.bool_(), pa.string()])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *cols], names=["doc_id", "text_hash", *names])
    release()


class LabelModel:
    """Per class, how often a rule that votes says good or bad; the share of good. An
    abstention is no evidence for either class."""

    def __init__(self, patterns: list[str], counts: np.ndarray, rounds: int = 100):
        votes = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(-1, len(RULES))
        weight = counts.astype(float)
        total = max(weight.sum(), 1.0)
        # a single bad vote starts out as a sign of a bad document; rules are held to a few pseudo-votes
        good = np.where((votes == BAD).any(axis=1), 0.1, 0.9)
        self.prior, self.rates = 0.5, np.ones((2, len(RULES), 3))
        for _ in range(rounds):
            was = self.rates.copy()
            for c, share in ((GOOD, good), (BAD, 1 - good)):
                for r in range(len(RULES)):
                    n = np.bincount(votes[:, r], weights=share * weight, minlength=3)[:2] + ((2.0, 3.0) if c == BAD else (0.25, 4.75))  # bad, good
                    self.rates[c, r, :2] = n / n.sum()
            self.prior = (float(good @ weight) + 1) / (total + 2)
            good = self.posteriors(votes)
            if np.abs(self.rates - was).max() < 1e-9:
                break

    def posteriors(self, votes: np.ndarray) -> np.ndarray:
        at = np.arange(len(RULES))
        log = [np.log(p) + np.log(self.rates[c][at, votes]).sum(axis=1) for c, p in ((GOOD, self.prior), (BAD, 1 - self.prior))]
        return 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))

    def posterior(self, pattern: str) -> float:
        return float(self.posteriors(np.array([[int(c) for c in pattern]]))[0])


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per document doc_id, text_hash, the counts, base_failed, votes, p_good and kept."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = dict(docs.dtypes)["doc_id"]
    rows = stored(rows.mapInArrow(_rows, f"doc_id {kind}, text_hash long, {FEATURES}"), "quality-votes")
    seen = rows.groupBy("votes").count().collect()  # at most 3 ** len(RULES) patterns
    patterns = sorted(r["votes"] for r in seen)
    by = {r["votes"]: r["count"] for r in seen}
    model = LabelModel(patterns, np.array([by[p] for p in patterns]))
    table = rows.sparkSession.createDataFrame([(p, model.posterior(p)) for p in patterns], "votes string, p_good double")
    rows = rows.join(F.broadcast(table), "votes")  # bounded as above
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    gone = judge(docs, threshold).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    gone = small(stored(gone, "quality-gone"), 24)
    return docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_hash")), "left_anti")
