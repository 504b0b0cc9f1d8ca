"""Operator 8: secret scans with character Markov models.

Base spans are fixed patterns (assignments, access keys, hex strings). Two models of
character pairs score every other token, a run of token characters of any length: one of
random strings, one of ordinary identifiers. A token is a secret if its log-likelihood
ratio is above a threshold.

Both models are trained on labelled samples of the corpus's training documents (nine in ten
by the crc32 of doc_id). Random: the values in base spans, and for each document two
strings of a hash of its id (hexadecimal and base64). Ordinary: the words of the texts (small
letters, the first may be a capital) outside of base spans, and identifiers made of them,
neighbouring words joined as in ``snake_case``, ``camelCase``, ``kebab-case``,
``CONSTANT_CASE``, paths, numbered names, numbers, dates. Other tokens have no label and are not
learned from, so secrets without a base span teach nothing, however many there are.

The threshold is chosen on the documents held out: the least ratio that no more than
FALSE_SHARE of their ordinary samples reach, and at least PRIOR, the log odds against a token being a
secret; ``held_out`` and ``shares`` tell what it finds there. Counts and histograms are summed in Spark; their size
depends on the alphabet and the bins alone.

Defined results: a null text is empty and has no spans; a null doc_id counts as the empty
text for the folds; rows that repeat are counted each and get equal results. Spans are in
code points, the end exclusive; spans that begin together stand in the order of KINDS. Very
long texts are scored in arrays of some fifty bytes a byte of text. Without training samples
no token is a secret. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm.words import slices, texts

# fixed values: kinds in the order of their names in a digest, and their patterns
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_HEXRUN = re.compile(r"[0-9a-f]{24,}")

#: Classes of the models: 0 stands around a token, then one class for each character of tokens.
CHARACTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CLASS = np.zeros(256, np.int64)
_CLASS[[ord(c) for c in CHARACTERS]] = np.arange(1, len(CHARACTERS) + 1)
CLASSES = len(CHARACTERS) + 1
TOKEN = re.compile("[A-Za-z0-9+/_=-]+")
WORD = re.compile("[A-Za-z]{2,12}")

HELD_OUT, FOLDS = 0, 10
#: Share of held-out ordinary samples that may reach the threshold, and its least value: the
#: log odds against a token being a secret, about one in thirty thousand.
FALSE_SHARE, PRIOR = 1e-6, 10.25
#: Bins of a ratio in the histograms of the held-out documents.
BIN, BINS = 0.25, 1200
#: Neighbouring words that are joined: one such group for every JOIN_EVERY words of a text.
JOIN_EVERY = 8
SLICE_BYTES = 1 << 20


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    # a run of hex digits of the least length; runs are maximal, so shorter ones can be skipped
    out += [(*m.span(), 2) for m in _HEXRUN.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def values(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The secret strings in base spans: of an assignment its value."""
    out = []
    for start, end, kind in spans:
        part = text[start:end]
        out.extend(TOKEN.findall(ASSIGN.fullmatch(part)[2] if kind == 0 else part))
    return out


def random_strings(doc: object) -> list[str]:
    """Two random strings that a document's id gives."""
    digest = hashlib.sha256(f"random:{'' if doc is None else doc}".encode()).digest()
    return [digest[:12 + digest[31] % 12].hex(), base64.b64encode(digest[:12 + digest[30] % 16]).decode().rstrip("=")]


def joined(text: str) -> list[str]:
    """Identifiers made of the text's words, one group of two to four for every JOIN_EVERY
    words, in eight styles by turns. The identifiers of a text grow with it."""
    words = WORD.findall(text)
    out = []
    for k in range(0, len(words) - 3, JOIN_EVERY):
        turn = k // JOIN_EVERY
        part, style = [w.lower() for w in words[k:k + 2 + turn % 3]], turn % 8
        if style == 1:
            out.append(part[0] + "".join(w.capitalize() for w in part[1:]))
        elif style == 5:
            n = crc32(" ".join(part).encode())
            out.append(f"{1950 + n % 100}-{n % 12 + 1:02}-{n % 28 + 1:02}" if turn % 4 == 1 else str(n)[:1 + n % 10] + str(n * n)[:n % 5])
        elif style == 6:
            out.append("_".join(part).upper() + (f"_{k % 1000}" if turn % 3 == 0 else ""))
        elif style == 7:
            out.append("/".join(part[:-1]) + "/" + "".join(w.capitalize() for w in part[-2:]))
        else:
            out.append({0: "_", 2: "-", 3: "/", 4: "_"}[style].join(part) + (str(k % 100) if style == 4 else ""))
    return out


def _coded(tokens: list[str]) -> np.ndarray:
    return _CLASS[np.frombuffer((" " + " ".join(tokens) + " ").encode("ascii"), np.uint8)]


def _pairs(code: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes; two that stand around tokens are no pair."""
    n = np.bincount(code[:-1] * CLASSES + code[1:], minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
    n[0, 0] = 0
    return n


def _code(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(classes of a text's code points with one before and one behind, 0 in spans and for
    characters of no token; the same as bytes do not matter: one entry a code point)."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.zeros(len(points) + 2, np.int64)
    code[1:-1] = _CLASS[np.where(points < 128, points, 0)]
    for start, end, _ in spans:
        code[start + 1:end + 1] = 0
    return code


def tokens_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first code point, end) of the tokens of a coded text."""
    inside = code != 0
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])


def words_of(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of small letters alone, but for a first capital."""
    starts, ends = tokens_of(code)
    other = np.concatenate(([0], np.cumsum(code > 26)))
    capital = (code[starts + 1] > 26) & (code[starts + 1] <= 52)
    plain = other[ends + 1] - other[starts + 1] == capital
    return starts[plain], ends[plain]


def _only(code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A coded text with these tokens alone."""
    change = np.bincount(starts + 1, minlength=len(code) + 1) - np.bincount(ends + 1, minlength=len(code) + 1)
    return code * np.cumsum(change)[:len(code)]


def fold(doc: object) -> int:
    return crc32(("" if doc is None else str(doc)).encode()) % FOLDS


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, CLASSES, CLASSES), np.int64)
    for batch in rows:
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
            if fold(doc) != HELD_OUT:
                text = text.as_py()
                spans = base_spans(text)
                total[0] += _pairs(_coded(values(text, spans) + random_strings(doc)))
                code = _code(text, spans)
                total[1] += _pairs(_only(code, *words_of(code)))
                total[1] += _pairs(_coded(joined(text)))
    used = np.flatnonzero(total.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total.ravel()[used], pa.int64())], names=["cell", "n"])


class Markov:
    """Log-likelihood ratio of random strings against ordinary identifiers."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        def rates(n: np.ndarray) -> np.ndarray:
            # one count spread over a row as its characters occur anywhere, so that rare pairs stay possible
            spread = (n.sum(axis=0) + 1.0) / (n.sum() + CLASSES)
            n = n + spread
            return n / n.sum(axis=1, keepdims=True)
        # the labelled secrets hold few alphabets: half of the random model is a uniform choice of the next character
        self.random = 0.5 * rates(random) + 0.5 / CLASSES
        self.ordinary = rates(ordinary)
        self.gain = np.log(self.random) - np.log(self.ordinary)

    def ratios(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The ratio of each token of a coded text, its two borders included."""
        if not len(starts):
            return np.zeros(0)
        upto = np.concatenate(([0.0], np.cumsum(self.gain[code[:-1], code[1:]])))
        return upto[ends + 1] - upto[starts]

    def ratio(self, token: str) -> float:
        code = _coded([token])
        return float(self.gain[code[:-1], code[1:]].sum())


def train(docs: DataFrame) -> Markov:
    """The models from every training document; only their tables reach the driver."""
    seen = docs.select("doc_id", "text").mapInArrow(_count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(2 * CLASSES * CLASSES)
    for r in seen:  # at most 2 * CLASSES ** 2 rows
        total[r.cell] = r.n
    return Markov(*total.reshape(2, CLASSES, CLASSES))


def _bin(ratios: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(ratios / BIN).astype(np.int64) + BINS // 2, 0, BINS - 1)


def _judge(model: Markov):
    """Histograms of the ratios of held-out samples: label 0 words of texts, 1 joined words, 2
    values of base spans, 3 random strings."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, BINS), np.int64)
        for batch in rows:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                if fold(doc) == HELD_OUT:
                    text = text.as_py()
                    spans = base_spans(text)
                    code = _code(text, spans)
                    starts, ends = words_of(code)
                    total[0] += np.bincount(_bin(model.ratios(code, starts, ends)), minlength=BINS)
                    for label, samples in ((1, joined(text)), (2, values(text, spans)), (3, random_strings(doc))):
                        code = _coded(samples)
                        total[label] += np.bincount(_bin(model.ratios(code, *tokens_of(code))), minlength=BINS)
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used // BINS, pa.int64()), pa.array(used % BINS, pa.int64()), pa.array(total.ravel()[used], pa.int64())],
                                         names=["label", "bin", "n"])
    return run


def held_out(docs: DataFrame, model: Markov) -> np.ndarray:
    """(labels, bins): how many held-out samples of each label have a ratio in each bin."""
    seen = (docs.select("doc_id", "text").mapInArrow(_judge(model), "label long, bin long, n long")
            .groupBy("label", "bin").agg(F.sum("n").alias("n")).collect())
    total = np.zeros((4, BINS), np.int64)
    for r in seen:  # at most 4 * BINS rows
        total[r.label, r.bin] = r.n
    return total


def threshold(seen: np.ndarray, false_share: float = FALSE_SHARE) -> float:
    """The least bin border that at most ``false_share`` of the ordinary samples reach, and at
    least PRIOR. With fewer ordinary samples than 1 / false_share, none may reach it."""
    ordinary = seen[0] + seen[1]
    above = np.concatenate((np.cumsum(ordinary[::-1])[::-1], [0]))  # samples in a bin or beyond
    first = int(np.flatnonzero(above <= false_share * ordinary.sum())[0])
    return max(PRIOR, (first - BINS // 2) * BIN)


def shares(seen: np.ndarray, at: float) -> dict[str, float]:
    """Of the held-out samples: recall of base values and random strings, share of ordinary
    tokens and joined words taken for secrets."""
    first = int(np.ceil(at / BIN)) + BINS // 2
    part = seen[:, first:].sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
    return dict(zip(("false_tokens", "false_joined", "recall_values", "recall_random"), part.tolist()))


def scan(text: str, model: Markov, least: float) -> tuple[list, list]:
    """(base spans, all spans) of a text."""
    base = base_spans(text)
    code = _code(text, base)
    starts, ends = tokens_of(code)
    hit = model.ratios(code, starts, ends) >= least
    more = [(a, b, 3) for a, b in zip(starts[hit].tolist(), ends[hit].tolist())]
    return base, sorted(base + more, key=lambda s: (s[0], s[2]))


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, end, kind in spans)


def _find(model: Markov, least: float):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = texts(batch.column("text"))
            for first, last in slices(column, SLICE_BYTES):
                out = []
                for text in column.slice(first, last - first).to_pylist():
                    base, every = scan(text, model, least)
                    n = [sum(k == kind for _, _, k in base) for kind in range(3)]
                    out.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)))
                cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, [pa.int64()] * 3 + [pa.string()] * 2)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *cols],
                                                 names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])
    return run


def find(docs: DataFrame, least: float | None = None) -> DataFrame:
    """Per document doc_id, the numbers of base spans, base_sha256 and spans. ``least`` is the
    threshold; without it, it is chosen on the held-out documents."""
    model = train(docs)
    if least is None:
        least = threshold(held_out(docs, model))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        _find(model, least), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
