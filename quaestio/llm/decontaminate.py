"""Operator 11: benchmark decontamination with an FM-index per training shard.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased. A test phrase is a window of ``width`` consecutive words of a benchmark item;
an item of fewer words is one phrase. A shard is about SHARD_BYTES of document text. Its
words are symbols (the rank of the word in the benchmark's vocabulary); words beyond that
vocabulary cannot stand in a phrase, so the shard's text is the runs between them, cut into
chunks that overlap by one word less than a phrase, which keeps every occurrence inside
one chunk. The shard's FM-index searches all distinct phrases backward through wavelet-tree
ranks, occurrences are located by sampled suffix positions, and their spans are merged to
the words that are hit.

The benchmark is taken in blocks of about BLOCK_BYTES of items (an item is never split):
a block's phrases go to the tasks with the plan, further blocks follow in further passes
over a written table that carries the spans and items found so far. No documents are
shuffled. Vocabularies are matched by 64-bit hashes of words: with 10^10 distinct words
against a block of 10^6, some 5 * 10^-4 false matches of a single word are to be expected
in all, and a false span would need a phrase of them.

Defined results: a null or empty text has no words and no hits. Items of equal item_id are
one item; a null item_id counts as the empty text. Repeated rows of documents get equal
results each, a null doc_id is carried along. An item without words has no phrase. A very
long text is hashed in pieces and indexed in shards of its own; it needs 8 bytes a word.
Empty tables: no documents give no rows, no items give documents without hits. Further
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm.fm_index import FMIndex
from quaestio.llm.shared import stored
from quaestio.llm.words import ALPHANUMERIC, WORD_ALPHANUMERIC, lowered, slices, texts, word_hashes

WIDTH = 10
SHARD_BYTES = 4 << 20
#: Symbols of one index: a very long text is indexed in several parts.
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 2 << 20
#: Words of a chunk, and how far apart the kept suffix positions are.
CHUNK, EVERY = 64, 8


class Phrases:
    """The distinct phrases of a block of benchmark items, as symbols."""

    def __init__(self, ids: list[str], text: pa.Array, width: int):
        hashes, counts = word_hashes(text, ALPHANUMERIC)
        self.vocabulary, symbols = np.unique(hashes, return_inverse=True)
        symbols = symbols + 1
        names, item_of = np.unique(np.array(ids, dtype=object), return_inverse=True) if ids else (np.zeros(0, object), [])
        self.names = names.tolist()
        found: dict[tuple, set[int]] = {}
        end = np.cumsum(counts)
        for item, a, b in zip(item_of, (end - counts).tolist(), end.tolist()):
            own = symbols[a:b].tolist()
            for i in range(max(len(own) - width + 1, 1) if own else 0):
                found.setdefault(tuple(own[i:i + width]), set()).add(int(item))
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.width = int(self.lengths.max()) if len(found) else 0
        self.symbols = np.zeros((len(found), self.width), np.int32)
        for i, p in enumerate(found):
            self.symbols[i, self.width - len(p):] = p
        self.first_item = np.concatenate(([0], np.cumsum([len(x) for x in found.values()]))).astype(np.int64)
        self.items = np.array([i for x in found.values() for i in sorted(x)], np.int64)
        self.bits = max(1, len(self.vocabulary).bit_length())

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words, 0 beyond the vocabulary."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)


def chunks(symbols: np.ndarray, ends: np.ndarray, least: int, width: int, size: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of the chunks of a shard: the runs of symbols other than 0
    within a document (``ends``: their ends) of at least ``least`` words, cut to ``size``
    words that overlap by width - 1."""
    size = max(size, 2 * width)
    known = symbols != 0
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    borders = ends[ends < len(symbols)]
    begins[borders] = known[borders]
    first = np.flatnonzero(begins)
    stops = known.copy()
    stops[:-1] &= ~known[1:]
    borders = ends[ends > 0] - 1
    stops[borders] = known[borders]
    length = np.flatnonzero(stops) + 1 - first
    keep = length >= least
    first, length = first[keep], length[keep]
    step = size - (width - 1)
    n = np.maximum(1, -(-(length - (width - 1)) // step))
    run = np.repeat(np.arange(len(first)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    begin = first[run] + nth * step
    return begin, np.minimum(size, first[run] + length[run] - begin)


def occurrences(symbols: np.ndarray, ends: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence of a phrase in a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.lengths) or not len(symbols):
        return none
    begin, length = chunks(symbols, ends, int(phrases.lengths.min()), phrases.width)
    if not len(begin):
        return none
    starts = np.cumsum(length + 1) - (length + 1)  # in the index's text, with the closing symbols
    text = np.zeros(int(length.sum()) + len(length), np.int64)
    shift = np.repeat(begin - starts, length + 1)
    word = np.arange(len(text)) + shift
    inside = np.ones(len(text), bool)
    inside[starts + length] = False
    text[inside] = symbols[word[inside]]
    index = FMIndex(text, phrases.bits, EVERY)
    lo, hi = index.search(phrases.symbols, phrases.lengths)
    n = np.maximum(hi - lo, 0)
    phrase = np.repeat(np.arange(len(n)), n)
    rows = np.arange(len(phrase)) + np.repeat(lo - (np.cumsum(n) - n), n)
    return word[index.locate(rows)], phrase


def parts(ends: np.ndarray, n: int, size: int, width: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) words of the indexes of a shard: whole documents while they fit,
    a longer one in parts that overlap by width - 1 words."""
    at = 0
    while at < n:
        last = int(np.searchsorted(ends, at + size, side="right")) - 1
        stop = int(ends[last]) if last >= 0 else 0
        if stop > at:
            yield at, stop
            at = stop
        else:
            whole = int(ends[last + 1])
            stop = min(at + size, whole)
            yield at, stop
            at = stop if stop == whole else stop - (width - 1)


def _merge(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which of n words stand in any of the spans."""
    change = np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _spans(hit: np.ndarray) -> bytes:
    """Merged spans of a document as pairs of (first word, end), 64-bit."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return edge.astype("<i8").tobytes()


FOUND = "n_words long, spans binary, items array<string>"


def _scan(phrases: Phrases):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            column = texts(batch.column("text"))
            for first, last in slices(column, SHARD_BYTES):
                n_words, spans, items = _shard(column.slice(first, last - first), batch.slice(first, last - first), phrases)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, last - first), batch.column("text").slice(first, last - first),
                     pa.array(n_words, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "text", "n_words", "spans", "items"])
    return run


def _shard(column: pa.Array, batch: pa.RecordBatch, phrases: Phrases) -> tuple[np.ndarray, list[bytes], list[list[str]]]:
    hashes, counts = word_hashes(column, ALPHANUMERIC)
    symbols = phrases.encode(hashes)
    del hashes
    ends = np.cumsum(counts)
    first, phrase = [], []
    for a, b in parts(ends, len(symbols), SHARD_WORDS, max(phrases.width, 1)):
        inner = ends[(ends > a) & (ends <= b)] - a
        own, which = occurrences(symbols[a:b], inner if len(inner) and inner[-1] == b - a else np.append(inner, b - a), phrases)
        first.append(own + a)
        phrase.append(which)
    first = np.concatenate(first) if first else np.zeros(0, np.int64)
    phrase = np.concatenate(phrase) if phrase else first
    hit = _merge(first, first + phrases.lengths[phrase], len(symbols)) if len(first) else np.zeros(len(symbols), bool)
    doc = np.searchsorted(ends, first, side="right")
    pair = np.unique(doc * len(phrases.lengths) + phrase)
    items: dict[int, set[str]] = {}
    for d, p in zip(*(x.tolist() for x in np.divmod(pair, max(len(phrases.lengths), 1)))):
        items.setdefault(d, set()).update(phrases.names[i] for i in phrases.items[phrases.first_item[p]:phrases.first_item[p + 1]])
    earlier_spans, earlier_items = batch.column("spans"), batch.column("items")
    spans, names = [b""] * len(column), [[]] * len(column)
    touched = set(items)
    if earlier_spans.null_count < len(column):
        touched |= {i for i, x in enumerate(earlier_spans) if x.as_py()}
    for d in touched:
        own = hit[ends[d] - counts[d]:ends[d]]
        if before := earlier_spans[d].as_py():
            edge = np.frombuffer(before, "<i8").reshape(-1, 2)
            own = own | _merge(edge[:, 0], edge[:, 1], len(own))
        spans[d] = _spans(own)
        names[d] = sorted(items.get(d, set()).union(earlier_items[d].as_py() or []))
    return counts, spans, names


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Phrases]:
    """The items in blocks of about ``block_bytes``, dealt by a hash of the item's id."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16)).first()[0] or 0
    n = int(-(-total // block_bytes)) or 1
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).toArrow()
        yield Phrases(block.column("item_id").to_pylist(), texts(block.column("text")), width)


def find(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document doc_id, text, n_words, ``spans`` (the merged removal spans as pairs of
    little-endian 64-bit word numbers, end exclusive) and ``items`` (sorted item_ids)."""
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("binary").alias("spans"),
                        F.lit(None).cast("array<string>").alias("items"))
    for k, phrases in enumerate(_blocks(benchmark, width, block_bytes)):
        if k:
            found = stored(found, "decontaminated")
        found = found.mapInArrow(_scan(phrases), f"doc_id {kind}, text string, {FOUND}")
    return found


def _summed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for spans, items in zip(batch.column("spans"), batch.column("items")):
            edge = np.frombuffer(spans.as_py() or b"", "<i8")
            names = items.as_py() or []
            out.append((int((edge[1::2] - edge[::2]).sum()), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(edge) > 0))
        cols = [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), *cols],
                                         names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def report(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    kind = dict(docs.dtypes)["doc_id"]
    return find(docs, benchmark, width).drop("text").mapInArrow(
        _summed, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        out = []
        for text, spans in zip(batch.column("text"), batch.column("spans")):
            text, edge = text.as_py(), np.frombuffer(spans.as_py() or b"", "<i8").reshape(-1, 2)
            if len(edge):
                at, kept, word = 0, [], 0
                words = WORD_ALPHANUMERIC.finditer(lowered(text))
                for a, b in edge.tolist():
                    for m in words:
                        if word == a:
                            kept.append(text[at:m.start()])
                        word += 1
                        if word == b:
                            at = m.end()
                            break
                text = "".join([*kept, text[at:]])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document doc_id and its text without the removal spans."""
    kind = dict(docs.dtypes)["doc_id"]
    return find(docs, benchmark, width).select("doc_id", "text", "spans").mapInArrow(_cut, f"doc_id {kind}, text string")


_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Phrases of both tables joined as texts; ``row`` tells repeated documents apart.
ORACLE = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS.format(_LOWERED)} AS w FROM benchmark),
phrase AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS n,
                  array_to_string(list_slice(w, i, i + least(len(w), {WIDTH}) - 1), ' ') AS p
           FROM item, unnest(range(1, greatest(len(w) - {WIDTH} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, row_number() OVER () AS row, {_WORDS.format(_LOWERED)} AS w FROM documents),
place AS (SELECT row, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
          FROM doc, (SELECT DISTINCT n FROM phrase) AS l, unnest(range(1, greatest(len(w) - n + 1, 0) + 1)) AS t(i)),
met AS (SELECT DISTINCT row, i, n, item_id FROM place JOIN phrase USING (n, p)),
hit AS (SELECT row, count(DISTINCT j) AS n_hit FROM met, unnest(range(i, i + n)) AS t(j) GROUP BY row),
named AS (SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT row, item_id FROM met) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN hit USING (row) LEFT JOIN named USING (row)"""
