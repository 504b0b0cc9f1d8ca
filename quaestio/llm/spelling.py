"""Operator 12: grouping of spelling variants by bidirectional FM-index search schemes.

A run of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z are lower-cased) of a document is
hashed with its doc_id; where a divisor divides the hash, one of its code points is deleted
(as the contract asks: it plants variants). The vocabulary holds the results of at least
``least_chars`` code points that occur at least ``least_n`` times in the corpus.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.
Then one half of either stands unchanged in the other: its first half at the other's
begin, or its second half at the other's end. So a word is sent as a query to the shards
of its two halves, and as an entry to the shards of the halves that a word of its length,
one more or one less can have. A shard builds the FM-index of its delimited words and of
the reversed ones and keeps both intervals of a match in step (a bidirectional index):

* first half exact: matched backward from its last code point to the delimiter, then
  extended to the right over the second half allowing one error, up to the delimiter;
* second half exact: matched backward from the delimiter, then extended to the left over
  the first half allowing one error, up to the delimiter.

The words are sorted, so the suffix-rank interval of a delimited match is the number of its
word. A half that more than SHARD_WORDS entries share is split into shards by the entries'
hash, and its queries go to all of them. Counts are summed per task before the shuffle;
forms are followed by pointer doubling over written tables. Nothing reaches the driver.

Defined results: a null or empty text has no runs; a null doc_id is hashed as the empty
text; repeated rows count again. Runs left empty or short by the deletion are no words.
Among near words of equal n the smallest in code-point order is taken. A very long text is
read in pieces cut between runs. An empty table gives no words; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm.fm_index import FMIndex
from quaestio.llm.shared import stored
from quaestio.llm.words import lowered

LETTERS = "A-Za-zÀ-ÿ"
RUN = re.compile(f"[{LETTERS}]+")
_NO_LETTER = re.compile(f"[^{LETTERS}]")
DIVISOR, LEAST_CHARS, LEAST_N = 97, 5, 3
#: Entries of a shard on average, and of one half within a shard at most.
SHARD_WORDS = 50_000
#: Distinct words a task counts before it passes them on, code points read at a time,
#: and queries searched at a time.
HELD_WORDS, PIECE, QUERIES = 200_000, 1 << 20, 4096

BITS = 7
_CODE = np.zeros(256, np.int64)  # code point -> symbol, in code-point order; 0 closes a word
_CODE[[*range(97, 123), *range(0xC0, 0x100)]] = np.arange(1, 91)


def runs(text: str) -> Iterator[list[str]]:
    """The lower-cased runs of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            m = _NO_LETTER.search(text, end)
            end = m.start() if m else len(text)
        yield RUN.findall(lowered(text[at:end]))
        at = end


def written(doc: str, run: str, start: int, divisor: int = DIVISOR) -> str:
    """A run of document ``doc`` with the code point deleted that its hash tells; ``start``
    is the hash of the document's id and colon."""
    h = crc32(run.encode(), start)
    if h % divisor:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def _count(divisor: int, least: int):
    def flush(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in rows:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for found in runs(text.as_py() or ""):
                    for w, n in Counter(found).items():
                        if len(w) >= least:
                            w = written(doc, w, start, divisor)
                            if len(w) >= least:
                                total[w] += n
                    if len(total) > HELD_WORDS:
                        yield flush(total)
                        total.clear()
        yield flush(total)
    return run


def vocabulary(docs: DataFrame, divisor: int = DIVISOR, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N) -> DataFrame:
    """(word, n): the words and how often they occur in all documents."""
    return (docs.select("doc_id", "text").mapInArrow(_count(divisor, least_chars), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n))


# --- the search of a shard -----------------------------------------------------------------


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row per word of symbols, 0 behind its end; lengths)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    grid = np.zeros((len(words), int(lengths.max()) + 1 if len(words) else 1), np.int64)
    grid[np.arange(grid.shape[1]) < lengths[:, None]] = _CODE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    return grid, lengths


class Delimited:
    """A bidirectional FM-index of sorted distinct words. A match is (lo, hi) in the index
    and ``back``, the first row of the reversed match in the index of the reversed words."""

    def __init__(self, words: list[str]):
        self.forward, self.reverse = (FMIndex(_CODE[np.frombuffer(("\0".join(x) + "\0").encode("latin-1"), np.uint8)], BITS)
                                      for x in (words, sorted(w[::-1] for w in words)))

    def left(self, c, lo, hi, back):
        """Matches extended by ``c`` to the left."""
        to_lo, to_hi = self.forward.left(c, lo, hi)
        return to_lo, to_hi, back + self.forward.bwt.less(c, lo, hi)

    def right(self, c, lo, hi, back):
        """Matches extended by ``c`` to the right."""
        end = back + hi - lo
        to_lo, to_hi = self.reverse.left(c, back, end)
        lo = lo + self.reverse.bwt.less(c, back, end)
        return lo, lo + to_hi - to_lo, to_lo

    def all_left(self, lo, hi, back):
        """Every extension to the left: (match, symbol, lo, hi, back)."""
        who, c, a, b, less = self.forward.bwt.children(lo, hi)
        return who, c, self.forward.first[c] + a, self.forward.first[c] + b, back[who] + less

    def all_right(self, lo, hi, back):
        """Every extension to the right."""
        who, c, a, b, less = self.reverse.bwt.children(back, back + hi - lo)
        lo = lo[who] + less
        return who, c, lo, lo + b - a, self.reverse.first[c] + a


def _kept(states: tuple, mask: np.ndarray) -> tuple:
    return tuple(x[mask] for x in states)


def near(index: Delimited, grid: np.ndarray, lengths: np.ndarray, first_half: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word number) of the words that differ from a query (a row of symbols) by one
    error, its first (or second) half exact."""
    half = lengths // 2
    m = len(lengths)
    step, every = (index.right, index.all_right) if first_half else (index.left, index.all_left)
    lo, hi, back = np.zeros(m, np.int64), np.full(m, index.forward.n), np.zeros(m, np.int64)
    number = np.arange(m)

    def exact(live, c):
        lo[live], hi[live], back[live] = index.left(c, lo[live], hi[live], back[live])

    if not first_half:
        exact(number, np.zeros(m, np.int64))
    size = half if first_half else lengths - half
    for t in range(int(size.max()) if m else 0):
        live = np.flatnonzero((t < size) & (hi > lo))
        exact(live, grid[live, (size if first_half else lengths)[live] - 1 - t])
    if first_half:
        live = np.flatnonzero(hi > lo)
        exact(live, np.zeros(len(live), np.int64))
    # what is left of the query: ``done`` of its other half's ``todo`` code points are matched
    todo = lengths - half if first_half else half

    def symbol(q, done):
        return grid[q, half[q] + done] if first_half else grid[q, half[q] - 1 - done]

    met = hi > lo
    clean = (number[met], np.zeros(int(met.sum()), np.int64), lo[met], hi[met], back[met])  # (query, done, lo, hi, back), no error yet
    spent = tuple(np.zeros(0, np.int64) for _ in range(5))  # the same, the error made
    pairs = []
    while len(clean[0]) or len(spent[0]):
        q, done, *at = spent
        end = done == todo[q]
        closed = _kept(spent, end)
        a, b, _ = step(np.zeros(len(closed[0]), np.int64), *closed[2:])
        whole = b > a
        # the row of a match between delimiters is its word's number: closing symbols come first, in the words' order
        pairs.append((closed[0][whole], a[whole]))
        q, done, *at = _kept(spent, ~end)
        a, b, r = step(symbol(q, done), *at)
        spent = _kept((q, done + 1, a, b, r), b > a)
        q, done, *at = clean
        more = done < todo[q]
        skipped = _kept((q, done + 1, *at), more)  # the query's code point is missing in the word
        who, c, a, b, r = every(*at)
        want = np.where(more[who], symbol(q[who], np.minimum(done[who], todo[q[who]] - 1)), -1)
        other = (c != 0) & (c != want)
        inserted = _kept((q[who], done[who], a, b, r), other)
        replaced = _kept((q[who], done[who] + 1, a, b, r), other & more[who])
        clean = _kept((q[who], done[who] + 1, a, b, r), c == want)
        spent = tuple(np.concatenate(x) for x in zip(spent, skipped, inserted, replaced))
    if not pairs:
        return number[:0], number[:0]
    q, word = (np.concatenate(x) for x in zip(*pairs))
    return q, word


def _search(table: pa.Table) -> pa.Table:
    """The near pairs of a shard: rows (word, first_half, query)."""
    words = np.array(table.column("word").to_pylist(), dtype=object)
    side, query = (table.column(c).to_numpy().astype(bool) for c in ("first_half", "query"))
    left, right = [], []
    entries = sorted(set(words[~query].tolist()))
    if entries:
        index = Delimited(entries)
        for first_half in (True, False):
            asked = sorted(set(words[query & (side == first_half)].tolist()), key=lambda w: (len(w), w))
            for k in range(0, len(asked), QUERIES):
                part = asked[k:k + QUERIES]
                q, word = near(index, *symbols(part), first_half)
                pair = np.unique(q * len(entries) + word)
                left += [part[i] for i in (pair // len(entries)).tolist()]
                right += [entries[i] for i in (pair % len(entries)).tolist()]
    return pa.table({"word": pa.array(left, pa.string()), "near": pa.array(right, pa.string())})


def _halves(words: DataFrame) -> DataFrame:
    """Rows (word, first_half, query, half): as a query its own halves, as an entry the
    halves that queries near to it can have."""
    n = F.length("word")

    own = [F.struct(F.lit(True).alias("first_half"), F.lit(True).alias("query"), F.substring("word", F.lit(1), F.floor(n / 2).cast("int")).alias("half")),
           F.struct(F.lit(False).alias("first_half"), F.lit(True).alias("query"),
                    F.substring("word", (F.floor(n / 2) + 1).cast("int"), n).alias("half"))]
    entries = []
    for k in (-1, 1):  # a query of n + k code points; one of n has the halves of n - 1 or n + 1
        first = F.floor((n + k) / 2).cast("int")
        entries.append(F.struct(F.lit(True).alias("first_half"), F.lit(False).alias("query"), F.substring("word", F.lit(1), first).alias("half")))
        second = (n + k - first).cast("int")
        entries.append(F.struct(F.lit(False).alias("first_half"), F.lit(False).alias("query"),
                                F.substring("word", (n - second + 1).cast("int"), second).alias("half")))
    return words.select("word", F.explode(F.array(*own, *entries)).alias("x")).select("word", "x.*")


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, near) for all near words of ``words`` (a stored table of distinct words)."""
    halves = stored(_halves(words.select("word")), "spelling-halves")
    n_shards = max(1, -(-4 * words.count() // shard_words))
    hot = (halves.filter(~F.col("query")).groupBy("first_half", "half").agg(F.count("*").alias("n"))
           .filter(F.col("n") > shard_words)
           .select("first_half", "half", F.ceil(F.col("n") / shard_words).cast("int").alias("subs")))
    subs = F.coalesce("subs", F.lit(1))
    sub = F.when(F.col("query"), F.sequence(F.lit(0), subs - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), subs).cast("int")))
    dealt = (halves.join(hot, ["first_half", "half"], "left").withColumn("sub", F.explode(sub))
             .withColumn("shard", F.pmod(F.xxhash64("first_half", "half", "sub"), F.lit(n_shards))))
    return (dealt.select("shard", "word", "first_half", "query").groupBy("shard")
            .applyInArrow(_search, "word string, near string").distinct())


def group(docs: DataFrame, divisor: int = DIVISOR, least_chars: int = LEAST_CHARS, least_n: int = LEAST_N,
          shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = stored(vocabulary(docs, divisor, least_chars, least_n), "spelling-words")
    pairs = near_pairs(words, shard_words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"),
                                     F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    forms = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "spelling-forms")
    # roots: each round a word takes over the root of its root; n doubles on the way, so the ways are short
    roots = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.alias("a").join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        roots = stored(onward.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        moved = roots.agg(F.max("moved")).first()[0]
        roots = roots.drop("moved")
        if not moved:
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# --- the same in DuckDB ----------------------------------------------------------------------

_TABLE = "SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: " \
         "xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM range(256) AS t(i))"
ORACLE = f"""
WITH crc_table AS ({_TABLE}),
run AS (SELECT doc_id, w, count(*) AS k FROM (
          SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents) GROUP BY doc_id, w),
byte AS (SELECT doc_id, w, k, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''),
                lambda c: CAST(unicode(c) AS BIGINT)) AS cp FROM run WHERE length(w) >= {LEAST_CHARS}),
hashed AS (SELECT w, k, xor(list_reduce([4294967295] || flatten(list_transform(cp,
                    lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END)),
                  lambda a, b: xor(a >> 8, crc[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) AS h
           FROM byte, crc_table),
cut AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN left(w, CAST(h % length(w) AS INTEGER)) || substr(w, CAST(h % length(w) AS INTEGER) + 2)
               ELSE w END AS word, k FROM hashed),
words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(k) >= {LEAST_N}),
gap AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
pair AS (SELECT a.word, b.word AS near FROM gap AS a JOIN gap AS b USING (i, rest) WHERE a.word <> b.word
         UNION SELECT g.word, w.word FROM gap AS g JOIN words AS w ON g.rest = w.word
         UNION SELECT w.word, g.word FROM gap AS g JOIN words AS w ON g.rest = w.word),
best AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY b.n DESC, p.near) AS near, max(b.n) AS near_n
         FROM pair AS p JOIN words AS b ON p.near = b.word GROUP BY p.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
                 CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM words AS w LEFT JOIN best USING (word)),
way AS (WITH RECURSIVE step AS (SELECT word, form AS root FROM forms WHERE form IS NOT NULL
                                UNION SELECT s.word, f.form FROM step AS s JOIN forms AS f ON s.root = f.word WHERE f.form IS NOT NULL)
        SELECT word, root FROM step JOIN (SELECT word AS root FROM forms WHERE form IS NULL) USING (root))
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN way USING (word)"""
