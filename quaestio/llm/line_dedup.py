"""Operator 6: line dedup by a segment-partition edit join.

A line goes when an earlier line of the corpus equals it or is within ``max_edits``
character edits of it (earlier: smaller doc_id, then smaller line number). Lines are the
parts of a text between ``\\n``; a line without a word is never compared and always stays.
Lines under ``min_chars`` code points only match exactly: a few edits make another line
of a short one.

Equal lines meet by a 128-bit hash. For the others, each distinct line is cut into
``max_edits`` + 1 segments; of two lines within ``max_edits`` edits, one segment of the
shorter one is unchanged in the longer one (or, for equal lengths, in either), near the
same place. Every line probes the segments of lines up to ``max_edits`` shorter at the
places the length difference allows (hash of length, segment number and text), and each
pair that meets, unless some letter counts are too far apart for so few edits, is verified by a banded bit-parallel edit distance: one word of
2 * ``max_edits`` + 1 bits slides down the diagonal, whatever the length.

Everything is DataFrame work; only hashes are shuffled, texts only of lines that met
(and of rows that lose lines, where the list of these is too large to broadcast).

Nulls and odd input: a null text has no lines and stays null. A null doc_id comes before
all others. Lines of rows with the same doc_id and line number are equally early, so
rows that repeat in full keep the same lines. Empty tables give empty results; further
columns are kept by ``dedup``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaestio.llm.shared import small, stored

#: Letters counted in every line; lines that meet are only compared if the counts allow it.
LETTERS = "eanrtiohsldcu ,."
HAS_WORD = r"[^\x20\x09-\x0D]"


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    """Names a row of documents: rows with one id but different texts stay apart."""
    return [F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63))).alias("row_id"), F.xxhash64(text).alias("row_hash")]


def _lines(docs: DataFrame) -> DataFrame:
    """row_id, row_hash, pos, line of every line that has a word."""
    rows = docs.filter(F.col("text").isNotNull()).select(*_row_key(F.col("doc_id"), F.col("text")), "text")
    return (rows.select("row_id", "row_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter(F.col("line").rlike(HAS_WORD)))


def _id(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line, F.length(line)).alias("h2")]


def _segment(n: Column, i: int, k: int) -> tuple[Column, Column]:
    """(start from 1, length) of segment i (from 0) of k even ones of a line of n characters."""
    base, more = F.floor(n / k).cast("int"), n % k
    start = base * i + F.greatest(F.lit(0), more - (k - i)) + 1
    return start, base + (more >= k - i).cast("int")


def _key(line: Column, n: Column, i: int, start: Column, length: Column) -> Column:
    return F.xxhash64(F.lit(i), n, F.substring(line, start, length))


def segment_keys(line: Column, max_edits: int) -> Column:
    """The keys under which a line is indexed."""
    n, k = F.length(line), max_edits + 1
    return F.array(*[_key(line, n, i, *_segment(n, i, k)) for i in range(k)])


def probe_keys(line: Column, max_edits: int) -> Column:
    """The keys that lines of the same length or up to ``max_edits`` shorter may have
    been indexed under, if they are within ``max_edits`` edits."""
    n, k, out = F.length(line), max_edits + 1, []
    for less in range(max_edits + 1):
        m = n - less
        for i in range(k):
            start, length = _segment(m, i, k)
            left, right = i, max_edits - i
            for shift in range(max(-left, less - right), min(left, less + right) + 1):
                out.append(_key(line, m, i, start + shift, length))
    return F.array(*out)


def edit_distance_within(a: Column, b: Column, max_edits: int) -> Column:
    """True if the two texts are within ``max_edits`` edits, by a banded bit-parallel
    pass. Bit x of a word stands for row j - max_edits + x of column j, so vertical and
    horizontal differences of the band fit 2 * max_edits + 1 bits; the shift down the
    diagonal is the shift of the words by one. The score is that of the band's lowest row,
    which is at most 2 * max_edits above the best of the band: beyond 3 * max_edits the
    rest is skipped. Equal ends are cut off first."""
    k, width = max_edits, 2 * max_edits + 1
    mask = (1 << width) - 1

    def bound(value: Column, use) -> Column:
        """use(value), with value computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def common(x: Column, y: Column, head: bool) -> Column:
        """The longest n with n equal characters at the head or tail, by bisection."""
        most = F.least(F.length(x), F.length(y))
        end = (lambda s, n: F.substring(s, F.lit(1), n)) if head else (lambda s, n: F.substring(s, F.length(s) - n + 1, n))

        def halve(acc, _):
            return bound(F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int"), lambda mid: F.when(
                end(x, mid) == end(y, mid), F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(
                F.struct(acc["lo"].alias("lo"), F.greatest(acc["lo"], mid - 1).alias("hi"))))
        steps = F.sequence(F.lit(1), F.ceil(F.log2(most + 2)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), most.alias("hi")), halve, lambda acc: acc["lo"])

    def bit(flag: Column, x: int) -> Column:
        return F.when(flag, F.lit(1 << x)).otherwise(F.lit(0)).cast("long")

    def distance(p: Column, t: Column) -> Column:
        """p, t: arrays of characters, both not empty, lengths at most max_edits apart."""
        m = F.size(p)

        def step(acc, j):
            return F.when(acc["score"] > 3 * k, acc).otherwise(bound(F.get(t, j - 1), lambda c: column(acc, j, c)))

        def column(acc, j, c):
            eq = F.lit(0).cast("long")
            for x in range(width):
                row = j - k + x
                eq = eq.bitwiseOR(bit((row >= 1) & (row <= m) & F.coalesce(F.get(p, row - 1) == c, F.lit(False)), x))

            def after(d0, vp, vn, score):
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(F.lit(mask))
                hn = d0.bitwiseAND(vp)
                low = F.greatest(F.lit(0), F.least(F.lit(2 * k), m - j + k))  # row m, or the lowest row of the band
                at = F.element_at(F.array(*[F.lit(1 << x).cast("long") for x in range(width)]), (low + 1).cast("int"))
                down = (d0.bitwiseAND(F.lit(1 << (2 * k))) == 0).cast("int")
                along = (hp.bitwiseAND(at) != 0).cast("int") - (hn.bitwiseAND(at) != 0).cast("int")
                new = score + F.when(j + k <= m, down).otherwise(along)
                half = F.shiftright(d0, 1)
                return F.struct(hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp))).bitwiseAND(F.lit(mask)).alias("vp"),
                                half.bitwiseAND(hp).alias("vn"), new.alias("score"))

            def with_eq(e):
                d0 = ((e.bitwiseAND(acc["vp"]) + acc["vp"]).bitwiseXOR(acc["vp"]).bitwiseOR(e).bitwiseOR(acc["vn"])
                      .bitwiseAND(F.lit(mask)))
                return bound(d0, lambda d: after(d, acc["vp"], acc["vn"], acc["score"]))
            return bound(eq, with_eq)

        first = F.struct(F.lit(mask & ~((1 << k) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"),
                         F.least(F.lit(k), m).alias("score"))
        return F.aggregate(F.sequence(F.lit(1), F.size(t)), first, step, lambda acc: acc["score"])

    def middles(h):
        x, y = F.substring(a, h + 1, F.length(a)), F.substring(b, h + 1, F.length(b))
        return bound(F.struct(x.alias("x"), y.alias("y")), lambda s: bound(common(s["x"], s["y"], False), lambda n: compare(
            F.substring(s["x"], F.lit(1), F.length(s["x"]) - n), F.substring(s["y"], F.lit(1), F.length(s["y"]) - n))))

    def compare(x, y):
        def both(s):
            short, long = F.length(s["x"]), F.length(s["y"])
            apart = bound(F.struct(F.split(s["x"], "").alias("p"), F.split(s["y"], "").alias("t")), lambda c: distance(c["p"], c["t"]))
            return F.when((short == 0) | (long == 0), F.greatest(short, long) <= k).otherwise(apart <= k)
        return bound(F.struct(x.alias("x"), y.alias("y")), both)

    near = F.abs(F.length(a) - F.length(b)) <= k
    return F.when(near, bound(common(a, b, True), middles)).otherwise(F.lit(False))


def _letters(line: Column) -> Column:
    """How often some frequent letters stand in a line (modulo 16 each), as one number.
    An edit changes these counts by 2 in all at most."""
    def count(i: int, x: str) -> Column:
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(x), F.lit("")))
        return F.shiftleft(n.cast("long").bitwiseAND(F.lit(15)), 4 * i)
    return reduce(lambda x, y: x.bitwiseOR(y), [count(i, x) for i, x in enumerate(LETTERS)])


def _letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of the difference of two such counts."""
    def one(i: int) -> Column:
        d = F.abs(F.shiftright(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * i).bitwiseAND(F.lit(15)))
        return F.least(d, 16 - d)
    return reduce(lambda x, y: x + y, [one(i) for i in range(len(LETTERS))])


def _at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of docs (row_id, row_hash, text) that ``places`` (stored: _row_id,
    _row_hash, _pos) names, with the positions it gives; null where it names none."""
    row_id, row_hash = _row_key(F.col("doc_id"), F.col("text"))
    return docs.join(small(places, 48 + 4 * F.size("_pos")), (row_id == F.col("_row_id")) & (row_hash == F.col("_row_hash")), "left")


def _by_row(places: DataFrame, name: str) -> DataFrame:
    """row_id, row_hash, pos collected into one row per row of documents, stored."""
    return stored(places.groupBy(F.col("row_id").alias("_row_id"), F.col("row_hash").alias("_row_hash"))
                  .agg(F.collect_set("pos").alias("_pos")), name)


def _near(docs: DataFrame, again: DataFrame, distinct: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """(h1, h2) of the distinct lines with an earlier line within ``max_edits`` edits."""
    # every distinct line once: where it stands first
    first = F.coalesce(~F.array_contains("_pos", F.col("pos")), F.lit(True))
    line = F.col("line")
    keys = (_at_places(docs.select("doc_id", "text"), again).select("_pos", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
            .filter((F.length(line) >= min_chars) & first & line.rlike(HAS_WORD))
            .select(F.xxhash64(line).alias("id"), _letters(line).alias("letters"),
                    segment_keys(line, max_edits).alias("own"), probe_keys(line, max_edits).alias("others")))
    keys = stored(keys, "line-keys")
    one = keys.select(F.explode("own").alias("key"), F.col("id").alias("a"), F.col("letters").alias("a_letters"))
    two = keys.select(F.explode("others").alias("key2"), F.col("id").alias("b"), F.col("letters").alias("b_letters"))
    meet = ((F.col("key") == F.col("key2")) & (F.col("a") != F.col("b"))
            & (_letters_apart(F.col("a_letters"), F.col("b_letters")) <= 2 * max_edits))
    pairs = stored(one.join(two, meet).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    met = stored(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct(), "line-met")
    firsts = stored(distinct.join(small(met, 16), "h1").select("h1", "h2", "first", "row_hash"), "line-firsts")
    where = _by_row(firsts.select("first.*", "row_hash"), "line-where")
    found = _at_places(docs.select("doc_id", "text"), where).filter(F.col("_pos").isNotNull())
    texts = (found.select(F.explode("_pos").alias("pos"), F.split("text", "\n").alias("parts"))
             .select(F.get("parts", F.col("pos")).alias("line")).distinct().select(*_id(F.col("line")), "line")
             .join(firsts.select("h1", "h2", "first"), ["h1", "h2"]))
    texts = stored(texts, "line-texts")
    one, two = (texts.select(F.col("h1").alias(c), F.col("h2").alias(f"{c}2"), F.col("line").alias(f"{c}_line"),
                             F.col("first").alias(f"{c}_first")) for c in "ab")
    near = (pairs.join(one, "a").join(two, "b")
            .filter(edit_distance_within(F.col("a_line"), F.col("b_line"), max_edits))
            .filter(F.col("a_first") != F.col("b_first"))
            .select(F.when(F.col("a_first") > F.col("b_first"), F.struct("a", "a2")).otherwise(
                F.struct(F.col("b").alias("a"), F.col("b2").alias("a2"))).alias("later")))
    return near.select(F.col("later.a").alias("h1"), F.col("later.a2").alias("h2")).distinct()


def dropped_lines(docs: DataFrame, max_edits: int = 2, min_chars: int = 32) -> DataFrame:
    """_row_id, _row_hash and _pos (the line numbers that go), for rows that lose lines."""
    if min_chars < (max_edits + 1) * max(max_edits, 1):
        raise ValueError("min_chars must leave segments of at least max_edits characters")
    rows = stored(_lines(docs).select("row_id", "row_hash", "pos", *_id(F.col("line"))), "line-places")
    place = F.struct("row_id", "pos")
    distinct = (rows.groupBy("h1", "h2").agg(F.min(F.struct("row_id", "pos", "row_hash")).alias("f"), F.count("*").alias("n"))
                .select("h1", "h2", F.struct("f.row_id", "f.pos").alias("first"), F.col("f.row_hash").alias("row_hash"), "n"))
    distinct = stored(distinct, "line-ids")
    repeated = distinct.filter("n > 1").select("h1", "h2", "first")
    again = stored(rows.join(repeated, ["h1", "h2"]).filter(place > F.col("first")).select("row_id", "row_hash", "pos"), "line-again")
    near = stored(_near(docs, _by_row(again, "line-again-rows"), distinct, max_edits, min_chars), "line-near")
    # the first occurrence of a line with an earlier near one goes too
    firsts = (rows.join(distinct.select("h1", "h2", "first").join(small(near, 16), ["h1", "h2"]), ["h1", "h2"])
              .filter(place == F.col("first")).select("row_id", "row_hash", "pos"))
    return _by_row(again.union(firsts), "line-gone")


def dedup(docs: DataFrame, max_edits: int = 2, min_chars: int = 32) -> DataFrame:
    """``docs`` with the text of the lines that stay, and n_lines, n_dropped (long) and
    emptied: lines went and none with a word is left."""
    names = docs.columns
    rows = _at_places(docs, dropped_lines(docs, max_edits, min_chars))
    gone = F.col("_pos").isNotNull()
    stay = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_pos"), i))
    text = F.when(gone, F.array_join(stay, "\n")).otherwise(F.col("text"))
    n = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    more = {"n_lines": F.coalesce(n, F.lit(0)).cast("long"), "n_dropped": F.when(gone, F.size("_pos")).otherwise(0).cast("long"),
            "emptied": F.when(gone, ~F.array_join(stay, " ").rlike(HAS_WORD)).otherwise(F.lit(False))}
    kept = [docs[c] for c in names if c not in {"text", *more}]
    return rows.select(*kept, *[e.alias(c) for c, e in more.items()], text.alias("text"))
