"""Operator 9: n-gram Jaccard join, size-aware (heavy-light).

A document's set holds the hashes of its distinct word shingles (A-Z lower-cased); equal
sets are one node. Nodes link when |intersection| >= similarity * |union|, in whole numbers
(similarity is a fraction). op9's contract sets shingles of 3 words and 9/10; a caller
without one names its own, as the pipeline does (5 words, 4/5).

* Light nodes (up to a boundary in size): two sets of sizes a <= b link exactly when they
  share a subset of t(a, b) shingles, the least intersection that suffices. Each light
  node enumerates those subsets for every partner size, as hashes; nodes that meet under
  a key are linked without any further look.
* Heavy nodes: inverted lists. A linked pair shares shingles among the rarest
  |x| - ceil(similarity |x|) + 1 of both sets, so only those are listed. Before that, a cheaper
  test on shingles in hash order leaves out nodes that cannot have a partner: with l more
  places in the prefix, linked nodes share l of them, so a node with fewer shared ones
  has no link. Only the other nodes' sets are built in full and ranked by frequency.
  Lists are worked off in stars, every node against two nodes of its list, in a few
  rounds while lists hold many pairs of different components; then, of what is not yet
  one component, the remaining pairs of a list. A large group of near copies thus costs
  a few stars, not all of its pairs; a component never misses a link.
* The boundary minimises the rows to enumerate plus the postings to list and verify,
  from the counts of nodes and the mean list lengths by size.

Result: one row per document with its class. Nulls and odd input: null texts and texts
without words have an empty set and are linked with nothing (component_id: their own
doc_id). A null doc_id takes part in links but is never a component_id unless all of
the component are null. Rows may repeat or share a doc_id: nodes are sets, not ids.
Columns other than doc_id and text are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestio.llm import counts as C
from quaestio.llm.components import components
from quaestio.llm.shared import small, stored
from quaestio.llm.words import mix, release, slices, texts, word_hashes

#: Words of a shingle and least Jaccard similarity of linked sets in op9's contract.
WIDTH, SIMILARITY = 3, Fraction(9, 10)
#: Sizes considered as the boundary between light and heavy sets.
MOST_LIGHT = 24
#: Sketch entries or set members that a block holds on average.
BLOCK_KEYS = 400_000
#: Rounds of stars at most, before what lists still hold is compared in pairs.
TURNS = 3
_MULTIPLIERS = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def as_fraction(similarity: float | str | Fraction) -> Fraction:
    """``similarity`` as it is written: 0.8 is 4/5."""
    found = Fraction(str(similarity))
    if not 0 < found <= 1:
        raise ValueError("similarity must be over 0 and at most 1")
    return found


def least_overlap(a: int, b: int, similarity: Fraction = SIMILARITY) -> int:
    """The least intersection of linked sets of a and b members."""
    p, q = similarity.as_integer_ratio()
    return -(-p * (a + b) // (p + q))


def must_share(n: int, similarity: Fraction = SIMILARITY) -> int:
    """The least intersection of a set of n members with any linked set."""
    p, q = similarity.as_integer_ratio()
    return -(-p * n // q)


def most_members(n: int, similarity: Fraction = SIMILARITY) -> int:
    """The most members of a set linked with one of n members."""
    p, q = similarity.as_integer_ratio()
    return q * n // p


def extra(n: int) -> int:
    """Places added to the prefix in hash order, and the shared shingles asked for."""
    return max(1, n // 8)


def sketch_size(n: int, similarity: Fraction = SIMILARITY) -> int:
    return n - must_share(n, similarity) + extra(n)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a text column."""
    for first, last in slices(column):
        hashes, counts = word_hashes(texts(column.slice(first, last - first)))
        at = 0
        m = [np.uint64(x) for x in _MULTIPLIERS]
        whole = hashes[:max(0, len(hashes) - width + 1)] * m[0]
        for i in range(1, width):
            whole = whole + mix(hashes[i:len(hashes) - width + 1 + i] + np.uint64(i)) * m[i % 5]
        whole = mix(whole)
        for n in counts.tolist():
            if n >= width:
                yield np.unique(whole[at:at + n - width + 1])
            elif n:  # fewer words than a shingle: the whole sequence is one
                value = np.uint64(n)
                for h in hashes[at:at + n]:
                    value = mix(np.array([value]) * m[4] + h)[0]
                yield np.array([value], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            at += n


def _fingerprint(members: np.ndarray, salt: int) -> int:
    return int(mix(members ^ np.uint64(_MULTIPLIERS[salt])).sum(dtype=np.uint64).astype(np.int64))


def _sketches(width: int, similarity: Fraction):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [], [], [], []
            for members in shingle_sets(batch.column("text"), width):
                n = len(members)
                head = members if n <= MOST_LIGHT else members[:sketch_size(n, similarity)]
                for x, v in zip(out, (n, _fingerprint(members, 0), _fingerprint(members, 1), head.tobytes())):
                    x.append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("text_hash"),
                 *[pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]],
                names=["doc_id", "text_hash", "n_shingles", "node", "node2", "sketch"])
        release()
    return run


def subset_keys(members: np.ndarray, most: int, similarity: Fraction = SIMILARITY) -> Iterator[tuple[int, int, int]]:
    """(key, key2, role) of every subset that a light set can share with a partner of at most
    ``most`` members; the keys are 128 bits of a sum of the subset's members, mixed twice. Role
    1: the smaller set of the pair, 2: the larger, 3: equal sizes."""
    n = len(members)
    both = members, mix(members ^ np.uint64(_MULTIPLIERS[2]))
    total = [m.sum(dtype=np.uint64) for m in both]
    for other in range(must_share(n, similarity), min(most, most_members(n, similarity)) + 1):
        a, b = min(n, other), max(n, other)
        least = least_overlap(a, b, similarity)
        if least > a:
            continue
        role = 3 if a == b else 1 if n == a else 2
        name = np.uint64((a * 1000 + b) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        keys = [mix((t - np.array([sum(x) & (1 << 64) - 1 for x in combinations(m.tolist(), n - least)], np.uint64)) ^ name)
                .astype(np.int64).tolist() for m, t in zip(both, total)]
        for key, key2 in zip(*keys):
            yield key, key2, role


def n_subsets(n: int, most: int, similarity: Fraction = SIMILARITY) -> int:
    others = range(must_share(n, similarity), min(most, most_members(n, similarity)) + 1)
    return sum(comb(n, n - least) for o in others if (least := least_overlap(n, o, similarity)) <= min(n, o))


def _light_keys(most: int, similarity: Fraction):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [(*key, node) for node, s in zip(batch.column("node").to_pylist(), batch.column("sketch").to_pylist())
                   for key in subset_keys(np.frombuffer(s, np.uint64), most, similarity)]
            for at in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out[at:at + 100_000])],
                                                 names=["key", "key2", "role", "node"])
    return run


def _ask(ranges: int, column: str):
    def run(table: pa.Table) -> pa.Table:
        release()
        keys, own = C.summed(np.frombuffer(b"".join(x.as_py() for x in table[column]), np.uint64))
        return pa.Table.from_batches([C.ask(table["block"][0].as_py(), keys, own, ranges)])
    return run


def _known(table: pa.Table, answered: pa.Table, column: str):
    """The members of a block's rows in one array, their counts over all blocks, and the rows' lengths."""
    parts = [np.frombuffer(x.as_py(), np.uint64) for x in table[column]]
    flat = np.concatenate(parts)
    keys, own = C.summed(flat)
    total = C.look_up(keys, *C.answers(answered), own)
    return flat, total[np.searchsorted(keys, flat)], [len(x) for x in parts]


def _live(similarity: Fraction):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        release()
        if not len(table):
            return pa.table({"node": pa.array([], pa.int64())})
        _, total, lengths = _known(table, answered, "sketch")
        out, at = [], 0
        for node, n, k in zip(table["node"].to_pylist(), table["n_shingles"].to_pylist(), lengths):
            if (total[at:at + k] > 1).sum() >= extra(must_share(n, similarity)):
                out.append(node)
            at += k
        return pa.table({"node": pa.array(out, pa.int64())})
    return run


#: A posting: the node's size, the token's place among its members (rarest first), and the
#: node's shape: for each value of the upper 8 bits, whether an odd number of members has it.
SHAPE = ("shape0", "shape1", "shape2", "shape3")
POSTING = ("token", "node", "n", "place", *SHAPE)


def _postings(similarity: Fraction):
    def run(table: pa.Table, answered: pa.Table) -> pa.Table:
        release()
        out: list[list[np.ndarray]] = [[] for _ in POSTING]
        if len(table):
            flat, total, lengths = _known(table, answered, "members")
            at = 0
            for node, n in zip(table["node"].to_pylist(), lengths):
                own, often = flat[at:at + n], total[at:at + n]
                at += n
                rare = np.lexsort((own, often))[:n - must_share(n, similarity) + 1]
                place = np.flatnonzero(often[rare] > 1)
                rare = rare[place]
                odd = np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256) & 1
                shape = np.packbits(odd.astype(np.uint8)).view(np.int64)
                for x, v in zip(out, (own[rare].view(np.int64), np.full(len(rare), node), np.full(len(rare), n), place,
                                      *[np.full(len(rare), part) for part in shape])):
                    x.append(v)
        return pa.table({k: pa.array(np.concatenate(v) if v else [], pa.int64()) for k, v in zip(POSTING, out)})
    return run


def _full_sets(width: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [(_fingerprint(x, 0), _fingerprint(x, 1), x.tobytes()) for x in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3,
                                                                             (pa.int64(), pa.int64(), pa.binary()))],
                                             names=["node", "node2", "members"])
        release()
    return run


def _linked(similarity: Fraction):
    p, q = similarity.as_integer_ratio()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(q * both >= p * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    x = sets.select(F.col("node").alias("u"), F.col("members").alias("x"))
    y = sets.select(F.col("node").alias("v"), F.col("members").alias("y"))
    return pairs.join(x, "u").join(y, "v").mapInArrow(_linked(similarity), "u long, v long")


def _fits(a, b, similarity: Fraction):
    """Whether the nodes of two postings of a token can link, if it is the first they
    share: by size, by the members left behind it, and by how far their shapes are apart
    (each bit that differs stands for at least one member that only one of them has)."""
    p, q = similarity.as_integer_ratio()
    least = F.ceil(p * (a["n"] + b["n"]) / (p + q))
    behind = F.least(a["n"] - a["place"], b["n"] - b["place"])  # the token itself included
    apart = sum((F.bit_count(a[c].bitwiseXOR(b[c])) for c in SHAPE), F.lit(0))
    return ((q * F.least(a["n"], b["n"]) >= p * F.greatest(a["n"], b["n"])) & (behind >= least)
            & (apart <= a["n"] + b["n"] - 2 * least))


def _posting(prefix: str = "") -> dict:
    return {c: F.col(prefix + c) for c in ("n", "place", *SHAPE)}


def boundary(nodes: DataFrame, similarity: Fraction = SIMILARITY) -> int:
    """The largest size of light sets at the least cost: subsets to enumerate, against
    postings to list and, for each, the members to merge per node met."""
    sizes = {r.n: r for r in nodes.filter(F.col("n_shingles").between(1, MOST_LIGHT)).select(
        F.col("n_shingles").alias("n"), F.xxhash64("sketch").alias("s"), F.substring("sketch", 1, 8).alias("t"))
        .groupBy("n").agg(F.count("*").alias("rows"), F.approx_count_distinct("t").alias("lists")).collect()}
    best, least = 0, None
    for x in range(MOST_LIGHT + 1):
        cost = 0.0
        for n, r in sizes.items():
            if n <= x:
                cost += r.rows * n_subsets(n, x, similarity)
            if n >= must_share(x + 1, similarity):
                listed = n - must_share(n, similarity) + 1
                cost += r.rows * (sketch_size(n, similarity) + listed * n * (r.rows / max(1, r.lists) - 1))
        if least is None or cost < least:
            best, least = x, cost
    return best


def _large_links(docs: DataFrame, nodes: DataFrame, light: int, width: int,
                 similarity: Fraction) -> tuple[DataFrame, DataFrame] | None:
    """(postings, sets) of the heavy nodes that can have a partner."""
    heavy = nodes.filter(F.col("n_shingles") >= must_share(light + 1, similarity))
    p, q = similarity.as_integer_ratio()
    places = f"n_shingles - ceil({p} * n_shingles / {q}) + greatest(1, floor(n_shingles / 8))"  # sketch_size
    keep = (F.when(F.col("n_shingles") <= MOST_LIGHT, F.expr(f"substring(sketch, 1, 8 * cast({places} as int))"))
            .otherwise(F.col("sketch")))
    size = heavy.agg(F.sum(F.octet_length("sketch"))).first()[0] or 0
    if not size:
        return None
    blocks = max(1, size // 8 // BLOCK_KEYS)
    heavy = heavy.select("node", "n_shingles", keep.alias("sketch"), F.pmod("node", F.lit(blocks)).alias("block"))
    asked = heavy.groupBy("block").applyInArrow(_ask(C.n_ranges(size), "sketch"), C.FIELDS)
    answered = stored(C.totals(asked).filter("block >= 0"), "shingles-shared")
    live = stored(heavy.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(_live(similarity), "node long")
                  .join(nodes.select("node", "node2", "doc_id"), "node"), "sets-live")
    ids = live.select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select("doc_id", "text")
    rows = rows.join(small(stored(ids, "sets-ids"), 16), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
    sets = (rows.mapInArrow(_full_sets(width), "node long, node2 long, members binary")
            .join(small(live.select("node", "node2"), 24), ["node", "node2"], "left_semi").dropDuplicates(["node"]))
    sets = stored(sets.select("node", "members"), "sets")
    size = sets.agg(F.sum(F.octet_length("members"))).first()[0] or 0
    blocks = max(1, size // 8 // BLOCK_KEYS)
    dealt = sets.withColumn("block", F.pmod("node", F.lit(blocks)))
    asked = dealt.groupBy("block").applyInArrow(_ask(C.n_ranges(size), "members"), C.FIELDS)
    answered = C.totals(asked).filter("block >= 0")
    postings = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        _postings(similarity), ", ".join(f"{c} long" for c in POSTING))
    return stored(postings, "postings"), sets


def classes(docs: DataFrame, width: int = WIDTH, similarity: float | Fraction = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): per document doc_id, text_hash, n_shingles and node; per node with a
    link the root of its component."""
    similarity = as_fraction(similarity)
    text_hash = F.xxhash64("text")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), text_hash.alias("text_hash"))
    rows = stored(rows.mapInArrow(_sketches(width, similarity), "doc_id long, text_hash long, n_shingles long, node long, node2 long, sketch binary"),
                  "shingles")
    nodes = stored(rows.filter("n_shingles > 0").groupBy("node", "node2", "n_shingles")
                   .agg(F.min("doc_id").alias("doc_id"), F.first("sketch").alias("sketch")), "nodes")
    light = boundary(nodes) if similarity == SIMILARITY else boundary(nodes, similarity)
    keys = (nodes.filter(F.col("n_shingles") <= light).select("node", "sketch")
            .mapInArrow(_light_keys(light, similarity), "key long, key2 long, role long, node long"))
    meet = keys.groupBy("key", "key2").agg(F.min("node").alias("v"), F.max("node").alias("w"), F.bit_or("role").alias("roles"))
    meet = meet.filter((F.col("v") != F.col("w")) & (F.col("roles") == 3)).select("key", "key2", "v")
    links = stored(keys.join(meet, ["key", "key2"]).select(F.col("node").alias("u"), "v").filter("u != v").distinct(), "links-light")
    found = _large_links(docs, nodes, light, width, similarity)
    if found is None:
        return rows, components(links)
    postings, sets = found
    tested = None
    for turn in range(TURNS):
        # every node against two nodes of its list, unless they are one component already: one with the fewest rarer
        # members (in a group of near copies, one with the fewest changes of its own), and any one, by hash
        named = postings.withColumn("root", F.col("node")) if tested is None else left
        what = [F.xxhash64("node", "token", F.lit(turn)).alias("h"), "node", "n", "place", *SHAPE, "root"]
        hubs = named.groupBy("token").agg(F.min(F.struct(F.col("place").alias("first"), *what)).alias("plain"),
                                          F.min(F.struct(F.lit(0).cast("long").alias("first"), *what)).alias("any"))
        hubs = stored(hubs.select("token", F.explode(F.array("plain", "any")).alias("f")), "hubs")
        star = named.join(small(hubs, 120), "token").filter(F.col("root") != F.col("f.root"))
        star = (star.filter(_fits(_posting(), _posting("f."), similarity))
                .select(F.greatest("node", "f.node").alias("u"), F.least("node", "f.node").alias("v")).distinct())
        star = stored(star if tested is None else star.join(tested, ["u", "v"], "left_anti"), "pairs-star")
        tested = star if tested is None else tested.union(star)
        gained = stored(_verified(star, sets, similarity), "links-star")
        if turn and gained.isEmpty():  # stars link no more: components and open lists stay as they are
            break
        roots = stored(components(links.union(gained)), "roots")
        links = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        named = postings.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_ = named.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("token")
        left = stored(named.join(small(stored(open_, "lists-open"), 16), "token"), "postings-open")
        # the pairs of different components that lists still hold, against the postings
        per = left.groupBy("token", "root").agg(F.count("*").cast("double").alias("c"))
        per = per.groupBy("token").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("pairs"), F.sum("c").alias("c"))
        pairs, c = per.agg(F.sum("pairs"), F.sum("c")).first()
        if (pairs or 0) <= 16 * (c or 0):
            break
    a, b = (left.select(F.col("token").alias(f"{s}_token"), *[F.col(c).alias(f"{s}_{c}") for c in ("node", "n", "place", *SHAPE, "root")])
            for s in "ab")
    meet = ((F.col("a_token") == F.col("b_token")) & (F.col("a_node") > F.col("b_node")) & (F.col("a_root") != F.col("b_root"))
            & _fits(_posting("a_"), _posting("b_"), similarity))
    rest = a.join(b, meet).select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct()
    more = stored(_verified(rest.join(tested, ["u", "v"], "left_anti"), sets, similarity), "links-rest")
    whole = roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)
    return rows, stored(components(whole), "roots-all")


def join(docs: DataFrame, width: int = WIDTH, similarity: float | Fraction = SIMILARITY) -> DataFrame:
    """Per document doc_id, n_shingles and component_id, the smallest doc_id reachable."""
    rows, roots = classes(docs, width, similarity)
    own = rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    named = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = stored(named, "nodes-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_all"))
    ids = named.select("node", "root").join(least.filter("n_all > 1"), "root").select("node", "component_id")
    return (rows.select("doc_id", "n_shingles", "node").join(stored(ids, "nodes-ids"), "node", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
                    .alias("component_id")))


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float | Fraction = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null last); of rows
    that share it, one text, and one row of it. Rows without words stay."""
    rows, roots = classes(docs, width, similarity)
    rows = rows.filter("n_shingles > 0").select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash").alias("at"), "node")
    # copies of one node first, so that a large group is small before it meets its component
    own = rows.groupBy("node", "at").agg(F.count("*").alias("n"))
    named = stored(own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "keep-named")
    chosen = named.groupBy("root").agg(F.min("at").alias("first"), F.sum("n").alias("n_all")).filter("n_all > 1")
    marks = named.join(chosen, "root").select("at.*", (F.col("at") == F.col("first")).alias("_kept"), "n")
    go = stored(marks.filter(~F.col("_kept") | (F.col("n") > 1)).select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_kept").distinct(), "keep-marks")
    marked = docs.join(small(go, 24), F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left")
    plain = marked.filter(F.col("_kept").isNull()).select(*[docs[c] for c in docs.columns])
    once = marked.filter(F.col("_kept")).select(*[docs[c] for c in docs.columns]).dropDuplicates(["doc_id", "text"])
    return plain.unionByName(once)
