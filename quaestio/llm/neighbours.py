"""Operator 5: nearest neighbours by stable projections and kd-trees.

Largest inner product is turned into least distance: every vector x gets one more
coordinate sqrt(M^2 - |x|^2), every query the coordinate 0 and the length M. A few
Gaussian (2-stable) projections map both to PROJECTED dimensions, where the squared
distance of a pair is its true squared distance times a chi-square variable.

The projected space is cut into cells by a kd-tree whose splits come from a bounded
sample (``SAMPLE_ROWS``); every row is indexed, in a kd-tree of its own cell. A query
takes projected neighbours leaf by leaf, nearest first, verifies their true inner
products, and stops once a vector as near as the k-th found so far would, with
probability ``confidence``, have been met before. It starts in its own cell; the other
cells that the same test leaves open follow in a second step. Cells that hold many rows
(copies of one vector cannot be split) are dealt to several tasks.

Nulls and odd input: vectors that are null, zero, hold null or non-finite components or
are not of the commonest length take no part, as queries or candidates; so do rows
without id. A row is not its own neighbour, nor are rows with its id; rows that repeat are separate
candidates. Empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaestio.llm.shared import stored

PROJECTED = 8
CONFIDENCE = 0.98
CELL_ROWS, MOST_CELLS, LEAF_ROWS = 4096, 4096, 64
#: Rows (the smallest by a hash of their id) that the splits between cells are taken from.
SAMPLE_ROWS = 20_000
FOUND = "query_id long, vec_id long, score double"
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vec: Column) -> Column:
    norm = F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # a null or NaN component makes the sum null or NaN, an infinite one infinite
    return F.coalesce((norm > 0) & ~F.isnan(norm) & (norm < float("inf")), F.lit(False))


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


class Space:
    """Projection to PROJECTED dimensions, and the splits between cells."""

    def __init__(self, dim: int, longest: float, seed: int = 7):
        self.longest = longest
        self.lines = np.random.default_rng(seed).standard_normal((dim + 1, PROJECTED))
        self.splits: list[tuple[int, float]] = []  # of a complete binary tree, in level order

    def rows(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0))
        return x @ self.lines[:-1] + rest[:, None] * self.lines[-1]

    def scaled(self, q: np.ndarray) -> np.ndarray:
        return q * (self.longest / np.sqrt((q * q).sum(axis=1)))[:, None]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return self.scaled(q) @ self.lines[:-1]

    def split(self, sample: np.ndarray, levels: int) -> None:
        parts = [sample]
        for _ in range(levels):
            following = []
            for p in parts:
                axis = int((p.max(axis=0) - p.min(axis=0)).argmax()) if len(p) else 0
                at = float(np.median(p[:, axis])) if len(p) else 0.0
                self.splits.append((axis, at))
                left = p[:, axis] <= at if len(p) else np.zeros(0, bool)
                following += [p[left], p[~left]]
            parts = following

    def cells(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        if self.splits:
            axis, at = np.array([a for a, _ in self.splits]), np.array([x for _, x in self.splits])
            every = np.arange(len(p))
            while (node < len(at)).all() and len(p):
                node = 2 * node + 1 + (p[every, axis[node]] > at[node])
        return node - len(self.splits)


def below(x: np.ndarray) -> np.ndarray:
    """The probability that a chi-square variable of PROJECTED (even) degrees is below x."""
    half, term, total = np.asarray(x, float) / 2, 1.0, 0.0
    for i in range(PROJECTED // 2):
        total = total + term
        term = term * half / (i + 1)
    return 1 - np.exp(-half) * total


def stop_at(confidence: float) -> float:
    """The chi-square value at which ``confidence`` is reached."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < confidence else (lo, mid)
    return hi


def leaves(p: np.ndarray) -> list[np.ndarray]:
    """Row numbers by leaf of a kd-tree of at most LEAF_ROWS rows a leaf."""
    out, stack = [], [np.arange(len(p))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF_ROWS:
            out.append(rows)
            continue
        own = p[rows]
        axis = int((own.max(axis=0) - own.min(axis=0)).argmax())
        order = np.argpartition(own[:, axis], len(rows) // 2)
        stack += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def gap(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of a point to boxes."""
    return (np.maximum(np.maximum(low - point, point - high), 0) ** 2).sum(axis=1)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _search(space: Space, k: int, limit: float):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(rows) or not len(queries):
            return _FOUND.empty_table()
        x, q = matrix(rows["vec"]), matrix(queries["vec"])
        ids, names, known = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy(), queries["kth"].to_numpy()
        p, at = space.rows(x), space.queries(q)
        parts = leaves(p)
        order = np.concatenate(parts)
        x, ids, p = x[order], ids[order], p[order]
        ends = np.cumsum([len(r) for r in parts])
        firsts = ends - [len(r) for r in parts]
        low, high = np.minimum.reduceat(p, firsts), np.maximum.reduceat(p, firsts)
        scale = space.longest / np.sqrt((q * q).sum(axis=1))
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(len(q)):
            far = gap(at[i], low, high)
            nearest = np.argsort(far, kind="stable")
            own_ids, own_scores = np.zeros(0, np.int64), np.zeros(0)
            kth, done, step = known[i], 0, 1
            while done < len(nearest):
                # the next leaf's distance against the k-th best true distance so far
                if kth > -np.inf and far[nearest[done]] >= limit * max(2 * space.longest ** 2 - 2 * scale[i] * kth, 0):
                    break
                take = np.concatenate([np.arange(firsts[n], ends[n]) for n in nearest[done:done + step]])
                done, step = done + step, min(2 * step, 16)
                rough = x[take] @ q[i]
                take = take[rough >= kth - 1e-9 * max(1.0, abs(kth))] if kth > -np.inf else take
                take = take[ids[take] != names[i]]
                if not len(take):
                    continue
                exact = (x[take] * q[i]).sum(axis=1)  # the same for equal vectors, wherever they stand
                own_ids, own_scores = np.concatenate([own_ids, ids[take]]), np.concatenate([own_scores, exact])
                best = top(own_ids, own_scores, k)
                own_ids, own_scores = own_ids[best], own_scores[best]
                if len(best) == k:
                    kth = max(kth, own_scores[-1])
            for o, v in zip(out, (np.full(len(own_ids), names[i]), own_ids, own_scores)):
                o.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(o)) for o in out], schema=_FOUND)
    return run


def _cells(space: Space, of_query: bool):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            if len(batch):
                x = matrix(batch.column("vec"))
                p = space.queries(x) if of_query else space.rows(x)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.cells(p)), pa.array(list(p), pa.list_(pa.float64()))],
                                                 names=[*batch.schema.names, "cell", "at"])
    return run


def _open_cells(space: Space, table: np.ndarray, limit: float):
    """For every query the cells other than its own that its k-th best leaves open.
    table: per cell its number, low and high corner."""
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, low, high = table[:, 0].astype(np.int64), table[:, 1:1 + PROJECTED], table[:, 1 + PROJECTED:]
        for batch in rows:
            if not len(batch):
                continue
            q, kth, home = matrix(batch.column("vec")), batch.column("kth").to_numpy(), batch.column("home").to_numpy()
            at, scale = space.queries(q), space.longest / np.sqrt((q * q).sum(axis=1))
            take, cells = [], []
            for i in range(len(q)):
                reach = np.inf if kth[i] == -np.inf else limit * max(2 * space.longest ** 2 - 2 * scale[i] * kth[i], 0)
                open_ = number[(gap(at[i], low, high) < reach) & (number != home[i])]
                take.append(np.full(len(open_), i))
                cells.append(open_)
            take = pa.array(np.concatenate(take).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(take), batch.column("vec").take(take),
                                              batch.column("kth").take(take), pa.array(np.concatenate(cells))],
                                             names=["query_id", "vec", "kth", "cell"])
    return run


def search(vectors: DataFrame, is_query: Column, k: int = 20, confidence: float = CONFIDENCE) -> DataFrame:
    """Per query (rows of ``vectors`` (vec_id, embedding) for which ``is_query`` holds) its
    k nearest other rows: query_id, rank, vec_id, score."""
    rows = (vectors.filter(F.col("vec_id").isNotNull()).withColumn("vec", F.col("embedding").cast("array<double>"))
            .filter(usable(F.col("vec"))))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "vec", F.coalesce(is_query, F.lit(False)).alias("q"))
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate(
        "vec", F.lit(0.0), lambda a, x: a + x * x)).alias("longest")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, longest = sizes[0]
    rows = rows.filter(F.size("vec") == dim)
    space = Space(dim, float(np.sqrt(longest)) * (1 + 1e-12))
    levels = max(0, int(np.ceil(np.log2(max(1, min(MOST_CELLS, n / CELL_ROWS))))))
    # of one hash value no more rows than any other: rows that repeat do not matter here
    sample = (rows.select("vec", F.xxhash64("vec_id", "vec").alias("h")).orderBy("h").limit(SAMPLE_ROWS).select("vec").toArrow())
    space.split(space.rows(matrix(sample["vec"])), levels)
    limit = stop_at(confidence)

    fields = "vec_id long, vec array<double>, q boolean, cell long, at array<double>"
    dealt = stored(rows.mapInArrow(_cells(space, False), fields), "vectors")
    corners = [f(F.col("at")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(PROJECTED)]
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n"), *corners).collect()  # at most MOST_CELLS rows
    subs = {r.cell: -(-r.n // (2 * CELL_ROWS)) for r in cells}
    table = np.array([[r.cell, *r[2:]] for r in cells], float).reshape(-1, 1 + 2 * PROJECTED)
    n_sub = F.element_at(F.create_map(*[F.lit(x) for kv in subs.items() for x in kv]), F.col("cell"))
    index = dealt.select("vec_id", "vec", "cell", F.pmod(F.xxhash64("vec_id"), n_sub).alias("sub"))

    def spread(queries: DataFrame) -> DataFrame:
        """Each query to every part of its cell."""
        return queries.withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), n_sub.cast("long") - 1)))

    def found(queries: DataFrame) -> DataFrame:
        return (index.groupBy("cell", "sub").cogroup(spread(queries).groupBy("cell", "sub"))
                .applyInArrow(_search(space, k, limit), FOUND))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    queries = (dealt.filter("q").select(F.col("vec_id").alias("query_id"), "vec").dropDuplicates(["query_id"])
               .mapInArrow(_cells(space, True), "query_id long, vec array<double>, cell long, at array<double>"))
    # a home cell that no row fell into is left to the second step
    queries = stored(queries.withColumn("home", F.col("cell")).drop("at"), "queries")
    first = found(queries.filter(F.col("cell").isin(list(subs)) if subs else F.lit(False))
                  .withColumn("kth", F.lit(float("-inf"))).drop("home"))
    first = stored(first.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), "found")
    kth = first.filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    left = (queries.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf")))).drop("cell")
            .mapInArrow(_open_cells(space, table, limit), "query_id long, vec array<double>, kth double, cell long"))
    every = first.drop("rank").union(found(left))
    return (every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
