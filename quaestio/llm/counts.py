"""Corpus-wide counts of 64-bit keys, asked for and answered per block of documents.

A block sends every distinct key it holds once, with its own count, to the key's range;
a range sums up and answers each block with the totals that differ from the block's own.
So a key that stands in every document costs one entry per block, not one per document.
Keys travel sorted and delta-coded, split into byte planes (the upper planes are almost
all zero and shrink to nothing in the shuffle's compression).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaestio.llm.words import release

#: block -1 holds what a range knows about all blocks: distinct counted keys and their sum, by kind.
FIELDS = "range long, block long, keys binary, counts binary"
SCHEMA = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def pack_sorted(keys: np.ndarray) -> bytes:
    delta = np.empty_like(keys)
    if len(keys):
        delta[0] = keys[0]
        np.subtract(keys[1:], keys[:-1], out=delta[1:])
    return np.ascontiguousarray(delta.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Unsigned counts in the narrowest width, the width first."""
    top = int(counts.max()) if len(counts) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sum of their counts (by default 1 each)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts, first)


def n_ranges(total_bytes: int, range_bytes: int = 8 << 20) -> int:
    """A power of two, in proportion to the input."""
    return 1 << max(0, int(total_bytes // range_bytes).bit_length())


def ask(block: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """A block's sorted distinct keys with its own counts, one row per key range."""
    bits = ranges.bit_length() - 1
    edges = [0, *np.searchsorted(keys, (np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - bits))).tolist(), len(keys)] \
        if bits else [0, len(keys)]
    rows = [(r, block, pack_sorted(keys[a:b]), pack_counts(counts[a:b]))
            for r, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, SCHEMA.types)],
                                      schema=SCHEMA)


def _answer(table: pa.Table) -> pa.Table:
    release()
    blocks = table["block"].to_pylist()
    parts = [unpack_sorted(x.as_py()) for x in table["keys"]]
    own = np.concatenate([unpack_counts(x.as_py()) for x in table["counts"]])
    lengths = [len(x) for x in parts]
    keys = np.concatenate(parts)
    del parts
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    total = np.add.reduceat(own[order], np.flatnonzero(first))
    # the odd keys are of one kind, the even ones of another (see callers)
    odd = (ranked[first] & np.uint64(1)).astype(bool)
    stats = [int((total[odd] > 0).sum()), int(total[odd].sum()), int((total[~odd] > 0).sum()), int(total[~odd].sum())]
    every = np.empty(len(keys), np.int64)
    every[order] = total[np.cumsum(first) - 1]
    del order, ranked, first, total
    rows, at = [], 0
    for block, n in zip(blocks, lengths):
        differs = every[at:at + n] != own[at:at + n]
        if differs.any():
            rows.append((table["range"][0].as_py(), block, pack_sorted(keys[at:at + n][differs]),
                         pack_counts(every[at:at + n][differs])))
        at += n
    rows.append((table["range"][0].as_py(), -1, b"", np.array(stats, "<i8").tobytes()))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)


def totals(asked: DataFrame) -> DataFrame:
    """Per block and range the sorted keys whose total over all blocks differs from the
    block's own count, with the totals; rows of block -1 hold statistics."""
    return asked.groupBy("range").applyInArrow(_answer, FIELDS)


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """One block's answers as sorted keys and totals."""
    parts = sorted(zip(table["range"].to_pylist(), table["keys"], table["counts"]), key=lambda x: x[0])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return (np.concatenate([unpack_sorted(k.as_py()) for _, k, _ in parts]),
            np.concatenate([unpack_counts(c.as_py()) for _, _, c in parts]))


def look_up(keys: np.ndarray, known: np.ndarray, values: np.ndarray, default: np.ndarray) -> np.ndarray:
    """values[i] where keys[..] == known[i] (sorted), else default."""
    if not len(known):
        return default
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return np.where(known[at] == keys, values[at], default)
