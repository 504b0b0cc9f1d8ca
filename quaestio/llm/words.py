"""Words of whole texts: runs of characters other than space and 0x09-0x0D."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: Words of ASCII letters and digits and of characters beyond ASCII.
#: The text must have its A-Z lower-cased.
WORD_ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: White space for str.split() that does not end a word here.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: Bytes of text that callers take as one column at a time (a longer text is a slice of its own).
SLICE_BYTES = 1 << 20
#: Bytes whose arrays are held at once while hashing.
PIECE_BYTES = 1 << 17

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but white space.
INSIDE = ~_SPACE
#: Bytes of words of letters and digits: ASCII ones, and all of characters beyond ASCII.
ALPHANUMERIC = np.zeros(256, dtype=bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def lowered(text: str) -> str:
    """``text`` with A-Z (and no other letter) in lower case; code points keep their places."""
    return text.encode().translate(_LOWER.tobytes()).decode()


def words(text: str) -> list[str]:
    """The words of ``text``; str.split() where it cuts at the same places."""
    odd = any(c in text for c in "\x1c\x1d\x1e\x1f") if text.isascii() else _ODD.search(text)
    return WORD.findall(text) if odd else text.split()


def release() -> None:
    """Give the memory that finished work left behind back to the system: workers stay and
    are reused, each would else keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, last + 1) runs of rows with about ``limit`` bytes of text each."""
    if not len(column):
        return
    width = np.int32 if pa.types.is_string(column.type) else np.int64
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset:column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last
        first = last


def texts(column) -> pa.Array:
    """A text column as one large_string array, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    return column.cast(pa.large_string()).fill_null("")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int, base: int) -> np.ndarray:
    """The first powers of ``base``; those of one piece are kept."""
    if n <= PIECE_BYTES and base in _powers:
        return _powers[base][:n]
    p = np.full(max(n, PIECE_BYTES), base, dtype=np.uint64)
    p[0] = 1
    p = np.cumprod(p)
    if n <= PIECE_BYTES:
        _powers[base] = p
    return p[:n]


def _border(data: np.ndarray, at: int, end: int, offsets: np.ndarray, inside: np.ndarray) -> int:
    """The last place up to ``end`` (or else the first beyond it) where no word goes on."""
    free = np.flatnonzero(~inside[data[at:end]])
    text = int(np.searchsorted(offsets, end, side="right")) - 1
    last = max(at + int(free[-1]) + 1 if len(free) else at, int(offsets[text]))
    if last > at:
        return last
    stop = int(offsets[text + 1])  # one word fills the piece: go on to its end
    while end < stop:
        free = np.flatnonzero(~inside[data[end:min(end + PIECE_BYTES, stop)]])
        if len(free):
            return end + int(free[0])
        end = min(end + PIECE_BYTES, stop)
    return stop


def word_hashes(column: pa.Array, inside: np.ndarray = INSIDE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (A-Z lower-cased) of some texts, in order, and the
    number of words of each text. A hash depends on the word's bytes alone. ``inside``
    tells the bytes of words; arrays beyond the result cover a piece at a time, cut
    between words, so a very long text needs no more than its hashes."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[lo:hi]
    offsets = offsets - lo
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE_BYTES, len(data))
        if end < len(data):
            end = _border(data, at, end, offsets, inside)
        piece = _LOWER[data[at:end]]
        within = inside[piece]
        begins = np.empty(len(piece), dtype=bool)
        begins[0] = True
        np.logical_not(within[:-1], out=begins[1:])
        begins[offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, end)] - at] = True
        begins &= within
        first = np.flatnonzero(begins)
        if len(first):
            value = piece.astype(np.uint64)
            value += np.uint64(1)
            value *= _power(len(piece), _BASE)
            value *= within
            hashes.append(mix(np.add.reduceat(value, first) * _power(len(piece), _INVERSE)[first]))
            starts.append(first + at)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))
