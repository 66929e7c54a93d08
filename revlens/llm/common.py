"""Helpers shared by the operators of this subpackage.

Words are ``[^\\x20\\x09-\\x0D]+`` throughout.  They are found and hashed on
the bytes of an Arrow string column, many documents at a time, so no
Python object is made per word.  Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from revlens.operators.common import salted_left_join  # noqa: F401  for the operators

U = np.uint64
GOLDEN = U(0x9E3779B97F4A7C15)
GROUP_BYTES = 1 << 20  # documents are handled together up to this size; a larger one stands alone
SEGMENT_BYTES = 1 << 19  # bytes hashed at a time, cut between words

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def byte_values(fold: bool) -> np.ndarray:
    """A random value for each byte; a byte of value 0 at a word's end does not count."""
    with np.errstate(over="ignore"):
        t = mix((np.arange(256, dtype=U) + U(1)) * GOLDEN)
    t[_SPACE] = 0
    if fold:
        t[65:91] = t[97:123]
    return t


_FOLDED, _EXACT = byte_values(True), byte_values(False)
_STEP = 0xD1342543DE82EF95  # odd: the weight of a byte is a power of it


def _weights(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        w = np.full(n, U(_STEP), U)
        w[0] = 1
        return np.multiply.accumulate(w)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    col = (pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col).cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    if off is None or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, np.int64)[col.offset: col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]  # of a slice its own part only


def _segment_words(data: np.ndarray, breaks: np.ndarray, table: np.ndarray):
    """Starts and hashes of the words of ``data``; a word also ends at each of ``breaks`` (document starts)."""
    space = _SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    before[breaks] = True
    starts = np.flatnonzero(before & ~space)
    if not len(starts):
        return starts, np.zeros(0, U)
    to = np.append(starts[1:], len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, to - starts)
    with np.errstate(over="ignore"):
        value = table[data[starts[0]:]] * _weights(int(place.max()) + 1)[place]
        return starts, mix(np.add.reduceat(value, starts - starts[0]) + GOLDEN)


def word_groups(col: pa.Array, fold: bool = True, table: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Word hashes of whole texts, for groups of consecutive documents.

    Yields ``(first, end, counts, hashes)``: documents ``first:end`` have
    ``counts`` words each, whose hashes follow one another in ``hashes``.
    ``fold`` lower-cases A-Z first; ``table`` gives other byte values (see
    ``byte_values``).  Null and empty texts have no words.
    """
    data, off = text_bytes(col)
    table = table if table is not None else _FOLDED if fold else _EXACT
    n, first = len(off) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(off, off[first] + GROUP_BYTES, "right")) - 1)
        edges, at, stop = off[first:end + 1], int(off[first]), int(off[end])
        places, hashes = [], []
        while at < stop:
            cut = min(stop, at + SEGMENT_BYTES)
            while cut < stop:  # on to the next space or document start
                near = np.flatnonzero(_SPACE[data[cut:cut + 4096]])
                e = edges[np.searchsorted(edges, cut)]
                cut = min(stop, int(e), cut + int(near[0]) if len(near) else cut + 4096)
                if len(near) or cut == e:
                    break
            own = edges[(edges >= at) & (edges < cut)] - at
            s, h = _segment_words(data[at:cut], own.astype(np.int64), table)
            places.append(s + at)
            hashes.append(h)
            at = cut
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        p = np.concatenate(places) if places else np.zeros(0, np.int64)
        yield first, end, np.diff(np.searchsorted(p, edges)), h
        first = end


def windows(counts: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the windows of ``n`` words that lie within one document: (document, first word, hash)."""
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < n:
        return doc[:0], doc[:0], hashes[:0]
    inside = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:])
    with np.errstate(over="ignore"):
        h = np.zeros(len(inside), U)
        for k in range(n):
            h = mix(h * U(_STEP) + hashes[inside + k] + GOLDEN)
    return doc[inside], inside, h


def held_fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds


def units(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``keys``, from batches sorted by them; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for b in batches:
        if not b.num_rows:
            continue
        k = np.column_stack([np.asarray(b.column(c)) for c in keys])
        starts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), b.num_rows]):
            if held and (s or tuple(k[s]) != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
            last = tuple(k[s])
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest place that each of ``n`` places reaches by the links (p, q)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, p, root[q])
        np.minimum.at(new, q, root[p])
        new = new[new]
        if (new == root).all():
            return root
        root = new
