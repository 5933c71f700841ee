"""Helpers that the operators share: stored tables, Arrow slices, word scanning, hashing.

Everything here works on Arrow buffers with numpy; no row-at-a-time Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkweave.sources import tables
from inkweave.sources.tables import shared_dir, spread, stored  # noqa: F401 - used by the operators

#: Bytes of text handled at once by a kernel; bounds a worker's memory (about 40 times this).
SLICE_BYTES = 4 << 20

U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: The word class of the contracts, for the JVM and for brute-force versions.
WORD = r"[^\x20\x09-\x0D]+"


# == tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; one that is a task or two only is spread over all cores."""
    return spread(tables.table(spark, sf_dir, name))


# == Arrow


def arrow_map(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, text: str | None = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` with batches cut so that column ``text`` holds about ``limit`` bytes in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, text, limit) if text else [batch]:
                yield kernel(part)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Gives memory that a partition's kernel has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def cut(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of ``text`` each (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    _, off = buffers(batch.column(text))
    edges = np.unique(np.searchsorted(off, off[0] + np.arange(limit, off[-1] - off[0] + limit, limit), "right") - 1)
    at = 0
    for e in [*edges.tolist(), n]:
        if (e := max(e, at + 1) if e < n else n) > at:
            yield batch.slice(at, e - at)
            at = e
        if at >= n:
            return


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 int64 offsets into them of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    n = len(col)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def pack(parts: list[bytes] | np.ndarray, offsets: np.ndarray | None = None) -> pa.Array:
    """Binary column from one buffer and its offsets."""
    if offsets is None:
        return pa.array(parts, pa.binary())
    data = np.ascontiguousarray(parts)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


# == words


class Words(NamedTuple):
    """Words of many texts in one buffer: byte ranges, and ``first[d]:first[d+1]`` are the words of text ``d``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n)


def words(col: pa.Array) -> Words:
    r"""Maximal runs of bytes outside ``\x20 \x09-\x0D`` (a UTF-8 sequence never holds one of these)."""
    return words_of(*buffers(col))


def words_of(data: np.ndarray, off: np.ndarray, white: np.ndarray = WHITE) -> Words:
    data, off = data[off[0] : off[-1]], off - off[0]
    ink = ~white[data]
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1]
    stop[:-1] &= ~ink[1:]
    full = np.diff(off) > 0
    a, b = off[:-1][full], off[1:][full] - 1
    begin[a], stop[b] = ink[a], ink[b]
    start = np.flatnonzero(begin)
    return Words(data, start, np.flatnonzero(stop) + 1, np.searchsorted(start, off))


# == hashing

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_ODD = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
_powers: dict = {}


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, at least ``n`` of them."""
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16) if got is None else max(n, 2 * len(got[0]))
        base = _ODD[which]
        inverse = U64(pow(int(base), -1, 1 << 64))
        out = []
        for x in (base, inverse):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = _powers[which] = (out[0], out[1])
    return got


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def word_hashes(w: Words) -> np.ndarray:
    """64-bit hash of each word: differences of a polynomial prefix sum over the bytes."""
    n = len(w.data)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[w.data] * up[:n], out=sums[1:])
    h = (sums[w.end] - sums[w.start]) * down[w.start]
    h += (w.end - w.start).astype(np.uint64) * _ODD[1]
    return mixed(h)


def gram_hashes(h: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hash of every ``k`` consecutive entries of ``h`` (len(h) - k + 1 of them, across texts too; mask those); ``which`` of two families."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1, which)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1] + U64(k))


def inside(w: Words, k: int) -> np.ndarray:
    """Starts (word numbers) of the ``k``-word windows that lie within one text."""
    n = len(w.start)
    if n < k:
        return np.zeros(0, np.int64)
    last = np.repeat(w.first[1:], w.n)[: n - k + 1]
    return np.flatnonzero(np.arange(k, n + 1) <= last)


# == code points


def spaced(col: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts in one buffer, each followed by a space, and the offsets of their starts (and the end)."""
    data, off = buffers(col)
    view, ends = memoryview(data), off.tolist()
    return b"".join([x for a, b in zip(ends, ends[1:]) for x in (view[a:b], b" ")]), off - off[0] + np.arange(len(off))


def code_points(body: bytes, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buffer as uint32 code points, and the offsets in these."""
    points = np.frombuffer(body.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)])
    return points, heads[off]


# == whole rows


def with_field(batch: pa.RecordBatch, number: int, name: str = "text") -> pa.RecordBatch:
    """A batch of whole rows and one of their fields beside them, without a copy."""
    row = batch.column("row")
    field = row.flatten()[number]  # heeds slices and null rows
    return pa.record_batch([row, field.cast(pa.string()) if not pa.types.is_string(field.type) else field], names=["row", name])


def quoted(name: str) -> str:
    """A column's name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole(docs: DataFrame):
    """All columns as one struct, so that names can't clash with those an operator needs meanwhile."""
    from pyspark.sql import functions as F

    return F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row")
