"""Benchmark decontamination by SimHash windows (operator 4).

A benchmark item of n words is compared with every window of n words of every
document (a shorter document is one window).  Words are runs of bytes that are
neither ASCII white space nor ASCII punctuation, A-Z lower-cased; shingles are
``SHINGLE`` words, weighted by how few items hold them.

1. *Bound.*  A window can only be similar enough to an item of its size if the
   weight of its shingles that occur in any item reaches the least that such an
   item demands.  Prefix sums give this for all windows; it loses nothing.
2. *SimHash.*  The windows left get 64-bit fingerprints of their weighted
   shingles, from prefix sums of signed bits.
3. *Multi-index.*  ``BLOCKS`` 16-bit blocks: fingerprints within ``RADIUS`` of an
   item's differ in at most RADIUS // BLOCKS bits in one block, so tables by block
   value return all of these; the full Hamming distance leaves no others.
4. *Verification.*  Exact weighted-shingle similarity: the weight of the item's
   distinct shingles in the window, over that of all of them; ``THRESHOLD`` decides.

The items are a stated query set: ``ITEMS_AT_ONCE`` of them are sent to the
workers at a time, whose size is bounded by ``ITEM_BYTES``, and the documents
are read once for each such block.  Weights are those of the whole benchmark
whatever the blocks: shingles that several items hold are counted over all of
them and sent along with each block (a shingle of one item weighs as much as
one of none).  Nothing is shuffled but these counts.

Nulls and edge cases: null or blank texts match nothing, on either side; items
of fewer than ``SHINGLE`` words have no shingles and match nothing; a null
doc_id or item_id is reported as such; repeated rows are reported each; other
columns are ignored or (``clean``) passed through; empty tables give an empty
result, and with an empty benchmark all documents are clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkweave.llm.common import U64, WHITE, Words, buffers, cut, gram_hashes, release, whole, with_field, word_hashes, words_of

SHINGLE = 2
RADIUS = 19
BLOCKS = 4
THRESHOLD = 0.7
ITEMS_AT_ONCE = 1024
ITEM_BYTES = 16 << 20
PART_BYTES = 1 << 20
#: Windows that are fingerprinted together, about; bounds a worker's memory.
WINDOWS_AT_ONCE = 200_000
_APART = WHITE.copy()
_APART[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POP = np.array([x.bit_count() for x in range(1 << 16)], np.uint8)


def _scan(col: pa.Array) -> tuple[Words, np.ndarray]:
    """Words, and the shingle that starts at each (0 where it would leave the text)."""
    data, off = buffers(col)
    w = words_of(_LOWER[data[off[0] : off[-1]]], off - off[0], _APART)
    h = np.zeros(len(w.start), np.uint64)
    grams = gram_hashes(word_hashes(w), SHINGLE)
    h[: len(grams)] = grams | U64(1)
    for back in range(1, SHINGLE):
        h[(w.first[1:] - back)[w.n >= back]] = 0
    return w, h


def _prints(h: np.ndarray, weight: np.ndarray, start: np.ndarray, stop: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
    """Fingerprints of the shingle ranges ``start:stop``; ``start`` ascending.  Signed bits are summed chunk by chunk."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        upto = max(at + 1, int(np.searchsorted(start, low + chunk)))
        a, b = start[at:upto] - low, stop[at:upto] - low
        bits = np.unpackbits(h[low : low + int(b.max())].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        signed = np.where(bits, weight[low : low + len(bits), None], -weight[low : low + len(bits), None]).astype(np.int32)
        sums = np.zeros((len(bits) + 1, 64), np.int32)
        np.cumsum(signed, axis=0, out=sums[1:])
        for k in range(0, len(a), 1 << 14):
            c = slice(k, k + (1 << 14))
            out[at:upto][c] = np.packbits(sums[b[c]] > sums[a[c]], axis=1).view(">u8").ravel()
        at = upto
    return out


def _distinct(w: Words, h: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending."""
    return [np.unique(h[a:b][h[a:b] != 0]) for a, b in zip(w.first, w.first[1:])]


class Index:
    """A block of benchmark items.  ``n_items`` and ``held``: of the whole benchmark, if the block isn't all of it."""

    def __init__(self, items: pa.Table, n_items: int | None = None, held: tuple[np.ndarray, np.ndarray] | None = None):
        text = items.column("text").combine_chunks()
        self.ids = items.column("item_id").combine_chunks()
        w, h = _scan(text)
        per = _distinct(w, h)
        every, df = own, _ = np.unique(np.concatenate([*per, np.zeros(0, np.uint64)]), return_counts=True)
        if held is not None:
            every = np.union1d(own, held[0])
            df = np.ones(len(every), np.int64)
            df[np.searchsorted(every, held[0])] = held[1]
        self.shingles = every
        self.own = np.isin(every, own)
        n_items = max(1, len(per) if n_items is None else n_items)
        self.other = int(round(16 * np.log2(1 + n_items)))
        self.weights = np.round(16 * np.log2(1 + n_items / np.maximum(df, 1))).astype(np.int64)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(every >> U64(44)).astype(np.int64)] = True
        self.sets = [(s, self.weights[np.searchsorted(every, s)]) for s in per]
        total = np.array([x.sum() for _, x in self.sets], np.int64)
        self.least = np.ceil(THRESHOLD * total - 1e-9).astype(np.int64)
        self.size = np.where(total > 0, w.n, 0)
        weight = np.where(h != 0, self.weights[np.searchsorted(every, h).clip(0, max(0, len(every) - 1))] if len(every) else 0, 0)
        self.prints = _prints(h, weight, w.first[:-1], w.first[1:])
        self.lengths = [(int(n), int(self.least[self.size == n].min())) for n in np.unique(self.size[self.size > 0])]
        # by block and block value: bit mask of the items within RADIUS // BLOCKS
        cells = -(-max(1, len(per)) // 64)
        self.near = np.zeros((BLOCKS, 1 << 16, cells), np.uint64)
        values = np.arange(1 << 16)
        for k, p in enumerate(self.prints.tolist()):
            if self.size[k]:
                for b in range(BLOCKS):
                    self.near[b, _POP[values ^ (p >> 16 * b & 0xFFFF)] <= RADIUS // BLOCKS, k // 64] |= U64(1 << k % 64)

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that some item has (of this block, or several of others), and their numbers."""
        at = np.flatnonzero(self.quick[(h >> U64(44)).astype(np.int64)])
        k = np.searchsorted(self.shingles, h[at]).clip(0, max(0, len(self.shingles) - 1))
        hit = self.shingles[k] == h[at] if len(self.shingles) else np.zeros(len(at), bool)
        return at[hit], k[hit]

    def candidates(self, prints: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within RADIUS and of one size."""
        windows, items = [], []
        for a in range(0, len(prints), 1 << 14):
            p = prints[a : a + (1 << 14)]
            mask = self.near[0, (p & U64(0xFFFF)).astype(np.int64)]
            for b in range(1, BLOCKS):
                mask = mask | self.near[b, (p >> U64(16 * b) & U64(0xFFFF)).astype(np.int64)]
            bits = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(self.size)].view(bool)
            bits &= self.size[None, :] == size[a : a + (1 << 14), None]
            x, y = np.nonzero(bits)
            close = np.bitwise_count(p[x] ^ self.prints[y]) <= RADIUS
            windows.append(x[close] + a)
            items.append(y[close])
        return np.concatenate([*windows, np.zeros(0, np.int64)]), np.concatenate([*items, np.zeros(0, np.int64)])

    def similarity(self, h: np.ndarray, start: np.ndarray, stop: np.ndarray, item: int) -> np.ndarray:
        """Exact weighted similarity of windows to one item."""
        keys, weight = self.sets[item]
        out = np.zeros(len(start))
        for a in range(0, len(start), 4096):
            lo, hi = start[a : a + 4096], stop[a : a + 4096]
            grid = lo[:, None] + np.arange(int((hi - lo).max()))
            found = h[np.minimum(grid, len(h) - 1)]
            k = np.searchsorted(keys, found).clip(0, len(keys) - 1)
            hit = (keys[k] == found) & (grid < hi[:, None])
            seen = np.zeros((len(lo), len(keys)), bool)
            seen[np.nonzero(hit)[0], k[hit]] = True
            out[a : a + 4096] = seen @ weight / weight.sum()
        return out

    def matches(self, col: pa.Array) -> tuple[np.ndarray, ...]:
        """(text, item, similarity, first word, words, Hamming distance): the best window of each pair, the first if equal."""
        w, h = _scan(col)
        none = np.zeros(0, np.int64)
        if not self.lengths or not len(h):
            return none, none, none.astype(float), none, none, none
        hit, k = self.lookup(h)
        inner = np.zeros(len(h) + 1, np.int64)
        inner[hit + 1] = self.weights[k] * self.own[k]
        inner = np.cumsum(inner)
        doc = w.doc()
        weight = np.where(h != 0, self.other, 0)
        weight[hit] = self.weights[k]
        whole_text = inner[w.first[1:]] - inner[w.first[:-1]]
        waiting, n_waiting, got = [], 0, []
        for n, least in self.lengths:
            at, end = none, none
            if len(h) >= n:
                at = np.flatnonzero(inner[n - SHINGLE + 1 : len(h) - SHINGLE + 2] - inner[: len(h) - n + 1] >= least)
                at = at[doc[at] == doc[at + n - 1]]
                end = at + n - SHINGLE + 1
            short = np.flatnonzero((w.n < n) & (whole_text >= least))
            at = np.concatenate([at, w.first[short]])
            end = np.concatenate([end, np.maximum(w.first[short + 1] - SHINGLE + 1, w.first[short])])
            waiting.append((at, end, np.full(len(at), n)))
            n_waiting += len(at)
            if n_waiting > WINDOWS_AT_ONCE or n == self.lengths[-1][0]:
                got.append(self._near(h, weight, *map(np.concatenate, zip(*waiting))))
                waiting, n_waiting = [], 0
        start, stop, y, apart = map(np.concatenate, zip(*got))
        order = np.argsort(y, kind="stable")
        start, stop, y, apart = start[order], stop[order], y[order], apart[order]
        sim = np.zeros(len(y))
        edges = np.flatnonzero(np.diff(y, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(y)]):
            sim[a:b] = self.similarity(h, start[a:b], stop[a:b], int(y[a]))
        good = sim >= THRESHOLD
        start, stop, y, apart, sim = start[good], stop[good], y[good], apart[good], sim[good]
        d = doc[start]
        order = np.lexsort((start, -sim, y, d))
        d, y, sim, start, stop, apart = d[order], y[order], sim[order], start[order], stop[order], apart[order]
        top = (np.diff(d, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0)
        d, y, sim, start, stop, apart = d[top], y[top], sim[top], start[top], stop[top], apart[top]
        return d, y, sim, start - w.first[d], stop - start + SHINGLE - 1, apart

    def _near(self, h: np.ndarray, weight: np.ndarray, start: np.ndarray, stop: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, stop, item, Hamming distance) of the windows whose fingerprints are within the radius of an item's."""
        order = np.argsort(start, kind="stable")
        start, stop, size = start[order], stop[order], size[order]
        prints = _prints(h, weight, start, stop)
        x, y = self.candidates(prints, size)
        return start[x], stop[x], y, np.bitwise_count(prints[x] ^ self.prints[y]).astype(np.int64)


def repeated(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that more than one item holds, ascending, and how many items hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(batch, "text", PART_BYTES):
                yield pa.record_batch([pa.array(np.concatenate([*_distinct(*_scan(part.column("text"))), np.zeros(0, np.uint64)]).view(np.int64))], names=["shingle"])
        release()

    got = items.select("text").mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").toArrow()
    shingles = np.array(got.column("shingle"), np.int64).view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], np.array(got.column("n"), np.int64)[order]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark in blocks of bounded size."""
    items = benchmark.where(F.length(text_col) > 0).select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // (ITEMS_AT_ONCE * 3 // 4)), -(-size // (ITEM_BYTES * 3 // 4)), 0)
    held = repeated(items) if blocks > 1 else None
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield Index(part.toArrow(), n, held)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item it holds: ``doc_id, item_id, similarity, start_word, n_words, hamming``."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming long"
    found = spark.createDataFrame([], schema)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for index in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in cut(batch, "text", PART_BYTES):
                    d, y, *rest = shared.value.matches(part.column("text"))
                    yield pa.record_batch([part.column("doc_id").take(pa.array(d)), shared.value.ids.take(pa.array(y)), *map(pa.array, rest)], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "hamming"])
            release()

        found = found.unionByName(picked.mapInArrow(run, schema))
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark item."""
    spark, number = docs.sparkSession, docs.columns.index(text_col)
    for index in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in cut(with_field(batch, number), "text", PART_BYTES):
                    keep = np.ones(part.num_rows, bool)
                    keep[shared.value.matches(part.column("text"))[0]] = False
                    yield pa.record_batch([part.column("row").filter(pa.array(keep))], names=["row"])
            release()

        docs = docs.select(whole(docs)).mapInArrow(run, StructType([StructField("row", docs.schema)])).select("row.*")
    return docs
