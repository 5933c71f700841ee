"""Exact substring deduplication with fixed-block anchors (operator 3).

A word goes if a window of ``WINDOW`` consecutive words covers it whose word
sequence also starts in a document with a smaller ``doc_id``.

*Anchors.*  Each document's non-overlapping blocks of ``BLOCK`` words (block 0
at its first word) are the index, a seventh of all positions.  As ``WINDOW >= 2
* BLOCK - 1``, any window holds one whole block of its own document, so whichever
of two documents is taken as the reference, probing its blocks with every
rolling block-sized window of the other finds each common window.  A probe that
meets a block of another document is a *hit*; a block that another document's
probe meets is *asked* for.  Only what holds a hit, or an asked block of its
own, goes on: it is extended left and right while the rolling windows are
shared; runs shorter than ``WINDOW`` words are dropped.  The windows of the
remaining runs are compared by 96 bits of two hash families over all their
words (some 10^-3 false pairs expected among the 10^13 windows of 100 TB),
which gives the smallest ``doc_id`` of each; windows that follow one another
and repeat make up the maximal exact repeats.

*Shape of the job.*  Documents are packed into slices of a few MB, written once
(step 0).  Each slice sends its distinct rolling hashes, sorted and
delta-coded, with a bit for those that are blocks, to ranges of the hash space;
a range, which is one task, looks probes up in the blocks and answers with three
bits a hash: shared, hit, asked (step 1).  The slices, joined with their bits,
send the windows of anchored runs with the slice's smallest doc_id each; a range
answers with one bit: a smaller doc_id exists elsewhere (step 2).  Joined with
these, the slices remove words (step 3).  A passage that a third of all
documents share is one entry per slice and never a group of rows; no pairs are
made, and ranges hold ``RANGE_ENTRIES`` entries on average at any size.

*Fan-out.*  A slice never sends more than ``FAN_OUT`` messages.  If there are
more ranges, messages go to bundles first: a bundle joins what ``FAN_OUT`` slices
send to neighbouring ranges, passes each distinct hash on once, and hands the
answers back to its slices, so a hot passage is one entry per bundle and messages
grow in proportion to the input.

Nulls and edge cases: a null text has no words; a row with a null ``doc_id`` is
never a reference and is kept whole; rows that share a doc_id are not smaller
than each other, so they don't remove each other's words; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import SLICE_BYTES, U64, WHITE, Words, buffers, cut, gram_hashes, inside, mixed, pack, release, stored, word_hashes, words_of

WINDOW = 13
BLOCK = 7
RANGE_ENTRIES = 2_000_000
#: Messages that a slice sends at most in a step, and slices of a bundle.
FAN_OUT = 4096
_SPACED = np.where(WHITE, 32, np.arange(256)).astype(np.uint8)
_LAST = np.iinfo(np.int64).max
_SECOND = U64(0x8F14E45FCEEA167B)


# == coding of sorted hashes


def encode(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes; the upper planes, which repeat, compressed."""
    n = len(values)
    planes = max(1, (int(values.max()).bit_length() + 7) // 8) if n else 1
    octets = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :planes].T)
    cheap = min(3, planes - 1)
    upper = zstandard.compress(octets[cheap:].tobytes(), 1)
    return n.to_bytes(4, "little") + bytes([planes]) + octets[:cheap].tobytes() + upper


def decode(blob: bytes) -> np.ndarray:
    n, planes = int.from_bytes(blob[:4], "little"), blob[4]
    cheap = min(3, planes - 1)
    octets = np.zeros((n, 8), np.uint8)
    octets[:, :cheap] = np.frombuffer(blob, np.uint8, cheap * n, 5).reshape(cheap, n).T
    octets[:, cheap:planes] = np.frombuffer(zstandard.decompress(blob[5 + cheap * n :]), np.uint8).reshape(planes - cheap, n).T
    return octets.view("<u8").ravel()


def encode_sorted(values: np.ndarray) -> bytes:
    return encode(np.diff(values, prepend=values[:1])) + (values[:1].tobytes() if len(values) else bytes(8))


def decode_sorted(blob: bytes) -> np.ndarray:
    got = decode(blob[:-8])
    if len(got):
        got[0] = np.frombuffer(blob[-8:], np.uint64)[0]
    return np.cumsum(got, dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).view(bool)


def _ranges(values: np.ndarray, ranges: int) -> tuple[np.ndarray, list[int]]:
    """The ranges that occur among sorted 64-bit values, and where each begins (and the end)."""
    which = ((values >> U64(32)) * U64(ranges)) >> U64(32)
    at = np.flatnonzero(np.diff(which, prepend=which[:1] + U64(1))) if len(values) else np.zeros(0, np.int64)
    return which[at].astype(np.int64), [*at.tolist(), len(values)]


# == slices


def packed(docs: DataFrame) -> DataFrame:
    """Slices of whole documents: ``slice``, ``n_words``, ``ids`` (int64), ``known`` (bits: the id isn't null), ``off`` (int64), ``body`` (each text and a space; zstd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for piece in cut(batch, "text", SLICE_BYTES):
                data, off = buffers(piece.column("text"))
                view, ends = memoryview(data), off.tolist()
                body = b"".join([x for a, b in zip(ends, ends[1:]) for x in (view[a:b], b" ")])
                off = off - off[0] + np.arange(len(off))
                ids = piece.column("doc_id")
                known = np.array(ids.is_valid())
                n = len(words_of(np.frombuffer(body, np.uint8), off).start)
                blobs = (np.array(ids.fill_null(0), np.int64).tobytes(), _bits(known), off.tobytes(), squeeze.compress(body))
                yield pa.record_batch([pa.array([number], pa.int64()), pa.array([n], pa.int64()), *(pack([x]) for x in blobs)], names=["slice", "n_words", "ids", "known", "off", "body"])
                number += 1
        release()

    return docs.mapInArrow(run, "slice long, n_words long, ids binary, known binary, off binary, body binary")


def _distinct(h: np.ndarray, check: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorting order, heads of equal values in it, and each value's number among the distinct ones."""
    order = np.argsort(h, kind="stable")
    new = np.diff(h[order], prepend=~h[order][:1]) != 0
    if check is not None:
        other = np.diff(check[order], prepend=check[order][:1]) != 0
        if (other & ~new).any():  # two windows of one hash: they must not lie in turns
            order = np.lexsort((check, h))
            new = np.diff(h[order], prepend=~h[order][:1]) != 0
            other = np.diff(check[order], prepend=check[order][:1]) != 0
        new |= other
    return order, np.flatnonzero(new), np.cumsum(new) - 1


class Slice:
    """One slice with its words and rolling hashes."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = _flags(row["known"], len(self.ids))
        self.off = np.frombuffer(row["off"], np.int64)
        self.body = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        self.words: Words = words_of(self.body, self.off)
        self.doc = self.words.doc()
        self.hash = word_hashes(self.words)
        self.at = inside(self.words, BLOCK)
        grams = (gram_hashes(self.hash, BLOCK)[self.at] >> U64(16)) << U64(16)  # 48 bits, at the top
        self.order, self.head, self.group = _distinct(grams)
        self.keys = grams[self.order][self.head]
        doc = self.doc[self.at]
        self.block = (self.at - self.words.first[doc]) % BLOCK == 0

    def probes(self) -> np.ndarray:
        """Of each distinct rolling hash: whether two documents here have it, and whether it is a block of one."""
        if not len(self.head):
            return np.zeros((2, 0), bool)
        doc = self.doc[self.at][self.order]
        return np.stack([np.minimum.reduceat(doc, self.head) != np.maximum.reduceat(doc, self.head), np.logical_or.reduceat(self.block[self.order], self.head)])

    def windows(self, shared: np.ndarray, hit: np.ndarray, asked: np.ndarray) -> dict:
        """The windows of anchored runs: start word, doc_id, number among the distinct ones; of these hash, check and least doc_id."""
        n, place = len(self.doc), self.at[self.order]
        ok, anchor = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        ok[place + 1] = shared[self.group]
        anchor[place + 1] = hit[self.group] | (asked[self.group] & self.block[self.order])
        ok, anchor = np.cumsum(ok), np.cumsum(anchor)
        at, span = inside(self.words, WINDOW), WINDOW - BLOCK + 1
        at = at[(anchor[at + span] > anchor[at]) & (ok[at + span] - ok[at] == span)]
        at = at[self.known[self.doc[at]]]
        ids = self.ids[self.doc[at]]
        h = gram_hashes(self.hash, WINDOW)[at]
        check = (gram_hashes(mixed(self.hash ^ _SECOND), WINDOW, 0)[at] >> U64(32)).astype(np.uint32)
        order, head, group = _distinct(h, check)
        number = np.empty(len(h), np.int64)
        number[order] = group
        return {"at": at, "ids": ids, "number": number, "hash": h[order][head], "check": check[order][head], "least": np.minimum.reduceat(ids[order], head) if len(head) else ids}


# == messages


_SENT = "slice long, part long, hashes binary, extra binary"
_TOLD = "slice long, part long, told binary"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _messages(step, sender: int, values: np.ndarray, state: tuple, ranges: int) -> pa.RecordBatch:
    """Sorted hashes cut at the ranges, each piece with its state."""
    (which, at), extra = _ranges(values, ranges), step.coded(state)
    cuts = list(zip(at, at[1:]))
    return pa.record_batch([pa.array([sender] * len(which), pa.int64()), pa.array(which), pack([encode_sorted(values[a:b] >> U64(step.spare)) for a, b in cuts]), pack([extra(a, b) for a, b in cuts])], names=["slice", "part", "hashes", "extra"])


def _of_bits(flags: np.ndarray):
    return lambda a, b: b"".join(map(_bits, flags[:, a:b]))


def _bit_rows(blob: bytes, n: int, rows: int) -> np.ndarray:
    size = (n + 7) // 8
    return np.stack([_flags(blob[k * size : (k + 1) * size], n) for k in range(rows)])


class Anchors:
    """Step 1: rolling hashes; two bits of each sent (two documents have it, it is a block), three told (shared, hit, asked)."""

    told, spare = 3, 16  # answers; low bits that are zero in all hashes

    @staticmethod
    def own(s: Slice, row: dict) -> tuple[np.ndarray, tuple]:
        return s.keys, tuple(s.probes())

    @staticmethod
    def coded(state: tuple):
        return _of_bits(np.stack(state))

    @staticmethod
    def read(blob: bytes, n: int) -> tuple:
        return tuple(_bit_rows(blob, n, 2))

    @staticmethod
    def keys(h: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _distinct(h)

    @staticmethod
    def merged(state: tuple, head: np.ndarray, total: int) -> tuple:
        several, block = state
        return (np.diff(head, append=total) > 1) | np.logical_or.reduceat(several, head), np.logical_or.reduceat(block, head)

    @staticmethod
    def answer(state: tuple, head: np.ndarray, group: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        """What each sender is told; ``above``: what this place was told about the distinct hashes, if it isn't the last."""
        several, block = state
        senders = np.diff(head, append=len(group))
        holders = np.add.reduceat(block.astype(np.int64), head)
        shared = (senders > 1)[group] | several
        hit = (holders[group] - block > 0) | (several & block)
        out = np.stack([shared, hit, shared & block])
        if above is not None:
            out |= above[:, group] & np.stack([np.ones_like(block), np.ones_like(block), block])
        return out


class Repeats:
    """Step 2: windows; the least doc_id of each and the second hash sent, one bit told (a smaller doc_id exists elsewhere)."""

    told, spare = 1, 0

    @staticmethod
    def own(s: Slice, row: dict) -> tuple[np.ndarray, tuple]:
        w = s.windows(*_gathered(row["first"], s.keys, row["ranges"], Anchors.told))
        return w["hash"], (w["least"], w["check"])

    @staticmethod
    def coded(state: tuple):
        least, check = state
        return lambda a, b: check[a:b].tobytes() + int(least[a:b].min()).to_bytes(8, "little", signed=True) + encode((least[a:b] - least[a:b].min()).view(np.uint64))

    @staticmethod
    def read(blob: bytes, n: int) -> tuple:
        return decode(blob[4 * n + 8 :]).view(np.int64) + int.from_bytes(blob[4 * n : 4 * n + 8], "little", signed=True), np.frombuffer(blob, np.uint32, n)

    @staticmethod
    def keys(h: np.ndarray, state: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _distinct(h, state[1])

    @staticmethod
    def merged(state: tuple, head: np.ndarray, total: int) -> tuple:
        least, check = state
        return np.minimum.reduceat(least, head), check[head]

    @staticmethod
    def answer(state: tuple, head: np.ndarray, group: np.ndarray, above: np.ndarray | None) -> np.ndarray:
        least = state[0]
        lower = np.minimum.reduceat(least, head)[group] < least
        return (lower if above is None else lower | above[0][group])[None]


def _gathered(answers: list[dict], values: np.ndarray, ranges: int, rows: int) -> np.ndarray:
    """A sender's bits from the answers of all ranges, in the order of its sorted hashes."""
    which, at = _ranges(values, ranges)
    got = {x["part"]: x["told"] for x in answers or []}
    if not len(which):
        return np.zeros((rows, 0), bool)
    return np.concatenate([_bit_rows(got[k], b - a, rows) for k, a, b in zip(which.tolist(), at, at[1:])], axis=1)


def _send(step, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield _messages(step, row["slice"], *step.own(Slice(row), row), ranges)
        release()

    return run


def _joined(step, hashes: list[bytes], extra: list[bytes]) -> tuple:
    """Messages of several senders: sizes, sorting order, distinct hashes, state in this order, heads, groups."""
    parts = [decode_sorted(x) << U64(step.spare) for x in hashes]
    states = [step.read(x, len(p)) for x, p in zip(extra, parts)]
    every = np.concatenate(parts)
    state = tuple(np.concatenate(x) for x in zip(*states))
    order, head, group = step.keys(every, state)
    return [len(p) for p in parts], order, every[order][head], tuple(x[order] for x in state), head, group


def _tell(step, senders: pa.Array, part: pa.Array, sizes: list[int], order: np.ndarray, state: tuple, head: np.ndarray, group: np.ndarray, above: np.ndarray | None) -> pa.RecordBatch:
    bits = np.empty((step.told, len(order)), bool)
    bits[:, order] = step.answer(state, head, group, above)
    ends = np.cumsum(sizes).tolist()
    return pa.record_batch([senders, part, pack([b"".join(map(_bits, bits[:, b - n : b])) for n, b in zip(sizes, ends)])], names=["slice", "part", "told"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """A partition's messages by range; as a rule it has one."""
    got = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if got is not None:
        part = np.array(got.column("part"))
        for k in np.unique(part).tolist():
            yield got.take(np.flatnonzero(part == k)).combine_chunks()


def _last(step):
    """A range's answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            sizes, order, _, state, head, group = _joined(step, t.column("hashes").to_pylist(), t.column("extra").to_pylist())
            yield _tell(step, t.column("slice").combine_chunks(), t.column("part").combine_chunks(), sizes, order, state, head, group, None)
        release()

    return run


def exchange(senders: DataFrame, step, ranges: int, name: str, fan_out: int = FAN_OUT) -> DataFrame:
    """``slice, part, told``: what each sender learns of its hashes, by the ``reach`` parts that it sent to."""
    reach = min(ranges, fan_out)
    sent = senders.mapInArrow(_send(step, reach), _SENT)
    return _relay(sent, step, ranges, reach, name, fan_out)


def _relay(sent: DataFrame, step, ranges: int, reach: int, name: str, fan_out: int) -> DataFrame:
    if ranges <= reach:
        return sent.repartitionById(ranges, F.col("part").cast("int")).mapInArrow(_last(step), _TOLD)
    # too many ranges for one message each: bundles of senders pass on what they have together
    sent = stored(sent, f"{name}-sent")
    wider = min(ranges, reach * fan_out)
    bundle = F.xxhash64("part", F.pmod(F.xxhash64("slice"), F.lit(max(1, ranges // fan_out))))

    def merge(t: pa.Table) -> pa.Table:
        _, _, h, state, head, group = _joined(step, t.column("hashes").to_pylist(), t.column("extra").to_pylist())
        return pa.Table.from_batches([_messages(step, t.column("bundle")[0].as_py(), h, step.merged(state, head, len(group)), wider)])

    grouped = sent.withColumn("bundle", bundle)
    told = _relay(grouped.groupBy("bundle").applyInArrow(merge, _SENT), step, ranges, wider, name + "-", fan_out)
    told = told.withColumnRenamed("slice", "bundle").withColumnRenamed("part", "upper")

    def back(t: pa.Table, answers: pa.Table) -> pa.Table:
        sizes, order, h, state, head, group = _joined(step, t.column("hashes").to_pylist(), t.column("extra").to_pylist())
        above = _gathered([{"part": p, "told": b} for p, b in zip(answers.column("upper").to_pylist(), answers.column("told").to_pylist())], h, wider, step.told)
        return pa.Table.from_batches([_tell(step, t.column("slice").combine_chunks(), t.column("part").combine_chunks(), sizes, order, state, head, group, above)])

    return grouped.groupBy("bundle").cogroup(told.groupBy("bundle")).applyInArrow(back, _TOLD)


def _remove(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            s = Slice(row)
            found = s.windows(*_gathered(row["first"], s.keys, reach, Anchors.told))
            lower = _gathered(row["second"], found["hash"], reach, Repeats.told)[0]
            gone = found["at"][lower[found["number"]] | (found["ids"] > found["least"][found["number"]])]
            w = s.words
            cover = np.zeros(len(w.start) + 1, np.int32)
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + WINDOW, -1)
            kept = np.cumsum(cover[:-1]) == 0
            edge = np.zeros(len(w.data) + 1, np.int8)
            edge[w.start[kept]] = 1
            edge[w.end[kept] + 1] -= 1  # the white byte after a word goes along
            stay = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
            out = _SPACED[w.data[stay]]
            upto = np.concatenate([[0], np.cumsum(stay)])[s.off]
            view, size = memoryview(out), [(a, max(a, b - 1)) for a, b in zip(upto.tolist(), upto[1:].tolist())]
            removed = w.n - np.diff(np.concatenate([[0], np.cumsum(kept)])[w.first])
            yield pa.record_batch([pa.array(s.ids, mask=~s.known), pa.array(w.n), pa.array(removed), pack([bytes(view[a:b]) for a, b in size])], names=["doc_id", "n_words", "n_removed", "kept"])
        release()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_entries: int = RANGE_ENTRIES, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, one space between; UTF-8 bytes)."""
    slices = stored(packed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))), "slices")
    ranges = max(1, -(-(slices.agg(F.sum("n_words")).first()[0] or 0) // range_entries))
    reach = min(ranges, fan_out)
    gather = lambda told, to: told.groupBy("slice").agg(F.collect_list(F.struct("part", "told")).alias(to))
    first = gather(stored(exchange(slices, Anchors, ranges, "anchors", fan_out), "anchors"), "first")
    joined = slices.join(first, "slice", "left").withColumn("ranges", F.lit(reach))
    second = gather(exchange(joined, Repeats, ranges, "repeats", fan_out), "second")
    return joined.join(second, "slice", "left").mapInArrow(_remove(reach), "doc_id long, n_words long, n_removed long, kept binary")
