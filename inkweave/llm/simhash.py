"""SimHash near-duplicates with pigeonring filtering (operator 6).

One pass turns texts into 64-bit fingerprints.  Equal fingerprints are
aggregated first, so that copies cost nothing later; pairs are sought among
distinct fingerprints only.

*Pigeonring.*  The fingerprint is a ring of ``SEGMENTS`` segments.  If two
fingerprints differ in at most ``RADIUS`` bits, then some segment starts a
chain in which every prefix of l segments differs in at most
``floor(l * RADIUS / SEGMENTS)`` bits.  With 5 segments and radius 4 the quotas
are 0, 1, 2, 3, 4: the first segment is equal and the second differs in one bit
at most, which makes a 26-bit equi-join key (one side gives each key once, the
other with every one-bit change of its second half).  The longer prefixes then
prune candidates; the last quota is the full Hamming check.  A pair is reported
by its first valid start only, so no distinct is needed.

Nulls and edge cases: a null or blank text has fingerprint zero and links like
any other; a null ``doc_id`` never becomes a component's id unless no reachable
row has one (then it is null); repeated rows count as separate documents; other
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import U64, arrow_map, buffers, inside, stored, whole, words_of

RADIUS = 4
SEGMENTS = 5
SHINGLE = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
STARTS = (0, 13, 26, 39, 52)
#: Bytes of text that are fingerprinted together, and of a shingle that is hashed by itself.
PART_BYTES = 1 << 20
ONE_BY_ONE = 512
_P1, _P2, _P3, _P4, _P5 = map(U64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_ALL = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = [np.array([sum((x >> (4 * half + b) & 1) << (16 * b) for b in range(4)) for x in range(256)], np.uint64) for half in range(2)]


# == fingerprints


def _left(x: np.ndarray, r: int) -> np.ndarray:
    return x << U64(r) | x >> U64(64 - r)


def xxh64(data: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges of one buffer, step by step over all that still have bytes; the longest few one by one."""
    size = stop - start
    out = np.empty(len(start), np.uint64)
    far = np.flatnonzero(size > ONE_BY_ONE)
    for k in far.tolist():
        out[k] = xxhash.xxh64_intdigest(data[start[k] : stop[k]], seed)
    rest = np.flatnonzero(size <= ONE_BY_ONE) if len(far) else np.arange(len(start))
    at, left = start[rest], size[rest]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    four = np.ndarray(len(data) + 5, "<u4", padded, strides=(1,))
    h = np.full(len(rest), (seed + int(_P5)) & _ALL, np.uint64)
    mix = lambda x: _left(x * _P2, 31) * _P1
    if len(k := np.flatnonzero(left >= 32)):
        lanes = [np.full(len(k), (seed + x) & _ALL, np.uint64) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        now = np.arange(len(k))
        while len(now):
            p = at[k[now]]
            for n in range(4):
                lanes[n][now] = _left(lanes[n][now] + eight[p + 8 * n] * _P2, 31) * _P1
            at[k[now]] += 32
            left[k[now]] -= 32
            now = now[left[k[now]] >= 32]
        long = _left(lanes[0], 1) + _left(lanes[1], 7) + _left(lanes[2], 12) + _left(lanes[3], 18)
        for lane in lanes:
            long = (long ^ mix(lane)) * _P1 + _P4
        h[k] = long
    h += size[rest].astype(np.uint64)
    while len(k := np.flatnonzero(left >= 8)):
        h[k] = _left(h[k] ^ mix(eight[at[k]]), 27) * _P1 + _P4
        at[k] += 8
        left[k] -= 8
    k = np.flatnonzero(left >= 4)
    h[k] = _left(h[k] ^ four[at[k]].astype(np.uint64) * _P1, 23) * _P2 + _P3
    at[k] += 4
    left[k] -= 4
    while len(k := np.flatnonzero(left > 0)):
        h[k] = _left(h[k] ^ data[at[k]].astype(np.uint64) * _P5, 11) * _P1
        at[k] += 1
        left[k] -= 1
    h = (h ^ h >> U64(33)) * _P2
    h = (h ^ h >> U64(29)) * _P3
    out[rest] = h ^ h >> U64(32)
    return out


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the hashes ``first[k]:first[k+1]``; zero without any.  Bits are counted four at a time in 16-bit lanes."""
    out = np.zeros(len(first) - 1, np.uint64)
    n = np.diff(first)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    begin = first[:-1][full]
    pieces = -(-n[full] // 0xFFFF)  # no lane may run over
    edge = np.repeat(begin, pieces) + 0xFFFF * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    group = np.cumsum(pieces) - pieces
    for k in range(8):
        octet = (h >> U64(8 * k)).astype(np.uint8)
        for half in range(2):
            lanes = np.add.reduceat(_LANES[half][octet], edge)
            for b in range(4):
                count = np.add.reduceat((lanes >> U64(16 * b) & U64(0xFFFF)).astype(np.int64), group)
                out[full] |= (2 * count > n[full]).astype(np.uint64) << U64(8 * k + 4 * half + b)
    return out


def prints_of(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Unsigned fingerprints of the texts in one UTF-8 buffer."""
    w = words_of(data, off)
    size = w.end - w.start
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    # every word in lower case and one space after it
    place = np.arange(begin[-1]) + np.repeat(w.start - begin[:-1], size + 1)
    line = _LOWER[w.data[np.minimum(place, max(0, len(w.data) - 1))]] if len(w.data) else np.zeros(0, np.uint8)
    line[begin[1:] - 1] = 32
    few = (w.n > 0) & (w.n < SHINGLE)
    at = np.sort(np.concatenate([inside(w, SHINGLE), w.first[:-1][few]]))
    h = xxh64(line, begin[at], begin[np.minimum(at + SHINGLE, np.repeat(w.first[1:], w.n)[at])] - 1)
    return majority(h, np.searchsorted(at, w.first))


def fingerprint(text: bytes) -> int:
    """Unsigned fingerprint of one UTF-8 text."""
    return int(prints_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``doc_id``, ``fp`` (signed long) and those named in ``keep``."""
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = prints_of(*buffers(batch.column("text")))
        return pa.record_batch([batch.column("doc_id"), pa.array(got.view(np.int64)), *(batch.column(c) for c in keep)], names=["doc_id", "fp", *keep])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *keep), kernel, f"doc_id long, fp long{kinds}", limit=PART_BYTES)


# == pairs


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chain(diff: Column, start: int) -> Column:
    """Whether the chain of segments from ``start`` keeps to every quota."""
    ok, mask = F.lit(True), 0
    for length in range(1, SEGMENTS + 1):
        k = (start + length - 1) % SEGMENTS
        mask |= ((1 << WIDTHS[k]) - 1) << STARTS[k]
        ok = ok & (F.bit_count(diff.bitwiseAND(F.lit(_signed(mask)).cast("long"))) <= length * RADIUS // SEGMENTS)
    return ok


def near_pairs(groups: DataFrame) -> DataFrame:
    """Ordered pairs ``(a, b, n_b)`` of distinct fingerprints within the radius; each pair comes both ways, once.

    ``groups`` has ``fp`` (distinct) and ``n`` (documents that share it).
    """

    def segment(k: int) -> Column:
        return F.shiftrightunsigned("fp", STARTS[k]).bitwiseAND(F.lit((1 << WIDTHS[k]) - 1).cast("long"))

    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(k).cast("long").bitwiseOR(F.shiftleft(segment(k), 3)).bitwiseOR(F.shiftleft(segment((k + 1) % SEGMENTS), 16)).alias("key")) for k in range(SEGMENTS)))
    index = groups.select(F.col("fp").alias("a"), F.explode(keys).alias("s")).select("a", "s.k", "s.key")
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << (16 + b)).cast("long") for b in range(max(WIDTHS))))
    probe = groups.select(F.col("fp").alias("b"), F.col("n").alias("n_b"), F.explode(F.transform(keys, lambda s: s["key"])).alias("base"))
    probe = probe.select("b", "n_b", "base", F.explode(flips).alias("flip")).select("b", "n_b", F.col("base").bitwiseXOR(F.col("flip")).alias("key"))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    chains = [_chain(diff, k) for k in range(SEGMENTS)]
    first = F.lit(False)
    for k in reversed(range(SEGMENTS)):
        first = F.when(chains[k], F.col("k") == k).otherwise(first)
    # sizes are estimated before the explodes, so a broadcast would be chosen blindly
    return index.join(probe.hint("merge"), "key").where((F.col("a") != F.col("b")) & first).select("a", "b", "n_b")


# == components


def components(edges: DataFrame) -> DataFrame:
    """``(node, rep)``: the smallest node of each node's component, for the nodes of ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes; each
    step is a minimum and a join back, so a hub's neighbours are never gathered
    in one place.  Every round is written out, which cuts the lineage.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = stored(small, "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("rep")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("rep")).distinct())


def classes(prints: DataFrame) -> DataFrame:
    """Per distinct fingerprint: ``fp``, ``n_near`` (of each of its documents), ``component_id`` (null if none of the component's rows has an id) and ``rep``, which is never null."""
    groups = stored(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("root")), "fingerprints")
    pairs = stored(near_pairs(groups), "pairs")
    member = components(pairs.where("a < b"))
    degree = pairs.groupBy("a").agg(F.sum("n_b").alias("near"))
    wide = groups.join(degree, groups.fp == degree.a, "left").join(member, groups.fp == member.node, "left")
    wide = stored(wide.select("fp", "root", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near"), F.coalesce("rep", "fp").alias("rep")), "classes")
    least = wide.groupBy("rep").agg(F.min("root").alias("component_id"))
    return wide.join(least, "rep").select("fp", "n_near", "component_id", "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex), ``n_near``, ``component_id``."""
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    return prints.join(classes(prints), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest ``doc_id`` (rows without one come last)."""
    mark = F.xxhash64("text")
    prints = stored(fingerprints(docs.select("doc_id", "text", mark.alias("mark")), keep=("mark",)), "prints")
    rows = prints.join(classes(prints).withColumnRenamed("component_id", "root"), "fp")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    member = rows.withColumn("one", F.coalesce("root", "rep")).withColumn("rootless", F.col("root").isNull())
    best = member.groupBy("one", "rootless").agg(F.min(key).alias("k")).select("k.doc_id", "k.mark")
    copies = prints.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    same = lambda x, y: x["doc_id"].eqNullSafe(y["doc_id"]) & (x["mark"] == y["mark"])
    best = best.join(copies, same(best, copies)).select(best["doc_id"].alias("keep_id"), best["mark"].alias("keep_mark"), "copies")
    kept = docs.select(whole(docs), "doc_id", mark.alias("mark")).join(best, F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("mark") == F.col("keep_mark")))
    kept = kept.select("row", "keep_id", "keep_mark", "copies")
    single = kept.where("copies = 1").select("row.*")
    repeated = kept.where("copies > 1").groupBy("keep_id", "keep_mark").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return single.unionByName(repeated)
