r"""Personal data: base patterns and bootstrapped contextual extraction (operator 1).

*Base* spans, leftmost and non-overlapping within a kind, exactly as these
expressions give them (matches that fail their check are dropped, not retried):

- email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``
- ip    ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``, parts at most 255
- card  ``[0-9]([\x20-]?[0-9])+``, 16 to 19 digits that pass Luhn
- phone ``\+[0-9][\x20().0-9-]+[0-9]``, 8 to 15 digits

They are found in time linear in the text.

*Seeds.*  Base spans, and *secrets*: tokens whose shape alone tells them (long
hexadecimal digests and keys with a known prefix), which are added as spans of
kind ``secret``.

*Bootstrapping.*  Each occurrence of an entity gives lexical patterns: the two
words before it; the word before and the word after; the two words after; the
word before, or after, with the token's shape (runs of digits, small and capital
letters as one mark each); and a cue alone if that ends in ``:``, ``=`` or ``#``
(also within a token, as in ``key=value``); a pattern with an empty side, at a
text's end, is none.  Words count whole, however long.  Candidate instances are
all other tokens of ``SHORTEST`` characters or more that hold a digit.  Spark
scores the bipartite graph of patterns and instances round by round until no
score moves by more than ``SETTLED`` (``ROUNDS`` at most): a pattern's score is
the sum of its distinct instances' confidence over their number plus one; an
instance's is one for seeds, else the noisy-or of its patterns that
``MIN_SEEDS`` distinct seeds support.  (As that support never changes, patterns
without it leave the graph at once.)  Occurrences of candidates in patterns of
score ``ACCEPT`` or more become spans of kind ``id``.  ``recovered`` measures the
method: seeds of one fold are hidden among the candidates, and those found
again counted.

Nulls and edge cases: a null text is empty; a null doc_id is kept and reported;
repeated rows get equal spans and count once as instances; other columns are
ignored, or passed through by ``redact``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkweave.llm.common import SLICE_BYTES, cut, release, stored, whole

KINDS = ("email", "ip", "card", "phone", "secret", "id")
SECRET, FOUND = KINDS.index("secret"), KINDS.index("id")
ROUNDS = 20
SETTLED = 0.01
SHORTEST = 4
MIN_SEEDS = 3
ACCEPT = 0.75
#: Bytes of discovered spans that may be broadcast to the texts for redaction; beyond, they are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"\S+")
_KEY = re.compile(r"(?=.*[0-9])(?=.*[A-Fa-f])(?:[0-9a-f]{16,}|[0-9A-F]{16,})|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AKIA[0-9A-Z]{16}|eyJ[\w-]+\.[\w-]+\.[\w-]+")
_SHAPE = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_A-Z]+"), "a"), (re.compile(r"[A-Z]+"), "A"))
_EDGES = "\"'`([{<.,;:!?)]}>|*&%$#"
_DOUBLE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def _luhn(digits: str) -> bool:
    return (sum(map(int, digits[-1::-2])) + sum(_DOUBLE[int(x)] for x in digits[-2::-2])) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = []
    at, last = t.find("@"), 0
    while at >= 0:
        start = at
        while start > last and t[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = t.find("@", m.end() if m else at + 1)
    if not _DIGIT.search(t):
        return out
    for m in _DOTTED.finditer(t):
        if m[0].count(".") >= 3:
            parts, start = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(x) < 4 and int(x) < 256 for x in (x.lstrip("0") or "0" for x in four)):
                    out.append((1, start, end))
                start = end + 1
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16 and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


def _key(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _back(t: str, at: int) -> tuple[int, int]:
    """Start and end of the word that ends at or before a place; equal at the text's beginning."""
    while at and t[at - 1].isspace():
        at -= 1
    end = at
    while at and not t[at - 1].isspace():
        at -= 1
    return at, end


def _before(t: str, at: int) -> tuple[str, str, str]:
    """Two words before a place, and the cue right before it (empty if it is none)."""
    a, b = _back(t, at)
    c, d = _back(t, a)
    left1, left2, cue = t[a:b].strip(_EDGES).lower(), t[c:d].strip(_EDGES).lower(), t[a:b].lower().lstrip(_EDGES)
    marked = cue[-1:] in ("=", ":", "#")
    return left2, left1 + "~" if b == at > a and not marked else left1, cue if marked else ""


def _after(t: str, end: int) -> tuple[str, str]:
    """The two words after a place; the rest of its own token isn't one."""
    if end < len(t) and not t[end].isspace():
        end = _TOKEN.match(t, end).end()
    words = []
    for _ in range(2):
        m = _TOKEN.search(t, end)
        words.append(m[0].strip(_EDGES).lower() if m else "")
        end = m.end() if m else end
    return words[0], words[1]


def _shape(token: str) -> str:
    for rule, mark in _SHAPE:
        token = rule.sub(mark, token)
    return token


def _patterns(t: str, start: int, end: int) -> list[int]:
    left2, left1, cue = _before(t, start)
    right1, right2 = _after(t, end)
    shape = _shape(t[start:end])
    pairs = (("LL", left2, left1), ("LR", left1, right1), ("RR", right1, right2), ("LS", left1, shape), ("SR", shape, right1), ("C", cue, cue))
    return [_key(*x) for x in pairs if x[1] and x[2]]


def _candidates(t: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens with a digit, without cue and outer punctuation, that touch no base span."""
    taken = sorted((s, e) for _, s, e in base)
    out, at, k = [], 0, 0
    while m := _DIGIT.search(t, at):
        start = m.start()
        while start > at and not t[start - 1].isspace():
            start -= 1
        end = _TOKEN.match(t, m.start()).end()
        at = end
        token = t[start:end]
        cue = max(token.find("="), token.find(":"))
        if 0 < cue < len(token) - 1:
            start += cue + 1
            token = token[cue + 1 :]
        core = token.strip(_EDGES)
        if len(core) < SHORTEST or not _DIGIT.search(core):
            continue
        start += token.index(core)
        end = start + len(core)
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            out.append((start, end))
    return out


def found_spans(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Base spans, secrets (both as kind, start, end) and the candidates that are neither."""
    base = base_spans(t)
    secrets, others = [], []
    for a, b in _candidates(t, base):
        if b - a > 12 and _KEY.fullmatch(t, a, b):
            secrets.append((SECRET, a, b))
        else:
            others.append((a, b))
    return base, secrets, others


_SPAN = "struct<kind:int,start:int,end:int>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, mark`` (hash of the text), ``base`` and ``sure`` (kind, start, end) and ``found`` (instances with their patterns)."""
    schema = f"doc_id long, mark long, base array<{_SPAN}>, sure array<{_SPAN}>, found array<struct<start:int,end:int,instance:long,seed:boolean,patterns:array<bigint>>>"
    span_type = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.int64()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.int64()))]))
    as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in cut(whole_batch, "text", SLICE_BYTES)):
            bases, sures, founds = [], [], []
            for t in batch.column("text").to_pylist():
                base, secrets, other = found_spans(t) if t else ([], [], [])
                bases.append(as_rows(base))
                sures.append(as_rows(secrets))
                founds.append([{"start": a, "end": b, "instance": _key(t[a:b].lower()), "seed": seed, "patterns": _patterns(t, a, b)} for seed, spans in ((True, [x[1:] for x in base + secrets]), (False, other)) for a, b in spans])
            yield pa.record_batch([batch.column("doc_id"), batch.column("mark"), pa.array(bases, span_type), pa.array(sures, span_type), pa.array(founds, found_type)], names=["doc_id", "mark", "base", "sure", "found"])
        release()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema)


def score(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pattern, score, seeds`` from distinct ``pattern, instance, seed``."""
    support = edges.groupBy("pattern").agg(F.sum(F.col("seed").cast("long")).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    edges = stored(edges.join(support, "pattern"), "supported")
    sure = F.col("seed").cast("double")
    patterns = stored(edges.groupBy("pattern", "seeds").agg((F.sum(sure) / (F.count("*") + 1)).alias("score")), "patterns")
    for _ in range(rounds - 1):
        doubt = F.sum(F.log(1 - F.least("score", F.lit(0.999))))
        confidence = edges.join(patterns.select("pattern", "score"), "pattern").groupBy("instance").agg(F.greatest(F.max(sure), 1 - F.exp(doubt)).alias("confidence"))
        rescored = stored(edges.join(confidence, "instance").groupBy("pattern", "seeds").agg((F.sum("confidence") / (F.count("*") + 1)).alias("score")), "patterns")
        moved = rescored.join(patterns.select("pattern", F.col("score").alias("old")), "pattern").agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0]
        patterns = rescored
        if (moved or 0) <= SETTLED:
            break
    return patterns.select("pattern", "score", "seeds")


def discovered(scanned: DataFrame) -> DataFrame:
    """``doc_id, mark, more``: spans of candidates in high-confidence patterns."""
    occurrences = scanned.select("doc_id", "mark", F.explode("found").alias("f")).select("doc_id", "mark", "f.*")
    links = occurrences.select(F.explode("patterns").alias("pattern"), "instance", "seed")
    edges = links.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    good = score(edges).where(F.col("score") >= ACCEPT).select("pattern")
    hits = occurrences.where("not seed").select("doc_id", "mark", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    span = F.struct(F.lit(FOUND).alias("kind"), "start", "end")
    return hits.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set(span)).alias("more"))


def recovered(docs: DataFrame, fold: int = 0, folds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``hidden, found, others``: occurrences of the seeds of one fold (by their hash) when these are mere candidates, how many patterns find, and other spans found."""
    scanned = stored(scan(docs, id_col, text_col), "scanned")
    masked_out = lambda f: f["seed"] & (F.pmod(f["instance"], F.lit(folds)) == fold)
    fields = lambda f, seed: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["instance"].alias("instance"), seed.alias("seed"), f["patterns"].alias("patterns"))
    more = stored(discovered(scanned.withColumn("found", F.transform("found", lambda f: fields(f, f["seed"] & ~masked_out(f))))), "discovered")
    rows = scanned.select("doc_id", "mark", F.explode("found").alias("f")).where(masked_out(F.col("f"))).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("f.start").alias("s"), F.col("f.end").alias("e")).distinct()
    got = more.select("doc_id", "mark", F.explode("more").alias("x")).select("doc_id", "mark", "x.start", "x.end")
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("m") == F.col("mark")) & (F.col("s") == F.col("start")) & (F.col("e") == F.col("end"))
    return rows.join(got, same, "full").agg(F.count("m").alias("hidden"), F.count_if(F.col("m").isNotNull() & F.col("mark").isNotNull()).alias("found"), F.count_if(F.col("m").isNull()).alias("others"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans`` (arrays of kind, start, end by kind and start)."""
    scanned = stored(scan(docs, id_col, text_col), "scanned")
    more = stored(discovered(scanned), "discovered").select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "more")
    joined = scanned.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left")
    return joined.select("doc_id", "base", F.concat("base", "sure", F.coalesce("more", F.expr(f"cast(array() as array<{_SPAN}>)"))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The counts, hash and list of spans that the query returns; ``n_more`` counts secrets and discovered ones, ``n_spans`` all."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)
    count = [F.size(of(k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    n = F.size("spans").cast("long")
    return found.select("doc_id", *count, (n - F.size("base")).alias("n_more"), n.alias("n_spans"), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def masked(t: str, more: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the union by the first one's."""
    out, at = [], 0
    base, secrets, _ = found_spans(t)
    for s, e, k in sorted((s, e, k) for k, s, e in [*base, *secrets, *more]):
        if s >= at:
            out += [t[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, t[at:]]) if out else t


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns and rows, with personal data in ``text`` masked."""
    more = stored(discovered(stored(scan(docs, id_col, text_col), "scanned")), "discovered").select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), "more")
    if more.agg(F.coalesce(F.sum(48 + 24 * F.size("more")), F.lit(0))).first()[0] <= BROADCAST_BYTES:
        more = F.broadcast(more)
    rows = docs.select(whole(docs), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    rows = rows.join(more, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left").select("row", "text", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in cut(whole_batch, "text", SLICE_BYTES)):
            clean = [t and masked(t, [(x["kind"], x["start"], x["end"]) for x in m or []]) for t, m in zip(batch.column("text").to_pylist(), batch.column("more").to_pylist())]
            yield pa.record_batch([batch.column("row"), pa.array(clean, pa.string())], names=["row", "clean"])
        release()

    schema = StructType([StructField("row", docs.schema)]).add("clean", "string")
    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
