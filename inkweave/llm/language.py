"""Language identification of mixed-language text (operator 2).

Training counts character bigrams and trigrams, hashed into ``2 * BUCKETS``
cells, and letters by script, for every language of all labelled documents; the
model is as large as cells times languages, whatever the corpus, so it can be
broadcast.

A word (run of letters and marks) is scored against each language by the sum of
its n-grams' log-probabilities.  Its script, by code-point ranges, narrows the
candidates to languages that use it (``SCRIPT_SHARE`` of their letters).
Viterbi decoding with a penalty of ``SWITCH`` for each change of language
labels the words of a text; consecutive words of one label are a span.  The
text's language is that with most letters, its score their share.

Nulls and edge cases: a null text, or one without letters, is ``und`` with
score 0; so is every text if nothing was learned.  Rows with a null language
teach nothing; ties between languages go to the first by code point.  Repeated
rows count each time.  Other columns pass through untouched (``predict``) and
may have any names but those of the result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from inkweave.llm.common import code_points, cut, release, spaced, whole, with_field

BUCKETS = 1 << 15
SWITCH = 12.0
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Bytes of text that are scanned, and whose words are decoded together, at a time.
PART_BYTES = 1 << 20
DECODE_BYTES = 8 << 20
#: (name, first and last code point ...) of the scripts told apart; all else is script 0.
SCRIPTS = (
    ("latin", (0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    ("armenian", (0x530, 0x58F)),
    ("hebrew", (0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    ("indic", (0x900, 0xDFF)),
    ("thai", (0xE00, 0xE7F)),
    ("lao_tibetan_myanmar", (0xE80, 0x109F)),
    ("georgian", (0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    ("hangul", (0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7FF)),
    ("ethiopic", (0x1200, 0x139F)),
    ("kana", (0x3040, 0x30FF), (0x31F0, 0x31FF)),
    ("han", (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
)
CELLS = 2 * BUCKETS + len(SCRIPTS) + 1
_tables: list[np.ndarray] = []


def _letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its lower case as a letter or mark (else 0), whether it is a letter, its script."""
    if not _tables:
        lower = np.zeros(0x110000, np.uint32)
        letter = np.zeros(0x110000, bool)
        script = np.zeros(0x110000, np.uint8)
        for k, (_, *spans) in enumerate(SCRIPTS, 1):
            for a, b in spans:
                script[a : b + 1] = k
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                letter[k], lower[k] = True, ord(low) if len(low) == 1 else k
            elif k > 0x2FF and unicodedata.category(c)[0] == "M":
                lower[k] = k
        _tables.extend((lower, letter, script))
    return _tables[0], _tables[1], _tables[2]


class Scan:
    """N-grams and words of the texts of one column."""

    def __init__(self, col: pa.Array):
        lower, letter, script = _letters()
        points, self.off = code_points(*spaced(col))
        c = lower[points]
        p1 = np.concatenate([[0], c[:-1]]).astype(np.uint32)
        p2 = np.concatenate([[0], p1[:-1]]).astype(np.uint32)
        p2[p1 == 0] = 0
        live = np.flatnonzero((c | p1) != 0)  # letters, and the place after a word
        a, b, d = c[live], p1[live], p2[live]
        two = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
        self.two = (two ^ two >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)
        three = (two + d * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        self.three = ((three ^ three >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)) + np.uint32(BUCKETS)
        first = (c != 0) & (p1 == 0)
        self.start = np.flatnonzero(first)
        self.stop = np.flatnonzero((c == 0) & (p1 != 0))
        self.head = np.flatnonzero(first[live])  # of each word, among its n-grams
        self.first = np.searchsorted(self.start, self.off)  # of each text, among the words
        ink = np.concatenate([[0], np.cumsum(letter[points])])
        self.size = ink[self.stop] - ink[self.start]  # letters of each word
        self.letters = np.diff(ink[self.off])
        self.script = script[points[self.start]]
        self.letter_script = script[points[letter[points]]]


# == training


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, cell, n`` over all rows whose language is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in cut(batch, "text", PART_BYTES):
                lang = part.column("lang")
                for x in lang.unique().to_pylist():
                    s = Scan(part.column("text").filter(pc.equal(lang, x)))
                    total.setdefault(x, np.zeros(CELLS, np.int64))
                    for cells, shift in ((s.two, 0), (s.three, 0), (s.letter_script, 2 * BUCKETS)):
                        n = np.bincount(cells)
                        total[x][shift : shift + len(n)] += n
        release()
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([x] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return known.mapInArrow(run, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))


class Model:
    """Log-probabilities by cell and language, and which languages use a script."""

    def __init__(self, langs: list[str], n: np.ndarray):
        self.langs = langs
        rate = n[: 2 * BUCKETS].astype(np.float64).reshape(2, BUCKETS, -1) + 0.5
        self.logs = np.log(rate / rate.sum(1, keepdims=True)).astype(np.float32).reshape(2 * BUCKETS, -1)
        script = n[2 * BUCKETS :].astype(np.float64)
        uses = script >= SCRIPT_SHARE * np.maximum(script.sum(0), 1)
        uses[~uses.any(1)] = True
        self.bar = np.where(uses, 0, -1e4).astype(np.float32)


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of all labelled rows.  What comes to the driver is bounded by cells times languages."""
    got = counts(docs, lang_col, text_col).toArrow()
    langs = sorted(got.column("lang").unique().to_pylist())
    n = np.zeros((CELLS, len(langs)), np.int64)
    number = {x: k for k, x in enumerate(langs)}
    n[np.array(got.column("cell"), np.int64), np.array([number[x] for x in got.column("lang").to_pylist()], np.int64)] = np.array(got.column("n"))
    return Model(langs, n)


# == decoding


def viterbi(score: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best label of each word; ``first`` delimits texts.  All texts advance together, word by word, the longest in front."""
    n, k = score.shape
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    label = np.zeros(n, np.int8 if k < 128 else np.int16)
    if not n or k < 2:
        return label
    most = int(size[0])
    alive = len(size) - np.searchsorted(size[::-1], np.arange(most), "right")
    stay = np.empty((n, k), bool)
    source = np.empty(n, label.dtype)
    last = np.empty(len(size), label.dtype)  # label of each text's last word
    now = score[begin[: alive[0]]]
    for t in range(1, most):
        m = alive[t]
        last[m : alive[t - 1]] = now[m:].argmax(1)
        now, at = now[:m], begin[:m] + t
        best = now.argmax(1)
        other = (now[np.arange(m), best] - np.float32(switch))[:, None]
        keeps = now >= other
        stay[at], source[at] = keeps, best
        now = np.where(keeps, now, other) + score[at]
    last[: alive[-1]] = now.argmax(1)
    state = np.zeros(0, label.dtype)
    for t in range(most - 1, -1, -1):
        m = alive[t]
        state = np.concatenate([state, last[len(state) : m]])
        at = begin[:m] + t
        label[at] = state
        if t:
            state = np.where(stay[at, state], state, source[at])
    return label


def decode(texts: pa.Array, model: Model, spans: bool = False) -> tuple[list[str], np.ndarray, list[str] | None]:
    """Language and score of each text, and on request its spans as ``lang:start:end`` in code points, joined by commas."""
    k = len(model.langs)
    parts = list(cut(pa.record_batch([texts], names=["text"]), "text", PART_BYTES))
    score, size, first, letters, edge = [], [], [np.zeros(1, np.int64)], [], []
    for part in parts:
        s = Scan(part.column(0))
        if k and len(s.head):
            grams = model.logs[s.two]
            grams += model.logs[s.three]
            score.append(np.add.reduceat(grams, s.head, axis=0) + model.bar[s.script])
        size.append(s.size)
        first.append(s.first[1:] + first[-1][-1])
        letters.append(s.letters)
        if spans:
            doc = np.repeat(s.off[:-1], np.diff(s.first))
            edge.append(np.stack([s.start - doc, s.stop - doc], 1))
    first, n = np.concatenate(first), len(texts)
    if not score:
        return [UNKNOWN] * n, np.zeros(n), [""] * n if spans else None
    label, size = viterbi(np.concatenate(score), first).astype(np.int64), np.concatenate(size)
    doc = np.repeat(np.arange(n), np.diff(first))
    share = np.bincount(doc * k + label, size, n * k).reshape(n, k)
    total, best = share.sum(1), share.argmax(1)
    rate = np.where(total > 0, share[np.arange(n), best] / np.maximum(total, 1), 0)
    names = [model.langs[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist())]
    if not spans:
        return names, rate, None
    edges, out = np.concatenate(edge), [[] for _ in range(n)]
    turn = np.flatnonzero((np.diff(label, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    for a, b in zip(turn.tolist(), [*turn[1:].tolist(), len(label)]):
        out[doc[a]].append(f"{model.langs[label[a]]}:{edges[a, 0]}:{edges[b - 1, 1]}")
    return names, rate, [",".join(x) for x in out]


def _judged(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``row`` (all columns of ``docs``), ``lang_pred``, ``lang_score`` and on request ``lang_spans``."""
    shared, number = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cut(with_field(batch, number), "text", DECODE_BYTES):
                names, rate, found = decode(part.column("text"), shared.value, spans)
                extra = [pa.array(names, pa.string()), pa.array(rate), *([pa.array(found, pa.string())] if spans else [])]
                yield pa.record_batch([part.column("row"), *extra], names=["row", "lang_pred", "lang_score", *["lang_spans"] * spans])
        release()

    schema = StructType([StructField("row", docs.schema), StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())] + [StructField("lang_spans", StringType())] * spans)
    return docs.select(whole(docs)).mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, text_col: str = "text", spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and on request ``lang_spans``; only the text decides."""
    return _judged(docs, model, text_col, spans).select("row.*", "lang_pred", "lang_score", *["lang_spans"] * spans)


def with_language(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, that have a language with at least this share of their letters."""
    judged = _judged(docs, model, text_col)
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least)).select("row.*")


def held_out(id_col: str = "doc_id"):
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame, spans: bool = False) -> DataFrame:
    """Trains on the rows of ``docs`` that aren't held out and predicts all: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs.where(~held_out()))
    got = predict(docs.select("doc_id", "text"), model, spans=spans)
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), *["lang_spans"] * spans)
