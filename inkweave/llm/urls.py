"""URL filters with host word segmentation and naive Bayes (operator 9).

*Rules.*  A rule (verdict, host, path) fits its host and all subdomains if the
url's path starts with the rule's; of those that fit the longest decides.

*Method* for all other urls.  The labels of a host are split into words by
unigram Viterbi: the best product of word probabilities, where a piece that
isn't in the lexicon costs more the longer it is.  The lexicon are all words (runs
of a to z, of any length, that touch no other letters) of all pages' text, tags,
scripts and entities aside.  A piece has ``LONGEST`` letters at most, as the names
of a host have by DNS.  Each name is joined with those of its pieces that are
words, so neither lexicon nor names are ever in one place.  Host words, and the
path's runs of letters (numbers count as one token), are the tokens of a
multinomial naive Bayes model, hashed into ``BUCKETS`` cells, with Laplace
smoothing over those that were seen (a token that wasn't says nothing), its two classes weighed alike however unequal the rules made them (a
prior by their counts would decide most urls alone).  It learns from all urls
that rules decide; without any it allows.  ``held_out`` measures it: learned from
three quarters of the ruled urls, asked of the others.

The naive Bayes model is bounded by its cells, so it is sent to the workers
whole.  Words of hosts are made once for each distinct name and joined back; a
host that holds a third of the pages is a skewed key of a sort-merge join, which
adaptive execution splits.

Nulls and edge cases: a null url or one without ``://`` has empty host and path,
fits no rule and has no tokens, so it is allowed; a tie allows; repeated
rows are judged alike; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import stored

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
LONGEST = 63
BUCKETS = 1 << 16
#: Entities that are letters, which words don't end at; all others are marks.
_LETTER = r"&(?i:[a-z]{1,2}(?:acute|grave|circ|uml|tilde|ring|cedil|slash|caron|lig));"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PIECE = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict``; the last two are null where no rule fits."""
    df = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("verdict", verdict)


# == segmentation


def lexicon(pages: DataFrame, text_col: str = "html") -> DataFrame:
    """``word, n``: how often each word occurs in all pages, tags, scripts and entities aside."""
    text = F.regexp_replace(F.regexp_replace(F.col(text_col), r"(?s)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, _LETTER, "é"), r"&(?:#?[0-9a-zA-Z]+);", " ")
    words = pages.select(F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(r"(?<![\p{L}\p{M}])([a-z]++)(?![\p{L}\p{M}])"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def segment(name: str, words: dict[str, float]) -> list[str]:
    """The most probable split of a name; of equal ones, that with the longest last words."""
    n = len(name)
    best, cut = [0.0] + [float("-inf")] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - LONGEST), end):
            piece = name[start:end]
            score = best[start] + words.get(piece, -12.0 - 2.3 * (end - start))
            if score > best[end]:
                best[end], cut[end] = score, start
    out = []
    while n:
        out.append(name[cut[n] : n])
        n = cut[n]
    return out[::-1]


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """``host, host_tokens`` of distinct hosts: the words of its names, numbers as ``0``, in order."""
    pieces = F.regexp_extract_all("host", F.lit(f"({_PIECE.pattern})"))
    placed = hosts.select("host", F.posexplode(pieces).alias("place", "name"))
    names = placed.select("name").distinct()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    n = F.length("name")
    # generated row by row: a long name's pieces are never in one array
    spans = names.where(~F.col("name").rlike("^[0-9]")).select("name", F.explode(F.sequence(F.lit(1), n)).alias("a"))
    spans = spans.select("name", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), n - F.col("a") + 1))).alias("k"))
    known = spans.select("name", F.expr("substr(name, a, k)").alias("word")).distinct().join(words.hint("merge"), "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = []
            for name, found in zip(batch.column("name").to_pylist(), batch.column("known").to_pylist()):
                split.append(["h:0"] if name[0].isdigit() else [f"h:{w}" for w in segment(name, {x["word"]: log(x["n"] / total) for x in found or []})])
            yield pa.record_batch([batch.column("name"), pa.array(split, pa.list_(pa.string()))], names=["name", "split"])

    done = names.join(known.hint("merge"), "name", "left").mapInArrow(run, "name string, split array<string>")
    parts = placed.join(done.hint("merge"), "name").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", "split"))).alias("s"))
    return parts.select("host", F.flatten(F.transform("s", lambda x: x["split"])).alias("host_tokens"))


def path_tokens(path: str) -> list[str]:
    return ["p:0" if x[0].isdigit() else f"p:{x}" for x in _PIECE.findall(path.lower())]


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


# == naive Bayes


def _rows(batch: pa.RecordBatch) -> Iterator[list[str]]:
    for host, path in zip(batch.column("host_tokens").to_pylist(), batch.column("path").to_pylist()):
        yield (host or []) + path_tokens(path)


def train(judged: DataFrame) -> tuple[np.ndarray, float]:
    """Log-odds of block by token bucket, and those of a url without tokens, from rows of ``host_tokens, path, verdict``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((BUCKETS + 1, 2), np.int64)
        for batch in batches:
            for tokens, verdict in zip(_rows(batch), batch.column("verdict").to_pylist()):
                k = int(verdict == "block")
                count[BUCKETS, k] += 1
                for t in tokens:
                    count[bucket(t), k] += 1
        at = np.flatnonzero(count.any(1))
        yield pa.record_batch([pa.array(at), pa.array(count[at, 0]), pa.array(count[at, 1])], names=["bucket", "allow", "block"])

    got = judged.select("host_tokens", "path", "verdict").mapInArrow(run, "bucket long, allow long, block long").groupBy("bucket").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toArrow()
    count = np.zeros((BUCKETS + 1, 2), np.float64)
    count[np.array(got.column("bucket"), np.int64)] = np.stack([np.array(got.column("allow")), np.array(got.column("block"))], 1).reshape(-1, 2)
    seen = count[:BUCKETS].any(1)
    rate = (count[:BUCKETS] + 1) * seen[:, None]
    odds = np.log(np.where(seen[:, None], rate / np.maximum(rate.sum(0), 1), 1))
    return odds[:, 1] - odds[:, 0], 0.0 if count[BUCKETS].any() else -1.0


def with_tokens(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``ruled`` with the words of each host."""
    df = ruled(pages, rules, id_col, url_col)
    words = stored(host_words(df.select("host").distinct(), stored(lexicon(pages, text_col), "lexicon")), "hosts")
    return df.join(words.hint("merge"), "host", "left")


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` and ``odds``, the model's log-odds of block (null where a rule decides)."""
    df = with_tokens(pages, rules, id_col, url_col, text_col)
    return _judged(df, train(df.where(F.col("rule").isNotNull())))


def held_out(pages: DataFrame, rules=RULES, fold: int = 2, folds: int = 4) -> DataFrame:
    """``truth, verdict, n``: how the model judges the ruled urls of one fold (by the crc32 of host and path), learned from the others."""
    df = with_tokens(pages, rules).where(F.col("rule").isNotNull())
    out = F.crc32(F.concat("host", "path")) % folds == fold
    asked = df.where(out).withColumn("rule", F.col("verdict")).withColumn("verdict", F.lit(None).cast("string"))
    return _judged(asked, train(df.where(~out))).groupBy(F.col("rule").alias("truth"), "verdict").agg(F.count("*").alias("n"))


def _judged(df: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, prior = shared.value
        for batch in batches:
            verdict, score = batch.column("verdict").to_pylist(), []
            for k, tokens in enumerate(_rows(batch)):
                if verdict[k] is None:
                    score.append(prior + float(sum(odds[bucket(t)] for t in tokens)))
                    verdict[k] = "block" if score[-1] > 0 else "allow"
                else:
                    score.append(None)
            yield pa.record_batch([batch.column(c) for c in ("page_id", "host", "path", "rule")] + [pa.array(verdict, pa.string()), pa.array(score, pa.float64())], names=["page_id", "host", "path", "rule", "verdict", "odds"])

    return df.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, odds double")
