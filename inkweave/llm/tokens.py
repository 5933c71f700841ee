"""Token counts by an exact length histogram (operator 8).

Every whole text is encoded with a public byte-level BPE vocabulary (its path is
a parameter; the file must be readable at that path on every worker).
Documents are aggregated by encoded length; all further questions are answered
from this histogram, whose size is the number of distinct lengths.  Suffix sums
over it give, for every context limit, how many documents and tokens reach it
and the total left after truncation.  They are computed in chunks of
``CHUNK`` lengths: sums per chunk, suffix sums over the chunks, then within each.
The histogram is written out first, so the corpus is encoded once; limits and
quantiles are asked of all its rows in one aggregation.

Nulls and edge cases: a null or empty text has length 0; control strings in a
text are ordinary text; repeated rows count each; other columns are ignored; an
empty table gives an empty histogram.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import arrow_map, stored

CHUNK = 1024
#: Splitting of text before merging, as the vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encodings: dict = {}


def encoding(path: str):
    """The encoding of a file of base64 tokens and ranks; kept by the worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def lengths(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every text."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoding(path).encode_ordinary
        n = np.fromiter((len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
        return pa.record_batch([batch.column("doc_id"), pa.array(n)], names=["doc_id", "n_tokens"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), kernel, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """``length, n_docs`` from ``n_tokens``."""
    return counted.groupBy(F.col("n_tokens").alias("length")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per length: documents and tokens of at least this length, all tokens, tokens left if texts are cut at this length, and the share of documents no longer than it."""
    h = stored(hist, "histogram").withColumn("chunk", F.expr(f"length div {chunk}")).withColumn("tokens", F.col("length") * F.col("n_docs"))
    chunks = h.groupBy("chunk").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    chunks = chunks.select("chunk", F.coalesce(F.sum("d").over(after), zero).alias("docs_after"), F.coalesce(F.sum("t").over(after), zero).alias("tokens_after"), F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("total_tokens"))
    here = Window.partitionBy("chunk").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("docs_here", F.sum("n_docs").over(here)).withColumn("tokens_here", F.sum("tokens").over(here)).join(chunks, "chunk")
    docs_from, tokens_from = F.col("docs_here") + F.col("docs_after"), F.col("tokens_here") + F.col("tokens_after")
    return h.select(
        "length",
        "n_docs",
        docs_from.alias("docs_from"),
        tokens_from.alias("tokens_from"),
        "total_tokens",
        (F.col("total_tokens") - tokens_from + docs_from * F.col("length")).alias("truncated_total"),
        ((F.col("docs") - docs_from + F.col("n_docs")) / F.col("docs")).alias("share_up_to"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, docs_over, truncated_total`` for any limits, from the suffix sums of the next longer length."""
    over = [F.min_by(F.struct("docs_from", "tokens_from"), F.when(F.col("length") > x, F.col("length"))).alias(f"_{k}") for k, x in enumerate(limits)]
    got = sums.agg(F.coalesce(F.max("total_tokens"), F.lit(0)).alias("total_tokens"), *over)
    each = F.array(*(F.struct(F.lit(int(x)).cast("long").alias("limit"), F.col(f"_{k}").alias("s")) for k, x in enumerate(limits)))
    got = got.select("total_tokens", F.explode(each).alias("e")).select("total_tokens", "e.limit", "e.s")
    docs, tokens = F.coalesce("s.docs_from", F.lit(0)), F.coalesce("s.tokens_from", F.lit(0))
    return got.select("limit", docs.alias("docs_over"), (F.col("total_tokens") - tokens + docs * F.col("limit")).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """``share, length``: the least length that this share of documents doesn't exceed (null without documents)."""
    least = [F.min(F.when(F.col("share_up_to") >= x, F.col("length"))).alias(f"_{k}") for k, x in enumerate(shares)]
    each = F.array(*(F.struct(F.lit(float(x)).alias("share"), F.col(f"_{k}").alias("length")) for k, x in enumerate(shares)))
    return sums.agg(*least).select(F.explode(each).alias("e")).select("e.share", "e.length")
