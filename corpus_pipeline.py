"""From raw documents to a training mix, in five stages.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that the
one before it kept; between stages the rows are written as Parquet and read
again.  All but the last return the columns of ``documents``.

1. ``language``: documents without a language (no letters), or in which no
   language has ``LEAST_SHARE`` of the letters, go.
2. ``near_duplicates``: of each group of linked documents, the one with the
   smallest doc_id stays.
3. ``decontamination``: documents that hold a benchmark item go.
4. ``personal_data``: personal data is masked in the text; no row goes.
5. ``mix``: sources are taken up to their target weights, documents repeated as
   epochs need; adds ``mix_epoch`` and ``mix_words``.

Nulls: a null text has no letters and goes in the first stage; null ids, sources
and languages are kept as the operators describe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkweave.llm import decontaminate, language, mixing, pii, simhash
from inkweave.llm.common import stored, table

#: Share of letters that a document's language must have.
LEAST_SHARE = 0.4


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.with_language(docs, language.train(docs.where(~language.held_out())), LEAST_SHARE)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("mix", to_weights),
]

#: Language, SimHash and contextual stages can't be said in SQL; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
