"""The operators' queries and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.llm.common import table


#: Public vocabulary for the token counts; the operator takes any path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.pii import digest, find

    return digest(find(table(spark, sf_dir, "documents")))


def op2_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op3_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.audio import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_chat_columnar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.chat import format_turns, read_back, with_probe

    return read_back(format_turns(with_probe(table(spark, sf_dir, "conversations"))))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.tokens import histogram, lengths, suffix_sums

    return suffix_sums(histogram(lengths(table(spark, sf_dir, "documents"), VOCABULARY)))


def op9_url_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.urls import judge

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkweave.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from inkweave.llm import chat, mixing

    return {"op7_chat_columnar": chat.ORACLE, "op10_mix_sources": mixing.ORACLE}
