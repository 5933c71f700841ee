from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkweave.operators import recall
from inkweave.plans import catalogue
from tests.conftest import same_as_duckdb


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_duckdb(spark, sf_dir, name):
    same_as_duckdb(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name], sf_dir)


def test_queries_without_sql_give_rows(spark, sf_dir):
    for name in catalogue.queries().keys() - catalogue.oracle_sql().keys():
        assert catalogue.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert {"chart_id", "markdown"} == set(entry.queries()["chart_xychart"](spark, "/root/testdata/sf0.001").columns)
    assert set(catalogue.queries()) <= set(entry.queries())


def with_table(sf_dir, folder, name, df):
    """The tables of ``sf_dir`` with another one in place of ``name``."""
    for path in Path(sf_dir).iterdir():
        if path.name != f"{name}.parquet":
            (folder / path.name).symlink_to(path)
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_number_text_of_balances_near_zero(spark, sf_dir, tmp_path):
    values = [-0.51, -0.5, -0.49, -0.01, -0.0, 0.0, 0.01, 0.49, 0.5, 1.5, 2.5, -2.5, 123456.5, 0.49999999999999994, None]
    df = spark.createDataFrame([(3 * i + k, v) for i, v in enumerate(values) for k in range(3)], "c_custkey long, c_acctbal double")
    folder = with_table(sf_dir, tmp_path, "customer", df)
    same_as_duckdb(catalogue.queries()["number_text"](spark, folder), catalogue.oracle_sql()["number_text"], folder)


@pytest.mark.parametrize(("at_once", "item_bytes"), [(1 << 20, 4 << 20), (5, 60)])
def test_token_recall_of_odd_rows(spark, sf_dir, tmp_path, monkeypatch, at_once, item_bytes):
    """Nulls, texts without words, equal shares, repeated ids; in groups and blocks of any size."""
    monkeypatch.setattr(recall, "AT_ONCE", at_once)
    monkeypatch.setattr(recall, "ITEM_BYTES", item_bytes)
    docs = [(1, "alpha Beta beta gamma"), (2, None), (3, ""), (4, "12 --"), (5, "Ümlaut ÜMLAUT ⅷ ²"), (6, "omega"), (6, "alpha beta"), (None, "delta epsilon"), (None, "zeta"), (7, "nothing of it"), (-8, "BETA gamma delta")]
    items = [(10, "alpha beta"), (3, "Alpha, gamma"), (-2, "gamma delta epsilon"), (5, "ümlaut ⅷ ² x"), (12, "alpha beta"), (9, None), (None, "omega omega"), (4, "zeta eta theta iota")]
    one = tmp_path / "a"
    one.mkdir()
    folder = with_table(sf_dir, one, "documents", spark.createDataFrame(docs, "doc_id long, text string"))
    for extra in ([], [(20, "1 2"), (21, "")]):  # all documents have the words of an item without any
        other = tmp_path / f"b{len(extra)}"
        other.mkdir()
        again = with_table(folder, other, "benchmark", spark.createDataFrame(items + extra, "item_id long, text string"))
        same_as_duckdb(catalogue.queries()["token_recall"](spark, again), catalogue.oracle_sql()["token_recall"], again)


def test_token_recall_without_items(spark, sf_dir, tmp_path):
    folder = with_table(sf_dir, tmp_path, "benchmark", spark.createDataFrame([], "item_id long, text string"))
    same_as_duckdb(catalogue.queries()["token_recall"](spark, folder), catalogue.oracle_sql()["token_recall"], folder)


def test_token_recall_reads_documents_once(spark, sf_dir, tmp_path):
    items = spark.range(3_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", F.lit("the de"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"))
    folder = with_table(sf_dir, tmp_path, "benchmark", items)
    df = catalogue.queries()["token_recall"](spark, folder)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [doc_id") == 1
    same_as_duckdb(df, catalogue.oracle_sql()["token_recall"], folder)
