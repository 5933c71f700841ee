"""Cached model answers as a table: ``id12, model, markdown, judge_verdict``.

A folder holds numbered versions; a version counts once it is complete, so a
reader never sees half of one, and a broken folder is an empty cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KIND = "id12 string, model string, markdown string, judge_verdict array<string>"


def _versions(spark: SparkSession, path: str) -> tuple[object, list[int]]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return fs, []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    whole = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return fs, sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and whole(n))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version; empty if there is none or its files can't be read."""
    _, known = _versions(spark, path)
    if known:
        try:
            got = spark.read.parquet(f"{path}/v={known[-1]}")
            return got.select(*(f.split()[0] for f in KIND.split(", ")))
        except Exception:  # noqa: BLE001 - a cache may be lost, never a conversion
            pass
    return spark.createDataFrame([], KIND)


def write(cache: DataFrame, path: str, keep: int = 2) -> None:
    """A new version; all but the last ``keep`` go."""
    spark = cache.sparkSession
    fs, known = _versions(spark, path)
    cache.select(*(f.split()[0] for f in KIND.split(", "))).write.mode("overwrite").parquet(f"{path}/v={(known[-1] if known else 0) + 1}")
    for n in known[: len(known) + 1 - keep]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={n}"), True)
