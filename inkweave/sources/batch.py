"""What a batch reads and where it writes, planned before anything is converted."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFIXES = {f".{kind}": kind for kind in ("xlsx", "docx")}


def walk(sources: list[Path]) -> list[tuple[str, str]]:
    """(absolute path, path relative to its source) of all packages below the sources, sorted within each; links aren't followed, a file counts once."""
    out: dict[str, str] = {}
    for source in sources:
        if source.is_dir():
            entries = [(Path(at, f), Path(at, f).relative_to(source)) for at, _, names in os.walk(source) for f in names]
            entries = sorted(e for e in entries if not e[0].is_symlink() and e[0].is_file())
        else:
            entries = [(source, Path(source.name))]
        for path, rel in entries:
            if path.suffix.lower() in SUFFIXES:
                out.setdefault(str(path.resolve()), str(rel))
    return list(out.items())


def output_name(rel: Column, suffix: str = ".md") -> Column:
    """The path with its last extension replaced."""
    return F.concat(F.regexp_replace(rel, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def plan(listing: DataFrame, path: str = "path", order: str = "ord") -> DataFrame:
    """Rows of a listing whose extension is known, each path at its first place; the order is kept in ``order``."""
    known = listing.where(F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1)).isin(*SUFFIXES))
    return known.withColumn("_n", F.row_number().over(Window.partitionBy(path).orderBy(order))).where("_n = 1").drop("_n")


def collisions(planned: DataFrame, rel: str, suffix: str = ".md") -> DataFrame:
    """``output, inputs`` of outputs that several inputs would write, inputs in order."""
    return planned.groupBy(output_name(F.col(rel), suffix).alias("output")).agg(F.array_sort(F.collect_list(rel)).alias("inputs")).where(F.size("inputs") > 1)
