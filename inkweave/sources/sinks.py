"""Results as files, one a document, written where the rows are."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("markdown", "charts_found", "charts_rendered", "warnings", "vlm_used", "groups_found")


def as_json(*fields: str) -> Column:
    """A whole result as JSON text."""
    return F.to_json(F.struct(*(fields or FIELDS)), {"ignoreNullFields": "false"})


def write_each(results: DataFrame, folder: str, json: bool = False) -> DataFrame:
    """Writes every readable document's Markdown (or JSON) under ``folder``, by its ``source_id`` with another suffix.

    ``folder`` must be shared by all executors.  A task that runs again writes
    the same files again.  Gives ``source_id, status, error, warnings, path``; to
    run it is to write.
    """
    suffix = ".json" if json else ".md"
    rows = results.select("source_id", "status", "error", "warnings", F.when(F.col("status") == "ok", as_json() if json else F.col("markdown")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths = []
            for source, text in zip(batch.column("source_id").to_pylist(), batch.column("text").to_pylist()):
                if text is None:
                    paths.append(None)
                    continue
                name = posixpath.normpath("/" + source).lstrip("/")
                path = posixpath.join(root, posixpath.splitext(name)[0] + suffix)
                system.create_dir(posixpath.dirname(path), recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(text.encode())
                paths.append(path)
            yield pa.record_batch([*(batch.column(c) for c in ("source_id", "status", "error", "warnings")), pa.array(paths, pa.string())], names=["source_id", "status", "error", "warnings", "path"])

    return rows.mapInArrow(run, "source_id string, status string, error string, warnings array<string>, path string")
