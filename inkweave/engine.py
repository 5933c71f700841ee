"""Conversion of a corpus: files in, one result row a document out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkweave.functions.text import data_uri, mime
from inkweave.operators import figures
from inkweave.operators.documents import documents
from inkweave.operators.sheets import workbooks
from inkweave.sources import answers
from inkweave.sources.packages import ANY_CASE, format_of, pictures, shred
from inkweave.sources.tables import stored

Client = Callable[[str, str, str], str]
NO_CONTENT = "no extractable content"
NO_DIAGRAMS = "diagram gate is 'none': chart diagrams left out, tables only"


@dataclass(frozen=True)
class Config:
    """Options of a conversion.

    ``gate``: which diagrams stay (``structural``, ``off`` for all, ``none``).
    ``use_vlm``: figures of word documents are interpreted (``interpret``), by
    ``model``; ``verify`` adds judges, one (``solo``) or two (``panel``);
    ``min_recall`` is the least share of a group's own words that its description
    must have.  Key material belongs in the client, never here.
    """

    strict: bool = False
    gate: str = "structural"
    use_vlm: bool = False
    verify: bool = False
    judge_mode: str = "panel"
    judge_model: str = "judge-a"
    judge_panel: tuple[str, str] = ("judge-a", "judge-b")
    model: str = "describer"
    min_recall: float = 0.80

    def __post_init__(self) -> None:
        if self.gate not in ("structural", "off", "none") or self.judge_mode not in ("solo", "panel") or len(self.judge_panel) != 2:
            raise ValueError("unknown gate or judge mode, or a panel that isn't two models")

    @property
    def judges(self) -> tuple[str, ...]:
        return () if not self.verify else (self.judge_model,) if self.judge_mode == "solo" else self.judge_panel


class Interpreted(NamedTuple):
    """Results with figures interpreted, the cache with all new answers, and ``id12, error`` of failed calls."""

    results: DataFrame
    cache: DataFrame
    failures: DataFrame


def files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Packages under a path as ``source_id, format, content``; other files aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", ANY_CASE).load(path)
    return df.select(F.col("path").alias("source_id"), format_of(F.col("path")).alias("format"), "content")


def in_memory(spark: SparkSession, items: list[tuple[str, str, bytes]]) -> DataFrame:
    """The same for ``(source_id, format, bytes)``."""
    return spark.createDataFrame(items, "source_id string, format string, content binary")


def convert_shredded(shredded: DataFrame, config: Config = Config()) -> DataFrame:
    """Result rows of shredded documents; unreadable ones keep their status and have no Markdown."""
    good = shredded.where("status = 'ok'")
    zero = F.lit(0).cast("int")
    books = workbooks(good.where("format = 'xlsx'"), config.gate).withColumn("groups_found", zero)
    texts = documents(good.where("format = 'docx'"), config.gate).select(*books.columns[:4], "has_content", "groups_found")
    made = books.unionByName(texts)
    rows = shredded.select("source_id", "format", "status", "error").join(made, "source_id", "left")
    ok = F.col("status") == "ok"
    warn = F.filter(F.array(F.when(~F.coalesce("has_content", F.lit(False)), NO_CONTENT), F.when((F.col("charts_found") > 0) & F.lit(config.gate == "none"), NO_DIAGRAMS)), lambda x: x.isNotNull())
    count = lambda c: F.when(ok, F.coalesce(c, zero)).alias(c)
    return rows.select(
        "source_id", "format", "status", "error", F.when(ok, F.coalesce("markdown", F.lit("\n"))).alias("markdown"), F.when(ok, warn).otherwise(F.array().cast("array<string>")).alias("warnings"),
        count("charts_found"), count("charts_rendered"), count("groups_found"), F.lit(False).alias("vlm_used"),
    )


def interpret(results: DataFrame, source: DataFrame, client: Client | None, config: Config = Config(use_vlm=True), cache: DataFrame | None = None, group_images: DataFrame | None = None) -> Interpreted:
    """Puts a model's descriptions in the place of the figure markers of word documents.

    ``client(prompt, uri, model)`` runs on the executors, once for each figure
    that ``cache`` (``id12, model, markdown, judge_verdict``) lacks; without a
    client only the cache speaks.  Raster images come from the packages in
    ``source``; images of groups, which need a renderer, from ``group_images``
    (``id12, uri``).  A figure without image or answer keeps its marker.
    """
    spark, results = results.sparkSession, stored(results, "results")
    docs = results.where("format = 'docx' and status = 'ok'").select("source_id", "markdown")
    found = figures.markers(docs, "source_id")
    kind = mime(F.col("part"))
    images = pictures(source).join(found.where("kind = 'image'").select("id12").distinct(), "id12", "left_semi").where(kind.isNotNull()).select("id12", data_uri(kind, F.col("content")).alias("uri"))
    if group_images is not None:
        images = images.unionByName(group_images.select("id12", "uri"))
    known = cache if cache is not None else spark.createDataFrame([], answers.KIND)
    fresh, failed = figures.refreshed(found, images, known, client, config.model, config.judges)
    fresh = stored(fresh, "cache")
    told = figures.inject(docs, fresh, "source_id", gate=config.gate, least=config.min_recall, verify=config.verify)
    told = told.select(F.col("source_id").alias("_s"), F.col("markdown").alias("_m"), F.col("vlm_used").alias("_u"), F.col("vlm_warnings").alias("_w"))
    rows = results.join(told, F.col("source_id") == F.col("_s"), "left")
    new = {"markdown": F.coalesce("_m", "markdown"), "vlm_used": F.coalesce("_u", F.lit(False)), "warnings": F.concat("warnings", F.coalesce("_w", F.array().cast("array<string>")))}
    return Interpreted(rows.select(*(new[c].alias(c) if c in new else F.col(c) for c in results.columns)), fresh, failed)


def convert(source: DataFrame, config: Config = Config(), client: Client | None = None, cache: DataFrame | None = None, group_images: DataFrame | None = None) -> DataFrame:
    """Rows of ``source_id, format, content`` to result rows.

    The shredded rows are written to the shared folder first, as charts, sheets
    and texts each read some of their columns; ``source_id`` must be unique.
    With ``use_vlm`` figures are interpreted (see ``interpret``, which also gives
    the new cache and the failures).
    """
    results = convert_shredded(stored(shred(source), "shredded"), config)
    if not config.use_vlm:
        return results
    if client is None and cache is None:
        raise ValueError("use_vlm needs a client or a cache")
    return interpret(results, source, client, config, cache, group_images).results


def totals(results: DataFrame) -> DataFrame:
    """Documents, failures, charts and groups by format and in all."""
    return results.rollup("format").agg(F.count("*").alias("documents"), F.count_if(F.col("status") != "ok").alias("failed"), F.sum("charts_found").alias("charts_found"), F.sum("charts_rendered").alias("charts_rendered"), F.sum("groups_found").alias("groups_found"))
