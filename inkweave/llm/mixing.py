"""Mixing sources to target weights (operator 10).

Sizes are words.  Sources in code-point order (null last) weigh 1, 2, 3,
repeating; they share the sum of all sizes by weight, no source getting more
than ``MOST`` times its own size; what is over goes to the others by weight.

Within a source, documents are put in the order of a random key, the md5 of
seed and doc_id.  The key's first digits are ranges of that order, as many as
make a range hold ``RANGE_ROWS`` rows, so no source, however large, is sorted
or summed in one task: sums per range give each range's offset, and a window
within the range gives the distributed prefix sums.  A source is taken whole as
many times as its budget holds (epochs), and then up to exactly the budget: the
document at the cut gives its first words only.  Only the table of sources (one
row each) and, per source, that of its ranges are ordered in one task; they
spill, and hold no documents.

Nulls and edge cases: a null or blank text has size 0 and takes 0; a null
source is a source of its own, the last; rows with equal keys (repeated doc_id,
or null) are ordered by size and are interchangeable beyond that; sources of
size 0 have target 0; an empty table gives an empty result.  Other columns stay
out of the way: the operator adds its own under names the caller may choose by
``prefix``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import arrow_map, stored, whole, words

MOST = 3
CYCLE = 3
SEED = "mix-1:"
RANGE_ROWS = 20_000


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``source``, ``size`` in words and ``mark``, a hash of the text that tells rows of one id apart."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(words(batch.column("text")).n), batch.column("mark")], names=["doc_id", "source", "size", "mark"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    return arrow_map(picked, kernel, "doc_id long, source string, size long, mark long")


def targets(totals: DataFrame) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: min(MOST * size, level * weight), the level chosen so that targets sum to all sizes.

    ``totals`` has a row for each source.  Sources are ranked by the level at
    which they fill up; the first rank whose level, with all before it full,
    stays below its own is where filling stops.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("weight", ((F.row_number().over(order) - 1) % CYCLE + 1).cast("long"))
    full = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(every) - MOST * F.coalesce(F.sum("source_size").over(full), F.lit(0))).cast("double") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0)))
    ranked = ranked.withColumn("at", level)
    ranked = ranked.withColumn("level", F.min(F.when(F.col("at") * 1.0 <= MOST * F.col("source_size") / F.col("weight"), F.struct(F.col("source_size") / F.col("weight"), "at"))).over(every)["at"])
    return ranked.select("source", "source_size", F.least(F.lit(float(MOST)) * F.col("source_size"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``mark``."""
    return spread(stored(sizes(docs, id_col, source_col, text_col).withColumn("key", F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))), "sizes"), range_rows)


def spread(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``mix`` for rows whose sizes and keys are known."""
    n = rows.count()
    digits = 0
    while n > range_rows * 16**digits:
        digits += 1
    rows = rows.withColumn("part", F.substring("key", 1, digits) if digits else F.lit(""))
    parts = stored(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts")
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    same = F.col("p.source").eqNullSafe(F.col("g.source"))
    offsets = offsets.alias("p").join(goal.alias("g"), same).select("p.source", "p.part", "p.offset", "g.source_size", "g.target")
    local = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("local", F.coalesce(F.sum("size").over(local), F.lit(0)))
    rows = rows.alias("r").join(offsets.alias("o"), F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.part") == F.col("o.part"))).select("r.doc_id", "r.source", "r.size", "r.mark", "r.local", "o.offset", "o.source_size", "o.target")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("local")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "mark")


def mixed(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix itself: rows of ``docs`` that are taken, with ``size``, ``taken`` and one row per epoch (``epoch``); at the cut, the text's first words only.

    A text that is cut has single spaces between its words.  Repeated rows (equal
    doc_id, source and text) take what ``mix`` gives them together: each its
    epochs, and the rest in turn.  Only where the cut falls among them are they
    numbered, in one task for each such document.
    """
    plan = mix(docs, range_rows=range_rows).groupBy("doc_id", "source", "mark").agg(F.max("size").alias("size"), F.count("*").alias("n"), F.min("taken").alias("low"), F.max("taken").alias("high"), F.sum("taken").alias("sum")).where("sum > 0")
    row = docs.select(whole(docs), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("from"), F.xxhash64("text").alias("text_mark"))
    found = row.join(plan, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("from").eqNullSafe(F.col("source")) & (F.col("text_mark") == F.col("mark")))
    found = found.withColumn("epochs", F.expr("low div size * size"))
    turn = Window.partitionBy("doc_id", "source", "mark").orderBy("mark")
    rest = F.col("sum") - F.col("n") * F.col("epochs") - (F.row_number().over(turn) - 1) * F.col("size")
    apart = found.where("low <> high").withColumn("taken", F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    found = found.where("low = high").withColumn("taken", F.col("low")).unionByName(apart).where("taken > 0")
    found = found.select("row", "size", "taken", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))")).alias("epoch"))
    words_now = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size"))
    found = found.withColumn("n", words_now)
    text = F.when(F.col("n") == F.col("size"), F.col("row.text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(r"([^\x20\x09-\x0D]+)")), F.lit(1), F.col("n").cast("int")), " "))
    return found.select(*(text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns), F.col("epoch").alias("mix_epoch"), F.col("n").alias("mix_words"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         ((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % {CYCLE} + 1 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, (sum(source_size) OVER () - {MOST} * coalesce(sum(source_size) OVER f, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS lvl
  FROM s WINDOW f AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lvl, source_size / weight) AS level FROM r WHERE lvl <= {MOST} * source_size / weight),
t AS (SELECT source, source_size, least({MOST}.0::DOUBLE * source_size, level * weight) AS target FROM s, l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + greatest(0, least(size, budget % source_size - before)) ELSE 0 END)::BIGINT AS taken
FROM p
"""
