"""Mixing sources to target weights along a curriculum.

Each source gets a target number of words: a share by weight of ``total`` times
all words, stopping at ``repeats`` times what the source holds, with what it
cannot take reshared by weight among the others.  A source's weight varies over
the training time t in [0, 1] as target * (1 + ramp * (1 - 2 t)); its integral
up to t is the source's demand.  The source's documents, in the order of a hash
of their id and repeated as often as needed, meet that demand in turn, so the
training position of a document is the time at which the demand reaches its
first word: the inverse of the integral.  The mix is range-sorted by position.
The last document of a source is taken in part: its first words.

Running sums are two-level (per source and hash bucket, then over the buckets),
so no task holds a source.  Defined results: a null source is a source of its
own, the last; null or empty texts have size 0, and a document of size 0 takes
nothing and has no position; equal ids, and null ids, which hash alike, follow
by size; repeated rows count as documents of their own; an empty table gives an
empty one; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import written
from . import textarrays as T

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Sources of the largest weight come late, those of the smallest early.
RAMPS = (-0.5, 0.5, 0.0)
TOTAL, REPEATS = 1.5, 2


def _cycled(values, index: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(index) % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights=WEIGHTS, ramps=RAMPS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """source_key, source_size, target, ramp of every source, from rows of source_key, source, size.

    The windows run over one row a source.  Sources fill up in the order of
    what they can take for their weight; the level at which the first one is
    not full is the level of all that are not.
    """
    per = sizes.groupBy("source_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    named, whole = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    filling = Window.orderBy("full_at", "at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("at", F.row_number().over(named) - 1)
    per = per.withColumn("weight", _cycled(weights, "at")).withColumn("ramp", _cycled([float(r) for r in ramps], "at"))
    per = per.withColumn("most", F.col("source_size") * repeats).withColumn("full_at", F.col("most") / F.col("weight"))
    left = F.lit(float(total)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(filling), F.lit(0))
    per = per.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0))))
    level = F.min(F.when(F.col("full_at") >= F.col("level"), F.struct("full_at", "at", "level"))).over(whole)["level"]
    return per.select("source_key", "source_size", F.least(F.col("most").cast("double"), level * F.col("weight")).alias("target"), "ramp")


def sized(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), bucket_digits: int = 3) -> DataFrame:
    """Of every document: row (a struct of the columns ``keep``), id, source, source_key, size, place (a hash of its id) and bucket.

    A bucket is a range of places; the rows without an id, which have one place
    between them, are ranges of sizes, in which order they follow each other.
    """
    rows = documents.select(
        F.struct(*keep).alias("row"),
        F.col("doc_id").alias("id"),
        "source",
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"),
    )
    nameless = F.md5(F.lit(""))
    part = F.when(F.col("place") < nameless, "a").when(F.col("place") > nameless, "c").otherwise(F.concat(F.lit("b"), F.lpad(F.floor(F.col("size") / 16).cast("string"), 12, "0")))
    return rows.withColumn("bucket", F.concat(F.substring("place", 1, bucket_digits), part))


def plan(rows: DataFrame, **settings) -> DataFrame:
    """The rows of :func:`sized` with source_size, target, ramp and before (words of the source before the document)."""
    totals = rows.groupBy("source_key", "bucket").agg(F.min("source").alias("source"), F.sum("size").alias("size"))
    earlier = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    goals = targets(totals, **settings)
    starts = totals.select("source_key", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bucket_start")).join(goals, "source_key")
    inside = Window.partitionBy("source_key", "bucket").orderBy("place", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("through", F.sum("size").over(inside)).join(starts, ["source_key", "bucket"])
    return rows.withColumn("before", F.col("bucket_start") + F.col("through") - F.col("size")).select("row", "id", "size", "source_size", "target", "ramp", "before")


def goal() -> Column:
    return F.floor(F.col("target") + 0.5)


def taken(turn: int) -> Column:
    """Words that pass ``turn`` over the source takes of a document."""
    return F.least(F.greatest(goal() - turn * F.col("source_size") - F.col("before"), F.lit(0)), F.col("size"))


def position(turn: int | Column) -> Column:
    """The time at which the source's demand reaches the document's first word in pass ``turn``."""
    share, ramp = (F.col("before") + turn * F.col("source_size")) / F.col("target"), F.col("ramp")
    return 2 * share / ((1 + ramp) + F.sqrt(F.greatest((1 + ramp) * (1 + ramp) - 4 * ramp * share, F.lit(0.0))))


def mixing(documents: DataFrame, repeats: int = REPEATS, **settings) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, first_position (null if nothing is taken); sorted by position."""
    rows = plan(written(sized(documents), "sizes"), repeats=repeats, **settings)  # words are counted once
    words = taken(0)
    for turn in range(1, repeats):
        words = words + taken(turn)
    rows = rows.withColumn("taken", words.cast("long"))
    first = F.when(F.col("taken") > 0, F.round(position(0), 9))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", first.alias("first_position")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def mixed_documents(documents: DataFrame, repeats: int = REPEATS, **settings) -> DataFrame:
    """The mix itself, in training order: a row of the documents' columns for each pass that takes words of a document, the text cut after the last word taken."""
    columns = documents.columns
    rows = plan(sized(documents, tuple(columns)), repeats=repeats, **settings)
    turns = F.filter(F.array(*(F.struct(F.lit(k).alias("turn"), taken(k).cast("long").alias("words")) for k in range(repeats))), lambda t: t["words"] > 0)
    rows = rows.withColumn("turn", F.explode(turns)).withColumn("position", position(F.col("turn")["turn"])).withColumn("words", F.col("turn")["words"])
    rows = rows.orderBy("position", "id").select("row", "words", "size")
    schema = ", ".join(f"`{c}` {t}" for c, t in documents.dtypes)
    return rows.mapInArrow(lambda batches: _cut(batches, columns), schema)


def _cut(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Texts of which fewer words are taken than they have end with the last one taken; n_chars follows."""
    for batch in batches:
        row, words, size = (batch.column(batch.schema.get_field_index(c)) for c in ("row", "words", "size"))
        out = dict(zip(columns, row.flatten()))
        text = out["text"]
        partial = [i for i, (w, s) in enumerate(zip(words.to_pylist(), size.to_pylist())) if w < s]
        if partial:
            texts = text.to_pylist()
            for i in partial:
                buffer, offsets = T.flat(text.slice(i, 1))
                ends = T.words(buffer, offsets)[1]
                texts[i] = buffer[: ends[words[i].as_py() - 1]].tobytes().decode()
            out["text"] = pa.array(texts, text.type)
            if "n_chars" in out:
                lengths = out["n_chars"].to_pylist()
                for i in partial:
                    lengths[i] = len(texts[i])
                out["n_chars"] = pa.array(lengths, out["n_chars"].type)
        yield pa.RecordBatch.from_arrays(list(out.values()), list(out))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(nth % 3 + 1)::INT] AS weight, [-0.5, 0.5, 0.0][(nth % 3 + 1)::INT]::DOUBLE AS ramp,
         (2 * source_size)::DOUBLE AS most FROM per),
filling AS (
  SELECT *, most / weight AS full_at,
    (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
  FROM weighed
  WINDOW f AS (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, ramp,
    least(most, weight * (SELECT level FROM filling WHERE full_at >= level ORDER BY full_at, nth LIMIT 1)) AS target
  FROM filling),
placed AS (
  SELECT doc_id, size, source_size, target, ramp, floor(target + 0.5)::BIGINT AS goal,
    (sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (
  SELECT *, (least(greatest(goal - before, 0), size) + least(greatest(goal - source_size - before, 0), size))::BIGINT AS taken
  FROM placed)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(2 * (before / target) / ((1 + ramp) + sqrt(greatest((1 + ramp) * (1 + ramp) - 4 * ramp * (before / target), 0::DOUBLE))), 9) END AS first_position
FROM mixed
"""
