"""Sharding by fixed virtual slots and a versioned map from slots to shards.

Records are hashed into thousands of slots, whose number never changes.  Bytes
are added up a slot; the map says which shard a slot belongs to and is the only
thing that is edited when shards are added or sizes drift: every shard keeps its
largest slots up to an equal share of all bytes, and the slots beyond go, largest
first, each to the shard that holds least.  A version of the map is a table of a
row a slot, written beside the earlier ones; no record changes its slot.

Equal rows are counted, not repeated, until they have been dealt to slots in
blocks of ``BLOCK`` copies, so that a row that makes up a third of the table is
spread like any other; everything here is DataFrame functions, and only tables of
a row a slot (:data:`SLOTS` at most) are broadcast.

Defined results: a null text has no bytes and the checksum of an empty one; null
and repeated ids are allowed, each row is placed; equal rows are interchangeable;
texts of any length count with all their bytes, and one larger than an equal
share has a shard almost to itself; an empty table gives an empty one; further
columns are not read by :func:`placed` and kept by :func:`sharded`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stored import written
from .common import crc32_sql

SLOTS, SHARDS, OVERHEAD, BLOCK = 8192, 40, 16, 64


def text_size(text: str = "text", overhead: int = OVERHEAD) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + overhead


def text_crc(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def slot_of(doc_id: Column, crc: Column, block: Column, slots: int = SLOTS) -> Column:
    """The slot of a record: 32 bits of the md5 of its id, its text's checksum and its block of copies."""
    name = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), crc.cast("string"), block.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def records(documents: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and copies of all rows; equal ones in blocks of at most BLOCK copies."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_size().alias("size"), text_crc().alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))))
    copies = F.least(F.lit(BLOCK).cast("long"), F.col("n") - F.col("block") * BLOCK)
    return rows.select("doc_id", "size", "text_crc32", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("block"), slots).alias("virtual_slot"), copies.alias("copies"))


def loads(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: a row for each slot that holds something."""
    return rows.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows"))


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1: the slots dealt to the shards in turn, before any sizes are known."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(mapping: DataFrame, sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of a map for ``shards`` shards (as many as before, or more) and the slots' bytes as they are now.

    All windows, and the one array that the released slots are dealt from, run
    over a row a slot.
    """
    rows = mapping.join(F.broadcast(sizes.select("virtual_slot", "bytes")), "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    share = F.floor(F.sum("bytes").over(Window.partitionBy()) / shards)
    largest = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    through = F.sum("bytes").over(largest.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"share": share, "through": through, "turn": F.row_number().over(largest)})
    rows = rows.withColumn("goes", (F.col("bytes") > 0) & (F.col("through") > F.col("share")) & (F.col("turn") > 1))
    kept = rows.where("not goes").groupBy("shard").agg(F.sum("bytes").alias("held"))
    start = F.array_sort(F.collect_list(F.struct("shard", "held")))
    # The shards' loads in order of their number; new shards, and those that hold nothing, start at 0.
    start = kept.agg(start.alias("held")).select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.try_element_at(F.filter("held", lambda h: h["shard"] == s), F.lit(1))["held"], F.lit(0).cast("long"))).alias("held"))
    released = rows.where("goes").agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "virtual_slot"))).alias("released"))

    def give(state: Column, slot: Column) -> Column:
        to = F.array_position(state["held"], F.array_min(state["held"])).cast("int") - 1
        held = F.transform(state["held"], lambda h, i: F.when(i == to, h - slot["less"]).otherwise(h))
        return F.struct(held.alias("held"), F.concat(state["given"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("to")))).alias("given"))

    empty = F.array().cast("array<struct<virtual_slot:int,to:int>>")
    given = start.crossJoin(F.broadcast(released)).select(F.explode(F.aggregate("released", F.struct(F.col("held").alias("held"), empty.alias("given")), give)["given"]).alias("g")).select("g.*")
    return rows.join(F.broadcast(given), "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("to", "shard").alias("shard"))


def store_map(mapping: DataFrame, path: str) -> None:
    """Write a version beside the earlier ones."""
    mapping.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map; the last one, if none is named."""
    versions = spark.read.parquet(path)
    wanted = F.lit(version) if version else versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == wanted).select("version", "virtual_slot", "shard")


def sharded(documents: DataFrame, mapping: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The documents with all their columns, _virtual_slot and _shard; equal rows meet in one slot here."""
    slot = slot_of(F.col("doc_id"), text_crc(), F.lit(0), slots)
    return documents.withColumn("_virtual_slot", slot).join(F.broadcast(mapping.select(F.col("virtual_slot").alias("_virtual_slot"), F.col("shard").alias("_shard"))), "_virtual_slot")


def write_shards(documents: DataFrame, mapping: DataFrame, path: str, slots: int = SLOTS) -> None:
    """Parquet folders _shard=0, 1, ...; each written by as many tasks as it has slots, no task waiting for a whole shard."""
    sharded(documents, mapping, slots).repartition("_virtual_slot").write.partitionBy("_shard").parquet(path)


def placed(documents: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot (its place in the shard, from 0), grown_shard, virtual_slot, map_version."""
    spark = documents.sparkSession
    rows = written(records(documents, slots), "records")
    sizes = written(loads(rows), "slot_loads")
    mapping = rebalanced(first_map(spark, slots, shards), sizes, shards)
    # Places: those of the slots before in the shard (a row a slot), then those before in the slot.
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = mapping.join(F.broadcast(sizes), "virtual_slot").withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("long"))).select("version", "virtual_slot", "shard", "base")
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "copies").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(written(bases, "slot_map")), "virtual_slot").withColumn("first", F.col("base") + F.coalesce(F.sum("copies").over(inside), F.lit(0).cast("long")))
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + {OVERHEAD} AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1) // {BLOCK} AS block FROM sized),
hashed AS (
  SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || block), 1, 8))::BIGINT % {SLOTS})::INT AS virtual_slot FROM numbered),
loads AS (
  SELECT virtual_slot, virtual_slot % {SHARDS} AS shard, sum(size)::BIGINT AS bytes, count(*) AS n FROM hashed GROUP BY virtual_slot),
judged AS (
  SELECT *, sum(bytes) OVER w AS through, row_number() OVER w AS turn, sum(bytes) OVER () // {SHARDS} AS share
  FROM loads WINDOW w AS (PARTITION BY shard ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT * FROM judged WHERE through <= share OR turn = 1),
released AS (
  SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS turn
  FROM judged WHERE NOT (through <= share OR turn = 1)),
start AS (
  SELECT list(coalesce(held, 0)::BIGINT ORDER BY s) AS held
  FROM range({SHARDS}) t(s) LEFT JOIN (SELECT shard, sum(bytes) AS held FROM kept GROUP BY shard) ON shard = s),
dealt AS (
  SELECT 0::BIGINT AS turn, NULL::INT AS virtual_slot, held, list_position(held, list_min(held)) AS open FROM start
  UNION ALL
  SELECT turn, virtual_slot, held, list_position(held, list_min(held)) FROM (
    SELECT r.turn, r.virtual_slot, list_transform(d.held, lambda h, i: CASE WHEN i = d.open THEN h + r.bytes ELSE h END) AS held
    FROM dealt d JOIN released r ON r.turn = d.turn + 1)),
mapping AS (
  SELECT virtual_slot, shard FROM kept
  UNION ALL SELECT r.virtual_slot, (d.open - 1)::INT FROM released r JOIN dealt d ON d.turn = r.turn - 1)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  NULL::INT AS grown_shard, virtual_slot, 2 AS map_version
FROM hashed JOIN mapping USING (virtual_slot)
"""
