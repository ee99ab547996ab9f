"""What the classifiers share: label folds and label samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(column: str = "doc_id", parts: int = 5):
    """crc32 of the id as text, modulo ``parts``; 0 for a null id, so that such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(0))


def label_ids(labels: DataFrame, label: str, parts: int = 5) -> DataFrame:
    """(doc_id, label, turn) of all labelled ids outside fold 0; null labels are unlabelled, an id with both labels counts as 0, ``turn`` is a hash of the id."""
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", parts) != 0))
    return ids.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("turn", F.xxhash64(F.col("doc_id").cast("long")))


def labelled(documents: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 5) -> DataFrame:
    """(doc_id, text, label, turn) of a bounded sample of labelled rows outside fold 0.

    At most ``per_class`` ids of each class, those with the smallest hash of
    their id; null labels are unlabelled, an id with both labels counts as 0.
    The sample of ids is broadcast; its size is bounded by ``per_class``.
    ``turn`` numbers the ids of a class in the order of that hash.  Of rows that
    share an id the one of the smallest text hash counts, one without a text last,
    so the rows are as many as the ids.
    """
    ids = label_ids(labels, label, parts)
    sample = None
    for y in (0, 1):
        part = ids.where(F.col("label") == y).orderBy("turn", "doc_id").limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = F.min_by("text", F.struct(F.isnull("text"), F.xxhash64("text")))
    return rows.groupBy("doc_id", "label", "turn").agg(one.alias("text")).select("doc_id", "text", "label", "turn")


def crc32_table() -> list[int]:
    """The 256 steps of the reflected polynomial 0xEDB88320."""
    table = list(range(256))
    for _ in range(8):
        table = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of the UTF-8 bytes of a text."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = f"xor(c >> 8, ({crc32_table()})[(xor(c, b) & 255) + 1])"
    return f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: {step}))::BIGINT"
