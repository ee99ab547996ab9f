"""Multiple-point patterns: how often a category stands amid given neighbours in a training grid, and the distributions that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import written

INDEX = ("i", "j", "k")


def events(grid: DataFrame, category: str, template: list[tuple[int, int, int]]) -> DataFrame:
    """i, j, k, category and event (the categories at the template's offsets, in its order, null where the grid has none) of every node with a category.

    Every cell is sent to the nodes that it is a neighbour of, one shuffle for
    the whole template.
    """
    rows = grid.where(F.col(category).isNotNull()).select(*(F.col(c).cast("long").alias(c) for c in INDEX), F.col(category).alias("category"))
    offsets = F.array(*(F.struct(F.lit(m).alias("m"), *(F.lit(d).alias(f"d{c}") for c, d in zip(INDEX, o))) for m, o in enumerate([(0, 0, 0), *template])))
    sent = rows.withColumn("o", F.explode(offsets)).select(*((F.col(c) - F.col("o")[f"d{c}"]).alias(c) for c in INDEX), F.col("o.m").alias("m"), "category")
    seen = [F.min(F.when(F.col("m") == m, F.col("category"))) for m in range(len(template) + 1)]
    return sent.groupBy(*INDEX).agg(seen[0].alias("category"), F.array(*seen[1:]).alias("event")).where("category is not null")


def _prefixes(event):
    """The beginnings of an event, from the empty one to the last before its first null, as texts."""
    known = F.coalesce(F.array_position(F.transform(event, lambda c: F.when(c.isNull(), 1).otherwise(0)), 1) - 1, F.size(event))
    known = F.when(F.exists(event, lambda c: c.isNull()), known).otherwise(F.size(event)).cast("int")
    texts = F.transform(event, lambda c: c.cast("string"))
    return F.transform(F.sequence(F.lit(0), known), lambda n: F.struct(n.alias("length"), F.concat_ws(",", F.slice(texts, F.lit(1), n)).alias("prefix")))


def pattern_counts(grid: DataFrame, category: str, template: list[tuple[int, int, int]]) -> DataFrame:
    """length, prefix, category, n: in how many nodes the category stands amid the first ``length`` neighbours ``prefix``; counted in the tasks first."""
    rows = events(grid, category, template).select("category", F.explode(_prefixes(F.col("event"))).alias("p"))
    return rows.groupBy(F.col("p.length").alias("length"), F.col("p.prefix").alias("prefix"), "category").agg(F.count(F.lit(1)).alias("n"))


def conditional(asked: DataFrame, row_id: str, event: str, counts: DataFrame, categories: list, least: int = 3) -> DataFrame:
    """row_id, category, probability, length, replicates of every row and category: the longest beginning of the row's event that has ``least`` replicates decides.

    Where not even the empty beginning has as many, all categories are equally
    likely (length null).  Counts that the table lacks are 0.
    """
    per = counts.groupBy("length", "prefix").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("by")).where(F.col("total") >= least)
    per = written(per, "patterns")  # a row a pattern; categories are few
    rows = asked.select(row_id, F.explode(_prefixes(F.col(event))).alias("p")).select(row_id, F.col("p.length").alias("length"), F.col("p.prefix").alias("prefix"))
    # The empty beginning is every row's: it is one row, and no join key.
    empty = per.where("length = 0").agg(F.first(F.struct("total", "by")).alias("_all"))
    found = rows.where("length > 0").join(per, ["length", "prefix"]).groupBy(row_id).agg(F.max_by(F.struct("length", "total", "by"), "length").alias("_own"))
    out = asked.select(row_id).join(found, row_id, "left").crossJoin(F.broadcast(empty))
    total, by = F.coalesce(F.col("_own.total"), F.col("_all.total")), F.coalesce(F.col("_own.by"), F.col("_all.by"))
    length = F.coalesce(F.col("_own.length"), F.when(F.col("_all").isNotNull(), F.lit(0)))
    each = F.explode(F.array(*map(F.lit, categories)))
    out = out.select(row_id, total.alias("replicates"), by.alias("_by"), length.alias("length"), each.alias("category"))
    share = F.coalesce(F.try_element_at("_by", F.col("category")), F.lit(0)) / F.col("replicates")
    return out.select(row_id, "category", F.coalesce(share, F.lit(1.0 / len(categories))).alias("probability"), "length", F.coalesce("replicates", F.lit(0)).alias("replicates"))
