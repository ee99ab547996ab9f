"""Running sums, ranks and quantiles over whole tables, in two levels: ranges of the order, then rows in a range.

No task holds more than a range, and a hot value is spread by the tie-breaking
keys.  The ranged rows are written once, so both levels see the same ranges even
if tasks are run again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stored import shards, written


def running(df: DataFrame, order: list, amount: Column | str, name: str = "before") -> DataFrame:
    """The rows with ``name``, the sum of ``amount`` over the rows that come earlier in the order; equal rows follow each other in any order."""
    n = max(2, shards(df.sparkSession))
    rows = df.withColumn("_rs_amount", amount if isinstance(amount, Column) else F.col(amount))
    rows = written(rows.repartitionByRange(n, *order).withColumn("_rs_range", F.spark_partition_id()), "ranges")
    totals = rows.groupBy("_rs_range").agg(F.sum("_rs_amount").alias("_rs_total"))  # a row a range
    totals = totals.withColumn("_rs_base", F.sum("_rs_total").over(Window.orderBy("_rs_range")) - F.col("_rs_total")).drop("_rs_total")
    inside = Window.partitionBy("_rs_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_rs_through", F.sum("_rs_amount").over(inside)).join(F.broadcast(totals), "_rs_range")
    return rows.withColumn(name, F.col("_rs_base") + F.col("_rs_through") - F.col("_rs_amount")).drop("_rs_amount", "_rs_range", "_rs_through", "_rs_base")


def ranked(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """The rows numbered from 1 in the order."""
    return running(df, order, F.lit(1).cast("long"), "_before").withColumn(name, F.col("_before") + 1).drop("_before")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None, parts: int = 64) -> DataFrame:
    """Linear quantiles of every group: a column for each name and share.

    Approximate quantiles cut a group's values into ranges; their counts tell
    in which ranges the wanted ranks lie, and only the values of those ranges
    are sorted.  Groups without a value are left out.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    edges = rows.groupBy(*by).agg(F.percentile_approx("_v", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(2000)).alias("_edges"), F.count(F.lit(1)).alias("_n"))
    join = (lambda a, b: a.join(b, reduce_equal(by, "_k_"), "inner").drop(*(f"_k_{c}" for c in by))) if by else (lambda a, b: a.crossJoin(F.broadcast(b)))
    keyed = lambda d: d.withColumnsRenamed({c: f"_k_{c}" for c in by})
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))  # equal values are one row from here on
    placed = join(counts, keyed(edges)).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    sizes = placed.groupBy(*by, "_part").agg(F.sum("_c").alias("_size"))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_size").over(upto), F.lit(0))).withColumnRenamed("_part", "_k_part")
    on = [placed["_part"] == F.col("_k_part"), *(placed[c].eqNullSafe(F.col(f"_k_{c}")) for c in by)]
    placed = placed.join(keyed(sizes), on).drop("_k_part", "_size", *(f"_k_{c}" for c in by))
    inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("_to", F.col("_base") + F.sum("_c").over(inside))
    at = lambda s: F.lit(float(s)) * (F.col("_n") - 1)

    def held(rank: Column) -> Column:
        return F.max(F.when((rank < F.col("_to")) & (rank >= F.col("_to") - F.col("_c")), F.col("_v")))

    found = placed.groupBy(*by).agg(F.max("_n").alias("_n"), *(held(f(at(s))).alias(f"_{k}_{n}") for k, s in shares.items() for n, f in (("lo", F.floor), ("hi", F.ceil))))
    share = lambda s: at(s) - F.floor(at(s))
    return found.select(*by, *((F.col(f"_{k}_lo") + share(s) * (F.col(f"_{k}_hi") - F.col(f"_{k}_lo"))).alias(k) for k, s in shares.items()))


def reduce_equal(columns: list[str], prefix: str) -> list[Column]:
    """Conditions of a join on columns that may be null, whose right side has a prefix."""
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in columns]


def around(rows: DataFrame, knots: DataFrame, at: str) -> DataFrame:
    """The rows with _a and _b: the last knot at or before ``at`` and the first one at or after it (structs of the knots' columns, null beyond the ends).

    Rows and knots are ranged together; the last knot of the ranges before and
    the first of those after come from a row a range.
    """
    n = max(2, shards(rows.sparkSession))
    kind = knots.schema.simpleString()
    own = rows.select(F.col(at).cast("double").alias("_at"), F.lit(None).cast(kind).alias("_knot"), F.struct(*rows.columns).alias("_row"))
    all_ = own.unionByName(knots.select(F.col(at).cast("double").alias("_at"), F.struct(*knots.columns).cast(kind).alias("_knot"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row")))
    both = written(all_.repartitionByRange(n, "_at").withColumn("_range", F.spark_partition_id()), "around")
    # Equal places are in one range: knots first where knots before are looked for, and last where knots after are.
    before = Window.partitionBy("_range").orderBy("_at", F.col("_knot").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_range").orderBy(F.desc("_at"), F.col("_knot").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"_a": F.last("_knot", True).over(before), "_b": F.last("_knot", True).over(after)})
    ends = both.groupBy("_range").agg(F.max_by("_knot", F.when(F.col("_knot").isNotNull(), F.col("_at"))).alias("_last"), F.min_by("_knot", F.when(F.col("_knot").isNotNull(), F.col("_at"))).alias("_first"))
    ranges = Window.orderBy("_range")
    ends = ends.select("_range", F.last("_last", True).over(ranges.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"), F.first("_first", True).over(ranges.rowsBetween(1, Window.unboundedFollowing)).alias("_later"))
    both = both.where("_row is not null").join(F.broadcast(ends), "_range")
    return both.select("_row.*", F.coalesce("_a", "_earlier").alias("_a"), F.coalesce("_b", "_later").alias("_b"))


#: Types of the results of a recurrence, Spark's and Arrow's.
_RESULTS = {"double": (T.DoubleType(), pa.float64()), "int": (T.IntegerType(), pa.int32()), "long": (T.LongType(), pa.int64()), "boolean": (T.BooleanType(), pa.bool_())}


#: Rows of a range that are folded as Python values at once.
SLICE = 1 << 16


def _listed(column: pa.ChunkedArray) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def folded(df: DataFrame, by: list[str], order: list, values: list[Column], step: Callable, out: dict[str, str], counted: str | None = None) -> DataFrame:
    """The rows with the results of a recurrence down the order of each group.

    ``step(state, x)`` gets the state (None at a group's first row) and the
    row's ``values``, and gives the next state, a tuple of numbers or None, and
    the results, one for each name of ``out`` (name: double, int, long or
    boolean).  The result ``counted`` becomes its running sum in the group.
    Rows that are equal in order and values follow each other in any order.

    A group may be of any size: rows are cut into ranges of (group, order), and
    each range is folded for itself.  A range that begins inside a group starts
    from the state at the end of the range before.  The ends of all ranges that
    another goes on from are worked out at once, from the rows of the last group
    alone; those ranges that lie wholly inside one group are done
    again as long as the state before them changes, which is never where the
    groups are smaller than a range and seldom goes far where the recurrence
    forgets its past.  A few numbers a range reach the driver.
    """
    n = max(2, shards(df.sparkSession))
    key = F.struct(*by) if by else F.struct(F.lit(1).alias("_one"))
    inputs = {f"_fd_v{i}": v for i, v in enumerate(values)}
    rows = df.withColumns(inputs).repartitionByRange(n, *by, *order, *inputs).withColumn("_fd_range", F.spark_partition_id())
    rows = written(rows, "folds")
    line = Window.partitionBy("_fd_range").orderBy(*by, *order, *inputs)
    rows = rows.withColumns({"_fd_at": F.row_number().over(line), "_fd_new": ~key.eqNullSafe(F.lag(key).over(line))})
    edges = rows.groupBy("_fd_range").agg(F.min_by(key, "_fd_at").alias("first"), F.max_by(key, "_fd_at").alias("last"), (F.count_if("_fd_new") == 1).alias("whole"))
    edges = edges.select("_fd_range", "whole", "first", "last", F.col("first").eqNullSafe(F.lag("last").over(Window.orderBy("_fd_range"))).alias("linked"))
    edges = written(edges.withColumn("_fd_on", F.coalesce(F.lead("linked").over(Window.orderBy("_fd_range")), F.lit(False))), "edges")
    lasts = rows.join(F.broadcast(edges.where("_fd_on").select("_fd_range", F.col("last").alias("_fd_last"))), "_fd_range").where(key.eqNullSafe(F.col("_fd_last"))).drop("_fd_last")
    edges = edges.select("_fd_range", "whole", "linked").orderBy("_fd_range").collect()
    names, taken, place = list(out), list(inputs), list(out).index(counted) if counted else None

    def fold(table: pa.Table, entries: dict) -> Iterator[tuple[list, tuple | None, float]]:
        """Results of the table's rows, a slice at a time, and the state and the total after it."""
        number = table.column("_fd_range")[0].as_py()
        state, total = entries.get(number, (None, 0))
        for at in range(0, len(table), SLICE):
            part = table.slice(at, SLICE)
            results, new = [], _listed(part.column("_fd_new"))
            for i, x in enumerate(zip(*(_listed(part.column(c)) for c in taken))):
                if new[i] and (i or at or number not in entries):
                    state, total = None, 0
                state, made = step(state, x)
                if place is not None:
                    total += made[place]
                    made = (*made[:place], total, *made[place + 1 :])
                results.append(made)
            yield results, state, total

    def ends(entries: dict) -> Callable:
        def end(table: pa.Table) -> pa.Table:
            number = table.column("_fd_range")[0].as_py()
            for _, state, total in fold(table.sort_by("_fd_at"), entries):
                pass
            return pa.table({"number": pa.array([number], pa.int32()), "state": pa.array([list(state)], pa.list_(pa.float64())), "total": pa.array([float(total)])})

        return end

    at_end, entries, todo = {}, {}, None
    while todo is None or todo:
        some = lasts if todo is None else rows.where(F.col("_fd_range").isin(todo))
        before = {k: (s, 0) for k, (s, _) in entries.items()}  # totals are added up below
        for r in some.groupBy("_fd_range").applyInArrow(ends(before), "number int, state array<double>, total double").collect():
            at_end[r["number"]] = (tuple(r["state"]), r["total"])
        found = {}
        for a, b in zip(edges, edges[1:]):
            if b["linked"]:
                state, total = at_end[a["_fd_range"]]
                carried = found[a["_fd_range"]][1] if a["whole"] and a["linked"] else 0
                found[b["_fd_range"]] = (state, int(total) + carried)
        todo = [e["_fd_range"] for e in edges if e["whole"] and e["linked"] and repr(found[e["_fd_range"]][0]) != repr(entries.get(e["_fd_range"], (None,))[0])]
        entries = found

    gone = [*inputs, "_fd_range", "_fd_at", "_fd_new"]
    schema = T.StructType([f for f in rows.schema.fields if f.name not in gone])
    for c, kind in out.items():
        schema = schema.add(c, _RESULTS[kind][0])

    def give(table: pa.Table) -> pa.Table:
        table = table.sort_by("_fd_at")
        made = [[pa.array(c, _RESULTS[out[name]][1]) for name, c in zip(names, zip(*results))] for results, _, _ in fold(table, entries)]
        table = table.drop_columns(gone)
        for name, pieces in zip(names, zip(*made)):
            table = table.append_column(name, pa.chunked_array(pieces, _RESULTS[out[name]][1]))
        return table

    return rows.groupBy("_fd_range").applyInArrow(give, schema)
