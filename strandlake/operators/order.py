"""Total orders without one task for all rows: row numbers, running sums, ranks in groups, average ranks.

Rows are range-partitioned once and written with their partition and their place
in it; offsets come from the counts of what was written, one row per partition.
So numbers and counts can't disagree, whatever a later plan does. Rows that tie
on the order are spread by a hash of the whole row, so that a key that a third of
all rows hold still meets many partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.storage import materialize

#: monotonically_increasing_id() is the partition shifted by so many bits, plus the place in it.
PLACE_BITS = 33


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    """The rows, written in order with `_m`: partition and place."""
    row = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in ((f"`{c}`", t) for c, t in df.dtypes)]
    keyed = df.select("*", *(o.alias(f"_o{i}") for i, o in enumerate(order)), F.xxhash64(*row).alias("_tie"))
    keys = [*(f"_o{i}" for i in range(len(order))), "_tie"]
    sorted_ = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(sorted_.drop(*keys).withColumn("_m", F.monotonically_increasing_id()), "ordered")


def _part() -> Column:
    return F.shiftright("_m", PLACE_BITS)


def _offsets(parts: DataFrame, column: str) -> DataFrame:
    """(_p, _s): what stands before each partition; parts has a row per partition."""
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("_p", F.coalesce(F.sum(column).over(before), F.lit(0)).alias("_s"))


def row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """The rows with consecutive numbers from 0 in an order; ties follow a hash of the row."""
    dealt = _dealt(df, [F.col(o) if isinstance(o, str) else o for o in order])
    starts = _offsets(dealt.groupBy(_part().alias("_p")).agg(F.count("*").alias("_n")), "_n")
    place = F.col("_m").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    numbered = dealt.withColumn("_p", _part()).join(F.broadcast(starts), "_p")  # a row per partition
    return numbered.withColumn(name, (F.col("_s") + place).cast("long")).drop("_p", "_s", "_m")


def running_sum(df: DataFrame, value: str, *order: str | Column, name: str = "before") -> DataFrame:
    """The rows with the sum of a value over all rows before them in an order; the order should not tie."""
    dealt = _dealt(df, [F.col(o) if isinstance(o, str) else o for o in order]).withColumn("_p", _part())
    starts = _offsets(dealt.groupBy("_p").agg(F.sum(value).alias("_n")), "_n")
    own = F.coalesce(F.sum(value).over(W.partitionBy("_p").orderBy("_m").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_own")).drop("_p", "_s", "_own", "_m")


def group_index(df: DataFrame, group: str, *order: str | Column, name: str = "group_index", size: str | None = None) -> DataFrame:
    """The rows with numbers from 0 inside their group, and its size; a group may hold any share of all rows."""
    whole = row_index(df, group, *order, name="_gi")
    firsts = whole.groupBy(F.col(group).alias("_gkey")).agg(F.min("_gi").alias("_gfirst"), F.count("*").alias("_gsize"))
    out = whole.join(firsts, F.col(group).eqNullSafe(F.col("_gkey"))).withColumn(name, F.col("_gi") - F.col("_gfirst"))
    return (out.withColumn(size, F.col("_gsize")) if size else out).drop("_gkey", "_gfirst", "_gsize", "_gi")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with the ranks of a column from 1, ties averaged: distinct values are counted, summed and joined back."""
    counts = running_sum(df.groupBy(column).agg(F.count("*").alias("_n")), "_n", column, name="_b")
    return df.join(counts.select(column, (F.col("_b") + (F.col("_n") + 1) / 2).alias(name)), column)
