"""Row numbers over a whole table in a given order, without one task that sorts it all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..store import materialize


def numbered(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """``df`` with the 1-based place of each row in ``order``, which must be total for the numbers to be the same in every run.

    Rows are range-partitioned and written once; a range's rows are numbered in one task, and the sizes of the ranges before it, one row a range, are added.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = sizes.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)).cast("long")
    return ranged.join(sizes, "__range").withColumn(name, F.col("__before") + place).drop("__range", "__before")


def exact_percentiles(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """One row with an array ``q`` of percentiles by linear interpolation between the values at the two places around each; nulls are left out."""
    values = numbered(df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n")), [F.asc("v")], "place")
    return _percentiles(values, shares)


def _percentiles(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """From distinct values with their number and place: how many rows lie before each is summed over blocks of places."""
    block = F.floor((F.col("place") - 1) / 65536)
    blocks = values.groupBy(block.alias("block")).agg(F.sum("n").alias("size"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for 65536 distinct values
    blocks = blocks.select("block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    spans = values.withColumn("block", block).withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, "block")
    spans = spans.select("v", (F.col("start") + F.col("inner")).alias("low"), (F.col("start") + F.col("inner") + F.col("n")).alias("high"))
    total = values.agg(F.sum("n").alias("total"))
    at = [F.lit(float(s)) * (F.col("total") - 1) for s in shares]
    wanted = total.select(F.array(*at).alias("at"))
    holds = lambda k: (F.col("low") <= k) & (k < F.col("high"))
    met = spans.join(F.broadcast(wanted))  # one row
    found = [F.max(F.when(holds(f(F.col("at")[i])), F.col("v"))) for i in range(len(shares)) for f in (F.floor, F.ceil)]
    one = met.agg(*[c.alias(f"__{k}") for k, c in enumerate(found)], F.first("at").alias("at"))
    part = lambda i: F.col("at")[i] - F.floor(F.col("at")[i])
    return one.select(F.array(*[F.col(f"__{2 * i}") + (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) * part(i) for i in range(len(shares))]).alias("q"))
