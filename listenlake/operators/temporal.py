"""Monthly series, seasonal decomposition, densities, consistency over years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import exact_percentiles


def monthly_series(df: DataFrame, value: str = "track_title", time: str = "play_time") -> DataFrame:
    """(month, plays), month being its first day; months without plays are missing."""
    return df.where(F.col(time).isNotNull()).groupBy(F.trunc(F.col(time).cast("date"), "month").alias("month")).agg(F.count(value).alias("plays"))


def fill_months(series: DataFrame) -> DataFrame:
    span = series.agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return span.join(series, "month", "left").na.fill({"plays": 0})


def decompose(series: DataFrame, *, period: int = 12, time: str = "month", value: str = "plays") -> DataFrame:
    """Multiplicative seasonal decomposition: trend, seasonal, resid; the ends of half a period have no trend.

    The trend is the centred moving average of a whole period (half weights at both ends); a phase's factor is its mean ratio
    to the trend, scaled so that factors have mean 1. The series has one row a period, so its window is small. A series of fewer than two
    whole periods has no parts: all three are null.
    """
    half = period // 2
    order = Window.orderBy(time)
    x = F.col(value).cast("double")
    inner = F.sum(x).over(order.rowsBetween(-(half - 1), half - 1))
    s = series.withColumn("__rn", F.row_number().over(order)).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    whole = (F.col("__rn") > half) & (F.col("__rn") <= F.col("__n") - half) & (F.col("__n") >= 2 * period)
    s = s.withColumn("trend", F.when(whole, (inner + (F.lag(x, half).over(order) + F.lead(x, half).over(order)) / 2) / period))
    s = s.withColumn("__phase", (F.col("__rn") - 1) % period)
    s = s.withColumn("__factor", F.avg(F.try_divide(x, F.col("trend"))).over(Window.partitionBy("__phase")))
    factors = s.groupBy("__phase").agg(F.first("__factor").alias("f")).agg(F.avg("f").alias("__mean"))
    s = s.join(F.broadcast(factors)).withColumn("seasonal", F.col("__factor") / F.col("__mean"))
    return s.withColumn("resid", F.try_divide(x, F.col("trend") * F.col("seasonal"))).select(time, value, "trend", "seasonal", "resid")


def kernel_density(counts: DataFrame, group: str, value: str, *, points: int = 500) -> DataFrame:
    """(group, x, density): Gaussian kernels on a grid from 0 to 1.1 times the greatest value, scaled to peak 1 in each group.

    Bandwidth is n ** -0.2 times the sample deviation; groups with fewer than two different values have none.
    """
    stats = counts.groupBy(group).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp(value).alias("__sd"), F.collect_list(F.col(value).cast("double")).alias("__xs")).where("__sd > 0")
    top = counts.agg((F.max(value) * 1.1).alias("__top"))
    grid = stats.join(F.broadcast(top)).withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("__k") * F.col("__top") / (points - 1)
    h = F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * F.col("__sd")
    dens = grid.withColumns({"x": x, "__h": h}).withColumn("__d", F.aggregate("__xs", F.lit(0.0), lambda a, p: a + F.exp(F.pow((F.col("x") - p) / F.col("__h"), F.lit(2)) * -0.5)))
    return dens.withColumn("density", F.col("__d") / F.max("__d").over(Window.partitionBy(group))).select(group, F.col("__k").alias("k"), "x", "density")


def percentile_rank(counts: DataFrame, group: str, value: str) -> DataFrame:
    """Rank within the group as percent, ties sharing their average rank."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    ties = F.count(F.lit(1)).over(Window.partitionBy(group, value))
    rank = F.rank().over(Window.partitionBy(group).orderBy(value))
    return counts.withColumn("pct", (rank + (ties - 1) / 2.0) / n * 100)


def steady_by_cv(counts: DataFrame, key: str, percentile: float = 25.0) -> DataFrame:
    """Mean, population deviation and their ratio of each key's yearly counts; ratios up to the given percentile stay."""
    s = counts.groupBy(key).agg(F.avg("plays").alias("mean"), F.stddev_pop("plays").alias("std")).withColumn("cv", F.round(F.try_divide("std", "mean"), 12))  # so that equal spreads are equal
    limit = exact_percentiles(s, "cv", [percentile / 100]).select(F.col("q")[0].alias("__limit"))
    return s.join(F.broadcast(limit), F.col("cv") <= F.col("__limit")).drop("__limit")


def steady_by_std(counts: DataFrame, key: str, n: int = 10) -> DataFrame:
    s = counts.groupBy(key).agg(F.stddev_samp("plays").alias("std"), F.sum("plays").alias("plays"))
    return s.orderBy(F.round("std", 9).asc_nulls_last(), key).limit(n)  # rounded, so that equal spreads tie


def consistent_above(ranked: DataFrame, key: str, thresholds: list[int], n: int = 5) -> DataFrame:
    """(threshold, key, mean_pct): the n best of the keys whose every year reaches the threshold."""
    s = ranked.groupBy(key).agg(F.min("pct").alias("__low"), F.avg("pct").alias("mean_pct"))
    s = s.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where(F.col("__low") >= F.col("threshold"))
    rank = F.row_number().over(Window.partitionBy("threshold").orderBy(F.round("mean_pct", 9).desc(), key))
    return s.withColumn("__rn", rank).where(F.col("__rn") <= n).select("threshold", key, "mean_pct")


def high_water_mark(df: DataFrame, time: str = "play_time") -> DataFrame:
    return df.agg(F.unix_timestamp(F.max(F.col(time).cast("timestamp"))).alias("mark"))


def after_mark(df: DataFrame, mark: Column, time: str) -> DataFrame:
    return df.where(F.col(time) > mark)


def history_length(df: DataFrame, group: str, *, least: int = 12, whole: int = 24, time: str = "play_time") -> DataFrame:
    """(group, months, worth_a_try, decomposable): months with plays of each group, and whether they reach the two bounds of a decomposition."""
    months = df.where(F.col(time).isNotNull()).groupBy(group).agg(F.count_distinct(F.trunc(F.col(time).cast("date"), "month")).alias("months"))
    return months.select(group, "months", (F.col("months") >= least).alias("worth_a_try"), (F.col("months") >= whole).alias("decomposable"))
