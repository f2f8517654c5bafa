"""Counting, ranking and membership over plays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import exact_percentiles, numbered


def value_counts(df: DataFrame, *keys: str, name: str = "plays") -> DataFrame:
    """Rows per non-null key."""
    for k in keys:
        df = df.where(F.col(k).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def by_count(name: str = "plays", *ties: str) -> list[Column]:
    return [F.desc(name), *[F.asc(t) for t in ties]]


def counts_by_year(df: DataFrame, value: str = "track_title", time: str = "play_time", *keys: Column) -> DataFrame:
    return df.where(F.col(time).isNotNull()).groupBy(F.year(time).alias("year"), *keys).agg(F.count(value).alias("plays"))


def average_by_month(df: DataFrame, value: str = "track_title", time: str = "play_time") -> DataFrame:
    """Mean plays of a calendar month over all years of the data, whether or not a year has that month."""
    monthly = df.groupBy(F.month(time).alias("month"), F.year(time).alias("year")).agg(F.count(value).alias("n"))
    years = monthly.agg(F.count_distinct("year").alias("years"))
    return monthly.groupBy("month").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(years)).select("month", (F.col("n") / F.col("years")).alias("avg_plays"))


def present_in_all(counts: DataFrame, key: str, dimension: str) -> DataFrame:
    """Keys that occur with every value of a dimension (relational division)."""
    whole = counts.agg(F.count_distinct(dimension).alias("__all"))
    own = counts.groupBy(key).agg(F.count_distinct(dimension).alias("__own"))
    return own.join(F.broadcast(whole), F.col("__own") == F.col("__all")).select(key)


def ranked_filter(df: DataFrame, key: str, text: str, limit: int | None = 10) -> DataFrame:
    """Keys that contain ``text`` with their rank by count among all keys, the first ``limit`` of them.

    Only what is asked for is ordered: the first keys, then, if ``text`` leaves some out, the keys ahead of each of them are counted.
    """
    counts = value_counts(df, key)
    order = [F.desc("plays"), F.asc(key)]
    if limit is None:
        return numbered(counts, order).where(F.col(key).contains(text)).select(F.col("rank").cast("int").alias("rank"), key, "plays")
    hits = counts.where(F.col(key).contains(text)).orderBy(*order).limit(limit)
    if not text:
        return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("rank", key, "plays")  # ``limit`` rows
    asked = hits.agg(F.collect_list(F.struct("plays", key)).alias("__hits"))  # one row of ``limit`` keys
    ahead = lambda h: (F.col("plays") > h["plays"]) | ((F.col("plays") == h["plays"]) & (F.col(key) <= h[key]))
    ranks = counts.join(F.broadcast(asked)).select(F.explode(F.filter("__hits", ahead)).alias("h")).groupBy("h").agg(F.count(F.lit(1)).cast("int").alias("rank"))
    return ranks.select("rank", F.col(f"h.{key}").alias(key), "h.plays").orderBy("rank")


def top_per_group(counts: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n largest of each group with their rank and share of the group in percent."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("plays"), F.asc(key)))
    total = F.sum("plays").over(Window.partitionBy(group))
    return counts.withColumns({"rank": rank, "share": F.col("plays") * 100.0 / total}).where(F.col("rank") <= n)


def pivot_years(counts: DataFrame, key: str, years: Sequence[int]) -> DataFrame:
    """One column a year, 0 where there is nothing; ``years`` given, so no extra job looks for them."""
    wide = counts.groupBy(key).pivot("year", list(years)).agg(F.sum("plays")).na.fill(0)
    return wide.withColumnsRenamed({str(y): f"y{y}" for y in years})


def decade_bin(n: Column) -> Column:
    """1 for 1-9, 10 for 10-99, 100 for 100-999, ..."""
    return F.pow(F.lit(10), F.length(n.cast("string")) - 1).cast("long")


def colour_bucket(n: Column) -> Column:
    return F.when(n > 10000, "high").when(n > 5000, "middle").when(n > 1000, "low").otherwise("none")


def case_buckets(df: DataFrame, column: str, cases: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows per bucket; the first text that the column contains decides, rows with none are left out."""
    c = F.col(column)
    bucket = F.when(c.contains(cases[0][0]), cases[0][1])
    for text, name in cases[1:]:
        bucket = bucket.when(c.contains(text), name)
    return df.select(bucket.alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("plays"))


def regex_or_member(df: DataFrame, column: str, members: Sequence[str], pattern: str, but: str) -> DataFrame:
    """Rows whose value is a member or matches ``pattern``, but does not match ``but``; case is ignored, null matches nothing."""
    c = F.col(column)
    like = lambda p: F.coalesce(c.rlike("(?i)" + p), F.lit(False))
    return df.where((F.coalesce(c.isin(list(members)), F.lit(False)) | like(pattern)) & ~like(but))


def label_priority(counts: DataFrame, measures: Sequence[str], n: int, key: str) -> DataFrame:
    """Each key under the first measure in which it is among the n largest; n rows a measure are all that is ordered."""
    firsts = [counts.orderBy(F.desc(m), F.asc(key)).limit(n).withColumn("__m", F.lit(i)) for i, m in enumerate(measures)]
    both = firsts[0]
    for f in firsts[1:]:
        both = both.unionByName(f)
    best = both.groupBy(*counts.columns).agg(F.min("__m").alias("__m"))
    return best.withColumn("label", F.element_at(F.array(*[F.lit(m) for m in measures]), F.col("__m") + 1)).drop("__m")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles by linear interpolation, maximum."""
    whole = df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.min(column).alias("min"), F.max(column).alias("max"))
    q = exact_percentiles(df, column, [0.25, 0.5, 0.75])
    return whole.join(F.broadcast(q)).select("n", "mean", "std", "min", *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((25, 50, 75))], "max")  # one row each


def ascending(counts: DataFrame, value: str = "plays", *ties: str) -> DataFrame:
    """Counts from the least to the greatest."""
    return counts.orderBy(F.asc(value), *[F.asc(t) for t in ties])


def between_years(df: DataFrame, low: int, high: int, time: str = "play_time") -> DataFrame:
    """Rows of the years from ``low`` to ``high``, both included; compared as times, so that a scan can skip files."""
    t = F.col(time)
    return df.where((t >= F.lit(f"{low}-01-01").cast("timestamp_ntz")) & (t < F.lit(f"{high + 1}-01-01").cast("timestamp_ntz")))


def two_letter(df: DataFrame, column: str) -> DataFrame:
    """Rows whose code is two characters and no text for a missing one."""
    return df.where(F.col(column).isNotNull() & (F.col(column) != "None") & (F.length(column) == 2))


def page_after(df: DataFrame, key: str, last: object | None, n: int) -> DataFrame:
    """The next ``n`` rows in order of a unique key, after the key that the page before ended with (None: the first page)."""
    rest = df if last is None else df.where(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(n)
