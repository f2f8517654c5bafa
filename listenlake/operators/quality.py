"""Completeness and hygiene reports, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, empty


def _unfolded(df: DataFrame, columns: Sequence[str], filled) -> DataFrame:
    """(column_name, filled, total) from a single aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("__total"), *[F.count_if(filled(F.col(c))).alias(f"__f{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"__f{i}").alias("filled")) for i, c in enumerate(columns)])
    return counts.select(F.explode(rows).alias("r"), F.col("__total").alias("total")).select("r.column_name", "r.filled", "total")


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled (neither null nor blank) rows of each column, and percent to two digits."""
    rows = _unfolded(df, columns, lambda c: ~blank(c.cast("string")))
    return rows.withColumn("percent", F.round(F.try_divide(F.col("filled").cast("double"), "total") * 100, 2))


def null_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null rows of each column and percent; blanks are values here."""
    rows = _unfolded(df, columns, lambda c: c.isNotNull()).withColumn("nulls", F.col("total") - F.col("filled"))
    return rows.select("column_name", "nulls", "total", F.try_divide(F.col("nulls") * 100.0, "total").alias("null_percent"))


def missing_ratio(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.avg(F.col(column).isNull().cast("int")) * 100).alias("missing_percent"))


def alias_coverage(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(empty(F.col(column))).alias("without"), F.count_if(~empty(F.col(column))).alias("with"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of every key that occurs more than once."""
    return df.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("copies > 1")


def short_values(df: DataFrame, column: str, least: int) -> DataFrame:
    """Values that are shorter than ``least`` once trimmed, with their number."""
    return df.where(F.length(F.trim(F.col(column))) < least).groupBy(column).agg(F.count(F.lit(1)).alias("plays"))


def probe_values(df: DataFrame, probes: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(column_name, value, plain, n_value, n_plain): exact matches of each probe's two spellings, all in one pass."""
    sums = [F.count_if(F.col(c) == x).alias(f"__{i}_{j}") for i, (c, *both) in enumerate(probes) for j, x in enumerate(both)]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(a).alias("value"), F.lit(b).alias("plain"), F.col(f"__{i}_0").alias("n_value"), F.col(f"__{i}_1").alias("n_plain"))
        for i, (c, a, b) in enumerate(probes)
    ]
    return df.agg(*sums).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def char_frequency(df: DataFrame, column: str, chars: DataFrame) -> DataFrame:
    """Distinct values that contain each character, 0 for the unused: characters of distinct values meet the table by equality."""
    used = df.select(column).distinct().select(F.explode(F.array_distinct(F.split(column, ""))).alias("ascii_char")).groupBy("ascii_char").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(chars).join(used, "ascii_char", "right").select("ascii_code", "ascii_char", "n").where("ascii_code is not null").unionByName(
        chars.join(used, "ascii_char", "left_anti").select("ascii_code", "ascii_char", F.lit(0).cast("long").alias("n"))
    )


def special_chars(spark) -> DataFrame:
    """Printable ASCII that is neither letter nor digit: 32 rows."""
    return spark.range(33, 127).select(F.col("id").cast("int").alias("ascii_code"), F.chr(F.col("id")).alias("ascii_char")).where(~F.col("ascii_char").rlike("[0-9A-Za-z]"))


def completeness_score(weights: Mapping[str, int]) -> Column:
    """Sum of the weights of the columns that are neither null nor empty."""
    terms = [F.when(~empty(F.col(c)), w).otherwise(0) for c, w in weights.items()]
    return sum(terms[1:], terms[0])
