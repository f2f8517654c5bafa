"""Profiles of a growing table from stored sketches of its months: what is known of old rows is merged, the rows are not read again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: log2 of the registers for distinct values: the standard error is 1.04 / sqrt(2 ** LOG_REGISTERS), 0.8 %.
LOG_REGISTERS = 14
#: Size of the sketch for quantiles: their rank is within 0.7 % of the number of values in 99 of 100 cases.
RANK_SIZE = 400
#: Bounds that the sketches keep to but for one case in many thousands: four standard errors, and twice the 99 % bound.
DISTINCT_BOUND, RANK_BOUND = 0.033, 0.014

SCHEMA = "month date, column string, rows bigint, filled bigint, low double, high double, total double, seen binary, spread binary"


def _number(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def month_sketches(df: DataFrame, time: str, columns: Sequence[str], numbers: Sequence[str] = ()) -> DataFrame:
    """One row a month and column (see ``SCHEMA``): exact rows, filled rows, least, greatest and total, a sketch of the distinct values and one of the quantiles.

    ``numbers`` have all of it (NaN counts as null), ``columns`` of any type no quantiles and totals. Rows without a time have a month of their
    own, null. One aggregation with partial sketches before the exchange, so a month that holds most rows is many tasks' work; no rows give none.
    """
    parts = []
    for c in dict.fromkeys([*columns, *numbers]):
        v = _number(c) if c in numbers else F.col(c)
        own = [F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count(v).alias("filled")]
        # by hash, as texts of no characters would not be counted
        seen = F.hll_sketch_agg(F.when(v.isNotNull(), F.xxhash64(v)), LOG_REGISTERS).alias("seen")
        if c in numbers:
            own += [F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"), seen, F.kll_sketch_agg_double(v, RANK_SIZE).alias("spread")]
        else:
            none = F.lit(None).cast("double")
            own += [none.alias("low"), none.alias("high"), none.alias("total"), seen, F.lit(None).cast("binary").alias("spread")]
        parts.append(F.struct(*own))
    months = df.groupBy(F.trunc(F.col(time).cast("date"), "month").alias("month")).agg(F.array(*parts).alias("__p"))
    return months.select("month", F.explode("__p").alias("p")).select("month", "p.*")


def add_sketches(batch: DataFrame, path: str, name: str, time: str, columns: Sequence[str], numbers: Sequence[str] = ()) -> None:
    """Sketches of a batch into the store at ``path``; a batch that is tried again under its name replaces what it left, so nothing counts twice."""
    month_sketches(batch, time, columns, numbers).write.mode("overwrite").parquet(f"{path}/batch={name}")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All sketches of a store, with the batch they are of."""
    return spark.read.schema(f"{SCHEMA}, batch string").parquet(path)


def merge_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """One row for each column, and each value of ``by`` (the month, say)."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("filled"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"),
        F.hll_union_agg("seen").alias("seen"), F.kll_merge_agg_double("spread").alias("spread"),
    )


def profile(sketches: DataFrame, *by: str, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(by, column, rows, filled, low, high, mean, distinct_values, quantiles) of merged sketches; only the last two are estimates.

    Distinct values are within ``DISTINCT_BOUND``, the rank of a quantile within ``RANK_BOUND`` of the filled rows. Null where a column is no number, or
    has no value.
    """
    one = merge_sketches(sketches, *by)
    at = F.array(*[F.lit(float(s)) for s in shares])
    quantiles = F.when(F.col("low").isNotNull(), F.kll_sketch_get_quantile_double("spread", at))
    return one.select(*by, "column", "rows", "filled", "low", "high", F.try_divide("total", F.when(F.col("total").isNotNull(), F.col("filled"))).alias("mean"), F.hll_sketch_estimate("seen").alias("distinct_values"), quantiles.alias("quantiles"))


def audit(df: DataFrame, found: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, distinct_close, quantiles_close): whether a profile of ``columns`` keeps its bounds on the rows it is of; null quantiles are not judged.

    Exact, so it costs what the sketches save: the distinct values of every column, and one pass that counts rows around each quantile.
    """
    wide = found.groupBy().pivot("column", list(columns)).agg(F.first("distinct_values").alias("d"), F.first("quantiles").alias("q"))
    met = df.join(F.broadcast(wide), how="cross")  # one row
    total = lambda v: F.greatest(F.count(v), F.lit(1))
    exact = []
    for c in columns:
        v, q = F.col(c), lambda i, c=c: F.get(F.col(f"{c}_q"), F.lit(i))
        number = dict(df.dtypes)[c] not in ("string", "date", "boolean", "timestamp", "timestamp_ntz")
        own = [F.count_distinct(v).alias("n"), F.first(f"{c}_d").alias("d")]
        if number:
            w = _number(c)
            below = [F.count(F.when(w < q(i), 1)) / total(w) for i in range(len(shares))]
            upto = [F.count(F.when(w <= q(i), 1)) / total(w) for i in range(len(shares))]
            near = [(b <= s + RANK_BOUND) & (u >= s - RANK_BOUND) for s, b, u in zip(shares, below, upto)]
            judged = near[0]
            for x in near[1:]:
                judged = judged & x
            own.append(F.when(F.first(f"{c}_q").isNotNull(), judged).alias("close"))
        else:
            own.append(F.lit(None).cast("boolean").alias("close"))
        exact.append(F.struct(F.lit(c).alias("column"), *own))
    each = met.agg(F.array(*exact).alias("e")).select(F.explode("e").alias("e")).select("e.*")
    return each.select("column", (F.abs(F.col("d") - F.col("n")) <= F.greatest(F.col("n") * DISTINCT_BOUND, F.lit(1.0))).alias("distinct_close"), F.col("close").alias("quantiles_close"))
