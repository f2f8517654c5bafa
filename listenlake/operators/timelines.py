"""Timelines of many users: intervals from a feed of changes, and values as of a time.

A key's rows are cut by month. What a month needs of those before it is one row a key and month (its last value), carried on over the months by a
window that is that much smaller; so a key with very many rows is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _month(time: Column) -> Column:
    return F.date_trunc("month", time.cast("timestamp"))


def _carried(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], there: Column) -> DataFrame:
    """(keys, __month, __before): the last ``value`` of the months before, as a struct that is null where there is none."""
    last = F.max_by(F.when(there, F.struct(F.col(value).alias("v"))), F.when(there, F.struct(*order)))
    months = rows.groupBy(*keys, "__month").agg(last.alias("__last"))
    w = Window.partitionBy(*keys).orderBy("__month").rowsBetween(Window.unboundedPreceding, -1)
    return months.select(*keys, "__month", F.last("__last", ignorenulls=True).over(w).alias("__before"))


def asof_by_month(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, value: str) -> DataFrame:
    """``left`` with the latest ``value`` of the same keys not after its ``time``; null if there is none. Of equal times of ``right`` the greatest value counts.

    Null keys are equal to each other. A null value of ``right`` counts as one. Rows of either side without a time meet nothing.
    """
    a = left.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.where(F.col(time).isNotNull()).select(*keys, time, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__month", _month(F.col(time)))
    carried = _carried(both, keys, "__v", [time, "__v"], F.col("__side") == 0)
    w = Window.partitionBy(*keys, "__month").orderBy(time, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last(F.when(F.col("__side") == 0, F.struct(F.col("__v").alias("v"))), ignorenulls=True).over(w)).where("__side = 1")
    carried = carried.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__month").alias("__m"), "__before")
    found = F.when(F.col(time).isNotNull(), F.coalesce("__seen", "__before")["v"])
    return seen.join(carried, _same(seen, keys), "left").select(*[c for c in left.columns if c != value], found.alias(value))


def intervals_of(feed: DataFrame, keys: Sequence[str], day: str, value: str, *order: str) -> DataFrame:
    """(keys, value, start_date, end_date): the feed's values as intervals [start, end), the last of a key open.

    Of several values of a day the last by ``order`` counts, then the greatest. Days on end with one value are one interval. Rows without a day are left
    out; a null value is a value of its own.
    """
    rank = F.struct(*order, F.col(value)) if order else F.struct(F.col(value))
    days = feed.where(F.col(day).isNotNull()).groupBy(*keys, F.col(day).cast("date").alias("__day")).agg(F.max_by(F.struct(F.col(value).alias("v")), rank)["v"].alias("__v"))
    days = days.withColumn("__month", _month(F.col("__day")))
    before = _carried(days, keys, "__v", ["__day"], F.lit(True))
    w = Window.partitionBy(*keys, "__month").orderBy("__day")
    stepped = days.withColumn("__own", F.lag(F.struct(F.col("__v").alias("v"))).over(w))
    before = before.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__month").alias("__m"), "__before")
    stepped = stepped.join(before, _same(stepped, keys), "left").withColumn("__prior", F.coalesce("__own", "__before"))
    starts = stepped.where(F.col("__prior").isNull() | ~F.col("__prior.v").eqNullSafe(F.col("__v"))).select(*keys, "__month", F.col("__v").alias(value), F.col("__day").alias("start_date"))
    # the end is the next start: of the same month, or the first of the months after
    months = starts.groupBy(*keys, "__month").agg(F.min("start_date").alias("__first"))
    after = Window.partitionBy(*keys).orderBy("__month").rowsBetween(1, Window.unboundedFollowing)
    following = months.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__month").alias("__m"), F.min("__first").over(after).alias("__after"))
    ended = starts.withColumn("__next", F.lead("start_date").over(Window.partitionBy(*keys, "__month").orderBy("start_date")))
    return ended.join(following, _same(ended, keys), "left").select(*keys, value, "start_date", F.coalesce("__next", "__after").alias("end_date"))


def _same(rows: DataFrame, keys: Sequence[str]) -> Column:
    on = rows["__month"] == F.col("__m")
    for k in keys:
        on = on & rows[k].eqNullSafe(F.col(f"__k_{k}"))
    return on


def current_intervals(timelines: DataFrame, keys: Sequence[str], today: Column) -> DataFrame:
    """Each key's interval that holds the day; of several that with the latest start."""
    here = timelines.where((F.col("start_date") <= today) & (F.col("end_date").isNull() | (F.col("end_date") > today)))
    rest = [c for c in timelines.columns if c not in keys]
    best = here.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("start_date", *[c for c in rest if c != "start_date"])).alias("__b"))
    return best.select(*keys, *[F.col(f"__b.{c}").alias(c) for c in rest])


def roll_timelines(timelines: DataFrame, news: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Close each key's open interval at its news' ``day`` and begin another, where the value changed; a key that had none begins one.

    ``news``: (keys, value, day), a row a key at most. Keys without news stay as they are.
    """
    is_open = F.col("end_date").isNull()
    fresh = news.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(value).alias("__new"), F.col("day").alias("__day"), F.lit(True).alias("__has"))
    on = F.lit(True)
    for k in keys:
        on = on & timelines[k].eqNullSafe(F.col(f"__k_{k}"))
    met = timelines.join(fresh, on, "left")
    changed = F.col("__has") & is_open & ~F.col(value).eqNullSafe(F.col("__new"))
    kept = met.select(*keys, value, "start_date", F.when(changed, F.col("__day")).otherwise(F.col("end_date")).alias("end_date"))
    still = timelines.where(is_open).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(value).alias("__new")).distinct()
    on = news[value].eqNullSafe(still["__new"])
    for k in keys:
        on = on & news[k].eqNullSafe(still[f"__k_{k}"])
    added = news.join(still, on, "left_anti").select(*keys, value, F.col("day").alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return kept.unionByName(added)
