"""Lookups, substitutions, interval and as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alike, fold, empty, split_variants, zipped_differences

OPEN_END = "9999-12-30"


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default: Column | None = None) -> DataFrame:
    """Left join with a dimension; the optimizer broadcasts it if its size allows."""
    joined = df.join(dim.select(on, value), on, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), default)) if default is not None else joined


def canonical_map(variants: DataFrame, seps: str = "{") -> DataFrame:
    """(variant, canonical_name) of linked groups; of several the latest, then the greatest hash; identities are left out."""
    pairs = variants.where("to_link").select(F.explode(split_variants(F.col("artist_variants_text"), seps)).alias("variant"), "canonical_name", "timestamp", "artist_variants_hash")
    best = pairs.groupBy("variant").agg(F.max(F.struct("timestamp", "artist_variants_hash", "canonical_name")).alias("b")).select("variant", F.col("b.canonical_name").alias("canonical_name"))
    return best.where("variant <> canonical_name")


def apply_canonical(df: DataFrame, variants: DataFrame, column: str = "artist_name", seps: str = "{") -> DataFrame:
    """Names replaced once, all at the same time: a canonical name that is itself a variant is not followed."""
    names = canonical_map(variants, seps)
    return df.join(names, df[column] == names["variant"], "left").withColumn(column, F.coalesce("canonical_name", column)).select(*df.columns)


def asof_interval(df: DataFrame, timeline: DataFrame, day: Column, *, compat: bool = False) -> DataFrame:
    """Country of the interval [start, end) that holds the day, null between intervals.

    Intervals are turned into a sorted array of change points (a timeline is one user's, so it is a row), and the last point
    not after the day counts. ``compat``: the latest start counts unless the day is after the end of the latest *closed* interval that began.
    """
    row = timeline.select("country_code", "start_date", "end_date")
    if compat:
        points = row.agg(F.array_sort(F.collect_list(F.struct("start_date", "country_code"))).alias("starts"), F.array_sort(F.collect_list(F.when(F.col("end_date").isNotNull(), F.struct("start_date", "end_date")))).alias("closed"))
        d = day.cast("date")
        last = F.try_element_at(F.filter("starts", lambda p: p["start_date"] <= d), F.lit(-1))
        end = F.try_element_at(F.filter("closed", lambda p: p["start_date"] <= d), F.lit(-1))
        return df.join(F.broadcast(points)).withColumn("user_country", F.when(end["end_date"].isNull() | (d <= end["end_date"]), last["country_code"])).drop("starts", "closed")
    ends = row.where("end_date is not null").select(F.col("end_date").alias("at"), F.lit(0).alias("k"), F.lit(None).cast("string").alias("country_code"))
    starts = row.select(F.col("start_date").alias("at"), F.lit(1).alias("k"), "country_code")
    points = starts.unionByName(ends).agg(F.array_sort(F.collect_list(F.struct("at", "k", "country_code"))).alias("__points"))
    hit = F.try_element_at(F.filter("__points", lambda p: p["at"] <= day.cast("date")), F.lit(-1))
    return df.join(F.broadcast(points)).withColumn("user_country", hit["country_code"]).drop("__points")


def asof_large(df: DataFrame, other: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """As-of join of two large tables: the latest ``value`` of the same key not after the row's time, by one sorted union."""
    left = df.withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(other.schema[value].dataType)})
    right = other.select(key, time, F.lit(0).alias("__side"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__side", "__v")


def current_interval(timeline: DataFrame, today: Column) -> DataFrame:
    open_now = (F.col("start_date") <= today) & (F.col("end_date").isNull() | (F.col("end_date") > today))
    return timeline.where(open_now).orderBy(F.desc("start_date")).limit(1)


def interval_overlaps(timeline: DataFrame, *, same_country: bool = True, closed: bool = False, bucket_days: int = 366, by: str | None = None) -> DataFrame:
    """Pairs of overlapping intervals (id_a < id_b), of equal ``by`` if that is given.

    Of two that overlap the later one starts within the earlier one. So each interval is laid out over the buckets of time from its start to its
    end (an open one to the last start of all), and meets those that start in one of them: an equi-join in which a pair meets once.
    """
    end = F.coalesce("end_date", F.lit(OPEN_END).cast("date"))
    bucket = lambda d: F.floor(F.unix_date(d) / bucket_days).cast("int")
    cut = timeline.select("id", F.col("country_code").alias("c"), F.col("start_date").alias("s"), end.alias("e"), (F.col(by) if by else F.lit(0)).alias("u"))
    last = cut.agg(F.max("s").alias("__last"))
    long = cut.join(F.broadcast(last)).withColumn("bucket", F.explode(F.sequence(bucket(F.col("s")), F.greatest(bucket(F.col("s")), bucket(F.least("e", "__last"))))))  # one row
    a = long.select(F.col("id").alias("ia"), F.col("c").alias("ca"), F.col("s").alias("sa"), F.col("e").alias("ea"), "bucket", F.col("u").alias("ua"))
    b = cut.select(F.col("id").alias("ib"), F.col("c").alias("cb"), F.col("s").alias("sb"), F.col("e").alias("eb"), bucket(F.col("s")).alias("b"), F.col("u").alias("ub"))
    later = (F.col("sa") < F.col("sb")) | ((F.col("sa") == F.col("sb")) & (F.col("ia") < F.col("ib")))
    meet = (F.col("sa") <= F.col("eb")) & (F.col("sb") <= F.col("ea")) if closed else (F.col("sa") < F.col("eb")) & (F.col("sb") < F.col("ea"))
    on = (F.col("bucket") == F.col("b")) & later & meet
    if same_country:
        on = on & (F.col("ca") == F.col("cb"))
    if by:
        on = on & (F.col("ua") == F.col("ub"))
    return a.join(b, on).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))


def backfill(df: DataFrame, fresh: DataFrame, on: list[str], column: str, *, overwrite: bool = False) -> DataFrame:
    """Fill ``column`` from another table: only where it is empty, or wherever the other has a value (``overwrite``)."""
    other = fresh.select(*on, F.col(column).alias("__new"))
    new = F.when(~empty(F.col("__new")), F.col("__new"))
    own = F.when(~empty(F.col(column)), F.col(column))
    value = F.coalesce(new, F.col(column)) if overwrite else F.coalesce(own, new, F.col(column))
    return df.join(other, on, "left").withColumn(column, value).drop("__new")


def fuzzy_code(names: DataFrame, codes: DataFrame) -> DataFrame:
    """(name, iso2): equal but for case, else the first country name in order of nearly equal length with one differing place at most.

    Candidates are met by length, so the join is on equal keys; the code table is small, as there are some 250 countries.
    """
    n = F.length(fold(F.col("en_name")))
    near = codes.select("iso2", "en_name", F.explode(F.sequence(F.greatest(n - 1, F.lit(0)), n + 1)).alias("__n"))
    probe = names.select("name").distinct()
    a, b = fold(F.col("name")), fold(F.col("en_name"))
    hits = probe.join(near, F.length(fold(F.col("name"))) == F.col("__n")).where((a == b) | (zipped_differences(a, b) <= 1))
    best = hits.groupBy("name").agg(F.min(F.struct((a != b).alias("miss"), "en_name", "iso2")).alias("b"))
    return names.join(best, "name", "left").select("name", F.col("b.iso2").alias("iso2"))


def by_name(left: DataFrame, right: DataFrame, column: str, value: str, *, accents: bool = False) -> DataFrame:
    """``left`` with the ``value`` that ``right`` has for a name, whatever its case and, unless ``accents`` count, its accents.

    A row of ``right`` with the very name goes before others, then the least name and value. Null names meet none.
    """
    names = left.select(F.col(column).alias("__name")).where("__name is not null").distinct()
    there = right.select(alike(F.col(column), accents).alias("__key"), F.col(column).alias("__other"), F.col(value).alias("__value"))
    met = names.join(there, alike(F.col("__name"), accents) == F.col("__key"))
    best = met.groupBy("__name").agg(F.min(F.struct((F.col("__name") != F.col("__other")).alias("miss"), "__other", "__value"))["__value"].alias(value))
    return left.drop(value).join(best, left[column] == best["__name"], "left").drop("__name")
