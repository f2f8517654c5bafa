"""From source frames to the fact schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_uuid, epoch_to_timestamp, parse_timestamp, sanitize
from ..schema import ALIASES, PLAY_COLUMNS, PLAY_KEYS


def rename_aliases(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Resolve source names by name only; an alias whose target is there already is dropped."""
    taken = set(df.columns)
    rename: dict[str, str] = {}
    for old, new in aliases.items():
        if old in taken and new not in taken and new not in rename.values():
            rename[old] = new
    return df.withColumnsRenamed(rename)


def order_columns(df: DataFrame, first: Sequence[str] = PLAY_COLUMNS) -> DataFrame:
    return df.select(*[c for c in first if c in df.columns], *[c for c in df.columns if c not in first])


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row a key, the first in ``order``; rows of equal order are told apart by nothing, so give a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rank).where("__rn = 1").drop("__rn")


def normalize_plays(df: DataFrame, *order: Column | str) -> DataFrame:
    """Fact rows of an API-like frame: names resolved, epoch seconds or text to UTC time, ids cleaned, first of each key kept."""
    df = rename_aliases(df)
    if "uts" in df.columns:
        df = df.withColumn("play_time", epoch_to_timestamp(F.col("uts")))
    elif df.schema["play_time"].dataType.simpleString() == "string":
        df = df.withColumn("play_time", parse_timestamp(F.col("play_time")))
    mbid = clean_uuid(F.col("artist_mbid")) if "artist_mbid" in df.columns else F.lit(None).cast("string")
    return keep_first(df.withColumn("artist_mbid", mbid), PLAY_KEYS[0], *order).select(*PLAY_COLUMNS)


def merge_keep_last(old: DataFrame, new: DataFrame, keys: Sequence[Sequence[str]] = PLAY_KEYS, *order: Column) -> DataFrame:
    """Union by name in which the newer batch, then the last row by ``order``, wins for the first key set that both have."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    key = next(k for k in keys if set(k) <= set(both.columns))
    return order_columns(keep_first(both, key, F.col("__batch").desc(), *order).drop("__batch"))


def repair_schema(df: DataFrame, expected: Sequence[str] = PLAY_COLUMNS) -> DataFrame:
    return df.select(*[c for c in expected if c in df.columns])


def with_calendar(df: DataFrame, time: str = "play_time") -> DataFrame:
    return df.withColumns({"year": F.year(time), "month": F.month(time), "day": F.dayofmonth(time)})


def align_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The model's columns in its order; missing ones and nulls are 0."""
    return df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])


def unique_names(df: DataFrame, column: str, *order: Column | str, name: str = "clean") -> DataFrame:
    """``name``: the sanitised ``column``, no two alike: of rows with the same one all but the first in ``order`` get _1, _2, ..."""
    s = df.withColumn("__base", sanitize(F.col(column)))
    k = F.row_number().over(Window.partitionBy("__base").orderBy(*(order or [column]))) - 1
    return s.withColumn("__k", k).withColumn(name, F.when(F.col("__k") == 0, F.col("__base")).otherwise(F.concat("__base", F.lit("_"), F.col("__k").cast("string")))).drop("__base", "__k")
