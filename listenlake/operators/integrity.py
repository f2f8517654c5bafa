"""Inserts, upserts, timelines: each returns the table as it is afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import empty, signature, signature_hash, split_variants
from .normalize import keep_first
from .quality import completeness_score

#: Weights of a dimension row's completeness; fixed values.
ARTIST_WEIGHTS = {"mbid": 2, "country": 1, "disambiguation_comment": 1, "aliases": 1}


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """Rows whose key is neither in the target nor earlier in the batch, after the target's."""
    fresh = keep_first(rows, keys, *order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def new_rows(target: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    return keep_first(rows, keys, *order).join(target.select(*keys), list(keys), "left_anti")


def best_record(dim: DataFrame, name: str = "artist_name", weights: Mapping[str, int] = ARTIST_WEIGHTS, id_col: str = "id") -> DataFrame:
    """The most complete row of each name, the least id among equals."""
    scored = dim.withColumn("score", completeness_score(weights))
    return keep_first(scored, [name], F.desc("score"), F.asc(id_col))


def upsert(target: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], *, overwrite: bool) -> DataFrame:
    """Full outer join on the key; ``overwrite``: a new value that is not empty wins, else only empty fields are filled."""
    new = rows.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    both = target.join(new, key, "full_outer")
    for c in columns:
        old, fresh = F.col(c), F.col(f"__{c}")
        both = both.withColumn(c, F.when(~empty(fresh), fresh).otherwise(old) if overwrite else F.when(empty(old), F.coalesce(fresh, old)).otherwise(old))
    return both.select(*target.columns)


def upsert_cache(target: DataFrame, rows: DataFrame, columns: Sequence[str] = ("disambiguation_comment", "aliases", "country")) -> DataFrame:
    """Upsert that meets rows by mbid, and those whose mbid is unknown by name; the columns are replaced, also by nulls, new rows come after.

    ``rows`` have distinct mbids and names. A target row met by its mbid is not met by its name as well.
    """
    fields = [F.col(c).alias(f"__{c}") for c in columns]
    by_id = rows.where("mbid is not null").select("mbid", F.lit(True).alias("__i"), *fields)
    known = target.select("mbid").where("mbid is not null").distinct()
    unknown = rows.join(known, "mbid", "left_anti")
    by_name = unknown.select("artist_name", F.lit(True).alias("__n"), F.col("mbid").alias("__mbid"), *[F.col(c).alias(f"__n_{c}") for c in columns])
    met = target.join(by_id, "mbid", "left").join(by_name, "artist_name", "left")
    for c in columns:
        met = met.withColumn(c, F.when(F.col("__i"), F.col(f"__{c}")).when(F.col("__n"), F.col(f"__n_{c}")).otherwise(F.col(c)))
    met = met.withColumn("mbid", F.when(F.col("__i").isNull() & F.col("__n"), F.coalesce("mbid", "__mbid")).otherwise(F.col("mbid")))
    added = unknown.join(target.select("artist_name").distinct(), "artist_name", "left_anti")
    return met.select(*target.columns).unionByName(added.select(*target.columns))


def upsert_variants(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Decisions by hash of the group's signature; the latest wins."""
    sig = signature(split_variants(F.col("artist_variants_text")))
    keyed = rows.withColumn("artist_variants_text", sig).withColumn("artist_variants_hash", signature_hash(F.col("artist_variants_text")))
    both = target.withColumn("__b", F.lit(0)).unionByName(keyed.withColumn("__b", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, ["artist_variants_hash"], F.desc("__b"), F.desc("timestamp"), F.asc("canonical_name")).drop("__b")


def apply_edits(variants: DataFrame, edits: DataFrame) -> DataFrame:
    """Review edits (hash, action, value): delete, toggle to_link (null becomes true), canonical, comment; one edit a row and action."""
    wide = edits.groupBy("artist_variants_hash").agg(
        *[F.max(F.when(F.col("action") == a, F.coalesce("value", F.lit("")))).alias(f"__{a}") for a in ("delete", "toggle", "canonical", "comment")]
    )
    out = variants.join(wide, "artist_variants_hash", "left").where("__delete is null")
    return out.withColumns(
        {
            "to_link": F.when(F.col("__toggle").isNotNull(), ~F.coalesce("to_link", F.lit(False))).otherwise(F.col("to_link")),
            "canonical_name": F.coalesce("__canonical", "canonical_name"),
            "comment": F.coalesce("__comment", "comment"),
        }
    ).select(*variants.columns)


def roll_timeline(timeline: DataFrame, country: str, today: Column) -> DataFrame:
    """Close the open interval and begin another if the country changed; else the timeline as it is."""
    is_open = F.col("end_date").isNull()
    state = timeline.agg(F.coalesce(F.bool_or(is_open & (F.col("country_code") == country)), F.lit(False)).alias("__same"))
    kept = timeline.join(F.broadcast(state)).withColumn("end_date", F.when(is_open & ~F.col("__same"), today).otherwise(F.col("end_date"))).drop("__same")
    added = state.where("not __same").select(F.lit(country).alias("country_code"), today.alias("start_date"), F.lit(None).cast("date").alias("end_date"))
    return kept.select("country_code", "start_date", "end_date").unionByName(added)


def valid_intervals(timeline: DataFrame, *, strict: bool = True) -> DataFrame:
    end = F.col("end_date")
    return timeline.where(end.isNull() | (end > F.col("start_date") if strict else end >= F.col("start_date")))


def fill_confident(dim: DataFrame, guesses: DataFrame, least: float = 0.85) -> DataFrame:
    """Countries where null, from guesses of enough confidence."""
    sure = guesses.where(F.col("confidence") >= least).select("artist_name", F.col("country").alias("__guess"))
    return dim.join(sure, "artist_name", "left").withColumn("country", F.coalesce("country", "__guess")).drop("__guess")


def worklist(plays: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct (mbid, name) of plays with an id, then distinct names of those without; the limit holds for each."""
    named = plays.select(F.col("artist_mbid").alias("mbid"), "artist_name")
    with_id = named.where("mbid is not null").distinct()
    without = named.where("mbid is null").distinct()
    if limit:
        with_id, without = with_id.orderBy("artist_name", "mbid").limit(limit), without.orderBy("artist_name").limit(limit)
    return with_id.unionByName(without)


def sync_dimension(dim: DataFrame, plays: DataFrame, reference: DataFrame) -> DataFrame:
    """Dimension rows of all artists of plays, with an action: created, updated (a field was filled) or kept."""
    names = plays.where("artist_name is not null").groupBy("artist_name").agg(F.max(F.when(F.col("artist_mbid") != "", F.col("artist_mbid"))).alias("__mbid"))
    ref = reference.select("artist_name", F.col("country").alias("__country"))
    old = dim.select("artist_name", "mbid", "country", F.lit(True).alias("__old"))
    both = names.join(ref, "artist_name", "left").join(old, "artist_name", "left")
    fills = (empty(F.col("mbid")) & F.col("__mbid").isNotNull()) | (empty(F.col("country")) & F.col("__country").isNotNull())
    action = F.when(F.col("__old").isNull(), "created").when(fills, "updated").otherwise("kept")
    pick = lambda c: F.when(empty(F.col(c)), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)).alias(c)
    return both.select("artist_name", pick("mbid"), pick("country"), action.alias("action"))


def rank_in(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def enrich_unknown(plays: DataFrame, dim: DataFrame, provider, batch: int | None = None) -> DataFrame:
    """The dimension with a row more for each artist of plays that it lacks, as the provider knows it; ``batch``: that many names, the first by name.

    A name that the provider does not know gets a row with the name alone, so that it is not asked for again.
    """
    missing = plays.where("artist_name is not null").select("artist_name").distinct().join(dim.select("artist_name"), "artist_name", "left_anti")
    if batch:
        missing = missing.orderBy("artist_name").limit(batch)
    found = missing.join(provider.lookup(missing).dropDuplicates(["artist_name"]), "artist_name", "left")
    columns = [F.col(c).cast(dim.schema[c].dataType) if c in found.columns else F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in dim.columns]
    return insert_ignore(dim, found.select(*[c.alias(n) for c, n in zip(columns, dim.columns)]), ["artist_name"], "artist_name")
