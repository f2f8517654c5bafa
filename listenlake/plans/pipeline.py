"""The load as named steps over snapshots, each returning a status."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import canon, counts, integrity, joins, normalize, similarity
from ..sources import sinks
from ..sources.provider import TableProvider
from ..store import materialize


@dataclass
class Store:
    """Places of the tables."""

    plays: str
    artists: str
    variants: str
    steps: list[dict] = field(default_factory=list)


def _status(step: str, **counts_: int) -> dict:
    return {"step": step, "status": "success", "message": f"{step} done", **counts_}


def fetch_new_data(spark: SparkSession, store: Store, source: DataFrame) -> dict:
    """Rows later than the newest stored play, inserted once; nothing new is a success as well.

    What is later than all that is stored cannot repeat a stored key, so it is appended: the table is not read beyond its newest time.
    """
    rows = normalize.normalize_plays(source, F.asc("uts")) if "uts" in source.columns else normalize.normalize_plays(source, F.asc("play_time"))
    sinks.recover(spark, store.plays)
    try:
        old = spark.read.parquet(store.plays)
    except Exception as e:  # the first load has no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        sinks.dump(rows, store.plays)
        return _status("fetch", new=spark.read.parquet(store.plays).count())
    mark = old.agg(F.max("play_time")).first()[0]
    fresh = materialize(rows if mark is None else rows.where(F.col("play_time") > F.lit(mark)), "fresh")
    new = fresh.count()
    if not new:
        return {"step": "fetch", "status": "success", "message": "no new plays to process", "new": 0}
    sinks.append(normalize.order_columns(fresh), store.plays)
    return _status("fetch", new=new)


def run_with_retries(step: Callable[[], dict], *, tries: int = 8, first: float = 30.0, most: float = 600.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """A step tried again after a failure, the wait doubling from ``first`` to ``most`` seconds; the last failure is raised."""
    wait = first
    for attempt in range(tries + 1):
        try:
            return step()
        except Exception:
            if attempt == tries:
                raise
            sleep(wait)
            wait = min(2 * wait, most)
    raise RuntimeError("unreachable")


def enrich_artist_data(spark: SparkSession, store: Store, reference: DataFrame) -> dict:
    dim, plays = spark.read.parquet(store.artists), spark.read.parquet(store.plays)
    found = integrity.sync_dimension(dim, plays, TableProvider(reference).lookup(plays))
    by = {r["action"]: r["n"] for r in found.groupBy("action").agg(F.count(F.lit(1)).alias("n")).collect()}
    sinks.swap_in(integrity.upsert(dim, found, "artist_name", ["mbid", "country"], overwrite=False), store.artists)
    return _status("enrich", processed=sum(by.values()), created=by.get("created", 0), updated=by.get("updated", 0))


def clean_artist_data(spark: SparkSession, store: Store) -> dict:
    dim, plays = spark.read.parquet(store.artists), spark.read.parquet(store.plays)
    before = dim.count()
    best = integrity.best_record(dim.withColumn("id", F.monotonically_increasing_id()) if "id" not in dim.columns else dim).select(*dim.columns)
    orphans = best.join(plays.select("artist_name"), "artist_name", "left_anti").count()
    sinks.swap_in(best, store.artists)
    remaining = spark.read.parquet(store.artists).count()
    return _status("clean", cleaned=before - remaining, remaining=remaining, orphans=orphans)


def run_canonization(spark: SparkSession, store: Store) -> dict:
    plays = joins.apply_canonical(spark.read.parquet(store.plays), spark.read.parquet(store.variants))
    r = plays.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("artist_name").alias("artists")).first()
    return _status("canonize", rows=r["rows"], artists=r["artists"])


def run_data_profiling(spark: SparkSession, store: Store, least: float = 0.77) -> dict:
    c = counts.value_counts(spark.read.parquet(store.plays), "artist_name")
    edges = similarity.similar_pairs(c, "artist_name", least, sort_tokens=True)
    members = canon.cluster_members(canon.clusters(edges))
    return _status("profile", artists=c.count(), groups=members.count())


def export_to_parquet(spark: SparkSession, store: Store, path: str) -> dict:
    sinks.dump(spark.read.parquet(store.plays), path)
    return _status("export", rows=spark.read.parquet(path).count())


def run_incremental_pipeline(spark: SparkSession, store: Store, source: DataFrame, reference: DataFrame) -> list[dict]:
    """Fetch new plays, enrich the artists, clean them; also where nothing new came, as references may have changed."""
    return [fetch_new_data(spark, store, source), enrich_artist_data(spark, store, reference), clean_artist_data(spark, store)]


def run_full_pipeline(spark: SparkSession, store: Store, source: DataFrame, reference: DataFrame, export: str, progress: Callable[[str, int], None] | None = None, retries: int = 0) -> list[dict]:
    """All steps in order, each tried again ``retries`` times; a step that still fails ends the run and is told in the list."""
    steps = [
        ("fetch", lambda: fetch_new_data(spark, store, source)),
        ("enrich", lambda: enrich_artist_data(spark, store, reference)),
        ("clean", lambda: clean_artist_data(spark, store)),
        ("canonize", lambda: run_canonization(spark, store)),
        ("export", lambda: export_to_parquet(spark, store, export)),
        ("profile", lambda: run_data_profiling(spark, store)),
    ]
    out = []
    for i, (name, step) in enumerate(steps):
        if progress:
            progress(name, 100 * i // len(steps))
        try:
            out.append(run_with_retries(step, tries=retries))
        except Exception as e:
            out.append({"step": name, "status": "error", "message": str(e)[:500]})
            break
    return out
