"""Connected components of link tables by alternating large-star and small-star steps; no link leaves the executors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import new_path, remove


def components(links: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (a, b: long).

    Each round is two aggregations and two joins and is written to the shared folder; the links only shrink. A node with
    very many links is aggregated map-side, and the joins may be split by adaptive execution.
    """
    spark = links.sparkSession
    edges, path = _write(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        following, new = _write(spark, small, name)
        state = tuple(following.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        remove(spark, path)
        edges, path = following, new
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _write(spark, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def local_roots(linked: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least node of the local component for the row nodes and the column nodes of a block of a link matrix."""
    top = np.iinfo(np.int64).max
    at_row, at_col = rows.copy(), cols.copy()
    while True:
        new_col = np.minimum(at_col, np.where(linked, at_row[:, None], top).min(axis=0, initial=top))
        new_row = np.minimum(at_row, np.where(linked, new_col[None, :], top).min(axis=1, initial=top))
        if (new_row == at_row).all() and (new_col == at_col).all():
            return at_row, at_col
        at_row, at_col = new_row, new_col
