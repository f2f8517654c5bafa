"""Spanning forests of similarity edges: one forest answers every threshold of single linkage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import materialize, new_path, remove


@dataclass(frozen=True)
class Forest:
    """``edges`` (a, b, sim), a < b: of every circle of edges the weakest is left out. ``paths`` (name, path): for each round of the
    search the component that a name was in and the least sim it was joined by so far."""

    edges: DataFrame
    paths: DataFrame


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, "forest")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _roots(up: DataFrame) -> tuple[DataFrame, str]:
    """(x, up) with ``up`` followed to its root, twice as far each round."""
    at = None
    while True:
        above = up.select(F.col("x").alias("up"), F.col("up").alias("far"))
        new, at_new = _cut(up.join(above, "up").select("x", F.col("far").alias("up"), (F.col("far") != F.col("up")).alias("moved")))
        if at:
            remove(up.sparkSession, at)
        up, at = new.select("x", "up"), at_new
        if new.where("moved").isEmpty():
            return up, at


def spanning_forest(edges: DataFrame) -> Forest:
    """The forest of greatest similarity of edges (a, b, sim), in rounds that at least halve the components.

    In a round each component takes its best edge to another one, by (sim, a, b), which orders edges of equal sim as well, so that the forest is the only one.
    Components that took edges to each other become one: the lesser of the two that took the same edge is the root, the others follow.
    Edges within a component go, of those between the same two the best stays. Direction and repeats of edges do not matter; loops and
    edges with a null are left out; no edges give an empty forest. All of it are joins and groupings by component; nothing goes to the driver.
    """
    spark = edges.sparkSession
    one = edges.where("a <> b AND sim IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("sim").cast("double").alias("sim"))
    one = one.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    between, at = _cut(one.select(F.col("a").alias("x"), F.col("b").alias("y"), F.struct((-F.col("sim")).alias("far"), "a", "b").alias("edge")))
    names = between.select(F.explode(F.array("x", "y")).alias("name")).distinct()
    paths = names.select("name", F.col("name").alias("root"), F.lit(float("inf")).alias("low"), F.array().cast("array<struct<root:string,low:double>>").alias("path"))
    paths, first = _cut(paths)
    made, taken = [first], []
    while True:
        both = between.unionByName(between.select(F.col("y").alias("x"), F.col("x").alias("y"), "edge"))
        best, at_best = _cut(both.groupBy("x").agg(F.min(F.struct("edge", "y")).alias("m")).select("x", F.col("m.y").alias("up"), F.col("m.edge").alias("edge")))
        made.append(at_best)
        if best.isEmpty():
            break
        taken.append(best.select("edge").distinct())
        other = best.select(F.col("x").alias("up"), F.col("up").alias("back"))
        up = best.join(other, "up").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("up")), F.col("x")).otherwise(F.col("up")).alias("up"))
        roots, at_roots = _roots(up)
        made.append(at_roots)
        step = roots.join(best.select("x", (-F.col("edge.far")).alias("by")), "x").select(F.col("x").alias("root"), F.col("up").alias("next"), "by")
        paths = paths.join(step, "root", "left").withColumn("root", F.coalesce("next", "root")).withColumn("low", F.least("low", "by"))
        paths = paths.select("name", "root", "low", F.concat("path", F.array(F.struct("root", "low"))).alias("path"))
        label = lambda c: roots.select(F.col("x").alias(c), F.col("up").alias(f"r{c}"))
        moved = between.join(label("x"), "x").join(label("y"), "y").where("rx <> ry")
        moved = moved.groupBy(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).agg(F.min("edge").alias("edge"))
        between, at_new = _cut(moved)
        remove(spark, at)
        at = at_new
    tree = between.select("edge")
    for t in taken:
        tree = tree.unionByName(t)
    # names of the paths' fields are those of the first, empty ones
    forest = Forest(materialize(tree.select("edge.a", "edge.b", (-F.col("edge.far")).alias("sim")), "tree"), materialize(paths.select("name", "path"), "paths"))
    for path in (at, *made):
        remove(spark, path)
    return forest


def bottlenecks(forest: Forest, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with ``sim``, the threshold up to which both names are in one cluster: the least sim on the best path between them.

    Null where no path joins them, 1 for a name and itself. The first round that has both in one component tells it, from a row for each name.
    """
    side = lambda c, to: forest.paths.select(F.col("name").alias(c), F.col("path").alias(to))
    met = pairs.join(side(a, "__pa"), a, "left").join(side(b, "__pb"), b, "left")
    shared = F.filter(F.zip_with("__pa", "__pb", lambda s, t: F.when(s["root"] == t["root"], F.least(s["low"], t["low"]))), lambda x: x.isNotNull())
    return met.select(*pairs.columns, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.get(shared, F.lit(0))).alias("sim"))


def group_thresholds(forest: Forest, groups: DataFrame, key: str = "group", name: str = "name") -> DataFrame:
    """(key, epsilon): the least distance at which all names of a group are in one cluster, null where none does, 0 for a group of one name."""
    one = groups.select(key, name).distinct()
    first = one.groupBy(key).agg(F.min(name).alias("__first"))
    met = bottlenecks(forest, one.join(first, key), "__first", name)
    return met.groupBy(key).agg(F.when(F.count("sim") == F.count(F.lit(1)), 1 - F.min("sim")).alias("epsilon"))


def clusters_at(forest: Forest, epsilon: float) -> DataFrame:
    """(name, cluster) of the names that have another within ``epsilon``, each cluster named by its least; from the forest's edges alone."""
    from .canon import clusters

    return clusters(forest.edges.where(1 - F.col("sim") <= F.lit(epsilon) + 1e-9))


def threshold_profile(forest: Forest, grid: Sequence[float]) -> DataFrame:
    """(epsilon, clusters, names) at each distance of ``grid``: a cluster of a forest has one name more than edges, so both are counted without clustering."""
    steps = F.explode(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: 1 - F.col("sim") <= g + 1e-9)).alias("epsilon")
    edges = forest.edges.select(steps).groupBy("epsilon").agg(F.count(F.lit(1)).alias("__edges"))
    nearest = forest.edges.select(F.explode(F.array("a", "b")).alias("name"), "sim").groupBy("name").agg(F.max("sim").alias("sim"))
    names = nearest.select(steps).groupBy("epsilon").agg(F.count(F.lit(1)).alias("names"))
    return names.join(edges, "epsilon").select("epsilon", (F.col("names") - F.col("__edges")).alias("clusters"), "names")
