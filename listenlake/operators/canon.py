"""Clusters of name variants, the least threshold that joins anchors, and recorded decisions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import signature, signature_hash, split_variants
from ..store import new_path, remove
from . import similarity
from .forest import group_thresholds, spanning_forest

#: Names known to be the same; the smallest threshold that joins each group is searched.
ANCHORS_EXAMPLE = (("hot ring", "hot rings"),)


def _cut(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and the place."""
    path = new_path(df.sparkSession, "labels")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def clusters(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(name, cluster): least name reachable over edges (a, b). Equals density clustering with two points a core; names without edges are noise and absent."""
    spark = edges.sparkSession
    edges, at_edges = _cut(edges.select("a", "b"))  # scored once, not once a round
    both, at_both = _cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    remove(spark, at_edges)
    labels, at = _cut(both.groupBy(F.col("a").alias("name")).agg(F.least(F.min("b"), F.min("a")).alias("cluster")))
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("name").alias("b"), "cluster"), "b").groupBy(F.col("a").alias("name")).agg(F.min("cluster").alias("near"))
        met = labels.join(around, "name").withColumn("low", F.least("cluster", "near"))
        # to the label of the label as well: long chains halve each round
        jump = labels.select(F.col("name").alias("low"), F.col("cluster").alias("far"))
        new, at_new = _cut(met.join(jump, "low", "left").select("name", F.coalesce(F.least("low", "far"), "low").alias("cluster"), (F.coalesce(F.least("low", "far"), "low") != F.col("cluster")).alias("moved")))
        remove(spark, at)
        labels, at = new.select("name", "cluster"), at_new
        if not new.where("moved").limit(1).count():
            remove(spark, at_both)
            return labels
    raise RuntimeError(f"clusters did not settle in {most_rounds} rounds")


def cluster_members(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.array_sort(F.collect_list("name")).alias("members"))


def cluster_input(counts: DataFrame, anchors: Sequence[str], least: int = 3) -> DataFrame:
    """Trimmed distinct names with enough plays, and the anchors in any case."""
    names = counts.where((F.col("plays") >= least) | F.col("artist_name").isin(list(anchors))).select(F.trim("artist_name").alias("name"))
    return names.unionByName(counts.sparkSession.createDataFrame([(a.strip(),) for a in anchors], "name string")).distinct()


#: Edges up to which the search for the least threshold runs on the driver, as rows of two names and a number.
EDGES_AT_HAND = 20_000


def minimal_epsilon(edges: Sequence[tuple[str, str, float]], groups: Sequence[Sequence[str]], low: float = 0.05, step: float = 0.01, high: float = 0.99) -> float | None:
    """Least distance of a grid at which every group is in one cluster, or None.

    A group joins at the largest edge on the paths of a minimum spanning tree: Kruskal's order of the edges gives it.
    """
    top: dict[str, str] = {}

    def find(x: str) -> str:
        top.setdefault(x, x)
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    needed = None
    for a, b, sim in sorted(edges, key=lambda e: 1 - e[2]):
        top[find(a)] = find(b)
        if all(len({find(x) for x in g}) == 1 for g in groups):
            needed = 1 - sim
            break
    return None if needed is None else _on_grid(needed, low, step, high)


def _on_grid(needed: float, low: float, step: float, high: float) -> float | None:
    k = 0
    while low + k * step < needed - 1e-9:
        k += 1
    value = round(low + k * step, 10)
    return value if value <= high + 1e-9 else None


def search_epsilon(edges: DataFrame, groups: Sequence[Sequence[str]], low: float = 0.05, step: float = 0.01, high: float = 0.99, at_hand: int = EDGES_AT_HAND) -> float | None:
    """``minimal_epsilon`` of edges (a, b, sim) of any number: few are searched on the driver, more by a spanning forest, of which the groups' thresholds alone come back."""
    edges = edges.where(F.col("sim") >= 1 - high - 1e-9).select("a", "b", "sim")
    few = edges.limit(at_hand + 1).collect()
    if len(few) <= at_hand:
        return minimal_epsilon([tuple(r) for r in few], groups, low, step, high)
    rows = edges.sparkSession.createDataFrame([(k, x) for k, g in enumerate(groups) for x in g], "group int, name string")
    found = group_thresholds(spanning_forest(edges), rows).agg(F.count("epsilon").alias("n"), F.count(F.lit(1)).alias("all"), F.max("epsilon").alias("needed")).first()
    return _on_grid(found["needed"] or 0.0, low, step, high) if found["n"] == found["all"] else None


def unhandled(members: DataFrame, variants: DataFrame) -> DataFrame:
    """Clusters whose signature has no recorded decision."""
    signed = members.withColumn("artist_variants_hash", signature_hash(signature(F.col("members"))))
    return signed.join(variants.select("artist_variants_hash"), "artist_variants_hash", "left_anti")


def apply_decisions(members: DataFrame, variants: DataFrame) -> DataFrame:
    """(cluster, action, canonical_name): link, skip or undecided, by the decision recorded for the signature."""
    signed = members.withColumn("artist_variants_hash", signature_hash(signature(F.col("members"))))
    known = variants.select("artist_variants_hash", "canonical_name", "to_link", F.lit(True).alias("__known"))
    action = F.when(F.col("__known").isNull(), "undecided").when(F.col("to_link"), "link").otherwise("skip")
    return signed.join(known, "artist_variants_hash", "left").select("cluster", action.alias("action"), F.when(action == "link", F.col("canonical_name")).alias("canonical_name"))


def missing_aliases(variants: DataFrame, dim: DataFrame) -> DataFrame:
    """Variants of linked groups that the artist's alias list lacks."""
    aliases = F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda x: F.trim(x))
    met = variants.where("to_link").join(dim.select(F.col("artist_name").alias("canonical_name"), aliases.alias("__have")), "canonical_name")
    own = F.array_except(split_variants(F.col("artist_variants_text")), F.array_union("__have", F.array("canonical_name")))
    return met.select("canonical_name", F.explode(own).alias("alias"))


#: What a record of a group that is not linked has for a canonical name; fixed value.
SKIPPED = "__SKIP__"


def record_decisions(groups: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, groups to decide again) of decisions (cluster, decision, value, part, comment) on groups (cluster, members).

    ``choose`` and ``custom`` link the group to the name in ``value``; without one, and on ``skip``, a record says that the group is not to be
    linked. ``split`` with a ``part`` that is some but not all of the members gives the part and the rest as groups to decide; any other
    part gives the group back as it is. Groups of fewer than two names and those without a decision leave no record.
    """
    met = groups.where(F.size("members") > 1).join(decisions, "cluster").withColumn("__name", F.trim(F.coalesce("value", F.lit(""))))
    link = F.col("decision").isin("choose", "custom") & (F.col("__name") != "")
    text = signature(F.col("members"))
    records = met.where("decision <> 'split'").select(
        signature_hash(text).alias("artist_variants_hash"),
        text.alias("artist_variants_text"),
        F.when(link, F.col("__name")).otherwise(SKIPPED).alias("canonical_name"),
        link.alias("to_link"),
        F.when(F.trim(F.coalesce("comment", F.lit(""))) != "", F.trim("comment")).when(F.col("decision").isin("choose", "custom") & ~link, F.lit("no name given")).alias("comment"),
    )
    part = F.array_sort(F.array_intersect("members", F.coalesce("part", F.array().cast("array<string>"))))
    rest = F.array_sort(F.array_except("members", part))
    whole = (F.size(part) == 0) | (F.size(rest) == 0)
    again = met.where("decision = 'split'").select("cluster", F.explode(F.when(whole, F.array(F.array_sort("members"))).otherwise(F.array(part, rest))).alias("members"))
    return records, again.select("cluster", F.row_number().over(Window.partitionBy("cluster").orderBy("members")).alias("k"), "members")


def rank_forms(pairs: DataFrame, column: str = "name", *, official: DataFrame | None = None, order: DataFrame | None = None) -> DataFrame:
    """A score of each spelling by text rules.

    ``official`` (name): a name that a register has comes before all else. 'és' is better than '&', '&' than spelled-out and; a leading The,
    collaborators as "a, b & c" and special characters count for a form. ``order`` (name, eastern, family, given): the order of a
    person's names that is usual in the artist's country counts for a form.
    """
    c = F.col(column)
    score = (
        F.when(c.rlike(r"\bés\b"), 3).when(c.contains("&"), 2).otherwise(0)
        - F.when(c.rlike(r"(?i)\b(and|und)\b"), 1).otherwise(0)
        + F.when(c.rlike(r"(?i)^the\s"), 1).otherwise(0)
        + F.when(c.rlike(r"^[^,&]+(, [^,&]+)+ & [^,&]+$"), 1).otherwise(0)
        + F.when(c.rlike(r"[^\x00-\x7f]"), 1).otherwise(0)
    )
    out = pairs
    if official is not None:
        out = out.join(official.select(F.col("name").alias(column), F.lit(8).alias("__official")).distinct(), column, "left")
        score = score + F.coalesce("__official", F.lit(0))
    if order is not None:
        usual = F.when(F.col("eastern"), F.concat_ws(" ", "family", "given")).otherwise(F.concat_ws(" ", "given", "family"))
        out = out.join(order.select(usual.alias(column), F.lit(1).alias("__usual")).distinct(), column, "left")
        score = score + F.coalesce("__usual", F.lit(0))
    return out.withColumn("form_score", score).select(*pairs.columns, "form_score")


def clustering_metrics(sims: DataFrame, labels: DataFrame) -> DataFrame:
    """(noise, clusters, silhouette) of a clustering over pair similarities: distance is 1 - sim, absent pairs are at distance 1.

    ``noise``: share of names without a cluster. Silhouette is the mean of (b - a) / max(a, b) over clustered names: a is the mean
    distance within the own cluster, b the least mean distance to another; null with fewer than two clusters.
    """
    both = sims.select("a", "b", "sim").unionByName(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    names = both.select(F.col("a").alias("name")).distinct()
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    own = labels.select(F.col("name").alias("a"), F.col("cluster").alias("ca"))
    met = both.join(own, "a").join(labels.select(F.col("name").alias("b"), F.col("cluster").alias("cb")), "b")
    near = met.groupBy("a", "ca", "cb").agg(F.sum("sim").alias("s")).join(sizes.withColumnRenamed("cluster", "cb"), "cb")
    inside = F.col("ca") == F.col("cb")
    mean = 1 - F.col("s") / F.when(inside, F.col("size") - 1).otherwise(F.col("size"))
    per = near.groupBy("a").agg(F.min(F.when(inside, mean)).alias("in"), F.min(F.when(~inside, mean)).alias("out"))
    per = per.withColumn("out", F.coalesce("out", F.lit(1.0))).select(((F.col("out") - F.col("in")) / F.greatest("in", "out")).alias("s"))
    totals = names.join(labels, "name", "left").agg(F.avg(F.col("cluster").isNull().cast("int")).alias("noise"), F.count_distinct("cluster").alias("clusters"))
    return totals.join(F.broadcast(per.agg(F.avg("s").alias("mean")))).select("noise", "clusters", F.when(F.col("clusters") > 1, F.col("mean")).alias("silhouette"))


#: Levels of likeness at which nearest clusters are looked for, and the clustered names up to which a level costs more than the comparisons it saves (the result is the same).
LEVELS = (0.7, 0.5)
FEW_NAMES = 800


def _silhouette_by_levels(n: DataFrame, labels: DataFrame, least: float, levels: Sequence[float]) -> tuple[DataFrame, int]:
    """((name, in, out), pairs compared): mean distances of each clustered name to its own cluster and to the nearest other one."""
    spark = n.sparkSession
    own = n.join(labels.select("name", "cluster"), "name")
    sizes = own.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    member = own.join(sizes, "cluster").select("name", "k", "n", "l", "cluster", "size")
    member, _ = _cut(member)
    left, right = (member.select(F.col("name").alias(c), F.col("k").alias(f"k{c}"), F.col("cluster").alias(f"c{c}"), F.col("size").alias(f"s{c}")) for c in "ab")
    scored, compared = _scored(left.join(right.withColumnRenamed("cb", "ca"), "ca").where("a < b").select("a", "b", "ka", "kb"), least)
    ends = scored.select(F.col("a").alias("name"), "sim").unionByName(scored.select(F.col("b").alias("name"), "sim"))
    inside = member.where("size > 1").join(ends.groupBy("name").agg(F.sum("sim").alias("s")), "name", "left").select("name", (1 - F.coalesce("s", F.lit(0.0)) / (F.col("size") - 1)).alias("in"))
    open_names, _ = _cut(member.where("size > 1").select("name"))
    settled = []
    for level in (*sorted((x for x in levels if x > least), reverse=True), least):
        asked = member.join(open_names.withColumn("asked", F.lit(True)), "name", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
        of = asked.select("name", "cluster", "asked")
        candidates = similarity.candidate_pairs(asked, level, asked="asked")
        candidates = candidates.join(of.select(F.col("name").alias("a"), F.col("cluster").alias("ca")), "a").join(of.select(F.col("name").alias("b"), F.col("cluster").alias("cb")), "b").where("ca <> cb")
        scored, count = _scored(candidates.select("a", "b", "ka", "kb"), level)
        compared += count
        found = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).join(open_names.withColumnRenamed("name", "a"), "a").join(right, "b")
        near = found.groupBy("a", "cb").agg(F.sum("sim").alias("s"), F.count(F.lit(1)).alias("met"), F.first("sb").alias("size"))
        last = level <= least
        # those not met are less alike than the level, and at the last one are nothing
        near = near.select("a", "cb", "size", "s", (F.col("s") / F.col("size")).alias("low"), ((F.col("s") + (F.col("size") - F.col("met")) * (0.0 if last else level)) / F.col("size")).alias("high"))
        near, _ = _cut(near)
        best = near.groupBy("a").agg(F.max("low").alias("best"))
        if not last:
            # only clusters that may be the nearest, and at least as near as any that was not met
            open_pairs = near.join(best, "a").where((F.col("high") >= F.col("best") - 1e-9) & (F.col("high") >= level))
            rest = open_pairs.where("high > low").join(right, "cb").join(found.select("a", "b"), ["a", "b"], "left_anti").join(left.select("a", "ka"), "a").select("a", "b", "cb", "ka", "kb")
            more, count = _scored(rest, least, "cb")
            compared += count
            exact = open_pairs.select("a", "cb", "s", "size").join(more.groupBy("a", "cb").agg(F.sum("sim").alias("more")), ["a", "cb"], "left")
            best = exact.groupBy("a").agg(F.max((F.col("s") + F.coalesce("more", F.lit(0.0))) / F.col("size")).alias("best")).where(F.col("best") >= level)
        done, _ = _cut(best.select(F.col("a").alias("name"), (1 - F.col("best")).alias("out")))
        settled.append(done)
        open_names, _ = _cut(open_names.join(done, "name", "left_anti"))
        if not open_names.limit(1).count():
            break
    out = reduce(DataFrame.unionByName, settled)
    return inside.join(out, "name", "left").select("name", "in", F.coalesce("out", F.lit(1.0)).alias("out")), compared


def _scored(pairs: DataFrame, least: float, *more: str) -> tuple[DataFrame, int]:
    """((a, b, sim) of pairs (a, b, ka, kb) as like as ``least``, number of pairs compared); compared once and written."""
    rows, _ = _cut(pairs.select("a", "b", *more, similarity.ratio_udf("ka", "kb").alias("sim")))
    return rows.where(F.col("sim") >= least), rows.count()


def name_clustering_metrics(names: DataFrame, column: str, labels: DataFrame, least: float = 0.05, *, sort_tokens: bool = True, levels: Sequence[float] | None = None) -> DataFrame:
    """(noise, clusters, silhouette, compared) as ``clustering_metrics`` of the distinct names' ratios of ``least`` or more, without comparing all of them; ``compared``: pairs compared.

    Names of one cluster are compared with each other. For the nearest other cluster the levels go down: what is met at a level gives bounds on a name's mean
    ratio with each cluster, since members not met are less alike than the level. A cluster whose upper bound is under another's lower one is out; only where the
    bounds do not decide are the other members compared. A name is settled when its nearest cluster is as near as the level, as one of
    which no member was met is farther. ``least`` is the last level, where what is not met is nothing. A name alone in its cluster does not count.
    By default ``LEVELS`` come before it where there are more than ``FEW_NAMES`` clustered names; fewer are one level's work.
    """
    if levels is None:
        levels = LEVELS if labels.limit(FEW_NAMES + 1).count() > FEW_NAMES else ()
    n = similarity.prepared_names(names, column, sort_tokens=sort_tokens)
    far = F.greatest("in", "out")
    per, compared = _silhouette_by_levels(n, labels, least, levels)
    per = per.select(F.when(far == 0, 0.0).otherwise((F.col("out") - F.col("in")) / F.when(far > 0, far)).alias("s"))
    totals = n.select("name").join(labels, "name", "left").agg(F.avg(F.col("cluster").isNull().cast("int")).alias("noise"), F.count_distinct("cluster").alias("clusters"))
    one = totals.join(F.broadcast(per.agg(F.avg("s").alias("mean"))))  # one row
    return one.select("noise", "clusters", F.when(F.col("clusters") > 1, F.col("mean")).alias("silhouette"), F.lit(compared).cast("long").alias("compared"))


def center_metrics(points: DataFrame, label: str, vector: str, *, most_numbers: int = 4_000_000) -> DataFrame:
    """(clusters, weighted_wss, bic) of labelled vectors around their clusters' means; null labels are noise and left out.

    Weighted WSS is the mean squared distance to the own mean. BIC is -2 LL + k d ln n, LL being half the sum of squared distances to the
    nearest mean, negated. The means, checked to be ``most_numbers`` numbers at most, go to every task.
    """
    rows = points.where(F.col(label).isNotNull()).select(F.col(label).alias("l"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    means = rows.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.avg("x").alias("m"))
    shape = means.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if shape > most_numbers:
        raise ValueError(f"means of {shape} numbers; {most_numbers} at most")
    centers = means.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select("l", F.col("c.m").alias("c"))
    every = centers.agg(F.collect_list("c").alias("all"))
    squared = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    met = rows.join(centers, "l").join(F.broadcast(every))  # one row, bounded above
    per = met.select(squared(F.col("v"), F.col("c")).alias("own"), F.array_min(F.transform("all", lambda c: squared(F.col("v"), c))).alias("near"), F.size("v").alias("d"), "l")
    one = per.agg(F.count(F.lit(1)).alias("n"), F.avg("own").alias("weighted_wss"), F.sum("near").alias("near"), F.max("d").alias("d"), F.count_distinct("l").alias("clusters"))
    return one.select("clusters", "weighted_wss", (F.col("near") + F.col("clusters") * F.col("d") * F.log(F.col("n").cast("double"))).alias("bic"))
