"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words in a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Targets of sources: (source, source_size) -> the same with weight, target and rate (target / source_size).

    Sources by code point, null last, get ``weights`` in turn and share the sum of all sizes. No target exceeds
    ``cap`` times its source's size; the excess is shared anew by weight until none is above. That fixed point needs
    no iteration: with sources sorted by cap / weight, those at their cap are a prefix, and prefix sums give the level
    of the rest. The sorts are over one row a source, never over documents. Empty sources get target 0.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    w = (
        sizes.withColumn("__i", (F.row_number().over(order) - 1) % len(weights))
        .withColumn("weight", F.element_at(turn, (F.col("__i") + 1).cast("int")))
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    )
    by_level = Window.orderBy(F.col("__cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    w = (
        w.withColumn("__total", F.sum(F.col("source_size").cast("double")).over(all_rows))
        .withColumn("__weights", F.sum("weight").over(all_rows))
        .withColumn("__caps_before", F.coalesce(F.sum("__cap").over(upto), F.lit(0.0)))
        .withColumn("__weights_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("__level", (F.col("__total") - F.col("__caps_before")) / (F.col("__weights") - F.col("__weights_before")))
        .withColumn("__full", F.col("__cap") <= F.col("weight") * F.col("__level"))
        .withColumn("__free_level", F.min(F.when(~F.col("__full"), F.struct("__weights_before", "__level"))).over(all_rows)["__level"])
    )
    target = F.when(F.col("__full"), F.col("__cap")).otherwise(F.col("weight") * F.col("__free_level"))
    return w.withColumn("target", target).select(
        "source",
        "source_size",
        "weight",
        "target",
        F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0)).alias("rate"),
    )


def source_offset(source: Column, seed: int) -> Column:
    """The random offset of a source, in [0, 1): the same in every run with the same seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("double") / float(1 << 52)


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: int = 11,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All rows of ``docs`` (``columns`` of them, default all) with ``size``, ``source_size``, ``target``, ``copies``.

    Systematic sampling: within a source, documents lie on a line in order of size; each takes a stretch of its expected
    copies (its source's rate), one offset drawn for the source shifts the line, and a document gets a copy for each
    integer boundary in its stretch. As the order is by size, taken words differ from the target by no more than about
    the size of the largest document of the source. ``copies`` never exceeds ceil(cap).

    Positions come from counts: (source, size) groups, 256 hash blocks in each, and the rank in a block. So no
    task sorts a whole source, the text moves in one exchange at most, and a rerun gives the same copies. Null text is
    empty (size 0), null source is a source of its own, rows without an id or with a repeated one are told apart by their text, repeated rows count
    each for itself. Extra columns are carried; columns named like the results are replaced.
    """
    made = ("size", "source_size", "target", "copies")
    keep = [c for c in (columns if columns is not None else docs.columns) if c not in made]
    base = docs.select(
        *[F.col(c) for c in keep],
        F.struct(F.col(source_col).alias("source")).alias("__s"),
        n_words(F.col(text_col)).alias("size"),
        # rows without an id are dealt and ordered by their text
        F.left(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), F.lit(2)).alias("__block"),
        F.col(id_col).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__tie"),
    )
    cells = base.groupBy("__s", "size", "__block").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("__s", "size").agg(F.sum("n").alias("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_size = Window.partitionBy("__s").orderBy("size")
    groups = groups.withColumn("__from", F.coalesce(F.sum("n").over(before(by_size)), F.lit(0))).drop("n")
    sources = groups_sizes(cells)
    targets = source_targets(sources, weights, cap).select(
        F.struct("source").alias("__s"), "source_size", "target", "rate", source_offset(F.col("source"), seed).alias("__offset")
    )
    by_block = Window.partitionBy("__s", "size").orderBy("__block")
    cells = (
        cells.withColumn("__in", F.coalesce(F.sum("n").over(before(by_block)), F.lit(0)))
        .join(groups, ["__s", "size"])
        .join(targets, "__s")
        .select("__s", "size", "__block", (F.col("__from") + F.col("__in")).alias("__before"), "source_size", "target", "rate", "__offset")
    )
    rank = Window.partitionBy("__s", "size", "__block").orderBy(F.col("__id").asc_nulls_first(), "__tie")
    at = F.col("__before") + F.col("__rank")
    copies = F.floor(at * F.col("rate") + F.col("__offset")) - F.floor((at - 1) * F.col("rate") + F.col("__offset"))
    return (
        base.withColumn("__rank", F.row_number().over(rank))
        .join(cells, ["__s", "size", "__block"])
        .select(*keep, "size", "source_size", "target", copies.cast("long").alias("copies"))
    )


def groups_sizes(cells: DataFrame) -> DataFrame:
    return cells.groupBy("__s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).select(F.col("__s.source").alias("source"), "source_size")


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself: each row ``copies`` times."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(*columns)
