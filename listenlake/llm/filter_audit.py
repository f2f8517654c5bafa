"""Interaction audit of filters: what each removes, alone and after the others, in every order they could run in.

A document is one cell of a table of masks: a bit for each filter that it fails. There are no more cells than parts times masks, however
many documents, and all that follows is on cells. They are unpivoted against the steps of every order; a running bit-or along an order tells
which documents of a cell an earlier step has removed, sums under conditions give a step's figures, and a window over a filter's steps
gives its total over all orders.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: What parts words.
BLANK = r"[\x20\x09-\x0D]+"
#: Most filters of an audit: 5040 orders.
MOST_FILTERS = 7


def standard_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, repetitive words, many capitals, symbols. ``text`` must not be null."""
    words = F.array_remove(F.split(text, BLANK), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def label_flags(labels: DataFrame, *, id_col: str = "doc_id", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """(id, good, toxic), one row an id: 1 if any of its labels says so. Rows without an id label nothing."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(one(good).alias("good"), one(bad).alias("toxic"))


def mask_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=standard_filters, repeats: str = "E") -> tuple[DataFrame, str]:
    """((part, mask, n, good, toxic), letters): documents by part and by the filters they fail, bit i of the mask for letter i.

    ``filters`` gives conditions by letter for a text; ``repeats`` names the filter that a text fails which a row with a smaller id
    has, anywhere in the table (empty: no such filter). Texts meet by their SHA-256, so no text is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    conditions = filters(text)
    letters = "".join(conditions) + repeats
    if len(letters) > MOST_FILTERS or len(set(letters)) < len(letters) or any(len(k) != 1 for k in [*conditions, *repeats]):
        raise ValueError(f"filters need different letters, {MOST_FILTERS} at most")
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * (1 << i) for i, c in enumerate(conditions.values())), F.lit(0))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.alias("mask"))
    rows = rows.join(label_flags(labels), "id", "left").na.fill(0, ["good", "toxic"])
    if repeats:
        rows = materialize(rows, "masks")
        # written, so that the join is of two plain exchanges and a text with very many copies can be split
        least = materialize(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least"), "repeated")
        late = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int") * (1 << len(conditions))
        rows = rows.join(least, "digest", "left").withColumn("mask", F.col("mask") + late)
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")), letters


def audit_cells(cells: DataFrame, letters: str) -> DataFrame:
    """A row for each part, order of ``letters`` and step, zeros included, from (part, mask, n, good, toxic)."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = cells.withColumn("filter_order", F.explode(orders)).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit = F.element_at(F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))]), F.col("filter"))
    steps = steps.withColumn("step", F.col("at") + 1).withColumn("bit", bit).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    earlier = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(earlier), F.lit(0)))
    here, gone = (F.col("failed") > 0) & (F.col("earlier") == 0), F.col("earlier") > 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    figures = steps.groupBy("part", "filter_order", "step", "filter").agg(
        total((F.col("failed") == 0) & ~gone).alias("kept"),
        total(here).alias("removed"),
        total((F.col("failed") > 0) & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return figures.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit_filters(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", filters=standard_filters, repeats: str = "E") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of ``docs``.

    A null text is empty, a null part the empty string. Rows without an id repeat no text, nor are they repeated, and have no label; rows that share
    an id and a text repeat each other only from a smaller id on. Rows of ``labels`` that share an id count once, with either's flags. A condition
    that is null is not failed. An empty table has no parts and no rows. Columns but the named ones are not read.
    """
    cells, letters = mask_cells(docs, labels, id_col=id_col, text_col=text_col, part_col=part_col, filters=filters, repeats=repeats)
    return audit_cells(cells, letters)


def shares(audit: DataFrame) -> DataFrame:
    """(part, filter, share): a filter's Shapley value, documents removed on average over all orders."""
    n = F.count(F.lit(1))
    return audit.groupBy("part", "filter").agg((F.max("shapley") / n).alias("share"))
