"""Document fingerprints: Merkle trees over sections and paragraphs, in DataFrame operations only.

A paragraph's leaves are hashes of short runs of its words. A run ends where the content says, at a word whose own hash is a
multiple of LEAF_WORDS, so a word put in or left out changes the run that it is in and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

#: Words of a leaf, on average.
LEAF_WORDS = 4


def _digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def _leaves(paragraph: Column) -> Column:
    """Hashes of the paragraph's runs of words. A paragraph holds no line end, so one can mark where a run ends."""
    ends = F.transform(F.split(paragraph, " "), lambda w: F.when(F.pmod(F.xxhash64(w), F.lit(LEAF_WORDS)) == 0, F.concat(w, F.lit("\n"))).otherwise(w))
    runs = F.split(F.array_join(ends, " "), "\n")
    return F.transform(runs, lambda r: F.shiftright(F.xxhash64(r), 32).cast("int"))


def tree(text: Column) -> Column:
    """Sections (blank lines part them), each an array of paragraphs (line ends part them) with digest and leaves."""
    paragraph = lambda p: F.struct(F.sha2(p.cast("binary"), 256).alias("digest"), _leaves(p).alias("leaves"))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), paragraph))


def leaf_set(sections: Column) -> Column:
    """Distinct leaves of a tree: what two fingerprints are compared by."""
    return F.array_distinct(F.flatten(F.transform(F.flatten(sections), lambda p: p["leaves"])))


def serialized(sections: Column) -> Column:
    """root[section(paragraph.leaves,...);...]: equal for equal texts; where two differ, the branch shows the place."""
    nodes = F.transform(sections, lambda s: F.struct(_digest(F.transform(s, lambda p: p["digest"])).alias("digest"), s.alias("paragraphs")))
    root = _digest(F.transform(nodes, lambda n: n["digest"]))
    leaf = lambda x: F.lpad(F.hex(F.when(x < 0, x.cast("long") + F.lit(1 << 32)).otherwise(x.cast("long"))), 8, "0")
    branch = lambda p: F.concat(F.left(p["digest"], F.lit(16)), F.lit("."), F.array_join(F.transform(p["leaves"], leaf), ""))
    section = lambda n: F.concat(F.left(n["digest"], F.lit(16)), F.lit("("), F.array_join(F.transform(n["paragraphs"], branch), ","), F.lit(")"))
    return F.concat(root, F.lit("["), F.array_join(F.transform(nodes, section), ";"), F.lit("]"))


def root_of(fingerprint: Column) -> Column:
    return F.substring(fingerprint, 1, 64)


def _sections(fingerprint: Column) -> Column:
    return F.split(F.substring(fingerprint, F.lit(66), F.length(fingerprint) - 66), ";")


def differing_branches(a: Column, b: Column) -> Column:
    """[(section, paragraph)], from 0 and in order: the paragraphs in which two fingerprints differ, or that one of them lacks.

    The descent goes only where digests differ: equal roots are no branch at all, equal sections are not opened. Null for a null fingerprint.
    """

    def differing(x: Column, y: Column) -> Column:
        """(place, p, q) where two arrays differ; past the end of one is null."""
        pairs = F.zip_with(x, y, lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        placed = F.transform(pairs, lambda pq, i: F.struct(i.alias("place"), pq["p"].alias("p"), pq["q"].alias("q")))
        return F.filter(placed, lambda r: ~r["p"].eqNullSafe(r["q"]))

    inside = lambda s: F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.split(F.substring(s, F.lit(18), F.length(s) - 18), ","))
    opened = F.transform(
        differing(_sections(a), _sections(b)),
        lambda s: F.transform(differing(inside(s["p"]), inside(s["q"])), lambda p: F.struct(s["place"].alias("section"), p["place"].alias("paragraph"))),
    )
    return F.when(root_of(a) == root_of(b), F.array().cast("array<struct<section: int, paragraph: int>>")).otherwise(F.flatten(opened))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two leaf sets, 0 to 1."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def fingerprint(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``fingerprint`` and ``leaves``. Null text: empty. A map, with no exchange."""
    keep = [c for c in docs.columns if c not in ("fingerprint", "leaves", "__tree")]
    grown = docs.withColumn("__tree", tree(F.coalesce(F.col(text_col), F.lit(""))))
    return grown.select(*keep, serialized(F.col("__tree")).alias("fingerprint"), leaf_set(F.col("__tree")).alias("leaves"))


def next_ids(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(__id, __next): for every distinct id the next greater one, for the greatest the least; null sorts first.

    Ids are range-partitioned and written once, so that each range is settled; only one row a range meets in one task.
    """
    ids = docs.select(F.col(id_col).alias("__id")).distinct()
    ids = materialize(ids.repartitionByRange(F.col("__id").asc_nulls_first()).select("__id", F.spark_partition_id().alias("__range")), "ids")
    key = F.struct(F.col("__id").isNotNull().alias("there"), F.col("__id").alias("id"))
    in_range = Window.partitionBy("__range").orderBy("__key")
    heads = ids.groupBy("__range").agg(F.min(key).alias("__head"))
    after = Window.orderBy("__range")
    heads = heads.select("__range", F.coalesce(F.lead("__head").over(after), F.first("__head").over(after)).alias("__following"))
    return (
        ids.withColumn("__key", key)
        .withColumn("__lead", F.lead("__key").over(in_range))
        .join(heads, "__range")
        .select("__id", F.coalesce("__lead", "__following")["id"].alias("__next"))
    )


def edit_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edit and of the next text, compared.

    The edit replaces the last floor(n_chars / 4) code points by the first as many (or all) of the next document. Null
    text is empty. Rows that repeat an id share the next greater id's document; of several documents with that id, the
    one whose text hashes least counts. ``n_branches`` paragraphs differ between the two trees, the first at ``first_section`` and
    ``first_paragraph`` (null if none). The text crosses one exchange, by id, which both joins use; what a document needs of the next, a quarter
    text and the leaves, crosses a second. A text's tree is grown on both sides of it: to send it along would take more than to grow it again.
    """
    kind = docs.schema[id_col].dataType
    # ids as two columns without nulls: plain equality keeps the partitioning that a null-safe join would redo
    key = lambda c, there, value: {there: F.col(c).isNotNull(), value: F.coalesce(F.col(c), F.lit(0).cast(kind))}
    own, following = ["__a", "__b"], ["__c", "__d"]
    base = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumns(key("__id", *own))
    base = base.select(*own, "__text").repartition(*own)
    asked = next_ids(docs, id_col).withColumns(key("__id", *own) | key("__next", *following)).select(*own, *following)
    need = docs.withColumns(key(id_col, *own)).groupBy(*own).agg(F.max(F.floor(F.length(F.coalesce(F.col(text_col), F.lit(""))) / 4)).cast("int").alias("__k"))
    asked = asked.join(need, own).withColumnsRenamed({"__a": "__asker_a", "__b": "__asker_b", "__c": "__a", "__d": "__b"})
    first = Window.partitionBy(*own).orderBy(F.xxhash64("__text"))
    given = base.withColumn("__rn", F.row_number().over(first)).where("__rn = 1")
    given = given.join(asked, own).select(
        F.col("__asker_a").alias("__a"),
        F.col("__asker_b").alias("__b"),
        F.substring(F.col("__text"), F.lit(1), F.col("__k")).alias("__head"),
        leaf_set(tree(F.col("__text"))).alias("__next_leaves"),
    )
    n = F.length("__text")
    out = base.join(given, own).select(
        F.when(F.col("__a"), F.col("__b")).alias(id_col),
        n.cast("long").alias("n_chars"),
        "__text",
        F.concat(F.substring("__text", F.lit(1), n - F.floor(n / 4).cast("int")), F.substring("__head", F.lit(1), F.floor(n / 4).cast("int"))).alias("__edited"),
        "__next_leaves",
    )
    out = out.select(id_col, "n_chars", F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"), tree(F.col("__text")).alias("__tree"), tree(F.col("__edited")).alias("__edited_tree"), "__next_leaves")
    out = out.withColumn("__leaves", leaf_set(F.col("__tree"))).withColumn("__edited_leaves", leaf_set(F.col("__edited_tree")))
    out = out.withColumns({"fingerprint": serialized(F.col("__tree")), "edited_fingerprint": serialized(F.col("__edited_tree"))})
    out = out.withColumn("__branches", differing_branches(F.col("fingerprint"), F.col("edited_fingerprint")))
    return out.select(
        id_col,
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("__leaves"), F.col("__edited_leaves")).alias("near_edited"),
        likeness(F.col("__leaves"), F.col("__next_leaves")).alias("near_next"),
        F.size("__branches").alias("n_branches"),
        F.get("__branches", F.lit(0))["section"].alias("first_section"),
        F.get("__branches", F.lit(0))["paragraph"].alias("first_paragraph"),
    )
