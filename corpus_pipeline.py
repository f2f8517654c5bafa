"""A corpus pipeline of five stages, each on all that the one before kept: Parquet in, Parquet out.

For every stage: ids may be null or repeat, rows are judged each for itself; extra columns go, columns of ``documents`` that are absent are
null; an empty table stays empty. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import jaccard_join, line_dedup, mixing, packing, quality
from listenlake.llm.queries import PACKING, tokenizer_path
from listenlake.llm.store import new_path, scope

TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
COLUMNS = list(TYPES)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in TYPES.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those scored under 0.5, null texts and texts without words among them. Equal texts fare alike."""
    return quality.quality_scores(_documents(docs)).where("keep").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen earlier go; a document of which nothing but white space stays goes with them.

    Earlier is by id, nulls first, then row, then line: of equal lines the first stays. Null and empty texts stay as they are.
    """
    rest = line_dedup.dedup_lines(_documents(docs))
    rest = rest.where((F.col("n_removed") == 0) | F.col("kept").rlike(mixing.WORD))
    text = F.col("kept")
    return rest.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays, nulls first; of rows that tie one. Null and empty texts stay, each by itself."""
    docs, kind = line_dedup.numbered(_documents(docs), "doc_id")
    if kind == "long":
        kept = jaccard_join.jaccard_join(docs).where("doc_id = component_id").select("doc_id").distinct()
        return docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").select(*COLUMNS)
    # rows without an id or with a repeated one are told apart by row; the least of a group is by id, nulls first, then row
    docs = docs.withColumn("__key", F.col("__id.row"))
    groups = jaccard_join.jaccard_join(docs, id_col="__key").select("__key", "component_id")
    kept = groups.join(docs.select("__key", "__id"), "__key").groupBy("component_id").agg(F.min("__id").alias("least")).select(F.col("least.row").alias("__key"))
    return docs.join(kept, "__key", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: 0 to 3 times. A null source is one of its own; documents without words share the rate of their source."""
    return mixing.repeated(mixing.mix_sources(_documents(docs)), COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with a checksum of their token ids, in sequences of 2048 tokens. Copies are packed each for itself, null texts as empty ones."""
    return packing.pack_documents(docs, tokenizer_path(), keep={"ids_crc32": F.crc32("ids")}, **PACKING)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

#: SQL cannot train the classifier or tokenize; tests hold the run against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{k}")
        with scope(spark):  # what a stage wrote for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
