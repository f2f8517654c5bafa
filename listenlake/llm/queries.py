"""Registered queries of the operators, with production parameters over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, filter_audit, fingerprints, jaccard_join, license_scan, line_dedup, mixing, packing, quality, substring_dedup, suffix_dedup, url_filter, whitening

#: (verdict, host, path); fixed values of the query's contract.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_fingerprints(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark, URL_RULES))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_removed", "kept_sha256")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.metric_join(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Capacities and weights of packing: a sequence's documents are masked from each other, by a table of this many entries; tokens
#: count first, what is left of the other two decides between sequences that fit alike.
PACKING = {"most_docs": 512, "most_cost": 2048.0**2, "weights": (1.0, 0.05, 0.05)}


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), keep={"ids_crc32": F.crc32("ids")}, **PACKING)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "weak", "quality", "keep")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), columns=("doc_id",))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_fingerprints": op2_fingerprints,
    "op3_url_filter": op3_url_filter,
    "op4_line_dedup": op4_line_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_pack": op7_pack,
    "op8_quality": op8_quality,
    "op9_mix_sources": op9_mix_sources,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}

SQL: dict[str, str] = {
    "op3_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*', 0, 's') AS path
            FROM cut
        ), rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fits AS (
            SELECT page_id, max_by(struct_pack(r := h || p, v := v), length(h || p)) AS best
            FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
            GROUP BY page_id
        )
        SELECT parts.page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict
        FROM parts LEFT JOIN fits USING (page_id)
    """,
    "op9_mix_sources": r"""
        WITH base AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
        ), sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source
        ), weighed AS (
            SELECT *, 3.0::DOUBLE * source_size AS cap,
                   [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight
            FROM sizes
        ), levels AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER upto, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0)) AS level
            FROM weighed
            WINDOW upto AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), free AS (
            SELECT min_by(level, cap / weight) AS level FROM levels WHERE cap > weight * level
        ), targets AS (
            SELECT l.source, source_size, CASE WHEN cap <= weight * l.level THEN cap ELSE weight * free.level END AS target FROM levels l, free
        ), rated AS (
            SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0.0 END AS rate,
                   ('0x' || substr(md5('11:' || coalesce('s' || source, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u
            FROM targets
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, substr(md5(doc_id::VARCHAR), 1, 2), doc_id) AS place FROM base
        )
        SELECT doc_id, size, source_size, target, (size * (floor(place * rate + u) - floor((place - 1) * rate + u)))::BIGINT AS taken
        FROM placed JOIN rated ON placed.source IS NOT DISTINCT FROM rated.source
    """,
    "op13_filter_audit": r"""
        WITH split AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), flags AS (
            SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id
        ), masks AS (
            SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
                   + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
                   + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask
            FROM split
        ), cells AS (
            SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
            FROM masks LEFT JOIN flags USING (doc_id) GROUP BY part, mask
        ), f(c, bit) AS (
            VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
        ), orders AS (
            SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
            FROM f p JOIN f q ON q.c <> p.c JOIN f r ON r.c NOT IN (p.c, q.c) JOIN f s ON s.c NOT IN (p.c, q.c, r.c) JOIN f t ON t.c NOT IN (p.c, q.c, r.c, s.c)
        ), steps AS (
            SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM orders, range(1, 6) x(step)
        ), figures AS (
            SELECT part, filter_order, step, bit,
                   sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                   sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
                   sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
                   sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM cells, steps GROUP BY ALL
        )
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
        FROM figures
    """,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
