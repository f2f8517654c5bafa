"""The reference model on the driver's tables: plays, dimensions and small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Literal tables of the adapters; fixed values, repeated in the SQL of the oracles.
TIMELINE = [("HU", "1994-01-01", "1997-06-30"), ("DE", "1997-06-30", "1999-01-01"), ("FR", "1999-09-01", "2001-02-01"), ("AT", "2001-02-01", None)]
VARIANTS = [
    ("hot ring{large rod", "hot ring", True, "2024-01-01"),
    ("small bolt{tiny bolt", "small bolt", True, "2024-01-02"),
    ("hot plate{cold plate", "hot plate", False, "2024-01-03"),
    ("red nut{blue nut", "red nut", None, "2024-01-04"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plays(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    mbid = F.when(F.col("c_mktsegment") == "MACHINERY", None).when(F.col("c_mktsegment") == "FURNITURE", "").otherwise(F.col("c_name"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("artist_name"),
        F.col("c_mktsegment").alias("album_title"),
        F.col("o_orderpriority").alias("track_title"),
        F.col("o_orderdate").alias("play_time"),
        mbid.alias("artist_mbid"),
        F.col("c_nationkey").alias("nation"),
    )


def part_plays(spark: SparkSession, sf: str) -> DataFrame:
    line, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return line.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("artist_name"), F.col("p_brand").alias("album_title"), F.col("p_type").alias("track_title"), F.col("l_shipdate").alias("play_time")
    )


def raw_plays(spark: SparkSession, sf: str) -> DataFrame:
    """API-like rows with epoch seconds; the key repeats and (l_partkey, l_suppkey, uts) tells repeats apart."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("Artist"),
        F.col("l_linenumber").cast("string").alias("Song"),
        F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("Album"),
        F.unix_timestamp(F.date_trunc("year", F.col("l_shipdate").cast("timestamp"))).cast("string").alias("uts"),
        F.when(F.col("l_linenumber") == 1, F.lit(" 5b11f4ce-a62d-471e-81fc-a69a8278c7da ")).when(F.col("l_linenumber") == 2, "X").when(F.col("l_linenumber") == 3, "").alias("artist_mbid"),
        F.col("l_shipdate"),
        "l_partkey",
        "l_suppkey",
    )


def artist_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as artists, each with a second, barer row."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    full = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("artist_name"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.concat(F.lit("m"), F.col("c_custkey").cast("string"))).alias("mbid"),
        F.when(F.col("c_acctbal") > 3000, F.col("c_mktsegment")).alias("disambiguation_comment"),
        F.when(F.col("c_nationkey") < 12, F.concat("c_mktsegment", F.lit(","), "c_name")).otherwise("").alias("aliases"),
        F.when(F.col("c_nationkey") != 6, F.col("n_name")).alias("country"),
    )
    bare = full.select((F.col("id") + 1000000000).alias("id"), "artist_name", F.lit(None).cast("string").alias("mbid"), F.lit("").alias("disambiguation_comment"), F.lit("a").alias("aliases"), "country")
    return full.unionByName(bare)


def country_code(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("iso2"), F.col("n_name").alias("en_name"), F.col("n_regionkey").alias("region"))


def timeline(spark: SparkSession) -> DataFrame:
    rows = [(i + 1, *r) for i, r in enumerate(TIMELINE)]
    return spark.createDataFrame(rows, "id int, country_code string, start_date string, end_date string").withColumns({"start_date": F.to_date("start_date"), "end_date": F.to_date("end_date")})


def brand_names(spark: SparkSession, sf: str) -> DataFrame:
    """(brand, names): the distinct part names of a brand in order, each with the brand before it."""
    name = F.concat_ws(" ", "p_brand", "p_name")
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.array_sort(F.collect_set(name)).alias("names"))


def brand_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Brands' first three names as recorded groups; a third of them are not linked and a third undecided."""
    g, n = brand_names(spark, sf), F.regexp_extract("brand", r"(\d+)$", 1).cast("int")
    text = F.array_join(F.slice("names", 1, 3), "{")
    link = F.when(n % 3 == 0, F.lit(True)).when(n % 3 == 1, F.lit(False))
    return g.select("brand", n.alias("n"), "names", text.alias("artist_variants_text"), F.col("names")[0].alias("canonical_name"), link.alias("to_link"), F.sha2(text.cast("binary"), 256).alias("artist_variants_hash"), F.lit(None).cast("string").alias("comment"), F.lit("2024-01-01").cast("timestamp").alias("timestamp"))


def priority_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as changes of a customer's priority."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderpriority").alias("country_code"), "o_orderkey")


def stays(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a customer's stays of up to forty days; some are open."""
    o = table(spark, sf, "orders")
    start = F.col("o_orderdate").cast("date")
    end = F.when(F.col("o_orderkey") % 97 != 0, F.date_add(start, (F.col("o_orderkey") % 40).cast("int")))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user"), F.col("o_orderstatus").alias("country_code"), start.alias("start_date"), end.alias("end_date"))


def variants(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(VARIANTS, "artist_variants_text string, canonical_name string, to_link boolean, timestamp string")
    return df.withColumns({"artist_variants_hash": F.sha2(F.col("artist_variants_text").cast("binary"), 256), "timestamp": F.col("timestamp").cast("timestamp"), "comment": F.lit(None).cast("string")})


#: The adapters in DuckDB SQL, by the names that the oracles use.
SQL = {
    "plays": """SELECT o_orderkey AS id, c_name AS artist_name, c_mktsegment AS album_title, o_orderpriority AS track_title, o_orderdate AS play_time,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE c_name END AS artist_mbid, c_nationkey AS nation
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "part_plays": "SELECT p_name AS artist_name, p_brand AS album_title, p_type AS track_title, l_shipdate AS play_time FROM lineitem JOIN part ON l_partkey = p_partkey",
    "raw_plays": """SELECT l_orderkey::VARCHAR AS "Artist", l_linenumber::VARCHAR AS "Song", l_partkey || '-' || l_suppkey AS "Album", epoch(date_trunc('year', l_shipdate))::BIGINT AS uts,
        CASE l_linenumber WHEN 1 THEN ' 5b11f4ce-a62d-471e-81fc-a69a8278c7da ' WHEN 2 THEN 'X' WHEN 3 THEN '' END AS artist_mbid, l_shipdate, l_partkey, l_suppkey FROM lineitem""",
    "artist_full": """SELECT c_custkey AS id, c_name AS artist_name, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'm' || c_custkey END AS mbid,
        CASE WHEN c_acctbal > 3000 THEN c_mktsegment END AS disambiguation_comment, CASE WHEN c_nationkey < 12 THEN c_mktsegment || ',' || c_name ELSE '' END AS aliases,
        CASE WHEN c_nationkey <> 6 THEN n_name END AS country FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "artist_dim": "SELECT * FROM artist_full UNION ALL SELECT id + 1000000000, artist_name, NULL, '', 'a', country FROM artist_full",
    "country_code": "SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS iso2, n_name AS en_name, n_regionkey AS region FROM nation",
    "timeline": """SELECT id::INTEGER AS id, country_code, start_date::DATE AS start_date, end_date::DATE AS end_date FROM (VALUES (1, 'HU', '1994-01-01', '1997-06-30'), (2, 'DE', '1997-06-30', '1999-01-01'),
        (3, 'FR', '1999-09-01', '2001-02-01'), (4, 'AT', '2001-02-01', NULL)) t(id, country_code, start_date, end_date)""",
    "brand_names": "SELECT p_brand AS brand, list_sort(list(DISTINCT p_brand || ' ' || p_name)) AS names FROM part GROUP BY ALL",
    "brand_variants": """SELECT brand, regexp_extract(brand, '(\\d+)$', 1)::INTEGER AS n, names, array_to_string(names[:3], '{') AS artist_variants_text, names[1] AS canonical_name,
        CASE regexp_extract(brand, '(\\d+)$', 1)::INTEGER % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS to_link, sha256(array_to_string(names[:3], '{')) AS artist_variants_hash FROM brand_names""",
    "priority_days": "SELECT o_custkey AS user, o_orderdate::DATE AS day, arg_max(o_orderpriority, (o_orderkey, o_orderpriority)) AS country_code FROM orders GROUP BY ALL",
    "priority_starts": "SELECT * FROM (SELECT *, lag(country_code) OVER (PARTITION BY user ORDER BY day) AS before FROM priority_days) WHERE before IS DISTINCT FROM country_code",
    "priority_timelines": "SELECT user, country_code, day AS start_date, lead(day) OVER (PARTITION BY user ORDER BY day) AS end_date FROM priority_starts",
    "stays": """SELECT o_orderkey AS id, o_custkey AS user, o_orderstatus AS country_code, o_orderdate::DATE AS start_date, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderdate::DATE + (o_orderkey % 40)::INTEGER END AS end_date FROM orders""",
    "variants": """SELECT artist_variants_text, canonical_name, to_link, sha256(artist_variants_text) AS artist_variants_hash FROM (VALUES ('hot ring{large rod', 'hot ring', TRUE),
        ('small bolt{tiny bolt', 'small bolt', TRUE), ('hot plate{cold plate', 'hot plate', FALSE), ('red nut{blue nut', 'red nut', NULL)) t(artist_variants_text, canonical_name, to_link)""",
}


def with_adapters(sql: str) -> str:
    """``sql`` with the definitions of the adapters before it."""
    sql = sql.strip()
    opening = next((w for w in ("WITH RECURSIVE ", "WITH ") if sql.startswith(w)), "")
    tables = ", ".join(f"{k} AS ({v})" for k, v in SQL.items())
    return f"{opening or 'WITH '}{tables}{', ' if opening else ' '}{sql[len(opening):]}"
