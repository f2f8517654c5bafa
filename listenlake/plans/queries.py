"""One query for each operator of the reference's kind, on the adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..functions import text
from ..operators import canon, counts, forest, integrity, joins, ml, normalize, quality, similarity, sketches, stats, temporal, timelines
from ..sources import manifest, provider, readers
from ..streaming import incremental, stateful
from . import adapters as A
from .registry import query

_YEARS = list(range(1995, 2002))
_SUBSTRING_CASES = [("ring", "rings"), ("rod", "rods"), ("bolt", "bolts"), ("hot", "hot"), ("cold", "cold"), ("blue", "blue")]


# counts and rankings


@query("SELECT id, artist_name, track_title, play_time FROM plays ORDER BY play_time DESC, id LIMIT 5")
def most_recent(spark: SparkSession, sf: str) -> DataFrame:
    return counts.top(A.plays(spark, sf).select("id", "artist_name", "track_title", "play_time"), 5, F.desc("play_time"), F.asc("id"))


@query("SELECT artist_name, count(*) AS plays FROM plays WHERE artist_name IS NOT NULL GROUP BY artist_name")
def artist_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.value_counts(A.plays(spark, sf), "artist_name")


@query("SELECT artist_name, count(*) AS plays FROM part_plays GROUP BY artist_name ORDER BY plays DESC, artist_name LIMIT 15")
def top_n_artists(spark: SparkSession, sf: str) -> DataFrame:
    return counts.top(counts.value_counts(A.part_plays(spark, sf), "artist_name"), 15, *counts.by_count("plays", "artist_name"))


@query("SELECT row_number() OVER (ORDER BY count(*) DESC, artist_name)::INTEGER AS rank, artist_name, count(*) AS plays FROM plays GROUP BY artist_name ORDER BY rank LIMIT 10")
def top_artists(spark: SparkSession, sf: str) -> DataFrame:
    return counts.ranked_filter(A.plays(spark, sf), "artist_name", "", 10)


@query(
    """SELECT artist_name, count(*) AS plays FROM plays JOIN nation ON nation = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)
    GROUP BY artist_name ORDER BY plays DESC, artist_name LIMIT 10"""
)
def top_artists_one_country(spark: SparkSession, sf: str) -> DataFrame:
    nation = A.table(spark, sf, "nation")
    one = nation.join(F.broadcast(nation.agg(F.min("n_name").alias("n_name"))), "n_name")  # one row
    here = A.plays(spark, sf).join(one, F.col("nation") == F.col("n_nationkey"))
    return counts.top(counts.value_counts(here, "artist_name"), 10, *counts.by_count("plays", "artist_name"))


@query("SELECT n_name AS country, count(*) AS plays FROM plays JOIN nation ON nation = n_nationkey GROUP BY n_name ORDER BY plays DESC, country LIMIT 20")
def top_countries(spark: SparkSession, sf: str) -> DataFrame:
    named = A.plays(spark, sf).join(A.table(spark, sf, "nation"), F.col("nation") == F.col("n_nationkey")).withColumnRenamed("n_name", "country")
    return counts.top(counts.value_counts(named, "country"), 20, *counts.by_count("plays", "country"))


@query(
    """WITH c AS (SELECT n_name AS country, artist_name, count(*) AS plays FROM plays JOIN nation ON nation = n_nationkey GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY plays DESC, artist_name)::INTEGER AS rank, plays * 100.0::DOUBLE / sum(plays) OVER (PARTITION BY country) AS share FROM c)
    SELECT country, artist_name, plays, rank, share FROM r WHERE rank <= 5"""
)
def top_artists_per_country(spark: SparkSession, sf: str) -> DataFrame:
    named = A.plays(spark, sf).join(A.table(spark, sf, "nation"), F.col("nation") == F.col("n_nationkey")).withColumnRenamed("n_name", "country")
    return counts.top_per_group(counts.value_counts(named, "country", "artist_name"), "country", "artist_name", 5)


def _ranked(table: str, key: str, like: str, limit: str = "LIMIT 10") -> str:
    return f"""WITH r AS (SELECT row_number() OVER (ORDER BY count(*) DESC, {key})::INTEGER AS rank, {key}, count(*) AS plays FROM {table} WHERE {key} IS NOT NULL GROUP BY {key})
    SELECT * FROM r WHERE contains({key}, '{like}') ORDER BY rank {limit}"""


@query(_ranked("part_plays", "artist_name", "ring"))
def ranked_filter_artist(spark: SparkSession, sf: str) -> DataFrame:
    return counts.ranked_filter(A.part_plays(spark, sf), "artist_name", "ring")


@query(_ranked("part_plays", "album_title", "#1"))
def ranked_filter_album(spark: SparkSession, sf: str) -> DataFrame:
    return counts.ranked_filter(A.part_plays(spark, sf), "album_title", "#1")


@query(_ranked("part_plays", "track_title", "O"))
def ranked_filter_track(spark: SparkSession, sf: str) -> DataFrame:
    return counts.ranked_filter(A.part_plays(spark, sf), "track_title", "O")


@query(_ranked("plays", "track_title", "-", ""))
def ranked_filter_char(spark: SparkSession, sf: str) -> DataFrame:
    return counts.ranked_filter(A.plays(spark, sf), "track_title", "-", None)


@query(
    """WITH t AS (SELECT strftime(play_time, '%Y-%m-%d %H:%M:%S') AS play_text FROM plays)
    SELECT row_number() OVER (ORDER BY count(*) DESC, play_text)::INTEGER AS rank, play_text, count(*) AS plays FROM t WHERE contains(play_text, ';') OR contains(play_text, '-29 ') GROUP BY play_text"""
)
def malformed_time(spark: SparkSession, sf: str) -> DataFrame:
    t = A.plays(spark, sf).select(F.date_format("play_time", "yyyy-MM-dd HH:mm:ss").alias("play_text"))
    odd = t.where(F.col("play_text").contains(";") | F.col("play_text").contains("-29 "))
    return counts.ranked_filter(odd, "play_text", "", None)


@query("SELECT DISTINCT artist_name FROM part_plays WHERE contains(artist_name, 'anvil')")
def name_contains_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return A.part_plays(spark, sf).where(F.col("artist_name").contains("anvil")).select("artist_name").distinct()


@query(
    "SELECT bucket, count(*) AS plays FROM (SELECT CASE "
    + " ".join(f"WHEN contains(artist_name, '{a}') THEN '{b}'" for a, b in _SUBSTRING_CASES)
    + " END AS bucket FROM part_plays) WHERE bucket IS NOT NULL GROUP BY bucket"
)
def case_bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.case_buckets(A.part_plays(spark, sf), "artist_name", _SUBSTRING_CASES)


@query(
    """SELECT p_partkey, p_name FROM part WHERE (p_name IN ('hot ring', 'red nut', 'blue rod') OR regexp_matches(p_name, '(?i)GIZMO|anvil')) AND NOT regexp_matches(p_name, '(?i)small|LARGE')"""
)
def regex_isin_filter(spark: SparkSession, sf: str) -> DataFrame:
    return counts.regex_or_member(A.table(spark, sf, "part"), "p_name", ["hot ring", "red nut", "blue rod"], "GIZMO|anvil", "small|LARGE").select("p_partkey", "p_name")


@query("SELECT year(play_time)::INTEGER AS year, count(track_title) AS plays FROM plays GROUP BY ALL")
def plays_per_year(spark: SparkSession, sf: str) -> DataFrame:
    return counts.counts_by_year(A.plays(spark, sf))


@query("SELECT year(play_time)::INTEGER AS year, month(play_time)::INTEGER AS month, count(track_title) AS plays FROM plays GROUP BY ALL")
def plays_per_year_month(spark: SparkSession, sf: str) -> DataFrame:
    return counts.counts_by_year(A.plays(spark, sf), "track_title", "play_time", F.month("play_time").alias("month"))


@query("SELECT month(play_time)::INTEGER AS month, count(track_title)::DOUBLE / (SELECT count(DISTINCT year(play_time)) FROM plays) AS avg_plays FROM plays GROUP BY ALL")
def avg_plays_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return counts.average_by_month(A.plays(spark, sf))


_YEARLY = "SELECT year(play_time)::INTEGER AS year, artist_name, count(track_title) AS plays FROM plays GROUP BY ALL"


def _yearly(spark: SparkSession, sf: str) -> DataFrame:
    return counts.counts_by_year(A.plays(spark, sf), "track_title", "play_time", F.col("artist_name"))


@query(_YEARLY)
def artist_year_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _yearly(spark, sf)


@query(f"WITH y AS ({_YEARLY}) SELECT artist_name, " + ", ".join(f"coalesce(sum(plays) FILTER (year = {y}), 0)::BIGINT AS y{y}" for y in _YEARS) + " FROM y GROUP BY artist_name")
def artist_year_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return counts.pivot_years(_yearly(spark, sf), "artist_name", _YEARS)


_EVERY = f"y AS ({_YEARLY}), every AS (SELECT artist_name FROM y GROUP BY artist_name HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM y))"


@query(f"WITH {_EVERY} SELECT artist_name FROM every")
def present_every_year(spark: SparkSession, sf: str) -> DataFrame:
    return counts.present_in_all(_yearly(spark, sf), "artist_name", "year")


def _companions(spark: SparkSession, sf: str) -> DataFrame:
    y = _yearly(spark, sf)
    return y.join(counts.present_in_all(y, "artist_name", "year"), "artist_name", "left_semi")


@query(
    f"""WITH {_EVERY}, s AS (SELECT artist_name, avg(plays) AS mean, stddev_pop(plays) AS std, round(stddev_pop(plays) / avg(plays), 12) AS cv FROM y WHERE artist_name IN (FROM every) GROUP BY artist_name)
    SELECT * FROM s WHERE cv <= (SELECT quantile_cont(cv, 0.25) FROM s)"""
)
def trusted_companions_cv(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.steady_by_cv(_companions(spark, sf), "artist_name")


@query(f"WITH {_EVERY} SELECT artist_name, stddev_samp(plays) AS std, sum(plays)::BIGINT AS plays FROM y WHERE artist_name IN (FROM every) GROUP BY artist_name ORDER BY round(std, 9) NULLS LAST, artist_name LIMIT 10")
def trusted_companions_std(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.steady_by_std(_companions(spark, sf), "artist_name")


_PCT = f"""{_EVERY}, t AS (SELECT * FROM y WHERE artist_name IN (FROM every)), p AS (SELECT artist_name, year, plays, (rank() OVER (PARTITION BY year ORDER BY plays)
    + (count(*) OVER (PARTITION BY year, plays) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY year) * 100 AS pct FROM t)"""


@query(f"WITH {_PCT} SELECT * FROM p")
def yearly_percentile_rank(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.percentile_rank(_companions(spark, sf), "year", "plays")


@query(
    f"""WITH {_PCT}, s AS (SELECT artist_name, min(pct) AS low, avg(pct) AS mean_pct FROM p GROUP BY artist_name), x AS (SELECT t::INTEGER AS threshold, artist_name, mean_pct,
    row_number() OVER (PARTITION BY t ORDER BY round(mean_pct, 9) DESC, artist_name) AS rn FROM s, (VALUES (5), (10), (25), (50)) v(t) WHERE low >= t) SELECT threshold, artist_name, mean_pct FROM x WHERE rn <= 5"""
)
def consistent_above_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.consistent_above(temporal.percentile_rank(_companions(spark, sf), "year", "plays"), "artist_name", [5, 10, 25, 50])


@query(
    """WITH c AS (SELECT artist_name, count(*) AS plays FROM plays GROUP BY ALL) SELECT count(plays) AS n, avg(plays) AS mean, stddev_samp(plays) AS std, min(plays) AS min,
    quantile_cont(plays, 0.25) AS p25, quantile_cont(plays, 0.5) AS p50, quantile_cont(plays, 0.75) AS p75, max(plays) AS max FROM c"""
)
def artist_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return counts.describe(counts.value_counts(A.plays(spark, sf), "artist_name"), "plays")


@query(
    """WITH c AS (SELECT artist_name, count(*) AS plays FROM plays GROUP BY ALL) SELECT (10 ** (length(plays::VARCHAR) - 1))::BIGINT AS bin,
    count(*) AS artists FROM c GROUP BY ALL"""
)
def count_bins(spark: SparkSession, sf: str) -> DataFrame:
    c = counts.value_counts(A.plays(spark, sf), "artist_name").withColumn("bin", counts.decade_bin(F.col("plays")))
    return c.groupBy("bin").agg(F.count(F.lit(1)).alias("artists"))


@query(
    """WITH p AS (SELECT nation, count(*) AS plays FROM plays GROUP BY ALL), c AS (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY ALL)
    SELECT n_name AS country, plays, people, plays * 1000000.0::DOUBLE / people AS per_million FROM p JOIN c ON nation = c_nationkey JOIN nation n ON p.nation = n_nationkey ORDER BY per_million DESC, country LIMIT 10"""
)
def per_capita(spark: SparkSession, sf: str) -> DataFrame:
    p = counts.value_counts(A.plays(spark, sf), "nation")
    people = A.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    met = p.join(people, F.col("nation") == F.col("c_nationkey")).join(A.table(spark, sf, "nation"), F.col("nation") == F.col("n_nationkey"))
    out = met.select(F.col("n_name").alias("country"), "plays", "people", F.try_divide(F.col("plays") * 1000000.0, "people").alias("per_million"))
    return counts.top(out, 10, F.desc("per_million"), F.asc("country"))


@query(
    """WITH c AS (SELECT nation, count(*) AS plays, count(DISTINCT artist_name) AS artists FROM plays GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY plays DESC, nation) AS a,
    row_number() OVER (ORDER BY artists DESC, nation) AS b FROM c) SELECT nation, plays, artists, CASE WHEN a <= 5 THEN 'plays' ELSE 'artists' END AS label FROM r WHERE a <= 5 OR b <= 5"""
)
def label_priority(spark: SparkSession, sf: str) -> DataFrame:
    c = A.plays(spark, sf).groupBy("nation").agg(F.count(F.lit(1)).alias("plays"), F.count_distinct("artist_name").alias("artists"))
    return counts.label_priority(c, ["plays", "artists"], 5, "nation")


@query(
    """WITH p AS (SELECT nation, count(*) AS plays FROM plays GROUP BY ALL), c AS (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY ALL)
    SELECT corr(people, plays) AS r, regr_slope(plays, people) AS slope, regr_intercept(plays, people) AS intercept FROM p JOIN c ON nation = c_nationkey"""
)
def population_trend(spark: SparkSession, sf: str) -> DataFrame:
    p = counts.value_counts(A.plays(spark, sf), "nation")
    people = A.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("people"))
    return stats.regression(p.join(people, F.col("nation") == F.col("c_nationkey")), "people", "plays")


@query(
    """WITH t AS (SELECT artist_name, album_title, track_title FROM part_plays) SELECT (SELECT arg_min(artist_name, (-c, artist_name)) FROM (SELECT artist_name, count(*) AS c FROM t GROUP BY ALL)) AS top_artist,
    (SELECT arg_min(album_title, (-c, album_title)) FROM (SELECT album_title, count(*) AS c FROM t GROUP BY ALL)) AS top_album,
    (SELECT arg_min(track_title, (-c, track_title)) FROM (SELECT track_title, count(*) AS c FROM t GROUP BY ALL)) AS top_track, (SELECT count(*) FROM t) AS plays"""
)
def profile_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    t = A.part_plays(spark, sf)
    out = t.agg(F.count(F.lit(1)).alias("plays"))
    for column, name in (("artist_name", "top_artist"), ("album_title", "top_album"), ("track_title", "top_track")):
        best = counts.value_counts(t, column).agg(F.min(F.struct(-F.col("plays"), F.col(column).alias("key"))).alias("b")).select(F.col("b.key").alias(name))
        out = out.join(F.broadcast(best))  # one row
    return out


# quality

_COLUMNS = ["artist_name", "mbid", "disambiguation_comment", "aliases", "country"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (coalesce(trim({c}), '') <> '') AS filled, count(*) AS total, round(count(*) FILTER (coalesce(trim({c}), '') <> '')::DOUBLE / count(*) * 100, 2) AS percent FROM artist_dim"
        for c in _COLUMNS
    )
)
def column_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return quality.completeness(A.artist_dim(spark, sf), _COLUMNS)


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, count(*) AS total, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS null_percent FROM artist_dim" for c in _COLUMNS
    )
)
def null_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.null_stats(A.artist_dim(spark, sf), _COLUMNS)


_SKETCHED, _MEASURED = ["l_partkey", "l_returnflag"], ["l_quantity", "l_extendedprice"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS filled, {f'min({c})::DOUBLE' if c in _MEASURED else 'NULL::DOUBLE'} AS low, {f'max({c})::DOUBLE' if c in _MEASURED else 'NULL::DOUBLE'} AS high, "
        f"{f'round(avg({c}), 4)' if c in _MEASURED else 'NULL::DOUBLE'} AS mean, true AS distinct_close, {'true' if c in _MEASURED else 'NULL::BOOLEAN'} AS quantiles_close FROM lineitem"
        for c in [*_SKETCHED, *_MEASURED]
    )
)
def sketched_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Columns from sketches of months, merged; whether the estimates keep their bounds is judged on all rows."""
    line = A.table(spark, sf, "lineitem")
    found = store.materialize(sketches.profile(sketches.month_sketches(line, "l_shipdate", _SKETCHED, _MEASURED)), "profile")
    judged = sketches.audit(line, found, [*_SKETCHED, *_MEASURED])
    return found.select("column", "rows", "filled", "low", "high", F.round("mean", 4).alias("mean")).join(judged, "column")


@query(
    "SELECT date_trunc('month', l_shipdate)::DATE AS month, count(*) AS rows, count(l_quantity) AS filled, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY 1"
)
def sketched_months(spark: SparkSession, sf: str) -> DataFrame:
    """The exact part of the sketches of one number, month by month."""
    months = sketches.profile(sketches.month_sketches(A.table(spark, sf, "lineitem"), "l_shipdate", [], ["l_quantity"]), "month")
    return months.select("month", "rows", "filled", "low", "high", F.round("mean", 4).alias("mean"))


@query("SELECT avg((mbid IS NULL)::INTEGER) * 100 AS missing_percent FROM artist_dim")
def missing_value_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_ratio(A.artist_dim(spark, sf), "mbid")


@query("SELECT count(*) AS missing, count(DISTINCT artist_name) AS artists FROM plays WHERE artist_mbid IS NULL OR artist_mbid = ''")
def missing_key_count(spark: SparkSession, sf: str) -> DataFrame:
    return A.plays(spark, sf).where(text.empty(F.col("artist_mbid"))).agg(F.count(F.lit(1)).alias("missing"), F.count_distinct("artist_name").alias("artists"))


@query("SELECT count(*) AS total, count(*) FILTER (aliases IS NULL OR aliases = '') AS without, count(*) FILTER (aliases <> '') AS \"with\" FROM artist_dim")
def alias_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return quality.alias_coverage(A.artist_dim(spark, sf), "aliases")


@query("SELECT l_type AS track_title, count(*) AS plays FROM (SELECT track_title AS l_type FROM part_plays) WHERE length(trim(l_type)) < 6 GROUP BY ALL")
def short_titles(spark: SparkSession, sf: str) -> DataFrame:
    return quality.short_values(A.part_plays(spark, sf), "track_title", 6)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, copies FROM (SELECT l_orderkey, l_linenumber, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies FROM lineitem) WHERE copies > 1"""
)
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return quality.duplicate_keys(A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber"])


_PROBES = [("artist_name", "hot, ring", "hot ring"), ("track_title", "ECO,NOMY", "ECONOMY"), ("album_title", "Brand#2", "Brand2")]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, '{a}' AS value, '{b}' AS plain, count(*) FILTER ({c} = '{a}') AS n_value, count(*) FILTER ({c} = '{b}') AS n_plain FROM part_plays" for c, a, b in _PROBES
    )
)
def comma_probe(spark: SparkSession, sf: str) -> DataFrame:
    return quality.probe_values(A.part_plays(spark, sf), _PROBES)


@query(
    """WITH chars AS (SELECT i::INTEGER AS ascii_code, chr(i::INTEGER) AS ascii_char FROM range(33, 127) t(i) WHERE NOT regexp_matches(chr(i::INTEGER), '[0-9A-Za-z]')), u AS (SELECT DISTINCT url FROM pages)
    SELECT ascii_code, ascii_char, count(url) AS n FROM chars LEFT JOIN u ON contains(url, ascii_char) GROUP BY ALL"""
)
def ascii_char_freq(spark: SparkSession, sf: str) -> DataFrame:
    return quality.char_frequency(A.table(spark, sf, "pages"), "url", quality.special_chars(spark))


# normalising

_NORMAL = """SELECT "Artist" AS artist_name, "Album" AS album_title, to_timestamp(uts)::TIMESTAMP AS play_time, "Song" AS track_title,
    CASE WHEN regexp_matches(trim(artist_mbid), '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') THEN trim(artist_mbid) END AS artist_mbid
    FROM (SELECT *, row_number() OVER (PARTITION BY "Artist", "Song", uts ORDER BY l_partkey, l_suppkey, l_shipdate) AS rn FROM raw_plays) WHERE rn = 1"""


@query(_NORMAL)
def normalize_plays(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.normalize_plays(A.raw_plays(spark, sf), "l_partkey", "l_suppkey", "l_shipdate").withColumn("play_time", F.col("play_time").cast("timestamp_ntz"))


@query("SELECT DISTINCT artist_name, album_title, track_title, play_time FROM part_plays")
def dedup_plays(spark: SparkSession, sf: str) -> DataFrame:
    return A.part_plays(spark, sf).dropDuplicates()


@query(
    """SELECT l_orderkey::VARCHAR AS artist_name, l_partkey || '-' || l_suppkey AS album_title, l_linenumber::VARCHAR AS track_title FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1"""
)
def parquet_merge_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    line = A.table(spark, sf, "lineitem")
    rows = line.select(
        F.col("l_orderkey").cast("string").alias("artist_name"), F.concat(F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("album_title"),
        F.col("l_linenumber").cast("string").alias("track_title"), "l_returnflag", "l_shipdate", "l_partkey", "l_suppkey",
    )
    old, new = rows.where("l_returnflag <> 'R'"), rows.where("l_returnflag = 'R'")
    merged = normalize.merge_keep_last(old, new, [["artist_name", "track_title"]], F.desc("l_shipdate"), F.desc("l_partkey"), F.desc("l_suppkey"))
    return merged.select("artist_name", "album_title", "track_title")


@query("SELECT artist_name, album_title, play_time, track_title, artist_mbid FROM plays")
def schema_repair(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.repair_schema(A.plays(spark, sf))


@query("SELECT event_id, event_type, (props->>'$.k')::BIGINT AS k, coalesce(props->>'$.missing', '') AS missing FROM events")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    p = F.from_json("props", "k long, missing string")
    return A.table(spark, sf, "events").select("event_id", "event_type", p["k"].alias("k"), F.coalesce(p["missing"], F.lit("")).alias("missing"))


@query("SELECT brand, names AS parts FROM brand_names")
def split_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a brand written as one text, with blanks and empty places between, and split again."""
    texts = A.brand_names(spark, sf).select("brand", F.concat(F.lit("{ "), F.array_join("names", " { ")).alias("t"))
    return texts.select("brand", text.split_variants(F.col("t")).alias("parts"))


@query(
    """WITH g AS (SELECT p_brand, list(DISTINCT p_name) AS names FROM part GROUP BY ALL), s AS (SELECT p_brand, array_to_string(list_sort(list_filter(list_transform(names, lambda x: trim(x)), lambda x: x <> '')), '{') AS sig FROM g)
    SELECT p_brand, sig, sha256(sig) AS hash FROM s"""
)
def variant_signature(spark: SparkSession, sf: str) -> DataFrame:
    g = A.table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    return g.select("p_brand", text.signature(F.col("names")).alias("sig")).withColumn("hash", text.signature_hash(F.col("sig")))


@query(
    """WITH g AS (SELECT p_brand, list_transform(list_sort(list(DISTINCT p_name)), lambda x: length(x)) AS n FROM part GROUP BY ALL), u AS (SELECT p_brand, unnest(n) AS k FROM g)
    SELECT p_brand, sum(k)::BIGINT AS sig_len, count(*) AS n_variants, avg(k) AS avg_len, max(k)::BIGINT AS max_len, stddev_pop(k) AS var_len FROM u GROUP BY p_brand"""
)
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = A.table(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "{").alias("joined"))
    return g.select("p_brand", text.length_stats(F.col("joined")).alias("s")).select("p_brand", "s.*")


@query(
    """WITH n AS (SELECT DISTINCT url AS name FROM pages), s AS (SELECT name, trim(regexp_replace(replace(replace(replace(replace(name, ' - ', '_minus_'), ' + ', '_plus_'), ' * ', '_mul_'), ' / ', '_div_'), '[^0-9A-Za-z_]+', '_', 'g'), '_') AS base FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY name) - 1 AS k FROM s) SELECT name, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS clean FROM r"""
)
def sanitize_names(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.unique_names(A.table(spark, sf, "pages").select(F.col("url").alias("name")).distinct(), "name").select("name", "clean")


# joins


@query("SELECT id, artist_name, coalesce(country, 'unknown') AS country FROM plays LEFT JOIN (SELECT artist_name, country FROM artist_full) USING (artist_name)")
def artist_country_lookup(spark: SparkSession, sf: str) -> DataFrame:
    dim = integrity.best_record(A.artist_dim(spark, sf))
    return joins.lookup(A.plays(spark, sf).select("id", "artist_name"), dim, "artist_name", "country", F.lit("unknown")).select("id", "artist_name", "country")


@query("SELECT id, coalesce(en_name, code) AS country FROM (SELECT id, lpad(nation::VARCHAR, 2, '0') AS code FROM plays) LEFT JOIN country_code ON code = iso2")
def code_to_name(spark: SparkSession, sf: str) -> DataFrame:
    p = A.plays(spark, sf).select("id", F.lpad(F.col("nation").cast("string"), 2, "0").alias("iso2"))
    return joins.lookup(p, A.country_code(spark, sf), "iso2", "en_name", F.col("iso2")).select("id", F.col("en_name").alias("country"))


_PAIRS = """pairs AS (SELECT DISTINCT trim(unnest(string_split(artist_variants_text, '{'))) AS variant, canonical_name FROM variants WHERE to_link)"""


@query(f"WITH {_PAIRS} SELECT coalesce(canonical_name, artist_name) AS artist_name, count(*) AS plays FROM part_plays LEFT JOIN pairs ON artist_name = variant AND variant <> canonical_name GROUP BY ALL")
def apply_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return counts.value_counts(joins.apply_canonical(A.part_plays(spark, sf), A.variants(spark)), "artist_name")


@query(
    f"""WITH {_PAIRS}, b AS (SELECT artist_name, count(*) AS before FROM part_plays GROUP BY ALL), a AS (SELECT coalesce(canonical_name, artist_name) AS artist_name, count(*) AS after FROM part_plays
    LEFT JOIN pairs ON artist_name = variant AND variant <> canonical_name GROUP BY ALL) SELECT artist_name, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM b FULL JOIN a USING (artist_name)"""
)
def before_after_canonical(spark: SparkSession, sf: str) -> DataFrame:
    p = A.part_plays(spark, sf)
    before = counts.value_counts(p, "artist_name", name="before")
    # names are replaced once a name, not once a play
    names = joins.apply_canonical(before.withColumn("old", F.col("artist_name")), A.variants(spark))
    after = names.groupBy("artist_name").agg(F.sum("before").alias("after"))
    return before.join(after, "artist_name", "full_outer").na.fill(0)


@query(
    """SELECT id, artist_name, country_code AS user_country FROM (SELECT id, artist_name, play_time::DATE AS day FROM plays) LEFT JOIN (SELECT country_code, start_date, end_date FROM timeline) t
    ON start_date <= day AND (end_date IS NULL OR day < end_date)"""
)
def asof_user_country(spark: SparkSession, sf: str) -> DataFrame:
    return joins.asof_interval(A.plays(spark, sf).select("id", "artist_name", "play_time"), A.timeline(spark), F.col("play_time")).select("id", "artist_name", "user_country")


@query(
    """SELECT event_id, user_id, ts, value AS last_purchase FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') v ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p USING (user_id, ts)"""
)
def asof_large(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    buys = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_purchase"))
    return joins.asof_large(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), buys, "user_id", "ts", "last_purchase")


@query("SELECT user, country_code, start_date, end_date FROM priority_timelines WHERE start_date <= DATE '1997-06-01' AND (end_date IS NULL OR end_date > DATE '1997-06-01')")
def current_interval(spark: SparkSession, sf: str) -> DataFrame:
    """The priority that each customer had on a day, with its interval."""
    lines = timelines.intervals_of(A.priority_feed(spark, sf), ["user"], "day", "country_code", "o_orderkey")
    return timelines.current_intervals(lines, ["user"], F.lit("1997-06-01").cast("date"))


@query("SELECT user, country_code, start_date, end_date FROM priority_timelines")
def priority_timelines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a feed of changes of each customer, as intervals."""
    return timelines.intervals_of(A.priority_feed(spark, sf), ["user"], "day", "country_code", "o_orderkey")


@query(
    """WITH buys AS (SELECT event_type, ts, max(value) AS value FROM events WHERE user_id % 2 = 0 GROUP BY ALL) SELECT event_id, e.event_type, b.value AS latest FROM (SELECT event_id, event_type, ts FROM events WHERE user_id % 2 = 1) e ASOF LEFT JOIN buys b USING (event_type, ts)"""
)
def asof_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """The latest value of another user's event of the same type: a few keys with very many rows each."""
    e = A.table(spark, sf, "events")
    right = e.where("user_id % 2 = 0").select("event_type", "ts", F.col("value").alias("latest"))
    return timelines.asof_by_month(e.where("user_id % 2 = 1").select("event_id", "event_type", "ts"), right, ["event_type"], "ts", "latest").drop("ts")


@query(
    """WITH t AS (SELECT id, user, coalesce(end_date, DATE '9999-12-30') AS e, start_date AS s FROM stays) SELECT a.id AS id_a, b.id AS id_b FROM t a JOIN t b ON a.user = b.user AND a.id < b.id AND a.s <= b.e AND b.s <= a.e"""
)
def interval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return joins.interval_overlaps(A.stays(spark, sf), same_country=False, closed=True, by="user")


@query(
    """WITH f AS (SELECT user, day, country_code FROM priority_days WHERE day < DATE '1997-01-01'), s AS (SELECT * FROM (SELECT *, lag(country_code) OVER (PARTITION BY user ORDER BY day) AS before FROM f) WHERE before IS DISTINCT FROM country_code),
    l AS (SELECT user, country_code, day AS start_date, lead(day) OVER (PARTITION BY user ORDER BY day) AS end_date FROM s),
    n AS (SELECT user, arg_min(country_code, day) AS country_code, min(day) AS day FROM priority_days WHERE day >= DATE '1997-01-01' GROUP BY ALL)
    SELECT l.user, l.country_code, l.start_date, CASE WHEN l.end_date IS NULL AND n.country_code IS DISTINCT FROM l.country_code THEN n.day ELSE l.end_date END AS end_date FROM l LEFT JOIN n USING (user)
    UNION ALL SELECT n.user, n.country_code, n.day, NULL FROM n LEFT JOIN (SELECT * FROM l WHERE end_date IS NULL) o USING (user) WHERE o.country_code IS DISTINCT FROM n.country_code"""
)
def scd2_roll(spark: SparkSession, sf: str) -> DataFrame:
    """Timelines up to a day, rolled on by each customer's first priority from that day on."""
    feed = A.priority_feed(spark, sf)
    lines = timelines.intervals_of(feed.where("day < date'1997-01-01'"), ["user"], "day", "country_code", "o_orderkey")
    later = timelines.intervals_of(feed.where("day >= date'1997-01-01'"), ["user"], "day", "country_code", "o_orderkey")
    news = later.groupBy("user").agg(F.min_by("country_code", "start_date").alias("country_code"), F.min("start_date").alias("day"))
    return timelines.roll_timelines(lines, news, ["user"], "country_code")


_TYPOS = [("ALGERIA",), ("algeria",), ("BRAZIM",), ("CANAD",), ("XCANADA",), ("nowhere",), ("",)]


@query(
    """WITH n AS (FROM (VALUES ('ALGERIA'), ('algeria'), ('BRAZIM'), ('CANAD'), ('XCANADA'), ('nowhere'), ('')) t(name)), h AS (SELECT name, iso2, en_name, lower(name) <> lower(en_name) AS miss FROM n, country_code
    WHERE lower(name) = lower(en_name) OR (abs(length(name) - length(en_name)) <= 1 AND len(list_filter(range(1, least(length(name), length(en_name)) + 1), lambda i: substr(lower(name), i, 1) <> substr(lower(en_name), i, 1))) <= 1))
    SELECT name, arg_min(iso2, (miss, en_name)) AS iso2 FROM n LEFT JOIN h USING (name) GROUP BY name"""
)
def fuzzy_code_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return joins.fuzzy_code(spark.createDataFrame(_TYPOS, "name string"), A.country_code(spark, sf))


# integrity


@query("SELECT DISTINCT artist_name FROM part_plays WHERE artist_name NOT IN (SELECT p_name FROM part WHERE p_size < 4)")
def unknown_artists(spark: SparkSession, sf: str) -> DataFrame:
    known = A.table(spark, sf, "part").where("p_size < 4").select(F.col("p_name").alias("artist_name"))
    return A.part_plays(spark, sf).select("artist_name").distinct().join(known, "artist_name", "left_anti")


@query("SELECT id, artist_name FROM artist_dim WHERE artist_name NOT IN (SELECT artist_name FROM plays WHERE play_time < TIMESTAMP '1996-06-01')")
def orphan_artists(spark: SparkSession, sf: str) -> DataFrame:
    early = A.plays(spark, sf).where("play_time < timestamp_ntz '1996-06-01'")
    return A.artist_dim(spark, sf).select("id", "artist_name").join(early, "artist_name", "left_anti").select("id", "artist_name")


_SCORE = "(2 * (coalesce(mbid, '') <> '')::INTEGER + (coalesce(country, '') <> '')::INTEGER + (coalesce(disambiguation_comment, '') <> '')::INTEGER + (coalesce(aliases, '') <> '')::INTEGER)::INTEGER"


@query(f"SELECT id, artist_name, score FROM (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY artist_name ORDER BY {_SCORE} DESC, id) AS rn FROM artist_dim) WHERE rn = 1")
def best_record_per_name(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.best_record(A.artist_dim(spark, sf)).select("id", "artist_name", "score")


_EVENT_KEY = "SELECT user_id, event_type, date_trunc('hour', ts) AS hour, event_id FROM events"


@query(
    f"""WITH e AS ({_EVENT_KEY}), old AS (SELECT user_id, event_type, hour, min(event_id) AS event_id FROM e WHERE hour < TIMESTAMP '2024-01-15' GROUP BY ALL),
    new AS (SELECT user_id, event_type, hour, min(event_id) AS event_id FROM e WHERE hour >= TIMESTAMP '2024-01-10' GROUP BY ALL) SELECT * FROM old UNION ALL SELECT * FROM new ANTI JOIN old USING (user_id, event_type, hour)"""
)
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").select("user_id", "event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_id")
    keys = ["user_id", "event_type", "hour"]
    old = normalize.keep_first(e.where("hour < TIMESTAMP_NTZ '2024-01-15 00:00:00'"), keys, "event_id")
    return integrity.insert_ignore(old, e.where("hour >= TIMESTAMP_NTZ '2024-01-10 00:00:00'"), keys, "event_id")


def _reference(spark: SparkSession, sf: str) -> DataFrame:
    """What a provider says: a row for every customer but those of the first nation, and some new names."""
    c = A.table(spark, sf, "customer").where("c_nationkey > 0").select(F.col("c_name").alias("artist_name"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("mbid"), F.lit("ZZ").alias("country"))
    s = A.table(spark, sf, "supplier").select(F.col("s_name").alias("artist_name"), F.lit(None).cast("string").alias("mbid"), F.lit("YY").alias("country"))
    return c.unionByName(s)


_REFERENCE = """ref AS (SELECT c_name AS artist_name, 'r' || c_custkey AS mbid, 'ZZ' AS country FROM customer WHERE c_nationkey > 0 UNION ALL SELECT s_name, NULL, 'YY' FROM supplier)"""


@query(
    f"""WITH {_REFERENCE} SELECT artist_name, CASE WHEN coalesce(a.mbid, '') = '' THEN coalesce(r.mbid, a.mbid) ELSE a.mbid END AS mbid, CASE WHEN coalesce(a.country, '') = '' THEN coalesce(r.country, a.country) ELSE a.country END AS country
    FROM artist_full a FULL JOIN ref r USING (artist_name)"""
)
def upsert_fill_missing(spark: SparkSession, sf: str) -> DataFrame:
    dim = integrity.best_record(A.artist_dim(spark, sf)).select("artist_name", "mbid", "country")
    return integrity.upsert(dim, _reference(spark, sf), "artist_name", ["mbid", "country"], overwrite=False)


@query(
    f"""WITH {_REFERENCE} SELECT artist_name, CASE WHEN coalesce(r.mbid, '') <> '' THEN r.mbid ELSE a.mbid END AS mbid, CASE WHEN coalesce(r.country, '') <> '' THEN r.country ELSE a.country END AS country
    FROM artist_full a FULL JOIN ref r USING (artist_name)"""
)
def upsert_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    dim = integrity.best_record(A.artist_dim(spark, sf)).select("artist_name", "mbid", "country")
    return integrity.upsert(dim, _reference(spark, sf), "artist_name", ["mbid", "country"], overwrite=True)


@query(
    """SELECT artist_variants_hash, canonical_name, to_link FROM brand_variants WHERE n % 4 <> 0 UNION ALL SELECT artist_variants_hash, names[2], TRUE FROM brand_variants WHERE n % 4 = 0"""
)
def upsert_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Groups decided anew for a part of the brands, their names in another order and with blanks."""
    v = A.brand_variants(spark, sf)
    new = v.where("n % 4 = 0").select(F.array_join(F.reverse(F.slice("names", 1, 3)), "{ ").alias("artist_variants_text"), F.col("names")[1].alias("canonical_name"), F.lit(True).alias("to_link"), F.lit("2025-01-01").cast("timestamp").alias("timestamp"))
    return integrity.upsert_variants(v.drop("brand", "n", "names"), new).select("artist_variants_hash", "canonical_name", "to_link")


@query("SELECT id, artist_name, CASE WHEN artist_mbid <> '' THEN artist_mbid ELSE coalesce(nullif(mbid, ''), artist_mbid) END AS artist_mbid FROM plays LEFT JOIN (SELECT artist_name, mbid FROM artist_full) USING (artist_name)")
def backfill_key(spark: SparkSession, sf: str) -> DataFrame:
    dim = integrity.best_record(A.artist_dim(spark, sf)).select("artist_name", F.col("mbid").alias("artist_mbid"))
    return joins.backfill(A.plays(spark, sf).select("id", "artist_name", "artist_mbid"), dim, ["artist_name"], "artist_mbid")


@query("SELECT artist_name, coalesce(country, CASE WHEN c_acctbal / 10000 >= 0.85 THEN 'G' || c_mktsegment END) AS country FROM artist_full JOIN customer ON c_custkey = id")
def fill_with_confidence(spark: SparkSession, sf: str) -> DataFrame:
    guesses = A.table(spark, sf, "customer").select(F.col("c_name").alias("artist_name"), F.concat(F.lit("G"), "c_mktsegment").alias("country"), (F.col("c_acctbal") / 10000).alias("confidence"))
    dim = integrity.best_record(A.artist_dim(spark, sf)).select("artist_name", "country")
    return integrity.fill_confident(dim, guesses)


@query(
    """SELECT artist_variants_text, CASE WHEN n % 5 = 1 THEN NOT coalesce(to_link, FALSE) ELSE to_link END AS to_link, CASE WHEN n % 5 = 2 THEN names[2] ELSE canonical_name END AS canonical_name FROM brand_variants WHERE n % 5 <> 0"""
)
def apply_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Of the brands' groups some are deleted, some toggled, some get another name."""
    v = A.brand_variants(spark, sf)
    kind = F.when(F.col("n") % 5 == 0, "delete").when(F.col("n") % 5 == 1, "toggle").when(F.col("n") % 5 == 2, "canonical")
    edits = v.select("artist_variants_hash", kind.alias("action"), F.when(F.col("n") % 5 == 2, F.col("names")[1]).alias("value")).where("action is not null")
    return integrity.apply_edits(v.drop("brand", "n", "names"), edits).select("artist_variants_text", "to_link", "canonical_name")


@query(
    """SELECT p.artist_name, CASE WHEN coalesce(a.mbid, '') = '' THEN coalesce(p.mbid, a.mbid) ELSE a.mbid END AS mbid, CASE WHEN coalesce(a.country, '') = '' THEN coalesce(n_name, a.country) ELSE a.country END AS country,
    CASE WHEN (coalesce(a.mbid, '') = '' AND p.mbid IS NOT NULL) OR (coalesce(a.country, '') = '' AND n_name IS NOT NULL) THEN 'updated' ELSE 'kept' END AS action
    FROM (SELECT artist_name, max(nullif(artist_mbid, '')) AS mbid, max(nation) AS nation FROM plays GROUP BY ALL) p JOIN nation ON p.nation = n_nationkey JOIN artist_full a USING (artist_name)"""
)
def sync_artist_dim(spark: SparkSession, sf: str) -> DataFrame:
    dim = integrity.best_record(A.artist_dim(spark, sf)).select("artist_name", "mbid", "country")
    c, n = A.table(spark, sf, "customer"), A.table(spark, sf, "nation")
    ref = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("artist_name"), F.col("n_name").alias("country"))
    return integrity.sync_dimension(dim, A.plays(spark, sf), ref)


@query("SELECT DISTINCT artist_mbid AS mbid, artist_name FROM plays")
def artist_worklist(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.worklist(A.plays(spark, sf))


@query("SELECT epoch(max(play_time))::BIGINT AS mark FROM plays")
def high_water_mark(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.high_water_mark(A.plays(spark, sf))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'error')")
def incremental_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").select("event_id", "ts", "event_type")
    mark = e.where("event_type = 'error'").agg(F.max("ts").alias("mark"))
    return temporal.after_mark(e.join(F.broadcast(mark)), F.col("mark"), "ts").select("event_id", "ts")  # one row


# temporal and statistical

_MONTHLY = "m AS (SELECT date_trunc('month', play_time)::DATE AS month, count(track_title) AS plays FROM plays GROUP BY ALL)"


@query(f"WITH {_MONTHLY} SELECT * FROM m")
def monthly_series(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.monthly_series(A.plays(spark, sf))


@query(
    f"""WITH {_MONTHLY}, r AS (SELECT *, row_number() OVER (ORDER BY month) AS rn, count(*) OVER () AS n, sum(plays) OVER (ORDER BY month ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS inner_sum,
    lag(plays, 6) OVER (ORDER BY month) AS a, lead(plays, 6) OVER (ORDER BY month) AS b FROM m), t AS (SELECT *, CASE WHEN rn > 6 AND rn <= n - 6 THEN (inner_sum + (a + b) / 2) / 12 END AS trend FROM r),
    f AS (SELECT (rn - 1) % 12 AS phase, avg(plays / trend) AS factor FROM t GROUP BY ALL), g AS (SELECT avg(factor) AS mean FROM f)
    SELECT month, plays, trend, factor / mean AS seasonal, plays / (trend * factor / mean) AS resid FROM t JOIN f ON (rn - 1) % 12 = phase, g"""
)
def seasonal_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.decompose(temporal.monthly_series(A.plays(spark, sf)))


@query(
    """WITH c AS (SELECT month(play_time)::INTEGER AS month, year(play_time) AS year, count(*) AS plays FROM plays GROUP BY ALL), s AS (SELECT month, count(*) AS n, stddev_samp(plays) AS sd FROM c GROUP BY month HAVING stddev_samp(plays) > 0),
    g AS (SELECT k::INTEGER AS k, k * (SELECT max(plays) * 1.1::DOUBLE FROM c) / 499 AS x FROM range(0, 500) t(k)), d AS (SELECT s.month, k, x, sum(exp(-0.5 * ((x - plays) / (n ** -0.2 * sd)) ** 2)) AS d FROM s JOIN c USING (month), g GROUP BY ALL)
    SELECT month, k, x, d / max(d) OVER (PARTITION BY month) AS density FROM d"""
)
def monthly_kde(spark: SparkSession, sf: str) -> DataFrame:
    c = counts.counts_by_year(A.plays(spark, sf), "track_title", "play_time", F.month("play_time").alias("month"))
    return temporal.kernel_density(c, "month", "plays")


@query(
    """WITH c AS (SELECT track_title AS x, album_title AS y, count(*) AS n FROM plays GROUP BY ALL), r AS (SELECT x, sum(n) AS r FROM c GROUP BY x), k AS (SELECT y, sum(n) AS k FROM c GROUP BY y), t AS (SELECT sum(n) AS t, count(DISTINCT x) AS rows, count(DISTINCT y) AS cols FROM c),
    g AS (SELECT coalesce(n, 0) AS n, r * k / t::DOUBLE AS e FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN c USING (x, y)), q AS (SELECT sum((n - e) ** 2 / e) AS chi2 FROM g) SELECT chi2, sqrt(chi2 / t / (least(rows, cols) - 1)) AS v FROM q, t"""
)
def cramers_v(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cramers_v(A.plays(spark, sf), "track_title", "album_title")


@query(
    """SELECT * FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice']) AS column_name, unnest([var_pop(l_quantity), var_pop(l_discount), var_pop(l_tax), var_pop(l_extendedprice)]) AS variance FROM lineitem) WHERE variance > 0.5"""
)
def variance_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stats.variances(A.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 0.5)


@query("SELECT event_id, value FROM events WHERE value < (SELECT quantile_cont(value, 0.01) FROM events) OR value > (SELECT quantile_cont(value, 0.99) FROM events)")
def outliers_p01_p99(spark: SparkSession, sf: str) -> DataFrame:
    return stats.outliers(A.table(spark, sf, "events").select("event_id", "value"), "value")


@query("SELECT quality::INTEGER AS quality, toxic::INTEGER AS toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confusion(A.table(spark, sf, "labels").select(F.col("quality").cast("int"), F.col("toxic").cast("int")), "quality", "toxic")


@query("SELECT doc_id, quality::INTEGER AS quality, toxic::INTEGER AS toxic, round(((doc_id * 37) % 1000) / 999.0::DOUBLE, 3) AS probability FROM labels WHERE quality <> toxic")
def misclassified(spark: SparkSession, sf: str) -> DataFrame:
    p = A.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int"), (((F.col("doc_id") * 37) % 1000) / 999.0).alias("probability"))
    return stats.misclassified(p, "quality", "toxic", "probability")


# canonisation


@query(
    """WITH v AS (SELECT brand, names[:12] AS v FROM brand_names), i AS (SELECT brand, v, unnest(range(1, len(v) + 1)) AS i FROM v),
    j AS (SELECT brand, v, i, unnest(range(i + 1, len(v) + 1)) AS j FROM i) SELECT brand, v[i] AS variant_a, v[j] AS variant_b FROM j"""
)
def expand_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of the first dozen names of a brand."""
    return similarity.expand_pairs(A.brand_names(spark, sf).select("brand", F.array_join(F.slice("names", 1, 12), "{").alias("variants"))).drop("variants")


@query("WITH c AS (SELECT artist_name, count(*) AS plays FROM part_plays GROUP BY ALL) SELECT DISTINCT trim(artist_name) AS name FROM c WHERE plays >= 900 OR artist_name IN ('hot ring', 'absent') UNION SELECT unnest(['hot ring', 'absent'])")
def cluster_input(spark: SparkSession, sf: str) -> DataFrame:
    return canon.cluster_input(counts.value_counts(A.part_plays(spark, sf), "artist_name"), ["hot ring", "absent"], 900)


# the ratio of two-word names by a longest common subsequence over positions, in a recursive table
_LCS = """names AS (SELECT DISTINCT p_name AS name, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS k FROM part), pairs AS (SELECT a.name AS a, b.name AS b, a.k AS ka, b.k AS kb FROM names a JOIN names b ON a.name < b.name),
    dp(a, b, ka, kb, i, row) AS (SELECT a, b, ka, kb, 0, list_transform(range(0, length(kb) + 1), lambda x: 0) FROM pairs UNION ALL
    SELECT a, b, ka, kb, i + 1, list_reduce(range(1, length(kb) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(ka, i + 1, 1) = substr(kb, j::INTEGER, 1) THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0]) FROM dp WHERE i < length(ka)),
    sims AS (SELECT a, b, 2.0::DOUBLE * row[length(kb) + 1] / (length(ka) + length(kb)) AS sim FROM dp WHERE i = length(ka))"""


def _edges(spark: SparkSession, sf: str, least: float = 0.77) -> DataFrame:
    return similarity.similar_pairs(A.table(spark, sf, "part"), "p_name", least, sort_tokens=True)


@query(f"WITH RECURSIVE {_LCS} SELECT a, b, sim FROM sims WHERE sim >= 0.77")
def pairwise_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf)


@query(
    f"""WITH RECURSIVE {_LCS}, e AS (SELECT a, b FROM sims WHERE sim >= 0.77 UNION SELECT b, a FROM sims WHERE sim >= 0.77), reach(name, other) AS (SELECT a, a FROM e UNION SELECT name, b FROM reach JOIN e ON other = a)
    SELECT cluster, list_sort(list(name)) AS members FROM (SELECT name, min(other) AS cluster FROM reach GROUP BY name) GROUP BY cluster"""
)
def name_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return canon.cluster_members(canon.clusters(_edges(spark, sf)))


_MUST_MERGE = [("hot rod", "cold rod"), ("blue bolt", "old bolt")]


@query(
    f"""WITH RECURSIVE {_LCS}, e AS (SELECT a, b, sim FROM sims WHERE sim >= 0.009 UNION ALL SELECT b, a, sim FROM sims WHERE sim >= 0.009), g AS (SELECT k, 0.05::DOUBLE + k * 0.01::DOUBLE AS eps FROM range(0, 95) t(k)),
    reach(k, src, name) AS (SELECT k, src, src FROM g, (VALUES ('hot rod'), ('blue bolt')) v(src) UNION SELECT r.k, src, b FROM reach r JOIN g ON r.k = g.k JOIN e ON a = name AND 1 - sim <= eps + 1e-9)
    SELECT round(min(eps), 10) AS epsilon FROM g WHERE k IN (SELECT k FROM reach WHERE src = 'hot rod' AND name = 'cold rod') AND k IN (SELECT k FROM reach WHERE src = 'blue bolt' AND name = 'old bolt')"""
)
def minimal_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(canon.search_epsilon(_edges(spark, sf, 0.01), _MUST_MERGE),)], "epsilon double")


# for each two names the least place, in order of the edges, that a path between them needs: paths over ever more names
_PLACES = f"""{_LCS}, e AS (SELECT a, b, sim, row_number() OVER (ORDER BY sim DESC, a, b) AS place FROM sims WHERE sim >= 0.5), v AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT a AS name FROM e UNION SELECT b FROM e)),
    fw(k, a, b, place) AS (SELECT 0, x.name, y.name, CASE WHEN x.name = y.name THEN 0 ELSE coalesce(e.place, 1000000) END FROM v x CROSS JOIN v y LEFT JOIN e ON e.a = least(x.name, y.name) AND e.b = greatest(x.name, y.name)
    UNION ALL SELECT p.k + 1, p.a, p.b, least(p.place, greatest(q.place, r.place)) FROM fw p JOIN v ON v.k = p.k + 1 JOIN fw q ON q.a = p.a AND q.b = v.name JOIN fw r ON r.a = v.name AND r.b = p.b),
    w AS (SELECT fw.a, fw.b, fw.place, CASE WHEN fw.place = 0 THEN 1.0::DOUBLE ELSE e.sim END AS sim FROM fw LEFT JOIN e USING (place) WHERE k = (SELECT count(*) FROM v))"""


@query(f"WITH RECURSIVE {_PLACES} SELECT e.a, e.b, e.sim FROM e JOIN w ON e.a = w.a AND e.b = w.b AND e.place = w.place")
def spanning_forest(spark: SparkSession, sf: str) -> DataFrame:
    return forest.spanning_forest(_edges(spark, sf, 0.5)).edges


@query(f"WITH RECURSIVE {_PLACES} SELECT name, sim FROM v JOIN w ON w.a = name AND w.b = (SELECT min(name) FROM v)")
def merge_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity up to which each name is in one cluster with the first of all names."""
    f = forest.spanning_forest(_edges(spark, sf, 0.5))
    first = f.paths.agg(F.min("name").alias("first"))
    return forest.bottlenecks(f, f.paths.select("name").join(F.broadcast(first)), "first", "name").select("name", "sim")  # one row


@query(
    f"""WITH RECURSIVE {_PLACES}, l AS (SELECT g.epsilon, w.a, min(w.b) AS cluster, count(*) AS size FROM w JOIN (SELECT unnest([0.1, 0.2, 0.25, 0.3, 0.4, 0.5]::DOUBLE[]) AS epsilon) g ON 1 - w.sim <= g.epsilon + 1e-9 GROUP BY ALL)
    SELECT epsilon, count(DISTINCT cluster) AS clusters, count(*) AS names FROM l WHERE size > 1 GROUP BY epsilon"""
)
def threshold_profile(spark: SparkSession, sf: str) -> DataFrame:
    return forest.threshold_profile(forest.spanning_forest(_edges(spark, sf, 0.5)), [0.1, 0.2, 0.25, 0.3, 0.4, 0.5])


@query(
    f"""WITH RECURSIVE {_LCS}, e AS (SELECT a, b FROM sims WHERE sim >= 0.77 UNION SELECT b, a FROM sims WHERE sim >= 0.77), reach(name, other) AS (SELECT a, a FROM e UNION SELECT name, b FROM reach JOIN e ON other = a),
    m AS (SELECT cluster, list_sort(list(name)) AS members FROM (SELECT name, min(other) AS cluster FROM reach GROUP BY name) GROUP BY cluster)
    SELECT cluster FROM m WHERE sha256(array_to_string(members, '{{')) NOT IN (SELECT artist_variants_hash FROM variants)"""
)
def unhandled_groups(spark: SparkSession, sf: str) -> DataFrame:
    return canon.unhandled(canon.cluster_members(canon.clusters(_edges(spark, sf))), A.variants(spark)).select("cluster")


_GROUPS = """g AS (SELECT a.n AS a, b.n AS b, a.n || '{' || b.n AS cluster FROM (SELECT DISTINCT p_name AS n FROM part) a JOIN (SELECT DISTINCT p_name AS n FROM part) b ON a.n < b.n),
    d AS (SELECT array_to_string(list_sort(string_split(artist_variants_text, '{')), '{') AS text, canonical_name, to_link FROM variants)"""


def _pair_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of names of the vocabulary as a group to decide on."""
    every = A.table(spark, sf, "part").agg(F.array_join(F.array_sort(F.collect_set("p_name")), "{").alias("variants"))
    pairs = similarity.expand_pairs(every)
    return pairs.select(F.concat_ws("{", "variant_a", "variant_b").alias("cluster"), F.array("variant_a", "variant_b").alias("members"))


def _recorded(spark: SparkSession) -> DataFrame:
    """The variants with signatures in order of name, as they are recorded."""
    v = A.variants(spark)
    return integrity.upsert_variants(v.limit(0), v)


@query(
    f"""WITH {_GROUPS} SELECT cluster, CASE WHEN text IS NULL THEN 'undecided' WHEN to_link THEN 'link' ELSE 'skip' END AS action, CASE WHEN to_link THEN canonical_name END AS canonical_name FROM g LEFT JOIN d ON cluster = text"""
)
def apply_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return canon.apply_decisions(_pair_groups(spark, sf), _recorded(spark))


@query(
    f"""WITH {_PAIRS} SELECT count(*) AS "rows", count(DISTINCT coalesce(canonical_name, artist_name)) AS artists FROM part_plays LEFT JOIN pairs ON artist_name = variant AND variant <> canonical_name"""
)
def canonization_summary(spark: SparkSession, sf: str) -> DataFrame:
    return joins.apply_canonical(A.part_plays(spark, sf), A.variants(spark)).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("artist_name").alias("artists"))


@query("SELECT count(*) AS \"rows\", count(DISTINCT artist_name) AS artists, count(DISTINCT album_title) AS albums, min(play_time) AS first_play, max(play_time) AS last_play FROM (SELECT DISTINCT artist_name, album_title, track_title, play_time FROM part_plays WHERE play_time IS NOT NULL)")
def profile_overview(spark: SparkSession, sf: str) -> DataFrame:
    p = A.part_plays(spark, sf).where("play_time is not null").dropDuplicates()
    return p.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("artist_name").alias("artists"), F.count_distinct("album_title").alias("albums"), F.min("play_time").alias("first_play"), F.max("play_time").alias("last_play"))


@query("SELECT canonical_name, unnest(CASE WHEN n % 2 = 0 THEN names[2:3] ELSE names[3:3] END) AS alias FROM brand_variants WHERE to_link")
def missing_aliases(spark: SparkSession, sf: str) -> DataFrame:
    """Names of linked groups that the artist's aliases lack: half of the brands have their second name there."""
    v = A.brand_variants(spark, sf)
    dim = v.select(F.col("canonical_name").alias("artist_name"), F.when(F.col("n") % 2 == 1, F.concat(F.lit("x, "), F.col("names")[1])).alias("aliases"))
    return canon.missing_aliases(v, dim)


_SCORED = f"""{_LCS}, alike AS (SELECT a, b FROM sims WHERE sim >= 0.77), toks AS (SELECT a, b, list_distinct(string_split(a, ' ')) AS ta, list_distinct(string_split(b, ' ')) AS tb FROM alike),
    sets AS (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb, array_to_string(list_sort(list_intersect(ta, tb)), ' ') AS shared,
    array_to_string(list_sort(list_filter(ta, lambda x: NOT list_contains(tb, x))), ' ') AS oa, array_to_string(list_sort(list_filter(tb, lambda x: NOT list_contains(ta, x))), ' ') AS ob FROM toks),
    parts AS (SELECT *, trim(shared || ' ' || oa) AS wa, trim(shared || ' ' || ob) AS wb FROM sets),
    sided AS (SELECT a, b, 'p' AS kind, a AS x, b AS y FROM parts UNION ALL SELECT a, b, 's', sa, sb FROM parts WHERE shared = '' UNION ALL SELECT a, b, 's', oa, ob FROM parts WHERE shared = ''),
    ways AS (SELECT a, b, kind, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS s, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM sided UNION ALL SELECT a, b, kind, y, x FROM sided WHERE length(x) = length(y)),
    cuts AS (SELECT a, b, kind, s, l, unnest(range(1 - length(s), length(l)))::INTEGER AS i FROM ways),
    need AS (SELECT a, b, 'ratio' AS kind, a AS x, b AS y FROM parts UNION ALL SELECT a, b, 'sort', sa, sb FROM parts UNION ALL SELECT a, b, 'set', wa, wb FROM parts UNION ALL SELECT a, b, 'set', shared, wa FROM parts WHERE shared <> ''
    UNION ALL SELECT a, b, 'set', shared, wb FROM parts WHERE shared <> '' UNION ALL SELECT DISTINCT a, b, kind, s, substr(l, greatest(i, 0) + 1, i + length(s)::INTEGER - greatest(i, 0)) FROM cuts),
    texts AS (SELECT DISTINCT x, y FROM need),
    grid(x, y, i, row) AS (SELECT x, y, 0, list_transform(range(0, length(y) + 1), lambda q: 0) FROM texts UNION ALL
    SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(x, i + 1, 1) = substr(y, j::INTEGER, 1) THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0]) FROM grid WHERE i < length(x)),
    known AS (SELECT x, y, 2.0::DOUBLE * row[length(y) + 1] / greatest(length(x) + length(y), 1) AS v FROM grid WHERE i = length(x)),
    best AS (SELECT a, b, max(CASE WHEN kind = 'ratio' THEN v END) AS r, max(CASE WHEN kind = 'sort' THEN v END) AS so, max(CASE WHEN kind = 'set' THEN v END) AS se, max(CASE WHEN kind = 'p' THEN v END) AS pa, max(CASE WHEN kind = 's' THEN v END) AS pt
    FROM need JOIN known USING (x, y) GROUP BY a, b),
    scores AS (SELECT a, b, r, pa, so, CASE WHEN shared <> '' AND (oa = '' OR ob = '') THEN 1.0::DOUBLE ELSE se END AS st, CASE WHEN shared <> '' THEN 1.0::DOUBLE ELSE pt END AS pt,
    greatest(length(a), length(b))::DOUBLE / least(length(a), length(b)) AS apart FROM best JOIN parts USING (a, b))"""


@query(
    f"""WITH RECURSIVE {_SCORED} SELECT a AS variant_a, b AS variant_b, r AS ratio, pa AS partial_ratio, so AS token_sort_ratio, st AS token_set_ratio,
    CASE WHEN apart < 1.5 THEN greatest(r, 0.95::DOUBLE * greatest(so, st)) ELSE greatest(r, (CASE WHEN apart < 8 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END) * greatest(pa, 0.95::DOUBLE * pt)) END AS weighted_ratio, r AS quick_ratio FROM scores"""
)
def fuzzy_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _edges(spark, sf).select(F.col("a").alias("variant_a"), F.col("b").alias("variant_b"))
    return similarity.fuzzy_scores(pairs)


@query(
    """WITH RECURSIVE names AS (SELECT DISTINCT p_name AS name FROM part), c AS (SELECT unnest(['hot rings', 'small bolts', 'new gizmo']) AS choice),
    dp(name, choice, i, row) AS (SELECT name, choice, 0, list_transform(range(0, length(choice) + 1), lambda x: 0) FROM names, c UNION ALL
    SELECT name, choice, i + 1, list_reduce(range(1, length(choice) + 1), lambda acc, j: list_append(acc, CASE WHEN substr(name, i + 1, 1) = substr(choice, j::INTEGER, 1) THEN row[j] + 1 ELSE greatest(acc[j], row[j + 1]) END), [0]) FROM dp WHERE i < length(name)),
    s AS (SELECT name, choice, 2.0::DOUBLE * row[length(choice) + 1] / (length(name) + length(choice)) AS p FROM dp WHERE i = length(name)),
    b AS (SELECT name, max(p) AS score, min_by(choice, (-p, choice)) AS choice FROM s WHERE p >= 0.8 GROUP BY name) SELECT name, choice, coalesce(score, 0.0::DOUBLE) AS score FROM names LEFT JOIN b USING (name)"""
)
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    names = A.table(spark, sf, "part").select(F.col("p_name").alias("name")).distinct()
    return similarity.best_match(names, ["hot rings", "small bolts", "new gizmo"], 0.8)


_FORMS = """n AS (SELECT DISTINCT p_name AS p FROM part), f AS (SELECT p AS name FROM n UNION SELECT replace(p, ' ', ' & ') FROM n UNION SELECT replace(p, ' ', ' and ') FROM n UNION SELECT 'The ' || p FROM n
    UNION SELECT replace(p, ' ', ' és ') FROM n UNION SELECT replace(p, ' ', ', ') || ' & more' FROM n)"""


@query(
    f"""WITH {_FORMS}, c AS (SELECT n_name AS name FROM nation UNION SELECT min(name) FROM f)
    SELECT name, (CASE WHEN regexp_matches(name, ' és ') THEN 3 WHEN contains(name, '&') THEN 2 ELSE 0 END - CASE WHEN regexp_matches(name, '(?i)\\b(and|und)\\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(name, '(?i)^the\\s') THEN 1 ELSE 0 END
    + CASE WHEN regexp_matches(name, '^[^,&]+(, [^,&]+)+ & [^,&]+$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(name, '[^\\x00-\\x7f]') THEN 1 ELSE 0 END + CASE WHEN name IN (FROM c) THEN 8 ELSE 0 END + CASE WHEN name = 'rod hot' THEN 1 ELSE 0 END)::INTEGER AS form_score FROM f"""
)
def rank_variant_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Spellings of each name: with '&', 'and', 'és', a leading The, and as a list of collaborators; the first of all is official."""
    p = A.table(spark, sf, "part").select(F.col("p_name").alias("p")).distinct()
    forms = F.array("p", F.replace("p", F.lit(" "), F.lit(" & ")), F.replace("p", F.lit(" "), F.lit(" and ")), F.concat(F.lit("The "), "p"), F.replace("p", F.lit(" "), F.lit(" és ")), F.concat(F.replace("p", F.lit(" "), F.lit(", ")), F.lit(" & more")))
    f = p.select(F.explode(forms).alias("name")).distinct()
    official = A.table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(f.agg(F.min("name").alias("name")))
    order = spark.createDataFrame([(True, "rod", "hot")], "eastern boolean, family string, given string")
    return canon.rank_forms(f, official=official, order=order)


@query(
    f"""WITH RECURSIVE {_LCS}, s AS (SELECT a, b, sim FROM sims WHERE sim >= 0.05 UNION ALL SELECT b, a, sim FROM sims WHERE sim >= 0.05), e AS (SELECT a, b FROM s WHERE sim >= 0.77),
    reach(name, other) AS (SELECT a, a FROM e UNION SELECT name, b FROM reach JOIN e ON other = a), l AS (SELECT name, min(other) AS cluster FROM reach GROUP BY name), z AS (SELECT cluster, count(*) AS size FROM l GROUP BY cluster),
    m AS (SELECT s.a, x.cluster AS ca, y.cluster AS cb, sum(sim) AS s FROM s JOIN l x ON s.a = x.name JOIN l y ON s.b = y.name GROUP BY ALL),
    d AS (SELECT a, ca = cb AS own, 1 - s / CASE WHEN ca = cb THEN size - 1 ELSE size END AS mean FROM m JOIN z ON cb = z.cluster),
    p AS (SELECT a, min(mean) FILTER (own) AS i, coalesce(min(mean) FILTER (NOT own), 1.0::DOUBLE) AS o FROM d GROUP BY a)
    SELECT (SELECT count(*) FROM (SELECT DISTINCT a FROM s) n WHERE a NOT IN (SELECT name FROM l)) / (SELECT count(DISTINCT a) FROM s)::DOUBLE AS noise, (SELECT count(DISTINCT cluster) FROM l) AS clusters,
    (SELECT avg((o - i) / greatest(i, o)) FROM p) AS silhouette"""
)
def clustering_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return canon.name_clustering_metrics(A.table(spark, sf, "part"), "p_name", canon.clusters(_edges(spark, sf))).drop("compared")


@query(None)
def link_model_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = similarity.fuzzy_scores(_edges(spark, sf, 0.6).select(F.col("a").alias("variant_a"), F.col("b").alias("variant_b")))
    same = F.substring_index("variant_a", " ", -1) == F.substring_index("variant_b", " ", -1)
    pairs = pairs.withColumn("label", same.cast("int"))
    features = ["ratio", "partial_ratio", "token_set_ratio"]
    split = stats.stratified_split(pairs.withColumn("pair", F.concat("variant_a", F.lit("|"), "variant_b")), "label", "pair")
    model = ml.train_link_model(split.where("not is_test"), features)
    return ml.score_links(model, split).select("variant_a", "variant_b", "label", "is_test", F.round("probability", 6).alias("probability"), F.col("prediction").cast("int").alias("prediction"))


def _stump(k: int, weight: float) -> str:
    """CTEs of one round of boosting by stumps: sums of each cut, the best cut, the rows' new margins. A round's targets are y at first, then the loss's gradient at the margin."""
    target = "y" if k == 1 else "4 * y / (1 + exp(2 * y * f))"
    return f"""g{k} AS (SELECT *, {target} AS g FROM f{k - 1} WHERE NOT is_test), k{k} AS (SELECT j, cut, sum(w * g) FILTER (x <= cut) AS sl, sum(w) FILTER (x <= cut) AS wl, sum(w * g) FILTER (x > cut) AS sr, sum(w) FILTER (x > cut) AS wr
    FROM (SELECT 0 AS j, sim AS x, w, g FROM g{k} UNION ALL SELECT 1, apart, w, g FROM g{k}) JOIN cuts USING (j) GROUP BY j, cut),
    b{k} AS (SELECT j, cut, sl / wl AS l, sr / wr AS r FROM k{k} ORDER BY round(sl * sl / wl + sr * sr / wr, 9) DESC, j, cut LIMIT 1),
    f{k} AS (SELECT a, b, sim, apart, label, is_test, y, w, f + {weight}::DOUBLE * CASE WHEN CASE j WHEN 0 THEN sim ELSE apart END <= cut THEN l ELSE r END AS f FROM f{k - 1} CROSS JOIN b{k})"""


@query(
    f"""WITH RECURSIVE {_LCS}, e AS (SELECT a, b, sim, abs(length(a) - length(b))::DOUBLE AS apart, (string_split(a, ' ')[-1] = string_split(b, ' ')[-1])::INTEGER AS label FROM sims WHERE sim >= 0.5),
    t AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('47' || a || '|' || b), a || '|' || b) <= round(count(*) OVER (PARTITION BY label) * 0.25::DOUBLE) AS is_test FROM e),
    f0 AS (SELECT *, 2.0::DOUBLE * label - 1 AS y, CASE label WHEN 1 THEN (SELECT (1 - avg(label)) / avg(label) FROM t WHERE NOT is_test) ELSE 1.0::DOUBLE END AS w, 0.0::DOUBLE AS f FROM t),
    cuts AS (SELECT j, (x + lag(x) OVER (PARTITION BY j ORDER BY x)) / 2 AS cut FROM (SELECT DISTINCT 0 AS j, sim AS x FROM f0 WHERE NOT is_test UNION SELECT DISTINCT 1, apart FROM f0 WHERE NOT is_test) QUALIFY cut IS NOT NULL),
    {_stump(1, 1.0)}, {_stump(2, 0.05)}, {_stump(3, 0.05)}
    SELECT a AS variant_a, b AS variant_b, label, is_test, round(1 / (1 + exp(-2 * f)), 6) AS probability, (f > 0)::INTEGER AS prediction FROM f3"""
)
def link_model_stumps(spark: SparkSession, sf: str) -> DataFrame:
    """Three rounds of the link model with one split a tree, on all rows and values: split, weights, scaling, boosting and scoring as SQL can follow them."""
    pairs = _edges(spark, sf, 0.5).select(F.col("a").alias("variant_a"), F.col("b").alias("variant_b"), "sim", F.abs(F.length("a") - F.length("b")).cast("double").alias("apart"))
    same = F.substring_index("variant_a", " ", -1) == F.substring_index("variant_b", " ", -1)
    pairs = pairs.withColumn("label", same.cast("int")).withColumn("pair", F.concat("variant_a", F.lit("|"), "variant_b"))
    split = store.materialize(stats.stratified_split(pairs, "label", "pair", portable=True), "split")
    model = ml.train_link_model(split.where("not is_test"), ["sim", "apart"], rounds=3, depth=1, rows_a_tree=1.0, features_a_split="all", bins=256)
    return ml.score_links(model, split).select("variant_a", "variant_b", "label", "is_test", F.round("probability", 6).alias("probability"), F.col("prediction").cast("int").alias("prediction"))


def _event_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as pages of the service's layout; each tenth is playing now and has no date."""
    e = A.table(spark, sf, "events")
    uts = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("string")
    track = F.struct(
        F.struct(F.col("event_type").alias("#text"), F.lit("m").alias("mbid")).alias("artist"), F.col("event_id").cast("string").alias("name"),
        F.struct(F.col("user_id").cast("string").alias("#text")).alias("album"), F.when(F.col("event_id") % 10 != 0, F.struct(uts.alias("uts"))).alias("date"),
    )
    pages = e.groupBy(F.floor(F.col("event_id") / 200).cast("int").alias("page")).agg(F.collect_list(track).alias("track"))
    return pages.select("page", F.to_json(F.struct(F.struct("track").alias("recenttracks"))).alias("value"))


_FLAT = """SELECT event_type AS "Artist", event_id::VARCHAR AS "Song", user_id::VARCHAR AS "Album", CASE WHEN event_id % 10 <> 0 THEN floor(epoch(ts))::BIGINT END AS uts, 'm' AS artist_mbid FROM events"""


@query(f"WITH f AS ({_FLAT}) SELECT * FROM f WHERE uts IS NOT NULL")
def page_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return readers.flatten_pages(_event_pages(spark, sf))


@query(f"""WITH f AS ({_FLAT}) SELECT * FROM f WHERE uts > epoch(TIMESTAMP '2024-01-15 00:00:00')::BIGINT""")
def pages_since(spark: SparkSession, sf: str) -> DataFrame:
    return readers.flatten_pages(_event_pages(spark, sf), since=1705276800)


@query(f"""WITH f AS ({_FLAT}) SELECT "Artist", "Song", "Album", coalesce(uts, 0) AS uts, artist_mbid FROM f ORDER BY uts DESC, "Artist", "Song", "Album" LIMIT 1000""")
def recent_plays(spark: SparkSession, sf: str) -> DataFrame:
    return readers.recent(readers.flatten_pages(_event_pages(spark, sf), undated=True))


@query("SELECT event_id FROM events")
def paginated_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items of pages of any method, parsed afterwards."""
    items = readers.flatten_items(_event_pages(spark, sf), "user.getRecentTracks")
    return items.select(F.get_json_object("item", "$.name").cast("long").alias("event_id"))


@query(
    """SELECT event_type AS "Artist", user_id::VARCHAR AS "Album", event_id::VARCHAR AS "Song", floor(epoch(ts))::BIGINT AS "Datetime" FROM events
    WHERE floor(epoch(ts))::BIGINT > 1705276800 AND floor(epoch(ts))::BIGINT < 1706140800 ORDER BY "Datetime" DESC, "Artist", "Song", "Album" LIMIT 500"""
)
def listens_flatten(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events")
    meta = F.struct(F.col("event_type").alias("artist_name"), F.col("event_id").cast("string").alias("track_name"), F.col("user_id").cast("string").alias("release_name"))
    listen = F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("listened_at"), meta.alias("track_metadata"))
    pages = e.groupBy(F.floor(F.col("event_id") / 100)).agg(F.collect_list(listen).alias("listens")).select(F.to_json(F.struct(F.struct("listens").alias("payload"))).alias("value"))
    return readers.flatten_listens(pages, min_ts=1705276800, max_ts=1706140800, count=500)


# ranges, paging, guards


@query("SELECT id, artist_name FROM plays WHERE year(play_time) BETWEEN 1996 AND 1998")
def year_range(spark: SparkSession, sf: str) -> DataFrame:
    return counts.between_years(A.plays(spark, sf), 1996, 1998).select("id", "artist_name")


@query("WITH c AS (SELECT CASE n_nationkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN upper(n_name[:2]) WHEN 2 THEN NULL ELSE n_name END AS code FROM nation) SELECT code FROM c WHERE code IS NOT NULL AND code <> 'None' AND length(code) = 2")
def two_letter_codes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    code = F.when(k == 0, "None").when(k == 1, F.upper(F.left("n_name", F.lit(2)))).when(k == 3, F.col("n_name"))
    return counts.two_letter(A.table(spark, sf, "nation").select(code.alias("code")), "code")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 100")
def keyset_page(spark: SparkSession, sf: str) -> DataFrame:
    return counts.page_after(A.table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", 40, 100)


@query("SELECT artist_name, count(*) AS plays FROM plays GROUP BY ALL")
def ascending_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return counts.ascending(counts.value_counts(A.plays(spark, sf), "artist_name"), "plays", "artist_name")


@query("SELECT album_title, count(DISTINCT date_trunc('month', play_time)) AS months, count(DISTINCT date_trunc('month', play_time)) >= 12 AS worth_a_try, count(DISTINCT date_trunc('month', play_time)) >= 24 AS decomposable FROM plays WHERE id % 7 = 0 AND (album_title <> 'BUILDING' OR play_time < TIMESTAMP '1996-09-01') GROUP BY ALL")
def history_length(spark: SparkSession, sf: str) -> DataFrame:
    p = A.plays(spark, sf).where("id % 7 = 0 and (album_title <> 'BUILDING' or play_time < timestamp_ntz '1996-09-01')")
    return temporal.history_length(p, "album_title")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL ELSE 'c' || user_id END AS country_iso2, CASE WHEN event_id % 4 IN (0, 2) THEN 0.0::DOUBLE ELSE (event_id % 100) / 100.0::DOUBLE END AS confidence FROM events")
def json_block(spark: SparkSession, sf: str) -> DataFrame:
    """Answers around a JSON block: without one, with a confidence that is a number, no number, or a text of one."""
    kind = F.col("event_id") % 4
    number = ((F.col("event_id") % 100) / 100.0).cast("string")
    block = F.concat(F.lit('{"country_iso2": "c'), F.col("user_id"), F.lit('",\n "confidence": '), F.when(kind == 1, number).when(kind == 2, F.lit('"high"')).otherwise(F.concat(F.lit('"'), number, F.lit('"'))), F.lit("}"))
    answer = F.when(kind == 0, F.lit("I do not know.")).otherwise(F.concat(F.lit("The answer:\n"), block, F.lit(" or {so}")))
    return A.table(spark, sf, "events").select("event_id", text.confident_answer(answer).alias("r")).select("event_id", "r.*")


@query(
    """WITH i AS (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS s, CASE WHEN l_linenumber % 3 > 0 THEN (o_orderdate + to_days((l_linenumber - 3)::INTEGER))::DATE END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT l_linenumber, count(*) FILTER (e IS NULL OR e > s) AS strict, count(*) FILTER (e IS NULL OR e >= s) AS loose FROM i GROUP BY ALL"""
)
def interval_validity(spark: SparkSession, sf: str) -> DataFrame:
    line, o = A.table(spark, sf, "lineitem"), A.table(spark, sf, "orders")
    start = text.strict_date(F.col("o_orderdate").cast("date").cast("string"))
    i = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_linenumber", start.alias("start_date"))
    i = i.withColumn("end_date", F.when(F.col("l_linenumber") % 3 > 0, F.date_add("start_date", F.col("l_linenumber").cast("int") - 3)))
    one = lambda strict: integrity.valid_intervals(i, strict=strict).groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("strict" if strict else "loose"))
    return i.select("l_linenumber").distinct().join(one(True), "l_linenumber", "left").join(one(False), "l_linenumber", "left").na.fill(0)


@query("SELECT o_orderpriority, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'id' ELSE 'name' END AS kind FROM orders")
def identifier_kind(spark: SparkSession, sf: str) -> DataFrame:
    key = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))).otherwise(F.concat(F.lit("g"), F.lpad(F.col("o_orderkey").cast("string"), 35, "0")))
    o = A.table(spark, sf, "orders")
    return o.select("o_orderpriority", "o_orderkey", F.when(text.is_identifier(key), "id").otherwise("name").alias("kind"))


@query("SELECT value, 0.0::DOUBLE AS absent, user_id::DOUBLE AS user_id FROM events")
def align_features(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.align_features(A.table(spark, sf, "events"), ["value", "absent", "user_id"])


@query("SELECT n_nationkey, md5('api_keyK' || 'method' || n_name || 'page' || n_nationkey || 'secret') AS api_sig FROM nation")
def request_signature(spark: SparkSession, sf: str) -> DataFrame:
    params = F.create_map(F.lit("page"), F.col("n_nationkey").cast("string"), F.lit("method"), F.col("n_name"), F.lit("api_key"), F.lit("K"))
    return A.table(spark, sf, "nation").select("n_nationkey", text.request_signature(params, "secret").alias("api_sig"))


@query("WITH c AS (SELECT nation, count(*) * 37 AS n FROM plays GROUP BY ALL) SELECT nation, CASE WHEN n > 10000 THEN 'high' WHEN n > 5000 THEN 'middle' WHEN n > 1000 THEN 'low' ELSE 'none' END AS colour FROM c")
def colour_bucket(spark: SparkSession, sf: str) -> DataFrame:
    c = counts.value_counts(A.plays(spark, sf), "nation")
    return c.select("nation", counts.colour_bucket(F.col("plays") * 37).alias("colour"))


@query("SELECT id, year(play_time)::INTEGER AS year, month(play_time)::INTEGER AS month, day(play_time)::INTEGER AS day FROM plays")
def snapshot_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return normalize.with_calendar(A.plays(spark, sf)).select("id", "year", "month", "day")


# statistics of several columns

_CORR = ["l_quantity", "l_extendedprice", "l_discount", "gross"]
_WITH_GROSS = "line AS (SELECT *, l_quantity * 3 + l_tax * 100 AS gross FROM lineitem)"
_CORR_SQL = " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS r FROM line" for i, a in enumerate(_CORR) for b in _CORR[i + 1 :])


def _line(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "lineitem").withColumn("gross", F.col("l_quantity") * 3 + F.col("l_tax") * 100)


@query(f"WITH {_WITH_GROSS} SELECT x, y, round(r, 6) AS r FROM ({_CORR_SQL})")
def correlation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.correlation(_line(spark, sf), _CORR)
    return spark.createDataFrame([(a, b, round(m[i][j], 6)) for i, a in enumerate(_CORR) for j, b in enumerate(_CORR) if i < j], "x string, y string, r double")


@query(
    f"""WITH {_WITH_GROSS}, c AS ({_CORR_SQL}), v AS (SELECT unnest({_CORR}) AS n, unnest([{', '.join(f'var_pop({c})' for c in _CORR)}]) AS var FROM line)
    SELECT DISTINCT CASE WHEN a.var < b.var THEN x ELSE y END AS dropped FROM c JOIN v a ON a.n = x JOIN v b ON b.n = y WHERE abs(r) > 0.5"""
)
def correlated_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that go for another that they move with."""
    line = _line(spark, sf)
    var = line.agg(*[F.var_pop(c).alias(c) for c in _CORR]).first().asDict()
    return spark.createDataFrame([(c,) for c in stats.drop_correlated(_CORR, stats.correlation(line, _CORR), 0.5, var)], "dropped string")


@query(
    """WITH p AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL), m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY ALL),
    d AS (SELECT p.label, vec_id, m.label AS other, sum((x - m) ** 2) AS d FROM p JOIN m USING (i) GROUP BY ALL), s AS (SELECT vec_id, label, min(d) FILTER (label = other) AS own, min(d) AS near FROM d GROUP BY ALL)
    SELECT count(DISTINCT label) AS clusters, avg(own) AS weighted_wss, sum(near) + count(DISTINCT label) * (SELECT max(len(embedding)) FROM embeddings) * ln(count(*)) AS bic FROM s"""
)
def center_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return canon.center_metrics(A.table(spark, sf, "embeddings"), "label", "embedding")


# more of dimensions and decisions


@query(
    f"""WITH {_GROUPS}, k AS (SELECT cluster, a, b, hash % 5 AS k FROM (SELECT *, (length(cluster) * 7 + ascii(a) + ascii(b)) AS hash FROM g))
    SELECT sha256(cluster) AS artist_variants_hash, cluster AS artist_variants_text, CASE k WHEN 0 THEN a WHEN 1 THEN 'own ' || b ELSE '__SKIP__' END AS canonical_name, k < 2 AS to_link,
    CASE k WHEN 0 THEN 'same' WHEN 3 THEN 'no name given' END AS comment FROM k WHERE k < 4"""
)
def record_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return canon.record_decisions(_pair_groups(spark, sf), _choices(spark, sf))[0]


def _choices(spark: SparkSession, sf: str) -> DataFrame:
    g = _pair_groups(spark, sf)
    a, b = F.col("members")[0], F.col("members")[1]
    k = (F.length("cluster") * 7 + F.ascii(a) + F.ascii(b)) % 5
    decision = F.when(k == 0, "choose").when((k == 1) | (k == 3), "custom").when(k == 2, "skip").otherwise("split")
    value = F.when(k == 0, a).when(k == 1, F.concat(F.lit("own "), b)).when(k == 3, F.lit("  "))
    return g.select("cluster", decision.alias("decision"), value.alias("value"), F.when(k == 4, F.array(b)).alias("part"), F.when(k == 0, F.lit(" same ")).alias("comment"))


@query(
    f"""WITH {_GROUPS}, k AS (SELECT cluster, a, b FROM g WHERE (length(cluster) * 7 + ascii(a) + ascii(b)) % 5 = 4) SELECT cluster, 1 AS k, [a] AS members FROM k UNION ALL SELECT cluster, 2, [b] FROM k"""
)
def split_groups(spark: SparkSession, sf: str) -> DataFrame:
    return canon.record_decisions(_pair_groups(spark, sf), _choices(spark, sf))[1]


@query(
    """WITH t AS (SELECT artist_name, mbid, disambiguation_comment, aliases, country FROM artist_full), r AS (SELECT CASE WHEN id % 2 = 0 THEN 'renamed ' || artist_name ELSE artist_name END AS artist_name,
    CASE WHEN id % 3 = 0 THEN 'new' || id ELSE mbid END AS mbid, 'c' || id AS disambiguation_comment, CASE WHEN id % 5 > 0 THEN 'x' END AS aliases, 'ZZ' AS country FROM artist_full WHERE id % 4 < 3),
    u AS (SELECT * FROM r WHERE mbid IS NULL OR mbid NOT IN (SELECT mbid FROM t WHERE mbid IS NOT NULL))
    SELECT t.artist_name, CASE WHEN i.mbid IS NULL AND u.artist_name IS NOT NULL THEN coalesce(t.mbid, u.mbid) ELSE t.mbid END AS mbid,
    CASE WHEN i.mbid IS NOT NULL THEN i.disambiguation_comment WHEN u.artist_name IS NOT NULL THEN u.disambiguation_comment ELSE t.disambiguation_comment END AS disambiguation_comment,
    CASE WHEN i.mbid IS NOT NULL THEN i.aliases WHEN u.artist_name IS NOT NULL THEN u.aliases ELSE t.aliases END AS aliases,
    CASE WHEN i.mbid IS NOT NULL THEN i.country WHEN u.artist_name IS NOT NULL THEN u.country ELSE t.country END AS country FROM t LEFT JOIN r i ON t.mbid = i.mbid LEFT JOIN u ON t.artist_name = u.artist_name
    UNION ALL SELECT artist_name, mbid, disambiguation_comment, aliases, country FROM u WHERE artist_name NOT IN (SELECT artist_name FROM t)"""
)
def upsert_cache(spark: SparkSession, sf: str) -> DataFrame:
    full = A.artist_dim(spark, sf).where("id < 1000000000")
    name = F.when(F.col("id") % 2 == 0, F.concat(F.lit("renamed "), "artist_name")).otherwise(F.col("artist_name"))
    mbid = F.when(F.col("id") % 3 == 0, F.concat(F.lit("new"), F.col("id").cast("string"))).otherwise(F.col("mbid"))
    rows = full.where("id % 4 < 3").select(
        name.alias("artist_name"), mbid.alias("mbid"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("disambiguation_comment"), F.when(F.col("id") % 5 > 0, "x").alias("aliases"), F.lit("ZZ").alias("country")
    )
    return integrity.upsert_cache(full.select("artist_name", "mbid", "disambiguation_comment", "aliases", "country"), rows)


_KNOWN = "SELECT artist_name, mbid, country, aliases FROM artist_full WHERE id % 3 = 0"


@query(
    f"""WITH d AS ({_KNOWN}), m AS (SELECT DISTINCT artist_name FROM plays WHERE artist_name NOT IN (SELECT artist_name FROM d) ORDER BY artist_name LIMIT 100), p AS (SELECT artist_name, mbid, country, aliases FROM artist_full WHERE id % 3 = 1)
    SELECT * FROM d UNION ALL SELECT artist_name, mbid, country, aliases FROM m LEFT JOIN p USING (artist_name)"""
)
def enrich_unknown(spark: SparkSession, sf: str) -> DataFrame:
    full = A.artist_dim(spark, sf).where("id < 1000000000").select("id", "artist_name", "mbid", "country", "aliases")
    return integrity.enrich_unknown(A.plays(spark, sf), full.where("id % 3 = 0").drop("id"), provider.TableProvider(full.where("id % 3 = 1").drop("id")), 100)


@query(
    f"""WITH d AS ({_KNOWN}), a AS (SELECT DISTINCT artist_name FROM plays), p AS (SELECT artist_name, mbid, country, aliases FROM artist_full WHERE id % 3 = 1)
    SELECT artist_name, coalesce(d.mbid, p.mbid) AS mbid, coalesce(d.country, p.country) AS country, coalesce(d.aliases, p.aliases) AS aliases FROM a LEFT JOIN d USING (artist_name) LEFT JOIN p USING (artist_name)"""
)
def read_through(spark: SparkSession, sf: str) -> DataFrame:
    full = A.artist_dim(spark, sf).where("id < 1000000000").select("id", "artist_name", "mbid", "country", "aliases")
    through = provider.ReadThroughProvider(full.where("id % 3 = 0").drop("id"), provider.TableProvider(full.where("id % 3 = 1").drop("id")))
    return through.lookup(A.plays(spark, sf))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 3 < 2 THEN lpad(c_nationkey::VARCHAR, 2, '0') END AS iso2 FROM customer")
def user_country(spark: SparkSession, sf: str) -> DataFrame:
    """Users' countries by name: as it is, in lower case, and unknown."""
    c = A.table(spark, sf, "customer").join(A.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    country = F.when(k == 0, F.col("n_name")).when(k == 1, F.lower("n_name")).otherwise("no such country at all")
    return provider.user_country(c.select(F.col("c_name").alias("name"), country.alias("country")), A.country_code(spark, sf))


@query(
    """WITH c AS (SELECT nation, count(*) AS plays FROM plays WHERE nation % 2 = 0 GROUP BY ALL) SELECT lpad(n_nationkey::VARCHAR, 2, '0') AS code, coalesce(plays, 0) AS plays, (n_nationkey + 1.0)::DOUBLE AS lon, (n_regionkey + 2.0)::DOUBLE AS lat
    FROM nation LEFT JOIN c ON nation = n_nationkey"""
)
def geo_feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Squares as polygons and multi-polygons, one a nation: their centres, and counts of plays of every other nation."""
    n = A.table(spark, sf, "nation")
    ring = F.format_string("[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", *[F.col(c) + d for dx, dy in ((0, 1), (2, 1), (2, 3), (0, 3)) for c, d in (("n_nationkey", dx), ("n_regionkey", dy))])
    many = F.col("n_nationkey") % 3 == 0
    shape = F.when(many, F.concat(F.lit("[["), ring, F.lit("],[[[9,9]]]]"))).otherwise(F.concat(F.lit("["), ring, F.lit("]")))
    code = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    features = n.select(code.alias("code"), F.when(many, "MultiPolygon").otherwise("Polygon").alias("kind"), shape.alias("coordinates"))
    plays = counts.value_counts(A.plays(spark, sf).where("nation % 2 = 0"), "nation").select(F.lpad(F.col("nation").cast("string"), 2, "0").alias("code"), "plays")
    return readers.feature_counts(features, plays).select("code", "plays").join(readers.centroids(features), "code")


# streams


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.file_stream(spark, f"{sf}/events.parquet")


@query("SELECT DISTINCT event_type AS artist_name, (user_id % 50)::VARCHAR AS track_title, epoch(date_trunc('hour', ts))::BIGINT AS uts FROM events")
def stream_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of plays, drained twice: a key is inserted once, however often it comes."""
    hour = F.unix_timestamp(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    rows = _event_stream(spark, sf).select(F.col("event_type").alias("Artist"), (F.col("user_id") % 50).cast("string").alias("Song"), F.lit("x").alias("Album"), hour.cast("string").alias("uts"), F.lit(None).cast("string").alias("artist_mbid"))
    target = store.new_path(spark, "stream-plays")
    for _ in range(2):  # the second drain has a checkpoint of its own, so it sends everything again
        incremental.load_plays(rows, target, store.new_path(spark, "stream-mark")).awaitTermination()
    return spark.read.parquet(target).select("artist_name", "track_title", F.unix_timestamp("play_time").alias("uts"))


@query("SELECT epoch(date_trunc('day', ts))::BIGINT AS day, count(*) AS plays FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Plays a day by windows of a drained stream."""
    target = store.new_path(spark, "stream-windows")
    counted = incremental.plays_per_window(_event_stream(spark, sf), "ts")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(target)
    counted.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", store.new_path(spark, "stream-mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select(F.unix_timestamp("window.start").alias("day"), "plays")


@query("SELECT DISTINCT event_type AS artist_name, (user_id % 50)::VARCHAR AS track_title, epoch(date_trunc('day', ts))::BIGINT AS uts FROM events")
def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Plays of a stream once each, by state within a watermark."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    plays = _event_stream(spark, sf).select(F.col("event_type").alias("artist_name"), (F.col("user_id") % 50).cast("string").alias("track_title"), day.alias("play_time"))
    target = store.new_path(spark, "stream-distinct")
    once = incremental.distinct_plays(plays, late="365 days")
    once.writeStream.format("parquet").option("path", target).option("checkpointLocation", store.new_path(spark, "stream-mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("artist_name", "track_title", F.unix_timestamp("play_time").alias("uts"))


# merges by file, and streams judged by state

_MONTHLY = """SELECT l_suppkey::VARCHAR AS artist_name, (l_partkey % 10)::VARCHAR AS track_title, date_trunc('month', l_shipdate) AS month, concat_ws('-', l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d')) AS album_title,
    CASE l_returnflag WHEN 'N' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS batch FROM lineitem"""


def _monthly(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Line items as plays of a supplier a month, in three batches that share keys."""
    line = A.table(spark, sf, "lineitem")
    album = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd"))
    month = F.date_trunc("month", F.col("l_shipdate").cast("timestamp"))
    rows = line.select(F.col("l_suppkey").cast("string").alias("artist_name"), album.alias("album_title"), month.alias("play_time"), (F.col("l_partkey") % 10).cast("string").alias("track_title"), "l_returnflag")
    return [rows.where(F.col("l_returnflag").isin(flag) if flag != "R" else ~F.col("l_returnflag").isin("N", "A")).drop("l_returnflag") for flag in ("N", "A", "R")]


def _merged(spark: SparkSession, sf: str, keep: str) -> manifest.ManifestTable:
    table = manifest.ManifestTable(spark, store.new_path(spark, "manifest"))
    for batch in _monthly(spark, sf):
        table.merge(batch, "album_title", keep=keep)
    return table


@query(f"""WITH p AS ({_MONTHLY}) SELECT artist_name, track_title, epoch(month)::BIGINT AS uts, album_title FROM p QUALIFY row_number() OVER (PARTITION BY artist_name, track_title, month ORDER BY batch DESC, album_title DESC) = 1""")
def manifest_merge_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    """Three merges into a table of files; the last batch's row of a key stays."""
    return _merged(spark, sf, "new").read().select("artist_name", "track_title", F.unix_timestamp("play_time").alias("uts"), "album_title")


@query(f"""WITH p AS ({_MONTHLY}) SELECT artist_name, track_title, epoch(month)::BIGINT AS uts, album_title FROM p QUALIFY row_number() OVER (PARTITION BY artist_name, track_title, month ORDER BY batch, album_title) = 1""")
def manifest_insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the first batch's row of a key staying: no file is rewritten."""
    return _merged(spark, sf, "old").read().select("artist_name", "track_title", F.unix_timestamp("play_time").alias("uts"), "album_title")


@query(f"""WITH p AS ({_MONTHLY}) SELECT epoch(month)::BIGINT AS month, count(DISTINCT (artist_name, track_title)) AS plays FROM p WHERE month >= TIMESTAMP '1997-03-01' AND month < TIMESTAMP '1997-09-01' GROUP BY ALL""")
def manifest_time_range(spark: SparkSession, sf: str) -> DataFrame:
    """Half a year of the table, for which the files of other months are not opened."""
    rows = _merged(spark, sf, "new").read(since="1997-03-01", until="1997-09-01")
    return rows.groupBy(F.unix_timestamp("play_time").alias("month")).agg(F.count(F.lit(1)).alias("plays"))


@query(
    """WITH p AS (SELECT event_type, user_id % 50 AS track, date_trunc('day', ts) AS day FROM events)
    SELECT event_type AS artist_name, count(DISTINCT (track, day)) AS new, count(*) - count(DISTINCT (track, day)) AS repeats FROM p GROUP BY ALL"""
)
def stream_judged(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of plays a day, told apart by keyed state: the first of a key is new, all others are repeats."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    plays = _event_stream(spark, sf).select(F.col("event_type").alias("artist_name"), (F.col("user_id") % 50).cast("string").alias("track_title"), day.alias("play_time"))
    target = store.new_path(spark, "stream-judged")
    stateful.write_judged(stateful.judged_plays(plays, horizon_days=3650), target, store.new_path(spark, "stream-mark")).awaitTermination()
    is_ = lambda v: F.sum((F.col("verdict") == v).cast("long"))
    return spark.read.parquet(target).groupBy("artist_name").agg(is_("new").alias("new"), is_("repeat").alias("repeats"))
