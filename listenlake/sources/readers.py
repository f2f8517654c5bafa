"""Readers: snapshots, delimited text, JSON pages, databases, GeoJSON, paginated services."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: One play of a page, and a page of plays; a lone play comes as an object and not as a list.
_TRACK = "struct<artist:struct<`#text`:string,mbid:string,name:string>,name:string,album:struct<`#text`:string>,date:struct<uts:string>>"
PAGE_MANY = f"struct<recenttracks:struct<track:array<{_TRACK}>>>"
PAGE_ONE = f"struct<recenttracks:struct<track:{_TRACK}>>"
LISTENS = "struct<payload:struct<listens:array<struct<listened_at:long,track_metadata:struct<artist_name:string,track_name:string,release_name:string>>>>>"


def snapshot(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """A Parquet table, or the fallback if there is none."""
    if fallback is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
            path = fallback
    return spark.read.parquet(path)


def table_or_none(spark: SparkSession, name: str, drop: str = "id") -> DataFrame | None:
    return spark.table(name).drop(drop) if spark.catalog.tableExists(name) else None


def database_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a database over JDBC; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.jdbc(url, name, properties=options)


def connect(spark: SparkSession, url: str, **options: str):
    """(connection of the driver's own to a database, the sign it quotes names with)."""
    jvm = spark._jvm
    if "driver" in options:
        jvm.java.lang.Class.forName(options["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    settings = jvm.java.util.Properties()
    for k, v in options.items():
        settings.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    return connection, connection.getMetaData().getIdentifierQuoteString().strip()


def database_ranges(spark: SparkSession, url: str, name: str, key: str, parts: int, **options: str) -> DataFrame:
    """A table of a database read by ``parts`` tasks of about equal rows: bounds are quantiles of its numeric ``key``, which is read alone first. Rows without a key are read with the first."""
    bounds = database_table(spark, url, name, **options).select(key).agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)).first()[0]
    cuts = sorted(set(bounds or []))
    if not cuts:
        return database_table(spark, url, name, **options)
    connection, quote = connect(spark, url, **options)
    connection.close()
    key = f"{quote}{key}{quote}"
    inner = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return spark.read.jdbc(url, name, predicates=[f"{key} < {cuts[0]} OR {key} IS NULL", *inner, f"{key} >= {cuts[-1]}"], properties=options)


def country_codes(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A pipe-separated file of strings: columns renamed and chosen, nulls empty, in order of English name."""
    df = spark.read.csv(path, sep="|", header=True).withColumnsRenamed(columns)
    return df.select(*columns.values()).na.fill("").orderBy("en_name")


def strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file of strings in which empty stays empty."""
    return spark.read.option("header", True).option("emptyValue", "").csv(path).na.fill("")


def flatten_pages(pages: DataFrame, column: str = "value", *, undated: bool = False, since: int | None = None) -> DataFrame:
    """(Artist, Song, Album, uts, artist_mbid) of JSON pages.

    Plays without a date (now playing) are left out, or have time 0 with ``undated``. ``since``: only plays after that second.
    """
    many = F.from_json(column, PAGE_MANY)["recenttracks"]["track"]
    one = F.from_json(column, PAGE_ONE)["recenttracks"]["track"]
    rows = pages.select(F.explode(F.coalesce(many, F.when(one.isNotNull(), F.array(one)))).alias("t")).where(F.lit(undated) | F.col("t.date.uts").isNotNull())
    flat = rows.select(
        F.coalesce("t.artist.#text", "t.artist.name", F.lit("")).alias("Artist"),
        F.coalesce("t.name", F.lit("")).alias("Song"),
        F.coalesce("t.album.#text", F.lit("")).alias("Album"),
        F.coalesce(F.col("t.date.uts").try_cast("long"), F.lit(0) if undated else F.lit(None)).cast("long").alias("uts"),
        F.coalesce("t.artist.mbid", F.lit("")).alias("artist_mbid"),
    )
    return flat if since is None else flat.where(F.col("uts") > since)


def recent(flat: DataFrame, n: int | None = 1000) -> DataFrame:
    """The latest ``n`` plays of flattened pages, or all of them, latest first."""
    out = flat.orderBy(F.desc("uts"), "Artist", "Song", "Album")
    return out if n is None else out.limit(n)


def flatten_items(pages: DataFrame, method: str, column: str = "value") -> DataFrame:
    """(page, item): the items of a method's pages as JSON texts, whether they come as a list or one by itself."""
    path = "$." + ".".join(item_path(method))
    raw = F.get_json_object(column, path)
    many = F.from_json(F.when(raw.startswith("["), raw), "array<string>")
    return pages.select("page", F.explode(F.coalesce(many, F.when(raw.startswith("{"), F.array(raw)))).alias("item"))


def flatten_listens(pages: DataFrame, column: str = "value", *, min_ts: int | None = None, max_ts: int | None = None, count: int | None = None) -> DataFrame:
    """(Artist, Album, Song, Datetime as epoch seconds) of pages of the other JSON layout, of the times between two bounds (not included), the latest ``count``."""
    flat = _listens(pages, column)
    if min_ts is not None:
        flat = flat.where(F.col("Datetime") > min_ts)
    if max_ts is not None:
        flat = flat.where(F.col("Datetime") < max_ts)
    return flat if count is None else flat.orderBy(F.desc("Datetime"), "Artist", "Song", "Album").limit(count)


def _listens(pages: DataFrame, column: str) -> DataFrame:
    rows = pages.select(F.explode(F.from_json(column, LISTENS)["payload"]["listens"]).alias("l"))
    return rows.select(F.col("l.track_metadata.artist_name").alias("Artist"), F.col("l.track_metadata.release_name").alias("Album"), F.col("l.track_metadata.track_name").alias("Song"), F.col("l.listened_at").alias("Datetime"))


def geojson(spark: SparkSession, path: str, code: str = "code") -> DataFrame:
    """(code, kind, coordinates as JSON text) of the features of a GeoJSON file; polygons and multi-polygons may be mixed."""
    schema = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return f.select(F.try_element_at("f.properties", F.lit(code)).alias("code"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))


def centroids(features: DataFrame) -> DataFrame:
    """(code, lon, lat): mean vertex of the first ring of each feature (code, kind, coordinates), of a multi-polygon's first polygon."""
    one = F.from_json(F.when(F.col("kind") == "Polygon", F.col("coordinates")), "array<array<array<double>>>")
    many = F.from_json(F.when(F.col("kind") == "MultiPolygon", F.col("coordinates")), "array<array<array<array<double>>>>")
    ring = F.coalesce(F.get(one, F.lit(0)), F.get(F.get(many, F.lit(0)), F.lit(0)))
    points = features.select("code", F.explode(ring).alias("p"))
    return points.groupBy("code").agg(F.avg(F.col("p")[0]).alias("lon"), F.avg(F.col("p")[1]).alias("lat"))


def feature_counts(features: DataFrame, counts: DataFrame, count: str = "plays") -> DataFrame:
    """Features with their code's count, 0 where there is none."""
    return features.join(counts.select("code", count), "code", "left").withColumn(count, F.coalesce(count, F.lit(0)))


def get_json(url: str, *, tries: int = 8, wait: float = 2.0, timeout: float = 30.0) -> dict:
    """A JSON answer; server and network errors are tried again, client errors and errors told in the answer are raised."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                data = json.load(answer)
            if isinstance(data, dict) and "error" in data:
                raise ValueError(f"service error {data['error']}: {data.get('message', '')}")
            return data
        except urllib.error.HTTPError as e:
            if e.code < 500 or attempt == tries - 1:
                raise
        except OSError:
            if attempt == tries - 1:
                raise
        time.sleep(wait)
    raise RuntimeError("unreachable")


#: The place of a page's items and of its attributes, where it does not follow from the method's name; fixed values.
ITEM_PATHS = {"user.getRecentTracks": ("recenttracks", "track")}


def item_path(method: str) -> tuple[str, str]:
    """(container, key) of a method's items: ``x.getArtists`` has them in ``artists.artist``, ``x.getTopArtists`` in ``topartists.artist``."""
    one = method.rsplit(".", 1)[-1].removeprefix("get").lower().removesuffix("s")
    return ITEM_PATHS.get(method, (f"{one}s", one.removeprefix("top").removeprefix("loved")))


class _Pages(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class _PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pages = options["url"], options.get("pages")
        self.method = options.get("method", "user.getRecentTracks")
        self.each, self.pause, self.wait = int(options.get("pagesPerTask", 10)), float(options.get("pause", 0.2)), float(options.get("wait", 2.0))
        since = options.get("since")
        if since is not None:  # the service's bound is inclusive
            self.url += ("&" if "?" in self.url else "?") + f"from={int(since) + 1}"

    def _get(self, page: int) -> dict:
        return get_json(self.url.format(page=page, method=self.method), wait=self.wait)

    def partitions(self) -> list[InputPartition]:
        if self.pages is None:
            container, _ = item_path(self.method)
            self.pages = self._get(1).get(container, {}).get("@attr", {}).get("totalPages", 1)
        total = int(self.pages)
        return [_Pages(i, min(i + self.each, total + 1)) for i in range(1, total + 1, self.each)]

    def read(self, partition: _Pages) -> Iterator[tuple]:
        for page in range(partition.first, partition.end):
            yield page, json.dumps(self._get(page))
            time.sleep(self.pause)


class _Range(InputPartition):
    """Pages of the plays after one second up to another."""

    def __init__(self, since: int, until: int, first: int, end: int):
        self.since, self.until, self.first, self.end = since, until, first, end


class _PageStream(DataSourceStreamReader):
    """Plays as they appear: an offset is the second up to which all were taken. The checkpoint has it, so the reader itself keeps nothing."""

    def __init__(self, options: dict):
        self.pages = _PageReader({k: v for k, v in options.items() if k != "since"})
        self.container, self.item = item_path(self.pages.method)
        self.first, self.lag, self.span = int(options.get("since", 0)), int(options.get("lag", 0)), int(options.get("span", 0))
        self.start: int | None = None

    def _page(self, page: int, since: int, until: int | None = None) -> dict:
        """A page of the service's plays from a second on, up to another, both included."""
        bounds = f"from={since}" + (f"&to={until}" if until is not None else "")
        url = self.pages.url + ("&" if "?" in self.pages.url else "?") + bounds
        return get_json(url.format(page=page, method=self.pages.method), wait=self.pages.wait).get(self.container, {})

    def _plays(self, page: dict) -> list[dict]:
        found = page.get(self.item) or []
        return [p for p in (found if isinstance(found, list) else [found]) if (p.get("date") or {}).get("uts")]

    def initialOffset(self) -> dict:
        return {"second": self.first}

    def latestOffset(self) -> dict:
        """The newest second, less ``lag``, for plays of which others of the same second may follow; at most ``span`` seconds after the last offset."""
        since = self.first if self.start is None else self.start
        newest = max([since, *(int(p["date"]["uts"]) - self.lag for p in self._plays(self._page(1, since + 1)))])
        self.start = min(newest, since + self.span) if self.span else newest
        return {"second": self.start}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since, until = int(start["second"]), int(end["second"])
        self.start = until  # after a restart the checkpoint tells where to go on
        if until <= since:
            return []
        total = int(self._page(1, since + 1, until).get("@attr", {}).get("totalPages", 1))
        return [_Range(since, until, i, min(i + self.pages.each, total + 1)) for i in range(1, total + 1, self.pages.each)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        for page in range(partition.first, partition.end):
            got = self._page(page, partition.since + 1, partition.until)
            # whatever the service takes its bounds for, and without the play that is on just now, which has no date
            plays = [p for p in self._plays(got) if partition.since < int(p["date"]["uts"]) <= partition.until]
            yield page, json.dumps({self.container: {self.item: plays}})
            time.sleep(self.pages.pause)

    def commit(self, end: dict) -> None:
        """Nothing to let go: the service keeps its plays."""


class PagedSource(DataSource):
    """``spark.read.format("paged").options(url="...{page}...")``: (page, value), a task a range of pages.

    The number of pages comes from the first answer's attributes, or from ``pages``. Other options: ``method`` (also put into the url where it
    holds ``{method}``), ``since`` (a second; only what is later is asked for), ``pagesPerTask``, ``pause`` between pages and ``wait`` before another try.

    ``spark.readStream`` takes the same: each batch has the plays after the last one's newest second, ``since`` first; what
    was taken is in the checkpoint, so that a query that is started again goes on there. ``lag`` holds the last seconds back, ``span``
    bounds the seconds of a batch. The newest play must be on the first page.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, value string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PageStream(self.options)
