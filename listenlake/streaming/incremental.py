"""Incremental loads as Structured Streaming jobs that run until the source is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.integrity import new_rows
from ..operators.normalize import normalize_plays, order_columns
from ..schema import PLAY_COLUMNS, PLAY_KEYS
from ..sources.manifest import ManifestTable
from ..store import exists, materialize, scope


def play_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of API-like rows (Artist, Song, Album, uts, artist_mbid) as they arrive."""
    return spark.readStream.schema(schema).json(path)


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the rows of a Parquet table, be it a folder, to which files may be added, or one file."""
    folder, _, name = path.rstrip("/").rpartition("/")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)


def load_plays(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new plays: a key that the target or the batch has already is ignored, so a replay changes nothing."""
    spark = stream.sparkSession

    def write(batch: DataFrame, _: int) -> None:
        with scope(spark):
            rows = materialize(normalize_plays(batch, F.asc("uts")), "batch")
            if exists(spark, target):
                first, last = rows.agg(F.min("play_time"), F.max("play_time")).first()
                there = spark.read.parquet(target)
                if first is not None:  # a key's rows have one time, so no others can be equal
                    there = there.where(F.col("play_time").between(first, last))
                rows = new_rows(there, rows, PLAY_KEYS[0], F.asc("play_time"))
            order_columns(rows, PLAY_COLUMNS).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_into(stream: DataFrame, table: ManifestTable, checkpoint: str, *, keep: str = "old", name: str = "load") -> StreamingQuery:
    """Merge each batch's plays into a table with a manifest, once each: a batch that is sent again after a failure is known by ``name`` and number.

    ``keep`` as for ``ManifestTable.merge``; only files whose month and ranges meet a batch are read. Plays are API-like rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        with scope(spark):
            table.merge(normalize_plays(batch, F.asc("uts")), keep=keep, job=f"{name}:{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_plays(stream: DataFrame, time: str = "play_time", late: str = "7 days") -> DataFrame:
    """Plays of a stream once each, for sources whose repeats come within ``late``; older ones are dropped."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark(PLAY_KEYS[0])


def plays_per_window(stream: DataFrame, time: str, length: str = "1 day", late: str = "1 day") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, late).groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("plays"))
