"""Writers: snapshots that are swapped in whole, appends, databases, reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import epoch_to_timestamp
from ..operators.normalize import merge_keep_last, order_columns, rename_aliases
from ..schema import PLAY_COLUMNS, PLAY_KEYS
from .readers import connect


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside ``path`` and rename: a failed write changes nothing.

    Between the two renames there is a moment without a table; a job that ends just there leaves the old one beside, which ``recover`` puts
    back. Readers that must never meet that moment read what ``publish`` writes.
    """
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(beside)
    target, fs = _fs(spark, path)
    aside = _fs(spark, beside + ".old")[0]
    had = fs.exists(target)
    if had:
        fs.rename(target, aside)
    fs.rename(_fs(spark, beside)[0], target)
    if had:
        fs.delete(aside, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back the table that a ``swap_in`` moved aside and did not replace; whether there was one."""
    target, fs = _fs(spark, path)
    if fs.exists(target):
        return False
    for found in fs.globStatus(_fs(spark, path.rstrip("/") + ".*.old")[0]) or []:
        return bool(fs.rename(found.getPath(), target))
    return False


def publish(df: DataFrame, path: str, keep: int = 2) -> str:
    """Write a version of a table in the folder ``path`` and point to it; readers of ``current`` see the old version or the new one whole.

    The pointer is a small file that replaces the one before in a single rename. The ``keep`` latest versions stay for readers that began earlier.
    """
    spark = df.sparkSession
    folder, fs = _fs(spark, path)
    numbers = sorted(int(s.getPath().getName()[1:]) for s in (fs.listStatus(folder) if fs.exists(folder) else []) if s.getPath().getName()[1:].isdigit())
    number = numbers[-1] + 1 if numbers else 0
    version = f"{path.rstrip('/')}/v{number}"
    df.write.option("compression", "zstd").parquet(version)
    fresh, pointer = (_fs(spark, f"{path.rstrip('/')}/{name}")[0] for name in (f"_next-{uuid.uuid4().hex}", "_CURRENT"))
    out = fs.create(fresh, True)
    out.writeBytes(str(number))
    out.close()
    jvm = spark._jvm
    rename = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    rename.rename(fresh, pointer, options)
    for old in numbers[: max(0, len(numbers) - keep + 1)]:
        fs.delete(_fs(spark, f"{path.rstrip('/')}/v{old}")[0], True)
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The version of a published table that the pointer names."""
    pointer, fs = _fs(spark, f"{path.rstrip('/')}/_CURRENT")
    stream = fs.open(pointer)
    number = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    stream.close()
    return spark.read.parquet(f"{path.rstrip('/')}/v{number}")


def append_or_create(df: DataFrame, path: str, *order: Column) -> DataFrame:
    """Merge plays into a snapshot; returns the snapshot.

    The last row of a key wins: rows of the batch over those of the snapshot, and within the batch by ``order`` (ascending), then by their place
    in the frame: partitions in order, rows within them as read. Columns that are no play's go.
    """
    spark = df.sparkSession
    new = rename_aliases(df)
    if "play_time" not in new.columns and "uts" in new.columns:
        new = new.withColumn("play_time", epoch_to_timestamp(F.col("uts")))
    places = [o.alias(f"__o{i}") for i, o in enumerate(order)] + [F.monotonically_increasing_id().alias("__place")]
    new = new.select(*[c for c in PLAY_COLUMNS if c in new.columns], *places)
    last = [F.desc(f"__o{i}") for i in range(len(order))] + [F.desc("__place")]
    recover(spark, path)
    target, fs = _fs(spark, path)
    merged = merge_keep_last(spark.read.parquet(path), new, PLAY_KEYS, *last) if fs.exists(target) else merge_keep_last(new.limit(0), new, PLAY_KEYS, *last)
    swap_in(order_columns(merged.drop("__place", *[f"__o{i}" for i in range(len(order))])), path)
    return spark.read.parquet(path)


def append_dimension(df: DataFrame, path: str, key: str = "artist_name") -> DataFrame:
    """Add rows to a small dimension; of rows of a key the last one stays, those of ``df`` after those there."""
    spark = df.sparkSession
    recover(spark, path)
    target, fs = _fs(spark, path)
    new = df.withColumn("__place", F.monotonically_increasing_id())
    merged = merge_keep_last(spark.read.parquet(path) if fs.exists(target) else new.limit(0), new, [[key]], F.desc("__place"))
    swap_in(merged.drop("__place"), path)
    return spark.read.parquet(path)


def export_listens(listens: DataFrame, path: str) -> None:
    """Listens as Parquet, times as whole epoch seconds."""
    swap_in(listens.select("Artist", "Album", "Song", F.col("Datetime").cast("long").alias("Datetime")), path)


def reload(df: DataFrame, path: str, columns: Sequence[str]) -> DataFrame:
    """Replace all rows of a table by those of ``df``, in the table's column order: truncate and load in one swap."""
    recover(df.sparkSession, path)
    swap_in(df.select(*columns), path)
    return df.sparkSession.read.parquet(path)


def dump(df: DataFrame, path: str, columns: Sequence[str] = PLAY_COLUMNS) -> None:
    swap_in(order_columns(df, columns), path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def to_database(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.jdbc(url, name, mode=mode, properties=options)


def merge_into_database(df: DataFrame, url: str, name: str, keys: Sequence[str], *, keep: str = "new", job: str = "load", **options: str) -> int:
    """Merge rows into a table of a database, whose keys must not be null; returns how many rows it took.

    Tasks write to a table of the ``job``'s own, beside; then one transaction moves them: rows of equal keys there are replaced (``keep`` = new) or stay (old). A
    job that fails and is tried again begins with its own table anew, so nothing comes twice. Of rows of ``df`` with equal keys one must be left.
    """
    beside = f"{name}_{job}_beside"
    df.write.jdbc(url, beside, mode="overwrite", properties=options)
    connection, quote = connect(df.sparkSession, url, **options)
    columns = ", ".join(f"{quote}{c}{quote}" for c in df.columns)
    same = " AND ".join(f"t.{quote}{k}{quote} = s.{quote}{k}{quote}" for k in keys)
    try:
        connection.setAutoCommit(False)
        run = connection.createStatement()
        if keep == "new":
            run.executeUpdate(f"DELETE FROM {name} t WHERE EXISTS (SELECT 1 FROM {beside} s WHERE {same})")
        rest = f" WHERE NOT EXISTS (SELECT 1 FROM {name} t WHERE {same})"
        taken = run.executeUpdate(f"INSERT INTO {name} ({columns}) SELECT {columns} FROM {beside} s" + (rest if keep == "old" else ""))
        connection.commit()
        run.executeUpdate(f"DROP TABLE {beside}")
        connection.commit()
        return taken
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def truncate(spark: SparkSession, path: str) -> None:
    """Overwrite a table with no rows of the same schema."""
    swap_in(spark.read.parquet(path).limit(0), path)


def markdown_report(counts: DataFrame, similar: DataFrame, top: int = 10) -> str:
    """A profile as text: totals, most played artists, most similar different names."""
    total = counts.agg({"plays": "sum", "*": "count"}).first()
    lines = ["# Profile", "", f"- artists: {total['count(1)']}", f"- plays: {total['sum(plays)'] or 0}", "", "| artist | plays |", "| --- | --- |"]
    lines += [f"| {r['artist_name']} | {r['plays']} |" for r in counts.orderBy("plays", "artist_name", ascending=[False, True]).limit(top).collect()]
    lines += ["", "| a | b | similarity |", "| --- | --- | --- |"]
    lines += [f"| {r['a']} | {r['b']} | {r['sim']:.3f} |" for r in similar.orderBy("sim", "a", "b", ascending=[False, True, True]).limit(top).collect()]
    return "\n".join(lines) + "\n"


def html_report(markdown: str) -> str:
    import html

    return "<!doctype html><meta charset=utf-8><pre>" + html.escape(markdown) + "</pre>"
