"""Tables of plays whose files are listed in a log: a merge rewrites only the files that may hold its keys.

A version is a small file of lines that add or remove data files, with each file's month and its least and greatest first key and time. Data
files never change. A merge reads the files whose month and ranges meet the batch, writes what they become beside them, and commits by making
the next version's file, which only one writer can do; who comes second looks whether the versions in between touch the same files
or ranges, and if not takes the number after. Readers take a version whole, be it an old one, and skip files by time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import keep_first, order_columns
from ..schema import PLAY_KEYS
from ..store import children, exists, mark, materialize, remove

#: Rows that a data file is meant to hold.
FILE_ROWS = 2_000_000
#: Versions from one list of all files to the next.
CHECKPOINT_EVERY = 20
#: Files of a version up to which tasks get the list whole: some 10 MB.
FILES_AT_HAND = 50_000

_ENTRY = "version long, op string, file string, month string, rows long, first_key string, last_key string, first_time long, last_time long, job string"


class Conflict(RuntimeError):
    """Another writer has changed what a merge was made from; merge again."""


@dataclass(frozen=True)
class Entry:
    op: str
    file: str = ""
    month: str = ""
    rows: int = 0
    first_key: str = ""
    last_key: str = ""
    first_time: int = 0
    last_time: int = 0
    job: str = ""

    def meets(self, other: Entry) -> bool:
        """Whether both may hold a row of the same key."""
        return self.month == other.month and self.first_key <= other.last_key and other.first_key <= self.last_key and self.first_time <= other.last_time and other.first_time <= self.last_time


_STATS = ("month", "rows", "first_key", "last_key", "first_time", "last_time")


class ManifestTable:
    """Plays in the folder ``path``, one row for each of ``keys``, of which the first is a text and ``time`` is one.

    Nulls in keys are equal to each other. The log is read by Spark; what comes to the driver is a line for each file that a merge touches or writes.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = PLAY_KEYS[0], time: str = "play_time", file_rows: int = FILE_ROWS):
        if time not in keys:
            raise ValueError(f"{time} must be one of the keys, so that equal keys lie in one month")
        self.spark, self.path, self.keys, self.time, self.file_rows = spark, path.rstrip("/"), list(keys), time, file_rows

    # the log

    def version(self) -> int:
        """The latest version; -1 if there is none."""
        return max([-1, *(int(n[:-5]) for n in children(self.spark, f"{self.path}/_log") if n.endswith(".json") and n[0] != "_")])

    def log(self, version: int | None = None) -> DataFrame:
        """Lines of all versions up to ``version`` since the last list of all files, that list's first."""
        last = self.version() if version is None else version
        names = children(self.spark, f"{self.path}/_log")
        lists = [k for k in (int(n.removeprefix("list-")) for n in names if n.startswith("list-")) if k <= last and exists(self.spark, f"{self.path}/_log/list-{k}/_SUCCESS")]
        begin = max(lists, default=-1)
        parts = [self.spark.read.schema(_ENTRY).parquet(f"{self.path}/_log/list-{begin}")] if lists else []
        lines = [f"{self.path}/_log/{k:012d}.json" for k in range(begin + 1, last + 1)]
        if lines:
            parts.append(self.spark.read.schema(_ENTRY).json(lines))
        out = parts[0] if parts else self.spark.createDataFrame([], _ENTRY)
        return out.unionByName(parts[1]) if len(parts) > 1 else out

    def files(self, version: int | None = None) -> DataFrame:
        """Data files of a version with their month and ranges. A file is added once and removed once at most."""
        log = self.log(version)
        gone = log.where("op = 'remove'").select("file")
        return log.where("op = 'add'").join(gone, "file", "left_anti").select("file", *_STATS)

    def _commit(self, base: int, entries: list[Entry], ranges: list[Entry], job: str = "") -> int:
        """Make the version after ``base``, or a later one if those between have nothing to do with it."""
        lines = "".join(json.dumps(asdict(e) | {"job": job}) + "\n" for e in entries)
        removed = {e.file for e in entries if e.op == "remove"}
        k = base + 1
        while not self._create(f"{self.path}/_log/{k:012d}.json", lines.replace('{"op"', f'{{"version": {k}, "op"')):
            for r in self.spark.read.schema(_ENTRY).json(f"{self.path}/_log/{k:012d}.json").collect():
                other = Entry(**{f: r[f] for f in Entry.__dataclass_fields__})
                if (job and other.job == job) or (other.op == "remove" and other.file in removed) or (other.op == "add" and any(other.meets(e) for e in ranges)):
                    raise Conflict(f"version {k} of {self.path} changes what the merge was made from")
            k += 1
        if k and k % CHECKPOINT_EVERY == 0 and not exists(self.spark, f"{self.path}/_log/list-{k}"):
            # jobs stay listed, so that none is done twice
            done = self.log(k).where("op = 'job'")
            live = self.files(k).withColumns({"op": F.lit("add"), "version": F.lit(k).cast("long"), "job": F.lit("")})
            live.unionByName(done.select(live.columns)).write.parquet(f"{self.path}/_log/list-{k}")
        return k

    def _create(self, path: str, text: str) -> bool:
        """Put a file there whole, unless there is one: it is written beside and renamed, which does not replace."""
        jvm = self.spark._jvm
        beside = f"{path.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
        target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(beside)
        fs = target.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(source, True)
        out.write(text.encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(source, False)
            return False
        return True

    # rows

    def read(self, version: int | None = None, *, since=None, until=None) -> DataFrame:
        """The table, or its rows from ``since`` up to and without ``until`` (timestamps or their text), of which other months' files are not opened."""
        files = self.files(version)
        bound = lambda t: F.unix_micros(F.lit(t).cast("timestamp"))
        if since is not None:
            files = files.where(F.col("last_time") >= bound(since))
        if until is not None:
            files = files.where(F.col("first_time") < bound(until))
        rows = self._open([r.file for r in files.select("file").collect()], version)
        time = F.col(self.time).cast("timestamp")
        if since is not None:
            rows = rows.where(time >= F.lit(since).cast("timestamp"))
        return rows if until is None else rows.where(time < F.lit(until).cast("timestamp"))

    def schema(self, version: int | None = None):
        """That of the newest file."""
        newest = self.log(version).where("op = 'add'").orderBy(F.desc("version"), "file").limit(1).collect()
        return self.spark.read.parquet(f"{self.path}/data/{newest[0].file}").schema if newest else None

    def _open(self, names: Sequence[str], version: int | None = None) -> DataFrame:
        schema = self.schema(version)
        if schema is None:
            raise ValueError(f"{self.path} has no version yet")
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _keyed(self) -> tuple[Column, Column, Column]:
        """(month, first key, time) as the log has them; nulls have a place of their own before all others."""
        time = F.col(self.time).cast("timestamp")
        return F.coalesce(F.date_format(time, "yyyy-MM"), F.lit("")), F.coalesce(F.col(self.keys[0]).cast("string"), F.lit("")), F.coalesce(F.unix_micros(time), F.lit(-(1 << 63)))

    def first_keys(self, batch: DataFrame, month: Column | None = None) -> DataFrame:
        """(month, key, rows, t0, t1): a row for each month and first key, whatever the number of plays; ``month`` where the batch has it."""
        found, key, time = self._keyed()
        return batch.groupBy((found if month is None else month).alias("month"), key.alias("key")).agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("t0"), F.max(time).alias("t1"))

    def touched(self, keys: DataFrame, version: int) -> list[Entry]:
        """Files that may hold a key of the batch whose ``first_keys`` are given."""
        keys = keys.drop("rows")
        files = self.files(version)
        if files.limit(FILES_AT_HAND + 1).count() <= FILES_AT_HAND:
            files = F.broadcast(files)
        met = keys.join(files, "month").where("key between first_key and last_key and t0 <= last_time and t1 >= first_time")
        return [Entry("remove", **r.asDict()) for r in met.select("file", *_STATS).distinct().collect()]

    @property
    def _sort(self) -> list[str]:
        return ["__month", *[k for k in self.keys if k != self.time], self.time]

    def _deal(self, rows: DataFrame, expected: int, months: int = 1) -> DataFrame:
        """``rows`` by ranges of month and keys, for as many files as ``expected`` rows need; as files end with a month, cores may have a range each up to the number of months."""
        tasks = max(1, -(-expected // self.file_rows), min(months, 2 * self.spark.sparkContext.defaultParallelism))
        dated = rows if "__month" in rows.columns else rows.withColumn("__month", self._keyed()[0])
        return dated.repartitionByRange(tasks, *self._sort)

    def _write(self, dealt: DataFrame) -> list[Entry]:
        """Data files of dealt rows, each of one month and of a range of keys."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        dealt.sortWithinPartitions(*self._sort).write.partitionBy("__month").option("compression", "zstd").parquet(folder)
        written = self.spark.read.option("recursiveFileLookup", True).schema(dealt.drop("__month").schema).parquet(folder)
        month, key, time = self._keyed()
        at = written.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"), month.alias("month"), key.alias("key"), time.alias("time"))
        sums = {r.file: r for r in at.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("first_time"), F.max("time").alias("last_time")).collect()}
        if not sums:
            return []
        # a file is in order of its first key: least and greatest are its first and last row's, and no texts are compared
        ends = self.spark.createDataFrame([(f, r.rows - 1) for f, r in sums.items()], "file string, last long")
        edge = at.join(F.broadcast(ends) if len(sums) <= FILES_AT_HAND else ends, "file").where("place = 0 or place = last")
        found: dict[str, dict] = {}
        for r in edge.select("file", "place", "last", "month", "key").collect():
            stats = found.setdefault(r.file, {"month": r.month})
            stats |= {name: r.key for name, here in (("first_key", r.place == 0), ("last_key", r.place == r.last)) if here}
        return [Entry("add", f.split("/data/")[-1], rows=r.rows, first_time=r.first_time, last_time=r.last_time, **found[f]) for f, r in sums.items()]

    def merge(self, batch: DataFrame, *order: Column | str, keep: str = "new", job: str = "") -> dict:
        """Merge plays; returns the version, the files removed and added, and the rows written.

        ``keep`` says whose row of a key stays: the batch's (``new``) or the one that is there (``old``: no file is rewritten). Within the
        batch the last by ``order`` stays, or with ``old`` the first (names of columns cost less than expressions). A ``job`` that is in the log already changes nothing, so a replay is harmless. Raises
        ``Conflict`` if another writer has committed what meets the batch meanwhile; the table is then as that writer left it.
        """
        if keep not in ("new", "old"):
            raise ValueError("keep is new or old")
        base = self.version()
        if job and self.log(base).where((F.col("op") == "job") & (F.col("job") == job)).limit(1).count():
            return {"version": base, "removed": [], "added": [], "rows": 0}
        place = F.monotonically_increasing_id().alias("__place")
        made = {f"__o{i}": o for i, o in enumerate(order) if not isinstance(o, str)}
        ranked = batch.select("*", *[o.alias(n) for n, o in made.items()], place, self._keyed()[0].alias("__month"))
        by = [o if isinstance(o, str) else f"__o{i}" for i, o in enumerate(order)] + ["__place"]
        first = [F.desc(c) if keep == "new" else F.asc(c) for c in by]
        given = materialize(order_columns(ranked), "batch")
        keys = materialize(self.first_keys(given, F.col("__month")), "batch-keys")
        months = keys.groupBy("month").agg(F.sum("rows").alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.min("t0").alias("first_time"), F.max("t1").alias("last_time"), F.max("rows").alias("most")).collect()
        ranges = [Entry("add", **{s: r[s] for s in _STATS}) for r in months]
        if not ranges:
            return {"version": base, "removed": [], "added": [], "rows": 0}
        new = given.agg(F.approx_count_distinct(F.xxhash64(*self.keys))).first()[0]
        if sum(e.rows for e in ranges) > 2 * new or max(r.most for r in months) > self.file_rows:
            # keys that repeat much, or one that may fill a task, become one row each before anything is dealt out
            given = materialize(keep_first(given, self.keys, *first), "batch-once")
        old = self.touched(keys, base) if base >= 0 else []
        rows = given.withColumn("__old", F.lit(False))
        if old:
            there = self._open([e.file for e in old], base)
            if keep == "new":
                rows = rows.unionByName(there.withColumns({"__old": F.lit(True), "__month": self._keyed()[0]}), allowMissingColumns=True)
            else:
                match = F.lit(True)
                for k in self.keys:
                    match = match & there[k].eqNullSafe(given[k])
                # written, as ranges are made of what is read twice
                rows = materialize(rows.join(there.select(self.keys), match, "left_anti"), "batch-new")
        removed = old if keep == "new" else []
        dealt = self._deal(rows, new + sum(e.rows for e in removed), len(ranges))
        # one exchange and one order serve the batch's repeats, the rows it replaces and the files
        added = self._write(keep_first(dealt, self._sort, F.asc("__old"), *first).drop("__old", "__place", *made))
        if not added and not removed:
            return {"version": base, "removed": [], "added": [], "rows": 0}
        entries = [*removed, *added, *([Entry("job")] if job else [])]
        version = self._commit(base, entries, ranges, job)
        return {"version": version, "removed": sorted(e.file for e in removed), "added": sorted(e.file for e in added), "rows": sum(e.rows for e in added)}

    def compact(self) -> dict:
        """Put the files of a month together that have fewer than half of ``file_rows``, where there are several."""
        base = self.version()
        small = [Entry("remove", **r.asDict()) for r in self.files(base).where(F.col("rows") < self.file_rows // 2).collect()]
        months = [e.month for e in small]
        small = [e for e in small if months.count(e.month) > 1]
        if not small:
            return {"version": base, "removed": [], "added": [], "rows": 0}
        added = self._write(self._deal(self._open([e.file for e in small], base), sum(e.rows for e in small)))
        version = self._commit(base, [*small, *added], [])
        return {"version": version, "removed": sorted(e.file for e in small), "added": sorted(e.file for e in added), "rows": sum(e.rows for e in added)}

    def vacuum(self, keep: int = 2) -> int:
        """Delete data files that none of the ``keep`` latest versions has; returns how many. Older versions cannot be read any more."""
        last = self.version()
        gone = 0
        for k in range(max(0, last - keep + 2)):
            done = f"{self.path}/_log/{k:012d}.done"
            if exists(self.spark, done):
                continue
            for r in self.spark.read.schema(_ENTRY).json(f"{self.path}/_log/{k:012d}.json").where("op = 'remove'").toLocalIterator():
                remove(self.spark, f"{self.path}/data/{r.file}")
                gone += 1
            mark(self.spark, done)
        return gone
