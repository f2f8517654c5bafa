"""Substring dedup over a log-structured index of window fingerprints.

A window is ``width`` consecutive words. Of the runs of half a window's words in it, the one that hashes least is its fingerprint: equal
windows have equal fingerprints, and a text has about one for each ten words. Fingerprints go, batch by batch, into an index
of immutable sorted runs: a batch is merge-joined with each run so far, then becomes a run, and runs are compacted. Runs are tables
bucketed and sorted by fingerprint, so a batch's joins exchange no history; only compaction does. Only
windows whose fingerprint is met twice are hashed whole (128 bits) and counted, which verifies them. Words that a repeated
window covers are removed.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import SECOND_BASE, Words, joined, slices, sliding, text_buffer, window_hashes
from .line_dedup import numbered
from .store import children, exists, mark, materialize, new_path, remove

#: Runs that the index holds before it compacts them into one.
MOST_RUNS = 4


class FingerprintIndex:
    """Runs of (h, n): fingerprints seen so far and how often, each run bucketed by h, sorted in its buckets and never changed.

    A run's name has the numbers of the first and the last batch in it. With a ``path`` the index outlives the session: it keeps the texts of
    each call as well, against which later calls count their windows, and a new index on the path goes on with what is there. All runs
    of an index have the same number of buckets: the shuffle partitions at its making, or ``buckets``.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, most_runs: int = MOST_RUNS, buckets: int | None = None):
        self.spark, self.path, self.most_runs = spark, (path or new_path(spark, "index")).rstrip("/"), most_runs
        self.lasting = path is not None
        self.runs: list[str] = []
        self.texts: list[str] = []
        self.made = 0
        self.tables: dict[str, str] = {}
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if self.lasting:
            self._reopen()

    def _reopen(self) -> None:
        """Whole runs, but for those that a compacted one holds, and the texts of calls that went through."""
        names = children(self.spark, self.path)
        settings = [n for n in names if n.startswith("_buckets")]
        if settings:
            self.buckets = int(settings[0].removeprefix("_buckets"))
        else:
            mark(self.spark, f"{self.path}/_buckets{self.buckets}")
        spans = {n: tuple(map(int, n[3:].split("-"))) for n in names if n.startswith("run") and exists(self.spark, f"{self.path}/{n}/_SUCCESS")}
        for n, (first, last) in sorted(spans.items(), key=lambda x: x[1]):
            if any(m != n and x <= first and last <= y for m, (x, y) in spans.items()):
                remove(self.spark, f"{self.path}/{n}")
            else:
                self.runs.append(f"{self.path}/{n}")
                self.made = max(self.made, last + 1)
        numbers = sorted(int(n[5:]) for n in names if n.startswith("texts") and exists(self.spark, f"{self.path}/{n}/_ADDED"))
        self.texts = [f"{self.path}/texts{k}" for k in numbers]

    def _write(self, counts: DataFrame, first: int, last: int) -> str:
        path, table = f"{self.path}/run{first}-{last}", f"listenlake_run_{uuid.uuid4().hex}"
        remove(self.spark, path)  # what a run that failed half-way left there
        counts.select("h", "n").write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(table)
        self.tables[path] = table
        return path

    def _read(self, path: str) -> DataFrame:
        if path not in self.tables:
            table = f"listenlake_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {table} (h BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            self.tables[path] = table
        return self.spark.table(self.tables[path])

    def _drop(self, path: str) -> None:
        if path in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(path)}")
        remove(self.spark, path)

    def add(self, fingerprints: DataFrame) -> DataFrame:
        """Add a batch (h: one row an occurrence); returns the h that are in it twice or in it and in an older run, once for each run that has it."""
        run = self._write(fingerprints.groupBy("h").agg(F.count(F.lit(1)).alias("n")), self.made, self.made)
        self.made += 1
        new = self._read(run)
        hits = new.where("n > 1").select("h")
        for old in self.runs:
            # both sides have the same buckets: a merge join bucket by bucket, with no exchange
            hits = hits.unionByName(new.select("h").hint("merge").join(self._read(old).select("h"), "h"))
        hits = materialize(hits, "hits")
        self.runs.append(run)
        if len(self.runs) > self.most_runs:
            self.compact()
        return hits

    def compact(self) -> None:
        """Merge all runs into one; the old ones go only when the new one is whole."""
        if len(self.runs) < 2:
            return
        old = self.runs
        first = int(old[0].rsplit("run", 1)[1].split("-")[0])
        # as plain files: counts over a union of bucketed tables are not merged between them (Spark 4.1)
        every = self.spark.read.schema("h long, n long").parquet(*old)
        self.runs = [self._write(every.groupBy("h").agg(F.sum("n").alias("n")), first, self.made - 1)]
        for path in old:
            self._drop(path)

    def close(self) -> None:
        """Forget the runs' tables; their files stay."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}

    def keep(self, profile: DataFrame) -> DataFrame:
        """Write a call's texts and their fingerprints; they count as history once ``added``."""
        number = 1 + max([-1, *(int(p.rsplit("texts", 1)[1]) for p in self.texts)])
        path = f"{self.path}/texts{number}"
        profile.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self._open = path
        return self.spark.read.schema(profile.schema).parquet(path)

    def added(self) -> None:
        mark(self.spark, f"{self._open}/_ADDED")
        self.texts.append(self._open)

    def history(self) -> DataFrame | None:
        """(k1, k2, prints, __text) of the texts of earlier calls."""
        if not self.texts:
            return None
        return self.spark.read.schema("k1 long, k2 long, prints array<long>, __text string").parquet(*self.texts)


def sequence_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of word hashes."""
    if not len(h):
        return 0, 0
    return int(window_hashes(h, len(h))[0].astype(np.int64)), int(window_hashes(h, len(h), SECOND_BASE)[0].astype(np.int64))


def _minima(words: Words, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of half a window, least of each window, validity of each window); windows that cross texts are not valid."""
    part = width // 2 + 1
    runs = window_hashes(h, part)
    n = len(h) - width + 1
    if n <= 0:
        return runs, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    least = sliding(runs, width - part + 1, np.minimum)
    owner_end = np.repeat(words.first[1:], words.counts())
    return runs, least, np.arange(n) + width <= owner_end[:n]


def _profile(width: int, with_text: bool = False):
    """Per text: words, 128-bit key of its word sequence, digest of its joined words, and its fingerprints, one an occurrence; last the text itself if asked for."""
    span = width - width // 2

    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                words = Words(*text_buffer(b.column(1)))
                h = words.hashes()
                runs, least, valid = _minima(words, h, width)
                # a run is chosen if it is the least of a valid window that holds it
                chosen = np.zeros(0, dtype=np.int64)
                if len(least):
                    padded = np.concatenate([np.zeros(span - 1, dtype=np.uint64), np.where(valid, least, 0), np.zeros(span - 1, dtype=np.uint64)])
                    chosen = np.flatnonzero(sliding(padded, span, np.maximum)[: len(runs)] == runs)
                at = np.searchsorted(chosen, words.first)
                keys = [sequence_key(h[x:y]) for x, y in zip(words.first[:-1], words.first[1:])]
                prints = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(runs[chosen].view(np.int64), pa.int64()))
                digests = [hashlib.sha256(t).hexdigest() for t in joined(words, np.ones(len(h), dtype=bool))]
                text = [b.column(1)] if with_text else []
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(words.counts(), pa.int64()), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(digests), prints, *text],
                    names=["id", "n", "k1", "k2", "digest", "prints"] + ["__text"] * with_text,
                )

    return run


def _windows(width: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                words = Words(*text_buffer(b.column(1)))
                h = words.hashes()
                _, least, valid = _minima(words, h, width)
                hits = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(np.array(x, dtype=np.int64) for x in b.column(3).to_pylist())])).view(np.uint64)
                start = np.flatnonzero(valid & np.isin(least, hits)) if len(least) else np.zeros(0, dtype=np.int64)
                row = np.searchsorted(words.first, start, side="right") - 1
                first, second = window_hashes(h, width), window_hashes(h, width, SECOND_BASE)
                for a in range(0, len(start), 50_000):
                    s, r = start[a : a + 50_000], pa.array(row[a : a + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(r), pa.array((s - words.first[row[a : a + 50_000]]).astype(np.int32)), pa.array(first[s].view(np.int64)), pa.array(second[s].view(np.int64)), b.column(2).take(r)],
                        names=["node", "pos", "w1", "w2", "weight"],
                    )

    return run


def _remove(width: int, with_text: bool):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                words = Words(*text_buffer(b.column(1)))
                change = np.zeros(len(words.starts) + 1, dtype=np.int64)
                for first, pos in zip(words.first, b.column(2).to_pylist()):
                    if pos:
                        at = first + np.array(pos, dtype=np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = joined(words, ~gone)
                total = np.concatenate([[0], np.cumsum(gone)])
                arrays = [b.column(0), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept])]
                yield pa.RecordBatch.from_arrays(
                    arrays + ([pa.array(kept, pa.binary()).cast(pa.string())] if with_text else []), names=["node", "gone", "kept_sha256"] + (["kept"] if with_text else [])
                )

    return run


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 35, batches: int = MOST_RUNS + 2, index: FingerprintIndex | None = None, with_text: bool = False) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256), one row per row of ``docs``, ids being whole numbers; ``with_text`` adds
    ``kept``, the words left joined by one space.

    A word goes if a window that covers it has the same words as a window that starts anywhere else, in the same text or another; all
    windows are judged on the input. ``docs`` enters ``index`` in ``batches`` parts (by hash of the words). With an index on a path of
    its own the input of all earlier calls (of the same ``width``) counts as other texts, but gives no rows. Texts with equal words are
    one class: with ``width`` words or more each of them is covered whole, and one stands for all in the search. Null text has no words.
    Rows that repeat an id, or have none, are documents of their own, told apart by a written row number. An index without a path serves one
    call. Extra columns are not read.
    """
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark)
    if index.made and not index.lasting:
        raise ValueError("an index without a path of its own does not keep texts, so it serves one call")
    rows, kind = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")), "id")
    # texts are found by a key that no other row has
    unique = kind == "long"
    base = rows.select((F.col("id") if unique else F.col("__id.row")).alias("id"), "__text")
    fields = "id long, n long, k1 long, k2 long, digest string, prints array<long>"
    if index.lasting:
        history = index.history()
        profile = index.keep(base.mapInArrow(_profile(width, True), f"{fields}, __text string")).drop("__text")
    else:
        history = None
        profile = materialize(base.mapInArrow(_profile(width), fields), "profile")
    hits = None
    for k in range(batches):
        part = profile.where(F.pmod(F.xxhash64("k1", "k2"), F.lit(batches)) == k).select(F.explode("prints").alias("h"))
        met = index.add(part)
        hits = met if hits is None else hits.unionByName(met)
    hits = hits.distinct()
    index.close()

    long_ones = profile.where(F.col("n") >= width)
    classes = long_ones.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    classes = materialize(classes.select("k1", "k2", "n", "rep", "weight", F.monotonically_increasing_id().alias("node")), "classes")
    # fingerprints of one document a class, met with the hits
    reps = long_ones.join(classes, ["k1", "k2", "n"]).where("id = rep").select("node", F.explode(F.array_distinct("prints")).alias("h"))
    met = reps.join(hits, "h").groupBy("node").agg(F.collect_set("h").alias("hits"))
    wanted = met.join(classes, "node").select(F.col("rep").alias("id"), "node", "weight", "hits")
    texts = materialize(base.join(wanted, "id").select("node", "__text", "weight", "hits"), "candidates")
    counted = texts
    if history is not None:
        # texts of earlier calls that share a fingerprint; once each, as a window of theirs needs but one of ours to repeat
        met = history.select("k1", "k2", F.explode(F.array_distinct("prints")).alias("h")).join(hits, "h").groupBy("k1", "k2").agg(F.collect_set("h").alias("hits"))
        old = history.select("k1", "k2", "__text").join(met, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        counted = texts.unionByName(materialize(old.select(F.lit(-1).cast("long").alias("node"), "__text", F.lit(1).cast("long").alias("weight"), "hits"), "earlier"))
    if index.lasting:
        index.added()

    windows = texts.mapInArrow(_windows(width), "node long, pos int, w1 long, w2 long, weight long")
    # written, so that the join below is of two plain exchanges and a window that many texts share can be split
    every = counted.mapInArrow(_windows(width), "node long, pos int, w1 long, w2 long, weight long")
    counts = materialize(every.groupBy("w1", "w2").agg(F.sum("weight").alias("times")).where("times > 1"), "repeated")
    marks = windows.join(counts, ["w1", "w2"]).groupBy("node").agg(F.collect_list("pos").alias("marks"))
    fields = "node long, gone long, kept_sha256 string" + (", kept string" if with_text else "")
    # a class of several texts is covered whole and needs no marks
    changed = texts.where("weight = 1").join(marks, "node").select("node", "__text", "marks").mapInArrow(_remove(width, with_text), fields)
    named = classes.join(changed, "node", "left").select("k1", "k2", "n", "weight", "gone", "kept_sha256", *(["kept"] if with_text else []))
    if with_text:
        plain = base.mapInArrow(_plain, "id long, k1 long, k2 long, whole string").dropDuplicates(["k1", "k2"])
        profile = profile.join(plain.select("k1", "k2", "whole"), ["k1", "k2"], "left")
    copies = F.coalesce(F.col("weight"), F.lit(1)) > 1
    if not unique:
        ids = rows.select(F.col("__id.row").alias("id"), F.col("id").alias("__own"))
        profile = profile.join(ids, "id")
    out = profile.join(named, ["k1", "k2", "n"], "left").select(
        F.col("id" if unique else "__own").alias(id_col),
        F.col("n").alias("n_words"),
        F.when(copies, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copies, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"),
        *([F.when(copies, F.lit("")).otherwise(F.coalesce("kept", "whole")).alias("kept")] if with_text else []),
    )
    return out


def _plain(batches):
    for batch in batches:
        for b in slices(batch, "__text"):
            words = Words(*text_buffer(b.column(1)))
            h = words.hashes()
            keys = [sequence_key(h[x:y]) for x, y in zip(words.first[:-1], words.first[1:])]
            texts = joined(words, np.ones(len(h), dtype=bool))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "k1", "k2", "whole"])
