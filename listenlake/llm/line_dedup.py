"""Line dedup by a deletion-neighbourhood join.

Two lines are within one edit (a code point replaced, left out or put in) exactly if one is the other with a code point left
out, or both give the same string when the code point at the same place is left out. So every line emits itself and its variants
without one code point as hashed keys with the place; lines meet in equal keys, and the least position in a key's group is all
that a member needs to know: no pairs are made, however many lines share a variant.

Equal lines are one class throughout. Most lines have no partner, which coarser keys show first: leaving out a whole half, then a
whole sixteenth, of a line instead of one code point can only make more lines equal, so a line that is alone there is alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import BYTE_BASE, SECOND_BASE, mix, powers, slices, text_buffer
from .store import materialize

#: Lines of fewer code points are not compared: among them one edit is a tenth of the line or more, and it would make unlike lines equal.
MIN_CHARS = 10


class Lines:
    """Lines of a batch of texts: byte spans, places of code points, and hashes of any stretch of code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        breaks = np.flatnonzero(data == 0x0A)
        row = np.searchsorted(offsets, breaks, side="right") - 1
        self.row = np.sort(np.concatenate([np.arange(len(offsets) - 1), row]), kind="stable")
        self.starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
        self.ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.pos = np.arange(len(self.row)) - self.first[self.row]
        self.data = data
        self.points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        self.at = np.searchsorted(self.points, self.starts)
        self.n = np.searchsorted(self.points, self.ends) - self.at
        self._sums = {}

    def hash(self, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        """Hash of the code points [begin, end) (numbers of ``points``), as a polynomial that starts at power 0; not mixed."""
        up, down = powers(base, len(self.data) + 1)
        if base not in self._sums:
            with np.errstate(over="ignore"):
                total = np.zeros(len(self.data) + 1, dtype=np.uint64)
                np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
            self._sums[base] = total
        total = self._sums[base]
        a, b = self.points[begin], self.points[end]
        with np.errstate(over="ignore"):
            return (total[b] - total[a]) * down[a]

    def without(self, begin: np.ndarray, a: np.ndarray, b: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
        """Hash of the code points [begin, a) and [b, end) put together."""
        up, _ = powers(base, len(self.data) + 1)
        with np.errstate(over="ignore"):
            left, right = self.hash(begin, a, base), self.hash(b, end, base)
            size = self.points[a] - self.points[begin] + self.points[end] - self.points[b]
            return mix(left + right * up[self.points[a] - self.points[begin]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def whole(self, base: int) -> np.ndarray:
        return self.without(self.at, self.at, self.at, self.at + self.n, base)

    def solid(self) -> np.ndarray:
        """Lines that hold anything but ASCII white space."""
        dark = np.concatenate([[0], np.cumsum(~np.isin(self.data, [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]))])
        return dark[self.ends] > dark[self.starts]

    def coarse(self, parts: int) -> np.ndarray:
        """(line, key): the line without each of ``parts`` stretches. A line of n code points meets those of n - 1 and of n + 1.

        For a class of lengths c and c + 1 the stretches are cut from the left end for the part before and from the right end
        for the part after, so that the one edit lies within a stretch.
        """
        keys = []
        for less in (0, 1):
            c = np.maximum(self.n - less, 0)
            for q in range(parts):
                a, b = self.at + c * q // parts, self.at + self.n - (c - c * (q + 1) // parts)
                with np.errstate(over="ignore"):
                    tag = (c * (2 * parts) + 2 * q).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                keys.append(mix(self.without(self.at, a, b, self.at + self.n, BYTE_BASE) ^ tag))
        return np.stack(keys, axis=1)


def _classes(least: int, exact: int | None = None):
    """Lines that are compared; ``near`` is false for those of ``exact`` to ``least`` code points, which only equal lines meet."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                x = Lines(*text_buffer(b.column(1)))
                near = x.n >= least
                keep = np.flatnonzero(near if exact is None else near | ((x.n >= exact) & x.solid()))
                coarse = x.coarse(2)[keep].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(x.row[keep])),
                        pa.array(x.pos[keep].astype(np.int32)),
                        pa.array(x.whole(BYTE_BASE)[keep].view(np.int64)),
                        pa.array(x.whole(SECOND_BASE)[keep].view(np.int64)),
                        *[pa.array(np.ascontiguousarray(coarse[:, k])) for k in range(4)],
                        pa.array(near[keep]),
                    ],
                    names=["id", "pos", "h1", "h2", "c0", "c1", "c2", "c3", "near"],
                )

    return run


def _texts(batches):
    """The lines that are asked for, if their hashes are right: (node, line, id, pos)."""
    for batch in batches:
        for b in slices(batch, "__text"):
            x = Lines(*text_buffer(b.column(1)))
            kind = b.schema.field(0).type
            h1, h2 = x.whole(BYTE_BASE).view(np.int64), x.whole(SECOND_BASE).view(np.int64)
            out: dict[str, list] = {"node": [], "line": [], "id": [], "pos": []}
            for row, (doc, asked) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                for a in asked:
                    k = int(x.first[row]) + a["pos"]
                    if k < x.first[row + 1] and h1[k] == a["h1"] and h2[k] == a["h2"]:
                        for name, v in (("node", a["node"]), ("line", x.data[x.starts[k] : x.ends[k]].tobytes()), ("id", doc), ("pos", a["pos"])):
                            out[name].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["node"], pa.int64()), pa.array(out["line"], pa.binary()).cast(pa.string()), pa.array(out["id"], kind), pa.array(out["pos"], pa.int32())], names=["node", "line", "id", "pos"]
            )


def _single(column: pa.Array) -> Lines:
    data, offsets = text_buffer(column)
    x = Lines(data, offsets)
    if len(x.row) != len(offsets) - 1:
        raise AssertionError("a line holds a line end")
    return x


def _finer(parts: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "line"):
                x = _single(b.column(1))
                keys = x.coarse(parts).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(len(keys)), keys.shape[1]))), pa.array(keys.ravel())], names=["node", "key"])

    return run


def _variants(batches):
    """Rows (v1, v2, place, node, id, pos): the line itself with place -1, and its variants without the code point at ``place``."""
    for batch in batches:
        for b in slices(batch, "line", 1 << 18):
            x = _single(b.column(1))
            edge = np.concatenate([[0], np.cumsum(x.n + 1)])
            # a stretch of variants at a time, however long a line is
            for i in range(0, int(edge[-1]), 100_000):
                number = np.arange(i, min(i + 100_000, int(edge[-1])))
                row = np.searchsorted(edge, number, side="right") - 1
                place = number - edge[row] - 1
                begin, end = x.at[row], (x.at + x.n)[row]
                a = begin + np.maximum(place, 0)
                c = np.where(place < 0, a, a + 1)
                v1, v2 = (x.without(begin, a, c, end, base).view(np.int64) for base in (BYTE_BASE, SECOND_BASE))
                r = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v1), pa.array(v2), pa.array(place.astype(np.int32)), b.column(0).take(r), b.column(2).take(r), b.column(3).take(r)], names=["v1", "v2", "place", "node", "id", "pos"]
                )


def _without(batches):
    for batch in batches:
        at = batch.schema.get_field_index("__text")
        for b in slices(batch, "__text"):
            texts, digests, counts = [], [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist()):
                if text is not None and gone:
                    drop = set(gone)
                    kept = [line for i, line in enumerate(text.split("\n")) if i not in drop]
                    text = "\n".join(kept)
                texts.append(text)
                digests.append(hashlib.sha256((text or "").encode()).hexdigest())
                counts.append(len(set(gone)) if gone else 0)
            rest = [b.column(i) for i in range(b.num_columns) if i not in (at, at + 1)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], names=[n for i, n in enumerate(b.schema.names) if i not in (at, at + 1)] + ["kept", "n_removed", "kept_sha256"]
            )


def numbered(rows: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """(rows, type of ``__id``): ``__id`` tells rows apart and orders them by id, nulls first.

    It is the id itself if ids are distinct and none is null. Else ``rows`` are written once with a row number, and it is (there, id, row).
    """
    ids = F.col(id_col).cast("long")
    if not rows.groupBy(ids.alias("id")).count().where("count > 1 or id is null").limit(1).count():
        return rows.withColumn("__id", ids), "long"
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    return rows.withColumn("__id", F.struct(ids.isNotNull().alias("there"), ids.alias("id"), F.col("__row").alias("row"))).drop("__row"), "struct<there: boolean, id: bigint, row: bigint>"


def _row(kind: str, column: str = "id"):
    """The whole number of a ``numbered`` id that rows are joined by."""
    return F.col(column) if kind == "long" else F.col(column)["row"]


def duplicate_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """(id, pos): every line of ``min_chars`` code points or more that an earlier line equals but for one edit at most.

    Earlier is by (id, row, line number). A line goes if any earlier line of the input is within the bound, whether that one stays or
    not. Lines of ``exact_chars`` to ``min_chars`` code points that are not blank go as well if an earlier one is equal.
    """
    rows, kind = numbered(docs.select(id_col, text_col), id_col)
    found = _gone(rows.select(F.col("__id").alias("id"), F.col(text_col).alias("__text")), kind, min_chars, exact_chars)
    return found if kind == "long" else found.select(F.col("id.id").alias("id"), "pos")


def _gone(base: DataFrame, kind: str, min_chars: int, exact_chars: int | None) -> DataFrame:
    """``duplicate_lines`` of ``numbered`` rows (id, __text)."""
    fields = f"id {kind}, pos int, h1 long, h2 long, c0 long, c1 long, c2 long, c3 long, near boolean"
    lines = materialize(base.mapInArrow(_classes(min_chars, exact_chars), fields), "lines")
    first = F.min(F.struct("id", "pos"))
    keys = ["c0", "c1", "c2", "c3"]
    classes = lines.groupBy("h1", "h2").agg(first.alias("first"), F.count(F.lit(1)).alias("times"), F.first("near").alias("near"), *[F.min(c).alias(c) for c in keys])
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def met(rows: DataFrame) -> DataFrame:
        # written, so that the join is of two plain exchanges and a crowded key can be split
        crowded = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "crowded")
        return rows.join(crowded, "key").select("node").distinct()

    survivors = met(classes.where("near").select("node", F.explode(F.array(*keys)).alias("key")))
    asked = classes.join(survivors, "node").select(F.col("first.id").alias("id"), F.struct(F.col("first.pos").alias("pos"), "node", "h1", "h2").alias("a"))
    asked = asked.groupBy(_row(kind).alias("__key")).agg(F.collect_list("a").alias("asked"))
    texts = base.withColumn("__key", _row(kind)).join(asked, "__key").select("id", "__text", "asked").mapInArrow(_texts, f"node long, line string, id {kind}, pos int")
    texts = materialize(texts, "texts")
    fine = met(texts.mapInArrow(_finer(16), "node long, key long"))
    near = materialize(texts.join(fine, "node"), "near")

    variants = near.select("node", "line", "id", "pos").mapInArrow(_variants, f"v1 long, v2 long, place int, node long, id {kind}, pos int")
    where = F.struct("id", "pos", "node")
    variant = F.when(F.col("place") >= 0, F.col("where"))
    # lines that share a variant at a place differ in one code point, so groups are no larger than the alphabet times the line
    keyed = variants.select("v1", "v2", "place", "node", where.alias("where")).repartition("v1", "v2")
    found = (
        keyed.withColumn("at_place", F.min(variant).over(Window.partitionBy("v1", "v2", "place")))
        .withColumn("whole", F.min(F.when(F.col("place") < 0, F.col("where"))).over(Window.partitionBy("v1", "v2")))
        .withColumn("any", F.min(variant).over(Window.partitionBy("v1", "v2")))
        .select("node", "where", F.when(F.col("place") < 0, F.col("any")).otherwise(F.least("at_place", "whole")).alias("least"))
        .where(F.col("least") < F.col("where"))
        .select("node", "least")
    )
    found = found.where("node <> least.node").groupBy("node").agg(F.min("least").alias("least"))
    mine = near.select("node", "line", F.struct("id", "pos").alias("own"))
    theirs = near.select(F.col("node").alias("other"), F.col("line").alias("other_line"))
    found = found.where("least is not null").join(mine, "node").withColumn("other", F.col("least.node")).join(theirs, "other")
    earlier = F.struct(F.col("least.id").alias("id"), F.col("least.pos").alias("pos"))
    gone = found.where((earlier < F.col("own")) & F.levenshtein("line", "other_line", 1).between(0, 1)).select("node", F.lit(True).alias("gone"))

    # classes of one line that nothing resembles are left out before lines meet them
    marked = classes.join(gone, "node", "left").where("times > 1 or gone").select("h1", "h2", "first", F.coalesce("gone", F.lit(False)).alias("gone"))
    own = F.struct("id", "pos")
    return lines.join(marked, ["h1", "h2"]).where(F.col("gone") | (own != F.col("first"))).select("id", "pos")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, exact_chars: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with ``kept`` (the lines that stay), ``n_removed`` and ``kept_sha256``.

    Lines part at line feeds; lines shorter than ``min_chars`` code points stay, or than ``exact_chars`` if that is given: between
    the two only equal lines count. Null text stays null (its digest is that of the empty text), an empty text stays empty. Null ids sort
    first; rows that repeat an id, or have none, are documents of their own, in the order of a written row number. Columns named like the
    results are replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "kept", "n_removed", "kept_sha256")]
    docs, kind = numbered(docs.select(*dict.fromkeys([*keep, id_col, text_col])), id_col)
    gone = _gone(docs.select(F.col("__id").alias("id"), F.col(text_col).alias("__text")), kind, min_chars, exact_chars)
    gone = gone.groupBy(_row(kind).alias("__key")).agg(F.collect_list("pos").alias("__gone"))
    rows = docs.select(*keep, F.col(text_col).alias("__text"), _row(kind, "__id").alias("__key"))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.join(gone, "__key", "left").select(*keep, "__text", "__gone").mapInArrow(_without, f"{fields}, kept string, n_removed long, kept_sha256 string")
