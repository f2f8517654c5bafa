"""Exact metric range join of embeddings: pivots cut space into cells, cells join independently.

Links are pairs with cosine >= threshold, that is unit vectors within distance r = sqrt(2 - 2 threshold). A vector's home is the
cell of its nearest pivot. If x is at home with pivot p and y with pivot q, then y lies at least
(d(y, p)^2 - d(y, q)^2) / (2 d(p, q)) from every point of p's cell, as that is its distance from the plane between the two
(the triangle inequality gives the weaker (d(y, p) - d(y, q)) / 2). So y is copied to each cell for which that is at most r,
and a vector meets all its partners at home. A label is the first cell; crowded cells are cut again by pivots of their own, so
pivots grow in number with the points and none go to the driver. Where further pivots would separate little, as in a
cloud without structure, a cell stays whole and is joined by pairs of blocks. Tasks return numbers of links and local components, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .jaccard_join import _dealt, _groups
from .store import materialize

#: Points of a cell that is cut again, pivots of one cut, and points that a task cuts with one reading of the pivots.
PER_PIVOT = 32
MOST_PIVOTS = 8
CUT_POINTS = 50_000
#: A cell is cut after the first time only if that leaves at most this share of its comparisons, judged on SAMPLE of its points.
WORTH = 0.8
SAMPLE = 512
#: Vectors that a block holds; a cell is joined by pairs of blocks.
BLOCK = 2048
#: Pivots nearer to each other than this are one: from there on distances from the plane between them are right to 1e-9.
CLOSE = 1e-5

CELL = ["label", "dim", "path"]
POINT = "id long, label long, dim int, path long, vec binary, weight long, home boolean"


def _unit(v: list | None) -> np.ndarray | None:
    """The unit vector of a list, or None if it is null, empty or zero, or holds null or non-finite components."""
    if v is None or not len(v) or None in v:
        return None
    x = np.array(v, dtype=np.float64)
    big = np.abs(x).max()
    if not np.isfinite(big) or not big > 0:
        return None
    x = x / big  # so that the squares neither overflow nor vanish
    return x / np.sqrt(x @ x)


def _units(batches):
    """(id, label, dim, vec) of every row; those that link with nothing have null ``vec``."""
    for b in batches:
        units = [_unit(v) if there else None for v, there in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array([0 if v is None else len(v) for v in units], pa.int32()), pa.array([None if v is None else v.tobytes() for v in units], pa.binary())], names=["id", "label", "dim", "vec"]
        )


def _apart(p: np.ndarray, least: float = CLOSE) -> np.ndarray:
    """The pivots without those closer than ``least`` to one before them: the plane between two such is lost in rounding."""
    taken: list[int] = []
    for i, x in enumerate(p):
        if all(np.linalg.norm(x - p[j]) >= least for j in taken):
            taken.append(i)
    return p[taken]


def _cells(pivots: dict[tuple[int, int], np.ndarray], radius: float):
    """Rows (part, cell, home, ...) : each vector at home and in every cell whose points may be within the radius."""
    slack = radius + 1e-9
    pivots = {key: _apart(p) for key, p in pivots.items()}

    def run(batches):
        for b in batches:
            part, dim = b.column(1).to_numpy(), b.column(2).to_numpy()
            order = np.lexsort((dim, part))
            edges = np.flatnonzero((np.diff(part[order]) != 0) | (np.diff(dim[order]) != 0)) + 1
            for rows in np.split(order, edges) if len(order) else []:
                p = pivots[(int(part[rows[0]]), int(dim[rows[0]]))]
                x = np.frombuffer(b"".join(b.column(3).take(pa.array(rows)).to_pylist()), dtype=np.float64).reshape(len(rows), -1)
                d2 = np.maximum(0, 2 - 2 * x @ p.T)
                home = d2.argmin(axis=1)
                near = np.stack([np.linalg.norm(p - q, axis=1) for q in p])
                with np.errstate(divide="ignore", invalid="ignore"):
                    gap = (d2 - d2[np.arange(len(rows)), home][:, None]) / (2 * near[home])
                at, cell = np.nonzero((gap <= slack) | (np.arange(len(p))[None, :] == home[:, None]))
                taken = b.take(pa.array(rows[at]))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(home[at] == cell)], names=[*b.schema.names, "cell", "home"]
                )

    return run


def _cut(radius: float):
    """Rows of cells, each cell's pivots first (``weight`` 0), to rows of the cells within; of a cell only the pivots are held."""

    def run(batches):
        key, pivots, place = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(b.schema.get_field_index(c)).to_numpy() for c in (*CELL, "salt", "weight")]
            change = np.zeros(b.num_rows, dtype=bool)
            for c in cols[:4]:
                change[1:] |= c[1:] != c[:-1]
            change[1:] |= (cols[4][1:] == 0) != (cols[4][:-1] == 0)
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:]):
                if a == z:
                    continue
                now, part = tuple(int(c[a]) for c in cols[:4]), b.slice(a, z - a)
                if now != key:
                    key, pivots, place = now, [], None
                if cols[4][a] == 0:
                    pivots += [np.frombuffer(v, dtype=np.float64) for v in part.column(part.schema.get_field_index("vec")).to_pylist()]
                    continue
                place = place or _cells({(now[2], now[1]): np.stack(pivots)}, radius)
                own = part.select(["id", "path", "dim", "vec", "label", "weight", "home"])
                own = own.rename_columns(["id", "path", "dim", "vec", "label", "weight", "was"])
                for out in place([own]):
                    get = lambda c: out.column(out.schema.get_field_index(c))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [get("id"), get("label"), get("dim"), get("path"), get("vec"), get("weight"), get("cell"), pa.compute.and_(get("was"), get("home"))],
                        names=["id", "label", "dim", "path", "vec", "weight", "cell", "home"],
                    )

    return run


def _join(threshold: float):
    def run(batches):
        for g in _groups(batches, 5):
            side, home, ids, weight = (g.column(c).to_numpy() for c in ("block", "home", "id", "weight"))
            x = np.frombuffer(b"".join(g.column("vec").to_pylist()), dtype=np.float64).reshape(len(ids), -1)
            i, j = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            linked = x[a] @ x[b].T >= threshold
            if i == j:
                np.fill_diagonal(linked, False)
            linked &= home[a][:, None] | home[b][None, :]
            if not linked.any():
                continue
            ra, rb = local_roots(linked, ids[a], ids[b])
            # each vector counts at home only
            na, nb = (linked @ weight[b]) * home[a], (weight[a] @ linked) * home[b]
            node, root, links = (ids[a], ra, na) if i == j else (np.concatenate([ids[a], ids[b]]), np.concatenate([ra, rb]), np.concatenate([na, nb]))
            hit = (links > 0) | (node != root)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(root[hit]), pa.array(links[hit].astype(np.int64))], names=["a", "b", "links"])

    return run


def _inner_cells(points: DataFrame, radius: float, per_pivot: int, most_pivots: int) -> DataFrame:
    """(POINT): points in cells that are joined as they are. Every label with more than ``per_pivot`` points is cut once at least."""

    def cut(rows: DataFrame, pivots: DataFrame, level: int) -> DataFrame:
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(6)), F.col("salts")).cast("int")).drop("salts", "k", "n")
        spread = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts").cast("int") - 1)))
        spread = spread.select(F.lit(-1).cast("long").alias("id"), *CELL, "vec", F.lit(0).cast("long").alias("weight"), F.lit(False).alias("home"), "salt")
        both = salted.unionByName(spread).repartition(*CELL, "salt").sortWithinPartitions(*CELL, "salt", F.col("weight") > 0, "id")
        out = both.mapInArrow(_cut(radius), "id long, label long, dim int, path long, vec binary, weight long, cell int, home boolean")
        return out.withColumnRenamed("path", "above").withColumn("path", F.xxhash64("above", "cell", F.lit(level)))

    open_, settled, level = points.withColumns({"path": F.lit(0).cast("long"), "home": F.lit(True)}), [], 0
    while True:
        sizes = open_.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("at_home"))
        crowded = materialize(sizes.where((F.col("n") > per_pivot) & (F.col("at_home") > 1)).drop("at_home"), "crowded")
        if not crowded.limit(1).count():
            return _union([*settled, open_])
        # a first cut of few pivots, which every crowded label gets
        k = F.least(F.lit(4 if level == 0 else most_pivots), F.floor(F.col("n") / per_pivot) + 1)
        crowded = crowded.withColumns({"k": k, "salts": F.floor(F.col("n") / CUT_POINTS) + 1})
        rows = open_.join(crowded, CELL)
        # a pivot is the vector at home that hashes least in its slot
        slot = F.pmod(F.xxhash64("vec", F.lit(3 + 10 * level)), F.col("k"))
        pivots = rows.where("home").groupBy(*CELL, slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("vec", F.lit(4 + 10 * level)).alias("h"), "vec")).alias("p"), F.first("salts").alias("salts"))
        pivots = materialize(pivots.select(*CELL, "p.vec", "salts"), "pivots")
        if level:
            drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(9)), F.col("n")) < SAMPLE).withColumn("salts", F.lit(1).cast("long"))
            tried = cut(drawn, pivots.withColumn("salts", F.lit(1).cast("long")), level).groupBy("label", "dim", F.col("above"), "path").agg(F.count(F.lit(1)).alias("all"), F.sum(F.col("home").cast("int")).alias("own"))
            tried = tried.groupBy("label", "dim", F.col("above").alias("path")).agg(F.sum(F.col("all") * F.col("own")).alias("left"), F.sum("own").alias("own"))
            size = drawn.groupBy(*CELL).agg(F.count(F.lit(1)).alias("drawn"))
            worth = materialize(tried.join(size, CELL).where(F.col("left") <= WORTH * F.col("own") * F.col("drawn")).select(*CELL), "worth")
            settled.append(open_.join(worth, CELL, "left_anti"))
            rows, pivots = rows.join(worth, CELL), pivots.join(worth, CELL)
            if not worth.limit(1).count():
                return _union(settled)
        else:
            settled.append(open_.join(crowded.select(*CELL), CELL, "left_anti"))
        open_ = materialize(cut(rows, pivots, level).select("id", *CELL, "vec", "weight", "home"), "cells")
        level += 1


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metric_join(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    per_pivot: int = PER_PIVOT,
    most_pivots: int = MOST_PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """(id_col, n_links, component_id, kept), one row per row of ``vectors``; ids are whole numbers.

    Vectors are compared only when labels are equal and not null, in double precision. Vectors that are null, empty or zero
    or hold null or non-finite components, and vectors of different lengths, link with nothing. Equal unit vectors of a label
    are one point with a weight; they link with each other. Rows that repeat an id, or have none, are vectors of their own; null ids are
    never a component's least, unless it has no other: then ``component_id`` is null. ``kept``: the id equals the component's, or both are null.
    Any label may hold most of the rows: its cells are cut again, and what cannot be cut is split into blocks, every pair of which is a task's work.
    An empty table gives no rows; extra columns are not read.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col)).alias("label"), F.col(vector_col).alias("v"), F.col(label_col).isNotNull().alias("there"))
    units = materialize(base.mapInArrow(_units, "id long, label long, dim int, vec binary"), "units")
    usable = units.where("vec is not null")
    points = usable.groupBy("label", "dim", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    points = materialize(points.withColumn("id", F.monotonically_increasing_id()), "points")
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    placed = _inner_cells(points.select("id", "label", "dim", "vec", "weight"), radius, per_pivot, most_pivots)
    load = placed.groupBy(*CELL).agg((F.floor(F.count(F.lit(1)) / block) + 1).alias("__nb"))
    both = placed.join(load, CELL).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("__nb")).cast("int"))
    both = both.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__nb").cast("int") - 1)))
    both = both.select(*CELL, F.least("block", "__other").alias("bi"), F.greatest("block", "__other").alias("bj"), "block", "id", "weight", "home", "vec")
    found = materialize(_dealt(both, *CELL, "bi", "bj").mapInArrow(_join(threshold), "a long, b long, links long"), "links")
    linked = components(found.select("a", "b"), "linked").distinct().join(points.select(F.col("id").alias("node"), "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(least, "component").select(F.col("node").alias("id"), "component_id", F.lit(True).alias("met"))
    counts = found.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    named = points.select("id", "label", "dim", "vec", "rep", "weight").join(counts, "id", "left").join(linked, "id", "left")
    named = named.select("label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.when(F.col("met"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    real = usable.join(named, ["label", "dim", "vec"]).select("id", "n_links", "component_id")
    alone = units.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = real.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
