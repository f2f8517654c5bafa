"""N-gram Jaccard join by chosen paths.

A document is the set of hashes of its runs of five words. Equal sets form a class, of which the least id goes on. A
sketch holds the minimum of the set under each of many hash functions. From a node of a run's tree a set goes to the children
of a few randomly chosen coordinates of its sketch, one for each value: two sets meet there if their minima are the same shared token.
Buckets split again until they are small, or until nearly all of a bucket goes the same way: its sets are alike, and to compare
them is the work that their links ask for. At a leaf sets are compared by sketch, large ones block by block. Runs repeat until the
recall of a pair at the threshold, loss by the sketch included, reaches the target.

A pair of which one set met few others in the leaf is verified by itself, on the whole sets. Sets that met many form groups, in
which every pair is verified block by block: tasks return sums and local components, never all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_roots
from .kernels import SECOND_BASE, Words, mix, slices, text_buffer, window_hashes
from .line_dedup import numbered
from .store import materialize

COORDINATES = 64
FANOUT = 2
#: Buckets of up to SMALL sets are leaves, and those that hold more than ALIKE of the bucket they were split from.
SMALL = 256
ALIKE = 0.6
#: Partners in a leaf up to which a set's pairs are verified one by one.
LIGHT = 16
#: Sets a block holds in sketch comparison, and tokens in verification; a group is split into pairs of blocks.
BLOCK_SETS = 2048
BLOCK_TOKENS = 1_500_000


def shingle_sets(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle of them all, no words no shingle."""
    words = Words(*text_buffer(batch.column(column)))
    h = words.hashes()
    windows = window_hashes(h, width)
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        elif b > a:
            yield window_hashes(h[a:b], int(b - a))[:1]
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(window_hashes(s, len(s))[0].astype(np.int64)), int(window_hashes(s, len(s), SECOND_BASE)[0].astype(np.int64))


def agreements(threshold: float) -> np.ndarray:
    """Chances that the sketches of a pair at the threshold agree in 0, 1, ... COORDINATES coordinates."""
    k = range(COORDINATES + 1)
    return np.array([math.comb(COORDINATES, x) * threshold**x * (1 - threshold) ** (COORDINATES - x) for x in k])


def least_agreement(threshold: float, recall: float) -> int:
    """Coordinates in which sketches must agree: a pair at the threshold is lost by it with a twentieth of the loss allowed at most."""
    return max(1, int(np.searchsorted(np.cumsum(agreements(threshold)), (1 - recall) / 20)))


def runs_needed(threshold: float, recall: float, fanout: int = FANOUT) -> int:
    """Runs until a pair at the threshold has met at a leaf of one, however deep, and passed the sketch, with probability ``recall``.

    Both depend on how many coordinates agree, so the chances are taken over that number.
    """
    share, met = np.arange(COORDINATES + 1) / COORDINATES, np.ones(COORDINATES + 1)
    for _ in range(60):
        met = 1 - (1 - share * met) ** fanout
    chance, least = agreements(threshold), least_agreement(threshold, recall)
    runs = 1
    while chance[:least].sum() + (chance * (1 - met) ** runs)[least:].sum() > 1 - recall:
        runs += 1
    return runs


def _mix1(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0])


def _children(paths: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, path of child): FANOUT different coordinates for each path, the child being told by coordinate and value."""
    n, t = sketches.shape
    first = mix(paths + np.uint64(1)) % np.uint64(t)
    picks = [first]
    with np.errstate(over="ignore"):
        for k in range(1, FANOUT):
            step = mix(paths + np.uint64(1 + k)) % np.uint64(t - 1)
            picks.append((first + np.uint64(1) + step) % np.uint64(t) if k == 1 else mix(paths + np.uint64(77 + k)) % np.uint64(t))
        rows = np.tile(np.arange(n), len(picks))
        coordinate = np.concatenate(picks)
        value = sketches[rows, coordinate.astype(np.int64)].astype(np.uint64)
        return rows, mix(np.tile(paths, len(picks)) * np.uint64(0x9E3779B97F4A7C15) + coordinate * np.uint64(0x100000001) + mix(value + (coordinate << np.uint64(32))))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns of batches sorted by them; a run may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        change[0] = last is not None and any(c[0] != x for c, x in zip(cols, last))
        cuts = np.flatnonzero(change)
        begin = 0
        for c in cuts:
            if c > begin:
                held.append(b.slice(begin, c - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], int(c)
        held.append(b.slice(begin))
        last = [c[-1] for c in cols]
    if held:
        yield pa.Table.from_batches(held)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def _sign(width: int, spans: np.ndarray):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                ids, n, k1, k2, sketches = b.column(0), [], [], [], []
                for s in shingle_sets(b, 1, width):
                    n.append(len(s))
                    key = set_key(s) if len(s) else (0, 0)
                    k1.append(key[0])
                    k2.append(key[1])
                    with np.errstate(over="ignore"):
                        low = np.full(len(spans), np.iinfo(np.uint64).max, dtype=np.uint64)
                        for a in range(0, len(s), 4096):
                            low = np.minimum(low, ((s[a : a + 4096, None] ^ spans[None, :]) * np.uint64(0xFF51AFD7ED558CCD)).min(axis=0))
                    sketches.append((mix(low) >> np.uint64(32)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketches, pa.binary())], names=["id", "n", "k1", "k2", "sketch"]
                )

    return run


def _sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, COORDINATES)


def _roots(runs: int):
    seeds = [_mix1(1000 + r) for r in range(runs)]

    def run(batches):
        for b in batches:
            ids, sk = b.column(0).to_numpy(), _sketches(b.column(1))
            for seed in seeds:
                rows, paths = _children(np.full(len(ids), seed, dtype=np.uint64), sk)
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), pa.array(ids[rows])], names=["path", "id"])

    return run


def _split(batches):
    for b in batches:
        paths, ids, sk = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), _sketches(b.column(2))
        rows, below = _children(paths, sk)
        yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), pa.array(ids[rows]), b.column(3).take(pa.array(rows))], names=["path", "id", "above"])


def _compare_sketches(least: int):
    """(a, b, heavy): pairs that a set which met few is in, and links of those that met many with the least of their kind."""

    def run(batches):
        for g in _groups(batches, 3):
            ids, side, sk = g.column("id").to_numpy(), g.column("block").to_numpy(), _sketches(g.column("sketch"))
            i, j = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            same = np.zeros((len(a), len(b)), dtype=np.uint8)
            for c in range(COORDINATES):
                same += sk[a, c][:, None] == sk[b, c][None, :]
            linked = same >= least
            if i == j:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            many_a, many_b = linked.sum(axis=1) > LIGHT, linked.sum(axis=0) > LIGHT
            x, y = np.nonzero(linked & ~(many_a[:, None] & many_b[None, :]))
            first, second = np.minimum(ids[a[x]], ids[b[y]]), np.maximum(ids[a[x]], ids[b[y]])
            if i == j:
                first, second = first[x < y], second[x < y]
            nodes, roots = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            if many_a.any() and many_b.any():
                ha, hb = ids[a[many_a]], ids[b[many_b]]
                ra, rb = local_roots(linked[np.ix_(many_a, many_b)], ha, hb)
                nodes, roots = np.concatenate([ha, hb]), np.concatenate([ra, rb])
                nodes, roots = nodes[nodes != roots], roots[nodes != roots]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([first, nodes])), pa.array(np.concatenate([second, roots])), pa.array(np.arange(len(first) + len(nodes)) >= len(first))], names=["a", "b", "heavy"]
            )

    return run


def _blocked(df: DataFrame, key: str, n_blocks) -> DataFrame:
    """Each row once for every pair of its group's blocks that its own block is in: (key, bi, bj, block, ...)."""
    df = df.withColumn("__nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("__nb")).cast("int"))
    df = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__nb").cast("int") - 1)))
    return df.withColumns({"bi": F.least("block", "__other"), "bj": F.greatest("block", "__other")}).drop("__nb", "__other")


def _verify(width: int, threshold: float):
    def count(sets: list[np.ndarray], weights: np.ndarray, ids: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool):
        sizes = np.array([len(s) for s in sets])
        tokens = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        new = np.append(True, tokens[1:] != tokens[:-1])
        starts = np.flatnonzero(new)
        df = np.diff(np.append(starts, len(tokens)))
        shared = np.repeat(df > 1, df)
        column = (np.cumsum(df > 1) - 1)[np.cumsum(new) - 1][shared]
        owner = owner[shared]
        at = np.full(len(sets), -1)
        at[a] = np.arange(len(a))
        bt = np.full(len(sets), -1)
        bt[b] = np.arange(len(b))
        both = np.zeros((len(a), len(b)), dtype=np.float32)
        n = int(column[-1]) + 1 if len(column) else 0
        wide = max(64, min(4096, (16 << 20) // max(1, len(sets))))
        for c in range(0, n, wide):
            lo, hi = np.searchsorted(column, [c, c + wide])
            o, k = owner[lo:hi], column[lo:hi] - c
            xa = np.zeros((len(a), wide), dtype=np.float32)
            m = at[o] >= 0
            xa[at[o][m], k[m]] = 1
            if same:
                xb = xa
            else:
                xb = np.zeros((len(b), wide), dtype=np.float32)
                m = bt[o] >= 0
                xb[bt[o][m], k[m]] = 1
            both += xa @ xb.T
        union = sizes[a][:, None] + sizes[b][None, :] - both
        linked = (both > 0) & (both >= threshold * union - 1e-6)
        if same:
            np.fill_diagonal(linked, False)
        return linked

    def run(batches):
        for g in _groups(batches, 3):
            ids, side, weight = (g.column(c).to_numpy() for c in ("id", "block", "weight"))
            sets = [s.values.to_numpy().view(np.uint64) for s in g.column("tokens")]
            i, j = g.column("bi")[0].as_py(), g.column("bj")[0].as_py()
            a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
            if not len(a) or not len(b):
                continue
            linked = count(sets, weight, ids, a, b, i == j)
            if not linked.any():
                continue
            ra, rb = local_roots(linked, ids[a], ids[b])
            na, nb = linked @ weight[b], weight[a] @ linked
            if i == j:
                node, root, links = ids[a], ra, na
            else:
                node, root, links = np.concatenate([ids[a], ids[b]]), np.concatenate([ra, rb]), np.concatenate([na, nb])
            hit = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(root[hit]), pa.array(links[hit].astype(np.int64))], names=["a", "b", "links"])

    return run


def _tokens(width: int):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                sets, rows = [], []
                for row, (s, k1, k2) in enumerate(zip(shingle_sets(b, 1, width), b.column(5).to_pylist(), b.column(6).to_pylist())):
                    if len(s) and set_key(s) == (k1, k2):
                        sets.append(s.view(np.int64))
                        rows.append(row)
                own = b.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sets, pa.list_(pa.int64())), *own.columns[2:5]], names=["id", "tokens", *b.schema.names[2:5]])

    return run


def _leaves(sketches: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(path, id, size): sets in the leaves of all runs' trees, without leaves of one set."""
    leaves = []
    rows = sketches.mapInArrow(_roots(runs_needed(threshold, recall)), "path long, id long").withColumn("above", F.lit(sketches.count()).cast("long"))
    depth = 1
    while True:
        rows = materialize(rows, f"paths{depth}")
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.first("above").alias("above")).where("size > 1")
        goes_on = (F.col("size") > SMALL) & (F.col("size") <= ALIKE * F.col("above"))
        # few: each holds more than SMALL sets
        crowded = materialize(sizes.where(goes_on).select("path", "size"), "crowded")
        leaves.append(rows.select("path", "id").join(sizes.where(~goes_on), "path").select("path", "id", "size"))
        if not crowded.limit(1).count():
            break
        more = rows.select("path", "id").join(crowded, "path").join(sketches, "id").select("path", "id", "sketch", "size")
        rows, depth = more.mapInArrow(_split, "path long, id long, above long"), depth + 1
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    return out


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """(id_col, class_id, n_links, component_id), one row per row of ``docs``; ids are whole numbers.

    ``class_id``: least id with the same shingle set. ``n_links``: other documents at similarity >= ``threshold``, copies
    counted each. ``component_id``: least id reachable by links. A text of fewer than ``width`` words is one shingle of all its words;
    null or empty texts, and rows with null id, link with nothing and are their own class. Rows that repeat an id are
    documents of their own; of those with equal text each counts as a copy of the other. An empty table gives no rows; extra columns are not read.
    """
    spark = docs.sparkSession
    rng = np.random.default_rng(20240229)
    spans = rng.integers(1, 1 << 63, size=COORDINATES, dtype=np.uint64)
    rows, kind = numbered(docs.select(F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("__text")), "own")
    # texts are found by a key that no other row has
    key = F.col("own") if kind == "long" else F.col("__id.row")
    base = rows.select(key.alias("id"), "__text")
    signed = materialize(base.mapInArrow(_sign(width, spans), "id long, n int, k1 long, k2 long, sketch binary"), "signed")
    signed = signed.withColumn("own", F.col("id")) if kind == "long" else signed.join(rows.select(key.alias("id"), "own"), "id")
    real = signed.where("n > 0 and own is not null")
    first = F.struct("own", "id")
    classes = real.groupBy("k1", "k2", "n").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("weight"), F.min_by("sketch", first).alias("sketch"))
    classes = classes.select("k1", "k2", "n", F.col("first.id").alias("rep"), F.col("first.own").alias("least"), "weight", "sketch")
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    sketches = classes.select(F.col("node").alias("id"), "sketch")

    met = _blocked(_leaves(sketches, threshold, recall), "path", F.ceil(F.col("size") / BLOCK_SETS)).join(sketches, "id").select("path", "bi", "bj", "id", "block", "sketch")
    guesses = materialize(_dealt(met, "path", "bi", "bj").mapInArrow(_compare_sketches(least_agreement(threshold, recall)), "a long, b long, heavy boolean"), "guesses")
    groups = materialize(components(guesses.where("heavy").select("a", "b"), "guessed").distinct(), "groups")
    group_of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"group_{end}"))
    pairs = guesses.where("not heavy").select("a", "b").distinct().join(group_of("a"), "a", "left").join(group_of("b"), "b", "left")
    pairs = materialize(pairs.where("group_a is null or group_b is null or group_a <> group_b").select("a", "b"), "pairs")

    # verification on whole sets; the text of a class is that of its first row
    partners = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
    members = partners.join(classes.select("node", "rep", "weight", "n", "k1", "k2"), "node").select(F.col("rep").alias("id"), "node", "weight", F.col("n").cast("long").alias("n"), "k1", "k2")
    one = base.join(members, "id").select("node", "__text", F.lit(0).cast("long").alias("grp"), "weight", "n", "k1", "k2")
    sets = one.mapInArrow(_tokens(width), "id long, tokens array<long>, grp long, weight long, n long").drop("grp")
    sets = materialize(sets, "sets")
    side = lambda end: sets.select(F.col("id").alias(end), F.col("weight").alias(f"weight_{end}"), F.col("tokens").alias(f"tokens_{end}"))
    by_pair = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("both", F.size(F.array_intersect("tokens_a", "tokens_b")))
    by_pair = by_pair.where((F.col("both") > 0) & (F.col("both") >= threshold * (F.size("tokens_a") + F.size("tokens_b") - F.col("both")) - 1e-6))
    ways = F.array(F.struct("a", "b", F.col("weight_b").alias("links")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight_a").alias("links")))
    found = by_pair.select(F.inline(ways))
    links = "a long, b long, links long"
    grouped = sets.join(groups.select(F.col("node").alias("id"), F.col("component").alias("grp")), "id")
    load = grouped.groupBy("grp").agg((F.floor(F.sum("n") / BLOCK_TOKENS) + 1).alias("blocks"))
    blocked = _blocked(grouped.join(load, "grp"), "grp", F.col("blocks")).select("grp", "bi", "bj", "id", "block", "weight", "tokens")
    found = materialize(found.unionByName(_dealt(blocked, "grp", "bi", "bj").mapInArrow(_verify(width, threshold), links)), "links")
    linked = components(found.select("a", "b"), "linked").distinct().join(classes.select("node", "least"), "node")
    least_id = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(least_id, "component").select("node", "component_id")
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))

    named = classes.join(counts, "node", "left").join(linked, "node", "left")
    named = named.select("k1", "k2", "n", F.col("least").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = real.select("own", "k1", "k2", "n").join(named, ["k1", "k2", "n"]).select(F.col("own").alias(id_col), "class_id", "n_links", "component_id")
    alone = signed.where("n = 0 or own is null").select(F.col("own").alias(id_col), F.col("own").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("own").alias("component_id"))
    return out.unionByName(alone)
