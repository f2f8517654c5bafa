from __future__ import annotations

import numpy as np
import pyarrow as pa

from listenlake.llm.embedding_dedup import _cells, metric_join
from listenlake.llm.queries import op5_embedding_dedup


def brute(rows, threshold=0.93):
    ids, unit, labels = [], [], []
    for i, v, label in rows:
        ids.append(i)
        labels.append(label)
        ok = v is not None and len(v) > 0 and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(np.array(v) != 0)
        unit.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if ok and label is not None else None)
    top = list(range(len(ids)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(ids)
    for a in range(len(ids)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and labels[a] == labels[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                top[find(a)] = find(b)
    least = {}
    for k in range(len(ids)):
        least[find(k)] = min(ids[k], least.get(find(k), ids[k]))
    return sorted((ids[k], links[k], least[find(k)], ids[k] == least[find(k)]) for k in range(len(ids)))


def test_cells_and_blocks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(400):
        v = centres[rng.integers(12)] + rng.normal(size=6) * rng.choice([0.0, 0.2, 0.6])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3)) if i % 17 else None))
    rows += [(500, None, 1), (501, [0.0] * 6, 1), (502, [float("nan")] + [1.0] * 5, 1), (503, [float("inf")] + [1.0] * 5, 1), (504, [None] + [1.0] * 5, 1), (505, [], 1), (506, [1.0, 2.0], 1), (507, [1.0, 2.0], 1)]
    rows += [(600 + i, rows[1][1], rows[1][2]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS id", "2 AS cell")
    got = metric_join(df, per_pivot=20, block=16).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert metric_join(df.where("false")).count() == 0


def test_pivots_that_rounding_alone_tells_apart():
    rng = np.random.default_rng(8)
    hot = rng.normal(size=7)
    x = np.stack([v / np.linalg.norm(v) for v in [*(hot * s for s in rng.uniform(0.1, 9, size=200)), *(hot + rng.normal(size=7) * 0.05 for _ in range(60))]])
    n = len(x)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.zeros(n, dtype=np.int64)), pa.array(np.full(n, 7)), pa.array([v.tobytes() for v in x], pa.binary())], names=["id", "label", "dim", "vec"])
    out = pa.Table.from_batches(list(_cells({(0, 7): np.unique(x[:200], axis=0)}, np.sqrt(2 - 2 * 0.93))([batch]))).to_pylist()
    cells = {r["id"]: set() for r in out}
    home = {r["id"]: r["cell"] for r in out if r["home"]}
    for r in out:
        cells[r["id"]].add(r["cell"])
    near = x @ x.T >= 0.93
    assert all(home[i] in cells[j] for i, j in zip(*np.nonzero(near)))


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_embedding_dedup(spark, sf).collect())) == brute(rows)


def test_rows_without_an_id_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (None, [0.0, 1.0], 1), (None, [0.0, 3.0], 1), (5, [1.0, 0.01], 1), (5, [-1.0, 0.0], 1), (None, None, 1), (None, [1.0, 0.0], None)]
    got = metric_join(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    want = [(1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (5, 2, 1, False), (5, 0, 5, True), (None, 0, None, True), (None, 0, None, True)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_crowded_cells_are_cut_again_and_compare_less(spark):
    """Clusters in space: comparisons at default settings, against all pairs, at two sizes."""
    from listenlake.llm import embedding_dedup as E
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    compared = {}
    for n in (1500, 7500):
        centres = rng.normal(size=(n // 50, 6))
        x = centres[rng.integers(len(centres), size=n)] + rng.normal(size=(n, 6)) * 0.05
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, bytes(v.tobytes())) for i, v in enumerate(x)], "id long, vec binary")
        points = df.selectExpr("id", "7L AS label", "6 AS dim", "vec", "1L AS weight")
        cells = E._inner_cells(points, np.sqrt(2 - 2 * 0.93), E.PER_PIVOT, E.MOST_PIVOTS)
        per = cells.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home").cast("int")).alias("own")).collect()
        assert sum(r.own for r in per) == n and len(per) > 4
        compared[n] = sum(r.n * r.own for r in per)
    print(compared)
    assert compared[1500] < 0.5 * 1500**2 and compared[7500] < 0.25 * 7500**2
