from __future__ import annotations

import math

import numpy as np
import pytest

from listenlake.llm.queries import op11_whitening
from listenlake.llm.whitening import SHIFT, fit, grid, whiten


def plain(rows, components=16):
    """Whitening in one matrix; {id: [(deviation, projections)]} and eigenvalues over the trace."""
    kept = [(i, [math.floor(64 * c) + SHIFT for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in distinct])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors / np.sqrt(np.maximum(values, 1e-300))) for i, x in kept]
    return n, out, values / values.sum(), min(components, len(sums))


def compare(got, rows, close=1e-8):
    n, want, share, k = plain(rows)
    assert len(got) == len(want) * k
    by = {}
    for r in got:
        by.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == n and r.explained == pytest.approx(share[r.component - 1], rel=1e-9) and 0 <= r.identity_error < 1e-8
    mine, theirs = [], []
    for i, d, y in sorted(want, key=lambda w: (str(w[0]), w[1])):
        theirs.append(y[:k])
        mine.append([by[i, d][c].pop() for c in range(1, k + 1)])
    mine, theirs = np.array(mine), np.array(theirs)
    signs = np.sign((mine * theirs).sum(axis=0))
    assert np.abs(mine * signs - theirs).max() < close


def structured(n, dims, seed=1):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dims)) * np.r_[np.linspace(40, 8, 20), np.full(dims - 20, 0.5)] @ np.linalg.qr(rng.standard_normal((dims, dims)))[0] + 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'q' AS id", "2.0D AS x", "0 AS component")


def test_structured_vectors_settle_in_passes(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(structured(700, 96))]
    rows += [(5, rows[0][1]), (None, rows[1][1]), (9000, rows[2][1]), (9001, None), (9002, [None] * 96), (9003, [float("nan")] + [0.0] * 95), (9004, [float("inf")] + [0.0] * 95)]
    df = frame(spark, rows)
    model = fit(grid(df))
    assert not model.full and model.passes <= 12 and model.n == 700
    compare(whiten(df).collect(), rows)


def test_cloud_without_structure_needs_all_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 64)))]
    df = frame(spark, rows)
    assert fit(grid(df)).full
    compare(whiten(df).collect(), rows)


def test_far_from_the_origin_and_few_dimensions(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (v * [1, 0.25, 7] + [1e6, -1e6, 5e5]).tolist()) for i, v in enumerate(rng.standard_normal((300, 3)))]
    compare(whiten(frame(spark, rows)).collect(), rows)


def test_deviations_are_exact_beyond_longs(spark):
    rows = [(i, [float(i) * 2**40, -float(i % 7) * 2**39]) for i in range(50)]
    got = whiten(frame(spark, rows)).collect()
    want = {i: d for i, d, _ in plain(rows)[1]}
    assert max(want.values()) > 1 << 64 and {r.vec_id: int(r.deviation) for r in got} == want


def test_no_rows_without_variance(spark):
    assert whiten(frame(spark, [])).count() == 0
    assert whiten(frame(spark, [(1, None), (2, [None])])).count() == 0
    assert whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    assert whiten(frame(spark, [(1, []), (2, [])])).count() == 0
    flat = [(i, [float(i), float(i), 0.0]) for i in range(10)]
    got = whiten(frame(spark, flat)).collect()
    assert {r.component for r in got} == {1} and got[0].explained == pytest.approx(1.0)


def test_other_lengths_go_and_too_large_entries_fail(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(9)]
    assert {r.vec_id for r in whiten(frame(spark, [*rows, (50, [1.0]), (51, [1.0, 2.0, 3.0])])).collect()} == set(range(9))
    with pytest.raises(Exception, match="too large"):
        whiten(frame(spark, [(1, [1e300])])).collect()


def test_query_against_one_matrix(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op11_whitening(spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint"
    compare(got.collect(), rows)
