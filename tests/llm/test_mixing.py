from __future__ import annotations

import re
from collections import defaultdict

import pytest

from listenlake.llm.mixing import mix_sources, repeated
from listenlake.llm.queries import SQL, op9_mix_sources


def filled(sizes: dict, weights=(5, 2, 1), cap=3.0):
    """Targets by pouring the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(cap * sizes[s] for s in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / sum(w[x] for x in free) for s in order}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, got, copies_at_most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    target = filled(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= copies_at_most
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] + 1e-6


def test_targets_and_takes(spark):
    rows = [(i, "w " * (i % 7 + 1), "abcde"[i % 5] if i % 11 else None) for i in range(200)]
    rows += [(1000 + i, "x " * 400, "big") for i in range(30)] + [(2000, None, "empty"), (2001, "", "empty"), (3000, "one", "tiny"), (None, "q q", "a"), (None, "q q", "a"), (5, "again " * 3, "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "7 AS target", "'z' AS size")
    got = mix_sources(df).collect()
    check(rows, got)
    key = lambda r: (str(r.doc_id), r.source or "", r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mix_sources(df.repartition(7)).collect()))
    mixed = repeated(mix_sources(df), ["doc_id", "text"])
    assert mixed.count() == sum(r.copies for r in got) and mixed.columns == ["doc_id", "text"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0
    zero = spark.createDataFrame([(1, "", "a"), (2, None, None)], df.schema)
    assert [r.copies for r in mix_sources(zero).collect()] == [0, 0]


def test_query_equals_sql(spark, sf):
    import duckdb

    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(SQL["op9_mix_sources"]).fetchall())
    assert sorted(map(tuple, op9_mix_sources(spark, sf).collect())) == want


def test_rows_without_an_id_are_taken_alike_in_reruns(spark):
    rows = [(None if i % 2 else 5, f"w{i} x{i}", "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = lambda d: sorted((r.text, r.copies) for r in mix_sources(d).collect())
    assert taken(df.repartition(5, "text")) == taken(df.repartition(3))


def test_native(spark, sf):
    plan = op9_mix_sources(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
