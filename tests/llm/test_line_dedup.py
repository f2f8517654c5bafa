from __future__ import annotations

import hashlib
import random

import numpy as np

from listenlake.llm.line_dedup import Lines, dedup_lines
from listenlake.llm.queries import op4_line_dedup


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]


def brute(rows, min_chars):
    lines = sorted(((d, k, x) for d, t in rows if t is not None for k, x in enumerate(t.split("\n"))), key=lambda r: r[:2])
    by_length: dict[int, list[str]] = {}
    gone: dict[int, set[int]] = {}
    exact: set[str] = set()
    for d, k, x in lines:
        if len(x) >= min_chars:
            if x in exact or any(within_one(x, y) for n in (len(x) - 1, len(x), len(x) + 1) for y in by_length.get(n, ())):
                gone.setdefault(d, set()).add(k)
            if x not in exact:
                exact.add(x)
                by_length.setdefault(len(x), []).append(x)
    out = []
    for d, t in rows:
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ()))
        out.append((d, kept, len(gone.get(d, ())), hashlib.sha256((kept or "").encode()).hexdigest()))
    return sorted(out)


def edited(rng, x):
    k, i = rng.randrange(3), rng.randrange(len(x))
    return x[:i] + (rng.choice("aé") if k < 2 else "") + x[i + (k != 0) :]


def test_against_brute_force(spark):
    rng = random.Random(4)
    seeds = ["".join(rng.choices("aéb ü", k=rng.randrange(3, 40))) for _ in range(30)] + ["aaaaaaaaaaaa", "abababababab"]
    rows = []
    for d in range(150):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            x = rng.choice(seeds)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                x = edited(rng, x) if x else x
            lines.append(x)
        rows.append((d, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 30_000 + "\n" + "x" * 30_001)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (4, 10):
        assert sorted(map(tuple, dedup_lines(df, min_chars=least).collect())) == brute(rows, least)


def test_odd_rows(spark):
    rows = [(1, "the same line"), (1, "the same line"), (None, "the same line"), (2, "another line here\nanother line her")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept", "2 AS pos", "3 AS node")
    got = sorted(((r.doc_id, r.kept) for r in dedup_lines(df).collect()), key=str)
    assert (None, "the same line") in got and (2, "another line here") in got and len(got) == 4
    assert dedup_lines(df.where("false")).count() == 0


def test_rows_without_an_id_of_their_own(spark):
    texts = ["shared first line\nonly in the first text", "shared first line\nonly in the second one", "a text by itself\nshared first line\ntwo", "a whole text twice", "a whole text twice"]
    for ids in ([None] * 5, [4] * 5, [None, 7, 7, None, 7]):
        rows = list(zip(ids, texts, range(5)))
        df = spark.createDataFrame(rows, "doc_id long, text string, k int").coalesce(1)
        order = sorted(range(5), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
        want = {order[d]: (kept, n) for d, kept, n, _ in brute([(d, texts[i]) for d, i in enumerate(order)], 10)}
        assert {r.k: (r.kept, r.n_removed) for r in dedup_lines(df).collect()} == want


def test_short_lines_join_by_equality(spark):
    df = spark.createDataFrame([(1, "Share\n \nSharf"), (2, "Share\n \n\nabc"), (3, "abc\nShare")], "doc_id long, text string")
    got = {r.doc_id: r.kept for r in dedup_lines(df, exact_chars=1).collect()}
    assert got == {1: "Share\n \nSharf", 2: " \n\nabc", 3: ""}
    assert all(r.n_removed == 0 for r in dedup_lines(df).collect())


def test_hash_without_a_stretch():
    texts = "héllo wörld\nabc"
    raw = np.frombuffer(texts.encode(), dtype=np.uint8)
    x = Lines(raw, np.array([0, len(raw)]))
    assert x.n.tolist() == [11, 3]
    other = np.frombuffer("hllo wörld".encode(), dtype=np.uint8)
    y = Lines(other, np.array([0, len(other)]))
    at = x.at[:1]
    assert x.without(at, at + 1, at + 2, at + 11, 0x9E3779B97F4A7C15)[0] == y.whole(0x9E3779B97F4A7C15)[0]


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, h) for d, _, n, h in brute(rows, 10))
    assert sorted(map(tuple, op4_line_dedup(spark, sf).collect())) == want
