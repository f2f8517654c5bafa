from __future__ import annotations

import re
from collections import defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from listenlake.llm.filter_audit import audit_filters, shares
from listenlake.llm.queries import SQL, op13_filter_audit


def plain(docs, labels):
    """Every order walked filter by filter over every document."""
    flags = defaultdict(lambda: [0, 0])
    for i, q, t in labels:
        if i is not None:
            flags[i][0] |= q == 1
            flags[i][1] |= t == 1
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        rows.append((lang or "", {c for c, f in fails.items() if f}, *(flags[i] if i is not None else (0, 0))))
    out, shapley = {}, defaultdict(int)
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for k, c in enumerate(order):
                here = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                unique = sum(r[0] == part and r[1] == {c} for r in rows)
                out[part, "".join(order), k + 1] = (len(left), len(here), sum(c in r[1] for r in gone), unique, sum(r[2] for r in here), sum(r[3] for r in here))
                gone += here
                shapley[part, c] += len(here)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def of(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in FIGURES) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_against_walking_every_order(spark):
    long = " ".join(f"w{i}" for i in range(120))
    texts = [long, long, long + " # x", "SHORT TEXT", None, "", "a " * 150, "A " * 99 + "b$", long.upper(), "é" * 30, " x　y " * 70, "x\x0by\x0cz " * 40, "AB cdefghijklmnopqr", "ABc defghijklmnopqrs"]
    docs = [(i * 3 % 17, t, ["en", None, "", "fr"][i % 4]) for i, t in enumerate(texts)]
    docs += [(None, long, "en"), (None, None, "fr"), (3, long, "en"), (3, long, "en"), (40, long, "de"), (41, long, "de")]
    labels = [(0, 1, 0), (0, 0, 1), (3, 1, None), (6, None, 1), (40, 1, 1), (99, 1, 1), (None, 1, 1), (40, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "'q' AS part", "2L AS id", "true AS filter")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "5 AS good", "7 AS id")
    got = audit_filters(df, lab)
    assert of(got) == plain(docs, labels)
    whole = {(r.part, r["filter"]): r.share for r in shares(got).collect()}
    for part in ("", "de", "en", "fr"):
        failing = sum((lang or "") == part for _, _, lang in docs) - got.where((F.col("part") == part) & (F.col("step") == 5)).first().kept
        assert sum(v for (p, _), v in whole.items() if p == part) == pytest.approx(failing)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], docs.schema)
    got = of(audit_filters(one, labels))
    assert len(got) == 600 and got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_own_filters_and_their_bound(spark):
    docs = spark.createDataFrame([(1, "ab", "x"), (2, "b", "x"), (3, "c", "x")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = of(audit_filters(docs, labels, filters=lambda t: {"P": t.contains("a"), "Q": t.contains("b")}, repeats=""))
    assert got["x", "PQ", 2][:3] == (1, 1, 1) and got["x", "QP", 1][:3] == (1, 2, 0)
    with pytest.raises(ValueError):
        audit_filters(docs, labels, filters=lambda t: {c: t.contains(c) for c in "ABCDEFGH"})


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(SQL["op13_filter_audit"])
    got = op13_filter_audit(spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, got.select(*want.columns).toPandas().itertuples(index=False, name=None))) == sorted(map(str, want.df().itertuples(index=False, name=None)))
