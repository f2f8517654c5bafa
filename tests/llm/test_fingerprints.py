from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from listenlake.llm import fingerprints as P
from listenlake.llm.queries import op2_fingerprints


def edited(rows):
    order = sorted({i for i, _ in rows}, key=lambda i: (i is not None, i or 0))
    text = dict(rows)
    out = {}
    for i, t in rows:
        t = t or ""
        nxt = text[order[(order.index(i) + 1) % len(order)]] or ""
        k = len(t) // 4
        out[i] = (len(t), t[: len(t) - k] + nxt[:k], nxt)
    return out


def check(df, rows):
    want = edited(rows)
    got = df.collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        n, e, _ = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(dict(rows)[r.doc_id] or "", set()).add(r.fingerprint)
        by_text.setdefault(e, set()).add(r.edited_fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert len({next(iter(v)) for v in by_text.values()}) == len(by_text)
    return got


def test_edits_and_odd_rows(spark):
    rows = [(5, "abcdefgh"), (1, None), (3, "é" * 9 + "\n\nzwei\ndrei"), (None, "first by order"), (9, ""), (7, "abcdefgh"), (11, "a b  c\n\n\nd " * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fingerprint", "2 AS leaves")
    check(P.edit_fingerprints(df), rows)
    assert P.edit_fingerprints(df.where("false")).count() == 0
    assert check(P.edit_fingerprints(df.where("doc_id = 5")), [(5, "abcdefgh")])[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    twice = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (1, "other"), (2, "x")], "doc_id long, text string")
    assert P.edit_fingerprints(twice).count() == 4


def test_branches_locate_an_edit(spark):
    a = "one two\nthree four\n\nfive six\nseven eight"
    b = a.replace("seven", "SEVEN")
    df = spark.createDataFrame([(a,), (b,)], "text string")
    x, y = (r.fingerprint for r in P.fingerprint(df).collect())
    assert x[:64] != y[:64]
    sections = [f[65:-1].split(";") for f in (x, y)]
    assert sections[0][0] == sections[1][0]
    second = [s.split("(")[1].rstrip(")").split(",") for s in (sections[0][1], sections[1][1])]
    assert second[0][0] == second[1][0] and second[0][1] != second[1][1]


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = check(op2_fingerprints(spark, sf), rows)
    long = [r for r in got if r.n_chars > 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 and sum(r.near_next for r in long) / len(long) < 0.1


def test_native(spark, sf):
    plan = op2_fingerprints(spark, sf).where(F.lit(True))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def plain_branches(a, b):
    a, b = ([x.split("\n") for x in t.split("\n\n")] for t in (a, b))
    at = lambda x, i: x[i] if i < len(x) else None
    out = []
    for i in range(max(len(a), len(b))):
        x, y = at(a, i) or [], at(b, i) or []
        out += [(i, j) for j in range(max(len(x), len(y))) if at(x, j) != at(y, j)]
    return out


def test_differing_branches(spark):
    a = "one two\nthree four\n\nfive six\nseven eight\n\nnine"
    pairs = [(a, a), (a, a.replace("seven", "SEVEN")), (a, a + "\nten"), (a + "\n\nten\neleven", a), ("", "x"), ("", ""), (a, a.replace("two", "2").replace("nine", "9")), (None, a)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    x = P.fingerprint(df, text_col="a").select("i", "b", F.col("fingerprint").alias("x"))
    got = P.fingerprint(x, text_col="b").select("i", P.differing_branches(F.col("x"), F.col("fingerprint")).alias("d")).orderBy("i").collect()
    assert [[(r.section, r.paragraph) for r in g.d] for g in got] == [plain_branches(a or "", b) for a, b in pairs]


def plain_leaves(text):
    """Distinct leaf hashes, from the definition."""
    import xxhash

    out = set()
    for p in (p for s in text.split("\n\n") for p in s.split("\n")):
        runs = [[]]
        for w in p.split(" "):
            runs[-1].append(w)
            if xxhash.xxh64_intdigest(w.encode(), 42) % P.LEAF_WORDS == 0:
                runs.append([""])
        # a run after an ended one begins with the space between them, and the last word's end leaves an empty run
        if len(runs) > 1 and runs[-1] == [""]:
            runs[-1] = []
        out |= {xxhash.xxh64_intdigest(" ".join(r).encode(), 42) >> 32 for r in runs}
    return out


def test_query_locates_its_edits_and_likeness_is_of_the_leaves(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = edited(rows)
    dice = lambda x, y: 2 * len(x & y) / (len(x) + len(y))
    for r in op2_fingerprints(spark, sf).collect():
        n, e, nxt = want[r.doc_id]
        text = dict(rows)[r.doc_id] or ""
        branches = plain_branches(text, e)
        assert r.n_branches == len(branches)
        assert (r.first_section, r.first_paragraph) == (branches[0] if branches else (None, None))
        assert abs(r.near_edited - dice(plain_leaves(text), plain_leaves(e))) < 1e-9
        assert abs(r.near_next - dice(plain_leaves(text), plain_leaves(nxt))) < 1e-9


def test_a_word_left_out_changes_little(spark):
    words = [f"w{i % 37}x{i}" for i in range(400)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:3] + words[4:]))], "a string, b string")
    near = df.select(P.likeness(P.leaf_set(P.tree(F.col("a"))), P.leaf_set(P.tree(F.col("b")))).alias("n")).first().n
    assert near > 0.95
