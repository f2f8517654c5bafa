from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest

from listenlake.llm import substring_dedup
from listenlake.llm.queries import op6_substring_dedup
from listenlake.llm.substring_dedup import FingerprintIndex, dedup_substrings


def brute(rows, width):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def with_history(earlier, rows, width):
    """What brute force gives ``rows`` after ``earlier``: ids are told apart by the call."""
    tagged = [((0, d), t) for d, t in earlier] + [((1, d), t) for d, t in rows]
    return [(d, *rest) for (call, d), *rest in brute(tagged, width) if call]


def passages(seed=2):
    rng = random.Random(seed)
    fresh = lambda n: [f"é{rng.randrange(10**6)}" for _ in range(n)]
    shared = [fresh(n) for n in (5, 6, 7, 20, 60)]
    rows = []
    for i in range(80):
        words = fresh(rng.randrange(0, 30))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            words += p[rng.randrange(0, 3) :] + fresh(rng.randrange(0, 9))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(100, rows[3][1]), (101, rows[5][1] + " "), (102, "a b " * 30), (103, None), (104, ""), (105, " x ")]
    return rows


def test_against_brute_force(spark):
    rows = passages()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for width, batches in ((6, 1), (7, 3)):
        got = dedup_substrings(df, width=width, batches=batches, with_text=True).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, width)


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "q r s t u v"), (None, "z a b c d e f"), (None, "1 2 3 4 5 6 7"), (2, "q r s t u v w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node", "'x' AS prints")
    got = dedup_substrings(df, width=6).collect()
    assert sorted(map(tuple, got), key=str) == sorted((x[:4] for x in brute(rows, 6)), key=str)
    assert dedup_substrings(df.where("false")).count() == 0


def test_index_is_incremental_and_compacts(spark):
    index = FingerprintIndex(spark, most_runs=2)
    batch = lambda *h: spark.createDataFrame([(x,) for x in h], "h long")
    assert {r.h for r in index.add(batch(1, 2, 2)).collect()} == {2}
    assert {r.h for r in index.add(batch(1, 3)).collect()} == {1}
    assert {r.h for r in index.add(batch(4, 3, 5)).collect()} == {3}
    assert len(index.runs) == 1
    assert {r.h for r in index.add(batch(4, 9)).collect()} == {4}


def test_calls_with_one_index_count_history(spark, tmp_path):
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(9)
    copy = " ".join(fresh(12))
    calls = [
        [(1, " ".join(fresh(5) + passage + fresh(4))), (2, copy), (3, None), (4, "a b")],
        [(1, " ".join(fresh(3) + passage + fresh(8))), (5, copy), (6, " ".join(fresh(20)))],
        [(7, " ".join(fresh(9))), (8, copy + " tail"), (9, copy + " tail"), (None, " ".join(passage[1:8]))],
    ]
    earlier: list = []
    for rows in calls:
        # an index of its own a call, as another session has it; three batches each, so that runs are compacted
        index = FingerprintIndex(spark, f"file://{tmp_path}/index", most_runs=2)
        assert bool(index.runs) == bool(earlier)
        got = dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), width=6, batches=3, index=index, with_text=True).collect()
        assert sorted(map(tuple, got), key=str) == sorted(with_history(earlier, rows, 6), key=str)
        earlier += rows
        assert len(index.runs) <= 2
    assert len(index.texts) == 3


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op6_substring_dedup(spark, sf).collect()), key=str) == sorted((x[:4] for x in brute(rows, 35)), key=str)


def test_history_is_joined_without_an_exchange(spark):
    index = FingerprintIndex(spark, most_runs=9)
    batch = lambda a, b: spark.range(a, b).withColumnRenamed("id", "h")
    index.add(batch(0, 5000))
    index.add(batch(4000, 9000))
    joined = index._read(index.runs[0]).select("h").hint("merge").join(index._read(index.runs[1]).select("h"), "h")
    assert joined.count() == 1000
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_compaction_merges_counts(spark):
    index = FingerprintIndex(spark, most_runs=9)
    for i in range(3):
        index.add(spark.range(i * 1000, i * 1000 + 1500).withColumnRenamed("id", "h"))
    index.compact()
    rows = index._read(index.runs[0]).collect()
    assert len(rows) == 3500 and sum(r.n for r in rows) == 4500 and {r.n for r in rows if 1000 <= r.h < 1500} == {2}


def test_rows_without_ids_are_as_cheap_as_others(spark):
    """Texts are fetched by row: of rows that share an id, or have none, no more than one each."""
    passage = " ".join(f"p{i}" for i in range(40))
    text = lambda i: f"{passage} " + " ".join(f"w{i}x{k}" for k in range(30))
    fetched = {}
    for n in (200, 800):
        df = spark.createDataFrame([(None if i % 2 else 7, text(i)) for i in range(n)], "doc_id long, text string")
        seen = []
        real = substring_dedup.materialize
        substring_dedup.materialize = lambda d, name, *a: (seen.append((name, out := real(d, name, *a))), out)[1]
        try:
            got = dedup_substrings(df).collect()
        finally:
            substring_dedup.materialize = real
        assert len(got) == n and {(r.n_words, r.n_removed) for r in got} == {(70, 40)}
        fetched[n] = next(d for name, d in seen if name == "candidates").count()
    assert fetched == {200: 200, 800: 800}


def test_an_index_without_a_path_serves_one_call(spark):
    df = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(40)))], "doc_id long, text string")
    index = FingerprintIndex(spark)
    dedup_substrings(df, index=index).collect()
    with pytest.raises(ValueError, match="one call"):
        dedup_substrings(df, index=index)
