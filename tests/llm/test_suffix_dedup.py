from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from listenlake.llm import suffix_dedup
from listenlake.llm.queries import op12_suffix_dedup
from listenlake.llm.suffix_dedup import SuffixArray, dedup_bytes, intervals, maximal_repeats, repeat_groups


def plain(docs, least=100):
    """[(id, bytes, removed, runs, digest)] from every string of ``least`` bytes; docs in order."""
    seen, out = set(), []
    for i, text in docs:
        t = (text or "").encode()
        gone = bytearray(len(t))
        for a in range(len(t) - least + 1):
            w = t[a : a + least]
            if w in seen:
                gone[a : a + least] = b"\1" * least
            seen.add(w)
        rest = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(30) for _ in range(4)] + [prose(14)[:100], prose(14)[:99]]
    docs = []
    for _ in range(120):
        parts = [prose(r.randint(0, 40))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            cut = r.choice([p, p, p[r.randint(0, 20) :], p[: len(p) - r.randint(0, 20)], p[: len(p) // 2] + "#" + p[len(p) // 2 :]])
            parts += [cut, prose(r.randint(0, 12))]
        docs.append("".join(parts) if r.random() < 0.5 else " ".join(parts))
    docs += [docs[3], docs[3], docs[5] + " x", "y" + docs[5], "ab" * 400, "a" * 900, "b" + "a" * 350 + "c", "x" * 99, "x" * 100, "x" * 101, "", None, "\0" * 300, "q\0\0" * 80, "é" * 120, prose(4000)]
    docs.append(docs[-1][100:9000] + docs[-1][:700])
    return docs


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 5])
def test_against_every_string(spark, crowd):
    docs = list(enumerate(corpus(1)))
    random.Random(2).shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).selectExpr("*", "1 AS key", "'x' AS h", "3 AS id", "5 AS n_bytes", "0 AS pos")
    assert sorted(rows(dedup_bytes(df, crowd=crowd))) == plain(sorted(docs, key=lambda d: d[0]))


def test_short_strings_and_texts_kept(spark):
    docs = list(enumerate(corpus(4)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = dedup_bytes(df, least=7, with_text=True)
    assert sorted(rows(got)) == plain(docs, 7)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_null_and_repeated_ids(spark):
    text = corpus(1)[0] * 3
    docs = [(None, text), (None, text), (4, text), (4, text), (2, "z" + text), (9, None)]
    got = dedup_bytes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 6
    own = plain([(0, text)])[0][2]
    left = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes - r.n_removed) for r in got)
    assert [x for x in left if not x[0][0]] == [((False, 0), 0), ((False, 0), len(text.encode()) - own)]
    assert dict((k[1], v) for k, v in left if k[0]) == {4: 0, 2: 1, 9: 0}


def test_empty_table(spark):
    assert dedup_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert repeat_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_intervals_of_a_common_prefix_array():
    strings = sorted([b"aab", b"aac", b"ab", b"abx", b"abx", b"b", b"bb"])
    sa = SuffixArray(np.zeros(len(strings), dtype=np.int64), pa.array(strings, pa.binary()), 3)
    assert [strings[i] for i in sa.order] == strings
    assert set(intervals(sa.lcp.tolist())) == {(2, 0, 1), (3, 3, 4), (2, 2, 4), (1, 0, 4), (1, 5, 6), (0, 0, 6)}


def test_zero_bytes_sort_behind_ends():
    strings = [b"ab\0\0", b"ab", b"ab\0\1", b"ab\0"]
    sa = SuffixArray(np.zeros(4, dtype=np.int64), pa.array(strings, pa.binary()), 4)
    assert [strings[i] for i in sa.order] == [b"ab", b"ab\0", b"ab\0\0", b"ab\0\1"] and sa.lcp.tolist() == [-1, 2, 3, 3]


@pytest.mark.parametrize("seed", range(20))
def test_maximal_repeats_of_one_anchor(seed):
    r = random.Random(seed)
    gram, least = 2, 6
    n, reach = 9, 4
    sides = [("".join(r.choice("ab") for _ in range(r.randint(0, reach))).encode(), "".join(r.choice("ab") for _ in range(r.randint(0, reach))).encode()) for _ in range(n)]
    group = np.sort(np.array([r.randint(0, 1) for _ in range(n)]))
    want = set()
    for i in range(n):
        for j in range(n):
            if i != j and group[i] == group[j]:
                left, right = (sum(1 for _ in iter_common(a, b)) for a, b in ((sides[i][0][::-1], sides[j][0][::-1]), (sides[i][1], sides[j][1])))
                if left + gram + right >= least:
                    tail, head = sides[i][0][len(sides[i][0]) - left :], sides[i][1][:right]
                    want.add((left, gram + right, frozenset(k for k in range(n) if group[k] == group[i] and sides[k][0].endswith(tail) and sides[k][1].startswith(head))))
    got = [(a, b, frozenset(m.tolist())) for a, b, m in maximal_repeats(group, pa.array([s[0] for s in sides], pa.binary()), pa.array([s[1] for s in sides], pa.binary()), gram, least)]
    assert set(got) == want and len(got) == len(want)


def iter_common(a, b):
    for x, y in zip(a, b):
        if x != y:
            return
        yield x


@pytest.mark.parametrize("crowd", [suffix_dedup.CROWD, 3])
def test_groups_hold_all_occurrences(spark, crowd):
    docs = {i: t for i, t in enumerate(corpus(7)[:60]) if t}
    got = repeat_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), crowd=crowd).collect()
    by = {}
    for r in got:
        by.setdefault((r.group, r.length), []).append((r.doc_id, r.start))
    everywhere = {}
    for i, t in docs.items():
        b = t.encode()
        for a in range(len(b) - 99):
            everywhere.setdefault(b[a : a + 100], set()).add((i, a))
    covered = set()
    for (_, length), places in by.items():
        strings = {docs[i].encode()[a : a + length] for i, a in places}
        assert len(strings) == 1 and length >= 100 and len(set(places)) == len(places) > 1
        s = strings.pop()
        assert set(places) == {p for p in everywhere[s[:100]] if docs[p[0]].encode()[p[1] : p[1] + length] == s}
        covered |= {(i, a + k) for i, a in places for k in range(length - 99)}
    assert covered == {p for places in everywhere.values() if len(places) > 1 for p in places}


def test_query_against_every_string(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(rows(op12_suffix_dedup(spark, sf))) == plain(docs)
