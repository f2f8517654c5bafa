from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

from listenlake.llm import license_scan as L
from listenlake.llm.queries import op1_license_scan


def test_longest_increasing():
    rng = random.Random(2)
    for _ in range(50):
        seq = rng.sample(range(30), 12)
        best = [1] * 12
        for i in range(12):
            best[i] = 1 + max((best[j] for j in range(i) if seq[j] < seq[i]), default=0)
        got = [seq[i] for i in L.longest_increasing(seq)]
        assert got == sorted(got) and len(got) == max(best)


def test_patience_is_an_alignment_and_recurses_into_gaps():
    a, b = "x the cat sat on the mat the end".split(), "the cat lay on the mat at the end".split()
    code = {w: i for i, w in enumerate(set(a + b))}
    pairs = L.patience([code[w] for w in a], [code[w] for w in b])
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert [a[i] for i, _ in pairs] == "the cat on the mat the end".split()


def scan(spark, *texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    return sorted((r.doc_id, r.license, round(r.coverage, 3), r.matched) for r in L.scan_licenses(df, **kw).collect())


def test_exact_edited_and_repeated(spark):
    words = L.TEMPLATES["MIT text"].split()
    rng = random.Random(3)
    edited = " ".join(w for w in words if rng.random() > 0.08)
    filler = "é of the and to in is " * 50
    got = scan(
        spark,
        filler + L.TEMPLATES["MIT text"] + " " + filler,
        filler + edited.lower(),
        "Released under the MIT License.\nfoo bar\nRELEASED under the -- MIT license!",
        None,
        "",
        filler * 20,
        L.TEMPLATES["Apache-2.0 header"],
    )
    assert [(d, n) for d, n, _, _ in got] == [(0, "MIT text"), (1, "MIT text"), (2, "MIT"), (2, "MIT"), (6, "Apache-2.0 header")]
    assert got[0][2] == 1.0 and 0.85 < got[1][2] < 1
    assert got[0][3] == L.TEMPLATES["MIT text"].rstrip(".") and got[3][3].startswith("Rel") or got[2][3].startswith("RELEASED")


def test_places_spread_by_foreign_words():
    code: dict[str, int] = {}
    words = lambda t: np.array([code.setdefault(w, len(code)) for w in re.findall("[a-z0-9]+", t.lower())], dtype=np.int64)
    goal = words(L.TEMPLATES["Apache-2.0"])
    marked = 'Licensed under the <a href="https://example.org/legal/terms.html" target="_blank" rel="noopener">Apache License</a>, Version 2.0'
    assert len(L.patience(words(marked).tolist(), goal.tolist())) == len(goal)
    filler = "here is some of the text under which a version of it stands " * 9
    for text, n in ((marked, 1), (filler + marked + filler, 1), (filler.join([marked] * 3), 3)):
        got = L.scan(words(text), goal, 0.8)
        assert len(got) == n and all(share >= 0.8 for share, _, _ in got)
    rng = random.Random(6)
    for name in ("MIT text", "GPL header", "BSD-2-Clause"):
        goal = words(L.TEMPLATES[name])
        text = [x for w in goal.tolist() for x in [w] + [10**6 + rng.randrange(10**6)] * rng.randrange(4)]
        assert [x[0] >= 0.8 for x in L.scan(np.array(text), goal, 0.8)] == [len(L.patience(text, goal.tolist())) >= 0.8 * len(goal)]


def test_words_of_a_notice_far_apart_are_no_place(spark):
    filler = [f"w{i}" for i in range(900)]
    far = " ".join(["Released", *filler, "under", *filler, "the", *filler, "license"])
    near = "Released w0 w1 under w2 w3 the w4 w5 MIT w6 w7 license"
    stray = " ".join(["released", *filler[:40], "under the MIT license", *filler[:40], "MIT license"])
    got = scan(spark, far, " ".join(filler * 3), near, stray, " ".join([far, near, far]))
    assert [(d, n) for d, n, _, _ in got] == [(2, "MIT"), (3, "MIT"), (4, "MIT")]
    assert got[0][2:] == (1.0, near) and got[1][2:] == (0.8, "under the MIT license") and got[2][3] in near
    one = L.scan_licenses(spark.createDataFrame([(1, near)], "doc_id long, text string")).first()
    assert one.density == pytest.approx(5 / 13)
    assert L.scan_licenses(spark.createDataFrame([(1, near)], "doc_id long, text string"), density=0.5).count() == 0


def test_longest_run_against_every_run():
    rng = random.Random(21)
    for _ in range(200):
        at = sorted(rng.sample(range(40), rng.randrange(1, 14)))
        least, density = rng.randrange(1, 8), rng.choice((0.2, 1 / 3, 0.6, 1.0))
        runs = [(j - i + 1, i, j) for i in range(len(at)) for j in range(i, len(at)) if j - i + 1 >= max(least, density * (at[j] - at[i] + 1) - 1e-9)]
        want = max(runs, key=lambda r: (r[0], at[r[1]] - at[r[2]], -r[1]), default=None)
        assert L.longest_run(at, least, density) == (want and want[1:])


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Licensed under CC BY-NC 4.0.")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.license) for r in L.scan_licenses(df).collect()), key=str) == [(1, "MIT"), (1, "MIT"), (None, "CC-BY-NC-4.0")]
    assert L.scan_licenses(df.where("false")).count() == 0


def test_query_finds_every_exact_notice(spark):
    sf = "/root/testdata/sf0.01"
    short = {k: v for k, v in L.TEMPLATES.items() if len(v) < 100}
    fold = lambda t: " " + re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", t) + " "
    tidy = lambda t: re.sub(" +", " ", fold(t))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(d.doc_id, k) for d in docs for k, v in short.items() if tidy(v) in tidy(d.text or "")}
    got = {(r.doc_id, r.license) for r in op1_license_scan(spark, sf).collect() if r.coverage == 1.0}
    assert want and want == got
    assert np.isfinite(len(got))


def aligned(text, goal):
    """Longest common subsequence by dynamic programming: no alignment has more pairs."""
    best = np.zeros(len(goal) + 1, dtype=np.int64)
    for w in text:
        take = np.where(goal == w, best[:-1] + 1, 0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], take))
    return int(best[-1])


def long_template(rng, n=2500):
    """A template as long as a whole license, in the words of one: most are repeated, some occur once."""
    few, many = [f"f{i}" for i in range(60)], [f"m{i}" for i in range(1200)]
    return [rng.choice(few) if rng.random() < 0.55 else rng.choice(many) for _ in range(n)]


def test_whole_long_templates_against_the_longest_alignment():
    rng = random.Random(17)
    code: dict[str, int] = {}
    number = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws], dtype=np.int64)
    template = long_template(rng)
    goal = number(template)
    for lost, foreign in ((0.0, 0.0), (0.05, 0.0), (0.05, 0.1), (0.12, 0.3), (0.4, 0.0)):
        text = [f"u{rng.randrange(300)}" for _ in range(3000)]
        for w in template:
            if rng.random() >= lost:
                text.append(w)
            while rng.random() < foreign:
                text.append(f"u{rng.randrange(300)}")
        text += [f"u{rng.randrange(300)}" for _ in range(1000)]
        best = aligned(number(text), goal) / len(goal)
        got = L.scan(number(text), goal, 0.8)
        # patience finds what the longest alignment does but for a few words around repeated ones
        assert [share > best - 0.02 for share, _, _ in got] == ([True] if best >= 0.8 else [])


def test_shared_words_of_windows():
    rng = random.Random(18)
    for _ in range(20):
        goal = np.array([rng.randrange(9) for _ in range(12)])
        words = np.array([rng.randrange(14) for _ in range(70)])
        want = []
        for lo in range(70):
            for span in (16, 32, 64):
                window = words[lo : lo + span].tolist()
                want.append(sum(min(window.count(x), goal.tolist().count(x)) for x in set(goal.tolist())))
        # the bound is what lets windows be skipped: no place may be found where it is too low
        got = L.scan(words, goal, 0.8)
        assert bool(got) <= (max(want) >= 0.8 * 12)
        assert all(share * 12 <= sum(min(words[a:z].tolist().count(x), goal.tolist().count(x)) for x in set(goal.tolist())) for share, a, z in got)


def test_templates_from_a_table(spark):
    rng = random.Random(19)
    template = long_template(rng, 900)
    text = " ".join(w for w in template if rng.random() > 0.08)
    table = spark.createDataFrame([("long", " ".join(template)), ("short", "this is short"), ("short", "zzz"), ("none", None), (None, "x"), ("blank", " - ")], "name string, text string")
    assert list(L.templates_of(table)) == ["long", "short"]
    got = scan(spark, "before it " + text + " and THIS is: short", templates=table)
    assert [(n, round(c, 1)) for _, n, c, _ in got] == [("long", 0.9), ("short", 1.0)]
    assert scan(spark, text, templates=table.where("false")) == []


def test_a_license_is_not_taken_for_a_longer_one_that_holds_it(spark):
    names = ["MIT grant", "MIT text", "BSD-2-Clause", "BSD-2-Clause text", "BSD-3-Clause text", "ISC text"]
    got = scan(spark, *["Copyright (c) 2020 someone. " + L.TEMPLATES[n] for n in names])
    assert [(d, n) for d, n, c, _ in got if c == 1.0] == list(enumerate(names)) and len(got) == len(names)


COMMON = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not (COMMON / "Apache-2.0").exists(), reason="no license texts on this system")
def test_whole_licenses_of_the_system(spark):
    """Edited copies of whole licenses, thousands of words long, inside other text, by templates from a table."""
    rng = random.Random(20)
    names = [n for n in ("Apache-2.0", "GPL-3", "LGPL-3", "MPL-2.0") if (COMMON / n).is_file()]
    texts = {n: (COMMON / n).read_text(encoding="utf-8", errors="replace") for n in names}
    table = spark.createDataFrame(list(texts.items()), "name string, text string")
    filler = "some words of a program that come before or after its license " * 30
    docs = []
    for n in names:
        words = [w for w in texts[n].split() if rng.random() > 0.06]
        for _ in range(len(words) // 15):
            words.insert(rng.randrange(len(words)), "inserted")
        docs.append(filler + " ".join(words) + " " + filler)
    got = scan(spark, *docs, filler, " ".join(texts[names[0]].split()[:400]), templates=table)
    assert [(d, n) for d, n, _, _ in got] == list(enumerate(names)) and all(c > 0.85 for _, _, c, _ in got)
