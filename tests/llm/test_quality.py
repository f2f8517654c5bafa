from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa

from listenlake.llm.kernels import text_buffer
from listenlake.llm import quality as Q
from listenlake.llm.queries import op8_quality


def test_weak_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    n, m = 20_000, len(Q.LABELLERS)
    y = rng.random(n) < 0.8
    right = np.linspace(0.65, 0.95, m)
    v = np.where(rng.random((n, m)) < right, y[:, None], ~y[:, None]).astype(np.int64)
    v[rng.random((n, m)) < 0.3] = Q.ABSTAIN
    codes, counts = np.unique(Q.code(v), return_counts=True)
    model = Q.fit_weak(dict(zip(codes.tolist(), counts.tolist())))
    assert abs(model.prior - 0.8) < 0.03
    assert np.abs(model.chance[1, :, Q.GOOD] - right).max() < 0.05
    assert ((model.posterior(v) > 0.5) == y).mean() > 0.9
    assert (Q.decode(Q.code(v)) == v).all()


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r.keep for r in op8_quality(spark, sf).collect()}
    assert len(got) == 1000
    clean = [got[d] for d, y in labels.items() if y == 1]
    junk = [got[d] for d, y in labels.items() if y == 0]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.1


def test_odd_rows(spark):
    rows = [(1, None, 0.1), (1, "", 0.2), (None, "x " * 9000, 0.3), (2, "The house of the man is in the town and it was good.", 0.4), (2, "The house of the man is in the town and it was good.", 0.4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality double")
    got = Q.quality_scores(df).collect()
    assert len(got) == 5 and not any(r.keep for r in got if not r.text)
    assert len({r.quality for r in got if r.doc_id == 2}) == 1
    assert Q.quality_scores(df.where("false")).count() == 0


def features(*texts):
    return Q.Features(*text_buffer(pa.array(texts)))


def plain_votes(text):
    """The labellers' definitions, text by text and word by word."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = max(len(w), 1)
    letter = lambda c: (c.isascii() and c.isalpha()) or (ord(c) >= 0xC0 and not 0x2000 <= ord(c) < 0x3000)
    letters = max(sum(map(letter, text)), 1)
    latin = 2 * sum(letter(c) and ord(c) >= 0x280 for c in text) <= letters
    share = lambda x, low, high: Q.GOOD if x <= low else Q.BAD if x >= high else Q.ABSTAIN
    variety, function = len(set(w)) / n, sum(x in set(Q.FUNCTION_WORDS) for x in w) / n
    stops, mean = sum(text.count(c) for c in ".?") / n, sum(map(letter, text)) / n
    out = [
        share(sum(sum(x.count(c) for c in "#$%&*+<=>@[\\]^_`{|}~") >= 2 for x in w) / n, 0.02, 0.2),
        share(text.count("!") / n, 0.05, 0.4),
        share(sum(c.isascii() and c.isupper() for c in text) / letters, 0.12, 0.4) if latin else Q.ABSTAIN,
        share(sum(a == b for a, b in zip(w, w[1:])) / n, 0.05, 0.3),
        Q.ABSTAIN if len(w) < 20 else Q.GOOD if variety >= 0.3 else Q.BAD if variety <= 0.12 and len(w) < 2000 else Q.ABSTAIN,
        share(w.count("|") / n, 0.02, 0.15),
        Q.ABSTAIN if len(w) < 20 or not latin else Q.GOOD if function >= 0.15 else Q.BAD if function <= 0.04 else Q.ABSTAIN,
        Q.ABSTAIN if len(w) < 20 or not latin else Q.GOOD if 0.02 <= stops <= 0.5 else Q.BAD if stops < 0.005 else Q.ABSTAIN,
        Q.ABSTAIN if not latin else Q.GOOD if 2.5 <= mean <= 9 else Q.BAD if mean < 1.5 or mean > 14 else Q.ABSTAIN,
    ]
    return out


def plain_weak(votes, rounds=100):
    """Expectation-maximisation row by row: (prior, chance[class][labeller][vote]) and each row's posterior."""
    p = []
    for v in votes:
        good, bad = v.count(Q.GOOD), v.count(Q.BAD)
        p.append(0.35 * good / max(good + bad, 1) if bad else 0.5 + 0.5 * good / max(good + bad, 1))
    for _ in range(rounds):
        chance = [[[1.0, 1.0] for _ in Q.LABELLERS] for _ in (0, 1)]
        for v, q in zip(votes, p):
            for k, x in enumerate(v):
                if x != Q.ABSTAIN:
                    chance[0][k][x] += 1 - q
                    chance[1][k][x] += q
        chance = [[[x / sum(c) for x in c] for c in side] for side in chance]
        for k in range(len(Q.LABELLERS)):
            chance[1][k][Q.BAD] = min(chance[1][k][Q.BAD], chance[0][k][Q.BAD])
            chance[1][k][Q.GOOD] = 1 - chance[1][k][Q.BAD]
        prior = min(max(sum(p) / len(p), 0.05), 0.95)
        before, p = p, []
        for v in votes:
            good = math.log(prior) + sum(math.log(chance[1][k][x]) for k, x in enumerate(v) if x != Q.ABSTAIN)
            bad = math.log(1 - prior) + sum(math.log(chance[0][k][x]) for k, x in enumerate(v) if x != Q.ABSTAIN)
            p.append(1 / (1 + math.exp(bad - good)))
        if max(abs(a - b) for a, b in zip(p, before)) < 1e-9:
            break
    return prior, chance, p


def test_query_against_brute_force(spark, sf):
    """Votes and posteriors of every document from plain loops; the scorer's sums word by word from its weights."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in op8_quality(spark, sf).collect()}
    rows = docs.collect()
    texts = [r.text or "" for r in rows]
    votes = [plain_votes(t) for t in texts]
    assert Q.votes(features(*texts)).tolist() == votes
    prior, chance, posterior = plain_weak(votes)
    model = Q.fit_quality(docs)
    assert abs(model.weak.prior - prior) < 1e-9 and np.abs(model.weak.chance - np.array(chance)).max() < 1e-9
    assert np.abs(model.weak.chance.sum(axis=2) - 1).max() < 1e-12
    for r, t, p in zip(rows, texts, posterior):
        f = features(t)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        z = sum(model.weights[s] for per_word in Q.slots(f).T.tolist() for s in per_word) / max(len(words), 1) + model.offset
        want = 1 / (1 + math.exp(-min(max(z, -30), 30))) if words else 0.0
        assert abs(got[r.doc_id].quality - want) < 1e-9 and got[r.doc_id].keep == (want >= 0.5)
        assert abs(got[r.doc_id].weak - (p if words else 0.0)) < 1e-9


def test_other_scripts_have_no_bad_votes():
    russian = "Сегодня утром мы пошли в старый парк и долго гуляли по аллеям, а потом сели на скамейку у пруда. " * 3
    hindi = "आज सुबह हम पुराने बाग में गए और बहुत देर तक घूमते रहे। फिर हम तालाब के पास बैठ गए। " * 3
    chinese = "今天早上我们去了老公园，在小路上走了很久。然后我们坐在池塘边的长椅上。" * 3
    v = Q.votes(features(russian, hindi, chinese))
    assert not (v == Q.BAD).any() and (v == Q.GOOD).any(axis=1).all()


def test_a_hot_text_counts_once_in_the_draw_and_reruns_agree(spark):
    good = ["The man of the house %d is in the town and it was good to see that, as he said." % i for i in range(60)]
    junk = ["## $$ %% && ** @@ || || {%d} [[ ]] << >> ~~ ^^ ``" % i for i in range(25)]
    hot = "A text of which there are many copies is in the table and it is a text like the other ones."
    df = spark.createDataFrame([(t,) for t in good + junk + [hot] * 3000], "text string")
    a = Q.fit_quality(df.repartition(7), sample_rows=30)
    b = Q.fit_quality(df.repartition(3), sample_rows=30)
    assert np.array_equal(a.weights, b.weights) and a.offset == b.offset
    kept = {r.text: r.keep for r in Q.quality_scores(df, sample_rows=60).distinct().collect()}
    assert all(kept[t] for t in [*good, hot]) and not any(kept[t] for t in junk)
