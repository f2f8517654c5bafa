"""The index of names by choices of letters, and silhouettes by bounds."""

from __future__ import annotations

import random

import pytest

from listenlake.operators import canon, similarity

SYLLABLES = [c + v for c in "bcdfghklmnprstvz" for v in "aeiou"]


def made_up(rng, size):
    """Two-word names, a third of them one letter away from another."""
    names = {"".join(rng.choices(SYLLABLES, k=rng.randrange(2, 5))) + " " + "".join(rng.choices(SYLLABLES, k=rng.randrange(2, 4))) for _ in range(size * 2 // 3)}
    for x in sorted(names)[: size // 3]:
        i = rng.randrange(len(x))
        names.add(x[:i] + rng.choice("aeiou") + x[i + 1 :])
    return sorted(names)


def frame(spark, names):
    return spark.createDataFrame([(x,) for x in names], "n string")


@pytest.mark.parametrize("least", [0.05, 0.4, 0.77, 1.0])
def test_equals_all_pairs(spark, least):
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("aabcdé", k=rng.randrange(0, 10))) for _ in range(90)} | {"x" * 40, "x" * 30 + "y" * 10, "\U0001f600ab", "\U0001f600ba"})
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if similarity.ratio(a, b) >= least}
    got = [(r.a, r.b) for r in similarity.similar_pairs(frame(spark, [*names, None, names[0]]), "n", least).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_names_that_sort_to_nothing_or_to_the_same(spark):
    got = {(r.a, r.b): r.sim for r in similarity.similar_pairs(frame(spark, ["", " ", "b a", "A b", "c"]), "n", 0.9, sort_tokens=True).collect()}
    assert got == {("", " "): 1.0, ("A b", "b a"): 1.0}


def test_no_names(spark):
    assert similarity.similar_pairs(frame(spark, []), "n", 0.5).count() == 0


def test_few_names_meet(spark):
    """Of ten times the names some ten times as many pairs meet for each name, as of any index by equality, but few of all pairs."""
    shares = []
    for size in (150, 1500):
        names = made_up(random.Random(4), size)
        met = similarity.meetings(similarity.prepared_names(frame(spark, names), "n"), 0.85).count()
        shares.append(met / (len(names) * (len(names) - 1) / 2))
        print(len(names), "names,", met, "pairs meet")
    assert max(shares) < 0.05


def plain_silhouette(names, label, least):
    def sim(a, b):
        s = similarity.ratio(a, b)
        return s if s >= least else 0.0

    scores = []
    for a in names:
        if a not in label:
            continue
        sums: dict = {}
        for b in names:
            if b in label and b != a:
                sums.setdefault(label[b], []).append(1 - sim(a, b))
        if label[a] not in sums:
            continue
        inside = sum(sums[label[a]]) / len(sums[label[a]])
        out = min(sum(x) / len(x) for c, x in sums.items() if c != label[a])
        scores.append((out - inside) / max(out, inside) if max(out, inside) else 0.0)
    return sum(scores) / len(scores)


@pytest.mark.parametrize("levels", [(0.7, 0.5), (), (0.9, 0.4, 0.2)])
def test_silhouette_equals_all_pairs(spark, levels):
    rng = random.Random(5)
    stems = ["bahamas trio", "bahamus duo", "celo mandolin", "zuruk", "gipor fesat", "gipor fesam low"]
    names = sorted({s[:i] + rng.choice("aeiouxyz") + s[i + 1 :] for s in stems for _ in range(6) for i in [rng.randrange(len(s))]} | {"qqq"})
    label = {x: min(range(len(stems)), key=lambda k: -similarity.ratio(x, stems[k])) for x in names if x != "qqq"}
    labels = spark.createDataFrame([(x, str(c)) for x, c in label.items()], "name string, cluster string")
    got = canon.name_clustering_metrics(frame(spark, names), "n", labels, 0.05, sort_tokens=False, levels=levels).first()
    assert got.clusters == len(set(label.values()))
    assert got.noise == pytest.approx(1 / len(names))
    assert got.silhouette == pytest.approx(plain_silhouette(names, label, 0.05), abs=1e-12)


def test_silhouette_compares_few(spark):
    names = made_up(random.Random(4), 1500)
    labels = canon.clusters(similarity.similar_pairs(frame(spark, names), "n", 0.85))
    found = canon.name_clustering_metrics(frame(spark, names), "n", labels, sort_tokens=False).first()
    pairs = len(names) * (len(names) - 1) // 2
    print(found.compared, "of", pairs, "pairs compared")
    assert found.compared < pairs / 5
