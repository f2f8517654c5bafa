from __future__ import annotations

import random

import pytest

from listenlake.operators import forest


def kruskal(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    out = []
    for a, b, sim in sorted({(min(a, b), max(a, b), s) for a, b, s in edges if a != b}, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            top[find(a)] = find(b)
            out.append((a, b, sim))
    return out


def between(tree, a, b):
    """The least sim on the path of a tree, by a walk."""
    around = {}
    for x, y, s in tree:
        around.setdefault(x, []).append((y, s))
        around.setdefault(y, []).append((x, s))
    todo, seen = [(a, 1.0)], {a}
    while todo:
        x, low = todo.pop()
        if x == b:
            return low
        for y, s in around.get(x, []):
            if y not in seen:
                seen.add(y)
                todo.append((y, min(low, s)))
    return None


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_paths_and_clusters_against_plain_loops(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(40)]
    # few different sims, so that many edges tie; either direction, repeats, loops and nulls
    edges = [(a, b, rng.choice((0.3, 0.5, 0.7, 0.9))) for a in names for b in names if a != b and rng.random() < 0.03]
    best = {}
    for a, b, s in edges:
        best[min(a, b), max(a, b)] = max(s, best.get((min(a, b), max(a, b)), 0))
    df = spark.createDataFrame([*edges, *edges[:3], ("n00", "n00", 1.0), ("n00", None, 0.5), ("n01", "n02", None)], "a string, b string, sim double")
    f = forest.spanning_forest(df)
    want = kruskal([(a, b, s) for (a, b), s in best.items()])
    assert sorted(tuple(r) for r in f.edges.collect()) == sorted(want)
    pairs = [(rng.choice(names), rng.choice([*names, "absent"])) for _ in range(80)]
    got = forest.bottlenecks(f, spark.createDataFrame(pairs, "a string, b string")).collect()
    assert len(got) == len(pairs) and all(r.sim == between(want, r.a, r.b) for r in got)
    profile = {r.epsilon: (r.clusters, r.names) for r in forest.threshold_profile(f, [0.1, 0.3, 0.6, 0.7]).collect()}
    for eps in (0.1, 0.3, 0.6):
        groups = {}
        for x in names:
            near = [y for y in names if x == y or (between(want, x, y) or 0) >= 1 - eps - 1e-9]
            if len(near) > 1:
                groups[x] = near[0]
        assert profile[eps] == (len(set(groups.values())), len(groups))
        if seed == 1 and eps == 0.3:
            assert {r.name: r.cluster for r in forest.clusters_at(f, eps).collect()} == groups


def test_long_chains_and_no_edges(spark):
    # every name takes the edge to the next: one round, followed along the whole chain
    n = 50
    df = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}", 0.2 + i / 1000) for i in range(n)], "a string, b string, sim double")
    f = forest.spanning_forest(df)
    assert f.edges.count() == n
    groups = spark.createDataFrame([("whole", "n000"), ("whole", f"n{n:03}"), ("part", "n020"), ("part", "n030"), ("one", "x"), ("none", "n001"), ("none", "x")], "group string, name string")
    got = {r.group: r.epsilon for r in forest.group_thresholds(f, groups).collect()}
    assert got == {"whole": pytest.approx(0.8), "part": pytest.approx(0.78), "one": 0.0, "none": None}
    empty = forest.spanning_forest(df.where("false"))
    assert empty.edges.isEmpty() and empty.paths.isEmpty()
    assert forest.threshold_profile(empty, [0.5]).isEmpty()
    assert [tuple(r) for r in forest.bottlenecks(empty, spark.createDataFrame([("a", "a"), ("a", "b")], "a string, b string")).collect()] == [("a", "a", 1.0), ("a", "b", None)]
