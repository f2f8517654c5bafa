from __future__ import annotations

import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from listenlake.operators import similarity as S

TEXT = st.one_of(st.text("ab c", max_size=12), st.text(max_size=9), st.text("xyz ", min_size=50, max_size=200))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=20))
def test_batches_equal_single_pairs(pairs):
    left, right = zip(*pairs)
    assert S.lcs_lengths(left, right).tolist() == [S.lcs_length(a, b) for a, b in pairs]
    got = S.batch_scores(left, right)
    for name, score in S.SCORES.items():
        assert np.allclose(got[name], [score(a, b) for a, b in pairs]), name


def test_pairs_of_many_letters_and_lengths():
    r = random.Random(3)
    word = lambda: "".join(chr(r.randint(0x4E00, 0x9FFF) if r.random() < 0.5 else r.randint(97, 122)) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 128, 300])))
    pairs = [(word(), word()) for _ in range(600)]
    pairs += [(a, a[::2]) for a, _ in pairs]
    assert S.lcs_lengths(*zip(*pairs)).tolist() == [S.lcs_length(a, b) for a, b in pairs]
    assert S.lcs_lengths([], []).tolist() == []


def test_a_batch_is_faster_than_pair_by_pair():
    r = random.Random(4)
    names = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9))) for _ in range(2)) for _ in range(4000)]
    left, right = names[:2000], names[2000:]
    begin = time.perf_counter()
    got = S.batch_scores(left, right)
    batch = time.perf_counter() - begin
    begin = time.perf_counter()
    want = {k: [f(a, b) for a, b in zip(left, right)] for k, f in S.SCORES.items()}
    single = time.perf_counter() - begin
    assert all(np.allclose(got[k], want[k]) for k in want) and batch < single


def test_null_names_have_null_scores(spark):
    df = spark.createDataFrame([("a b", "b a"), (None, "x"), ("x", None), ("", "")], "variant_a string, variant_b string")
    got = {(r.variant_a, r.variant_b): tuple(r)[2:] for r in S.fuzzy_scores(df).collect()}
    assert got["a b", "b a"][2] == 1.0 and set(got[None, "x"]) == set(got["x", None]) == {None} and got["", ""] == (1.0, 1.0, 1.0, 0.0, 0.0, 0.0)
