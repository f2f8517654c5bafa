"""Semantics on literal inputs, worked out by hand."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listenlake.functions import text
from listenlake.operators import canon, counts, integrity, joins, ml, normalize, quality, similarity, stats, temporal
from listenlake.plans import pipeline
from listenlake.sources import readers, sinks
from listenlake.streaming import incremental


def values(df, *cols):
    return [tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()]


def test_ids_and_times(spark):
    df = spark.createDataFrame([(" 5b11f4ce-a62d-471e-81fc-a69a8278c7da ",), ("X",), ("",), (None,)], "m string")
    assert values(df.select(text.clean_uuid(F.col("m")).alias("m")), "m") == ["5b11f4ce-a62d-471e-81fc-a69a8278c7da", None, None, None]
    t = spark.createDataFrame([("1700000000",), ("bad",)], "u string").select(text.epoch_to_timestamp(F.col("u")).cast("string").alias("t"))
    assert values(t, "t") == ["2023-11-14 22:13:20", None]


def test_merges_keep_last_and_normalising_keeps_first(spark):
    old = spark.createDataFrame([("a", "t", "1", "old")], "artist_name string, track_title string, play_time string, album_title string")
    new = spark.createDataFrame([("a", "t", "1", "new")], old.schema)
    assert values(normalize.merge_keep_last(old, new), "album_title") == ["new"]
    raw = spark.createDataFrame([("a", "s", "first", 5, 1), ("a", "s", "second", 5, 2)], "Artist string, Song string, Album string, uts long, n int")
    got = normalize.normalize_plays(raw, "n")
    assert values(got, "album_title") == ["first"] and got.columns == ["artist_name", "album_title", "play_time", "track_title", "artist_mbid"]


def test_columns_are_found_by_name(spark):
    df = spark.createDataFrame([("t", "a", "b", "m", "p")], "track_title string, artist_name string, album_title string, artist_mbid string, play_time string")
    assert normalize.order_columns(df).columns == ["artist_name", "album_title", "play_time", "track_title", "artist_mbid"]


def test_substitution_is_not_followed_and_null_does_not_link(spark):
    v = spark.createDataFrame(
        [("A", "B", True, "h1"), ("B", "C", True, "h2"), ("D", "E", False, "h3"), ("F", "G", None, "h4")], "artist_variants_text string, canonical_name string, to_link boolean, artist_variants_hash string"
    ).withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    df = spark.createDataFrame([(x,) for x in "ABDF"], "artist_name string")
    assert sorted(values(joins.apply_canonical(df, v), "artist_name")) == ["B", "C", "D", "F"]


def test_asof_modes(spark):
    line = spark.createDataFrame([("HU", dt.date(2000, 1, 1), dt.date(2010, 1, 1)), ("DE", dt.date(2010, 1, 1), None)], "country_code string, start_date date, end_date date")
    days = spark.createDataFrame([(i, d) for i, d in enumerate([dt.date(1999, 6, 1), dt.date(2005, 1, 1), dt.date(2010, 1, 1), dt.date(2015, 1, 1)])], "i int, day date")
    run = lambda **k: [c for _, c in sorted(values(joins.asof_interval(days, line, F.col("day"), **k), "i", "user_country"))]
    assert run() == [None, "HU", "DE", "DE"]
    assert run(compat=True) == [None, "HU", "DE", None]


def test_overlap_modes(spark):
    def n(second, **k):
        rows = [(1, "HU", dt.date(2000, 1, 1), dt.date(2001, 1, 1)), (2, second, dt.date(2001, 1, 1), None)]
        return joins.interval_overlaps(spark.createDataFrame(rows, "id int, country_code string, start_date date, end_date date"), **k).count()

    assert [n("HU"), n("DE")] == [0, 0]
    assert [n("HU", same_country=False, closed=True), n("DE", same_country=False, closed=True)] == [1, 1]


def test_percentile_rank_and_spreads(spark):
    c = spark.createDataFrame([(2000, p) for p in (1, 2, 2, 5)], "year int, plays long")
    assert sorted(values(temporal.percentile_rank(c, "year", "plays"), "pct")) == [25, 62.5, 62.5, 100]
    y = spark.createDataFrame([("a", p) for p in (3, 5, 9)], "artist_name string, plays long")
    assert values(temporal.steady_by_cv(y, "artist_name", 100), "std") == [pytest.approx(2.494438257849294)]
    one = spark.createDataFrame([("a", 3)], "artist_name string, plays long")
    assert values(temporal.steady_by_std(one, "artist_name"), "std") == [None]


def test_best_record(spark):
    rows = [(3, "a", "m", None, None, None), (2, "a", "", "HU", "", "x"), (9, "b", "m", "HU", "d", "x"), (8, "b", "m", "HU", "d", "x")]
    df = spark.createDataFrame(rows, "id int, artist_name string, mbid string, country string, disambiguation_comment string, aliases string")
    assert sorted(values(integrity.best_record(df), "id", "score")) == [(2, 2), (8, 5)]


def test_fuzzy_codes(spark):
    codes = spark.createDataFrame([("HU", "Hungary")], "iso2 string, en_name string")
    names = spark.createDataFrame([(n,) for n in ("Hungari", "Hungar", "XHungary", "HUNGARY")], "name string")
    assert dict(values(joins.fuzzy_code(names, codes), "name", "iso2")) == {"Hungari": "HU", "Hungar": "HU", "XHungary": None, "HUNGARY": "HU"}


def test_signatures_and_lengths(spark):
    df = spark.createDataFrame([([" b ", "a", ""], "ab{ abcd ")], "v array<string>, s string")
    r = df.select(text.signature(F.col("v")).alias("sig"), text.length_stats(F.col("s")).alias("l")).withColumn("h", text.signature_hash(F.col("sig"))).first()
    assert r.sig == "a{b" and r.h == "acef99516b82fddd4a5a3ee61f218c8d7ac0408d1c07641d1abb5c8fc8487736"
    assert tuple(r.l) == (6, 2, 3.0, 4, 1.0)
    split = spark.createDataFrame([("a {|} b|c",)], "s string").select(text.split_variants(F.col("s"), "{|").alias("p")).first().p
    assert split == ["a", "} b", "c"]


def test_char_frequency(spark):
    df = spark.createDataFrame([(x,) for x in ("a!b", "a!c", "a_b", "a%b", "a!b")], "n string")
    got = dict(values(quality.char_frequency(df, "n", quality.special_chars(spark)), "ascii_char", "n"))
    assert len(got) == 32 and {k: v for k, v in got.items() if v} == {"!": 2, "_": 1, "%": 1}


def test_rank_comes_before_the_filter(spark):
    df = spark.createDataFrame([("x",)] * 5 + [("y,z",)] * 3 + [("w",)] * 2, "a string")
    assert values(counts.ranked_filter(df, "a", ","), "rank", "a", "plays") == [(2, "y,z", 3)]


def test_sanitize(spark):
    df = spark.createDataFrame([("a - b",), ("a-b",), ("a_b",)], "n string").select(text.sanitize(F.col("n")).alias("n"))
    assert values(df, "n") == ["a_minus_b", "a_b", "a_b"]


def test_minimal_epsilon():
    edges = [("a", "b", 0.9), ("b", "c", 0.78)]
    assert canon.minimal_epsilon(edges, [("a", "c")]) == pytest.approx(0.22)
    assert canon.minimal_epsilon(edges, [("a", "z")]) is None


def test_clusters_follow_long_chains(spark):
    n = 60
    edges = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)] + [("x", "y")], "a string, b string")
    got = canon.clusters(edges).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in got} == {("n000", n + 1), ("x", 2)}


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    assert similarity.lcs_length(a, b) == row[-1]


def test_scores_by_hand():
    assert similarity.ratio("abcd", "abxd") == 0.75
    assert similarity.partial_ratio("abc", "xxabcxx") == 1.0
    assert similarity.token_sort_ratio("b a", "a b") == 1.0
    assert similarity.token_set_ratio("a b", "a b c") == 1.0
    assert similarity.quick_ratio("", "") == 0.0


def test_pruning_loses_nothing(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(120)})
    df = spark.createDataFrame([(x,) for x in names], "n string")
    for least in (0.5, 0.77):
        want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if similarity.ratio(a, b) >= least}
        assert set(values(similarity.similar_pairs(df, "n", least), "a", "b")) == want


def test_cramers_v_has_yates(spark):
    df = spark.createDataFrame([("a", "x")] * 10 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 9, "p string, q string")
    e = [12 * 13 / 24, 12 * 11 / 24]
    chi = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((10, 2, 3, 9), (*e, *e)))
    assert stats.cramers_v(df, "p", "q").first().chi2 == pytest.approx(chi)


def test_correlation_pruning():
    names, m = ["a", "b", "c"], [[1, 0.95, 0.1], [0.95, 1, 0.2], [0.1, 0.2, 1]]
    var = {"a": 1.0, "b": 2.0, "c": 3.0}
    assert stats.drop_correlated(names, m, 0.9, var) == ["a"]
    assert stats.prune_correlated(names, m, 0.9, var, least=2) == ["a", "c"]


def test_seasonal_series(spark):
    factors = [0.7, 0.8, 0.9, 1.0, 1.1, 1.2, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8]
    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), (100.0 + i) * factors[i % 12]) for i in range(36)]
    got = temporal.decompose(spark.createDataFrame(rows, "month date, plays double")).orderBy("month").collect()
    assert [r.trend is None for r in got] == [True] * 6 + [False] * 24 + [True] * 6
    assert sum(r.seasonal for r in got[:12]) / 12 == pytest.approx(1) and got[0].seasonal == pytest.approx(got[12].seasonal)


def _page(*tracks):
    one = [{"artist": {"#text": a}, "name": n, "album": {"#text": "al"}, **({"date": {"uts": u}} if u else {})} for a, n, u in tracks]
    return json.dumps({"recenttracks": {"track": one if len(one) > 1 else one[0]}})


def test_pages_with_lists_and_lone_plays(spark):
    pages = spark.createDataFrame([(_page(("a", "x", "1"), ("b", "y", None)),), (_page(("c", "z", "3")),)], "value string")
    assert sorted(values(readers.flatten_pages(pages), "Artist", "uts")) == [("a", 1), ("c", 3)]


def test_snapshot_merge_and_pipeline(spark, tmp_path):
    path = f"file://{tmp_path}/plays"
    raw = lambda *rows: spark.createDataFrame(list(rows), "Artist string, Song string, Album string, uts string, artist_mbid string")
    store = pipeline.Store(path, f"file://{tmp_path}/artists", f"file://{tmp_path}/variants")
    spark.createDataFrame([("old", None, None, None, None)], "artist_name string, mbid string, disambiguation_comment string, aliases string, country string").write.parquet(store.artists)
    v = spark.createDataFrame([("A{B", "A", True, "h")], "artist_variants_text string, canonical_name string, to_link boolean, artist_variants_hash string").withColumn("timestamp", F.current_timestamp())
    v.write.parquet(store.variants)
    ref = spark.createDataFrame([("A", "HU")], "artist_name string, country string")
    out = pipeline.run_full_pipeline(spark, store, raw(("A", "s", "x", "10", None), ("B", "s", "x", "20", None)), ref, f"file://{tmp_path}/out")
    assert [s["status"] for s in out] == ["success"] * 6 and out[3]["artists"] == 1
    again = pipeline.fetch_new_data(spark, store, raw(("A", "s", "x", "10", None)))
    assert again["new"] == 0
    assert pipeline.fetch_new_data(spark, store, raw(("C", "s", "x", "30", None)))["new"] == 1
    sinks.append_or_create(raw(("C", "s", "new", "30", None)).withColumn("play_time", F.timestamp_seconds(F.lit(30))).drop("uts"), path)
    assert spark.read.parquet(path).where("album_title = 'new'").count() == 1


def test_stream_ignores_what_it_has(spark, tmp_path):
    schema = "Artist string, Song string, Album string, uts string, artist_mbid string"
    (tmp_path / "in").mkdir()
    put = lambda name, *rows: (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("Artist", "Song", "Album", "uts"), r))) for r in rows))
    target, mark = f"file://{tmp_path}/plays", f"file://{tmp_path}/mark"
    put("1.json", ("a", "s", "x", "1"), ("a", "s", "y", "1"))
    incremental.load_plays(incremental.play_stream(spark, f"file://{tmp_path}/in", schema), target, mark).awaitTermination(60)
    put("2.json", ("a", "s", "z", "1"), ("b", "s", "z", "2"))
    incremental.load_plays(incremental.play_stream(spark, f"file://{tmp_path}/in", schema), target, mark).awaitTermination(60)
    assert sorted(values(spark.read.parquet(target), "artist_name")) == ["a", "b"]


def test_link_model_is_saved_whole_and_trees_become_rules(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(i / 40, (i * 7 % 40) / 40, int(i >= 20)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double, label int")
    model = ml.train_link_model(df, ["x", "y"], rounds=5)
    model.write().overwrite().save(f"file://{tmp_path}/model")
    scored = ml.score_links(PipelineModel.load(f"file://{tmp_path}/model"), df)
    assert ml.area_under_curve(scored) > 0.99
    assert ml.importances(model, ["x", "y"], 1)[0][0] == "x"
    flat = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    tree = DecisionTreeClassifier(maxDepth=2).fit(flat)
    assert all(r.startswith("x > ") for r in ml.rules_of(tree, ["x", "y"])) and ml.rules_of(tree, ["x", "y"])


def test_gold_pairs_carry_scores_and_lengths(spark):
    got = ml.gold_pairs(spark.createDataFrame([("b a{a b{ab", True)], "variants string, to_link boolean")).collect()
    assert {(r.variant_a, r.variant_b): r.token_sort_ratio for r in got}[("a b", "b a")] == 1.0
    assert all(r.n_variants == 3 for r in got)


def test_upsert_cache_meets_by_id_then_name(spark):
    schema = "artist_name string, mbid string, disambiguation_comment string, aliases string, country string"
    old = spark.createDataFrame([("a", "1", "x", "p", "HU"), ("b", None, None, None, None), ("c", "3", "z", "q", "DE")], schema)
    new = spark.createDataFrame([("renamed", "1", "n", None, "FR"), ("b", "2", "m", "r", "AT"), ("d", "4", None, "s", None)], schema)
    got = {r.artist_name: (r.mbid, r.disambiguation_comment, r.aliases, r.country) for r in integrity.upsert_cache(old, new).collect()}
    assert got == {"a": ("1", "n", None, "FR"), "b": ("2", "m", "r", "AT"), "c": ("3", "z", "q", "DE"), "d": ("4", None, "s", None)}
