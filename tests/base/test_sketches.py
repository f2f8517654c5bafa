from __future__ import annotations

import datetime as dt
import random

import pytest

from listenlake.operators import counts, similarity, sketches
from listenlake.sources import sinks

COLUMNS, NUMBERS = ["artist_name"], ["seconds"]


def plays(spark, n, seed, days=300):
    rng = random.Random(seed)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(days)), f"a{int(rng.expovariate(1 / 800))}", rng.gauss(200, 40)) for _ in range(n)]
    return spark.createDataFrame(rows, "play_time date, artist_name string, seconds double")


def test_batches_add_up_and_keep_their_bounds(spark, tmp_path):
    path = f"file://{tmp_path}/sketches"
    batches = {"first": plays(spark, 9000, 1), "second": plays(spark, 4000, 2), "third": plays(spark, 500, 3, 20)}
    for name, batch in batches.items():
        sketches.add_sketches(batch, path, name, "play_time", COLUMNS, NUMBERS)
    sketches.add_sketches(batches["second"], path, "second", "play_time", COLUMNS, NUMBERS)  # tried again
    whole = batches["first"].unionByName(batches["second"]).unionByName(batches["third"])
    found = sketches.profile(sketches.stored(spark, path))
    got = {r.column: r for r in found.collect()}
    exact = whole.selectExpr("count(*) n", "min(seconds) low", "max(seconds) high", "avg(seconds) mean", "count(DISTINCT artist_name) names").first()
    assert got["artist_name"].rows == got["seconds"].filled == exact.n == 13500
    assert (got["seconds"].low, got["seconds"].high) == (exact.low, exact.high) and got["seconds"].mean == pytest.approx(exact["mean"])
    assert abs(got["artist_name"].distinct_values / exact.names - 1) < sketches.DISTINCT_BOUND
    values = sorted(r.seconds for r in whole.select("seconds").collect())
    for share, q in zip((0.25, 0.5, 0.75), got["seconds"].quantiles):
        assert abs(sum(v < q for v in values) / len(values) - share) < sketches.RANK_BOUND
    judged = {r.column: (r.distinct_close, r.quantiles_close) for r in sketches.audit(whole, found, [*COLUMNS, *NUMBERS]).collect()}
    assert judged == {"artist_name": (True, None), "seconds": (True, True)}
    # a profile that is wrong is told
    off = sketches.profile(sketches.stored(spark, path).where("batch = 'third'")).selectExpr("column", "distinct_values", "transform(quantiles, x -> x + 30) AS quantiles")
    assert {r.column: (r.distinct_close, r.quantiles_close) for r in sketches.audit(whole, off, [*COLUMNS, *NUMBERS]).collect()} == {"artist_name": (False, None), "seconds": (False, False)}
    months = {(r.month, r.column): r.rows for r in sketches.profile(sketches.stored(spark, path), "month").collect()}
    want = {r.m: r["count"] for r in whole.groupBy(whole.play_time.substr(1, 7).alias("m")).count().collect()}
    assert {m.isoformat()[:7]: n for (m, c), n in months.items() if c == "seconds"} == want


def test_odd_rows(spark):
    rows = [(None, "", float("nan")), (dt.date(2020, 2, 3), None, None), (dt.date(2020, 2, 4), "", 1.0), (dt.date(2020, 2, 4), "", 1.0), (dt.date(2020, 3, 4), None, None)]
    df = spark.createDataFrame(rows, "play_time date, artist_name string, seconds double")
    got = {(r.month and r.month.month, r.column): r for r in sketches.profile(sketches.month_sketches(df, "play_time", COLUMNS, NUMBERS), "month").collect()}
    assert len(got) == 6
    text, number = got[2, "artist_name"], got[2, "seconds"]
    assert (text.rows, text.filled, text.distinct_values, text.quantiles, text.mean) == (3, 2, 1, None, None)
    assert (number.filled, number.low, number.mean, number.distinct_values, number.quantiles) == (2, 1.0, 1.0, 1, [1.0, 1.0, 1.0])
    assert (got[None, "seconds"].filled, got[None, "artist_name"].distinct_values) == (0, 1)
    assert (got[3, "seconds"].mean, got[3, "seconds"].quantiles, got[3, "seconds"].distinct_values) == (None, None, 0)
    assert sketches.month_sketches(df.where("false"), "play_time", COLUMNS, NUMBERS).isEmpty()


def test_report_of_a_profile(spark):
    names = spark.createDataFrame([("hot ring",)] * 3 + [("hot rings",)] * 2 + [("<b>",)], "artist_name string")
    text = sinks.markdown_report(counts.value_counts(names, "artist_name"), similarity.similar_pairs(names, "artist_name", 0.8), top=2)
    lines = text.splitlines()
    assert "- artists: 3" in lines and "- plays: 6" in lines
    assert lines[lines.index("| artist | plays |") + 2 :][:2] == ["| hot ring | 3 |", "| hot rings | 2 |"]
    assert lines[-1] == "| hot ring | hot rings | 0.941 |"
    page = sinks.html_report(text + "<b>")
    assert page.startswith("<!doctype html>") and "&lt;b&gt;" in page and "<b>" not in page
