from __future__ import annotations

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from listenlake.operators import timelines


def test_intervals_against_walking_the_days(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), date(2020, 1, 1) + timedelta(days=r.randint(0, 400)), r.choice(["HU", "DE", None]), i) for i in range(300)] + [("a", None, "FR", 999)]
    got = timelines.intervals_of(spark.createDataFrame(rows, "user string, day date, country string, k int"), ["user"], "day", "country", "k")
    want = []
    for user in ("a", "b", None):
        last = {}
        for u, day, c, k in rows:
            if u == user and day and (day not in last or last[day][0] < k):
                last[day] = (k, c)
        starts = []
        for day in sorted(last):
            if not starts or starts[-1][1] != last[day][1]:
                starts.append((day, last[day][1]))
        want += [(user, c, s, e) for (s, c), e in zip(starts, [*[x[0] for x in starts[1:]], None])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    now = timelines.current_intervals(got, ["user"], F.lit("2020-07-01").cast("date"))
    assert sorted(map(tuple, now.select("user", "country", "start_date", "end_date").collect()), key=str) == sorted([w for w in want if w[2] <= date(2020, 7, 1) and (w[3] is None or w[3] > date(2020, 7, 1))], key=str)


def test_asof_of_a_hot_key_against_a_search(spark):
    r = random.Random(2)
    at = lambda: datetime(2020, 1, 1) + timedelta(hours=r.randint(0, 9000))
    left = [(i, r.choice(["hot", "hot", "x", None]), at()) for i in range(400)] + [(1000, "hot", None), (1001, "none", at())]
    right = [(r.choice(["hot", "hot", "x", None]), at(), r.choice([1, 2, None, 7])) for i in range(200)] + [("hot", None, 99)]
    df = timelines.asof_by_month(spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, v int"), ["k"], "t", "v")

    def find(k, t):
        met = [(u, v is not None, v or 0, v) for kk, u, v in right if kk == k and u and t and u <= t]
        return max(met)[3] if met else None

    assert {x.id: x.v for x in df.collect()} == {i: find(k, t) for i, k, t in left}


def test_a_hot_key_is_dealt_over_tasks(spark):
    """Half of the rows have one key; its windows are a month's, so the exchange parts them."""
    left = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.timestamp_seconds(1_600_000_000 + F.col("id") * 7000).alias("t"))
    df = timelines.asof_by_month(left, left.select("k", "t", F.col("id").alias("v")), ["k"], "t", "v")
    assert df.where("v <> id").count() == 0 and df.count() == 20_000
    parts = left.withColumn("m", F.date_trunc("month", "t")).where("k = -1").repartition(16, "k", "m").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 8 and max(p["count"] for p in parts) < 10_000 / 3


def test_rolling_timelines_of_many_users(spark):
    d = lambda x: date(2020, x, 1)
    lines = spark.createDataFrame([("a", "HU", d(1), d(2)), ("a", "DE", d(2), None), ("b", "HU", d(1), None), ("c", "HU", d(1), None), ("e", None, d(1), None), (None, "HU", d(1), None)], "u string, c string, start_date date, end_date date")
    news = spark.createDataFrame([("a", "HU", d(5)), ("b", "HU", d(6)), ("d", "FR", d(7)), ("e", None, d(5)), (None, "DE", d(5))], "u string, c string, day date")
    got = timelines.roll_timelines(lines, news, ["u"], "c")
    want = [("a", "HU", d(1), d(2)), ("a", "DE", d(2), d(5)), ("a", "HU", d(5), None), ("b", "HU", d(1), None), ("c", "HU", d(1), None), ("d", "FR", d(7), None), ("e", None, d(1), None), (None, "HU", d(1), d(5)), (None, "DE", d(5), None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
