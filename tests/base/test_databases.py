from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from listenlake.sources import readers, sinks

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
PLAY = "id long, artist_name string, n int"


@pytest.fixture
def url(request):
    return f"jdbc:derby:memory:{request.node.name.replace('[', '_').replace(']', '')};create=true"


def rows(spark, url, name="plays"):
    return sorted(tuple(r) for r in readers.database_table(spark, url, name, **DRIVER).collect())


def test_round_trip(spark, url):
    df = spark.createDataFrame([(1, "a", 1), (2, "Ünï {x", None)], PLAY)
    sinks.to_database(df, url, "plays", **DRIVER)
    sinks.to_database(spark.createDataFrame([(3, None, 3)], PLAY), url, "plays", **DRIVER)
    assert rows(spark, url) == [(1, "a", 1), (2, "Ünï {x", None), (3, None, 3)]
    assert readers.database_table(spark, url, "plays", **DRIVER).where("n = 3").first().id == 3


def test_ranges_of_about_equal_rows(spark, url):
    skewed = spark.range(400).select(F.when(F.col("id") < 300, F.col("id")).otherwise(F.col("id") * 1_000_000).alias("id"), F.lit("a").alias("artist_name"), F.lit(1).alias("n"))
    sinks.to_database(skewed.unionByName(spark.createDataFrame([(None, "none", 0)], PLAY)), url, "plays", **DRIVER)
    df = readers.database_ranges(spark, url, "plays", "id", 4, **DRIVER)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 401 and max(sizes) < 130
    sinks.to_database(spark.createDataFrame([], PLAY), url, "nothing", **DRIVER)
    assert readers.database_ranges(spark, url, "nothing", "id", 4, **DRIVER).count() == 0


def test_a_write_that_is_tried_again_leaves_no_double_row(spark, url):
    sinks.to_database(spark.createDataFrame([(1, "old", 1), (2, "old", 2)], PLAY), url, "plays", **DRIVER)
    new = spark.createDataFrame([(i, "new", i) for i in range(2, 50)], PLAY).repartition(8)
    breaks = new.withColumn("n", F.when(F.col("id") == 30, F.raise_error(F.lit("half-way")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="half-way"):
        sinks.merge_into_database(breaks, url, "plays", ["id"], **DRIVER)
    assert rows(spark, url) == [(1, "old", 1), (2, "old", 2)]
    want = [(1, "old", 1), *[(i, "new", i) for i in range(2, 50)]]
    for _ in range(2):
        assert sinks.merge_into_database(new, url, "plays", ["id"], **DRIVER) == 48
        assert rows(spark, url) == want
    assert sinks.merge_into_database(spark.createDataFrame([(1, "x", 0), (99, "x", 0)], PLAY), url, "plays", ["id"], keep="old", **DRIVER) == 1
    assert rows(spark, url) == [*want, (99, "x", 0)]


def test_a_merge_that_breaks_changes_nothing(spark, url):
    sinks.to_database(spark.createDataFrame([(1, "a", 1)], PLAY), url, "plays", **DRIVER)
    with pytest.raises(Exception):  # noqa: B017 - the table has no such column, which the insert finds after the delete
        sinks.merge_into_database(spark.createDataFrame([(1, "b", 2)], "id long, artist_name string, other int"), url, "plays", ["id"], **DRIVER)
    assert rows(spark, url) == [(1, "a", 1)]
