from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.functions import text
from listenlake.operators import joins


def test_folding_against_the_language_own(spark):
    names = ["Straße", "STRASSE", "ΟΔΥΣΣΕΎΣ", "Οδυσσεύς", "İstanbul", "ISTANBUL", "ısı", "Beyoncé", "ǅ", "ﬃ", "ŉ", "ẞ", "", "a B"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.fold(F.col("n")).alias("f")).collect()
    assert {r.n: r.f for r in got} == {n: n.casefold() for n in names}


def test_groups_blind_to_case_and_accents(spark):
    names = ["Beyoncé", "BEYONCE", "beyoncé", "Straße", "STRASSE", "Sigur Rós", "sigur ros", "other"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert df.groupBy(text.alike(F.col("n"))).count().count() == 4
    assert df.where("n like '%ey%' or n like '%EY%'").groupBy(text.alike(F.col("n"), accents=True)).count().count() == 2


def test_lookup_by_name(spark):
    right = spark.createDataFrame([("Türkiye", "TR"), ("TURKIYE", "T2"), ("Côte d'Ivoire", "CI"), ("Österreich", "AT"), (None, "XX")], "name string, iso2 string")
    left = spark.createDataFrame([("türkiye",), ("TURKIYE",), ("cote d'ivoire",), ("OSTERREICH",), ("nowhere",), (None,)], "name string")
    got = {r.name: r.iso2 for r in joins.by_name(left, right, "name", "iso2").collect()}
    assert got == {"türkiye": "T2", "TURKIYE": "T2", "cote d'ivoire": "CI", "OSTERREICH": "AT", "nowhere": None, None: None}
    strict = {r.name: r.iso2 for r in joins.by_name(left, right, "name", "iso2", accents=True).collect()}
    assert strict["türkiye"] == "TR" and strict["OSTERREICH"] is None


def test_fuzzy_lookup_folds(spark):
    codes = spark.createDataFrame([("XS", "Strasse"), ("TR", "Türkiye")], "iso2 string, en_name string")
    names = spark.createDataFrame([("STRAßE",), ("straße",), ("TÜRKIYE",), ("Turkiye",)], "name string")
    assert {r.name: r.iso2 for r in joins.fuzzy_code(names, codes).collect()} == {"STRAßE": "XS", "straße": "XS", "TÜRKIYE": "TR", "Turkiye": "TR"}
