"""Reference data about artists: a table, or a remote service asked once for each distinct key."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_identifier
from ..operators.joins import fuzzy_code


class TableProvider:
    """Answers from a dimension table."""

    def __init__(self, dim: DataFrame):
        self.dim = dim

    def lookup(self, names: DataFrame) -> DataFrame:
        return names.select("artist_name").distinct().join(self.dim, "artist_name", "left")

    def search(self, text: str, limit: int = 10, *, alias: str | None = None, country: str | None = None) -> DataFrame:
        """Rows whose name or aliases hold ``text``, of those with an alias equal to ``alias`` and of a country, if these are given."""
        hit = F.lower("artist_name").contains(text.lower()) | F.lower(F.coalesce("aliases", F.lit(""))).contains(text.lower())
        if alias is not None:
            hit = hit & F.exists(self._aliases(), lambda a: a == alias)
        if country is not None:
            hit = hit & (F.col("country") == country)
        return self.dim.where(hit).orderBy("artist_name").limit(limit)

    @staticmethod
    def _aliases():
        parts = F.transform(F.split(F.coalesce("aliases", F.lit("")), ","), lambda x: F.trim(x))
        return F.filter(parts, lambda x: x != "")

    def aliases(self, keys: DataFrame, column: str = "mbid") -> DataFrame:
        """(column, alias) of the rows that the keys name, one row an alias."""
        return keys.select(column).distinct().join(self.dim, column).select(column, F.explode(self._aliases()).alias("alias"))

    def resolve(self, keys: DataFrame, column: str = "key") -> DataFrame:
        """The rows that keys name: a key that has an id's form is looked up by mbid, any other by name; nulls where there is none."""
        by_id, by_name = self.dim.withColumnRenamed("mbid", column), self.dim.withColumn(column, F.col("artist_name"))
        asked = keys.select(column).distinct()
        ids = asked.where(is_identifier(F.col(column))).join(by_id.withColumn("mbid", F.col(column)), column, "left")
        names = asked.where(~F.coalesce(is_identifier(F.col(column)), F.lit(False))).join(by_name, column, "left")
        return ids.unionByName(names)


class RemoteProvider:
    """Answers from ``ask``: names to rows (artist_name, mbid, country, aliases), called in batches on the executors."""

    SCHEMA = "artist_name string, mbid string, country string, aliases string"

    def __init__(self, ask: Callable[[list[str]], Iterable[tuple]]):
        self.ask = ask

    def lookup(self, names: DataFrame) -> DataFrame:
        ask = self.ask

        def run(batches):
            for b in batches:
                yield pd.DataFrame(list(ask(b["artist_name"].tolist())), columns=["artist_name", "mbid", "country", "aliases"])

        return names.select("artist_name").distinct().mapInPandas(run, self.SCHEMA)


class ReadThroughProvider:
    """Answers from a dimension; what it lacks is asked of another provider, and what that lacks as well is a row with the name alone."""

    def __init__(self, dim: DataFrame, beyond: TableProvider | RemoteProvider):
        self.dim, self.beyond = dim, beyond

    def lookup(self, names: DataFrame) -> DataFrame:
        asked = names.select("artist_name").distinct()
        have = asked.join(self.dim, "artist_name").select("artist_name", "mbid", "country", "aliases")
        missing = asked.join(self.dim.select("artist_name"), "artist_name", "left_anti")
        found = self.beyond.lookup(missing).select("artist_name", "mbid", "country", "aliases").where("artist_name is not null").dropDuplicates(["artist_name"])
        return have.unionByName(missing.join(found, "artist_name", "left").select("artist_name", "mbid", "country", "aliases"))


def cached(source: DataFrame, path: str, version: str = "id") -> DataFrame:
    """``source`` by way of a Parquet copy: the copy is read if its greatest ``version`` is the source's, else written anew first."""
    from .sinks import recover, swap_in

    spark = source.sparkSession
    recover(spark, path)
    newest = source.agg(F.max(version)).first()[0]
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        copy = spark.read.parquet(path)
        if copy.agg(F.max(version)).first()[0] == newest:
            return copy
    swap_in(source, path)
    return spark.read.parquet(path)


def ask_decider(groups: DataFrame, decide: Callable[[list[list[str]]], Iterable[tuple]], column: str = "members") -> DataFrame:
    """(cluster, decision, value, confidence) for groups of names, as an outside service gives them: ``decide`` gets the member lists of a batch."""

    def run(batches):
        for b in batches:
            answers = list(decide([list(m) for m in b[column]]))
            yield pd.DataFrame({"cluster": b["cluster"].tolist(), "decision": [a[0] for a in answers], "value": [a[1] for a in answers], "confidence": [float(a[2]) for a in answers]})

    return groups.select("cluster", column).mapInPandas(run, "cluster string, decision string, value string, confidence double")


def user_country(profile: DataFrame, codes: DataFrame) -> DataFrame:
    """(name, iso2) of users' profiles (name, country): the country's name to its code, exact but for case or one letter; null if unknown."""
    known = fuzzy_code(profile.select(F.col("country").alias("name")), codes).distinct().select(F.col("name").alias("country"), "iso2")
    return profile.join(known, "country", "left").select("name", "iso2")
