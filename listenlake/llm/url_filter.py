"""URL filters: a sort-merge range join of urls with host and path rules.

A rule (host, path) fits a url if the url's host is the rule's host or a subdomain of it and the url's path starts with
the rule's path. Canonical keys make this a test of prefixes of one string: a rule's key is its host with labels
reversed, a separator and its path; a url has one key for each of its host's suffixes. A prefix is an interval of sorted
keys, and a sweep over sorted keys keeps the stack of the rules whose intervals are open. Intervals of prefixes are
nested or apart, so the top of the stack is the longest rule that fits the key.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of at most this many bytes (measured, as keys) go to every task; more are range-partitioned with the urls.
RULES_AT_HAND = 32 << 20
#: Most keys of one range and salt that one task sweeps at once.
RANGE_KEYS = 200_000
SEPARATOR = "\x01"  # sorts before every character of a host
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of a url: both empty for null or without ``://``. Only A-Z are lower-cased, in the host."""
    if url is None:
        return "", ""
    _, mark, rest = url.partition("://")
    if not mark:
        return "", ""
    end = min([i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0], default=len(rest))
    host, path = rest[:end].translate(_LOWER), rest[end:]
    stop = min([i for i in (path.find("?"), path.find("#")) if i >= 0], default=len(path))
    return host, path[:stop]


def url_parts(url: Column) -> tuple[Column, Column]:
    """``split_url`` in built-in expressions: (host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def key(host: str, path: str) -> str:
    return ".".join(reversed(host.split("."))) + SEPARATOR + path


def suffixes(host: str) -> Iterator[str]:
    """The host and every host that it is a subdomain of."""
    while True:
        yield host
        _, dot, host = host.partition(".")
        if not dot:
            return


def sweep(rules: Sequence[tuple[str, object]], keys: Sequence[str]) -> list[object]:
    """For each of the sorted ``keys`` the payload of the longest of the sorted ``rules`` that is its prefix, or None."""
    out: list[object] = []
    stack: list[tuple[str, object]] = []
    i = 0
    for k in keys:
        while i < len(rules) and rules[i][0] <= k:
            while stack and not rules[i][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[i])
            i += 1
        while stack and not k.startswith(stack[-1][0]):
            stack.pop()
        out.append(stack[-1][1] if stack else None)
    return out


def _longest(host: str, found: Iterable[tuple[str, str, str] | None]) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest rule by its text, among equals that of the longer host."""
    best = max((f for f in found if f is not None), key=lambda f: (len(f[0]) + len(f[1]), len(f[0])), default=None)
    return (None, None) if best is None else (best[0] + best[1], best[2])


def _rule_rows(rules: DataFrame) -> DataFrame:
    """(key, host, path, verdict), one row a (host, path): of conflicting verdicts ``block`` counts. Null host or verdict: no rule."""
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.col("path"), F.lit(""))
    tidy = rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull()).select(host.alias("host"), path.alias("path"), "verdict")
    tidy = tidy.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return tidy.select(F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "."), F.lit(SEPARATOR), "path").alias("key"), "host", "path", "verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", rules_at_hand: int = RULES_AT_HAND) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``; ``rules`` has host, path, verdict (allow or block).

    The longest rule (its host and path as text) wins; no rule: ``default``, rule null. Rules whose measured keys
    take at most ``rules_at_hand`` bytes are sorted once and swept against each sorted batch of urls, with no exchange.
    More rules are cut into key ranges with the urls' keys; a crowded range is salted. Null urls and urls without ``://``
    have empty host and path and the default verdict. Repeated rows are judged each for itself.
    """
    rows = _rule_rows(rules)
    size = rows.agg(F.sum(F.octet_length("key") * 2 + F.octet_length("verdict")).alias("n")).first()["n"] or 0
    if size <= rules_at_hand:
        return _sweep_batches(pages, [tuple(r) for r in rows.collect()], id_col, url_col, default)
    return _sweep_ranges(pages, rows, id_col, url_col, default)


def _parted(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = url_parts(F.coalesce(F.col(url_col), F.lit("")))
    return pages.select(F.col(id_col).alias("__id"), host.alias("host"), path.alias("path"))


def _schema(pages: DataFrame, id_col: str) -> str:
    return f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, host string, path string, rule string, verdict string"


def _sweep_batches(pages: DataFrame, rows: list[tuple], id_col: str, url_col: str, default: str) -> DataFrame:
    ordered = sorted((k, (host, path, verdict)) for k, host, path, verdict in rows)

    def run(batches):
        for b in batches:
            parts = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist()))
            probes = sorted((key(s, p), i) for i, (h, p) in enumerate(parts) if h for s in suffixes(h))
            found: list[list] = [[] for _ in parts]
            for (_, i), hit in zip(probes, sweep(ordered, [k for k, _ in probes])):
                found[i].append(hit)
            best = [_longest(h, f) for (h, _), f in zip(parts, found)]
            yield pa.RecordBatch.from_arrays(
                [
                    *b.columns,
                    pa.array([r for r, _ in best], pa.string()),
                    pa.array([v or default for _, v in best], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return _parted(pages, id_col, url_col).toDF(id_col, "host", "path").mapInArrow(run, _schema(pages, id_col))


def _sweep_ranges(pages: DataFrame, rows: DataFrame, id_col: str, url_col: str, default: str, ranges: int = 512) -> DataFrame:
    """For rule tables beyond the bound: urls once as (row, key) probes, ranges cut at sampled rule keys, results met by row."""
    spark = pages.sparkSession
    from .store import materialize

    cuts = sorted({r["key"] for r in rows.orderBy(F.xxhash64("key")).limit(ranges).select("key").collect()})

    def probe(batches):
        for b in batches:
            out: dict[str, list] = {"row": [], "host": [], "path": [], "key": [], "range": []}
            for row, h, p in zip(*(b.column(c).to_pylist() for c in range(3))):
                for s in suffixes(h) if h else ():
                    k = key(s, p)
                    for name, v in (("row", row), ("host", h), ("path", p), ("key", k), ("range", bisect.bisect_right(cuts, k))):
                        out[name].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("key", pa.string()), ("range", pa.int32())]))

    def spread(batches):
        for b in batches:
            at: dict[str, list] = {"key": [], "host": [], "path": [], "verdict": [], "range": []}
            for k, h, p, v in zip(*(b.column(i).to_pylist() for i in range(4))):
                for r in range(bisect.bisect_right(cuts, k), bisect.bisect_right(cuts, k + "\U0010ffff") + 1):
                    for name, x in (("key", k), ("host", h), ("path", p), ("verdict", v), ("range", r)):
                        at[name].append(x)
            yield pa.RecordBatch.from_pydict(at, schema=pa.schema([("key", pa.string()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string()), ("range", pa.int32())]))

    rowed = materialize(_parted(pages, id_col, url_col).withColumn("__row", F.monotonically_increasing_id()), "urls")
    probes = rowed.select("__row", "host", "path").mapInArrow(probe, "row long, host string, path string, key string, range int")
    load = probes.groupBy("range").agg((F.floor(F.count(F.lit(1)) / RANGE_KEYS) + 1).cast("int").alias("salts"))
    load = F.broadcast(load)  # one row a range: at most ``ranges`` + 1
    salted = probes.join(load, "range").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int")).select("range", "salt", "row", "key")
    held = rows.mapInArrow(spread, "key string, host string, path string, verdict string, range int")
    held = held.join(load.select(F.col("range").alias("at"), F.col("salts").alias("copies")), F.col("range") == F.col("at"))
    held = held.select("range", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"), "key", "host", "path", "verdict")

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("key", kind="stable")
        right = right.sort_values("key", kind="stable")
        hits = sweep(list(zip(right["key"], zip(right["host"], right["path"], right["verdict"]))), list(left["key"]))
        got = [(row, *hit) for row, hit in zip(left["row"], hits) if hit is not None]
        return pd.DataFrame(got, columns=["row", "rule_host", "rule_path", "verdict"])

    hits = salted.groupBy("range", "salt").cogroup(held.toDF("at", "part", "key", "host", "path", "verdict").groupBy("at", "part")).applyInPandas(merge, "row long, rule_host string, rule_path string, verdict string")
    n = F.length("rule_host") + F.length("rule_path")
    best = hits.groupBy("row").agg(F.max(F.struct(n.alias("n"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best"))

    return rowed.join(best, rowed["__row"] == best["row"], "left").select(
        F.col("__id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path)."""
    return spark.createDataFrame([(h, p, v) for v, h, p in rules], "host string, path string, verdict string")
