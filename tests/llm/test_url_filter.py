from __future__ import annotations

import random

from listenlake.llm import url_filter as U
from listenlake.llm.queries import URL_RULES, op3_url_filter


def brute(url, rules, default="allow"):
    host, path = U.split_url(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else default


def rows(df):
    return sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=str)


def test_both_joins_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(U, "RANGE_KEYS", 25)
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "xa.com", "net", "c.net", "a.c.net", "org-", "a-b.com"]
    paths = ["/", "/a", "/a/", "/a/b/", "/ab", "/é/", ""]
    rules = [(rng.choice(["allow", "block"]), h, p) for h in hosts for p in paths if rng.random() < 0.5]
    urls = [f"HTTP://{rng.choice(['', 'W.', 'x.'])}{rng.choice(hosts).upper()}{rng.choice(paths)}{rng.choice(['', 'b/', '?q=/a', '#/a'])}" for _ in range(200)]
    urls += [None, "", "no mark", "://", "http://", "x://a.com?b", "x://É.com/a"]
    table = [(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])]
    want = sorted(((i, *brute(u, rules)) for i, u in table), key=str)
    pages = spark.createDataFrame(table, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS row", "3 AS key")
    held = U.rules_frame(spark, rules)
    assert rows(U.filter_urls(pages, held)) == want
    assert rows(U.filter_urls(pages, held, rules_at_hand=0)) == want
    assert U.filter_urls(pages.where("false"), held).count() == 0
    none = spark.createDataFrame([(None, "/", "block"), ("a.com", None, None)], "host string, path string, verdict string")
    assert {r.verdict for r in U.filter_urls(pages, none).collect()} == {"allow"}


def test_query(spark, sf):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    assert rows(op3_url_filter(spark, sf)) == sorted(((i, *brute(u, URL_RULES)) for i, u in pages), key=str)
