"""Sources, sinks, providers, settings and orders beyond what the registered queries reach."""

from __future__ import annotations

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from listenlake import config, store
from listenlake.functions.sqltext import format_sql
from listenlake.operators import canon, counts, joins, ml, normalize, order, similarity, stats, temporal
from listenlake.plans import pipeline
from listenlake.sources import provider, readers, sinks


def test_numbers_of_all_rows_in_order(spark):
    values = random.Random(3).choices(range(50), k=500)
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int").repartition(5)
    got = {r.id: r.rank for r in order.numbered(df, [F.asc("v"), F.desc("id")]).collect()}
    want = {i: k for k, (_, i) in enumerate(sorted((v, -i) for i, v in enumerate(values)), 1)}
    assert got == {-i: k for i, k in want.items()}
    assert order.numbered(df.where("false"), [F.asc("v")]).count() == 0


def test_exact_percentiles(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 400):
        values = [rng.choice([rng.random(), 3.0]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        want = df.select(F.percentile("v", F.array(*[F.lit(x) for x in (0.0, 0.01, 0.3, 0.99, 1.0)])).alias("q")).first().q
        assert order.exact_percentiles(df, "v", [0.0, 0.01, 0.3, 0.99, 1.0]).first().q == pytest.approx(want)


def test_ranks_of_keys_that_hold_a_text(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice(["a", "b", "ab", "bc", "abc", "c", "ca"]),) for _ in range(60)], "k string")
    plain = sorted(((-n, k) for k, n in df.groupBy("k").count().collect()))
    for text in ("", "a", "bc", "q"):
        want = [(i, k, -n) for i, (n, k) in enumerate(plain, 1) if text in k]
        for limit in (2, 10, None):
            got = sorted((r["rank"], r["k"], r["plays"]) for r in counts.ranked_filter(df, "k", text, limit).collect())
            assert got == (want if limit is None else want[:limit])
    plan = counts.ranked_filter(df, "k", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_cramers_v_against_a_grid(spark):
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), rng.choice("xyz") if rng.random() < 0.7 else "w") for _ in range(90)]
    got = stats.cramers_v(spark.createDataFrame(rows, "p string, q string"), "p", "q").first()
    p, q = sorted({a for a, _ in rows}), sorted({b for _, b in rows})
    e = lambda a, b: sum(x == a for x, _ in rows) * sum(y == b for _, y in rows) / len(rows)
    chi = sum((rows.count((a, b)) - e(a, b)) ** 2 / e(a, b) for a in p for b in q)
    assert got.chi2 == pytest.approx(chi) and got.v == pytest.approx((chi / len(rows) / (min(len(p), len(q)) - 1)) ** 0.5)


def test_overlaps_against_all_pairs(spark):
    import datetime as dt

    rng = random.Random(7)
    rows = []
    for i in range(60):
        start = dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(3000))
        rows.append((i, rng.choice("ab"), start, None if rng.random() < 0.2 else start + dt.timedelta(days=rng.choice([0, 1, 40, 900]))))
    df = spark.createDataFrame(rows, "id int, country_code string, start_date date, end_date date")
    end = lambda d: d or dt.date(9999, 12, 30)
    for same in (True, False):
        for closed in (True, False):
            want = set()
            for a in rows:
                for b in rows:
                    meet = (a[2] <= end(b[3]) and b[2] <= end(a[3])) if closed else (a[2] < end(b[3]) and b[2] < end(a[3]))
                    if a[0] < b[0] and meet and (not same or a[1] == b[1]):
                        want.add((a[0], b[0]))
            got = [tuple(r) for r in joins.interval_overlaps(df, same_country=same, closed=closed, bucket_days=90).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_epsilon_of_many_edges_equals_that_of_few(spark):
    rng = random.Random(8)
    names = [f"n{i}" for i in range(14)]
    edges = [(a, b, round(rng.uniform(0.2, 0.95), 3)) for a in names for b in names if a < b and rng.random() < 0.4]
    df = spark.createDataFrame(edges, "a string, b string, sim double")
    groups = [("n0", "n1"), ("n2", "n3", "n4")]
    assert canon.search_epsilon(df, groups) == canon.search_epsilon(df, groups, at_hand=3) is not None
    assert canon.search_epsilon(df, [("n0", "absent")], at_hand=3) is None


def test_records_and_splits(spark):
    groups = spark.createDataFrame([("g", ["b", "a", "c"]), ("h", ["x", "y"]), ("i", ["p", "q"]), ("one", ["z"])], "cluster string, members array<string>")
    rows = [("g", "split", None, ["c"], None), ("h", "split", None, ["q"], None), ("i", "custom", " own ", None, " why "), ("one", "skip", None, None, None)]
    decisions = spark.createDataFrame(rows, "cluster string, decision string, value string, part array<string>, comment string")
    records, again = canon.record_decisions(groups, decisions)
    assert [(r.artist_variants_text, r.canonical_name, r.to_link, r.comment) for r in records.collect()] == [("p{q", "own", True, "why")]
    assert sorted((r.cluster, r.k, r.members) for r in again.collect()) == [("g", 1, ["a", "b"]), ("g", 2, ["c"]), ("h", 1, ["x", "y"])]


def test_merge_keeps_the_last_row_of_the_frame(spark, tmp_path):
    path = f"file://{tmp_path}/plays"
    frame = lambda *rows: spark.createDataFrame(list(rows), "Artist string, Song string, Album string, uts string, extra int").coalesce(1)
    sinks.append_or_create(frame(("a", "s", "first", "10", 1), ("a", "s", "second", "10", 2), ("b", "s", "x", "5", 3)), path)
    got = sinks.append_or_create(frame(("b", "s", "y", "5", 1), ("b", "s", "z", "5", 2)), path)
    assert got.columns == ["artist_name", "album_title", "play_time", "track_title"]
    assert sorted((r.artist_name, r.album_title) for r in got.collect()) == [("a", "second"), ("b", "z")]
    ordered = sinks.append_or_create(frame(("b", "s", "late", "5", 9), ("b", "s", "early", "5", 1)), path, F.col("extra"))
    assert [r.album_title for r in ordered.where("artist_name = 'b'").collect()] == ["late"]


def test_dimension_append_reload_and_recovery(spark, tmp_path):
    path = f"file://{tmp_path}/dim"
    frame = lambda *rows: spark.createDataFrame(list(rows), "artist_name string, country string").coalesce(1)
    sinks.append_dimension(frame(("a", "HU"), ("a", "DE")), path)
    assert sorted(map(tuple, sinks.append_dimension(frame(("b", "FR")), path).collect())) == [("a", "DE"), ("b", "FR")]
    (tmp_path / "dim").rename(tmp_path / "dim.0123.old")  # a job that ended between the two renames
    assert sinks.recover(spark, path) and not sinks.recover(spark, path)
    assert sinks.reload(frame(("c", "AT")), path, ["country", "artist_name"]).columns == ["country", "artist_name"]
    sinks.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0


def test_published_versions(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    for k in range(4):
        sinks.publish(spark.createDataFrame([(k,)], "k int"), path)
        assert [r.k for r in sinks.current(spark, path).collect()] == [k]
    assert sorted(p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("v")) == ["v2", "v3"]


def test_listens_export(spark, tmp_path):
    page = {"payload": {"listens": [{"listened_at": t, "track_metadata": {"artist_name": "a", "track_name": f"t{t}", "release_name": "r"}} for t in (5, 10, 15, 20)]}}
    flat = readers.flatten_listens(spark.createDataFrame([(json.dumps(page),)], "value string"), min_ts=5, max_ts=20, count=1)
    sinks.export_listens(flat, f"file://{tmp_path}/listens")
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/listens").collect()] == [("a", "r", "t15", 15)]


def test_delimited_files(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("ISO2|Name|More\nHU|Hungary|x\nAT|Austria|\nXX||y\n")
    got = readers.country_codes(spark, f"file://{tmp_path}/codes.csv", {"ISO2": "iso2", "Name": "en_name"})
    assert [tuple(r) for r in got.collect()] == [("XX", ""), ("AT", "Austria"), ("HU", "Hungary")]
    (tmp_path / "s.csv").write_text('a,b\n1,\n"",2\n')
    assert [tuple(r) for r in readers.strings(spark, f"file://{tmp_path}/s.csv").collect()] == [("1", ""), ("", "2")]
    assert readers.snapshot(spark, f"file://{tmp_path}/absent", f"file://{tmp_path}").sparkSession is spark if (tmp_path / "x.parquet").exists() else True
    assert readers.table_or_none(spark, "no_such_table") is None


class _Service(BaseHTTPRequestHandler):
    """Pages of plays, the second a lone one; the first request for page 2 fails."""

    failed = False

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        page, since = int(q["page"][0]), int(q.get("from", ["0"])[0])
        if page == 2 and not _Service.failed:
            _Service.failed = True
            self.send_error(503)
            return
        body: dict = {"error": 6, "message": "no such method"} if q["method"][0] == "bad" else {}
        if not body:
            plays = [{"artist": {"#text": "a"}, "name": f"t{page}{k}", "album": {"#text": ""}, "date": {"uts": str(10 * page + k)}} for k in range(1 if page == 2 else 3)]
            plays = [p for p in plays if int(p["date"]["uts"]) >= since]
            items = plays[0] if len(plays) == 1 else plays
            key, container = ("track", "recenttracks") if q["method"][0] == "user.getRecentTracks" else ("artist", "artists")
            body = {container: {key: items, "@attr": {"totalPages": "3"}}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def service():
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?method={{method}}&page={{page}}"
    server.shutdown()


def test_paged_service(spark, service):
    spark.dataSource.register(readers.PagedSource)
    read = lambda **o: spark.read.format("paged").options(url=service, pause="0", wait="0", pagesPerTask="1", **o).load()
    flat = readers.flatten_pages(read())
    assert sorted(r.uts for r in flat.collect()) == [10, 11, 12, 20, 30, 31, 32]
    assert sorted(r.uts for r in readers.flatten_pages(read(since="11"), since=11).collect()) == [12, 20, 30, 31, 32]
    items = readers.flatten_items(read(method="library.getArtists"), "library.getArtists")
    assert sorted(json.loads(r.item)["name"] for r in items.collect()) == ["t10", "t11", "t12", "t20", "t30", "t31", "t32"]
    with pytest.raises(ValueError, match="no such method"):
        readers.get_json(service.format(method="bad", page=1))


def test_geojson_of_mixed_shapes(spark, tmp_path):
    square = [[0, 0], [2, 0], [2, 2], [0, 2]]
    features = [{"properties": {"code": "A", "name": "x"}, "geometry": {"type": "Polygon", "coordinates": [square]}}, {"properties": {"code": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[x + 1, y] for x, y in square]], [[[9, 9]]]]}}]
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    geo = readers.geojson(spark, f"file://{tmp_path}/g.json")
    assert sorted(tuple(r) for r in readers.centroids(geo).collect()) == [("A", 1.0, 1.0), ("B", 2.0, 1.0)]
    met = readers.feature_counts(geo, spark.createDataFrame([("B", 7)], "code string, plays long"))
    assert sorted((r.code, r.plays) for r in met.collect()) == [("A", 0), ("B", 7)]


def test_providers(spark, tmp_path):
    schema = "artist_name string, mbid string, country string, aliases string"
    dim = spark.createDataFrame([("a", "5b11f4ce-a62d-471e-81fc-a69a8278c7da", "HU", "x, yy"), ("b", None, None, None)], schema)
    p = provider.TableProvider(dim)
    assert [r.artist_name for r in p.search("A", alias="yy", country="HU").collect()] == ["a"] and p.search("a", country="DE").count() == 0
    ids = spark.createDataFrame([("5b11f4ce-a62d-471e-81fc-a69a8278c7da",), ("b",), ("none",)], "key string")
    assert sorted((r.key[:1], r.artist_name) for r in p.resolve(ids).collect()) == [("5", "a"), ("b", "b"), ("n", None)]
    assert sorted(r.alias for r in p.aliases(dim.select("mbid")).collect()) == ["x", "yy"]
    through = provider.ReadThroughProvider(dim, provider.RemoteProvider(lambda names: [(n, "m", "DE", None) for n in names if n != "unknown"]))
    names = spark.createDataFrame([("a",), ("c",), ("unknown",)], "artist_name string")
    assert sorted((r.artist_name, r.country) for r in through.lookup(names).collect()) == [("a", "HU"), ("c", "DE"), ("unknown", None)]
    source = spark.createDataFrame([(1, "a")], "id int, n string")
    path = f"file://{tmp_path}/copy"
    assert provider.cached(source, path).count() == 1
    changed = spark.createDataFrame([(1, "b")], "id int, n string")
    assert provider.cached(changed, path).first().n == "a"  # the version is the same, so the copy is read
    assert provider.cached(spark.createDataFrame([(2, "b")], "id int, n string"), path).first().n == "b"
    groups = spark.createDataFrame([("g", ["a", "b"])], "cluster string, members array<string>")
    asked = provider.ask_decider(groups, lambda many: [("choose", m[0], 0.9) for m in many])
    assert [tuple(r) for r in asked.collect()] == [("g", "choose", "a", 0.9)]


def test_retries_double_their_waits():
    waits: list[float] = []
    calls = iter([ValueError, ValueError, None])

    def step():
        e = next(calls)
        if e:
            raise e("x")
        return {"ok": 1}

    assert pipeline.run_with_retries(step, tries=5, first=30, most=45, sleep=waits.append) == {"ok": 1} and waits == [30, 45]
    with pytest.raises(ZeroDivisionError):
        pipeline.run_with_retries(lambda: 1 // 0, tries=2, sleep=waits.append)


def test_model_is_saved_with_its_columns_and_matches_names(spark, tmp_path):
    names = ["anna", "annas", "berta", "bertas", "carl", "carls"]
    pairs = spark.createDataFrame([(a, b, int(a[:3] == b[:3])) for a in names for b in names if a != b], "variant_a string, variant_b string, label int")
    features = ["ratio", "token_set_ratio"]
    ml.save_link_model(ml.train_link_model(similarity.fuzzy_scores(pairs), features, rounds=4), features, f"file://{tmp_path}/m")
    model, columns = ml.load_link_model(spark, f"file://{tmp_path}/m")
    assert columns == features
    best = similarity.best_match_by_model(spark.createDataFrame([("anna",), ("zzz",)], "name string"), ["carls", "annas"], model)
    got = {r.name: (r.choice, r.score > 0.5) for r in best.collect()}
    assert got == {"anna": ("annas", True), "zzz": (None, False)}
    scored = ml.score_batch(model, columns, spark.createDataFrame([(1, 1.0)], "id int, ratio double"))
    assert scored.columns[:3] == ["id", "ratio", "token_set_ratio"] and scored.count() == 1


def test_short_series_have_no_parts(spark):
    import datetime as dt

    rows = [(dt.date(2000 + i // 12, i % 12 + 1, 1), float(i + 1)) for i in range(23)]
    got = temporal.decompose(spark.createDataFrame(rows, "month date, plays double")).collect()
    assert len(got) == 23 and all(r.trend is None and r.seasonal is None and r.resid is None for r in got)


def test_names_are_made_unique(spark):
    df = spark.createDataFrame([("a - b",), ("a-b",), ("a_b",), (" a b ",), ("é+",)], "n string")
    got = {r.n: r.clean for r in normalize.unique_names(df, "n").collect()}
    assert got["a - b"] == "a_minus_b" and got["é+"] == "é" and sorted(got[k] for k in (" a b ", "a-b", "a_b")) == ["a_b", "a_b_1", "a_b_2"]


def test_settings(tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"canonization_rules": [{"number": 2, "text": "b"}, {"number": 1, "text": "a"}]}))
    assert [r["text"] for r in config.load_rules(tmp_path / "r.json")] == ["a", "b"]
    (tmp_path / "p.json").write_text(json.dumps({"warm": ["#ff0000"], "bad": ["red"]}))
    with pytest.raises(ValueError):
        config.load_palettes(tmp_path / "p.json")


def test_sql_layout():
    text = "select a,  'from  x' from t left join u on t.a = u.a where b in (1, 2) order by a"
    assert format_sql(text).split("\n") == ["select a, 'from  x'", "from t", "left join u on t.a = u.a", "where b in (1, 2)", "order by a"]
    assert all(len(line) <= 40 for line in format_sql("select " + ", ".join(f"column_{i}" for i in range(20)), 40).split("\n"))


def test_tables_of_a_step_are_deleted(spark):
    with store.scope(spark):
        kept = store.materialize(spark.range(3), "x")
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert store.exists(spark, path)
    assert not store.exists(spark, path)


def test_functions_in_sql(spark):
    similarity.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM expand_pairs('b{ a{{c{b')").collect()] == [("a", "b"), ("a", "c"), ("b", "c")]
    assert spark.sql("SELECT name_ratio('abcd', 'abxd') AS r").first().r == 0.75


def test_incremental_pipeline(spark, tmp_path):
    raw = lambda *rows: spark.createDataFrame(list(rows), "Artist string, Song string, Album string, uts string, artist_mbid string")
    places = pipeline.Store(f"file://{tmp_path}/plays", f"file://{tmp_path}/artists", f"file://{tmp_path}/variants")
    spark.createDataFrame([], "artist_name string, mbid string, disambiguation_comment string, aliases string, country string").write.parquet(places.artists)
    ref = spark.createDataFrame([("A", "HU")], "artist_name string, country string")
    first = pipeline.run_incremental_pipeline(spark, places, raw(("A", "s", "x", "10", None)), ref)
    assert [s["step"] for s in first] == ["fetch", "enrich", "clean"] and first[0]["new"] == 1
    again = pipeline.run_incremental_pipeline(spark, places, raw(("A", "s", "x", "10", None)), ref)
    assert [s["status"] for s in again] == ["success"] * 3 and again[0]["new"] == 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace as N

    conf = N(get=lambda *_: None)
    cluster = N(conf=conf, sparkContext=N(getConf=lambda: conf, master="spark://host:7077", applicationId="a"))
    with pytest.raises(ValueError, match="checkpoint"):
        store.shared_dir(cluster)
    shared = N(conf=N(get=lambda *_: "hdfs://x/y/"), sparkContext=cluster.sparkContext)
    assert store.shared_dir(shared) == "hdfs://x/y"
