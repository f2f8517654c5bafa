from __future__ import annotations

import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from listenlake.sources import readers
from listenlake.sources.manifest import ManifestTable
from listenlake.streaming import incremental, stateful

PLAY = "artist_name string, track_title string, play_time timestamp, album_title string"


def put(spark, folder, name, rows):
    spark.createDataFrame([(a, s, datetime(2024, 1, 1) + timedelta(days=d), album) for a, s, d, album in rows], PLAY).coalesce(1).write.parquet(f"file://{folder}/in/{name}")


def drain(spark, folder, **o):
    stream = spark.readStream.schema(PLAY).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"file://{folder}/in")
    judged = stateful.judged_plays(stream, **o)
    query = stateful.write_judged(judged, f"file://{folder}/out", f"file://{folder}/mark")
    assert query.awaitTermination(120)
    return query


def keys(df):
    return sorted((r.artist_name, r.track_title, (r.play_time - datetime(2024, 1, 1)).days) for r in df.collect())


def test_repeats_and_late_plays_are_told_by_state(spark, tmp_path):
    put(spark, tmp_path, "1", [("a", "s", 0, "x"), ("a", "s", 0, "y"), ("a", "s", 20, "x"), ("b", "s", 5, "x"), (None, "s", 5, "x")])
    query = drain(spark, tmp_path)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != stateful.ROCKSDB
    put(spark, tmp_path, "2", [("a", "s", 20, "again"), ("a", "s", 14, "x"), ("a", "s", 3, "late"), ("b", "s", 5, "again"), ("b", "s", 3, "x"), ("c", "s", 0, "x"), (None, "s", 5, "again")])
    put(spark, tmp_path, "3", [("a", "s", 14, "again"), ("c", "s", 0, "again"), ("c", "t", 0, "x"), ("b", "s", 40, "x"), ("b", "s", 3, "again")])
    query = drain(spark, tmp_path)
    new = [("a", "s", 0), ("a", "s", 14), ("a", "s", 20), ("b", "s", 3), ("b", "s", 5), ("b", "s", 40), ("c", "s", 0), ("c", "t", 0)]
    out = f"file://{tmp_path}/out"
    got = stateful.verdicts(spark, out, "new")
    assert keys(got.where("artist_name is not null")) == new and got.where("artist_name is null").count() == 1
    assert keys(stateful.verdicts(spark, out, "late")) == [("a", "s", 3)]
    assert stateful.verdicts(spark, out, "repeat").count() == 7
    assert [p.numInputRows for p in query.recentProgress] == [7, 5]  # a file a batch
    assert "out" not in "".join(s.description for p in query.recentProgress for s in p.sources)  # nothing of the target is read


def test_a_drained_stream_equals_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plays = events.select(F.col("event_type").alias("artist_name"), (F.col("user_id") % 5).cast("string").alias("track_title"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("play_time"), F.lit("x").alias("album_title"))
    for k in range(3):
        plays.where(F.col("play_time").isNotNull() & (F.pmod(F.xxhash64("play_time", "track_title"), F.lit(3)) >= k - 1)).coalesce(1).write.parquet(f"file://{tmp_path}/in/{k}")
    drain(spark, tmp_path, horizon_days=10_000)
    got, want = stateful.verdicts(spark, f"file://{tmp_path}/out", "new"), plays.select("artist_name", "track_title", "play_time").distinct()
    assert got.count() == want.count() and keys(got) == keys(want)


def test_load_into_a_table_with_a_manifest(spark, tmp_path):
    raw = "Artist string, Song string, Album string, uts string, artist_mbid string"
    send = lambda name, *rows: spark.createDataFrame([(*r, None) for r in rows], raw).coalesce(1).write.json(f"file://{tmp_path}/in/{name}")
    table = ManifestTable(spark, f"file://{tmp_path}/plays")

    def load(mark):
        stream = spark.readStream.schema(raw).option("recursiveFileLookup", True).json(f"file://{tmp_path}/in")
        incremental.load_into(stream, table, f"file://{tmp_path}/{mark}", name=mark).awaitTermination(120)

    send("1", ("a", "s", "x", "10"), ("b", "s", "x", "20"))
    load("one")
    send("2", ("a", "s", "later", "10"), ("c", "s", "x", "30"))
    load("one")
    load("two")  # sends everything once more
    assert sorted((r.artist_name, r.album_title) for r in table.read().collect()) == [("a", "x"), ("b", "x"), ("c", "x")]


class _Service(BaseHTTPRequestHandler):
    """Plays by time, newest first, three to a page; one is on just now."""

    plays: dict[int, list[str]] = {}
    fail = 0
    asked: list[dict] = []

    def do_GET(self):
        q = parse_qs(urlparse(self.path).query)
        since, until = int(q["from"][0]), int(q.get("to", ["9999999999"])[0])
        _Service.asked.append({"from": since, "page": int(q["page"][0])})
        if _Service.fail and "to" in q and int(q["page"][0]) == 2:
            _Service.fail -= 1
            self.send_response(404)
            self.end_headers()
            return
        found = [(t, n) for t in sorted(_Service.plays, reverse=True) if since <= t <= until for n in _Service.plays[t]]
        page = int(q["page"][0]) - 1
        tracks = [{"artist": {"#text": "a"}, "name": n, "album": {"#text": ""}, "date": {"uts": str(t)}} for t, n in found[3 * page : 3 * page + 3]]
        tracks.insert(0, {"artist": {"#text": "a"}, "name": "now", "album": {"#text": ""}})
        body = {"recenttracks": {"track": tracks, "@attr": {"totalPages": str(max(1, -(-len(found) // 3)))}}}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def service():
    _Service.plays, _Service.fail, _Service.asked = {}, 0, []
    server = HTTPServer(("127.0.0.1", 0), _Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/?page={{page}}"
    server.shutdown()


def test_page_stream_goes_on_where_it_stopped(spark, service, tmp_path):
    spark.dataSource.register(readers.PagedSource)

    def run(**o):
        stream = spark.readStream.format("paged").options(url=service, pause="0", wait="0", pagesPerTask="1", **o).load()
        query = readers.flatten_pages(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/mark").trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    def got():
        return sorted((r.uts, r.Song) for r in spark.read.schema("Song string, uts long").parquet(f"file://{tmp_path}/out").collect())

    def want():
        return sorted((t, n) for t, names in _Service.plays.items() if t > 5 for n in names)

    _Service.plays = {t: [f"t{t}", *([f"u{t}"] if t % 4 == 0 else [])] for t in range(1, 20)}
    run(since="5")
    assert got() == want()
    _Service.plays |= {t: [f"t{t}"] for t in range(20, 40)}
    _Service.fail = 8  # a page that cannot be had: the batch is given up and the query ends
    with pytest.raises(Exception):  # noqa: B017
        run(since="5")
    assert got() == [x for x in want() if x[0] < 20]
    _Service.fail = 0
    _Service.plays |= {t: [f"t{t}"] for t in range(40, 50)}
    _Service.asked = []
    run(since="5")  # the batch that was given up, then what came meanwhile
    assert got() == want() and min(a["from"] for a in _Service.asked) > 5
    run(since="5", span="10")
    assert got() == want()
