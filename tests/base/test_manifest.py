from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from listenlake.sources import manifest
from listenlake.sources.manifest import Conflict, ManifestTable

SCHEMA = "artist_name string, album_title string, play_time timestamp, track_title string, artist_mbid string"


def plays(spark, rows):
    return spark.createDataFrame([(a, album, datetime.fromisoformat(t), s, None) for a, s, t, album in rows], SCHEMA)


def content(df):
    return sorted((r.artist_name, r.track_title, r.play_time.isoformat(" "), r.album_title) for r in df.collect())


@pytest.fixture
def table(spark, tmp_path):
    return ManifestTable(spark, f"file://{tmp_path}/plays", file_rows=4)


JANUARY = [(f"a{i}", "s", f"2024-01-{i + 1:02d}", "x") for i in range(10)]
FEBRUARY = [(f"a{i}", "s", f"2024-02-{i + 1:02d}", "x") for i in range(10)]


def test_a_batch_of_one_month_rewrites_only_files_of_its_keys(spark, table):
    first = table.merge(plays(spark, JANUARY + FEBRUARY))
    assert first["version"] == 0 and len(first["added"]) >= 5 and not first["removed"]
    before = {r.file: r for r in table.files().collect()}
    done = table.merge(plays(spark, [("a0", "s", "2024-01-01", "y"), ("a0", "t", "2024-01-01", "new")]))
    assert len(done["removed"]) == 1 and before[done["removed"][0]].month == "2024-01" and before[done["removed"][0]].first_key == "a0"
    after = {r.file for r in table.files().collect()}
    assert set(before) - after == set(done["removed"]) and after - set(before) == set(done["added"])
    assert all("2024-01" in f for f in done["added"])
    want = [r if r[:3] != ("a0", "s", "2024-01-01") else (*r[:3], "y") for r in JANUARY + FEBRUARY] + [("a0", "t", "2024-01-01", "new")]
    assert content(table.read()) == content(plays(spark, want))
    assert content(table.read(0)) == content(plays(spark, JANUARY + FEBRUARY))  # the version before is there


def test_the_last_row_of_a_key_wins_or_the_first(spark, table):
    rows = plays(spark, [("a", "s", "2024-01-01", "1"), ("a", "s", "2024-01-01", "3"), ("a", "s", "2024-01-01", "2")])
    table.merge(rows, F.col("album_title"))
    assert content(table.read())[0][3] == "3"
    kept = table.merge(plays(spark, [("a", "s", "2024-01-01", "9"), ("b", "s", "2024-01-01", "7"), ("b", "s", "2024-01-01", "6")]), F.col("album_title"), keep="old")
    assert not kept["removed"] and [r[3] for r in content(table.read())] == ["3", "6"]
    again = table.merge(plays(spark, [("a", "s", "2024-01-01", "9")]), keep="old")
    assert again["version"] == kept["version"] and again["rows"] == 0


def test_two_writers(spark, table):
    table.merge(plays(spark, JANUARY + FEBRUARY))
    other = ManifestTable(spark, table.path, file_rows=4)

    def beside(write, mine):
        """``mine`` is committed after ``write``, which began after it and ended before it."""
        commit = table._commit

        def late(*a):
            write()
            return commit(*a)

        table._commit = late
        try:
            return table.merge(plays(spark, mine))
        finally:
            table._commit = commit

    got = beside(lambda: other.merge(plays(spark, [("a1", "s", "2024-02-02", "theirs")])), [("a1", "s", "2024-01-02", "mine")])
    assert got["version"] == 2
    assert {r[3] for r in content(table.read()) if r[0] == "a1"} == {"theirs", "mine"}
    before = content(table.read())
    with pytest.raises(Conflict):  # both rewrite the file of a3
        beside(lambda: other.merge(plays(spark, [("a3", "s", "2024-01-04", "theirs")])), [("a3", "s", "2024-01-04", "mine")])
    assert content(table.read()) == sorted([*[r for r in before if r[:3] != ("a3", "s", "2024-01-04 00:00:00")], ("a3", "s", "2024-01-04 00:00:00", "theirs")])
    with pytest.raises(Conflict):  # both add a key that no file had
        beside(lambda: other.merge(plays(spark, [("z", "s", "2024-03-04", "theirs")])), [("z", "s", "2024-03-04", "mine")])
    assert table.merge(plays(spark, [("z", "s", "2024-03-04", "mine")]))["removed"]
    assert [r[3] for r in content(table.read()) if r[0] == "z"] == ["mine"]


def test_a_job_is_done_once(spark, table):
    table.merge(plays(spark, JANUARY), job="stream:0")
    version = table.merge(plays(spark, [("a1", "s", "2024-01-02", "y")]), job="stream:1")["version"]
    again = table.merge(plays(spark, [("a1", "s", "2024-01-02", "other")]), job="stream:1")
    assert again["version"] == version and [r[3] for r in content(table.read()) if r[0] == "a1"] == ["y"]


def test_reading_by_time_opens_only_files_in_question(spark, table):
    table.merge(plays(spark, JANUARY + FEBRUARY))
    got = table.read(since="2024-02-03", until="2024-02-05 00:00:00")
    assert content(got) == content(plays(spark, FEBRUARY[2:4]))
    assert all("2024-02" in f for f in got.inputFiles())
    assert table.read(since="2030-01-01").count() == 0


def test_many_merges_against_a_dictionary(spark, table, monkeypatch):
    monkeypatch.setattr(manifest, "CHECKPOINT_EVERY", 3)
    r = random.Random(5)
    want = {}
    for k in range(8):
        rows = [(r.choice(["a", "b", None, "ü", ""]), r.choice("st"), (datetime(2024, 1, 28) + timedelta(days=r.randint(0, 7))).isoformat(" "), f"{k}.{i:02d}") for i in range(12)]
        keep = "old" if k % 3 == 2 else "new"
        batch = {}
        for row in rows:
            if keep == "new" or row[:3] not in batch:
                batch[row[:3]] = row[3]
        want = {**want, **batch} if keep == "new" else {**batch, **want}
        table.merge(plays(spark, rows), F.col("album_title"), keep=keep)
    got = table.read()
    assert {(x.artist_name, x.track_title, x.play_time.isoformat(" ")): x.album_title for x in got.collect()} == want and got.count() == len(want)
    files = table.files().count()
    done = table.compact()
    assert done["removed"] and table.files().count() < files and table.read().count() == len(want)
    assert table.vacuum(keep=1) > 0 and table.vacuum(keep=1) == 0 and table.read().count() == len(want)


def test_empty_batches_and_tables(spark, table):
    assert table.merge(plays(spark, []))["version"] == -1 and table.files().count() == 0
    with pytest.raises(ValueError):
        table.read()
    with pytest.raises(ValueError):
        ManifestTable(spark, "x", keys=["artist_name"])


def test_few_rows_of_many_months_are_dealt_to_many_tasks_and_their_ranges_are_those_of_the_rows(spark, tmp_path):
    table = ManifestTable(spark, f"file://{tmp_path}/plays")
    rows = [(name, s, f"20{y:02d}-{m:02d}-{5 + k:02d}", f"{k}{s}") for y in (3, 24) for m in range(1, 13) for k, name in enumerate(["b", None, "ü", "", "a"]) for s in "st"]
    first = table.merge(plays(spark, rows + [("a", "s", "2003-01-09", "0"), ("a", "s", "2003-01-09", "9")]), "album_title")
    assert len({f.rpartition("/")[2][:10] for f in first["added"]}) > 4  # part-00000 and so on
    assert sum(e.rows for e in table.files().collect()) == len(rows) == table.read().count()
    assert [r.album_title for r in table.read().where("artist_name = 'a' and track_title = 's' and play_time = '2003-01-09'").collect()] == ["9"]
    for e in table.files().collect():
        here = spark.read.parquet(f"{table.path}/data/{e.file}").collect()
        names = sorted((r.artist_name or "").encode() for r in here)
        times = sorted(int((r.play_time - datetime(1970, 1, 1)).total_seconds()) * 1000000 for r in here)
        assert {r.play_time.strftime("%Y-%m") for r in here} == {e.month}
        assert (e.rows, e.first_key.encode(), e.last_key.encode(), e.first_time, e.last_time) == (len(here), names[0], names[-1], times[0], times[-1])


def test_a_key_that_fills_a_task_is_one_row_before_rows_are_dealt(spark, table):
    table.merge(plays(spark, JANUARY))
    hot = [("a1", "s", "2024-01-02", f"{i:02d}") for i in range(30)] + [("a2", "s", "2024-01-03", f"{i:02d}") for i in (3, 7, 5)]
    done = table.merge(plays(spark, hot), "album_title")
    assert {r[0]: r[3] for r in content(table.read()) if r[3] != "x"} == {"a1": "29", "a2": "07"} and table.read().count() == 10
    assert len(done["added"]) <= 3  # for the rows that stay, not for those that came
    ignored = table.merge(plays(spark, [("b", "s", "2024-01-02", f"{i:02d}") for i in range(9)] + hot), "album_title", keep="old")
    assert ignored["rows"] == 1 and not ignored["removed"] and [r[3] for r in content(table.read()) if r[0] == "b"] == ["00"]
