"""The pipeline on small documents against brute-force versions of its stages, each on its own input."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline as P
from listenlake.llm.queries import SQL, tokenizer_path

from .test_jaccard_join import brute as groups_of
from .test_line_dedup import brute as lines_left


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """(docs in, docs out) of each stage, as lists of rows, and the Parquet of each."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, paths = [docs.collect()], [f"{sf}/documents.parquet"]
    for k, (_, stage) in enumerate(P.STAGES):
        path = f"file://{base}/{k}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
        paths.append(f"{base}/{k}/*.parquet")
    return out, paths


def test_stages_keep_the_columns(stages):
    for rows in stages[0][1:-1]:
        assert rows and list(rows[0].asDict()) == P.COLUMNS


def test_quality(stages, spark, sf):
    before, after = stages[0][0], {r.doc_id: r for r in stages[0][1]}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(after[r.doc_id] == r for r in before if r.doc_id in after)
    kept = lambda y: np.mean([d in after for d, q in labels.items() if q == y])
    assert kept(1) > 0.95 and kept(0) < 0.15


def test_lines(stages):
    before, after = stages[0][1], {r.doc_id: r for r in stages[0][2]}
    for doc, kept, n, _ in lines_left([(r.doc_id, r.text) for r in before], 10):
        if n and not re.search(r"[^\x20\x09-\x0D]", kept):
            assert doc not in after
        else:
            assert after[doc].text == kept and (not n or after[doc].n_chars == len(kept))
    assert len({r.doc_id for r in before}) >= len(after)


def test_groups(stages):
    before, after = stages[0][2], {r.doc_id for r in stages[0][3]}
    assert after == {doc for doc, _, _, group in groups_of([(r.doc_id, r.text) for r in before]) if doc == group}


def test_mix(stages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{stages[1][3]}'")
    want = {d: taken // size for d, size, _, _, taken in con.sql(SQL["op9_mix_sources"]).fetchall() if size and taken}
    assert Counter(r.doc_id for r in stages[0][4]) == want


def test_packs(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    before, after = stages[0][4], stages[0][5]
    want = Counter()
    for r in before:
        want[r.doc_id] += len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1
    got, places = Counter(), defaultdict(list)
    for r in after:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for items in places.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048


def test_run(stages, spark, sf):
    assert P.run(spark, sf).count() == len(stages[0][5])


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "The man is in the house and it was good to see that.", "en", "s", 52), (3, "The man is in the house and it was good to see that.", "en", None, 52), (3, "x", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS kept", "2 AS node", "'q' AS quality")
    df.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert P.run(spark, f"file://{tmp_path}").count() >= 1
    df.where("false").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    assert P.run(spark, f"file://{tmp_path}/none").count() == 0


def test_copies_without_an_id_of_their_own(spark, sf):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text), (None, text), (5, text), (5, text), (6, "something else that nothing here is like at all"), (6, "and a third text of quite other words than these"), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.dedup_documents(spark, df, sf).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([rows[0], rows[4], rows[5], rows[6]], key=str)
