from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listenlake.llm import packing
from listenlake.llm.kernels import text_buffer
from listenlake.llm.queries import op7_pack, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_chunks_encode_like_whole_texts(tokenizer):
    texts = ["", " ", "\n\n", "a  b", "a \n b\t\tc  ", "it's we'll  don't", "x  y", "x y 　z", "tail   ", "<|endoftext|> a", "a<|endoftext|>", "é ü 42 4 2!?", "\x1cq \x85 z", "a\r\n b"]
    texts += ["a b\u00a0 c", "a b <|x", " a b", "a. b, (c), d's", "x\u00b2 y3 \u00bd4", "na\u00efve \u0430\u0431\u0432.", "a\n b", "n\u0303. m"]
    got = packing.ChunkEncoder(tokenizer_path()).encode(texts, packing.plain(*text_buffer(pa.array(texts))))
    for t, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (17, [(0, 1), (1, 8), (9, 8)]), (16, [(0, 8), (8, 8)])])
def test_cut(n, want):
    assert packing.cut(n, 8) == want


@pytest.mark.parametrize("rule,docs,cost,weights", [("norm", 100, 1e9, (1, 0, 0)), ("norm", 3, 1e9, (1, 1, 0)), ("dot", 4, 3000, (1, 1, 1))])
def test_plan_keeps_every_constraint(rule, docs, cost, weights):
    rng = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 40, 500), return_counts=True))}
    places = packing.plan(histogram, 64, docs, cost, weights, rule)
    bins = defaultdict(list)
    for length, rows in places.items():
        assert sorted(r for a, b, _, _ in rows for r in range(a, b)) == list(range(histogram[length]))
        for a, b, first, offset in rows:
            for k in range(b - a):
                bins[first + k].append((offset, length))
    for items in bins.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 64 and len(items) <= docs and sum(x * x for _, x in items) <= cost


def test_query_packs_every_document(spark, sf, tokenizer):
    rows = op7_pack(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for d in docs:
        ids = np.array(tokenizer.encode(d.text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        pieces = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert len(pieces) == max(1, math.ceil(len(ids) / 2048))
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        end = 0
        for offset, length in sorted(items):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in rows) / 2048) * 1.02 + 1


def test_odd_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", None), (2, "word " * 5000, "z"), (2, "word " * 5000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length string")
    got = packing.pack_documents(df, tokenizer_path(), capacity=64).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 2
    assert len([r for r in got if r.doc_id is None]) == 1
    empty = packing.pack_documents(df.where(F.lit(False)), tokenizer_path())
    assert empty.count() == 0 and "ids" in empty.columns


def sequences_of(places):
    bins = defaultdict(list)
    for length, rows in places.items():
        for a, b, first, _ in rows:
            for k in range(b - a):
                bins[first + k].append(length)
    return sorted(tuple(sorted(x)) for x in bins.values())


def test_each_limit_and_weight_changes_the_packing():
    histogram = {40: 3, 30: 4, 20: 6, 9: 10, 3: 30}
    free = sequences_of(packing.plan(histogram, 64, 64, 64.0**2))
    few = sequences_of(packing.plan(histogram, 64, 4, 64.0**2))
    cheap = sequences_of(packing.plan(histogram, 64, 64, 1700.0))
    assert max(map(len, free)) > 4 >= max(map(len, few))
    assert max(sum(x * x for x in s) for s in free) > 1700 >= max(sum(x * x for x in s) for s in cheap)
    rng = np.random.default_rng(6)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 50, 300), return_counts=True))}
    made = [packing.plan(histogram, 64, 8, 3000.0, w, rule) for w, rule in (((1.0, 0.0, 0.0), "norm"), ((0.2, 1.0, 1.0), "norm"), ((1.0, 1.0, 1.0), "dot"))]
    assert len({tuple(sequences_of(p)) for p in made}) == 3


def test_best_fit_against_plain_search():
    """Item by item, longest first, into the sequence with the least weighted residual."""
    rng = np.random.default_rng(4)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 60, 120), return_counts=True))}
    caps, w = np.array([64.0, 6.0, 3600.0]), np.array([1.0, 0.05, 0.05])
    open_: list[tuple[np.ndarray, list[int]]] = []
    for length in sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True):
        item = np.array([length, 1, length**2], dtype=float)
        fits = [(float((w * ((r - item) / caps) ** 2).sum()), k) for k, (r, _) in enumerate(open_) if (r >= item).all()]
        if fits:
            k = min(fits)[1]
            open_[k] = (open_[k][0] - item, [*open_[k][1], length])
        else:
            open_.append((caps - item, [length]))
    got = packing.plan(histogram, 64, 6, 3600.0, tuple(w))
    assert sequences_of(got) == sorted(tuple(sorted(x)) for _, x in open_)


def test_caches_are_bounded_by_characters(tokenizer):
    e = packing.ChunkEncoder(tokenizer_path())
    e.chunks.chars = e.words.chars = 1000
    texts = ["x" * 700 + str(i) + " " + "y" * 700 + str(i) for i in range(12)]
    for t in texts:
        assert np.frombuffer(e.encode([t], packing.plain(*text_buffer(pa.array([t]))))[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    assert len(e.words.young) + len(e.words.old) < 6


def test_kept_columns_must_not_clash(spark):
    with pytest.raises(ValueError):
        packing.pack_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), tokenizer_path(), keep={"length": F.col("ids")})


def test_ranks_give_the_tokenizer_s_ids(tokenizer):
    encoder = packing.RankEncoder.of(tokenizer_path())
    same = lambda texts: [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_column(pa.array(texts))] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert same(["", None, " ", "\n\n", "a  b", "it's we'll  don'T", "tail   ", "<|endoftext|> a", "a<|endoftext|>b", "<|endoftext|", "x" * 5000, "é ü 42 4 2!?", "\x1cq \x85 z", "a\r\n b"])
    # every code point between, before and after letters, digits, spaces and itself
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 7 == 0)]
    for i in range(0, len(points), 4096):
        assert same(["".join(f"a{c}b {c}1 {c}{c}. {c} x{c}\n{c}  {c}\t 1{c}2 '{c}s" for c in points[i + k : i + k + 64]) for k in range(0, 4096, 64)])
    # every token's own text
    assert same([tokenizer.decode([i], skip_special_tokens=False) for i in range(0, tokenizer.get_vocab_size(), 3)])


def test_other_tokenizers_keep_the_tokenizer_itself(tmp_path):
    import json

    spec = json.load(open(tokenizer_path(), encoding="utf-8"))
    spec["model"]["merges"] = spec["model"]["merges"][1:] + spec["model"]["merges"][:1]
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    assert packing.RankEncoder.of(str(tmp_path / "t.json")) is None
    assert isinstance(packing.encoder_of(str(tmp_path / "t.json")), packing.ChunkEncoder)
