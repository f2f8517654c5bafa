"""Best-fit packing of tokenized documents into sequences.

Items are vectors (tokens, one document, attention cost = tokens squared). How an item fits depends on its length alone,
so the plan is made on the histogram of lengths, which has at most ``capacity`` rows however large the corpus is. Bins
are kept as intervals of numbers that share a residual vector. Items find their places by rank among items of their length.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import defaultdict
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernels import slices, text_buffer
from .store import materialize

# a run of white space with a word of Latin letters that ends before punctuation, a space or the end; else with all up to the next space
_CHUNK = re.compile(r"[\x09-\x0d\x20]*[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+(?![^.,!?;:\x09-\x0d\x20])|[\x09-\x0d\x20]*[^\x09-\x0d\x20]+|[\x09-\x0d\x20]+")
#: Characters that some pre-tokenizer may treat as white space or that begin a special token's string: such texts are encoded whole.
_ODD = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xa0 ᠎ -‏    ⁠　﻿]|<\\|")
#: Words, and chunks of words, that each generation of a cache holds, and characters of them.
CACHED_WORDS, CACHED_CHUNKS = 700_000, 100_000
CACHED_CHARS = 16 << 20


class Cache:
    """Ids by string in two generations: entries in use move to the younger, the older goes as a whole."""

    def __init__(self, size: int, chars: int = CACHED_CHARS):
        self.size, self.chars, self.young, self.old, self.made = size, chars, {}, {}, 0

    def absent(self, needed: set[str]) -> list[str]:
        """Those of ``needed`` that must be made and put into ``young``; the others are there afterwards."""
        if len(self.young) + len(needed) > self.size or self.made > self.chars:
            self.old, self.young, self.made = self.young, {}, 0
        young, old, out = self.young, self.old, []
        for c in needed.difference(young):
            ids = old.get(c)
            if ids is None:
                out.append(c)
            else:
                young[c] = ids
        self.made += sum(map(len, out))
        return out


#: Bytes of characters that need a closer look: controls, and lead bytes of the blocks with rare spaces and marks.
_LOOK = np.zeros(256, dtype=bool)
_LOOK[[*range(0x09), *range(0x0E, 0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts in which every space follows a word directly and no rare character or special token can be."""
    flag = _LOOK[data]
    after = np.zeros(len(data), dtype=np.int64)
    if len(data):
        flag[1:] |= ((data[1:] == 0x20) & _WHITE[data[:-1]]) | ((data[1:] == ord("|")) & (data[:-1] == ord("<")))
        flag[offsets[:-1][offsets[:-1] < len(data)]] |= _WHITE[data[offsets[:-1][offsets[:-1] < len(data)]]]
        after = np.cumsum(flag)
    total = np.concatenate([[0], after])
    return total[offsets[1:]] == total[offsets[:-1]]


class ChunkEncoder:
    """Ids of texts, as little-endian uint32 bytes, by a byte-level BPE whose pre-tokens never run from a non-space into a space.

    Such a tokenizer can be applied to each run of white space plus following word by itself, and no pre-token holds both a
    letter and punctuation after it. Bounded caches of words (of plain texts) and of these chunks save most of the work. Texts
    with rare kinds of white space or special tokens go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.chunks = Cache(CACHED_WORDS), Cache(CACHED_CHUNKS)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _made(self, cache: Cache, missing: list[str], strings: list[str]) -> None:
        """Put the ids of ``strings`` into the cache under ``missing``, many a call; word numbers tell whose ids are whose."""
        for i in range(0, len(missing), 4096):
            part = strings[i : i + 4096]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            at = np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(part) + 1)) * 4
            ids, at = np.array(e.ids, dtype="<u4").tobytes(), at.tolist()
            cache.young.update(zip(missing[i : i + 4096], map(ids.__getitem__, map(slice, at[:-1], at[1:]))))

    def _chunked(self, texts: list[str]) -> list[bytes]:
        lists = [_CHUNK.findall(t) for t in texts]
        missing = self.chunks.absent({c for chunks in lists for c in chunks})
        self._made(self.chunks, missing, missing)
        get = self.chunks.young.__getitem__
        return [b"".join(map(get, chunks)) for chunks in lists]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        return self.encode([t or "" for t in column.to_pylist()], plain(*text_buffer(column)))

    def encode(self, texts: list[str], is_plain: np.ndarray) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        easy = [i for i, t in enumerate(texts) if is_plain[i] and t]
        lists = [texts[i].split(" ") for i in easy]
        # texts are plain, so a word after a space may hold other white space inside, but its start is the start of a pre-token
        missing = self.words.absent({w for words in lists for w in words[1:]})
        self._made(self.words, missing, [" " + w for w in missing])
        get = self.words.young.__getitem__
        for i, first, words in zip(easy, self._chunked([words[0] for words in lists]), lists):
            out[i] = first + b"".join(map(get, words[1:]))
        hard = [i for i, t in enumerate(texts) if t and not is_plain[i]]
        odd = [i for i in hard if _ODD.search(texts[i])]
        for i in odd:
            out[i] = self.whole(texts[i])
        rest = sorted(set(hard).difference(odd))
        for i, ids in zip(rest, self._chunked([texts[i] for i in rest])):
            out[i] = ids
        return out


#: How a byte-level BPE cuts texts before it merges, as its pre-tokenizer does by default; fixed value.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def _bytes_of_signs() -> dict[str, int]:
    """The byte that each sign in a byte-level vocabulary stands for: printable Latin-1 for itself, others in order from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankEncoder:
    """Ids of whole texts by a byte-level BPE whose vocabulary numbers its tokens in the order of their merges.

    There the token of the lowest id is merged first, which needs the vocabulary alone and no cache. A text that holds a special token's string
    goes through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: dict[bytes, int], special: list[str]):
        import tiktoken

        self.path, self.special, self.tokenizer = path, special, None
        self.ids = tiktoken.Encoding(os.path.basename(path), pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @classmethod
    def of(cls, path: str) -> RankEncoder | None:
        """The encoder of a tokenizer's file, or None if its model is of another kind or its vocabulary in another order."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut_by, signs = spec["model"], spec.get("pre_tokenizer") or {}, _bytes_of_signs()
        plain_model = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain_cut = cut_by.get("type") == "ByteLevel" and not cut_by.get("add_prefix_space") and cut_by.get("use_regex", True) and not spec.get("normalizer")
        if not plain_model or not plain_cut:
            return None
        special = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
        in_order = all(x is not None for x in merged) and all(x < y for x, y in zip(merged, merged[1:]))
        if not in_order or len(vocabulary) != 256 + len(merged) or any(c not in signs for t in vocabulary for c in t):
            return None
        return cls(path, {bytes(signs[c] for c in t): i for t, i in vocabulary.items()}, special)

    def whole(self, text: str) -> list[int]:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_column(self, column: pa.Array) -> list[bytes]:
        ids = self.ids
        return [np.array(self.whole(t) if any(s in t for s in self.special) else ids(t), dtype="<u4").tobytes() if t else b"" for t in column.to_pylist()]


@functools.cache
def encoder_of(path: str) -> RankEncoder | ChunkEncoder:
    """The encoder of this worker process, which serves task after task."""
    return RankEncoder.of(path) or ChunkEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all of ``capacity``, but the first may be shorter."""
    first = n % capacity or capacity
    starts = [0, *range(first, n, capacity)]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def plan(
    histogram: Mapping[int, int],
    capacity: int,
    most_docs: int,
    most_cost: float,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    rule: str = "norm",
) -> dict[int, list[tuple[int, int, int, int]]]:
    """Vector best-fit decreasing: length -> [(first rank, end rank, first bin, offset)], bins being consecutive per row.

    Longest items first. Of the bins that an item fits under every constraint, ``rule`` takes the one whose residual after it
    has the least weighted norm ("norm"), or whose residual has the least weighted dot product with the item ("dot").
    Residuals count as shares of the capacities.
    """
    caps = np.array([capacity, most_docs, most_cost], dtype=float)
    residuals = np.zeros((0, 3))
    held: list[list[tuple[int, int]]] = []
    index: dict[tuple, int] = {}
    live = np.zeros(0, dtype=bool)
    bins = 0
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)

    def add(residual: np.ndarray, span: tuple[int, int]) -> None:
        nonlocal residuals, live
        k = tuple(residual)
        if k not in index:
            free = np.flatnonzero(~live)
            if len(free):
                i = int(free[0])
                index.pop(tuple(residuals[i]), None)
                residuals[i] = residual
                held[i] = []
            else:
                i = len(held)
                residuals = np.vstack([residuals, residual])
                live = np.append(live, False)
                held.append([])
            index[k] = i
        i = index[k]
        live[i] = True
        held[i].append(span)

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        item = np.array([length, 1, length * length], dtype=float)
        if (item > caps).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        w = np.array(weights)
        while rank < n:
            fits = live & (residuals >= item).all(axis=1)
            if not fits.any():
                each = int(min(caps // item))
                fresh = -(-(n - rank) // each)
                add(caps.copy(), (bins, bins + fresh))
                bins += fresh
                continue
            at = np.flatnonzero(fits)
            if rule == "norm":
                score = (w * ((residuals[at] - item) / caps) ** 2).sum(axis=1)
            else:
                score = (w * (residuals[at] / caps) * (item / caps)).sum(axis=1)
            i = int(at[np.argmin(score)])
            a, b = held[i].pop()
            if not held[i]:
                live[i] = False
            m = min(b - a, n - rank)
            out[length].append((rank, rank + m, a, int(capacity - residuals[i][0])))
            after = residuals[i] - item
            if m < b - a:
                add(residuals[i].copy(), (a + m, b))
            if after[0] > 0:
                add(after, (a, a + m))
            rank += m
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    most_docs: int | None = None,
    most_cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    rule: str = "norm",
    keep: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row a piece: id_col, piece, start, length, the ``keep`` columns, sequence_id, offset.

    A document is its ids and ``end_id``; only one longer than ``capacity`` is cut. ``keep`` names columns derived from
    ``ids`` (binary, little-endian uint32; default the ids themselves); its names must not be those of other result columns. ``most_docs`` and ``most_cost`` bound the pieces of a
    sequence and the sum of their squared lengths (default: no bound beyond the tokens; a piece of ``capacity`` has the cost ``capacity`` squared, so
    whole documents allow no lower bound). Null or empty text is the end id alone; long texts are read whole. Every row is packed for itself,
    whether ids repeat, are null or not; an empty table gives no rows, extra columns are not read. Pieces are written once; then only narrow rows move.
    """
    keep = {"ids": F.col("ids")} if keep is None else dict(keep)
    clash = {id_col, "piece", "start", "length", "sequence_id", "offset"}.intersection(keep)
    if clash:
        raise ValueError(f"columns kept must not be named {sorted(clash)}")

    def tokenize(batches):
        encoder, ranks, part = encoder_of(tokenizer_path), defaultdict(int), TaskContext.get().partitionId()
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for b in slices(batch, "__text"):
                cols: dict[str, list] = {k: [] for k in ("row", "piece", "start", "length", "ids", "part", "rank")}
                for row, ids in enumerate(encoder.encode_column(b.column(1))):
                    ids += end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        for name, v in (("row", row), ("piece", piece), ("start", start), ("length", length), ("ids", ids[4 * start : 4 * (start + length)]), ("part", part), ("rank", ranks[length])):
                            cols[name].append(v)
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(cols["row"], pa.int64())),
                        pa.array(cols["piece"], pa.int32()),
                        pa.array(cols["start"], pa.int64()),
                        pa.array(cols["length"], pa.int64()),
                        pa.array(cols["ids"], pa.binary()),
                        pa.array(cols["part"], pa.int32()),
                        pa.array(cols["rank"], pa.int64()),
                    ],
                    names=["__id", "piece", "start", "length", "ids", "__part", "__rank"],
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(
        tokenize, f"__id {id_type}, piece int, start long, length long, ids binary, __part int, __rank long"
    )
    pieces = materialize(pieces.select("__id", "piece", "start", "length", *[c.alias(k) for k, c in keep.items()], "__part", "__rank"), "pieces")
    parts = pieces.groupBy("length", "__part").agg(F.count(F.lit(1)).alias("__n"))
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}
    places = plan(histogram, capacity, most_docs or capacity, most_cost or float(capacity) ** 2, weights, rule)
    arrays = {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in places.items()}
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("length", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = pieces.join(bases, ["length", "__part"]).select(F.col("__id").alias(id_col), "piece", "start", "length", *keep, (F.col("__base") + F.col("__rank")).alias("__rank"))

    def place(batches):
        for b in batches:
            lengths, ranks = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                low, _, first, at = arrays[int(lengths[rows[0]])]
                i = np.searchsorted(low, ranks[rows], side="right") - 1
                sequence[rows], offset[rows] = first[i] + ranks[rows] - low[i], at[i]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
