"""Repeated byte strings by common-prefix interval trees over a sparse suffix array.

A string of ``least`` bytes has an anchor: of the grams of a third of its bytes the one that hashes least. Equal strings have equal anchors at equal
places, so all that can repeat is found among suffixes that start at anchors of one gram. One exchange sorts anchors by gram and by a hash of
all that ``least`` bytes around them reach; anchors whose whole context has occurred before are repeats throughout, and only the edges of
repeats are left: grams with several contexts.

Their contexts are brought together by gram. The suffixes after an anchor, sorted, with the common prefixes of neighbours, are an enhanced suffix
array; so are the reversed prefixes before it. A stack-scan of the latter gives an interval for each string on the left that parts its
members; a stack-scan of these members' suffixes gives the intervals of common suffixes. An interval whose members go on differently to the
left is a maximal repeat: it goes out with all its occurrences, of which the earliest stays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_BASE, SECOND_BASE, mix, slices, sliding, span_hashes, text_buffer, window_hashes
from .line_dedup import numbered
from .store import materialize

#: Contexts of one gram that a task may hold at once, some 300 bytes each; grams with more are cut to single strings that meet by hash.
CROWD = 50_000


def gram_of(least: int) -> int:
    return max(1, least // 3)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each gram, never 0."""
    return np.maximum(window_hashes(data.astype(np.uint64) + np.uint64(1), gram), np.uint64(1))


def anchors(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of anchors in the bytes, hash of the gram at each): every gram that is the least of a string of ``least`` bytes in one text."""
    gram = gram_of(least)
    h = gram_hashes(data, gram)
    span = least - gram + 1
    low = sliding(h, span, np.minimum) if len(h) >= span else h[:0]
    if not len(low):
        return np.zeros(0, dtype=np.int64), h[:0]
    within = np.arange(len(low)) + least <= np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    edge = np.zeros(span - 1, dtype=np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([edge, np.where(within, low, 0), edge]), span, np.maximum)[: len(h)] == h)
    return at, h[at]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of spans; those that touch are one."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1]) if len(start) else np.zeros(0, dtype=bool)
    return start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)] if len(start) else end


def _anchor_rows(least: int, every: bool = False):
    """(h, c, rank, key, pos, len): anchors with a hash of their context. One whose gram and context the same text had before is no row
    of its own: its context repeats throughout, and the union of such contexts goes out as spans (``len`` > 0), unless ``every`` anchor is wanted."""
    gram = gram_of(least)
    fields = ("h", "c", "rank", "key", "pos", "len")

    def run(batches):
        for batch in batches:
            for b in slices(batch, "__text"):
                data, offsets = text_buffer(b.column(2))
                at, h = anchors(data, offsets, least)
                row = np.searchsorted(offsets, at, side="right") - 1
                start, end = np.maximum(offsets[row], at - (least - gram)), np.minimum(offsets[row + 1], at + least)
                with np.errstate(over="ignore"):
                    c = mix(span_hashes(data, start, end, SECOND_BASE) + (at - start).astype(np.uint64))
                same = np.zeros(len(at), dtype=bool)
                if not every:
                    order = np.lexsort((at, c, h, row))
                    same[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (h[order[1:]] == h[order[:-1]]) & (c[order[1:]] == c[order[:-1]])
                once = np.flatnonzero(~same)
                # texts are moved apart by one place each, so that spans of two do not touch
                s, e = _merged((start + row)[same], (end + row)[same])
                k = np.searchsorted(offsets + np.arange(len(offsets)), s, side="right") - 1
                rows = pa.array(np.concatenate([row[once], k]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h[once], mix(s.astype(np.uint64))]).view(np.int64)),
                        pa.array(np.concatenate([c[once], mix(e.astype(np.uint64))]).view(np.int64)),
                        b.column(0).take(rows),
                        b.column(1).take(rows),
                        pa.array(np.concatenate([at[once] - offsets[row[once]], s - k - offsets[k]]).astype(np.int32)),
                        pa.array(np.concatenate([np.zeros(len(once), dtype=np.int64), e - s]).astype(np.int32)),
                    ],
                    names=fields,
                )

    return run


def _sorted_runs(least: int, every: bool = False):
    """From anchors in order of (h, c, rank, key, pos): (h, key, pos, end), with a null end for an anchor that has to meet others of its gram, else
    a span of bytes that are repeats.

    Only one row is held back: the first of a gram, until another context of that gram comes. A gram may go on in the next task,
    so the first row of the first and of the last gram always go out: meeting nobody does no harm. With ``every`` equal contexts meet too.
    """
    reach = least - gram_of(least)

    def rows(h, key, pos, end):
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(key), pa.array(pos.astype(np.int32)), end], names=["h", "key", "pos", "end"])

    def meet(h, key, pos):
        return rows(h, key, pos, pa.nulls(len(h), pa.int32()))

    def run(batches):
        held, last, out = None, None, False  # first row of the gram that is open, its last (h, c), whether the row went out
        for b in batches:
            h, c, key, pos, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5))
            whole = size > 0
            if whole.any():
                yield rows(h[whole], key[whole], pos[whole], pa.array((pos + size)[whole].astype(np.int32)))
                h, c, key, pos = (x[~whole] for x in (h, c, key, pos))
            if not len(h):
                continue
            new_h = np.append(last is None or h[0] != last[0], h[1:] != h[:-1])
            new_c = np.ones(len(h), dtype=bool) if every else new_h | np.append(last is None or c[0] != last[1], c[1:] != c[:-1])
            late = ~new_c
            if late.any():
                yield rows(h[late], key[late], np.maximum(pos[late] - reach, 0), pa.array((pos[late] + least).astype(np.int32)))
            second = new_c & ~new_h
            # grams by number: 0 is the one left open by the batches before
            gram = np.cumsum(new_h)
            several = np.bincount(gram[second], minlength=gram[-1] + 1) > 0
            if held is not None and not out and (several[0] or (gram[-1] > 0 and held[3])):
                yield meet(*(np.array([x]) for x in held[:3]))
                out = True
            firsts = np.flatnonzero(new_h)
            goes = several[gram[firsts]]
            take = np.sort(np.concatenate([firsts[goes], np.flatnonzero(second)]))
            if len(take):
                yield meet(h[take], key[take], pos[take])
            if len(firsts):
                opening = last is None
                if opening and len(firsts) > 1 and not goes[0]:  # the task's first gram, already closed
                    yield meet(h[firsts[:1]], key[firsts[:1]], pos[firsts[:1]])
                k = firsts[-1]
                held, out = (h[k], key[k], pos[k], opening and len(firsts) == 1), bool(goes[-1])
            last = (h[-1], c[-1])
        if held is not None and not out:
            yield meet(*(np.array([x]) for x in held[:3]))

    return run


def _pack(batches):
    """(id, key, bytes, text compressed), so that the one exchange of texts is small."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for b in slices(batch, "__text"):
            data, offsets = text_buffer(b.column(2))
            raw = [data[x:y].tobytes() for x, y in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(offsets)), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["id", "key", "n", "packed"]
            )


def _unpacked(n: pa.Array, packed: pa.Array):
    codec = pa.Codec("zstd")
    for size, z in zip(n.to_pylist(), packed):
        yield codec.decompress(z.as_buffer(), size, asbytes=True) if size else b""


CONTEXT = "h long, rank long, key long, pos int, left binary, gram binary, right binary"


def _contexts(least: int, with_gram: bool):
    """``CONTEXT`` of the anchors asked for; both sides end where the text does. Where nobody asks for it the gram, which ``h`` stands for, is null."""
    gram = gram_of(least)
    reach = least - gram
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        for b in batches:
            rows = []
            for key, t, asked, rank in zip(b.column(0).to_pylist(), _unpacked(b.column(1), b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()):
                for a in asked:
                    p = a["pos"]
                    rows.append((a["h"], rank, key, p, t[max(0, p - reach) : p], t[p : p + gram] if with_gram else None, t[p + gram : p + least]))
                if len(rows) > 20_000:
                    yield _batch(rows, types)
                    rows = []
            if rows:
                yield _batch(rows, types)

    return run


def _batch(rows: list, types) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in CONTEXT.split(", ")])


class SuffixArray:
    """Strings sorted within their groups: ``order``, each string's place in it (``place``), and ``lcp`` of each with the one before (-1: another group)."""

    def __init__(self, group: np.ndarray, strings: pa.Array, width: int, backwards: bool = False):
        data, offsets = _bytes(strings)
        size = np.diff(offsets)
        n = len(size)
        # a group, the bytes, and the length, which puts a string before those that go on with zero bytes
        cells = np.zeros((n, -(-(width + 6) // 8) * 8), dtype=np.uint8)
        cells[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
        j = np.arange(width)
        inside = j < size[:, None]
        source = offsets[1:, None] - 1 - j if backwards else offsets[:-1, None] + j
        if len(data):
            cells[:, 4 : 4 + width] = np.where(inside, data[np.clip(source, 0, len(data) - 1)], 0)
        cells[:, 4 + width : 6 + width] = size.astype(">u2").view(np.uint8).reshape(n, 2)
        self.order = np.lexsort(cells.view(">u8").astype(np.uint64).T[::-1])
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.order] = np.arange(n)
        body, size, group = cells[self.order, 4 : 4 + width], size[self.order], group[self.order]
        differ = np.concatenate([body[1:] != body[:-1], np.ones((max(n - 1, 0), 1), dtype=bool)], axis=1)
        common = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
        self.lcp = np.append(-1, np.where(group[1:] == group[:-1], common, -1))[:n]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def intervals(lcp: list[int], least: int = 0):
    """(depth, first, last) of every common-prefix interval of ``least`` or more, children first: one scan with a stack of the intervals that are open."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate(lcp):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i - 1
        if depth >= least and i and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    while stack:
        d, first = stack.pop()
        yield d, first, len(lcp) - 1


def maximal_repeats(group: np.ndarray, left: pa.Array, right: pa.Array, gram: int, least: int):
    """(length to the left of the anchor, length from it on, members) of every maximal repeat of ``least`` bytes or more in the contexts of anchors.

    ``group`` numbers grams. Members are all contexts that hold it; at a context's end it counts as going on differently.
    """
    reach = least - gram
    before, after = SuffixArray(group, left, reach, backwards=True), SuffixArray(group, right, reach)
    pairs, larger = [], []
    for node in intervals(before.lcp.tolist()):
        (pairs if node[2] == node[1] + 1 else larger).append(node)
    if pairs:
        depth, first, _ = np.array(pairs).T
        a, b = before.order[first], before.order[first + 1]
        low, high = np.minimum(after.place[a], after.place[b]), np.maximum(after.place[a], after.place[b])
        near = np.flatnonzero(high - low < 64)  # contexts of a pair are mostly neighbours in the other order as well
        common = np.empty(len(a), dtype=np.int64)
        near_common = np.full(len(near), 1 << 30)
        for step in range(1, 64):
            open_ = low[near] + step <= high[near]
            if not open_.any():
                break
            near_common[open_] = np.minimum(near_common[open_], after.lcp[(low[near] + step)[open_]])
        common[near] = near_common
        for k in np.flatnonzero(high - low >= 64):
            common[k] = after.lcp[low[k] + 1 : high[k] + 1].min()
        for k in np.flatnonzero(depth + gram + common >= least):
            yield int(depth[k]), gram + int(common[k]), np.array([a[k], b[k]])
    for depth, first, last in larger:
        members = before.order[first : last + 1]
        # a child for each way to go on to the left
        child = np.cumsum(np.append(0, before.lcp[first + 1 : last + 1] == depth))
        place = after.place[members]
        order = np.argsort(place)
        place, members, child = place[order], members[order], child[order]
        common = np.minimum.reduceat(after.lcp[place[0] + 1 : place[-1] + 1], place[:-1] - place[0])
        for d, i, j in intervals([-1, *common.tolist()], max(0, least - gram - depth)):
            ways = child[i : j + 1]
            if (ways != ways[0]).any():  # left-extension diversity
                yield depth, gram + d, members[i : j + 1]


def _groups_of(batches):
    """Batches of whole groups, from rows in order of ``h``; what a batch leaves open waits for the next."""
    open_ = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b] if open_ is None else [*open_.to_batches(), b]).combine_chunks()
        h = t.column(0).to_numpy()
        cut = int(np.searchsorted(h, h[-1], side="left"))
        open_ = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if open_ is not None:
        yield open_


def _tree(least: int, with_groups: bool):
    """Repeats of contexts in order of gram: spans (key, pos, end) of what an earlier occurrence covers, or all occurrences of each group."""
    gram = gram_of(least)

    def run(batches):
        for t in _groups_of(batches):
            h, rank, key, pos = (t.column(i).to_numpy() for i in range(4))
            group = np.cumsum(np.append(0, h[1:] != h[:-1]))
            # contexts by place in the corpus, so that the earliest of a group has the least number
            order = np.lexsort((pos, key, rank))
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.arange(len(order))
            left, right = (t.column(i).combine_chunks() for i in (4, 6))
            found = maximal_repeats(group, left, right, gram, least)
            if with_groups:
                yield from _group_batches((x for x in found if _own(t, x, gram, least)), h, rank, key, pos, number)
                continue
            before, after = np.full(len(h), -1), np.zeros(len(h), dtype=np.int64)
            for back, on, members in found:
                late = members[number[members] != number[members].min()]
                # all that is covered around an anchor holds its gram, so the union is one span
                before[late] = np.maximum(before[late], back)
                after[late] = np.maximum(after[late], on)
            hit = np.flatnonzero(before >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array((pos[hit] - before[hit]).astype(np.int32)), pa.array((pos[hit] + after[hit]).astype(np.int32))], names=["key", "pos", "end"])

    return run


def _anchored(left: bytes, middle: bytes, right: bytes, o: np.ndarray, gram: int, least: int) -> np.ndarray:
    """For strings that begin ``o`` bytes before a gram, whether it hashes least in them."""
    h = gram_hashes(np.frombuffer(left + middle + right, dtype=np.uint8), gram)
    return sliding(h, least - gram + 1, np.minimum)[len(left) - o] == h[len(left)]


def _own(t: pa.Table, repeat, gram: int, least: int) -> bool:
    """Whether the anchor is one by strings within the repeat. If not, it need not be one at every occurrence, and another anchor has the repeat."""
    back, on, members = repeat
    left, middle, right = (t.column(i)[int(members[0])].as_py() for i in (4, 5, 6))
    o = np.arange(max(0, least - on), back + 1)
    return bool(_anchored(left, middle, right, o, gram, least).any())


def _group_batches(found, h, rank, key, pos, number):
    for back, on, members in found:
        members = members[np.argsort(number[members])]
        name = hashlib.md5(f"{h[members[0]]}:{rank[members[0]]}:{key[members[0]]}:{pos[members[0]]}:{back}:{on}".encode()).hexdigest()
        k = len(members)
        yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array([back + on] * k, pa.int32()), pa.array(key[members]), pa.array((pos[members] - back).astype(np.int32))], names=["group", "length", "key", "pos"])


def _strings(least: int, with_gram: bool):
    """(w1, w2, rank, key, pos): each string of ``least`` bytes of a context that holds its gram, by hash; with the gram at hand only those it is the anchor of."""
    gram = gram_of(least)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                t = b.slice(at, 512)
                h, rank, key, pos = (t.column(i).to_numpy() for i in range(4))
                (lead, lead_at), (tail, tail_at) = _bytes(t.column(4)), _bytes(t.column(6))
                least_o, most_o = np.maximum(0, least - gram - np.diff(tail_at)), np.diff(lead_at)
                n = np.maximum(most_o - least_o + 1, 0)
                row = np.repeat(np.arange(len(n)), n)
                o = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + least_o[row]
                if with_gram:
                    keep = np.concatenate([_anchored(*(t.column(c)[i].as_py() for c in (4, 5, 6)), o[row == i], gram, least) for i in range(t.num_rows)])
                    row, o = row[keep], o[keep]
                w = []
                for base in (SECOND_BASE, BYTE_BASE):
                    # the gram between the two is that of h
                    x, y = span_hashes(lead, lead_at[row + 1] - o, lead_at[row + 1], base), span_hashes(tail, tail_at[row], tail_at[row] + least - gram - o, base)
                    with np.errstate(over="ignore"):
                        w.append(mix(mix(x + o.astype(np.uint64)) * np.uint64(3) + y + h.view(np.uint64)[row]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(w[0]), pa.array(w[1]), pa.array(rank[row]), pa.array(key[row]), pa.array((pos[row] - o).astype(np.int32))], names=["w1", "w2", "rank", "key", "pos"])

    return run


def _cut_out(with_text: bool):
    """Per text: bytes, removed bytes, removed runs, digest of the rest."""

    def run(batches):
        for b in batches:
            removed, runs, digests, kept = [], [], [], []
            for text, size, spans in zip(_unpacked(b.column(1), b.column(2)), b.column(1).to_pylist(), b.column(3)):
                gone, rest = (np.zeros(0, dtype=np.int64),) * 2, text
                if spans.is_valid and len(spans):
                    ends = np.minimum(spans.values.field("end").to_numpy(), size).astype(np.int64)
                    gone = _merged(np.maximum(spans.values.field("pos").to_numpy(), 0).astype(np.int64), ends)
                    rest = b"".join(text[x:y] for x, y in zip([0, *gone[1].tolist()], [*gone[0].tolist(), size]))
                removed.append(size - len(rest))
                runs.append(len(gone[0]))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string()), *([pa.array(kept, pa.binary())] if with_text else [])],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text,
            )

    return run


class _Corpus:
    """Texts with a place in the corpus (rank, key), the anchors that repeat, and contexts of those that must meet."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, least: int, every: bool = False):
        rows, kind = numbered(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text")), "id")
        unique = kind == "long"
        self.rank = F.lit(0).cast("long") if unique else F.coalesce("id", F.lit(-(1 << 63)))
        base = rows.select("id", (F.col("id") if unique else F.col("__id.row")).alias("key"), "__text").where("key is not null")
        self.least, self.every = least, every
        # one exchange by key serves both joins
        self.packed = base.mapInArrow(_pack, "id long, key long, n long, packed binary").where("key is not null")
        rows = base.select(self.rank.alias("rank"), "key", "__text").mapInArrow(_anchor_rows(least, every), "h long, c long, rank long, key long, pos int, len int")
        # ranges of (h, c, place): a gram or a context that very many texts share is dealt over several tasks
        order = ["h", "c", "rank", "key"]
        runs = rows.repartitionByRange(*order).sortWithinPartitions(*order, "pos").mapInArrow(_sorted_runs(least, every), "h long, key long, pos int, end int")
        self.found = materialize(runs, "repeats")
        self.meet = self.found.where("end is null").select("h", "key", "pos")

    def contexts(self, meet: DataFrame) -> DataFrame:
        asked = meet.groupBy("key").agg(F.collect_list(F.struct("h", "pos")).alias("asked"))
        # all columns, those that are not needed as well: else the exchange of texts would be another one
        rows = self.packed.join(asked, "key").select("key", "n", "packed", "asked", self.rank.alias("rank"), "id")
        return rows.mapInArrow(_contexts(self.least, self.every), CONTEXT)

    def by_gram(self, meet: DataFrame) -> DataFrame:
        return self.contexts(meet).repartition("h").sortWithinPartitions("h")

    def crowds(self, crowd: int) -> DataFrame | None:
        """Grams with more contexts than a task may hold at once."""
        found = materialize(self.meet.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("h"), "crowds")
        return found if found.limit(1).count() else None

    def strings(self, crowds: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(strings of ``least`` bytes in crowded contexts, those that are met twice with their first place)."""
        kinds = "w1 long, w2 long, rank long, key long, pos int"
        rows = materialize(self.contexts(self.meet.join(crowds, "h", "left_semi")).mapInArrow(_strings(self.least, self.every), kinds), "strings")
        # written, so that joins are of two plain exchanges and a string that very many texts share can be split
        first = rows.groupBy("w1", "w2").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first < last")
        return rows, materialize(first.drop("last"), "first")


def _place():
    return F.struct("rank", "key", "pos")


def dedup_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100, crowd: int = CROWD, with_text: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256), one row per row of ``docs``; ``with_text`` adds ``kept``, the bytes left.

    A byte goes if a string of ``least`` bytes that covers it also starts earlier: in a row with a smaller id, or before in the same text. Strings
    are judged on the input, overlaps count, none crosses rows. A null text is empty. Null ids come first; rows without an id, or with
    a repeated one, are documents of their own, in the order of a written row number. Extra columns are not read. What is left may part a
    code point, so ``kept`` is binary.
    """
    c = _Corpus(docs, id_col, text_col, least)
    meet = c.meet
    spans = c.found.where("end is not null").select("key", "pos", "end")
    crowds = c.crowds(crowd)
    if crowds is not None:
        strings, first = c.strings(crowds)
        late = strings.join(first, ["w1", "w2"]).where(_place() > F.col("first"))
        spans = spans.unionByName(late.select("key", "pos", (F.col("pos") + least).alias("end")))
        meet = meet.join(crowds, "h", "left_anti")
    spans = spans.unionByName(c.by_gram(meet).mapInArrow(_tree(least, False), "key long, pos int, end int"))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("pos", "end")).alias("spans"))
    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return c.packed.join(spans, "key", "left").select("id", "n", "packed", "spans").mapInArrow(_cut_out(with_text), fields).withColumnRenamed("id", id_col)


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 100, crowd: int = CROWD) -> DataFrame:
    """(group, length, id_col, start): all occurrences of every string that is repeated and maximal in reach of an anchor, in bytes.

    A string is maximal if its occurrences go on differently on both sides. Beyond ``least`` bytes to the right of an anchor, or ``least`` less a
    gram to the left, nothing is compared: a longer repeat comes as groups that overlap along it. Grams with more than ``crowd``
    occurrences come as groups of ``least`` bytes. Rows as for ``dedup_bytes``.
    """
    c = _Corpus(docs, id_col, text_col, least, every=True)
    meet, crowds = c.meet, c.crowds(crowd)
    kinds = "group string, length int, key long, pos int"
    if crowds is not None:
        meet = meet.join(crowds, "h", "left_anti")
    groups = c.by_gram(meet).mapInArrow(_tree(least, True), kinds)
    if crowds is not None:
        strings, first = c.strings(crowds)
        name = F.concat(F.hex("w1"), F.lit(":"), F.hex("w2"))
        groups = groups.unionByName(strings.join(first, ["w1", "w2"]).select(name.alias("group"), F.lit(least).alias("length"), "key", "pos").distinct())
    ids = c.packed.select("key", F.col("id").alias(id_col))
    return groups.withColumnRenamed("pos", "start").join(ids, "key").select("group", "length", id_col, "start")
