"""Vectorised text kernels: words, hashes and windows over whole Arrow string columns.

Everything works on the concatenated UTF-8 bytes of many texts at once, so the cost per word is a few numpy
operations and no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Odd multipliers of the polynomial hashes (mod 2**64); fixed values.
BYTE_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xC2B2AE3D27D4EB4F
SECOND_BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse mod 2**64 for i < n, grown as needed."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (int(n) - 1).bit_length())
        up = np.full(size, base, dtype=np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(up), np.cumprod(down)
        _POWERS[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """Hash of data[s:e] for each span, from one prefix sum."""
    up, down = powers(base, len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(BYTE_BASE >> 1))


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: byte spans, hashes, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(len(data), dtype=bool)
        before[1:] = ~solid[:-1]
        after = np.ones(len(data), dtype=bool)
        after[:-1] = ~solid[1:]
        self.starts = np.flatnonzero(solid & (before | edge[:-1]))
        self.ends = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # word number at which each text begins, and the end

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def window_hashes(words: np.ndarray, width: int, base: int = WINDOW_BASE) -> np.ndarray:
    """Hash of words[i:i+width] for every i that has a full window; texts are not told apart here."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * up[: len(words)], out=total[1:])
        return mix((total[width:] - total[:n]) * down[:n])


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the byte offset of each row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most_bytes`` of text, at least one row each, so that memory stays level."""
    i = batch.schema.get_field_index(column)
    texts = batch.column(i)
    if not len(texts):
        return
    sizes = np.array([0 if x is None else x for x in pa.compute.binary_length(texts).to_pylist()], dtype=np.int64)
    group = (np.cumsum(sizes) - sizes) // most_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        yield batch.slice(a, b - a)


def joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """For each text its kept words, joined by one space."""
    kept = np.flatnonzero(keep)
    starts, lengths = words.starts[kept], words.ends[kept] - words.starts[kept] + 1
    begin = np.cumsum(lengths) - lengths
    total = int(lengths.sum())
    source = np.arange(total) - np.repeat(begin, lengths) + np.repeat(starts, lengths)
    out = words.data[np.minimum(source, max(0, len(words.data) - 1))] if total else np.zeros(0, dtype=np.uint8)
    out[begin + lengths - 1] = 0x20
    at = np.searchsorted(kept, words.first)
    edge = np.append(begin, total)
    return [out[edge[a] : edge[b] - 1].tobytes() if b > a else b"" for a, b in zip(at[:-1], at[1:])]


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over values[i:i+width] for every full stretch."""
    have, out = 1, values
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out
