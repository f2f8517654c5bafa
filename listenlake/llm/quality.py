"""Quality classifier: a weak-label model over heuristic labellers, whose posterior labels train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BYTE_BASE, Words, mix, slices, span_hashes, text_buffer

#: Frequent function words of English, German, French and Spanish; fixed values.
FUNCTION_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine für im in ist mit nicht sich und von zu "
    "au aux avec ce dans de des du en est et il la le les ne pas pour que qui sur un une "
    "al como con de del el en es la las lo los más no para por que se su un una y"
).split()

#: Votes of a labeller.
BAD, GOOD, ABSTAIN = 0, 1, 2

WORD_SLOTS, SUFFIX_SLOTS, SHAPE_SLOTS = 2048, 1024, 512
SLOTS = WORD_SLOTS + SUFFIX_SLOTS + SHAPE_SLOTS
#: Distinct texts (about) whose posterior labels train the scorer, drawn from the whole table by hash.
SAMPLE_ROWS = 4000


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_SYMBOL = _table("#$%&*+<=>@[\\]^_`{|}~")
_SHOUT = _table("!")
_STOP = _table(".?")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
# letters beyond ASCII count by the byte that begins them; 0xC2 and 0xE2 begin the blocks of signs and of punctuation
_BEYOND_LATIN = np.zeros(256, dtype=np.int64)
_BEYOND_LATIN[[*range(0xCA, 0xE2), *range(0xE3, 0xF8)]] = 1
_LETTER = _UPPER + _LOWER + _BEYOND_LATIN
_LETTER[0xC3:0xCA] = 1


class Features:
    """Counts per word and per text of a batch that labellers and scorer share."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = w = Words(data, offsets)
        self.h = w.hashes()
        self.n = w.counts()
        count = {k: np.concatenate([[0], np.cumsum(t[data])]) for k, t in (("symbol", _SYMBOL), ("shout", _SHOUT), ("stop", _STOP), ("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("letter", _LETTER), ("beyond", _BEYOND_LATIN))}
        self.in_word = {k: c[w.ends] - c[w.starts] for k, c in count.items()}
        self.in_text = {k: c[offsets[1:]] - c[offsets[:-1]] for k, c in count.items()}
        self.length = w.ends - w.starts
        self.again = np.zeros(len(self.h), dtype=bool)
        self.again[1:] = self.h[1:] == self.h[:-1]
        self.again[w.first[:-1][w.first[:-1] < len(self.h)]] = False
        self.bare = w.data[w.starts] if len(w.starts) else np.zeros(0, dtype=np.uint8)

    def per_text(self, x: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(x)])
        return c[self.words.first[1:]] - c[self.words.first[:-1]]

    def distinct(self) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.n)), self.n)
        order = np.lexsort((self.h, owner))
        h, o = self.h[order], owner[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=len(self.n))


def _function_hashes() -> np.ndarray:
    raw = [w.encode() for w in FUNCTION_WORDS]
    data = np.frombuffer(b" ".join(raw), dtype=np.uint8)
    ends = np.cumsum([len(w) + 1 for w in raw]) - 1
    return np.unique(span_hashes(data, ends - [len(w) for w in raw], ends, BYTE_BASE))


_FUNCTION = _function_hashes()

LABELLERS = ("symbols", "shouting", "capitals", "stutter", "variety", "table", "function_words", "sentences", "word_length")


def votes(f: Features) -> np.ndarray:
    """(text, labeller) votes. Every labeller may be wrong, and most abstain between their two thresholds.

    Of a text in another script than Latin those that know only Latin words, sentence ends, capitals and spaces between words say nothing.
    """
    n = np.maximum(f.n, 1)
    share = lambda x, low, high: np.where(x <= low, GOOD, np.where(x >= high, BAD, ABSTAIN))
    letters = np.maximum(f.in_text["letter"], 1)
    at = np.minimum(np.searchsorted(_FUNCTION, f.h), len(_FUNCTION) - 1)
    function = f.per_text(_FUNCTION[at] == f.h) / n
    stops = f.in_text["stop"] / n
    mean = f.in_text["letter"] / n
    pipes = f.per_text((f.length == 1) & (f.bare == ord("|"))) / n
    latin = 2 * f.in_text["beyond"] <= letters
    long_enough = f.n >= 20
    sentences = long_enough & latin
    out = [
        share(f.per_text(f.in_word["symbol"] >= 2) / n, 0.02, 0.2),
        share(f.in_text["shout"] / n, 0.05, 0.4),
        np.where(latin, share(f.in_text["upper"] / letters, 0.12, 0.4), ABSTAIN),
        share(f.per_text(f.again) / n, 0.05, 0.3),
        np.where(long_enough, np.where(f.distinct() / n >= 0.3, GOOD, np.where((f.distinct() / n <= 0.12) & (f.n < 2000), BAD, ABSTAIN)), ABSTAIN),
        share(pipes, 0.02, 0.15),
        np.where(sentences, np.where(function >= 0.15, GOOD, np.where(function <= 0.04, BAD, ABSTAIN)), ABSTAIN),
        np.where(sentences, np.where((stops >= 0.02) & (stops <= 0.5), GOOD, np.where(stops < 0.005, BAD, ABSTAIN)), ABSTAIN),
        np.where(latin, np.where((mean >= 2.5) & (mean <= 9), GOOD, np.where((mean < 1.5) | (mean > 14), BAD, ABSTAIN)), ABSTAIN),
    ]
    return np.stack(out, axis=1)


def code(v: np.ndarray) -> np.ndarray:
    """One number for a row of votes: at most 3 ** len(LABELLERS) different ones."""
    return v @ (3 ** np.arange(v.shape[1]))


def decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


@dataclass
class WeakModel:
    """Prior of good, and each labeller's chance of each vote given bad and good, when it votes."""

    prior: float
    chance: np.ndarray

    def posterior(self, v: np.ndarray) -> np.ndarray:
        log = np.concatenate([np.log(self.chance), np.zeros((2, v.shape[1], 1))], axis=2)  # to abstain says nothing
        k = np.arange(v.shape[1])
        bad, good = np.log(1 - self.prior) + log[0, k, v].sum(axis=1), np.log(self.prior) + log[1, k, v].sum(axis=1)
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


def fit_weak(counts: Mapping[int, int], rounds: int = 100, smooth: float = 1.0) -> WeakModel:
    """Expectation-maximisation over the counts of vote patterns of all rows; labellers are independent given the class.

    It begins with each pattern's share of good votes, and a vote for the true class counts as at least as likely as against
    it, so that the classes cannot change places.
    """
    codes = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(c)] for c in codes], dtype=float)
    v = decode(codes)
    good, bad = (v == GOOD).sum(axis=1), (v == BAD).sum(axis=1)
    p = np.where(bad >= 1, 0.35 * good / np.maximum(good + bad, 1), 0.5 + 0.5 * good / np.maximum(good + bad, 1))
    model = WeakModel(0.5, np.full((2, v.shape[1], 2), 0.5))
    for _ in range(rounds):
        weight = np.stack([(1 - p) * n, p * n])
        chance = np.stack([np.stack([(weight[y][:, None] * (v == x)).sum(axis=0) for x in (BAD, GOOD)], axis=1) for y in (0, 1)]) + smooth
        model = WeakModel(float(np.clip(weight[1].sum() / max(n.sum(), 1e-9), 0.05, 0.95)), chance / chance.sum(axis=2, keepdims=True))
        model.chance[1, :, BAD] = np.minimum(model.chance[1, :, BAD], model.chance[0, :, BAD])
        model.chance[1, :, GOOD] = 1 - model.chance[1, :, BAD]
        before, p = p, model.posterior(v)
        if np.abs(p - before).max(initial=0) < 1e-9:
            break
    return model


def slots(f: Features) -> np.ndarray:
    """(feature, word) slots: the word, its last three bytes, its shape."""
    end = f.words.ends
    three = sum((f.words.data[np.maximum(end - 1 - k, f.words.starts)].astype(np.uint64) << np.uint64(8 * k) for k in range(3)), np.zeros(len(end), dtype=np.uint64))
    kind = np.digitize(f.length, [2, 3, 5, 9, 15, 30])
    some = lambda k, least=1: (f.in_word[k] >= least).astype(np.int64)
    shape = kind + 7 * (some("symbol") + some("symbol", 2)) + 21 * some("shout") + 42 * f.again + 84 * ((f.in_word["lower"] == 0) & (f.in_word["upper"] >= 2)) + 168 * some("digit")
    return np.stack([(f.h % np.uint64(WORD_SLOTS)).astype(np.int64), WORD_SLOTS + (mix(three) % np.uint64(SUFFIX_SLOTS)).astype(np.int64), WORD_SLOTS + SUFFIX_SLOTS + shape % SHAPE_SLOTS])


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 30, rate: float = 0.3, ridge: float = 1e-4, batch: int = 256) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels of weighted rows; small batches in the order given, with per-weight steps."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    m = (np.ones(len(y)) if weight is None else weight).astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    seen, seen_b = np.full(x.shape[1], 1e-8, dtype=np.float32), 1e-8
    for _ in range(rounds):
        for i in range(0, len(y), batch):
            xi, yi, mi = x[i : i + batch], y[i : i + batch], m[i : i + batch]
            gap = mi / mi.sum() * (1 / (1 + np.exp(-np.clip(xi @ w + np.float32(b), -30, 30))) - yi)
            g, gb = gap @ xi + np.float32(ridge) * w, float(gap.sum())
            seen, seen_b = seen + g * g, seen_b + gb * gb
            w, b = w - np.float32(rate) * g / np.sqrt(seen), b - rate * gb / np.sqrt(seen_b)
    return w.astype(np.float64), b


def _codes(batches):
    for batch in batches:
        for b in slices(batch, "__text"):
            yield pa.RecordBatch.from_arrays([pa.array(code(votes(Features(*text_buffer(b.column(0))))), pa.int64()), b.column(1)], names=["code", "h"])


def _rows(batches):
    """Distinct drawn texts of a task, with how often they were met: a hot text is looked at once."""
    met: dict[int, list] = {}
    for batch in batches:
        new = []
        for i, h in enumerate(batch.column(1).to_pylist()):
            if h in met:
                met[h][0] += 1
            else:
                met[h] = [1]
                new.append(i)
        for b in slices(batch.take(pa.array(new, pa.int64())), "__text"):
            f = Features(*text_buffer(b.column(0)))
            s = slots(f)
            for h, c, n, a, z in zip(b.column(1).to_pylist(), code(votes(f)).tolist(), f.n.tolist(), f.words.first[:-1], f.words.first[1:]):
                k, m = np.unique(s[:, a:z], return_counts=True)
                met[h] += [c, k.astype("<i4").tobytes(), (m / max(n, 1)).astype("<f4").tobytes()]
    rows = [(h, *found) for h, found in met.items() if found[2]]  # texts without words train nothing
    if rows:
        h, n, c, k, m = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), pa.array(m, pa.binary())], names=["h", "n", "code", "slots", "shares"])


@dataclass
class QualityModel:
    """The weak-label model and the scorer: a weight for each slot and the offset."""

    weak: WeakModel
    weights: np.ndarray
    offset: float

    def scores(self, f: Features) -> tuple[np.ndarray, np.ndarray]:
        """(posterior, quality) of each text; without words 0."""
        z = sum(f.per_text(self.weights[s]) for s in slots(f)) / np.maximum(f.n, 1) + self.offset
        quality = np.where(f.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
        return np.where(f.n > 0, self.weak.posterior(votes(f)), 0.0), quality


def fit_quality(docs: DataFrame, *, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Labellers' accuracies from the vote patterns of every row, and the scorer from about ``sample_rows`` distinct texts.

    The share of distinct texts that are drawn is reckoned by their number; of those drawn, by hash, the first by hash count, at most twice
    ``sample_rows``. A text weighs 1 + ln(its rows), so one with a million copies is no more than some. The same table gives the same model.
    """
    text = docs.select(F.col(text_col).alias("__text"), F.xxhash64(F.col(text_col)).alias("h"))
    # 3 ** 9 rows at most; equal texts vote alike, so distinct ones can be counted by pattern
    patterns = text.mapInArrow(_codes, "code long, h long").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("texts")).collect()
    weak = fit_weak({r["code"]: r["n"] for r in patterns})
    share = min(1.0, sample_rows / max(sum(r["texts"] for r in patterns), 1))
    draw = F.pmod(F.xxhash64("h", F.lit(17)), F.lit(1 << 30))
    drawn = text.where(draw < F.lit(int(share * (1 << 30)))).mapInArrow(_rows, "h long, n long, code long, slots binary, shares binary")
    drawn = drawn.groupBy("h").agg(F.sum("n").alias("n"), F.first("code").alias("code"), F.first("slots").alias("slots"), F.first("shares").alias("shares"))
    rows = drawn.orderBy(draw, "h").limit(2 * sample_rows).collect()
    w, b = np.zeros(SLOTS), 0.0
    if rows:
        x = np.zeros((len(rows), SLOTS), dtype=np.float32)
        for i, r in enumerate(rows):
            x[i, np.frombuffer(r["slots"], "<i4")] = np.frombuffer(r["shares"], "<f4")
        scale = np.sqrt((x**2).mean(axis=0)) + 0.02  # rare slots weigh little
        w, b = fit_linear(x / scale, weak.posterior(decode(np.array([r["code"] for r in rows]))), 1 + np.log([r["n"] for r in rows]))
        w = w / scale
    return QualityModel(weak, w, b)


def quality_scores(docs: DataFrame, *, text_col: str = "text", cutoff: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All rows and columns of ``docs`` with ``weak`` (the weak-label model's posterior), ``quality`` (the scorer's, 0 to 1) and ``keep``.

    Texts without words, null ones among them, score 0 and are not kept. Long texts are read whole, and ids play no part: rows are judged by
    their text alone, so repeated rows agree. Columns named like the results are replaced. An empty table gives no rows.
    """
    model = fit_quality(docs, text_col=text_col, sample_rows=sample_rows)

    def score(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in slices(batch, text_col):
                posterior, quality = model.scores(Features(*text_buffer(part.column(at))))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(posterior), pa.array(quality), pa.array(quality >= cutoff)], names=[*part.schema.names, "weak", "quality", "keep"])

    keep = docs.select(*[c for c in docs.columns if c not in ("weak", "quality", "keep")])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    return keep.mapInArrow(score, f"{fields}, weak double, quality double, keep boolean")
