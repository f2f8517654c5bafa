"""Fuzzy name similarity: kernels in Arrow batches, exact pruning in the plan."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf, udtf

from ..functions.text import split_variants, token_sort
from ..store import new_path


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one machine word or big integer of bits a row."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 LCS / (length of both): 1 for equal, also for two empty texts."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows at the ends being cut off."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    windows = {long[max(0, i) : i + n] for i in range(1 - n, len(long))}
    best = max(ratio(short, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def _sorted_words(s: str) -> str:
    return " ".join(sorted(s.split()))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(_sorted_words(a), _sorted_words(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with each side's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, own_a, own_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not own_a or not own_b):
        return 1.0
    left, right = f"{both} {own_a}".strip(), f"{both} {own_b}".strip()
    scores = [ratio(left, right)]
    if both:
        scores += [ratio(both, left), ratio(both, right)]
    return max(scores)


def partial_token_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if x & y:
        return 1.0
    return max(partial_ratio(_sorted_words(a), _sorted_words(b)), partial_ratio(" ".join(sorted(x - y)), " ".join(sorted(y - x))))


def weighted_ratio(a: str, b: str) -> float:
    """Weighted best of the ratios; for texts of very different length the partial ones count, scaled down."""
    if not a or not b:
        return 0.0
    apart = max(len(a), len(b)) / min(len(a), len(b))
    best = ratio(a, b)
    if apart < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if apart < 8 else 0.6
    return max(best, scale * partial_ratio(a, b), scale * 0.95 * partial_token_ratio(a, b))


def quick_ratio(a: str, b: str) -> float:
    return ratio(a, b) if a and b else 0.0


SCORES = {
    "ratio": ratio,
    "partial_ratio": partial_ratio,
    "token_sort_ratio": token_sort_ratio,
    "token_set_ratio": token_set_ratio,
    "weighted_ratio": weighted_ratio,
    "quick_ratio": quick_ratio,
}


#: Entries of the table of letters that the pairs of one pass may have.
MASKS = 1 << 21


def lcs_lengths(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``lcs_length`` of many pairs at once, in blocks of bits: a pair's left text is a row of 64-bit words, and each place of the right texts one step of numpy for all pairs."""
    size = np.array([len(x) for x in left], dtype=np.int64), np.array([len(x) for x in right], dtype=np.int64)
    out = np.zeros(len(size[0]), dtype=np.int64)
    order = np.lexsort((size[1], size[0]))
    order = order[(size[0][order] > 0) & (size[1][order] > 0)]
    at = 0
    while at < len(order):
        # pairs of like length share a pass
        words = int(size[0][order[at]] + 63) // 64
        end = min(len(order), at + 4096, at + int(np.searchsorted((size[0][order[at:]] + 63) // 64, words, side="right")))
        part = order[at:end]
        codes_a, codes_b, letters = _coded([left[i] for i in part], [right[i] for i in part])
        step = max(1, MASKS // (letters * words))
        for k in range(0, len(part), step):
            some = part[k : k + step]
            out[some] = _lcs_block(codes_a[k : k + step], codes_b[k : k + step], size[0][some], size[1][some], letters, words)
        at = end
    return out


def _coded(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Texts as rows of small letter numbers; number 0 is a letter that the left texts do not have, or no letter."""

    def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(t) for t in texts])
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inside = np.arange(max(n.max(initial=0), 1)) < n[:, None]
        return flat, inside

    (a, in_a), (b, in_b) = points(left), points(right)
    letters, number = np.unique(a, return_inverse=True)
    rows_a, rows_b = np.zeros(in_a.shape, dtype=np.int32), np.zeros(in_b.shape, dtype=np.int32)
    rows_a[in_a] = number + 1
    place = np.minimum(np.searchsorted(letters, b), len(letters) - 1)
    rows_b[in_b] = np.where(letters[place] == b, place + 1, 0)
    return rows_a, rows_b, len(letters) + 1


def _lcs_block(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray, letters: int, words: int) -> np.ndarray:
    pair = np.arange(len(a))
    masks = np.zeros((len(a), letters, words), dtype=np.uint64)
    for i in range(int(n.max())):
        masks[pair, a[:, i], i // 64] |= np.uint64(1 << (i % 64))
    masks[:, 0] = 0
    row = np.full((len(a), words), ~np.uint64(0))
    with np.errstate(over="ignore"):
        for j in range(int(m.max())):
            hit = row & masks[pair, b[:, j]]
            carry = np.zeros(len(a), dtype=np.uint64)
            for w in range(words):
                part = row[:, w] + hit[:, w]
                whole = part + carry
                carry = ((part < row[:, w]) | (whole < part)).astype(np.uint64)
                row[:, w] = whole | (row[:, w] & ~hit[:, w])
    # a zero within the left text is a letter of the subsequence
    used = np.clip(n[:, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
    inside = np.where(used == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(used, 63)) - np.uint64(1))
    return np.bitwise_count(~row & inside).sum(axis=1).astype(np.int64)


def ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``ratio`` of many pairs."""
    total = np.array([len(x) + len(y) for x, y in zip(left, right)], dtype=np.int64)
    return np.where(total > 0, 2 * lcs_lengths(left, right) / np.maximum(total, 1), 1.0)


def partial_ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """``partial_ratio`` of many pairs: the windows of all of them go through one kernel, equal ones of a pair once."""
    short, window, owner = [], [], []
    out = np.zeros(len(left))
    for k, (x, y) in enumerate(zip(left, right)):
        sides = [(x, y)] if len(x) < len(y) else [(y, x)] if len(y) < len(x) else [(x, y), (y, x)]
        if not sides[0][0]:
            out[k] = 0.0 if sides[0][1] else 1.0
            continue
        for s, text in sides:
            n = len(s)
            found = {text[max(0, i) : i + n] for i in range(1 - n, len(text))}
            short += [s] * len(found)
            window += found
            owner += [k] * len(found)
    if owner:
        np.maximum.at(out, np.array(owner), ratios(short, window))
    return out


def batch_scores(left: Sequence[str], right: Sequence[str]) -> dict[str, np.ndarray]:
    """The six ``SCORES`` of many pairs; every ratio in them is computed for all pairs at once."""
    tokens = {t: (set(t.split()), _sorted_words(t)) for t in {*left, *right}}
    own = [(tokens[x][0], tokens[y][0]) for x, y in zip(left, right)]
    shared, rest_a, rest_b = ([" ".join(sorted(f(x, y))) for x, y in own] for f in (set.intersection, set.difference, lambda x, y: y - x))
    sorted_a, sorted_b = [tokens[t][1] for t in left], [tokens[t][1] for t in right]
    both, only_a, only_b = (np.array([bool(t) for t in side], dtype=bool) for side in (shared, rest_a, rest_b))
    words = np.array([bool(x) and bool(y) for x, y in own], dtype=bool)
    plain, by_sort = ratios(left, right), ratios(sorted_a, sorted_b)
    with_a, with_b = ([f"{s} {r}".strip() for s, r in zip(shared, rest)] for rest in (rest_a, rest_b))
    by_set = ratios(with_a, with_b)
    by_set = np.where(both, np.maximum(by_set, np.maximum(ratios(shared, with_a), ratios(shared, with_b))), by_set)
    by_set = np.where(~words, 0.0, np.where(both & (~only_a | ~only_b), 1.0, by_set))
    partial = partial_ratios(left, right)
    n = np.array([len(x) for x in left], dtype=np.int64), np.array([len(x) for x in right], dtype=np.int64)
    filled = (n[0] > 0) & (n[1] > 0)
    apart = np.maximum(*n) / np.maximum(np.minimum(*n), 1)
    weighted = np.maximum(plain, 0.95 * np.maximum(by_sort, by_set))
    far = np.flatnonzero(filled & (apart >= 1.5))
    if len(far):
        pick = lambda side: [side[k] for k in far]
        tokenwise = np.where(both[far], 1.0, np.maximum(partial_ratios(pick(sorted_a), pick(sorted_b)), partial_ratios(pick(rest_a), pick(rest_b))))
        scale = np.where(apart[far] < 8, 0.9, 0.6)
        weighted[far] = np.maximum(plain[far], scale * np.maximum(partial[far], 0.95 * tokenwise))
    none = np.where(filled, plain, 0.0)
    return dict(zip(SCORES, (plain, partial, by_sort, by_set, np.where(filled, weighted, 0.0), none)))


@pandas_udf(T.DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    there = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[there] = ratios(a[there].tolist(), b[there].tolist())
    return pd.Series(out).astype("Float64").mask(~there) if not there.all() else pd.Series(out)


@pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in SCORES]))
def scores_udf(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    there = (a.notna() & b.notna()).to_numpy()
    found = batch_scores(a[there].tolist(), b[there].tolist())
    out = pd.DataFrame({k: pd.Series(np.nan, index=range(len(a))).astype("Float64").mask(~there) for k in SCORES})
    for k, v in found.items():
        out.loc[there, k] = v
    return out


def fuzzy_scores(pairs: DataFrame, a: str = "variant_a", b: str = "variant_b") -> DataFrame:
    return pairs.withColumn("s", scores_udf(F.col(a), F.col(b))).select(*pairs.columns, "s.*")


#: Keys that a name may have for one length of its partner before fewer letters make a key.
KEYS = 32
#: Most letters of a key.
LETTERS = 5


def _letters_of_key(misses: int) -> int:
    """Letters of a key where the longer name may lack as many as ``misses``."""
    return max((p for p in range(1, LETTERS + 1) if math.comb(misses + p, p) <= KEYS), default=1)


#: The most letters that the longer name may lack where keys have two letters or more.
FEW_MISSES = max(m for m in range(KEYS) if _letters_of_key(m) > 1)


def prepared_names(names: DataFrame, column: str, *, sort_tokens: bool = False) -> DataFrame:
    """(name, k, n, l) of the distinct names: what is compared, its length, and its letters, told apart by occurrence, rarest first. Written once and read back."""
    key = token_sort(F.col(column)) if sort_tokens else F.col(column)
    n = names.where(F.col(column).isNotNull()).select(F.col(column).alias("name"), key.alias("k")).distinct().withColumn("n", F.length("k"))
    letters = n.where("n > 0").select("name", F.explode(F.split("k", "")).alias("c")).where("c <> ''").groupBy("name", "c").agg(F.count(F.lit(1)).alias("times"))
    letters = letters.select("name", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("i"), "c").select("name", F.concat("c", F.col("i").cast("string")).alias("t"))
    common = letters.groupBy("t").agg(F.count(F.lit(1)).alias("df"))  # one row a letter and occurrence
    rare = letters.join(common, "t").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("l")).select("name", F.col("l.t").alias("l"))
    n = n.join(rare, "name", "left").withColumn("l", F.coalesce("l", F.array().cast("array<string>")))
    path = new_path(n.sparkSession, "names")
    n.write.parquet(path)
    return n.sparkSession.read.schema(n.schema).parquet(path)


def _keys(n: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(name, na, nb, key) of the names as the longer and as the shorter of a pair of lengths na >= nb."""
    spark = n.sparkSession
    low = least / (2 - least)
    lengths = F.broadcast(n.agg(F.array_sort(F.collect_set("n")).alias("lengths")))  # one row, of numbers up to the longest name
    choices = [(m, p, *c, *[None] * (LETTERS - p)) for p in range(LETTERS + 1) for m in range(FEW_MISSES + 1) if m == 0 or p and math.comb(m + p, p) <= KEYS for c in combinations(range(m + p), p)]
    places = [f"c{i}" for i in range(LETTERS)]
    choices = F.broadcast(spark.createDataFrame(choices, "miss int, p int, " + ", ".join(f"{c} int" for c in places)))  # some hundred rows, by KEYS
    all_of = F.coalesce(*[F.when(F.col("far") == m, _letters_of_key(m)) for m in range(FEW_MISSES + 1)])

    def side(own: str, other: str) -> DataFrame:
        longer = own == "na"
        near = (lambda x: (x <= F.col("n")) & (x >= F.col("n") * low - 1e-9)) if longer else (lambda x: (x >= F.col("n")) & (x * low <= F.col("n") + 1e-9))
        r = n.join(lengths).select("name", "l", F.col("n").alias(own), F.explode(F.filter("lengths", near)).alias(other))
        shared = F.ceil(least * (F.col("na") + F.col("nb")) / 2 - 1e-9).cast("int")
        r = r.withColumn("shared", F.when(F.col("na") == 0, 0).otherwise(F.greatest(shared, F.lit(1)))).withColumn("far", F.col("na") - F.col("shared")).withColumn("miss", F.col(own) - F.col("shared")).where("miss >= 0")
        few = r.where(F.col("far") <= FEW_MISSES).withColumn("p", F.least(all_of, "shared")).join(choices, ["miss", "p"])
        few = few.select("name", "na", "nb", F.xxhash64(*[F.get("l", F.col(c)) for c in places]).alias("key"))
        many = r.where(F.col("far") > FEW_MISSES).select("name", "na", "nb", F.explode(F.slice("l", F.lit(1), F.col("miss") + 1)).alias("t")).select("name", "na", "nb", F.xxhash64("t").alias("key"))
        return few.unionByName(many)

    return side("na", "nb"), side("nb", "na")


def meetings(n: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b, of ``prepared_names`` that share a key."""
    longer, shorter = _keys(n, least)
    met = longer.withColumnRenamed("name", "x").join(shorter.withColumnRenamed("name", "y"), ["na", "nb", "key"]).where("x < y or (na > nb and x <> y)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def candidate_pairs(n: DataFrame, least: float, *, asked: str | None = None) -> DataFrame:
    """(a, b, ka, kb), a < b, of ``prepared_names`` that may have a ratio >= ``least``: all that have it, and others. ``asked``: a boolean column that holds for one of the two at least."""
    met = meetings(n, least)
    extra = [F.col(asked)] if asked else [F.lit(True)]
    side = lambda c: n.select(F.col("name").alias(c), F.col("k").alias(f"k{c}"), F.col("n").alias(f"n{c}"), F.col("l").alias(f"l{c}"), extra[0].alias(f"q{c}"))
    met = met.join(side("a"), "a").join(side("b"), "b").where("qa or qb")
    bound = 2.0 * F.size(F.array_intersect("la", "lb")) / F.greatest(F.col("na") + F.col("nb"), F.lit(1))
    return met.where((bound >= least - 1e-9) | (F.col("na") + F.col("nb") == 0)).select("a", "b", "ka", "kb")


def similar_pairs(names: DataFrame, column: str, least: float, *, sort_tokens: bool = False) -> DataFrame:
    """(a, b, sim), a < b, of the distinct names with ratio >= ``least`` > 0.

    Exact pruning before the kernel. For two lengths the ratio tells how many letters, told apart by occurrence, two names share at least, and so
    how many of its letters each may lack. The first p letters that they share, rarest first, are then among the first p and as many more as it may lack
    of either: names meet by equality of both lengths and a choice of p letters. p is the more the fewer may lack (five letters where two
    may, one where seven or more may), so that a name has at most ``KEYS`` keys a length, or one more than it may lack. Then all shared letters bound the ratio.
    """
    met = candidate_pairs(prepared_names(names, column, sort_tokens=sort_tokens), least)
    return met.select("a", "b", ratio_udf("ka", "kb").alias("sim")).where(F.col("sim") >= least)


def expand_pairs(groups: DataFrame, column: str = "variants") -> DataFrame:
    """Each pair (variant_a, variant_b) of the sorted distinct variants of a row."""
    v = F.array_sort(F.array_distinct(split_variants(F.col(column))))
    one = groups.withColumn("__v", v).select(*groups.columns, "__v", F.posexplode("__v").alias("__i", "variant_a"))
    return one.select(*groups.columns, "variant_a", F.explode(F.slice("__v", F.col("__i") + 2, F.greatest(F.size("__v") - F.col("__i") - 1, F.lit(0)))).alias("variant_b"))


@udtf(returnType="variant_a string, variant_b string")
class ExpandPairs:
    """``expand_pairs`` as a table function in SQL: ``SELECT * FROM expand_pairs('a{b{c')``; the operator itself stays in built-in functions."""

    def eval(self, variants: str):
        names = sorted({x.strip() for x in (variants or "").split("{")} - {""})
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                yield a, b


def register(spark: SparkSession) -> None:
    """The table function and the scores under their names in SQL."""
    spark.udtf.register("expand_pairs", ExpandPairs)
    spark.udf.register("name_ratio", ratio_udf)
    spark.udf.register("name_scores", scores_udf)


def best_match(names: DataFrame, choices: Sequence[str], threshold: float) -> DataFrame:
    """The choice of the highest score for each name, null and 0 if none reaches the threshold; the first of equals."""
    spark = names.sparkSession
    c = F.broadcast(spark.createDataFrame([(x,) for x in choices], "choice string"))  # a caller's list
    scored = names.select("name").distinct().join(c).withColumn("p", ratio_udf("name", "choice")).where(F.col("p") >= threshold)
    best = scored.groupBy("name").agg(F.max("p").alias("score"), F.min_by("choice", F.struct(-F.col("p"), F.col("choice"))).alias("choice"))
    return names.join(best, "name", "left").select("name", "choice", F.coalesce("score", F.lit(0.0)).alias("score"))


def best_match_by_model(names: DataFrame, choices: Sequence[str], model: PipelineModel, threshold: float = 0.5) -> DataFrame:
    """The choice that a link model gives the highest probability for each name, null and 0 if none reaches the threshold; the first of equals."""
    from .ml import score_links

    c = F.broadcast(names.sparkSession.createDataFrame([(i, x) for i, x in enumerate(choices)], "place int, choice string"))  # a caller's list
    pairs = names.select("name").distinct().join(c)
    scored = score_links(model, fuzzy_scores(pairs, "name", "choice")).where(F.col("probability") >= threshold)
    best = scored.groupBy("name").agg(F.max("probability").alias("score"), F.min_by("choice", F.struct(-F.col("probability"), "place")).alias("choice"))
    return names.join(best, "name", "left").select("name", "choice", F.coalesce("score", F.lit(0.0)).alias("score"))
