"""Association, variance, outliers, regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import exact_percentiles


def contingency(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, x: str, y: str) -> DataFrame:
    """Cramér's V with Yates' correction for two by two tables.

    Cells without rows count through the marginals: each adds its expected number to chi-square, and all cells' expected numbers add up to the
    rows. So only cells that exist are looked at, however many categories there are. In a two by two table all gaps are equal.
    """
    cells = contingency(df, x, y)
    rows = cells.groupBy(x).agg(F.sum("n").alias("__r"))
    cols = cells.groupBy(y).agg(F.sum("n").alias("__c"))
    shape = cells.agg(F.sum("n").alias("__n")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("__rows"), F.sum(1 / F.col("__r")).alias("__ir"))))
    shape = shape.join(F.broadcast(cols.agg(F.count(F.lit(1)).alias("__cols"), F.sum(1 / F.col("__c")).alias("__ic"))))  # one row each
    met = cells.join(rows, x).join(cols, y).join(F.broadcast(shape))
    expected = F.col("__r") * F.col("__c") / F.col("__n")
    gap = F.abs(F.col("n") - expected)
    one = met.agg(
        F.sum(gap * gap / expected).alias("__chi"), F.sum(expected).alias("__e"), F.max(gap).alias("__gap"), *[F.first(c).alias(c) for c in ("__n", "__rows", "__cols", "__ir", "__ic")]
    )
    less = F.greatest(F.col("__gap") - F.least(F.lit(0.5), F.col("__gap")), F.lit(0.0))
    yates = (F.col("__rows") == 2) & (F.col("__cols") == 2)
    chi2 = F.when(yates, less * less * F.col("__n") * F.col("__ir") * F.col("__ic")).otherwise(F.col("__chi") + F.greatest(F.col("__n") - F.col("__e"), F.lit(0.0)))
    return one.select(chi2.alias("chi2"), F.sqrt(F.try_divide(chi2 / F.col("__n"), F.least("__rows", "__cols") - 1)).alias("v"))


def variances(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """(column_name, variance): population variances above the threshold."""
    one = df.agg(*[F.var_pop(c).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("variance")) for c in columns])
    return one.select(F.explode(rows).alias("r")).select("r.*").where(F.col("variance") > threshold)


def outliers(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows strictly outside two percentiles (linear interpolation), which are exact: distinct values are ordered in ranges."""
    q = exact_percentiles(df, column, [low, high])
    return df.join(F.broadcast(q)).where((F.col(column) < F.col("q")[0]) | (F.col(column) > F.col("q")[1])).drop("q")  # one row


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def correlation(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> list[list[float]]:
    """The matrix of a few dozen columns at most."""
    v = VectorAssembler(inputCols=list(columns), outputCol="v", handleInvalid="skip").transform(df)
    return Correlation.corr(v, "v", method).first()[0].toArray().tolist()


def drop_correlated(columns: Sequence[str], matrix: Sequence[Sequence[float]], threshold: float, variance: dict[str, float]) -> list[str]:
    """Columns to drop: of each pair above the threshold the one of lower variance, of equals the second."""
    out: list[str] = []
    for i, a in enumerate(columns):
        for j in range(i + 1, len(columns)):
            b = columns[j]
            if abs(matrix[i][j]) > threshold:
                loser = a if variance[a] < variance[b] else b
                if loser not in out:
                    out.append(loser)
    return out


def prune_correlated(columns: Sequence[str], matrix: Sequence[Sequence[float]], cutoff: float, variance: dict[str, float], least: int = 8) -> list[str]:
    """Columns left when the strongest pair above the cutoff loses its member of higher variance, again and again."""
    left = list(range(len(columns)))
    while len(left) > least:
        pairs = [(abs(matrix[i][j]), i, j) for a, i in enumerate(left) for j in left[a + 1 :]]
        r, i, j = max(pairs, key=lambda p: (p[0], -p[1], -p[2]))
        if r <= cutoff:
            break
        left.remove(i if variance[columns[i]] > variance[columns[j]] else j)
    return [columns[i] for i in left]


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    return df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))


def misclassified(df: DataFrame, truth: str, guess: str, probability: str) -> DataFrame:
    return df.where(F.col(truth) != F.col(guess)).withColumn(probability, F.round(probability, 3))


def stratified_split(df: DataFrame, label: str, id_col: str, *, test: float = 0.25, seed: int = 47, portable: bool = False) -> DataFrame:
    """``is_test`` for the given share of each label, by hash order: the same rows in every run. ``portable``: by a digest that other engines have as well."""
    w = Window.partitionBy(label)
    order = F.md5(F.concat(F.lit(str(seed)), F.col(id_col).cast("string"))) if portable else F.xxhash64(F.lit(seed), F.col(id_col))
    rank = F.row_number().over(w.orderBy(order, id_col))
    return df.withColumn("is_test", rank <= F.round(F.count(F.lit(1)).over(w) * test))
