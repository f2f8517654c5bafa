"""Link model on scored pairs: features, boosted trees, reports, rules, batch scoring."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import length_stats
from ..store import materialize
from .similarity import expand_pairs, fuzzy_scores

#: Rows of one task in training.
ROWS_A_TASK = 100_000
LENGTHS = ["sig_len", "n_variants", "avg_len", "max_len", "var_len"]


def gold_pairs(groups: DataFrame) -> DataFrame:
    """Scores and length statistics of each pair of decided groups (variants, to_link)."""
    s = fuzzy_scores(expand_pairs(groups)).withColumn("l", length_stats(F.col("variants")))
    return s.select("*", *[F.col(f"l.{c}").alias(c) for c in LENGTHS]).drop("l")


def train_link_model(pairs: DataFrame, features: Sequence[str], label: str = "label", *, rounds: int = 400, depth: int = 4, rows_a_tree: float = 0.9, features_a_split: str = "0.75", bins: int = 32, seed: int = 47) -> PipelineModel:
    """Scaler and boosted trees as one pipeline, so that what is saved scores as it was trained; classes weigh by their inverse.

    Each tree sees a share of the rows, each split a share of the features, of whose values it tries ``bins``.

    Rows are written once and trained on in as many partitions as they fill: every tree is several passes over them.
    """
    pairs = materialize(pairs, "pairs")
    facts = pairs.agg(F.avg(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    share = facts["p"] or 0.5
    pairs = pairs.coalesce(1 + facts["n"] // ROWS_A_TASK)
    weighted = pairs.withColumn("__w", F.when(F.col(label) == 1, (1 - share) / max(share, 1e-9)).otherwise(1.0)).withColumn(label, F.col(label).cast("double"))
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="__raw"),
        RobustScaler(inputCol="__raw", outputCol="features", withCentering=True, withScaling=True),
        GBTClassifier(labelCol=label, weightCol="__w", maxIter=rounds, stepSize=0.05, maxDepth=depth, maxBins=bins, subsamplingRate=rows_a_tree, featureSubsetStrategy=features_a_split, seed=seed),
    ]
    return Pipeline(stages=stages).fit(weighted)


def score_links(model: PipelineModel, pairs: DataFrame) -> DataFrame:
    scored = model.transform(pairs).withColumn("probability", vector_to_array("probability")[1])
    return scored.drop("__raw", "features", "rawPrediction")


def area_under_curve(scored: DataFrame, label: str = "label") -> float:
    return BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol=label).evaluate(scored.withColumn(label, F.col(label).cast("double")))


def importances(model: PipelineModel, features: Sequence[str], n: int = 15) -> list[tuple[str, float]]:
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:n]


def rules_of(tree: DecisionTreeClassificationModel, features: Sequence[str]) -> list[str]:
    """Paths of a tree to leaves that predict 1, as texts of conditions."""
    out: list[str] = []
    path: list[str] = []
    for line in tree.toDebugString.split("\n")[1:]:
        text = line.strip()
        level = max(0, len(line) - len(line.lstrip()) - 2)
        if m := re.match(r"(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", text):
            path = path[:level] + [f"{features[int(m[1])]} {m[2]} {float(m[3]):g}"]
        elif text.startswith("Predict: 1"):
            out.append(" and ".join(path[:level]))
    return out


def save_link_model(model: PipelineModel, features: Sequence[str], path: str) -> None:
    """The model and, beside it, the columns that it scores, in their order."""
    model.write().overwrite().save(f"{path.rstrip('/')}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame(list(enumerate(features)), "place int, feature string").coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/features")


def load_link_model(spark: SparkSession, path: str) -> tuple[PipelineModel, list[str]]:
    columns = spark.read.parquet(f"{path.rstrip('/')}/features").orderBy("place").collect()
    return PipelineModel.load(f"{path.rstrip('/')}/model"), [r["feature"] for r in columns]


def score_batch(model: PipelineModel, features: Sequence[str], rows: DataFrame) -> DataFrame:
    """Rows with probability and prediction; features that are absent or null count as 0, other columns are carried."""
    aligned = rows.select(*[c for c in rows.columns if c not in features], *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in rows.columns else F.lit(0.0).alias(c) for c in features])
    return score_links(model, aligned)
