"""Random forest for pairs: features, weights, tuning on a fixed validation split, evaluation, importance, predictions."""

from __future__ import annotations

import itertools
import random
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import MODEL_FEATURES
from . import ranking, stats

#: Years that are missing; trees split them off.
NO_YEAR = -1
#: How classes may be weighed (fixed values). Spark weighs rows, not the rows of a tree's sample, so that both give the same.
WEIGHTS = ("balanced", "balanced_subsample")
#: Space of the search, and of the grid (fixed values); a depth of 30, Spark's most, stands for no bound.
SPACE = {"trees": range(100, 401, 50), "depth": range(5, 31, 5), "split": range(2, 11), "leaf": range(1, 6), "subset": ("sqrt", "log2"), "weights": WEIGHTS}
GRID = {"trees": (200, 250), "depth": (30, 15, 20), "split": (2, 5), "leaf": (1, 2), "subset": ("sqrt",), "weights": WEIGHTS}


class Params(NamedTuple):
    """The published forest.

    split, the least rows that a node is split at, has no counterpart in Spark: a node of fewer rows than twice the least
    leaf is never split, so the leaf is raised to half of it, which splits a little less than was asked.
    """

    trees: int = 350
    depth: int = 15
    leaf: int = 5
    subset: str = "log2"
    split: int = 2
    weights: str = "balanced_subsample"

    def least_leaf(self) -> int:
        return max(self.leaf, -(-self.split // 2))


def assembled(rows: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """`rows` with the vector `features`; missing numbers become NO_YEAR."""
    filled = {f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(float(NO_YEAR))) for c in features}
    return VectorAssembler(inputCols=list(filled), outputCol="features").transform(rows.withColumns(filled)).drop(*filled)


def weighted(rows: DataFrame) -> DataFrame:
    """`rows` with `weight` = rows / (2 x rows of the class)."""
    n = {r["label"]: r["n"] for r in stats.label_counts(rows).collect()}  # two classes, two rows
    total = sum(n.values())
    weight = F.lit(1.0)
    for k, v in n.items():
        weight = F.when(F.col("label") == k, F.lit(total / (2.0 * v))).otherwise(weight)
    return rows.withColumn("weight", weight)


def fit(rows: DataFrame, params: Params | None = None, features: tuple[str, ...] = MODEL_FEATURES, seed: int = 42) -> RandomForestClassificationModel:
    p = params or Params()
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=p.trees, maxDepth=p.depth, minInstancesPerNode=p.least_leaf(), featureSubsetStrategy=p.subset, seed=seed)
    return forest.fit(weighted(assembled(rows, features)))


def save(model: RandomForestClassificationModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def predict(model: RandomForestClassificationModel, rows: DataFrame, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    """`rows` with `proba` of label 1 and `prediction`."""
    out = model.transform(assembled(rows, features)).withColumn("proba", F.get(vector_to_array("probability"), 1))
    return out.withColumn("prediction", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability")


def evaluate(predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    return stats.class_report(predicted), stats.confusion(predicted)


def f1(predicted: DataFrame) -> float:
    return stats.class_report(predicted).where("class = '1'").first()["f1"]


def search(train: DataFrame, val: DataFrame, trials: int = 30, seed: int = 42, space: dict | None = None, features: tuple[str, ...] = MODEL_FEATURES) -> tuple[Params, float]:
    """The best of `trials` drawn settings by F1 of label 1 on the fixed validation rows."""
    rng, s = random.Random(seed), space or SPACE
    return best_of([Params(**{k: rng.choice(list(s[k])) for k in s}) for _ in range(trials)], train, val, features)


def grid_search(train: DataFrame, val: DataFrame, grid: dict | None = None, features: tuple[str, ...] = MODEL_FEATURES) -> tuple[Params, float]:
    g = grid or GRID
    return best_of([Params(**dict(zip(g, values, strict=True))) for values in itertools.product(*g.values())], train, val, features)


def best_of(choices: list[Params], train: DataFrame, val: DataFrame, features: tuple[str, ...]) -> tuple[Params, float]:
    fits: dict[tuple, float] = {}  # settings that come to the same forest are fitted once
    for p in choices:
        same = (p.trees, p.depth, p.least_leaf(), p.subset)
        if same not in fits:
            fits[same] = f1(predict(fit(train, p, features), val, features))
    scored = [(fits[p.trees, p.depth, p.least_leaf(), p.subset], -i, p) for i, p in enumerate(choices)]
    best = max(scored)
    return best[2], best[0]


def importance(model: RandomForestClassificationModel, features: tuple[str, ...] = MODEL_FEATURES) -> DataFrame:
    from pyspark.sql import SparkSession

    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return SparkSession.active().createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"))


def mean_reciprocal_rank(predicted: DataFrame) -> DataFrame:
    """Over keys with a positive; the truth is the first positive row in the order of `ord`."""
    return ranking.mrr(ranking.reciprocal_ranks(predicted, ranking.first_positive(predicted), "proba"))
