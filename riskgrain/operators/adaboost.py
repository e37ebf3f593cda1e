"""AdaBoost: trees fitted in turn to rows whose weight grows with each mistake."""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..session import materialise


class AdaBoostModel(Model):
    """Weighted vote of the trees; the probability is the logistic curve of the vote."""

    def __init__(self, trees=(), votes=()):
        super().__init__()
        self.trees, self.votes = list(trees), list(votes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows, total = dataset, F.lit(0.0)
        for k, (tree, vote) in enumerate(zip(self.trees, self.votes)):
            said = f"_said{k}"
            rows = tree.copy({tree.predictionCol: said, tree.rawPredictionCol: "", tree.probabilityCol: ""}).transform(rows)
            total = total + F.lit(vote) * (2 * F.col(said) - 1)
        p = 1 / (1 + F.exp(-total))
        return rows.select(
            *dataset.columns, array_to_vector(F.array(-total, total)).alias("rawPrediction"),
            array_to_vector(F.array(1 - p, p)).alias("probability"), (total > 0).cast("double").alias("prediction"))


class AdaBoost(Estimator):
    """Two classes, 0 and 1; stops early when a tree is no better than a guess or makes no mistake."""

    def __init__(self, labelCol: str = "label", featuresCol: str = "features", maxIter: int = 20, maxDepth: int = 1, seed: int = 7):
        super().__init__()
        self.label, self.features, self.rounds, self.depth, self.seed = labelCol, featuresCol, maxIter, maxDepth, seed

    def _fit(self, dataset: DataFrame) -> AdaBoostModel:
        rows = dataset.select(self.label, self.features).withColumn("_weight", F.lit(1.0))
        trees, votes = [], []
        for _ in range(self.rounds):
            tree = DecisionTreeClassifier(
                labelCol=self.label, featuresCol=self.features, weightCol="_weight", maxDepth=self.depth, seed=self.seed,
                predictionCol="_said", rawPredictionCol="", probabilityCol="").fit(rows)
            said = tree.transform(rows)
            wrong = F.col("_said") != F.col(self.label)
            sums = said.agg(F.sum("_weight").alias("all"), F.sum(F.when(wrong, F.col("_weight")).otherwise(0.0)).alias("wrong")).first()
            error = max(sums["wrong"] / sums["all"], 1e-10)
            if error >= 0.5:
                break
            vote = 0.5 * math.log((1 - error) / error)
            trees.append(tree)
            votes.append(vote)
            if sums["wrong"] == 0:
                break
            # weights sum to the same total each round; written, so that the plan stays short
            scale = F.when(wrong, 0.5 / error).otherwise(0.5 / (1 - error))
            rows = materialise(said.select(self.label, self.features, (F.col("_weight") * scale).alias("_weight")), "weights")
        return AdaBoostModel(trees, votes)
