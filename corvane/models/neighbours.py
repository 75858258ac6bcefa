"""Nearest-neighbour classifiers over any distance between series."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import elastic
from corvane.operators.distances import nearest


@dataclass
class KNN:
    """The majority of the k nearest training rows, ties to the smaller label; at equal distances the smaller id is nearer."""

    k: int = 1
    distance: Callable[..., np.ndarray] | None = None
    options: dict = field(default_factory=dict)
    train: DataFrame | None = None

    def fit(self, train: DataFrame) -> KNN:
        return KNN(self.k, self.distance, self.options, train.select("id", "label", "s"))

    def neighbours(self, test: DataFrame) -> DataFrame:
        """(q, label, distance, rank)."""
        measure = partial(self.distance, **self.options) if self.distance else None
        hits = nearest(test.select("id", "s"), self.train, self.k, distance=measure)
        return hits.join(self.train.select(F.col("id").alias("c"), "label"), "c").select("q", "c", "label", "distance", "rank")

    def predict(self, test: DataFrame) -> DataFrame:
        """(id, predicted, votes)."""
        votes = self.neighbours(test).groupBy("q", "label").agg(F.count("*").alias("votes"))
        first = Window.partitionBy("q").orderBy(F.col("votes").desc(), "label")
        return votes.withColumn("at", F.row_number().over(first)).where("at = 1").select(F.col("q").alias("id"), F.col("label").alias("predicted"), "votes")

    def leave_one_out(self) -> float:
        """Accuracy on the training rows, each without itself (rows are told apart by id)."""
        told = self.predict(self.train).join(self.train.select("id", "label"), "id")
        return told.agg(F.avg((F.col("label") == F.col("predicted")).cast("double"))).first()[0] or 0.0


def one_nn(name: str, **options) -> KNN:
    """1-NN by the name of a distance."""
    return KNN(1, None if name == "ed" else elastic.DISTANCES[name], options)


def best_of(train: DataFrame, candidates: list[KNN]) -> tuple[KNN, float]:
    """The candidate of the best leave-one-out accuracy, the first of equals, fitted."""
    scored = [(m, m.leave_one_out()) for m in (c.fit(train) for c in candidates)]
    return max(scored, key=lambda x: x[1])


def dtw_cv(train: DataFrame, windows: int = 11) -> tuple[KNN, float]:
    """1-NN with the warping window, of so many from 0 to 1, that leaves out best."""
    return best_of(train, [KNN(1, elastic.dtw, {"window": w / max(1, windows - 1)}) for w in range(windows)])


def best_k(train: DataFrame, most: int, distance: Callable | None = None) -> tuple[int, float]:
    """The smallest k up to most of the best leave-one-out accuracy, from one search for most neighbours."""
    model = KNN(most, distance).fit(train)
    hits = model.neighbours(model.train).join(model.train.select(F.col("id").alias("q"), F.col("label").alias("truth")), "q")
    each = hits.withColumn("k", F.explode(F.sequence(F.col("rank").cast("int"), F.lit(most))))
    votes = each.groupBy("k", "q", "truth", "label").agg(F.count("*").alias("n"))
    first = Window.partitionBy("k", "q").orderBy(F.col("n").desc(), "label")
    told = votes.withColumn("at", F.row_number().over(first)).where("at = 1")
    scores = told.groupBy("k").agg(F.avg((F.col("truth") == F.col("label")).cast("double")).alias("acc")).orderBy(F.desc("acc"), "k").first()
    return scores["k"], scores["acc"]


def combined(weight: float, first: Callable, second: Callable) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A convex combination of two distances, as between a series' values and its derivative's."""
    return lambda a, b: weight * first(a, b) + (1 - weight) * second(a, b)


def derivative_combination(train: DataFrame, steps: int = 5) -> tuple[KNN, float]:
    """1-NN on a mix of warping distances of values and derivatives, the mix by leave-one-out."""
    return best_of(train, [KNN(1, combined(k / (steps - 1), elastic.dtw, elastic.derivative_dtw)) for k in range(steps)])


def transform_combination(train: DataFrame, transform: Callable[[np.ndarray], np.ndarray], steps: int = 5) -> tuple[KNN, float]:
    """As derivative_combination, with a transform (cosine, sine, hilbert of ``batch``) in place of the derivative."""
    return best_of(train, [KNN(1, combined(k / (steps - 1), elastic.dtw, lambda a, b: elastic.dtw(transform(a), transform(b)))) for k in range(steps)])


def shape_distance(describe: Callable[[np.ndarray], np.ndarray], size: int = 30) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Warping distance between series of local descriptors: of the window around each point."""
    from corvane.operators import batch

    def described(x: np.ndarray) -> np.ndarray:
        w = batch.subsequences(x, size).reshape(len(x) * x.shape[1], size)
        return describe(w).reshape(len(x), x.shape[1], -1).transpose(0, 2, 1)

    def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return elastic.dtw(described(a), described(b))

    distance.parts = described, elastic.dtw
    return distance


def elastic_ensemble(train: DataFrame, test: DataFrame, names: tuple[str, ...] = ("ed", "dtw", "ddtw", "wdtw", "wddtw", "erp", "lcss", "msm", "twed")) -> DataFrame:
    """(id, predicted, weight): 1-NN members vote with their leave-one-out accuracies; ties to the smaller label."""
    votes = None
    for n in names:
        model = one_nn(n).fit(train)
        told = model.predict(test).select("id", "predicted", F.lit(model.leave_one_out()).alias("w"))
        votes = told if votes is None else votes.union(told)
    sums = votes.groupBy("id", "predicted").agg(F.round(F.sum("w"), 9).alias("weight"))
    first = Window.partitionBy("id").orderBy(F.col("weight").desc(), "predicted")
    return sums.withColumn("at", F.row_number().over(first)).where("at = 1").drop("at")
