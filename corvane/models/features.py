"""Classifiers on features of series: intervals, kernels, canonical features; ridge and forests on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import batch
from corvane.storage import written

Matrix = Callable[[np.ndarray], np.ndarray]


def random_intervals(length: int, count: int, least: int, seed: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        n = int(rng.integers(min(least, length), length + 1))
        at = int(rng.integers(0, length - n + 1))
        out.append((at, at + n))
    return out


def interval_summaries(length: int, count: int = 64, least: int = 3, seed: int = 0) -> Matrix:
    """Mean, deviation and slope of random intervals."""
    spans = random_intervals(length, count, least, seed)

    def f(x: np.ndarray) -> np.ndarray:
        out = []
        for a, b in spans:
            p, t = x[:, a:b], np.arange(b - a) - (b - a - 1) / 2
            out += [p.mean(1), p.std(1), p @ t / max((t * t).sum(), 1e-12)]
        return np.stack(out, 1)

    return f


def interval_spectra(length: int, count: int = 8, least: int = 16, seed: int = 0) -> Matrix:
    """Autocorrelations and power spectra of random intervals."""
    spans = random_intervals(length, count, least, seed)

    def f(x: np.ndarray) -> np.ndarray:
        return np.concatenate([g(x[:, a:b]) for a, b in spans for g in (lambda p: batch.autocorrelations(p, p.shape[1] // 4), batch.power_spectrum)], 1)

    return f


def interval_canonical(length: int, count: int = 4, least: int = 10, seed: int = 0, views: bool = False) -> Matrix:
    """Canonical features and summaries of random intervals; with views, of the differences and the periodogram too."""

    def f(x: np.ndarray) -> np.ndarray:
        out = []
        for k, y in enumerate([x, np.diff(x, axis=1), batch.power_spectrum(x)] if views else [x]):
            for a, b in random_intervals(y.shape[1], count, least, seed + k):
                out += [batch.catch22(y[:, a:b]), batch.summary(y[:, a:b])[:, [0, 1, 4]]]
        return np.nan_to_num(np.concatenate(out, 1), posinf=0.0, neginf=0.0)

    return f


@dataclass
class Forest:
    """A random forest on features of series: of a Matrix function of the series' length. Labels are 0 to classes - 1."""

    make: Callable[[int], Matrix]
    trees: int = 50
    depth: int = 8
    seed: int = 0
    model: object = None
    features: Matrix | None = None

    def fit(self, train: DataFrame) -> Forest:
        n = train.agg(F.min(F.size("s"))).first()[0]
        features = self.make(n)
        rows = batch.transform(train.select("label", F.slice("s", 1, n).alias("s")), features).select(F.col("label").cast("double").alias("label"), array_to_vector("v").alias("features"))
        rows = written(rows, "forest")  # each level of the trees reads the features again
        model = RandomForestClassifier(numTrees=self.trees, maxDepth=self.depth, seed=self.seed, featureSubsetStrategy="sqrt").fit(rows)
        out = Forest(self.make, self.trees, self.depth, self.seed, model, features)
        out.length = n
        return out

    def predict(self, test: DataFrame) -> DataFrame:
        rows = batch.transform(test.select("id", F.slice("s", 1, self.length).alias("s")), self.features).select("id", array_to_vector("v").alias("features"))
        return self.model.transform(rows).select("id", F.col("prediction").cast("long").alias("predicted"))


def time_series_forest(intervals: int = 64, **options) -> Forest:
    return Forest(lambda n: interval_summaries(n, intervals), **options)


def spectral_forest(intervals: int = 8, **options) -> Forest:
    return Forest(lambda n: interval_spectra(n, intervals), **options)


def canonical_forest(intervals: int = 4, views: bool = False, **options) -> Forest:
    return Forest(lambda n: interval_canonical(n, intervals, views=views), **options)


def catch22_forest(**options) -> Forest:
    return Forest(lambda n: lambda x: np.nan_to_num(batch.catch22(x), posinf=0.0, neginf=0.0), **options)


def gram(df: DataFrame, features: Matrix, classes: int) -> tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray]:
    """Sums over rows (label, s) of features and their products, with the +-1 targets of each class: partial sums by partition."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = features(np.array(b.column(1).to_pylist(), float))
                y = 2.0 * (np.array(b.column(0).to_pylist())[:, None] == np.arange(classes)) - 1
                z = np.concatenate((x, y, np.ones((len(x), 1))), 1)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary()), pa.array([len(total)], pa.int32())], ["sums", "n"])

    total = None
    for r in df.select("label", "s").mapInArrow(each, "sums binary, n int").toLocalIterator():
        part = np.frombuffer(r["sums"], "<f8").reshape(r["n"], r["n"])
        total = part if total is None else total + part
    d = len(total) - classes - 1
    return total[:d, :d], total[:d, d:-1], total[-1, -1], total[:d, -1], total[d:-1, -1]


@dataclass
class Ridge:
    """Ridge regression on +-1 targets of each class, features standardised; the penalty of the least generalised cross-validation error.

    The fit needs the sums of products alone: features squared numbers from each partition.
    """

    features: Matrix
    penalties: tuple[float, ...] = tuple(10.0 ** np.linspace(-3, 3, 10))
    weights: np.ndarray | None = None

    def fit(self, train: DataFrame, classes: int) -> Ridge:
        xx, xy, n, sx, sy = gram(train, self.features, classes)
        mean = sx / n
        c = xx / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(c), 0))
        scale = np.where(sd > 1e-9, sd, np.inf)
        c = c / np.outer(scale, scale)
        r = (xy / n - np.outer(mean, sy / n)) / scale[:, None]
        values, vectors = np.linalg.eigh(c)
        values, z = np.maximum(values, 0), vectors.T @ r
        best = None
        for p in self.penalties:
            shrink = 1 / (values + p / n)
            error = 1 - (sy / n) ** 2 - (z**2 * (2 * shrink - values * shrink**2)[:, None]).sum(0)
            score = error.sum() / max(1e-9, 1 - (values * shrink).sum() / n) ** 2
            if best is None or score < best[0]:
                best = score, vectors @ (shrink[:, None] * z)
        w = best[1] / scale[:, None]
        return Ridge(self.features, self.penalties, np.concatenate((w, (sy / n - mean @ w)[None, :])))

    def predict(self, test: DataFrame) -> DataFrame:
        features, w = self.features, self.weights

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = features(np.array(b.column(1).to_pylist(), float)) if b.num_rows else np.zeros((0, len(w) - 1))
                score = x @ w[:-1] + w[-1]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score.argmax(1).astype(np.int64)), pa.array(score.tolist(), pa.list_(pa.float64()))], ["id", "predicted", "scores"])

        return test.select(F.col("id").cast("long").alias("id"), "s").mapInArrow(each, "id long, predicted long, scores array<double>")


def rocket_classifier(train: DataFrame, classes: int, kernels: int = 500, seed: int = 0) -> Ridge:
    n = train.agg(F.min(F.size("s"))).first()[0]
    return Ridge(batch.Rocket(kernels, n, seed)).fit(train, classes)


def arsenal(train: DataFrame, test: DataFrame, classes: int, members: int = 5, kernels: int = 200) -> DataFrame:
    """(id, predicted): the class that most of several kernel classifiers tell, ties to the smaller."""
    votes = None
    for k in range(members):
        told = rocket_classifier(train, classes, kernels, k).predict(test).select("id", "predicted")
        votes = told if votes is None else votes.union(told)
    n = votes.groupBy("id", "predicted").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.max_by("predicted", F.struct("n", -F.col("predicted"))).alias("predicted"))
