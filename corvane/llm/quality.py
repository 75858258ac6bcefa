"""Quality classifier by importance resampling over hashed n-grams.

Two generative models over hashed n-grams are counted: target text (documents
labelled good) and raw text (all documents). The log ratio of a text under them
is its importance weight (Xie et al. 2023). Its n-grams are words and pairs of
words, and likewise their shapes (runs of small letters, capitals and digits
collapsed); a pair of the same word twice is one n-gram whatever the word.

Gumbel top-k: every document's log weight gets Gumbel noise from a hash of its
row, and the k documents of the highest sums stay, which samples k in proportion
to the weights, without replacement. k is the number of good documents that a
logistic fit on the labelled sample expects in all (its variable is the log
weight, divided by the square root of the number of n-grams); the fit has no
other part in what stays.

Labels: the target model and the logistic fit use at most ``SAMPLE`` labelled
documents, those of least id hash. All other counts are over all documents.

Defined cases: a null or empty text has no n-grams and weight 0; labels null,
missing, or all of one kind leave every document kept; a document labelled twice
has its least quality; documents that tie at the k-th place stay together, as
repeated rows do; an empty table gives an empty result; all columns of the
documents pass through, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import discard, documents, release, written

BITS = 14
SAMPLE = 20_000
WORDS = 200_000
PASS = 256

_UPPER, _LOWER, _DIGIT, _SAME = re.compile(rb"[A-Z]+"), re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[0-9]+"), re.compile(rb"(.)\1+", re.S)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shape(word: bytes) -> bytes:
    return _SAME.sub(rb"\1\1", _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word))))


class Grams:
    """Hashed n-grams of texts; keeps the hashes of WORDS words and those of one more text."""

    def __init__(self, bits: int = BITS):
        self.known, self.codes, self.shift = {}, np.zeros((0, 2), np.uint64), np.uint64(64 - bits)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().split()
        if len(self.known) > WORDS:
            self.known, self.codes = {}, np.zeros((0, 2), np.uint64)
        known = self.known
        if new := list(set(words).difference(known)):
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            if len(known) > len(self.codes):
                self.codes = np.concatenate((self.codes[:first], np.zeros((len(known) + 4096, 2), np.uint64)))
            self.codes[first : len(known)] = [(zlib.crc32(w), zlib.crc32(shape(w), 7)) for w in new]
        both = self.codes[np.fromiter(map(known.__getitem__, words), np.int64, len(words))]
        word, form = both[:, 0], both[:, 1]
        pairs = word[:-1] * _A + word[1:] * _B + np.uint64(1)
        pairs[word[:-1] == word[1:]] = 3
        forms = form[:-1] * _A + form[1:] * _B + np.uint64(2)
        return (np.concatenate((word * _A, form * _A, pairs * _A, forms * _A)) >> self.shift).astype(np.int64)


def labelled(labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(doc_id, quality) of at most bound labelled documents, a row each."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def models(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> np.ndarray:
    """Log ratio of target to raw for each of the 2**bits n-grams; counts grow with the corpus, the table does not."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        grams, raw, target = Grams(bits), np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            for k in range(0, b.num_rows, PASS):
                part = b.slice(k, PASS)
                found = [grams(body) for body in part.column(0).to_pylist()]
                raw += np.bincount(np.concatenate(found), minlength=size)
                if good := [x for x, g in zip(found, part.column(1).to_pylist(), strict=True) if g]:
                    target += np.bincount(np.concatenate(good), minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], ["gram", "raw", "target"])

    good = sample.where("quality > 0").select(F.col("doc_id").alias("__good"))
    marked = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(good), F.col("__key") == F.col("__good"), "left")
    counts = marked.select("__text", F.col("__good").isNotNull().alias("good")).mapInArrow(count, "gram long, raw long, target long")
    found = np.ones((2, size))
    for g, raw, target in counts.groupBy("gram").agg(F.sum("raw"), F.sum("target")).collect():  # 2**bits rows at most
        found[:, g] += raw, target
    logs = np.log(found / found.sum(1, keepdims=True))
    return (logs[1] - logs[0]).astype(np.float32)


def weights(ratio: np.ndarray, bits: int = BITS) -> Callable[[list[str | None]], np.ndarray]:
    """From texts to rows (n-grams, log weight)."""
    grams = Grams(bits)

    def each(texts: list[str | None]) -> np.ndarray:
        found = [grams(t) for t in texts]
        return np.array([(len(g), ratio[g].sum(dtype=np.float64)) for g in found]).reshape(-1, 2)

    return each


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on one variable, by Newton's method; the classes weigh as they occur."""
    scale = float(np.median(np.abs(x))) or 1.0
    design = np.stack((np.clip(x / scale, -10, 10), np.ones(len(x))), 1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - penalty * beta * (1, 0)
        bend = (design * (p * (1 - p))[:, None]).T @ design + np.diag((penalty, 1e-6))
        step = np.linalg.solve(bend, slope)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The exact k-th largest value of a double column (1 at least), by narrowing histograms: bins + 1 rows reach the driver at a time."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while lo is not None and lo < hi:
        width = (hi - lo) / bins
        inside = df.where(F.col(column).between(lo, hi))
        found = inside.groupBy(F.least(F.floor((F.col(column) - lo) / F.lit(width)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for row in sorted(found, key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        lo, hi = row["lo"], row["hi"]
    return lo


def scores(docs: DataFrame, ratio: np.ndarray, seed: int, key: str, text: str, whole: bool) -> DataFrame:
    """(id, grams, weight, x, noise) of each document, all from the row itself; with row, a struct of its columns, if whole."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key, text), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    given = docs.select(F.col(text).alias("text"), F.col(key).alias("id"), (-F.log(-F.log(u))).alias("noise"), *[F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * whole)
    found = ("grams", T.LongType()), ("weight", T.DoubleType()), ("x", T.DoubleType())
    fields = [*given.schema.fields[1:], *(T.StructField(n, t) for n, t in found)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        weigh = weights(ratio)
        for b in batches:
            for k in range(0, b.num_rows, PASS):
                part = b.slice(k, PASS)
                n, w = weigh(part.column(0).to_pylist()).T
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(n.astype(np.int64)), pa.array(w), pa.array(w / np.sqrt(n + 1))], [f.name for f in fields])

    return given.mapInArrow(each, T.StructType(fields))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 42, bound: int = SAMPLE, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """The written scores of all documents with odds (log odds of a good document), perturbed (log weight with its noise) and kept."""
    sample = written(labelled(labels, bound), "quality-sample")
    scored = written(scores(docs, models(docs, sample, key, text), seed, key, text, whole), "quality-scores")
    pairs = scored.join(F.broadcast(sample), F.col("id") == F.col("doc_id")).groupBy("id").agg(F.min("x"), F.min("quality")).collect()  # bound rows at most
    discard(sample)
    x, y = np.array([p[1] for p in pairs]), np.array([p[2] > 0 for p in pairs], float)
    slope, intercept = fit(x, y) if 0 < y.sum() < len(y) else (0.0, 30.0)
    told = scored.withColumn("odds", F.col("x") * slope + intercept).withColumn("perturbed", F.col("weight") + F.col("noise"))
    k = int(round(told.agg(F.sum(1 / (1 + F.exp(-F.col("odds"))))).first()[0] or 0.0))
    least = kth_largest(told, "perturbed", k) if k else np.inf
    return told.withColumn("kept", F.col("perturbed") >= F.lit(float(-np.inf if least is None else least)))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with their columns."""
    return resample(docs, labels, whole=True, **options).where("kept").select("row.*")


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, grams, log_weight, log_odds, kept) of all documents."""
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select(F.col("id").alias("doc_id"), "grams", F.col("weight").alias("log_weight"), F.col("odds").alias("log_odds"), "kept")
