"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target number of words. Dividing it by the source's words gives
a rate between 0 and 2: every document is taken floor(rate) times, and once more
with the fractional rate as inclusion probability. The extra copies are drawn by
the cube method (Deville and Tille 2004): the vector of probabilities walks
through the null space of the balancing constraints (documents, words), by random
steps that keep its expectation, until nearly all of it is 0 or 1.

The walk is sequential, so a source is cut into strata of at most ``STRATUM``
documents by a hash of their rows and, for rows alike, their number among them. What each stratum leaves open (two documents
at most) is walked again, in strata likewise, until a source has one stratum
left. Both sums are kept on the way. The last stratum stops at ``LANDING`` open
documents, and of their subsets takes the one nearest in words, then in
documents; for these few alone the inclusion probability is not kept exactly.

Defined cases: a null or empty text has no words and its document is taken like
any other, adding nothing; null sources are one source, last in order; a source
without words has target 0; repeated rows and equal ids are documents of their
own; an empty table gives an empty result. Reruns agree: random numbers come
from the seed, the source and the stratum. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import WORD, documents, written

WEIGHTS = (3, 1, 2)
STRATUM = 2_000
LANDING = 12
#: Alike rows that one task deals out at a time.
COPIES = 10_000
DRAWN = "doc_id long, source string, size long, source_size long, target double, base long, tag long, strata long, p double"


def words(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, documents, source_size, target): share of all words dealt by weight, with at most ``most`` times each source's own.

    In the order of bound by weight, the sources before the first whose share of
    what is left lies under its bound get their bounds; that one and the others
    share the rest. The windows run over one row for each source, not over documents.
    """
    t = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("size").alias("source_size"))
    name = F.col("source").asc_nulls_last()
    nth = (F.row_number().over(Window.orderBy(name)) - 1) % len(weights) + 1
    t = t.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), nth.cast("int")))
    t = t.withColumn("bound", most * F.col("source_size"))
    order = Window.orderBy(F.col("bound") / F.col("weight"), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    left = share * F.sum("source_size").over(every) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    t = t.withColumn("nth", F.row_number().over(order)).withColumn("level", left / weights_left)
    fits = F.col("level") * F.col("weight") < F.col("bound")
    level = F.min(F.when(fits, F.struct("nth", "level"))).over(every)["level"]
    return t.select("source", "documents", "source_size", F.coalesce(F.least("bound", F.col("weight") * level), "bound").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Walk probabilities until at most two are fractional; their sum and that of p * size stay."""
    p, open_ = p.copy(), []
    draws = iter(rng.random(len(p) + 1).tolist())
    sizes, values = size.tolist(), p.tolist()
    for k in range(len(values)):
        if not 0.0 < values[k] < 1.0:
            continue
        open_.append(k)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
        if not any(u):
            u = (1, -1, 0)
        _step(values, open_, u, next(draws))
        open_ = [i for i in open_ if 0.0 < values[i] < 1.0]
    return np.array(values)


def _step(values: list, at: list, u: tuple, draw: float, eps: float = 1e-9) -> None:
    """Move values[at] along u or against it to the border of the unit cube, with expectation kept."""
    up = min((1 - values[i]) / x if x > 0 else -values[i] / x for i, x in zip(at, u, strict=True) if x)
    down = min(values[i] / x if x > 0 else (values[i] - 1) / x for i, x in zip(at, u, strict=True) if x)
    by = up if draw * (up + down) < down else -down
    for i, x in zip(at, u, strict=True):
        moved = values[i] + by * x
        values[i] = 0.0 if moved < eps else 1.0 if moved > 1 - eps else moved


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the few open probabilities: of all their subsets, the one nearest to what they stand for, in words first and documents second."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        subsets = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
        off = subsets - p[open_]
        sizes = size[open_]
        cost = np.abs(off @ sizes) / max(1.0, sizes.mean()) + 0.1 * np.abs(off.sum(1))
        p[open_] = subsets[int(np.argmin(cost))]
    return p


def sized(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, *keep: str) -> DataFrame:
    """Written rows of DRAWN at the start of the walk, with the columns keep: one scan of the texts.

    Rows that are alike are counted, and dealt out again with a number each, a
    block of rows at a time; so every row has a tag of its own that follows from
    the table alone, and copies of one document spread over all strata.
    """
    columns = ["doc_id", "source", "size", "like", *keep]
    alike = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", *keep).alias("like"), *keep)
    counted = alike.groupBy(*columns).agg(F.count("*").alias("times"))
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / COPIES)))).repartition("like", "block")
    inside = F.least(F.col("times") - F.col("block") * COPIES, F.lit(COPIES).cast("long"))
    each = blocks.withColumn("inside", F.explode(F.sequence(F.lit(1).cast("long"), inside))).withColumn("nth", F.col("inside") + F.col("block") * COPIES)
    rows = written(each.select("doc_id", "source", "size", F.xxhash64("like", "nth").alias("tag"), *keep), "mixing-sizes")
    t = targets(rows, weights, share).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = F.floor(rate)
    return rows.join(t, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "source", "size", "source_size", "target", base.alias("base"), "tag", F.ceil(F.col("documents") / STRATUM).alias("strata"), (rate - base).alias("p"), *keep
    )


def _walker(seed: int, level: int, last: bool, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    def walk(part: pa.Table) -> pa.Table:
        part = part.sort_by([("tag", "ascending"), ("size", "ascending")]).select(names)
        first, source = part["tag"][0].as_py(), part["source"][0].as_py()
        rng = np.random.default_rng([seed, level, source is None, *(source or "").encode(), first % 2**64])
        size = part["size"].to_numpy()
        p = part["p"].to_numpy().copy()
        walked = np.flatnonzero((p > 0) & (p < 1))
        if last:
            walked = walked[LANDING - 2 :]
        p[walked] = flight(p[walked], size[walked], rng)
        p = landing(p, size) if last else p
        return part.set_column(names.index("p"), "p", pa.array(p, pa.float64()))

    return walk


def draw(rows: DataFrame, seed: int = 42, stratum: int = STRATUM) -> DataFrame:
    """The rows of ``sized`` with p settled to 0 or 1, level by level; each level is written."""
    level, settled, kept = 0, [], [f for f in rows.columns if f not in DRAWN.replace(",", "").split()[::2]]
    schema = DRAWN + "".join(f", `{k}` {rows.schema[k].dataType.simpleString()}" for k in kept)
    while True:
        most = rows.agg(F.max("strata")).first()[0]
        last = most is None or most <= 1

        dealt = rows.withColumn("stratum", F.pmod(F.xxhash64(F.lit(level), "tag"), F.col("strata")))
        walked = written(dealt.groupBy("source", "stratum").applyInArrow(_walker(seed, level, last, rows.columns), schema), "mixing-walk")
        settled.append(walked.where("p in (0, 1)"))
        if last:
            return reduce(DataFrame.union, settled)
        rows = walked.where("p not in (0, 1)").withColumn("strata", F.ceil(2 * F.col("strata") / stratum))
        level += 1


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, seed: int = 42, keep: tuple = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each document, with the columns keep."""
    drawn = draw(sized(docs, weights, share, *keep), seed)
    copies = (F.col("base") + F.col("p")).cast("long")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)


def op1_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
