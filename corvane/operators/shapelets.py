"""Shapelets: subsequences that tell classes apart by how near they come to a series."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.batch import windows
from corvane.storage import written


def distances_to(shapelets: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(series, shapelets): the least mean squared difference of a z-normalised shapelet from a z-normalised window, the last window included."""
    size = shapelets.shape[1]
    w = windows(x, size)
    s = shapelets - shapelets.mean(1, keepdims=True)
    sd = s.std(1, keepdims=True)
    s = np.divide(s, sd, out=np.zeros_like(s), where=sd > 1e-12)
    d = (w * w).sum(2)[:, :, None] + (s * s).sum(1)[None, None, :] - 2 * (w @ s.T)
    return np.maximum(d.min(1), 0) / size


def candidates(df: DataFrame, sizes: list[int], step: int = 1) -> DataFrame:
    """(id, label, start, size, shapelet): every subsequence of the sizes, step places apart."""
    each = df.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.size("s") >= F.col("size"))
    each = each.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("s") - F.col("size"), F.lit(step))))
    return each.select("id", "label", "start", "size", F.slice("s", F.col("start") + 1, F.col("size")).alias("shapelet"))


def profile(df: DataFrame, shapelets: DataFrame, most: int = 1 << 22) -> DataFrame:
    """(id, label, c_id, start, size, distance) of every series to every shapelet, by blocks of series of one length and blocks of shapelets of one size."""

    def packed(x: DataFrame, rows: int) -> DataFrame:
        """(data): pickled blocks of rows (names, vector), the names as an array, the vectors of one length as a matrix."""

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                by: dict[int, list] = {}
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    by.setdefault(len(r[-1]), []).append(r)
                out = [pickle.dumps((list(zip(*(r[:-1] for r in part), strict=True)), np.array([r[-1] for r in part], float))) for group in by.values() for k in range(0, len(group), rows) for part in [group[k : k + rows]]]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["data"])

        return x.mapInArrow(each, "data binary")

    groups = written(packed(shapelets.select(F.col("id").alias("c_id"), "start", "shapelet"), 1024), "shapelets")
    keys = max(1, min(groups.count(), 8 * df.sparkSession.sparkContext.defaultParallelism))
    c = groups.select(F.pmod(F.xxhash64("data"), F.lit(keys)).alias("key"), F.col("data").alias("group")).repartition(2 * keys, "key")
    q = packed(df.select("id", F.col("label").cast("long").alias("label"), "s"), 64).withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long")))).repartition(2 * keys, "key")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                ((ids, labels), x), ((c_ids, starts), found) = pickle.loads(one), pickle.loads(two)
                n, size = len(c_ids), found.shape[1]
                step = max(1, most // max(1, n * (x.shape[1] - size + 1)))
                for k in range(0, len(x) if x.shape[1] >= size else 0, step):
                    d = distances_to(found, x[k : k + step])
                    own = np.repeat(np.arange(k, k + len(d)), n)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(own)), pa.array(labels, pa.int64()).take(pa.array(own)), pa.array(np.tile(np.array(c_ids, np.int64), len(d))), pa.array(np.tile(np.array(starts, np.int32), len(d))), pa.array(np.full(d.size, size, np.int32)), pa.array(d.ravel())], ["id", "label", "c_id", "start", "size", "distance"])

    return q.join(c.hint("shuffle_hash"), "key").select("data", "group").mapInArrow(each, "id long, label long, c_id long, start int, size int, distance double")


SHAPELET = ["c_id", "start", "size"]


def information_gain(profiles: DataFrame, decimals: int = 9) -> DataFrame:
    """(c_id, start, size, value): the best gain, in bits, of a threshold on a shapelet's distances; thresholds lie between different distances."""
    counts = profiles.groupBy(*SHAPELET, F.round("distance", decimals).alias("d"), "label").agg(F.count("*").cast("double").alias("n"))
    classes = counts.select(*SHAPELET, "label").distinct()
    places = counts.select(*SHAPELET, "d").distinct().join(classes, SHAPELET).join(counts, [*SHAPELET, "d", "label"], "left").fillna(0.0, ["n"])
    upto = Window.partitionBy(*SHAPELET, "label").orderBy("d")
    every = Window.partitionBy(*SHAPELET, "label")
    t = places.withColumn("left", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(every))
    xlogx = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    sums = t.groupBy(*SHAPELET, "d").agg(F.sum("left").alias("nl"), F.sum("all").alias("n"), F.sum(xlogx(F.col("left"))).alias("l"), F.sum(xlogx(F.col("all") - F.col("left"))).alias("r"), F.sum(xlogx(F.col("all"))).alias("a"))
    nl, n = F.col("nl"), F.col("n")
    gain = ((xlogx(n) - F.col("a")) - (xlogx(nl) - F.col("l")) - (xlogx(n - nl) - F.col("r"))) / n
    return sums.groupBy(*SHAPELET).agg(F.max(gain).alias("value"))


def f_statistic(profiles: DataFrame) -> DataFrame:
    """(c_id, start, size, value): one-way analysis of variance of a shapelet's distances by class."""
    x = F.col("distance")
    parts = profiles.groupBy(*SHAPELET, "label").agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = parts.groupBy(*SHAPELET).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("w"))
    return t.select(*SHAPELET, F.try_divide(F.try_divide(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k"))).alias("value"))


def kruskal_wallis(profiles: DataFrame) -> DataFrame:
    """(c_id, start, size, value): the rank statistic of a shapelet's distances by class, without a correction for ties."""
    from corvane.operators.comparison import tied_rank

    t = profiles.withColumn("rank", tied_rank(SHAPELET, F.round("distance", 9)))
    sums = t.groupBy(*SHAPELET, "label").agg(F.count("*").cast("double").alias("k"), F.sum("rank").alias("r"))
    s = sums.groupBy(*SHAPELET).agg(F.sum("k").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("k")).alias("s"))
    return s.select(*SHAPELET, (12 / (F.col("n") * (F.col("n") + 1)) * F.col("s") - 3 * (F.col("n") + 1)).alias("value"))


def moods_median(profiles: DataFrame) -> DataFrame:
    """(c_id, start, size, value): chi-squared of the classes' distances above, and not above, their median."""
    middle = profiles.groupBy(*SHAPELET).agg(F.median("distance").alias("m"), F.count("*").cast("double").alias("n"))
    t = profiles.join(middle, SHAPELET).groupBy(*SHAPELET, "label", "n").agg(F.count("*").cast("double").alias("own"), F.sum((F.col("distance") > F.col("m")).cast("double")).alias("above"))
    whole = t.groupBy(*SHAPELET).agg(F.sum("above").alias("a"))
    t = t.join(whole, SHAPELET)
    cell = lambda got, side: F.coalesce(F.try_divide((got - F.col("own") * side / F.col("n")) * (got - F.col("own") * side / F.col("n")), F.col("own") * side / F.col("n")), F.lit(0.0))
    return t.groupBy(*SHAPELET).agg(F.sum(cell(F.col("above"), F.col("a")) + cell(F.col("own") - F.col("above"), F.col("n") - F.col("a"))).alias("value"))


def without_overlaps(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each series of which no better one overlaps: greedy within a series' own candidates."""
    rows = scored.groupBy("c_id").agg(F.sort_array(F.collect_list(F.struct((-F.round("value", 9)).alias("minus"), "start", "size", "value"))).alias("all"))
    zero = F.array().cast("array<struct<minus:double,start:int,size:int,value:double>>")
    apart = lambda x, y: (x["start"] >= y["start"] + y["size"]) | (y["start"] >= x["start"] + x["size"])
    kept = F.aggregate("all", zero, lambda acc, x: F.when((F.size(acc) < k) & F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))
    return rows.select("c_id", F.explode(kept).alias("x")).select("c_id", "x.start", "x.size", "x.value")


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k best over all series, ties by series, place and size."""
    return without_overlaps(scored, k).orderBy(F.round("value", 9).desc(), *SHAPELET).limit(k)


def best_balanced(scored: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """k over the number of classes from the series of each class; labels: (c_id, label)."""
    rows = without_overlaps(scored, k).join(labels, "c_id")
    classes = labels.agg(F.count_distinct("label").alias("classes"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.round("value", 9).desc(), *SHAPELET))
    return rows.withColumn("place", place).join(F.broadcast(classes)).where(F.col("place") <= F.floor(F.lit(k) / F.col("classes"))).select(*SHAPELET, "value", "label")


class ShapeletTransform:
    """The distances to the k shapelets of best quality, found among the training series."""

    def __init__(self, k: int, sizes: list[int], step: int = 1, quality=information_gain, balanced: bool = False):
        self.k, self.sizes, self.step, self.quality, self.balanced = k, sizes, step, quality, balanced

    def fit(self, train: DataFrame) -> ShapeletTransform:
        found = candidates(train, self.sizes, self.step)
        scored = self.quality(profile(train, found))
        kept = best_balanced(scored, train.select(F.col("id").alias("c_id"), "label"), self.k) if self.balanced else best(scored, self.k)
        self.shapelets = kept.select(*SHAPELET, "value").join(found.select(F.col("id").alias("c_id"), "start", "size", "shapelet"), SHAPELET)
        self.chosen = sorted(((r["value"], r["c_id"], r["start"], r["size"], r["shapelet"]) for r in self.shapelets.collect()), key=lambda r: (-round(r[0], 9), *r[1:4]))  # k rows
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """df with v: a distance to each shapelet, best first."""
        from corvane.operators.batch import transform

        chosen = [np.array([r[4]], float) for r in self.chosen]
        return transform(df, lambda x: np.concatenate([distances_to(s, x) for s in chosen], 1), "s", "v")
