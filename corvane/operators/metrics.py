"""Measures of predictions: classification, clustering, regression, splits.

Predictions are rows (rid, y_true, y_pred, dist): dist holds a probability for each
class 0 to k - 1. Every measure is an aggregation over counts; what reaches the
driver is a table of classes by classes at most.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import positions

#: What a true class of probability 0 costs in bits, and what stands for no true positives. Fixed values.
NO_CHANCE, NO_HIT, TINY = 6.64, 1e-7, 2.22e-16


def value(df: DataFrame, *names: str) -> dict:
    row = df.first()
    return {n: row[n] for n in names or df.columns}


def accuracy(p: DataFrame) -> DataFrame:
    return p.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("value"))


def confusion(p: DataFrame) -> DataFrame:
    return p.groupBy("y_true", "y_pred").agg(F.count("*").alias("n"))


def by_class(p: DataFrame) -> DataFrame:
    """For each class: true and false positives and negatives, precision, recall, specificity, F1 (of NO_HIT where there are no true positives)."""
    counts = confusion(p)
    both = counts.select(F.explode(F.array(F.struct(F.col("y_true").alias("class"), F.col("n").alias("own"), F.lit(0).cast("long").alias("told")), F.struct(F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("own"), F.col("n").alias("told")))).alias("x"), "y_true", "y_pred", "n", F.lit(1).alias("one"))
    side = both.groupBy("x.class").agg(F.sum("x.own").alias("own"), F.sum("x.told").alias("told"))
    hits = counts.where("y_true = y_pred").select(F.col("y_true").alias("class"), F.col("n").alias("tp"))
    whole = counts.agg(F.sum("n").alias("whole"))  # one row
    t = side.join(hits, "class", "left").join(F.broadcast(whole)).withColumn("tp", F.coalesce("tp", F.lit(0)))
    t = t.select("class", "tp", (F.col("told") - F.col("tp")).alias("fp"), (F.col("own") - F.col("tp")).alias("fn"), (F.col("whole") - F.col("own") - F.col("told") + F.col("tp")).alias("tn"))
    hit = F.when(F.col("tp") == 0, F.lit(NO_HIT)).otherwise(F.col("tp").cast("double"))
    t = t.withColumn("precision", hit / (hit + F.col("fp"))).withColumn("recall", hit / (hit + F.col("fn"))).withColumn("specificity", F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")))
    return t.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))


def balanced_accuracy(p: DataFrame) -> DataFrame:
    """Mean over classes of the share of their rows that are told right."""
    return p.groupBy("y_true").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("r")).agg(F.avg("r").alias("value"))


def f1(p: DataFrame) -> DataFrame:
    """Mean over the classes; of two classes, that of the rarer (ties: the second)."""
    sizes = by_class(p).withColumn("size", F.col("tp") + F.col("fn"))
    return sizes.agg(F.when(F.count("*") == 2, F.min_by("f1", F.struct("size", -F.col("class")))).otherwise(F.avg("f1")).alias("value"))


def matthews(p: DataFrame) -> DataFrame:
    """The correlation of truth and prediction over k classes; 0 where its numerator is."""
    counts = confusion(p)
    own = counts.groupBy(F.col("y_true").alias("c")).agg(F.sum("n").alias("own"))
    told = counts.groupBy(F.col("y_pred").alias("c")).agg(F.sum("n").alias("told"))
    sums = own.join(told, "c", "full").select(F.coalesce("own", F.lit(0)).cast("double").alias("own"), F.coalesce("told", F.lit(0)).cast("double").alias("told"))
    sums = sums.agg(F.sum(F.col("own") * F.col("told")).alias("ot"), F.sum(F.col("own") * F.col("own")).alias("oo"), F.sum(F.col("told") * F.col("told")).alias("tt"))
    whole = counts.agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    top = F.col("c") * F.col("s") - F.col("ot")
    return sums.join(F.broadcast(whole)).select(F.when(top == 0, F.lit(0.0)).otherwise(F.try_divide(top, F.sqrt((F.col("s") * F.col("s") - F.col("tt")) * (F.col("s") * F.col("s") - F.col("oo"))))).alias("value"))


def log_loss(p: DataFrame) -> DataFrame:
    """Mean bits for the true class; a probability of 0 costs NO_CHANCE."""
    x = F.get("dist", F.col("y_true").cast("int"))
    return p.agg(F.avg(F.when(x == 0, F.lit(NO_CHANCE)).otherwise(-F.log2(x))).alias("value"))


def area_under_roc(p: DataFrame, classes: int) -> DataFrame:
    """(class, size, auroc): rows by falling probability of the class, ties by rid; areas by steps, from positions within ranges."""
    each = p.select("rid", "y_true", F.posexplode("dist").alias("class", "p")).where(F.col("class") < classes)
    at = positions(each.withColumn("minus", -F.col("p")), [F.col("minus"), F.col("rid")], F.col("minus"), ["class"])
    own = (F.col("y_true") == F.col("class")).cast("double")
    n, k = F.count("*"), F.sum(own)
    # negatives behind a positive: all behind it less the positives behind it
    behind = F.sum(own * (F.lit(-1.0) - F.col("position")))
    area = at.groupBy("class").agg(n.alias("n"), k.alias("size"), behind.alias("behind"))
    wins = F.col("behind") + F.col("n") * F.col("size") - F.col("size") * (F.col("size") - 1) / 2
    return area.select("class", F.col("size").cast("long").alias("size"), F.try_divide(wins, F.col("size") * (F.col("n") - F.col("size"))).alias("auroc"))


def mean_auroc(p: DataFrame, classes: int) -> DataFrame:
    """Weighted by the classes' shares; of two classes, that of the second."""
    t = area_under_roc(p, classes)
    return t.agg((F.max(F.when(F.col("class") == 1, F.col("auroc"))) if classes == 2 else F.sum(F.col("size") * F.coalesce("auroc", F.lit(0.0))) / F.sum("size")).alias("value"))


def roc_points(p: DataFrame, label: int) -> DataFrame:
    """(threshold, fpr, tpr) at each distinct probability of one class: counts by probability, then running sums over them."""
    x = F.get("dist", F.lit(label))
    counts = p.groupBy(x.alias("threshold")).agg(F.sum((F.col("y_true") == label).cast("long")).alias("own"), F.count("*").alias("n"))
    whole = counts.agg(F.sum("own").alias("all_own"), F.sum("n").alias("all_n"))
    running = _running(counts.withColumn("minus", -F.col("threshold")), "minus", ["own", "n"])
    t = running.join(F.broadcast(whole))
    return t.select("threshold", F.try_divide(F.col("n_sum") - F.col("own_sum"), F.col("all_n") - F.col("all_own")).alias("fpr"), F.try_divide(F.col("own_sum"), F.col("all_own")).alias("tpr"))


def _running(df: DataFrame, order: str, columns: list[str], parts: int = 64) -> DataFrame:
    """Running sums <column>_sum along distinct values of a numeric column, by ranges with offsets."""
    from corvane.operators.ordering import ranges

    ranged = df.withColumn("__range", ranges(df, F.col(order), parts))
    inner = Window.partitionBy("__range").orderBy(order)
    sums = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(F.col("__range").alias("__at"), *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in columns])
    t = ranged.join(F.broadcast(sums), F.col("__range") == F.col("__at"))
    return t.select(*df.columns, *[(F.sum(c).over(inner) + F.col(f"__{c}")).alias(f"{c}_sum") for c in columns])


def earliness(p: DataFrame, column: str = "earliness") -> DataFrame:
    return p.agg(F.avg(column).alias("value"))


def harmonic_mean(p: DataFrame, column: str = "earliness") -> DataFrame:
    """Of accuracy and one minus the mean earliness; 0 where both are."""
    t = p.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("a"), (1 - F.avg(column)).alias("e"))
    return t.select(F.coalesce(F.try_divide(2 * F.col("a") * F.col("e"), F.col("a") + F.col("e")), F.lit(0.0)).alias("value"))


CLASSIFICATION = {"accuracy": (accuracy, True), "balanced_accuracy": (balanced_accuracy, True), "f1": (f1, True), "mcc": (matthews, True), "nll": (log_loss, False)}


def pair_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, and the pairs within cells, within a and within b, as doubles."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    pairs = lambda c: (F.col(c).cast("double") * (F.col(c) - 1) / 2)
    one = cells.agg(F.sum("n").cast("double").alias("n"), F.sum(pairs("n")).alias("ij"))
    two = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("i"))
    three = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("j"))
    return one.join(F.broadcast(two)).join(F.broadcast(three))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    every = F.col("n") * (F.col("n") - 1) / 2
    return pair_counts(df, a, b).select(F.coalesce(F.try_divide(every + 2 * F.col("ij") - F.col("i") - F.col("j"), every), F.lit(1.0)).alias("value"))


def adjusted_rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    chance = F.try_divide(F.col("i") * F.col("j"), F.col("n") * (F.col("n") - 1) / 2)
    return pair_counts(df, a, b).select(F.coalesce(F.try_divide(F.col("ij") - chance, (F.col("i") + F.col("j")) / 2 - chance), F.lit(1.0)).alias("value"))


def _information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information and both entropies, in nats."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"))
    one = cells.groupBy(a).agg(F.sum("n").alias("ni"))
    two = cells.groupBy(b).agg(F.sum("n").alias("nj"))
    whole = cells.agg(F.sum("n").cast("double").alias("whole"))
    t = cells.join(one, a).join(two, b).join(F.broadcast(whole))
    mi = t.agg(F.sum(F.col("n") / F.col("whole") * F.log(F.col("n") * F.col("whole") / (F.col("ni") * F.col("nj").cast("double")))).alias("mi"))
    entropy = lambda d, c, name: d.join(F.broadcast(whole)).agg(F.sum(-F.col(c) / F.col("whole") * F.log(F.col(c) / F.col("whole"))).alias(name))
    return mi.join(F.broadcast(entropy(one, "ni", "ha"))).join(F.broadcast(entropy(two, "nj", "hb")))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    return _information(df, a, b).select(F.col("mi").alias("value"))


def normalised_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    return _information(df, a, b).select(F.coalesce(F.try_divide(F.col("mi"), (F.col("ha") + F.col("hb")) / 2), F.lit(1.0)).alias("value"))


def contingency(df: DataFrame, a: str, b: str) -> np.ndarray:
    """The table of counts, rows by a and columns by b, sorted: as large as the clusters and classes are many."""
    rows = df.groupBy(a, b).agg(F.count("*").alias("n")).collect()
    i, j = (sorted({r[c] for r in rows}, key=str) for c in (a, b))
    out = np.zeros((len(i), len(j)), np.int64)
    for r in rows:
        out[i.index(r[a]), j.index(r[b])] = r["n"]
    return out


def expected_mutual_information(table: np.ndarray) -> float:
    """Over all tables with the same margins (Vinh, Epps and Bailey 2010)."""
    n = int(table.sum())
    log = np.vectorize(math.lgamma)
    total = 0.0
    for a in table.sum(1).tolist():
        for b in table.sum(0).tolist():
            k = np.arange(max(1, a + b - n), min(a, b) + 1)
            if len(k):
                weight = np.exp(log(a + 1) + log(b + 1) + log(n - a + 1) + log(n - b + 1) - log(n + 1) - log(k + 1) - log(a - k + 1) - log(b - k + 1) - log(n - a - b + k + 1))
                total += float((k / n * np.log(n * k / (a * b)) * weight).sum())
    return total


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    told = _information(df, a, b).first()
    chance = expected_mutual_information(contingency(df, a, b)) if told["mi"] is not None else 0.0
    spread = ((told["ha"] or 0.0) + (told["hb"] or 0.0)) / 2 - chance
    out = 1.0 if not spread else ((told["mi"] or 0.0) - chance) / spread
    return df.sparkSession.createDataFrame([(float(out),)], "value double")


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of the largest sum, each row and column once, by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain).astype(float)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j, least, used, way = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j] = True
            free = ~used[1:]
            slack = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = free & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j
            nearest = int(np.where(free, least[1:], np.inf).argmin()) + 1
            step = least[nearest]
            np.add.at(u, match[used], step)
            v[used] -= step
            least[~used] -= step
            j = nearest
            if not match[j]:
                break
        while j:
            match[j] = match[way[j]]
            j = way[j]
    pairs = [(int(match[j]) - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def clustering_accuracy(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """The share of rows that the best pairing of clusters and classes tells right."""
    table = contingency(df, cluster, label)
    hits = sum(int(table[i, j]) for i, j in best_assignment(table)) if table.size else 0
    return df.sparkSession.createDataFrame([(hits / max(1, int(table.sum())),)], "value double")


def regression(df: DataFrame, y: str, p: str) -> DataFrame:
    """mse, rmse, mae, r2 and mape; divisors of 0 are TINY."""
    y, p = F.col(y), F.col(p)
    off = y - p
    t = df.agg(F.avg(off * off).alias("mse"), F.avg(F.abs(off)).alias("mae"), F.avg(F.abs(off) / F.greatest(F.abs(y), F.lit(TINY))).alias("mape"), F.var_pop(y).alias("var"))
    return t.select("mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.col("mse") / F.when(F.col("var") == 0, F.lit(TINY)).otherwise(F.col("var"))).alias("r2"), "mape")


def _shares(counts: Column) -> Column:
    whole = F.aggregate(counts, F.lit(0.0), lambda t, x: t + x)
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, whole), F.lit(0.0)))


def entropy(counts: Column) -> Column:
    """Bits of an array of class counts."""
    return F.aggregate(_shares(counts), F.lit(0.0), lambda t, p: t - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def gini(counts: Column) -> Column:
    return 1 - F.aggregate(_shares(counts), F.lit(0.0), lambda t, p: t + p * p)


def split_scores(df: DataFrame, split: str, label: str) -> DataFrame:
    """One row for a split of labelled rows: entropy and Gini impurity before, their gains, and chi-squared."""
    cells = df.groupBy(split, label).agg(F.count("*").cast("double").alias("n"))
    whole = cells.groupBy(label).agg(F.sum("n").alias("nj"))
    before = whole.agg(F.sort_array(F.collect_list("nj")).alias("all"), F.sum("nj").alias("whole"))  # as long as there are classes
    parts = cells.groupBy(split).agg(F.sort_array(F.collect_list("n")).alias("part"), F.sum("n").alias("ni"))
    t = parts.join(F.broadcast(before))
    gains = t.groupBy("all", "whole").agg(F.sum(F.col("ni") / F.col("whole") * entropy(F.col("part"))).alias("e"), F.sum(F.col("ni") / F.col("whole") * gini(F.col("part"))).alias("g"))
    # chi-squared: sum n^2 / expected - n, which leaves empty cells out
    chi = cells.join(parts.select(split, "ni"), split).join(whole, label).join(F.broadcast(before.select("whole"))).agg((F.sum(F.col("n") * F.col("n") * F.col("whole") / (F.col("ni") * F.col("nj"))) - F.first("whole")).alias("chi_squared"))
    return gains.select(entropy(F.col("all")).alias("entropy"), gini(F.col("all")).alias("gini"), (entropy(F.col("all")) - F.col("e")).alias("information_gain"), (gini(F.col("all")) - F.col("g")).alias("gini_gain")).join(F.broadcast(chi))


def association(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi-squared, Cramer's V, information gain, gain ratio and symmetrical uncertainty (in bits) of two columns."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").cast("double").alias("n"))
    one, two = cells.groupBy("a").agg(F.sum("n").alias("ni")), cells.groupBy("b").agg(F.sum("n").alias("nj"))
    whole = cells.agg(F.sum("n").alias("w"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    bits = lambda d, c, name: d.join(F.broadcast(whole)).agg(F.sum(-F.col(c) / F.col("w") * F.log2(F.col(c) / F.col("w"))).alias(name))
    t = cells.join(one, "a").join(two, "b").join(F.broadcast(whole))
    t = t.agg(F.sum(F.col("n") / F.col("w") * F.log2(F.col("n") * F.col("w") / (F.col("ni") * F.col("nj")))).alias("gain"), (F.sum(F.col("n") * F.col("n") * F.col("w") / (F.col("ni") * F.col("nj"))) - F.first("w")).alias("chi_squared"))
    t = t.join(F.broadcast(bits(one, "ni", "ha"))).join(F.broadcast(bits(two, "nj", "hb"))).join(F.broadcast(whole))
    none = F.lit(0.0)
    return t.select(
        "chi_squared", F.coalesce(F.sqrt(F.try_divide(F.col("chi_squared"), F.col("w") * (F.least("ka", "kb") - 1))), none).alias("cramers_v"), F.col("gain").alias("information_gain"),
        F.coalesce(F.try_divide(F.col("gain"), F.col("ha")), none).alias("gain_ratio"), F.coalesce(F.try_divide(2 * F.col("gain"), F.col("ha") + F.col("hb")), none).alias("symmetrical_uncertainty"),
    )


def rescored(scores: DataFrame, column: str, decimals: int = 6) -> DataFrame:
    return scores.withColumn(column, F.round(column, decimals) + 0.0)
