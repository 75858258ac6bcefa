"""Comparison of estimators over datasets and folds, and the tests that go with it.

Results are rows (estimator, dataset, fold, split, value): one for each model that was
run. Tests of samples take columns of a table; ranks run within a dataset.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided Student quantiles at 0.05 by degrees of freedom, to three decimals. Fixed values.
STUDENT = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 25: 2.060, 29: 2.045, 30: 2.042, 40: 2.021, 60: 2.0, 120: 1.98}


def student(freedom: Column) -> Column:
    """The quantile of the nearest tabled degrees of freedom at or under; 1.96 beyond them."""
    out = F.lit(1.96)
    for n in sorted(STUDENT, reverse=True):
        out = F.when(freedom <= n, F.lit(STUDENT[max(k for k in STUDENT if k <= n)])).otherwise(out)
    return out


def over_folds(results: DataFrame, median: bool = False) -> DataFrame:
    """(estimator, dataset, value): mean or median over folds."""
    return results.groupBy("estimator", "dataset").agg((F.median("value") if median else F.avg("value")).alias("value"))


def deviations(results: DataFrame) -> DataFrame:
    return results.groupBy("estimator", "dataset").agg(F.stddev_samp("value").alias("value"))


def complete(results: DataFrame) -> DataFrame:
    """Results of the datasets and folds that every estimator has."""
    n = results.select("estimator").distinct().agg(F.count("*").alias("__n"))
    full = results.groupBy("dataset", "fold").agg(F.count_distinct("estimator").alias("__have")).join(F.broadcast(n)).where("__have = __n")
    return results.join(full.select("dataset", "fold"), ["dataset", "fold"], "left_semi")


def tied_rank(by: list[str], order: Column) -> Column:
    """1-based ranks within by; ties share the mean of theirs."""
    whole = Window.partitionBy(*by, order)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(whole) - 1) / 2


def ranks(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """scores (estimator, dataset, value) with the rank of each estimator on each dataset."""
    key = -F.col("value") if higher_is_better else F.col("value")
    keyed = scores.withColumn("__key", key)
    return keyed.withColumn("rank", tied_rank(["dataset"], F.col("__key"))).drop("__key")


def mean_ranks(scores: DataFrame, higher_is_better: bool = True) -> DataFrame:
    return ranks(scores, higher_is_better).groupBy("estimator").agg(F.avg("rank").alias("rank"))


def _pairs(a: DataFrame, on: list[str]) -> DataFrame:
    one = a.select(F.col("estimator").alias("a"), *on, F.col("value").alias("x"))
    two = a.select(F.col("estimator").alias("b"), *on, F.col("value").alias("y"))
    return one.join(two, on).where("a <> b")


def wins_draws_losses(scores: DataFrame) -> DataFrame:
    """(a, b, wins, draws, losses) over datasets."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return _pairs(scores, ["dataset"]).groupBy("a", "b").agg(count(F.col("x") > F.col("y")).alias("wins"), count(F.col("x") == F.col("y")).alias("draws"), count(F.col("x") < F.col("y")).alias("losses"))


def paired_t(results: DataFrame) -> DataFrame:
    """(a, b, dataset, n, t): paired over folds; null without spread."""
    d = F.col("x") - F.col("y")
    t = _pairs(results, ["dataset", "fold"]).groupBy("a", "b", "dataset").agg(F.count("*").alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("sd"))
    return t.select("a", "b", "dataset", "n", F.try_divide(F.col("m"), F.col("sd") / F.sqrt("n")).alias("t"))


def significant_wins(results: DataFrame) -> DataFrame:
    """(a, b, wins, draws, losses) over datasets, of those whose paired t-test over folds is beyond the 0.05 quantile; all others are draws."""
    far = student(F.col("n") - 1)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    t = paired_t(results).groupBy("a", "b").agg(count(F.col("t") > far).alias("wins"), count(F.col("t") < -far).alias("losses"), F.count("*").alias("n"))
    return t.select("a", "b", "wins", (F.col("n") - F.col("wins") - F.col("losses")).alias("draws"), "losses")


def by_group(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, estimator, value, wins): the mean over each group's datasets, and on how many of them it is best (ties count)."""
    t = scores.join(groups, "dataset")
    best = F.max("value").over(Window.partitionBy("dataset"))
    return t.withColumn("__best", best).groupBy("group", "estimator").agg(F.avg("value").alias("value"), F.sum((F.col("value") == F.col("__best")).cast("long")).alias("wins"))


def train_test_differences(results: DataFrame) -> DataFrame:
    """(estimator, dataset, fold, value): train less test."""
    side = lambda s, name: results.where(F.col("split") == s).select("estimator", "dataset", "fold", F.col("value").alias(name))
    return side("train", "x").join(side("test", "y"), ["estimator", "dataset", "fold"]).select("estimator", "dataset", "fold", (F.col("x") - F.col("y")).alias("value"))


def summary(scores: DataFrame) -> DataFrame:
    """(estimator, mean, sd, least, most, rank, best): the report's lines."""
    best = F.max("value").over(Window.partitionBy("dataset"))
    t = ranks(scores).withColumn("__best", best)
    return t.groupBy("estimator").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"), F.avg("rank").alias("rank"), F.sum((F.col("value") == F.col("__best")).cast("long")).alias("best"))


def cube(results: DataFrame, *by: str) -> DataFrame:
    """Counts and means of the results at every grouping of the columns."""
    return results.cube(*by).agg(F.count("*").alias("n"), F.avg("value").alias("value"))


# Tests of samples. Rank sums come from ties counted by value, so that windows run
# over distinct values within a pair, not over the tables.


def normal_tail(z: Column) -> Column:
    """The two-sided tail of the normal distribution, by the rational approximation of Abramowitz and Stegun 7.1.26 (error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def one_sample_t(df: DataFrame, column: str, mean: float = 0.0) -> DataFrame:
    t = df.agg(F.count(column).alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("sd"))
    return t.select("n", F.try_divide(F.col("m") - mean, F.col("sd") / F.sqrt("n")).alias("statistic"))


def sign_test(df: DataFrame, column: str, median: float = 0.0) -> DataFrame:
    """(n, above, statistic): values beyond the median of those unlike it, and their number in standard deviations."""
    d = F.col(column) - median
    t = df.agg(F.sum((d != 0).cast("long")).alias("n"), F.sum((d > 0).cast("long")).alias("above"))
    return t.select("n", "above", F.try_divide(F.col("above") - F.col("n") / 2, F.sqrt(F.col("n") / 4)).alias("statistic"))


def _value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, rank): the tied rank of each distinct value, by ranges."""
    from corvane.operators.metrics import _running

    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__n"))
    t = _running(counts, "__v", ["__n"])
    return t.select("__v", "__n", (F.col("__n_sum") - (F.col("__n") - 1) / 2).alias("__rank"))


def ranked(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """df with the tied rank of a value over the whole table."""
    t = _value_ranks(df, value)
    return df.join(t, F.col(value) == F.col("__v"), "left").withColumn(name, F.col("__rank")).select(*df.columns, name)


def signed_rank(df: DataFrame, column: str, median: float = 0.0) -> DataFrame:
    """Wilcoxon's signed rank: (n, w_plus, statistic), values like the median left out."""
    d = df.select((F.col(column) - median).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    t = ranked(d, "size").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    return t.select("n", "w_plus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("statistic"))


def rank_sum(df: DataFrame, column: str, group: str, first: object) -> DataFrame:
    """Wilcoxon's rank sum and Mann and Whitney's U of one group against all other rows: (n, m, w, u, statistic)."""
    t = ranked(df.select(column, (F.col(group) == first).alias("own")).where(F.col(column).isNotNull()), column)
    t = t.agg(F.sum(F.col("own").cast("double")).alias("n"), F.sum((~F.col("own")).cast("double")).alias("m"), F.sum(F.when(F.col("own"), F.col("rank"))).alias("w"))
    n, m = F.col("n"), F.col("m")
    u = F.col("w") - n * (n + 1) / 2
    return t.select("n", "m", "w", u.alias("u"), F.try_divide(u - n * m / 2, F.sqrt(n * m * (n + m + 1) / 12)).alias("statistic"))


def two_sample_t(df: DataFrame, column: str, group: str, first: object, equal: bool = True) -> DataFrame:
    """(freedom, statistic) of one group against all other rows, with one variance or two."""
    own = F.col(group) == first
    part = lambda f, c: f(F.when(c, F.col(column)))
    t = df.agg(*[part(f, c).alias(f"{k}{i}") for i, c in ((1, own), (2, ~own)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    n1, n2, v1, v2 = F.col("n1").cast("double"), F.col("n2").cast("double"), F.col("v1"), F.col("v2")
    if equal:
        pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
        return t.select((n1 + n2 - 2).alias("freedom"), F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / n1 + 1 / n2))).alias("statistic"))
    a, b = v1 / n1, v2 / n2
    return t.select(F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1)).alias("freedom"), F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(a + b)).alias("statistic"))


def kruskal_wallis(df: DataFrame, column: str, group: str) -> DataFrame:
    """(groups, n, statistic), corrected for ties."""
    known = df.select(group, column).where(F.col(column).isNotNull())
    sums = ranked(known, column).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.sum("rank").alias("r"))
    t = sums.agg(F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"))
    ties = known.groupBy(column).agg(F.count("*").cast("double").alias("k")).agg(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("ties"))
    n = F.col("n")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return t.join(F.broadcast(ties)).select("groups", n.cast("long").alias("n"), F.try_divide(h, 1 - F.try_divide(F.col("ties"), n * n * n - n)).alias("statistic"))


def moods_median(df: DataFrame, column: str, group: str) -> DataFrame:
    """Chi-squared of the groups' rows above, and not above, the median of all."""
    from corvane.operators.metrics import association

    middle = df.agg(F.median(column).alias("__m"))
    told = df.join(F.broadcast(middle)).select(group, (F.col(column) > F.col("__m")).alias("above"))
    return association(told, group, "above").select(F.col("chi_squared").alias("statistic"))


def f_ratio(df: DataFrame, column: str, group: str) -> DataFrame:
    """One-way analysis of variance: mean square between groups over that within."""
    x = F.col(column)
    parts = df.where(x.isNotNull()).groupBy(group).agg(F.count("*").cast("double").alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    t = parts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s1"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = F.col("s2") - F.col("s1") * F.col("s1") / F.col("n")
    return t.select(F.try_divide(F.try_divide(between, F.col("k") - 1), F.try_divide(F.col("within"), F.col("n") - F.col("k"))).alias("statistic"))


def friedman(scores: DataFrame) -> DataFrame:
    """(estimators, datasets, statistic) over mean ranks."""
    t = ranks(scores).groupBy("estimator").agg(F.avg("rank").alias("r"), F.count("*").alias("n"))
    t = t.agg(F.count("*").cast("double").alias("k"), F.max("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"))
    k, n = F.col("k"), F.col("n")
    return t.select(k.cast("long").alias("estimators"), n.cast("long").alias("datasets"), (12 * n / (k * (k + 1)) * (F.col("s") - k * (k + 1) * (k + 1) / 4)).alias("statistic"))


def pairwise_signed_rank(scores: DataFrame) -> DataFrame:
    """(a, b, n, w_plus, statistic, p): Wilcoxon's signed rank over datasets for each pair of estimators, with its normal tail."""
    d = _pairs(scores, ["dataset"]).where("a < b").withColumn("d", F.col("x") - F.col("y")).where("d <> 0").withColumn("size", F.abs("d"))
    t = d.withColumn("rank", tied_rank(["a", "b"], F.col("size"))).groupBy("a", "b").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)).alias("w_plus"))
    n = F.col("n").cast("double")
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return t.select("a", "b", "n", "w_plus", z.alias("statistic"), normal_tail(z).alias("p"))


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (.., p) with rejected: by Holm's step-down rule over a table of pairs."""
    order = Window.orderBy("p", "a", "b")
    t = tests.withColumn("__at", F.row_number().over(order)).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(0))))
    kept = F.max((F.col("p") > alpha / (F.col("__n") - F.col("__at") + 1)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("rejected", kept == 0).drop("__at", "__n")


def goldfeld_quandt(df: DataFrame, order: str, residual: str, middle: float = 0.2) -> DataFrame:
    """The ratio of the later rows' residual variance to the earlier rows', a middle share left out."""
    from corvane.operators.rows import numbered

    n = df.count()
    cut = int(n * (1 - middle) / 2)
    rows = numbered(df, order, "__rid")
    square = lambda c: F.sum(F.when(c, F.col(residual) * F.col(residual)))
    return rows.agg(F.try_divide(square(F.col("__rid") >= n - cut), square(F.col("__rid") < cut)).alias("statistic"))


def runs_test(df: DataFrame, order: str, residual: str) -> DataFrame:
    """(runs, statistic): runs of one sign along an order, in standard deviations from what chance gives; a join on positions finds where they begin."""
    from corvane.operators.rows import numbered

    rows = numbered(df.select(order, (F.col(residual) >= 0).alias("up")), order, "__rid")
    last = rows.select((F.col("__rid") + 1).alias("__at"), F.col("up").alias("was"))
    t = rows.join(last, F.col("__rid") == F.col("__at"), "left")
    t = t.agg(F.sum(F.when(F.col("was").isNull() | (F.col("was") != F.col("up")), 1).otherwise(0)).alias("runs"), F.sum(F.col("up").cast("double")).alias("p"), F.sum((~F.col("up")).cast("double")).alias("q"))
    n, pq = F.col("p") + F.col("q"), F.col("p") * F.col("q")
    mean = 2 * pq / n + 1
    return t.select(F.col("runs").cast("long").alias("runs"), F.try_divide(F.col("runs") - mean, F.sqrt((mean - 1) * (mean - 2) / (n - 1))).alias("statistic"))
