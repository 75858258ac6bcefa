"""Scores of attributes against a class, subsets of them, and rules among them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.metrics import association


def scores(df: DataFrame, attributes: list[str], label: str, measure: str) -> DataFrame:
    """(attribute, value): information_gain, gain_ratio, symmetrical_uncertainty, chi_squared or cramers_v of each with the class."""
    parts = [association(df, a, label).select(F.lit(a).alias("attribute"), F.col(measure).alias("value")) for a in attributes]
    return reduce(DataFrame.union, parts)


def correlations(df: DataFrame, attributes: list[str], target: str) -> DataFrame:
    """(attribute, value): Pearson's, 0 without spread; one pass."""
    row = df.agg(*[F.coalesce(F.corr(a, target), F.lit(0.0)).alias(f"c{i}") for i, a in enumerate(attributes)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"c{i}").alias("value")) for i, a in enumerate(attributes)])).alias("x")).select("x.*")


def one_rule(df: DataFrame, attributes: list[str], label: str) -> DataFrame:
    """(attribute, value): the share of rows that the most frequent class of each of its values tells right."""

    def of(a: str) -> DataFrame:
        top = df.groupBy(a, label).agg(F.count("*").alias("n")).groupBy(a).agg(F.max("n").alias("hit"), F.sum("n").alias("n"))
        return top.agg((F.sum("hit") / F.sum("n")).alias("value")).select(F.lit(a).alias("attribute"), "value")

    return reduce(DataFrame.union, [of(a) for a in attributes])


def consistency(df: DataFrame, subset: list[str], label: str) -> DataFrame:
    """One less the share of rows that differ from the most frequent class of their values over a subset."""
    top = df.groupBy(*subset, label).agg(F.count("*").alias("n")).groupBy(*subset).agg(F.max("n").alias("hit"), F.sum("n").alias("n"))
    return top.agg((F.sum("hit") / F.sum("n")).alias("value"))


def subset_merit(df: DataFrame, subset: list[str], label: str) -> float:
    """k times the mean uncertainty shared with the class, over sqrt(k + k (k - 1) times that among the attributes)."""
    shared = lambda a, b: association(df, a, b).first()["symmetrical_uncertainty"] or 0.0
    own = [shared(a, label) for a in subset]
    pairs = [shared(a, b) for i, a in enumerate(subset) for b in subset[:i]]
    return sum(own) / max(1e-12, (len(subset) + 2 * sum(pairs)) ** 0.5)


def greedy_subset(df: DataFrame, attributes: list[str], label: str) -> list[str]:
    """Attributes added while the subset's merit grows."""
    chosen: list[str] = []
    best = 0.0
    while rest := [a for a in attributes if a not in chosen]:
        merit, a = max(((subset_merit(df, [*chosen, a], label), a) for a in rest), key=lambda x: (x[0], -attributes.index(x[1])))
        if merit <= best + 1e-12:
            break
        best = merit
        chosen.append(a)
    return chosen


def top(scored: DataFrame, n: int | None = None, least: float | None = None) -> DataFrame:
    """The best attributes, ties by name."""
    kept = scored if least is None else scored.where(F.col("value") >= least)
    out = kept.orderBy(F.desc("value"), "attribute")
    return out if n is None else out.limit(n)


def relief(df: DataFrame, attributes: list[str], label: str, key: str, vector: str, k: int = 10) -> DataFrame:
    """(attribute, value): how much more an attribute differs between a row and its nearest of other classes than of its own, on a scale of 0 to 1."""
    from corvane.operators.distances import nearest

    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("s"))
    hits = nearest(rows, rows, k)
    one, two = (df.select(F.col(key).alias(c), F.col(label).alias(f"{c}_label"), F.col(vector).alias(f"{c}_v")) for c in "qc")
    t = hits.join(one, "q").join(two, "c")
    sign = F.when(F.col("q_label") == F.col("c_label"), -1.0).otherwise(1.0)
    spread = df.select(F.posexplode(vector).alias("at", "x")).groupBy("at").agg((F.max("x") - F.min("x")).alias("spread"))
    each = t.select(sign.alias("sign"), F.posexplode(F.zip_with("q_v", "c_v", lambda x, y: F.abs(x - y))).alias("at", "d"))
    sums = each.groupBy("at").agg(F.avg(F.col("sign") * F.col("d")).alias("d")).join(F.broadcast(spread), "at")
    names = F.array(*map(F.lit, attributes))
    return sums.select(F.get(names, F.col("at")).alias("attribute"), F.coalesce(F.try_divide(F.col("d"), F.col("spread")), F.lit(0.0)).alias("value"))


def frequent_itemsets(baskets: DataFrame, items: str, support: float) -> DataFrame:
    """(items, freq) of item sets of at least a share of the baskets, by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol=items, minSupport=support).fit(baskets).freqItemsets
    return found.select(F.sort_array("items").alias("items"), "freq")


def rules(baskets: DataFrame, items: str, support: float, confidence: float) -> DataFrame:
    """(antecedent, consequent, confidence, lift, leverage, conviction, support)."""
    from pyspark.ml.fpm import FPGrowth

    found = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(baskets).associationRules
    base = F.try_divide(F.col("confidence"), F.col("lift"))
    return found.select(F.sort_array("antecedent").alias("antecedent"), "consequent", "confidence", "lift", (F.col("support") - F.col("support") / F.col("confidence") * base).alias("leverage"), F.try_divide(1 - base, 1 - F.col("confidence")).alias("conviction"), "support")


def frequent_sequences(sequences: DataFrame, column: str, support: float, longest: int = 5) -> DataFrame:
    """(sequence, freq), by PrefixSpan."""
    from pyspark.ml.fpm import PrefixSpan

    return PrefixSpan(minSupport=support, maxPatternLength=longest, sequenceCol=column).findFrequentSequentialPatterns(sequences)
