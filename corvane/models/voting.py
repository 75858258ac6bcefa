"""Ensembles over the predictions of their modules: weights, and ways to vote.

Predictions are rows (module, rid, y_true, p), p the module's probability for each
class; weights are rows (module, weight) or (module, class, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def told(p: Column) -> Column:
    """The class of the highest probability, the smallest of equals."""
    return F.array_position(p, F.array_max(p)) - 1


def weigh(train: DataFrame, by: str = "accuracy", power: float = 1.0) -> DataFrame:
    """(module, weight) from predictions of training rows: equal, accuracy, balanced_accuracy, f1, mcc, nll, corrected by the mean or the most, proportional."""
    rows = train.withColumn("y_pred", told(F.col("p")))
    hit = (F.col("y_true") == F.col("y_pred")).cast("double")
    if by == "equal":
        return rows.select("module").distinct().withColumn("weight", F.lit(1.0))
    acc = rows.groupBy("module").agg(F.avg(hit).alias("acc"))
    if by in ("proportional", "mean_corrected", "max_corrected"):
        every = Window.partitionBy(F.lit(0))  # a row for each module
        w = {"proportional": F.col("acc") / F.sum("acc").over(every), "mean_corrected": F.greatest(F.col("acc") - F.avg("acc").over(every), F.lit(0.0)), "max_corrected": F.col("acc") / F.max("acc").over(every)}[by]
        return acc.select("module", w.alias("weight"))
    if by == "accuracy":
        return acc.select("module", F.pow("acc", F.lit(power)).alias("weight"))
    if by == "nll":
        x = F.get("p", F.col("y_true").cast("int"))
        return rows.groupBy("module").agg((1 / F.avg(F.when(x == 0, F.lit(6.64)).otherwise(-F.log2(x)))).alias("weight"))
    cells = rows.groupBy("module", "y_true", "y_pred").agg(F.count("*").cast("double").alias("n"))
    if by == "mcc":
        own = cells.groupBy("module", F.col("y_true").alias("c")).agg(F.sum("n").alias("own"))
        said = cells.groupBy("module", F.col("y_pred").alias("c")).agg(F.sum("n").alias("said"))
        both = own.join(said, ["module", "c"], "full").fillna(0.0, ["own", "said"]).groupBy("module").agg(F.sum(F.col("own") * F.col("said")).alias("os"), F.sum(F.col("own") * F.col("own")).alias("oo"), F.sum(F.col("said") * F.col("said")).alias("ss"))
        whole = cells.groupBy("module").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0)).alias("hit"))
        n2 = F.col("n") * F.col("n")
        r = F.try_divide(F.col("hit") * F.col("n") - F.col("os"), F.sqrt((n2 - F.col("ss")) * (n2 - F.col("oo"))))
        return both.join(whole, "module").select("module", ((F.coalesce(r, F.lit(0.0)) + 1) / 2).alias("weight"))
    recall = cells.groupBy("module", "y_true").agg((F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0)) / F.sum("n")).alias("r"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0.0)).alias("tp"), F.sum("n").alias("own"))
    if by == "recall_by_class":
        return recall.select("module", F.col("y_true").alias("class"), F.col("r").alias("weight"))
    if by == "balanced_accuracy":
        return recall.groupBy("module").agg(F.avg("r").alias("weight"))
    if by == "f1":
        said = cells.groupBy("module", F.col("y_pred").alias("y_true")).agg(F.sum("n").alias("said"))
        t = recall.join(said, ["module", "y_true"], "left").fillna(0.0, ["said"])
        hits = F.when(F.col("tp") == 0, F.lit(1e-7)).otherwise(F.col("tp"))
        return t.groupBy("module").agg(F.avg(2 * hits / (F.col("own") + F.col("said") - 2 * F.col("tp") + 2 * hits)).alias("weight"))
    raise ValueError(f"no weighting {by!r}")


def _first(sums: DataFrame) -> DataFrame:
    """(rid, predicted, score) of (rid, class, score): the highest, ties to the smaller class."""
    order = Window.partitionBy("rid").orderBy(F.round("score", 9).desc(), "class")
    return sums.withColumn("at", F.row_number().over(order)).where("at = 1").select("rid", F.col("class").alias("predicted"), "score")


def _joined(test: DataFrame, weights: DataFrame) -> DataFrame:
    return test.join(F.broadcast(weights), "module")  # a row for each module, or for each of its classes


def majority_vote(test: DataFrame, weights: DataFrame) -> DataFrame:
    """Each module's weight for its class; weights by class count for the class told."""
    voted = test.withColumn("class", told(F.col("p")))
    t = voted.join(F.broadcast(weights), ["module", "class"] if "class" in weights.columns else ["module"])
    return _first(t.groupBy("rid", "class").agg(F.sum("weight").alias("score")))


def distribution(test: DataFrame, weights: DataFrame) -> DataFrame:
    """(rid, class, score): the weighted mean of the modules' probabilities."""
    t = _joined(test, weights).select("rid", "weight", F.posexplode("p").alias("class", "x"))
    return t.groupBy("rid", F.col("class").cast("long").alias("class")).agg((F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("score"))


def majority_confidence(test: DataFrame, weights: DataFrame) -> DataFrame:
    """The class of the highest weighted mean probability; with accuracies to the power of 4 for weights, the probabilistic ensemble CAWPE."""
    return _first(distribution(test, weights))


def cawpe(train: DataFrame, test: DataFrame, power: float = 4.0) -> DataFrame:
    return majority_confidence(test, weigh(train, "accuracy", power))


def vote_by_confidence(test: DataFrame, weights: DataFrame, power: float = 1.0, correct: float = 0.0, mean: bool = False) -> DataFrame:
    """Each module's weight times its confidence (less a share, to a power) for its class; summed, or averaged over the modules that told the class."""
    confidence = F.pow(F.greatest(F.array_max("p") - correct, F.lit(0.0)), F.lit(power))
    t = _joined(test, weights).select("rid", told(F.col("p")).alias("class"), (F.col("weight") * confidence).alias("x"))
    return _first(t.groupBy("rid", "class").agg((F.avg("x") if mean else F.sum("x")).alias("score")))


def best_module(train: DataFrame) -> DataFrame:
    """(module, acc): the most accurate, the first by name of equals."""
    acc = train.groupBy("module").agg(F.avg((F.col("y_true") == told(F.col("p"))).cast("double")).alias("acc"))
    return acc.orderBy(F.desc("acc"), "module").limit(1)


def best_individual(train: DataFrame, test: DataFrame) -> DataFrame:
    t = test.join(F.broadcast(best_module(train)), "module")
    return t.select("rid", told(F.col("p")).alias("predicted"), F.array_max("p").alias("score"))


def highest_probability(test: DataFrame) -> DataFrame:
    """The class that any module is surest of."""
    t = test.select("rid", F.posexplode("p").alias("class", "x"))
    return _first(t.groupBy("rid", F.col("class").cast("long").alias("class")).agg(F.max("x").alias("score")))


def bayes_combination(train: DataFrame, test: DataFrame, classes: int) -> DataFrame:
    """The class of the largest product, over modules, of the smoothed share of its training rows that the module told alike."""
    cells = train.withColumn("said", told(F.col("p"))).groupBy("module", F.col("y_true").cast("long").alias("class"), "said").agg(F.count("*").alias("n"))
    own = train.groupBy("module", F.col("y_true").cast("long").alias("class")).agg(F.count("*").alias("own"))
    each = test.select("module", "rid", told(F.col("p")).alias("said"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long"))).alias("class"))
    t = each.join(F.broadcast(own), ["module", "class"], "left").join(F.broadcast(cells), ["module", "class", "said"], "left")
    share = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("own", F.lit(0)) + classes)
    return _first(t.groupBy("rid", "class").agg(F.sum(F.log(share)).alias("score")))


def greedy_selection(train: DataFrame, rounds: int = 5) -> list[str]:
    """Modules added one at a time, with replacement, while the accuracy of their mean distribution grows: a driver loop over module sums."""
    modules = sorted(r[0] for r in train.select("module").distinct().collect())
    each = train.select("module", "rid", "y_true", F.posexplode("p").alias("class", "x"))
    wide = each.groupBy("rid", "y_true", "class").pivot("module", modules).agg(F.first("x"))
    chosen: list[str] = []
    best = -1.0
    for _ in range(rounds):
        sums = [sum((F.col(f"`{c}`") for c in [*chosen, m]), F.lit(0.0)) for m in modules]
        long = wide.select("rid", "y_true", "class", *[s.alias(f"s{i}") for i, s in enumerate(sums)])
        by = long.groupBy("rid", "y_true").agg(*[F.max_by("class", F.struct(f"s{i}", -F.col("class"))).alias(f"c{i}") for i in range(len(modules))])
        acc = by.agg(*[F.avg((F.col(f"c{i}") == F.col("y_true")).cast("double")) for i in range(len(modules))]).first()
        at = max(range(len(modules)), key=lambda i: (acc[i], -i))
        if acc[at] <= best:
            break
        best = acc[at]
        chosen.append(modules[at])
    return chosen
