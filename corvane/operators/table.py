"""Operators of the table layer: recoding, ranking, statistics, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_within(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """0-based rank of value within group, ties by another column."""
    return df.withColumn("rank", (F.row_number().over(Window.partitionBy(group).orderBy(value, tie)) - 1).cast("long"))


def column_interval(df: DataFrame, group: str, value: str) -> DataFrame:
    """Min-max scaling by group: partial aggregation, then a join on the group."""
    bounds = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return df.join(bounds, group).withColumn("value", (F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")))


def equal_width(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Bin 0 to bins - 1 of equal widths over the column's range."""
    bounds = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))  # one row
    place = F.floor((F.col(value) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins))
    return df.join(F.broadcast(bounds)).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("long")).drop("lo", "hi")


def statistics(df: DataFrame, value: str) -> DataFrame:
    """Count, missing, distinct, minimum, maximum, mean and sample standard deviation of a column."""
    c = F.col(value)
    return df.agg(
        F.count("*").alias("n"), F.sum(c.isNull().cast("long")).alias("missing"), F.count_distinct(c).alias("n_distinct"), F.round(F.min(c), 4).alias("least"),
        F.round(F.max(c), 4).alias("most"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"),
    )


def one_hot(df: DataFrame, value: str, labels: list[str]) -> DataFrame:
    return df.select("*", *[(F.col(value) == x).cast("int").alias(f"{value}_{x}") for x in labels])


def shuffled_folds(df: DataFrame, key: str, group: str, folds: int, seed: str = "0") -> DataFrame:
    """Stratified folds: rows of each group in the order of a seeded hash, dealt in turn."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("-", F.lit(seed), key)), key)
    return df.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("long"))


def queries(read) -> dict:
    found = {}

    def add(name, run, sql):
        found[name] = (run, sql)

    add("discretize_equal_width", lambda s, d: equal_width(read(s, d, "customer"), "c_acctbal").select("c_custkey", "bin"), "SELECT c_custkey, CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
    add("attribute_stats", lambda s, d: statistics(read(s, d, "customer"), "c_acctbal"), "SELECT count(*) AS n, CAST(sum((c_acctbal IS NULL)::INT) AS BIGINT) AS missing, count(DISTINCT c_acctbal) AS n_distinct, ROUND(min(c_acctbal), 4) AS least, ROUND(max(c_acctbal), 4) AS most, ROUND(avg(c_acctbal), 4) AS mean, ROUND(stddev_samp(c_acctbal), 4) AS sd FROM customer")
    add("one_hot", lambda s, d: one_hot(read(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", ["BUILDING", "MACHINERY"]).select("c_custkey", "c_mktsegment_BUILDING", "c_mktsegment_MACHINERY"), "SELECT c_custkey, (c_mktsegment = 'BUILDING')::INT AS \"c_mktsegment_BUILDING\", (c_mktsegment = 'MACHINERY')::INT AS \"c_mktsegment_MACHINERY\" FROM customer")
    add("stratified_folds", lambda s, d: shuffled_folds(read(s, d, "customer"), "c_custkey", "c_mktsegment", 10).select("c_custkey", "fold"), "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0-' || CAST(c_custkey AS VARCHAR)), c_custkey) - 1) % 10 AS BIGINT) AS fold FROM customer")
    add("class_distribution", lambda s, d: read(s, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
    add("relaggs", lambda s, d: read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.min("o_totalprice"), 6).alias("least"), F.round(F.max("o_totalprice"), 6).alias("most"), F.round(F.avg("o_totalprice"), 6).alias("mean")), "SELECT o_custkey, count(*) AS n, ROUND(min(o_totalprice), 6) AS least, ROUND(max(o_totalprice), 6) AS most, ROUND(avg(o_totalprice), 6) AS mean FROM orders GROUP BY 1")
    return found
