"""Positions in a total order, without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into.
PARTS = 64


def ranges(df: DataFrame, lead: Column, parts: int = PARTS) -> Column:
    """The number of a row's range among parts of about equal size by a numeric lead; null comes after all.

    The bounds are quantiles of the lead: parts - 1 numbers on the driver.
    """
    steps = [k / parts for k in range(1, parts)]
    bounds = sorted(set(df.select(lead.cast("double").alias("lead")).approxQuantile("lead", steps, 0.5 / parts)))
    known = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<double>"), lambda b: b < lead.cast("double")))
    return F.when(lead.isNull(), F.lit(parts)).otherwise(known)


def positions(df: DataFrame, order: list[Column], lead: Column, by: list[str] | None = None, name: str = "position", parts: int = PARTS) -> DataFrame:
    """df with each row's 0-based position in an order, within by.

    order must be total, and lead a number that never falls along it (nulls last).
    Rows are numbered within ranges of the lead, each a window of its own, and get
    the rows of the ranges before as an offset; no task sees more than a range of
    a group. Only rows of one and the same lead stay together.
    """
    by = list(by or [])
    ranged = df.withColumn("__range", ranges(df, lead, parts))
    local = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(*order))
    sizes = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__range_"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    same = F.col("__range") == F.col("__range_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    numbered = ranged.withColumn("__local", local).join(sizes, same)
    return numbered.withColumn(name, (F.col("__local") - 1 + F.col("__offset")).cast("long")).select(*df.columns, name)


def hashed(seed: int | str, *columns: str) -> Column:
    """The hexadecimal digest that stands for a random order: of the seed and the columns."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *columns))


def fraction(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest as a number from 0 to under 1, monotone in the digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def shuffled(df: DataFrame, seed: int | str, key: str, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """df with positions in the order of a seeded hash of its key, ties by the key."""
    digest = hashed(seed, key)
    return positions(df, [digest, F.col(key)], fraction(digest), by, name)
