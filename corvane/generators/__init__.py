"""Synthetic data: every value follows from a seed, a row and a place, through MD5, so tables are the same wherever they are made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.ordering import fraction


def uniform(seed: int | str, *keys: Column | str) -> Column:
    return fraction(F.md5(F.concat_ws("-", F.lit(str(seed)), *[k.cast("string") if isinstance(k, Column) else F.col(k).cast("string") for k in keys])))


def normal(seed: int | str, *keys: Column | str) -> Column:
    """By the cosine half of Box and Muller's pair."""
    u, v = uniform(f"{seed}u", *keys), uniform(f"{seed}v", *keys)
    return F.sqrt(-2 * F.log(u + 2.0**-33)) * F.cos(2 * math.pi * v)


def cases(spark: SparkSession, n: int, classes: int = 2) -> DataFrame:
    """(series_id, label): labels in turn."""
    return spark.range(n).select(F.col("id").alias("series_id"), (F.col("id") % classes).cast("int").alias("label"))


def series(df: DataFrame, length: int, value: Column, name: str = "s") -> DataFrame:
    """df with a series: value at each place t from 0, an expression over t."""
    points = df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).select(*df.columns, "t", value.alias("x"))
    return points.groupBy(*df.columns).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "x"))), lambda p: p["x"]).alias(name))


def points(df: DataFrame, length: int) -> DataFrame:
    return df.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))


def white_noise(df: DataFrame, length: int, sd: float = 1.0, seed: int | str = 0) -> DataFrame:
    return points(df, length).withColumn("value", sd * normal(seed, "series_id", "t"))


def sinusoids(df: DataFrame, length: int, waves: list[tuple[float, float, float]], noise: float = 0.0, seed: int | str = 0) -> DataFrame:
    """Sum of amplitude sin(2 pi frequency t / length + phase), and noise."""
    wave = sum((a * F.sin(2 * math.pi * f * F.col("t") / length + p) for a, f, p in waves), F.lit(0.0))
    return points(df, length).withColumn("value", wave + noise * normal(seed, "series_id", "t"))


def polynomial(df: DataFrame, length: int, coefficients: list[float], noise: float = 0.0, seed: int | str = 0) -> DataFrame:
    """Of t / length, lowest power first."""
    x = F.col("t") / length
    return points(df, length).withColumn("value", sum((c * F.pow(x, F.lit(float(k))) for k, c in enumerate(coefficients)), F.lit(0.0)) + noise * normal(seed, "series_id", "t"))


def autoregressive(df: DataFrame, length: int, phi: list[float], seed: int | str = 0, burn: int = 0) -> DataFrame:
    """x_t = sum phi_k x_(t-k) + e_t from zeros, after some steps that are left out."""
    e = F.transform(F.sequence(F.lit(0), F.lit(length + burn - 1)), lambda t: normal(seed, "series_id", t))
    p = len(phi)
    zero = F.array_repeat(F.lit(0.0), p)
    step = lambda acc, x: F.concat(acc, F.array(x + sum((c * F.element_at(acc, -(k + 1)) for k, c in enumerate(phi)), F.lit(0.0))))
    whole = F.aggregate(e, zero, step)
    values = F.slice(whole, p + burn + 1, length)
    return df.select("*", F.posexplode(values).alias("t", "value"))


SHAPES = {
    "triangle": lambda x: 1 - F.abs(2 * x - 1),
    "head_and_shoulders": lambda x: F.when(x < 1 / 3, 0.5 * F.sin(3 * math.pi * x)).when(x < 2 / 3, F.sin(3 * math.pi * (x - 1 / 3))).otherwise(0.5 * F.sin(3 * math.pi * (x - 2 / 3))),
    "sine": lambda x: F.sin(2 * math.pi * x),
    "step": lambda x: F.when(x < 0.5, -1.0).otherwise(1.0),
    "spike": lambda x: F.when(x < 0.5, 2 * x).otherwise(2 * x - 2),
}


def planted(df: DataFrame, length: int, size: int, shapes: list[str], height: float = 4.0, repeats: int = 1, noise: float = 1.0, seed: int | str = 0) -> DataFrame:
    """Noise with the label's shape at random places (as many as repeats, one in each stretch of the series)."""
    stretch = length // repeats
    place = F.floor(F.col("t") / stretch)
    start = place * stretch + F.floor(uniform(f"{seed}at", "series_id", place.cast("int")) * (stretch - size + 1))
    x = (F.col("t") - start) / size
    inside = (x >= 0) & (x < 1) & (place < repeats)
    form = F.lit(0.0)
    for k, s in enumerate(shapes):
        form = F.when(F.col("label") == k, SHAPES[s](x)).otherwise(form)
    return points(df, length).withColumn("value", F.when(inside, height * form).otherwise(0.0) + noise * normal(seed, "series_id", "t"))


def dictionary(df: DataFrame, length: int, size: int, repeats: tuple[int, int] = (2, 4), shape: str = "sine", **options) -> DataFrame:
    """The classes differ in how often a shape occurs: the label picks the count."""
    parts = [planted(df.where(F.col("label") == k).withColumn("label", F.lit(0)), length, size, [shape], repeats=n, **options).withColumn("label", F.lit(k)) for k, n in enumerate(repeats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def intervals(df: DataFrame, length: int, spans: list[tuple[int, int]], shapes: list[str], height: float = 4.0, noise: float = 1.0, seed: int | str = 0) -> DataFrame:
    """Noise with the label's shape over fixed intervals; all else tells nothing."""
    value = F.lit(0.0)
    for a, b in spans:
        x = (F.col("t") - a) / (b - a)
        for k, s in enumerate(shapes):
            value = F.when((F.col("t") >= a) & (F.col("t") < b) & (F.col("label") == k), height * SHAPES[s](x)).otherwise(value)
    return points(df, length).withColumn("value", value + noise * normal(seed, "series_id", "t"))


def warped(df: DataFrame, length: int, shapes: list[str], most: float = 0.3, noise: float = 0.1, seed: int | str = 0) -> DataFrame:
    """The label's shape over the whole series, its time bent by up to a share."""
    bend = most * (2 * uniform(f"{seed}bend", "series_id") - 1)
    x = F.col("t") / length
    moved = x + bend * F.sin(math.pi * x) / 2
    form = F.lit(0.0)
    for k, s in enumerate(shapes):
        form = F.when(F.col("label") == k, SHAPES[s](moved)).otherwise(form)
    return points(df, length).withColumn("value", form + noise * normal(seed, "series_id", "t"))


def motifs(df: DataFrame, length: int, size: int, shapes: list[str], discord: bool = False, **options) -> DataFrame:
    """A shape that occurs twice; or, for discords, many times but for one place of noise."""
    return planted(df, length, size, shapes, repeats=max(3, length // (2 * size)) if discord else 2, **options)


def led(spark: SparkSession, n: int, noise: float = 0.1, irrelevant: int = 17, seed: int | str = 0) -> DataFrame:
    """(rid, label, a1 .. a24): seven segments of a digit, each wrong with some probability, and attributes without meaning."""
    #: Segments of the digits 0 to 9, top to bottom. Fixed values.
    digits = ["1110111", "0010010", "1011101", "1011011", "0111010", "1101011", "1101111", "1010010", "1111111", "1111011"]
    label = F.floor(uniform(f"{seed}d", "id") * 10).cast("int")
    rows = spark.range(n).select(F.col("id").alias("rid"), label.alias("label"), F.get(F.array(*map(F.lit, digits)), label).alias("bits"))
    rid = F.col("rid")
    segment = lambda k: F.substring("bits", k + 1, 1).cast("int")
    cells = [F.when(uniform(f"{seed}n{k}", rid) < noise, 1 - segment(k)).otherwise(segment(k)).alias(f"a{k + 1}") for k in range(7)]
    more = [(uniform(f"{seed}i{k}", rid) < 0.5).cast("int").alias(f"a{k + 8}") for k in range(irrelevant)]
    return rows.select("rid", "label", *cells, *more)


def loans(spark: SparkSession, n: int, seed: int | str = 0) -> DataFrame:
    """(rid, salary, commission, age, elevel, loan, label): applicants, class 1 by a rule of age and salary."""
    u = lambda k: uniform(f"{seed}{k}", "id")
    rows = spark.range(n).select(F.col("id").alias("rid"), (20_000 + 130_000 * u("salary")).alias("salary"), (20 + F.floor(61 * u("age"))).alias("age"), F.floor(5 * u("elevel")).alias("elevel"), (500_000 * u("loan")).alias("loan"), (10_000 + 65_000 * u("commission")).alias("c"))
    rows = rows.withColumn("commission", F.when(F.col("salary") >= 75_000, 0.0).otherwise(F.col("c"))).drop("c")
    rule = F.when(F.col("age") < 40, F.col("salary").between(50_000, 100_000)).when(F.col("age") < 60, F.col("salary").between(75_000, 125_000)).otherwise(F.col("salary").between(25_000, 75_000))
    return rows.withColumn("label", rule.cast("int"))


def radial(spark: SparkSession, n: int, centres: int = 10, dimensions: int = 5, classes: int = 2, seed: int | str = 0) -> DataFrame:
    """(rid, label, v): rows spread normally, in a random direction, around random centres that have classes and widths."""
    import numpy as np

    rng = np.random.default_rng(abs(hash(str(seed))) % 2**32 if not isinstance(seed, int) else seed)
    at, width, label = rng.random((centres, dimensions)), rng.random(centres), rng.integers(0, classes, centres)
    pick = F.floor(uniform(f"{seed}c", "id") * centres).cast("int")
    numbers = lambda a: F.array(*[F.lit(float(x)) for x in a])
    centre = F.get(F.array(*[numbers(r) for r in at]), pick)
    off = F.array(*[normal(f"{seed}{d}", "id") for d in range(dimensions)])
    return spark.range(n).select(F.col("id").alias("rid"), F.get(F.array(*[F.lit(int(x)) for x in label]), pick).alias("label"), F.zip_with(centre, off, lambda c, x: c + x * F.get(numbers(width), pick) / math.sqrt(dimensions)).alias("v"))


def expression(spark: SparkSession, n: int, formula: str = "sin(a1) + a2^2", attributes: int = 2, noise: float = 0.1, seed: int | str = 0) -> DataFrame:
    """(rid, a1 .. an, target): a formula over uniform attributes, with noise."""
    from corvane.operators.columns import expression as parsed

    rows = spark.range(n).select(F.col("id").alias("rid"), *[uniform(f"{seed}a{k}", "id").alias(f"a{k + 1}") for k in range(attributes)])
    return rows.withColumn("target", parsed(formula, rows.columns[1:]) + noise * normal(f"{seed}e", "rid"))


def mexican_hat(spark: SparkSession, n: int, noise: float = 0.0, seed: int | str = 0) -> DataFrame:
    """(rid, x, y): y = sin |x| / |x| over -10 to 10."""
    rows = spark.range(n).select(F.col("id").alias("rid"), (20 * uniform(f"{seed}x", "id") - 10).alias("x"))
    return rows.withColumn("y", F.coalesce(F.try_divide(F.sin(F.abs("x")), F.abs("x")), F.lit(1.0)) + noise * normal(f"{seed}e", "rid"))


def grid_clusters(spark: SparkSession, n: int, side: int = 2, spacing: float = 4.0, sd: float = 1.0, seed: int | str = 0) -> DataFrame:
    """(rid, cluster, x, y): normal clusters on a square grid."""
    cluster = F.floor(uniform(f"{seed}c", "id") * side * side).cast("int")
    rows = spark.range(n).select(F.col("id").alias("rid"), cluster.alias("cluster"))
    return rows.select("rid", "cluster", (F.col("cluster") % side * spacing + sd * normal(f"{seed}x", "rid")).alias("x"), (F.floor(F.col("cluster") / side) * spacing + sd * normal(f"{seed}y", "rid")).alias("y"))


def subspace_clusters(spark: SparkSession, n: int, boxes: list[list[tuple[float, float]]], seed: int | str = 0) -> DataFrame:
    """(rid, cluster, v): uniform within the box of a random cluster, box by dimension."""
    cluster = F.floor(uniform(f"{seed}c", "id") * len(boxes)).cast("int")
    dims = range(len(boxes[0]))
    lo, hi = ([F.get(F.array(*[F.lit(float(b[d][k])) for b in boxes]), cluster) for d in dims] for k in (0, 1))
    return spark.range(n).select(F.col("id").alias("rid"), cluster.alias("cluster"), F.array(*[lo[d] + (hi[d] - lo[d]) * uniform(f"{seed}{d}", "id") for d in dims]).alias("v"))


def rule_data(spark: SparkSession, n: int, attributes: int = 6, rules: list[tuple[dict[int, int], int]] | None = None, seed: int | str = 0) -> DataFrame:
    """(rid, a1 .. an, label): binary attributes, the class of the first rule that holds, 0 by default."""
    rows = spark.range(n).select(F.col("id").alias("rid"), *[(uniform(f"{seed}{k}", "id") < 0.5).cast("int").alias(f"a{k + 1}") for k in range(attributes)])
    label = F.lit(0)
    for when, then in reversed(rules or [({1: 1, 2: 0}, 1), ({3: 1}, 2)]):
        holds = F.lit(True)
        for k, v in when.items():
            holds &= F.col(f"a{k}") == v
        label = F.when(holds, F.lit(then)).otherwise(label)
    return rows.withColumn("label", label)
