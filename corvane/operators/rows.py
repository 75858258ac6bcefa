"""Operators on rows: predicates, folds, samples. Rows have a key column that orders them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.ordering import fraction, hashed, positions, shuffled


def present(x: Column) -> Column:
    """x, with NaN as null."""
    return F.when(~F.isnan(x), x) if x is not None else x


def drop_missing(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def numbered(df: DataFrame, key: str, name: str = "rid") -> DataFrame:
    """Rows numbered from 0 in the order of a numeric key."""
    return positions(df, [F.col(key)], F.col(key), name=name)


def without(df: DataFrame, rid: str, *drop: int) -> DataFrame:
    return df.where(~F.col(rid).isin(list(drop)))


def selected(spec: str, size: int) -> list[int]:
    """0-based positions of a range list such as ``first-3,5,last``, in its order."""
    number = {"first": 1, "last": size}
    out: list[int] = []
    for part in spec.replace(" ", "").split(","):
        a, _, b = part.partition("-")
        lo, hi = (number.get(x) or int(x) for x in (a, b or a))
        if not 1 <= lo <= hi <= size:
            raise ValueError(f"range {part!r} is not within 1 to {size}")
        out += range(lo - 1, hi)
    return out


def columns_in(df: DataFrame, spec: str, invert: bool = False) -> list[str]:
    """Names of the columns of a range list; inverted: of all others, in the table's order."""
    at = selected(spec, len(df.columns))
    return [c for i, c in enumerate(df.columns) if i not in at] if invert else [df.columns[i] for i in at]


def kth_smallest(df: DataFrame, column: str, key: str, k: int) -> DataFrame:
    """The k-th smallest value (from 1); missing values come last."""
    order = [F.col(column).asc_nulls_last(), F.col(key)]
    return positions(df, order, F.col(column)).where(F.col("position") == k - 1).select(column)


def mean_or_mode(df: DataFrame, column: str, weight: Column | None = None) -> DataFrame:
    """Weighted mean of a numeric column (0 if all is missing), weighted mode of another (ties to the smaller)."""
    w = F.lit(1.0) if weight is None else weight
    if df.schema[column].dataType.typeName() == "string":
        votes = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum(w).alias("w"))
        return votes.orderBy(F.desc("w"), column).limit(1).select(F.col(column).alias("value"))
    x = F.col(column)
    return df.agg(F.coalesce(F.try_divide(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))), F.lit(0.0)).alias("value"))


def weighted_variance(df: DataFrame, column: str, weight: str) -> DataFrame:
    """Sample variance with weights: (sum w x^2 - (sum w x)^2 / sum w) / (sum w - 1); null for a weight sum of 1 or less."""
    x, w = F.col(column), F.when(F.col(column).isNotNull(), F.col(weight))
    s, s1, s2 = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    return df.agg(F.when(s > 1, F.greatest(F.lit(0.0), s2 - s1 * s1 / s) / (s - 1)).alias("value"))


def sum_of_weights(df: DataFrame, weight: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("value"))


def contiguous_folds(df: DataFrame, key: str, folds: int, name: str = "fold") -> DataFrame:
    """Folds of neighbouring rows in the key's order; the first n mod folds of them have one row more."""
    rows = numbered(df, key, "__rid")
    n = df.agg(F.count("*").alias("__n"))  # one row
    small, more = F.floor(F.col("__n") / folds), F.col("__n") % folds
    first = F.floor(F.col("__rid") / (small + 1))
    fold = F.when(F.col("__rid") < more * (small + 1), first).otherwise(more + F.floor((F.col("__rid") - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return rows.join(F.broadcast(n)).withColumn(name, fold.cast("long")).select(*df.columns, name)


def stratified_folds(df: DataFrame, key: str, group: str, folds: int, seed: int | str = 0, name: str = "fold") -> DataFrame:
    """Folds that each class is dealt over in turn, in the order of a seeded hash of the key."""
    return shuffled(df, seed, key, [group], name).withColumn(name, F.col(name) % folds)


def stratified_split(df: DataFrame, key: str, group: str, proportion: float, seed: int | str = 0, name: str = "train") -> DataFrame:
    """A boolean: floor(proportion * size) rows of each class, in the order of a seeded hash."""
    sizes = df.groupBy(F.col(group).alias("__group")).agg(F.floor(F.count("*") * proportion).alias("__train"))
    rows = shuffled(df, seed, key, [group], "__at").join(sizes, F.col(group).eqNullSafe(F.col("__group")))
    return rows.withColumn(name, F.col("__at") < F.col("__train")).select(*df.columns, name)


def resplit(train: DataFrame, test: DataFrame, key: str, group: str, seed: int) -> DataFrame:
    """Train and test pooled and dealt anew, each class with as many training rows as before; seed 0 leaves the split as it is."""
    pool = train.withColumn("train", F.lit(True)).union(test.withColumn("train", F.lit(False)))
    if seed == 0:
        return pool
    sizes = train.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__train"))
    rows = shuffled(pool.drop("train"), seed, key, [group], "__at").join(sizes, F.col(group).eqNullSafe(F.col("__group")), "left")
    return rows.withColumn("train", F.col("__at") < F.coalesce("__train", F.lit(0))).select(*train.columns, "train")


def leave_one_out(df: DataFrame, column: str, fold: int, name: str = "train") -> DataFrame:
    """Test rows: those of the fold-th value of a column, by its order; the values' ranks come from one row each."""
    values = df.select(F.col(column).alias("__value")).distinct()
    ranked = values.withColumn("__rank", F.row_number().over(Window.orderBy("__value")) - 1)
    return df.join(ranked, F.col(column).eqNullSafe(F.col("__value"))).withColumn(name, F.col("__rank") != fold).select(*df.columns, name)


def bootstrap(df: DataFrame, key: str, seed: int | str = 0, draws: DataFrame | None = None) -> DataFrame:
    """As many rows as df has, drawn with replacement: draw i takes the row at floor(u(seed, i) * n).

    The draws are a table of their own (a row for each row of df), joined on the position.
    """
    rows = numbered(df, key, "__rid")
    n = df.count()
    draw = F.floor(fraction(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))) * n).cast("long")
    picks = df.sparkSession.range(n).select(F.col("id").alias("draw"), draw.alias("__pick"))
    return picks.join(rows, F.col("__pick") == F.col("__rid")).select("draw", *df.columns)


def weighted_bootstrap(df: DataFrame, key: str, weight: str, seed: int | str = 0, parts: int = 64) -> DataFrame:
    """n draws with replacement in proportion to the weight: draw i lands where the running sum of weights passes u(seed, i) of the total.

    Running sums are made range by range of the key; ranges, not rows, are told to the draws.
    """
    from corvane.operators.ordering import ranges

    ranged = df.withColumn("__range", ranges(df, F.col(key), parts))
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    sums = ranged.groupBy("__range").agg(F.sum(w).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__lo", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)))  # a row for each range
    n, total = df.count(), sums.agg(F.sum("__sum")).first()[0] or 0.0
    inner = Window.partitionBy("__range").orderBy(key)
    rows = ranged.withColumn("__hi", F.sum(w).over(inner)).withColumn("__from", F.coalesce(F.lag("__hi").over(inner), F.lit(0.0)))
    u = fraction(F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string")))) * total
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), u.alias("__u"))
    placed = draws.join(F.broadcast(sums), (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__lo") + F.col("__sum"))).select("draw", "__range", (F.col("__u") - F.col("__lo")).alias("__at"))
    hit = placed.join(rows, "__range").where((F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__hi")))
    return hit.select("draw", *df.columns)


def sample(df: DataFrame, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """n rows without replacement: those of least seeded hash; each task sends n rows at most."""
    return df.withColumn("__u", hashed(seed, key)).orderBy("__u", key).limit(n).drop("__u")


def sample_fraction(df: DataFrame, key: str, share: float, seed: int | str = 0, invert: bool = False) -> DataFrame:
    """floor(share * n) rows of least seeded hash, or the others."""
    rows = shuffled(df, seed, key, name="__at")
    some = F.col("__at") < F.floor(F.lit(share) * df.count())
    return rows.where(~some if invert else some).select(*df.columns)


def sample_by_class(df: DataFrame, key: str, group: str, share: float, seed: int | str = 0) -> DataFrame:
    return stratified_split(df, key, group, share, seed, "__in").where("__in").drop("__in")


def spread(df: DataFrame, key: str, group: str, ratio: float, seed: int | str = 0) -> DataFrame:
    """At most ratio times the rarest class's rows of each class."""
    least = df.groupBy(group).count().agg(F.floor(F.min("count") * ratio).alias("__most"))  # one row
    return shuffled(df, seed, key, [group], "__at").join(F.broadcast(least)).where("__at < __most").select(*df.columns)


def resample_to_uniform(df: DataFrame, key: str, group: str, size: float, bias: float, seed: int | str = 0) -> DataFrame:
    """size * n rows without replacement, the classes' shares moved by bias (0: as they are, 1: equal); a class gives all it has at most."""
    counts = df.groupBy(F.col(group).alias("__group")).agg(F.count("*").alias("__n"))
    whole = counts.agg(F.sum("__n").alias("__all"), F.count("*").alias("__classes"))  # one row
    quota = F.floor(F.lit(size) * ((1 - bias) * F.col("__n") + bias * F.col("__all") / F.col("__classes")))
    quotas = counts.join(F.broadcast(whole)).select("__group", quota.alias("__quota"))
    rows = shuffled(df, seed, key, [group], "__at").join(quotas, F.col(group).eqNullSafe(F.col("__group")))
    return rows.where("__at < __quota").select(*df.columns)


def round_robin(df: DataFrame, key: str, group: str, seed: int | str = 0, name: str = "turn") -> DataFrame:
    """The classes' rows in turn: a row's turn is its place in its class's seeded order."""
    return shuffled(df, seed, key, [group], name)


def with_values(df: DataFrame, column: str, keep: list | None = None, split: float | None = None, invert: bool = False, match_missing: bool = False) -> DataFrame:
    """Rows by the value of one column: of a list, or under a split (inverted: not of it, at least it); missing ones stay unless match_missing."""
    good = F.col(column).isin(keep) if keep is not None else F.col(column) < F.lit(split)
    good = ~good if invert else good
    return df.where(F.coalesce(good, F.lit(not match_missing)))


def drop_share(df: DataFrame, key: str, share: float = 0.5, invert: bool = False) -> DataFrame:
    """All but the first round(share * n) rows by key, or only those."""
    rows = numbered(df, key, "__rid")
    first = F.col("__rid") < int(df.count() * share + 0.5)
    return rows.where(first if invert else ~first).select(*df.columns)


def frequent(df: DataFrame, column: str, k: int = 2, least: bool = False) -> DataFrame:
    """Rows of the k most (or least) frequent values; ties to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).count()
    top = counts.orderBy(F.col("count").asc() if least else F.col("count").desc(), column).limit(k).select(column)
    return df.join(top, column, "left_semi")


def duplicates_removed(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropDuplicates(list(columns) or None)


def zipped(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """Two tables of equal length side by side, by position in their keys' orders."""
    if a.count() != b.count():
        raise ValueError("the tables differ in length")
    x, y = numbered(a, key_a, "__rid"), numbered(b, key_b, "__other")
    return x.join(y, F.col("__rid") == F.col("__other")).drop("__rid", "__other")


def header_difference(a: DataFrame, b: DataFrame) -> str:
    """Why two tables' headers differ; empty if they don't."""
    if len(a.schema) != len(b.schema):
        return f"different number of columns: {len(a.schema)} and {len(b.schema)}"
    for i, (x, y) in enumerate(zip(a.schema, b.schema, strict=True), 1):
        if x.name != y.name:
            return f"names differ at column {i}: {x.name} and {y.name}"
        if x.dataType != y.dataType:
            return f"types differ at column {i} ({x.name}): {x.dataType.simpleString()} and {y.dataType.simpleString()}"
    return ""


def moved(df: DataFrame, order: str, columns: list[str], by: int = -1, difference: bool = False, fill: bool = True, group: list[str] | None = None) -> DataFrame:
    """Columns replaced by their values by rows away (negative: before), or by the difference to them.

    Rows without such a neighbour get null, or go if not fill. Without a group the
    neighbours come from a join on positions, so no window takes the whole table.
    """
    if group:
        window = Window.partitionBy(*group).orderBy(order)
        there = {c: F.lag(c, -by).over(window) if by < 0 else F.lead(c, by).over(window) for c in columns}
        has = (F.lag(F.lit(1), -by) if by < 0 else F.lead(F.lit(1), by)).over(window)
        rows = df.select("*", *[v.alias(f"__{c}") for c, v in there.items()], has.alias("__has"))
    else:
        rows = numbered(df, order, "__rid")
        other = rows.select((F.col("__rid") - by).alias("__at"), F.lit(1).alias("__has"), *[F.col(c).alias(f"__{c}") for c in columns])
        rows = rows.join(other, F.col("__rid") == F.col("__at"), "left")
    rows = rows if fill else rows.where("__has is not null")
    return rows.select(*[(F.col(c) - F.col(f"__{c}") if difference else F.col(f"__{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def reservoir(df: DataFrame, key: str, k: int = 100, seed: int | str = 0) -> DataFrame:
    """A uniform sample of k rows in one pass: as ``sample``, whose top k merges over partitions."""
    return sample(df, key, k, seed)


def smote(df: DataFrame, key: str, group: str, minority: str, vector: str, k: int = 5, percent: int = 100, seed: int | str = 0) -> DataFrame:
    """Synthetic rows (key, copy, vector) of a class: each row moved a random share towards one of its k nearest of the class."""
    from corvane.operators.distances import nearest

    own = df.where(F.col(group) == minority).select(F.col(key).alias("id"), F.col(vector).alias("s"))
    near = nearest(own, own, k)
    hits = near.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "c"))).alias("hits"))
    copies = hits.select("q", "hits", F.explode(F.sequence(F.lit(0), F.lit(percent // 100 - 1))).alias("copy"))
    draw = fraction(F.md5(F.concat_ws("-", F.lit(str(seed)), "q", "copy")))
    pick = copies.select("q", "copy", F.element_at("hits", F.floor(draw * F.size("hits")).cast("int") + 1)["c"].alias("c"), fraction(F.md5(F.concat_ws("-", F.lit(f"{seed}+"), "q", "copy"))).alias("share"))
    rows = pick.join(own.select(F.col("id").alias("q"), F.col("s").alias("a")), "q").join(own.select(F.col("id").alias("c"), F.col("s").alias("b")), "c")
    mixed = F.transform(F.arrays_zip("a", "b"), lambda x: x["a"] + F.col("share") * (x["b"] - x["a"]))
    return rows.select(F.col("q").alias(key), "copy", mixed.alias(vector))


def union_all(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
