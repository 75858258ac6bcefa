"""Column filters: selecting, recoding, scaling, imputing, discretising.

What a filter learns is a bounded row of statistics: fit on one table, it is a
function that projects any other (``fitted = standardize(train, cols); fitted(test)``).
Missing values are null and stay null, unless a filter is there to replace them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators.ordering import fraction

Filter = Callable[[DataFrame], DataFrame]
NUMERIC = (T.NumericType,)


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def chain(*filters: Filter) -> Filter:
    """One after the other."""
    return lambda df: reduce(lambda d, f: f(d), filters, df)


def keep_all(df: DataFrame) -> DataFrame:
    return df


def drop_all(df: DataFrame) -> DataFrame:
    return df.limit(0)


def remove_by_name(df: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    return df.select([c for c in df.columns if bool(re.fullmatch(pattern, c)) == invert])


def remove_by_type(df: DataFrame, kind: type, invert: bool = False) -> DataFrame:
    return df.select([f.name for f in df.schema if isinstance(f.dataType, kind) == invert])


def has_type(df: DataFrame, kind: type) -> bool:
    return any(isinstance(f.dataType, kind) for f in df.schema)


def remove_useless(train: DataFrame, most_distinct: float = 0.99) -> Filter:
    """Drops constant columns, and strings of which more than a share of the values is distinct."""
    told = train.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(train.columns)]).first()
    drop = [c for i, c in enumerate(train.columns) if told[f"d_{i}"] <= 1 or not is_numeric(train, c) and told[f"d_{i}"] > most_distinct * told["n"]]
    return lambda df: df.drop(*drop)


def remove_constant(train: DataFrame, columns: list[str]) -> Filter:
    told = train.agg(*[(F.min(c) == F.max(c)).alias(c) for c in columns]).first()
    return lambda df: df.drop(*[c for c in columns if told[c]])


def remove_redundant(train: DataFrame, columns: list[str]) -> Filter:
    """Drops constant columns and those equal to an earlier one in every row."""
    pairs = [(a, b) for i, b in enumerate(columns) for a in columns[:i]]
    same = [F.min(F.col(a).eqNullSafe(F.col(b)).cast("int")).alias(f"{i}") for i, (a, b) in enumerate(pairs)]
    told = train.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"c_{c}") for c in columns], *same).first()
    drop = {c for c in columns if told[f"c_{c}"]} | {b for i, (_, b) in enumerate(pairs) if told[f"{i}"] == 1}
    return lambda df: df.drop(*drop)


def add_column(df: DataFrame, name: str, kind: str, at: int | None = None, value: object = None) -> DataFrame:
    """df with a column of one value (missing by default), at a 0-based place."""
    columns: list = [F.col(f"`{c}`") for c in df.columns]
    columns.insert(len(columns) if at is None else at, F.lit(value).cast(kind).alias(name))
    return df.select(columns)


def rename_matching(df: DataFrame, pattern: str, by: str) -> DataFrame:
    return df.toDF(*[re.sub(pattern, by, c) for c in df.columns])


def copied(df: DataFrame, columns: list[str], prefix: str = "copy_of_") -> DataFrame:
    return df.select("*", *[F.col(c).alias(prefix + c) for c in columns])


FUNCTIONS = {"abs": F.abs, "cos": F.cos, "exp": F.exp, "log": F.ln, "sqrt": F.sqrt, "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "tan": F.tan, "sin": F.sin}


def expression(text: str, columns: list[str]) -> Column:
    """A column from arithmetic over a1 to an: + - * / ^, unary minus, parentheses, and FUNCTIONS. Division by zero gives null."""
    tokens = re.findall(r"\d+\.?\d*(?:[eE][+-]?\d+)?|[A-Za-z]+\d*|[-+*/^()]", text)
    if "".join(tokens) != re.sub(r"\s", "", text):
        raise ValueError(f"cannot read {text!r}")
    power = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 4}
    at = 0

    def take() -> str:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"{text!r} ends too early")
        at += 1
        return tokens[at - 1]

    def close() -> None:
        if take() != ")":
            raise ValueError(f"a parenthesis of {text!r} is not closed")

    def atom() -> Column:
        t = take()
        if t == "-":
            return -parse(3)
        if t == "(":
            out = parse(0)
            close()
            return out
        if t in FUNCTIONS:
            if take() != "(":
                raise ValueError(f"{t} needs an argument")
            out = parse(0)
            close()
            return FUNCTIONS[t](out).cast("double")
        if m := re.fullmatch(r"a(\d+)", t):
            return F.col(columns[int(m[1]) - 1]).cast("double")
        return F.lit(float(t))

    def parse(least: int) -> Column:
        left = atom()
        while at < len(tokens) and tokens[at] in power and power[tokens[at]] > least:
            op = take()
            right = parse(power[op])
            left = {"+": lambda: left + right, "-": lambda: left - right, "*": lambda: left * right, "/": lambda: F.try_divide(left, right), "^": lambda: F.pow(left, right)}[op]()  # noqa: B023
        return left

    out = parse(0)
    if at < len(tokens):
        raise ValueError(f"{tokens[at]!r} is left over in {text!r}")
    return out


def add_expression(df: DataFrame, text: str = "a1^2", name: str = "expression") -> DataFrame:
    return df.withColumn(name, expression(text, df.columns))


def _stats(train: DataFrame, columns: list[str], **wanted: Callable[[str], Column]) -> dict[str, dict]:
    """{column: {statistic: value}} from one aggregation; a row on the driver."""
    row = train.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in wanted.items()]).first()
    return {c: {k: row[f"{k}_{i}"] for k in wanted} for i, c in enumerate(columns)}


def _mapped(columns: dict[str, Callable[[Column], Column]]) -> Filter:
    return lambda df: df.select([columns[c](F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def center(train: DataFrame, columns: list[str]) -> Filter:
    told = _stats(train, columns, m=F.avg)
    return _mapped({c: (lambda x, s=told[c]: x - F.lit(s["m"])) for c in columns})


def standardize(train: DataFrame, columns: list[str]) -> Filter:
    """By mean and sample deviation; a column without spread is centred only."""
    told = _stats(train, columns, m=F.avg, sd=F.stddev_samp)
    return _mapped({c: (lambda x, s=told[c]: (x - F.lit(s["m"])) / F.lit(s["sd"] or 1.0)) for c in columns})


def normalize(train: DataFrame, columns: list[str], scale: float = 1.0, shift: float = 0.0) -> Filter:
    """To shift .. shift + scale by minimum and maximum; a constant column is the shift."""
    told = _stats(train, columns, lo=F.min, hi=F.max)

    def of(s: dict) -> Callable[[Column], Column]:
        if s["lo"] is None or s["hi"] == s["lo"]:
            return lambda x: F.when(x.isNotNull(), F.lit(float(shift)))
        return lambda x: (x - F.lit(s["lo"])) / F.lit(float(s["hi"] - s["lo"])) * scale + shift

    return _mapped({c: of(told[c]) for c in columns})


def unit_rows(df: DataFrame, columns: list[str], norm: float = 1.0, power: float = 2.0) -> DataFrame:
    """Rows scaled to an L-p norm; rows of norm 0 stay."""
    size = F.pow(sum((F.pow(F.abs(F.col(c)), F.lit(power)) for c in columns), F.lit(0.0)), F.lit(1 / power))
    return df.select([F.when(size > 0, F.col(c) * norm / size).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def cuts_equal_width(train: DataFrame, column: str, bins: int = 10) -> list[float]:
    lo, hi = train.agg(F.min(column), F.max(column)).first()
    return [] if lo is None or hi == lo else [float(lo + (hi - lo) / bins * i) for i in range(1, bins)]


def cuts_equal_frequency(train: DataFrame, column: str, bins: int = 10) -> list[float]:
    """Cuts midway between neighbouring distinct values, so that each bin gets close to its share of what is left.

    Runs over the counts of the distinct values; at most ``DISTINCT`` of them are
    told to the driver, more are first merged into so many quantile ranges.
    """
    counts = _value_counts(train, column)
    n, cuts, inside, left_bins = sum(c for _, c in counts), [], 0, bins
    for (value, count), (after, _) in zip(counts, counts[1:]):
        share = n / left_bins
        inside += count
        if left_bins > 1 and inside >= share - 1e-9:
            cuts.append((value + after) / 2)
            n, inside, left_bins = n - inside, 0, left_bins - 1
    return cuts


#: Distinct values of a column that a discretiser takes as they are.
DISTINCT = 100_000


def _value_counts(train: DataFrame, column: str) -> list[tuple[float, int]]:
    x = F.col(column).cast("double")
    known = train.where(x.isNotNull())
    if known.agg(F.approx_count_distinct(column)).first()[0] > DISTINCT:
        bounds = sorted(set(known.approxQuantile(column, [k / 10_000 for k in range(10_001)], 1e-5)))
        edges = F.array(*map(F.lit, bounds))
        x = F.element_at(edges, F.greatest(F.lit(1), F.size(F.filter(edges, lambda b: b <= F.col(column)))))
    return [(r["v"], r["n"]) for r in known.groupBy(x.alias("v")).agg(F.count("*").alias("n")).orderBy("v").collect()]


def cuts_by_class(train: DataFrame, column: str, label: str) -> list[float]:
    """Cuts of least class entropy while the description length allows them (Fayyad and Irani 1993), over counts of distinct values and classes."""
    rows = train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v"), label).count().orderBy("v").collect()
    values = sorted({r["v"] for r in rows})
    classes = sorted({str(r[label]) for r in rows})
    counts = np.zeros((len(values), len(classes)))
    place = {v: i for i, v in enumerate(values)}
    for r in rows:
        counts[place[r["v"]], classes.index(str(r[label]))] = r["count"]

    def entropy(c: np.ndarray) -> np.ndarray:
        n = c.sum(-1, keepdims=True)
        p = np.divide(c, n, out=np.zeros_like(c), where=n > 0)
        return -(p * np.log2(np.where(p > 0, p, 1))).sum(-1)

    cuts: list[float] = []

    def split(lo: int, hi: int) -> None:
        part = counts[lo:hi]
        n = part.sum()
        if hi - lo < 2:
            return
        left = np.cumsum(part, 0)[:-1]
        right = part.sum(0) - left
        weighted = (left.sum(1) * entropy(left) + right.sum(1) * entropy(right)) / n
        k = int(np.argmin(weighted))
        whole = part.sum(0)
        kinds = [(c > 0).sum() for c in (whole, left[k], right[k])]
        spent = np.log2(3.0 ** kinds[0] - 2) - (kinds[0] * entropy(whole) - kinds[1] * entropy(left[k]) - kinds[2] * entropy(right[k]))
        if entropy(whole) - weighted[k] <= (np.log2(n - 1) + spent) / n:
            return
        cuts.append((values[lo + k] + values[lo + k + 1]) / 2)
        split(lo, lo + k + 1)
        split(lo + k + 1, hi)

    split(0, len(values))
    return sorted(cuts)


def binned(x: Column, cuts: list[float]) -> Column:
    """The number of cuts under x; a value on a cut belongs to the bin before."""
    return F.when(x.isNotNull(), sum(((x > F.lit(c)).cast("long") for c in cuts), F.lit(0).cast("long")))


def discretize(train: DataFrame, columns: list[str], bins: int = 10, equal_frequency: bool = False) -> Filter:
    find = cuts_equal_frequency if equal_frequency else cuts_equal_width
    cuts = {c: find(train, c, bins) for c in columns}
    return _mapped({c: (lambda x, k=cuts[c]: binned(x, k)) for c in columns})


def discretize_by_class(train: DataFrame, columns: list[str], label: str) -> Filter:
    cuts = {c: cuts_by_class(train, c, label) for c in columns}
    return _mapped({c: (lambda x, k=cuts[c]: binned(x, k)) for c in columns})


def discretize_by_root(train: DataFrame, columns: list[str]) -> Filter:
    """Equal frequency with as many bins as the square root of the known values."""
    told = _stats(train, columns, n=F.count)
    cuts = {c: cuts_equal_frequency(train, c, max(1, int(math.sqrt(told[c]["n"])))) for c in columns}
    return _mapped({c: (lambda x, k=cuts[c]: binned(x, k)) for c in columns})


def to_binary(x: Column) -> Column:
    return F.when(x.isNotNull(), (x != 0).cast("int"))


def clean_number(x: Column, least: float | None = None, least_by: float | None = None, most: float | None = None, most_by: float | None = None, near: float | None = None, near_by: float | None = None, tolerance: float = 1e-6, decimals: int = -1) -> Column:
    """x with values under least, over most, or within tolerance of near replaced, then rounded."""
    out = x
    if least is not None:
        out = F.when(out < least, F.lit(least_by if least_by is not None else least)).otherwise(out)
    if most is not None:
        out = F.when(out > most, F.lit(most_by if most_by is not None else most)).otherwise(out)
    if near is not None:
        out = F.when(F.abs(out - near) < tolerance, F.lit(near_by if near_by is not None else near)).otherwise(out)
    return F.round(out, decimals) if decimals >= 0 else out


def outliers(train: DataFrame, column: str, outlier: float = 3.0, extreme: float = 6.0) -> Filter:
    """Adds outlier and extreme flags: beyond the quartiles by so many times their distance. Extreme values are no outliers."""
    q1, q3 = train.agg(F.expr(f"percentile({column}, 0.25)"), F.expr(f"percentile({column}, 0.75)")).first()
    x = F.col(column)
    if q1 is None:
        return lambda df: df.select("*", F.lit(False).alias("outlier"), F.lit(False).alias("extreme"))
    far = lambda k: F.coalesce((x > q3 + k * (q3 - q1)) | (x < q1 - k * (q3 - q1)), F.lit(False))
    return lambda df: df.select("*", (far(outlier) & ~far(extreme)).alias("outlier"), far(extreme).alias("extreme"))


def replace_missing(train: DataFrame, columns: list[str]) -> Filter:
    """Means of numbers, most frequent values of others (ties to the smaller)."""
    numbers = [c for c in columns if is_numeric(train, c)]
    known = {c: s["m"] for c, s in _stats(train, numbers, m=F.avg).items()} if numbers else {}
    for c in set(columns) - set(numbers):
        top = train.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c).limit(1).collect()
        known[c] = top[0][c] if top else None
    return _mapped({c: (lambda x, v=known[c]: F.coalesce(x, F.lit(v))) for c in columns})


def replace_missing_by(df: DataFrame, values: dict[str, object]) -> DataFrame:
    return df.fillna(values)


def one_hot(train: DataFrame, column: str, labels: list | None = None) -> Filter:
    """A 0/1 column for each label, in order; of two labels one column, for the second."""
    found = sorted(r[0] for r in train.where(F.col(column).isNotNull()).select(column).distinct().collect()) if labels is None else labels
    kept = found[1:] if len(found) == 2 and labels is None else found
    return lambda df: df.select("*", *[(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in kept])


def by_target_mean(train: DataFrame, column: str, target: str) -> Filter:
    """Supervised one-hot: labels in the order of their mean target; column k says whether a row's label is beyond the k-th."""
    order = [r[column] for r in train.groupBy(column).agg(F.avg(target).alias("m")).orderBy("m", column).collect()]
    return lambda df: df.select("*", *[F.col(column).isin(order[k:]).cast("int").alias(f"{column}_{k}") for k in range(1, len(order))])


def indicator(df: DataFrame, column: str, values: list, name: str) -> DataFrame:
    return df.withColumn(name, F.col(column).isin(values).cast("int"))


def merge_labels(x: Column, labels: list, by: str) -> Column:
    return F.when(x.isin(labels), F.lit(by)).otherwise(x)


def merge_rare(train: DataFrame, column: str, least: int, by: str = "other") -> Filter:
    """Labels of fewer than so many rows become one."""
    kept = train.groupBy(column).count().where(F.col("count") >= least).select(F.col(column).alias("__kept"))
    return lambda df: df.join(kept, F.col(column) == F.col("__kept"), "left").withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("__kept", F.lit(by)))).drop("__kept")


def swap_labels(x: Column, a: str, b: str) -> Column:
    return F.when(x == a, F.lit(b)).when(x == b, F.lit(a)).otherwise(x)


def relabelled(train: DataFrame, column: str, by: str = "frequency", name: str | None = None) -> Filter:
    """Labels by their number from 0, in the order of frequency (ties by label) or of the labels themselves."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).count()
    order = [r[column] for r in (counts.orderBy(F.desc("count"), column) if by == "frequency" else counts.orderBy(column)).collect()]
    number = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)]) if order else F.create_map()
    return lambda df: df.withColumn(name or column, F.try_element_at(number, F.col(column)).cast("long"))


def noisy_labels(df: DataFrame, column: str, key: str, labels: list, share: float, seed: int | str = 0) -> DataFrame:
    """A share of the rows, by a seeded hash, get the label that follows theirs in the list."""
    following = F.create_map(*[F.lit(x) for a, b in zip(labels, labels[1:] + labels[:1]) for x in (a, b)])
    u = fraction(F.md5(F.concat_ws("-", F.lit(str(seed)), key)))
    return df.withColumn(column, F.when(u < share, F.try_element_at(following, F.col(column))).otherwise(F.col(column)))


def random_subset(df: DataFrame, columns: list[str], n: int, seed: int | str = 0) -> DataFrame:
    """n of the columns, those of least seeded hash, in the table's order; all other columns stay."""
    import hashlib

    kept = set(sorted(columns, key=lambda c: hashlib.md5(f"{seed}-{c}".encode()).hexdigest())[:n])
    return df.select([c for c in df.columns if c not in columns or c in kept])


def random_projection(df: DataFrame, vector: str, dimensions: int, size: int, seed: int = 0, sparse: bool = True, name: str = "projected") -> DataFrame:
    """A vector times a random matrix: of sqrt(3) times -1, 0, 0, 0, 0, 1 (sparse) or of normal entries; the matrix is size x dimensions numbers."""
    rng = np.random.default_rng(seed)
    matrix = rng.choice(np.sqrt(3) * np.array([-1, 0, 0, 0, 0, 1]), (dimensions, size)) if sparse else rng.normal(size=(dimensions, size))
    row = lambda r: F.array(*[F.lit(float(x)) for x in r])
    dot = lambda r: F.aggregate(F.zip_with(vector, row(r), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    return df.withColumn(name, F.array(*[dot(r) for r in matrix]))


def principal_components(train: DataFrame, vector: str, size: int, kept: int | None = None, variance: float = 0.95) -> Filter:
    """Scores on the components of the covariance that explain a share of the variance, signed so that each component's largest entry is positive.

    One pass of partial sums over the rows (size x size numbers a task), one eigendecomposition on the driver.
    """
    import pyarrow as pa

    def sums(batches):
        n, s, c = 0, np.zeros(size), np.zeros((size, size))
        for b in batches:
            x = np.array([v for v in b.column(0).to_pylist() if v is not None], float).reshape(-1, size)
            n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([c.ravel().tolist()])], ["n", "s", "c"])

    parts = train.select(vector).mapInArrow(sums, "n long, s array<double>, c array<double>")
    n, total, cross = 0, np.zeros(size), np.zeros((size, size))
    for r in parts.toLocalIterator():
        n, total, cross = n + r["n"], total + np.array(r["s"]), cross + np.array(r["c"]).reshape(size, size)
    mean = total / max(n, 1)
    values, vectors = np.linalg.eigh(cross / max(n - 1, 1) - np.outer(mean, mean) * n / max(n - 1, 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(size)])
    k = kept or int(np.searchsorted(np.cumsum(values) / values.sum(), variance) + 1)
    numbers = lambda r: F.array(*[F.lit(float(x)) for x in r])
    centred = F.zip_with(vector, numbers(mean), lambda x, m: x - m)
    score = lambda v: F.aggregate(F.zip_with(centred, numbers(v), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x)
    return lambda df: df.withColumn("scores", F.array(*[score(vectors[:, j]) for j in range(k)]))


def relaggs(df: DataFrame, key: str, numbers: list[str], labels: dict[str, list], most: int = 20) -> DataFrame:
    """A row for each key: minimum, maximum, mean, sample deviation and sum of numbers; counts of each label of up to ``most`` labels."""
    aggs = [f(c).alias(f"{c}_{n}") for c in numbers for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("stdev", F.stddev_samp), ("sum", F.sum))]
    aggs += [F.sum((F.col(c) == v).cast("long")).alias(f"{c}_{v}_cnt") for c, vs in labels.items() if len(vs) <= most for v in vs]
    return df.groupBy(key).agg(*aggs)


def unnested(df: DataFrame, bag: str, weighted: bool = True) -> DataFrame:
    """A row for each element of a bag; weights of a bag's rows add up to 1."""
    rows = df.withColumn("__size", F.size(bag)).withColumn(bag, F.explode(bag))
    return rows.withColumn("weight", 1 / F.col("__size") if weighted else F.lit(1.0)).drop("__size")


def nested(df: DataFrame, key: str, columns: list[str], name: str = "bag") -> DataFrame:
    """A row for each key with its rows as a sorted bag; bags are as large as their keys' rows."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def obfuscated(df: DataFrame) -> DataFrame:
    return df.toDF(*[f"A{i + 1}" for i in range(len(df.columns))])


def date_reduced(x: Column, fmt: str) -> Column:
    return F.date_format(x, fmt)


def tokens(text: Column, delimiters: str = r"[ \r\n\t.,;:'\"()?!]+") -> Column:
    return F.filter(F.split(text, delimiters), lambda w: w != "")


def alphabetic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("[A-Za-z]+"), 0)


def ngrams(words: Column, least: int = 1, most: int = 3) -> Column:
    """Runs of neighbouring words, long ones first."""

    def of(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[of(n) for n in range(most, least - 1, -1)])


#: Very common English words. Fixed values.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with"]


def without_stopwords(words: Column, stop: list[str] | None = None) -> Column:
    return F.array_except(words, F.array(*map(F.lit, stop or STOPWORDS)))


def with_prefix(df: DataFrame, column: str, prefixes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Rows whose value starts with any of the prefixes: a join on the value's own prefixes, of the lengths that occur."""
    lengths = [r[0] for r in prefixes.select(F.length(prefix)).distinct().collect()]
    heads = F.array_distinct(F.array(*[F.substring(column, 1, n) for n in sorted(lengths)])) if lengths else F.array().cast("array<string>")
    hits = df.withColumn("__head", F.explode(heads)).join(prefixes.select(F.col(prefix).alias("__head")).distinct(), "__head", "left_semi")
    return hits.drop("__head").distinct()


def ranked_labels(df: DataFrame, column: str) -> DataFrame:
    """The labels of a column with their numbers, sorted; a row for each label."""
    return df.select(column).distinct().withColumn("label_idx", (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))
