"""Queries over the reference's own operators, with their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators import batch as B
from corvane.operators import distances as D
from corvane.operators import elastic
from corvane.operators import evaluation as E
from corvane.operators import series as S
from corvane.operators import table as T
from corvane.registry import QUERIES, SQL, Query, instances, query, read

BASE = """WITH raw AS (SELECT vec_id AS series_id, label, [CAST(x AS DOUBLE) for x in embedding] AS s FROM embeddings),
centred AS (SELECT *, list_avg(s) AS m FROM raw), spread AS (SELECT *, list_avg([(x - m) * (x - m) for x in s]) AS var FROM centred),
b AS (SELECT *, [CASE WHEN var < 1e-6 THEN 0.0 ELSE (x - m) / sqrt(var) END for x in s] AS z FROM spread)"""
MEAN, VAR, Z = "m", "var", "z"


def _long(df: DataFrame) -> DataFrame:
    return df.select("series_id", F.posexplode("v").alias("t", "x")).select("series_id", F.col("t").cast("long").alias("t"), (F.round("x", 6) + 0.0).alias("value"))


def series(name: str, f: Callable[[Column], Column], sql: str) -> None:
    """A transformer's query: its values in long form. sql: the same list from the list s."""
    QUERIES[name] = lambda spark, sf_dir: _long(instances(spark, sf_dir).select("series_id", f(F.col("s")).alias("v")))
    SQL[name] = _series_sql(sql)


def _series_sql(sql: str) -> str:
    return f"{BASE}, r AS (SELECT series_id, {sql} AS v FROM b), l AS (SELECT series_id, v, unnest(range(1, len(v) + 1)) AS t FROM r) SELECT series_id, CAST(t - 1 AS BIGINT) AS t, ROUND(CAST(v[t] AS DOUBLE), 6) + 0.0 AS value FROM l"


def batched(name: str, f: B.Matrix, sql: str) -> None:
    """As series, for a transformer over matrices of series."""
    QUERIES[name] = lambda spark, sf_dir: _long(B.transform(instances(spark, sf_dir).select("series_id", "s").repartition(8), f))
    SQL[name] = _series_sql(sql)


def _each(expression: str, n: str = "len(s)", first: int = 0) -> str:
    return f"[{expression} for i in range({first}, {n})]"


def _sum(expression: str, n: str = "len(s)") -> str:
    return f"list_sum([{expression} for j in range(0, {n})])"


PI = "3.141592653589793"
PAA = _each(_sum("s[j + 1] * greatest(0.0, least(j + 1.0, (i + 1) * (len(s) / 8.0)) - greatest(j + 0.0, i * (len(s) / 8.0)))") + " / (len(s) / 8.0)", "8")

series("series_build", lambda a: a, "s")
series("znorm", S.standardise, Z)
series("center", S.centre, f"[x - {MEAN} for x in s]")
series("minmax_norm", S.interval, "[CASE WHEN list_max(s) - list_min(s) < 1e-6 THEN 0.0 ELSE (x - list_min(s)) / (list_max(s) - list_min(s)) END for x in s]")
series("diff_lag1", S.differences, _each("s[i + 1] - s[i + 2]", "len(s) - 1"))
series("diff_lag2", lambda a: S.differences(a, 2, True), _each("s[i + 3] - s[i + 1]", "len(s) - 2"))
I = "least(greatest(i, 1), len(s) - 2)"
series("derivative", S.derivative, _each(f"((s[{I} + 1] - s[{I}]) + (s[{I} + 2] - s[{I}]) / 2) / 2"))
series("clipping", S.clip, f"[CASE WHEN x < {MEAN} THEN 0.0 ELSE 1.0 END for x in s]")
series("paa_even", S.paa, PAA)
series("paa_fractional", lambda a: S.paa(a, 7), PAA.replace("8.0", "7.0").replace("range(0, 8)", "range(0, 7)"))
series("sax_symbols", lambda a: S.sax(S.standardise(a)), f"[CAST((x >= -0.67)::INT + (x >= 0.0)::INT + (x >= 0.67)::INT AS DOUBLE) for x in {PAA.replace('s[j', 'z[j')}]")
batched("dct", B.cosine, _each(_sum(f"s[j + 1] * cos(i * (j + 0.5) * {PI} / len(s))")))
batched("dst", B.sine, _each(_sum(f"s[j + 1] * sin(i * (j + 0.5) * {PI} / len(s))")))
batched("hilbert", B.hilbert, _each(_sum("CASE WHEN i = j THEN 0.0 ELSE s[j + 1] / (i - j) END")))
batched("power_spectrum", B.power_spectrum, _each(f"sqrt(pow({_sum(f's[j + 1] * cos(2 * {PI} * j * i / len(s))')}, 2) + pow({_sum(f's[j + 1] * sin(2 * {PI} * j * i / len(s))')}, 2))", "len(s) // 2"))
series("dwt_haar", S.haar, f"list_concat({_each('(s[2 * i + 1] + s[2 * i + 2]) / sqrt(2)', 'len(s) // 2')}, {_each('(s[2 * i + 1] - s[2 * i + 2]) / sqrt(2)', 'len(s) // 2')})")
series("convolution", lambda a: S.convolve(a, [0.25, 0.5, 0.25]), _each("0.25 * s[i + 1] + 0.5 * s[i + 2] + 0.25 * s[i + 3]", "len(s) - 2"))
series("reverse_series", lambda a: F.reverse(a), "list_reverse(s)")
series("shift_series", lambda a: F.transform(a, lambda x: x + 1.5), "[x + 1.5 for x in s]")
series("interval", lambda a: F.slice(a, 9, 16), "s[9:24]")
series("truncate", lambda a: F.slice(a, 1, 32), "s[1:32]")
series("pad", lambda a: F.concat(a, F.array_repeat(S.mean(a), 8)), f"list_concat(s, [{MEAN} for i in range(0, 8)])")
series("moving_average", lambda a: S.convolve(a, [0.2] * 5), _each("0.2 * (s[i + 1] + s[i + 2] + s[i + 3] + s[i + 4] + s[i + 5])", "len(s) - 4"))
MID = "((len(s) - 1) / 2.0)"
series("summary_stats", S.summary, f"[{MEAN}, {VAR}, list_min(s), list_max(s), {_sum(f's[j + 1] * (j - {MID})')} / (len(s) * (len(s) * len(s) - 1) / 12.0)]")
X, Y = "s[1:len(s) - i]", "s[i + 1:len(s)]"
_cov = f"list_sum([(s[j + 1] - list_avg({X})) * (s[j + 1 + i] - list_avg({Y})) for j in range(0, len(s) - i)]) / (len(s) - i)"
_var = lambda p: f"list_avg([(x - list_avg({p})) * (x - list_avg({p})) for x in {p}])"
series("acf", S.autocorrelation, _each(f"{_cov} / sqrt({_var(X)} * {_var(Y)})", "11", 1))


@query("run_length_hist", BASE + f""", p AS (SELECT series_id, unnest(range(1, len(s) + 1)) AS t, unnest([x >= {MEAN} for x in s]) AS up FROM b),
g AS (SELECT series_id, up, t - row_number() OVER (PARTITION BY series_id, up ORDER BY t) AS run FROM p), n AS (SELECT series_id, least(count(*), 16) AS n FROM g GROUP BY series_id, up, run),
k AS (SELECT series_id, unnest(range(1, 17)) AS k FROM b)
SELECT k.series_id, CAST(k - 1 AS BIGINT) AS t, CAST(count(n.n) AS DOUBLE) AS value FROM k LEFT JOIN n ON k.series_id = n.series_id AND k.k = n.n GROUP BY 1, 2""")  # fmt: skip
def run_length_hist(spark, sf_dir):
    return _long(instances(spark, sf_dir).select("series_id", S.run_lengths(F.col("s")).alias("v")))


@query("rank_order", BASE + ", p AS (SELECT series_id, unnest(range(0, len(s))) AS t, unnest(s) AS x FROM b) SELECT series_id, t, CAST(row_number() OVER (PARTITION BY t ORDER BY x, series_id) - 1 AS BIGINT) AS rank FROM p")
def rank_order(spark, sf_dir):
    return T.rank_within(instances(spark, sf_dir).select("series_id", F.posexplode("s").alias("t", "x")), "t", "x", "series_id").select("series_id", F.col("t").cast("long").alias("t"), "rank")


@query("column_normalise", BASE + ", p AS (SELECT series_id, unnest(range(0, len(s))) AS t, unnest(s) AS x FROM b), m AS (SELECT t, min(x) AS lo, max(x) AS hi FROM p GROUP BY t) SELECT series_id, t, ROUND((x - lo) / (hi - lo), 6) + 0.0 AS value FROM p JOIN m USING (t)")
def column_normalise(spark, sf_dir):
    points = instances(spark, sf_dir).select("series_id", F.posexplode("s").alias("t", "x"))
    return T.column_interval(points, "t", "x").select("series_id", F.col("t").cast("long").alias("t"), (F.round("value", 6) + 0.0).alias("value"))


def _neighbours(name: str, distance: Callable, sql: str) -> None:
    """Distances from the series whose ids 100 divides to all others."""

    def run(spark, sf_dir):
        rows = instances(spark, sf_dir).select(F.col("series_id").alias("id"), "s")
        found = D.between(rows.where("id % 100 = 0"), rows, distance)
        return found.select(F.col("a_id").alias("q"), F.col("b_id").alias("c"), (F.round("distance", 6) + 0.0).alias("distance"))

    QUERIES[name] = run
    SQL[name] = f"{BASE} SELECT x.series_id AS q, y.series_id AS c, ROUND({sql}, 6) + 0.0 AS distance FROM b x JOIN b y ON x.series_id % 100 = 0 AND x.series_id <> y.series_id"


N = "range(1, len(x.s) + 1)"
_neighbours("euclidean", elastic.euclidean, f"list_sum([(x.s[i] - y.s[i]) * (x.s[i] - y.s[i]) for i in {N}])")
_neighbours("manhattan", lambda a, b: np.abs(a - b).sum(1), f"list_sum([abs(x.s[i] - y.s[i]) for i in {N}])")
_neighbours("chebyshev", lambda a, b: np.abs(a - b).max(1), f"list_max([abs(x.s[i] - y.s[i]) for i in {N}])")
HI, LO = "list_max(x.s[greatest(i - 5, 1):least(i + 5, len(x.s))])", "list_min(x.s[greatest(i - 5, 1):least(i + 5, len(x.s))])"
_neighbours("minkowski_3", lambda a, b: (np.abs(a - b) ** 3).sum(1) ** (1 / 3), f"pow(list_sum([pow(abs(x.s[i] - y.s[i]), 3) for i in {N}]), 1.0 / 3)")
_neighbours("lb_keogh", lambda a, b: elastic.lb_keogh(a, b, 5), f"list_sum([CASE WHEN y.s[i] > {HI} THEN pow({HI} - y.s[i], 2) WHEN y.s[i] < {LO} THEN pow({LO} - y.s[i], 2) ELSE 0.0 END for i in {N}])")

NEAR = BASE + f", zs AS (SELECT series_id, label, z AS s FROM b), d AS (SELECT x.series_id AS q, x.label, y.series_id AS c, y.label AS other, ROUND(list_sum([(x.s[i] - y.s[i]) * (x.s[i] - y.s[i]) for i in {N}]), 9) AS distance FROM zs x JOIN zs y ON x.series_id <> y.series_id)"


def _nearest(spark, sf_dir, k):
    z = instances(spark, sf_dir).withColumn("s", S.standardise(F.col("s")))
    rows = z.select(F.col("series_id").alias("id"), "s")
    return z.select("series_id", "label"), D.nearest(rows, rows, k)


@query("ed_1nn", NEAR + ", n AS (SELECT label, other FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, c) = 1) SELECT label, count(*) AS n, CAST(sum((label = other)::INT) AS BIGINT) AS correct FROM n GROUP BY label")
def ed_1nn(spark, sf_dir):
    labels, hits = _nearest(spark, sf_dir, 1)
    pairs = hits.join(labels.withColumnRenamed("series_id", "q"), "q").join(labels.select(F.col("series_id").alias("c"), F.col("label").alias("other")), "c")
    return E.accuracy_by_class(pairs, "label", "other")


@query("knn_vote", NEAR + ", n AS (SELECT q, label, other FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, c) <= 5), v AS (SELECT q, label, other, count(*) AS n FROM n GROUP BY ALL) SELECT q AS series_id, label, other AS predicted, n AS votes FROM v QUALIFY row_number() OVER (PARTITION BY q ORDER BY n DESC, other) = 1")
def knn_vote(spark, sf_dir):
    labels, hits = _nearest(spark, sf_dir, 5)
    pairs = hits.join(labels.withColumnRenamed("series_id", "q"), "q").join(labels.select(F.col("series_id").alias("c"), F.col("label").alias("other")), "c")
    return E.majority(pairs, ["q", "label"], "other").select(F.col("q").alias("series_id"), "label", F.col("other").alias("predicted"), F.col("n").alias("votes"))


def _elastic(name: str, distance) -> None:
    """Distances from the series whose ids 100 divides to all others, on whole series."""

    def run(spark, sf_dir):
        rows = instances(spark, sf_dir).select(F.col("series_id").alias("id"), "s")
        return D.between(rows.where("id % 100 = 0"), rows, distance)

    QUERIES[name] = run


for _name in ("wdtw", "ddtw", "wddtw", "msm", "twed", "pdtw", "cid"):
    _elastic(_name, elastic.DISTANCES[_name])
_elastic("dtw", D.dtw_many)
_elastic("erp", D.erp_many)
_elastic("lcss", D.lcss_many)

for name, (run, sql) in {**T.queries(read), **E.queries(read)}.items():
    QUERIES[name], SQL[name] = run, sql


from corvane.catalog import evaluation, models, series_more, sources, table  # noqa: E402, F401  they register themselves


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
