"""Queries of the series layer: containers, transformers at their usual settings, shapelets, generators."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import generators as G
from corvane.operators import batch as B
from corvane.operators import series as S
from corvane.operators import shapelets as H
from corvane.operators.ordering import fraction
from corvane.registry import instances, query, read

RAW = "WITH b AS (SELECT vec_id AS series_id, label, [CAST(x AS DOUBLE) for x in embedding] AS s FROM embeddings)"


def long(df: DataFrame, decimals: int = 6) -> DataFrame:
    return df.select("series_id", F.posexplode("v").alias("t", "x")).select("series_id", F.col("t").cast("long").alias("t"), (F.round("x", decimals) + 0.0).alias("value"))


def long_sql(list_sql: str, extra: str = "") -> str:
    return f"{RAW}{extra}, r AS (SELECT series_id, {list_sql} AS v FROM b), l AS (SELECT series_id, v, unnest(range(1, len(v) + 1)) AS t FROM r) SELECT series_id, CAST(t - 1 AS BIGINT) AS t, ROUND(CAST(v[t] AS DOUBLE), 6) + 0.0 AS value FROM l"


def column(name: str, f, sql: str) -> None:
    """f: from the series column to an array."""
    query(name, long_sql(sql))(lambda s, d: long(instances(s, d).select("series_id", f(F.col("s")).alias("v"))))


def matrix(name: str, f: B.Matrix, sql: str | None = None, decimals: int = 6) -> None:
    query(name, long_sql(sql) if sql else None)(lambda s, d: long(B.transform(instances(s, d).select("series_id", "s").repartition(8), f), decimals))


def each(expression: str, n: str, first: int = 0) -> str:
    return f"[{expression} for i in range({first}, {n})]"


# slices
column("slice_points", lambda a: S.points(a, [3, 0, 60]), "[s[4], s[1], s[61]]")
column("slice_without_points", lambda a: S.without_points(a, [0, 1, 63]), "s[3:63]")
column("resized_longer", lambda a: S.resized(a, 70), "list_concat(s, [list_sum(s) / len(s) for i in range(0, 6)])")
column("resized_shorter", lambda a: S.resized(a, 50), "s[1:50]")
column("truncated_padded", lambda a: F.concat(F.slice(a, 1, 40), F.array_repeat(F.lit(None).cast("double"), 24)), "list_concat(s[1:40], [NULL::DOUBLE for i in range(0, 24)])")
column("shortened_normalised", lambda a: S.standardise(F.slice(a, F.lit(1), F.floor(F.size(a) * 0.3).cast("int"))), "[(x - list_avg(s[1:19])) / sqrt(list_avg([(y - list_avg(s[1:19])) * (y - list_avg(s[1:19])) for y in s[1:19]])) for x in s[1:19]]")
column("mean_centred", S.centre, "[x - list_avg(s) for x in s]")
column("argmax_argmin", lambda a: F.array(S.argmax(a).cast("double"), S.argmin(a).cast("double")), "[list_position(s, list_max(s)) - 1, list_position(s, list_min(s)) - 1]")
column("slope_ref", lambda a: F.array(S.slope_ref(a)), "[(list_sum([s[i] * (i - 1) for i in range(1, len(s) + 1)]) - pow(list_sum(s), 2) / len(s)) / (list_sum([x * x for x in s]) - pow(list_sum(s), 2) / len(s))]")
VAR = "list_avg([(y - list_avg(s)) * (y - list_avg(s)) for y in s])"
MOM = f"list_avg([pow((x - list_avg(s)) / sqrt({VAR}), {{k}}) for x in s])"
column("moments", lambda a: S.let(S.moments(a), lambda m: F.array(*[m[k] for k in ("sum", "sum_sq", "mean", "variance", "skew", "kurtosis")])), f"[list_sum(s), list_sum([x * x for x in s]), list_avg(s), {VAR}, {MOM.format(k=3)}, {MOM.format(k=4)}]")
for _n in (2, 5, 7, 10):
    _bp = S.BREAKPOINTS[_n]
    _z = f"[(x - list_avg(s)) / sqrt({VAR}) for x in s]"
    _frame = "[list_avg(z[8 * i + 1:8 * i + 8]) for i in range(0, 8)]"
    query(f"sax_{_n}", f"{RAW}, z AS (SELECT series_id, {_z} AS z FROM b), r AS (SELECT series_id, [CAST({' + '.join(f'(x >= {p})::INT' for p in _bp)} AS DOUBLE) for x in {_frame}] AS v FROM z), l AS (SELECT series_id, v, unnest(range(1, len(v) + 1)) AS t FROM r) SELECT series_id, CAST(t - 1 AS BIGINT) AS t, v[t] AS value FROM l")(lambda s, d, n=_n: long(instances(s, d).select("series_id", S.sax(S.standardise(F.col("s")), 8, n).alias("v"))))


@query("points_noise_added", RAW + ", l AS (SELECT series_id, s, unnest(range(0, len(s))) AS t FROM b) SELECT series_id, CAST(t AS BIGINT) AS t, ROUND(s[t + 1] + 0.1 * (('0x' || substr(md5('0-' || series_id || '-' || t), 1, 8))::BIGINT / 4294967296.0::DOUBLE - 0.5), 6) + 0.0 AS value FROM l")
def points_noise_added(spark, sf_dir):
    v = F.transform("s", lambda x, i: x + 0.1 * (fraction(F.md5(F.concat_ws("-", F.lit("0"), F.col("series_id").cast("string"), i.cast("string")))) - 0.5))
    return long(instances(spark, sf_dir).select("series_id", v.alias("v")))


# two dimensions: the halves of a series
def halves(spark, sf_dir) -> DataFrame:
    return instances(spark, sf_dir).select("series_id", "label", F.array(F.slice("s", 1, 32), F.slice("s", 33, 32)).alias("dims"))


def dims(name: str, f, sql: str) -> None:
    """f: from the dimensions column to an array of arrays; rows (series_id, dim, t, value)."""

    def run(s, d):
        t = halves(s, d).select("series_id", F.posexplode(f(F.col("dims"))).alias("dim", "v")).select("series_id", "dim", F.posexplode("v").alias("t", "x"))
        return t.select("series_id", F.col("dim").cast("long").alias("dim"), F.col("t").cast("long").alias("t"), (F.round("x", 6) + 0.0).alias("value"))

    query(name, f"{RAW}, h AS (SELECT series_id, [s[1:32], s[33:64]] AS d FROM b), r AS (SELECT series_id, {sql} AS v FROM h), e AS (SELECT series_id, v, unnest(range(1, len(v) + 1)) AS dim FROM r), l AS (SELECT series_id, dim, v[dim] AS w, unnest(range(1, len(v[dim]) + 1)) AS t FROM e) SELECT series_id, CAST(dim - 1 AS BIGINT) AS dim, CAST(t - 1 AS BIGINT) AS t, ROUND(w[t], 6) + 0.0 AS value FROM l")(run)


get = lambda d, i: F.get(d, F.lit(i))
dims("dims_selected", lambda d: F.filter(d, lambda x, i: i == 1), "[d[2]]")
dims("dims_reordered", lambda d: F.array(get(d, 1), get(d, 0)), "[d[2], d[1]]")
dims("dims_sliced", lambda d: F.transform(d, lambda x: F.slice(x, 5, 10)), "[x[5:14] for x in d]")
dims("dims_points", lambda d: F.transform(d, lambda x: S.points(x, [0, 31])), "[[x[1], x[32]] for x in d]")
dims("dims_transposed", S.transposed, "[[d[1][i], d[2][i]] for i in range(1, 33)]")
dims("dims_concatenated", lambda d: F.array(F.flatten(d)), "[list_concat(d[1], d[2])]")
dims("dims_interleaved", lambda d: F.array(F.flatten(F.transform(F.arrays_zip(get(d, 0).alias("p"), get(d, 1).alias("q")), lambda x: F.array(x["p"], x["q"])))), "[flatten([[d[1][i], d[2][i]] for i in range(1, 33)])]")
dims("dims_stacked", lambda d: F.concat(d, F.array(F.reverse(get(d, 0)))), "[d[1], d[2], list_reverse(d[1])]")
dims("dims_joined_in_time", lambda d: F.zip_with(d, F.transform(d, lambda x: F.reverse(x)), lambda x, y: F.concat(x, y)), "[list_concat(x, list_reverse(x)) for x in d]")
dims("dims_normalised", lambda d: F.transform(d, lambda x: S.standardise(x)), "[[(y - list_avg(x)) / sqrt(list_avg([(z - list_avg(x)) * (z - list_avg(x)) for z in x])) for y in x] for x in d]")
dims("dims_chopped", lambda d: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.flatten(d), i * 16 + 1, F.lit(16))), "[list_concat(d[1], d[2])[16 * i + 1:16 * i + 16] for i in range(0, 4)]")
dims("dims_combined", lambda d: F.array(F.concat(S.differences(get(d, 0)), S.paa(get(d, 1), 4))), "[list_concat([d[1][i] - d[1][i + 1] for i in range(1, 32)], [list_avg(d[2][8 * i + 1:8 * i + 8]) for i in range(0, 4)])]")
EV = "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"


def points_of_users(spark, sf_dir) -> DataFrame:
    """Series of unequal length: the values of each user's events."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select(F.col("user_id").alias("series_id"), F.transform("e", lambda x: x["value"]).alias("s"))


query("length_histogram", EV + " SELECT n AS length, count(*) AS series FROM e GROUP BY 1")(lambda s, d: points_of_users(s, d).groupBy(F.size("s").cast("long").alias("length")).agg(F.count("*").alias("series")))
query("dataset_profile", EV + " SELECT count(*) AS series, min(n) AS least, max(n) AS most, min(n) = max(n) AS equal_length FROM e")(lambda s, d: points_of_users(s, d).agg(F.count("*").alias("series"), F.min(F.size("s")).cast("long").alias("least"), F.max(F.size("s")).cast("long").alias("most"), (F.min(F.size("s")) == F.max(F.size("s"))).alias("equal_length")))
query("truncated_to_shortest", EV + ", m AS (SELECT min(n) AS m FROM e), p AS (SELECT user_id AS series_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events) SELECT series_id, CAST(t AS BIGINT) AS t, ROUND(value, 6) + 0.0 AS value FROM p, m WHERE t < m")(lambda s, d: long(points_of_users(s, d).join(F.broadcast(points_of_users(s, d).agg(F.min(F.size("s")).alias("m")))).select("series_id", F.slice("s", F.lit(1), F.col("m")).alias("v"))))
query("column_over_series", RAW + " SELECT series_id, ROUND(s[8], 6) + 0.0 AS value FROM b")(lambda s, d: instances(s, d).select("series_id", (F.round(F.get("s", F.lit(7)), 6) + 0.0).alias("value")))
query("series_hashed", RAW + " SELECT series_id, sha256(array_to_string([CAST(round(x * 1000000) AS BIGINT) for x in s], ',')) AS digest FROM b")(lambda s, d: instances(s, d).select("series_id", F.sha2(F.array_join(F.transform("s", lambda x: F.round(x * 1000000).cast("long").cast("string")), ","), 256).alias("digest")))

# transformers over matrices
COS, SIN = f"list_sum([s[j + 1] * cos(2 * {math.pi} * j * i / len(s)) for j in range(0, len(s))])", f"-list_sum([s[j + 1] * sin(2 * {math.pi} * j * i / len(s)) for j in range(0, len(s))])"
matrix("fourier", B.fourier, f"flatten([[{COS}, {SIN}] for i in range(0, len(s) // 2)])")
matrix("power_spectrum_log", lambda x: B.power_spectrum(x, True))
matrix("power_cepstrum", B.power_cepstrum)
matrix("spectrogram", B.spectrogram)
matrix("mfcc", B.mfcc)
matrix("audio_features", B.audio_features)
P, Q = "s[1:len(s) - i]", "s[i + 1:len(s)]"
_cov = f"list_sum([(s[j + 1] - list_avg({P})) * (s[j + 1 + i] - list_avg({Q})) for j in range(0, len(s) - i)]) / (len(s) - i)"
_v = lambda p: f"list_avg([(x - list_avg({p})) * (x - list_avg({p})) for x in {p}])"
matrix("acf_100", B.autocorrelations, each(f"{_cov} / sqrt({_v(P)} * {_v(Q)})", "61", 1))
matrix("pacf", B.partial_autocorrelations)
matrix("acf_pacf", B.both_autocorrelations)
matrix("arma", B.autoregression)
matrix("dwt_levels", lambda x: B.haar(x, 2), "list_concat(list_concat([(s[4 * i + 1] + s[4 * i + 2] + s[4 * i + 3] + s[4 * i + 4]) / 2 for i in range(0, 16)], [(s[4 * i + 1] + s[4 * i + 2] - s[4 * i + 3] - s[4 * i + 4]) / 2 for i in range(0, 16)]), [(s[2 * i + 1] - s[2 * i + 2]) / sqrt(2) for i in range(0, 32)])")
W8 = "s[8 * i + 1:8 * i + 8]"
_y = f"list_sum([({W8}[j] - list_avg({W8})) * ({W8}[j] - list_avg({W8})) for j in range(1, 9)]) - 42"
_x = f"2 * list_sum([({W8}[j] - list_avg({W8})) * (j - 4.5) for j in range(1, 9)])"
matrix("slopes", B.slopes, each(f"(({_y}) + sqrt(pow({_y}, 2) + pow({_x}, 2))) / ({_x})", "8"))
_half = "list_concat([s[32 * h + 1]], list_concat(s[32 * h + 1:32 * h + 32], [s[32 * h + 32]]))"
matrix("hog1d", B.gradient_histograms, f"flatten([[len(list_filter([degrees(atan(0.05 * ({_half}[j + 2] - {_half}[j]))) for j in range(1, 33)], lambda a: a > -90 + 22.5 * k AND a <= -67.5 + 22.5 * k)) for k in range(0, 8)] for h in range(0, 2)])")
ZS = "[(x - list_avg(s)) / sqrt(" + VAR + ") for x in s]"
query("subsequences", f"{RAW}, z AS (SELECT series_id, {ZS} AS z FROM b), r AS (SELECT series_id, unnest(range(0, 64)) AS i, z FROM z), l AS (SELECT series_id, i, unnest(range(0, 30)) AS j, z FROM r) SELECT series_id, CAST(i * 30 + j AS BIGINT) AS t, ROUND(z[least(greatest(i + j - 15, 0), 63) + 1], 6) + 0.0 AS value FROM l")(lambda s, d: long(B.transform(instances(s, d).select("series_id", "s").repartition(8), B.subsequences)))
query("matrix_profile", f"{RAW}, w AS (SELECT series_id, i, s[i + 1:i + 10] AS w FROM b, range(0, 55) r(i)), z AS (SELECT series_id, i, [(x - list_avg(w)) / sqrt(list_avg([(y - list_avg(w)) * (y - list_avg(w)) for y in w])) for x in w] AS z FROM w), p AS (SELECT a.series_id, a.i, min(list_sum([(a.z[j] - b.z[j]) * (a.z[j] - b.z[j]) for j in range(1, 11)])) AS d FROM z a JOIN z b ON a.series_id = b.series_id AND abs(a.i - b.i) > 15 GROUP BY 1, 2) SELECT series_id, CAST(i AS BIGINT) AS t, ROUND(d, 4) + 0.0 AS value FROM p")(lambda s, d: long(B.transform(instances(s, d).select("series_id", "s").repartition(8), lambda x: B.matrix_profile(x)[:, : x.shape[1] - 9]), 4))
matrix("summary_seven", B.summary, f"[list_avg(s), {VAR}, {MOM.format(k=3)}, {MOM.format(k=4)}, list_sum([s[j + 1] * (j - (len(s) - 1) / 2.0) for j in range(0, len(s))]) / (len(s) * (len(s) * len(s) - 1) / 12.0), list_min(s), list_max(s)]")
matrix("catch22", B.catch22)
matrix("rocket", B.Rocket(50, 64, 1))
def _second_difference(x: np.ndarray) -> np.ndarray:
    r = B.Rocket(0, 64)
    r.kernels = [(np.array([1.0, -2.0, 1.0]), 0.0, 2, 0)]
    return r(x)


query("kernel_convolved", RAW + ", r AS (SELECT series_id, [s[i + 1] - 2 * s[i + 3] + s[i + 5] for i in range(0, 60)] AS v FROM b) SELECT series_id, CAST(0 AS BIGINT) AS t, ROUND(len(list_filter(v, lambda x: x > 0)) / 60.0::DOUBLE, 6) + 0.0 AS value FROM r UNION ALL SELECT series_id, CAST(1 AS BIGINT), ROUND(list_max(v), 6) + 0.0 FROM r")(lambda s, d: long(B.transform(instances(s, d).select("series_id", "s"), _second_difference)))



@query("bag_of_patterns", RAW + ", w AS (SELECT series_id, s[i + 1:i + 10] AS w FROM b, range(0, 55) r(i)), z AS (SELECT series_id, [CASE WHEN v < 1e-6 THEN 0.0 ELSE (x - m) / sqrt(v) END for x in w] AS z FROM (SELECT *, list_avg([(x - m) * (x - m) for x in w]) AS v FROM (SELECT *, list_avg(w) AS m FROM w))), f AS (SELECT series_id, [list_sum([z[j + 1] * greatest(0.0, least(j + 1.0, (i + 1) * 2.5) - greatest(j + 0.0, i * 2.5)) for j in range(0, 10)]) / 2.5 for i in range(0, 4)] AS p FROM z), l AS (SELECT series_id, array_to_string([substr('abcd', 1 + (x >= -0.67)::INT + (x >= 0.0)::INT + (x >= 0.67)::INT, 1) for x in p], '') AS word FROM f) SELECT series_id, word, count(*) AS n FROM l GROUP BY 1, 2")
def bag_of_patterns(spark, sf_dir):
    from corvane.models.dictionary import bags

    return bags(instances(spark, sf_dir).select(F.col("series_id").alias("id"), "s")).select(F.col("id").alias("series_id"), "word", "n")


# power transforms, of positive numbers
POS = "WITH p AS (SELECT p_partkey AS k, p_retailprice AS x, p_retailprice - 1000 AS y FROM part)"


def scalar(name: str, f: Callable[[Column, Column], Column], sql: str) -> None:
    query(name, f"{POS} SELECT k, ROUND({sql}, 6) + 0.0 AS value FROM p")(lambda s, d: read(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"), (F.col("p_retailprice") - 1000).alias("y")).select("k", (F.round(f(F.col("x"), F.col("y")), 6) + 0.0).alias("value")))


scalar("box_cox", lambda x, y: (F.pow(x, F.lit(0.5)) - 1) / 0.5, "(pow(x, 0.5) - 1) / 0.5")
scalar("box_cox_zero", lambda x, y: F.log(x), "ln(x)")
scalar("yeo_johnson", lambda x, y: F.when(y >= 0, (F.pow(y + 1, F.lit(0.5)) - 1) / 0.5).otherwise(-(F.pow(1 - y, F.lit(1.5)) - 1) / 1.5), "CASE WHEN y >= 0 THEN (pow(y + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - y, 1.5) - 1) / 1.5 END")
scalar("reciprocal", lambda x, y: F.try_divide(F.lit(1.0), x), "1 / x")
scalar("exponential", lambda x, y: F.exp(x / 1000), "exp(x / 1000)")

# shapelets: of every fortieth series, at two sizes
FEW = "series_id % 40 = 0"
ZN = "[(x - list_avg(w)) / sqrt(list_avg([(y - list_avg(w)) * (y - list_avg(w)) for y in w])) for x in w]"
PROFILE = f"{RAW}, c AS (SELECT series_id AS c_id, st AS start, z AS size, s[st + 1:st + z] AS w FROM b, (VALUES (8), (16)) v(z), range(0, 57) r(st) WHERE series_id % 200 = 0 AND st % 8 = 0 AND st + z <= 64), cz AS (SELECT c_id, start, size, {ZN} AS c FROM c), q AS (SELECT series_id AS id, label, z AS size, i, s[i + 1:i + z] AS w FROM b, (VALUES (8), (16)) v(z), range(0, 57) r(i) WHERE {FEW} AND i + z <= 64), qz AS (SELECT id, label, size, {ZN} AS q FROM q), p AS (SELECT id, label, c_id, start, size, min(list_sum([(q[j] - c[j]) * (q[j] - c[j]) for j in range(1, size + 1)])) / size AS distance FROM qz JOIN cz USING (size) GROUP BY 1, 2, 3, 4, 5)"


def shapelet_profile(spark, sf_dir) -> DataFrame:
    rows = instances(spark, sf_dir).withColumnRenamed("series_id", "id")
    return H.profile(rows.where("id % 40 = 0"), H.candidates(rows.where("id % 200 = 0"), [8, 16], 8))


query("shapelet_distances", PROFILE + " SELECT id, label, c_id, start, size, ROUND(distance, 6) + 0.0 AS distance FROM p")(lambda s, d: shapelet_profile(s, d).select("id", F.col("label").cast("int").alias("label"), "c_id", F.col("start").cast("long").alias("start"), "size", (F.round("distance", 6) + 0.0).alias("distance")))
KEY = "c_id, start, size"


def quality(name: str, f, sql: str) -> None:
    query(f"shapelet_{name}", PROFILE + sql)(lambda s, d: f(shapelet_profile(s, d)).select("c_id", F.col("start").cast("long").alias("start"), "size", (F.round("value", 4) + 0.0).alias("value")))


quality("f_statistic", H.f_statistic, f", g AS (SELECT {KEY}, count(*)::DOUBLE AS n, avg(distance) AS m, var_pop(distance) AS v FROM p GROUP BY ALL, label), z AS (SELECT {KEY}, count(*) AS k, sum(n) AS n, sum(n * m) AS s1, sum(n * m * m) AS s2, sum(n * v) AS w FROM g GROUP BY {KEY}) SELECT {KEY}, ROUND(((s2 - s1 * s1 / n) / (k - 1)) / (w / (n - k)), 4) + 0.0 AS value FROM z".replace("GROUP BY ALL, label", f"GROUP BY {KEY}, label"))
quality("kruskal_wallis", H.kruskal_wallis, f", k AS (SELECT *, rank() OVER (PARTITION BY {KEY} ORDER BY ROUND(distance, 9)) + (count(*) OVER (PARTITION BY {KEY}, ROUND(distance, 9)) - 1) / 2.0 AS rank FROM p), g AS (SELECT {KEY}, count(*)::DOUBLE AS k, sum(rank) AS r FROM k GROUP BY {KEY}, label), z AS (SELECT {KEY}, sum(k) AS n, sum(r * r / k) AS s FROM g GROUP BY {KEY}) SELECT {KEY}, ROUND(12 / (n * (n + 1)) * s - 3 * (n + 1), 4) + 0.0 AS value FROM z")
quality("information_gain", H.information_gain, f", d AS (SELECT {KEY}, label, ROUND(distance, 9) AS d FROM p), h AS (SELECT {KEY}, d, count(*) AS x FROM d GROUP BY ALL), s AS (SELECT a.c_id, a.start, a.size, a.d, b.label, count(*) FILTER (WHERE b.d <= a.d)::DOUBLE AS l, count(*)::DOUBLE AS t FROM h a JOIN d b ON a.c_id = b.c_id AND a.start = b.start AND a.size = b.size GROUP BY ALL), e AS (SELECT {KEY}, d, sum(l) AS nl, sum(t) AS n, sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) AS lx, sum(CASE WHEN t > l THEN (t - l) * log2(t - l) ELSE 0 END) AS rx, sum(t * log2(t)) AS ax FROM s GROUP BY {KEY}, d) SELECT {KEY}, ROUND(max(((n * log2(n) - ax) - (nl * log2(nl) - lx) - (CASE WHEN n > nl THEN (n - nl) * log2(n - nl) ELSE 0 END - rx)) / n), 4) + 0.0 AS value FROM e GROUP BY {KEY}")
quality("moods_median", H.moods_median, f", m AS (SELECT {KEY}, median(distance) AS m FROM p GROUP BY {KEY}), a AS (SELECT p.c_id, p.start, p.size, label, distance > m AS up FROM p JOIN m USING (c_id, start, size)), t AS (SELECT {KEY}, label, up, count(*)::DOUBLE AS n FROM a GROUP BY ALL), w AS (SELECT {KEY}, sum(n) AS w FROM t GROUP BY {KEY}), i AS (SELECT {KEY}, label, sum(n) AS ni FROM t GROUP BY {KEY}, label), j AS (SELECT {KEY}, up, sum(n) AS nj FROM t GROUP BY {KEY}, up) SELECT t.c_id, t.start, t.size, ROUND(sum(t.n * t.n * w / (ni * nj)) - max(w), 4) + 0.0 AS value FROM t JOIN i USING (c_id, start, size, label) JOIN j USING (c_id, start, size, up) JOIN w USING (c_id, start, size) GROUP BY 1, 2, 3")
query("shapelet_transform")(lambda s, d: long(H.ShapeletTransform(5, [8, 16], 8, H.f_statistic).fit(instances(s, d).withColumnRenamed("series_id", "id").where("id % 40 = 0")).transform(instances(s, d).withColumnRenamed("series_id", "id")).withColumnRenamed("id", "series_id")))
query("shapelets_balanced")(lambda s, d: H.best_balanced(H.f_statistic(shapelet_profile(s, d)), instances(s, d).where("series_id % 200 = 0").select(F.col("series_id").alias("c_id"), "label"), 10).select("c_id", "start", "size", F.round("value", 6).alias("value"), "label"))

# generators
U = "(('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def usql(seed: str, *keys: str) -> str:
    return U.format(k=" || '-' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]]))


def nsql(seed: str, *keys: str) -> str:
    return f"sqrt(-2 * ln({usql(seed + 'u', *keys)} + {2.0**-33!r}::DOUBLE)) * cos(2 * {math.pi} * {usql(seed + 'v', *keys)})"


GRID = "WITH g AS (SELECT i AS series_id, CAST(i % 2 AS INT) AS label, t FROM range(0, 40) a(i), range(0, 50) b(t))"


def generated(name: str, f, sql: str | None) -> None:
    query(f"generate_{name}", f"{GRID} SELECT series_id, label, CAST(t AS BIGINT) AS t, ROUND({sql}, 6) + 0.0 AS value FROM g" if sql else None)(lambda s, d: f(G.cases(s, 40)).select("series_id", "label", F.col("t").cast("long").alias("t"), (F.round("value", 6) + 0.0).alias("value")))


NOISE = nsql("0", "series_id", "t")
generated("white_noise", lambda c: G.white_noise(c, 50, 2.0), f"2 * {NOISE}")
generated("sinusoids", lambda c: G.sinusoids(c, 50, [(1.0, 2.0, 0.0), (0.5, 5.0, 1.0)], 0.1), f"sin(2 * {math.pi} * 2 * t / 50) + 0.5 * sin(2 * {math.pi} * 5 * t / 50 + 1) + 0.1 * {NOISE}")
generated("polynomial", lambda c: G.polynomial(c, 50, [1.0, -2.0, 3.0], 0.1), f"1 - 2 * (t / 50.0::DOUBLE) + 3 * pow(t / 50.0::DOUBLE, 2) + 0.1 * {NOISE}")
query("generate_autoregressive", f"{GRID}, e AS (SELECT *, {NOISE} AS e FROM g) SELECT a.series_id, a.label, CAST(a.t AS BIGINT) AS t, ROUND(sum(b.e * pow(0.7, a.t - b.t)), 6) + 0.0 AS value FROM e a JOIN e b ON a.series_id = b.series_id AND b.t <= a.t GROUP BY 1, 2, 3")(lambda s, d: G.autoregressive(G.cases(s, 40), 50, [0.7]).select("series_id", "label", F.col("t").cast("long").alias("t"), (F.round("value", 6) + 0.0).alias("value")))
_TRI, _STEP = "1 - abs(2 * {x} - 1)", "CASE WHEN {x} < 0.5 THEN -1.0 ELSE 1.0 END"
_at = f"floor({usql('0at', 'series_id', '0')} * 36)"
_in = f"((t - {_at}) / 15)"
generated("shapelets", lambda c: G.planted(c, 50, 15, ["triangle", "step"]), f"CASE WHEN {_in} >= 0 AND {_in} < 1 THEN 4 * (CASE label WHEN 0 THEN {_TRI.format(x=_in)} ELSE {_STEP.format(x=_in)} END) ELSE 0 END + {NOISE}")
_iv = "((t - 10) / 15.0::DOUBLE)"
generated("intervals", lambda c: G.intervals(c, 50, [(10, 25)], ["triangle", "step"]), f"CASE WHEN t >= 10 AND t < 25 THEN 4 * (CASE label WHEN 0 THEN {_TRI.format(x=_iv)} ELSE {_STEP.format(x=_iv)} END) ELSE 0 END + {NOISE}")
_bx = f"((t / 50.0::DOUBLE) + 0.3 * (2 * {usql('0bend', 'series_id')} - 1) * sin({math.pi} * (t / 50.0::DOUBLE)) / 2)"
generated("warped", lambda c: G.warped(c, 50, ["sine", "triangle"]), f"CASE label WHEN 0 THEN sin(2 * {math.pi} * {_bx}) ELSE {_TRI.format(x=_bx)} END + 0.1 * {NOISE}")
generated("dictionary", lambda c: G.dictionary(c, 50, 10), None)
generated("motifs", lambda c: G.motifs(c, 50, 10, ["sine", "spike"]), None)
generated("discords", lambda c: G.motifs(c, 50, 5, ["sine", "spike"], True), None)
query("generate_loans", f"WITH r AS (SELECT id AS rid, 20000 + 130000 * {usql('0salary', 'id')} AS salary, 20 + floor(61 * {usql('0age', 'id')}) AS age FROM range(0, 500) t(id)) SELECT rid, ROUND(salary, 4) AS salary, CAST(age AS BIGINT) AS age, CAST(CASE WHEN age < 40 THEN salary BETWEEN 50000 AND 100000 WHEN age < 60 THEN salary BETWEEN 75000 AND 125000 ELSE salary BETWEEN 25000 AND 75000 END AS INT) AS label FROM r")(lambda s, d: G.loans(s, 500).select("rid", F.round("salary", 4).alias("salary"), F.col("age").cast("long").alias("age"), "label"))
query("generate_expression", f"SELECT id AS rid, ROUND(sin({usql('0a0', 'id')}) + pow({usql('0a1', 'id')}, 2) + 0.1 * {nsql('0e', 'id')}, 6) + 0.0 AS target FROM range(0, 500) t(id)")(lambda s, d: G.expression(s, 500).select("rid", (F.round("target", 6) + 0.0).alias("target")))
query("generate_mexican_hat", f"WITH r AS (SELECT id AS rid, 20 * {usql('0x', 'id')} - 10 AS x FROM range(0, 500) t(id)) SELECT rid, ROUND(x, 6) + 0.0 AS x, ROUND(sin(abs(x)) / abs(x), 6) + 0.0 AS y FROM r")(lambda s, d: G.mexican_hat(s, 500).select("rid", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y")))
query("generate_grid_clusters", f"WITH r AS (SELECT id AS rid, CAST(floor({usql('0c', 'id')} * 4) AS INT) AS cluster FROM range(0, 500) t(id)) SELECT rid, cluster, ROUND(cluster % 2 * 4 + {nsql('0x', 'rid')}, 6) + 0.0 AS x, ROUND(floor(cluster / 2) * 4 + {nsql('0y', 'rid')}, 6) + 0.0 AS y FROM r")(lambda s, d: G.grid_clusters(s, 500).select("rid", "cluster", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y")))
query("generate_rule_data", f"WITH r AS (SELECT id AS rid, {', '.join(f'CAST({usql(f'0{k}', 'id')} < 0.5 AS INT) AS a{k + 1}' for k in range(6))} FROM range(0, 500) t(id)) SELECT *, CASE WHEN a1 = 1 AND a2 = 0 THEN 1 WHEN a3 = 1 THEN 2 ELSE 0 END AS label FROM r")(lambda s, d: G.rule_data(s, 500))
_BOX = "[[[0.0, 1.0], [0.0, 5.0]], [[4.0, 6.0], [2.0, 3.0]]]"
query("generate_subspace_clusters", f"WITH r AS (SELECT id AS rid, CAST(floor({usql('0c', 'id')} * 2) AS INT) AS cluster, {usql('00', 'id')} AS u, {usql('01', 'id')} AS v, {_BOX} AS b FROM range(0, 500) t(id)) SELECT rid, cluster, ROUND(b[cluster + 1][1][1] + (b[cluster + 1][1][2] - b[cluster + 1][1][1]) * u, 6) + 0.0 AS x, ROUND(b[cluster + 1][2][1] + (b[cluster + 1][2][2] - b[cluster + 1][2][1]) * v, 6) + 0.0 AS y FROM r")(lambda s, d: G.subspace_clusters(s, 500, [[(0.0, 1.0), (0.0, 5.0)], [(4.0, 6.0), (2.0, 3.0)]]).select("rid", "cluster", (F.round(F.get("v", F.lit(0)), 6) + 0.0).alias("x"), (F.round(F.get("v", F.lit(1)), 6) + 0.0).alias("y")))
query("generate_led")(lambda s, d: G.led(s, 500))
query("generate_radial")(lambda s, d: G.radial(s, 500).select("rid", "label", F.posexplode("v").alias("t", "value")))
