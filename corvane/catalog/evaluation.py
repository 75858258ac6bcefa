"""Queries of measures, comparisons, tests, votes and attribute scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.models import voting as V
from corvane.operators import attributes as A
from corvane.operators import comparison as K
from corvane.operators import metrics as M
from corvane.registry import query, read

# predictions of ten classes from the embeddings: a share for each class from its component, with a lean to the true one
_W = "CAST(embedding[{o} + i] AS DOUBLE) * CAST(embedding[{o} + i] AS DOUBLE) + 0.01 + CASE WHEN label = i - 1 THEN 0.02 ELSE 0.0 END"


def _modules(offsets: list[int]) -> str:
    one = lambda m, o: f"SELECT {m} AS module, vec_id AS rid, label, [{_W.format(o=o)} for i in range(1, 11)] AS w FROM embeddings"
    return "WITH raw AS (" + " UNION ALL ".join(one(m, o) for m, o in enumerate(offsets)) + "), p AS (SELECT module, rid, CAST(label AS BIGINT) AS y_true, [x / list_sum(w) for x in w] AS dist FROM raw), q AS (SELECT *, CAST(list_position(dist, list_max(dist)) - 1 AS BIGINT) AS y_pred FROM p)"


ONE, THREE = _modules([0]), _modules([0, 10, 20])


def predictions(spark, sf_dir, offsets: tuple[int, ...] = (0,)) -> DataFrame:
    """(module, rid, y_true, y_pred, dist)."""
    e = read(spark, sf_dir, "embeddings")

    def of(module: int, offset: int) -> DataFrame:
        w = F.transform(F.slice("embedding", offset + 1, 10), lambda x, i: x.cast("double") * x.cast("double") + 0.01 + F.when(F.col("label") == i, 0.02).otherwise(0.0))
        t = e.select(F.lit(module).alias("module"), F.col("vec_id").alias("rid"), F.col("label").cast("long").alias("y_true"), w.alias("w"))
        return t.select("module", "rid", "y_true", F.transform("w", lambda x: x / F.aggregate("w", F.lit(0.0), lambda a, b: a + b)).alias("dist"))

    t = reduce(DataFrame.union, [of(m, o) for m, o in enumerate(offsets)])
    return t.withColumn("y_pred", V.told(F.col("dist")).cast("long"))


def value6(df: DataFrame) -> DataFrame:
    return df.select((F.round("value", 6) + 0.0).alias("value"))


def measure(name: str, f, sql: str) -> None:
    query(name, f"{ONE} SELECT ROUND({sql}, 6) + 0.0 AS value FROM q")(lambda spark, sf_dir: value6(f(predictions(spark, sf_dir))))


def measure_of(name: str, f, sql: str) -> None:
    query(name, f"{ONE}{sql}")(lambda spark, sf_dir: f(predictions(spark, sf_dir)))


HIT = "(y_true = y_pred)::INT::DOUBLE"
measure("accuracy", M.accuracy, f"avg({HIT})")
measure("log_loss", M.log_loss, "avg(CASE WHEN dist[y_true + 1] = 0 THEN 6.64 ELSE -log2(dist[y_true + 1]) END)")
query("balanced_accuracy", f"{ONE} SELECT ROUND(avg(r), 6) + 0.0 AS value FROM (SELECT avg({HIT}) AS r FROM q GROUP BY y_true)")(lambda s, d: value6(M.balanced_accuracy(predictions(s, d))))
CLASS = ", k AS (SELECT unnest(range(0, 10)) AS c), t AS (SELECT c AS class, count(*) FILTER (WHERE y_true = c AND y_pred = c) AS tp, count(*) FILTER (WHERE y_true <> c AND y_pred = c) AS fp, count(*) FILTER (WHERE y_true = c AND y_pred <> c) AS fn, count(*) FILTER (WHERE y_true <> c AND y_pred <> c) AS tn FROM k, q GROUP BY c), m AS (SELECT *, greatest(tp, 1e-7) / (greatest(tp, 1e-7) + fp) AS pr, greatest(tp, 1e-7) / (greatest(tp, 1e-7) + fn) AS re FROM t WHERE tp + fp + fn > 0)"
measure_of("class_table", lambda p: M.by_class(p).select("class", "tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("specificity", 6).alias("specificity"), F.round("f1", 6).alias("f1")), CLASS + " SELECT class, tp, fp, fn, tn, ROUND(pr, 6) AS precision, ROUND(re, 6) AS recall, ROUND(tn / (tn + fp)::DOUBLE, 6) AS specificity, ROUND(2 * pr * re / (pr + re), 6) AS f1 FROM m")
measure_of("f1_macro", lambda p: value6(M.f1(p)), CLASS + " SELECT ROUND(avg(2 * pr * re / (pr + re)), 6) + 0.0 AS value FROM m")
measure_of("mcc", lambda p: value6(M.matthews(p)), CLASS + ", z AS (SELECT (SELECT count(*)::DOUBLE FROM q) AS s, sum(tp)::DOUBLE AS c, sum((tp + fn)::DOUBLE * (tp + fp)) AS ot, sum((tp + fn)::DOUBLE * (tp + fn)) AS oo, sum((tp + fp)::DOUBLE * (tp + fp)) AS tt FROM m) SELECT ROUND((c * s - ot) / sqrt((s * s - tt) * (s * s - oo)), 6) + 0.0 AS value FROM z")
RANKED = ", e AS (SELECT rid, y_true, unnest(range(0, 10)) AS class, unnest(dist) AS x FROM q), o AS (SELECT class, (y_true = class)::INT AS own, row_number() OVER (PARTITION BY class ORDER BY x DESC, rid) AS i FROM e), b AS (SELECT class, own, sum(1 - own) OVER (PARTITION BY class ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM o), r AS (SELECT class, CAST(sum(own) AS BIGINT) AS size, sum(own * coalesce(after, 0)) / (sum(own) * sum(1 - own))::DOUBLE AS auroc FROM b GROUP BY class)"
measure_of("auroc_by_class", lambda p: M.area_under_roc(p, 10).select(F.col("class").cast("long").alias("class"), "size", F.round("auroc", 6).alias("auroc")), RANKED + " SELECT class, size, ROUND(auroc, 6) AS auroc FROM r")
measure_of("auroc_mean", lambda p: value6(M.mean_auroc(p, 10)), RANKED + " SELECT ROUND(sum(size * auroc) / sum(size), 6) + 0.0 AS value FROM r")
measure_of("roc_points", lambda p: M.roc_points(p, 3).select(F.round("threshold", 9).alias("threshold"), F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr")), ", g AS (SELECT dist[4] AS threshold, sum((y_true = 3)::INT) AS own, count(*) AS n FROM q GROUP BY 1), c AS (SELECT threshold, sum(own) OVER w AS o, sum(n) OVER w AS m, sum(own) OVER () AS ao, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY threshold DESC)) SELECT ROUND(threshold, 9) AS threshold, ROUND((m - o) / (an - ao)::DOUBLE, 6) AS fpr, ROUND(o / ao::DOUBLE, 6) AS tpr FROM c")
EARLY = "((rid % 10) + 1) / 10.0"
early = lambda p: p.withColumn("earliness", (F.col("rid") % 10 + 1) / 10)
measure("earliness", lambda p: M.earliness(early(p)), f"avg(({EARLY})::DOUBLE)")
measure("harmonic_mean", lambda p: M.harmonic_mean(early(p)), f"2 * avg({HIT}) * (1 - avg(({EARLY})::DOUBLE)) / (avg({HIT}) + 1 - avg(({EARLY})::DOUBLE))")
measure_of("confusion_matrix", lambda p: M.confusion(p), " SELECT y_true, y_pred, count(*) AS n FROM q GROUP BY 1, 2")

# clusterings: order status against priority
CELLS = "WITH t AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM t GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM t GROUP BY b), w AS (SELECT sum(n) AS w FROM t)"
PAIRS = CELLS + ", z AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS ij, (SELECT sum(na * (na - 1) / 2) FROM x) AS i, (SELECT sum(nb * (nb - 1) / 2) FROM y) AS j, w * (w - 1) / 2 AS e FROM w)"
INFO = CELLS + ", z AS (SELECT (SELECT sum(n / w * ln(n * w / (na * nb))) FROM t JOIN x USING (a) JOIN y USING (b), w) AS mi, (SELECT -sum(na / w * ln(na / w)) FROM x, w) AS ha, (SELECT -sum(nb / w * ln(nb / w)) FROM y, w) AS hb)"
AMI = INFO + ", k AS (SELECT na, nb, w, unnest(range(greatest(1, na + nb - w)::BIGINT, least(na, nb)::BIGINT + 1)) AS k FROM x, y, w), e AS (SELECT sum(k / w * ln(w * k / (na * nb)) * exp(lgamma(na + 1) + lgamma(nb + 1) + lgamma(w - na + 1) + lgamma(w - nb + 1) - lgamma(w + 1) - lgamma(k + 1) - lgamma(na - k + 1) - lgamma(nb - k + 1) - lgamma(w - na - nb + k + 1))) AS e FROM k)"


def clustering(name: str, f, sql: str) -> None:
    query(name, sql)(lambda s, d: value6(f(read(s, d, "orders"), "o_orderstatus", "o_orderpriority")))


clustering("rand_index", M.rand_index, PAIRS + " SELECT ROUND((e + 2 * ij - i - j) / e, 6) + 0.0 AS value FROM z")
clustering("adjusted_rand_index", M.adjusted_rand_index, PAIRS + " SELECT ROUND((ij - i * j / e) / ((i + j) / 2 - i * j / e), 6) + 0.0 AS value FROM z")
clustering("mutual_information", M.mutual_information, INFO + " SELECT ROUND(mi, 6) + 0.0 AS value FROM z")
clustering("normalised_mutual_information", M.normalised_mutual_information, INFO + " SELECT ROUND(mi / ((ha + hb) / 2), 6) + 0.0 AS value FROM z")
clustering("adjusted_mutual_information", M.adjusted_mutual_information, AMI + " SELECT ROUND((mi - e) / ((ha + hb) / 2 - e), 6) + 0.0 AS value FROM z, e")
clustering("clustering_accuracy", M.clustering_accuracy, CELLS + ", o AS (SELECT a, b, n FROM t), f AS (SELECT max(p.n + q.n + coalesce(r.n, 0)) AS best FROM o p JOIN o q ON p.a < q.a AND p.b <> q.b LEFT JOIN o r ON q.a < r.a AND r.b <> p.b AND r.b <> q.b) SELECT ROUND(best / w, 6) + 0.0 AS value FROM f, w")

query("regression_measures", "WITH r AS (SELECT l_extendedprice AS y, l_quantity * 1500.0 AS p FROM lineitem) SELECT ROUND(sqrt(avg((y - p) * (y - p))), 4) AS rmse, ROUND(avg((y - p) * (y - p)) / 1e4, 4) AS mse4, ROUND(avg(abs(y - p)), 4) AS mae, ROUND(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, ROUND(avg(abs(y - p) / greatest(abs(y), 2.22e-16)), 6) AS mape FROM r")(
    lambda s, d: M.regression(read(s, d, "lineitem").withColumn("p", F.col("l_quantity") * 1500.0), "l_extendedprice", "p").select(F.round("rmse", 4).alias("rmse"), F.round(F.col("mse") / 1e4, 4).alias("mse4"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("mape", 6).alias("mape"))
)
query("split_scores", "WITH t AS (SELECT l_linestatus AS s, l_returnflag AS c, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), i AS (SELECT s, sum(n) AS ni FROM t GROUP BY s), j AS (SELECT c, sum(n) AS nj FROM t GROUP BY c), w AS (SELECT sum(n) AS w FROM t), h AS (SELECT -sum(nj / w * log2(nj / w)) AS e, 1 - sum(nj / w * nj / w) AS g FROM j, w), a AS (SELECT sum(ni / w * e) AS e, sum(ni / w * g) AS g FROM (SELECT s, max(ni) AS ni, -sum(n / ni * log2(n / ni)) AS e, 1 - sum(n / ni * n / ni) AS g FROM t JOIN i USING (s) GROUP BY s), w), x AS (SELECT sum(n * n * w / (ni * nj)) - max(w) AS chi FROM t JOIN i USING (s) JOIN j USING (c), w) SELECT ROUND(h.e, 6) AS entropy, ROUND(h.g, 6) AS gini, ROUND(h.e - a.e, 6) AS information_gain, ROUND(h.g - a.g, 6) AS gini_gain, ROUND(chi, 4) AS chi_squared FROM h, a, x")(
    lambda s, d: M.split_scores(read(s, d, "lineitem"), "l_linestatus", "l_returnflag").select(*[F.round(c, 6).alias(c) for c in ("entropy", "gini", "information_gain", "gini_gain")], F.round("chi_squared", 4).alias("chi_squared"))
)

# experiments: estimators are line numbers, datasets suppliers by their last digit, folds orders
RESULTS = "WITH r AS (SELECT CAST(l_linenumber AS BIGINT) AS estimator, l_suppkey % 10 AS dataset, l_orderkey % 5 AS fold, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split, ROUND(avg(l_discount), 6) AS value FROM lineitem GROUP BY 1, 2, 3, 4), t AS (SELECT * FROM r WHERE split = 'test'), s AS (SELECT estimator, dataset, ROUND(avg(value), 6) AS value FROM t GROUP BY 1, 2)"


def results(spark, sf_dir) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy(F.col("l_linenumber").cast("long").alias("estimator"), (F.col("l_suppkey") % 10).alias("dataset"), (F.col("l_orderkey") % 5).alias("fold"), F.when(F.col("l_linestatus") == "F", "train").otherwise("test").alias("split")).agg(F.round(F.avg("l_discount"), 6).alias("value"))


def tests(spark, sf_dir) -> DataFrame:
    return results(spark, sf_dir).where("split = 'test'")


def scores(spark, sf_dir) -> DataFrame:
    return K.over_folds(tests(spark, sf_dir)).withColumn("value", F.round("value", 6))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.select([(F.round(c, 6) + 0.0).alias(c) if c in columns else F.col(c) for c in df.columns])


query("mean_over_folds", RESULTS + " SELECT * FROM s")(scores)
query("median_over_folds", RESULTS + " SELECT estimator, dataset, ROUND(median(value), 6) + 0.0 AS value FROM t GROUP BY 1, 2")(lambda s, d: r6(K.over_folds(tests(s, d), True), "value"))
query("deviation_over_folds", RESULTS + " SELECT estimator, dataset, ROUND(stddev_samp(value), 6) + 0.0 AS value FROM t GROUP BY 1, 2")(lambda s, d: r6(K.deviations(tests(s, d)), "value"))
TIED = ", k AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY value DESC) + (count(*) OVER (PARTITION BY dataset, value) - 1) / 2.0 AS rank FROM s)"
query("ranks", RESULTS + TIED + " SELECT estimator, dataset, value, CAST(rank AS DOUBLE) AS rank FROM k")(lambda s, d: K.ranks(scores(s, d)))
query("mean_ranks", RESULTS + TIED + " SELECT estimator, ROUND(avg(rank), 6) + 0.0 AS rank FROM k GROUP BY 1")(lambda s, d: r6(K.mean_ranks(scores(s, d)), "rank"))
query("wins_draws_losses", RESULTS + " SELECT x.estimator AS a, y.estimator AS b, CAST(sum((x.value > y.value)::INT) AS BIGINT) AS wins, CAST(sum((x.value = y.value)::INT) AS BIGINT) AS draws, CAST(sum((x.value < y.value)::INT) AS BIGINT) AS losses FROM s x JOIN s y ON x.dataset = y.dataset AND x.estimator <> y.estimator GROUP BY 1, 2")(lambda s, d: K.wins_draws_losses(scores(s, d)))
TT = ", d AS (SELECT x.estimator AS a, y.estimator AS b, x.dataset, x.value - y.value AS d FROM t x JOIN t y ON x.dataset = y.dataset AND x.fold = y.fold AND x.estimator <> y.estimator), pt AS (SELECT a, b, dataset, count(*) AS n, CASE WHEN stddev_samp(d) = 0 THEN NULL ELSE avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM d GROUP BY 1, 2, 3)"
query("paired_t", RESULTS + TT + " SELECT a, b, dataset, n, ROUND(t, 4) + 0.0 AS t FROM pt")(lambda s, d: K.paired_t(tests(s, d)).withColumn("t", F.round("t", 4) + 0.0))
query("significant_wins", RESULTS + TT + ", f AS (SELECT *, CASE n - 1 WHEN 1 THEN 12.706 WHEN 2 THEN 4.303 WHEN 3 THEN 3.182 WHEN 4 THEN 2.776 END AS q FROM pt) SELECT a, b, CAST(count(*) FILTER (WHERE t > q) AS BIGINT) AS wins, CAST(count(*) - count(*) FILTER (WHERE abs(t) > q) AS BIGINT) AS draws, CAST(count(*) FILTER (WHERE t < -q) AS BIGINT) AS losses FROM f GROUP BY 1, 2")(lambda s, d: K.significant_wins(tests(s, d)))
query("by_dataset_group", RESULTS + ", z AS (SELECT *, dataset % 2 AS grp, max(value) OVER (PARTITION BY dataset) AS best FROM s) SELECT grp AS \"group\", estimator, ROUND(avg(value), 6) + 0.0 AS value, CAST(sum((value = best)::INT) AS BIGINT) AS wins FROM z GROUP BY 1, 2")(lambda s, d: r6(K.by_group(scores(s, d), scores(s, d).select("dataset", (F.col("dataset") % 2).alias("group")).distinct()), "value"))
query("train_test_differences", RESULTS + " SELECT a.estimator, a.dataset, a.fold, ROUND(a.value - b.value, 6) + 0.0 AS value FROM r a JOIN r b ON a.estimator = b.estimator AND a.dataset = b.dataset AND a.fold = b.fold AND a.split = 'train' AND b.split = 'test'")(lambda s, d: r6(K.train_test_differences(results(s, d)), "value"))
query("estimator_summary", RESULTS + TIED + ", z AS (SELECT *, max(value) OVER (PARTITION BY dataset) AS top FROM k) SELECT estimator, ROUND(avg(value), 6) + 0.0 AS mean, ROUND(stddev_samp(value), 6) + 0.0 AS sd, min(value) AS least, max(value) AS most, ROUND(avg(rank), 6) + 0.0 AS rank, CAST(sum((value = top)::INT) AS BIGINT) AS best FROM z GROUP BY 1")(lambda s, d: r6(K.summary(scores(s, d)), "mean", "sd", "rank"))
query("results_cube", RESULTS + " SELECT estimator, dataset, count(*) AS n, ROUND(avg(value), 6) + 0.0 AS value FROM t GROUP BY CUBE (estimator, dataset)")(lambda s, d: r6(K.cube(tests(s, d), "estimator", "dataset"), "value"))
query("complete_results", RESULTS + ", f AS (SELECT dataset, fold FROM t GROUP BY 1, 2 HAVING count(DISTINCT estimator) = (SELECT count(DISTINCT estimator) FROM t)) SELECT dataset, fold, estimator, split, value FROM t JOIN f USING (dataset, fold)")(lambda s, d: K.complete(tests(s, d)).select("dataset", "fold", "estimator", "split", "value"))
query("friedman", RESULTS + TIED + ", m AS (SELECT estimator, avg(rank) AS r, count(*) AS n FROM k GROUP BY 1), z AS (SELECT count(*)::DOUBLE AS k, max(n)::DOUBLE AS n, sum(r * r) AS q FROM m) SELECT CAST(k AS BIGINT) AS estimators, CAST(n AS BIGINT) AS datasets, ROUND(12 * n / (k * (k + 1)) * (q - k * (k + 1) * (k + 1) / 4), 4) AS statistic FROM z")(lambda s, d: K.friedman(scores(s, d)).withColumn("statistic", F.round("statistic", 4)))
SIGNED = ", d AS (SELECT x.estimator AS a, y.estimator AS b, x.value - y.value AS d FROM s x JOIN s y ON x.dataset = y.dataset AND x.estimator < y.estimator WHERE x.value <> y.value), k AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS rank FROM d)"
query("pairwise_signed_rank", RESULTS + SIGNED + ", z AS (SELECT a, b, count(*) AS n, coalesce(sum(rank) FILTER (WHERE d > 0), 0)::DOUBLE AS w_plus FROM k GROUP BY 1, 2) SELECT a, b, n, w_plus, ROUND((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 6) + 0.0 AS statistic FROM z")(lambda s, d: r6(K.pairwise_signed_rank(scores(s, d)).drop("p"), "statistic"))
query("holm")(lambda s, d: K.holm(K.pairwise_signed_rank(scores(s, d))).select("a", "b", "n", F.round("p", 6).alias("p"), "rejected"))

# tests of samples: balances of customers
S = "WITH c AS (SELECT c_custkey AS k, ROUND(c_acctbal / 100) AS x, c_mktsegment AS g FROM customer)"


def sample(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.round(F.col("c_acctbal") / 100).alias("x"), F.col("c_mktsegment").alias("g"))


def r4(df: DataFrame, *columns: str) -> DataFrame:
    return df.select([(F.round(c, 4) + 0.0).alias(c) if c in (columns or ("statistic",)) else F.col(c) for c in df.columns])


RANK = ", f AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rank FROM c)"
query("one_sample_t", S + " SELECT count(x) AS n, ROUND((avg(x) - 45) / (stddev_samp(x) / sqrt(count(x))), 4) + 0.0 AS statistic FROM c")(lambda s, d: r4(K.one_sample_t(sample(s, d), "x", 45.0)))
query("sign_test", S + ", z AS (SELECT count(*) FILTER (WHERE x <> 45) AS n, count(*) FILTER (WHERE x > 45) AS above FROM c) SELECT n, above, ROUND((above - n / 2.0) / sqrt(n / 4.0), 4) + 0.0 AS statistic FROM z")(lambda s, d: r4(K.sign_test(sample(s, d), "x", 45.0)))
query("signed_rank", S + ", d AS (SELECT x - 45 AS d FROM c WHERE x <> 45), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rank FROM d), z AS (SELECT count(*) AS n, sum(rank) FILTER (WHERE d > 0)::DOUBLE AS w_plus FROM k) SELECT n, w_plus, ROUND((w_plus - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 4) + 0.0 AS statistic FROM z")(lambda s, d: r4(K.signed_rank(sample(s, d), "x", 45.0)))
query("rank_sum", S + RANK + ", z AS (SELECT count(*) FILTER (WHERE g = 'BUILDING')::DOUBLE AS n, count(*) FILTER (WHERE g <> 'BUILDING')::DOUBLE AS m, sum(rank) FILTER (WHERE g = 'BUILDING')::DOUBLE AS w FROM f) SELECT n, m, w, w - n * (n + 1) / 2 AS u, ROUND((w - n * (n + 1) / 2 - n * m / 2) / sqrt(n * m * (n + m + 1) / 12), 4) + 0.0 AS statistic FROM z")(lambda s, d: r4(K.rank_sum(sample(s, d), "x", "g", "BUILDING")))
TWO = ", z AS (SELECT count(*) FILTER (WHERE g = 'BUILDING')::DOUBLE AS n1, count(*) FILTER (WHERE g <> 'BUILDING')::DOUBLE AS n2, avg(x) FILTER (WHERE g = 'BUILDING') AS m1, avg(x) FILTER (WHERE g <> 'BUILDING') AS m2, var_samp(x) FILTER (WHERE g = 'BUILDING') AS v1, var_samp(x) FILTER (WHERE g <> 'BUILDING') AS v2 FROM c)"
query("two_sample_t", S + TWO + " SELECT n1 + n2 - 2 AS freedom, ROUND((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 4) + 0.0 AS statistic FROM z")(lambda s, d: r4(K.two_sample_t(sample(s, d), "x", "g", "BUILDING")))
query("two_sample_t_unequal", S + TWO + " SELECT ROUND(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) + 0.0 AS freedom, ROUND((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 4) + 0.0 AS statistic FROM z")(lambda s, d: r4(K.two_sample_t(sample(s, d), "x", "g", "BUILDING", False), "freedom", "statistic"))
query("kruskal_wallis", S + RANK + ", q AS (SELECT count(*)::DOUBLE AS n, sum(rank) AS r FROM f GROUP BY g), t AS (SELECT sum(m * m * m - m) AS ties FROM (SELECT count(*)::DOUBLE AS m FROM c GROUP BY x)), z AS (SELECT count(*) AS groups, sum(n) AS n, sum(r * r / n) AS s FROM q) SELECT groups, CAST(n AS BIGINT) AS n, ROUND((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) + 0.0 AS statistic FROM z, t")(lambda s, d: r4(K.kruskal_wallis(sample(s, d), "x", "g")))
query("moods_median", S + ", a AS (SELECT g, x > (SELECT median(x) FROM c) AS up FROM c), t AS (SELECT g, up, count(*)::DOUBLE AS n FROM a GROUP BY 1, 2), i AS (SELECT g, sum(n) AS ni FROM t GROUP BY g), j AS (SELECT up, sum(n) AS nj FROM t GROUP BY up), w AS (SELECT sum(n) AS w FROM t) SELECT ROUND(sum(n * n * w / (ni * nj)) - max(w), 4) + 0.0 AS statistic FROM t JOIN i USING (g) JOIN j USING (up), w")(lambda s, d: r4(K.moods_median(sample(s, d), "x", "g")))
query("f_ratio", S + ", p AS (SELECT count(*)::DOUBLE AS n, avg(x) AS m, var_pop(x) AS v FROM c GROUP BY g), z AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s1, sum(n * m * m) AS s2, sum(n * v) AS w FROM p) SELECT ROUND(((s2 - s1 * s1 / n) / (k - 1)) / (w / (n - k)), 4) + 0.0 AS statistic FROM z")(lambda s, d: r4(K.f_ratio(sample(s, d), "x", "g")))
query("tied_ranks", S + RANK + " SELECT k, CAST(rank AS DOUBLE) AS rank FROM f")(lambda s, d: K.ranked(sample(s, d), "x").select("k", "rank"))
RES = S + ", e AS (SELECT k, x - (SELECT avg(x) FROM c) AS r, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM c)"
residuals = lambda s, d: sample(s, d).join(F.broadcast(sample(s, d).agg(F.avg("x").alias("m")))).withColumn("r", F.col("x") - F.col("m"))
query("goldfeld_quandt", RES + " SELECT ROUND(sum(r * r) FILTER (WHERE i >= n - floor(n * 0.8 / 2)) / sum(r * r) FILTER (WHERE i < floor(n * 0.8 / 2)), 4) + 0.0 AS statistic FROM e")(lambda s, d: r4(K.goldfeld_quandt(residuals(s, d), "k", "r")))
query("runs_test", RES + ", u AS (SELECT r >= 0 AS up, lag(r >= 0) OVER (ORDER BY i) AS was FROM e), z AS (SELECT count(*) FILTER (WHERE was IS NULL OR was <> up) AS runs, count(*) FILTER (WHERE up)::DOUBLE AS p, count(*) FILTER (WHERE NOT up)::DOUBLE AS q FROM u), m AS (SELECT *, 2 * p * q / (p + q) + 1 AS mean FROM z) SELECT runs, ROUND((runs - mean) / sqrt((mean - 1) * (mean - 2) / (p + q - 1)), 4) + 0.0 AS statistic FROM m")(lambda s, d: r4(K.runs_test(residuals(s, d), "k", "r")))

# ensembles of three modules; odd rows train the weights, even rows are voted on
TRAIN, TEST = "WHERE rid % 2 = 1", "WHERE rid % 2 = 0"
ACC = f", a AS (SELECT module, avg({HIT}) AS acc FROM q {TRAIN} GROUP BY module)"


def both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = predictions(spark, sf_dir, (0, 10, 20)).withColumnRenamed("dist", "p")
    return p.where("rid % 2 = 1"), p.where("rid % 2 = 0")


def weighting(name: str, by: str, sql: str, power: float = 1.0) -> None:
    query(f"weights_{name}", THREE + sql)(lambda s, d: r6(V.weigh(both(s, d)[0], by, power), "weight"))


weighting("equal", "equal", " SELECT DISTINCT module, 1.0::DOUBLE AS weight FROM q")
weighting("accuracy", "accuracy", ACC + " SELECT module, ROUND(pow(acc, 4), 6) + 0.0 AS weight FROM a", 4.0)
weighting("proportional", "proportional", ACC + " SELECT module, ROUND(acc / sum(acc) OVER (), 6) + 0.0 AS weight FROM a")
weighting("mean_corrected", "mean_corrected", ACC + " SELECT module, ROUND(greatest(acc - avg(acc) OVER (), 0), 6) + 0.0 AS weight FROM a")
weighting("max_corrected", "max_corrected", ACC + " SELECT module, ROUND(acc / max(acc) OVER (), 6) + 0.0 AS weight FROM a")
weighting("nll", "nll", f" SELECT module, ROUND(1 / avg(-log2(dist[y_true + 1])), 6) + 0.0 AS weight FROM q {TRAIN} GROUP BY module")
RECALL = f", r AS (SELECT module, y_true AS class, avg({HIT}) AS r, sum({HIT}) AS tp, count(*) AS own FROM q {TRAIN} GROUP BY 1, 2), sd AS (SELECT module, y_pred AS class, count(*) AS said FROM q {TRAIN} GROUP BY 1, 2)"
weighting("balanced_accuracy", "balanced_accuracy", RECALL + " SELECT module, ROUND(avg(r), 6) + 0.0 AS weight FROM r GROUP BY 1")
weighting("recall_by_class", "recall_by_class", RECALL + " SELECT module, class, ROUND(r, 6) + 0.0 AS weight FROM r")
weighting("f1", "f1", RECALL + " SELECT module, ROUND(avg(2 * greatest(tp, 1e-7) / (own + coalesce(said, 0) - 2 * tp + 2 * greatest(tp, 1e-7))), 6) + 0.0 AS weight FROM r LEFT JOIN sd USING (module, class) GROUP BY 1")
weighting("mcc", "mcc", RECALL + ", z AS (SELECT module, sum(own::DOUBLE * coalesce(said, 0)) AS os, sum(own::DOUBLE * own) AS oo, sum(tp) AS hit, sum(own)::DOUBLE AS n FROM r LEFT JOIN sd USING (module, class) GROUP BY 1), y AS (SELECT module, sum(said::DOUBLE * said) AS ss FROM sd GROUP BY 1) SELECT module, ROUND(((hit * n - os) / sqrt((n * n - ss) * (n * n - oo)) + 1) / 2, 6) + 0.0 AS weight FROM z JOIN y USING (module)")


def vote(name: str, f, sql: str) -> None:
    pick = ", o AS (SELECT rid, class, score, row_number() OVER (PARTITION BY rid ORDER BY ROUND(score, 9) DESC, class) AS i FROM v) SELECT rid, CAST(class AS BIGINT) AS predicted, ROUND(score, 6) + 0.0 AS score FROM o WHERE i = 1"
    query(f"vote_{name}", THREE + ACC + sql + pick)(lambda s, d: r6(f(*both(s, d)).withColumn("predicted", F.col("predicted").cast("long")), "score"))


E1 = f", e AS (SELECT module, rid, unnest(range(0, 10)) AS class, unnest(dist) AS x FROM q {TEST})"
vote("majority", lambda tr, te: V.majority_vote(te, V.weigh(tr)), f", v AS (SELECT rid, y_pred AS class, sum(acc) AS score FROM q JOIN a USING (module) {TEST} GROUP BY 1, 2)")
vote("majority_confidence", lambda tr, te: V.majority_confidence(te, V.weigh(tr)), E1 + ", v AS (SELECT rid, class, sum(acc * x) / sum(acc) AS score FROM e JOIN a USING (module) GROUP BY 1, 2)")
vote("cawpe", lambda tr, te: V.cawpe(tr, te), E1 + ", v AS (SELECT rid, class, sum(pow(acc, 4) * x) / sum(pow(acc, 4)) AS score FROM e JOIN a USING (module) GROUP BY 1, 2)")
vote("by_confidence", lambda tr, te: V.vote_by_confidence(te, V.weigh(tr)), f", v AS (SELECT rid, y_pred AS class, sum(acc * list_max(dist)) AS score FROM q JOIN a USING (module) {TEST} GROUP BY 1, 2)")
vote("by_powered_confidence", lambda tr, te: V.vote_by_confidence(te, V.weigh(tr), power=3.0), f", v AS (SELECT rid, y_pred AS class, sum(acc * pow(list_max(dist), 3)) AS score FROM q JOIN a USING (module) {TEST} GROUP BY 1, 2)")
vote("by_corrected_confidence", lambda tr, te: V.vote_by_confidence(te, V.weigh(tr), correct=0.1), f", v AS (SELECT rid, y_pred AS class, sum(acc * greatest(list_max(dist) - 0.1, 0)) AS score FROM q JOIN a USING (module) {TEST} GROUP BY 1, 2)")
vote("average_by_confidence", lambda tr, te: V.vote_by_confidence(te, V.weigh(tr), mean=True), f", v AS (SELECT rid, y_pred AS class, avg(acc * list_max(dist)) AS score FROM q JOIN a USING (module) {TEST} GROUP BY 1, 2)")
vote("highest_probability", lambda tr, te: V.highest_probability(te), E1 + ", v AS (SELECT rid, class, max(x) AS score FROM e GROUP BY 1, 2)")
vote("best_individual", lambda tr, te: V.best_individual(tr, te), f", b AS (SELECT module FROM a ORDER BY acc DESC, module LIMIT 1), v AS (SELECT rid, y_pred AS class, list_max(dist) AS score FROM q JOIN b USING (module) {TEST})")
vote("bayes", lambda tr, te: V.bayes_combination(tr, te, 10), f", n AS (SELECT module, y_true AS class, y_pred AS said, count(*) AS n FROM q {TRAIN} GROUP BY 1, 2, 3), w AS (SELECT module, y_true AS class, count(*) AS own FROM q {TRAIN} GROUP BY 1, 2), x AS (SELECT module, rid, y_pred AS said, unnest(range(0, 10)) AS class FROM q {TEST}), v AS (SELECT rid, class, sum(ln((coalesce(n, 0) + 1) / (coalesce(own, 0) + 10)::DOUBLE)) AS score FROM x LEFT JOIN w USING (module, class) LEFT JOIN n USING (module, class, said) GROUP BY 1, 2)")

# attributes of line items against the return flag
ATTRIBUTES = ["l_linestatus", "l_linenumber", "l_tax"]
LI = "WITH l AS (SELECT * FROM lineitem)"


def _attribute_sql(measure: str) -> str:
    def of(a: str) -> str:
        t = f"(SELECT {a} AS a, l_returnflag AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2)"
        return f"SELECT '{a}' AS attribute, ROUND({measure}, 6) + 0.0 AS value FROM (SELECT sum(n / w * log2(n * w / (na * nb))) AS gain, max(ha) AS ha, max(hb) AS hb, sum(n * n * w / (na * nb)) - max(w) AS chi FROM (SELECT *, sum(n) OVER () AS w, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM {t}), (SELECT -sum(na / w * log2(na / w)) AS ha FROM (SELECT sum(n) AS na, sum(sum(n)) OVER () AS w FROM {t} GROUP BY a)), (SELECT -sum(nb / w * log2(nb / w)) AS hb FROM (SELECT sum(n) AS nb, sum(sum(n)) OVER () AS w FROM {t} GROUP BY b)))"

    return " UNION ALL ".join(of(a) for a in ATTRIBUTES)


def attribute(name: str, measure_name: str, sql: str) -> None:
    query(name, _attribute_sql(sql))(lambda s, d: r6(A.scores(read(s, d, "lineitem"), ATTRIBUTES, "l_returnflag", measure_name), "value"))


attribute("attribute_information_gain", "information_gain", "gain")
attribute("attribute_gain_ratio", "gain_ratio", "gain / ha")
attribute("attribute_symmetrical_uncertainty", "symmetrical_uncertainty", "2 * gain / (ha + hb)")
attribute("attribute_chi_squared", "chi_squared", "chi")
query("attribute_correlation", " UNION ALL ".join(f"SELECT '{a}' AS attribute, ROUND(corr({a}, l_extendedprice), 6) + 0.0 AS value FROM lineitem" for a in ("l_quantity", "l_discount", "l_tax")))(lambda s, d: r6(A.correlations(read(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "value"))
query("attribute_one_rule", " UNION ALL ".join(f"SELECT '{a}' AS attribute, ROUND(sum(hit) / sum(n)::DOUBLE, 6) + 0.0 AS value FROM (SELECT max(n) AS hit, sum(n) AS n FROM (SELECT {a} AS a, count(*) AS n FROM lineitem GROUP BY {a}, l_returnflag) GROUP BY a)" for a in ATTRIBUTES))(lambda s, d: r6(A.one_rule(read(s, d, "lineitem"), ATTRIBUTES, "l_returnflag"), "value"))
query("attribute_consistency", "SELECT ROUND(sum(hit) / sum(n)::DOUBLE, 6) + 0.0 AS value FROM (SELECT max(n) AS hit, sum(n) AS n FROM (SELECT l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_linestatus, l_linenumber, l_returnflag) GROUP BY l_linestatus, l_linenumber)")(lambda s, d: value6(A.consistency(read(s, d, "lineitem"), ["l_linestatus", "l_linenumber"], "l_returnflag")))
query("attribute_ranking", f"SELECT * FROM ({_attribute_sql('gain')}) ORDER BY value DESC, attribute LIMIT 2")(lambda s, d: A.top(r6(A.scores(read(s, d, "lineitem"), ATTRIBUTES, "l_returnflag", "information_gain"), "value"), 2))
query("attribute_relief")(lambda s, d: r6(A.relief(read(s, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double")).alias("v")), [f"e{i}" for i in range(8)], "label", "vec_id", "v", 5), "value"))
query("attribute_subset")(lambda s, d: s.createDataFrame([(x,) for x in A.greedy_subset(read(s, d, "lineitem"), ATTRIBUTES, "l_returnflag")], "attribute string"))

# rules among the parts of an order's lines
BASKETS = "WITH b AS (SELECT DISTINCT l_orderkey, 'line' || l_linenumber AS item FROM lineitem UNION SELECT DISTINCT l_orderkey, 'flag' || l_returnflag FROM lineitem), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM b)"


def baskets(spark, sf_dir) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")  # noqa: E741
    items = F.explode(F.array(F.concat(F.lit("line"), "l_linenumber"), F.concat(F.lit("flag"), "l_returnflag")))
    return l.select("l_orderkey", items.alias("item")).groupBy("l_orderkey").agg(F.collect_set("item").alias("items"))


query("frequent_pairs", BASKETS + " SELECT a.item || ' ' || b.item AS items, count(*) AS freq FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.item < b.item GROUP BY 1 HAVING count(*) >= 0.2 * (SELECT n FROM n)")(lambda s, d: A.frequent_itemsets(baskets(s, d), "items", 0.2).where("size(items) = 2").select(F.array_join("items", " ").alias("items"), "freq"))
query("association_rules", BASKETS + ", i AS (SELECT item, count(*)::DOUBLE AS c FROM b GROUP BY 1), p AS (SELECT a.item AS x, b.item AS y, count(*)::DOUBLE AS c FROM b a JOIN b ON a.l_orderkey = b.l_orderkey AND a.item <> b.item GROUP BY 1, 2) SELECT x AS antecedent, y AS consequent, ROUND(p.c / i.c, 6) AS confidence, ROUND(p.c / i.c / (j.c / n), 6) AS lift, ROUND(p.c / n - i.c / n * j.c / n, 6) + 0.0 AS leverage FROM p JOIN i ON x = i.item JOIN i j ON y = j.item, n WHERE p.c >= 0.2 * n AND p.c / i.c >= 0.5")(
    lambda s, d: A.rules(baskets(s, d), "items", 0.2, 0.5).where("size(antecedent) = 1 and size(consequent) = 1").select(F.get("antecedent", F.lit(0)).alias("antecedent"), F.get("consequent", F.lit(0)).alias("consequent"), F.round("confidence", 6).alias("confidence"), F.round("lift", 6).alias("lift"), (F.round("leverage", 6) + 0.0).alias("leverage"))
)
query("frequent_sequences", "WITH e AS (SELECT user_id, event_type FROM events), n AS (SELECT count(DISTINCT user_id) AS n FROM e) SELECT event_type AS sequence, count(DISTINCT user_id) AS freq FROM e GROUP BY 1 HAVING count(DISTINCT user_id) >= 0.3 * (SELECT n FROM n)")(
    lambda s, d: A.frequent_sequences(read(s, d, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: F.array(x["event_type"])).alias("seq")), "seq", 0.3, 1).select(F.get(F.get("sequence", F.lit(0)), F.lit(0)).alias("sequence"), "freq")
)
