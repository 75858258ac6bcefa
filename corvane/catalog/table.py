"""Queries of the table layer: rows, columns, sampling, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.operators import columns as C
from corvane.operators import metrics as M
from corvane.operators import rows as R
from corvane.registry import query, read

CTE = "WITH c AS (SELECT c_custkey AS k, c_acctbal AS x, c_mktsegment AS g, CAST(c_nationkey AS BIGINT) AS n, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS xm FROM customer) "


def cust(spark, sf_dir) -> DataFrame:
    """Customers as (k, x, g, n, xm): xm is x with every seventh missing."""
    x = F.col("c_acctbal")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), x.alias("x"), F.col("c_mktsegment").alias("g"), F.col("c_nationkey").cast("long").alias("n"), F.when(F.col("c_custkey") % 7 != 0, x).alias("xm"))


def u(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5('{seed}-' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def place(order: str, by: str = "") -> str:
    return f"CAST(row_number() OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY {order}) - 1 AS BIGINT)"


HASH = "md5('0-' || CAST(k AS VARCHAR)), k"


def on_customers(name: str, f, sql: str) -> None:
    query(name, CTE + sql)(lambda spark, sf_dir: f(cust(spark, sf_dir)))


def r6(c: str, name: str | None = None):
    return (F.round(c, 6) + 0.0).alias(name or c)


# rows
on_customers("rows_without_missing", lambda c: R.drop_missing(c, "xm").select("k", "xm"), "SELECT k, xm FROM c WHERE xm IS NOT NULL")
on_customers("rows_deleted_by_position", lambda c: R.without(R.numbered(c, "k"), "rid", 0, 5, 9).select("k", "rid"), f"SELECT * FROM (SELECT k, {place('k')} AS rid FROM c) WHERE rid NOT IN (0, 5, 9)")
on_customers("rows_all_deleted", lambda c: C.drop_all(c).select("k"), "SELECT k FROM c WHERE false")
on_customers("rows_identity", lambda c: C.keep_all(c).select("k", "xm"), "SELECT k, xm FROM c")
on_customers("rows_numbered", lambda c: R.numbered(c, "k").select("k", "rid"), f"SELECT k, {place('k')} AS rid FROM c")
on_customers("kth_smallest", lambda c: R.kth_smallest(c, "xm", "k", 17), "SELECT xm FROM (SELECT xm, row_number() OVER (ORDER BY xm NULLS LAST, k) AS i FROM c) WHERE i = 17")
on_customers("mean_weighted", lambda c: R.mean_or_mode(c, "xm", F.col("n") + 1).select(r6("value")), "SELECT ROUND(sum(xm * (n + 1)) / sum(CASE WHEN xm IS NOT NULL THEN n + 1 END), 6) + 0.0 AS value FROM c")
on_customers("mode", lambda c: R.mean_or_mode(c, "g"), "SELECT g AS value FROM c GROUP BY g ORDER BY count(*) DESC, g LIMIT 1")
on_customers("variance_weighted", lambda c: R.weighted_variance(c.withColumn("w", F.col("n") + 1), "xm", "w").select(F.round(F.col("value") / 1e4, 6).alias("value")), "SELECT ROUND((s2 - s1 * s1 / s) / (s - 1) / 1e4, 6) AS value FROM (SELECT sum(w) AS s, sum(w * xm) AS s1, sum(w * xm * xm) AS s2 FROM (SELECT CASE WHEN xm IS NOT NULL THEN n + 1 END AS w, xm FROM c))")
on_customers("sum_of_weights", lambda c: R.sum_of_weights(c, "x").select(F.round("value", 2).alias("value")), "SELECT ROUND(sum(x), 2) AS value FROM c")
on_customers("rows_sorted", lambda c: R.positions(c, [F.col("xm").asc_nulls_last(), F.col("k")], F.col("xm")).select("k", "position"), f"SELECT k, {place('xm NULLS LAST, k')} AS position FROM c")
on_customers("rows_shuffled", lambda c: R.shuffled(c, 0, "k").select("k", "position"), f"SELECT k, {place(HASH)} AS position FROM c")
on_customers("bootstrap", lambda c: R.bootstrap(c, "k").select("draw", "k"), f", r AS (SELECT k, {place('k')} AS rid FROM c), d AS (SELECT i AS draw, CAST(floor({u('0', 'i')} * (SELECT count(*) FROM c)) AS BIGINT) AS rid FROM range((SELECT count(*) FROM c)) t(i)) SELECT draw, k FROM d JOIN r USING (rid)")
on_customers("bootstrap_weighted", lambda c: R.weighted_bootstrap(c.withColumn("w", F.col("n") + 1), "k", "w").select("draw", "k"), f", r AS (SELECT k, sum(n + 1) OVER (ORDER BY k) AS hi, n + 1 AS w FROM c), d AS (SELECT i AS draw, {u('0', 'i')} * (SELECT sum(n + 1) FROM c) AS v FROM range((SELECT count(*) FROM c)) t(i)) SELECT draw, k FROM d JOIN r ON v < hi AND v >= hi - w")
FOLD = "ntile(10) OVER (ORDER BY k) - 1"
on_customers("contiguous_folds", lambda c: R.contiguous_folds(c, "k", 10).select("k", "fold"), f"SELECT k, CAST({FOLD} AS BIGINT) AS fold FROM c")
on_customers("fold_test_rows", lambda c: R.contiguous_folds(c, "k", 10).where("fold = 3").select("k"), f"SELECT k FROM (SELECT k, {FOLD} AS fold FROM c) WHERE fold = 3")
on_customers("fold_train_rows", lambda c: R.contiguous_folds(c, "k", 10).where("fold <> 3").select("k"), f"SELECT k FROM (SELECT k, {FOLD} AS fold FROM c) WHERE fold <> 3")
on_customers("folds_by_class", lambda c: R.stratified_folds(c, "k", "g", 10).select("k", "fold"), f"SELECT k, {place(HASH, 'g')} % 10 AS fold FROM c")
on_customers("split_by_class", lambda c: R.stratified_split(c, "k", "g", 0.5).select("k", "train"), f"SELECT k, {place(HASH, 'g')} < floor(count(*) OVER (PARTITION BY g) * 0.5) AS train FROM c")
on_customers("split_anew", lambda c: R.resplit(c.where("k % 3 = 0"), c.where("k % 3 <> 0"), "k", "g", 7).select("k", "train"), f"SELECT k, {place(HASH.replace('0-', '7-'), 'g')} < count(*) FILTER (WHERE k % 3 = 0) OVER (PARTITION BY g) AS train FROM c")
on_customers("split_seed_zero", lambda c: R.resplit(c.where("k % 3 = 0"), c.where("k % 3 <> 0"), "k", "g", 0).select("k", "train"), "SELECT k, k % 3 = 0 AS train FROM c")
on_customers("leave_one_value_out", lambda c: R.leave_one_out(c, "g", 1).select("k", "train"), "SELECT k, dense_rank() OVER (ORDER BY g) - 1 <> 1 AS train FROM c")
on_customers("sample_without_replacement", lambda c: R.sample(c, "k", 100).select("k"), f"SELECT k FROM c ORDER BY {HASH} LIMIT 100")
on_customers("sample_share", lambda c: R.sample_fraction(c, "k", 0.3).select("k"), f"SELECT k FROM (SELECT k, {place(HASH)} AS i FROM c) WHERE i < floor(0.3 * (SELECT count(*) FROM c))")
on_customers("sample_share_inverted", lambda c: R.sample_fraction(c, "k", 0.3, invert=True).select("k"), f"SELECT k FROM (SELECT k, {place(HASH)} AS i FROM c) WHERE i >= floor(0.3 * (SELECT count(*) FROM c))")
on_customers("sample_by_class", lambda c: R.sample_by_class(c, "k", "g", 0.2).select("k"), f"SELECT k FROM (SELECT k, {place(HASH, 'g')} AS i, count(*) OVER (PARTITION BY g) AS m FROM c) WHERE i < floor(m * 0.2)")
on_customers("spread_subsample", lambda c: R.spread(c, "k", "n", 1.0).select("k"), f"SELECT k FROM (SELECT k, {place(HASH, 'n')} AS i FROM c) WHERE i < (SELECT min(m) FROM (SELECT count(*) AS m FROM c GROUP BY n))")
on_customers("resample_to_uniform", lambda c: R.resample_to_uniform(c, "k", "g", 0.5, 1.0).select("k"), f"SELECT k FROM (SELECT k, {place(HASH, 'g')} AS i FROM c) WHERE i < floor(0.5 * (SELECT count(*) FROM c) / (SELECT count(DISTINCT g) FROM c))")
on_customers("round_robin", lambda c: R.round_robin(c, "k", "g").select("k", "turn"), f"SELECT k, {place(HASH, 'g')} AS turn FROM c")
on_customers("reservoir", lambda c: R.reservoir(c, "k", 50, 3).select("k"), f"SELECT k FROM c ORDER BY {HASH.replace('0-', '3-')} LIMIT 50")
on_customers("with_values_numeric", lambda c: R.with_values(c, "xm", split=1000.0).select("k"), "SELECT k FROM c WHERE xm < 1000 OR xm IS NULL")
on_customers("with_values_nominal", lambda c: R.with_values(c, "g", keep=["BUILDING", "MACHINERY"], invert=True, match_missing=True).select("k"), "SELECT k FROM c WHERE g NOT IN ('BUILDING', 'MACHINERY')")
on_customers("rows_after_share", lambda c: R.drop_share(c, "k", 0.4).select("k"), f"SELECT k FROM (SELECT k, {place('k')} AS i FROM c) WHERE i >= round((SELECT count(*) FROM c) * 0.4)")
on_customers("rows_of_range", lambda c: R.numbered(c, "k").where(F.col("rid").isin(R.selected("first-3,7,12-15", 1500))).select("k"), f"SELECT k FROM (SELECT k, {place('k')} AS i FROM c) WHERE i IN (0, 1, 2, 6, 11, 12, 13, 14)")
on_customers("most_frequent_values", lambda c: R.frequent(c, "n", 2).select("k", "n"), "SELECT k, n FROM c WHERE n IN (SELECT n FROM c GROUP BY n ORDER BY count(*) DESC, n LIMIT 2)")
on_customers("least_frequent_values", lambda c: R.frequent(c, "n", 3, least=True).select("k", "n"), "SELECT k, n FROM c WHERE n IN (SELECT n FROM c GROUP BY n ORDER BY count(*), n LIMIT 3)")
on_customers("lagged", lambda c: R.moved(c.select("k", "x"), "k", ["x"], -1), "SELECT k, lag(x) OVER (ORDER BY k) AS x FROM c")
on_customers("lagged_difference", lambda c: R.moved(c.select("k", "x"), "k", ["x"], -2, difference=True, fill=False).select("k", r6("x")), "SELECT k, ROUND(x - y, 6) + 0.0 AS x FROM (SELECT k, x, lag(x, 2) OVER (ORDER BY k) AS y FROM c) WHERE y IS NOT NULL")
on_customers("leading_by_group", lambda c: R.moved(c.select("g", "k", "x"), "k", ["x"], 1, group=["g"]), "SELECT g, k, lead(x) OVER (PARTITION BY g ORDER BY k) AS x FROM c")
on_customers("side_by_side", lambda c: R.zipped(c.select("k", "x"), c.select((-F.col("k")).alias("other"), F.col("g").alias("other_g")), "k", "other").select("k", "x", "other_g"), f"SELECT a.k, a.x, b.g AS other_g FROM (SELECT *, {place('k')} AS i FROM c) a JOIN (SELECT *, {place('k DESC')} AS i FROM c) b USING (i)")
on_customers("concatenated", lambda c: R.union_all(c.select("k", "g"), c.select("k", "g")), "SELECT k, g FROM c UNION ALL SELECT k, g FROM c")
on_customers("distinct_rows", lambda c: R.duplicates_removed(c.select("g", "n"), "g", "n"), "SELECT DISTINCT g, n FROM c")
on_customers("smallest_class", lambda c: c.groupBy("g").count().agg(F.min("count").alias("value")), "SELECT min(m) AS value FROM (SELECT count(*) AS m FROM c GROUP BY g)")
on_customers("class_proportions", lambda c: c.groupBy("g").agg(F.count("*").alias("m")).join(F.broadcast(c.agg(F.count("*").alias("w")))).select("g", F.round(F.col("m") / F.col("w"), 6).alias("share")), "SELECT g, ROUND(count(*) / (SELECT count(*) FROM c)::DOUBLE, 6) AS share FROM c GROUP BY g")
on_customers("rows_by_class", lambda c: C.nested(c, "g", ["k"]).select("g", F.size("bag").cast("long").alias("n"), F.get("bag", F.lit(0))["k"].alias("first"), F.element_at("bag", -1)["k"].alias("last")), "SELECT g, count(*) AS n, min(k) AS first, max(k) AS last FROM c GROUP BY g")
on_customers("median", lambda c: c.agg(F.median("xm").alias("value")), "SELECT median(xm) AS value FROM c")
on_customers("weighted_classes", lambda c: c.groupBy("g").agg(F.sum("n").alias("w")), "SELECT g, CAST(sum(n) AS BIGINT) AS w FROM c GROUP BY g")

# columns
on_customers("columns_by_name", lambda c: C.remove_by_name(c, "x.*"), "SELECT k, g, n FROM c")
on_customers("columns_by_type", lambda c: C.remove_by_type(c, T.StringType), "SELECT k, x, n, xm FROM c")
on_customers("columns_by_range", lambda c: c.select(R.columns_in(c, "first,3-last")), "SELECT k, g, n, xm FROM c")
on_customers("columns_reordered", lambda c: c.select(R.columns_in(c, "last,first")), "SELECT xm, k FROM c")
on_customers("useless_removed", lambda c: C.remove_useless(c.withColumn("one", F.lit(1)))(c.withColumn("one", F.lit(1))), "SELECT * FROM c")
on_customers("constant_removed", lambda c: C.remove_constant(c.withColumn("one", F.lit(1)), ["x", "one"])(c.withColumn("one", F.lit(1))), "SELECT * FROM c")
on_customers("redundant_removed", lambda c: C.remove_redundant(c.withColumn("y", F.col("x")), ["x", "n", "y"])(c.withColumn("y", F.col("x"))), "SELECT * FROM c")
on_customers("column_added", lambda c: C.add_column(c, "new", "double", 1).select("k", "new", "x"), "SELECT k, CAST(NULL AS DOUBLE) AS new, x FROM c")
on_customers("constant_added", lambda c: C.add_column(c, "tag", "string", value="t").select("k", "tag"), "SELECT k, 't' AS tag FROM c")
on_customers("columns_renamed", lambda c: C.rename_matching(c.select("k", "x", "xm"), "^x", "balance_"), "SELECT k, x AS balance_, xm AS balance_m FROM c")
on_customers("columns_copied", lambda c: C.copied(c.select("k", "x"), ["x"]), "SELECT k, x, x AS copy_of_x FROM c")
on_customers("obfuscated", lambda c: C.obfuscated(c.select("k", "x")), 'SELECT k AS "A1", x AS "A2" FROM c')
on_customers("expression", lambda c: C.add_expression(c.select("k", "x"), "a2^2 / 1000 + 3*abs(a2) - log(a1 + 1) / -(2)").select("k", F.round("expression", 4).alias("expression")), "SELECT k, ROUND(pow(x, 2) / 1000 + 3 * abs(x) - ln(k + 1) / -2, 4) AS expression FROM c")
on_customers("centered", lambda c: C.center(c, ["xm"])(c).select("k", r6("xm")), "SELECT k, ROUND(xm - (SELECT avg(xm) FROM c), 6) + 0.0 AS xm FROM c")
on_customers("standardized", lambda c: C.standardize(c, ["xm"])(c).select("k", r6("xm")), "SELECT k, ROUND((xm - (SELECT avg(xm) FROM c)) / (SELECT stddev_samp(xm) FROM c), 6) + 0.0 AS xm FROM c")
on_customers("standardized_on_train", lambda c: C.standardize(c.where("k % 2 = 0"), ["x"])(c.where("k % 2 = 1")).select("k", r6("x")), "SELECT k, ROUND((x - (SELECT avg(x) FROM c WHERE k % 2 = 0)) / (SELECT stddev_samp(x) FROM c WHERE k % 2 = 0), 6) + 0.0 AS x FROM c WHERE k % 2 = 1")
on_customers("normalized", lambda c: C.normalize(c, ["xm"], 2.0, -1.0)(c).select("k", r6("xm")), "SELECT k, ROUND((xm - (SELECT min(xm) FROM c)) / (SELECT max(xm) - min(xm) FROM c) * 2 - 1, 6) + 0.0 AS xm FROM c")
on_customers("unit_rows", lambda c: C.unit_rows(c.select("k", F.col("n").cast("double").alias("n"), "x"), ["n", "x"]).select("k", r6("n"), r6("x")), "SELECT k, ROUND(n / sqrt(n * n + x * x), 6) + 0.0 AS n, ROUND(x / sqrt(n * n + x * x), 6) + 0.0 AS x FROM c")
on_customers("equal_width_bins", lambda c: C.discretize(c, ["xm"], 8)(c).select("k", "xm"), "SELECT k, CAST(CASE WHEN xm IS NULL THEN NULL ELSE (SELECT count(*) FROM range(1, 8) t(i) WHERE xm > lo + (hi - lo) / 8 * i) END AS BIGINT) AS xm FROM c, (SELECT min(xm) AS lo, max(xm) AS hi FROM c)")
on_customers("class_entropy_bins", lambda c: C.discretize_by_class(c.withColumn("label", (F.col("x") > 3000).cast("int") + (F.col("x") > 7000).cast("int")), ["x"], "label")(c).groupBy("x").agg(F.count("*").alias("n")).select(F.col("x").alias("bin"), "n"), "SELECT CAST((x > 3000)::INT + (x > 7000)::INT AS BIGINT) AS bin, count(*) AS n FROM c GROUP BY 1")
on_customers("to_binary", lambda c: c.select("k", C.to_binary(F.when(F.col("k") % 3 == 0, 0.0).otherwise(F.col("xm"))).alias("b")), "SELECT k, CAST(CASE WHEN k % 3 = 0 THEN 0 WHEN xm IS NULL THEN NULL WHEN xm <> 0 THEN 1 ELSE 0 END AS INT) AS b FROM c")
on_customers("to_nominal", lambda c: c.select("k", F.col("n").cast("string").alias("n")), "SELECT k, CAST(n AS VARCHAR) AS n FROM c")
on_customers("function_applied", lambda c: c.select("k", F.abs("xm").alias("x")), "SELECT k, abs(xm) AS x FROM c")
on_customers("numbers_cleaned", lambda c: c.select("k", C.clean_number(F.col("xm"), 0.0, -1.0, 9000.0, 9999.0, 5000.0, 5000.0, 50.0, 1).alias("x")), "SELECT k, ROUND(CASE WHEN y BETWEEN 4950.0000001 AND 5049.9999999 THEN 5000 ELSE y END, 1) AS x FROM (SELECT k, CASE WHEN xm < 0 THEN -1.0 WHEN xm > 9000 THEN 9999.0 ELSE xm END AS y FROM c)")
Q = "(SELECT quantile_cont(xm, 0.25) AS q1, quantile_cont(xm, 0.75) AS q3 FROM c)"
on_customers("outliers", lambda c: C.outliers(c, "xm", 0.2, 0.4)(c).select("k", "outlier", "extreme"), f"SELECT k, coalesce((xm > q3 + 0.2 * (q3 - q1) OR xm < q1 - 0.2 * (q3 - q1)) AND NOT (xm > q3 + 0.4 * (q3 - q1) OR xm < q1 - 0.4 * (q3 - q1)), false) AS outlier, coalesce(xm > q3 + 0.4 * (q3 - q1) OR xm < q1 - 0.4 * (q3 - q1), false) AS extreme FROM c, {Q}")
on_customers("missing_replaced", lambda c: C.replace_missing(c.withColumn("h", F.when(F.col("k") % 5 != 0, F.col("g"))), ["xm", "h"])(c.withColumn("h", F.when(F.col("k") % 5 != 0, F.col("g")))).select("k", r6("xm"), "h"), ", d AS (SELECT *, CASE WHEN k % 5 <> 0 THEN g END AS h FROM c) SELECT k, ROUND(coalesce(xm, (SELECT avg(xm) FROM d)), 6) + 0.0 AS xm, coalesce(h, (SELECT h FROM d WHERE h IS NOT NULL GROUP BY h ORDER BY count(*) DESC, h LIMIT 1)) AS h FROM d")
on_customers("missing_by_constant", lambda c: C.replace_missing_by(c, {"xm": -5.0}).select("k", "xm"), "SELECT k, coalesce(xm, -5.0) AS xm FROM c")
on_customers("one_hot_fitted", lambda c: C.one_hot(c, "g")(c).drop("x", "xm", "n", "g").select("k", "g_AUTOMOBILE", "g_BUILDING"), "SELECT k, (g = 'AUTOMOBILE')::INT AS \"g_AUTOMOBILE\", (g = 'BUILDING')::INT AS \"g_BUILDING\" FROM c")
on_customers("one_hot_by_target", lambda c: C.by_target_mean(c, "g", "x")(c).select("k", "g_1", "g_4"), ", o AS (SELECT g, row_number() OVER (ORDER BY avg(x), g) - 1 AS i FROM c GROUP BY g) SELECT k, (i >= 1)::INT AS g_1, (i >= 4)::INT AS g_4 FROM c JOIN o USING (g)")
on_customers("indicator", lambda c: C.indicator(c, "n", [1, 2, 3], "few").select("k", "few"), "SELECT k, (n IN (1, 2, 3))::INT AS few FROM c")
on_customers("labels_merged", lambda c: c.select("k", C.merge_labels(F.col("g"), ["BUILDING", "FURNITURE"], "HOME").alias("g")), "SELECT k, CASE WHEN g IN ('BUILDING', 'FURNITURE') THEN 'HOME' ELSE g END AS g FROM c")
on_customers("rare_labels_merged", lambda c: C.merge_rare(c.withColumn("n", F.col("n").cast("string")), "n", 60)(c.withColumn("n", F.col("n").cast("string"))).select("k", "n"), "SELECT k, CASE WHEN count(*) OVER (PARTITION BY n) >= 60 THEN CAST(n AS VARCHAR) ELSE 'other' END AS n FROM c")
on_customers("labels_swapped", lambda c: c.select("k", C.swap_labels(F.col("g"), "BUILDING", "MACHINERY").alias("g")), "SELECT k, CASE g WHEN 'BUILDING' THEN 'MACHINERY' WHEN 'MACHINERY' THEN 'BUILDING' ELSE g END AS g FROM c")
on_customers("labels_by_frequency", lambda c: C.relabelled(c, "g")(c).select("k", "g"), "SELECT k, i AS g FROM c JOIN (SELECT g, CAST(row_number() OVER (ORDER BY count(*) DESC, g) - 1 AS BIGINT) AS i FROM c GROUP BY g) USING (g)")
on_customers("labels_sorted", lambda c: C.ranked_labels(c, "g"), "SELECT g, CAST(row_number() OVER (ORDER BY g) - 1 AS BIGINT) AS label_idx FROM (SELECT DISTINCT g FROM c)")
LABELS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
on_customers("labels_noisy", lambda c: C.noisy_labels(c, "g", "k", LABELS, 0.1).select("k", "g"), f"SELECT k, CASE WHEN {u('0', 'k')} < 0.1 THEN coalesce((['BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'AUTOMOBILE'])[list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], g)], CASE WHEN false THEN g END) ELSE g END AS g FROM c")
on_customers("filters_chained", lambda c: C.chain(lambda d: R.drop_missing(d, "xm"), C.center(c, ["xm"]))(c).select("k", r6("xm")), "SELECT k, ROUND(xm - (SELECT avg(xm) FROM c), 6) + 0.0 AS xm FROM c WHERE xm IS NOT NULL")
on_customers("random_columns", lambda c: C.random_subset(c, ["x", "n", "xm", "g"], 2, 1), "SELECT k, " + ", ".join(c for c in ("x", "g", "n", "xm") if c in sorted(["x", "n", "xm", "g"], key=lambda v: __import__("hashlib").md5(f"1-{v}".encode()).hexdigest())[:2]) + " FROM c")
on_customers("header_differs", lambda c: c.sparkSession.createDataFrame([(R.header_difference(c, c), bool(R.header_difference(c, c.drop("x"))), C.has_type(c, T.StringType))], "same string, differs boolean, has_text boolean"), "SELECT '' AS same, true AS differs, true AS has_text")


@query("relaggs_full", "SELECT o_custkey, ROUND(min(o_totalprice), 6) AS price_min, ROUND(max(o_totalprice), 6) AS price_max, ROUND(avg(o_totalprice), 6) AS price_avg, ROUND(stddev_samp(o_totalprice), 6) AS price_stdev, ROUND(sum(o_totalprice), 6) AS price_sum, CAST(sum((o_orderstatus = 'F')::INT) AS BIGINT) AS status_f, CAST(sum((o_orderstatus = 'O')::INT) AS BIGINT) AS status_o FROM orders GROUP BY 1")
def relaggs_full(spark, sf_dir):
    t = C.relaggs(read(spark, sf_dir, "orders"), "o_custkey", ["o_totalprice"], {"o_orderstatus": ["F", "O", "P"]})
    return t.select("o_custkey", *[F.round(f"o_totalprice_{n}", 6).alias(f"price_{n}") for n in ("min", "max", "avg", "stdev", "sum")], F.col("o_orderstatus_F_cnt").alias("status_f"), F.col("o_orderstatus_O_cnt").alias("status_o"))


@query("bags_nested", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def bags_nested(spark, sf_dir):
    t = C.nested(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey", "o_totalprice"])
    return t.select("o_custkey", F.size("bag").cast("long").alias("n"), F.get("bag", F.lit(0))["o_orderkey"].alias("first"), F.element_at("bag", -1)["o_orderkey"].alias("last"))


@query("bags_unnested", "SELECT o_orderkey, ROUND(1.0 / count(*) OVER (PARTITION BY o_custkey), 6) AS weight FROM orders")
def bags_unnested(spark, sf_dir):
    t = C.unnested(C.nested(read(spark, sf_dir, "orders"), "o_custkey", ["o_orderkey"]), "bag")
    return t.select("bag.o_orderkey", F.round("weight", 6).alias("weight"))


@query("dates_reduced", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def dates_reduced(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", C.date_reduced(F.col("o_orderdate"), "yyyy-MM").alias("month"))


@query("association", "WITH t AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT a, sum(n) AS na FROM t GROUP BY a), y AS (SELECT b, sum(n) AS nb FROM t GROUP BY b), w AS (SELECT sum(n) AS w FROM t), s AS (SELECT sum(n * n * w / (na * nb)) - max(w) AS chi, sum(n / w * log2(n * w / (na * nb))) AS gain, max(w) AS w FROM t JOIN x USING (a) JOIN y USING (b), w), h AS (SELECT (SELECT -sum(na / w * log2(na / w)) FROM x, w) AS ha, (SELECT -sum(nb / w * log2(nb / w)) FROM y, w) AS hb) SELECT ROUND(chi, 4) AS chi_squared, ROUND(sqrt(chi / (w * (least((SELECT count(*) FROM x), (SELECT count(*) FROM y)) - 1))), 6) AS cramers_v, ROUND(gain, 6) AS information_gain, ROUND(gain / ha, 6) AS gain_ratio, ROUND(2 * gain / (ha + hb), 6) AS symmetrical_uncertainty FROM s, h")
def association(spark, sf_dir):
    t = M.association(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")
    return t.select(F.round("chi_squared", 4).alias("chi_squared"), *[F.round(c, 6).alias(c) for c in ("cramers_v", "information_gain", "gain_ratio", "symmetrical_uncertainty")])


# tokens, over part names
WORDS = "list_filter(string_split(p_name, ' '), lambda w: w <> '')"


@query("word_tokens", f"SELECT p_partkey, CAST(len({WORDS}) AS BIGINT) AS n, ({WORDS})[1] AS first FROM part")
def word_tokens(spark, sf_dir):
    w = C.tokens(F.col("p_name"), " ")
    return read(spark, sf_dir, "part").select("p_partkey", F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first"))


@query("alphabetic_tokens", "SELECT p_partkey, array_to_string(regexp_extract_all(p_name, '[A-Za-z]+'), '|') AS words FROM part")
def alphabetic_tokens(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(C.alphabetic_tokens(F.col("p_name")), "|").alias("words"))


@query("word_ngrams", f"WITH w AS (SELECT {WORDS} AS w FROM part), g AS (SELECT unnest(list_concat([w[i] || ' ' || w[i + 1] for i in range(1, len(w))], w)) AS gram FROM w) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def word_ngrams(spark, sf_dir):
    grams = read(spark, sf_dir, "part").select(F.explode(C.ngrams(C.tokens(F.col("p_name"), " "), 1, 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query("stopwords_removed", "SELECT item_id, CAST(len(list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w <> '' AND NOT list_contains(" + str(C.STOPWORDS) + ", w)))) AS BIGINT) AS n FROM benchmark")
def stopwords_removed(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(C.without_stopwords(C.tokens(F.lower("text"), " "))).cast("long").alias("n"))


@query("prefix_matches", "SELECT DISTINCT p_partkey, p_name FROM part JOIN (SELECT DISTINCT substr(p_name, 1, 3) AS prefix FROM part WHERE p_partkey < 10) ON starts_with(p_name, prefix)")
def prefix_matches(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return C.with_prefix(part, "p_name", part.where("p_partkey < 10").select(F.substring("p_name", 1, 3).alias("prefix")).distinct())


@query("edit_distance", "SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def edit_distance(spark, sf_dir):
    n = read(spark, sf_dir, "nation")
    pairs = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"), "n_regionkey"), "n_regionkey")
    return pairs.select("a", "b", F.levenshtein("x", "y").cast("long").alias("d"))


@query("folds_shuffled_whole", f"SELECT o_orderkey, CAST((row_number() OVER (ORDER BY md5('0-' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM orders")
def folds_shuffled_whole(spark, sf_dir):
    return R.shuffled(read(spark, sf_dir, "orders"), 0, "o_orderkey", name="fold").select("o_orderkey", (F.col("fold") % 5).alias("fold"))

