"""Queries of files: each writes a table in a format to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.registry import instances, query, read
from corvane.sources import files as X
from corvane.storage import fresh_path

RAW = "WITH b AS (SELECT vec_id AS series_id, label, [CAST(x AS DOUBLE) for x in embedding] AS s FROM embeddings)"
LONG = RAW + ", l AS (SELECT series_id, label, s, unnest(range(1, len(s) + 1)) AS t FROM b) SELECT row_id AS series_id, CAST(label AS VARCHAR) AS label, CAST(t - 1 AS BIGINT) AS t, ROUND(s[t], 6) + 0.0 AS value FROM l JOIN (SELECT series_id, CAST(row_number() OVER (ORDER BY series_id) - 1 AS BIGINT) AS row_id FROM b) USING (series_id)"


def long(df: DataFrame, vector: str) -> DataFrame:
    return df.select("series_id", F.col("label").cast("string").alias("label"), F.posexplode(vector).alias("t", "x")).select("series_id", "label", F.col("t").cast("long").alias("t"), (F.round("x", 6) + 0.0).alias("value"))


@query("file_ts", LONG)
def file_ts(spark, sf_dir):
    path = fresh_path(spark, "file.ts")
    X.write_ts(instances(spark, sf_dir).withColumn("dims", F.array("s")), path, "Embeddings")
    return long(X.read_ts(spark, path).withColumn("v", F.get("dims", F.lit(0))), "v")


@query("file_ts_multivariate", RAW + ", h AS (SELECT series_id, label, [s[1:32], s[33:64]] AS d FROM b), l AS (SELECT *, unnest(range(1, 33)) AS t FROM h) SELECT CAST(label AS INT) AS label_idx, CAST(t - 1 AS BIGINT) AS t, count(*) AS n, ROUND(sum(d[1][t]), 4) + 0.0 AS first, ROUND(sum(d[2][t]), 4) + 0.0 AS second FROM l GROUP BY 1, 2")
def file_ts_multivariate(spark, sf_dir):
    path = fresh_path(spark, "file.ts")
    X.write_ts(instances(spark, sf_dir).withColumn("dims", F.array(F.slice("s", 1, 32), F.slice("s", 33, 32))), path, "Halves")
    t = X.load(spark, path).select("label_idx", F.posexplode(F.arrays_zip(F.get("dims", F.lit(0)).alias("a"), F.get("dims", F.lit(1)).alias("b"))).alias("t", "x"))
    return t.groupBy("label_idx", F.col("t").cast("long").alias("t")).agg(F.count("*").alias("n"), (F.round(F.sum("x.a"), 4) + 0.0).alias("first"), (F.round(F.sum("x.b"), 4) + 0.0).alias("second"))


CUST = "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS rid, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x, c_mktsegment AS g, c_name AS name FROM customer"


def cust(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("x"), F.col("c_mktsegment").alias("g"), F.col("c_name").alias("name"))


@query("file_arff", CUST)
def file_arff(spark, sf_dir):
    path = fresh_path(spark, "file.arff")
    X.write_arff(cust(spark, sf_dir), path, "customers", "k", ("g",))
    return X.load(spark, path)


@query("file_csv", CUST.replace("CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS rid", "c_custkey AS k"))
def file_csv(spark, sf_dir):
    path = fresh_path(spark, "file.csv")
    X.write_csv(cust(spark, sf_dir), path)
    return X.read_csv(spark, path, schema="k long, x double, g string, name string")


@query("file_svmlight", "SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS rid, CAST(label AS DOUBLE) AS label, CAST(len(list_filter(embedding, lambda x: x <> 0)) AS BIGINT) AS n, ROUND(list_sum([CAST(x AS DOUBLE) for x in embedding]), 6) + 0.0 AS total FROM embeddings")
def file_svmlight(spark, sf_dir):
    path = fresh_path(spark, "file.svmlight")
    X.write_svm(instances(spark, sf_dir), path, "series_id", "label", "s")
    return X.load(spark, path).select("rid", "label", F.size("indices").cast("long").alias("n"), (F.round(F.aggregate("values", F.lit(0.0), lambda a, b: a + b), 6) + 0.0).alias("total"))


@query("file_libsvm_dense", RAW + ", l AS (SELECT series_id, s, unnest(range(1, 65)) AS t FROM b) SELECT CAST(dense_rank() OVER (ORDER BY series_id) - 1 AS BIGINT) AS rid, CAST(t - 1 AS BIGINT) AS t, ROUND(s[t], 6) + 0.0 AS value FROM l")
def file_libsvm_dense(spark, sf_dir):
    path = fresh_path(spark, "file.libsvm")
    X.write_svm(instances(spark, sf_dir), path, "series_id", "label", "s")
    return X.load(spark, path).select("rid", F.posexplode(X.dense(F.col("indices"), F.col("values"), 64)).alias("t", "x")).select("rid", F.col("t").cast("long").alias("t"), (F.round("x", 6) + 0.0).alias("value"))


@query("file_matrix", RAW + ", l AS (SELECT series_id, s, unnest(range(1, 65)) AS t FROM b) SELECT CAST(dense_rank() OVER (ORDER BY series_id) - 1 AS BIGINT) AS rid, CAST(t - 1 AS BIGINT) AS t, ROUND(s[t], 6) + 0.0 AS value FROM l")
def file_matrix(spark, sf_dir):
    path = fresh_path(spark, "file.m")
    X.write_matrix(instances(spark, sf_dir), path, "series_id", "s")
    return X.load(spark, path).select("rid", F.posexplode("v").alias("t", "x")).select("rid", F.col("t").cast("long").alias("t"), (F.round("x", 6) + 0.0).alias("value"))


@query("file_delimited_series", LONG)
def file_delimited_series(spark, sf_dir):
    path = fresh_path(spark, "file.txt")
    X.write_matrix(instances(spark, sf_dir).withColumn("row", F.concat(F.array(F.col("label").cast("string")), F.transform("s", lambda x: x.cast("string")))), path, "series_id", "row")
    return long(X.load(spark, path).withColumn("v", F.get("dims", F.lit(0))), "v")


@query("file_c45", "SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS rid, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS x, c_mktsegment AS class FROM customer")
def file_c45(spark, sf_dir):
    stem = fresh_path(spark, "file")
    X.write_c45(cust(spark, sf_dir).drop("name"), stem, "k", "g")
    return X.read_c45(spark, f"{stem}.names", f"{stem}.data")


@query("file_results", "SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS rid, CAST(label AS BIGINT) AS y_true, vec_id % 10 AS y_pred, 0.25::DOUBLE AS p0, vec_id * 3 AS time FROM embeddings")
def file_results(spark, sf_dir):
    path = fresh_path(spark, "results")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), F.col("label").alias("y_true"), (F.col("vec_id") % 10).alias("y_pred"), F.array(F.lit(0.25), F.lit(0.75)).alias("dist"), (F.col("vec_id") * 3).alias("time"))
    X.write_results(rows, path, {"dataset": "Embeddings", "estimator": "mod", "split": "test", "fold": 0, "unit": "ns"})
    return X.read_results(spark, path)[1].select("rid", "y_true", "y_pred", F.get("dist", F.lit(0)).alias("p0"), "time")


@query("file_results_facts", "SELECT 'Embeddings' AS dataset, ROUND(avg((label = vec_id % 10)::INT), 6) AS accuracy, 2 AS classes FROM embeddings")
def file_results_facts(spark, sf_dir):
    path = fresh_path(spark, "results")
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rid"), F.col("label").alias("y_true"), (F.col("vec_id") % 10).alias("y_pred"), F.array(F.lit(0.25), F.lit(0.75)).alias("dist"), F.lit(1).alias("time"))
    X.write_results(rows, path, {"dataset": "Embeddings"})
    facts, _ = X.read_results(spark, path)
    return spark.createDataFrame([(facts["dataset"], round(facts["accuracy"], 6), facts["classes"])], "dataset string, accuracy double, classes int")


@query("file_text_folder", "SELECT o_orderstatus AS class, count(*) AS files FROM (SELECT * FROM orders WHERE o_orderkey < 40) GROUP BY 1")
def file_text_folder(spark, sf_dir):
    path = fresh_path(spark, "texts")
    read(spark, sf_dir, "orders").where("o_orderkey < 40").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("text")).repartition(8, "text").write.option("maxRecordsPerFile", 1).partitionBy("o_orderstatus").text(path)
    return X.read_text_folder(spark, path).groupBy(F.regexp_extract("class", "=(.*)$", 1).alias("class")).agg(F.count("*").alias("files"))


@query("wide_and_narrow", LONG)
def wide_and_narrow(spark, sf_dir):
    wide = X.wide(instances(spark, sf_dir).withColumn("dims", F.array("s")).drop("s"), 64)
    from corvane.operators.rows import numbered

    t = X.narrow(wide, [f"att{i + 1}" for i in range(64)]).withColumn("v", F.get("dims", F.lit(0)))
    return long(numbered(t.withColumnRenamed("series_id", "old"), "old", "series_id"), "v")
