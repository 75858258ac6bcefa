"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java / RE2 / Python alike: the words of every contract that counts words.
WORD = r"[^\x20\x09-\x0D]+"

#: Settings while operators write: batches that a worker holds several of whatever the length
#: of the texts, and shuffle files that go as soon as what they led to is written.
WRITING = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}

#: What operators keep in a Python worker from task to task.
held: dict = {}


def release() -> None:
    """Free what other operators' tasks have left in this Python worker, and give freed memory back to the system."""
    held.clear()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (a local session, as in tests) a temporary folder stands in for it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("corvane.local.folder", "")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("corvane.local.folder", named)
    return named.rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and then with its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage: what follows survives the loss of any executor, and
    values that depend on the partitioning (row numbers) are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    with settings(spark, WRITING):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.corvane_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more: those whose readers' results are written themselves."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.corvane_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def stable(df: DataFrame) -> DataFrame:
    """df, if it is a plain scan of files, whose rows have the same numbers each time; else a written copy."""
    pin_splits(df.sparkSession)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    nodes = {line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in plan.splitlines() if line.strip()}
    return df if nodes <= {"Project", "Filter", "Relation"} else written(df, "rows")


def pin_splits(spark: SparkSession) -> None:
    """Hold the number of parts that files are split into at the least, which otherwise follows the executors of the moment.

    Row numbers of two scans of the same files agree from here on, whatever executors come or go.
    """
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(2, spark.sparkContext.defaultParallelism)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b), as written rows (node, root): root is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014).
    Each step is an aggregation (combined on the map side) and a join whose large
    partitions adaptive execution can split, so a hub with a third of all edges
    does not land in one task. Ends when every node has one edge, to a node without.
    Null ends and self links are ignored; no edges give no rows.
    """
    e = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null and a <> b")
    e = written(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while True:
        ends = e.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if not ends.where("up > 1 or (up > 0 and down > 0)").limit(1).count():
            nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
            out = written(nodes.union(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))), name)
            discard(e)
            return out
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        m = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(m, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b"))).distinct()
        before, e = e, written(small, name)
        discard(before)


def merged(roots: DataFrame, edges: DataFrame, name: str = "components") -> DataFrame:
    """Components (node, root) after more edges (a, b): only links between different components are walked."""
    ends = edges
    for c in "ab":
        known = roots.select(F.col("node").alias(f"node_{c}"), F.col("root").alias(f"root_{c}"))
        ends = ends.join(known, F.col(c) == F.col(f"node_{c}"), "left").withColumn(c, F.coalesce(f"root_{c}", c)).select("a", "b")
    up = components(ends, name).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(up, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = up.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return written(moved.union(fresh), name)
