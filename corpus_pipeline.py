"""Training-corpus pipeline: each stage works on all documents that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import mixing, neardup, packing, quality, secrets
from corvane.llm.common import documents, pin_splits, written

#: Words that a packing worker keeps: fewer than alone, as the JVM has grown by then.
CACHE = 200_000


def fresh(docs: DataFrame, name: str) -> str:
    """A name like the given one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps.

    Texts null or empty have weight 0; repeated rows stay or go together; without
    labels of both kinds all stay; an empty table stays empty.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates.

    Null, empty and white texts are one group; repeated rows are; ids may be null
    or repeated, as rows are told apart by their place in docs.
    """
    pin_splits(spark)
    row = fresh(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    gone = neardup.duplicates(rows.select(F.col(row).alias("row"), "text")).select(F.col("row").alias(row))
    return rows.join(gone.hint("merge"), row, "left_anti").drop(row)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials replaced; values that many owners hold are examples and stay.

    A text without any, null and empty ones among them, stays as it is.
    """
    pin_splits(spark)
    row, found = fresh(docs, "row"), fresh(docs, "spans")
    scan = secrets.scan_secrets(docs)
    taken = F.filter("spans", lambda x: x["class"] != "example").alias(found)
    hits = written(scan.select(F.col("row").alias(row), taken).where(F.size(found) > 0), "pipeline-secrets")
    rows = docs.withColumn(row, F.monotonically_increasing_id()).join(hits.hint("merge"), row, "left")
    text = F.when(F.col(found).isNotNull(), secrets.redact(F.col("text"), F.col(found))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, by any of its rows where rows repeat."""
    pin_splits(spark)
    row, times, copy = fresh(docs, "row"), fresh(docs, "times"), fresh(docs, "copy")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    copies = written(mixing.mix(rows, keep=(row,)).where("copies > 0").select(row, F.col("copies").alias(times)), "pipeline-mix")
    taken = rows.join(copies.hint("merge"), row)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens; a null text is empty and packs its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache=CACHE)


STAGES = [
    ("quality classifier", classify),
    ("SimHash near-dedup", deduplicate),
    ("secret scans", redact),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: SQL can express neither the classifier nor the walk of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
