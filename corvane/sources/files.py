"""Readers and writers of dataset files: .ts, ARFF, CSV, LibSVM, SVM-light, C4.5, matrices, text folders, XRFF, delimited series, results.

Headers are read on the driver: the first lines of one file. Data lines are parsed by
column expressions, wherever the files lie that Spark reads. Missing values are null.
Writers make a folder of part files with the header in the first; readers take a file,
a folder or a pattern. Rows of text have no order of their own but that of files and
places in them, which ``series_id`` and ``rid`` follow: files by their paths, whatever
their sizes (Spark's own scan deals out large files first).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = 100_000


def split() -> Column:
    """The split of a file that a row comes from: its path and first byte, which order the splits of a folder."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, at): at is the line's split; lines of a split follow each other in one task."""
    return spark.read.text(path).select(F.col("value").alias("line"), split().alias("at"))


def first_lines(spark: SparkSession, path: str) -> Iterator[str]:
    """The first HEADER lines in order, file by file and split by split, read as they are asked for."""
    text, n = spark.read.text(path), 0
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    for file in sorted(text.inputFiles()):
        own = F.col("_metadata.file_path").isin(file, file.replace(":///", ":/", 1))  # Spark writes an empty authority either way
        for r in text.where(own).where(place < HEADER).toLocalIterator():
            if n == HEADER:
                return
            n += 1
            yield r["value"]


def head(spark: SparkSession, path: str, until: str) -> list[str]:
    """The lines before the one that matches until, HEADER at most."""
    out: list[str] = []
    for line in first_lines(spark, path):
        if re.match(until, line.strip(), re.I):
            return out
        out.append(line.strip())
    raise ValueError(f"no line of {path} matches {until}")


def number(x: Column) -> Column:
    """A double, null where the text is none or is NaN."""
    out = x.try_cast("double")
    return F.when(~F.isnan(out), out)


def _ordered(df: DataFrame, name: str) -> DataFrame:
    """Rows numbered by split and place: a row's place among its split's, which one task reads in order, after the rows of the splits before.

    A row for each split is counted; no rows are moved.
    """
    spark, key = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:  # else it follows the executors of the moment, and the two scans might split files apart
        spark.conf.set(key, str(max(2, spark.sparkContext.defaultParallelism)))
    rows = df.withColumn("__id", F.monotonically_increasing_id())
    sizes = rows.groupBy("at").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("at").alias("__split"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    found = rows.join(F.broadcast(sizes), F.col("at") == F.col("__split"))
    return found.select((F.col("__id") + F.col("__offset")).cast("long").alias(name), *[c for c in df.columns if c != "at"])


# .ts


def ts_header(spark: SparkSession, path: str) -> dict:
    """The header's fields by lower-case name; classLabel as the list of its labels, None where there is none."""
    out: dict = {"classlabel": None}
    for line in head(spark, path, "@data"):
        if line.startswith("@"):
            name, _, rest = line[1:].partition(" ")
            parts = rest.split()
            out[name.lower()] = (parts[1:] if parts and parts[0].lower() == "true" else None) if name.lower() == "classlabel" else rest.strip()
    return out


def read_ts(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, label, label_idx, dims): dimensions by colons, values by commas, the label last if the header has labels."""
    labels = ts_header(spark, path)["classlabel"]
    rows = lines(spark, path).where(~F.col("line").rlike(r"^\s*([#@]|$)"))
    fields = F.split(F.trim("line"), ":")
    data = F.slice(fields, F.lit(1), F.size(fields) - (1 if labels else 0))
    dims = F.transform(data, lambda d: F.transform(F.split(d, ","), lambda x: number(F.trim(x))))
    label = F.trim(F.element_at(fields, -1)) if labels else F.lit(None).cast("string")
    index = F.array_position(F.array(*map(F.lit, labels)), label) - 1 if labels else F.lit(None)
    return _ordered(rows.select("at", label.alias("label"), F.when(index >= 0, index).cast("int").alias("label_idx"), dims.alias("dims")), "series_id")


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("?"))


def _written(header: list[str], data: DataFrame, path: str) -> None:
    """data: (at, line), in the order of at; the header stands before, all of it in the first file."""
    spark = data.sparkSession
    top = spark.createDataFrame([(None, i, h) for i, h in enumerate(header)], "at long, top int, line string")
    rows = top.union(data.select(F.col("at").cast("long").alias("at"), F.lit(None).cast("int").alias("top"), "line"))
    rows.repartitionByRange("at").sortWithinPartitions("at", F.col("top").asc_nulls_last()).select("line").write.text(path)


def write_ts(df: DataFrame, path: str, name: str, key: str = "series_id", label: str | None = "label", dims: str = "dims") -> None:
    """Rows in the order of a numeric key."""
    labels = sorted(str(r[0]) for r in df.select(label).distinct().collect() if r[0] is not None) if label else []
    told = df.agg(F.min(F.size(dims)), F.max(F.size(dims)), F.min(F.size(F.get(dims, F.lit(0)))), F.max(F.size(F.get(dims, F.lit(0)))), F.max(F.exists(dims, lambda d: F.exists(d, lambda x: x.isNull())).cast("int"))).first()
    same = told[2] == told[3]
    yes = lambda b: "true" if b else "false"
    header = [f"@problemName {name}", "@timeStamps false", f"@missing {yes(told[4])}", f"@univariate {yes(told[1] == 1)}", f"@dimensions {told[1]}", f"@equalLength {yes(same)}", *([f"@seriesLength {told[2]}"] if same else []), f"@classLabel {yes(label)}" + "".join(f" {x}" for x in labels), "@data"]
    body = F.array_join(F.transform(dims, lambda d: F.array_join(F.transform(d, _text), ",")), ":")
    line = F.concat_ws(":", body, F.col(label).cast("string")) if label else body
    _written(header, df.select(F.col(key).alias("at"), line.alias("line")), path)


# ARFF


def _unquoted(x: str) -> str:
    return x[1:-1].replace("\\'", "'") if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x


def arff_header(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, str, list]]]:
    """The relation, and (name, kind, more) of the attributes: numeric, string, date (format), nominal (labels) or relational (attributes)."""
    relation, found, stack = "", [], []
    for line in head(spark, path, r"@data\b"):
        if m := re.match(r"@relation\s+(.*)", line, re.I):
            relation = _unquoted(m[1].strip())
        elif m := re.match(r"@end\b", line, re.I):
            inner, found = found, stack.pop()
            found[-1] = (found[-1][0], "relational", inner)
        elif m := re.match(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.*)", line, re.I):
            name, rest = _unquoted(m[1]), m[2].strip()
            if rest.startswith("{"):
                labels = re.findall(r"'(?:[^'\\]|\\.)*'|\"[^\"]*\"|[^,\s][^,]*", rest.strip("{} "))
                found.append((name, "nominal", [_unquoted(x.strip()) for x in labels]))
                continue
            kind = rest.split()[0].lower()
            if kind == "relational":
                found.append((name, "relational", []))
                stack.append(found)
                found = []
            else:
                found.append((name, {"real": "numeric", "integer": "numeric"}.get(kind, kind), [_unquoted(rest[len(kind) :].strip())] if kind == "date" else []))
    return relation, found


def _typed(x: Column, kind: str, more: list) -> Column:
    x = F.when(x != "?", x)
    if kind == "numeric":
        return number(x)
    if kind == "date":
        return F.try_to_timestamp(x, F.lit(more[0] if more and more[0] else "yyyy-MM-dd'T'HH:mm:ss"))
    if kind == "relational":
        rows = F.split(x, r"\\n|\n")
        return F.transform(rows, lambda r: F.transform(F.split(r, ","), lambda v: number(F.trim(v))))
    return x


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """rid and a column for each attribute; a relational one is an array of arrays (rows of numbers). Sparse rows leave out zeros, or first labels."""
    _, attributes = arff_header(spark, path)
    rows = lines(spark, path).where(~F.col("line").rlike(r"^\s*([%@]|$)"))
    schema = ", ".join(f"c{i} string" for i in range(len(attributes)))
    line = F.trim("line")
    dense = F.from_csv(line, schema, {"quote": "'", "escape": "\\", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "nullValue": "?", "maxCharsPerColumn": "-1"})
    pairs = F.transform(F.filter(F.split(F.regexp_replace(line, r"^\{\s*|\s*\}$", ""), r"\s*,\s*"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("i"), F.regexp_replace(F.regexp_replace(p, r"^\d+\s+", ""), "^'|'$", "").alias("v")))
    is_sparse = line.startswith("{")
    known = F.map_from_entries(F.when(is_sparse, pairs).otherwise(F.array().cast("array<struct<i:int,v:string>>")))
    out = rows.select("at", is_sparse.alias("__sparse"), dense.alias("__dense"), known.alias("__pairs"))
    columns = []
    for i, (name, kind, more) in enumerate(attributes):
        zero = F.lit("0") if kind == "numeric" else F.lit(more[0]) if kind == "nominal" else F.lit(None).cast("string")
        x = F.when(F.col("__sparse"), F.coalesce(F.try_element_at("__pairs", F.lit(i)), zero)).otherwise(F.col(f"__dense.c{i}"))
        columns.append(_typed(x, kind, more).alias(name))
    return _ordered(out.select("at", *columns), "rid")


def _quoted(x: Column) -> Column:
    odd = x.rlike(r"[\s,{}%'\"?]") | (x == "")
    return F.when(odd, F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))).otherwise(x)


def write_arff(df: DataFrame, path: str, relation: str, key: str, nominal: tuple[str, ...] = ()) -> None:
    """Columns but the key, rows in its order: numbers numeric, strings string or (where named) nominal."""
    header, cells = [f"@relation {relation}", ""], []
    for f in df.schema:
        if f.name == key:
            continue
        if f.name in nominal:
            labels = sorted(str(r[0]) for r in df.select(f.name).distinct().collect() if r[0] is not None)
            kind = "{" + ",".join(re.sub(r"^(.*[\s,{}%'\"?].*)$", lambda m: "'" + m[1].replace("'", "\\'") + "'", x) for x in labels) + "}"
        else:
            kind = "numeric" if isinstance(f.dataType, T.NumericType) else "string"
        header.append(f"@attribute {f.name} {kind}")
        text = F.col(f.name).cast("string")
        cells.append(F.coalesce(text if isinstance(f.dataType, T.NumericType) else _quoted(text), F.lit("?")))
    _written([*header, "", "@data"], df.select(F.col(key).alias("at"), F.concat_ws(",", *cells).alias("line")), path)


# delimited, sparse and plain


def read_csv(spark: SparkSession, path: str, missing: str = "?", sep: str = ",", schema: str | None = None) -> DataFrame:
    """With a header line; types inferred where no schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("nullValue", missing)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, missing: str = "?", sep: str = ",") -> None:
    df.write.option("header", True).option("nullValue", missing).option("sep", sep).csv(path)


def read_svm(spark: SparkSession, path: str) -> DataFrame:
    """(rid, label, qid, indices, values) of LibSVM or SVM-light lines; indices from 0; comments after # are left out."""
    rows = lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", "#.*$", ""))).where("line <> ''")
    parts = F.split("line", r"\s+")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    pairs = F.filter(rest, lambda p: p.rlike(r"^\d+:"))
    qid = F.regexp_extract("line", r"\bqid:(\d+)", 1)
    return _ordered(rows.select("at", number(F.get(parts, F.lit(0))).alias("label"), F.when(qid != "", qid.cast("long")).alias("qid"), F.transform(pairs, lambda p: F.get(F.split(p, ":"), F.lit(0)).cast("int") - 1).alias("indices"), F.transform(pairs, lambda p: number(F.get(F.split(p, ":"), F.lit(1)))).alias("values")), "rid")


def dense(indices: Column, values: Column, size: int) -> Column:
    known = F.map_from_arrays(indices, values)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(0.0)))


def write_svm(df: DataFrame, path: str, key: str, label: str, vector: str, qid: str | None = None) -> None:
    """Values other than 0, indices from 1."""
    pairs = F.filter(F.transform(vector, lambda x, i: F.struct((i + 1).alias("i"), x.alias("x"))), lambda p: p["x"] != 0)
    cells = F.array_join(F.transform(pairs, lambda p: F.concat_ws(":", p["i"], p["x"])), " ")
    parts = [F.col(label).cast("string"), *([F.concat(F.lit("qid:"), F.col(qid).cast("string"))] if qid else []), cells]
    _written([], df.select(F.col(key).alias("at"), F.rtrim(F.concat_ws(" ", *parts)).alias("line")), path)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(rid, v): rows of numbers by white space; lines of % are comments."""
    rows = lines(spark, path).where(~F.col("line").rlike(r"^\s*(%|$)"))
    return _ordered(rows.select("at", F.transform(F.split(F.trim("line"), r"\s+"), number).alias("v")), "rid")


def write_matrix(df: DataFrame, path: str, key: str, vector: str) -> None:
    _written([], df.select(F.col(key).alias("at"), F.array_join(F.transform(vector, lambda x: F.coalesce(x.cast("string"), F.lit("NaN"))), " ").alias("line")), path)


def read_delimited_series(spark: SparkSession, path: str, sep: str = r"[,\s]+") -> DataFrame:
    """(series_id, label, dims) of lines that hold a label and then one series."""
    rows = lines(spark, path).where(~F.col("line").rlike(r"^\s*$"))
    parts = F.split(F.trim("line"), sep)
    return _ordered(rows.select("at", F.get(parts, F.lit(0)).alias("label"), F.array(F.transform(F.slice(parts, F.lit(2), F.size(parts)), number)).alias("dims")), "series_id")


def c45_names(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, str]]]:
    """Classes, and (name, kind) of the attributes of a .names file; kinds: continuous, ignore, or the labels as they stand."""
    text = "\n".join(first_lines(spark, path))
    entries = [e.strip() for e in re.split(r"\.\s*(?:\n|$)", re.sub(r"\|.*", "", text)) if e.strip()]
    classes = [c.strip() for c in entries[0].split(",")]
    return classes, [tuple(x.strip() for x in e.split(":", 1)) for e in entries[1:]]


def read_c45(spark: SparkSession, names: str, data: str) -> DataFrame:
    """rid, the attributes that are not to be ignored, and class."""
    _, attributes = c45_names(spark, names)
    rows = lines(spark, data).withColumn("line", F.regexp_replace(F.regexp_replace("line", r"\|.*$", ""), r"\.\s*$", "")).where("trim(line) <> ''")
    parts = F.transform(F.split("line", ","), F.trim)
    cell = lambda i: F.when(F.get(parts, F.lit(i)) != "?", F.get(parts, F.lit(i)))
    columns = [(number(cell(i)) if kind.lower() == "continuous" else cell(i)).alias(name) for i, (name, kind) in enumerate(attributes) if kind.lower() != "ignore"]
    return _ordered(rows.select("at", *columns, cell(len(attributes)).alias("class")), "rid")


def write_c45(df: DataFrame, stem: str, key: str, label: str) -> None:
    """Folders stem.names and stem.data."""
    kinds, cells = [], []
    spark = df.sparkSession
    values = lambda c: sorted(str(r[0]) for r in df.select(c).distinct().collect() if r[0] is not None)
    for f in df.schema:
        if f.name not in (key, label):
            kinds.append(f"{f.name}: " + ("continuous" if isinstance(f.dataType, T.NumericType) else ", ".join(values(f.name))) + ".")
            cells.append(_text(F.col(f.name)))
    spark.createDataFrame([(x,) for x in [", ".join(values(label)) + ".", *kinds]], "line string").coalesce(1).write.text(f"{stem}.names")
    _written([], df.select(F.col(key).alias("at"), F.concat_ws(",", *cells, _text(F.col(label))).alias("line")), f"{stem}.data")


def read_text_folder(spark: SparkSession, path: str) -> DataFrame:
    """(text, filename, class): whole files, the class being the folder that each lies in."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    name = F.col("_metadata.file_path")
    return files.select(F.col("value").alias("text"), F.element_at(F.split(name, "/"), -1).alias("filename"), F.element_at(F.split(name, "/"), -2).alias("class"))


def read_xrff(spark: SparkSession, path: str) -> DataFrame:
    """(rid, values): the instances of an XML file as arrays of text, null where a value is marked missing."""
    value = "array<struct<_VALUE:string,_missing:string>>"
    rows = spark.read.schema(f"value {value}").option("rowTag", "instance").xml(path).select(split().alias("at"), "value")
    return _ordered(rows.select("at", F.transform("value", lambda v: F.when(F.coalesce(v["_missing"], F.lit("no")) != "yes", F.trim(v["_VALUE"]))).alias("values")), "rid")


# results of an experiment


def write_results(df: DataFrame, path: str, facts: dict, parameters: str = "", key: str = "rid", compact: bool = False) -> None:
    """Rows (rid, y_true, y_pred, dist, time): three header lines (names and fold; parameters; accuracy, times, memory, classes), then a line for each case."""
    told = df.agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"), F.sum("time").alias("time"), F.max(F.size("dist")).alias("classes")).first()
    header = [",".join(str(facts.get(k, "")) for k in ("dataset", "estimator", "split", "fold", "unit", "comment")), parameters, ",".join(map(str, (told["acc"], facts.get("build", 0), told["time"], 0, 0, told["classes"])))]
    dist = F.array_join(F.transform("dist", lambda p: p.cast("string")), ",")
    parts = [F.col("y_true"), F.col("y_pred")] if compact else [F.col("y_true"), F.col("y_pred"), F.lit(""), dist, F.lit(""), F.col("time"), F.lit(""), F.lit("")]
    _written(header, df.select(F.col(key).alias("at"), F.concat_ws(",", *[p.cast("string") for p in parts]).alias("line")), path)


def read_results(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The header's facts, and (rid, y_true, y_pred, dist, time); fields are told apart by place, so build time is the second of line three."""
    first = list(islice(first_lines(spark, path), 3))
    names, figures = first[0].split(","), first[2].split(",")
    facts = dict(zip(("dataset", "estimator", "split", "fold", "unit", "comment"), names)) | {"parameters": first[1], "accuracy": float(figures[0]), "build": float(figures[1]), "test": float(figures[2]), "classes": int(figures[5])}
    rows = _ordered(lines(spark, path), "n").where("n > 2")
    parts = F.split("line", ",")
    k = facts["classes"]
    return facts, rows.select((F.col("n") - 3).alias("rid"), number(F.get(parts, F.lit(0))).cast("long").alias("y_true"), number(F.get(parts, F.lit(1))).cast("long").alias("y_pred"), F.transform(F.slice(parts, F.lit(4), F.lit(k)), number).alias("dist"), number(F.get(parts, F.lit(4 + k))).cast("long").alias("time"))


# by name

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ts": read_ts, "arff": read_arff, "csv": read_csv, "libsvm": read_svm, "svmlight": read_svm, "txt": read_delimited_series, "m": read_matrix, "xrff": read_xrff,
    "parquet": lambda spark, path: spark.read.parquet(path),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """By the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for {path}; endings: {', '.join(READERS)}")
    return READERS[kind](spark, path)


def load_split(spark: SparkSession, folder: str, problem: str, fold: int = 0, seed_column: str = "label") -> tuple[DataFrame, DataFrame]:
    """<problem>_TRAIN and _TEST of a folder; a fold other than 0 deals their rows anew, as many a class."""
    from corvane.operators.rows import resplit

    train, test = (read_ts(spark, f"{folder}/{problem}/{problem}_{side}.ts") for side in ("TRAIN", "TEST"))
    if fold == 0:
        return train, test
    n = train.count()
    pool = resplit(train, test.withColumn("series_id", F.col("series_id") + n), "series_id", seed_column, fold)
    return pool.where("train").drop("train"), pool.where("not train").drop("train")


def wide(df: DataFrame, length: int, dims: str = "dims") -> DataFrame:
    """The first dimension's values as columns att1 .. attn."""
    return df.select(*[c for c in df.columns if c != dims], *[F.get(F.get(dims, F.lit(0)), F.lit(i)).alias(f"att{i + 1}") for i in range(length)])


def narrow(df: DataFrame, columns: list[str], name: str = "dims") -> DataFrame:
    """Columns of values as the one dimension of a series."""
    return df.select(*[c for c in df.columns if c not in columns], F.array(F.array(*[F.col(c).cast("double") for c in columns])).alias(name))


def union_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
