"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Candidates of three kinds (assigned values, access keys, long hex runs) and
free-standing mixed tokens are found in whole texts. Their values' hashes are
counted over the corpus: how many owners, and how many repositories, hold each,
and whether it is anywhere a value of the three kinds. A value that many owners
hold is a copied example; one that a single owner holds and that looks live is a
credential. Free-standing tokens are reported as spans of a fourth kind, owned,
where the corpus shows them to be such: the value of a credential, repeated
without its assignment, or a token of ``LONG`` characters or more that looks live
and has one owner.

Defined cases: a null or empty text has no spans; a null owner or repository
counts as one of its own; repeated rows and equal ids each keep their own row;
spans that start together sort by kind as listed; an empty table gives an empty
result; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents, pin_splits, written

#: kind, pattern, the group that holds the value. Fixed values of the contract, but for the last.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = ["assign", "access", "hex", "owned"]
#: Runs that may match at all: shorter ones would be dropped as wholes.
PATTERNS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "owned": "[A-Za-z0-9_-]{8,}"}
#: A free-standing token of so many characters may be a credential by itself.
LONG = 20
#: Whether any pattern can match; of a token, the digit may stand anywhere.
SOME = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{8}"
SPAN = "array<struct<start:bigint,kind:int,end:bigint,hash:string,live:boolean>>"


def _spans(text: Column, kind: str) -> Column:
    """Structs (start, kind, end, hash, live) of the leftmost non-overlapping matches, by code points.

    The pieces between matches come from ``split``, the matches from
    ``regexp_extract_all``; both walk the text alike, so offsets are running sums.
    """
    pattern = F.lit(PATTERNS[kind])
    pieces = F.split(text, PATTERNS[kind], -1)
    matches = F.regexp_extract_all(text, pattern, 0)
    values = F.regexp_extract_all(text, pattern, 2) if kind == "assign" else matches
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.char_length(p).cast("long").alias("p"), F.char_length(m).cast("long").alias("m")))
    both = F.zip_with(both, values, lambda x, v: F.struct(x["p"].alias("p"), x["m"].alias("m"), v.alias("v")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + x["m"]).alias("end"), F.sha2(x["v"], 256).alias("hash"), live(x["v"]).alias("live"))
        good = F.char_length(x["v"]) >= 6 if kind == "assign" else x["v"].rlike("[0-9]") & x["v"].rlike("[A-Za-z]") if kind == "owned" else F.lit(True)
        return F.struct((start + x["m"]).alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPAN).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(both, zero, step, lambda acc: acc["out"])).otherwise(F.array().cast(SPAN))


def live(value: Column) -> Column:
    """Has digits and letters, and at least 8 different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def candidates(docs: DataFrame, key: str, text: str, owner: str, repository: Column) -> DataFrame:
    """(row, doc_id, owner, repository, spans), a written row for each document.

    One cheap pattern goes over every text first; the patterns with offsets run
    only where it matches, and each of them only where it matches itself.
    """
    pin_splits(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(SPAN)
    parts = [F.when(body.rlike(SOME), _spans(body, k)).otherwise(none) for k in KINDS]
    return written(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(owner).alias("owner"), repository.alias("repository"), F.concat(*parts).alias("spans")),
        "secret-candidates",
    )


def ownership(found: DataFrame, least_owners: int = 3) -> DataFrame:
    """(hash, owners, repositories, live, credential, class) of every candidate value of the corpus.

    The pairs are made distinct first, with partial aggregation before each
    shuffle: a value that a third of all rows hold sends a row per task.
    """
    each = found.where(F.size("spans") > 0).select("owner", "repository", F.explode("spans").alias("s"))
    pairs = each.groupBy("s.hash", "owner", "repository").agg(F.max("s.live").alias("live"), F.max(F.col("s.kind") < 3).alias("credential"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.max("live").alias("live"), F.max("credential").alias("credential"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.max("live").alias("live"), F.max("credential").alias("credential")).withColumn(
        "class", F.when(F.col("owners") >= least_owners, "example").when((F.col("owners") == 1) & F.col("live"), "live").otherwise("unclear")
    )


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: Column | None = None, least_owners: int = 3) -> DataFrame:
    """(row, doc_id, base, spans) for each row of docs: spans of the three kinds, and with those that ownership adds.

    Each has its value's class, owners and repositories. ``row`` is the row's
    monotonically increasing id in docs.
    """
    repository = F.struct(owner, "lang") if repository is None else repository
    found = candidates(docs, key, text, owner, repository)
    some = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s"))
    known = ownership(found, least_owners)
    told = some.join(known, some["s.hash"] == known["hash"])
    long = F.col("s.end") - F.col("s.start") >= LONG
    told = told.where((F.col("s.kind") < 3) | ((F.col("class") == "live") & (F.col("credential") | long)))
    told = told.select("row", F.struct("s.start", "s.kind", "s.end", "class", "owners", "repositories").alias("s"))
    told = told.groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("told"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,class:string,owners:bigint,repositories:bigint>>")
    out = found.select("row", "doc_id").join(told.hint("merge"), "row", "left").withColumn("told", F.coalesce("told", empty))
    base = F.filter("told", lambda x: x["kind"] < 3)
    owned = F.filter("told", lambda x: x["kind"] == 3)
    alone = F.filter(owned, lambda x: ~F.exists(base, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return out.select("row", "doc_id", base.alias("base"), F.array_sort(F.concat(base, alone)).alias("spans"))


def _text(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """The query's columns; classes, owners and repositories are those of the values of spans, in their order."""
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"),
        *[F.array_join(F.col(f"spans.{c}").cast("array<string>"), ",").alias(name) for c, name in (("class", "classes"), ("owners", "owners"), ("repositories", "repositories"))],
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start) replaced; overlapping spans count as one."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), more.alias("out"))).otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(scan_secrets(documents(spark, sf_dir)))
