"""Near-duplicate groups of whole texts: SimHash and Golay keys, then an exact join on rare shingles.

For filtering a corpus, where near means a Jaccard similarity of 0.8 or more
between the sets of five-word shingles. Groups are the connected components of
all such pairs, with equal texts always together.

First the cheap links: 64-bit SimHashes of the sets of words (one for each seed)
get the Golay keys of ``corvane.llm.simhash``, and in each bucket texts are held
against one text of it: the first in an order of its own for each seed and
segment. What these links leave out the join below finds, so seeds and pivots
set the work and not the result.

Then all that is left, after one more round of links to one text each: put the shingles of all texts in one order, rare ones
first. Two texts of x and y shingles at 0.8 or more share 4/9 (x + y) of them, so
the first one they share is among the first fifth of each, with that many left
from there on in both. Texts of two components that share such a shingle are
verified on their whole shingle sets; no cap on a bucket, and no pair is lost. The
order comes from counts over an eighth of the texts; any order gives the same
groups, a worse one only more pairs to verify.

Defined cases: null and empty texts, and texts of white space, are equal to each
other; fewer words than five are one shingle; repeated rows are equal texts; an
empty table gives an empty result; ids and other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import components, discard, merged, release, written
from corvane.llm.simhash import keys

SEEDS = 2
SHINGLE = 5
#: One text in so many is counted for the order of the shingles, and so many shingles at most are told to the workers.
SAMPLE = 8
COMMON = 1 << 18
SIMILAR = 0.8
#: Longs of a sketch that goes with each first shingle; the shortest sketch has as many.
BRIEF = 8
#: Texts whose sets a worker holds at a time.
PASS = 256


def set_fingerprints(text: bytes, seeds: int = SEEDS) -> np.ndarray:
    """SimHashes of the set of words, one for each seed, from one hash of each word."""
    h = xxhash.xxh64_intdigest
    base = np.array([h(w) for w in set(text.lower().split())], np.uint64)
    out = np.zeros(seeds, np.uint64)
    for s in range(seeds if len(base) else 0):
        x = base + np.uint64(s * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[s] = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(base), bitorder="little").view(np.uint64)[0]
    return out


def shingles(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the set of shingles."""
    h, found = xxhash.xxh64_intdigest, text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    word = np.array([h(w) for w in found], np.uint64)
    n = max(1, len(word) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(words, len(word))):
        total = (total ^ word[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(total)


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of a set of hashes by their last bits, at least a bit for each of them (512 at least).

    The sketches of two sets differ in no more bits than the sets differ in
    elements, and half of a sketch laid over the other half is that of half the bits.
    """
    bits = 1 << max(9, (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def brief(c: str) -> list[Column]:
    """A sketch laid over itself until 512 bits are left: the columns brief0 to brief7."""
    return [F.aggregate(F.sequence(F.lit(k + 1), F.size(c), F.lit(BRIEF)), F.lit(0).cast("long"), lambda x, at: x.bitwiseXOR(F.element_at(c, at))).alias(f"brief{k}") for k in range(BRIEF)]


def differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ; of lengths up to a factor of two apart."""

    def xor(x: Column, y: Column) -> Column:
        return x.bitwiseXOR(y)

    def halved(x: str, other: str) -> Column:
        half = F.size(other)
        return F.when(F.size(x) > half, F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), xor)).otherwise(F.col(x))

    return F.aggregate(F.zip_with(halved(a, b), halved(b, a), xor), F.lit(0), lambda n, x: n + F.bit_count(x))


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the commonest shingles of a sample of rows (row, text), and their counts; COMMON at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t or b"").view(np.int64))], ["key"])

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "key long")
    counts = written(sample.groupBy("key").agg(F.count("*").alias("n")).where("n > 2"), "neardup-common")
    least, total = 3, 0
    for n, keys_of_n in sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect(), reverse=True):
        total += keys_of_n
        if total > COMMON:
            least = n + 1
            break
    found = counts.where(F.col("n") >= least).toArrow()
    key, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(key)
    return key[order], n[order]


def first_shingles(found: np.ndarray, common: np.ndarray, counts: np.ndarray, similar: float) -> np.ndarray:
    """Of a set of shingles, rare ones first, as many as a set similar to it can't all lack."""
    if not len(found):
        return found
    rank = np.zeros(len(found), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: len(found) - math.ceil(similar * len(found) - 1e-9) + 1]


def duplicates(rows: DataFrame, similar: float = SIMILAR, seeds: int = SEEDS) -> DataFrame:
    """(row) of every row (row, text) that is not the first of its group; rows must yield the same ids each time."""
    common, counts = common_shingles(rows)
    longs = pa.list_(pa.int64())

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for t in b.column(1).cast(pa.binary()).to_pylist():
                t = (t or b"").strip(b" ")
                t = t if t.split() else b""
                own = shingles(t)
                found = (hashlib.blake2b(t, digest_size=16).digest(), set_fingerprints(t, seeds).view(np.int64), len(own), sketch(own), first_shingles(own, common, counts, similar).view(np.int64))
                for column, x in zip(out, found, strict=True):
                    column.append(x)
            kinds = (pa.binary(), longs, pa.int32(), longs, longs)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], ["row", "same", "prints", "size", "sketch", "begin"])

    every = written(rows.select("row", "text").mapInArrow(prints, "row long, same binary, prints array<long>, size int, sketch array<long>, begin array<long>"), "neardup-prints")
    first = written(every.groupBy("same").agg(F.min("row").alias("row")), "neardup-texts")
    lead = written(every.drop("same").join(first.select("row").hint("merge"), "row"), "neardup-lead")
    apart = (1 - similar) / (1 + similar)

    def golay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy()
            every = np.array(b.column(1).to_pylist(), np.int64).view(np.uint64).reshape(len(row), -1)
            for s in range(every.shape[1]):
                at, key = keys(np.ascontiguousarray(every[:, s]))
                yield pa.RecordBatch.from_arrays([pa.array(key | s << 48), pa.array(row[at])], ["key", "row"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for k in range(0, b.num_rows, PASS):
                part = b.slice(k, PASS)
                found = [shingles(t or b"").view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, longs)], ["row", "set"])

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs (a, b), those at similar or more: sketches rule out nearly all others, whole sets decide."""
        one, two = (lead.select(F.col("row").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        both = pairs.distinct().join(one.hint("merge"), "a").join(two.hint("merge"), "b")
        both = both.where(F.least("size_a", "size_b") >= similar * F.greatest("size_a", "size_b") - 1e-6)
        near = written(both.where(differ("sketch_a", "sketch_b") <= apart * (F.col("size_a") + F.col("size_b")) + 1e-6).select("a", "b"), f"neardup-{name}")
        needed = near.select(F.col("a").alias("row")).union(near.select("b")).distinct()
        found = written(rows.select("row", "text").join(needed.hint("merge"), "row").select("row", "text").mapInArrow(sets, "row long, set array<long>"), "neardup-sets")
        one, two = (found.select(F.col("row").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        shared = F.size(F.array_intersect("set_a", "set_b"))
        good = near.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(shared >= similar * (F.size("set_a") + F.size("set_b") - shared) - 1e-9)
        out = written(good.select("a", "b"), "neardup-linked")
        discard(near, found)
        return out

    keyed = written(lead.select("row", "prints").mapInArrow(golay, "key long, row long"), "neardup-keys")
    order = F.shiftright("key", 40)
    pivots = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(order, "row").alias("x"), "row"))["row"].alias("pivot")).where("n > 1")
    # of the buckets of a seed and segment, a text takes the one whose pivot comes first
    stars = keyed.join(pivots, "key").where(F.col("row") != F.col("pivot")).groupBy("row", order.alias("order"))
    stars = stars.agg(F.min(F.struct(F.xxhash64(order, "pivot").alias("x"), "pivot"))["pivot"].alias("pivot"))
    links = linked(stars.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")), "candidates")
    discard(keyed)
    roots = components(links, "neardup-roots")

    def unsettled(met: DataFrame, explode: bool) -> DataFrame:
        """met (or the first shingles of all texts) with the components so far; a shingle that one component alone has links nothing new."""
        found = met.join(roots, F.col("row") == F.col("node"), "left").withColumn("root", F.coalesce("root", "row")).drop("node")
        found = written(found, "neardup-rooted")
        each = found.select("row", "root", "size", F.posexplode("begin").alias("at", "key")).withColumn("left", F.col("size") - F.col("at")) if explode else found
        keys = each.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
        out = written(each.select("key", "row", "left", "size", "root").join(keys, "key"), "neardup-met")
        discard(found)
        return out

    def enough(a: str, b: str) -> Column:
        return F.least(f"left{a}", f"left{b}") >= similar / (1 + similar) * (F.col(f"size{a}") + F.col(f"size{b}")) - 1e-6

    met = unsettled(lead.select("row", "size", "begin"), True)
    # each text against the pivot that it shares most of its first shingles with; of a shingle's texts that is the one
    # with the fewest rarer ones of its own before it, as the form that others were made from
    own = (F.col("size") - F.col("left")) / F.col("size")
    heads = met.groupBy("key").agg(F.min(F.struct(own.alias("own"), F.xxhash64("row").alias("x"), "row", "left", "size", "root")).alias("p"))
    heads = heads.select("key", *[F.col(f"p.{x}").alias(f"{x}_p") for x in ("row", "left", "size", "root")])
    stars = met.join(heads, "key").where((F.col("root") != F.col("root_p")) & enough("", "_p")).groupBy("row", "row_p").agg(F.count("*").alias("n"))
    stars = stars.groupBy("row").agg(F.max(F.struct("n", "row_p"))["row_p"].alias("pivot"))
    roots = merged(roots, linked(stars.select(F.least("row", "pivot").alias("a"), F.greatest("row", "pivot").alias("b")), "stars"), "neardup-roots")
    before, met = met, unsettled(met.drop("root"), False)
    discard(before)
    # short sketches in the join itself, so that pairs too far apart are no rows
    short = lead.join(met.select("row").distinct().hint("merge"), "row").select("row", *brief("sketch"))
    before, met = met, written(met.join(short.hint("merge"), "row"), "neardup-short")
    discard(before)
    one, two = (met.select("key", *[F.col(x).alias(f"{x}_{c}") for x in met.columns if x != "key"]) for c in "ab")
    bits = sum((F.bit_count(F.col(f"brief{k}_a").bitwiseXOR(F.col(f"brief{k}_b"))) for k in range(BRIEF)), F.lit(0))
    rest = one.join(two, "key").where((F.col("row_a") < F.col("row_b")) & (F.col("root_a") != F.col("root_b")) & enough("_a", "_b") & (bits <= apart * (F.col("size_a") + F.col("size_b")) + 1e-6))
    roots = merged(roots, linked(rest.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")), "rest"), "neardup-roots")
    kept = first.join(roots, first["row"] == roots["node"], "left").select("same", F.coalesce("root", "row").alias("root"))
    gone = written(every.select("row", "same").join(kept, "same").where("row <> root").select("row"), "neardup-gone")
    discard(every, first, lead, met, roots)
    return gone
