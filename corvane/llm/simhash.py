"""SimHash near-duplicates through Golay-code fuzzy hashing.

Fingerprints of 64 bits are cut into segments of 23, 23 and 18 bits. Two that
differ in at most two bits agree wholly on one segment, and differ in at most two
bits of the next one. The perfect Golay code (23, 12) decodes any word to the
codeword within three bits. Two words at distance two or less share a word that
is within one bit of both, so the codeword indices decoded from a word and its
one-bit neighbours (one or six of them) meet. A key is a whole segment with one
such index of the next segment: up to 18 keys for a fingerprint, and no linked
pair without a common key.

Buckets of at most ``BUCKET`` different fingerprints are verified pair by pair.
Larger ones are resolved by the same midpoint argument over all 64 bits: each
fingerprint meets others at the words within one bit of it, of which no word has
more than 65; so the work stays linear in the rows, and no link is lost.

Defined cases: a null or empty text, or one of white space, has fingerprint zero
and is linked like any other; fewer words than the shingle length give the whole
sequence as one shingle; repeated rows and equal ids keep a row each; a null
doc_id does not count for the smallest id (a component of null ids has a null
id); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import components, documents, release, written

SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code (23, 12). Fixed value.
GENERATOR = 0b101011100011
BUCKET = 32


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def _errors() -> np.ndarray:
    """The error of up to three bits for each of the 2048 syndromes."""
    bit = 1 << np.arange(23)
    one = bit
    two = (bit[:, None] | bit[None, :])[np.triu_indices(23, 1)]
    three = np.unique((two[:, None] | bit[None, :]).ravel())
    three = three[np.array([int(x).bit_count() for x in three]) == 3]
    errors = np.concatenate(([0], one, two, three))
    table = np.zeros(2048, np.int64)
    table[syndrome(errors)] = errors
    return table


ERRORS = _errors()


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[syndrome(words)]) >> 11


def near_codewords(words: np.ndarray, width: int) -> np.ndarray:
    """Indices decoded from each word and its one-bit neighbours (within width bits), a row for a word; repeats are -1."""
    flips = np.concatenate(([0], 1 << np.arange(width)))
    found = np.sort(decode((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints."""
    parts = [(fingerprints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, out = [], []
    for family in range(3):
        near = near_codewords(parts[(family + 1) % 3], SEGMENTS[(family + 1) % 3][1])
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        out.append(family << 40 | parts[family][row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(out)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    whole, ends, at = b" ".join(found), [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    stops = ends[words - 1 :] or ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(whole[a:b], seed) for a, b in zip(starts, stops, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # so that a very long text takes bounded memory
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            found = np.array([fingerprint(x, words, seed) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(key, text).mapInArrow(each, "doc_id long, fp long")


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints (a column fp, each once) at two or fewer bits."""

    def golay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            row, key = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])

    def midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate((np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)))
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            near = (fp.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), pa.array(np.repeat(fp, 65))], ["mid", "fp"])

    each = written(distinct.select("fp").mapInArrow(golay, "key long, fp long"), "golay-keys")
    sizes = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(each.join(sizes, "key"), "golay-buckets")
    small = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode(F.transform("fps", lambda x, i: F.struct(x.alias("a"), F.slice("fps", i + 2, F.size("fps")).alias("more")))).alias("p"))
    pairs = pairs.select(F.col("p.a").alias("a"), F.explode(F.filter("p.more", lambda y: F.bit_count(F.col("p.a").bitwiseXOR(y)) <= 2)).alias("b"))
    large = shared.where(F.col("n") > bucket).select("fp").distinct().mapInArrow(midpoints, "mid long, fp long")
    met = large.groupBy("mid").agg(F.sort_array(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row (doc_id, fp) of a table that yields the same rows each time."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    root = components(links(distinct), "simhash-links")
    rooted = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by = rooted.join(ids, "root").select("fp", "component_id")
    return prints.join(by, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(documents(spark, sf_dir)), "simhash")
    found = near_duplicates(prints)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
