"""Removal of repeated byte strings, through a multi-document BWT built column by column.

Every string of ``LENGTH`` bytes has an anchor: the place of its least hashed
k-mer. Equal strings have their anchors at the same place, so only stretches whose
anchors' k-mers are equal need comparing. A stretch is a run of neighbouring
strings with one anchor. The different stretches around equal k-mers are the
documents of a collection, aligned on their anchors; one that occurs several times
is held once, with its count. The collection's BWT is built as Bauer, Cox and
Rosone do, from the right, one symbol of each document a round: the symbols that
stand before the suffixes so far, in the order of these, are the transform's next
column, and counting them gives the places of the longer suffixes. Common prefixes
follow from the minimum between neighbours (Cox et al. 2016). Transform, order and
prefixes are sequential files that each round appends to, reading the last column
only: as equal strings lie at equal distance from their anchors, suffixes of
different columns need no order among each other. When all columns are in, one
sequential pass finds every repeated string: its common prefix with a neighbour
reaches LENGTH, or its document occurs several times.

An anchor with more than ``CROWD`` different stretches is divided before: into
blocks of neighbouring starts, and by the bytes that all strings of a block hold;
again and again, down to single strings if need be. So the BWT decides every case
and no collection grows with the data.

The query adds a column over shorter strings, by the same method: the words of each
document that lie in repeated runs of over 50 words. Many such runs have fewer than
400 bytes, so nothing of them is removed.

Defined cases: a null or empty text has no bytes and nothing is removed; texts
shorter than LENGTH keep all; repeated rows repeat each other and lose all, equal
ids keep a row each; texts of any length are cut into overlapping pieces for
hashing; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import discard, documents, release, stable, written

LENGTH = 400
KMER = 128
#: A passage: a repeated run of over so many words, of strings of so many bytes.
PASSAGE, PASSAGE_WORDS = 256, 50
CROWD = 2_048
PIECE = 1 << 21
BATCH = 8_192
PLACE = np.uint64((1 << 24) - 1)
RUNS = "row long, h long, a int, s0 int, s1 int, g1 long, g2 long"


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Rolling:
    """Hashes of substrings of one array of bytes: sums of byte codes by powers of an odd base, modulo 2**64."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int):
        n = len(data)
        base = int(_mix(np.array([seed], np.uint64))[0]) | 1
        if seed not in self.powers or len(self.powers[seed][0]) <= n:
            size = max(n + 1, PIECE + LENGTH)
            up = np.full(size, base, np.uint64)
            down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[seed] = np.cumprod(up), np.cumprod(down)
        self.up, down = self.powers[seed]
        codes = _mix(np.arange(256, dtype=np.uint64) + np.uint64(1 + 1000 * seed))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[data] * down[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.up[start])

    def windows(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.up[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: of the end of one block and the start of the next."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def stretches(texts: list[bytes], length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(text, h, a, s0, s1, g1, g2) of every run of strings with one anchor, over concatenated texts."""
    sizes = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    hashes = Rolling(data, 1)
    kmers = hashes.windows(k)
    least = sliding_min((kmers & ~PLACE) | np.arange(len(kmers), dtype=np.uint64), length - k + 1)
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, (ends - sizes), 1)
    np.add.at(edge, np.maximum(ends - length + 1, ends - sizes), -1)
    starts = np.flatnonzero(np.cumsum(edge)[: len(least)] > 0)
    anchor = (least[starts] & PLACE).astype(np.int64)
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
    last = np.append(new[1:], len(starts)) - 1
    s0, s1, a = starts[new], starts[last], anchor[new]
    text = np.searchsorted(ends, s0, "right")
    more = _mix(((a - s0) * 4096 + (s1 - s0)).astype(np.uint64) + np.uint64(7))
    other = Rolling(data, 2)
    at = (ends - sizes)[text]
    return text, kmers[a], a - at, s0 - at, s1 - at, hashes(s0, s1 + length) ^ more, other(s0, s1 + length) ^ more


def _pieces(rows: Iterator[tuple[int, bytes]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row, first byte, bytes) by about PIECE bytes; long texts overlap by length - 1."""
    batch, size = [], 0
    for row, text in rows:
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            if size and size + len(part) > PIECE:
                yield batch
                batch, size = [], 0
            batch.append((row, at, part))
            size += len(part)
    if batch:
        yield batch


class ColumnBwt:
    """The BWT of a collection of aligned documents, a column a round, with its common prefixes, in sequential files."""

    def __init__(self, group: np.ndarray, table: np.ndarray, lo: np.ndarray, hi: np.ndarray, folder: str):
        """group: numbers from 0, ascending; table: a row for each column; lo, hi: the columns each document covers."""
        self.group, self.table, self.lo, self.hi, self.n = group.astype(np.uint16), table, lo, hi, len(group)
        self.files = {name: os.open(os.path.join(folder, name), os.O_RDWR | os.O_CREAT) for name in ("transform", "order", "prefixes")}
        self.columns = 0
        self._append("order", np.arange(self.n, dtype=np.int32))
        self._append("prefixes", np.zeros(self.n, np.int16))

    def _append(self, name: str, data: np.ndarray) -> None:
        rest = memoryview(np.ascontiguousarray(data)).cast("B")
        while len(rest):
            rest = rest[os.write(self.files[name], rest) :]

    def section(self, name: str, column: int, kind: type) -> np.ndarray:
        """A column of a file: that of the suffixes after so many rounds."""
        size, parts = self.n * np.dtype(kind).itemsize, []
        while (at := sum(map(len, parts))) < size:
            parts.append(os.pread(self.files[name], size - at, column * size + at))
        return np.frombuffer(b"".join(parts), kind)

    def insert(self, c: int) -> None:
        """One symbol of each document: that of column c, before the suffixes so far."""
        order, prefixes = self.section("order", self.columns, np.int32), self.section("prefixes", self.columns, np.int16)
        symbols = self.table[c][order].astype(np.uint16)
        symbols[(c < self.lo[order]) | (c >= self.hi[order])] = 256  # not covered: last of its group, and equal to none
        self._append("transform", symbols)
        # within a group, smaller symbols first, equal ones in the order of the suffixes that they stand before
        at = np.argsort(symbols, kind="stable")
        at = at[np.argsort(self.group[at], kind="stable")]
        symbols = symbols[at]
        same = np.zeros(self.n, bool)
        same[1:] = (self.group[1:] == self.group[:-1]) & (symbols[1:] == symbols[:-1]) & (symbols[1:] != 256)
        new = np.zeros(self.n, np.int16)
        new[same] = prefixes[at[same]] + 1
        far = np.flatnonzero(same)
        far = far[at[far] != at[far - 1] + 1]
        if len(far):
            between = np.stack((at[far - 1] + 1, at[far] + 1), 1).ravel()
            new[far] = np.minimum.reduceat(np.append(prefixes, np.int16(0)), between)[::2] + 1
        self._append("order", order[at])
        self._append("prefixes", new)
        self.columns += 1

    def repeats(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each column, the last inserted last: its documents in order, and whether a neighbour shares length symbols or more."""
        for k in range(1, self.columns + 1):
            far = self.section("prefixes", k, np.int16) >= length
            far[:-1] |= far[1:]
            yield self.section("order", k, np.int32), far

    def close(self) -> None:
        for f in self.files.values():
            os.close(f)


def repeated(group: np.ndarray, texts: list[bytes], before: np.ndarray, strings: np.ndarray, copies: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch, from, to): the repeated strings among stretches of equal group (ascending), as ranges of starts from the anchor, inclusive.

    before: bytes ahead of the anchor; strings: how many strings each stretch holds; copies: how often it occurs.
    """
    reach = length - k
    n, lo = len(texts), reach - before
    table = np.zeros((reach + length, n), np.uint8)
    sizes = np.array([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lo, sizes)
    table[column, np.repeat(np.arange(n), sizes)] = flat
    marks = np.zeros((reach + 3, n), bool)
    with tempfile.TemporaryDirectory() as folder:
        bwt = ColumnBwt(group, table, lo, lo + sizes, folder)
        for c in reversed(range(len(table))):
            bwt.insert(c)
        for c, (order, far) in zip(reversed(range(len(table))), bwt.repeats(length), strict=True):
            if c <= reach:
                marks[c + 1][order] = (far | (copies[order] > 1)) & (lo[order] <= c) & (c < lo[order] + strings[order])
        bwt.close()
    edges = np.diff(marks.astype(np.int8), axis=0).T
    stretch, first = np.nonzero(edges == 1)
    _, last = np.nonzero(edges == -1)
    return stretch, first - reach, last - 1 - reach


KIND = ("h", "g1", "g2")
KINDS = "h long, g1 long, g2 long, copies long, ahead int, strings int, bytes binary"
FOUND = "h long, g1 long, g2 long, first int, last int"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def decide(kinds: DataFrame, length: int, k: int) -> DataFrame:
    """FOUND of KINDS whose groups h are of a size for one task: through the BWT, batch by batch."""

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list) -> pa.RecordBatch:
            group = np.cumsum(np.diff(np.array([r[0] for r in rows]), prepend=rows[0][0]) != 0)
            stretch, first, last = repeated(group, [r[6] for r in rows], *(np.array([r[c] for r in rows]) for c in (4, 5, 3)), length, k)
            ids = [pa.array(np.array([r[c] for r in rows])[stretch], pa.int64()) for c in range(3)]
            return pa.RecordBatch.from_arrays([*ids, pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], _names(FOUND))

        release()
        held: list = []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(held) >= BATCH and held[-1][0] != r[0]:
                    yield done(held)
                    held = []
                held.append(r)
        if held:
            yield done(held)

    return kinds.select(*_names(KINDS)).repartition("h").sortWithinPartitions("h").mapInArrow(columns, FOUND)


def divide(kinds: DataFrame, width: int, length: int, k: int) -> DataFrame:
    """Kinds cut into blocks of width starts: their KINDS columns with the kind that each comes from (of_h, of_g1, of_g2).

    The new group is a hash of the old one, the block, and the bytes that all strings of the block hold.
    """
    reach = length - k
    names = [*_names(KINDS), "of_h", "of_g1", "of_g2"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for b in batches:
            out: list[tuple] = []
            for h, g1, g2, copies, ahead, strings, data in zip(*(b.column(c).to_pylist() for c in _names(KINDS)), strict=True):
                for block in range((reach - ahead) // width, (reach - ahead + strings - 1) // width + 1):
                    lo, hi = block * width - reach, block * width - reach + width - 1
                    first, last = max(lo, -ahead), min(hi, -ahead + strings - 1)
                    shared = data[hi + ahead : lo + length + ahead] if width > 1 else data[lo + ahead : lo + length + ahead]
                    part = data[first + ahead : last + length + ahead]
                    group = xxhash.xxh64_intdigest(shared, (h ^ block * 0x9E3779B97F4A7C15) % (1 << 64))
                    content = xxhash.xxh128_intdigest(part, first + reach)
                    out.append((signed(group), signed(content >> 64), signed(content % (1 << 64)), copies, -first, last - first + 1, part, h, g1, g2))
            columns = list(zip(*out, strict=True)) or [[]] * 10
            i, s = pa.int64(), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (i, i, i, i, s, s, pa.binary(), i, i, i), strict=True)], names)

    return kinds.mapInArrow(each, KINDS + ", of_h long, of_g1 long, of_g2 long")


def found_in(kinds: DataFrame, width: int, length: int, k: int, crowd: int) -> DataFrame:
    """Written FOUND of written KINDS; groups of more than crowd kinds are divided first."""
    sizes = written(kinds.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select("h"), "repeats-crowds")
    if width <= 1 or not sizes.limit(1).count():
        return written(decide(kinds, length, k), "repeats-found")
    few = written(decide(kinds.join(sizes, "h", "left_anti"), length, k), "repeats-found")
    width = -(-width // 2)
    parts = written(divide(kinds.join(sizes, "h", "left_semi").select(*_names(KINDS)), width, length, k), "repeats-parts")
    one = parts.groupBy(*KIND).agg(F.sum("copies").alias("copies"), F.min("ahead").alias("ahead"), F.min("strings").alias("strings"), F.min("bytes").alias("bytes"))
    below = written(one.select(*_names(KINDS)), "repeats-kinds")
    found = found_in(below, width, length, k, crowd)
    back = parts.select(*KIND, "of_h", "of_g1", "of_g2").join(found, [*KIND]).select(F.col("of_h").alias("h"), F.col("of_g1").alias("g1"), F.col("of_g2").alias("g2"), "first", "last")
    out = written(few.union(back), "repeats-found")
    discard(sizes, few, parts, below, found)
    return out


def repeated_spans(base: DataFrame, length: int = LENGTH, k: int = KMER, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Of rows (row, text as bytes) that yield the same numbers each time: written (row, text) of those that share a k-mer; (row, at, to) ranges of repeated bytes."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for part in _pieces(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), length):
                rows, at = np.array([p[0] for p in part]), np.array([p[1] for p in part])
                text, h, a, s0, s1, g1, g2 = stretches([p[2] for p in part], length, k)
                signed = lambda x: pa.array(x.view(np.int64))
                places = [pa.array((x + at[text]).astype(np.int32)) for x in (a, s0, s1)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[text]), signed(h), *places, signed(g1), signed(g2)], _names(RUNS))

    runs = written(base.select("row", "text").mapInArrow(scan, RUNS), "repeats-runs")
    # written, so that both sides of the joins below are plain shuffles, whose hot keys adaptive execution splits
    common = written(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeats-common")
    shared = written(runs.join(common, "h"), "repeats-shared")
    discard(runs, common)
    one = shared.groupBy(*KIND).agg(F.count("*").alias("copies"), F.min(F.struct("row", "a", "s0", "s1")).alias("one"))
    asked = written(one.select(*KIND, "copies", "one.*"), "repeats-asked")
    some = shared.select("row").distinct()
    texts = written(base.join(some.hint("merge"), "row").select("row", "text"), "repeats-texts")
    # a text's stretches together, so that the text moves once; they are as many as its length allows
    by = asked.groupBy("row").agg(F.collect_list(F.struct(*KIND, "copies", "a", "s0", "s1")).alias("runs"))
    cut = texts.join(by.hint("merge"), "row").select("text", F.explode("runs").alias("r"))
    ahead, strings = F.col("r.a") - F.col("r.s0"), F.col("r.s1") - F.col("r.s0") + 1
    part = F.substring("text", F.col("r.s0") + 1, F.col("r.s1") - F.col("r.s0") + length)
    kinds = written(cut.select("r.h", "r.g1", "r.g2", "r.copies", ahead.alias("ahead"), strings.alias("strings"), part.alias("bytes")), "repeats-kinds")
    found = found_in(kinds, length - k + 1, length, k, crowd)
    spans = shared.join(found, [*KIND]).select("row", (F.col("a") + F.col("first")).alias("at"), (F.col("a") + F.col("last") + length).alias("to"))
    spans = written(spans, "repeats-spans")
    discard(shared, asked, kinds, found)
    return texts, spans


def merged(spans: list) -> list[tuple[int, int]]:
    """Ranges sorted by their start, with those that touch joined."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["at"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["to"])
        else:
            out.append([s["at"], s["to"]])
    return [(a, b) for a, b in out]


def with_spans(texts: DataFrame, spans: DataFrame) -> DataFrame:
    by = spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", "to"))).alias("spans"))
    return texts.join(by.hint("merge"), "row").select("row", "text", "spans")


def passages(base: DataFrame, length: int = PASSAGE, words: int = PASSAGE_WORDS, k: int = KMER, crowd: int = CROWD) -> DataFrame:
    """(row, passage_words): words within runs of over so many words that strings of length bytes, found elsewhere too, cover; rows with any."""
    texts, spans = repeated_spans(base, length, k, crowd)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = [len(text[x:y].split()) for x, y in merged(spans)]
                found.append(sum(n for n in runs if n > words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["row", "passage_words"])

    return with_spans(texts, spans).mapInArrow(count, "row long, passage_words long").where("passage_words > 0")


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = KMER, crowd: int = CROWD, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): kept is null where the text stays whole; with a passage length also passage_words."""
    base = stable(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    facts = base.select("row", "doc_id", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    more = []
    if passage:
        told = written(passages(base, passage, k=k, crowd=crowd), "repeats-passages")
        facts = facts.join(told.hint("merge"), "row", "left")
        more = [F.coalesce("passage_words", F.lit(0)).cast("long").alias("passage_words")]
    texts, spans = repeated_spans(base, length, k, crowd)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                runs = merged(spans)
                kept = b"".join(text[x:y] for x, y in zip([0, *(y for _, y in runs)], [*(x for x, _ in runs), len(text)], strict=True))
                for column, x in zip(out, (len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["row", "n_removed", "n_spans", "kept_sha256", "kept"])

    changed = with_spans(texts, spans).mapInArrow(cut, "row long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    none = F.lit(0).cast("long")
    return facts.join(changed.hint("merge"), "row", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), "kept", *more)


def op2_column_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), passage=PASSAGE).drop("kept")
