"""Language-model scoring with a sharded Elias-Fano bigram trie.

The texts become blocks of token numbers. Each block asks the shards of the
vocabulary, by ranges of word hashes, for the corpus counts of its words, and the
shards of the bigrams for the probabilities of its word pairs; what it asks for
carries its own training counts, from which the shards make the model. So every
word and pair of a block moves once each way, however often it occurs, and no
table of the corpus is held in one place. A shard of the bigrams writes its trie
to a file of its own, maps it, answers the blocks and deletes it.

Model: p(w | v) = (c(v w) + m p(w)) / (c(v) + m), with p(w) the contract's base
probability. The trie holds c(v w) / c(v), quantised to 16 bits on fixed levels;
the block scales it by c(v) / (c(v) + m). m depends on the magnitude of c(v) alone, and is the best
of a grid by leave-one-out likelihood of all training pairs, from sums that every
shard makes over its own. An unseen context leaves p(w). So a score follows from
the corpus alone: how the texts are split decides where pairs meet, not their
probabilities.

Words are told apart by 64-bit XXH64.

Defined cases: a null or empty text has the end token alone; a null id counts as
the empty text for the remainder, so it is held out; repeated rows and equal ids
keep a row each; without training documents every token has the base probability
of none seen; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import os
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents, release, written
from corvane.llm.eliasfano import Trie, level

BLOCK = 2_000_000
ROWS = "kind int, block long, shard long, data binary"
ARROW = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int64()), ("data", pa.binary())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
DOCS, WORDS, COUNTS, PAIRS, CODES, FIT = range(6)
GRID = 10.0 ** np.arange(-1, 7.5, 0.5)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of bytes, 32- or 64-bit numbers; byte planes side by side, then zstandard."""
    z, out = zstandard.ZstdCompressor(level=1), []
    for a in arrays:
        data = z.compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes() if len(a) else b"")
        out.append(struct.pack("<cBqq", a.dtype.kind.encode(), a.itemsize, len(a), len(data)) + data)
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    z, out, at = zstandard.ZstdDecompressor(), [], 0
    while at < len(data):
        kind, width, n, size = struct.unpack_from("<cBqq", data, at)
        planes = np.frombuffer(z.decompress(data[at + 18 : at + 18 + size], max_output_size=max(1, n * width)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(np.dtype(f"<{kind.decode()}{width}")))
        at += 18 + size
    return out


def small(a: np.ndarray) -> np.ndarray:
    """Non-negative numbers in 32 bits, if they fit."""
    return a.astype(np.uint32) if not len(a) or int(a.max()) < 1 << 32 else a.astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def word_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


class Reader:
    """Collects documents into one block."""

    def __init__(self, folds: int):
        self.folds, self.words, self.ids, self.tokens, self.lengths, self.n = folds, {b"": 0}, [], [], [], 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        known = self.words
        add = known.setdefault
        found = [add(w, len(known)) for w in (text or "").encode().lower().split()]
        found.append(0)  # the end token has the empty word, which no text holds
        self.tokens.append(np.array(found, np.uint32))
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.n += len(found)

    def rows(self, block: int, shards: int) -> list[tuple]:
        h = xxhash.xxh64_intdigest
        hashes = np.array([h(w) for w in self.words], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        hashes, tokens, lengths = hashes[order], rank[np.concatenate(self.tokens)], np.array(self.lengths, np.int64)
        held = np.array([held_out(i, self.folds) for i in self.ids], np.uint8)
        counts = np.bincount(tokens[np.repeat(held, lengths) == 0], minlength=len(hashes))
        ids = np.array([0 if i is None else i for i in self.ids], np.int64)
        null = np.array([i is None for i in self.ids], np.uint8)
        out = [(DOCS, block, -1, pack(ids, null, held, small(lengths), small(tokens), np.array([len(hashes)], np.int64)))]
        shard = word_shard(hashes, shards)
        for s in np.unique(shard).tolist():
            a, b = np.searchsorted(shard, [s, s + 1])
            out.append((WORDS, block, s, pack(np.diff(hashes[a:b], prepend=np.uint64(0)), small(counts[a:b]))))
        return out


def _rows(table: pa.Table) -> list[tuple]:
    return sorted(zip(*(table[c].to_pylist() for c in ("kind", "block", "shard", "data")), strict=True), key=lambda r: r[:3])


def count_words(table: pa.Table) -> pa.Table:
    """For a shard: corpus counts of its words, and their ranks by hash among those counted, in the order each block asked."""
    asked = _rows(table)
    shard = asked[0][2]
    parts = [unpack(r[3]) for r in asked]
    sizes = [len(p[0]) for p in parts]
    hashes, place = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), return_inverse=True)
    counts = np.bincount(place, np.concatenate([p[1] for p in parts]), minlength=len(hashes)).astype(np.int64)
    ranks = np.maximum(np.cumsum(counts > 0) - 1, 0)
    ends = int(counts[hashes == np.uint64(xxhash.xxh64_intdigest(b""))].sum())
    out = [(COUNTS, -1, shard, pack(np.array([counts.sum(), (counts > 0).sum(), ends], np.int64)))]
    for r, p in zip(asked, np.split(place, np.cumsum(sizes)[:-1]), strict=True):
        out.append((COUNTS, r[1], shard, pack(small(counts[p]), small(ranks[p]))))
    return pa.Table.from_batches([_batch(out)])


class Totals:
    """What all blocks know: shards, training tokens, distinct words before each shard, training documents."""

    def __init__(self, shards: int, found: dict[int, tuple[int, int, int]]):
        sizes = [found.get(s, (0, 0, 0)) for s in range(shards)]
        self.shards, self.tokens, self.ends = shards, sum(x[0] for x in sizes), sum(x[2] for x in sizes)
        self.before = np.concatenate(([0], np.cumsum([x[1] for x in sizes])))
        self.distinct = int(self.before[-1])
        #: The pairs of contexts that occur more often are dealt over all shards.
        self.hot = max(1 << 16, self.tokens // (8 * shards))


class Block:
    """A block with its words' counts and numbers, and what it asks of the bigram shards.

    Words are numbered by hash over the corpus, so the block's own order is the
    order of numbers; START comes after all words.
    """

    def __init__(self, rows: list[tuple], totals: Totals):
        docs = next(r for r in rows if r[0] == DOCS)
        self.block, self.totals = docs[1], totals
        self.ids, self.null, self.held, lengths, tokens, (n,) = unpack(docs[3])
        self.lengths, self.tokens = lengths.astype(np.int64), tokens.astype(np.int64)
        answers = [(r[2], *unpack(r[3])) for r in rows if r[0] == COUNTS]
        self.counts = np.append(np.concatenate([a[1] for a in answers]).astype(np.int64), totals.ends)
        self.numbers = np.append(np.concatenate([totals.before[a[0]] + a[2] for a in answers]), totals.distinct)
        self.base = (self.counts[:-1] + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1))
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.before = np.concatenate(([n], self.tokens[:-1]))
        self.before[self.starts] = n
        self.known = (self.counts[self.before] > 0) & (self.counts[self.tokens] > 0)
        keys = (self.before * (n + 1) + self.tokens)[self.known]
        self.sorting = np.argsort(keys)
        keys = keys[self.sorting]
        new = np.diff(keys, prepend=-1) != 0
        self.group, self.first = np.cumsum(new) - 1, np.flatnonzero(new)
        self.context, self.word = np.divmod(keys[new], n + 1)
        seen = np.zeros(n + 1, bool)
        seen[self.before] = True
        contexts = np.flatnonzero(seen & (self.counts > 0))
        mixed = (self.numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        home = mixed % totals.shards
        spread = np.where(self.counts[self.context] > totals.hot, mixed[self.word], 0)
        shard = (mixed[self.context] + spread) % totals.shards
        self.order = np.argsort(shard, kind="stable")
        by_home = contexts[np.argsort(home[contexts], kind="stable")]
        # only shards that the block has something for: their number follows from its pairs, however many there are
        shard, home = shard[self.order], home[by_home]
        self.asked = np.union1d(shard, home)
        self.bounds = {int(s): ab for s, *ab in zip(self.asked, np.searchsorted(shard, self.asked), np.searchsorted(shard, self.asked, "right"), strict=True)}
        self.contexts = {int(s): by_home[a:b] for s, a, b in zip(self.asked, np.searchsorted(home, self.asked), np.searchsorted(home, self.asked, "right"), strict=True)}

    def asks(self) -> list[tuple]:
        """For each shard: its contexts, their counts and numbers of pairs; the pairs' words, training counts and base probabilities."""
        train = (np.repeat(self.held, self.lengths) == 0)[self.known][self.sorting]
        counts = np.add.reduceat(train.astype(np.int64), self.first)[self.order] if len(self.first) else self.first
        logs = np.clip(np.round(-25 * np.log10(self.base)), 0, 255).astype(np.uint8)
        contexts, words = self.context[self.order], self.word[self.order]
        out = []
        for s, own in self.contexts.items():
            a, b = self.bounds[s]
            c = np.unique(np.concatenate((own, contexts[a:b])))
            size = np.bincount(np.searchsorted(c, contexts[a:b]), minlength=len(c))
            w = words[a:b]
            out.append((PAIRS, self.block, s, pack(small(np.diff(self.numbers[c], prepend=0)), small(self.counts[c]), small(size), small(self.numbers[w]), small(counts[a:b]), logs[w])))
        return out

    def scores(self, rows: list[tuple], m: np.ndarray) -> pa.RecordBatch:
        found = np.zeros(len(self.first))
        for r in rows:
            if r[0] == CODES:
                (codes,) = unpack(r[3])
                a, b = self.bounds[r[2]]
                found[self.order[a:b]] = level(codes)
        weight = m[np.frexp(np.maximum(self.counts, 1))[1]]
        back = np.where(self.counts > 0, weight / (self.counts + weight), 1.0)
        found *= 1 - back[self.context]
        p = back[self.before] * self.base[self.tokens]
        seen = np.empty(len(self.group))
        seen[self.sorting] = found[self.group]
        p[self.known] += seen
        sums = lambda x: np.add.reduceat(x, self.starts)
        known = sums((self.counts[self.tokens] > 0).astype(np.int64))
        columns = [
            pa.array(self.ids, pa.int64(), mask=self.null.astype(bool)), pa.array(self.held.astype(bool)), pa.array(self.lengths, pa.int64()), pa.array(known, pa.int64()),
            pa.array(np.full(len(self.ids), self.totals.tokens), pa.int64()), pa.array(sums(np.log10(self.base)[self.tokens])), pa.array(sums(np.log10(p))),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCORES.split(", ")])


def fit_sums(counts: np.ndarray, contexts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """For each m of GRID and each magnitude of a context's count: the leave-one-out likelihood; then the number of pairs of each magnitude."""
    bucket = np.maximum(np.frexp(np.maximum(contexts, 1))[1], 2)
    out = np.empty((len(GRID) + 1, 65))
    for k, m in enumerate(GRID):
        gain = counts * np.log((counts - 1 + m * base) / (contexts - 1 + m))
        out[k] = np.bincount(bucket, gain, minlength=65)
    out[-1] = np.bincount(bucket, minlength=65)
    return out


def best_weights(sums: np.ndarray) -> np.ndarray:
    """m for each magnitude of a context's count: the best of GRID by fit_sums over all pairs."""
    m = GRID[np.argmax(sums[:-1], 0)]
    m[sums[-1] == 0] = 1000.0
    m[:2] = m[2]
    return m


def answer_pairs(table: pa.Table) -> pa.Table:
    """For a shard of the bigrams: the ratios from all blocks' counts, as a trie, the codes each block asked for, and the shard's part of the fit."""
    asked, parts = _rows(table), []
    for r in asked:
        contexts, count, size, word, n, log = unpack(r[3])
        size = size.astype(np.int64)
        parts.append((np.repeat(np.cumsum(contexts.astype(np.int64)), size), word, n, np.repeat(count, size), log))
    sizes = np.cumsum([len(p[1]) for p in parts])
    c, w, n, of, log = (np.concatenate([p[k] for p in parts]) for k in range(5))
    parts.clear()
    w = w.astype(np.int64)
    wide = len(w) and max(int(w.max()), int(c.max())) >= 1 << 31
    order = np.lexsort((w, c)) if wide else np.argsort(c << 31 | w)
    c, w = c[order], w[order]
    new = (np.diff(c, prepend=-1) != 0) | (np.diff(w, prepend=-1) != 0)
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    c, w, of, log = c[first], w[first], of[order[first]].astype(np.int64), log[order[first]]
    counts = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else first
    kept = counts > 0
    base = 10.0 ** (log[kept].astype(np.float64) / -25)
    sums = fit_sums(counts[kept], of[kept], base)
    with tempfile.TemporaryDirectory() as folder:
        Trie.write(path := os.path.join(folder, "trie"), c[kept], w[kept], counts[kept] / of[kept])
        trie = Trie(path)
        codes = np.empty(len(order), np.uint16)
        codes[order] = trie.lookup(c, w)[group]
    out = [(CODES, r[1], r[2], pack(x)) for r, x in zip(asked, np.split(codes, sizes[:-1]), strict=True)]
    return pa.Table.from_batches([_batch([*out, (FIT, -1, asked[0][2], sums.tobytes())])])


def add_fits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: the sum of its shards' parts."""
    parts = [np.frombuffer(x) for b in batches for x in b.column(0).to_pylist()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, 0).tobytes()], pa.binary())], ["data"])


def score(docs: DataFrame, folds: int = 10, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SCORES of all documents; those whose id's remainder is not 0 teach the model.

    There are as many shards as docs has partitions, so the rows of a shard grow no
    faster than a partition does. A block sends a row to each shard that it asks, a
    pair's at the least, so rows are as many as pairs at most.
    """
    shards = max(4, docs.rdd.getNumPartitions())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        number, reader = TaskContext.get().partitionId() << 24, Reader(folds)
        for b in batches:
            for doc_id, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader.add(doc_id, body)
                if reader.n >= block:
                    yield _batch(reader.rows(number, shards))
                    number, reader = number + 1, Reader(folds)
        if reader.n:
            yield _batch(reader.rows(number, shards))

    blocks = written(docs.select(key, text).mapInArrow(read, ROWS), "lm-blocks")
    asked = blocks.where(F.col("kind") == WORDS)
    counted = written(asked.groupBy("shard").applyInArrow(count_words, ROWS), "lm-counts")
    told = counted.where("block < 0").select("shard", "data").toLocalIterator()  # three numbers for each shard
    totals = Totals(shards, {s: tuple(unpack(data)[0].tolist()) for s, data in told})
    known = blocks.where(F.col("kind") == DOCS).union(counted.where("block >= 0"))

    def ask(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_batch(Block(_rows(table), totals).asks())])

    def close(table: pa.Table) -> pa.Table:
        rows = _rows(table)
        return pa.Table.from_batches([Block(rows, totals).scores(rows, m)])

    pairs = known.groupBy("block").applyInArrow(ask, ROWS)
    codes = written(pairs.groupBy("shard").applyInArrow(answer_pairs, ROWS), "lm-codes")
    sums = np.zeros((len(GRID) + 1) * 65)
    for row in codes.where(F.col("kind") == FIT).select("data").mapInArrow(add_fits, "data binary").toLocalIterator():
        sums += np.frombuffer(row["data"])
    m = best_weights(sums.reshape(-1, 65))
    return known.union(codes.where(F.col("kind") == CODES)).groupBy("block").applyInArrow(close, SCORES)


def op7_eliasfano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
