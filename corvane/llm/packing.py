"""Packing token sequences into windows: bounded-space online best fit.

Each partition streams its documents through a fixed number of open windows. A
document is cut into whole windows while it is longer than one; its rest goes to
the open window it fits most tightly. When none fits and no window is free, the
fullest is emitted: its gap, if it is worth a cut, takes the head of the piece.
Windows still open at the end of a partition are merged: their pieces are packed
again, some partitions together, level by level, until one group is left. That
one fills its windows without gaps, and cuts what remains at powers of two,
which need no padding.

A partition holds ``OPEN`` windows of token ids, whatever its size.

Defined cases: a null or empty text has the end token alone; texts of any length
are cut; repeated rows and equal or null ids are documents of their own; an
empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import documents, held, release, written

CAPACITY = 4096
OPEN = 32
#: A gap of so many tokens at most is padded rather than filled by a cut.
LEAST_CUT = 16
#: Leftover windows of so many partitions are merged by one task.
MERGE = 16
END = 2
#: Distinct words whose ids a worker keeps, in each of two generations.
CACHE = 600_000
#: ASCII punctuation without the apostrophe.
TAIL = b"""!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROWS = PIECES + ", task long, ids binary"
ARROW = pa.schema([*((n.split()[0], pa.int64()) for n in ROWS.split(", ")[:-1]), ("ids", pa.binary())])


class WordEncoder:
    """Token ids of whole texts, for a lower-casing BPE with word ends that never joins characters across white space.

    A word is encoded once while the cache holds it, which keeps two generations of
    ``cache`` words. Words of letters alone, or with a tail of ASCII punctuation
    but no apostrophe, are cut between the two, as the tokenizer does. Their
    letters, brought to the model's characters here, are encoded many at a time, as
    one text cut at white space alone, and parted again behind the tokens that end a word. All other
    words are encoded one by one. Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.size = Tokenizer.from_file(path), cache
        self.known, self.older = {}, {}
        plain = json.loads(self.tokenizer.to_str())
        self.by_word = plain["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in (plain["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            plain |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
            self.plain = Tokenizer.from_str(json.dumps(plain))

    def _encode(self, words: Iterable[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(list(words), add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        known, older = self.known, self.older
        odd, cut, fresh = [], [], {}
        for w in new:
            if w in older:
                known[w] = older[w]
            elif w.isalpha():
                fresh[w] = w.lower().decode()
            else:
                core = w.rstrip(TAIL)
                if core not in known and core not in fresh:
                    if core in older:
                        known[core] = older[core]
                    elif core.isalpha():
                        fresh[core] = core.lower().decode()
                    elif not core.isascii() and (form := _letters(core.lower().decode())):
                        fresh[core] = form.encode().decode("latin-1").translate(BYTES)
                    else:
                        odd.append(w)
                        continue
                elif not (core.isalpha() or not core.isascii() and _letters(core.lower().decode())):
                    odd.append(w)
                    continue
                if len(core) < len(w):
                    cut.append((w, core, w[len(core) :]))
        if fresh:
            ids = np.array(self.plain.encode_batch_fast([" ".join(fresh.values())], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            data = ids.tobytes()
            known.update(zip(fresh, (data[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)), strict=True))
        odd += {t for _, _, t in cut if t not in known}
        if odd:
            known.update(zip(odd, self._encode(w.decode() for w in odd), strict=True))
        for w, core, tail in cut:
            known[w] = known[core] + known[tail]

    def __call__(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        for part in _parts([t or b"" for t in texts]):
            if not self.by_word:
                yield from (np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast([t.decode() for t in part], add_special_tokens=False))
                continue
            if len(self.known) > self.size:
                self.known, self.older = {}, self.known
            # the tokenizer's special tokens are told apart by case
            split = [(t if b"<|" in t else t.lower()).split() for t in part]
            get = self.known.get
            here = {w: get(w) for w in set().union(*split)}
            if new := [w for w, ids in here.items() if ids is None]:
                self._learn(new)
                here.update(zip(new, map(self.known.__getitem__, new), strict=True))
            for words in split:
                yield np.frombuffer(b"".join(map(here.__getitem__, words)), "<u4")


def _parts(texts: list[bytes], most: int = 2048, size: int = 1 << 24) -> Iterator[list[bytes]]:
    """Texts by so many at a time, or so many bytes."""
    ends = np.cumsum([len(t) for t in texts])
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right"))
        last = min(max(last, first + 1), first + most)
        yield texts[first:last]
        first = last


def _letters(word: str) -> str:
    """A word in the tokenizer's own form, if that is letters alone; else nothing."""
    form = unicodedata.normalize("NFC", word).lower()
    return form if form.isalpha() and "\u03c2" not in form and "\u03a3" not in word else ""


def _byte_characters() -> dict[int, str]:
    """The character that byte-level BPE has for each byte: itself where it prints, else one above 255, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}


BYTES = _byte_characters()


def encoder(path: str, cache: int = CACHE) -> WordEncoder:
    """One for each worker process, path and size."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if ("packing", path, cache) not in held:
        release()
        held["packing", path, cache] = WordEncoder(path, cache)
    return held["packing", path, cache]


class Packer:
    """Open windows of one task. A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, first: int, capacity: int = CAPACITY, slots: int = OPEN, least_cut: int = LEAST_CUT):
        self.next, self.capacity, self.slots, self.least_cut = first, capacity, slots, least_cut
        self.windows: list[tuple[int, list]] = []
        self.out: list[list] = [[] for _ in range(7)]

    def emit(self, pieces: Iterable[tuple]) -> None:
        offset = 0
        for doc, start, tokens, ids in pieces:
            row = (doc, start, len(ids), zlib.crc32(ids.tobytes()), tokens, self.next, offset)
            for column, x in zip(self.out, row, strict=True):
                column.append(x)
            offset += len(ids)
        self.next += 1

    def add(self, doc, start: int, tokens: int, ids: np.ndarray) -> None:
        while len(ids) >= self.capacity:
            self.emit([(doc, start, tokens, ids[: self.capacity])])
            start, ids = start + self.capacity, ids[self.capacity :]
        if not len(ids):
            return
        room = self.capacity - len(ids)
        best = max((k for k, w in enumerate(self.windows) if w[0] <= room), key=lambda k: self.windows[k][0], default=None)
        if best is None and len(self.windows) == self.slots:
            fullest = max(range(self.slots), key=lambda k: self.windows[k][0])
            fill, pieces = self.windows.pop(fullest)
            if (gap := self.capacity - fill) > self.least_cut:
                pieces.append((doc, start, tokens, ids[:gap]))
                start, ids = start + gap, ids[gap:]
            self.emit(pieces)
            return self.add(doc, start, tokens, ids)
        if best is None:
            self.windows.append((len(ids), [(doc, start, tokens, ids)]))
            return
        fill, pieces = self.windows[best]
        pieces.append((doc, start, tokens, ids))
        self.windows[best] = (fill + len(ids), pieces)
        if fill + len(ids) == self.capacity:
            self.emit(self.windows.pop(best)[1])

    def close(self) -> None:
        """Emit what is open: full windows, then windows of powers of two."""
        rest = [p for _, pieces in sorted(self.windows, key=lambda w: -w[0]) for p in pieces]
        self.windows = []
        left = sum(len(p[3]) for p in rest)
        while left:
            size = min(self.capacity, 1 << left.bit_length() - 1)
            left -= size
            taken = []
            while size:
                doc, start, tokens, ids = rest.pop(0)
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, tokens, ids[size:]))
                taken.append((doc, start, tokens, ids[:size]))
                size -= len(taken[-1][3])
            self.emit(taken)

    def sealed(self) -> pa.RecordBatch:
        columns, self.out = self.out, [[] for _ in range(7)]
        n = len(columns[0])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], schema=ARROW)

    def leftovers(self, task: int) -> pa.RecordBatch:
        """The pieces of open windows, to be packed again; sequence_id keeps windows together."""
        rows = [(d, s, len(i), None, t, k, None, task, i.astype("<u4").tobytes()) for k, (_, pieces) in enumerate(self.windows) for d, s, t, i in pieces]
        columns = list(zip(*rows, strict=True)) or [[]] * 9
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """PIECES of all documents. sequence_id is level, task and number, so unique without a shuffle."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packer, encode = Packer(task << 32), encoder(tokenizer, cache)
        for b in (whole.slice(k, 2048) for whole in batches for k in range(0, whole.num_rows, 2048)):
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1).cast(pa.binary()).to_pylist()), strict=True):
                ids = np.append(ids, np.array([END], "<u4"))
                packer.add(doc, 0, len(ids), ids)
            if packer.out[0]:
                yield packer.sealed()
        yield packer.leftovers(task)

    def again(level: int, last: bool) -> Callable[[pa.Table], pa.Table]:
        def merge(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("ids_at", "ascending")])
            group = rows["group"][0].as_py()
            packer = Packer((level << 56) + (group << 32))
            for doc, start, tokens, ids in zip(*(rows[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.add(doc, start, tokens, np.frombuffer(ids, "<u4"))
            if last:
                packer.close()
            return pa.Table.from_batches([packer.sealed(), packer.leftovers(group)])

        return merge

    rows = written(docs.select(key, text).mapInArrow(first, ROWS), "packing")
    level, sealed = 0, [rows.where("ids is null")]
    most = rows.agg(F.max("task")).first()[0]
    while True:
        level += 1
        last = most is None or most < MERGE
        group = F.floor(F.col("task") / MERGE)
        rest = rows.where("ids is not null").withColumn("group", group).withColumn("ids_at", F.struct("doc_id", "start").cast("string"))
        rows = written(rest.groupBy("group").applyInArrow(again(level, last), ROWS), "packing")
        sealed.append(rows.where("ids is null"))
        if last:
            return reduce(DataFrame.union, sealed).drop("task", "ids")
        most //= MERGE


def op5_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
