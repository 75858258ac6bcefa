"""Elias-Fano sequences and a two-level n-gram trie over them, in one memory-mapped file."""

from __future__ import annotations

import numpy as np

SAMPLE = 512
#: Quantised probabilities: steps of 0.04 %.
OCTAVES, LEVELS = 40, 65_534


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, one after the other."""
    if not width:
        return np.zeros(0, np.uint8)
    parts = []
    for k in range(0, len(values), 1 << 16):  # 65536 values fill whole bytes at any width
        bits = values[k : k + (1 << 16), None] >> np.arange(width, dtype=np.int64) & 1
        parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint8)


def unpack_bits(data: np.ndarray, width: int, lo: int, hi: int) -> np.ndarray:
    if not width:
        return np.zeros(hi - lo, np.int64)
    first, last = lo * width, hi * width
    bits = np.unpackbits(data[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
    return bits.reshape(-1, width).astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


class EliasFano:
    """A non-decreasing sequence: low bits as they are, high bits in unary, with the place of every SAMPLE-th element."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.width, self.low, self.high, self.places = n, width, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        places = (values >> width) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 8 if n else 8) // 8 * 8, np.uint8)
        bits[places] = 1
        return cls(n, width, pack_bits(values, width), np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.int64))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.width], np.int64), self.low, self.high, self.places]

    def decode(self, lo: int, hi: int) -> np.ndarray:
        """Elements lo to hi."""
        if hi <= lo:
            return np.zeros(0, np.int64)
        start = lo // SAMPLE
        stop = -(-hi // SAMPLE)
        first = int(self.places[start]) >> 3
        last = (int(self.places[stop]) >> 3) + 1 if stop < len(self.places) else len(self.high)
        at = np.flatnonzero(np.unpackbits(self.high[first:last], bitorder="little")) + 8 * first
        at = at[at >= self.places[start]][lo - start * SAMPLE : hi - start * SAMPLE]
        return (at - np.arange(lo, hi)) << self.width | unpack_bits(self.low, self.width, lo, hi)


def save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays, each with its type and length in front, at multiples of 8 bytes."""
    with open(path, "wb") as f:
        for a in arrays:
            f.write(np.array([np.dtype(a.dtype).num, len(a)], np.int64).tobytes())
            f.write(a.tobytes())
            f.write(bytes(-a.nbytes % 8))


def load(path: str) -> list[np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    kinds = {np.dtype(t).num: np.dtype(t) for t in (np.uint8, np.uint16, np.int64)}
    out, at = [], 0
    while at < len(data):
        kind, n = data[at : at + 16].view(np.int64).tolist()
        size = n * kinds[kind].itemsize
        out.append(data[at + 16 : at + 16 + size].view(kinds[kind]))
        at += 16 + size + -size % 8
    return out


def quantise(values: np.ndarray) -> np.ndarray:
    """16-bit codes of numbers from 2**-OCTAVES to 1: levels of equal ratio, the same for all data. Code 0 is free."""
    return (1 + np.rint((OCTAVES + np.log2(np.maximum(values, 2.0**-OCTAVES))) * (LEVELS / OCTAVES))).astype(np.uint16)


def level(codes: np.ndarray) -> np.ndarray:
    """What codes stand for; 0 for code 0."""
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 1) * (OCTAVES / LEVELS) - OCTAVES), 0.0)


class Trie:
    """Contexts, monotone pointers to their successors, successors, and quantised probabilities.

    The successors of a context are stored above the last element of the context
    before, so the whole level is one non-decreasing sequence. A query looks for
    the first successor at or above the word, relative to that base and within
    the context's range.
    """

    @staticmethod
    def write(path: str, contexts: np.ndarray, words: np.ndarray, values: np.ndarray) -> None:
        """Rows sorted by context and word, each pair once."""
        new = np.flatnonzero(np.diff(contexts, prepend=-1)) if len(contexts) else np.zeros(0, np.int64)
        pointers = np.append(new, len(contexts))
        last = words[pointers[1:] - 1] if len(new) else words[:0]
        base = np.concatenate(([0], np.cumsum(last)[:-1])) if len(new) else words[:0]
        parts = [EliasFano.of(contexts[new]), EliasFano.of(pointers), EliasFano.of(words + np.repeat(base, np.diff(pointers)))]
        save(path, [*(a for part in parts for a in part.parts()), quantise(values)])

    def __init__(self, path: str):
        a = load(path)
        self.contexts, self.pointers, self.words = (EliasFano(*map(int, a[k]), *a[k + 1 : k + 4]) for k in (0, 4, 8))
        self.codes = a[12]

    def lookup(self, contexts: np.ndarray, words: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Codes of pairs sorted by context and word; 0 where a pair is not there. Decodes ``step`` contexts at a time."""
        out = np.zeros(len(contexts), np.uint16)
        for lo in range(0, self.contexts.n, step):
            hi = min(lo + step, self.contexts.n)
            here = self.contexts.decode(lo, hi)
            a, b = np.searchsorted(contexts, here[0], "left"), np.searchsorted(contexts, here[-1], "right")
            if a == b:
                continue
            pointers = self.pointers.decode(lo, hi + 1)
            first = max(int(pointers[0]) - 1, 0)
            level = self.words.decode(first, int(pointers[-1]))
            before = pointers[:-1] - 1
            base = np.where(before >= 0, level[np.maximum(before, first) - first], 0)
            level = level[int(pointers[0]) - first :]
            rank = np.minimum(np.searchsorted(here, contexts[a:b]), len(here) - 1)
            known = here[rank] == contexts[a:b]
            wanted = words[a:b] + base[rank]
            # the range's own bounds keep equal elements of neighbours apart
            at = np.searchsorted(level, wanted, "left")
            at = np.maximum(at, pointers[rank] - pointers[0])
            found = known & (at < pointers[rank + 1] - pointers[0])
            found[found] = level[at[found]] == wanted[found]
            part = out[a:b]
            part[found] = self.codes[int(pointers[0]) + at[found]]
        return out
