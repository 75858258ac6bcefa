"""Elastic distances between series, for batches of pairs at a time.

Each takes a and b of shape (pairs, dimensions, length) and gives a distance for each
pair; the table of the recurrence is filled by anti-diagonals, with NumPy over a
diagonal's cells of as many pairs as a processor's cache holds. A pair that exceeds its
limit is infinitely far; cells never fall along a path, so two whole diagonals decide.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np

Distance = Callable[..., np.ndarray]


def shaped(x: np.ndarray) -> np.ndarray:
    """(pairs, dimensions, length) of (length,), (pairs, length) or itself."""
    x = np.asarray(x, float)
    return x.reshape((1,) * (3 - x.ndim) + x.shape) if x.ndim == 1 else x[:, None, :] if x.ndim == 2 else x


def band(n: int, m: int, i: int, window: float) -> tuple[int, int]:
    """Columns of row i within window * m of the stretched diagonal."""
    middle = i * (m - 1) / (n - 1) if n > 1 else 0.0
    return max(0, math.ceil(middle - window * m)), min(m - 1, math.floor(middle + window * m))


#: Numbers in a buffer of one anti-diagonal, which a few such keep within a processor's cache.
CELLS = 24_576
#: The same where one series is held against many, which takes fewer buffers.
ROOM = 16_384
#: Numbers in a buffer of a row of a band's cells.
BAND = 65_536
#: Costs of all cells of a series with a block's, where they are made at once.
COSTS = 2_097_152


def _edges(n: int, m: int, window: float) -> list[tuple[int, int]]:
    """For each anti-diagonal, the first and last row of its cells in the band; without any, the last is before the first."""
    low, high = zip(*((i + lo, i + hi) for i in range(n) for lo, hi in (band(n, m, i, window),)), strict=True)
    k = np.arange(n + m - 1)
    return list(zip(np.searchsorted(np.maximum.accumulate(high), k).tolist(), (np.searchsorted(np.maximum.accumulate(low), k, "right") - 1).tolist(), strict=True))


def _filled(a: np.ndarray, b: np.ndarray, window: float, limit: np.ndarray | float | None, start: Callable, margin: Callable | None = None) -> np.ndarray:
    """The last cell, by anti-diagonals: no cell needs another one of its own, so a step takes a whole one of many pairs.

    start(a, b), of (dimensions, length, pairs), b reversed in time, gives
    fill(k, lo, hi, at, d, u, l, out): the cells of diagonal k in rows lo to hi from their neighbours before on
    the diagonal, above and to the left (infinite out of the band; 0 before the
    first cell); at is where b's points for these rows start. margin(a, b) gives
    the cells of a row and column before the first, by place.
    """
    n, m, pairs = a.shape[2], b.shape[2], len(a)
    if not n or not m:
        return np.full(pairs, 0.0 if n == m else np.inf)
    edges, out = _edges(n, m, window), np.empty(pairs)
    step = max(16, CELLS // max(1, *(hi + 1 - lo for lo, hi in edges)))
    for s in range(0, pairs, step):
        x, y = (np.ascontiguousarray(z[s : s + step].transpose(1, 2, 0)) for z in (a, b[:, :, ::-1]))
        most = None if limit is None else np.broadcast_to(limit, (pairs,))[s : s + step]
        fill = start(x, y)
        down, right = margin(x, y) if margin else (None, None)
        # cell (i, k - i) stands at i + 1
        before, last, now = (np.full((n + 2, x.shape[2]), np.inf) for _ in range(3))
        before[0] = 0.0
        if margin:
            last[0], last[1] = right[0], down[0]
        for k, (lo, hi) in enumerate(edges):
            if lo > hi:
                now.fill(np.inf)
            else:
                now[lo] = now[hi + 2] = np.inf
                at = m - 1 - k + lo
                fill(k, lo, hi, at, before[lo : hi + 1], last[lo : hi + 1], last[lo + 1 : hi + 2], now[lo + 1 : hi + 2])
            if margin:
                now[0] = right[k + 1] if k + 1 < m else np.inf
                if k + 1 < n:
                    now[k + 2] = down[k + 1]
            if most is not None and k % 16 == 15 and lo <= hi and not margin:
                least = np.minimum(now[lo + 1 : hi + 2].min(0), last[lo : hi + 2].min(0))
                if (least > most).all():
                    now[n] = np.inf
                    break
            before, last, now = last, now, before
        else:
            now = last
        out[s : s + step] = now[n] if most is None else np.where(now[n] > most, np.inf, now[n])
    return out


def _squares(x: np.ndarray, y: np.ndarray, out: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Squared differences, summed over the first axis, into out."""
    np.subtract(x[0], y[0], out=out)
    np.multiply(out, out, out=out)
    for d in range(1, len(x)):
        np.subtract(x[d], y[d], out=more)
        np.multiply(more, more, out=more)
        np.add(out, more, out=out)
    return out


def _warped(a: np.ndarray, b: np.ndarray, window: float, limit: np.ndarray | float | None, weights: np.ndarray | None = None) -> np.ndarray:
    """dtw, its costs weighed by |i - j| where there are weights."""
    a, b = _oriented(a, b)

    def start(x, y):
        one, two = (np.empty(x.shape[1:]) for _ in range(2))

        def fill(k, lo, hi, at, d, u, l, out):  # noqa: E741
            n = hi + 1 - lo
            cost = _squares(x[:, lo : hi + 1], y[:, at : at + n], one[:n], two[:n])
            if weights is not None:
                np.multiply(cost, weights[abs(2 * np.arange(lo, hi + 1) - k)][:, None], out=cost)
            np.minimum(d, u, out=out)
            np.minimum(out, l, out=out)
            np.add(out, cost, out=out)

        return fill

    return _filled(a, b, window, limit, start)


def _oriented(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The longer one first."""
    a, b = shaped(a), shaped(b)
    return (b, a) if a.shape[2] < b.shape[2] else (a, b)


def euclidean(a: np.ndarray, b: np.ndarray, limit: float | None = None) -> np.ndarray:
    """Squared, over all dimensions."""
    d = ((shaped(a) - shaped(b)) ** 2).sum((1, 2))
    return d if limit is None else np.where(d > limit, np.inf, d)


def dtw(a: np.ndarray, b: np.ndarray, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    """Squared-cost dynamic time warping of all dimensions together, within a band around the stretched diagonal."""
    return _warped(a, b, window, limit)


def weighted_dtw(a: np.ndarray, b: np.ndarray, g: float = 0.05, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    """dtw whose costs weigh 1 / (1 + exp(-g (|i - j| - n / 2))), n the longer length."""
    n = max(shaped(a).shape[2], shaped(b).shape[2])
    return _warped(a, b, window, limit, 1 / (1 + np.exp(-g * (np.arange(n) - n / 2))))


def erp(a: np.ndarray, b: np.ndarray, gap: float = 0.01, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    """Edit distance with real penalty, squared costs; the first pair costs nothing, and ties prefer the pair."""
    a, b = _oriented(a, b)

    def start(x, y):
        skip_a, skip_b = ((x - gap) ** 2).sum(0), ((y - gap) ** 2).sum(0)
        one, two = (np.empty(x.shape[1:]) for _ in range(2))

        def fill(k, lo, hi, at, d, u, l, out):  # noqa: E741
            n = hi + 1 - lo
            pair = _squares(x[:, lo : hi + 1], y[:, at : at + n], one[:n], two[:n])
            np.add(d, pair, out=out)
            np.minimum(out, np.add(l, skip_b[at : at + n], out=pair), out=out)
            np.minimum(out, np.add(u, skip_a[lo : hi + 1], out=pair), out=out)
            if k == 0:
                out.fill(0.0)

        return fill

    return _filled(a, b, window, limit, start)


def lcss(a: np.ndarray, b: np.ndarray, epsilon: float = 0.01, window: float = 1.0) -> np.ndarray:
    """One less the longest common subsequence's share of the shorter length; points match within epsilon in every dimension."""
    a, b = _oriented(a, b)
    n, m = a.shape[2], b.shape[2]
    if not n or not m:
        return np.full(len(a), 0.0 if n == m else 1.0)
    if window >= 1:
        return 1 - _common(a, b, epsilon) / min(n, m)
    row = np.zeros((m + 1, len(a)), int)
    for i in range(n):
        lo, hi = band(n, m, i, window)
        new = np.zeros_like(row)
        same = (np.abs(a[:, :, i][:, :, None] - b) <= epsilon).all(1).T
        for j in range(lo, hi + 1):
            new[j + 1] = np.where(same[j], row[j] + 1, np.maximum(row[j + 1], new[j]))
        new[hi + 2 :] = new[hi + 1]
        row = new
    return 1 - row[-1] / min(n, m)


def _common(a: np.ndarray, b: np.ndarray, epsilon: float) -> np.ndarray:
    """Lengths of the longest common subsequences, by anti-diagonals of the whole table: the most of three neighbours, a match being one more than the one before."""
    n, m, pairs = a.shape[2], b.shape[2], len(a)
    edges, out = _edges(n, m, 1.0), np.empty(pairs, int)
    step = max(16, CELLS // n)
    for s in range(0, pairs, step):
        x, y = (np.ascontiguousarray(z[s : s + step].transpose(1, 2, 0)) for z in (a, b[:, :, ::-1]))
        before, last, now = (np.zeros((n + 2, x.shape[2]), np.int16 if n < 30_000 else int) for _ in range(3))
        gap, same, more = np.empty(x.shape[1:]), np.empty(x.shape[1:], bool), np.empty(x.shape[1:], bool)
        for k, (lo, hi) in enumerate(edges):
            c, at = hi + 1 - lo, m - 1 - k + lo
            for d in range(len(x)):
                np.abs(np.subtract(x[d, lo : hi + 1], y[d, at : at + c], out=gap[:c]), out=gap[:c])
                np.less_equal(gap[:c], epsilon, out=(more if d else same)[:c])
                if d:
                    np.logical_and(same[:c], more[:c], out=same[:c])
            now[lo] = now[hi + 2] = 0
            cells = np.add(before[lo : hi + 1], same[:c], out=now[lo + 1 : hi + 2])
            np.maximum(cells, last[lo : hi + 1], out=cells)
            np.maximum(cells, last[lo + 1 : hi + 2], out=cells)
            before, last, now = last, now, before
        out[s : s + step] = last[n]
    return out


def msm(a: np.ndarray, b: np.ndarray, c: float = 1.0, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    """Move, split, merge; of several dimensions the sum.

    A split or merge of x next to y and z costs c, and if x isn't between them its
    distance to the nearer one: of x - z, what lies between 0 and x - y.
    """
    a, b = _oriented(a, b)

    def start(x, y):
        up, left = np.diff(x, axis=1, prepend=x[:, :1]), np.diff(y, axis=1, append=y[:, -1:])  # y runs back in time: each less the next one
        up_lo, up_hi, left_lo, left_hi = np.minimum(up, 0), np.maximum(up, 0), np.minimum(left, 0), np.maximum(left, 0)
        gap, cost, more = (np.empty(x.shape[1:]) for _ in range(3))

        def fill(k, lo, hi, at, d, u, l, out):  # noqa: E741
            n = hi + 1 - lo
            t, v, w = gap[:n], cost[:n], more[:n]
            for own, low, high, first, rest in ((d, None, None, 0, 0), (u, up_lo, up_hi, lo, 1), (l, left_lo, left_hi, at, 1)):
                for q in range(len(x)):
                    np.subtract(x[q, lo : hi + 1], y[q, at : at + n], out=t)
                    to = w if q else v
                    if rest:
                        np.minimum(np.maximum(t, low[q, first : first + n], out=t), high[q, first : first + n], out=t)
                    np.abs(t, out=to)
                    if rest:
                        np.add(to, c, out=to)
                    if q:
                        np.add(v, w, out=v)
                np.add(v, own, out=v if rest else out)
                if rest:
                    np.minimum(out, v, out=out)

        return fill

    return _filled(a, b, window, limit, start)


def twed(a: np.ndarray, b: np.ndarray, nu: float = 1.0, penalty: float = 1.0, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    """Time warp edit distance, squared point costs; points before the first are 0."""
    a, b = _oriented(a, b)
    n, m = a.shape[2], b.shape[2]

    def steps(x, y):
        """Squared steps to each point, the first from 0; y runs back in time."""
        return (np.diff(x, axis=1, prepend=0.0) ** 2).sum(0), (np.diff(y, axis=1, append=0.0) ** 2).sum(0)

    def margin(x, y):
        """The row and column before the first: everything deleted."""
        one, two = steps(x, y)
        return np.cumsum(one, axis=0), np.cumsum(two[::-1], axis=0)

    def start(x, y):
        one, two = (s + (penalty + nu) for s in steps(x, y))
        costs = [np.zeros((n + 1, x.shape[2])) for _ in range(3)]  # of a diagonal and the two before, at i + 1
        more = np.empty(x.shape[1:])

        def fill(k, lo, hi, at, d, u, l, out):  # noqa: E741
            c = hi + 1 - lo
            cost, was = costs[k % 3], costs[(k - 2) % 3]
            own = _squares(x[:, lo : hi + 1], y[:, at : at + c], cost[lo + 1 : hi + 2], more[:c])
            time = nu * abs(2.0 * np.arange(lo, hi + 1) - k) * 2
            if lo == 0:
                time[0] /= 2
                was[0] = 0.0
            if hi == k:
                time[-1] = time[-1] / 2 if hi else time[-1]
                was[hi] = 0.0
            np.add(d, time[:, None], out=out)
            np.add(out, own, out=out)
            np.add(out, was[lo : hi + 1], out=out)
            np.minimum(out, np.add(u, one[lo : hi + 1], out=more[:c]), out=out)
            np.minimum(out, np.add(l, two[at : at + c], out=more[:c]), out=out)

        return fill

    return _filled(a, b, window, limit, start, margin)


def _by_rows(x: np.ndarray, y: np.ndarray, edges: list[tuple[int, int]], make: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]], dtype: type = float) -> np.ndarray:
    """Distances of every x to every y, of (rows, length): make(some rows of y) gives a function of as many x's side by side, (length, rows), so that what depends on y alone is made once."""
    out = np.empty((len(x), len(y)), dtype)
    room = max(16, ROOM * 8 // np.dtype(dtype).itemsize * len(edges) // max(1, sum(max(0, hi + 1 - lo) for lo, hi in edges)))
    for s in range(0, len(y), room):
        rows = y[s : s + room]
        together = max(1, min(room // len(rows), len(x)))
        to = make(np.tile(rows, (together, 1)))
        for i in range(0, len(x), together):
            some = x[np.minimum(np.arange(i, i + together), len(x) - 1)]
            out[i : i + together, s : s + room] = to(np.repeat(some.T, len(rows), 1)).reshape(together, len(rows))[: len(x) - i]
    return out


def _diagonals(tables: list[np.ndarray], edges: list[tuple[int, int]]) -> list[tuple]:
    """For each anti-diagonal its number, first and last row, the views d, u, l and out of ``_filled``, and the two neighbours of out, to be infinite; without cells a whole table."""
    out = []
    for k, (lo, hi) in enumerate(edges):
        before, last, now = (tables[(k + r) % 3] for r in range(3))
        out.append((k, lo, hi, before[lo : hi + 1], last[lo : hi + 1], last[lo + 1 : hi + 2], now[lo + 1 : hi + 2], now[lo], now[hi + 2]) if lo <= hi else (k, lo, hi, *[now] * 6))
    return out


def _apart(values: np.ndarray, n: int, rows: int, dtype: type) -> Callable[[int, int, int], np.ndarray]:
    """at(k, lo, hi): of the cells (i, k - i) in rows lo to hi the values[|i - j|], as many as rows side by side: slices of two tables, as NumPy is slow on broadcast columns."""
    far = 2 * n
    tables = [np.repeat(values[np.minimum(abs(np.arange(odd - far, far, 2)), len(values) - 1)][:, None].astype(dtype), rows, 1) for odd in (0, 1)]
    return lambda k, lo, hi: tables[k % 2][(2 * lo - k + far) // 2 : (2 * lo - k + far) // 2 + hi + 1 - lo]


def _warped_every(x: np.ndarray, y: np.ndarray, window: float = 1.0, weights: np.ndarray | None = None, dtype: type = float) -> np.ndarray:
    """_warped of every x with every y, of one dimension, x the longer; the same operations in the same order."""
    n, m = x.shape[1], y.shape[1]
    edges = _edges(n, m, window)
    width = max(1, *(hi + 1 - lo for lo, hi in edges))

    def make(rows: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        back, own, cost = np.ascontiguousarray(rows.T[::-1], dtype), np.empty((n, len(rows)), dtype), np.empty((width, len(rows)), dtype)
        tables = [np.full((n + 2, len(rows)), np.inf, dtype) for _ in range(3)]
        weight = None if weights is None else _apart(weights, n, len(rows), dtype)
        steps = []
        for k, lo, hi, *views in _diagonals(tables, edges):
            c, at = hi + 1 - lo, m - 1 - k + lo
            steps.append((c, own[lo : hi + 1], back[at : at + c] if c > 0 else None, cost[: max(c, 0)], weight(k, lo, hi) if weight and c > 0 else None, *views))

        def to(some: np.ndarray) -> np.ndarray:
            own[:] = some
            tables[0][0], tables[1][:2] = 0.0, np.inf
            for c, a, b, gap, w, d, u, l, cells, low, high in steps:  # noqa: E741
                if c < 1:
                    cells.fill(np.inf)
                    continue
                low.fill(np.inf)
                high.fill(np.inf)
                np.subtract(a, b, out=gap)
                np.multiply(gap, gap, out=gap)
                if w is not None:
                    np.multiply(gap, w, out=gap)
                np.minimum(d, u, out=cells)
                np.minimum(cells, l, out=cells)
                np.add(cells, gap, out=cells)
            return tables[(n + m) % 3][n]

        return to

    return _by_rows(x, y, edges, make, dtype)


def _twed_every(x: np.ndarray, y: np.ndarray, nu: float = 1.0, penalty: float = 1.0, window: float = 1.0) -> np.ndarray:
    """twed of every x with every y, of one dimension, x the longer; the same operations in the same order."""
    n, m = x.shape[1], y.shape[1]
    edges = _edges(n, m, window)

    def make(rows: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        p = len(rows)
        back = np.ascontiguousarray(rows.T[::-1])
        right = np.diff(back, axis=0, append=0.0) ** 2
        two, right = right + (penalty + nu), np.cumsum(right[::-1], axis=0)
        own, one, more = np.empty((n, p)), np.empty((n, p)), np.empty((n, p))
        tables = [np.full((n + 2, p), np.inf) for _ in range(3)]
        costs = [np.zeros((n + 1, p)) for _ in range(3)]
        time = _apart(nu * np.arange(2.0 * n) * 2, n, p, float)
        steps = []
        for k, lo, hi, *views in _diagonals(tables, edges):
            c, at = hi + 1 - lo, m - 1 - k + lo
            now = tables[(k + 2) % 3]
            first = [right[k + 1]] if k + 1 < m else []
            if c < 1:
                steps.append((c, k, now, first, *[None] * 14))
                continue
            cost, was = costs[k % 3], costs[(k - 2) % 3]
            half = {0: k} if lo == 0 else {}  # by place, how far apart a cell of the first row or column is
            if hi == k and hi:
                half[c - 1] = k
            ends = [(views[0][i], nu * 2.0 * z / 2, views[3][i]) for i, z in half.items()]
            none = [was[0]] * (lo == 0) + [was[hi]] * (hi == k)
            steps.append((c, k, now, first, own[lo : hi + 1], back[at : at + c], cost[lo + 1 : hi + 2], was[lo : hi + 1], none, ends, time(k, lo, hi), one[lo : hi + 1], two[at : at + c], more[:c], *views[:4]) + tuple(views[4:]))

        def to(some: np.ndarray) -> np.ndarray:
            square = np.diff(some, axis=0, prepend=0.0) ** 2
            down = np.cumsum(square, axis=0)
            own[:], one[:] = some, square + (penalty + nu)
            tables[0][0], tables[1][0], tables[1][1] = 0.0, right[0], down[0]
            for c, k, now, first, a, b, cost, was, none, ends, apart, gone, left, spare, d, u, l, cells, *sides in steps:  # noqa: E741
                if c < 1:
                    now.fill(np.inf)
                else:
                    for z in sides:
                        z.fill(np.inf)
                    np.subtract(a, b, out=cost)
                    np.multiply(cost, cost, out=cost)
                    for z in none:
                        z.fill(0.0)
                    np.add(d, apart, out=cells)
                    for z, half, cell in ends:
                        np.add(z, half, out=cell)
                    np.add(cells, cost, out=cells)
                    np.add(cells, was, out=cells)
                    np.minimum(cells, np.add(u, gone, out=spare), out=cells)
                    np.minimum(cells, np.add(l, left, out=spare), out=cells)
                now[0] = first[0] if first else np.inf
                if k + 1 < n:
                    now[k + 2] = down[k + 1]
            return tables[(n + m) % 3][n]

        return to

    return _by_rows(x, y, edges, make)


def _lcss_every(x: np.ndarray, y: np.ndarray, epsilon: float = 0.01, window: float = 1.0) -> np.ndarray:
    """lcss of every x with every y, of one dimension, x the longer.

    Up to 64 points of y are the bits of a word, which a point of x changes at once (Hyyro
    2004: the zeros are the length so far). The rows that hold a point within epsilon
    of each of x's are told from all of x's values in order.
    """
    n, m = x.shape[1], y.shape[1]
    if window < 1 or m > 64 or not (np.isfinite(x).all() and np.isfinite(y).all() and epsilon >= 0):
        return np.array([lcss(np.broadcast_to(one, (len(y), n)), y, epsilon, window) for one in x]).reshape(len(x), len(y))
    # bits are y's points; for a row of y, the word of those near a value changes at 2 m values only
    order = np.argsort(x, axis=None, kind="stable")
    values, place = x.ravel()[order], np.empty(x.size, np.int64)
    place[order] = np.arange(x.size)
    place = np.ascontiguousarray(place.reshape(x.shape).T)  # (n, queries)
    low, high = _within(y, epsilon)
    start, stop = np.searchsorted(values, low.ravel(), "left").reshape(y.shape), np.searchsorted(values, high.ravel(), "right").reshape(y.shape)
    out, bit, ones = np.empty((len(x), len(y))), np.uint64(1) << np.arange(m, dtype=np.uint64), np.uint64(2**m - 1)
    together = max(1, ROOM // 8 // len(x))
    for r in range(0, len(y), together):
        some = range(r, min(r + together, len(y)))
        near = np.empty((n, len(some), len(x)), np.uint64)
        for g, j in enumerate(some):
            at = np.concatenate((start[j], stop[j]))
            by = np.argsort(at, kind="stable")
            words = np.bitwise_xor.accumulate(np.concatenate((np.zeros(1, np.uint64), np.concatenate((bit, bit))[by])))
            at = at[by]
            near[:, g] = np.repeat(words, np.diff(at, prepend=0, append=x.size))[place]
        v = np.full(near.shape[1:], ones)
        u, w = np.empty_like(v), np.empty_like(v)
        for i in range(n):
            np.bitwise_and(v, near[i], out=u)
            np.subtract(v, u, out=w)
            np.add(v, u, out=v)
            np.bitwise_or(v, w, out=v)
        out[:, some.start : some.stop] = 1 - (m - np.bitwise_count(v & ones).astype(int)).T / m
    return out


def _within(y: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """For each y the least and the largest x with |x - y| <= epsilon as floating point has it: found by halving, as the rounded difference never falls as x grows."""

    def last(sign: float) -> np.ndarray:
        good, bad = y.copy(), y + sign * (2 * epsilon + np.abs(y) * 1e-9 + 1e-300)
        while True:
            middle = good / 2 + bad / 2
            open_ = (middle != good) & (middle != bad)
            if not open_.any():
                return np.where(np.abs(bad - y) <= epsilon, bad, good)
            fits = np.abs(middle - y) <= epsilon
            good, bad = np.where(open_ & fits, middle, good), np.where(open_ & ~fits, middle, bad)

    return last(-1.0), last(1.0)


def _dtw_every(x: np.ndarray, y: np.ndarray, window: float = 1.0, dtype: type = float) -> np.ndarray:
    return _warped_every(x, y, window, None, dtype)


def _weighted_dtw_every(x: np.ndarray, y: np.ndarray, g: float = 0.05, window: float = 1.0, dtype: type = float) -> np.ndarray:
    n = x.shape[1]
    return _warped_every(x, y, window, 1 / (1 + np.exp(-g * (np.arange(n) - n / 2))), dtype)


dtw.every, weighted_dtw.every, twed.every, lcss.every = _dtw_every, _weighted_dtw_every, _twed_every, _lcss_every


def every(distance: Distance, x: np.ndarray, y: np.ndarray, most: int = 16_384) -> np.ndarray:
    """A distance of every x to every y as a matrix: by what the distance has for that (one dimension, no limit), else as batches of pairs, most at a time."""
    options = distance.keywords if isinstance(distance, partial) else {}
    x, y = np.asarray(x, float), np.asarray(y, float)
    if (whole := whole_of(distance, x, y)) is not None:
        return whole(x, y, **options) if x.shape[-1] >= y.shape[-1] else whole(y, x, **options).T
    out = np.empty(len(x) * len(y))
    for k in range(0, len(out), most):
        i, j = np.divmod(np.arange(k, min(k + most, len(out))), len(y))
        out[k : k + most] = np.asarray(distance(x[i], y[j]), float)
    return out.reshape(len(x), len(y))


def rough(distance: Distance, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]] | None:
    """Warping distances of every x to every y in single precision, and by how much such a matrix may be off; None where that is not known.

    Rounding moves each difference on a path of at most n + m cells by e at most, so the root of
    the path's sum by e times the root of their number; each sum and weight is rounded besides.
    Of several dimensions, costs are off by a share of both points' squares: of three times the lesser and twice the cost.
    """
    f, options = (distance.func, distance.keywords) if isinstance(distance, partial) else (distance, {})
    several = f is dtw and _plain(distance) and x.ndim == y.ndim == 3 and x.shape[1] == y.shape[1] > 1
    if f not in (dtw, weighted_dtw) or not several and whole_of(distance, x, y) is None or not x.size or not y.size:
        return None
    size = max(np.abs(x).max(), np.abs(y).max())
    if not size < 1e15:  # nor nan
        return None
    e, cells = size * 2.0**-21, x.shape[-1] + y.shape[-1]
    if several:
        d = _dtw_by_product(x, y, **options) if x.shape[2] >= y.shape[2] else _dtw_by_product(y, x, **options).T
        one, two = ((z * z).sum(1).max(1) for z in (x, y))
        share, least = (x.shape[1] + 4) * 2.0**-22, np.minimum(one[:, None], two[None, :])
        return d.astype(float), lambda z: z * (cells + 8) * 2.0**-21 + share * (2 * z + 3 * cells * least) + 1e-9
    d = every(partial(f, **options, dtype=np.float32), x, y).astype(float)
    return d, lambda z: z * (cells + 8) * 2.0**-21 + 2 * e * np.sqrt(cells * z) + cells * e * e + 1e-9


def _dtw_by_product(x: np.ndarray, y: np.ndarray, window: float = 1.0) -> np.ndarray:
    """dtw of every x with every y in single precision, x the longer: all costs of a series with a block by one matrix product."""
    (count, dims, n), (_, _, m) = x.shape, y.shape
    edges, out = _edges(n, m, window), np.empty((count, len(y)), np.float32)
    a = np.ascontiguousarray(np.concatenate((-2 * x, (x * x).sum(1, keepdims=True), np.ones((count, 1, n))), 1).transpose(0, 2, 1), np.float32)
    step = max(16, COSTS // (n * m))
    for s in range(0, len(y), step):
        rows = y[s : s + step]
        p = len(rows)
        b = np.concatenate((rows, np.ones((p, 1, m)), (rows * rows).sum(1, keepdims=True)), 1).transpose(1, 2, 0).astype(np.float32).reshape(dims + 2, m * p)
        costs, tables = np.empty((n, m * p), np.float32), [np.full((n + 2, p), np.inf, np.float32) for _ in range(3)]
        cell = costs.reshape(n * m, p)  # (i, j) stands at i m + j
        steps = [(hi + 1 - lo, cell[lo * m + k - lo : max(0, hi * m + k - hi + 1) : max(1, m - 1)], *views) for k, lo, hi, *views in _diagonals(tables, edges)]
        for i in range(count):
            np.matmul(a[i], b, out=costs)
            tables[0][0], tables[1][:2] = 0.0, np.inf
            for c, cost, d, u, l, cells, low, high in steps:  # noqa: E741
                low.fill(np.inf)
                high.fill(np.inf)
                if c > 0:
                    np.minimum(d, u, out=cells)
                    np.minimum(cells, l, out=cells)
                    np.add(cells, cost, out=cells)
            out[i, s : s + step] = tables[(n + m) % 3][n]
    return out


def straight(distance: Distance, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]] | None:
    """Upper bounds of msm or twed of every x to every y, the costs of the straight path, and a function of each x's limit that gives lower bounds of all that are within it; None where that is not known.

    A path d points off the diagonal has d steps aside and d back, of which each costs the least gap at least, but for
    twed's before the first points: a limit leaves a band. Within it steps aside count with their least cost, in single precision, its error allowed for.
    """
    f, options = (distance.func, distance.keywords) if isinstance(distance, partial) else (distance, {})
    n, flat = x.shape[-1], all(z.ndim == 2 or z.ndim == 3 and z.shape[1] == 1 for z in (x, y))
    if f not in (msm, twed) or not _plain(distance) or not flat or n != y.shape[-1] or not x.size or not y.size:
        return None
    nu = None if f is msm else options.get("nu", 1.0)
    gap, size = options.get("c", 1.0) if nu is None else nu + options.get("penalty", 1.0), max(np.abs(x).max(), np.abs(y).max())
    if not (size < 1e15 and 0 < gap < 1e15 and (nu is None or 0 <= nu < 1e15) and options.get("window", 1.0) >= 0):  # nor nan
        return None
    x, y = x.reshape(len(x), n), y.reshape(len(y), n)
    middle = (x.mean() + y.mean()) / 2  # only differences count: smaller numbers are rounded by less
    one, two = x - middle, y - middle
    e, share = max(np.abs(one).max(), np.abs(two).max()) * 2.0**-21 + size * 2.0**-48, (4 * n + 8) * 2.0**-21
    steps = tuple(np.zeros_like(z) if nu is None else np.diff(z, axis=1, prepend=0.0) ** 2 for z in (x, y))

    def off(z: np.ndarray, width: np.ndarray | int = 0) -> np.ndarray:
        by = 2 * n * e if nu is None else 2 * e * np.sqrt(4 * n * z) + 4 * n * e * e
        return (z + gap * width) * share + by + 1e-9

    def lower(limit: np.ndarray) -> np.ndarray:
        width = np.minimum((limit + 1e-9) * (1 + 1e-9) / (2 * gap if nu is None else gap), n).astype(int)
        return _in_band(one, two, steps, width, gap, nu) - off(limit, width)[:, None]

    high = _in_band(one, two, steps, np.zeros(len(x), int), gap, nu).astype(float)
    return high + off(high), lower


def _in_band(x: np.ndarray, y: np.ndarray, steps: tuple[np.ndarray, np.ndarray], widths: np.ndarray, gap: float, nu: float | None) -> np.ndarray:
    """Lower bounds of msm, with nu of twed, of every x to every y, of one length, on paths as far off the diagonal as x's width, in single precision.

    Cells go by rows, by how far j - i they are off; less gap times that a step aside to the left is free, one down costs it twice, and what x's step does besides.
    """
    n, r, out = x.shape[1], len(y), np.empty((len(x), len(y)), np.float32)
    deleted = [np.cumsum(z, 1).T[:, None, :, None] for z in steps]
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        together = max(1, BAND // ((2 * w + 1) * r))
        back = np.full((n + 2 * w, 1, r), np.inf, np.float32)  # none before the first point nor after the last
        back[w : w + n, 0] = y.T
        apart = None if nu is None or not w else (nu * abs(np.arange(-w, w + 1.0)))[:, None, None].astype(np.float32)
        for s in range(0, len(at), together):
            some = at[s : s + together]
            own, down = x[some].astype(np.float32).T[:, None, :, None], (2 * gap + steps[0][some]).astype(np.float32).T[:, None, :, None]
            cost, was, last, now = (np.full((2 * w + 1, len(some), r), np.inf, np.float32) for _ in range(4))
            if nu is not None:  # before the first row all of y is deleted, before the first column all of x, without gaps
                last[w], was[:] = 0.0, 0.0
                for k in range(1, w + 1):
                    last[w + k] = deleted[1][k - 1, :, :, 0] - k * gap
            for i in range(n):
                np.subtract(back[i : i + 2 * w + 1], own[i], out=cost)
                if nu is None:
                    np.abs(cost, out=cost)
                    np.add(last, cost, out=now)
                else:
                    np.multiply(cost, cost, out=cost)
                    if i <= w:
                        was[w - i] = 0.0  # of the first point of y
                    np.add(last, cost, out=now)
                    np.add(now, was, out=now)
                    if apart is not None:
                        np.add(now, apart, out=now)
                    cost, was = was, cost
                if nu is None and i == 0:
                    now[w:] = cost[w]
                elif w:
                    np.minimum(now[:-1], np.add(last[1:], down[i], out=cost[1:]), out=now[:-1])
                if nu is not None and i < w:
                    now[w - 1 - i] = deleted[0][i, 0, some] + (i + 1) * gap
                for k in range(1, 2 * w + 1):
                    np.minimum(now[k], now[k - 1], out=now[k])
                last, now = now, last
            out[some] = last[w]
    return out


def _plain(distance: Distance) -> bool:
    """Whether nothing is given to it but options other than a limit."""
    return not isinstance(distance, partial) or not distance.args and "limit" not in distance.keywords


def whole_of(distance: Distance, x: np.ndarray, y: np.ndarray) -> Callable[..., np.ndarray] | None:
    """A distance's own way from every x to every y, if it has one for these."""
    f = distance.func if isinstance(distance, partial) else distance
    flat = x.ndim == 2 or x.ndim == 3 and x.shape[1] == 1
    return _flat(f.every) if _plain(distance) and flat and x.shape[-1] and y.shape[-1] and hasattr(f, "every") else None


def _flat(whole: Callable[..., np.ndarray]) -> Callable[..., np.ndarray]:
    return lambda x, y, **options: whole(x.reshape(len(x), -1), y.reshape(len(y), -1), **options)


def derivative(x: np.ndarray) -> np.ndarray:
    """Along the last axis, ends copied; zeros for two points."""
    x = shaped(x)
    if x.shape[2] < 3:
        return np.zeros_like(x)
    inner = ((x[:, :, 1:-1] - x[:, :, :-2]) + (x[:, :, 2:] - x[:, :, :-2]) / 2) / 2
    return np.concatenate((inner[:, :, :1], inner, inner[:, :, -1:]), 2)


def derivative_dtw(a: np.ndarray, b: np.ndarray, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    return dtw(derivative(a), derivative(b), window, limit)


def weighted_derivative_dtw(a: np.ndarray, b: np.ndarray, g: float = 0.05, window: float = 1.0, limit: float | None = None) -> np.ndarray:
    return weighted_dtw(derivative(a), derivative(b), g, window, limit)


#: What is done to each series by itself, and the distance between such; see ``prepared``.
derivative_dtw.parts = derivative, dtw
weighted_derivative_dtw.parts = derivative, weighted_dtw


def prepared(distance: Distance) -> tuple[Callable[[np.ndarray], np.ndarray], Distance]:
    """A distance as something done once to each series, and a distance of the outcomes."""
    f, options = (distance.func, distance.keywords) if isinstance(distance, partial) else (distance, {})
    first, then = getattr(f, "parts", (lambda x: x, f))
    return first, partial(then, *(distance.args if isinstance(distance, partial) else ()), **options)


def piecewise_dtw(a: np.ndarray, b: np.ndarray, frames: int = 8, window: float = 1.0) -> np.ndarray:
    """dtw of frame means."""

    def means(x: np.ndarray) -> np.ndarray:
        x = shaped(x)
        n = x.shape[2]
        edges = np.arange(frames + 1) * n / frames
        cell = np.clip(np.minimum(np.arange(1, n + 1)[None, :], edges[1:, None]) - np.maximum(np.arange(n)[None, :], edges[:-1, None]), 0, None)
        return x @ cell.T / (n / frames)

    return dtw(means(a), means(b), window)


def independent(distance: Distance, a: np.ndarray, b: np.ndarray, **options) -> np.ndarray:
    """The sum over dimensions of a distance of each."""
    a, b = shaped(a), shaped(b)
    return sum(distance(a[:, d], b[:, d], **options) for d in range(a.shape[1]))


def complexity_invariant(a: np.ndarray, b: np.ndarray, distance: Distance = euclidean, **options) -> np.ndarray:
    """A distance times the ratio of the larger complexity to the smaller: the root of the sum of squared steps."""
    size = lambda x: np.sqrt((np.diff(shaped(x), axis=2) ** 2).sum((1, 2)))
    x, y = size(a), size(b)
    least = np.minimum(x, y)
    return distance(a, b, **options) * np.where(least > 0, np.maximum(x, y) / np.where(least > 0, least, 1), np.where(np.maximum(x, y) > 0, np.inf, 1.0))


def lb_kim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest squared difference of the first points, the last, the minima and the maxima: never above dtw."""
    a, b = shaped(a)[:, 0], shaped(b)[:, 0]
    return np.maximum.reduce([(a[:, 0] - b[:, 0]) ** 2, (a[:, -1] - b[:, -1]) ** 2, (a.min(1) - b.min(1)) ** 2, (a.max(1) - b.max(1)) ** 2])


def envelope(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Maxima and minima of each point's neighbours within a radius."""
    n = x.shape[-1]
    wide = lambda fill: np.pad(x, [(0, 0)] * (x.ndim - 1) + [(radius, radius)], constant_values=fill)
    slide = lambda y: np.lib.stride_tricks.sliding_window_view(y, 2 * radius + 1, -1)[..., :n, :]
    return slide(wide(-np.inf)).max(-1), slide(wide(np.inf)).min(-1)


def _excess(x: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.where(x > hi, x - hi, np.where(x < lo, lo - x, 0.0))


def lb_keogh(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Squared distance of b to a's envelope."""
    a, b = shaped(a)[:, 0], shaped(b)[:, 0]
    return (_excess(b, *envelope(a, radius)) ** 2).sum(1)


def lb_improved(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """lb_keogh, and the distance of a to the envelope of b drawn into a's."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    hi, lo = envelope(x, radius)
    drawn = np.clip(y, lo, hi)
    return (_excess(y, hi, lo) ** 2).sum(1) + (_excess(x, *envelope(drawn, radius)) ** 2).sum(1)


def lb_enhanced(a: np.ndarray, b: np.ndarray, radius: int, bands: int = 4) -> np.ndarray:
    """The least costs of the first and last left and right bands, and lb_keogh between them."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    n = x.shape[1]
    bands = min(bands, n // 2)
    total = (x[:, 0] - y[:, 0]) ** 2 + ((x[:, -1] - y[:, -1]) ** 2 if n > 1 else 0.0)
    for i in range(1, bands):
        j = np.arange(max(0, i - radius), i + 1)
        total = total + np.minimum(((x[:, [i]] - y[:, j]) ** 2).min(1), ((x[:, j] - y[:, [i]]) ** 2).min(1))
        k, j = n - 1 - i, n - 1 - j
        total = total + np.minimum(((x[:, [k]] - y[:, j]) ** 2).min(1), ((x[:, j] - y[:, [k]]) ** 2).min(1))
    inner = slice(bands, n - bands)
    return total + (_excess(y, *envelope(x, radius))[:, inner] ** 2).sum(1) if n > 2 * bands else total


def lb_yi(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared excess of b over a's largest, and under its least, value."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    return (_excess(y, x.max(1, keepdims=True), x.min(1, keepdims=True)) ** 2).sum(1)


def lb_lcss(a: np.ndarray, b: np.ndarray, radius: int, epsilon: float = 0.01) -> np.ndarray:
    """One less the share of b's points within epsilon of a's envelope."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    hi, lo = envelope(x, radius)
    return 1 - ((y <= hi + epsilon) & (y >= lo - epsilon)).sum(1) / min(x.shape[1], y.shape[1])


def lb_wdtw(a: np.ndarray, b: np.ndarray, g: float = 0.05) -> np.ndarray:
    """lb_yi weighted by the least weight."""
    n = max(shaped(a).shape[2], shaped(b).shape[2])
    return lb_yi(a, b) / (1 + math.exp(g * n / 2))


def lb_erp(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared difference of the sums, over the longer length: what gaps at 0 cannot make up for."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    return np.abs(x.sum(1) - y.sum(1)) ** 2 / max(x.shape[1], y.shape[1])


def lb_msm(a: np.ndarray, b: np.ndarray, c: float = 1.0) -> np.ndarray:
    """The first pair moves, every later point of b beyond a's range costs the excess or c, whichever is less."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    over = _excess(y[:, 1:], x.max(1, keepdims=True), x.min(1, keepdims=True))
    return np.abs(x[:, 0] - y[:, 0]) + np.minimum(over, c).sum(1)


def lb_twed(a: np.ndarray, b: np.ndarray, nu: float = 1.0, penalty: float = 1.0) -> np.ndarray:
    """The first pair at its cheapest, every later point of b beyond a's range its squared excess or a deletion, whichever is less."""
    x, y = shaped(a)[:, 0], shaped(b)[:, 0]
    over = _excess(y[:, 1:], np.maximum(x.max(1, keepdims=True), 0), np.minimum(x.min(1, keepdims=True), 0)) ** 2
    first = np.minimum.reduce([(x[:, 0] - y[:, 0]) ** 2, x[:, 0] ** 2 + nu + penalty, y[:, 0] ** 2 + nu + penalty])
    return first + np.minimum(over, nu + penalty).sum(1)


#: Distances by name, at their defaults.
DISTANCES: dict[str, Distance] = {
    "ed": euclidean, "dtw": dtw, "wdtw": weighted_dtw, "ddtw": derivative_dtw, "wddtw": weighted_derivative_dtw,
    "erp": erp, "lcss": lcss, "msm": msm, "twed": twed, "pdtw": piecewise_dtw, "cid": complexity_invariant,
}
