"""Distances between series, and nearest neighbours by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import elastic
from corvane.operators.series import total


def squared_euclidean(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def lb_keogh(query: Column, candidate: Column, radius: int) -> Column:
    """Squared distance of the candidate to the query's envelope."""
    n = F.size(query)

    def gap(c: Column, i: Column) -> Column:
        first = F.greatest(i - radius, F.lit(0)) + 1
        around = F.slice(query, first, F.least(i + radius + 1, n) - first + 1)
        hi, lo = F.array_max(around), F.array_min(around)
        return F.when(c > hi, (hi - c) * (hi - c)).when(c < lo, (lo - c) * (lo - c)).otherwise(0.0)

    return total(F.transform(candidate, gap))


def _one(distance: Callable[..., np.ndarray]) -> Callable[..., float]:
    return lambda a, b, *more, **options: float(distance(a, b, *more, **options)[0])


#: One pair, and a batch of pairs (rows of a with the same rows of b), of the distances in ``elastic``.
dtw, erp, lcss = _one(elastic.dtw), _one(elastic.erp), _one(elastic.lcss)
dtw_many, erp_many, lcss_many = elastic.dtw, elastic.erp, elastic.lcss

BLOCK = "ids binary, width int, data binary"


def blocks(df: DataFrame, rows: int = 1024) -> DataFrame:
    """Rows (id, s) as blocks of up to rows series of one length, as bytes; made within a batch, without a shuffle. Null ids and series, and series with nulls, are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[int, tuple[list, list]] = {}
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i is not None and s is not None and None not in s:
                    ids, data = by.setdefault(len(s), ([], []))
                    ids.append(i)
                    data.append(s)
            out = [(np.array(ids[k : k + rows], "<i8").tobytes(), n, np.array(data[k : k + rows], "<f8").tobytes()) for n, (ids, data) in by.items() for k in range(0, len(ids), rows)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.binary()), strict=True)], ["ids", "width", "data"])

    return df.select("id", "s").mapInArrow(each, BLOCK)


def _unpacked(ids: bytes, width: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    return i, np.frombuffer(data, "<f8").reshape(len(i), width)


def block_pairs(queries: DataFrame, rows: DataFrame, f: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterable[pa.RecordBatch]], schema: str, size: int = 1024, each_core: int = 8) -> DataFrame:
    """f(query ids, queries, row ids, rows) of every block of queries with every block of rows.

    Blocks of rows are dealt in turn to keys, some for each core (as many as blocks at
    most); each block of queries is sent to every key. So a task holds two blocks
    at a time, and the exchange moves the queries as often as there are keys.
    """
    keys = max(1, min(-(-rows.count() // size), each_core * rows.sparkSession.sparkContext.defaultParallelism))
    turn = F.spark_partition_id() + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    c = blocks(rows, size).select(F.pmod(turn, F.lit(keys)).alias("key"), F.col("ids").alias("c_ids"), F.col("width").alias("c_width"), F.col("data").alias("c_data"))
    q = blocks(queries, size).withColumn("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(keys - 1).cast("long"))))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                yield from f(*_unpacked(*r[:3]), *_unpacked(*r[3:]))

    # few bytes are much work here: by number, so that adaptive execution doesn't merge the parts; twice as many, as keys fall on the same one
    q, c = (d.repartition(2 * keys, "key") for d in (q, c))
    return q.join(c.hint("shuffle_hash"), "key").select("ids", "width", "data", "c_ids", "c_width", "c_data").mapInArrow(each, schema)


def between(queries: DataFrame, rows: DataFrame, distance: Callable[[np.ndarray, np.ndarray], np.ndarray], block: int = 512, most: int = 16_384) -> DataFrame:
    """(a_id, b_id, distance) from each of queries (id, s) to each of rows (id, s) with another id, block by block; distance is one of ``elastic``'s."""
    first, then = elastic.prepared(distance)

    def each(qi, x, ci, y):
        d = elastic.every(then, first(x), first(y), most)
        at, to = np.nonzero(qi[:, None] != ci[None, :])
        for k in range(0, len(at), most):
            i, j = at[k : k + most], to[k : k + most]
            yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ci[j]), pa.array(d[i, j])], ["a_id", "b_id", "distance"])

    return block_pairs(queries, rows, each, "a_id long, b_id long, distance double", block)


def rough_squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distances of all rows of x to all rows of y by one matrix product, and for each row of x how far they may be off."""
    nx, ny = (x * x).sum(1), (y * y).sum(1)
    rough = x @ y.T
    rough *= -2
    rough += nx[:, None]
    rough += ny[None, :]
    return rough, 1e-9 + 1e-11 * (nx + ny.max(initial=0.0))


def within_radius(rows: DataFrame, radius: float, count: bool = False, block: int = 2048) -> DataFrame:
    """(a, b) of rows (id, s) with another id and a squared Euclidean distance of radius at most; with count, (a, n) for each block of rows instead.

    A matrix product settles nearly all pairs; those near the radius are measured exactly. Rows of another length are not near.
    """

    def each(qi, x, ci, y):
        if x.shape[1] != y.shape[1]:
            return
        rough, off = rough_squares(x, y)
        near = rough <= radius + off[:, None]
        near &= qi[:, None] != ci[None, :]
        at, to = np.nonzero(near & (rough >= radius - off[:, None]))
        near[at, to] = ((x[at] - y[to]) ** 2).sum(1) <= radius
        if count:
            n = near.sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(qi[n > 0]), pa.array(n[n > 0])], ["a", "n"])
            return
        at, to = np.nonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ci[to])], ["a", "b"])

    return block_pairs(rows, rows, each, "a long, n long" if count else "a long, b long", block, 3)


def _kth(d: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k-th least, or the largest of fewer."""
    least = min(k, d.shape[1]) - 1
    return np.partition(d, least, axis=1)[:, least]


def _measured(distance: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, y: np.ndarray, most: int, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(np.asarray(distance(x[row[i : i + most]], y[col[i : i + most]]), float) for i in range(0, len(row), most))])


def may_be_nearest(high: np.ndarray, lower: Callable[[np.ndarray], np.ndarray], own: np.ndarray, k: int, measured: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of all pairs, but own ones, that may be among their row's k nearest, by what ``elastic.straight`` gives; where these are many, by those measured whose lower bounds are least."""
    far = _kth(np.where(own, np.inf, high), k)
    low = np.where(own, np.inf, lower(far))
    if np.count_nonzero(low <= far[:, None]) > 4 * k * len(low):
        col = np.argpartition(low, min(k, low.shape[1]) - 1, axis=1)[:, :k]
        row = np.repeat(np.arange(len(low)), col.shape[1])
        far = np.minimum(far, np.where(own[row, col.ravel()], np.inf, measured(row, col.ravel())).reshape(col.shape).max(1))
    return np.nonzero(~own & (low <= far[:, None]))


def nearest(queries: DataFrame, rows: DataFrame, k: int = 1, block: int = 1024, distance: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, most: int = 16_384) -> DataFrame:
    """(q, c, distance, rank): the k nearest of rows (id, s) for each of queries (id, s), ties to the smaller id; not itself.

    By default the squared Euclidean distance: a pair of blocks is one matrix
    product, which rules out all but a few rows a query; these are measured exactly.
    Any other distance is measured for all pairs; warping distances in single precision,
    and again in full for those that may be among the nearest; msm and twed in full for
    those that a band about the diagonal leaves. Distances count to nine decimals.
    Rows of another length are no neighbours under the default.
    """

    def told(qi, ci, row, col, d):
        d = np.round(d, 9)
        order = np.lexsort((ci[col], d, row))
        row, col, d = row[order], col[order], d[order]
        first = np.searchsorted(row, row)
        keep = (np.arange(len(row)) - first < k) & np.isfinite(d)
        return pa.RecordBatch.from_arrays([pa.array(qi[row[keep]]), pa.array(ci[col[keep]]), pa.array(d[keep])], ["q", "c", "distance"])

    def euclidean(qi, x, ci, y):
        if x.shape[1] != y.shape[1]:
            return
        rough, off = rough_squares(x, y)
        rough[qi[:, None] == ci[None, :]] = np.inf
        far = np.partition(rough, min(k, len(ci)) - 1, axis=1)[:, min(k, len(ci)) - 1]
        row, col = np.nonzero(rough <= (far + 2 * off)[:, None])
        good = qi[row] != ci[col]
        row, col = row[good], col[good]
        yield told(qi, ci, row, col, ((x[row] - y[col]) ** 2).sum(1))

    first, then = elastic.prepared(distance) if distance else (None, None)

    def other(qi, x, ci, y):
        x, y = first(x), first(y)
        own = qi[:, None] == ci[None, :]
        measured = partial(_measured, then, x, y, most)
        if known := elastic.straight(then, x, y):
            row, col = may_be_nearest(*known, own, k, measured)
            yield told(qi, ci, row, col, measured(row, col))
            return
        single = elastic.rough(then, x, y)
        d, off = single or (np.round(elastic.every(then, x, y, most), 9), np.zeros_like)
        none = own | ~np.isfinite(d)
        least = np.where(none, 0.0, d)
        by = off(least)
        far = _kth(np.where(none, np.inf, least + by), k)
        row, col = np.nonzero(~none & (least - by <= far[:, None]))
        yield told(qi, ci, row, col, d[row, col] if single is None else measured(row, col))

    hits = block_pairs(queries, rows, euclidean if distance is None else other, "q long, c long, distance double", block if distance is None else min(block, 512))
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "c"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)
