"""Exact top-k inner products by M-trees, best-first.

Vectors of a shard get one more coordinate that makes their lengths equal, so the
largest inner products are the smallest distances, and a metric index serves. The
tree is a table of pages: each has a routing vector, a covering radius and its
distance to the routing vector of its parent; a leaf also stores the distance of
each vector to its routing vector. A block of queries goes down together. Each
query visits its leaves by their lower bounds; those that come to the same leaf in
the same round are computed at once. Before a distance is computed, the triangle
inequality over the stored distances decides whether it is needed.

Shards hold about ``SHARD`` vectors and query blocks ``BLOCK`` queries; each pair of
them is a row of its own, so no task's memory grows with the tables. Equal vectors
of a shard are one entry with their k + 1 smallest ids, which are all that can
appear in a result of k.

Defined cases: rows with a null id or vector, or a null or non-finite component,
take no part; vectors meet only vectors of their own length; rows with the
query's id count as its own; repeated query rows each get their results, repeated
candidates are ranked each; ties go to the smaller id; fewer than k candidates
are all returned; an empty table gives an empty result. Scores beyond a long are
an error. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import written

SHARD = 8192
BLOCK = 1024
PAGE = 128
FAN = 24
HITS = "row long, query_id long, vec_id long, score long"


class MTree:
    """Pages as arrays: routing vector, radius, parent, distance to the parent's, first and last entry; entries in page order."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], seed: int = 0):
        self.rng = np.random.default_rng(seed)
        exact = vectors.astype(np.float64)
        norms = (exact * exact).sum(1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.whole = exact
        self.points = np.concatenate((exact, np.sqrt(np.maximum(self.top - norms, 0))[:, None]), 1)
        self.pages: list[tuple] = []
        self.order: list[np.ndarray] = []
        self.placed = 0
        if len(vectors):
            self._grow(np.arange(len(vectors)), -1, 0)
        order = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        self.vectors, self.points, self.ids = vectors[order], self.points[order], [ids[i] for i in order]
        self.whole = self.whole[order]
        self.place = np.argsort(np.argsort(np.array([x[0] for x in self.ids]), kind="stable"))  # entries by smallest id
        self.entry = np.argsort(self.place)
        self.routing = np.array([p[0] for p in self.pages])
        self.radius, self.parent, self.to_parent, self.first, self.last = (np.array([p[k] for p in self.pages]) for k in range(1, 6))
        self.to_route = np.concatenate([p[6] for p in self.pages if p[6] is not None]) if self.pages else np.zeros(0)

    def _distances(self, at: np.ndarray, route: np.ndarray) -> np.ndarray:
        gap = self.points[at] - route
        return np.sqrt((gap * gap).sum(1))

    def _grow(self, at: np.ndarray, parent: int, depth: int) -> None:
        center = self.points[at].mean(0)
        route = self.points[at[np.argmin(self._distances(at, center))]]
        away = self._distances(at, route)
        up = float(np.sqrt(((route - self.pages[parent][0]) ** 2).sum())) if parent >= 0 else 0.0
        number = len(self.pages)
        if len(at) <= PAGE:
            self.pages.append((route, float(away.max()), parent, up, self.placed, self.placed + len(at), away))
            self.order.append(at)
            self.placed += len(at)
            return
        self.pages.append((route, float(away.max()), parent, up, -1, -1, None))
        seeds = self.points[self.rng.choice(at, min(FAN, -(-len(at) // PAGE)), replace=False)]
        near = np.argmin((seeds * seeds).sum(1) - 2 * self.points[at] @ seeds.T, 1)
        if depth > 20 or np.bincount(near).max() > 0.9 * len(at):  # no clusters to be found: even parts by distance
            near[np.argsort(away, kind="stable")] = np.arange(len(at)) * len(seeds) // len(at)
        for k in range(len(seeds)):
            if (near == k).any():
                self._grow(at[near == k], number, depth + 1)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, scores, ids): the k best of each query, without the rows of its own id."""
        self.computed = 0
        m, n = len(queries), len(self.pages)
        if not n or not m:
            return
        exact = queries.astype(np.float64)
        points = np.concatenate((exact, np.zeros((m, 1))), 1)
        length = (points * points).sum(1)
        slack = 1e-6 * (1 + np.sqrt(length + self.top))
        worst = np.full(m, np.inf)  # distance of the (k + 1)-th best so far
        total = max(1, len(self.vectors))
        most = float(np.abs(exact).max(initial=0)) * float(np.abs(self.whole).max(initial=0)) * max(1, exact.shape[1])
        # score and smallest id as one number, beyond 64 bits if need be: larger is better
        number, least = (np.int64, -(2**62)) if most * total < 2**52 else (object, -(2**200))
        best = np.full((m, k + 1), least, number)
        away = np.full((m, n), np.nan)
        routes = (self.routing * self.routing).sum(1)
        done = np.zeros((m, n), bool)

        def route(rows: np.ndarray, page: int) -> None:
            self.computed += len(rows)
            away[rows, page] = np.sqrt(np.maximum(length[rows] + routes[page] - 2 * points[rows] @ self.routing[page], 0))

        def visit(rows: np.ndarray, page: int) -> None:
            done[rows, page] = True
            a, b = self.first[page], self.last[page]
            need = np.abs(away[rows, page][:, None] - self.to_route[None, a:b]) <= (worst[rows] + slack[rows])[:, None]
            columns = np.flatnonzero(need.any(0))
            if not len(columns):
                return
            self.computed += len(rows) * len(columns)
            if number is object:
                found = queries[rows].astype(object) @ self.vectors[a + columns].T.astype(object)
            else:
                found = (exact[rows] @ self.whole[a + columns].T).astype(np.int64)
            found = found * total + (total - 1 - self.place[a + columns])
            better = (found > best[rows, 0][:, None]).any(1)
            rows, found = rows[better], found[better]
            if len(rows):
                both = np.concatenate((best[rows], found), 1)
                both = both if number is object else np.partition(both, -k - 1, 1)[:, -k - 1 :]
                best[rows] = np.sort(both, 1)[:, -k - 1 :]  # the least comes first
                low = best[rows, 0]
                full = low != least
                score = (low // total).astype(np.float64)
                worst[rows] = np.where(full, np.sqrt(np.maximum(length[rows] + self.top - 2 * score, 0)), np.inf)

        every = np.arange(m)
        route(every, 0)
        children = [np.flatnonzero(self.parent == p) for p in range(n)]
        leaf = self.first >= 0
        # first the nearest path of each query, for a bound
        here = np.zeros(m, np.int64)
        while not leaf[here].all():
            for page in np.unique(here[~leaf[here]]):
                rows = np.flatnonzero(here == page)
                for c in children[page]:
                    route(rows, c)
                here[rows] = children[page][np.argmin(away[np.ix_(rows, children[page])], 1)]
        for page in np.unique(here):
            visit(np.flatnonzero(here == page), page)
        # then the pages that stored and computed distances do not rule out, parents before children
        open_ = np.zeros((m, n), bool)
        open_[:, 0] = away[:, 0] - self.radius[0] <= worst + slack
        for page in range(1, n):
            up = self.parent[page]
            maybe = open_[:, up] & (np.abs(away[:, up] - self.to_parent[page]) - self.radius[page] <= worst + slack)
            if len(rows := np.flatnonzero(maybe & np.isnan(away[:, page]))):
                route(rows, page)
            open_[:, page] = maybe & (away[:, page] - self.radius[page] <= worst + slack)
        leaves = np.flatnonzero(leaf)
        bound = np.where(open_[:, leaves] & ~done[:, leaves], away[:, leaves] - self.radius[leaves], np.inf)
        order = np.argsort(bound, 1, kind="stable")
        for step in range(len(leaves)):
            at = order[:, step]
            next_ = bound[every, at]
            active = np.flatnonzero(np.isfinite(next_) & (next_ <= worst + slack))
            if not len(active):
                break
            by = active[np.argsort(at[active], kind="stable")]
            for rows in np.split(by, np.flatnonzero(np.diff(at[by])) + 1):
                visit(rows, leaves[at[rows[0]]])
        for q in range(m):
            keys = best[q][best[q] != least][::-1]
            entries = self.entry[(total - 1 - keys % total).astype(np.int64)]
            ids = np.concatenate([self.ids[x] for x in entries]) if len(entries) else np.zeros(0, np.int64)
            scores = np.repeat((keys // total).astype(np.int64), [len(self.ids[x]) for x in entries])
            keep = ids != own[q]
            scores, ids = scores[keep], ids[keep]
            order = np.lexsort((ids, -scores))[:k]
            yield q, scores[order], ids[order]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(flat), -1)


def _tree(vectors: np.ndarray, ids: np.ndarray, k: int) -> MTree:
    """Equal vectors become one entry with its k + 1 smallest ids."""
    order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
    vectors, ids = vectors[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(1))))
    return MTree(vectors[first], [x[: k + 1] for x in np.split(ids, first[1:])])


def top_inner_products(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", scale: int = 64, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k largest inner products of floor(scale * x) with all other rows."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    clean = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"), is_query.alias("query"), F.size(vector).alias("dim")
    )
    clean = written(clean, "vectors")
    sizes = clean.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"), F.ceil(F.sum(F.col("query").cast("long")) / block).alias("blocks"))
    dealt = clean.join(sizes, "dim")

    def fold(table: pa.Table) -> pa.Table:
        """The rows of a shard or block as one row of arrays."""
        table = table.sort_by("row")
        return pa.table({
            "dim": [table["dim"][0].as_py()], "at": [table["at"][0].as_py()], "most": [table["most"][0].as_py()], "n": [len(table)], "row": [table["row"].to_numpy().tobytes()],
            "ids": [table["vec_id"].to_numpy().tobytes()], "v": [_matrix(table["v"]).tobytes()],
        }).cast(pa.schema([("dim", pa.int32()), ("at", pa.int64()), ("most", pa.int64()), ("n", pa.int64()), ("row", pa.binary()), ("ids", pa.binary()), ("v", pa.binary())]))

    folded = "dim int, at long, most long, n long, row binary, ids binary, v binary"
    spread = lambda n: F.pmod(F.xxhash64("vec_id", "row"), n)
    columns = ("dim", "row", "vec_id", "v")
    shards = dealt.select(*columns, spread(F.col("shards")).alias("at"), F.col("shards").alias("most")).groupBy("dim", "at").applyInArrow(fold, folded)
    blocks = dealt.where("query").select(*columns, spread(F.col("blocks")).alias("at"), F.col("shards").alias("most")).groupBy("dim", "at").applyInArrow(fold, folded)
    shards, blocks = written(shards, "mtree-shards"), written(blocks, "mtree-queries")
    asked = blocks.select("dim", F.col("n").alias("qn"), F.col("row").alias("qrow"), F.col("ids").alias("qids"), F.col("v").alias("qv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("most") - 1)).alias("at"))
    # both sides are dealt by shard: neither is broadcast, whatever its size
    pairs = shards.hint("merge").join(asked, ["dim", "at"]).select("dim", "at", "n", "ids", "v", "qn", "qrow", "qids", "qv")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for b in batches:
            for r in range(b.num_rows):
                dim, at, n, ids, v, qn, qrow, qids, qv = (b.column(c)[r].as_py() for c in range(9))
                if (dim, at) != last:
                    tree, last = _tree(np.frombuffer(v, np.int64).reshape(n, dim), np.frombuffer(ids, np.int64), k), (dim, at)
                qrow, qids = np.frombuffer(qrow, np.int64), np.frombuffer(qids, np.int64)
                out: list[list] = [[], [], [], []]
                for q, scores, found in tree.search(np.frombuffer(qv, np.int64).reshape(qn, dim), qids, k):
                    for column, x in zip(out, (np.full(len(found), qrow[q]), np.full(len(found), qids[q]), found, scores), strict=True):
                        column.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["row", "query_id", "vec_id", "score"])

    hits = pairs.mapInArrow(search, HITS)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] for a in list_transform(range(1, len(q.e) + 1), lambda i: [q.e[i], c.e[i]])]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20
"""
