"""Search of a stated query set against all vectors, block by block.

Candidates form strips and queries blocks, both of bounded size. A strip is made
ready for search (quantised, or grown into trees) once, whatever number of blocks
will meet it. Each block first meets one strip; its queries' k-th scores there go
with them to all other strips, which then return only what can still be among the
best. A last step ranks, per query.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskloom.llm.util import materialise, session

#: Queries in a block; bytes of a strip's vectors, and of a block's, at most.
QUERIES, BYTES = 16384, 16 << 20


def usable(vector: Column) -> Column:
    """Not null or empty, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = table.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().reshape(len(lists), -1)


def search(rows: DataFrame, is_query: Column, k: int, strip: int, ready: Callable, best: Callable, score: str, block: int = QUERIES) -> DataFrame:
    """``rows``: vec_id (not null), v. ``ready(ids, vectors)`` makes a strip ready;
    ``best(strip, query_ids, queries, bounds, k)`` gives (query index, vec_id, score)
    arrays, at most k a query, and needs to give none scored under the query's bound
    (NaN: none known). Vectors meet those of their own length only. Rows of a query's
    vec_id are its own. Returns query_id, rank, vec_id, score."""
    session(rows)
    rows = materialise(rows.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row")), "vectors")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"))
    most = lambda n: F.greatest(F.lit(1), F.least(F.lit(n), F.floor(F.lit(BYTES) / 8 / F.col("dim"))))
    many = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / most(size))).cast("long")
    # one row a vector length; Spark broadcasts it when small
    sized = rows.join(sizes.select("dim", many("q", block).alias("blocks"), many("n", strip).alias("strips")), "dim")
    # rows are dealt out by a hash of their number, so repeats of an id spread
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "row"), n)

    def grow(part: pa.Table) -> pa.Table:
        data = pickle.dumps(ready(part.column("vec_id").to_numpy(), matrix(part, "v")), 5)
        return pa.table([part.column("dim")[:1], part.column("blocks")[:1], part.column("strip")[:1], pa.array([data], pa.binary())], ["dim", "blocks", "strip", "ready"])

    strips = sized.select("dim", "blocks", dealt(2, "strips").alias("strip"), "vec_id", "v").groupBy("dim", "strip")
    strips = materialise(strips.applyInArrow(grow, "dim int, blocks long, strip long, ready binary"), "strips")
    queries = sized.where(is_query).select("dim", "strips", dealt(1, "blocks").alias("block"), "row", "vec_id", "v")
    first = F.pmod(F.xxhash64(F.lit(3), "dim", "block"), F.col("strips"))
    queries = queries.withColumn("first", first)
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    every = strips.select("dim", "strip", F.explode(numbers("blocks")).alias("block"), "ready")
    kind = pa.int64() if score == "long" else pa.float64()

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["row", "query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), kind)], names)
        q_ids = left.column("q_id").to_numpy()
        bounds = left.column("bound").to_numpy(zero_copy_only=False)
        at, ids, got = best(pickle.loads(right.column("ready")[0].as_py()), q_ids, matrix(left, "q_v"), bounds, k)
        return pa.Table.from_arrays([pa.array(left.column("row").to_numpy()[at]), pa.array(q_ids[at]), pa.array(ids, pa.int64()), pa.array(got, kind)], names)

    def meet(queries: DataFrame, strips: DataFrame) -> DataFrame:
        left = queries.toDF("q_dim", "q_block", "q_strip", "row", "q_id", "q_v", "bound")
        tasks = left.groupBy("q_dim", "q_block", "q_strip").cogroup(strips.groupBy("dim", "block", "strip"))
        return tasks.applyInArrow(tile, f"row long, query_id long, vec_id long, score {score}")

    none = F.lit(None).cast(score)
    opened = queries.select("dim", "block", F.col("first").alias("strip")).distinct()
    here = every.join(opened, ["dim", "block", "strip"], "left_semi")
    begun = meet(queries.select("dim", "block", "first", "row", "vec_id", "v", none.alias("bound")), here)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    if strips.where("strip > 0").isEmpty():  # all have met all
        return begun.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    begun = materialise(begun, "begun")
    bounds = begun.groupBy("row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("bound"))
    rest = queries.join(bounds, "row", "left")
    rest = rest.withColumn("strip", F.explode(F.filter(numbers("strips"), lambda i: i != F.col("first"))))
    rest = rest.select("dim", "block", "strip", "row", "vec_id", "v", "bound")
    found = begun.unionByName(meet(rest, every.join(opened, ["dim", "block", "strip"], "left_anti")))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def cut(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query: highest score, then smallest id; in that order."""
    order = np.lexsort((ids, -score, at))
    at, ids, score = at[order], ids[order], score[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], ids[keep], score[keep]


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, components added from first to last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


# --- int8 block matrix join -------------------------------------------------

TILE = 256, 4096


def _int8(x: np.ndarray):
    """Codes, scale a row, norm of what codes stand for, norm of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.linalg.norm(stands, axis=1), np.linalg.norm(x - stands, axis=1)


def quantised(ids: np.ndarray, vectors: np.ndarray) -> tuple:
    c = vectors.astype(np.float64)
    codes, scale, _, miss = _int8(c)
    return ids, c, codes, scale, miss, np.linalg.norm(c, axis=1)


def best_inner_products(strip, query_ids, queries, bounds, k):
    """A tile of int8 products bounds every inner product: it is off by at most
    |q'| |c - c'| + |q - q'| |c|, q' and c' being what the codes stand for. Pairs
    whose upper bound reaches the query's k-th best (of lower bounds here, of
    scores before) are computed again in double precision and merged by heaps."""
    ids, c, c8, c_scale, c_miss, c_norm = strip
    q = queries.astype(np.float64)
    q8, q_scale, q_norm, q_miss = _int8(q)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # sums of codes are whole in it
    heaps = [[] for _ in range(len(q))]  # of (-score, id), best first
    before = np.where(np.isnan(bounds), -np.inf, bounds)
    for a in range(0, len(q), TILE[0]):
        for b in range(0, len(c), TILE[1]):
            i, j = slice(a, a + TILE[0]), slice(b, b + TILE[1])
            near = (q8[i].astype(exact) @ c8[j].astype(exact).T).astype(np.float64) * np.outer(q_scale[i], c_scale[j])
            off = np.outer(q_norm[i], c_miss[j]) + np.outer(q_miss[i], c_norm[j])
            off += 1e-9 * (1 + np.abs(near))
            own = query_ids[i][:, None] == ids[j][None, :]
            low = np.where(own, -np.inf, near - off)
            bound = np.array([-h[-1][0] if len(h) == k else -np.inf for h in heaps[i]])
            bound = np.maximum(bound, before[i])
            if low.shape[1] >= k:
                bound = np.maximum(bound, np.partition(low, -k, axis=1)[:, -k])
            at, to = np.nonzero((near + off >= bound[:, None]) & ~own)
            at, to = at + a, to + b
            at, got, score = cut(at, ids[to], inner(q[at], c[to]), k)
            ends = np.searchsorted(at, np.arange(a, min(a + TILE[0], len(q)) + 1))
            for n, (x, y) in enumerate(zip(ends, ends[1:])):
                if x < y:
                    new = zip((-score[x:y]).tolist(), got[x:y].tolist())
                    heaps[a + n] = [p for _, p in zip(range(k), heapq.merge(heaps[a + n], new))]
    at = np.repeat(np.arange(len(q)), [len(h) for h in heaps])
    flat = [p for h in heaps for p in h]
    ids, score = np.array([p[1] for p in flat], np.int64), np.array([-p[0] for p in flat], np.float64)
    keep = score >= before[at] if len(at) else slice(None)
    return at[keep], ids[keep], score[keep]


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, strip: int = 8192, block: int = QUERIES) -> DataFrame:
    """For each vec_id divisible by ``every`` the ``k`` largest inner products:
    query_id, rank, vec_id, score. Exact: recall is 1.

    Rows whose vector is null, zero, empty or holds a null or non-finite
    component, or whose vec_id is null, take no part. Ties go to the smaller
    vec_id. With fewer candidates, all. An empty table gives no rows."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).where(F.exists("v", lambda x: x != 0))
    return search(rows, F.col("vec_id") % every == 0, k, strip, quantised, best_inner_products, "double", block)


# --- KD-trees ---------------------------------------------------------------

SHARD, LEAF = 4096, 64


class KdTree:
    """Median splits of the widest dimension; each node has its tight box and
    smallest id; leaves are slices of ``order``. Components are integers."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.ids, self.order = ids, np.arange(len(ids))
        self.largest = int(max(-int(vectors.min()), int(vectors.max()))) if vectors.size else 0
        self.whole, self.vectors = vectors, vectors.astype(np.float64)
        self.least, self.spans, self.below = [], [], []
        low, high, todo = [], [], [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            rows = self.order[a:b]
            points = self.vectors[rows]
            low.append(points.min(axis=0))
            high.append(points.max(axis=0))
            me = len(self.spans)
            self.least.append(int(ids[rows].min()))
            self.spans.append((a, b))
            self.below.append([])
            if parent is not None:
                self.below[parent].append(me)
            wide = np.argmax(high[me] - low[me])
            if b - a > leaf and high[me][wide] > low[me][wide]:
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(points[:, wide], half)]
                todo += [(a, a + half, me), (a + half, b, me)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product any point of each node's box can have, or a
        little more where doubles do not hold it."""
        q = queries.astype(np.float64)
        most = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        if not self._held(queries):
            most += (np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high)).T) * (q.shape[1] + 4) * 2.0**-51
        return most

    def _reach(self, queries: np.ndarray) -> int:
        largest = max(-int(queries.min()), int(queries.max())) if queries.size else 0
        return largest * self.largest * queries.shape[-1]

    def _held(self, queries: np.ndarray) -> bool:
        return self._reach(queries) < 1 << 53

    def scored(self, queries: np.ndarray):
        """The points and the queries in the narrowest type that holds all their inner
        products: doubles, else 64-bit integers, else integers of any size."""
        reach = self._reach(queries)
        if reach < 1 << 53:
            return self.vectors, queries.astype(np.float64)
        if reach < 1 << 62:
            return self.whole, queries
        return self.whole.astype(object), queries.astype(object)

    def search(self, points: np.ndarray, query: np.ndarray, own: int, bound: np.ndarray, best: list, floor, k: int) -> list:
        """``points`` and ``query`` as ``scored`` gives them. Best-first: nodes by bound, until none can change ``best``, the k best
        (-score, id) so far, of this shard or others; nothing scored under ``floor``
        (None: no such) is asked for."""
        least = -floor if floor is not None else float("inf")  # of -score
        todo = [(-bound[0], 0)]
        while todo:
            most, node = heapq.heappop(todo)
            worst = best[-1] if len(best) == k else (least, float("inf"))
            if most > min(least, worst[0]):
                break
            if (most, self.least[node]) > worst:
                continue
            for x in self.below[node]:
                heapq.heappush(todo, (-bound[x], x))
            if not self.below[node]:
                rows = self.order[slice(*self.spans[node])]
                score, ids = points[rows] @ query, self.ids[rows]
                if score.dtype == object:  # beyond a long's range, the nearest one
                    score = np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in score], object)
                here = (ids != own) & (-score <= min(least, worst[0]))
                if here.any():
                    new = sorted(zip((-score[here]).tolist(), ids[here].tolist()))[:k]
                    best = [p for _, p in zip(range(k), heapq.merge(best, new))]
        return best


def trees(ids: np.ndarray, vectors: np.ndarray, shard: int = SHARD) -> list[KdTree]:
    return [KdTree(vectors[a : a + shard], ids[a : a + shard]) for a in range(0, len(ids), shard)]


def best_by_trees(strip: list[KdTree], query_ids, queries, bounds, k):
    """Shard by shard, each query's k-th best going on to the next."""
    best = [[] for _ in range(len(queries))]
    floors = [None if x != x else int(x) for x in bounds.tolist()]
    for tree in strip:
        for b in range(0, len(queries), 512):
            bound, (points, some) = tree.bounds(queries[b : b + 512]), tree.scored(queries[b : b + 512])
            for n in range(len(bound)):
                best[b + n] = tree.search(points, some[n], query_ids[b + n], bound[n], best[b + n], floors[b + n], k)
    at = np.repeat(np.arange(len(queries)), [len(h) for h in best])
    flat = [p for h in best for p in h]
    return at, np.array([p[1] for p in flat], np.int64), np.array([-int(p[0]) for p in flat], np.int64)


def exact_top_k(embeddings: DataFrame, k: int = 5, every: int = 50, strip: int = 16384, scale: int = 256, block: int = QUERIES) -> DataFrame:
    """For each vec_id divisible by ``every`` the ``k`` highest inner products of
    vectors of floor(scale * component): query_id, rank, vec_id, score (long).

    Rows whose vector is null, empty or holds a null or non-finite component, or
    whose vec_id is null, take no part; zero vectors do. Ties go to the smaller
    vec_id. With fewer candidates, all. An empty table gives no rows. Scores are
    exact, beyond 2**53 too; components and scores outside a long's range are
    taken for the long nearest to them."""
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")))
    return search(rows, F.col("vec_id") % every == 0, k, strip, trees, best_by_trees, "long", block)
