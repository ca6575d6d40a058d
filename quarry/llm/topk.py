"""Exact top-k search by inner product over a pivot-distance index.

Vectors are quantized to integers, floor(scale * x). Each is lengthened by one component so that all have the norm M of the longest; queries
get 0 there. Then distance falls as the inner product grows: d(q, x)^2 = |q|^2 + M^2 - 2 q.x. The index is a table keyed by each vector's nearest
pivot and its distance to it, and sorted by them, so that consecutive rows of a pivot are annuli around it.

Queries are searched in chunks of about CHUNK, those near the same pivots together. A chunk's queries go to every task; the index stays where it is
stored, and is never shuffled again. By the triangle inequality an annulus with distances in [lo, hi] from a pivot p holds nothing nearer to a query q than
max(lo - d(q, p), d(q, p) - hi). So only the rows of each pivot are read whose distances lie within the chunk's bound of a query's own distance; of an
annulus read, the distances to all pivots bound each query, and it is scored for those queries alone that the bound doesn't rule out. A task expands the annuli of a batch
from the queries' own distance outwards, which tightens their k-th distances. At first those are the k-th distances within the sample that the pivots are fitted on.
Results don't depend on pivots, annuli or chunks, which only save work: rankings are of exact integer scores.

Pivots are means of clusters of PIVOT_SAMPLE vectors at most; every vector is indexed. scored_share() tells which share of all pairs has been scored.

Defined results. Vectors that are null, or hold null or non-finite components, take no part. Vectors of different lengths: the shorter counts
as 0 beyond its end. Very long vectors: a batch of them fits into a task. Null ids take no part. Repeated ids: each row is a candidate, but no row is a candidate of a query
with its own id; queries of one id and different vectors are ranked together. Ties: smaller vec_id first. Fewer than k candidates: all. Empty table: no rows.
Scores beyond 64 bits saturate, and saturated ones are ties. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import map_arrow, materialize, new_path, pick

K, SCALE, EVERY = 5, 256, 50
PIVOTS, PIVOT_SAMPLE, ROUNDS = 32, 4096, 8
CHUNK, ANNULUS = 8_192, 1_024
#: Queries that are scored against an annulus at once.
AT_ONCE = 2_048
#: Distances are compared with so much room for rounding, relative to M.
ROOM = 1e-6
#: Up to here double products and sums are exact integers.
EXACT = float(1 << 52)
NONE = np.iinfo(np.int64).max


def quantized(vectors: DataFrame, scale: float = SCALE, column: str = "embedding") -> DataFrame:
    """vec_id and v, the integer components as doubles, of the vectors that take part."""
    d = pick(vectors, "vec_id", column).where(F.col("vec_id").isNotNull() & F.col(column).isNotNull())
    v = F.transform(F.col(column), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    # Components are bounded so that no product or distance overflows a double.
    bounded = F.transform(v, lambda x: F.greatest(F.least(x, F.lit(1e100)), F.lit(-1e100)))
    return d.where(F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), bounded.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix, shorter rows filled up with 0."""
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    width = int(lengths.max(initial=0))
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))


def fit_pivots(x: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Means of at most n clusters: farthest-first choice, then ROUNDS rounds of moving each pivot to the mean of the vectors nearest to it."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    p = x[chosen].copy()
    for _ in range(ROUNDS):
        near = _distances(x, p, 0.0).argmin(1)
        for i in range(len(p)):
            if (own := near == i).any():
                p[i] = x[own].mean(0)
    return p


def _distances(x: np.ndarray, pivots: np.ndarray, last: np.ndarray | float) -> np.ndarray:
    """From each row, lengthened by `last`, to each pivot, lengthened by 0."""
    width = max(x.shape[1], pivots.shape[1])
    x, p = _widened(x, width), _widened(pivots, width)
    d = (x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T) + (np.asarray(last) ** 2 if np.ndim(last) else np.full(len(x), float(last) ** 2))[:, None]
    return np.sqrt(np.maximum(d, 0))


def _lengthened(x: np.ndarray, norm: float) -> np.ndarray:
    """The component that lengthens each row to the norm."""
    return np.sqrt(np.maximum(norm * norm - (x * x).sum(1), 0))


def build_index(vectors: DataFrame, pivots: np.ndarray, norm: float) -> DataFrame:
    """The index (pivot, d, vec_id, v) of quantized vectors, sorted by pivot and distance; equal distances, as of equal vectors, fall into partitions by a hash of ids."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            d = _distances(x, pivots, _lengthened(x, norm))
            near = d.argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(d[np.arange(len(x)), near], pa.float64()), b.column(0), b.column(1)], ["pivot", "d", "vec_id", "v"])

    keyed = map_arrow(vectors, key, "pivot int, d double, vec_id bigint, v array<double>")
    order = ("pivot", "d", F.xxhash64("vec_id"))
    return materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order), "topk-index")


class Queries:
    """A chunk's queries, and what bounds them: their distances to the pivots, and their k-th distances so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, norm: float, k: int, annulus: int = ANNULUS):
        self.ids, self.q, self.pivots, self.norm, self.k, self.annulus = ids, q, pivots, norm, k, annulus
        self.squares, self.dp, self.bound = (q * q).sum(1), _distances(q, pivots, 0.0), np.full(len(q), np.inf)

    def distance(self, at: np.ndarray | slice, score: np.ndarray) -> np.ndarray:
        """Of the queries `at`, the distance at which a vector has such a score."""
        return np.sqrt(np.maximum(0.0, self.squares[at] + self.norm * self.norm - 2 * score))

    def bound_by(self, sample_ids: np.ndarray, sample: np.ndarray) -> None:
        """The k-th distances within a sample of the vectors, which those within all can't exceed."""
        if len(sample) <= self.k:
            return
        width = max(self.q.shape[1], sample.shape[1])
        x, q = _widened(sample, width), _widened(self.q, width)
        for s in range(0, len(q), AT_ONCE):
            score = q[s : s + AT_ONCE] @ x.T
            score[self.ids[s : s + AT_ONCE, None] == sample_ids[None]] = -np.inf
            kth = np.partition(score, -self.k, axis=1)[:, -self.k]
            some = slice(s, s + AT_ONCE)
            self.bound[some] = np.where(np.isfinite(kth), self.distance(some, np.where(np.isfinite(kth), kth, 0.0)), np.inf)

    def reach(self) -> Column:
        """Which rows of the index an annulus of this chunk may have to read: of each pivot, distances within the bound of a query's own."""
        room = self.bound[:, None] + ROOM * self.norm
        lo, hi = (self.dp - room).min(0), (self.dp + room).max(0)
        return reduce(or_, [(F.col("pivot") == p) & F.col("d").between(float(a), float(b)) for p, (a, b) in enumerate(zip(lo, hi, strict=True))])

    def search(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's best k for each query; a row without query tells how many pairs it has scored, and how many it has read."""
        n, k = len(self.q), self.k
        ids, scores, bound = np.full((n, k), NONE), np.full((n, k), -np.inf), self.bound.copy()
        slow: dict[int, list[tuple[int, int]]] = {}
        scored = read = 0
        for b in batches:
            x = _matrix(b.column(1))
            width = max(x.shape[1], self.q.shape[1])
            x, q, own = _widened(x, width), _widened(self.q, width), b.column(0).to_numpy()
            exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, width) < EXACT
            dp = _distances(x, self.pivots, _lengthened(x, self.norm))
            rings = []
            for s in range(0, len(x), self.annulus):
                d = dp[s : s + self.annulus]
                rings.append((np.maximum(np.maximum(d.min(0) - self.dp, self.dp - d.max(0)).max(1), 0), s))
            # Outwards from the queries' own distance.
            for near, s in sorted(rings, key=lambda r: (float(np.median(r[0])), r[1])):
                read += n * len(x[s : s + self.annulus])
                live = np.flatnonzero(near <= bound + ROOM * self.norm)
                order = s + np.argsort(own[s : s + self.annulus], kind="stable")
                for c in range(0, len(live), AT_ONCE):
                    at = live[c : c + AT_ONCE]
                    scored += len(at) * len(order)
                    if exact:
                        self._merge(at, q[at] @ x[order].T, own[order], ids, scores)
                        bound[at] = np.minimum(bound[at], np.where(np.isfinite(kth := scores[at, -1]), self.distance(at, np.where(np.isfinite(kth), kth, 0.0)), np.inf))
                    else:
                        self._merge_slowly(at, q[at], x[order], own[order], slow)
        if slow:  # rare: whichever came first, all meet here
            for i, held in slow.items():
                both = sorted([*held, *((-int(v), int(d)) for v, d in zip(scores[i], ids[i], strict=True) if np.isfinite(v))])[:k]
                yield self._rows([int(self.ids[i])] * len(both), [d for _, d in both], [-v for v, _ in both])
        fast = np.isfinite(scores)
        if slow:
            fast[list(slow)] = False
        i, _ = np.nonzero(fast)
        yield self._rows(self.ids[i], ids[fast], scores[fast].astype(np.int64))
        yield self._rows(pa.nulls(1, pa.int64()), [scored], [read])

    @staticmethod
    def _rows(query_id, vec_id, score) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (query_id, vec_id, score)], ["query_id", "vec_id", "score"])

    def _merge(self, at: np.ndarray, score: np.ndarray, own: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """The best k of what queries hold and of an annulus, whose columns are in the order of ids."""
        score[self.ids[at, None] == own[None]] = -np.inf
        if score.shape[1] > self.k:
            # Of equal scores the first columns count: all above the k-th, then as many of its equals as are needed.
            kth = np.partition(score, -self.k, axis=1)[:, -self.k, None]
            above, equal = score > kth, score == kth
            equal &= np.cumsum(equal, 1) <= self.k - above.sum(1, keepdims=True)
            some = np.nonzero(above | equal)[1].reshape(len(at), self.k)
        else:
            some = np.broadcast_to(np.arange(score.shape[1]), score.shape)
        new = np.take_along_axis(score, some, 1)
        both_s = np.concatenate([scores[at], new], 1)
        both_i = np.concatenate([ids[at], np.where(np.isfinite(new), own[some], NONE)], 1)
        best = np.lexsort((both_i, -both_s), axis=1)[:, : self.k]
        scores[at], ids[at] = np.take_along_axis(both_s, best, 1), np.take_along_axis(both_i, best, 1)

    def _merge_slowly(self, at: np.ndarray, q: np.ndarray, x: np.ndarray, own: np.ndarray, held: dict[int, list[tuple[int, int]]]) -> None:
        """As _merge(), with Python's integers, for components that doubles can't multiply exactly."""
        whole = np.frompyfunc(int, 1, 1)
        score = whole(q).dot(whole(x).T)
        for i, row in zip(at.tolist(), score, strict=True):
            new = [(-max(min(v, 2**63 - 1), -(2**63)), d) for v, d in zip(row, own.tolist(), strict=True) if d != self.ids[i]]
            held[i] = sorted(held.get(i, []) + new)[: self.k]


def _chunks(queries: DataFrame, pivots: np.ndarray, chunk: int) -> tuple[DataFrame, int]:
    """The queries with `chunk`, and how many chunks there are: queries of one nearest pivot together, pivots with many cut by a hash, those with few joined."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            near = _distances(x, pivots, 0.0).argmin(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32())], ["vec_id", "v", "pivot"])

    placed = materialize(map_arrow(queries, key, "vec_id bigint, v array<double>, pivot int"), "topk-queries")
    counts = {r["pivot"]: r["count"] for r in placed.groupBy("pivot").count().collect()}  # a row for each pivot
    first, parts, at, room = {}, {}, 0, chunk
    for p, n in sorted(counts.items()):
        if n > room and room < chunk:
            at, room = at + 1, chunk
        first[p], parts[p] = at, max(1, -(-n // chunk))
        at, room = (at + parts[p], chunk) if n > chunk else (at, room - n)
    number = F.create_map(*[F.lit(x) for p in counts for x in (p, first[p])]) if counts else F.create_map(F.lit(0), F.lit(0))
    many = F.create_map(*[F.lit(x) for p in counts for x in (p, parts[p])]) if counts else F.create_map(F.lit(0), F.lit(1))
    split = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.element_at(many, F.col("pivot")).cast("long"))
    return placed.withColumn("chunk", F.element_at(number, F.col("pivot")) + split.cast("int")), at + 1


def found(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, chunk: int = CHUNK, annulus: int = ANNULUS) -> DataFrame:
    """query_id, vec_id, score: each query's best k of each task; rows without query_id hold, in vec_id and score, the pairs that were scored and read. Both tables as quantized() returns them."""
    spark = vectors.sparkSession
    vectors = materialize(vectors, "topk-vectors")
    norm = float(np.sqrt(vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0] or 0.0)) * (1 + 1e-9)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(PIVOT_SAMPLE).collect()
    sample = _matrix(pa.array([r.v for r in rows], pa.list_(pa.float64())))
    sample_ids = np.array([r.vec_id for r in rows], np.int64)
    p = fit_pivots(sample, pivots)
    index = build_index(vectors, p, norm)
    placed, chunks = _chunks(queries, p, chunk)
    path = new_path(spark, "topk-found")
    schema = "query_id bigint, vec_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(path)
    for c in range(chunks):
        own = placed.where(F.col("chunk") == c).select("vec_id", "v").collect()  # about `chunk` rows
        if own:
            q = Queries(np.array([r.vec_id for r in own], np.int64), _matrix(pa.array([r.v for r in own], pa.list_(pa.float64()))), p, norm, k, annulus)
            q.bound_by(sample_ids, sample)
            map_arrow(index.where(q.reach()).select("vec_id", "v"), q.search, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def scored_share(found_: DataFrame, vectors: DataFrame, queries: DataFrame) -> float:
    """The share of all pairs of queries and vectors that has been scored."""
    scored = found_.where("query_id is null").agg(F.sum("vec_id")).first()[0] or 0
    return scored / max(1, vectors.count() * queries.count())


def search(vectors: DataFrame, queries: DataFrame, k: int = K, **sizes) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best among `vectors`. Both tables as quantized() returns them."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found(vectors, queries, k, **sizes).where("query_id is not null").withColumn("rank", rank)
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def is_query(vec_id: Column, every: int = EVERY) -> Column:
    return vec_id % every == 0


def nearest(vectors: DataFrame, k: int = K, scale: float = SCALE, every: int = EVERY, **sizes) -> DataFrame:
    """The search with the rows whose id is divisible by `every` as queries, against all rows."""
    q = quantized(vectors, scale)
    return search(q, q.where(is_query(F.col("vec_id"), every)), k, **sizes)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding])
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([a[1] * a[2] FOR a IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
