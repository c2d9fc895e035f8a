"""Operator 7: exact top-k inner-product search over an impact-ordered, score-at-a-time index.

Vectors are turned into integers and dealt by hash into blocks.  A block is indexed as posting segments: for every dimension
and quantised level, the rows of that level.  A segment's impact for a query is the most that a posting in it can contribute,
above the least that the dimension gives.  A query takes segments by descending impact and adds the impact to the
accumulators of the segment's rows; what is left can add at most the largest impact left in each dimension.  After each
stage the likeliest rows are scored exactly, which gives a floor for the k-th score; the search ends once the rows whose
bound reaches the floor are few, or all segments are taken, and these rows are rescored exactly.  Nothing is left out:
a row is skipped only if its bound proves that k others score more.

Queries are a stated set.  A block's vectors move once for every ``GROUP`` query blocks, and query blocks, packed, once for every
block of vectors; there is no join of the two.  A block returns at most k rows per query; ranks are taken over these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

K = 5
LEVELS = 16
BLOCK = 8192
QUERY_BLOCK = 128
#: Query blocks that meet a block of vectors in one task.
GROUP = 256
#: Shares of the postings after which the bounds are looked at.
STAGES = (0.25, 0.5, 0.75, 1.0)


def _matrix(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """An array of lists -> (rows, matrix) for each length of list."""
    lengths = col.value_lengths().to_numpy()
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield rows, col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), d)


def _pack(size: int):
    """mapInArrow function: (vec_id, v) -> blocks (dims, ids, values as bytes); vectors in a block have one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(d: int, whole: bool) -> Iterator[pa.RecordBatch]:
            ids, vs = (np.concatenate(x) for x in zip(*held[d], strict=True))
            cut = len(ids) if whole else len(ids) // size * size
            for s in range(0, cut, size):
                e = min(s + size, cut)
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids[s:e].tobytes()], pa.binary()), pa.array([vs[s:e].tobytes()], pa.binary())], names=["dims", "ids", "values"])
            held[d] = [(ids[cut:], vs[cut:])]

        for b in batches:
            ids = b.column(0).to_numpy()
            for rows, v in _matrix(b.column(1)):
                held.setdefault(v.shape[1], []).append((ids[rows], v))
                if sum(len(x) for x, _ in held[v.shape[1]]) >= size:
                    yield from blocks(v.shape[1], False)
        for d in list(held):
            yield from blocks(d, True)

    return run


class ImpactIndex:
    """Posting segments of one block of vectors (``ids`` ascending)."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, levels: int = LEVELS):
        order = np.argsort(ids)
        self.ids, self.v = ids[order], v[order]
        n, d = self.v.shape
        low, high = self.v.min(0), self.v.max(0)
        step = np.maximum((high - low) // levels + 1, 1)
        segment = np.arange(d) * levels + (self.v - low) // step
        #: Row numbers of all segments one after the other, and where each segment starts.
        self.postings = (np.argsort(segment.ravel(), kind="stable") // d).astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(segment.ravel(), minlength=d * levels))])
        self.low = low[:, None] + step[:, None] * np.arange(levels)
        self.high = np.minimum(self.low + step[:, None] - 1, high[:, None])
        self.most = int(max(abs(int(low.min(initial=0))), abs(int(high.max(initial=0)))))

    def impacts(self, q: np.ndarray) -> tuple[np.ndarray, int]:
        """Impact of each segment (-1: it is empty), and what every row has at least by the bounds."""
        up = np.maximum(q[:, None] * self.low, q[:, None] * self.high)
        filled = np.diff(self.start).reshape(up.shape) > 0
        least = np.where(filled, up, np.iinfo(np.int64).max).min(1)
        return np.where(filled, up - least[:, None], -1).ravel(), int(least.sum())

    def search(self, q: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) among which the k best are; ``own`` is left out."""
        n, d = self.v.shape
        if self.most * int(np.abs(q).max(initial=0)) * max(d, 1) >= 1 << 61:  # beyond whole numbers of 64 bits: count exactly
            scores = self.v.astype(object) @ q.astype(object)
            rows = np.array([r for r in range(n) if r != own], np.int64)
            if any(not -(1 << 63) <= s < 1 << 63 for s in scores[rows]):
                raise OverflowError("an inner product is beyond a long")
            return rows, scores[rows].astype(np.int64)
        impact, base = self.impacts(q)
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        sizes = np.diff(self.start)[order]
        upto = np.cumsum(sizes)
        acc, at = np.full(n, base, np.int64), 0
        # Floats add whole numbers exactly up to 2**53; a row gets one posting of each dimension at most.
        small = int(impact.reshape(d, -1).max(1, initial=0).clip(0).sum()) < 1 << 53
        if own >= 0:
            acc[own] = np.iinfo(np.int64).min // 2
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for stage in STAGES:
            end = int(np.searchsorted(upto, stage * (upto[-1] if len(upto) else 0))) + 1
            new = order[at:end]
            if len(new):
                where = np.concatenate([self.postings[self.start[s] : self.start[s + 1]] for s in new.tolist()])
                add = np.repeat(impact[new], sizes[at:end])
                if small:
                    acc += np.bincount(where, add, n).astype(np.int64)
                else:
                    np.add.at(acc, where, add)
            at = end
            left = np.zeros(d, np.int64)
            np.maximum.at(left, order[at:] // (len(impact) // max(d, 1)), impact[order[at:]])
            likely = np.argpartition(-acc, min(4 * k, n) - 1)[: 4 * k]
            likely = likely[likely != own]
            exact = np.sort(self.v[likely] @ q)[::-1]
            rows = np.flatnonzero(acc + left.sum() >= (exact[k - 1] if len(exact) >= k else np.iinfo(np.int64).min // 4))
            if len(rows) <= max(4 * k, n // 32):
                break
        rows = rows[rows != own]
        return rows, self.v[rows] @ q


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, group: int = GROUP) -> DataFrame:
    """(vec_id long, v array<long>) twice -> (query_id, rank, vec_id, score): k best by inner product, ties to smaller vec_id.

    vec_id is a key: repeated ids count once (the least vector).  A query skips the candidate of its own id; vectors of another
    length than the query's take no part in its search.  Fewer candidates than k give all of them; no rows, no result.  Sums are
    exact at every size of component; one that no long holds raises an error.  Extra columns are ignored.
    """
    once = materialize(vectors.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    asked = queries.select("vec_id").distinct().join(once, "vec_id")
    ask = materialize(asked.mapInArrow(_pack(query_block), "dims int, ids binary, values binary"), "queries")
    blocks, groups = max(1, -(-once.count() // block)), max(1, -(-ask.count() // group))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = once.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("c"), each(groups).alias("g"), "vec_id", "v")
    c = c.select((F.col("c") * groups + F.col("g")).alias("cell"), F.lit(0).alias("kind"), "vec_id", "v", F.lit(None).cast("int").alias("dims"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("values"))
    a = ask.select(each(blocks).alias("c"), F.pmod(F.xxhash64("ids"), F.lit(groups)).alias("g"), "dims", "ids", "values")
    a = a.select((F.col("c") * groups + F.col("g")).alias("cell"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<long>").alias("v"), "dims", "ids", "values")
    dealt = c.unionAll(a).repartition("cell").sortWithinPartitions("cell", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, index = None, [], {}

        def answers(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for r in range(b.num_rows):
                d = b.column("dims")[r].as_py()
                if d not in index:
                    continue
                x, out = index[d], ([], [], [])
                qids = np.frombuffer(b.column("ids")[r].as_buffer(), np.int64)
                qs = np.frombuffer(b.column("values")[r].as_buffer(), np.int64).reshape(len(qids), d)
                for qid, q in zip(qids.tolist(), qs, strict=True):
                    own = int(np.searchsorted(x.ids, qid))
                    rows, scores = x.search(q, k, own if own < len(x.ids) and x.ids[own] == qid else -1)
                    best = np.lexsort((x.ids[rows], -scores))[:k]
                    for col, v in zip(out, ([qid] * len(best), x.ids[rows[best]].tolist(), scores[best].tolist()), strict=True):
                        col.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], names=["query_id", "vec_id", "score"])

        for b in batches:
            key = b.column("cell").to_numpy() * 2 + b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
            for s, e in zip(cuts, [*cuts[1:], len(key)], strict=False):
                part = b.slice(s, e - s)
                if key[s] // 2 != cell:
                    cell, held, index = key[s] // 2, [], {}
                if key[s] % 2 == 0:
                    held.append(part.select(["vec_id", "v"]))
                    continue
                if held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    ids = t.column("vec_id").to_numpy()
                    col = t.column("v").chunk(0) if t.num_rows else t.column("v").combine_chunks()
                    index, held = {v.shape[1]: ImpactIndex(ids[rows], v) for rows, v in _matrix(col)}, []
                yield from answers(part)

    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component as double; rows with null or non-finite components are left out."""
    x = F.col(vector).cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.col("vec_id").isNotNull()
    return df.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * 256)).alias("v"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(v, v.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM e q JOIN e c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES = {"op7_topk": op7_topk}
ORACLE = {"op7_topk": OP7_SQL}
