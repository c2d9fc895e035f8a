"""Operator 11: hard negatives by bit-sliced integer products.

Vectors of whole numbers are dealt by hash into blocks.  A block keeps its components, less the least of each dimension, as
bit-planes.  An anchor takes the planes most significant first: after each plane the planes left can add at most the sum of the
anchor's positive components and at least that of its negative ones, times what the lower bits can hold, so every candidate has an
interval of scores.  A candidate goes once its interval can't qualify: for positives, once k others of the label surely score
more; for negatives, once the interval misses every window of scores or k others surely lie in the window above it.  After the
last plane the intervals are single numbers, the exact scores.  No candidate is dropped otherwise.

Anchors are a stated set.  Blocks of anchors and blocks of vectors meet in cells, one after the other, without a join of the two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

POSITIVES, NEGATIVES = 5, 5
#: Window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 80, 100
BLOCK = 2048
ANCHORS = 2048


class BitSlices:
    """Bit-planes of one block of whole-number vectors of one length; ``ids`` and ``labels`` go with its rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, v = ids[order], labels[order], v[order]
        self.low = v.min(0)
        above = v.view(np.uint64) - self.low.view(np.uint64)  # right modulo 2**64, even where the difference outgrows a long
        self.bits = int(above.max(initial=0)).bit_length()
        self.planes = [((above >> np.uint64(b)) & np.uint64(1)).astype(np.uint8) for b in range(self.bits)]
        self.ready: dict[tuple[int, str], np.ndarray] = {}

    def plane(self, b: int, kind: str) -> np.ndarray:
        """The plane in the type of the sums, kept for the next anchor."""
        if kind == "O":
            return self.planes[b].astype(object)
        if (b, kind) not in self.ready:
            self.ready[b, kind] = self.planes[b].astype(kind)
        return self.ready[b, kind]

    def refine(self, q: np.ndarray, rows: np.ndarray, alive: Callable[[np.ndarray, np.ndarray], np.ndarray], planes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the rows that ``alive(low, high)`` leaves; ``planes`` gets the rows left after each plane."""
        exact = [int(x) for x in q]
        up, down = sum(x for x in exact if x > 0), sum(x for x in exact if x < 0)
        base = sum(x * int(y) for x, y in zip(exact, self.low, strict=True))
        most = (up - down) * (1 << self.bits) + abs(base)
        # Sums of single bits are exact in single precision up to 2**24; whole numbers of 64 bits, then of any size, beyond.
        kind = "O" if most >= 1 << 62 else "f4" if up - down < 1 << 24 else "i8"
        q = q.astype(kind)
        score = np.full(len(rows), base, "O" if kind == "O" else np.int64)
        for b in range(self.bits - 1, -1, -1):
            every = len(rows) == len(self.ids)
            plane = self.plane(b, kind)
            part = (plane if every else plane[rows]) @ q
            score = score + (part if kind == "O" else part.astype(np.int64)) * (1 << b)
            rest = (1 << b) - 1
            keep = alive(score + down * rest, score + up * rest)
            rows, score = rows[keep], score[keep]
            if planes is not None:
                planes.append(len(rows))
            if not len(rows):
                break
        if not self.bits:
            keep = alive(score, score)
            rows, score = rows[keep], score[keep]
        return rows, score

    def _best(self, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        if len(rows) and not -(1 << 63) <= min(score) <= max(score) < 1 << 63:
            raise OverflowError("an inner product is beyond a long")
        best = np.lexsort((self.ids[rows], -score.astype(object) if score.dtype == object else -score))[:k]
        return self.ids[rows[best]].tolist(), [int(s) for s in score[best]]

    def positives(self, own: int, label: int, q: np.ndarray, k: int) -> tuple[list[int], list[int]]:
        """(ids, scores) of the k best rows of the label, the anchor's own left out."""

        def alive(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return high >= np.sort(low)[-k] if len(low) > k else np.ones(len(low), bool)

        return self._best(*self.refine(q, np.flatnonzero((self.labels == label) & (self.ids != own)), alive), k)

    def negatives(self, own: int, label: int, q: np.ndarray, scores: list[int], k: int, low: int = LOW, high: int = HIGH) -> list[tuple[list[int], list[int]]]:
        """For each positive's score, (ids, scores) of the k best rows of other labels inside its window."""
        windows = [(-(-low * s // 100), high * s // 100) for s in scores]  # the least and the largest score allowed
        out: list[tuple[list[int], list[int]]] = [([], []) for _ in scores]
        some = [w for w in dict.fromkeys(windows) if w[0] <= w[1]]
        if not some:
            return out

        def alive(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            keep = np.zeros(len(lo), bool)
            for first, last in some:
                may = (hi >= first) & (lo <= last)
                sure = lo[(lo >= first) & (hi <= last)]
                if len(sure) > k:
                    may &= hi >= np.sort(sure)[-k]
                keep |= may
            return keep

        rows, score = self.refine(q, np.flatnonzero((self.labels != label) & (self.ids != own)), alive)
        for i, (first, last) in enumerate(windows):
            inside = (score >= first) & (score <= last)
            out[i] = self._best(rows[inside], score[inside], k)
        return out


def _blocks(held: list[pa.RecordBatch]) -> dict[int, BitSlices]:
    """Bit-planes of a cell's vectors for each length of vector."""
    t = pa.Table.from_batches(held)
    ids, labels = t.column("vec_id").to_numpy(), t.column("label").to_numpy()
    col = t.column("v").combine_chunks()
    lengths = col.value_lengths().to_numpy()
    out = {}
    for d in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == d)
        out[d] = BitSlices(ids[rows], labels[rows], col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), d))
    return out


def _meet(rows: DataFrame, anchors: DataFrame, search: Callable, schema: str, block: int, group: int) -> DataFrame:
    """``search(slices, anchor id, label, vector, scores)`` yields rows of ``schema``, for each anchor and block of vectors of its length.

    A vector goes to one cell for each group of anchors, an anchor to one for each block of vectors.  A cell holds one block.
    """
    blocks, groups = max(1, -(-rows.count() // block)), max(1, -(-anchors.count() // group))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n))
    c = rows.select(part(blocks, 0).alias("_own"), each(groups).alias("_other"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("scores"))
    c = c.select((F.col("_own") * groups + F.col("_other")).alias("cell"), F.lit(0).alias("kind"), "vec_id", "label", "v", "scores")
    a = anchors.select(part(groups, 1).alias("_own"), each(blocks).alias("_other"), "vec_id", "label", "v", "scores")
    a = a.select((F.col("_other") * groups + F.col("_own")).alias("cell"), F.lit(1).alias("kind"), "vec_id", "label", "v", "scores")
    dealt = c.unionAll(a).repartition("cell").sortWithinPartitions("cell", "kind")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, slices = None, [], {}
        for b in batches:
            key = b.column("cell").to_numpy() * 2 + b.column("kind").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
            for s, e in zip(cuts, [*cuts[1:], len(key)], strict=False):
                if key[s] // 2 != cell:
                    cell, held, slices = key[s] // 2, [], {}
                part = b.slice(s, e - s)
                if key[s] % 2 == 0:
                    held.append(part)
                    continue
                if held:
                    slices, held = _blocks(held), []
                found = []
                for r in part.select(["vec_id", "label", "v", "scores"]).to_pylist():
                    if len(r["v"]) in slices:
                        found.extend(search(slices[len(r["v"])], r["vec_id"], r["label"], np.array(r["v"], np.int64), r["scores"]))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(names))], names=names)

    return dealt.mapInArrow(run, schema)


def _first(rows: DataFrame, by: list[str], score: str, ident: str, k: int) -> DataFrame:
    """The k best of each group, ranked from 1."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), ident)).cast("int")).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, group: int = ANCHORS) -> DataFrame:
    """(vec_id long, label long, v array<long>) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` is the condition of the stated anchors.  vec_id is a key: of rows that share one the least (label, v) counts.  Rows
    with a null in a column take no part, nor do vectors of another length than the anchor's in its search.  Fewer positives or
    negatives than asked give all there are; ties go to the smaller vec_id.  Scores are exact at every size of component; one that
    no long holds raises an error.  Extra columns are ignored; an empty table gives no rows.
    """
    good = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    once = materialize(good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", F.col("r.label").cast("long").alias("label"), "r.v"), "vectors")
    asked = once.where(anchors)

    def best(slices: BitSlices, own: int, label: int, q: np.ndarray, _: list[int] | None) -> list[tuple]:
        return [(own, i, s) for i, s in zip(*slices.positives(own, label, q, positives), strict=True)]

    found = _meet(once, asked.withColumn("scores", F.lit(None).cast("array<long>")), best, "anchor_id long, positive_id long, positive_score long", block, group)
    found = materialize(_first(found, ["anchor_id"], "positive_score", "positive_id", positives).drop("rank"), "positives")
    scores = found.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # at most ``positives`` numbers
    asked = materialize(asked.join(scores, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "anchors")

    def near(slices: BitSlices, own: int, label: int, q: np.ndarray, scores: list[int]) -> list[tuple]:
        return [(own, p, i, s) for p, got in zip(scores, slices.negatives(own, label, q, scores, negatives), strict=True) for i, s in zip(*got, strict=True)]

    mined = _meet(once, asked, near, "anchor_id long, positive_score long, negative_id long, negative_score long", block, group)
    mined = _first(mined, ["anchor_id", "positive_score"], "negative_score", "negative_id", negatives)
    return found.join(mined, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled_vectors(df: DataFrame) -> DataFrame:
    """(vec_id, label, v): floor(256 * x) of each component; every seventh id has the next label.

    Rows with a null id, label or vector, or a null or non-finite component, are left out.
    """
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    rows = df.where(good & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.transform(x, lambda e: F.floor(e * 256)).alias("v"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(labelled_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM e a JOIN e c ON a.i = c.i AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY 1, 2, 3),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
  WHERE p.place <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLE = {"op11_hard_negatives": OP11_SQL}
