"""Operator 6: quality classifier, a regularised quadratic discriminant over document statistics.

Statistics of whole texts are computed in numpy batches and log-transformed.  Class moments are summed
by Spark over labelled rows (a sample of bounded size, ``TRAIN_ROWS``); the driver sees one row per class and moment (their number depends on the
number of statistics alone).  Covariances are shrunk towards their diagonal, and scores are logistic in the
difference of Mahalanobis log densities, with the Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, array_slices, materialize, mix64, table, words_of, RollingHash

STATISTICS = ("words", "word_length", "upper", "digit", "mark", "symbol", "shout", "line_breaks", "distinct", "distinct_3", "again", "stops")
THRESHOLD = 0.3
#: Labelled documents that the model is fitted on, about and at most: it has a few hundred parameters.
TRAIN_ROWS = 50_000
SYMBOLS = b"*$%&#@^~_=|<>{}[]\\/"
MARKS = b".,;:?'\"()-"


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _MARK = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(SYMBOLS), _class(MARKS)


def document_statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text; null and empty texts have the statistics of no words."""
    out = np.zeros((len(texts), len(STATISTICS)))
    for first, end, data, offs in array_slices(texts):
        n = end - first
        size = np.maximum(np.diff(offs), 1).astype(float)
        row = np.repeat(np.arange(n), np.diff(offs))

        def share(hit: np.ndarray, row=row, n=n, size=size) -> np.ndarray:
            return np.bincount(row[hit], minlength=n) / size

        upper = _UPPER[data]
        if len(data) > 1:  # capitals of two-byte Latin letters
            upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        starts, ends, wrow = words_of(data, offs)
        words = np.bincount(wrow, minlength=n)
        some = np.maximum(words, 1).astype(float)
        h = RollingHash(data)(starts, ends)

        def distinct(x: np.ndarray, r: np.ndarray, n=n) -> np.ndarray:
            key = np.sort((r.astype(np.uint64) << np.uint64(40)) | (x >> np.uint64(24)))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            return np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)

        together = wrow[2:] == wrow[:-2]
        three = mix64(h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[together]
        threes = np.maximum(np.bincount(wrow[2:][together], minlength=n), 1)
        again = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
        last = data[ends - 1]
        f = out[first:end]
        f[:, 0] = np.log1p(words)
        f[:, 1] = np.log1p(np.bincount(wrow, ends - starts, n) / some)
        for k, hit in ((2, upper), (3, _DIGIT[data]), (4, _MARK[data]), (5, _SYMBOL[data]), (6, data == 33), (7, data == 10)):
            f[:, k] = np.log(share(hit) + 1e-3)
        f[:, 8] = np.log(distinct(h, wrow) / some + 1e-2)
        f[:, 9] = np.log(np.where(words > 2, distinct(three, wrow[2:][together]) / threes, 1) + 1e-2)
        f[:, 10] = np.log(np.bincount(wrow[1:][again], minlength=n) / some + 1e-2)
        f[:, 11] = np.log(np.bincount(wrow[last == 46], minlength=n) / some + 1e-2)
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(texts: pa.Array) -> pa.Array:
    x = document_statistics(texts)
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


@dataclass
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the covariance, half its log determinant."""

    center: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        z, logs = (x - self.center) / self.scale, []
        for prior, mean, factor, half in self.classes:
            d = np.linalg.solve(factor, (z - mean).T)
            logs.append(prior - half - 0.5 * np.einsum("ij,ij->j", d, d))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(features: DataFrame, label: str = "label", shrinkage: float = 0.2, ridge: float = 0.05) -> Discriminant | float:
    """``features`` has ``x`` and a 0/1 label.  Without both classes the share of label 1 (1.0 if no label) is the score."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.asarray(b.column(1).to_numpy(zero_copy_only=False))
            x = np.stack(b.column(0).to_numpy(zero_copy_only=False)) if len(y) else np.zeros((0, 1))
            for c in (0, 1):
                v = x[y == c]
                if len(v):
                    flat = np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c, np.int32)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["c", "i", "v"])

    sums = features.where(F.col(label).isin(0, 1)).select("x", F.col(label).cast("int")).mapInArrow(moments, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")).collect()
    d = len(STATISTICS)
    m = np.zeros((2, 1 + d + d * d))
    for r in sums:
        m[r.c, r.i] = r.v
    n = m[:, 0]
    if not n.all():
        return float(n[1] / n.sum()) if n.sum() else 1.0
    total = m.sum(0)
    center = total[1 : 1 + d] / total[0]
    scale = np.sqrt(np.maximum(np.diag(total[1 + d :].reshape(d, d)) / total[0] - center**2, 1e-6))
    classes = []
    for c in (0, 1):
        mean = m[c, 1 : 1 + d] / n[c]
        cov = m[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean, mean)
        cov = cov / np.outer(scale, scale)
        cov = (1 - shrinkage) * cov + shrinkage * np.diag(np.diag(cov)) + ridge * np.eye(d)
        factor = np.linalg.cholesky(cov)
        classes.append((float(np.log(n[c] / n.sum())), (mean - center) / scale, factor, float(np.log(np.diag(factor)).sum())))
    return Discriminant(center, scale, classes)


def score_column(model: Discriminant | float, x: Column) -> Column:
    if isinstance(model, float):
        return F.lit(model)

    @F.arrow_udf(T.DoubleType())
    def score(v: pa.Array) -> pa.Array:
        flat = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        return pa.array(model.scores(flat))

    return score(x)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, label) of the rows to train on: not held out, one row per document, about ``most`` of them if there are more.

    Documents whose labels disagree, and null ids or labels, are left out.  The sample goes by a hash of the id.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").select("doc_id", "label")
    known = materialize(known, "labels")
    n = known.count()
    return known if n <= most else known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(6)), F.lit(1 << 30)) < F.lit(int(most / n * (1 << 30))))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Discriminant | float:
    """The model, fitted on the documents with a label that aren't held out; texts of other documents aren't looked at.

    A bit filter over the labelled ids picks these documents inside the scan, so that no other text moves.
    """
    known = known_labels(labels, most)
    has = BitFilter(known.select(F.xxhash64("doc_id")))
    if not has.size:
        return 1.0

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(has(h.to_numpy()))

    some = docs.where(F.col("doc_id").isNotNull()).where(maybe(F.xxhash64(F.col("doc_id").cast(known.schema["doc_id"].dataType))))
    features = some.select(F.col("doc_id").alias("_id"), statistics_udf("text").alias("x"))
    return fit(features.join(known, F.col("_id") == F.col("doc_id")).select("x", "label"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject; columns unchanged.

    Null and empty texts are scored as texts of no words, rows with a null id like any other, equal rows alike.  Without labels of both
    classes the share of label 1 is every score (1 without any label).  An empty table gives no rows.
    """
    return docs.where(score_column(train(docs, labels), statistics_udf("text")) >= threshold)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score_column(model, statistics_udf("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
