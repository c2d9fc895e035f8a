"""Operator 12: ranked lexical search over postings bucketed by term, with whole-number scores.

Documents are split into terms in Arrow batches; every document gives a posting for each of its terms and one row of its length.
Postings are written bucketed by term (a frequent term is spread over the files of its bucket).  Items' terms join them by term,
each match is scored in whole numbers, matches are summed by item and document, and a window takes the first documents of each
item.  For the sum, postings are dealt by document, so that a document's matches meet in one task and are summed where they arise;
only an item's first documents of each task move on.

An index for stated items needs only the terms that they hold: a bit filter of bounded size keeps the others from being written.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BitFilter, materialize, shared_dir, strings, table

K = 10
BUCKETS = 64
#: Parts that the postings of one term are spread over inside its bucket.
SPREAD = 32
#: Most (item, term) rows that are sent to all tasks; beyond, they meet the postings by a shuffle of both.
SENT = 200_000
#: Fixed value: a term is a run of ASCII letters, digits and all other signs beyond ASCII (in UTF-8: bytes from 0x80).
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Terms whose answer by the filter a worker remembers.
KNOWN = 1 << 18


def terms_of(text: str) -> list[bytes]:
    """Terms of a text with repeats; only A-Z is lower-cased."""
    return TERM.findall(text.encode().lower())


def item_terms(items: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term): the distinct terms of each item; rows that share an id, null too, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, t.decode()) for i, s in enumerate(strings(b.column(1))) for t in set(terms_of(s))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.string())], names=["item_id", "term"])

    rows = items.select(F.col(f"`{item}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term string").distinct()


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", only: DataFrame | None = None) -> DataFrame:
    """(bucket, term, row, doc_id, tf, n) as a written table partitioned by bucket.

    A posting for each distinct term of a row, and in bucket -1 one of the empty term for each row with terms at all; ``n`` counts a
    row's terms with repeats.  ``row`` numbers the rows of ``docs``: rows that share an id, or are equal, are documents of their own.
    Null and empty texts have no terms and no posting.  ``only`` (term) bounds the index to terms that will be asked for.
    """
    has = None if only is None else BitFilter(only.select(F.xxhash64(F.col("term").cast("binary"))).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        known: dict[bytes, bool] = {}

        def rows(ids: pa.Array, at: list[int], terms: list[bytes], tf: list[int], n: list[int], nos: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(nos, pa.int64()), ids.take(pa.array(at, pa.int64())), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], names=["term", "row", "doc_id", "tf", "n"])

        for b in batches:
            ids, at, terms, tf, n, nos = b.column(0), [], [], [], [], []
            for i, s in enumerate(strings(b.column(1))):
                count = Counter(terms_of(s))
                if count:
                    new = [t for t in count if t not in known] if has else []
                    if new:
                        if len(known) > KNOWN:
                            known.clear()
                            new = list(count)
                        hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in new], np.uint64).view(np.int64)
                        known.update(zip(new, has(hashes).tolist(), strict=True))
                    held = [t for t in count if known[t]] if has else list(count)
                    size = count.total()
                    terms += [b"", *held]
                    tf += [0, *map(count.__getitem__, held)]
                    for col, v in ((at, i), (n, size), (nos, row)):
                        col += [v] * (len(held) + 1)
                row += 1
                if len(terms) > 100_000:
                    yield rows(ids, at, terms, tf, n, nos)
                    at, terms, tf, n, nos = [], [], [], [], []
            yield rows(ids, at, terms, tf, n, nos)

    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = rows.mapInArrow(run, f"term string, row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, tf long, n long")
    bucket = F.when(F.col("term") == "", -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    found = found.select(bucket.alias("bucket"), "term", "row", "doc_id", "tf", "n")
    path = f"{shared_dir(docs.sparkSession)}/postings-{uuid.uuid4().hex}"
    found.repartition("bucket", F.pmod(F.xxhash64("row"), F.lit(SPREAD))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
    schema = found.select("term", "row", "doc_id", "tf", "n", "bucket").schema
    return docs.sparkSession.read.schema(schema).parquet(path)


def rank(index: DataFrame, asked: DataFrame, k: int = K, sent: int = SENT) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ties to the smaller doc_id, null last.

    ``index`` is a table of ``postings``, ``asked`` has (item_id, term).  Fewer documents give all there are; an item without terms
    that documents hold has no rows, and so has an empty index.
    """
    size = index.where("bucket = -1").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    if not size.N:
        return asked.join(index, "term").select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score")).where("false")
    asked = materialize(asked.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")), "asked")
    held = index.where("bucket >= 0")
    df = held.groupBy("bucket", "term").agg(F.count("*").alias("df")).join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")
    weight = F.floor(1000 * F.ln((2 * F.lit(size.N) + 2) / (2 * F.col("df") + 1)))
    weighted = materialize(asked.join(df, ["bucket", "term"]).select("item_id", "term", weight.alias("w")).where("w > 0"), "weights")
    long = F.expr(f"10 + (90L * n * {size.N}L) div {size.L}L")
    matches = held.select("term", "row", "doc_id", "tf", long.alias("m")).select("term", "row", "doc_id", F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)").alias("part"))
    if weighted.count() <= sent:
        matches = matches.repartition("row").join(F.broadcast(weighted), "term")  # the size is checked above
    else:
        matches = matches.join(weighted, "term")
    scores = matches.groupBy("item_id", "row", "doc_id").agg(F.sum(F.col("w") * F.col("part")).alias("score")).where("score > 0")
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return scores.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = materialize(item_terms(table(spark, sf_dir, "benchmark")), "items")
    return rank(postings(table(spark, sf_dir, "documents"), only=asked), asked)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
c AS (SELECT count(*) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM d WHERE len(ws) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
f AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term, big_n),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + ((90 * n * big_n) // big_l))))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

QUERIES = {"op12_ranked": op12_ranked}
ORACLE = {"op12_ranked": OP12_SQL}
