"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a table.  Batches sent to Python are bounded by rows and bytes, so that long texts don't pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The application's folder under ``spark.checkpoint.dir``, which driver and executors share.

    Where the session names no such folder, a local session gets a temporary one (tests); on a cluster that would lose data,
    so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/docengine-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = getattr(spark, "_docengine_shared", None)
    if made is None:
        made = "file://" + tempfile.mkdtemp(prefix="docengine-")
        spark._docengine_shared = made
    return made


def clear_shared(spark: SparkSession) -> None:
    """Delete the tables that this application has written by ``materialize``, once their results have been read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most bits of a membership filter: 16 MB, whatever the size of the data.
FILTER_BITS = 1 << 27


class BitFilter:
    """Membership of 64-bit hashes in a set, with false alarms but no misses; its size follows the set's up to ``FILTER_BITS``.

    The bits are set by Spark, chunk by chunk; the driver puts the chunks together, 16 MB at most whatever the data.
    """

    SHIFTS = (0, 18, 37)

    def __init__(self, hashes: DataFrame):
        """``hashes`` has one long column of well-mixed values."""
        name = f"`{hashes.columns[0]}`"
        self.size = hashes.count()
        bits = min(FILTER_BITS, max(1 << 16, 1 << (12 * self.size).bit_length()))
        self.mask, self.bits = bits - 1, np.zeros(bits // 8, np.uint8)
        if self.size:
            places = F.array(*[F.shiftrightunsigned(name, s).bitwiseAND(F.lit(self.mask)) + 1 for s in self.SHIFTS])
            at = hashes.select(F.explode(places).alias("at"))
            for r in at.groupBy(F.bitmap_bucket_number("at").alias("chunk")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect():
                self.bits[(r.chunk - 1) * 4096 : r.chunk * 4096] = np.frombuffer(r.bits, np.uint8)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        hit, h = np.ones(len(h), bool), h.view(np.uint64)
        for s in self.SHIFTS:
            at = (h >> np.uint64(s)) & np.uint64(self.mask)
            hit &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1) > 0
        return hit


def drop_rows(rows: DataFrame, ident: list[str | Column], gone: DataFrame) -> DataFrame:
    """``rows`` without those whose ``ident`` equals (null-safe) a row of ``gone``, which has as many columns.

    Wide rows hardly move: a bit filter of bounded size over ``gone`` lets the rows through that can't be in it, and only the rest
    (those in ``gone`` and a few more, or all once ``gone`` outgrows the filter) goes through the exact join.
    """

    def mark(cols: list[Column]) -> Column:
        return F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])

    has = BitFilter(gone.select(mark([F.col(f"`{c}`") for c in gone.columns])))
    if not has.size:
        return rows

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(has(h.to_numpy()))

    cols = [F.col(f"`{i}`") if isinstance(i, str) else i for i in ident]
    seen = maybe(mark(cols))
    right = gone.select(*[F.col(f"`{c}`").alias(f"_gone_{k}") for k, c in enumerate(gone.columns)]).distinct()
    same = F.lit(True)
    for k, c in enumerate(cols):
        same = same & c.eqNullSafe(F.col(f"_gone_{k}"))
    return rows.where(~seen).unionByName(rows.where(seen).join(right.hint("merge"), same, "left_anti"))


def array_slices(col: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole rows holding about ``max_bytes``.

    Yields (first row, end row, bytes, offsets): the UTF-8 bytes of the run as one uint8 array and its
    row offsets.  Nulls count as empty.  A longer text makes a run of its own.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    start = 0
    while start < len(col):
        end = int(np.searchsorted(offs, offs[start] + max_bytes, "right")) - 1
        end = min(max(start + 1, end), len(col))
        yield start, end, data[offs[start] : offs[end]], offs[start : end + 1] - offs[start]
        start = end


def strings(col: pa.Array, rows: int = 256) -> Iterator[str]:
    """The texts of an array as Python strings, a few at a time; null is empty."""
    for start in range(0, len(col), rows):
        for text in col.slice(start, rows).to_pylist():
            yield text or ""


def text_groups(col: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The same in lists of about so many characters."""
    held, size = [], 0
    for text in strings(col, 64):
        held.append(text)
        size += len(text)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def text_slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same over record batches: yields (rows of the run, bytes, offsets)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        for start, end, data, offs in array_slices(col, max_bytes):
            yield batch.slice(start, end - start), data, offs


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public-domain constants)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, np.uint64)
_INVERSE = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; grown by doubling and kept per worker."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(size, np.uint64)
            p[0], k = 1, 1
            while k < size:
                np.multiply(p[:k], np.uint64(pow(base, k, 1 << 64)), out=p[k : 2 * k])
                k *= 2
            out.append(p)
        _POWERS, _INVERSE = out
    return _POWERS[:n], _INVERSE[:n]


class RollingHash:
    """64-bit polynomial hashes of any substring of a byte array, all by vector operations."""

    def __init__(self, data: np.ndarray):
        p, self.inverse = _powers(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=self.prefix[1:])

    def __call__(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix64((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of non-space bytes; runs end at row borders."""
    ink = ~IS_SPACE[data]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    first[inner] = ink[inner]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    before = inner[inner > 0] - 1
    last[before] = ink[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph, by alternating large-star and small-star rounds.

    ``edges`` has long columns a and b.  Returns (node, component): every node that occurs in an edge, with
    the smallest node reachable.  Each round is two group-bys and joins, written to the shared folder;
    hubs are reduced by partial aggregation and the join with them can be split by adaptive execution.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.select("a", "b") if not large else e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        joined = near.join(least, "a")
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        return materialize(out.where("a > b").distinct(), "star")

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges")
    before = None
    while True:
        e = star(star(e, True), False)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
