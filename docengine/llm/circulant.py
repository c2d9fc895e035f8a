"""Operator 13: MinHash near-dedup with circulant signatures, banding and exact verification.

Two permutations of the 64-bit shingle hashes give all coordinates of a signature: the first scatters the shingles, the second, its
places shifted circularly by k, orders them for coordinate k, whose value is the least place.  Both are bijections modulo 2**64.

Texts of equal shingle sets (told by a digest of 128 bits over the sorted set) are one class.  Classes whose signatures agree in
all rows of a band meet in a bucket.  Whether two classes link is always decided by their full sets of shingles:

1. Every class is verified against the first class of each of its buckets, which joins families of near copies without their pairs.
2. Buckets that still hold several components are searched whole.  Members of the first class's component never meet each other,
   only members of others: both are dealt by hash into parts of bounded size, and parts meet in cells.  In a cell the signatures
   choose the pairs of different components that are compared by their sets, and a spanning forest of links leaves it, not the pairs.

Sets are made only for classes that share a bucket, from their texts, which are found through a bit filter of bounded size.

A pair at the threshold shares no bucket with a probability of 4e-7, and its signatures fall below ``AGREE`` with one of 1e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, RollingHash, array_slices, connected_components, materialize, mix64, table, words_of

SHINGLE = 3
#: Similarity of two sets that links them, in hundredths.
PERCENT = 85
#: Rows of a band and bands; a signature has as many coordinates as their product.
ROWS, BANDS = 4, 20
#: Least share of equal coordinates of a pair whose sets are compared: six deviations below the threshold.
AGREE = 0.6
#: Members of a part.
PART = 512

_ODD = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def first_permutation(x: np.ndarray) -> np.ndarray:
    return mix64(x ^ np.uint64(_ODD[1]))


def second_permutation(x: np.ndarray) -> np.ndarray:
    return mix64(x ^ np.uint64(_ODD[2]))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first place of each, hashes): distinct shingle hashes of each text, ascending; texts without words are left out."""
    for first, _, data, offs in array_slices(texts):
        lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, row = words_of(lower, offs)
        if not len(starts):
            continue
        word = RollingHash(lower)(starts, ends)
        count = np.bincount(row, minlength=len(offs) - 1)
        at = np.concatenate([[0], np.cumsum(count)[:-1]])
        h = np.zeros(len(word), np.uint64)
        for i in range(min(shingle, len(word))):  # the hash of the words so far, then one more; it also knows how many they are
            h[: len(word) - i] = mix64(h[: len(word) - i] * np.uint64(_ODD[0]) + word[i:] + np.uint64(i + 1))
        whole = np.arange(len(word)) - at[row] <= np.maximum(count[row] - shingle, 0)
        for r in np.flatnonzero((count > 0) & (count < shingle)).tolist():  # the whole sequence
            x = np.zeros(1, np.uint64)
            for i in range(count[r]):
                x = mix64(x * np.uint64(_ODD[0]) + word[at[r] + i : at[r] + i + 1] + np.uint64(i + 1))
            h[at[r]] = x[0]
        h, row = h[whole], row[whole]
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
        h, row = h[new], row[new]
        begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        yield first + row[begin], begin, h


def signatures(at: np.ndarray, h: np.ndarray, size: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash of each run of hashes, by run and coordinate."""
    scattered = first_permutation(h)
    out = np.empty((len(at), size), np.uint64)
    for k in range(size):
        out[:, k] = np.minimum.reduceat(second_permutation(scattered + np.uint64(k)), at)
    return out


def _digests(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two longs."""
    ends = np.append(at[1:], len(h)).tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(h[s:e], digest_size=16).digest() for s, e in zip(at.tolist(), ends, strict=True)), np.int64).reshape(-1, 2)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (row, key, n, d1, d2, bands, signature); without words n is 0 and the rest null."""
    base = TaskContext.get().partitionId() << 33
    for b in batches:
        done = 0
        key = b.column(0)

        def bare(first: int, end: int, key: pa.Array = key, base: int = base) -> pa.RecordBatch:
            none = lambda t: pa.nulls(end - first, t)
            return pa.RecordBatch.from_arrays([pa.array(np.arange(base + first, base + end)), key.slice(first, end - first), pa.array(np.zeros(end - first, np.int64)), none(pa.int64()), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.binary())], names=NAMES)

        for rows, at, h in shingle_sets(b.column(1)):
            s = signatures(at, h)
            bands = np.zeros((len(at), BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix64(bands * np.uint64(_ODD[3]) + s[:, i::ROWS])
            d = _digests(at, h)
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * BANDS, bands.view(np.int64).ravel())
            low = np.ascontiguousarray(s.astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(base + rows), key.take(pa.array(rows)), pa.array(np.diff(np.append(at, len(h)))), pa.array(d[:, 0]), pa.array(d[:, 1]), lists, pa.array([x.tobytes() for x in low], pa.binary())], names=NAMES)
            skipped = np.setdiff1d(np.arange(done, rows[-1] + 1), rows)
            for r in skipped.tolist():
                yield bare(r, r + 1)
            done = int(rows[-1]) + 1
        if done < b.num_rows:
            yield bare(done, b.num_rows)
        base += b.num_rows


NAMES = ["row", "key", "n", "d1", "d2", "bands", "signature"]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (d1, d2, set)."""
    for b in batches:
        for _, at, h in shingle_sets(b.column(0)):
            d, raw = _digests(at, h), h.tobytes()
            ends = np.append(at[1:], len(h))
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([raw[8 * s : 8 * e] for s, e in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["d1", "d2", "shingles"])


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two ascending arrays of distinct hashes have that Jaccard similarity."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    both = np.searchsorted(large, small)
    same = int((large[np.minimum(both, len(large) - 1)] == small).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


@F.arrow_udf(T.BooleanType())
def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    view = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
    return pa.array([similar(view(x), view(y)) for x, y in zip(a, b, strict=True)], pa.bool_())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link them."""
    left, right = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(_linked("_a", "_b")).select("a", "b")


def cell_links(node: np.ndarray, comp: np.ndarray, sig: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links between members of different components."""
    label = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    sizes, out = np.array([len(s) for s in sets]), []
    for i in range(1, len(node)):
        near = (100 * np.minimum(sizes[:i], sizes[i]) >= PERCENT * np.maximum(sizes[:i], sizes[i])) & (comp[:i] != comp[i])
        j = np.flatnonzero(near)
        if len(j):
            j = j[(sig[j] == sig[i]).mean(1) >= AGREE]
        for other in j.tolist():
            x, y = root(int(comp[i])), root(int(comp[other]))
            if x != y and similar(sets[i], sets[other]):
                label[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[other])))
    return out


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, comp, signature, shingles) in order of cells -> (a, b)."""
    cell, held = None, []

    def links() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("shingles")]
        sig = np.frombuffer(b"".join(x.as_py() for x in t.column("signature")), np.uint8).reshape(-1, ROWS * BANDS)
        found = cell_links(t.column("node").to_numpy(), t.column("comp").to_numpy(), sig, raw)
        return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for b in batches:
        key = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
        for s, e in zip(cuts, [*cuts[1:], len(key)], strict=False):
            if key[s] != cell:
                if held:
                    yield links()
                cell, held = key[s], []
            held.append(b.slice(s, e - s))
    if held:
        yield links()


def _dealt(open_: DataFrame, part: int) -> DataFrame:
    """(bucket, node, comp, side) -> (cell, node, comp): members of side 1 meet those of both sides, those of side 0 only side 1."""
    size = open_.groupBy("bucket").agg(F.ceil(F.count_if(F.col("side") == 0) / part).cast("int").alias("p0"), F.ceil(F.count_if(F.col("side") == 1) / part).cast("int").alias("p1"))
    d = open_.join(size, "bucket").withColumn("own", F.pmod(F.xxhash64("node", F.lit(13)), F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cell = lambda kind, x, y: F.xxhash64("bucket", F.lit(kind), x, y)
    across = F.when(F.col("side") == 0, F.transform(upto("p1"), lambda o: cell(0, F.col("own"), o))).otherwise(F.transform(upto("p0"), lambda o: cell(0, o, F.col("own"))))
    within = F.when((F.col("side") == 1) & (F.col("p1") > 1), F.transform(upto("p1"), lambda o: cell(1, F.least(F.col("own"), o), F.greatest(F.col("own"), o)))).otherwise(F.array().cast("array<long>"))
    return d.select(F.explode(F.concat(across, within)).alias("cell"), "node", "comp")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", part: int = PART) -> DataFrame:
    """(key, n_shingles, component): the number of distinct shingles and the smallest key reachable over links, for every row.

    Sets of shingles link at a Jaccard similarity of ``PERCENT`` hundredths.  A text of fewer words than a shingle is one shingle; one
    without words, or null, has none and is linked with nothing.  Equal texts always link.  Rows with a null key link too, but name a
    component only where it has no other key; rows that share a key are documents of their own.  Very long texts are taken whole.
    Extra columns are ignored; an empty table gives no rows.
    """
    kind = docs.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = materialize(source.mapInArrow(_scan, f"row long, key {kind}, n long, d1 long, d2 long, bands array<long>, signature binary"), "signatures")
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("node"), F.min("key").alias("least"))
    classes = materialize(classes, "classes")

    heads = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi")
    banded = heads.select(F.col("row").alias("node"), F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("center")).where("size > 1").select("bucket", "center")
    members = materialize(banded.join(shared, "bucket").select("bucket", "node", "center"), "members")

    picked = members.select("node").distinct().join(classes, "node")
    picked = materialize(picked.select("node", "d1", "d2", "least"), "picked")
    has = BitFilter(picked.select(F.xxhash64("least")).distinct())

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        return pa.array(has(h.to_numpy()))

    made = source.where(maybe(F.xxhash64("key"))).select("text").mapInArrow(_sets, "d1 long, d2 long, shingles binary")
    sets = materialize(made.join(picked.select("d1", "d2", "node"), ["d1", "d2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")

    sizes = heads.select(F.col("row").alias("node"), "n")
    pairs = members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    pairs = pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "_na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "_nb"}), "b")
    links = materialize(_verified(pairs.where(100 * F.least("_na", "_nb") >= PERCENT * F.greatest("_na", "_nb")).select("a", "b"), sets), "links")
    first = materialize(connected_components(links), "components")

    named = members.join(first, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("bucket").agg(F.min("comp").alias("_l"), F.max("comp").alias("_g")).where("_l <> _g").select("bucket")
    home = first.select(F.col("node").alias("center"), F.col("component").alias("home"))
    open_ = named.join(mixed, "bucket").join(home, "center", "left")
    open_ = materialize(open_.select("bucket", "node", "comp", (F.col("comp") != F.coalesce("home", "center")).cast("int").alias("side")), "open")
    full = sets.join(heads.select(F.col("row").alias("node"), "signature"), "node")
    cells = _dealt(open_, part).join(full, "node").select("cell", "node", "comp", "signature", "shingles")
    more = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_search, "a long, b long"), "more")
    found = first
    if not more.isEmpty():
        found = materialize(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more)), "components")

    rooted = classes.join(found, "node", "left").select("d1", "d2", "least", F.coalesce("component", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("d1", "d2", "component")
    linked = rows.where("n > 0").select("key", "n", "d1", "d2").join(named, ["d1", "d2"]).select("key", "n", "component")
    out = linked.unionAll(rows.where("n = 0").select("key", "n", F.col("key").alias("component")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose key names their component, with all their columns; keys are taken as unique."""
    kept = near_duplicates(docs, key, text).where(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, F.col(f"`{key}`").eqNullSafe(F.col("_kept")), "left_semi")


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 85 * (nx.n + ny.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op13_minhash": op13_minhash}
ORACLE = {"op13_minhash": OP13_SQL}
