"""Operator 2: SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints of whole texts are computed in Arrow batches; equal fingerprints collapse to one row before anything is shuffled.

Upper nodes of the index are masked bit patterns: the 64 bits are cut into six fields, and fingerprints that differ
in at most four bits agree on at least two fields, so each fingerprint goes to the 15 nodes that fix a
pair of fields and every link lies under some node.  Inside a node, fingerprints are sorted by Gray rank (neighbours in
that order differ little) and factored further into runs of runs; each run keeps the AND and OR of its members.
Two runs are compared by the bits that are constant in both and differ: beyond four the whole pair of groups is
pruned, and if even their varying bits together keep within four, one link joins them all.  What survives is
split until single fingerprints meet.  A node keeps a spanning forest of its links, never all pairs.

A node with more than ``NODE`` fingerprints (hot patterns, say a huge family of near copies) is dealt by hash into parts,
and each pair of parts is handled as a node of its own, so that no task holds an unbounded group and no link is lost.  With
more than eight times that, the bits that the node leaves open are cut into six fields first and the nodes below it, which fix
two of these as well, take its place: 15 rows a fingerprint whatever the node's size, so large inputs don't grow by pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import array_slices, connected_components, drop_rows, materialize, mix64, table

SHINGLE = 4
DISTANCE = 4
NODE = 4096
RUN = 8


def shingle_hashes(texts: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, first hash of each, hashes) of runs of texts; texts without words are left out."""
    digest = xxhash.xxh64_intdigest
    for first, _, data, offs in array_slices(texts):
        raw = data.tobytes().lower()
        hashes: list[int] = []
        rows, sizes = [], []
        for i in range(len(offs) - 1):
            words = raw[offs[i] : offs[i + 1]].split()
            if not words:
                continue
            joined = b" ".join(words)
            if len(words) <= shingle:
                new = [digest(joined, 42)]
            else:
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                starts = np.concatenate([[0], ends[:-shingle]]).tolist()
                new = [digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
            hashes += new
            rows.append(first + i)
            sizes.append(len(new))
        if rows:
            yield np.array(rows), np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.array(hashes, np.uint64)


def majority(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that are 1 in over half of them."""
    out, n = np.zeros(len(at), np.uint64), np.diff(np.append(at, len(h)))
    for b in range(64):
        ones = np.add.reduceat(((h >> np.uint64(b)) & np.uint64(1)).astype(np.int32), at)
        out |= np.where(2 * ones > n, np.uint64(1) << np.uint64(b), np.uint64(0))
    return out


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit SimHash of each text, as uint64; texts without words have zero."""
    out = np.zeros(len(texts), np.uint64)
    for rows, at, h in shingle_hashes(texts, shingle):
        out[rows] = majority(h, at)
    return out


def sketches(texts: pa.Array, shingle: int, lanes: int) -> np.ndarray:
    """The same over ``lanes`` hashes of the distinct shingles: a longer SimHash, by text and lane."""
    out = np.zeros((len(texts), lanes), np.uint64)
    for rows, at, h in shingle_hashes(texts, shingle):
        run = np.repeat(np.arange(len(rows)), np.diff(np.append(at, len(h))))
        order = np.lexsort((h, run))
        run, h = run[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (run[1:] != run[:-1]) | (h[1:] != h[:-1])
        run, h = run[new], h[new]
        at = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        for k in range(lanes):
            out[rows, k] = majority(mix64(h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))), at)
    return out


@F.arrow_udf(T.LongType())
def fingerprint_udf(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints(texts).view(np.int64))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each pattern in the reflected Gray order."""
    r = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class Forest:
    """Components of local nodes under links, kept as smallest-member labels."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        up = self.label[i]
        while True:
            nxt = self.label[up]
            if (nxt == up).all():
                return up
            up = nxt

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.find(a), self.find(b)
            apart = x != y
            if not apart.any():
                break
            a, b = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
            np.minimum.at(self.label, a, b)
        every = np.arange(len(self.label))
        self.label = self.find(every)


def node_links(fp: np.ndarray, side: np.ndarray | None, distance: int = DISTANCE) -> np.ndarray:
    """Component label (index of a member) of each fingerprint of one node.

    ``fp`` is distinct and in Gray order, one number or a row of several each.  With ``side`` (0/1) only links between the sides are
    needed, others may be found too.
    """
    fp = fp.reshape(len(fp), -1)
    forest = Forest(len(fp))
    lows, highs, spans = [fp], [fp], [np.ones(len(fp), np.int64)]
    while len(lows[-1]) > 1:
        at = np.arange(0, len(lows[-1]), RUN)
        lows.append(np.bitwise_and.reduceat(lows[-1], at, 0))
        highs.append(np.bitwise_or.reduceat(highs[-1], at, 0))
        spans.append(np.add.reduceat(spans[-1], at))
    firsts = [np.concatenate([[0], np.cumsum(s)[:-1]]) for s in spans]
    top = len(lows) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, a, b = stack.pop()
        low, high = lows[level], highs[level]
        apart = np.bitwise_count((low[a] & ~high[b]) | (low[b] & ~high[a])).sum(1, dtype=np.int32)
        near = apart <= distance
        a, b = a[near], b[near]
        if not len(a):
            continue
        first = firsts[level]
        if level == 0:
            forest.link(a, b)
            continue
        loose = np.bitwise_count((high[a] | high[b]) & ~(low[a] & low[b])).sum(1, dtype=np.int32)
        tight = loose <= distance
        if tight.any():  # all members of both runs are within the distance of each other
            size = spans[level]
            for i, j in zip(a[tight], b[tight], strict=True):
                members = np.concatenate([np.arange(first[i], first[i] + size[i]), np.arange(first[j], first[j] + size[j])])
                forest.link(members[1:], np.full(len(members) - 1, members[0]))
            a, b = a[~tight], b[~tight]
        # A pair of groups that already is one component needs no further look.
        if len(a):
            lab, size = forest.label, spans[level]
            lo, hi = np.minimum.reduceat(lab, first), np.maximum.reduceat(lab, first)
            done = (lo[a] == hi[a]) & (lo[b] == hi[b]) & (lo[a] == lo[b]) & (size[a] > 1)
            a, b = a[~done], b[~done]
        below = len(lows[level - 1])
        for start in range(0, len(a), 4096):
            x, y = a[start : start + 4096], b[start : start + 4096]
            cx = (x[:, None] * RUN + np.arange(RUN))[:, :, None]
            cy = (y[:, None] * RUN + np.arange(RUN))[:, None, :]
            cx, cy = np.broadcast_arrays(cx, cy)
            ok = (cx < below) & (cy < below) & (cx <= cy)
            if level == 1:
                ok &= cx < cy
            stack.append((level - 1, cx[ok], cy[ok]))
    return forest.find(np.arange(len(fp)))


def _fields(bits: list[int]) -> list[int]:
    """Six masks that share the given bit places out among them."""
    cuts = [round(k * len(bits) / 6) for k in range(7)]
    return [sum(1 << b for b in bits[s:e]) for s, e in zip(cuts, cuts[1:], strict=False)]


def _pairs(masks: list[int]) -> list[int]:
    return [masks[i] | masks[j] for i in range(len(masks)) for j in range(i + 1, len(masks))]


#: Masks of the upper nodes, and below each the masks of the nodes that fix two fields of the bits left open.
PATTERNS = _pairs(_fields(list(range(63, -1, -1))))
BELOW = [_pairs(_fields([b for b in range(63, -1, -1) if not m >> b & 1])) for m in PATTERNS]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masked(masks: list[int]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for k, m in enumerate(masks)])


def _deal(keyed: DataFrame, node: int, counts: DataFrame) -> DataFrame:
    """(node, fp) -> (node, fp, side): nodes as they are, and those with more than ``node`` fingerprints by pairs of parts."""
    big = counts.where(F.col("size") > node).select("node", F.ceil(F.col("size") / (node // 2)).cast("int").alias("parts"))
    small = keyed.join(counts.where(F.col("size") <= node).select("node"), "node").select("node", "fp", F.lit(0).alias("side"))
    hot = keyed.join(big, "node").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return small.unionAll(hot.select(pair.alias("node"), "fp", (F.col("own") > F.col("other")).cast("int").alias("side")))


def fingerprint_links(distinct: DataFrame, node: int = NODE) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b): links that span each component under every node."""
    keyed = distinct.select("fp", F.explode(_masked(PATTERNS)).alias("n")).select("fp", "n.k", F.xxhash64("n.k", "n.bits").alias("node"))
    counts = materialize(keyed.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "nodes")
    # Far too many for pairs of parts: the same again on the bits that the node leaves open, 15 rows a fingerprint.
    deep = counts.where(F.col("size") > 8 * node).select("node")
    under = F.element_at(F.array(*[_masked(m) for m in BELOW]), F.col("k") + 1)
    lower = keyed.join(deep, "node").select("fp", "node", F.explode(under).alias("n")).select("fp", F.xxhash64("node", "n.k", "n.bits").alias("node"))
    lower_counts = materialize(lower.groupBy("node").agg(F.count("*").alias("size")).where("size > 1"), "nodes")
    dealt = _deal(keyed.select("fp", "node"), node, counts.where(F.col("size") <= 8 * node)).unionAll(_deal(lower, node, lower_counts))
    dealt = dealt.repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_node, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((gray_rank(fp), key))
            key, fp = key[order], fp[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([at, [len(key)]]))
            a, b = [], []
            two = at[sizes == 2]  # most nodes by far
            close = np.bitwise_count(fp[two] ^ fp[two + 1]) <= DISTANCE
            a.append(fp[two[close]])
            b.append(fp[two[close] + 1])
            for s, n in zip(at[sizes > 2], sizes[sizes > 2], strict=True):
                part = fp[s : s + n]
                label = node_links(part, None)
                off = label != np.arange(n)
                a.append(part[off])
                b.append(part[label[off]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_node, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield links(key[:cut], fp[:cut])
            held_node, held_fp = key[cut:], fp[cut:]
        if len(held_node):
            yield links(held_node, held_fp)

    return dealt.select("node", "fp").mapInArrow(run, "a long, b long")


def _members(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of every row and (c_fp, root) of every distinct fingerprint."""
    prints = materialize(docs.select(key, fingerprint_udf(F.col(text)).alias("fp")), "prints")
    classes = materialize(prints.select("fp").distinct(), "classes")
    return prints, _rooted(classes, fingerprint_links(classes))


def _rooted(classes: DataFrame, links: DataFrame) -> DataFrame:
    found = materialize(connected_components(links), "components")
    return materialize(classes.join(found, classes["fp"] == found["node"], "left").select(F.col("fp").alias("c_fp"), F.coalesce("component", "fp").alias("root")), "members")


#: Of the stage that drops near-duplicates: words of a shingle, similarity of two texts' shingles, 64-bit lanes of the longer SimHash.
STAGE_SHINGLE, SIMILARITY, LANES = 5, 0.8, 4
#: Masks of an upper node there and bits that each fixes; a pair at the similarity shares a node with a probability of 0.7, one at 0.9 of 0.98.
MASKS, MASK_BITS = 32, 20
SAMPLE = 64


def stage_distance(similarity: float = SIMILARITY, bits: int = 64 * LANES) -> int:
    """Bits that differ, as expected, between two texts of that Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _lane_masks() -> list[list[int]]:
    rng = np.random.default_rng(64)
    out = []
    for _ in range(MASKS):
        picked = rng.choice(64 * LANES, MASK_BITS, replace=False).tolist()
        out.append([_signed(sum(1 << b % 64 for b in picked if b // 64 == k)) for k in range(LANES)])
    return out


def sketch_links(distinct: DataFrame, distance: int, node: int = NODE, sample: int = SAMPLE) -> DataFrame:
    """(fp, s array<long>) distinct sketches -> (a, b): links of sketches within the distance that share a node, spanning each component.

    Nodes expected to be hot by a sample are dealt by pairs of parts; the sample decides nothing else.
    """
    nodes = F.array(*[F.xxhash64(F.lit(k), *[F.col("s")[i].bitwiseAND(F.lit(m)) for i, m in enumerate(mask) if m]) for k, mask in enumerate(_lane_masks())])
    keyed = distinct.select("fp", "s", F.explode(nodes).alias("node"))
    some = keyed.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(sample)) == 0)
    heat = some.groupBy("node").agg(F.count("*").alias("seen")).where(F.col("seen") * sample > node // 2)
    heat = materialize(heat.select("node", F.ceil(F.col("seen") * sample / (node // 2)).cast("int").alias("parts")), "heat")
    cold = keyed.join(heat, "node", "left_anti").select("node", "fp", "s")
    hot = keyed.join(heat, "node").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hot = hot.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "fp", "s")
    dealt = cold.unionAll(hot).repartition("node").sortWithinPartitions("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((gray_rank(s[:, 0]), key))
            key, fp, s = key[order], fp[order], s[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(at, len(key)))
            two = at[sizes == 2]
            two = two[np.bitwise_count(s[two] ^ s[two + 1]).sum(1, dtype=np.int32) <= distance]
            a, b = [fp[two]], [fp[two + 1]]
            for start, n in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                label = node_links(s[start : start + n], None, distance)
                off = np.flatnonzero(label != np.arange(n))
                a.append(fp[start + off])
                b.append(fp[start + label[off]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        held: tuple[np.ndarray, ...] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, LANES), np.uint64))
        for batch in batches:
            s = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).reshape(-1, LANES)
            held = tuple(np.concatenate(x) for x in zip(held, (batch.column(0).to_numpy(), batch.column(1).to_numpy(), s), strict=True))
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                yield links(*(x[:cut] for x in held))
                held = tuple(x[cut:] for x in held)
        if len(held[0]):
            yield links(*held)

    return dealt.mapInArrow(run, "a long, b long")


@F.arrow_udf(T.ArrayType(T.LongType()))
def sketch_udf(texts: pa.Array) -> pa.Array:
    x = sketches(texts, STAGE_SHINGLE, LANES).view(np.int64)
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * LANES, x.ravel())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): the fingerprint and the smallest key reachable over links, for every row.

    Null and empty texts have fingerprint zero and link like any other; equal texts share a fingerprint; rows with a null key are
    linked too but never name a component unless alone in it.  Extra columns are ignored; an empty table gives no rows.
    """
    prints, member = _members(docs, key, text)
    least = prints.groupBy("fp").agg(F.min(key).alias("least"))
    roots = materialize(least.join(member, F.col("fp") == F.col("c_fp")).groupBy(F.col("root").alias("r_root")).agg(F.min("least").alias("component")), "roots")
    named = materialize(member.join(roots, F.col("root") == F.col("r_root")).select("c_fp", "component"), "named")
    return prints.join(named, prints["fp"] == named["c_fp"]).select(key, "fp", "component")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: the one with the smallest key (of rows that share it, the one of the least hash of text).

    Texts are near-duplicates if their five-word shingles have a Jaccard similarity of 0.8 or more, as a SimHash of 256 bits tells it
    (the 64 bits of the query's contract can't: they expect ten differing bits there, against four linked).  Upper nodes fix
    20 of the 256 bits; inside them the same Gray order and pruning apply.

    Columns are unchanged.  Equal rows are kept once; a row with a null key stays only if its component has no other key.
    Texts are read but hardly moved: decisions are made on fingerprints, and only rows that go meet the list of what goes.
    """
    prints = docs.select(key, F.xxhash64(text).alias("tag"), sketch_udf(F.col(text)).alias("s"))
    prints = materialize(prints.withColumn("fp", F.xxhash64("s")), "prints")
    classes = materialize(prints.groupBy("fp").agg(F.first("s").alias("s")), "classes")
    member = _rooted(classes.select("fp"), sketch_links(classes, stage_distance()))
    per = prints.groupBy("fp").agg(F.min(F.struct(F.col(key).isNull().alias("z"), F.col(key).alias("k"), F.col("tag").alias("t"))).alias("best"))
    best = per.join(member, F.col("fp") == F.col("c_fp")).groupBy(F.col("root").alias("b_root")).agg(F.min("best").alias("best"))
    best = materialize(best.select("b_root", "best.k", "best.t"), "best")
    every = prints.select(key, "tag", "fp").join(member, F.col("fp") == F.col("c_fp")).join(best, F.col("root") == F.col("b_root"))
    every = materialize(every.select(F.col(key).alias("_key"), F.col("tag").alias("_tag"), (F.col(key).eqNullSafe(F.col("k")) & (F.col("tag") == F.col("t"))).alias("_stays")), "every")
    out = drop_rows(docs, [key, F.xxhash64(text)], materialize(every.where("not _stays").select("_key", "_tag").distinct(), "gone"))
    again = materialize(every.where("_stays").groupBy("_key", "_tag").agg(F.count("*").alias("n")).where("n > 1").select("_key", "_tag"), "again")
    if again.isEmpty():
        return out
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(text) == F.col("_tag"))
    return out.join(again, same, "left_anti").unionByName(out.join(again, same, "left_semi").dropDuplicates([key, text]))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op2_simhash": op2_simhash}
ORACLE: dict[str, str] = {}
