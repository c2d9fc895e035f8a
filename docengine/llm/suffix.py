"""Operator 5: exact removal of repeated 200-byte strings with sharded suffix arrays.

1. Anchors.  In every window of 200 bytes the least hashed 100-gram is its anchor, so equal windows have equal anchors at
   the same place.  A document's windows fall into runs with one anchor each.  Equal runs become one: a run is described by its
   anchor's hash and by a cryptographic digest (BLAKE2b, 96 bits, compared only among runs of one anchor) of its bytes, so
   that thousands of copies don't move their bytes.  A run of an anchor that occurs nowhere else is done; an anchor with one
   distinct run that occurs twice has all its windows repeated; all other anchors go on.
2. Shards.  The bytes of their distinct runs are gathered by anchor.  Each shard gets a suffix array (Larsson-Sadakane:
   doubling, only groups that are still mixed are refined) and Kasai's common prefixes, both in numpy; neighbours that share
   200 bytes are repeated windows.  Bytes decide here, hashes only bring runs together.
3. Merge.  Anchors so common that their runs fill several shards are merged across shards: every shard sends each of its
   distinct windows once, with its bytes, and each is looked up among the sorted windows of the other shards by binary search.
4. The removed intervals meet the texts again, once per document.

Anchors of hot passages are found on a sample of documents beforehand and salted by document; the sample only decides how
rows are dealt, never which rows count.  Texts are treated whole, as bytes; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RollingHash, materialize, table, text_slices

LENGTH = 200
#: Rows of one anchor that may meet in a task, and runs in a shard.
HOT = 4096
SHARD = 2048
#: One document in so many is looked at to find hot anchors.
SAMPLE = 64


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def anchor_runs(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, anchor hash, digest of the bytes under them as long and int) of each run of windows with one anchor."""
    gram = length // 2
    n = len(data)
    none = (*(np.zeros(0, np.int64),) * 5, np.zeros(0, np.int32))
    if n < length:
        return none
    roll = RollingHash(data)
    h = roll(slice(0, n - gram + 1), slice(gram, n + 1))
    low = np.uint64((1 << 28) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= offs[1:][row])
    if not len(at):
        return none
    anchor, r = (least[at] & low).astype(np.int64), row[at]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (r[1:] != r[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    lo, hi, a = at[new], at[last], anchor[new]
    raw, blake = data.tobytes(), hashlib.blake2b
    digests = b"".join([blake(raw[s:e], digest_size=12).digest() for s, e in zip(lo.tolist(), (hi + length).tolist(), strict=True)])
    mark = np.frombuffer(digests, np.dtype([("c", "<i8"), ("d", "<i4")]))
    return r[new], lo - offs[r[new]], hi - lo + 1, h[a].view(np.int64), mark["c"].copy(), mark["d"] ^ (a - lo).astype(np.int32)


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            row, first, count, h, c, d = anchor_runs(data, offs, length)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(first * 65536 + count), pa.array(h), pa.array(c), pa.array(d)], names=["uid", "run", "h", "c", "d"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, run long, h long, c long, d int")


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by keys -> tables that hold whole groups."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        if not t.num_rows:
            continue
        same = np.ones(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            same &= v == v[-1]
        cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield t.slice(0, cut).combine_chunks()
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _starts(*cols: np.ndarray) -> np.ndarray:
    change = np.zeros(len(cols[0]), bool)
    change[:1] = True
    for c in cols:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, salt, c, d) -> those that are repeated or need their bytes compared, with how often their bytes occur here."""
    for t in _whole_groups(batches, ["h", "salt"]):
        h, salt, c, d = (t.column(k).to_numpy() for k in ("h", "salt", "c", "d"))
        at = _starts(h, salt, c, d)
        times = np.diff(np.concatenate([at, [len(h)]]))
        groups = _starts(h[at], salt[at])
        kinds = np.repeat(np.diff(np.concatenate([groups, [len(at)]])), np.diff(np.concatenate([groups, [len(at)]])))
        n = np.repeat(times, times)
        head = np.zeros(len(h), bool)
        head[at] = True
        mixed = np.repeat(kinds > 1, times)
        keep = (n > 1) | mixed | (salt > 0)
        yield pa.RecordBatch.from_arrays([pa.array(t.column(k).to_numpy()[keep]) for k in ("uid", "run", "h", "c", "d", "salt")] + [pa.array(n[keep].astype(np.int64)), pa.array(head[keep]), pa.array(mixed[keep])], names=["uid", "run", "h", "c", "d", "salt", "n", "head", "mixed"])


def suffix_array(data: np.ndarray, words: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement from 8-byte groups (Kasai's bound needs the full order)."""
    n = len(data)
    sa = np.argsort(words[:n], kind="stable")
    k = words[sa]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.repeat(first, size)
    act, h = np.flatnonzero(np.repeat(size, size) > 1), 8
    while len(act):
        suf = sa[act]
        nxt = suf + h
        r2 = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + n + 1, n - suf)  # ended suffixes first, short ones before long
        key = (rank[suf] << 32) | r2
        order = np.argsort(key, kind="stable")
        suf, key = suf[order], key[order]
        sa[act] = suf
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(act)]]))
        rank[suf] = np.repeat(act[first], size)
        act = act[np.repeat(size, size) > 1]
        h *= 2
    return sa


def common_prefixes(sa: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Kasai's common prefix of each suffix with its predecessor in ``sa``, up to ``limit``; by text position.

    All texts of the shard advance together; prefixes are extended eight bytes at a time.
    """
    n = len(sa)
    before = np.empty(n, np.int64)
    before[sa[0]] = -1
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    got = np.zeros(len(starts), np.int64)
    for t in range(int(sizes.max(initial=0))):
        live = int(np.searchsorted(-sizes, -t, "left"))
        i = starts[:live] + t
        j = before[i]
        ok = j >= 0
        same = np.where(ok, np.maximum(got[:live] - 1, 0), 0)
        todo = np.flatnonzero(ok & (same < limit))
        while len(todo):
            x, y = i[todo] + same[todo], j[todo] + same[todo]
            inside = np.maximum(x, y) < n
            diff = np.where(inside, words[np.minimum(x, n)] ^ words[np.minimum(y, n)], np.uint64(1) << np.uint64(63))
            add = np.full(len(todo), 8)
            part = diff != 0
            d = diff[part]
            add[part] = sum((d < np.uint64(1 << b)).astype(np.int64) for b in (8, 16, 24, 32, 40, 48, 56))
            same[todo] += add
            todo = todo[~part & (same[todo] < limit)]
        same = np.minimum(same, n - np.maximum(i, j))  # the padding is not text
        got[:live] = same
        out[i] = same
    return out


def repeated_windows(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, class) of every window of ``length`` bytes of the texts; windows are equal if their class is."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + n + 8] << np.uint64(56 - 8 * k)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    sa = suffix_array(data, words)
    lcp = common_prefixes(sa, words, starts, sizes, length)[sa]
    text = np.repeat(np.arange(len(texts)), sizes)
    whole = starts[text] + sizes[text] - np.arange(n) >= length
    at = np.flatnonzero(whole[sa])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    least = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))
    cls = np.cumsum(np.concatenate([[True], least[1:] < length])) - 1
    return text[sa[at]], sa[at] - starts[text[sa[at]]], cls


def _shards(length: int):
    """mapInArrow: runs with their bytes, sorted by shard -> kind 0: removed intervals; kind 1: windows to merge across shards."""

    def flush(rows: pa.Table) -> pa.RecordBatch:
        texts = rows.column("bytes").to_pylist()
        uid, run, h = (rows.column(k).to_numpy() for k in ("uid", "run", "h"))
        known, split = (rows.column(k).to_numpy() for k in ("known", "split"))
        text, window, cls = repeated_windows(texts, length)
        times = np.bincount(cls)[cls] if len(cls) else cls
        first = run // 65536
        hit = (times > 1) & ~known[text]
        order = np.lexsort((window[hit], text[hit]))
        tx, w = text[hit][order], window[hit][order]
        new = np.flatnonzero(np.concatenate([[True], (tx[1:] != tx[:-1]) | (w[1:] != w[:-1] + 1)])) if len(tx) else np.zeros(0, np.int64)
        end = np.concatenate([new[1:], [len(tx)]])[: len(new)] - 1
        cols = [np.zeros(len(new), np.int32), uid[tx[new]], first[tx[new]] + w[new], first[tx[new]] + w[end] + length, uid[tx[new]], np.zeros(len(new), bool)]
        windows: list[bytes | None] = [None] * len(new)
        if split.any():
            one = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])) if len(cls) else np.zeros(0, np.int64)
            one = one[split[text[one]]]
            data = b"".join(texts)
            base = np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]])
            s = base[text[one]] + window[one]
            mark = RollingHash(np.frombuffer(data, np.uint8))(s, s + length).view(np.int64)
            windows += [data[x : x + length] for x in s.tolist()]
            alone = (times[one] == 1) & ~known[text[one]]
            start = first[text[one]] + window[one]
            more = [np.ones(len(one), np.int32), uid[text[one]], start, start + length, mark, alone]
            cols = [np.concatenate(x) for x in zip(cols, more, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array(windows, pa.binary())], names=["kind", "uid", "start", "end", "mark", "alone", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in _whole_groups(batches, ["h", "part"]):
            held.append(t)
            size += t.get_total_buffer_size()
            if size > 2 << 20:
                yield from _flush_all(held, flush)
                held, size = [], 0
        if held:
            yield from _flush_all(held, flush)

    return run


def _flush_all(held: list[pa.Table], flush) -> Iterator[pa.RecordBatch]:
    t = pa.concat_tables(held).combine_chunks()
    h, part = t.column("h").to_numpy(), t.column("part").to_numpy()
    ends = np.concatenate([_starts(h, part)[1:], [len(h)]])
    start = 0
    while start < len(h):
        end = int(ends[max(np.searchsorted(ends, start + 2 * SHARD, "right") - 1, np.searchsorted(ends, start, "right"))])
        yield flush(t.slice(start, end - start))
        start = end


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of several shards, brought together by mark: those that binary search finds more than once among the sorted are removed."""
    for t in _whole_groups(batches, ["kind", "mark"]):
        kind, alone = (t.column(k).to_numpy() for k in ("kind", "alone"))
        keep = kind == 0
        w = np.flatnonzero(kind == 1)
        if len(w):
            windows = t.column("window").take(pa.array(w)).to_pylist()
            order = sorted(windows)
            keep[w] = [bisect_right(order, x) - bisect_left(order, x) > 1 for x in windows]
            keep[w] &= alone[w]
        t = t.filter(pa.array(keep))
        for b in t.select(["uid", "start", "end"]).to_batches():
            yield b


def _extract(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, "text"):
            raw = data.tobytes()
            cols: list[list] = [[] for _ in range(7)]
            uids, runs = part.column(part.schema.get_field_index("uid")).to_pylist(), part.column(part.schema.get_field_index("runs"))
            for i in range(part.num_rows):
                for r in runs[i].as_py():
                    s = int(offs[i]) + r["run"] // 65536
                    for c, v in zip(cols, (uids[i], r["run"], r["h"], r["part"], r["known"], r["split"], raw[s : s + r["run"] % 65536 - 1 + length]), strict=True):
                        c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["uid", "run", "h", "part", "known", "split", "bytes"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offs in text_slices(batches, "text"):
        spans = part.column(part.schema.get_field_index("spans")).to_pylist()
        uid = part.column(part.schema.get_field_index("uid"))
        size, removed, count, digest = [], [], [], []
        raw = memoryview(data.tobytes())
        for i, found in enumerate(spans):
            text = raw[offs[i] : offs[i + 1]]
            sha, at, gone, n, end = hashlib.sha256(), 0, 0, 0, -1
            for s, e in sorted((x["start"], x["end"]) for x in found or ()):
                if s > end:
                    n += 1
                    sha.update(text[max(at, 0) : s])
                    gone += e - s
                    end = e
                elif e > end:
                    gone += e - end
                    end = e
                at = end
            sha.update(text[at:])
            size.append(len(text))
            removed.append(gone)
            count.append(n)
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([uid, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([[(x["start"], x["end"]) for x in f or ()] for f in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def with_uid(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(uid, doc_id, text): a whole-number doc_id itself where it is a key, else a hash of the row (equal rows share it); whether it is a key everywhere.

    Keys of other types are hashed with their text throughout.
    """
    whole = docs.schema["doc_id"].dataType.typeName() in ("byte", "short", "integer", "long")
    row = F.xxhash64(F.col("doc_id").cast("string"), "text")
    if not whole:
        return docs.select(row.alias("uid"), "doc_id", "text"), False
    again = materialize(docs.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("n")).where("n > 1 or _again is null").select("_again"), "again")
    if again.isEmpty():
        return docs.select(F.col("doc_id").cast("long").alias("uid"), "doc_id", "text"), True
    mark = docs.join(again, docs["doc_id"].eqNullSafe(again["_again"]), "left")
    odd = F.col("_again").isNotNull() | F.col("doc_id").isNull()
    return mark.select(F.when(odd, row).otherwise(F.col("doc_id").cast("long")).alias("uid"), "doc_id", "text"), False


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): what is left of each text without the bytes of repeated strings.

    One row per input row.  Null texts are empty; texts shorter than ``length`` have nothing removed; equal rows each count, so
    their texts are removed; an empty table gives no rows; extra columns are ignored; doc_id may be of any type that casts to
    string, null and repeated too.  ``spans`` are byte intervals that cover the removed bytes, maybe overlapping.
    """
    rows, keyed = with_uid(docs.select("doc_id", "text"))
    texts = rows.select("uid", "text")
    some = _anchors(texts.where(F.pmod(F.xxhash64("uid", F.lit(1)), F.lit(sample)) == 0), length)
    least = max(2, hot // sample // 4)
    heat = materialize(some.groupBy("h").agg(F.count("*").alias("seen")).where(F.col("seen") >= least).select("h", (F.col("seen") * sample / hot + 1).cast("int").alias("parts")), "hot")
    a = _anchors(texts, length).join(heat, "h", "left")
    salt = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("uid", "run"), F.col("parts"))).cast("int")
    a = a.select("uid", "run", "h", "c", "d", salt.alias("salt"))
    judged = a.repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "d").mapInArrow(_judge, "uid long, run long, h long, c long, d int, salt int, n long, head boolean, mixed boolean")
    judged = materialize(judged, "runs")
    interval = [(F.floor(F.col("run") / 65536)).alias("start"), (F.floor(F.col("run") / 65536) + F.col("run") % 65536 - 1 + length).alias("end")]
    plain = judged.where("n > 1").select("uid", *interval)
    # Hot anchors were judged in parts: the parts' distinct runs meet here.
    warm = judged.where("salt > 0 and head")
    met = materialize(warm.groupBy("h", "c", "d").agg(F.sum("n").alias("times"), F.min(F.struct("uid", "run")).alias("at")), "met")
    single = judged.where("salt > 0 and n = 1").select("uid", "run", "h", "c", "d").join(met.where("times > 1").select("h", "c", "d"), ["h", "c", "d"]).select("uid", *interval)
    sizes = materialize(met.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h", F.ceil(F.col("k") / shard).cast("int").alias("parts")), "sizes")
    hot_runs = met.join(sizes, "h").select(F.col("at.uid").alias("uid"), F.col("at.run").alias("run"), "h", F.pmod("c", F.col("parts")).cast("int").alias("part"), (F.col("times") > 1).alias("known"), (F.col("parts") > 1).alias("split"))
    cold_runs = judged.where("salt = 0 and mixed and head").select("uid", "run", "h", F.lit(0).alias("part"), (F.col("n") > 1).alias("known"), F.lit(False).alias("split"))
    wanted = cold_runs.unionAll(hot_runs).groupBy("uid").agg(F.collect_list(F.struct("run", "h", "part", "known", "split")).alias("runs"))
    # The exchange of texts by uid is the same in this join and in the last one, so that Spark writes it once.
    pieces = texts.join(wanted, "uid").mapInArrow(_extract(length), "uid long, run long, h long, part int, known boolean, split boolean, bytes binary")
    shards = pieces.repartition("h", "part").sortWithinPartitions("h", "part").mapInArrow(_shards(length), "kind int, uid long, start long, end long, mark long, alone boolean, window binary")
    merged = shards.repartition("mark").sortWithinPartitions("kind", "mark").mapInArrow(_merge, "uid long, start long, end long")
    spans = plain.unionAll(single).unionAll(merged).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    done = texts.join(spans, "uid", "left").mapInArrow(_apply, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    if rows.schema["doc_id"].dataType == done.schema["uid"].dataType and keyed:
        return done.withColumnRenamed("uid", "doc_id")
    # Equal rows share a uid, and so the same result: each row takes it.
    one = done.dropDuplicates(["uid"])
    return one.join(rows.select("uid", "doc_id"), "uid").drop("uid")


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op5_suffix": op5_suffix}
ORACLE: dict[str, str] = {}
