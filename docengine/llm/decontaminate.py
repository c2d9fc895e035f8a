"""Operator 8: benchmark decontamination by template canonicalisation.

Words are reduced to their core, lower-cased and hashed; numbers, names (capitalised inside a sentence) and units (after a
number) become typed placeholders.  Windows of five template words of the benchmark are joined by hash with the windows
of all documents, each match is chained to its best predecessor in both texts (so windows that an item holds twice make
parallel chains), and a chain counts if it covers most of its item, or is long, and
its slots map item values to document values consistently (so re-parameterised questions are caught and
mere look-alikes are not).

Items of equal text are one item.  Document windows pass a bit filter over the benchmark's window hashes inside the scan, of
bounded size whatever the benchmark's; those that pass meet the benchmark's windows in an exact join, by one plan at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BitFilter, RollingHash, drop_rows, materialize, mix64, table, text_slices, words_of

WINDOW = 5
COVERAGE = 0.8
LONG = 20
#: Fixed values.
UNITS = "mm cm m km in ft mi g kg mg t lb oz ml cl l s sec min h hr ms hour hours minute minutes second seconds day days week weeks month months year years percent % dollar dollars euro euros cent cents pound pounds meter meters metre metres mile miles gram grams liter liters litre litres inch inches foot feet degree degrees".split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()

_CORE = np.zeros(256, bool)
_CORE[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ%")] = True
_CORE[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[list(b".,:/%-")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:\"")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
NUM, NAME, UNIT = (np.uint64(x) for x in (1, 2, 3))
KIND_NAMES = ("", "num", "name", "unit")
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def word_hash(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = words_of(data, np.array([0, len(data)]))
    return RollingHash(data)(starts, ends)


class Template:
    """Template words of a run of texts: starts, ends, row, hash of the word, kind of placeholder (0: a literal)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        low = _LOWER[data]
        wide = np.zeros(len(data), bool)
        if len(data) > 1:  # capitals of two-byte Latin letters
            wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
            low[wide] += 32
        starts, ends, row = words_of(data, offs)
        core = np.flatnonzero(_CORE[data])
        if len(core):
            i = np.minimum(np.searchsorted(core, starts), len(core) - 1)
            j = np.maximum(np.searchsorted(core, ends) - 1, 0)
            s, e = core[i], core[j] + 1
            good = (s >= starts) & (s < ends) & (e <= ends) & (e > s)
        else:
            s, e, good = starts, ends, np.zeros(len(starts), bool)
        raw_end = ends[good]
        self.start, self.end, self.row = s[good], e[good], row[good]
        self.hash = RollingHash(low)(self.start, self.end)
        n = len(self.start)
        self.kind = np.zeros(n, np.uint64)
        if not n:
            return
        digits, numeric = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
        np.cumsum(_DIGIT[data], out=digits[1:])
        np.cumsum(_NUMERIC[data], out=numeric[1:])
        number = (digits[self.end] > digits[self.start]) & (numeric[self.end] - numeric[self.start] == self.end - self.start)
        number |= np.isin(self.hash, _number_hashes())
        first = np.ones(n, bool)
        first[1:] = (self.row[1:] != self.row[:-1]) | _STOP[data[raw_end[:-1] - 1]]
        lines = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=lines[1:])
        first[1:] |= lines[self.start[1:]] != lines[raw_end[:-1]]
        head = data[self.start]
        capital = (head >= 65) & (head <= 90)
        nxt = np.minimum(self.start + 1, len(data) - 1)
        capital |= (head == 0xC3) & wide[nxt]
        self.kind[capital & ~first] = NAME
        self.kind[number] = NUM
        after = np.zeros(n, bool)
        after[1:] = number[:-1] & (self.row[1:] == self.row[:-1])
        self.kind[after & ~number & np.isin(self.hash, _unit_hashes())] = UNIT

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, hash, and whether placeholders stand in it, of each window inside one text.

        A window with fewer than three literals (fewer than all, if shorter) is hashed by its words alone.
        """
        n = len(self.start) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        slot = self.kind > 0
        typed, plain, slots = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
        word = np.where(slot, self.kind, self.hash)
        for k in range(width):
            typed += mix64(word[k : k + n] + np.uint64(1)) * _FACTORS[k]
            plain += mix64(self.hash[k : k + n] + np.uint64(1)) * _FACTORS[k]
            slots += slot[k : k + n]
        few = slots > min(2, width - 1)
        h = mix64(np.where(few, plain + np.uint64(7), typed) + np.uint64(width))
        at = np.flatnonzero(self.row[: n] == self.row[width - 1 :])
        return at, h[at], ((slots > 0) & ~few)[at]


_CACHE: dict[str, np.ndarray] = {}


def _number_hashes() -> np.ndarray:
    if "n" not in _CACHE:
        _CACHE["n"] = word_hash(NUMBER_WORDS)
    return _CACHE["n"]


def _unit_hashes() -> np.ndarray:
    if "u" not in _CACHE:
        _CACHE["u"] = word_hash(UNITS)
    return _CACHE["u"]


def template_windows(rows: DataFrame, key: list[str], text: str, widths: list[int] | None, wanted: BitFilter | None) -> DataFrame:
    """(key..., pos, width, n_words, h, slots): windows of the texts; all of them, or those whose hash may be wanted.

    widths None: windows of WINDOW words, or the whole text if it has fewer.
    """
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in key), "pos int, width int, n_words int, h long, slots array<string>"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offs in text_slices(batches, text):
            t = Template(data, offs)
            counts = np.bincount(t.row, minlength=part.num_rows)
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            for width in widths or range(1, WINDOW + 1):
                at, h, slotted = t.windows(width)
                if widths is None and width < WINDOW:
                    whole = counts[t.row[at]] == width
                    at, h, slotted = at[whole], h[whole], slotted[whole]
                if wanted is not None and len(at):
                    hit = wanted(h)
                    at, h, slotted = at[hit], h[hit], slotted[hit]
                if not len(at):
                    continue
                row = t.row[at]
                slots = [[f"{KIND_NAMES[int(t.kind[i])]}:{bytes(data[t.start[i] : t.end[i]]).decode('utf-8', 'replace')}" for i in range(a, a + width) if t.kind[i]] if s else [] for a, s in zip(at, slotted, strict=True)]
                cols = [part.column(part.schema.get_field_index(k)).take(pa.array(row)) for k in key]
                cols += [pa.array((at - first[row]).astype(np.int32)), pa.array(np.full(len(at), width, np.int32)), pa.array(counts[row].astype(np.int32)), pa.array(h.view(np.int64)), pa.array(slots, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=[*key, "pos", "width", "n_words", "h", "slots"])

    return rows.select(*key, text).mapInArrow(emit, schema)


BEST = T.StructType([T.StructField("covered", T.IntegerType()), T.StructField("coverage", T.DoubleType()), T.StructField("start_word", T.IntegerType()), T.StructField("end_word", T.IntegerType()), T.StructField("same_slots", T.BooleanType())])


def item_chains(matches: list[tuple[int, int, int, list[str], list[str]]]) -> list[tuple[int, int, int, bool, bool]]:
    """Matches (pos, ipos, width, item's slots, document's slots) of one item in one text -> its chains.

    Returns (covered, first word, end word, are the slots consistent, are they the same).  Each match follows the one with most
    words covered, less the words by which the two texts move apart; a chain moves on in both texts at every step.
    """
    matches = sorted(matches)
    score, back, low = [0] * len(matches), [-1] * len(matches), 0
    for i, (pos, ipos, width, _, _) in enumerate(matches):
        while matches[low][0] < pos - WINDOW - 8:
            low += 1
        score[i] = width
        for k in range(low, i):
            step, istep = pos - matches[k][0], ipos - matches[k][1]
            if step > 0 < istep and abs(step - istep) <= 8 and (new := score[k] + min(width, istep) - abs(step - istep)) > score[i]:
                score[i], back[i] = new, k
    used, out = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: (-score[i], i)):
        if used[i]:
            continue
        chain, at = [], i
        while at >= 0:
            used[at] = True
            chain.append(matches[at])
            at = back[at]
        covered = chain[0][2] + sum(min(a[2], a[1] - b[1]) for a, b in zip(chain, chain[1:], strict=False))
        pairs = {p for c in chain for p in zip(c[3], c[4], strict=False)}
        out.append((covered, chain[-1][0], chain[0][0] + chain[0][2], len(pairs) == len({a for a, _ in pairs}), all(a == b for a, b in pairs)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, long: int = LONG) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    Returns (doc_id, tag, item_id, n_items, covered, coverage, start_word, end_word, same_slots), one row per item and text of the
    document.  ``item_id`` is the smallest of the ``n_items`` rows with the item's text.  ``tag`` is Spark's 64-bit hash of the text, so
    rows that share a doc_id are told apart; equal rows count once.  Null and empty texts match nothing; an empty benchmark gives
    an empty result; extra columns are ignored.
    """
    b = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    items = materialize(template_windows(materialize(b, "classes"), ["item_id", "n_items"], "text", None, None), "items")
    widths = sorted(r.width for r in items.select("width").distinct().collect())
    if not widths:
        widths = [WINDOW]
    wanted = BitFilter(items.select("h").distinct())
    rows = docs.select("doc_id", F.xxhash64("text").alias("tag"), "text")
    found = template_windows(rows, ["doc_id", "tag"], "text", widths, wanted).select("doc_id", "tag", "pos", "width", "h", "slots")
    i = items.select("item_id", "n_items", F.col("pos").alias("ipos"), F.col("n_words").alias("iwords"), F.col("h").alias("ih"), F.col("slots").alias("islots"), F.col("width").alias("iwidth"))
    m = found.join(i, (F.col("h") == F.col("ih")) & (F.col("width") == F.col("iwidth"))).dropDuplicates(["doc_id", "tag", "item_id", "pos", "ipos"])
    match = F.struct("pos", "ipos", "width", "islots", "slots")
    g = m.groupBy("doc_id", "tag", "item_id", "n_items").agg(F.max("iwords").alias("iwords"), F.collect_list(match).alias("matches"))
    # So few windows can't cover enough.
    g = g.where(F.size("matches") * WINDOW >= F.least(F.lit(long), coverage * F.col("iwords")))

    @F.arrow_udf(BEST)
    def best(matches: pa.Array, iwords: pa.Array) -> pa.Array:
        out = []
        for k in range(len(matches)):
            found = [(c, c / iwords[k].as_py(), s, e, same) for c, s, e, fits, same in item_chains([tuple(x.values()) for x in matches[k].as_py()]) if fits]
            found = [x for x in found if x[1] >= coverage or x[0] >= long]
            top = max(found, key=lambda x: (x[0], x[4], -x[2], -x[3]), default=None)
            out.append(dict(zip(BEST.names, top, strict=True)) if top else None)
        return pa.array(out, pa.struct([("covered", pa.int32()), ("coverage", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("same_slots", pa.bool_())]))

    found = g.withColumn("best", best("matches", "iwords")).where("best is not null")
    return found.select("doc_id", "tag", "item_id", "n_items", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain a benchmark item; columns unchanged."""
    hit = materialize(contaminated(docs, benchmark).select("doc_id", "tag").distinct(), "leaks")
    return drop_rows(docs, ["doc_id", F.xxhash64("text")], hit)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_items", F.col("covered").cast("long").alias("covered"), F.round("coverage", 6).alias("coverage"), F.col("start_word").cast("long").alias("start_word"), F.col("end_word").cast("long").alias("end_word"), "same_slots").distinct()


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE: dict[str, str] = {}
