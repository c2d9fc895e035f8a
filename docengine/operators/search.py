"""Lexical, semantic and hybrid search.

BM25 needs no inverted index for ad-hoc queries: the query's phrases are counted in folded text (nothing is exploded or
shuffled), corpus statistics are one row, and the result is a distributed top-k.  ``postings`` writes the index for repeated
queries, and ``bm25_postings`` ranks from it.  All ranked lists have columns (id, score, rank).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions.text import fold, query_phrases, snippet, tokens

K1, B = 1.2, 0.75


def pool_size(k: int) -> int:
    return max(4 * k, 24)


_SIGN = r"[\p{L}\p{N}]"


def _count(folded: Column, phrase: list[str]) -> Column:
    """Places of a phrase in folded text, overlapping ones too; texts without its first word aren't searched."""
    whole = rf"(?<!{_SIGN})(?={rf'[^\p{{L}}\p{{N}}]+'.join(phrase)}(?!{_SIGN}))"
    return F.when(F.contains(folded, F.lit(phrase[0])), F.regexp_count(folded, F.lit(whole))).otherwise(0)


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, score) of every document with a phrase of the query; repeated phrases count again.

    ``keep`` filters results only: statistics are those of the whole corpus.  One scan gives the statistics; a second scores the
    documents that hold a word of the query at all.  Nothing is split into arrays, exploded or shuffled.
    """
    phrases = query_phrases(query)
    if not phrases:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    kept = keep if keep is not None else F.lit(True)
    folded = fold(F.coalesce(F.col(text), F.lit("")))
    size = F.regexp_count("_t", F.lit(_SIGN + "+"))
    all_ = docs.select(folded.alias("_t")).select(size.alias("_dl"), *[(_count(F.col("_t"), p) > 0).alias(f"_h{i}") for i, p in enumerate(phrases)])
    stats = all_.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avgdl"), *[F.count_if(F.col(f"_h{i}")).alias(f"_df{i}") for i in range(len(phrases))])
    some = F.lit(False)
    for p in phrases:
        some = some | F.contains("_t", F.lit(p[0]))
    hits = docs.where(kept).select(F.col(id_col).alias("id"), folded.alias("_t")).where(some)
    hits = hits.select("id", size.alias("_dl"), *[_count(F.col("_t"), p).alias(f"_f{i}") for i, p in enumerate(phrases)])
    score, any_hit = F.lit(0.0), F.lit(False)
    for i in range(len(phrases)):
        idf = F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        f = F.col(f"_f{i}")
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl")))
        any_hit = any_hit | (f > 0)
    return hits.where(any_hit).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))  # one row of statistics


def bm25_postings(index: DataFrame, query: str) -> DataFrame:
    """(id, score) as ``bm25``, from a written ``postings`` table: only the rows of the query's terms and one row of statistics are read."""
    phrases = query_phrases(query)
    terms = sorted({t for p in phrases for t in p})
    if not terms:
        return index.select("id", F.lit(0.0).alias("score")).where("false")
    stats = index.where("term = ''").agg(F.count("*").alias("_n"), F.avg("dl").alias("_avgdl"))
    rows = index.where(F.col("term").isin(*terms)).select("id", "term", "dl", "positions")
    per = rows.groupBy("id").agg(F.first("dl").alias("_dl"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("_p"))
    none = F.array().cast("array<int>")
    at = lambda t: F.coalesce(F.try_element_at("_p", F.lit(t)), none)

    def places(phrase: list[str]) -> Column:
        out = at(phrase[0])
        for k, t in enumerate(phrase[1:], 1):
            out = F.array_intersect(out, F.transform(at(t), _back(k)))
        return F.size(out)

    counted = per.select("id", "_dl", *[places(p).alias(f"_f{i}") for i, p in enumerate(phrases)])
    df = counted.agg(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"_df{i}") for i in range(len(phrases))])
    score, any_hit = F.lit(0.0), F.lit(False)
    for i in range(len(phrases)):
        idf = F.ln((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5))
        f = F.col(f"_f{i}")
        score = score + F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl")))
        any_hit = any_hit | (f > 0)
    both = stats.crossJoin(F.broadcast(df))  # one row each
    return counted.where(any_hit).crossJoin(F.broadcast(both)).select("id", score.alias("score"))


def _back(k: int):
    return lambda x: x - k


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", lead: int = 8) -> DataFrame:
    """(id, item): documents that hold all words of an item one after the other, whatever the space between them.

    Runs of ``lead`` words (fewer for shorter items) bring the two together by their hash, without texts; the whole item decides
    about these pairs.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    i = items.select(item_col, flat(text).alias("_item")).where("_item <> ''").withColumn("_w", F.split("_item", " "))
    i = i.withColumn("_n", F.least(F.size("_w"), F.lit(lead))).withColumn("_lead", F.xxhash64(F.array_join(F.slice("_w", F.lit(1), F.col("_n")), " ")))
    sizes = sorted(r[0] for r in i.select("_n").distinct().collect())  # at most ``lead`` numbers
    if not sizes:
        return docs.select(id_col).crossJoin(items.select(item_col)).where("false")
    d = docs.select(id_col, flat(text).alias("_text"))
    runs = [F.transform(F.sequence(F.lit(1), F.greatest(F.size("_v") - n + 1, F.lit(1))), _run(n)) for n in sizes]
    seen = d.select(id_col, F.split("_text", " ").alias("_v")).select(id_col, F.explode(F.array_distinct(F.concat(*runs))).alias("_lead"))
    pairs = seen.join(i.select(item_col, "_item", "_lead"), "_lead").select(id_col, item_col, "_item").distinct()
    return d.join(pairs, id_col).where(F.contains(F.concat(F.lit(" "), "_text", F.lit(" ")), F.concat(F.lit(" "), "_item", F.lit(" ")))).select(id_col, item_col).distinct()


def _run(n: int):
    return lambda at: F.xxhash64(F.array_join(F.slice("_v", at, F.lit(n)), " "))


def top(scored: DataFrame, k: int, digits: int = 12) -> DataFrame:
    """(id, score, rank): the k best of all rows, ties to the smaller id; the window sees k rows."""
    best = scored.select("id", F.round("score", digits).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, id, tf, dl, positions): the inverted index; write it sorted or partitioned by term.

    A row of the empty term for every document keeps its length, for the corpus statistics.
    """
    words = docs.select(F.col(id_col).alias("id"), tokens(F.col(text)).alias("w")).withColumn("dl", F.size("w"))
    each = words.select("id", "dl", F.posexplode("w").alias("pos", "term"))
    got = each.groupBy("term", "id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("pos")).alias("positions"))
    every = words.select(F.lit("").alias("term"), "id", F.lit(0).cast("long").alias("tf"), "dl", F.array().cast("array<int>").alias("positions"))
    return got.select("term", "id", "tf", "dl", "positions").unionByName(every)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where a norm is 0."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    n = F.least(F.size(x), F.size(y))
    x, y = F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n)
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot, nx, ny = add(F.zip_with(x, y, lambda p, q: p * q)), add(F.transform(x, lambda p: p * p)), add(F.transform(y, lambda p: p * p))
    return F.when((nx == 0) | (ny == 0), 0.0).otherwise(dot / F.sqrt(nx) / F.sqrt(ny))


def pack_vector(vector: Column) -> Column:
    """The components as 32-bit floats in little-endian order, one after the other; null stays null."""

    @F.arrow_udf(T.BinaryType())
    def run(rows: pa.Array) -> pa.Array:
        data = rows.flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
        sizes = rows.value_lengths().fill_null(0).to_numpy() * 4
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pc.if_else(rows.is_null(), None, packed)

    return run(vector)


def unpack_vector(content: Column) -> Column:
    """What ``pack_vector`` packed; null, and bytes that aren't whole floats, give null."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(rows: pa.Array) -> pa.Array:
        got = [np.frombuffer(x.as_buffer(), "<f4") if x.is_valid and len(x.as_buffer()) % 4 == 0 else None for x in rows]
        return pa.array(got, pa.list_(pa.float32()))

    return run(content)


def _norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, e: s + e * e))


def semantic(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, score) of all vectors against one query vector, a literal in the plan."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), cosine(F.col(vector), q).alias("score"))


def _angles(rows: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows whose number of components is the pivots', their lengths, their angles to all pivots)."""
    sizes = np.nan_to_num(rows.value_lengths().to_numpy(zero_copy_only=False), nan=-1)
    same = np.flatnonzero(sizes == pivots.shape[1])
    x = rows.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).reshape(len(same), -1)
    n = np.sqrt((x**2).sum(1))
    return same, n, np.arccos(np.clip(x @ pivots.T / np.where(n > 0, n, 1)[:, None], -1, 1))


class CosineCells:
    """Vectors in cells around pivots, for exact cosine search that skips cells.

    A vector is in the cell of the pivot that it makes the least angle with; a cell keeps the largest such angle.  No vector of a cell
    can be nearer to a query than the query's angle to the pivot less the cell's.  Vectors without length, and those of
    another number of components than the pivots, have cells of their own, which are never skipped wrongly: their bound is 0 and 1.

    ``pivots`` bounds what every task gets and what the driver sees: so many vectors, angles and counts.
    """

    NONE, ODD = -1, -2

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", pivots: int = 64, part: int = 16384):
        v = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("_v"))
        first = v.where(F.size("_v") > 0).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(pivots).select("_v").collect()
        width = max((len(r[0]) for r in first), default=0)
        p = np.array([r[0] for r in first if len(r[0]) == width] or np.zeros((0, width)), float)
        self.pivots = p[(p**2).sum(1) > 0] / np.sqrt((p[(p**2).sum(1) > 0] ** 2).sum(1))[:, None]
        self.v, self.vectors, self.part = v.withColumns({"_nv": _norm("_v"), "_c": self._cell("_v")}).select("id", "_v", "_nv", "_c.cell", "_c.angle"), vectors, part
        self.cells = {r.cell: (r.angle, r.n) for r in self.v.groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()}

    def _cell(self, vector: str) -> Column:
        pivots, none, odd = self.pivots, self.NONE, self.ODD

        @F.arrow_udf(T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]))
        def run(rows: pa.Array) -> pa.Array:
            cell, angle = np.full(len(rows), odd, np.int32), np.zeros(len(rows))
            if len(pivots):
                same, n, a = _angles(rows, pivots)
                best = a.argmin(1) if len(same) else np.zeros(0, int)
                cell[same] = np.where(n > 0, best, none)
                angle[same] = np.where(n > 0, a[np.arange(len(same)), best], 0)
            return pa.StructArray.from_arrays([pa.array(cell), pa.array(angle)], ["cell", "angle"])

        return run(F.col(vector))

    def bounds(self, queries: DataFrame) -> DataFrame:
        """(query_id, query_vector, cell, bound): the most that a vector of each cell can score."""
        cells, pivots, odd = sorted(self.cells), self.pivots, self.ODD
        most = np.array([self.cells[c][0] for c in cells])

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def run(rows: pa.Array) -> pa.Array:
            out = np.ones((len(rows), len(cells)))
            if len(pivots):
                same, n, a = _angles(rows, pivots)
                for k, c in enumerate(cells):
                    bound = np.cos(np.maximum(a[:, c] - most[k], 0)) if c >= 0 else np.full(len(same), 1.0 if c == odd else 0.0)
                    out[same, k] = np.where((n > 0) | (c == odd), bound, 0.0)
            return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(cells), out.ravel())

        q = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        named = F.array(*[F.lit(c) for c in cells]) if cells else F.array().cast("array<int>")
        each = q.select("query_id", "query_vector", F.explode(F.arrays_zip(named.alias("cell"), run("query_vector").alias("bound"))).alias("x"))
        return each.select("query_id", "query_vector", "x.cell", "x.bound")

    def scored(self, asked: DataFrame) -> DataFrame:
        """(query_id, id, score) of (query_id, query_vector, cell) with the cell's vectors; large cells are met in parts."""
        parts = F.lit(1)
        for c, (_, n) in self.cells.items():
            if n > self.part:
                parts = F.when(F.col("cell") == c, -(-n // self.part)).otherwise(parts)
        v = self.v.withColumn("_part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        q = asked.withColumn("_nq", _norm("query_vector")).withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        pairs = v.join(q, ["cell", "_part"]).where(F.col("id") != F.col("query_id"))
        # Norms are worked out once per vector; only vectors of unequal lengths go the long way.
        same = F.size("_v") == F.size("query_vector")
        dot = F.aggregate(F.zip_with("_v", "query_vector", lambda p, q: p * q), F.lit(0.0), lambda s, e: s + e)
        near = F.when((F.col("_nv") == 0) | (F.col("_nq") == 0), 0.0).otherwise(dot / F.col("_nv") / F.col("_nq"))
        return pairs.select("query_id", "id", F.round(F.when(same, near).otherwise(cosine(F.col("_v"), F.col("query_vector"))), 6).alias("score"))

    def open_cells(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, query_vector, cell): cells that can hold one of the k best of a query."""
        bounds = self.bounds(queries)
        # The cell with the highest bound is searched first; its k-th score is a floor of the k-th of all.
        best = W.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
        first = bounds.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "bound")
        floor = _best(self.scored(first), k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))
        # Scores are rounded to six digits: what rounds to the floor stays.
        return bounds.join(floor, "query_id", "left").where(F.col("_floor").isNull() | (F.col("bound") >= F.col("_floor") - 2e-6)).drop("bound", "_floor")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def semantic_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 16384, pivots: int = 64) -> DataFrame:
    """(query_id, id, score, rank): k best for each of a stated set of queries (query_id, query_vector), one row per query.

    Exact: cells of vectors are left out by a bound on their cosine.  A query and the cells left meet by shuffle, in parts of about
    ``block`` vectors.  One plan at every size.
    """
    cells = CosineCells(vectors, id_col, vector, pivots, block)
    return _best(cells.scored(cells.open_cells(queries, k)), k)


def rank_fusion(lists: list[DataFrame], limit: int, constant: int = 60, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (id, rank); ties to the list, then the place, where an id was first seen."""
    seen = None
    for i, ranked in enumerate(lists):
        part = ranked.select("id", (1.0 / (F.col("rank") + constant)).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank").alias("place")).alias("first"))
        seen = part if seen is None else seen.unionByName(part)
    fused = seen.groupBy("id").agg(F.round(F.sum("part"), digits).alias("score"), F.min("first").alias("first"))
    best = fused.orderBy(F.desc("score"), "first").limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "first"))).drop("first")


def hydrate(ranked: DataFrame, chunks: DataFrame, query: str | None = None, id_col: str = "doc_id", text: str = "text", keep: Column | None = None) -> DataFrame:
    """Ranked ids with their rows, in rank order; ids without a row go; ``keep`` filters after ranking."""
    few = ranked.withColumnRenamed("rank", "_rank")  # a pool of rows: its size, not a hint, makes it the broadcast side
    out = chunks.join(few, chunks[id_col] == few["id"]).drop("id")
    if keep is not None:
        out = out.where(keep)
    if query is not None:
        out = out.withColumn("snippet", snippet(F.col(text), query))
    return out.orderBy("_rank").withColumnRenamed("_rank", "rank")


def hybrid(chunks: DataFrame, query: str, query_vector: list[float] | None, k: int = 8, id_col: str = "doc_id", text: str = "text", vector: str = "embedding", sources: Column | None = None, keep: Column | None = None) -> DataFrame:
    """Lexical and semantic pools, fused, hydrated and filtered; without vectors the lexical list alone."""
    pool = pool_size(k)
    lists = [top(bm25(chunks, query, id_col, text, sources), pool)]
    if query_vector is not None:
        rows = chunks if sources is None else chunks.where(sources)
        lists.append(top(semantic(rows, query_vector, id_col, vector), pool))
    return hydrate(rank_fusion(lists, pool), chunks, query, id_col, text, keep).limit(k)


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], text: str = "text", batch: int = 16) -> DataFrame:
    """Add ``embedding`` by an injected model, ``batch`` texts a call; a wrong number of vectors is an error."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            rows = s.fillna("").tolist()
            out: list[list[float]] = []
            for i in range(0, len(rows), batch):
                got = model(rows[i : i + batch])
                if len(got) != len(rows[i : i + batch]):
                    raise ValueError("the model returned another number of vectors")
                out += got
            yield pd.Series(out)

    return texts.withColumn("embedding", run(F.col(text)))


def rerank(hits: DataFrame, query: str, scorer: Callable[[str, list[str]], list[float]], text: str = "text", pool: int = 64) -> DataFrame:
    """Order the first ``pool`` hits by an injected scorer; if it fails or gives a wrong number of scores the order stays.

    The pool is taken by rank first (a distributed top-k), so that one task sees no more than that.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [p for p in parts if len(p)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values("rank")
        if len(rows) > 1:
            try:
                scores = scorer(query, rows[text].fillna("").tolist())
                if len(scores) == len(rows):
                    rows["score"] = [float(x) for x in scores]
                    rows = rows.sort_values(["score", "rank"], ascending=[False, True])
                    rows["rank"] = range(1, len(rows) + 1)
            except Exception:  # noqa: BLE001 - a failing scorer must not fail the search
                pass
        yield rows

    return hits.orderBy("rank").limit(pool).repartition(1).mapInPandas(run, hits.schema)
