"""Search queries: BM25, cosine, fusion, snippets, hydration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import documents as D
from docengine.operators import search as S
from docengine.operators.chunk import chunk_markdown, split_for_speech

from .common import table
from .kept import corpus_index
from .ranking import FRENCH, PHRASE, TOKENS, WORDS, bm25_sql


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_index(spark, sf).search(WORDS, S.pool_size(8), 6)


def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_index(spark, sf).search(WORDS, 24, 6, sources=F.col("source").isin("src1", "src3"))


def bm25_scan(spark: SparkSession, sf: str) -> DataFrame:
    """The same from the texts, for a query that no index was kept for."""
    return S.top(S.bm25(table(spark, sf, "documents"), WORDS, keep=F.col("source").isin("src1", "src3")), 24, 6)


def bm25_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_index(spark, sf).search(PHRASE, 24, 6)


def bm25_folded(spark: SparkSession, sf: str) -> DataFrame:
    return S.top(S.bm25(table(spark, sf, "documents"), FRENCH), 24, 6)


def bm25_index(spark: SparkSession, sf: str) -> DataFrame:
    """The phrase query from the inverted index."""
    return S.top(S.bm25_postings(S.postings(table(spark, sf, "documents")), PHRASE + " " + WORDS), 24, 6)


def postings_terms(spark: SparkSession, sf: str) -> DataFrame:
    p = S.postings(table(spark, sf, "documents")).where("term <> ''")
    return p.groupBy("term").agg(F.count("*").alias("n_docs"), F.sum("tf").alias("n_terms"), F.max(F.size("positions")).cast("long").alias("most"))


def cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return S.semantic_batch(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 8)


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return S.top(S.semantic(e, e.where("vec_id = 7").first()["embedding"]), 24, 6)


def cosine_zero_norm(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    zero = F.transform("embedding", lambda x: x * 0)
    return e.select("vec_id", S.cosine(F.col("embedding"), zero).alias("zero"), F.round(S.cosine(F.col("embedding"), F.slice("embedding", 1, 8)), 6).alias("shorter"))


def packed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as bytes and back: their sizes, outer components and what is the same."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", S.pack_vector(F.col("embedding")).alias("b"))
    e = e.withColumn("back", S.unpack_vector(F.col("b")))
    return e.select("vec_id", F.octet_length("b").alias("n_bytes"), F.col("back")[0].alias("head"), F.element_at("back", -1).alias("tail"), F.round(S.cosine(F.col("back"), F.col("embedding")), 6).alias("similarity"))


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return S.rank_fusion([bm25_topk(spark, sf), _semantic(spark, sf)], 24)


def rrf_postfilter(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return S.hydrate(rrf_hybrid(spark, sf), d, keep=F.col("lang") == "en").select("doc_id", "score", "rank").limit(8)


def hydrate_ranked(spark: SparkSession, sf: str) -> DataFrame:
    ranked = bm25_topk(spark, sf)
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return S.hydrate(ranked, d).select("rank", "doc_id", "score", "lang", "source", "quality")


def snippet_window(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), "worthless the tion").alias("snippet"))


def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.last_words(F.col("text"), 60).alias("tail"), F.substring("text", 1, 4000).alias("head"))


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_markdown(table(spark, sf, "documents").select("doc_id", "text"))


def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = chunk_markdown(table(spark, sf, "pages").select("page_id", T.html_to_markdown(F.col("html")).alias("text")))
    return c.groupBy("page_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("heading").alias("heading"))


def speech_parts(spark: SparkSession, sf: str) -> DataFrame:
    return split_for_speech(table(spark, sf, "documents").select("doc_id", "text"))


def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.html_title(F.col("html")).alias("title"), T.html_to_markdown(F.col("html")).alias("markdown"))


def parse_url_ref(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.parse_ref(F.col("url")).alias("r")).select("page_id", "r.provider", "r.label")


def slugs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.slugify(F.col("text")).alias("slug"), T.normalize_key(F.col("text")).alias("key"))


def benchmark_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a whole benchmark item, word for word."""
    return S.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


HINTS = [("alpha", ("the", "/\\bthat\\b/"), (), (), ()), ("beta", ("la ", "/\\bque\\b/"), (), (), ()), ("gamma", ("der", "und"), (), (), ())]


def classify_hints(spark: SparkSession, sf: str) -> DataFrame:
    return D.hint_scores(table(spark, sf, "documents"), HINTS).drop("place")


def classify_gate(spark: SparkSession, sf: str) -> DataFrame:
    return D.classify(D.hint_scores(table(spark, sf, "documents"), HINTS))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_filtered, bm25_scan, bm25_phrase, bm25_folded, bm25_index, postings_terms, cosine_topk, cosine_zero_norm, packed_vectors, rrf_hybrid, rrf_postfilter, hydrate_ranked, snippet_window, estimate_tokens, chunk_rows, chunk_stats, speech_parts, html_to_markdown, parse_url_ref, slugs, benchmark_lookup, classify_hints, classify_gate)}

_COS = "SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q, q)) AS s FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7)"
_BM = bm25_sql(T.query_phrases(WORDS), k=32)
_RRF = f"""WITH l AS ({_BM}),
s AS (SELECT id, CAST(row_number() OVER (ORDER BY round(s, 6) DESC, id) AS INTEGER) AS rank FROM ({_COS}) ORDER BY rank LIMIT 24),
u AS (SELECT id, 1.0::DOUBLE / (60 + rank) AS p, rank AS o FROM l UNION ALL SELECT id, 1.0::DOUBLE / (60 + rank), 1000 + rank FROM s),
g AS (SELECT id, round(sum(p), 9) AS score, min(o) AS o FROM u GROUP BY id),
fused AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, o) AS INTEGER) AS rank FROM g ORDER BY rank LIMIT 24)
"""
_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_MD = "html"
for _p, _n in (
    ("(?s)<!--.*?-->", ""), ("(?is)<script.*?</script>", ""), ("(?is)<style.*?</style>", ""), ("(?is)<noscript.*?</noscript>", ""), ("(?is)<svg.*?</svg>", ""), (r"\r\n?", "\n"),
    (r"(?i)<br\s*/?>", "\n"), ("(?i)</(?:p|div|section|article|tr|li|h[1-6])>", "\n"), *((f"(?i)<h{i}[^>]*>", "\n" + "#" * i + " ") for i in range(1, 7)),
    ("(?i)<li[^>]*>", "- "), ("(?i)<t[dh][^>]*>", " | "), (r'(?is)<a\s[^>]*href="([^"]+)"[^>]*>\s*(.*?)\s*</a>', r"[\2](\1)"),
    ("(?is)<strong>(.*?)</strong>", r"**\1**"), ("(?is)<b>(.*?)</b>", r"**\1**"), ("(?is)<em>(.*?)</em>", r"*\1*"), ("(?is)<i>(.*?)</i>", r"*\1*"), ("(?is)<code[^>]*>(.*?)</code>", r"`\1`"), ("<[^>]+>", ""),
):
    _MD = "regexp_replace(" + _MD + ", '" + _p + "', '" + _n + "', 'g')"
_MD = "replace(replace(" + _MD + ", '&quot;', '\"'), '&amp;', '&')"
_MD = f"array_to_string(list_transform(string_split({_MD}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10))"
_MD = rf"regexp_replace(regexp_replace({_MD}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_HINT = """WITH s AS (SELECT doc_id, lower(substr(text, 1, 6000)) AS t FROM documents),
h AS (SELECT doc_id AS id, 'alpha' AS type, 0 AS place, contains(t, 'the')::INT + 2 * regexp_matches(t, '\\bthat\\b')::INT AS score FROM s
UNION ALL SELECT doc_id, 'beta', 1, contains(t, 'la ')::INT + 2 * regexp_matches(t, '\\bque\\b')::INT FROM s
UNION ALL SELECT doc_id, 'gamma', 2, contains(t, 'der')::INT + contains(t, 'und')::INT FROM s)
"""

ORACLE = {
    "bm25_topk": _BM,
    "bm25_filtered": bm25_sql(T.query_phrases(WORDS), "source IN ('src1', 'src3')"),
    "bm25_scan": bm25_sql(T.query_phrases(WORDS), "source IN ('src1', 'src3')"),
    "bm25_phrase": bm25_sql(T.query_phrases(PHRASE)),
    "bm25_folded": bm25_sql(T.query_phrases(FRENCH)),
    "bm25_index": bm25_sql(T.query_phrases(PHRASE + " " + WORDS)),
    "postings_terms": f"SELECT term, count(*) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_terms, max(tf) AS most FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "cosine_topk": """SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 6) AS score
FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 8""",
    "cosine_zero_norm": "SELECT vec_id, 0.0::DOUBLE AS zero, 1.0::DOUBLE AS shorter FROM embeddings",
    "packed_vectors": "SELECT vec_id, CAST(4 * len(embedding) AS INTEGER) AS n_bytes, embedding[1] AS head, embedding[-1] AS tail, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS similarity FROM embeddings",
    "rrf_hybrid": _RRF + "SELECT id, score, rank FROM fused",
    "rrf_postfilter": _RRF + "SELECT doc_id, score, rank FROM fused JOIN documents ON id = doc_id WHERE lang = 'en' ORDER BY rank LIMIT 8",
    "hydrate_ranked": f"SELECT rank, d.doc_id, score, lang, source, quality FROM ({_BM}) r JOIN documents d ON d.doc_id = r.id LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "snippet_window": f"""WITH f AS (SELECT doc_id, {_FLAT} AS t FROM documents),
p AS (SELECT doc_id, t, coalesce(nullif(strpos(lower(t), 'worthless'), 0), nullif(strpos(lower(t), 'the'), 0), strpos(lower(t), 'tion')) AS place FROM f)
SELECT doc_id, CASE WHEN length(t) <= 320 THEN t WHEN place = 0 THEN substr(t, 1, 320) || '…'
ELSE CASE WHEN place - 1 - 106 > 0 THEN '…' ELSE '' END || substr(t, greatest(place - 1 - 106, 0) + 1, 320) || '…' END AS snippet FROM p""",
    "estimate_tokens": r"SELECT doc_id, CAST(greatest(1, ceil(length(text) / 4)) AS INTEGER) AS tokens, array_to_string(list_slice(regexp_split_to_array(text, '\s+'), greatest(len(regexp_split_to_array(text, '\s+')) - 44, 1), len(regexp_split_to_array(text, '\s+'))), ' ') AS tail, substr(text, 1, 4000) AS head FROM documents",
    "html_to_markdown": f"""WITH p AS (SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, {_MD} AS m FROM pages)
SELECT page_id, title, CASE WHEN title <> '' AND NOT starts_with(m, '# ' || title) THEN '# ' || title || chr(10) || chr(10) || m ELSE m END AS markdown FROM p""",
    "parse_url_ref": r"SELECT page_id, 'url' AS provider, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+[^?#]*/([^/?#]*)', 1), ''), 'download') AS label FROM pages",
    "slugs": r"""WITH h AS (SELECT doc_id, lower(strip_accents(text)) AS h FROM documents)
SELECT doc_id, coalesce(nullif(substr(regexp_replace(regexp_replace(h, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48), ''), 'project') AS slug, regexp_replace(h, '[^a-z0-9]', '', 'g') AS key FROM h""",
    "benchmark_lookup": r"""WITH b AS (SELECT item_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS w FROM benchmark WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
d AS (SELECT doc_id, ' ' || trim(regexp_replace(text, '\s+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, item_id FROM d JOIN b ON contains(t, w)""",
    "classify_hints": _HINT + "SELECT id, type, score FROM h WHERE score > 0",
    "classify_gate": _HINT + """, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS n, count(*) OVER (PARTITION BY id) AS k, lead(score) OVER (PARTITION BY id ORDER BY score DESC, place) AS nxt FROM h WHERE score > 0)
SELECT id, type, score, coalesce(nxt, 0) AS second, k = 1 OR score >= nxt + 2 AS sure FROM r WHERE n = 1""",
}
