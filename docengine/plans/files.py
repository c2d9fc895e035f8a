"""Queries of file kinds, delimited text, model headers, cascades and injected models on made-up contents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.operators import catalog as C
from docengine.operators import documents as D
from docengine.operators import library as L
from docengine.operators import search as S
from docengine.sources import files as files_
from docengine.streaming import streams

from .common import table
from .library import _of, _pick

#: First bytes in hex, extension -> kind.
_FILES = {
    ("255044462D312E34", "xlsx"): "pdf", ("504B03040000776F72642F646F63756D656E742E786D6C", "zip"): "docx", ("504B0304786C2F776F726B626F6F6B2E786D6C", "bin"): "xlsx", ("504B03047070742F736C696465732F736C696465312E786D6C", "x"): "pptx", ("504B0304AA", "docx"): "archive",
    ("494433040000", "txt"): "audio", ("524946460000000057415645", "bin"): "audio", ("524946460000000057454250", "x"): "image", ("524946460000000041564920", "x"): "video", ("4F676753", "x"): "audio", ("0000001866747970", "m4a"): "audio", ("0000001866747970", "mp4"): "video", ("1A45DFA3", "x"): "video",
    ("89504E470D0A1A0A", "txt"): "image", ("FFD8FF", "x"): "image", ("68656C6C6F20776F726C64", "md"): "text", ("3C68746D6C3E3C626F64793E", "txt"): "html", ("613B620A313B32", "txt"): "csv", ("46726F6D3A20610A0A74657874", "txt"): "eml", ("2020", "x"): "unknown", ("6F6E65206C696E65", "csv"): "csv",
}


def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", files_.file_kind(F.unhex(_pick(k, *(h for h, _ in _FILES))), _pick(k, *(e for _, e in _FILES))).alias("kind"))


def decoded_text(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", files_.decode_text(F.unhex(_pick(k, "C3A7C3A36F", "E7E36F", "EFBBBF6162", ""))).alias("text"))


_LINES = ("a;b;c\n1;2;3", "a,b\n1,2\n", "a\tb\n1\t2", "x|y|z\n1|2|3", "one line", "a;b\n1,2", "")


def delimiters(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", _pick(F.col("p_partkey"), *_LINES).alias("t"))
    return p.select("p_partkey", T.guess_delimiter(F.col("t")).alias("sep"), T.looks_tabular(F.col("t")).alias("tabular"))


def text_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    """The separator that each document and page would be read with, and whether it looks like a table."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    d = d.unionByName(table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("t")))
    o = table(spark, sf, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat_ws("\n", F.lit("key;who"), F.concat_ws(";", "o_orderkey", "o_custkey"), F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, "|").otherwise(";"), "o_orderpriority")).alias("t"))
    return d.unionByName(o).select("id", T.guess_delimiter(F.col("t")).alias("sep"), T.looks_tabular(F.col("t")).alias("tabular"))


def csv_markdown(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("name;key;more\r\n"), "n_name", F.lit(";"), F.col("n_nationkey"), F.lit("\n;;\np|q;")).alias("t"))
    return n.select("n_nationkey", files_.delimited_markdown(F.col("t"), T.guess_delimiter(F.col("t"))).alias("markdown"))


def column_refs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 702
    letter = lambda n: F.chr(n.cast("long") + 65)
    ref = F.concat(F.when(k >= 26, letter(F.floor(k / 26) - 1)).otherwise(""), letter(k % 26), F.lit("12"))
    return table(spark, sf, "part").select("p_partkey", T.column_index(ref).alias("column"))


_TENSORS = {
    ("model.diffusion_model.a", "conditioner.embedders.1.x"): ("image", "main", "sdxl"), ("model.diffusion_model.a", "first_stage_model.b"): ("image", "main", "sd1"), ("double_blocks.0.img", "txt_in.x"): ("image", "diffusion", "flux"), ("blocks.3.ffn.0", "patch_embedding.w"): ("video", "diffusion", "wan"),
    ("encoder.conv_in.w", "decoder.mid.x"): ("image", "vae", "vae"), ("encoder.block.0.layer.1", "shared.weight"): ("image", "text_encoder", "t5"), ("text_model.encoder.layers.0", "x"): ("image", "text_encoder", "clip"), ("model.layers.0.self_attn.q", "x"): ("text", "main", "transformers"),
    ("lora_unet_x", "alpha"): ("image", "lora", "lora"), ("control_model.x", "y"): ("image", "controlnet", "controlnet"), ("encoder.0.x", "quantizer.codebook"): ("tts", "vae", "codec"), ("nothing", "known"): (None, "unknown", None),
}


def tensor_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    names = F.array(_pick(k, *(a for a, _ in _TENSORS)), _pick(k, *(b for _, b in _TENSORS)))
    return table(spark, sf, "part").select("p_partkey", C.classify_tensors(names).alias("k")).select("p_partkey", "k.kind", "k.role", "k.arch")


#: Architecture, file type, name -> kind, role, quantisation, parameters, whether it sees.
_GGUF = {
    ("llama", "15", "X 8B.gguf"): ("text", "main", "Q4_K_M", 8_000_000_000, False), ("bert", "7", "e.gguf"): ("embeddings", "main", "Q8_0", None, False), ("flux", "2", "f-0.6b.gguf"): ("image", "diffusion", "Q4_0", 600_000_000, False), ("t5", "99", "t.gguf"): ("image", "text_encoder", "ft99", None, False),
    ("whisper", "1", "w.gguf"): ("speech", "main", "F16", None, False), ("qwen2vl", "18", "got-ocr.gguf"): ("ocr", "main", "Q6_K", None, True), ("llama", "30", "my-rerank.gguf"): ("rerank", "main", "IQ4_XS", None, False), ("clip", "1", "mmproj-a.gguf"): ("vision", "mmproj", "F16", None, True),
}


def gguf_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    values = F.create_map(F.lit("general.architecture"), quoted(_pick(k, *(a for a, _, _ in _GGUF))), F.lit("general.file_type"), _pick(k, *(t for _, t, _ in _GGUF)))
    return table(spark, sf, "part").select("p_partkey", C.classify_gguf(values, _pick(k, *(n for _, _, n in _GGUF))).alias("k")).select("p_partkey", "k.kind", "k.role", "k.quant", "k.params", "k.vision")


def topic_events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.topics(table(spark, sf, "events"), "view, error", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    o, li = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "key"), table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "key")
    left = D.delete_cascade(o.where("o_orderstatus = 'F'"), "key", o, li)
    return left[0].select(F.lit("orders").alias("kept"), "key").unionAll(left[1].select(F.lit("lines"), "key")).groupBy("kept").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The injected model gives a text's length and its number of spaces."""
    e = S.embed(table(spark, sf, "documents").select("doc_id", "text"), lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts])
    return e.select("doc_id", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("spaces"))


def rerank_hits(spark: SparkSession, sf: str) -> DataFrame:
    """The injected scorer prefers long texts; one that fails leaves the order."""
    hits = table(spark, sf, "documents").select("doc_id", "text", F.lit(0.0).alias("score"), F.col("doc_id").cast("int").alias("rank"))
    good = S.rerank(hits, "q", lambda _, texts: [float(len(t)) for t in texts], pool=20).select("doc_id", "rank", F.lit("good").alias("scorer"))
    return good.unionAll(S.rerank(hits, "q", lambda _, texts: [1.0], pool=20).select("doc_id", "rank", F.lit("bad")))


def hybrid_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Without a query vector the lexical list alone ranks."""
    from .ranking import WORDS

    return S.hybrid(table(spark, sf, "documents"), WORDS, None, 5).select("doc_id", "rank")


def download_parts(spark: SparkSession, sf: str) -> DataFrame:
    from docengine.operators.records import parallel_parts

    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", parallel_parts(F.when(k % 7 > 0, k * 3_000_000), k % 3 > 0, 6).alias("parts"))


def speech_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Names of languages and shown sizes together, as a library lists them."""
    k = F.col("p_partkey")
    names = table(spark, sf, "part").select("p_partkey", L.language_from_name(_pick(k, "a-pt_PT", "b.es", "c")).alias("language"), T.params_from_name(_pick(k, "m-7b-q", "m-1.5B", "none")).alias("params"), T.quant_from_name(_pick(k, "x-Q5_K_M.gguf", "x-fp8.bin", "x")).alias("quant"))
    return names


QUERIES = {f.__name__: f for f in (file_kinds, decoded_text, delimiters, text_delimiters, csv_markdown, column_refs, tensor_kinds, gguf_kinds, topic_events, delete_cascade, embed_texts, rerank_hits, hybrid_lexical, download_parts, speech_numbers)}


def _cols(values, names: tuple[str, ...], cast: dict[str, str] | None = None) -> str:
    rows = list(values)
    return ", ".join(f"CAST({_of('p_partkey', *(str(r[i]).lower() if isinstance(r[i], bool) else r[i] for r in rows))} AS {(cast or {}).get(n, 'VARCHAR')}) AS {n}" for i, n in enumerate(names))


def _lexical() -> str:
    from .ranking import WORDS, bm25_sql

    return f"SELECT id AS doc_id, rank FROM ({bm25_sql(T.query_phrases(WORDS), k=5)})"


ORACLE = {
    "hybrid_lexical": _lexical(),
    "file_kinds": f"SELECT p_partkey, {_of('p_partkey', *_FILES.values())} AS kind FROM part",
    "decoded_text": f"SELECT p_partkey, {_of('p_partkey', 'ção', 'ção', 'ab', '')} AS text FROM part",
    "text_delimiters": """WITH t AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages
UNION ALL SELECT 'o' || o_orderkey, 'key;who' || chr(10) || o_orderkey || ';' || o_custkey || chr(10) || o_orderstatus || CASE WHEN o_orderkey % 3 = 0 THEN '|' ELSE ';' END || o_orderpriority FROM orders),
h AS (SELECT id, t, array_to_string(list_slice(string_split_regex(t, '\\r?\\n'), 1, 5), chr(10)) AS h, list_slice(list_filter(string_split_regex(t, '\\r?\\n'), lambda x: trim(x) <> ''), 1, 5) AS f FROM t),
n AS (SELECT *, length(h) - length(replace(h, ',', '')) AS a, length(h) - length(replace(h, ';', '')) AS b, length(h) - length(replace(h, chr(9), '')) AS c, length(h) - length(replace(h, '|', '')) AS d,
list_transform([',', ';', chr(9)], lambda s: list_transform(f, lambda x: length(x) - length(replace(x, s, '')))) AS per FROM h)
SELECT id, CASE greatest(a, b, c, d) WHEN 0 THEN ',' WHEN a THEN ',' WHEN b THEN ';' WHEN c THEN chr(9) WHEN d THEN '|' ELSE ',' END AS sep,
coalesce(len(f) >= 2 AND len(list_filter(per, lambda p: list_min(p) = list_max(p) AND list_min(p) >= 1)) > 0, false) AS tabular FROM n""",
    "delimiters": "SELECT p_partkey, ([';', ',', chr(9), '|', ',', ',', ','])[p_partkey % 7 + 1] AS sep, p_partkey % 7 < 3 AS tabular FROM part",
    "csv_markdown": "SELECT n_nationkey, '| name | key | more |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || n_name || ' | ' || n_nationkey || ' |  |' || chr(10) || '| p\\|q |  |  |' AS markdown FROM nation",
    "column_refs": "SELECT p_partkey, CAST(p_partkey % 702 AS INTEGER) AS \"column\" FROM part",
    "tensor_kinds": f"SELECT p_partkey, {_cols(_TENSORS.values(), ('kind', 'role', 'arch'))} FROM part",
    "gguf_kinds": f"SELECT p_partkey, {_cols(_GGUF.values(), ('kind', 'role', 'quant', 'params', 'vision'), {'params': 'BIGINT', 'vision': 'BOOLEAN'})} FROM part",
    "topic_events": "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'error') GROUP BY 1",
    "delete_cascade": """SELECT 'orders' AS kept, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT 'lines', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
    "embed_texts": "SELECT doc_id, length(coalesce(text, '')) AS chars, length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS spaces FROM documents",
    "rerank_hits": "SELECT doc_id, CAST(row_number() OVER (ORDER BY length(text) DESC, doc_id) AS INTEGER) AS rank, 'good' AS scorer FROM documents WHERE doc_id < 20 UNION ALL SELECT doc_id, CAST(doc_id AS INTEGER), 'bad' FROM documents WHERE doc_id < 20",
    "download_parts": "SELECT p_partkey, CAST(CASE WHEN p_partkey % 7 = 0 OR p_partkey % 3 = 0 OR p_partkey * 3000000 < 67108864 THEN 1 ELSE greatest(2, least(6, ceil(p_partkey * 3000000 / 33554432.0))) END AS INTEGER) AS parts FROM part",
    "speech_numbers": f"SELECT p_partkey, {_of('p_partkey', 'pt-PT', 'es', 'und')} AS language, {_of('p_partkey', 7_000_000_000, 1_500_000_000, None)} AS params, {_of('p_partkey', 'Q5_K_M', 'fp8', None)} AS quant FROM part",
}
