"""Queries over parts, customers, line items and events: model lookup, devices, voices, providers, patches, JSON in answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import catalog as C
from docengine.streaming import streams

from .common import table


def model_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as a library; suppliers ask by id, file name, start of a name and recipe."""
    p = table(spark, sf, "part")
    role = F.when(F.col("p_size") % 3 == 0, "main").when(F.col("p_size") % 3 == 1, "diffusion").otherwise("vae")
    library = p.select(F.concat(F.lit("m"), "p_partkey").alias("id"), F.concat("p_name", F.lit("-"), "p_partkey", F.lit(".gguf")).alias("filename"), role.alias("role"), F.lower("p_type").alias("recipe"))
    s = table(spark, sf, "supplier").join(p, F.col("s_suppkey") == F.col("p_partkey"))
    kind = F.col("s_suppkey") % 4
    ref = F.when(kind == 0, F.concat(F.lit("m"), "p_partkey")).when(kind == 1, F.concat("p_name", F.lit("-"), "p_partkey", F.lit(".gguf"))).when(kind == 2, F.upper(F.concat("p_name", F.lit("-"), F.substring(F.col("p_partkey").cast("string"), 1, 1)))).otherwise(F.lower("p_type"))
    return C.find_models(s.select(ref.alias("ref")), library)


def _devices(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    vendor = F.element_at(F.array(*[F.lit(v) for v in ("nvidia", "amd", "intel", "other")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    listed = c.select((F.col("c_custkey") % 97).alias("host"), F.col("c_name").alias("name"), vendor.alias("vendor"))
    measured = table(spark, sf, "supplier").select((F.col("s_suppkey") % 97).alias("host"), F.col("s_name").alias("name"), F.lit("nvidia").alias("vendor"))
    return C.merge_devices(measured, listed, "host")


def device_merge(spark: SparkSession, sf: str) -> DataFrame:
    return _devices(spark, sf)


def device_backend(spark: SparkSession, sf: str) -> DataFrame:
    return C.backends(_devices(spark, sf), "host", F.when(F.col("host") % 3 == 0, "windows").when(F.col("host") % 11 == 0, "mac").otherwise("linux"))


def slot_args(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    args = F.array(*[F.lit(a) for a in ("-m", "{model}", "--vae", "{vae}", "--size", "{size}", "-v")])
    slots = F.create_map(F.lit("model"), F.col("p_name"), F.lit("vae"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("size"), F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_size").cast("string")))
    return p.select("p_partkey", F.array_join(C.fill_slots(args, slots), " ").alias("line"))


def voice_pack_kinds(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(a) for a in ("model.onnx", "tokens.txt", "voices.bin", "matcha-a.onnx", "vits-b.onnx", "x.onnx", "README.md")])
    return C.voice_packs(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("dir"), F.element_at(names, (F.col("l_partkey") % 7 + 1).cast("int")).alias("name")))


def _voices(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as speakers of their region's pack; a user voice replaces every third."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    packs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("speakers"))
    packs = packs.select(F.lower("r_name").alias("id"), F.col("r_name").alias("name"), F.concat(F.substring("r_name", 1, 2), F.lit("-XX")).alias("language"), "speakers")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 3 = 0")
    users = both.select(F.concat(F.lower("r_name"), F.lit(":"), F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "-")).alias("id"), F.concat(F.lit("user "), "n_name").alias("name"), F.lit("pt-BR").alias("language"))
    return C.voices(packs, users)


def voice_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return _voices(spark, sf).select("id", "name", "language", "builtin")


def voice_default(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "region").select(F.concat(F.lower(F.substring("r_name", 1, 2)), F.when(F.col("r_regionkey") % 2 == 0, "-xx").otherwise("-yy")).alias("language"), F.lit("none").alias("preferred"))
    return C.default_voices(_voices(spark, sf), wanted)


def provider_split(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    providers = c.select(F.lower("c_mktsegment").alias("id")).distinct().withColumn("enabled", F.when(F.col("id") == "building", False).when(F.col("id") != "machinery", True))
    sep = F.when(F.col("c_custkey") % 3 == 0, ":").when(F.col("c_custkey") % 3 == 1, "/").otherwise("#")
    return C.split_provider(c.select("c_custkey", F.concat("c_mktsegment", sep, "c_name").alias("ref")), providers).select("c_custkey", "provider", "model")


def provider_models(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    models = n.groupBy("n_regionkey").agg(F.collect_list("n_name").alias("models")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    p = models.select(F.lower("r_name").alias("id"), "models", (F.col("r_regionkey") != 4).alias("enabled"), F.when(F.col("r_regionkey") % 2 == 0, "k").alias("key"), F.when(F.col("r_regionkey") == 1, "http://127.0.0.1/v1").otherwise("https://x/v1").alias("url"))
    return C.advertised(p)


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    port = F.when(F.col("o_orderkey") % 5 == 0, "1.5").when(F.col("o_orderkey") % 7 == 0, "null").otherwise((F.col("o_custkey") * 97).cast("string"))
    theme = F.when(F.col("o_orderkey") % 3 == 0, "dark").otherwise("blue")
    patch = F.concat(F.lit('{"server":{"port":'), port, F.lit(',"apiKey":"x"},"ui":{"theme":"'), theme, F.lit('"},"agent":{"enabled":true,"workspace":null,"no":{"such":[1]}},"providers":{"a":{"b":1}}}'))
    return C.flatten_patch(o.select("o_orderkey", patch.alias("patch")), "o_orderkey")


def flatten_settings(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).groupBy("key").agg(F.count("*").alias("n"))


def check_settings(spark: SparkSession, sf: str) -> DataFrame:
    return C.check_patch(_flat(spark, sf)).select("o_orderkey", "key", F.coalesce("problem", F.lit("-")).alias("problem"))


def json_salvage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_id") % 4
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 1, F.concat(F.lit('Sure [1, "}"]: '), "props", F.lit(" } ok"))).when(kind == 2, F.concat(F.lit("{not json} "), "props", F.lit(" [1, {}]"))).otherwise("none")
    return e.select("event_id", C.extract_json(answer).alias("found"))


def gguf_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files of their brand's repository; every tenth is a projector, and line numbers are parts of split files."""
    p = table(spark, sf, "part")
    quant = F.element_at(F.array(*[F.lit(q) for q in ("Q4_K_M", "Q5_K_M", "Q8_0", "IQ1_S")]), F.col("p_size") % 4 + 1)
    key, n = F.col("p_partkey").cast("string"), F.explode(F.sequence(F.lit(1), F.when(F.col("p_partkey") % 10 == 0, 1).otherwise(2)))
    p = p.select("*", n.alias("n"))
    whole = F.concat(F.lit("mmproj-"), F.when(F.col("p_size") % 2 == 0, "F16").otherwise("Q8_0"), F.lit("-"), key, F.lit(".gguf"))
    split = F.concat(F.lit("m"), key, F.lit("-"), quant, F.lit("-0000"), F.col("n").cast("string"), F.lit("-of-00002.gguf"))
    files = p.select(F.concat(F.lit("o/"), F.regexp_replace("p_brand", "#", "-")).alias("repo"), F.when(F.col("p_partkey") % 10 == 0, whole).otherwise(split).alias("path"), (F.col("p_size") * F.col("n")).cast("long").alias("size"))
    return C.plan_gguf(files, F.lit(60))


def recording_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticks of one recording per user; a tick's length is the time since the first hour."""
    e = table(spark, sf, "events")
    total = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6) % 86400
    t = e.withColumn("total", total).withColumn("day", F.to_date("ts")).withColumn("who", F.concat_ws("/", "user_id", "day"))
    return streams.growing_windows(t.withColumn("final", F.lit(False)), "who", "ts", "total", "final", 600.0)


QUERIES = {f.__name__: f for f in (model_lookup, device_merge, device_backend, slot_args, voice_pack_kinds, voice_catalog, voice_default, provider_split, provider_models, flatten_settings, check_settings, json_salvage, gguf_plan, recording_windows)}

_DEVICES = """SELECT s_suppkey % 97 AS host, s_name AS name, 'nvidia' AS vendor FROM supplier UNION ALL
SELECT c_custkey % 97, c_name, ['nvidia', 'amd', 'intel', 'other'][c_custkey % 4 + 1] FROM customer
WHERE (c_custkey % 4 <> 0 OR c_custkey % 97 NOT IN (SELECT s_suppkey % 97 FROM supplier))"""
_VOICES = """SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'user ' || n_name ELSE r_name || ' · ' || n_name END AS name, lower(r_name) || ':' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS id,
CASE WHEN n_nationkey % 3 = 0 THEN 'pt-BR' ELSE substr(r_name, 1, 2) || '-XX' END AS language, n_nationkey % 3 <> 0 AS builtin FROM nation JOIN region ON n_regionkey = r_regionkey"""
ORACLE = {
    "model_lookup": """WITH lib AS (SELECT 'm' || p_partkey AS id, p_name || '-' || p_partkey || '.gguf' AS filename, CASE p_size % 3 WHEN 0 THEN 'main' WHEN 1 THEN 'diffusion' ELSE 'vae' END AS role, lower(p_type) AS recipe FROM part),
refs AS (SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 'm' || p_partkey WHEN 1 THEN p_name || '-' || p_partkey || '.gguf' WHEN 2 THEN upper(p_name || '-' || substr(p_partkey::VARCHAR, 1, 1)) ELSE lower(p_type) END AS ref FROM supplier JOIN part ON s_suppkey = p_partkey),
hit AS (SELECT ref, id, CASE WHEN id = ref THEN 0 WHEN filename = ref THEN 1 WHEN role = 'main' AND starts_with(lower(filename), lower(ref)) THEN 2 WHEN role IN ('main', 'diffusion') AND recipe = ref THEN 3 END AS level FROM refs, lib)
SELECT ref, id, level FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY level, id) AS k FROM hit WHERE level IS NOT NULL) WHERE k = 1""",
    "device_merge": _DEVICES,
    "device_backend": f"""SELECT host, CASE WHEN host % 3 <> 0 AND host % 11 = 0 THEN 'cpu' WHEN bool_or(vendor = 'nvidia') THEN 'cuda' WHEN bool_or(vendor = 'amd') THEN CASE WHEN host % 3 = 0 THEN 'vulkan' ELSE 'rocm' END
WHEN bool_or(vendor = 'intel') THEN 'vulkan' ELSE 'cpu' END AS backend FROM ({_DEVICES}) GROUP BY host""",
    "slot_args": "SELECT p_partkey, '-m ' || p_name || CASE WHEN p_size % 2 = 0 THEN ' --vae ' || p_brand ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '' ELSE ' --size ' || p_size END || ' -v' AS line FROM part",
    "voice_pack_kinds": """WITH f AS (SELECT l_orderkey AS dir, ['model.onnx', 'tokens.txt', 'voices.bin', 'matcha-a.onnx', 'vits-b.onnx', 'x.onnx', 'README.md'][l_partkey % 7 + 1] AS name FROM lineitem),
g AS (SELECT dir, min(name) FILTER (name LIKE '%.onnx') AS a, bool_or(name = 'tokens.txt') AS t, bool_or(name = 'voices.bin') AS v, bool_or(name = 'model.onnx') AS m, bool_or(name = 'matcha-a.onnx') AS ma, bool_or(name = 'vits-b.onnx') AS vi FROM f GROUP BY 1)
SELECT dir, CASE WHEN v THEN 'kokoro' WHEN ma THEN 'matcha' ELSE 'vits' END AS kind, CASE WHEN v THEN CASE WHEN m THEN 'model.onnx' ELSE a END WHEN ma THEN 'matcha-a.onnx' WHEN m THEN 'model.onnx' WHEN vi THEN 'vits-b.onnx' ELSE a END AS model FROM g WHERE t AND a IS NOT NULL""",
    "voice_catalog": f"SELECT id, name, language, builtin FROM ({_VOICES})",
    "voice_default": f"""WITH v AS ({_VOICES}), w AS (SELECT lower(substr(r_name, 1, 2)) || CASE WHEN r_regionkey % 2 = 0 THEN '-xx' ELSE '-yy' END AS language FROM region)
SELECT language, coalesce((SELECT arg_min(id, name) FROM v WHERE lower(v.language) = w.language), (SELECT arg_min(id, name) FROM v WHERE lower(substr(v.language, 1, 2)) = substr(w.language, 1, 2)), (SELECT arg_min(id, name) FROM v)) AS id FROM w""",
    "provider_split": """SELECT c_custkey, CASE WHEN ok THEN lower(c_mktsegment) END AS provider, CASE WHEN ok THEN c_name END AS model FROM (SELECT *, c_custkey % 3 < 2 AND c_mktsegment <> 'BUILDING' AS ok FROM customer)""",
    "provider_models": "SELECT lower(r_name) || ':' || n_name AS id, lower(r_name) AS provider FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4 AND (r_regionkey % 2 = 0 OR r_regionkey = 1)",
    "flatten_settings": "SELECT key, count(*) AS n FROM orders, (SELECT unnest(['server.port', 'server.apiKey', 'ui.theme', 'agent.enabled', 'agent.workspace', 'agent.no.such', 'providers.a.b']) AS key) GROUP BY key",
    "check_settings": """SELECT o_orderkey, key, CASE key WHEN 'server.apiKey' THEN 'secret' WHEN 'agent.no.such' THEN 'unknown' WHEN 'ui.theme' THEN CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE 'choice' END
WHEN 'server.port' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'whole' WHEN o_orderkey % 7 = 0 THEN 'empty' WHEN o_custkey * 97 < 1 THEN 'least' WHEN o_custkey * 97 > 65535 THEN 'most' ELSE '-' END ELSE '-' END AS problem
FROM orders, (SELECT unnest(['server.port', 'server.apiKey', 'ui.theme', 'agent.enabled', 'agent.workspace', 'agent.no.such']) AS key)""",
    "json_salvage": "SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN props WHEN event_id % 4 = 2 THEN '[1, {}]' END AS found FROM events",
    "gguf_plan": """WITH f AS (SELECT 'o/' || replace(p_brand, '#', '-') AS repo, p_partkey AS k, p_size AS z, ['Q4_K_M', 'Q5_K_M', 'Q8_0', 'IQ1_S'][p_size % 4 + 1] AS q FROM part),
m AS (SELECT *, 3 * z <= 60 AND q <> 'IQ1_S' AS good, CASE q WHEN 'Q4_K_M' THEN 1 WHEN 'Q5_K_M' THEN 2 ELSE 5 END AS place FROM f WHERE k % 10 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY NOT good, CASE WHEN good THEN place ELSE 0 END, CASE WHEN good THEN 0 ELSE 3 * z END, 'm' || k || '-' || q || '-') AS n FROM m),
x AS (SELECT repo, 'mmproj-' || CASE WHEN z % 2 = 0 THEN 'F16' ELSE 'Q8_0' END || '-' || k || '.gguf' AS path, z, row_number() OVER (PARTITION BY repo ORDER BY z % 2 = 0, k::VARCHAR || '.') AS n FROM f WHERE k % 10 = 0 AND repo IN (SELECT repo FROM m))
SELECT repo, 'm' || k || '-' || q || '-0000' || i || '-of-00002.gguf' AS path, CAST(z * i AS BIGINT) AS size, 'main' AS role, 3 * z <= 60 AS fits FROM r, (SELECT unnest([1, 2]) AS i) WHERE n = 1
UNION ALL SELECT repo, path, CAST(z AS BIGINT), 'mmproj', true FROM x WHERE n = 1""",
    "recording_windows": """WITH RECURSIVE e AS (SELECT DISTINCT user_id || '/' || strftime(ts, '%Y-%m-%d') AS id, CAST(epoch_us(ts) // 1000000 % 86400 AS BIGINT) AS s FROM events),
f AS (SELECT a.id, a.s, min(b.s) AS nxt FROM e a LEFT JOIN e b ON b.id = a.id AND b.s >= a.s + 595 GROUP BY 1, 2),
r AS (SELECT id, CAST(0 AS BIGINT) AS start, min(s) AS "end" FROM e WHERE s >= 595 GROUP BY 1 UNION ALL SELECT r.id, r."end", f.nxt FROM r JOIN f ON f.id = r.id AND f.s = r."end" WHERE f.nxt IS NOT NULL)
SELECT id, start, "end" FROM r""",
}
