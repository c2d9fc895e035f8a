"""Queries over orders, events, conversations and parts: validation, reconciliation, jobs, transcripts, planning, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.functions import validate as V
from docengine.operators import documents as D
from docengine.operators import records as R
from docengine.streaming import streams

from .common import table


def _cents(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


def _brl(x: Column) -> Column:
    """An amount in Brazilian notation with thousands."""
    c = _cents(x)
    whole = F.regexp_replace(F.floor(c / 100).cast("string"), r"(?<=\d)(?=(\d{3})+$)", ".")
    return F.concat(F.lit("R$ "), whole, F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))


def normalize_amount(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", V.parse_amount(_brl(F.col("o_totalprice"))).alias("amount"), V.parse_amount(F.col("o_totalprice")).alias("plain"), V.normalize_value(_brl(F.col("o_totalprice"))).alias("normal"))


def normalize_date(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey", V.parse_date(F.date_format(d, "d/M/yy")).alias("short"), V.parse_date(F.date_format(d, "dd-MM-yyyy")).alias("dashed"), V.parse_date(F.date_format(d, "yyyy-MM-dd HH:mm")).alias("iso"), V.parse_date(F.concat(F.lit("x"), F.col("o_orderkey"))).alias("none"))


def check_digits(spark: SparkSession, sf: str) -> DataFrame:
    """Synthetic identifiers from customer keys, completed with each possible last digit."""
    base = F.lpad((F.col("c_custkey") * 7919).cast("string"), 43, "31")
    c = table(spark, sf, "customer").withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return c.groupBy("c_custkey").agg(
        F.sum(F.when(V.is_valid_nfe_key(F.concat(base, "d")), F.col("d"))).alias("nfe_digit"),
        F.count_if(V.is_valid_cnpj(F.concat(F.substring(base, 32, 12), F.col("d"), F.lit("0")))).alias("cnpj_hits"),
        F.count_if(V.is_valid_cpf(F.concat(F.substring(base, 35, 9), F.col("d"), F.lit("0")))).alias("cpf_hits"),
    )


def tax_id_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers from customer keys, plain or with their marks, that end in digits of the key; some are blank."""
    k = F.col("c_custkey")
    base, two = F.lpad((k * 7919).cast("string"), 43, "31"), lambda n: F.lpad((n % 100).cast("string"), 2, "0")
    marked = lambda c, pattern, to: F.when(k % 2 == 0, c).otherwise(F.regexp_replace(c, pattern, to))
    cnpj = marked(F.concat(F.substring(base, 32, 12), two(k)), r"^(..)(...)(...)(....)(..)$", "$1.$2.$3/$4-$5")
    cpf = marked(F.concat(F.substring(base, 35, 9), two(k * 3)), r"^(...)(...)(...)(..)$", "$1.$2.$3-$4")
    fields = F.create_map(F.lit("cnpjEmitente"), F.when(k % 5 == 0, "").otherwise(cnpj), F.lit("cpf"), F.when(k % 7 == 0, " ").otherwise(cpf))
    c = table(spark, sf, "customer").select("c_custkey", V.run_validators(["cnpj", "cpf"], fields).alias("i"))
    return c.select("c_custkey", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["code"], x["field"])), ",").alias("codes"))


def _invoices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as documents with fields, and line items as lists."""
    o, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    fields = F.create_map(F.lit("numero"), F.col("o_orderkey").cast("string"), F.lit("valorTotal"), F.when(F.col("o_orderkey") % 7 == 0, "-1,00").when(F.col("o_orderkey") % 11 == 0, "abc").otherwise(_brl(F.col("o_totalprice"))), F.lit("dataEmissao"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("dataVencimento"), F.when(F.col("o_orderkey") % 5 == 0, "01/01/1990").otherwise("31/12/2030"))
    docs = o.select("o_orderkey", "o_totalprice", fields.alias("fields"))
    it = F.create_map(F.lit("quantidade"), F.col("l_quantity").cast("long").cast("string"), F.lit("precoUnitario"), (_cents(F.col("l_extendedprice") / F.col("l_quantity")) / 100).cast("decimal(18,2)").cast("string"))
    return docs, items.groupBy("l_orderkey").agg(F.collect_list(it).alias("items"))


def items_sum_check(spark: SparkSession, sf: str) -> DataFrame:
    _, items = _invoices(spark, sf)
    return items.select("l_orderkey", F.round(V.items_total(F.col("items")), 2).alias("total"))


def validate_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs, _ = _invoices(spark, sf)
    as_of = F.lit("1998-01-01").cast("date")
    issues = V.run_validators(["dates", "positiveAmounts", "required", "nfeKey", "nobody"], F.col("fields"), doc_type=F.lit("nfe"), as_of=as_of)
    d = docs.select("o_orderkey", issues.alias("issues"))
    return d.select("o_orderkey", V.is_ok(F.col("issues")).alias("ok"), F.array_join(F.transform("issues", lambda i: i["code"]), ",").alias("codes"))


def _both_sides(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    docs = o.select(F.col("o_orderkey").alias("id"), F.concat(F.when(F.col("o_orderkey") % 10 == 3, "D-").otherwise("N-"), "o_orderkey").alias("numero"), _brl(F.col("o_totalprice")).alias("valorTotal"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("dataEmissao"))
    price = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    t = o.select(F.concat(F.when(F.col("o_orderkey") % 10 == 4, " t-").otherwise(" n-"), "o_orderkey").alias("Número"), (_cents(price) / 100).cast("decimal(18,2)").cast("string").alias("valor_total"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dataEmissao"))
    return D.crosscheck(docs, t, ["numero"], ["valorTotal", "dataEmissao"])


def crosscheck_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _both_sides(spark, sf).select("key", "id", "status", F.array_join(F.transform("differences", lambda d: F.concat(d["column"], F.lit("="), d["document"], F.lit("/"), d["table"])), ";").alias("diff"))


def crosscheck_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.crosscheck_summary(_both_sides(spark, sf))


def dedup_sha256(spark: SparkSession, sf: str) -> DataFrame:
    return D.dedup_by_content(table(spark, sf, "documents"))


def replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return D.replace_rows(d, d.where("source = 'src1' and doc_id % 40 = 1").withColumn("n_chars", F.col("n_chars") + 1), "source")


def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    patch = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit("NEW").alias("c_mktsegment"))
    return D.partial_update(c, patch, "c_custkey")


def upsert_meta(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    return D.upsert_meta(n, n.where("value < '2'").withColumn("value", F.lit("x")).unionAll(spark.range(1).select(F.lit("ATLANTIS").alias("key"), F.lit("99").alias("value"))))


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", F.lit(".pdf")).alias("name"))
    return D.unique_names(p).select("id", "unique_name")


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    s = d.select("lang", F.when(F.col("n_chars") < 200, "error").otherwise("done").alias("status"), F.col("quality").isNotNull().alias("extracted"), F.coalesce(F.col("toxic") == 0, F.lit(True)).alias("ok"))
    return R.project_report(s, ["lang"])


def doc_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy(F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("doc_type")).agg(F.count("*").alias("n"))


def chat_list(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("first_question"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    answers = c.groupBy("conv_id").agg(F.max("turn").alias("m")).select("conv_id", F.when(F.col("conv_id") % 3 == 0, F.lit("none")).otherwise(F.concat(F.lit("see [2] and [1], [2] or [99] "), F.lit("["), (F.col("m") + 1).cast("string"), F.lit("]"))).alias("text"))
    hits = c.select("conv_id", (F.col("turn") + 1).cast("int").alias("n"), F.length("text").alias("quote_chars"))
    return D.citations(answers, hits, "conv_id").select("conv_id", "place", "n", "quote_chars")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2.25).alias("end"))


def speaker_turns(spark: SparkSession, sf: str) -> DataFrame:
    s = _segments(spark, sf).withColumn("text", F.when(F.col("turn") == 1, " ").otherwise(F.col("text")))
    return R.speakers(s, "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", F.col("speaker").cast("long").alias("speaker"))


def transcript_text(spark: SparkSession, sf: str) -> DataFrame:
    return R.transcript(_segments(spark, sf), "conv_id", "turn")


def srt_cues(spark: SparkSession, sf: str) -> DataFrame:
    return R.cues(_segments(spark, sf), "conv_id", "turn")


def prompt_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return R.prompt_transcript(_segments(spark, sf).withColumn("start", F.col("start") * 600), "conv_id", "turn", 150)


def segments_overlap(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    start = (F.col("us") / 1000000) % 3600
    return R.overlapping(e, start, start + F.col("value"), 600.0, 900.0).select("event_id")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in (("view", "queued"), ("click", "running"), ("purchase", "done"), ("error", "failed"), ("signup", "cancelled")) for x in kv])
    return table(spark, sf, "events").select(F.col("user_id").alias("id"), "event_id", "ts", status[F.col("event_type")].alias("status"), "value")


def job_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    at = F.struct("ts", "event_id")
    return R.latest_jobs(_log(spark, sf), "id", at, [F.col("ts").alias("created_at")], [F.col("ts").alias("updated_at"), F.col("status"), F.col("value").alias("progress")])


def job_history(spark: SparkSession, sf: str) -> DataFrame:
    j = job_upsert_latest(spark, sf).select("id", "status", "created_at")
    return R.history(j.where("id % 2 = 0"), j.withColumn("status", F.lit("stored")), "id", "created_at", 50)


def job_history_kind(spark: SparkSession, sf: str) -> DataFrame:
    """The newest jobs of one kind, live and stored."""
    j = job_upsert_latest(spark, sf).select("id", "status", "created_at", F.concat(F.lit("kind"), F.col("id") % 3).alias("kind"))
    return R.history(j.where("id % 2 = 0"), j.withColumn("status", F.lit("stored")), "id", "created_at", 20, "kind1")


def job_retention(spark: SparkSession, sf: str) -> DataFrame:
    j = job_upsert_latest(spark, sf).select("id", F.when(F.col("status").isin("done", "failed", "cancelled"), F.col("updated_at")).alias("ended_at"))
    return R.retained(j, "ended_at", F.lit("2024-02-20").cast("timestamp_ntz"), 30)


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    return R.recover_orphans(job_upsert_latest(spark, sf).select("id", "status"))


def running_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    j = job_upsert_latest(spark, sf).select((F.col("id") % 4).cast("string").alias("kind"), "status")
    return R.running_by_kind(j, {"0": 1, "1": 100})


def illegal_moves(spark: SparkSession, sf: str) -> DataFrame:
    return R.illegal_moves(_log(spark, sf), "id", F.struct("ts", "event_id")).select("id", "event_id", "status", "previous")


def session_debounce(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return streams.debounce(e, ["user_id"], "ts", "30 minutes")


def tumbling_window(spark: SparkSession, sf: str) -> DataFrame:
    return streams.tumbling(table(spark, sf, "events"), ["event_type"], "ts", "1 hour", "value").withColumn("total", F.round("total", 4))


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return streams.rate_limit(table(spark, sf, "events"), "user_id", "ts", 2, 36000.0).withColumn("wait", F.round(F.col("wait") * 1e6).cast("long"))


def lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return R.evictions(p, "p_brand", F.col("p_partkey"), F.col("p_size"), 100, 600).select("p_partkey")


def pick_by_preference(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_size", "p_name", F.concat("p_name", F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    first = table(spark, sf, "part").select("p_type").distinct().orderBy("p_type").limit(2).agg(F.sort_array(F.collect_list(F.lower("p_type"))).alias("prefer"))
    return R.pick_by_preference(p.crossJoin(F.broadcast(first)), "p_brand", "p_type", "p_size", "path", F.col("prefer"), F.lit(10)).select("p_brand", F.col("p_size").cast("long").alias("p_size"), "path", "fits")


def shard_sum(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    f = li.select(F.concat(F.lit("m"), "l_orderkey", F.lit("-"), F.lpad(F.col("l_linenumber").cast("string"), 5, "0"), F.lit("-of-00007.bin")).alias("path"), F.col("l_quantity").cast("long").alias("size"))
    return R.shard_groups(f)


def split_ranges(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size")
    return R.split_ranges(p, F.col("p_size") * 100, F.lit(4)).select("p_partkey", "index", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


def prune_nulls(spark: SparkSession, sf: str) -> DataFrame:
    m = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("z"), F.get_json_object("props", "$.z"), F.lit("e"), F.when(F.col("event_id") % 2 == 0, "").otherwise("x"))
    return table(spark, sf, "events").select("event_id", F.array_join(F.transform(F.map_entries(D.prune(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("kept"))


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").groupBy(v.alias("k")).agg(F.count("*").alias("n"))


def cue_clock(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") / 10, 3).alias("s"))
    return o.select("o_orderkey", T.clock(F.col("s")).alias("clock"), T.parse_duration(F.regexp_replace(T.cue_time(F.col("s")), ",", ".")).alias("seconds"), T.file_size(F.floor(F.col("s") * 1000)).alias("size"))


QUERIES = {f.__name__: f for f in (normalize_amount, normalize_date, check_digits, tax_id_issues, items_sum_check, validate_rules, crosscheck_rows, crosscheck_summary, dedup_sha256, replace_chunks, partial_update, upsert_meta, unique_names, ingest_report, doc_type_counts, chat_list, citations, speaker_turns, transcript_text, srt_cues, prompt_transcript, segments_overlap, job_upsert_latest, job_history, job_history_kind, job_retention, orphans, running_by_kind, illegal_moves, session_debounce, tumbling_window, rate_limit, lru_evict, pick_by_preference, shard_sum, split_ranges, prune_nulls, json_fields, cue_clock)}

_CENTS = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"
_NUM = r"regexp_replace(regexp_replace(CAST(CAST({c} / 100.0 AS DECIMAL(20, 2)) AS VARCHAR), '0+$', ''), '\.$', '')"
_LOG = "SELECT user_id AS id, event_id, ts, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'cancelled' END AS status, value FROM events"
_JOBS = f"SELECT id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(status, (ts, event_id)) AS status, arg_max(value, (ts, event_id)) AS progress, count(*) AS n_events FROM ({_LOG}) GROUP BY id"
_SEG = "SELECT conv_id, turn, role, text, turn * 2.5::DOUBLE AS start, turn * 2.5::DOUBLE + 2.25::DOUBLE AS \"end\" FROM conversations"
_CROSS = f"""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 3 THEN 'd-' ELSE 'n-' END || o_orderkey AS k, {_NUM.format(c=_CENTS)} AS v, strftime(o_orderdate, '%Y-%m-%d') AS e FROM orders),
t AS (SELECT CASE WHEN o_orderkey % 10 = 4 THEN 't-' ELSE 'n-' END || o_orderkey AS k, {_NUM.format(c="CAST(floor((o_totalprice + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END) * 100 + 0.5) AS BIGINT)")} AS v, strftime(o_orderdate, '%Y-%m-%d') AS e FROM orders),
j AS (SELECT coalesce(d.k, t.k) AS key, id, CASE WHEN d.k IS NULL THEN 'missing_in_documents' WHEN t.k IS NULL THEN 'missing_in_table' WHEN d.v <> t.v OR d.e <> t.e THEN 'different' ELSE 'matched' END AS status,
CASE WHEN d.k IS NOT NULL AND t.k IS NOT NULL THEN CASE WHEN d.v <> t.v THEN 'valorTotal=' || d.v || '/' || t.v ELSE '' END END AS diff FROM d FULL JOIN t ON d.k = t.k)
"""


def _clock(s: str) -> str:
    s = f"CAST(floor({s} + 0.5) AS BIGINT)"
    return f"CASE WHEN {s} // 3600 > 0 THEN ({s} // 3600) || ':' || lpad(({s} % 3600 // 60)::VARCHAR, 2, '0') ELSE ({s} // 60)::VARCHAR END || ':' || lpad(({s} % 60)::VARCHAR, 2, '0')"


def _cue(s: str) -> str:
    ms = f"CAST(floor({s} * 1000 + 0.5) AS BIGINT)"
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 60000 // 1000)::VARCHAR, 2, '0') || ',' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


def _check(weights: list[int], s: str) -> str:
    return "(" + " + ".join(f"CAST(substr({s}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights)) + ")"


_BASE = "lpad((c_custkey * 7919)::VARCHAR, 43, '31')"
_M11 = lambda t: f"CASE WHEN {t} % 11 < 2 THEN 0 ELSE 11 - {t} % 11 END"

ORACLE = {
    "normalize_amount": f"SELECT o_orderkey, {_CENTS} / 100.0::DOUBLE AS amount, o_totalprice AS plain, {_NUM.format(c=_CENTS)} AS normal FROM orders",
    "normalize_date": "SELECT o_orderkey, strftime(o_orderdate, '20%y-%m-%d') AS short, strftime(o_orderdate, '%Y-%m-%d') AS dashed, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(NULL AS VARCHAR) AS none FROM orders",
    "check_digits": f"""WITH b AS (SELECT c_custkey, {_BASE} AS s, substr({_BASE}, 32, 12) AS n, substr({_BASE}, 35, 9) AS f FROM customer),
d AS (SELECT *, CAST({_M11(_check([2 + (42 - i) % 8 for i in range(43)], 's'))} AS BIGINT) AS nfe, {_M11(_check([2 + (11 - i) % 8 for i in range(12)], 'n'))} AS n1, {_check(list(range(10, 1, -1)), 'f')} * 10 % 11 % 10 AS f1 FROM b),
e AS (SELECT *, {_M11(_check([2 + (12 - i) % 8 for i in range(13)], '(n || n1)'))} AS n2, {_check(list(range(11, 1, -1)), '(f || f1)')} * 10 % 11 % 10 AS f2 FROM d)
SELECT c_custkey, nfe AS nfe_digit, CAST((n2 = 0)::INT AS BIGINT) AS cnpj_hits, CAST((f2 = 0)::INT AS BIGINT) AS cpf_hits FROM e""",
    "tax_id_issues": f"""WITH b AS (SELECT c_custkey, substr({_BASE}, 32, 12) AS n, substr({_BASE}, 35, 9) AS f FROM customer),
d AS (SELECT *, {_M11(_check([2 + (11 - i) % 8 for i in range(12)], 'n'))} AS n1, {_check(list(range(10, 1, -1)), 'f')} * 10 % 11 % 10 AS f1 FROM b),
e AS (SELECT *, {_M11(_check([2 + (12 - i) % 8 for i in range(13)], '(n || n1)'))} AS n2, {_check(list(range(11, 1, -1)), '(f || f1)')} * 10 % 11 % 10 AS f2 FROM d)
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 5 <> 0 AND CAST(n1 * 10 + n2 AS BIGINT) <> c_custkey % 100 THEN 'cnpj_invalido:cnpjEmitente' END,
CASE WHEN c_custkey % 7 <> 0 AND CAST(f1 * 10 + f2 AS BIGINT) <> c_custkey * 3 % 100 THEN 'cpf_invalido:cpf' END], lambda x: x IS NOT NULL), ',') AS codes FROM e""",
    "items_sum_check": "SELECT l_orderkey, round(sum(CAST(l_quantity AS BIGINT) * (CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS BIGINT) / 100.0::DOUBLE)), 2) AS total FROM lineitem GROUP BY 1",
    "validate_rules": """SELECT o_orderkey, NOT (o_orderkey % 5 = 0 OR (o_orderkey % 11 = 0 AND o_orderkey % 7 <> 0)) AS ok,
array_to_string(list_filter([CASE WHEN o_orderkey % 5 = 0 THEN 'vencimento_antes_emissao' END, CASE WHEN o_orderdate >= DATE '1998-01-03' THEN 'data_futura' END,
CASE WHEN o_orderkey % 7 = 0 THEN 'valor_negativo' WHEN o_orderkey % 11 = 0 THEN 'valor_ilegivel' END, 'nfe_key_missing', 'validador_desconhecido'], lambda x: x IS NOT NULL), ',') AS codes FROM orders""",
    "crosscheck_rows": _CROSS + "SELECT key, id, status, diff FROM j",
    "crosscheck_summary": _CROSS + "SELECT count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'different') AS different, count(*) FILTER (status = 'missing_in_table') AS missing_in_table, count(*) FILTER (status = 'missing_in_documents') AS missing_in_documents FROM j",
    "dedup_sha256": "SELECT sha256(text) AS digest, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY 1",
    "replace_chunks": "SELECT doc_id, source, n_chars FROM documents WHERE source <> 'src1' UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE source = 'src1' AND doc_id % 40 = 1",
    "partial_update": "SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer",
    "upsert_meta": "SELECT n_name AS key, CASE WHEN n_nationkey::VARCHAR < '2' THEN 'x' ELSE n_nationkey::VARCHAR END AS value FROM nation UNION ALL SELECT 'ATLANTIS', '99'",
    "unique_names": "SELECT id, CASE WHEN n = 1 THEN b || '.pdf' ELSE b || ' (' || n || ').pdf' END AS unique_name FROM (SELECT p_partkey AS id, p_brand AS b, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)",
    "ingest_report": "SELECT lang, count(*) AS sources, count(*) FILTER (n_chars >= 200) AS indexed, count(*) FILTER (n_chars < 200) AS failed, count(quality) AS extracted, count(*) FILTER (toxic <> 0) AS with_issues FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "doc_type_counts": "SELECT coalesce(quality::VARCHAR, 'none') AS doc_type, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "chat_list": "SELECT conv_id, count(*) AS turns, arg_min(text, turn) FILTER (role = 'user') AS first_question FROM conversations GROUP BY 1",
    "citations": """WITH m AS (SELECT conv_id, max(turn) + 1 AS s FROM conversations GROUP BY 1),
l AS (SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN range(1, least(3, s) + 1) ELSE list_filter([2, 1, CASE WHEN s > 2 AND s <= 99 THEN s END], lambda n: n IS NOT NULL AND n <= s) END AS l FROM m),
e AS (SELECT conv_id, unnest(l) AS n, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS place FROM l)
SELECT e.conv_id, place, CAST(n AS INTEGER) AS n, length(text) AS quote_chars FROM e JOIN conversations c ON c.conv_id = e.conv_id AND c.turn + 1 = e.n""",
    "speaker_turns": "SELECT conv_id, turn, speaker FROM (SELECT conv_id, turn, text, CAST(1 + coalesce(sum((role = 'assistant')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS speaker FROM conversations) WHERE turn <> 1 AND trim(text) <> ''",
    "transcript_text": f"SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, arg_max(\"end\", turn) AS duration, count(*) AS n_segments FROM ({_SEG}) GROUP BY 1",
    "srt_cues": f"SELECT conv_id, CAST(n AS INTEGER) AS n, n || chr(10) || {_cue('start')} || ' --> ' || {_cue('e')} || chr(10) || text AS cue FROM (SELECT conv_id, start, \"end\" AS e, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM ({_SEG}))",
    "prompt_transcript": f"""WITH f AS (SELECT conv_id, string_agg('[' || {_clock('start * 600')} || '] ' || text, chr(10) ORDER BY turn) AS t FROM ({_SEG}) GROUP BY 1)
SELECT conv_id, CASE WHEN length(t) <= 150 THEN t ELSE substr(t, 1, 75) || chr(10) || chr(10) || '[… trecho do meio omitido por tamanho …]' || chr(10) || chr(10) || right(t, 75) END AS text FROM f""",
    "segments_overlap": "SELECT event_id FROM (SELECT event_id, (epoch_us(ts) / 1000000) % 3600 AS s, value FROM events) WHERE s + value > 600 AND s < 900",
    "job_upsert_latest": _JOBS,
    "job_history_kind": f"SELECT id, CASE WHEN id % 2 = 0 THEN status ELSE 'stored' END AS status, created_at, 'kind1' AS kind FROM ({_JOBS}) WHERE id % 3 = 1 ORDER BY created_at DESC, id LIMIT 20",
    "job_history": f"SELECT id, CASE WHEN id % 2 = 0 THEN status ELSE 'stored' END AS status, created_at FROM ({_JOBS}) ORDER BY created_at DESC, id LIMIT 50",
    "job_retention": f"SELECT id, ended_at FROM (SELECT id, CASE WHEN status IN ('done', 'failed', 'cancelled') THEN updated_at END AS ended_at FROM ({_JOBS})) WHERE ended_at IS NULL OR ended_at >= TIMESTAMP '2024-01-21'",
    "orphans": f"SELECT id, CASE WHEN status IN ('queued', 'running') THEN 'failed' ELSE status END AS status FROM ({_JOBS})",
    "running_by_kind": f"SELECT kind, running, greatest(CASE kind WHEN '0' THEN 1 WHEN '1' THEN 100 ELSE 2 END - running, 0) AS free FROM (SELECT (id % 4)::VARCHAR AS kind, count(*) FILTER (status = 'running') AS running FROM ({_JOBS}) GROUP BY 1)",
    "illegal_moves": f"""SELECT id, event_id, status, p AS previous FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY ts, event_id) AS p FROM ({_LOG}))
WHERE NOT coalesce((p IS NULL AND status = 'queued') OR (p = 'queued' AND status IN ('running', 'cancelled', 'failed')) OR (p = 'running' AND status IN ('done', 'failed', 'cancelled', 'running')), false)""",
    "session_debounce": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, s""",
    "tumbling_window": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "rate_limit": """WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (SELECT a.client, a.n, min(b.n) AS nxt FROM e a LEFT JOIN e b ON b.client = a.client AND b.us >= a.us + 36000000000 GROUP BY 1, 2),
r AS (SELECT client, n FROM e WHERE n = 1 UNION ALL SELECT r.client, f.nxt FROM r JOIN f ON f.client = r.client AND f.n = r.n WHERE f.nxt IS NOT NULL),
w AS (SELECT e.client, e.us, e.n, max(r.n) OVER (PARTITION BY e.client ORDER BY e.n) AS opened FROM e LEFT JOIN r ON r.client = e.client AND r.n = e.n)
SELECT w.client, w.us, w.n - w.opened < 2 AS allowed, CASE WHEN w.n - w.opened < 2 THEN 0 ELSE o.us + 36000000000 - w.us END AS wait FROM w JOIN e o ON o.client = w.client AND o.n = w.opened""",
    "lru_evict": "SELECT p_partkey FROM (SELECT p_partkey, sum(p_size) OVER (PARTITION BY p_brand) - coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM part) WHERE l + 100 > 600",
    "pick_by_preference": """WITH t AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS n FROM (SELECT DISTINCT p_type FROM part)),
r AS (SELECT p_brand, p_size, p_name || '/' || p_partkey AS path, CASE WHEN n <= 2 AND p_size <= 10 THEN n END AS good FROM part JOIN t USING (p_type)),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY good IS NULL, coalesce(good, 0), CASE WHEN good IS NULL THEN p_size ELSE 0 END, path) AS k FROM r)
SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, path, p_size <= 10 AS fits FROM k WHERE k = 1""",
    "shard_sum": "SELECT min('m' || l_orderkey || '-' || lpad(l_linenumber::VARCHAR, 5, '0') || '-of-00007.bin') AS path, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS size, count(*) AS parts FROM lineitem GROUP BY l_orderkey",
    "split_ranges": "SELECT p_partkey, CAST(i AS INTEGER) AS index, CAST(i * p_size * 25 AS BIGINT) AS start, CAST((i + 1) * p_size * 25 - 1 AS BIGINT) AS \"end\" FROM part, range(4) r(i)",
    "prune_nulls": "SELECT event_id, 'k=' || json_extract_string(props, '$.k') || CASE WHEN event_id % 2 = 0 THEN '' ELSE ',e=x' END AS kept FROM events",
    "json_fields": "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "cue_clock": f"""WITH o AS (SELECT o_orderkey, round(o_totalprice / 10, 3) AS s FROM orders)
SELECT o_orderkey, {_clock('s')} AS clock, CAST(floor(s * 1000 + 0.5) AS BIGINT) // 3600000 * 3600::DOUBLE + CAST(floor(s * 1000 + 0.5) AS BIGINT) % 3600000 // 60000 * 60::DOUBLE + CAST(CAST(floor(s * 1000 + 0.5) AS BIGINT) % 60000 / 1000.0 AS DECIMAL(9,3))::DOUBLE AS seconds,
CASE WHEN floor(s * 1000) = 0 THEN '?' WHEN floor(s * 1000) >= 1048576 THEN CAST(floor(floor(s * 1000) / 1048576 + 0.5) AS BIGINT) || ' MB' ELSE CAST(floor(floor(s * 1000) / 1024 + 0.5) AS BIGINT) || ' KB' END AS size FROM o""",
}
