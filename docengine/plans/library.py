"""Queries of asking, selections, exports, names and download plans over the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import documents as D
from docengine.operators import library as L
from docengine.operators import records as R
from docengine.functions import text as T
from docengine.functions import validate as V
from docengine.sources.files import model_format

from .common import table


def _conv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def _pick(key: Column, *values: str) -> Column:
    """One of the values, in turn by a number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def ask_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's first turn asks, its other turns are the excerpts; a third find nothing."""
    c = _conv(spark, sf)
    q = c.where("turn = 0").select("conv_id", F.col("text").alias("question"), F.concat(F.lit("P"), "conv_id").alias("project"))
    hits = c.where("turn > 0 and conv_id % 3 <> 0").select("conv_id", F.col("turn").alias("n"), F.concat(F.lit("f"), "turn").alias("name"), F.when(F.col("turn") % 2 == 0, F.col("turn")).alias("page"), "text")
    return L.ask_prompts(q, hits, "conv_id", _memory(spark, sf))


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    m = _conv(spark, sf).where("conv_id % 2 = 0").select("conv_id", "text", (F.col("role") == "user").alias("pinned"), F.col("turn").alias("created_at"))
    return L.memory_prompts(m, "conv_id", L.global_memory(F.lit("# Head\nAlways short.\n## More\nNo jokes.\n")), 2)


def memory_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _memory(spark, sf)


def ask_answers(spark: SparkSession, sf: str) -> DataFrame:
    """The injected model says how much it was told; nothing found is answered without it."""
    return L.answers(ask_prompt(spark, sf), lambda system, user: [f" {len(s)}/{len(u)} " for s, u in zip(system, user, strict=True)], "conv_id")


def chat_append(spark: SparkSession, sf: str) -> DataFrame:
    c = _conv(spark, sf)
    new = c.where("turn < 2").select("conv_id", F.col("turn").alias("at"), F.lit("user").alias("role"), F.concat(F.lit("again "), "text").alias("text"))
    return L.append_turns(c, new, "conv_id").select("conv_id", "turn", "role", "text")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("id"), "lang", F.when(F.col("n_chars") < 200, "failed").when(F.col("n_chars") < 500, "queued").otherwise("done").alias("status"), F.col("quality").alias("fields"), F.col("toxic"), F.col("n_chars").alias("added_at"))


def point_read(spark: SparkSession, sf: str) -> DataFrame:
    return L.by_id(table(spark, sf, "documents"), "doc_id", 17)


def sources_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return L.with_status(_sources(spark, sf), "queued").select("id", "status")


def ingest_targets(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    return L.ingest_targets(s).select("id", F.col("target").alias("stale")).join(L.ingest_targets(s, [1, 2, 3]).select("id", F.col("target").alias("named")), "id").join(L.ingest_targets(s, force=True).select("id", F.col("target").alias("forced")), "id")


def ingest_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = L.ingest_targets(_sources(spark, sf)).withColumn("failed", F.col("status") == "failed").withColumn("chunks", F.col("added_at"))
    return L.ingest_summary(s, ["lang"])


def extraction_targets(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf)
    return L.extraction_targets(s).select("id", F.lit("open").alias("how")).unionAll(L.extraction_targets(s, [1, 2, 3, 4, 5]).select("id", F.lit("named"))).unionAll(L.extraction_targets(s, force=True).select("id", F.lit("all")))


def extraction_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _sources(spark, sf).select("lang", (F.col("toxic") == 0).alias("ok"), F.when(F.col("status") == "failed", "x").alias("error"))
    return L.extraction_summary(s, ["lang"])


def source_records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props")).alias("fields"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("kind"))
    r = L.source_records(e, ["fields"])
    got = lambda k: F.get_json_object("record", f"$.{k}")
    return r.select(got("id").cast("long").alias("id"), got("kind").alias("kind"), got("fields.k").alias("k"), F.size(F.json_object_keys("record")).alias("n_fields"))


def typed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", _pick(F.col("p_partkey"), "nfe", "boleto", "nobody").alias("type"))
    return L.typed_lookup(p, D.doc_types(spark).select(F.col("id").alias("type"), F.size("hints").alias("hints"))).select("p_partkey", "type", "hints", "error")


def add_files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.sha2("text", 256).alias("digest"), F.col("doc_id").cast("string").alias("name"))
    old = d.where("name % 3 = 0").groupBy("digest").agg(F.min("name").alias("name"))
    return L.add_files(old, d.where("name % 3 <> 0"))


def soft_delete(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("2020")).alias("deleted_at"))
    return L.soft_delete(c, c.where("c_custkey % 2 = 0"), "c_custkey", F.lit("2024"))


def redacted_settings(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("k"), F.col("n_nationkey") % 3).alias("key"), F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("value"), "n_nationkey")
    return L.redacted(n, ["k1", "k2"])


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_brand", k.alias("id"), k.alias("place"), _pick(k, "speech", "embeddings", "text").alias("kind"), F.when(k % 5 == 0, "main").otherwise("voice").alias("role"), F.concat(_pick(k, "ggml-", "Turbo ", "x"), "p_name").alias("name"))


def default_models(spark: SparkSession, sf: str) -> DataFrame:
    c = _catalog(spark, sf)
    speech = L.default_models(c, "p_brand", "speech", "turbo", "whisper|ggml").select("p_brand", F.lit("speech").alias("kind"), "id")
    return speech.unionAll(L.default_models(c, "p_brand", "embeddings").select("p_brand", F.lit("embeddings"), "id"))


def sorted_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Places in a Portuguese sort of names with accents and mixed case (at most the nations)."""
    n = table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.replace("n_name", F.lit("A"), F.lit("Á"))).alias("name"))
    names = L.sorted_by_name(n, "name").agg(F.array_sort(F.collect_list(F.collate("name", "pt"))).alias("all"))
    return n.crossJoin(F.broadcast(names)).select("n_nationkey", F.array_position("all", F.collate("name", "pt")).alias("place"))  # one row of names


def mail_batch(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("uid"), F.col("o_orderdate").alias("at"))
    k = F.col("c_custkey")
    a = table(spark, sf, "customer").select(k.alias("account"), F.when(k % 3 == 0, F.lit("1996-01-01").cast("timestamp_ntz")).alias("since"), F.when(k % 2 == 0, F.lit("1994-06-01").cast("timestamp_ntz")).alias("last_sync_at"), F.when(k % 5 == 0, 3).alias("most"))
    return L.mail_batch(m, a, "account", 4).select("account", "uid")


def idle_instances(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "ready").otherwise("busy").alias("status"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("last_used_at"), F.col("ts").alias("started_at"))
    now = F.lit("2024-01-15").cast("timestamp_ntz")
    return L.idle_instances(e, now, 600).select("id").unionAll(L.idle_instances(e, now, 0).select("id"))


def progress_throttle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "ts", F.col("event_id").alias("b"), F.when(F.col("user_id") % 2 == 0, F.lit(1e6)).alias("z"))
    return L.throttled(e, "user_id", "ts", "b", "z", 86_400_000).select("user_id", F.unix_millis("at").alias("ms"), F.col("done").cast("long").alias("done"), F.round("rate", 6).alias("rate"), F.col("eta").isNotNull().alias("timed"))


def eta_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", L.eta_text((F.col("o_orderkey") * 7 % 20000).cast("long")).alias("eta"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    word = F.struct(F.col("role").alias("word"), (F.col("turn") * 2.5).alias("start"))
    return _conv(spark, sf).select("conv_id", "turn", "text", (F.col("turn") * 2.5).alias("start"), (F.col("turn") * 2.5 + 2.25).alias("end"), F.when(F.col("turn") % 3 != 2, F.col("role")).alias("speaker"), F.lit(0.5).alias("confidence"), F.when(F.col("turn") != 1, F.array(word, word)).alias("words"))


def export_vtt(spark: SparkSession, sf: str) -> DataFrame:
    return L.to_vtt(_segments(spark, sf), "conv_id", "turn")


def export_txt(spark: SparkSession, sf: str) -> DataFrame:
    return L.to_txt(_segments(spark, sf), "conv_id", "turn")


def speaker_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return L.speaker_markdown(_segments(spark, sf), "conv_id", "turn")


def verbose_words(spark: SparkSession, sf: str) -> DataFrame:
    v = L.verbose(_segments(spark, sf), "conv_id", "turn")
    return v.select("conv_id", "text", "duration", F.size("segments").alias("n_segments"), F.size("words").alias("n_words"), F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("words"), F.element_at("segments", -1)["id"].cast("long").alias("last_id"))


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id")
    raw = F.concat(F.lit('{"summary":" all '), k.cast("string"), F.lit(' ","decisions":[" go ",7,"",'), F.lit('null,"stay"],"actions":[{"text":"do it","owner":" Ann ","due":""},{"owner":"x"},3],"questions":'), F.when(k % 2 == 0, F.lit('["why?"]')).otherwise(F.lit('"no list"')), F.lit("}"))
    return _conv(spark, sf).where("turn = 0").select("conv_id", F.when(k % 7 == 0, F.lit("broken {")).otherwise(raw).alias("raw"))


def summary_fields(spark: SparkSession, sf: str) -> DataFrame:
    s = _summaries(spark, sf).select("conv_id", L.normal_summary(F.col("raw")).alias("s"))
    return s.select("conv_id", "s.summary", F.array_join("s.decisions", "|").alias("decisions"), F.array_join(F.transform("s.actions", lambda a: F.concat_ws("/", a["text"], a["owner"], a["due"])), "|").alias("actions"), F.array_join("s.questions", "|").alias("questions"))


def meeting_markdown(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id")
    m = _summaries(spark, sf).select("conv_id", F.concat(F.lit("M"), k).alias("title"), F.lit("1/2").alias("started"), F.when(k % 2 == 0, F.lit("1/3")).alias("ended"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("mic"), F.lit("system"))).alias("sources"), F.when(k % 5 != 0, L.normal_summary(F.col("raw"))).alias("summary"))
    return L.meeting_markdown(m, _segments(spark, sf), "conv_id", "turn")


def wav_headers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    head = F.concat(F.lit("5249464600000000574156456d7420201000000000000000"[:40]), _pick(k, "0100", "0300"), _pick(k, "0100", "0100", "0200"), _pick(k, "803E0000", "44AC0000", "803E0000", "803E0000", "803E0000"), F.repeat(F.lit("00"), 16))
    return table(spark, sf, "part").select("p_partkey", L.is_wav_16k_mono(F.unhex(F.when(k % 11 == 0, F.substring(head, 1, 80)).otherwise(head))).alias("ok"))


def ocr_export(spark: SparkSession, sf: str) -> DataFrame:
    f = _conv(spark, sf).select("conv_id", "turn", F.concat(F.lit('a"b'), "turn").alias("file"), (F.col("turn") + 1).alias("pages"), F.col("text").alias("markdown"))
    return L.ocr_csv(f, "conv_id", "turn").join(L.ocr_markdown(f, "conv_id", "turn"), "conv_id")


_VOICES = ("vits-piper-pt_BR-faber-medium", "kokoro-multi-lang-v1_0", "Matcha-zh_x", "af_bella", "PM_alex-En", "piper-male.de", "x-female-fr_CA")


def voice_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select("p_partkey", _pick(F.col("p_partkey"), *_VOICES).alias("name"))
    return n.select("p_partkey", L.language_from_name(F.col("name")).alias("language"), L.gender_from_name(F.col("name")).alias("gender"), L.pretty_name(F.col("name")).alias("pretty"))


_NAMES = {
    "a/mmproj-x.gguf": ("vision", "mmproj", "gguf"), "Whisper-l.gguf": ("speech", "main", "gguf"), "got-ocr.gguf": ("ocr", "main", "gguf"), "nomic-embed.gguf": ("embeddings", "main", "gguf"), "bge-rerank.gguf": ("rerank", "main", "gguf"),
    "wan2.1-t5.gguf": ("video", "text_encoder", "gguf"), "flux-vae.gguf": ("image", "vae", "gguf"), "ltx-2b.gguf": ("video", "diffusion", "gguf"), "Llama-3.gguf": ("text", "main", "gguf"), "dir/ggml-base.bin": ("speech", "main", "ggml"), "other.bin": (None, "unknown", None),
    "my-lora.safetensors": ("image", "lora", "safetensors"), "sdxl_vae.pt": ("image", "vae", "safetensors"), "clip_l.ckpt": ("image", "text_encoder", "safetensors"), "hunyuan_video.safetensors": ("video", "diffusion", "safetensors"), "chroma.safetensors": ("image", "diffusion", "safetensors"),
    "plain.ckpt": ("image", "main", "safetensors"), "pt_BR-faber-medium.onnx": ("tts", "voice", "onnx"), "text_det.onnx": ("ocr", "main", "onnx"), "kokoro.onnx": ("tts", "voice", "onnx"), "config.json": (None, "config", "json"), "README": (None, "unknown", None),
}


def guess_names(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select("p_partkey", _pick(F.col("p_partkey"), *_NAMES).alias("name"))
    return n.select("p_partkey", L.guess_from_name(F.col("name")).alias("g")).select("p_partkey", "g.kind", "g.role", "g.format")


def device_lists(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    said = {
        "dshow": F.concat(F.lit('[dshow] "'), "n_name", F.lit('" (audio)\r\n[x] "cam" (video)\n"CABLE Output" (Audio)')),
        "avfoundation": F.concat(F.lit("AVFoundation video devices:\n[0] cam\n[x] AVFoundation audio devices:\n[A] [1] "), "n_name", F.lit(" \n[2] BlackHole 2ch\nAVFoundation video devices\n[3] late")),
        "pactl": F.concat(F.lit("1\t"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("\tmod\n2\talsa.monitor\tx\n\n3")),
    }
    out = None
    for kind, text in said.items():
        part = n.select("n_nationkey", F.lit(kind).alias("tool"), F.array_join(F.transform(L.audio_devices(text, kind), lambda d: F.concat_ws(":", d["id"], d["name"], d["kind"])), ",").alias("devices"))
        out = part if out is None else out.unionAll(part)
    return out


_HEADS = {"gguf": "4747554603000000", "zip": "504B030400000000", "html": "3C21646F63747970652068746D6C3E", "json": "7B2261223A20317D20", "bin": "0102030405060708"}
_EXTS = (".gguf", ".json", ".zip", ".onnx", ".safetensors", ".txt", ".GGUF")


def head_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", model_format(F.unhex(_pick(k, *_HEADS.values()))).alias("found"), _pick(k, *_EXTS).alias("ext"))
    return p.select("p_partkey", "found", L.head_problem(F.col("found"), F.col("ext")).alias("problem"))


_MOVED = ("m/a.gguf", "m/b.part", "m/sub/c.json", "m/d.json", "m/fake", "m/sub/data", "m/.hidden", "m/e.bin", "m/f.gguf.sidecar.json", "m/g.txt")


def migration_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    f = table(spark, sf, "part").select("p_partkey", F.lit("m").alias("folder"), F.lit("image").alias("hint"), _pick(k, *_MOVED).alias("path"), _pick(k / 10, "gguf", "html", "bin").alias("format"), F.when(k % 4 == 0, "text").alias("kind"))
    return L.migration_flags(f).select("p_partkey", "path", "problem", "suggested")


def present_files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    planned = p.select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("size"))
    there = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(F.col("p_size")).alias("size"))
    return L.present_files(planned, there).select("path", "present")


def plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_brand", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), None).otherwise(F.col("p_size").cast("long")).alias("size"))
    return L.total_bytes(p, ["p_brand"])


def most_vram(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_nationkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("s_suppkey") * 10).alias("vram_mib"))
    return L.most_vram(s, "s_nationkey")


def derivative_rank(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_brand", F.concat(_pick(k, "unsloth", "Qwen", "nobody", "ggml-org", "bartowski"), F.lit("/m"), k).alias("id"), F.when(k % 7 > 0, k % 50).alias("downloads"))
    return L.ranked_derivatives(p, "p_brand").select("p_brand", "id", "rank")


def _recipes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(F.concat(F.lit("r"), k).alias("recipe"), F.concat(F.lit("Org/R"), k % 40).alias("repo"), _pick(k, "draft", "verified", "planned", "community", "other").alias("status"))


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    repo = F.concat(F.lit("org/r"), k % 60)
    return table(spark, sf, "customer").select(k.alias("ref"), repo.alias("repo"), F.when(k % 13 == 0, F.concat(F.lit("f"), k % 60, F.lit("-0.gguf"))).alias("path"), F.when(k % 11 == 0, F.lit("sub")).alias("subpath"), F.when(k % 2 == 0, F.lit("image")).when(k % 3 == 0, F.lit("text")).alias("kind"))


def recipe_match(spark: SparkSession, sf: str) -> DataFrame:
    return L.recipes_for(_refs(spark, sf), _recipes(spark, sf))


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Repositories 0 to 79, each with files of one sort by the tens of its number."""
    k, n = F.col("p_partkey"), F.col("p_partkey") % 80
    ext = F.when(n < 15, "gguf").when(n < 44, "json").when(n < 48, "ckpt").when(n < 52, "onnx").otherwise("bin")
    folder = F.when(k % 3 == 0, "sub/").when(k % 7 == 0, "images/").otherwise("")
    return table(spark, sf, "part").select(F.concat(F.lit("org/r"), n).alias("repo"), F.concat(folder, F.lit("f"), n, F.lit("-"), F.floor(k / 80), F.lit("."), ext).alias("path"), F.when(k % 5 == 0, F.lit(0)).otherwise(F.lit(600 << 20) + k).cast("long").alias("size"), (n % 6 == 0).alias("gated"))


def plan_steps(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "nation").select(F.concat(F.lit("org/r"), F.lit(48) + F.col("n_nationkey") % 8).alias("repo"), F.concat(_pick(F.col("n_nationkey"), "nobody", "city96"), F.lit("/d"), "n_nationkey").alias("id"), F.col("n_nationkey").alias("downloads"))
    recipes = _recipes(spark, sf).where("recipe < 'r3'")
    return L.plan_steps(_refs(spark, sf), _tree(spark, sf), recipes, conv)


def slot_sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(2))))
    n = (k + F.col("place") * 30) % 90
    glob = F.when(k % 2 == 1, _pick(k, "f*-?.json", "**.gguf", "f*.ckpt"))
    s = s.select(F.concat(F.lit("r"), k).alias("recipe"), F.lit("main").alias("slot"), "place", F.concat(F.lit("org/r"), n).alias("repo"), F.when(k % 2 == 0, F.concat(F.lit("f"), n, F.lit("-1.json"))).alias("path"), glob.alias("glob"), (k % 5 == 0).alias("many"))
    return L.resolve_slots(s, _tree(spark, sf)).select("recipe", "repo", F.array_join("files", ",").alias("files"), "tried")


def companion_files(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.concat(F.lit("/m/"), "p_brand", F.lit("/"), F.col("p_partkey") % 100, F.lit(".bin")).alias("path"))
    w = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("#"), F.col("c_custkey") % 6, F.lit("/"), F.col("c_custkey") % 110, F.lit(".bin")).alias("suffix"))
    return L.companions(w, p)


def file_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return L.with_label(table(spark, sf, "part").select("p_partkey", F.concat(F.lit("d/m-"), _pick(k, "Q4_K_M", "plain", "fp16"), F.lit(".bin")).alias("path"), (k * 5_000_000 + 1).alias("size"))).select("p_partkey", "label")


def output_kinds(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("created_at"), F.lit("p").alias("prompt"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("created_at"), F.lit(3).alias("seconds"))
    return L.outputs(image=n, speech=r)


# Operators of other modules that had no query of their own


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf, "part")
    b = p.select("p_partkey", R.budget_bytes(_pick(k, "text", "image", "speech"), F.when(k % 4 > 0, k * 16), k * 64 + 4096).alias("budget"), R.vram_mib(_pick(k, "text", "image", "speech"), k * 1_000_000, _pick(k, "cuda", "cpu", "cuda", "vulkan")).alias("vram"))
    return b.select("p_partkey", F.round("budget", 0).cast("long").alias("budget"), "vram")


def kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", R.infer_kind(_pick(k, "a/Big-OCR", "a/music-x", "a/rerank", "a/tts-audio", "a/plain"), _pick(k, "text-to-image", "text-to-audio", "feature-extraction", "text-generation", "image-to-video", "automatic-speech-recognition", "other")).alias("kind"), R.checkpoint_score(_pick(k, "m-opt.safetensors", "fp16-vae.ckpt", "lora_pruned.safetensors", "plain.safetensors")).alias("score"))


def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("mtime"))
    old = f.where("path % 3 > 0").withColumn("size", F.when(F.col("path") % 5 == 0, 0).otherwise(F.col("size")))
    return R.changed_files(f, old).select("path")


def flag_dedup(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    arg = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("-"), F.col("l_partkey") % 3)).otherwise(F.concat(F.lit("v"), F.col("l_linenumber")))
    a = li.groupBy(F.col("l_orderkey").alias("cmd"), F.col("l_linenumber").alias("pos")).agg(F.min(arg).alias("arg"))
    return R.last_flags(a, "cmd")


def settings_merge(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    base = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("1"))
    patch = F.create_map(F.lit("b"), F.when(n % 2 == 0, F.lit("2")), F.lit("c"), n.cast("string"))
    m = R.merge_settings(base, patch)
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


def parsed_segments(spark: SparkSession, sf: str) -> DataFrame:
    t = F.struct(F.struct((F.col("turn") * 1000).cast("double").alias("from"), (F.col("turn") * 1000 + 500).cast("double").alias("to")).alias("offsets"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" "), F.col("role"), F.lit(" [SPEAKER_TURN]"))).otherwise(F.concat(F.lit("x "), F.col("role"))).alias("text"), F.array(F.struct(F.lit(" a").alias("text"), F.lit(0.5).alias("p"), F.struct(F.lit(0.0).alias("from"), F.lit(100.0).alias("to")).alias("offsets")), F.struct(F.lit("[_BEG_]").alias("text"), F.lit(0.25).alias("p"), F.struct(F.lit(0.0).alias("from"), F.lit(0.0).alias("to")).alias("offsets"))).alias("tokens"))
    g = _conv(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", t.alias("t")))).alias("l"))
    raw = g.select(F.col("conv_id").alias("id"), F.to_json(F.struct(F.struct(F.lit("pt").alias("language")).alias("result"), F.transform("l", lambda x: x["t"]).alias("transcription"))).alias("raw"))
    s = R.parse_segments(raw, offset=1.5)
    return s.select("id", "seq", "start", "end", "text", F.col("speaker").cast("long").alias("speaker"), "confidence", F.size("words").alias("n_words"), "language")


def item_progress(spark: SparkSession, sf: str) -> DataFrame:
    return R.progress(_conv(spark, sf).select("conv_id", "turn"), "conv_id", "turn").withColumn("progress", F.round("progress", 9))


def memory_lines(spark: SparkSession, sf: str) -> DataFrame:
    c = _conv(spark, sf)
    m = c.select(F.col("conv_id").alias("project_id"), _pick(F.col("turn"), "user", "fact", "glossary", "other").alias("kind"), F.concat("role", "turn").alias("text"), (F.col("turn") % 5 == 0).alias("pinned"), F.timestamp_seconds("turn").alias("created_at"))
    return D.memory_markdown(m)


def remembered(spark: SparkSession, sf: str) -> DataFrame:
    c = _conv(spark, sf).select(F.concat(F.lit(" "), F.substring("text", 1, 3), F.col("role")).alias("text"))
    old = c.select(F.trim("text").alias("text")).where("text like 'a%'")
    return D.new_memories(old, c)


def tax_ids(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    fields = F.create_map(F.lit("cnpjEmitente"), _pick(k, "11.222.333/0001-81", "11222333000180", ""), F.lit("cpf"), _pick(k, "529.982.247-25", "52998224724"))
    c = table(spark, sf, "customer").select("c_custkey", V.run_validators(["cnpj", "cpf"], fields).alias("i"))
    return c.select("c_custkey", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["code"], x["field"])), ",").alias("codes"))


def key_marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", T.fingerprint(F.concat(F.lit("sk-"), F.col("c_name"))).alias("mark"))


QUERIES = {f.__name__: f for f in (ask_prompt, memory_prompt, ask_answers, chat_append, point_read, sources_by_status, ingest_targets, ingest_summary, extraction_targets, extraction_summary, source_records, typed_lookup, add_files, soft_delete, redacted_settings, default_models, sorted_by_name, mail_batch, idle_instances, progress_throttle, eta_text, export_vtt, export_txt, speaker_markdown, verbose_words, summary_fields, meeting_markdown, wav_headers, ocr_export, voice_names, guess_names, device_lists, head_checks, migration_flags, present_files, plan_totals, most_vram, derivative_rank, recipe_match, plan_steps, slot_sources, companion_files, file_labels, output_kinds, budgets, kinds, changed_files, flag_dedup, settings_merge, parsed_segments, item_progress, memory_lines, remembered, tax_ids, key_marks)}


def _of(key: str, *values: object) -> str:
    """SQL of ``_pick``."""
    shown = ["NULL" if v is None else f"{v}" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in values]
    return f"([{', '.join(shown)}])[CAST({key} AS BIGINT) % {len(values)} + 1]"


_SRC = "SELECT d.doc_id AS id, lang, CASE WHEN n_chars < 200 THEN 'failed' WHEN n_chars < 500 THEN 'queued' ELSE 'done' END AS status, quality AS fields, toxic, n_chars AS added_at FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
_MEMORY = """SELECT conv_id, 'Memória geral do usuário:' || chr(10) || 'Always short.' || chr(10) || chr(10) || 'No jokes.' || chr(10) || chr(10) || 'Memória deste projeto:' || chr(10) || string_agg('- ' || text, chr(10) ORDER BY n) AS memory
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user' DESC, turn DESC, text) AS n FROM conversations WHERE conv_id % 2 = 0) WHERE n <= 2 GROUP BY conv_id"""
_ASK = f"""SELECT q.conv_id, CASE WHEN h.used > 0 THEN 'Você responde perguntas sobre os documentos do projeto "P' || q.conv_id || '", em português do Brasil. {L.SYSTEM[0]} {L.SYSTEM[1]}' || coalesce(' ' || chr(10) || m.memory, '') END AS system,
h.parts || chr(10) || chr(10) || chr(10) || chr(10) || 'Pergunta: ' || trim(q.text) AS user, coalesce(h.used, 0) AS used
FROM conversations q LEFT JOIN (SELECT conv_id, count(*) AS used, string_agg('[' || turn || '] f' || turn || CASE WHEN turn % 2 = 0 THEN ', página ' || turn ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS parts FROM conversations WHERE turn > 0 AND conv_id % 3 <> 0 GROUP BY 1) h ON h.conv_id = q.conv_id
LEFT JOIN ({_MEMORY}) m ON m.conv_id = q.conv_id WHERE q.turn = 0 AND trim(q.text) <> ''"""
_SPEAKER = "CASE WHEN turn % 3 <> 2 THEN role END"


def _time(s: str) -> str:
    ms = f"CAST(floor(({s}) * 1000 + 0.5) AS BIGINT)"
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


_CLOCK = "(CAST(floor(turn * 2.5 + 0.5) AS BIGINT) // 60) || ':' || lpad((CAST(floor(turn * 2.5 + 0.5) AS BIGINT) % 60)::VARCHAR, 2, '0')"
_SUM = "SELECT conv_id, conv_id % 7 = 0 AS broken, conv_id % 2 = 0 AS asks FROM conversations WHERE turn = 0"
_PART = "SELECT p_partkey AS k, * FROM part"
_REFS = "SELECT c_custkey AS ref, 'org/r' || (c_custkey % 60) AS repo, CASE WHEN c_custkey % 13 = 0 THEN 'f' || (c_custkey % 60) || '-0.gguf' END AS path, CASE WHEN c_custkey % 11 = 0 THEN 'sub' END AS subpath, CASE WHEN c_custkey % 2 = 0 THEN 'image' WHEN c_custkey % 3 = 0 THEN 'text' END AS kind FROM customer"
_RECIPES = f"SELECT 'r' || s_suppkey AS recipe, 'org/r' || (s_suppkey % 40) AS repo, list_position(['verified', 'community', 'draft', 'planned', 'other'], {_of('s_suppkey', 'draft', 'verified', 'planned', 'community', 'other')}) AS state FROM supplier"
_TREE = """SELECT 'org/r' || n AS repo, CASE WHEN k % 3 = 0 THEN 'sub/' WHEN k % 7 = 0 THEN 'images/' ELSE '' END || 'f' || n || '-' || (k // 80) || '.' || CASE WHEN n < 15 THEN 'gguf' WHEN n < 44 THEN 'json' WHEN n < 48 THEN 'ckpt' WHEN n < 52 THEN 'onnx' ELSE 'bin' END AS file,
CASE WHEN k % 5 = 0 THEN 0 ELSE 629145600 + k END AS size, n % 6 = 0 AS gated FROM (SELECT p_partkey AS k, p_partkey % 80 AS n FROM part)"""
_MATCH = f"SELECT ref, recipe, CAST(row_number() OVER (PARTITION BY ref ORDER BY state, recipe) AS INTEGER) AS rank FROM ({_REFS}) f JOIN ({_RECIPES}) r ON f.repo = r.repo"

ORACLE = {
    "memory_prompt": _MEMORY,
    "ask_prompt": _ASK,
    "ask_answers": f"SELECT conv_id, CASE WHEN used = 0 THEN '{L.NOT_FOUND}' ELSE length(system) || '/' || length(\"user\") END AS text, used FROM ({_ASK})",
    "chat_append": "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id) + row_number() OVER (PARTITION BY conv_id ORDER BY turn), 'user', 'again ' || text FROM conversations c WHERE turn < 2",
    "point_read": "SELECT * FROM documents WHERE doc_id = 17",
    "sources_by_status": f"SELECT id, status FROM ({_SRC}) WHERE status = 'queued'",
    "ingest_targets": f"SELECT id, status <> 'done' AS stale, id IN (1, 2, 3) AS named, true AS forced FROM ({_SRC})",
    "ingest_summary": f"SELECT lang, count(*) FILTER (status = 'queued') AS processed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'done') AS skipped, CAST(coalesce(sum(added_at) FILTER (status = 'queued'), 0) AS BIGINT) AS chunks FROM ({_SRC}) GROUP BY 1",
    "extraction_targets": f"SELECT id, h AS how FROM ({_SRC}), (VALUES ('open'), ('named'), ('all')) v(h) WHERE status = 'done' AND (h = 'all' OR (h = 'named' AND id BETWEEN 1 AND 5) OR (h = 'open' AND fields IS NULL))",
    "extraction_summary": f"SELECT lang, count(*) FILTER (toxic = 0) AS ok, count(*) FILTER (toxic <> 0) AS with_issues, count(*) FILTER (status = 'failed') AS failed FROM ({_SRC}) GROUP BY 1",
    "source_records": "SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, CASE WHEN event_id % 3 > 0 THEN json_extract_string(props, '$.k') END AS k, CAST(1 + (event_id % 3 > 0)::INT + (event_id % 2 = 0)::INT AS INTEGER) AS n_fields FROM events",
    "typed_lookup": f"SELECT p_partkey, t AS type, CASE t WHEN 'nfe' THEN 6 WHEN 'boleto' THEN 7 END::INTEGER AS hints, CASE WHEN t = 'nobody' THEN 'não consegui identificar o tipo do documento' END AS error FROM (SELECT p_partkey, {_of('p_partkey', 'nfe', 'boleto', 'nobody')} AS t FROM part)",
    "add_files": "WITH d AS (SELECT sha256(text) AS digest, doc_id::VARCHAR AS name, doc_id % 3 = 0 AS old FROM documents) SELECT digest, CASE WHEN bool_or(old) THEN min(name) FILTER (old) ELSE min(name) END AS name FROM d GROUP BY 1",
    "soft_delete": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN '2020' WHEN c_custkey % 2 = 0 THEN '2024' END AS deleted_at FROM customer",
    "redacted_settings": "SELECT 'k' || (n_nationkey % 3) AS key, CASE WHEN n_nationkey % 3 = 0 THEN CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE n_name END WHEN n_nationkey % 4 > 0 THEN '•••' END AS value, n_nationkey FROM nation",
    "default_models": f"""WITH c AS (SELECT p_brand, p_partkey AS id, {_of('p_partkey', 'speech', 'embeddings', 'text')} AS kind, p_partkey % 5 = 0 AS main, {_of('p_partkey', 'ggml-', 'Turbo ', 'x')} || p_name AS name FROM part)
SELECT p_brand, kind, arg_min(id, (NOT regexp_matches(name, '(?i)turbo'), id)) AS id FROM c WHERE kind = 'speech' AND (main OR regexp_matches(name, '(?i)whisper|ggml')) GROUP BY 1, 2
UNION ALL SELECT p_brand, kind, min(id) FROM c WHERE kind = 'embeddings' AND main GROUP BY 1, 2""",
    "sorted_by_name": "SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name)) AS place FROM nation",
    "mail_batch": """WITH m AS (SELECT o_custkey AS account, o_orderkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders
WHERE o_orderdate >= CASE WHEN o_custkey % 3 = 0 THEN TIMESTAMP '1996-01-01' WHEN o_custkey % 2 = 0 THEN TIMESTAMP '1994-06-01' ELSE TIMESTAMP '1900-01-01' END AND o_custkey IN (SELECT c_custkey FROM customer))
SELECT account, uid FROM m WHERE n <= CASE WHEN account % 5 = 0 THEN 3 ELSE 4 END""",
    "idle_instances": "SELECT event_id AS id FROM events WHERE event_type = 'view' AND ts < TIMESTAMP '2024-01-15' - INTERVAL 600 MINUTE",
    "progress_throttle": """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_id, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f AS (SELECT a.user_id, a.n, min(b.n) AS nxt FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.ms >= a.ms + 86400000 GROUP BY 1, 2),
r AS (SELECT user_id, n, NULL::BIGINT AS was FROM e WHERE n = 1 UNION ALL SELECT r.user_id, f.nxt, r.n FROM r JOIN f ON f.user_id = r.user_id AND f.n = r.n WHERE f.nxt IS NOT NULL)
SELECT r.user_id, x.ms, x.event_id AS done, round((x.event_id - y.event_id)::DOUBLE * 1000 / (x.ms - y.ms), 6) AS rate, r.user_id % 2 = 0 AND x.event_id > y.event_id AS timed
FROM r JOIN e x ON x.user_id = r.user_id AND x.n = r.n JOIN e y ON y.user_id = r.user_id AND y.n = r.was""",
    "eta_text": "SELECT o_orderkey, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN CAST(floor(s / 60.0 + 0.5) AS BIGINT) || 'min' ELSE ((s * 10 + 1800) // 3600 // 10) || '.' || ((s * 10 + 1800) // 3600 % 10) || 'h' END AS eta FROM (SELECT o_orderkey, o_orderkey * 7 % 20000 AS s FROM orders)",
    "export_vtt": f"SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_time('turn * 2.5')} || ' --> ' || {_time('turn * 2.5 + 2.25')} || chr(10) || coalesce({_SPEAKER} || ': ', '') || text || chr(10), chr(10) ORDER BY turn) AS vtt FROM conversations GROUP BY 1",
    "export_txt": f"SELECT conv_id, string_agg(coalesce({_SPEAKER} || ': ', '') || text, chr(10) ORDER BY turn) AS txt FROM conversations GROUP BY 1",
    "speaker_markdown": f"SELECT conv_id, string_agg(coalesce('**' || {_SPEAKER} || '**: ', '') || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1",
    "verbose_words": "SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text, max(turn) * 2.5::DOUBLE + 2.25::DOUBLE AS duration, CAST(count(*) AS INTEGER) AS n_segments, CAST(2 * count(*) FILTER (turn <> 1) AS INTEGER) AS n_words, coalesce(string_agg(role || ' ' || role, ' ' ORDER BY turn) FILTER (turn <> 1), '') AS words, count(*) - 1 AS last_id FROM conversations GROUP BY 1",
    "summary_fields": f"SELECT conv_id, CASE WHEN broken THEN '' ELSE 'all ' || conv_id END AS summary, CASE WHEN broken THEN '' ELSE 'go|stay' END AS decisions, CASE WHEN broken THEN '' ELSE 'do it/Ann' END AS actions, CASE WHEN NOT broken AND asks THEN 'why?' ELSE '' END AS questions FROM ({_SUM})",
    "meeting_markdown": f"""SELECT s.conv_id, '# M' || s.conv_id || chr(10) || chr(10) || '- Início: 1/2' || chr(10) || CASE WHEN asks THEN '- Fim: 1/3' || chr(10) ELSE '' END || '- Fontes: ' || CASE WHEN s.conv_id % 3 = 0 THEN '—' ELSE 'mic + system' END || chr(10) || chr(10)
|| CASE WHEN s.conv_id % 5 = 0 THEN '' WHEN broken THEN '## Resumo' || chr(10) || chr(10) || '—' || chr(10) || chr(10)
ELSE '## Resumo' || chr(10) || chr(10) || 'all ' || s.conv_id || chr(10) || chr(10) || '## Decisões' || chr(10) || chr(10) || '- go' || chr(10) || '- stay' || chr(10) || chr(10) || '## Ações' || chr(10) || chr(10) || '- do it — Ann' || chr(10) || chr(10)
|| CASE WHEN asks THEN '## Perguntas em aberto' || chr(10) || chr(10) || '- why?' || chr(10) || chr(10) ELSE '' END END || '## Transcrição' || chr(10) || chr(10) || l.lines AS markdown
FROM ({_SUM}) s JOIN (SELECT conv_id, string_agg('**' || {_CLOCK} || '** ' || coalesce('*' || {_SPEAKER} || '*: ', '') || text, chr(10) ORDER BY turn) AS lines FROM conversations GROUP BY 1) l ON l.conv_id = s.conv_id""",
    "wav_headers": "SELECT p_partkey, p_partkey % 11 > 0 AND p_partkey % 2 = 0 AND p_partkey % 3 < 2 AND p_partkey % 5 <> 1 AS ok FROM part",
    "ocr_export": """SELECT conv_id, '"arquivo","paginas","caracteres"' || chr(10) || string_agg('"a""b' || turn || '","' || (turn + 1) || '","' || length(text) || '"', chr(10) ORDER BY turn) AS csv,
string_agg('# a"b' || turn || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""",
    "voice_names": f"SELECT p_partkey, {_of('p_partkey', 'pt-BR', 'und', 'zh', 'und', 'en', 'de', 'fr-CA')} AS language, {_of('p_partkey', None, None, None, 'f', 'm', 'm', 'f')} AS gender, {_of('p_partkey', 'pt BR faber medium', 'multi lang v1 0', 'zh x', 'af bella', 'PM alex En', 'male.de', 'x female fr CA')} AS pretty FROM part",
    "guess_names": "SELECT p_partkey, " + ", ".join(f"{_of('p_partkey', *(v[i] for v in _NAMES.values()))} AS {n}" for i, n in enumerate(("kind", "role", "format"))) + " FROM part",
    "device_lists": """SELECT n_nationkey, 'dshow' AS tool, n_name || ':' || n_name || ':mic,CABLE Output:CABLE Output:system' AS devices FROM nation
UNION ALL SELECT n_nationkey, 'avfoundation', '1:' || n_name || ':mic,2:BlackHole 2ch:system' FROM nation
UNION ALL SELECT n_nationkey, 'pactl', lower(replace(n_name, ' ', '_')) || ':' || lower(replace(n_name, ' ', '_')) || ':mic,alsa.monitor:alsa.monitor:system' FROM nation""",
    "head_checks": f"""SELECT p_partkey, f AS found, CASE WHEN f = 'html' THEN 'html' WHEN e IN ('.gguf', '.json', '.zip', '.safetensors') AND f <> substr(e, 2) THEN substr(e, 2) WHEN e = '.onnx' AND f NOT IN ('onnx', 'bin') THEN 'onnx' END AS problem
FROM (SELECT p_partkey, {_of('p_partkey', *_HEADS)} AS f, lower({_of('p_partkey', *_EXTS)}) AS e FROM part)""",
    "migration_flags": f"""SELECT p_partkey, path, problem, CASE WHEN problem = 'partial' THEN NULL WHEN kind IS NOT NULL THEN kind WHEN problem IS NULL THEN 'image' END AS suggested FROM (
SELECT p_partkey, path, kind, CASE WHEN path = 'm/b.part' THEN 'partial' WHEN format = 'html' THEN 'html' WHEN kind IS NOT NULL THEN NULL WHEN path LIKE '%.json' THEN 'config' ELSE 'unknown' END AS problem FROM (
SELECT p_partkey, {_of('p_partkey', *_MOVED)} AS path, (['gguf', 'html', 'bin'])[CAST(floor(p_partkey / 10.0::DOUBLE % 3) AS BIGINT) + 1] AS format, CASE WHEN p_partkey % 4 = 0 THEN 'text' END AS kind FROM part) WHERE path IN ('m/a.gguf', 'm/b.part', 'm/d.json', 'm/fake', 'm/e.bin'))""",
    "present_files": "SELECT p_partkey AS path, p_partkey % 2 = 0 AND (p_partkey % 3 = 0 OR p_size = 0 OR CASE WHEN p_partkey % 5 = 0 THEN p_size = 1 ELSE true END) AS present FROM part",
    "plan_totals": "SELECT p_brand, CASE WHEN p_brand NOT IN ('Brand#1', 'Brand#2') THEN CAST(sum(p_size) AS BIGINT) END AS total FROM part GROUP BY 1",
    "most_vram": "SELECT s_nationkey, max(CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey * 10 ELSE 0 END) AS vram_mib FROM supplier GROUP BY 1",
    "derivative_rank": f"""SELECT p_brand, id, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY t, coalesce(d, 0) DESC, id) AS INTEGER) AS rank FROM (
SELECT p_brand, {_of('p_partkey', 'unsloth', 'Qwen', 'nobody', 'ggml-org', 'bartowski')} || '/m' || p_partkey AS id, {_of('p_partkey', 3, 5, 99, 0, 4)} AS t, CASE WHEN p_partkey % 7 > 0 THEN p_partkey % 50 END AS d FROM part)""",
    "recipe_match": _MATCH,
    "plan_steps": f"""WITH t AS (SELECT * FROM ({_TREE}) WHERE NOT regexp_matches(file, '^images/')), r AS ({_REFS}),
g AS (SELECT r.ref, any_value(r.repo) AS repo, any_value(r.path) AS path, any_value(r.subpath) AS subpath, any_value(r.kind) AS kind, coalesce(bool_or(t.file = r.path), false) AS named, min(file) FILTER (file LIKE '%.gguf') AS gguf,
arg_min(file, (size, file)) FILTER (file LIKE '%.ckpt' AND NOT contains(file, '/') AND size > 524288000) AS checkpoint, count(*) FILTER (file LIKE '%.onnx') AS n_onnx, min(file) FILTER (file LIKE '%.onnx') AS onnx, min(file) FILTER (NOT file LIKE '%.json' AND size > 0) AS raw
FROM r LEFT JOIN t ON t.repo = r.repo AND (r.subpath IS NULL OR starts_with(file, r.subpath || '/') OR file = r.path) GROUP BY r.ref),
h AS (SELECT * REPLACE (CASE WHEN subpath IS NULL OR starts_with(gguf, 'sub/') THEN gguf END AS gguf) FROM g),
m AS (SELECT ref, arg_min(recipe, (state, recipe)) AS recipe FROM r JOIN ({_RECIPES}) x ON x.repo = r.repo WHERE recipe < 'r3' GROUP BY 1),
c AS (SELECT 'org/r' || (48 + n_nationkey % 8) AS repo, arg_min({_of('n_nationkey', 'nobody', 'city96')} || '/d' || n_nationkey, (n_nationkey % 2 = 0, -n_nationkey)) AS derivative FROM nation GROUP BY 1),
p AS (SELECT h.ref, CASE WHEN named THEN path END AS p0, recipe, gguf, CASE WHEN kind IS NULL OR kind = 'image' THEN checkpoint END AS checkpoint, CASE WHEN subpath IS NOT NULL OR n_onnx <= 6 THEN onnx END AS onnx, derivative, raw FROM h LEFT JOIN m USING (ref) LEFT JOIN c ON c.repo = h.repo)
SELECT ref, CASE WHEN p0 IS NOT NULL THEN 'file' WHEN recipe IS NOT NULL THEN 'recipe' WHEN gguf IS NOT NULL THEN 'gguf' WHEN checkpoint IS NOT NULL THEN 'checkpoint' WHEN onnx IS NOT NULL THEN 'onnx' WHEN derivative IS NOT NULL THEN 'derivative' WHEN raw IS NOT NULL THEN 'raw' END AS step,
coalesce(p0, recipe, gguf, checkpoint, onnx, derivative, raw) AS pick FROM p""",
    "slot_sources": f"""WITH s AS (SELECT s_suppkey AS k, place, 'org/r' || ((s_suppkey + place * 30) % 90) AS repo, (s_suppkey + place * 30) % 90 AS n FROM supplier, range(3) r(place)),
h AS (SELECT s.k, s.place, s.repo, list_sort(list(file)) AS files, bool_or(gated) AS gated FROM s JOIN ({_TREE}) t ON t.repo = s.repo
WHERE CASE WHEN k % 2 = 0 THEN file = 'f' || n || '-1.json' ELSE regexp_matches(file, {_of('k', '^f[^/]*-[^/].json$', '^.*.gguf$', '^f[^/]*.ckpt$')}) END GROUP BY 1, 2, 3),
b AS (SELECT k, arg_min(repo, (gated, place)) AS repo, arg_min(files, (gated, place)) AS files, arg_min(place, (gated, place)) AS place FROM h GROUP BY 1)
SELECT 'r' || s_suppkey AS recipe, repo, CASE WHEN s_suppkey % 5 = 0 THEN array_to_string(files, ',') ELSE files[1] END AS files, CAST(coalesce(place, 3) AS INTEGER) AS tried FROM supplier LEFT JOIN b ON k = s_suppkey""",
    "companion_files": "SELECT c_custkey AS id, min('/m/' || p_brand || '/' || (p_partkey % 100) || '.bin') AS path FROM customer JOIN part ON p_partkey % 100 = c_custkey % 110 AND ends_with(p_brand, '#' || (c_custkey % 6)) GROUP BY 1",
    "file_labels": f"SELECT p_partkey, coalesce({_of('p_partkey', 'Q4_K_M', None, 'fp16')}, 'm-plain.bin') || ' · ' || CASE WHEN z >= 1073741824 THEN printf('%.2f', z / 1073741824.0::DOUBLE) || ' GB' WHEN z >= 1048576 THEN CAST(floor(z / 1048576.0 + 0.5) AS BIGINT) || ' MB' ELSE CAST(floor(z / 1024.0 + 0.5) AS BIGINT) || ' KB' END AS label FROM (SELECT p_partkey, p_partkey * 5000000 + 1 AS z FROM part)",
    "output_kinds": "SELECT n_nationkey AS id, n_name AS created_at, 'p' AS prompt, 'image' AS kind, NULL::INTEGER AS seconds FROM nation UNION ALL SELECT r_regionkey, CASE WHEN r_regionkey > 1 THEN r_name END, NULL, 'speech', 3 FROM region",
    "budgets": f"""SELECT p_partkey, CAST(round(CASE k WHEN 'text' THEN CASE WHEN v > 0 THEN greatest(v * 0.85::DOUBLE, least(r * 0.5::DOUBLE, 25769803776.0::DOUBLE)) ELSE r * 0.5::DOUBLE END WHEN 'image' THEN CASE WHEN v > 0 THEN greatest(v * 0.9::DOUBLE, r * 0.35::DOUBLE) ELSE r * 0.35::DOUBLE END ELSE r * 0.5::DOUBLE END, 0) AS BIGINT) AS budget,
CASE WHEN p_partkey % 4 = 1 THEN 0 ELSE CAST(floor(CASE k WHEN 'text' THEN m * 1.05::DOUBLE + 512 + 400 WHEN 'image' THEN m * 1.1::DOUBLE + 600 + 300 ELSE m * 1.2::DOUBLE + 200 END + 0.5) AS BIGINT) END AS vram
FROM (SELECT p_partkey, {_of('p_partkey', 'text', 'image', 'speech')} AS k, CASE WHEN p_partkey % 4 > 0 THEN p_partkey * 16 ELSE 0 END * 1048576::DOUBLE AS v, (p_partkey * 64 + 4096) * 1048576::DOUBLE AS r, p_partkey * 1000000 / 1048576::DOUBLE AS m FROM part)""",
    "kinds": f"""SELECT p_partkey, CASE WHEN n = 'a/Big-OCR' THEN 'ocr' WHEN t = 'text-to-image' THEN 'image' WHEN t = 'image-to-video' THEN 'video' WHEN t = 'automatic-speech-recognition' THEN 'speech' WHEN t = 'text-to-audio' THEN CASE WHEN n = 'a/music-x' THEN 'music' ELSE 'tts' END WHEN t = 'feature-extraction' THEN CASE WHEN n = 'a/rerank' THEN 'rerank' ELSE 'embeddings' END WHEN t = 'text-generation' THEN 'text' END AS kind, CAST({_of('p_partkey', 3, -5, -4, 0)} AS INTEGER) AS score
FROM (SELECT p_partkey, {_of('p_partkey', 'a/Big-OCR', 'a/music-x', 'a/rerank', 'a/tts-audio', 'a/plain')} AS n, {_of('p_partkey', 'text-to-image', 'text-to-audio', 'feature-extraction', 'text-generation', 'image-to-video', 'automatic-speech-recognition', 'other')} AS t FROM part)""",
    "changed_files": "SELECT p_partkey AS path FROM part WHERE p_partkey % 3 = 0 OR (p_partkey % 5 = 0 AND p_size <> 0)",
    "flag_dedup": """WITH a AS (SELECT l_orderkey AS cmd, l_linenumber AS pos, min(CASE WHEN l_linenumber % 2 = 1 THEN '-' || (l_partkey % 3) ELSE 'v' || l_linenumber END) AS arg FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, last_value(CASE WHEN arg[1] = '-' THEN arg END IGNORE NULLS) OVER w AS flag, count(*) FILTER (arg[1] = '-') OVER w AS run FROM a WINDOW w AS (PARTITION BY cmd ORDER BY pos ROWS UNBOUNDED PRECEDING))
SELECT cmd, pos, arg FROM (SELECT *, max(run) OVER (PARTITION BY cmd, flag) AS last FROM f) WHERE run = last""",
    "settings_merge": "SELECT n_nationkey, 'a=' || n_name || CASE WHEN n_nationkey % 2 = 0 THEN ',b=2' ELSE '' END || ',c=' || n_nationkey AS merged FROM nation",
    "parsed_segments": """SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq, turn + 1.5::DOUBLE AS start, turn + 2.0::DOUBLE AS "end", CASE WHEN turn % 2 = 0 THEN role ELSE 'x ' || role END AS text,
1 + CAST(coalesce(sum((turn % 2 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS speaker, 0.375::DOUBLE AS confidence, 1::INTEGER AS n_words, 'pt' AS language FROM conversations""",
    "item_progress": "SELECT conv_id, turn, round((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::DOUBLE / count(*) OVER (PARTITION BY conv_id), 9) AS progress FROM conversations",
    "memory_lines": f"""SELECT project_id, string_agg('## ' || (['Anotado por você', 'Fatos', 'Glossário'])[p + 1] || chr(10) || chr(10) || l, chr(10) || chr(10) ORDER BY p) AS markdown FROM (
SELECT conv_id AS project_id, turn % 4 AS p, string_agg('- ' || role || turn, chr(10) ORDER BY turn % 5 = 0 DESC, turn DESC, role || turn) AS l FROM conversations WHERE turn % 4 < 3 GROUP BY 1, 2) GROUP BY 1""",
    "remembered": "WITH c AS (SELECT trim(' ' || substr(text, 1, 3) || role) AS text FROM conversations) SELECT DISTINCT text FROM c WHERE length(text) BETWEEN 3 AND 400 AND text NOT IN (SELECT trim(' ' || substr(text, 1, 3) || role) FROM conversations WHERE ' ' || substr(text, 1, 3) || role LIKE 'a%')",
    "tax_ids": f"SELECT c_custkey, array_to_string(list_filter([{_of('c_custkey', None, 'cnpj_invalido:cnpjEmitente', None)}, {_of('c_custkey', None, 'cpf_invalido:cpf')}], lambda x: x IS NOT NULL), ',') AS codes FROM customer",
    "key_marks": "SELECT c_custkey, substr('sk-' || c_name, 1, 8) || '…' || substr(sha256('sk-' || c_name), 1, 12) AS mark FROM customer",
}
