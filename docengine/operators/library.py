"""Asking, selections, exports, transcripts, names, download plans and devices over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions.text import clock, cue_time, file_size, quant_from_name

from .scan import opened

#: What a model is told, and the answer where nothing was found.
SYSTEM = (
    "Use somente os trechos numerados fornecidos. Cite as fontes no formato [1], [2] logo após a informação.",
    "Se os trechos não responderem, diga exatamente o que falta — nunca invente números, datas ou nomes.",
)
NOT_FOUND = "Não encontrei nada sobre isso nos documentos deste projeto."


def _joined(order: str, value: Column, sep: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("v")))), lambda x: x["v"]), sep)


# Asking


def global_memory(text: Column) -> Column:
    """A memory file without its headings, trimmed, at most 4000 signs."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?m)^#.*$", ""), r"^\s+|\s+$", ""), 1, 4000)


def memory_prompts(memory: DataFrame, by: str, general: Column | None = None, limit: int = 40) -> DataFrame:
    """(by, memory): the general memory and a project's newest lines (text, pinned, created_at), pinned ones first."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc("pinned"), F.desc("created_at"), "text"))
    lines = memory.withColumn("_n", place).where(F.col("_n") <= limit).groupBy(by).agg(_joined("_n", F.concat(F.lit("- "), F.col("text")), "\n").alias("l"))
    whole = F.when(general != "", F.concat(F.lit("Memória geral do usuário:\n"), general)) if general is not None else F.lit(None).cast("string")
    return lines.select(by, F.concat_ws("\n\n", whole, F.concat(F.lit("Memória deste projeto:\n"), F.col("l"))).alias("memory"))


def ask_prompts(questions: DataFrame, hits: DataFrame, by: str, memory: DataFrame | None = None) -> DataFrame:
    """(by, system, user, used): what to ask a model for each question (question, project).

    ``hits`` has (by, n, name, page, text) in rank order.  Questions without hits have null prompts; their answer is ``NOT_FOUND``.
    """
    page = F.coalesce(F.concat(F.lit(", página "), F.col("page").cast("string")), F.lit(""))
    part = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("name"), page, F.lit("\n"), F.col("text"))
    found = hits.groupBy(by).agg(_joined("n", part, "\n\n").alias("parts"), F.count("*").alias("used"))
    q = questions.where(F.trim("question") != "").join(found, by, "left")
    q = q.join(memory, by, "left") if memory is not None else q.withColumn("memory", F.lit(None).cast("string"))
    intro = F.concat(F.lit('Você responde perguntas sobre os documentos do projeto "'), F.col("project"), F.lit('", em português do Brasil.'))
    system = F.concat_ws(" ", intro, *[F.lit(s) for s in SYSTEM], F.when(F.col("memory") != "", F.concat(F.lit("\n"), F.col("memory"))))
    user = F.concat(F.col("parts"), F.lit("\n\n\n\nPergunta: "), F.trim("question"))
    return q.select(by, F.when(F.col("used") > 0, system).alias("system"), user.alias("user"), F.coalesce("used", F.lit(0)).alias("used"))


def answers(prompts: DataFrame, model: Callable[[list[str], list[str]], list[str]], by: str, batch: int = 16) -> DataFrame:
    """(by, text, used): answers by an injected model of (systems, users), ``batch`` a call; none is asked where nothing was found."""

    @F.pandas_udf("string")
    def run(system, user):
        out = []
        for s in range(0, len(user), batch):
            out += model(system[s : s + batch].tolist(), user[s : s + batch].tolist())
        return type(user)(out, dtype=object)

    asked = prompts.where("used > 0").select(by, F.trim(run("system", "user")).alias("text"), "used")
    return asked.unionByName(prompts.where("used = 0").select(by, F.lit(NOT_FOUND).alias("text"), "used"))


def append_turns(turns: DataFrame, new: DataFrame, by: str, order: str = "turn") -> DataFrame:
    """Chat turns with new ones after the last of their chat, in the order they come in; unknown chats begin at 0."""
    last = turns.groupBy(by).agg(F.max(order).alias("_last"))
    n = F.row_number().over(W.partitionBy(by).orderBy("at"))
    more = new.join(last, by, "left").withColumn(order, (F.coalesce("_last", F.lit(-1)) + n).cast(turns.schema[order].dataType))
    return turns.unionByName(more.select(*turns.columns))


# Selections


def by_id(rows: DataFrame, key: str, value) -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def with_status(sources: DataFrame, status: str | None = None, newest: str = "added_at", key: str = "id") -> DataFrame:
    """Sources of a status (all without one), newest first."""
    return (sources if status is None else sources.where(F.col("status") == status)).orderBy(F.desc(newest), key)


def ingest_targets(sources: DataFrame, ids: list | None = None, force: bool = False, key: str = "id") -> DataFrame:
    """Sources with ``target``: the named ones, else all that aren't done (or all if forced); the others are skipped."""
    return sources.withColumn("target", F.col(key).isin(*ids) if ids else F.lit(force) | ~F.coalesce(F.col("status") == "done", F.lit(False)))


def ingest_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Outcomes (target, failed, chunks) -> processed, failed, skipped and the chunks of what was processed."""
    done = F.col("target") & ~F.col("failed")
    return outcomes.groupBy(*by).agg(F.count_if(done).alias("processed"), F.count_if(F.col("target") & F.col("failed")).alias("failed"), F.count_if(~F.col("target")).alias("skipped"), F.coalesce(F.sum(F.when(done, F.col("chunks"))), F.lit(0)).alias("chunks"))


def extraction_targets(sources: DataFrame, ids: list | None = None, force: bool = False, key: str = "id") -> DataFrame:
    """Done sources: the named ones, else those without fields (all if forced)."""
    done = sources.where(F.col("status") == "done")
    return done.where(F.col(key).isin(*ids)) if ids else done if force else done.where("fields is null")


def extraction_summary(results: DataFrame, by: list[str]) -> DataFrame:
    """Results (ok: null if not validated, error) -> ok, with_issues, failed."""
    return results.groupBy(*by).agg(F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("with_issues"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def source_records(rows: DataFrame, json: list[str]) -> DataFrame:
    """Rows as one ``record`` of JSON without null fields; the named columns hold JSON and are null where it can't be parsed."""
    cols = [F.try_parse_json(c).alias(c) if c in json else F.col(c) for c in rows.columns]
    return rows.select(F.to_json(F.struct(*cols)).alias("record"))


def typed_lookup(docs: DataFrame, types: DataFrame, key: str = "type") -> DataFrame:
    """Documents with their type's row; one of unknown type stays, with an error."""
    out = docs.join(F.broadcast(types.withColumn("_known", F.lit(True))), key, "left")  # a dimension of a few rows
    return out.withColumn("error", F.when(F.col("_known").isNull(), F.lit("não consegui identificar o tipo do documento"))).drop("_known")


def add_files(sources: DataFrame, files: DataFrame, digest: str = "digest") -> DataFrame:
    """Sources with those new files appended whose content isn't registered; of equal new files the first name counts."""
    once = files.groupBy(digest).agg(F.min_by(F.struct(*[c for c in files.columns if c != digest]), "name").alias("r")).select(digest, "r.*")
    return sources.unionByName(once.join(sources.select(digest), digest, "left_anti").select(*sources.columns))


def soft_delete(rows: DataFrame, gone: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows named in ``gone`` get ``deleted_at``; nothing is removed, and an earlier date stays."""
    mark = gone.select(key).distinct().withColumn("_gone", at)
    return rows.join(mark, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", "_gone")).drop("_gone")


def redacted(settings: DataFrame, secret: list[str], key: str = "key", value: str = "value") -> DataFrame:
    """Settings with secret values masked; an empty secret is null."""
    return settings.withColumn(value, F.when(F.col(key).isin(*secret), F.when(F.coalesce(F.col(value), F.lit("")) != "", F.lit("•••"))).otherwise(F.col(value)))


def default_models(catalog: DataFrame, by: str, kind: str, prefer: str | None = None, also: str | None = None) -> DataFrame:
    """(by, id): the first model of a kind whose role is main (or whose name fits ``also``), one whose name fits ``prefer`` before others."""
    fits = F.col("role") == "main"
    rows = catalog.where((F.col("kind") == kind) & (fits | F.regexp_like("name", F.lit(f"(?i){also}")) if also else fits))
    late = ~F.regexp_like("name", F.lit(f"(?i){prefer}")) if prefer else F.lit(False)
    return rows.groupBy(by).agg(F.min_by("id", F.struct(late.alias("late"), "place")).alias("id"))


def sorted_by_name(rows: DataFrame, name: str, locale: str = "pt") -> DataFrame:
    """Rows in the order of a language's alphabet."""
    return rows.orderBy(F.collate(F.col(name), locale))


def mail_batch(mails: DataFrame, accounts: DataFrame, by: str, limit: int = 50) -> DataFrame:
    """Mails to fetch: since the configured date, else the last sync, the newest ``limit`` of an account, in ascending order."""
    since = accounts.select(by, F.coalesce("since", "last_sync_at").alias("_since"), F.coalesce("most", F.lit(limit)).alias("_most"))
    m = mails.join(since, by).where(F.col("_since").isNull() | (F.col("at") >= F.col("_since")))
    n = F.row_number().over(W.partitionBy(by).orderBy(F.desc("uid")))
    return m.withColumn("_n", n).where(F.col("_n") <= F.col("_most")).drop("_n", "_most", "_since").orderBy(by, "uid")


def idle_instances(instances: DataFrame, now: Column, idle_minutes: int) -> DataFrame:
    """Ready instances to stop; 0 minutes stop none."""
    used = F.coalesce("last_used_at", "started_at")
    return instances.where(F.lit(idle_minutes > 0) & (F.col("status") == "ready") & (used < now - F.expr(f"interval {int(idle_minutes)} minutes")))


def throttled(reports: DataFrame, by: str, at: str, done: str, total: str, gap_ms: int = 500, parts: int | None = None) -> DataFrame:
    """(by, at, done, rate, eta): reports at least ``gap_ms`` after the last one shown; bytes a second since then, seconds left.

    The first report is the start.  One download's reports are spread over tasks (``docengine.operators.scan``).
    """
    r = reports.select(by, F.unix_millis(F.col(at).cast("timestamp")).alias("_ms"), F.col(done).cast("double").alias("_done"), F.col(total).cast("double").alias("_size"))
    shown = opened(r, by, "_ms", gap_ms, "_done", parts).where("_pos = _o_pos AND _p_at IS NOT NULL")
    rate = (F.col("_done") - F.col("_p_value")) * 1000 / (F.col("_ms") - F.col("_p_at"))
    out = shown.select(by, F.timestamp_millis("_ms").alias("at"), F.col("_done").alias("done"), rate.alias("rate"), "_size")
    left = F.when((F.col("_size") > 0) & (F.col("rate") > 0), F.floor((F.col("_size") - F.col("done")) / F.col("rate") + 0.5))
    return out.select(by, "at", "done", "rate", left.alias("eta"))


def eta_text(seconds: Column) -> Column:
    """Seconds, minutes or hours, rounded half up."""
    tenths = F.floor((seconds * 10 + 1800) / 3600)
    hours = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("h"))
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60 + 0.5).cast("string"), F.lit("min"))).otherwise(hours)


# Transcripts


def _said() -> Column:
    return F.concat(F.coalesce(F.concat(F.nullif(F.col("speaker"), F.lit("")), F.lit(": ")), F.lit("")), F.col("text"))


def to_vtt(segments: DataFrame, by: str, order: str) -> DataFrame:
    cue = F.concat(cue_time(F.col("start"), "."), F.lit(" --> "), cue_time(F.col("end"), "."), F.lit("\n"), _said(), F.lit("\n"))
    return segments.groupBy(by).agg(_joined(order, cue, "\n").alias("c")).select(by, F.concat(F.lit("WEBVTT\n\n"), F.col("c")).alias("vtt"))


def to_txt(segments: DataFrame, by: str, order: str) -> DataFrame:
    return segments.groupBy(by).agg(_joined(order, _said(), "\n").alias("txt"))


def speaker_markdown(segments: DataFrame, by: str, order: str) -> DataFrame:
    """A transcript as Markdown paragraphs that begin with the speaker."""
    line = F.concat(F.coalesce(F.concat(F.lit("**"), F.nullif(F.col("speaker"), F.lit("")), F.lit("**: ")), F.lit("")), F.col("text"))
    return segments.groupBy(by).agg(_joined(order, line, "\n\n").alias("markdown"))


def meeting_markdown(meetings: DataFrame, segments: DataFrame, by: str, order: str) -> DataFrame:
    """(by, markdown): a meeting (title, started, ended, sources, summary) with its parts and its lines.

    ``summary`` is what ``normal_summary`` gives, or null; empty parts are left out.
    """
    line = F.concat(F.lit("**"), clock(F.col("start")), F.lit("** "), F.coalesce(F.concat(F.lit("*"), F.nullif(F.col("speaker"), F.lit("")), F.lit("*: ")), F.lit("")), F.col("text"))
    m = meetings.join(segments.groupBy(by).agg(_joined(order, line, "\n").alias("_lines")), by, "left")
    s = F.col("summary")

    def part(title: str, lines: Column) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n")))

    actions = F.transform(s["actions"], lambda a: F.concat(a["text"], F.coalesce(F.concat(F.lit(" — "), a["owner"]), F.lit("")), F.coalesce(F.concat(F.lit(" ("), a["due"], F.lit(")")), F.lit(""))))
    said = F.when(s.isNotNull(), F.concat(F.lit("## Resumo\n\n"), F.coalesce(F.nullif(s["summary"], F.lit("")), F.lit("—")), F.lit("\n")))
    sources = F.concat(F.lit("- Fontes: "), F.coalesce(F.nullif(F.array_join("sources", " + "), F.lit("")), F.lit("—")), F.lit("\n"))
    head = [F.concat(F.lit("# "), F.col("title"), F.lit("\n")), F.concat(F.lit("- Início: "), F.col("started")), F.concat(F.lit("- Fim: "), F.col("ended")), sources]
    body = [said, part("Decisões", s["decisions"]), part("Ações", actions), part("Perguntas em aberto", s["questions"]), F.lit("## Transcrição\n"), F.col("_lines")]
    return m.select(by, F.concat_ws("\n", *head, *body).alias("markdown"))


def verbose(segments: DataFrame, by: str, order: str) -> DataFrame:
    """(by, text, duration, segments, words): segments numbered from 0 and the words of all of them in one list."""
    s = F.struct(order, "start", "end", "text", "speaker", "confidence", "words")
    g = segments.groupBy(by).agg(F.array_sort(F.collect_list(s)).alias("s"), F.max_by("end", order).alias("duration"))
    numbered = F.transform("s", lambda x, i: F.struct(i.alias("id"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), x["speaker"].alias("speaker"), x["confidence"].alias("avg_logprob")))
    none = F.array().cast(segments.schema["words"].dataType)
    return g.select(by, F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"), "duration", numbered.alias("segments"), F.flatten(F.transform("s", lambda x: F.coalesce(x["words"], none))).alias("words"))


def normal_summary(raw: Column) -> Column:
    """A model's JSON summary -> struct(summary, decisions, actions, questions): strings trimmed, other values left out."""
    v = F.try_parse_json(raw)
    text = lambda x, path="$": F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.trim(F.try_variant_get(x, path, "string")))

    def items(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))

    def strings(path: str) -> Column:
        return F.filter(F.transform(items(path), lambda x: text(x)), lambda x: x.isNotNull() & (x != ""))

    with_text = F.filter(items("$.actions"), lambda a: F.try_variant_get(a, "$.text", "variant").isNotNull())
    actions = F.transform(with_text, lambda a: F.struct(F.try_variant_get(a, "$.text", "string").alias("text"), F.nullif(text(a, "$.owner"), F.lit("")).alias("owner"), F.nullif(text(a, "$.due"), F.lit("")).alias("due")))
    return F.struct(F.coalesce(F.trim(F.try_variant_get(v, "$.summary", "string")), F.lit("")).alias("summary"), strings("$.decisions").alias("decisions"), actions.alias("actions"), strings("$.questions").alias("questions"))


def is_wav_16k_mono(content: Column) -> Column:
    """RIFF/WAVE, PCM, one channel, 16 kHz, by the first 44 bytes."""
    head = F.hex(F.substring(content, 1, 44))
    return (F.length(content) >= 44) & F.startswith(head, F.lit("52494646")) & (F.substring(head, 17, 8) == "57415645") & (F.substring(head, 41, 16) == "01000100803E0000")


def ocr_csv(files: DataFrame, by: str, order: str) -> DataFrame:
    """(by, csv): file, pages and signs of each recognised file (file, pages, markdown), every cell quoted."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", quoted(F.col("file")), quoted(F.col("pages")), quoted(F.length("markdown")))
    return files.groupBy(by).agg(F.concat(F.lit('"arquivo","paginas","caracteres"\n'), _joined(order, row, "\n")).alias("csv"))


def ocr_markdown(files: DataFrame, by: str, order: str) -> DataFrame:
    return files.groupBy(by).agg(_joined(order, F.concat(F.lit("# "), F.col("file"), F.lit("\n\n"), F.col("markdown")), "\n\n---\n\n").alias("markdown"))


# Names


def language_from_name(name: Column) -> Column:
    both = r"(?:^|[-_.])([a-z]{2})[-_]([A-Z]{2})(?=$|[-_.])"
    one = F.lower(F.regexp_extract(name, r"(?i)(?:^|[-_.])(pt|en|es|fr|de|it|zh|ja|ru)(?=$|[-_.])", 1))
    return F.when(F.regexp_like(name, F.lit(both)), F.concat_ws("-", F.regexp_extract(name, both, 1), F.regexp_extract(name, both, 2))).otherwise(F.coalesce(F.nullif(one, F.lit("")), F.lit("und")))


def gender_from_name(name: Column) -> Column:
    has = lambda p: F.regexp_like(name, F.lit(p))
    return F.when(has("(?i)^[pbaeijz]f_") | has("(?i)female|feminina"), "f").when(has("(?i)^[pbaeijz]m_") | has(r"(?i)\bmale|masculina"), "m")


def pretty_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "(?i)^(vits|matcha|kokoro)-", ""), "(?i)^piper-", ""), "[-_]", " "))


#: Name patterns in order of precedence -> kind and role, by extension.
GGUF_NAMES = (("whisper", "speech", "main"), ("ocr", "ocr", "main"), ("embed", "embeddings", "main"), ("rerank", "rerank", "main"))
DIFFUSION_NAMES = "flux|sd3|sdxl|stable-diffusion|wan|ltx|z-image|qwen-image|chroma|hidream"
TENSOR_NAMES = (("lora", "image", "lora"), (r"vae|\bae\b", "image", "vae"), ("t5|clip|umt5|text.?encoder", "image", "text_encoder"), ("controlnet", "image", "controlnet"), ("wan|ltx|hunyuan.?video|cogvideo", "video", "diffusion"), ("flux|sd3|z-image|qwen-image|chroma|hidream", "image", "diffusion"))


def guess_from_name(name: Column) -> Column:
    """struct(kind, role, format) that a file's name suggests; nulls and role unknown where it suggests nothing."""
    f = F.lower(name)
    base = F.substring_index(f, "/", -1)
    ext = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    has = lambda p, x=f: F.regexp_like(x, F.lit(p))
    is_ = lambda kind, role, form: F.struct((kind if isinstance(kind, Column) else F.lit(kind).cast("string")).alias("kind"), (role if isinstance(role, Column) else F.lit(role)).alias("role"), F.lit(form).cast("string").alias("format"))
    gguf, tensors = ext == ".gguf", ext.isin(".safetensors", ".ckpt", ".pt")
    out = F.when(has("mmproj"), is_("vision", "mmproj", "gguf"))
    for pattern, kind, role in GGUF_NAMES:
        out = out.when(gguf & has(pattern), is_(kind, role, "gguf"))
    part = F.when(has(r"vae|ae\."), "vae").when(has("t5|clip|umt5|text.?encoder"), "text_encoder").otherwise("diffusion")
    out = out.when(gguf & has(DIFFUSION_NAMES), is_(F.when(has("wan|ltx"), "video").otherwise("image"), part, "gguf")).when(gguf, is_("text", "main", "gguf"))
    out = out.when((ext == ".bin") & has("^ggml-|whisper", base), is_("speech", "main", "ggml"))
    for pattern, kind, role in TENSOR_NAMES:
        out = out.when(tensors & has(pattern), is_(kind, role, "safetensors"))
    out = out.when(tensors, is_("image", "main", "safetensors"))
    voice = has(r"^[a-z]{2,3}_[a-z]{2}-[a-z0-9_]+-(x_low|low|medium|high)\.onnx$", base) | has("voice|piper|kokoro")
    out = out.when(ext == ".onnx", is_(F.when(has("ocr|det|rec|cls"), "ocr").otherwise("tts"), F.when(voice, "voice").otherwise("main"), "onnx"))
    return out.when(ext == ".json", is_(None, "config", "json")).otherwise(is_(None, "unknown", None))


def audio_devices(output: Column, kind: str) -> Column:
    """What a tool printed -> array of struct(id, name, kind); ``kind`` is dshow, avfoundation or pactl."""
    lines = F.split(output, r"\r?\n")
    system = {"dshow": "(?i)virtual-audio-capturer|stereo mix|mixagem|loopback|cable output|what u hear", "avfoundation": "(?i)blackhole|loopback|soundflower|aggregate", "pactl": r"\.monitor$"}[kind]
    of = lambda name: F.when(F.regexp_like(name, F.lit(system)), "system").otherwise("mic")
    device = lambda id_, name: F.struct(id_.alias("id"), name.alias("name"), of(name).alias("kind"))
    if kind == "dshow":
        shape = r'(?i)"([^"]+)"\s*\(audio\)'
        return F.transform(F.filter(lines, lambda x: F.regexp_like(x, F.lit(shape))), lambda x: device(F.regexp_extract(x, shape, 1), F.regexp_extract(x, shape, 1)))
    if kind == "pactl":
        name = lambda x: F.coalesce(F.try_element_at(F.split(x, r"\s+"), F.lit(2)), F.lit(""))
        return F.transform(F.filter(lines, lambda x: name(x) != ""), lambda x: device(name(x), name(x)))
    # Only what stands after a heading for audio, up to one for video.
    audio = F.array_join(F.transform(F.split(output, "(?i)(?=[^\n]*AVFoundation (?:audio|video) devices)"), lambda x: F.when(F.regexp_like(x, F.lit("(?i)^[^\n]*AVFoundation audio devices")), x).otherwise("")), "\n")
    shape = r"\[(\d+)\]\s+(.+?)\s*$"
    found = F.filter(F.split(audio, r"\r?\n"), lambda x: F.regexp_like(x, F.lit(shape)) & ~F.regexp_like(x, F.lit("(?i)AVFoundation audio devices")))
    return F.transform(found, lambda x: device(F.regexp_extract(x, shape, 1), F.regexp_extract(x, shape, 2)))


# The library and its downloads


def head_problem(found: Column, ext: Column) -> Column:
    """Why the first bytes of a download (format ``found``) aren't those of its extension, or null: html, or what was expected."""
    want = F.lower(ext)
    bad = F.lit(False)
    for e, formats in ((".gguf", ("gguf",)), (".safetensors", ("safetensors",)), (".onnx", ("onnx", "bin")), (".json", ("json",)), (".zip", ("zip",))):
        bad = bad | ((want == e) & ~found.isin(*formats))
    return F.when(found == "html", "html").when(bad, F.substring(want, 2, 16))


#: Weights by their extension, and folders of a repository that hold none.
WEIGHTS = r"(?i)\.(gguf|safetensors|ckpt|pt|pth|bin|onnx)$"
NO_WEIGHTS = r"(?i)^(images?|assets|examples|samples|docs?|wheel|figures?)/"


def migration_flags(files: DataFrame, sidecar: str = ".sidecar.json") -> DataFrame:
    """Files to take over (folder, hint, path, format, kind) with ``problem`` (partial, html, config, unknown or null) and ``suggested`` kind.

    Side files, hidden ones, data files and JSON below the top of a folder are out.
    """
    name, top = F.substring_index("path", "/", -1), F.regexp_replace("path", "/[^/]*$", "") == F.col("folder")
    like = lambda p: F.regexp_like(name, F.lit(p))
    weight, json_ = like(WEIGHTS), like(r"(?i)\.json$")
    partial = like(r"(?i)\.(crdownload|part|tmp|download)$")
    bare = ~like(r"[^.]\.[^.]*$") & top
    kept = partial | ((weight | json_ | like(r"(?i)\.zip$") | bare) & (~json_ | top))
    f = files.where(~like(r"^\.") & ~F.endswith(name, F.lit(sidecar)) & kept)
    problem = F.when(partial, "partial").when(F.col("format") == "html", "html").when(F.col("kind").isNotNull(), None).when(json_, "config").otherwise("unknown")
    return f.withColumn("problem", problem).withColumn("suggested", F.when(~partial, F.coalesce("kind", F.when(F.col("problem").isNull(), F.col("hint")))))


def present_files(planned: DataFrame, there: DataFrame) -> DataFrame:
    """Planned files (path, size) with ``present``: there already, and of that size if one is known."""
    t = there.select("path", F.col("size").alias("_size"))
    known = F.coalesce(F.col("size"), F.lit(0)) > 0
    return planned.join(t, "path", "left").withColumn("present", F.coalesce(F.col("_size").isNotNull() & (~known | (F.col("_size") == F.col("size"))), F.lit(False))).drop("_size")


def total_bytes(files: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """(by, total): unknown sizes count nothing; a total of nothing is null."""
    return files.groupBy(*by).agg(F.nullif(F.sum(F.coalesce(F.col(size), F.lit(0))), F.lit(0)).alias("total"))


#: Makers of conversions, most trusted first, and states of recipes.
TRUSTED = ("ggml-org", "leejet", "city96", "unsloth", "bartowski", "qwen", "microsoft", "google", "mradermacher", "lmstudio-community", "second-state", "gpustack")
STATES = ("verified", "community", "draft", "planned")


def _place(value: Column, order: tuple[str, ...]) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at > 0, at - 1).otherwise(len(order)).cast("int")


def ranked_derivatives(found: DataFrame, by: str, repo: str = "id", downloads: str = "downloads") -> DataFrame:
    """Conversions of a repository with ``rank``: trusted makers first, then by downloads."""
    trust = _place(F.lower(F.substring_index(repo, "/", 1)), TRUSTED)
    return found.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(trust, F.desc(F.coalesce(F.col(downloads), F.lit(0))), repo)))


def _states(recipes: DataFrame) -> DataFrame:
    return recipes.select("recipe", F.lower("repo").alias("_known"), _place(F.col("status"), STATES).alias("_state"))


def recipes_for(refs: DataFrame, recipes: DataFrame) -> DataFrame:
    """(ref, recipe, rank): recipes (recipe, repo, status) of each reference's repository, whatever its case, best state first."""
    out = refs.select("ref", F.lower("repo").alias("_known")).join(_states(recipes).distinct(), "_known")
    return out.select("ref", "recipe", F.row_number().over(W.partitionBy("ref").orderBy("_state", "recipe")).alias("rank"))


def glob_pattern(glob: Column) -> Column:
    """A glob as a regular expression: ``**`` crosses folders, ``*`` and ``?`` don't."""
    s = F.regexp_replace(glob, r"([.+^$(){}|\[\]\\])", r"\\$1")
    s = F.replace(F.replace(s, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*"))
    return F.concat(F.lit("^"), F.replace(F.replace(s, F.lit("?"), F.lit("[^/]")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def resolve_slots(sources: DataFrame, tree: DataFrame) -> DataFrame:
    """(recipe, slot, repo, files, tried): for each slot the first source, in order, that a repository can serve.

    ``sources`` has (recipe, slot, place, repo, path, glob, many): an exact path or a glob, and whether all matches are taken or the first by
    name.  ``tree`` has (repo, path, gated).  Gated repositories serve only if no other source of the slot does.  ``tried`` counts
    the sources before the chosen one.  Slots that nothing serves have null files.
    """
    # A pattern meets a repository's files once, however many sources ask for it; whole lists go to the chosen sources only.
    s = sources.withColumn("_ask", F.struct(F.col("path").alias("p"), F.when(F.col("path").isNull(), F.col("glob")).alias("g")))
    t = tree.select(F.col("repo").alias("_repo"), F.col("path").alias("file"), "gated")
    here = F.col("repo") == F.col("_repo")
    asked = s.groupBy("repo", "_ask.p", "_ask.g").agg(F.max("many").alias("_all"))
    hits = asked.join(t, here & (F.col("p") == F.col("file"))).unionAll(asked.where("g IS NOT NULL").join(t, here).where(F.regexp_like("file", glob_pattern(F.col("g")))))
    hits = hits.groupBy("_repo", "p", "g").agg(F.min("file").alias("first"), F.collect_list(F.when(F.col("_all"), F.col("file"))).alias("list"))
    asks = lambda ask: here & F.col(f"{ask}.p").eqNullSafe(F.col("p")) & F.col(f"{ask}.g").eqNullSafe(F.col("g"))
    hit = s.select("recipe", "slot", "place", "repo", "many", "_ask").join(hits.drop("list"), asks("_ask"), "left").drop("_repo")
    hit = hit.join(t.groupBy("_repo").agg(F.max("gated").alias("gated")), here, "left")
    each = hit.groupBy("recipe", "slot", "place", "repo", "many").agg(F.min("first").alias("first"), F.collect_list(F.when(F.col("many"), F.col("_ask"))).alias("asks"), F.max("gated").alias("gated"))
    rank = F.struct(F.col("first").isNull().alias("none"), F.coalesce("gated", F.lit(False)).alias("gated"), "place")
    best = each.groupBy("recipe", "slot").agg(F.min_by(F.struct("repo", "first", "place", "asks"), rank).alias("b"), F.count("*").alias("n"))
    got = F.col("b.first").isNotNull()
    best = best.select("recipe", "slot", F.when(got, F.col("b.repo")).alias("repo"), F.col("b.first").alias("top"), F.when(got, F.col("b.place")).otherwise(F.col("n")).cast("int").alias("tried"), F.explode_outer("b.asks").alias("_ask"))
    whole = best.join(hits.drop("first"), asks("_ask"), "left").groupBy("recipe", "slot", "repo", "top", "tried").agg(F.array_sort(F.flatten(F.collect_list("list"))).alias("list"))
    files = F.when(F.size("list") > 0, F.col("list")).when(F.col("top").isNotNull(), F.array("top"))
    return whole.select("recipe", "slot", "repo", files.alias("files"), "tried")


#: The steps of a plan, in order.
STEPS = ("file", "recipe", "gguf", "checkpoint", "onnx", "derivative", "raw")


def plan_steps(refs: DataFrame, tree: DataFrame, recipes: DataFrame, derivatives: DataFrame) -> DataFrame:
    """(ref, step, pick): how each reference (ref, repo, path, subpath, kind) is served, and the file, recipe or conversion picked.

    A named file, else a recipe that knows the repository, else its GGUF files, a single checkpoint, an ONNX pack, the best
    conversion, or its weights as they are.  ``tree`` has (repo, path, size).
    """
    # Files are summed up once for their repository (no folder) and once for each folder that they are in, not for each reference.
    parts = F.split("file", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i > 0, F.array_join(F.slice(parts, 1, i), "/")))
    t = tree.select(F.col("repo").alias("_repo"), F.col("path").alias("file"), "size").where("file IS NOT NULL")
    like = lambda p: F.regexp_like("file", F.lit(p))
    root = like(r"(?i)^[^/]+\.(safetensors|ckpt)$") & (F.coalesce(F.col("size"), F.lit(0)) > 500 << 20)
    per = t.where(~like(NO_WEIGHTS)).withColumn("_folder", F.explode(folders)).groupBy("_repo", "_folder").agg(
        F.min(F.when(like(r"(?i)\.gguf$"), F.col("file"))).alias("gguf"),
        F.min_by(F.when(root, F.col("file")), F.when(root, F.struct((-_checkpoint(F.col("file"))).alias("s"), "size", "file"))).alias("checkpoint"),
        F.count_if(like(r"(?i)\.onnx$")).alias("n_onnx"),
        F.min(F.when(like(r"(?i)\.onnx$"), F.col("file"))).alias("onnx"),
        F.min(F.when(like(WEIGHTS) & (F.col("size") > 0), F.col("file"))).alias("raw"),
    )
    names = t.select(F.col("_repo").alias("_in"), "file").distinct()
    g = refs.select("ref", "repo", "path", "subpath", "kind").distinct()
    g = g.join(names, (F.col("repo") == F.col("_in")) & (F.col("path") == F.col("file")), "left").withColumn("named", F.col("file").isNotNull())
    g = g.join(per, (F.col("repo") == F.col("_repo")) & F.col("subpath").eqNullSafe(F.col("_folder")), "left")
    known = _states(recipes).groupBy("_known").agg(F.min(F.struct("_state", "recipe")).alias("_best"))
    best = refs.select("ref", F.lower("repo").alias("_known")).join(known, "_known").groupBy("ref").agg(F.min("_best").alias("_best")).select("ref", "_best.recipe")
    conv = ranked_derivatives(derivatives, "repo").where("rank = 1").select(F.col("repo").alias("_conv"), F.col("id").alias("derivative"))
    g = g.join(best, "ref", "left").join(conv, F.col("repo") == F.col("_conv"), "left")
    image = F.col("kind").isNull() | (F.col("kind") == "image")
    picks = {"file": F.when(F.col("named"), F.col("path")), "recipe": F.col("recipe"), "gguf": F.col("gguf"), "checkpoint": F.when(image, F.col("checkpoint")), "onnx": F.when(F.col("subpath").isNotNull() | (F.col("n_onnx") <= 6), F.col("onnx")), "derivative": F.col("derivative"), "raw": F.col("raw")}
    found = F.coalesce(*[F.when(picks[s].isNotNull(), F.struct(F.lit(s).alias("step"), picks[s].alias("pick"))) for s in STEPS])
    return g.select("ref", found.alias("f")).select("ref", "f.step", "f.pick")


def _checkpoint(path: Column) -> Column:
    from docengine.operators.records import checkpoint_score

    return checkpoint_score(path)


def companions(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): the first file whose path ends in each wanted suffix (id, suffix).

    Files are cut to the lengths of the suffixes with their last part, and meet them by what is left.
    """
    last = lambda c: F.substring_index(c, "/", -1).alias("_last")
    w = wanted.select("id", "suffix", last("suffix"))
    sizes = w.select("_last", F.length("suffix").alias("_size")).distinct()
    ends = files.select("path", last("path")).distinct().join(sizes, "_last").groupBy("_last", F.right("path", F.col("_size")).alias("suffix")).agg(F.min("path").alias("path"))
    return w.join(ends, ["_last", "suffix"]).groupBy("id").agg(F.min("path").alias("path"))


def most_vram(devices: DataFrame, by: str) -> DataFrame:
    return devices.groupBy(by).agg(F.max(F.coalesce("vram_mib", F.lit(0))).alias("vram_mib"))


def with_label(files: DataFrame) -> DataFrame:
    """Alternative files with the label shown for them: the quantisation, or the name, and the size."""
    return files.withColumn("label", F.concat(F.coalesce(quant_from_name(F.col("path")), F.substring_index("path", "/", -1)), F.lit(" · "), file_size(F.col("size"))))


def outputs(**by_kind: DataFrame) -> DataFrame:
    """Outputs of several kinds in one table, newest first; columns that a kind lacks are null."""
    out = None
    for kind, rows in by_kind.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.orderBy(F.desc(F.coalesce("created_at", F.lit(""))), "id")
