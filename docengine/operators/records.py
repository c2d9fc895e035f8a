"""Job logs, reports, transcripts, catalogs and resource planning over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions.text import clock, cue_time

from .scan import running_sums


def latest_jobs(log: DataFrame, key: str, at: Column, first: list[str], last: list[str]) -> DataFrame:
    """One row per job: ``first`` columns as first recorded, ``last`` columns as last recorded."""
    return log.groupBy(key).agg(F.min_by(F.struct(*first), at).alias("a"), F.max_by(F.struct(*last), at).alias("b"), F.count("*").alias("n_events")).select(key, "a.*", "b.*", "n_events")


def recover_orphans(jobs: DataFrame, status: str = "status") -> DataFrame:
    return jobs.withColumn(status, F.when(F.col(status).isin("queued", "running"), "failed").otherwise(F.col(status)))


def retained(jobs: DataFrame, ended: str, as_of: Column, days: int = 30) -> DataFrame:
    """Without jobs that ended more than ``days`` days before ``as_of``; jobs that haven't ended stay."""
    return jobs.where(F.col(ended).isNull() | (F.col(ended) >= as_of - F.expr(f"interval {int(days)} days")))


def history(live: DataFrame, stored: DataFrame, key: str, order: str, limit: int = 500, kind: str | None = None) -> DataFrame:
    """Live jobs and stored ones that aren't live, newest first; of one ``kind``, if one is asked for."""
    if kind:
        live, stored = live.where(F.col("kind") == kind), stored.where(F.col("kind") == kind)
    return live.unionByName(stored.join(live.select(key), key, "left_anti").select(*live.columns)).orderBy(F.desc(order), key).limit(min(limit, 500))


def running_by_kind(jobs: DataFrame, limits: dict[str, int], default: int = 2) -> DataFrame:
    """(kind, running, free): running jobs against the limit of their kind."""
    table = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.create_map().cast("map<string,int>")
    g = jobs.groupBy("kind").agg(F.count_if(F.col("status") == "running").alias("running"))
    return g.withColumn("free", F.greatest(F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(default)) - F.col("running"), F.lit(0)))


#: Allowed moves of a job.
MOVES = {None: ("queued",), "queued": ("running", "cancelled", "failed"), "running": ("done", "failed", "cancelled", "running")}


def illegal_moves(log: DataFrame, key: str, order: Column, status: str = "status") -> DataFrame:
    """Log rows whose status can't follow the job's previous one."""
    before = F.lag(status).over(W.partitionBy(key).orderBy(order))
    ok = F.lit(False)
    for was, to in MOVES.items():
        ok = ok | ((F.col("_was").isNull() if was is None else F.col("_was") == was) & F.col(status).isin(*to))
    return log.withColumn("_was", before).where(~F.coalesce(ok, F.lit(False))).withColumnRenamed("_was", "previous")


def project_report(sources: DataFrame, by: list[str]) -> DataFrame:
    """Counts of sources by state."""
    return sources.groupBy(*by).agg(F.count("*").alias("sources"), F.count_if(F.col("status") == "done").alias("indexed"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("extracted")).alias("extracted"), F.count_if(~F.col("ok")).alias("with_issues"))


def progress(items: DataFrame, by: str, order: str) -> DataFrame:
    """Share of a job's items that are done before each item."""
    w = W.partitionBy(by)
    return items.withColumn("progress", (F.row_number().over(w.orderBy(order)) - 1) / F.count("*").over(w))


def speakers(segments: DataFrame, by: str, order: str, turn_end: Column, text: str = "text") -> DataFrame:
    """Number of the speaker of each segment: one more than the turns that ended before it.  Blank segments count turns, then go."""
    summed = running_sums(segments, by, F.col(order), turn_end.cast("int"))
    return summed.withColumn("speaker", 1 + F.col("_before")).drop("_before", "_total").where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")


def parse_segments(raw: DataFrame, json: str = "raw", by: str = "id", offset: float = 0.0) -> DataFrame:
    """Recogniser output -> one row per segment: id, seq, start, end, text, speaker, confidence, words."""
    schema = "result struct<language:string>, transcription array<struct<offsets:struct<`from`:double,`to`:double>, text:string, speaker_turn_next:boolean, tokens:array<struct<text:string,p:double,offsets:struct<`from`:double,`to`:double>>>>>"
    s = raw.select(by, F.from_json(json, schema).alias("j")).select(by, F.col("j.result.language").alias("language"), F.posexplode("j.transcription").alias("seq", "s"))
    marker = F.lit(r"\[SPEAKER_TURN\]\s*$")
    s = s.withColumn("turn_end", F.coalesce("s.speaker_turn_next", F.lit(False)) | F.regexp_like("s.text", marker))
    s = s.withColumn("text", F.trim(F.regexp_replace("s.text", r"\[SPEAKER_TURN\]", "")))
    s = speakers(s, by, "seq", F.col("turn_end"))
    p = F.filter(F.transform("s.tokens", lambda t: t["p"]), lambda x: x.isNotNull())
    mean = F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size(p)
    sec = lambda ms: ms / 1000 + F.lit(offset)
    words = F.filter("s.tokens", lambda t: t["offsets"].isNotNull() & (F.trim(t["text"]) != "") & ~F.regexp_like(F.trim(t["text"]), F.lit(r"^\[.*\]$")))
    words = F.transform(words, lambda t: F.struct(F.trim(t["text"]).alias("word"), sec(t["offsets"]["from"]).alias("start"), sec(t["offsets"]["to"]).alias("end")))
    return s.select(by, "seq", sec(F.col("s.offsets.from")).alias("start"), sec(F.col("s.offsets.to")).alias("end"), "text", "speaker", F.when(F.size(p) > 0, F.floor(mean * 1000 + 0.5) / 1000).alias("confidence"), words.alias("words"), "language")


def transcript(segments: DataFrame, by: str, order: str, text: str = "text", end: str = "end") -> DataFrame:
    """(by, text, duration, n_segments): segments joined in order."""
    g = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("s"), F.max_by(end, order).alias("duration"), F.count("*").alias("n_segments"))
    return g.select(by, F.array_join(F.transform("s", lambda x: x["t"]), " ").alias("text"), "duration", "n_segments")


def cues(segments: DataFrame, by: str, order: str, start: str = "start", end: str = "end", text: str = "text", vtt: bool = False) -> DataFrame:
    """(by, n, cue): numbered subtitle cues."""
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    mark = "." if vtt else ","
    body = F.concat(cue_time(F.col(start), mark), F.lit(" --> "), cue_time(F.col(end), mark), F.lit("\n"), F.col(text))
    return segments.withColumn("n", n).select(by, "n", body.alias("cue") if vtt else F.concat(F.col("n").cast("string"), F.lit("\n"), body).alias("cue"))


def overlapping(segments: DataFrame, start: Column, end: Column, lo: float, hi: float) -> DataFrame:
    return segments.where((end > lo) & (start < hi))


def prompt_transcript(segments: DataFrame, by: str, order: str, limit: int, start: str = "start", text: str = "text") -> DataFrame:
    """Lines with clocks; over ``limit`` signs the first and last half with a note between."""
    line = F.concat(F.lit("["), clock(F.col(start)), F.lit("] "), F.col(text))
    g = segments.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("l")))).alias("s"))
    full = F.array_join(F.transform("s", lambda x: x["l"]), "\n")
    half = limit // 2
    cut = F.concat(F.substring(full, 1, half), F.lit("\n\n[… trecho do meio omitido por tamanho …]\n\n"), F.right(full, F.lit(half)))
    return g.select(by, F.when(F.length(full) <= limit, full).otherwise(cut).alias("text"))


def evictions(running: DataFrame, by: str, last_used: Column, size: Column, need: float, budget: float) -> DataFrame:
    """Instances to stop, least recently used first, until ``need`` more fits into ``budget``."""
    if not need or not budget:
        return running.where("false")
    summed = running_sums(running, by, last_used, size)
    return summed.where(F.col("_total") - F.col("_before") + need > budget).drop("_before", "_total")


def pick_by_preference(files: DataFrame, by: str, quant: str, size: str, path: str, prefer: list[str] | Column, budget: Column, override: str | None = None) -> DataFrame:
    """One file per group: the override, else the first preferred that fits, else the smallest.  A column ``prefer`` holds small letters."""
    q = F.lower(F.coalesce(F.col(quant), F.lit("")))
    wanted = prefer if isinstance(prefer, Column) else F.array(*[F.lit(p.lower()) for p in prefer])
    place = F.array_position(wanted, q).cast("int")
    fits = F.col(size) <= budget
    exact = q == override.lower() if override else F.lit(False)
    good = (place > 0) & fits
    rank = F.struct((~exact).alias("a"), (~good).alias("b"), F.when(good, place).otherwise(0).alias("c"), F.when(good & ~exact, 0).otherwise(F.col(size)).alias("d"), F.col(path).alias("e"))
    picked = files.groupBy(by).agg(F.min_by(F.struct(path, size, quant, fits.alias("fits")), rank).alias("r"))
    return picked.select(by, "r.*")


def shard_groups(files: DataFrame, path: str = "path", size: str = "size") -> DataFrame:
    """Split files (``name-00001-of-00003.ext``) as one row: the first part's path and the sum of sizes."""
    base = F.regexp_replace(path, r"-\d{5}-of-(\d{5})", "-of-$1")
    g = files.groupBy(base.alias("base")).agg(F.min(path).alias("path"), F.nullif(F.sum(F.coalesce(F.col(size), F.lit(0))), F.lit(0)).alias("size"), F.count("*").alias("parts"))
    return g.drop("base")


def split_ranges(df: DataFrame, total: Column, chunks: Column) -> DataFrame:
    """One row per contiguous byte range: index, start, end (inclusive)."""
    size = F.ceil(total / chunks)
    i = F.explode(F.sequence(F.lit(0), F.greatest(chunks - 1, F.lit(0))))
    out = df.withColumn("_size", size).withColumn("_total", total).withColumn("index", i).withColumn("start", F.col("index") * F.col("_size"))
    return out.where(F.col("start") < F.col("_total")).withColumn("end", F.least(F.col("_total"), F.col("start") + F.col("_size")) - 1).drop("_size", "_total")


def parallel_parts(total: Column, ranges: Column, configured: int) -> Column:
    """Connections for a download: one below 64 MiB or without ranges, else one per 32 MiB."""
    many = F.greatest(F.lit(2), F.least(F.lit(configured), F.ceil(total / (32 << 20)))).cast("int")
    return F.when((F.lit(configured) <= 1) | ~ranges | total.isNull() | (total < 64 << 20), 1).otherwise(many)


def budget_bytes(kind: Column, vram_mib: Column, ram_mib: Column) -> Column:
    mib = float(1 << 20)
    vram, ram = F.coalesce(vram_mib, F.lit(0)) * mib, ram_mib * mib
    text = F.when(vram > 0, F.greatest(vram * 0.85, F.least(ram * 0.5, F.lit(24 * 1024 * mib)))).otherwise(ram * 0.5)
    image = F.when(vram > 0, F.greatest(vram * 0.9, ram * 0.35)).otherwise(ram * 0.35)
    return F.when(kind.isin("text", "ocr", "vision"), text).when(kind.isin("image", "video"), image).otherwise(ram * 0.5)


def vram_mib(kind: Column, size_bytes: Column, backend: Column, context: Column | None = None, pixels: Column | None = None) -> Column:
    """Memory of a language, image or speech model; 0 on a CPU."""
    mib = size_bytes / float(1 << 20)
    text = mib * 1.05 + (context if context is not None else F.lit(8192)) * 32 * 2 * 1024 / float(1 << 20) + 400
    image = mib * 1.1 + (pixels if pixels is not None else F.lit(1 << 20)) / float(1 << 20) * 600 + 300
    whole = F.floor(F.when(kind == "text", text).when(kind == "image", image).otherwise(mib * 1.2 + 200) + 0.5).cast("long")
    return F.when(backend == "cpu", 0).otherwise(whole)


def last_flags(args: DataFrame, by: str, pos: str = "pos", arg: str = "arg") -> DataFrame:
    """Command arguments without earlier repeats of a dashed flag and its value."""
    w = W.partitionBy(by).orderBy(pos)
    is_flag = F.startswith(arg, F.lit("-"))
    flag = F.last(F.when(is_flag, F.col(arg)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    run = F.sum(is_flag.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = args.withColumn("_flag", flag).withColumn("_run", run)
    return out.withColumn("_last", F.max("_run").over(W.partitionBy(by, "_flag"))).where(F.col("_run") == F.col("_last")).drop("_flag", "_run", "_last")


def infer_kind(name: Column, tag: Column) -> Column:
    """Kind of a model from its repository name and pipeline tag, or null."""
    low = F.lower(name)
    has = lambda p: F.regexp_like(low, F.lit(p))
    speech = F.when(has("music|audio") & ~has("tts"), "music").otherwise("tts")
    k = F.when(has("ocr"), "ocr").when(tag.isin("text-to-image", "image-to-image"), "image").when(tag.isin("text-to-video", "image-to-video"), "video")
    k = k.when(tag == "automatic-speech-recognition", "speech").when(tag.isin("text-to-speech", "text-to-audio"), speech)
    return k.when(tag.isin("feature-extraction", "sentence-similarity"), F.when(has("rerank"), "rerank").otherwise("embeddings")).when(tag.isin("image-text-to-text", "text-generation"), "text")


def checkpoint_score(path: Column) -> Column:
    low = F.lower(path)
    rules = ((r"-opt\b|opt\.safetensors", 3), ("fp16|pruned", 1), (r"inpaint|refiner|vae\b|lora|controlnet", -5), (r"\.ckpt$", -1))
    total = F.lit(0)
    for pattern, points in rules:
        total = total + F.when(F.regexp_like(low, F.lit(pattern)), points).otherwise(0)
    return total


def changed_files(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose path, size and time aren't in the inspection cache."""
    return now.join(cache, ["path", "size", "mtime"], "left_anti")


def merge_settings(base: Column, patch: Column) -> Column:
    """Shallow merge of string maps; a null value deletes its key."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(patch), k))
    return F.map_filter(F.map_concat(kept, patch), lambda _, v: v.isNotNull())


def by_priority(rows: DataFrame, by: str, *cases: Column) -> DataFrame:
    """One row per group: the first case that a row meets decides; rows that meet none are out."""
    p = F.coalesce(*[F.when(c, i) for i, c in enumerate(cases)])
    cols = [c for c in rows.columns if c != by]
    return rows.withColumn("_p", p).where("_p is not null").groupBy(by).agg(F.min_by(F.struct(*cols), F.struct("_p", *cols)).alias("r")).select(by, "r.*")
