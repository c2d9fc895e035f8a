"""Catalogs: model lookup, devices, voices, providers, tensor headers, settings patches, JSON inside answers."""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.text import params_from_name, quant_from_name
from docengine.operators.records import pick_by_preference


def find_models(refs: DataFrame, library: DataFrame, ref: str = "ref") -> DataFrame:
    """(ref, id, level): the model that each reference means; references that mean none are out.

    ``library`` has id, filename, role and recipe.  Levels: 0 the id, 1 the file name, 2 the start of a main model's file name
    in any case, 3 the recipe of a main or diffusion model.  Ties go to the smallest id.  Every level is an equality, so that one
    hash join finds them all; file names are short, which bounds the number of their starts.
    """
    name = F.lower("filename")
    starts = F.transform(F.sequence(F.lit(1), F.length(name)), lambda n: F.substring(name, F.lit(1), n))
    keys = F.concat(
        F.array(F.struct(F.lit(0).alias("level"), F.col("id").alias("key")), F.struct(F.lit(1).alias("level"), F.col("filename").alias("key"))),
        F.when((F.col("role") == "main") & (F.length(name) > 0), F.transform(starts, lambda s: F.struct(F.lit(2).alias("level"), s.alias("key")))).otherwise(F.array().cast("array<struct<level:int,key:string>>")),
        F.when(F.col("role").isin("main", "diffusion"), F.array(F.struct(F.lit(3).alias("level"), F.col("recipe").alias("key")))).otherwise(F.array().cast("array<struct<level:int,key:string>>")),
    )
    have = library.select("id", F.inline(keys)).groupBy("level", "key").agg(F.min("id").alias("id"))
    want = refs.select(ref).distinct().select(ref, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    want = want.withColumn("key", F.when(F.col("level") == 2, F.lower(ref)).otherwise(F.col(ref)))
    return want.join(have, ["level", "key"]).groupBy(ref).agg(F.min_by(F.struct("id", "level"), "level").alias("r")).select(ref, "r.*")


def merge_devices(measured: DataFrame, listed: DataFrame, by: str, vendor: str = "vendor", own: str = "nvidia") -> DataFrame:
    """Measured devices and the listed ones, without those of the measuring vendor where a host has measured ones."""
    has = measured.select(by).distinct().withColumn("_has", F.lit(True))
    rest = listed.join(has, by, "left").where(F.col("_has").isNull() | (F.coalesce(F.col(vendor), F.lit("")) != own))
    return measured.unionByName(rest.select(*measured.columns))


def backends(devices: DataFrame, by: str, platform: Column, vendor: str = "vendor") -> DataFrame:
    """(by, backend): by the vendors of a host's devices; ``platform`` is linux, windows, mac-arm64 or mac."""
    is_there = lambda v: F.coalesce(F.bool_or(F.col(vendor) == v), F.lit(False))
    g = devices.groupBy(by).agg(F.any_value(platform).alias("p"), *[is_there(v).alias(v) for v in ("nvidia", "amd", "intel")])
    pick = F.when(F.col("p") == "mac-arm64", "metal").when(F.col("p") == "mac", "cpu").when(F.col("nvidia"), "cuda")
    pick = pick.when(F.col("amd"), F.when(F.col("p") == "linux", "rocm").otherwise("vulkan")).when(F.col("intel"), "vulkan").otherwise("cpu")
    return g.select(by, pick.alias("backend"))


def fill_slots(args: Column, slots: Column) -> Column:
    """An array of arguments with each ``{slot}`` replaced by its path; a slot without one goes, and so does what stands before it."""
    slot = lambda a: F.regexp_extract(a, r"^\{(\w+)\}$", 1)

    def step(done: Column, a: Column) -> Column:
        path = F.try_element_at(slots, slot(a))
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(slot(a) == "", F.concat(done, F.array(a))).when(F.coalesce(path, F.lit("")) == "", shorter).otherwise(F.concat(done, F.array(path)))

    return F.aggregate(args, F.array().cast("array<string>"), step)


def voice_packs(files: DataFrame, dir: str = "dir", name: str = "name") -> DataFrame:
    """(dir, kind, model): what a directory's files make of it, never its name; directories without model or tokens are out.

    Where several files would do, the first by name is taken.
    """
    low = F.lower(name)
    is_model = F.endswith(low, F.lit(".onnx"))
    first = lambda pattern: F.min(F.when(is_model & F.regexp_like(low, F.lit(pattern)), F.col(name)))
    g = files.groupBy(dir).agg(
        F.min(F.when(is_model, F.col(name))).alias("any"), F.count_if(low == "tokens.txt").alias("tokens"), F.count_if(low == "voices.bin").alias("voices"),
        first("kokoro|model").alias("kokoro"), first("^model-steps|matcha").alias("matcha"), first("vits|model").alias("vits"),
    ).where(F.col("any").isNotNull() & (F.col("tokens") > 0))
    kind = F.when(F.col("voices") > 0, "kokoro").when(F.col("matcha").isNotNull(), "matcha").otherwise("vits")
    return g.select(dir, kind.alias("kind"), F.when(kind == "kokoro", F.coalesce("kokoro", "any")).when(kind == "matcha", F.col("matcha")).otherwise(F.coalesce("vits", "any")).alias("model"))


def voices(packs: DataFrame, users: DataFrame) -> DataFrame:
    """(id, name, language, speaker, builtin): a voice per speaker of the packs, replaced by users' voices of the same id.

    ``packs`` has id, name, language and speakers (array; one or none: a single voice); ``users`` id, name and language.
    """
    many = F.size(F.coalesce("speakers", F.array().cast("array<string>"))) > 1
    rows = packs.select("id", "name", "language", F.posexplode(F.when(many, F.col("speakers")).otherwise(F.array(F.lit(None).cast("string")))).alias("speaker", "who"))
    part = F.regexp_replace(F.lower("who"), "[^a-z0-9]+", "-")
    built = rows.select(F.when(F.col("who").isNull(), F.col("id")).otherwise(F.concat_ws(":", "id", part)).alias("id"), F.concat_ws(" · ", "name", "who").alias("name"), "language", "speaker", F.lit(True).alias("builtin"))
    both = built.unionByName(users.select("id", "name", "language", F.lit(0).alias("speaker"), F.lit(False).alias("builtin")))
    cols = ["name", "language", "speaker", "builtin"]
    return both.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct("builtin", "name", "speaker")).alias("v")).select("id", "v.*")


def default_voices(all_voices: DataFrame, wanted: DataFrame) -> DataFrame:
    """(language, id): the voice for each wanted language: the preferred one, else its language, its prefix, the first by name.

    ``wanted`` has language and preferred.  Voices are cut to the first by name of each language before they meet a request.
    """
    first = lambda key: F.min_by("id", F.struct("name", "id")).alias(key)
    v = all_voices.select("id", "name", F.lower("language").alias("lang"))
    exact, start = v.groupBy("lang").agg(first("exact")), v.groupBy(F.substring("lang", 1, 2).alias("start")).agg(first("near"))
    w = wanted.withColumn("lang", F.lower("language")).withColumn("start", F.substring("lang", 1, 2))
    w = w.join(v.select(F.col("id").alias("preferred"), F.col("id").alias("mine")).distinct(), "preferred", "left").join(exact, "lang", "left").join(start, "start", "left")
    w = w.join(v.agg(first("any")).hint("broadcast"), how="left", on=F.lit(True))  # one row
    return w.select("language", F.coalesce("mine", "exact", "near", "any").alias("id"))


def split_provider(models: DataFrame, providers: DataFrame, ref: str = "ref") -> DataFrame:
    """Rows of ``models`` with provider and model, both null where no enabled provider (id, enabled) is named."""
    p = providers.where(F.coalesce("enabled", F.lit(True))).select(F.col("id").alias("provider")).distinct()
    part = lambda n: F.regexp_extract(ref, r"(?i)^([a-z0-9_-]+)[:/](.+)$", n)
    out = models.withColumn("_name", F.lower(part(1))).join(p, F.col("_name") == F.col("provider"), "left").drop("_name")
    return out.withColumn("model", F.when(F.col("provider").isNotNull(), part(2)))


def advertised(providers: DataFrame) -> DataFrame:
    """(id, provider) of all models of enabled providers that have a key or a local address."""
    ok = F.coalesce("enabled", F.lit(True)) & (F.coalesce(F.col("key") != "", F.lit(False)) | F.contains("url", F.lit("127.0.0.1")))
    return providers.where(ok).select(F.col("id").alias("provider"), F.explode("models").alias("m")).select(F.concat_ws(":", "provider", "m").alias("id"), "provider")


def tensor_names(content: Column) -> Column:
    """Names of the tensors in the JSON header of a safetensors file; null where there is no such header."""
    digits = F.hex(F.substring(content, 1, 8))
    size = F.conv(F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)]), 16, 10).cast("long")
    good = (F.length(content) >= 8) & (size > 0) & (size <= F.length(content) - 8)
    head = F.when(good, F.substr(content, F.lit(9), size.cast("int")))
    # The values are objects; only the keys are needed.
    keys = F.map_keys(F.from_json(F.try_validate_utf8(head.cast("string")), "map<string,string>"))
    return F.filter(keys, lambda k: k != "__metadata__")


_UNET = r"^model\.diffusion_model\."
#: Kind, role and architecture, the patterns of which each must match a tensor's name, and one that mustn't.
TENSORS = (
    ("image", "main", "sdxl", (_UNET, r"^conditioner\.embedders\.1"), None),
    ("image", "main", "sd1", (_UNET, r"^first_stage_model\.|^vae\.|^decoder\.(conv_in|mid|up)|^cond_stage_model\.|^conditioner\.embedders\.|^text_model\."), None),
    ("image", "diffusion", "flux2", (r"^(transformer\.)?(double|single)_blocks\.", r"img_in_patch|double_stream_modulation"), None),
    ("image", "diffusion", "flux", (r"^(double_blocks|single_blocks)\.|^transformer\.(double|single)_blocks\.",), None),
    ("video", "diffusion", "wan", (r"^blocks\.\d+\.(cross_attn|self_attn|ffn)\.", "patch_embedding"), None),
    ("image", "diffusion", "dit", (r"^transformer_blocks\.\d+\.", "^caption_projection|context_embedder|x_embedder"), None),
    ("image", "vae", "vae", (r"^(encoder|decoder)\.(conv_in|down|up|mid)",), _UNET),
    ("image", "text_encoder", "t5", (r"^encoder\.block\.\d+\.layer\.",), None),
    ("image", "text_encoder", "t5", (r"^shared\.weight$", r"^encoder\.final_layer_norm"), None),
    ("image", "text_encoder", "clip", (r"^text_model\.encoder\.layers\.",), _UNET),
    ("text", "main", "transformers", (r"^model\.layers\.\d+\.(self_attn|mlp)\.|^layers\.\d+\.attention\.",), None),
    ("image", "lora", "lora", (r"lora_(up|down|A|B)\.|\.lora_(up|down)\.weight$|lora_te|lora_unet",), None),
    ("image", "controlnet", "controlnet", (r"^control_model\.|^controlnet",), None),
    ("tts", "vae", "codec", (r"^(encoder|decoder)\.", "quantizer|codebook"), None),
)


def classify_tensors(names: Column) -> Column:
    """struct<kind, role, arch> of a model by the names of its tensors; the first rule of ``TENSORS`` that fits."""
    there = lambda p: F.exists(names, lambda k: F.regexp_like(k, F.lit(p)))
    what = lambda kind, role, arch: F.struct(F.lit(kind).cast("string").alias("kind"), F.lit(role).alias("role"), F.lit(arch).cast("string").alias("arch"))
    fits = []
    for kind, role, arch, needed, banned in TENSORS:
        ok = F.lit(True) if banned is None else ~there(banned)
        for p in needed:
            ok = ok & there(p)
        fits.append(F.when(ok, what(kind, role, arch)))
    return F.coalesce(*fits, what(None, "unknown", None))


#: Scalar types of GGUF metadata, by number (signed bytes are read as unsigned ones).
SCALARS = {0: "<B", 1: "<B", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}
TEXT, LIST = 8, 9


def gguf_values(content: bytes | None) -> dict[str, str] | None:
    """Metadata of a GGUF head as JSON texts: scalars whole, lists as their length.  None if it isn't one of version 2 or 3 or is cut short."""
    data, at = memoryview(content or b""), 24

    def scalar(fmt: str):
        nonlocal at
        (value,) = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return value

    def text() -> str:
        nonlocal at
        n = scalar("<Q")
        if n > len(data) - at:
            raise ValueError
        at += n
        return bytes(data[at - n : at]).decode("utf-8", "replace")

    def items() -> int:
        nonlocal at
        kind, n = scalar("<I"), scalar("<Q")
        if kind in SCALARS:
            at += n * struct.calcsize(SCALARS[kind])
            if at > len(data):
                raise ValueError
            return n
        if kind not in (TEXT, LIST) or n > len(data):
            raise ValueError
        for _ in range(n):
            text() if kind == TEXT else items()
        return n

    try:
        magic, version, _, pairs = struct.unpack_from("<4sIQQ", data)
        if magic != b"GGUF" or version not in (2, 3):
            return None
        out = {}
        for _ in range(pairs):
            key, kind = text(), scalar("<I")
            if kind not in (*SCALARS, TEXT, LIST):
                return None
            out[key] = json.dumps(text() if kind == TEXT else items() if kind == LIST else scalar(SCALARS[kind]), ensure_ascii=False)
        return out
    except (struct.error, ValueError, RecursionError):
        return None


def gguf_metadata(content: Column) -> Column:
    """Metadata in the first bytes of a GGUF file as a map of JSON texts, or null."""

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(gguf_values)

    return run(content)


#: Quantisations by file type, and families of architectures.
FILE_TYPES = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 7: "Q8_0", 8: "Q5_0", 9: "Q5_1", 10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L", 14: "Q4_K_S", 15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M", 18: "Q6_K",
    19: "IQ2_XXS", 20: "IQ2_XS", 21: "Q2_K_S", 22: "IQ3_XS", 23: "IQ3_XXS", 24: "IQ1_S", 25: "IQ4_NL", 26: "IQ3_S", 27: "IQ3_M", 28: "IQ2_S", 29: "IQ2_M", 30: "IQ4_XS", 31: "IQ1_M", 32: "BF16",
}
EMBEDDING = ["bert", "nomic-bert", "jina-bert-v2", "xlm-roberta", "gte", "modernbert", "gemma-embedding", "qwen3-embedding"]
DIFFUSION = ["flux", "flux2", "sd1", "sd2", "sdxl", "sd3", "wan", "ltx", "qwen_image", "z_image", "hunyuan", "chroma", "hidream", "lumina2"]
ENCODERS = ["clip", "t5", "t5encoder", "umt5", "clip-vision", "siglip"]
VISION = r"ocr|vl\b|vision|-v-|glm4v|qwen2vl|qwen2\.5vl|qwen3vl|llava|minicpmv|gemma3"


def classify_gguf(values: Column, filename: Column) -> Column:
    """struct<kind, role, arch, quant, params, context, vision> of a GGUF model by its metadata and, where that is silent, its name."""
    plain = lambda k: F.get_json_object(F.concat(F.lit('{"v":'), F.try_element_at(values, k if isinstance(k, Column) else F.lit(k)), F.lit("}")), "$.v")
    arch = F.nullif(F.lower(F.coalesce(plain("general.architecture"), F.lit(""))), F.lit(""))
    type_, name, file_type = F.lower(F.coalesce(plain("general.type"), F.lit("model"))), plain("general.name"), plain("general.file_type").try_cast("int")
    shown, low_file = F.lower(F.coalesce(name, filename)), F.lower(filename)
    a = F.coalesce(arch, F.lit(""))
    says = lambda c, p: F.regexp_like(c, F.lit(p))
    as_ = lambda kind, role: F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"))
    projector = (type_ == "mmproj") | ((a == "clip") & F.map_contains_key(values, "clip.has_vision_encoder")) | says(low_file, "mmproj")
    rerank, every = says(shown, "rerank"), F.lower(F.concat_ws(" ", a, name, filename))
    ocr = says(F.lower(F.concat_ws(" ", name, filename)), "ocr")
    what = F.when(projector, as_("vision", "mmproj")).when(type_ == "adapter", as_("text", "lora")).when(a.isin(DIFFUSION), as_("image", "diffusion"))
    what = what.when(a.isin(ENCODERS), as_("image", "text_encoder")).when(a == "vae", as_("image", "vae")).when(a == "whisper", as_("speech", "main"))
    what = what.when(a == "wavtokenizer-dec", as_("tts", "vae")).when(says(a, "tts"), as_("tts", "main")).when(rerank, as_("rerank", "main"))
    what = what.when((a != "") & (a.isin(EMBEDDING) | says(shown, "embed")), as_("embeddings", "main")).when(ocr, as_("ocr", "main")).otherwise(as_("text", "main"))
    types = F.create_map(*[F.lit(x) for kv in FILE_TYPES.items() for x in kv])
    quant = F.when(file_type.isNull(), quant_from_name(filename)).otherwise(F.coalesce(F.try_element_at(types, file_type), F.concat(F.lit("ft"), file_type.cast("string"))))
    params = F.coalesce(plain("general.parameter_count").try_cast("long"), params_from_name(F.coalesce(name, filename)))
    vision = (what["role"] == "mmproj") | ((what["role"] == "main") & what["kind"].isin("text", "ocr") & says(every, VISION))
    return F.struct(what["kind"].alias("kind"), what["role"].alias("role"), F.when(projector, F.coalesce(arch, F.lit("clip"))).otherwise(arch).alias("arch"), quant.alias("quant"), params.alias("params"), plain(F.concat(arch, F.lit(".context_length"))).try_cast("long").alias("context"), vision.alias("vision"))


#: Quantisations by preference.
PREFER = {
    "small": ["Q8_0", "f16", "Q6_K", "Q4_K_M", "bf16"],
    "image": ["Q4_K_S", "Q4_K_M", "Q4_0", "Q5_K_S", "Q5_0", "Q6_K", "Q8_0", "Q3_K_S", "Q3_K_M", "F16", "BF16"],
    "text": ["Q4_K_M", "Q5_K_M", "Q4_K_S", "Q6_K", "Q8_0", "Q3_K_M", "IQ4_XS", "Q4_0", "F16", "BF16"],
}


def repo_kind(repo: Column) -> Column:
    """Kind of a GGUF repository by its name."""
    name = F.lower(F.substring_index(repo, "/", -1))
    says = lambda p: F.regexp_like(name, F.lit(p))
    return F.when(says("ocr"), "ocr").when(says("embed"), "embeddings").when(says("rerank"), "rerank").when(says("whisper"), "speech").otherwise("text")


def plan_gguf(files: DataFrame, budget: Column, kind: Column | None = None) -> DataFrame:
    """(repo, path, size, role, fits): what to download of each repository: all parts of one model and the best projector.

    ``files`` has repo, path and size.  ``kind`` overrides the kind read from the repository's name.
    """
    k = F.coalesce(kind, repo_kind(F.col("repo"))) if kind is not None else repo_kind(F.col("repo"))
    low = F.lower("path")
    g = files.where(F.endswith(low, F.lit(".gguf"))).withColumn("kind", k).withColumn("size", F.coalesce(F.col("size").cast("long"), F.lit(0))).withColumn("projector", F.contains(low, F.lit("mmproj")))
    base = F.regexp_replace("path", r"-\d{5}-of-(\d{5})", "-of-$1")
    mains = g.where("not projector").withColumn("base", base)
    models = mains.groupBy("repo", "kind", "base").agg(F.min("path").alias("path"), F.sum("size").alias("size")).withColumn("quant", quant_from_name(F.col("path")))
    lists = {n: F.array(*[F.lit(q.lower()) for q in qs]) for n, qs in PREFER.items()}
    prefer = F.when(F.col("kind").isin("ocr", "embeddings", "rerank"), lists["small"]).when(F.col("kind").isin("image", "video"), lists["image"]).otherwise(lists["text"])
    # Ranked by the base name's first part; the base tells which parts belong to it.
    chosen = pick_by_preference(models, "repo", "quant", "size", "path", prefer, budget).select("repo", base.alias("base"), "fits")
    role = F.when(F.col("kind").isin("image", "video"), "diffusion").otherwise("main")
    parts = mains.join(chosen, ["repo", "base"]).select("repo", "path", "size", role.alias("role"), "fits")
    rank = F.when(F.contains(low, F.lit("q8_0")), 3).when(F.contains(low, F.lit("f16")), 2).otherwise(0)
    best = g.where("projector").groupBy("repo").agg(F.min_by(F.struct("path", "size"), F.struct(-rank, "path")).alias("r"))
    best = best.join(chosen.select("repo"), "repo", "left_semi")
    return parts.unionByName(best.select("repo", "r.path", "r.size", F.lit("mmproj").alias("role"), F.lit(True).alias("fits")))


#: Keys that a patch may change.  Numbers: (whole, least, most, may be null, allowed word).
NUMBERS = {
    "server.port": (True, 1, 65535, False, None),
    "server.rateLimitPerMinute": (True, 0, 100000, False, None),
    "engines.idleUnloadMinutes": (True, 0, 1440, False, None),
    "engines.vramBudgetMiB": (True, 0, 1000000, False, "auto"),
    "downloads.parallelFiles": (True, 1, 8, False, None),
    "downloads.parallelChunks": (True, 1, 16, False, None),
    "downloads.maxSpeedMiBps": (False, 0.1, 10000, True, None),
    "agent.port": (True, 1, 65535, False, None),
    "audio.meetingWindowSec": (True, 5, 300, False, None),
    "documents.chunkTokens": (True, 64, 4000, False, None),
    "documents.chunkOverlap": (True, 0, 1000, False, None),
}
CHOICES = {"ui.language": ["pt-BR", "en"], "ui.theme": ["system", "dark", "light"], "engines.preferredBackend": ["auto", "cuda", "vulkan", "metal", "rocm", "cpu"]}
TEXTS = ["downloads.hfMirror", "agent.workspace", "audio.defaultVoice", "audio.sttModel", "documents.embeddingModel", "documents.rerankModel", "documents.ocrModel"]
SWITCHES = ["server.openBrowser", "agent.enabled"]
LISTS = ["server.corsOrigins"]


def flatten_patch(patches: DataFrame, by: str, patch: str = "patch", depth: int = 4) -> DataFrame:
    """(by, key, value): the leaves of JSON objects under dotted keys; lists are leaves, empty objects give none.

    Objects below ``depth`` stay whole, under the key of that level.  Texts that aren't JSON objects give nothing.
    """
    tvf = patches.sparkSession.tvf
    level = patches.select(by, F.lit(None).cast("string").alias("at"), F.try_parse_json(patch).alias("v"))
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    level, out = level.where(is_object), None
    for n in range(depth):
        inner = level.lateralJoin(tvf.variant_explode(F.col("v").outer())).select(by, F.concat_ws(".", "at", "key").alias("at"), F.col("value").alias("v"))
        leaves = inner if n == depth - 1 else inner.where(~is_object)
        out = leaves if out is None else out.unionAll(leaves)
        level = inner.where(is_object)
    return out.select(by, F.col("at").alias("key"), F.col("v").alias("value"))


def check_patch(flat: DataFrame) -> DataFrame:
    """Rows of a flat patch (key, value) with ``problem``: null, or why the value can't be set.

    Keys of providers have a way of their own and are out.
    """
    key, kind = F.col("key"), F.schema_of_variant("value")
    text, number = F.try_variant_get("value", "$", "string"), F.try_variant_get("value", "$", "double")
    null, is_text, is_number = kind == "VOID", kind == "STRING", F.regexp_like(kind, F.lit("^(BIGINT|DOUBLE|DECIMAL)"))
    empty = F.when(null, "empty")
    found = F.when(key.isin(SWITCHES), F.when(kind != "BOOLEAN", "type"))
    items = F.try_variant_get("value", "$", "array<variant>")
    found = found.when(key.isin(LISTS), F.when(~F.coalesce(F.startswith(kind, F.lit("ARRAY")) & F.forall(items, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(False)), "type"))
    found = found.when(key.isin(TEXTS), F.when(~null & ~is_text, "type"))
    for k, words in CHOICES.items():
        found = found.when(key == k, F.coalesce(empty, F.when(~is_text, "type"), F.when(~text.isin(words), "choice")))
    for k, (whole, least, most, nullable, word) in NUMBERS.items():
        bad = F.coalesce(F.when(~is_number, "type"), F.when(F.lit(whole) & (number != F.floor(number)), "whole"), F.when(number < least, "least"), F.when(number > most, "most"))
        good = (null & F.lit(nullable)) | (is_text & (text == (word or ""))) if word else null & F.lit(nullable)
        found = found.when(key == k, F.when(~good, F.coalesce(empty, bad)))
    secret = (key == "server.apiKey") | F.startswith(key, F.lit("secrets"))
    found = found.when(secret, "secret").otherwise("unknown")
    return flat.where(~F.startswith(key, F.lit("providers."))).withColumn("problem", found)


def _no_constant(_: str) -> None:
    raise ValueError


_JSON = json.JSONDecoder(parse_constant=_no_constant)


def json_in(text: str | None) -> str | None:
    """The JSON text in an answer: all of it without its code fence, else the value that starts at the first brace, or bracket."""
    t = (text or "").strip()
    if t.startswith("```"):
        t = t[3:]
        t = t[4:] if t[:4].lower() == "json" else t
    t = t.rstrip().removesuffix("```").strip()
    for start, whole in ((0, True), (t.find("{"), False), (t.find("["), False)):
        if start < 0:
            continue
        try:
            value, end = _JSON.raw_decode(t, start)
        except (ValueError, RecursionError):
            continue
        if value is not None and (end == len(t) or not whole):
            return t[start:end]
    return None


def extract_json(text: Column) -> Column:
    """The JSON text inside a model's answer, or null; read it with ``from_json`` or ``try_parse_json``."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(json_in)

    return run(text)
