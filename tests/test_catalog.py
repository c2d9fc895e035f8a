"""Small cases of the catalog operators and of growing recordings."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from docengine.operators import catalog as C
from docengine.streaming import streams


@pytest.mark.parametrize("text,want", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('Here: {"a": "}"} and more', '{"a": "}"}'),
    ('[1, 2] then {"b": {}}', '{"b": {}}'),
    ("{oops} [1, 2]", "[1, 2]"),
    ("42", "42"),
    ("42 apples", None),
    ("null", None),
    ("", None),
    (None, None),
    ("[" * 5000, None),
])
def test_json_in(text, want):
    assert C.json_in(text) == want


def test_slots_drop_their_flag(spark):
    df = spark.createDataFrame([(["-m", "{model}", "--vae", "{vae}", "x{y}"], {"model": "/m"}), ([], None), (["{a}"], {"a": ""})], "a array<string>, s map<string,string>")
    assert [r.x for r in df.select(C.fill_slots(F.col("a"), F.col("s")).alias("x")).collect()] == [["-m", "/m", "x{y}"], [], []]


def _file(names: list[str]) -> bytearray:
    head = json.dumps({"__metadata__": {"t": "x"}, **{n: {"dtype": "F16", "shape": [1], "data_offsets": [0, 2]} for n in names}}).encode()
    return bytearray(struct.pack("<Q", len(head)) + head + b"\0\0")


@pytest.mark.parametrize("names,want", [
    (["model.diffusion_model.a", "first_stage_model.b"], ("image", "main", "sd1")),
    (["model.diffusion_model.a", "conditioner.embedders.1.b"], ("image", "main", "sdxl")),
    (["double_blocks.0.x"], ("image", "diffusion", "flux")),
    (["model.layers.0.mlp.up"], ("text", "main", "transformers")),
    (["decoder.mid.a"], ("image", "vae", "vae")),
    (["else"], (None, "unknown", None)),
])
def test_tensor_classes(spark, names, want):
    df = spark.createDataFrame([(_file(names),)], "c binary").withColumn("n", C.tensor_names(F.col("c")))
    row = df.select("n", C.classify_tensors(F.col("n")).alias("k")).first()
    assert sorted(row.n) == sorted(names) and tuple(row.k) == want


def test_broken_headers_have_no_names(spark):
    df = spark.createDataFrame([(bytearray(b""),), (bytearray(b"\x05"),), (bytearray(b"<html>..<body>"),), (None,)], "c binary")
    assert [r.n for r in df.select(C.tensor_names(F.col("c")).alias("n")).collect()] == [None] * 4


def test_patch_problems(spark):
    patch = {"engines": {"vramBudgetMiB": "auto"}, "downloads": {"maxSpeedMiBps": None, "parallelChunks": 0}, "server": {"corsOrigins": ["a", 1], "openBrowser": "yes", "port": 8080}, "audio": {"defaultVoice": 3}, "ui": {}, "secrets": {"k": "v"}}
    df = spark.createDataFrame([(1, json.dumps(patch)), (2, "no json"), (3, None), (4, "[1]")], "id int, patch string")
    got = {r.key: r.problem for r in C.check_patch(C.flatten_patch(df, "id")).collect()}
    assert got == {"engines.vramBudgetMiB": None, "downloads.maxSpeedMiBps": None, "downloads.parallelChunks": "least", "server.corsOrigins": "type", "server.openBrowser": "type", "server.port": None, "audio.defaultVoice": "type", "secrets.k": "secret"}


def test_default_voice_cascade(spark):
    v = spark.createDataFrame([("a", "Ana", "pt-BR"), ("b", "Bob", "en-US"), ("c", "Ada", "pt-PT")], "id string, name string, language string")
    w = spark.createDataFrame([("pt-br", None), ("pt-AO", None), ("fr", None), ("en", "a")], "language string, preferred string")
    assert {r.language: r.id for r in C.default_voices(v, w).collect()} == {"pt-br": "a", "pt-AO": "c", "fr": "c", "en": "a"}


TICKS = [("m", 0, 12.9, False), ("m", 25, 27.5, False), ("m", 50, 40.0, False), ("m", 75, 75.2, False), ("m", 80, 76.4, True), ("n", 0, 0.5, True), ("n", 9, None, False)]
SPANS = [("m", 0, 27), ("m", 27, 75), ("m", 75, 76)]


def test_growing_windows(spark):
    t = spark.createDataFrame(TICKS, "id string, s int, total double, final boolean").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(tuple(r) for r in streams.growing_windows(t, "id", "at", "total", "final").collect()) == SPANS


def test_growing_windows_as_stream(spark, tmp_path):
    t = spark.createDataFrame(TICKS, "id string, s int, total double, final boolean").withColumn("at", F.timestamp_seconds("s"))
    for i, part in enumerate((t.where("s <= 50"), t.where("s > 50"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
        streams.growing_windows(s, "id", "at", "total", "final").writeStream.format("memory").queryName(f"grown{i}").option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("grown0").collect()) == SPANS[:1]


def _gguf(values: dict, version: int = 3) -> bytearray:
    text = lambda t: struct.pack("<Q", len(t.encode())) + t.encode()
    body = b""
    for k, v in values.items():
        body += text(k)
        if isinstance(v, str):
            body += struct.pack("<I", 8) + text(v)
        elif isinstance(v, list):
            body += struct.pack("<IIQ", 9, 8, len(v)) + b"".join(map(text, v))
        else:
            body += struct.pack("<II", 4, v)
    return bytearray(b"GGUF" + struct.pack("<IQQ", version, 0, len(values)) + body)


def test_gguf_models(spark):
    rows = [
        (_gguf({"general.architecture": "llama", "tokens": ["a", "bc"], "general.file_type": 15, "llama.context_length": 4096, "general.name": "X 8B"}), "x.gguf"),
        (_gguf({"general.architecture": "clip"}), "mmproj-x-F16.gguf"),
        (_gguf({"general.architecture": "bert"}), "e-Q8_0.gguf"),
        (_gguf({"general.architecture": "flux"}, 2), "f-Q4_0.gguf"),
        (_gguf({"general.architecture": "qwen2vl"}), "GLM-OCR-0.9B-Q8_0.gguf"),
        (_gguf({"general.architecture": "llama"}), "bge-reranker-Q8_0.gguf"),
    ]
    df = spark.createDataFrame(rows, "c binary, f string").withColumn("v", C.gguf_metadata(F.col("c")))
    got = {r.f: tuple(r.k) for r in df.select("f", C.classify_gguf(F.col("v"), F.col("f")).alias("k")).collect()}
    assert got == {
        "x.gguf": ("text", "main", "llama", "Q4_K_M", 8_000_000_000, 4096, False),
        "mmproj-x-F16.gguf": ("vision", "mmproj", "clip", "F16", None, None, True),
        "e-Q8_0.gguf": ("embeddings", "main", "bert", "Q8_0", None, None, False),
        "f-Q4_0.gguf": ("image", "diffusion", "flux", "Q4_0", None, None, False),
        "GLM-OCR-0.9B-Q8_0.gguf": ("ocr", "main", "qwen2vl", "Q8_0", 900_000_000, None, True),
        "bge-reranker-Q8_0.gguf": ("rerank", "main", "llama", "Q8_0", None, None, False),
    }


@pytest.mark.parametrize("content", [None, b"", b"GGUF", b"<html><body>no model at all</body></html>", bytes(_gguf({"a": "b"}))[:-1], bytes(_gguf({"a": 1}, 9))])
def test_broken_gguf(content):
    assert C.gguf_values(content) is None
