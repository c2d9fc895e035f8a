"""Operators on small tables: reconciliation, jobs, transcripts, planning, sources, streams."""

import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docengine.operators import documents as D
from docengine.operators import records as R
from docengine.sources import files
from docengine.streaming import streams


def test_crosscheck(spark):
    d = spark.createDataFrame([("a", "1", "10,00"), ("b", "2", "20,00"), ("c", "3", "1"), ("n", None, None)], "id string, numero string, valorTotal string")
    t = spark.createDataFrame([(" 1", "10.00", 0), ("2", "99", 0), ("2", "21", 1), ("9", "1", 0)], "`Número` string, valor_total string, place int")
    rows = D.crosscheck(d, t, ["numero"], ["valorTotal"], order=F.col("place"))
    got = {r.key: (r.status, r.differences) for r in rows.collect()}
    assert got["1"][0] == "matched" and got["3"][0] == got[""][0] == "missing_in_table" and got["9"][0] == "missing_in_documents"
    assert got["2"][0] == "different" and got["2"][1][0]["table"] == "21"
    assert tuple(D.crosscheck_summary(rows).first()) == (1, 1, 2, 1)


def test_classification(spark):
    d = spark.createDataFrame([(1, "DANFE nota fiscal eletrônica NFE"), (2, "recibo e boleto"), (3, None)], "doc_id long, text string")
    got = {r.id: (r.type, r.sure) for r in D.classify(D.hint_scores(d, D.DOC_TYPES)).collect()}
    assert got == {1: ("nfe", True), 2: ("recibo", False)}
    assert D.doc_types(spark).count() == 7


def test_memory_and_tables(spark):
    m = spark.createDataFrame([("p", "fact", "b", False, datetime(2024, 1, 1)), ("p", "user", "a", True, datetime(2024, 1, 2))], "project_id string, kind string, text string, pinned boolean, created_at timestamp")
    assert D.memory_markdown(m).first()["markdown"] == "## Anotado por você\n\n- a\n\n## Fatos\n\n- b"
    assert [r.text for r in D.new_memories(m.select("text"), spark.createDataFrame([("a",), ("xyz",), ("xyz ",), ("no",)], "text string")).collect()] == ["xyz"]
    a, b = D.delete_cascade(spark.createDataFrame([(1,)], "k int"), "k", spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int"))
    assert (a.count(), b.count()) == (1, 0)


def test_segments(spark):
    raw = '{"result":{"language":"pt"},"transcription":[{"offsets":{"from":0,"to":1000},"text":" Oi [SPEAKER_TURN]","tokens":[{"text":"Oi","p":0.5,"offsets":{"from":0,"to":500}},{"text":"[_BEG_]","p":1.0}]},{"offsets":{"from":1000,"to":1500},"text":"  ","speaker_turn_next":true},{"offsets":{"from":1500,"to":2500},"text":"Sim"}]}'
    s = R.parse_segments(spark.createDataFrame([("x", raw)], "id string, raw string"), offset=10.0).orderBy("seq").collect()
    assert [(r.text, r.speaker, r.start, r.end) for r in s] == [("Oi", 1, 10.0, 11.0), ("Sim", 3, 11.5, 12.5)]
    assert s[0].confidence == 0.75 and [w["word"] for w in s[0].words] == ["Oi"] and s[1].confidence is None


def test_planning(spark):
    args = spark.createDataFrame([(1, i, a) for i, a in enumerate(["-m", "x", "--v", "-m", "y"])], "id int, pos int, arg string")
    assert [r.arg for r in R.last_flags(args, "id").orderBy("pos").collect()] == ["--v", "-m", "y"]
    s = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": None, "c": "3"})], "x map<string,string>, y map<string,string>")
    assert s.select(R.merge_settings(F.col("x"), F.col("y"))).first()[0] == {"a": "1", "c": "3"}
    k = spark.createDataFrame([("org/tts-x", "text-to-speech"), ("org/musicgen", "text-to-audio"), ("o/bge-rerank", "feature-extraction"), ("o/x", None)], "n string, t string")
    assert [r[0] for r in k.select(R.infer_kind(F.col("n"), F.col("t"))).collect()] == ["tts", "music", "rerank", None]
    m = spark.createDataFrame([("a.gguf", 1), ("A.gguf", 2)], "name string, v int").withColumn("g", F.lit(1))
    assert R.by_priority(m, "g", F.col("name") == "zzz", F.lower("name") == "a.gguf").first()["v"] in (1, 2)
    b = spark.range(1).select(R.budget_bytes(F.lit("text"), F.lit(6144), F.lit(32768)), R.vram_mib(F.lit("speech"), F.lit(100 << 20), F.lit("cuda")), R.vram_mib(F.lit("text"), F.lit(1), F.lit("cpu"))).first()
    assert b[0] == 16 * 1024 * (1 << 20) and b[1] == 320 and b[2] == 0


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Título", "Heading1") + p("texto") + p("item", "ListParagraph") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx())
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04word/document.xml")
    (tmp_path / "b.csv").write_bytes(b"numero;valor\r\n1;2\r\n")
    (tmp_path / "h.txt").write_bytes(b"a;b\n1;2\n3;4\n")
    (tmp_path / "c.html").write_bytes("<html><body><h1>Olá</h1></body></html>".encode("latin-1"))
    (tmp_path / "d.xlsx").write_bytes(b"%PDF-1.4")
    (tmp_path / "e.txt").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "f.bin").write_bytes(b"RIFF0000WAVE")
    (tmp_path / "g.eml").write_bytes("Subject: =?utf-8?B?T2zDoQ==?=\nFrom: a@b.c\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\nd=C3=A9bito".encode())
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert {k: r.kind for k, r in got.items()} == {"a.docx": "docx", "broken.docx": "docx", "b.csv": "csv", "c.html": "html", "d.xlsx": "pdf", "e.txt": "image", "f.bin": "audio", "g.eml": "eml", "h.txt": "csv"}
    assert got["a.docx"].markdown == "# Título\n\ntexto\n\n- item\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    assert got["broken.docx"].error and got["c.html"].markdown == "# Olá" and got["b.csv"].markdown == "| numero | valor |\n| --- | --- |\n| 1 | 2 |"
    assert got["g.eml"].markdown == "# Olá\n**From:** a@b.c\n\ndébito" and got["d.xlsx"].needs_ocr and got["f.bin"].needs_transcription
    assert files.read_files(spark, str(tmp_path), r"\.CSV$").count() == 1
    heads = spark.createDataFrame([(b"GGUF\x03",), (b"\x10\0\0\0\0\0\0\0{\"",), (b"<!DOCTYPE html>",), (b"PK\x03\x04",), (b"ab",)], "c binary")
    assert [r[0] for r in heads.select(files.model_format(F.col("c"))).collect()] == ["gguf", "safetensors", "html", "zip", "unknown"]
    table = files.read_delimited(spark, str(tmp_path / "b.csv"), ";").collect()
    assert [(r.numero, r.valor) for r in table] == [("1", "2")]


def test_limiter(spark):
    verdicts, *_ = streams.limited([0.0, 1.0, 2.0, 61.0], 2)
    assert verdicts == [(True, 0.0), (True, 0.0), (False, 58.0), (True, 0.0)]
    e = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 2)] + [("b", datetime(2024, 1, 1))], "c string, ts timestamp")
    got = streams.rate_limit(e, "c", "ts", 2).orderBy("client", "us").collect()
    assert [(r.client, r.allowed) for r in got] == [("a", True), ("a", True), ("a", False), ("b", True)]


def test_streams(spark, tmp_path):
    src, ck, out = (str(tmp_path / x) for x in ("src", "ck", "out"))
    e = [("a", datetime(2024, 1, 1, 0, 0, s)) for s in (0, 1, 5)] + [("z", datetime(2024, 1, 2))]
    spark.createDataFrame(e, "c string, ts timestamp").write.parquet(src)
    s = spark.readStream.schema("c string, ts timestamp").parquet(src)

    def run(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{ck}-{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    bursts = run(streams.debounce(s, ["c"], "ts", item="ts"), "bursts")
    assert sorted((r.c, r.n) for r in bursts if r.c == "a") == [("a", 1), ("a", 2)]
    assert sorted(r.n for r in run(streams.tumbling(s.withColumn("v", F.lit(1)), ["c"], "ts", "1 minute", "v"), "tumbling")) == [3]
    assert sum(r.allowed for r in run(streams.rate_limit(s, "c", "ts", 2), "limited")) == 3
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name in ("a.txt", "b.txt"):
        (inbox / name).write_bytes(b"same")
    q = streams.ingest_new(streams.watch_folder(spark, str(inbox)), ck + "-in", out, lambda sp: None, lambda d: d.select("path", "digest"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 1


@pytest.mark.parametrize("n", [0, 3])
def test_shards_and_report(spark, n):
    f = spark.createDataFrame([(f"m-0000{i + 1}-of-00003.gguf", 5) for i in range(n)], "path string, size long")
    assert [tuple(r) for r in R.shard_groups(f).collect()] == ([("m-00001-of-00003.gguf", 15, 3)] if n else [])
