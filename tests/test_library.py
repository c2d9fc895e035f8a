"""Asking, exports, names, collections of files and the job mirror, on literals."""

import json

from pyspark.sql import functions as F

from docengine.operators import library as L
from docengine.operators import search as S
from docengine.sources import collections as C
from docengine.streaming import streams


def test_ask_without_hits_asks_no_model(spark):
    q = spark.createDataFrame([(1, " who? ", "P"), (2, "what", "P"), (3, "  ", "P")], "id int, question string, project string")
    hits = spark.createDataFrame([(1, 2, "b.md", None, "two"), (1, 1, "a.pdf", 3, "one")], "id int, n int, name string, page int, text string")
    p = L.ask_prompts(q, hits, "id").orderBy("id")
    first, second = p.collect()
    assert first.user == "[1] a.pdf, página 3\none\n\n[2] b.md\ntwo\n\n\n\nPergunta: who?" and first.used == 2
    assert second.system is None and second.used == 0
    got = {r.id: r.text for r in L.answers(p, lambda s, u: ["  yes [1] "] * len(u), "id").collect()}
    assert got == {1: "yes [1]", 2: L.NOT_FOUND}


def test_vtt_and_markdown_of_nothing(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 1.5, None, "a"), (1, 1, 1.5, 3661.0, "", "b")], "id int, seq int, start double, end double, speaker string, text string")
    assert L.to_vtt(s, "id", "seq").first().vtt == "WEBVTT\n\n00:00:00.000 --> 00:00:01.500\na\n\n00:00:01.500 --> 01:01:01.000\nb\n"
    assert L.speaker_markdown(s, "id", "seq").first().markdown == "a\n\nb"
    assert L.to_txt(s.where("false"), "id", "seq").count() == 0


def test_summary_of_broken_answers(spark):
    rows = [None, "", "[1]", '{"summary":5,"decisions":"x","actions":{"text":1}}', '{"actions":[{"text":7,"owner":3,"due":" d "}]}']
    got = spark.createDataFrame(list(enumerate(rows)), "i int, j string").select("i", L.normal_summary(F.col("j")).alias("s")).orderBy("i").collect()
    assert [r.s.decisions + r.s.questions for r in got] == [[]] * 5
    assert [len(r.s.actions) for r in got] == [0, 0, 0, 0, 1]
    assert tuple(got[4].s.actions[0]) == ("7", None, "d")


def test_globs(spark):
    cases = [("*.gguf", "a.gguf", True), ("*.gguf", "d/a.gguf", False), ("**.gguf", "d/a.gguf", True), ("a?.b", "ax.b", True), ("a?.b", "ax_b", False), ("x(1)+[2].c", "x(1)+[2].c", True)]
    df = spark.createDataFrame(cases, "g string, p string, want boolean")
    assert df.where(F.regexp_like("p", L.glob_pattern(F.col("g"))) != F.col("want")).isEmpty()


def test_gated_sources_come_last(spark):
    src = spark.createDataFrame([("r", "main", 0, "gated", "w.bin", None, False), ("r", "main", 1, "open", "w.bin", None, False), ("r", "vae", 0, "gated", None, "*.bin", True), ("r", "none", 0, "open", "missing", None, False)], "recipe string, slot string, place int, repo string, path string, glob string, many boolean")
    tree = spark.createDataFrame([("gated", "w.bin", True), ("gated", "v.bin", True), ("open", "w.bin", False)], "repo string, path string, gated boolean")
    got = {r.slot: (r.repo, r.files, r.tried) for r in L.resolve_slots(src, tree).collect()}
    assert got == {"main": ("open", ["w.bin"], 1), "vae": ("gated", ["v.bin", "w.bin"], 0), "none": (None, None, 1)}


def joined(spark, df):
    """The rows of a query, and the most rows that one of its steps put out."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if (count := node.metrics().get("numOutputRows")).isDefined():
            most = max(most, count.get().value())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    return rows, most


def test_plan_steps_of_many_references_to_one_repository(spark):
    files = [(f"{('', 'sub/', 'sub/in/', 'images/')[k % 4]}f{k:03}.{('gguf', 'onnx', 'bin')[k % 3]}", 1 + k) for k in range(400)]
    tree = spark.createDataFrame([("o/r", *f) for f in files] + [("o/s", "a.onnx", 1), ("o/s", None, 1), (None, "b.gguf", 1)], "repo string, path string, size long")
    kinds = [(None, None), ("f004.onnx", None), ("gone", "sub"), ("f004.onnx", "sub/in"), (None, "su"), (None, "sub/"), ("images/f003.gguf", "sub")]
    refs = spark.createDataFrame([(k, "o/r", *kinds[k % 7], None) for k in range(700)] + [(700, "o/s", None, None, "text"), (701, None, None, None, None), (702, "O/K", None, None, None), (702, "O/K", None, None, None)], "ref int, repo string, path string, subpath string, kind string")
    recipes = spark.createDataFrame([(f"r{k}", "o/k", "draft" if k else "verified") for k in range(200)], "recipe string, repo string, status string")
    conv = spark.createDataFrame([], "repo string, id string, downloads int")
    got, most = joined(spark, L.plan_steps(refs, tree, recipes, conv))
    inside = lambda sub: min(f for f, _ in files if f.startswith(sub) and f.endswith(".gguf"))
    top = min(f for f, _ in files if f.endswith(".gguf") and not f.startswith("images/"))
    want = [("gguf", top), ("file", "f004.onnx"), ("gguf", inside("sub/")), ("file", "f004.onnx"), (None, None), (None, None), ("file", "images/f003.gguf")]
    assert {r.ref: (r.step, r.pick) for r in got} == {k: want[k % 7] for k in range(700)} | {700: ("onnx", "a.onnx"), 701: (None, None), 702: ("recipe", "r0")}
    assert len(got) == 703 and most < 2000


def test_companions_of_many_files_of_one_name(spark):
    files = spark.createDataFrame([(f"/m/{k % 50}/d/w.bin",) for k in range(1000)] + [("/m/x/w.bin",), (None,), ("w.bin",), ("/e/",)], "path string")
    wanted = spark.createDataFrame([(k, f"{k % 60}/d/w.bin") for k in range(1000)] + [(1000, "w.bin"), (1001, None), (1002, ""), (1003, "ww.bin"), (1004, "m/x/w.bin"), (1004, "zz/w.bin"), (1005, "bin")], "id int, suffix string")
    got, most = joined(spark, L.companions(wanted, files))
    paths = [f"/m/{k}/d/w.bin" for k in range(50)]
    want = {k: min(p for p in paths if p.endswith(f"{k % 60}/d/w.bin")) for k in range(1000) if k % 60 < 50}
    assert {r.id: r.path for r in got} == want | {1000: "/m/0/d/w.bin", 1002: "/e/", 1004: "/m/x/w.bin"}
    assert most < 3000


def test_slots_of_many_recipes_from_one_repository(spark):
    tree = spark.createDataFrame([("o/r", f"f{k:03}.{('bin', 'gguf')[k % 2]}", False) for k in range(400)] + [("o/r", "f001.gguf", None), ("o/g", "g.bin", True)], "repo string, path string, gated boolean")
    patterns = [("f002.bin", None, False), (None, "*.gguf", False), (None, "f00?.gguf", True), ("gone", "*.gguf", True), (None, None, True), ("f004.bin", "x", None)]
    src = [(f"r{k}", "main", place, ("o/g", "o/r")[place], *patterns[k % 6]) for k in range(600) for place in (0, 1)] + [(None, None, 0, "o/r", None, "f00[", True), (None, None, 1, "o/r", "f006.bin", None, True), (None, None, 1, "o/r", None, "f00?.bin", True), ("n", "main", 0, None, None, "*", False)]
    src = spark.createDataFrame(src, "recipe string, slot string, place int, repo string, path string, glob string, many boolean")
    got, most = joined(spark, L.resolve_slots(src, tree))
    few = ["f001.gguf", "f001.gguf", "f003.gguf", "f005.gguf", "f007.gguf", "f009.gguf"]
    want = [("o/r", ["f002.bin"], 1), ("o/r", ["f001.gguf"], 1), ("o/r", few, 1), (None, None, 2), (None, None, 2), ("o/r", ["f004.bin"], 1)]
    both = ["f000.bin", "f002.bin", "f004.bin", "f006.bin", "f006.bin", "f008.bin"]
    assert {r.recipe: (r.repo, r.files, r.tried) for r in got} == {f"r{k}": want[k % 6] for k in range(600)} | {None: ("o/r", both, 1), "n": (None, None, 1)}
    assert most < 4000


def test_collections_skip_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"createdAt":"2024","turns":[1,2]}')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.txt").write_text("{}")
    got = C.json_collection(spark, str(tmp_path), "createdAt string, turns array<int>").collect()
    assert [(r.id, r.createdAt, r.turns) for r in got] == [("a", "2024", [1, 2])]


def test_types_of_two_folders(spark, tmp_path):
    schema = {"type": "object", "properties": {"numero": {"type": "string", "description": "d"}, "total": {"type": "number"}, "itens": {"type": "array", "items": {"type": "object", "properties": {"q": {"type": "integer"}}}}}, "required": ["numero", "total"]}
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps({"doctypes": [{"id": "nfe", "name": "old"}, {"id": "x", "hints": ["h"]}]}))
    (tmp_path / "one" / "broken.json").write_text("{")
    (tmp_path / "two" / "b.json").write_text(json.dumps({"id": "nfe", "name": "new", "schema": schema, "crossCheck": {"key": ["numero"]}}))
    got = {r.id: r for r in C.type_files(spark, str(tmp_path / "one"), str(tmp_path / "two")).collect()}
    assert set(got) == {"nfe", "x"} and got["nfe"].name == "new" and got["nfe"].key == ["numero"] and got["x"].hints == ["h"]
    rows = spark.createDataFrame([('{"numero":"1","total":2.5,"itens":[{"q":3}]}',), ('{"total":1}',), ("broken",)], "answer string")
    out = C.read_fields(rows, got["nfe"].schema).collect()
    assert out[0].fields.itens[0].q == 3 and [r.missing for r in out] == [[], ["numero"], ["numero", "total"]]


def test_job_mirror(spark, tmp_path):
    spark.createDataFrame([("job", "a"), ("log", "b"), ("job", "c")], "topic string, id string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("topic string, id string").parquet(str(tmp_path / "in"))
    streams.mirror_jobs(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a", "c"}


def test_index_ranks_as_the_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ação de teste, ação de novo"), (2, "acao_de teste"), (3, None), (4, "nothing here")], "doc_id long, text string")
    S.postings(docs).write.parquet(str(tmp_path / "index"))
    for query in ("acao_de teste", "teste teste", "", "zz"):
        scan = [tuple(r) for r in S.top(S.bm25(docs, query), 5).collect()]
        assert [tuple(r) for r in S.top(S.bm25_postings(spark.read.parquet(str(tmp_path / "index")), query), 5).collect()] == scan


def test_contained_items(spark):
    docs = spark.createDataFrame([(1, "a b\n c d e"), (2, "ab c d"), (3, None), (4, " b  c ")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b c"), (2, "c d e"), (3, ""), (4, None), (5, "a b c d e f")], "item_id long, text string")
    assert {tuple(r) for r in S.contained(docs, items).collect()} == {(1, 1), (1, 2), (4, 1)}
    assert S.contained(docs, items.where("false")).count() == 0
