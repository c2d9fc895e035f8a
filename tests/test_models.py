"""Questions to an injected model: calls are counted, failures stay in their rows; cosine search skips cells by proof."""

import random

import pytest
from pyspark.sql import functions as F

from docengine.operators import models as M
from docengine.operators import search as S


def test_only_bad_answers_are_asked_again(spark):
    def model(talks):
        assert len(talks) <= 4
        return ["nothing" if "bad" in t[1]["content"] or ("once" in t[1]["content"] and len(t) == 2) else '{"a": 1} and more' for t in talks]

    df = spark.createDataFrame([("good",), ("once",), ("bad",), (None,), ("good",)] * 3, "q string").coalesce(1)
    got = df.select("q", M.ask_json("s", F.col("q"), model, batch=4).alias("r")).select("q", "r.*").collect()
    assert {(r.q, r.json, r.calls, r.error) for r in got} == {("good", '{"a": 1}', 1, None), ("once", '{"a": 1}', 2, None), ("bad", None, 2, M.NO_JSON), (None, None, 0, None)}


@pytest.mark.parametrize("model", [lambda talks: ["{}"], lambda talks: 1 // 0])
def test_a_failing_model_fails_no_job(spark, model):
    docs = spark.createDataFrame([(1, "the text", "p", "n"), (2, "that text", "p", "n")], "doc_id int, text string, project_id string, name string").coalesce(1)
    got = docs.select(M.ask_json("s", F.col("text"), model).alias("r")).select("r.*").collect()
    assert all(r.json is None and r.error and r.calls == 1 for r in got)
    types = [("alpha", ("the",), (), (), ()), ("beta", ("text",), (), (), ())]
    assert {(r.id, r.type) for r in M.classify_documents(docs, types, {}, model).collect()} == {(1, "alpha"), (2, "beta")}
    assert M.remember(docs.withColumn("text", F.repeat("text", 100)), docs.select("project_id", "text"), model).count() == 0


def test_answers_that_are_refused_count_as_none(spark):
    df = spark.createDataFrame([("q",)], "q string")
    r = df.select(M.ask_json("s", F.col("q"), lambda talks: ["[1]"] * len(talks), lambda x: isinstance(x, dict)).alias("r")).first().r
    assert (r.json, r.calls, r.error) == (None, 2, M.NO_JSON)


def plain_cosine(vectors, queries, k):
    def cos(a, b):
        n = min(len(a), len(b))
        a, b = a[:n], b[:n]
        x, y = sum(v * v for v in a) ** 0.5, sum(v * v for v in b) ** 0.5
        return round(sum(p * q for p, q in zip(a, b, strict=True)) / x / y, 6) if x and y else 0.0

    out = []
    for q, qv in queries:
        best = sorted((-cos(v, qv), i) for i, v in vectors if i != q)[:k]
        out += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots", [1, 8, 32])
def test_cosine_is_brute_force(spark, pivots):
    rng = random.Random(pivots)
    centers = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(7)]
    vectors = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centers)]) for i in range(400)]
    vectors += [(1000 + i, vectors[3][1]) for i in range(9)] + [(2000, [0.0] * 6), (2001, [1.0, 2.0]), (2002, [0.5] * 8), (2003, [])]
    queries = [v for v in vectors if v[0] % 40 == 3] + [(2000, [0.0] * 6), (5000, [1.0, 0.0]), (5001, vectors[0][1])]
    v = spark.createDataFrame([*vectors, (3000, None)], "vec_id int, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id int, query_vector array<double>")
    got = S.semantic_batch(v, q, 5, pivots=pivots)
    assert sorted((r.query_id, r.id, abs(r.score) if r.score == 0 else r.score, r["rank"]) for r in got.collect()) == plain_cosine(vectors, queries, 5)
    assert S.semantic_batch(v, q.where("false"), 5).count() == 0 and S.semantic_batch(v.where("false"), q, 5).count() == 0


def test_cosine_skips_cells(spark):
    rng = random.Random(2)
    centers = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    v = spark.createDataFrame([(i, [c + rng.gauss(0, 0.01) for c in centers[i % 12]]) for i in range(600)], "vec_id int, embedding array<double>")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    cells = S.CosineCells(v, pivots=24)
    every, open_ = cells.bounds(q).count(), cells.open_cells(q, 5).count()
    assert open_ < every / 3


def test_rerank_keeps_the_pool_apart(spark):
    hits = spark.createDataFrame([(i, "x" * i, 0.0, i) for i in range(1, 50)], "doc_id int, text string, score double, rank int").repartition(7)
    got = S.rerank(hits, "q", lambda _, texts: [float(len(t)) for t in texts], pool=10)
    assert [(r.doc_id, r["rank"]) for r in got.orderBy("rank").collect()] == [(11 - i, i) for i in range(1, 11)]
    assert sorted(r.doc_id for r in S.rerank(hits, "q", lambda *_: [1.0], pool=10).collect()) == list(range(1, 11))


def test_vectors_as_bytes(spark):
    rows = [(1, [1.0, -2.5]), (2, []), (3, None), (4, [0.1])]
    df = spark.createDataFrame(rows, "i int, v array<float>").coalesce(1).select("i", "v", S.pack_vector(F.col("v")).alias("b")).withColumn("u", S.unpack_vector(F.col("b")))
    assert all(r.u == r.v for r in df.collect())
    assert {r.i: None if r.b is None else bytes(r.b).hex() for r in df.collect()} == {1: "0000803f000020c0", 2: "", 3: None, 4: "cdcccc3d"}
    assert df.select(S.unpack_vector(F.lit(b"abc")).alias("x")).first().x is None
