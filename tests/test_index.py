"""Committed tables and the kept index: versions, failed and competing writes, skipped blocks, replaced sources."""

import pytest
from pyspark.sql import functions as F

from docengine.operators import documents as D
from docengine.operators import search as S
from docengine.operators.index import Index
from docengine.sources.store import Conflict, KeptTable

from .conftest import SF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def chunks(spark, tmp_path):
    data = spark.createDataFrame([(f"s{i % 7}", i, f"text {i}", None) for i in range(60)] + [(None, 99, "of none", "x")], "source string, n int, `a.b` string, note string")
    return data, KeptTable.create(f"file://{tmp_path}/t", data, "source", parts=5)


def test_changes_are_what_the_plans_say(spark, chunks):
    data, t = chunks
    assert rows(t.read()) == rows(data)
    new = spark.createDataFrame([("s1", 1000, "new", "y"), ("s9", 1001, "added", None)], data.schema)
    t.replace(new)
    want = D.replace_rows(data, new, "source")
    assert rows(t.read()) == rows(want)
    t.append(new)
    want = want.unionByName(new)
    assert rows(t.read()) == rows(want)
    gone = spark.createDataFrame([("s2",), ("nowhere",)], "source string")
    t.delete(gone)
    want = D.delete_cascade(gone, "source", want)[0]
    assert rows(t.read()) == rows(want)
    patch = spark.createDataFrame([("s3", "noted")], "source string, note string")
    t.update(patch)
    want = want.withColumn("note", F.when(F.col("source") == "s3", "noted").otherwise(F.col("note")))
    assert rows(t.read()) == rows(want)
    t.delete_where(F.col("n") % 10 == 4)
    t.update_where(F.col("note") == "noted", n=F.col("n") + 5000)
    want = want.where("n % 10 <> 4").withColumn("n", F.when(F.col("note") == "noted", F.col("n") + 5000).otherwise(F.col("n")))
    assert rows(t.read()) == rows(want)
    assert rows(t.read(1)) == rows(data)  # every version can still be read
    assert t.versions.vacuum(1) > 0 and rows(t.read()) == rows(want)
    t.delete(t.read().select("source").where("source IS NOT NULL"))
    assert [r.n for r in t.read().collect()] == [99]  # a null key equals no other


def test_upsert_keeps_one_row_per_key(spark, tmp_path):
    t = KeptTable.create(f"file://{tmp_path}/m", spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int"), "key", parts=3)
    t.upsert(spark.createDataFrame([("b", 20), ("c", 30)], "key string, v int"))
    assert rows(t.read()) == [("a", 1), ("b", 20), ("c", 30)]


def test_empty_tables_and_changes(spark, tmp_path):
    empty = spark.createDataFrame([], "key string, v int")
    t = KeptTable.create(f"file://{tmp_path}/e", empty, "key")
    assert t.read().count() == 0 and t.read().columns == ["key", "v"]
    assert t.replace(empty) == 1
    t.append(spark.createDataFrame([("a", 1)], "key string, v int"))
    assert rows(t.read()) == [("a", 1)]


def test_a_failed_write_changes_nothing(spark, chunks):
    data, t = chunks
    before = rows(t.read())
    broken = spark.createDataFrame([("s1", 1, "x", "y")], data.schema).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken)
    assert rows(t.read()) == before and t.versions.latest() == 1


def test_one_of_two_writers_is_refused(spark, chunks):
    data, t = chunks
    base = t.versions.load()
    t.append(spark.createDataFrame([("s1", 5, "first", None)], data.schema))
    with pytest.raises(Conflict):
        t.versions.commit(base, {})
    assert "first" in [r["a.b"] for r in t.read().collect()]
    t.replace(spark.createDataFrame([("s1", 6, "second", None)], data.schema))  # a reader of the new version may go on
    assert [r["a.b"] for r in t.read().where("source = 's1'").collect()] == ["second"]


QUERIES = ["ing ndble tion ing", "of_the thation", "mentch équeê réaumente", "the of and", "worthless", "the_the", "zzqqy"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(10**6, None, None, "x"), (10**6 + 1, None, "the of and the", "x")], docs.schema))
    return docs, Index.create(f"file://{tmp_path_factory.mktemp('i')}/i", docs, groups=3, buckets=8, width=16)


@pytest.mark.parametrize("query", QUERIES)
def test_index_ranks_as_the_scan(kept, query):
    docs, index = kept
    want = rows(S.top(S.bm25(docs, query), 12, 6))
    assert rows(index.search(query, 12, 6)) == want
    assert rows(index.search(query, 12, 6, skip=False)) == want
    some = rows(S.top(S.bm25(docs, query, keep=F.col("source").isin("src1", "src3")), 5, 6))
    assert rows(index.search(query, 5, 6, sources=F.col("source").isin("src1", "src3"))) == some


def test_index_skips_slices_by_proof(kept):
    docs, index = kept
    every, open_ = index.bounds("worthless the"), index.open_slices("worthless the", 3, 6)
    assert 0 < open_.count() < every.count()
    scores = {r.id: r.score for r in S.bm25(docs, "worthless the").collect()}
    bound = {r.slice: r.bound for r in every.collect()}
    place = {r.id: r.slice for r in index.documents().collect()}
    assert all(bound[place[i]] >= s - 1e-9 for i, s in scores.items())


def test_a_source_is_replaced(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    index = Index.create(f"file://{tmp_path}/i", docs, groups=4, buckets=4, width=16)
    new = docs.where("source = 'src1' AND doc_id % 3 <> 0").withColumn("text", F.concat(F.lit("worthless words "), "text"))
    index.replace(new, docs)
    now = docs.where("NOT source <=> 'src1'").unionByName(new)
    for query in ("worthless", "the_of words", "ing tion"):
        assert rows(index.search(query, 20, 6)) == rows(S.top(S.bm25(now, query), 20, 6))
    again = Index(spark, f"file://{tmp_path}/i")  # as another session reads it
    assert rows(again.search("worthless", 20, 6)) == rows(index.search("worthless", 20, 6))
    index.replace(docs.where("false"), docs)
    assert index.state["version"] == 2


def test_empty_index(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, source string, text string")
    index = Index.create(f"file://{tmp_path}/i", docs)
    assert index.search("anything", 5).count() == 0
    index.replace(spark.createDataFrame([(1, "a", "some words"), (2, "a", "other words")], docs.schema), docs)
    assert [r.id for r in index.search("some", 5).collect()] == [1]
