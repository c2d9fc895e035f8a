"""Goldens of text and validation functions and of the chunker."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from docengine.functions import text as T
from docengine.functions import validate as V
from docengine.operators import chunk, search


def values(spark, col, *rows):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(col).collect()]


def test_identifiers(spark):
    x = F.col("x")
    assert values(spark, V.is_valid_cnpj(x), "11.222.333/0001-81", "11222333000181", "11222333000182", "11111111111111", None) == [True, True, False, False, False]
    assert values(spark, V.is_valid_cpf(x), "529.982.247-25", "52998224724", "11111111111", "", None) == [True, False, False, False, False]
    base = "3520091234567800019955001000000123100000123"
    digit = values(spark, V.nfe_check_digit(x), base)[0]
    keys = [base + str(digit)] + [base[:i] + str((int(base[i]) + 1) % 10) + base[i + 1 :] + str(digit) for i in (0, 7, 20, 42)]
    assert values(spark, V.is_valid_nfe_key(x), *keys) == [True, False, False, False, False]


def test_amounts_and_dates(spark):
    x = F.col("x")
    assert values(spark, V.parse_amount(x), "R$ 1.234,56", "1,234.56", "1234.56", "2.500", "2.5", "1,234", "1,234,567", "12-34", "abc", None, "-3,5", "5d") == [1234.56, 1234.56, 1234.56, 2500.0, 2.5, 1.234, None, None, None, None, -3.5, 5.0]
    assert values(spark, V.parse_date(x), "01/09/2026", "2026-09-01T10", "01-09-26", "31/02/2026", "1/13/2026", "x", None) == ["2026-09-01", "2026-09-01", "2026-09-01", "2026-02-31", None, None, None]
    assert values(spark, V.normalize_value(x), "01/09/2026", "11.222.333/0001-81", "R$ 10,00", "-2.5", " A  b ", None, "2.005") == ["2026-09-01", "11222333000181", "10", "-2.5", "a b", "", "2005"]


def test_validators(spark):
    f = F.create_map(F.lit("valorTotal"), F.lit("30,00"), F.lit("cnpj"), F.lit("1"), F.lit("dataEmissao"), F.lit("02/01/2026"), F.lit("dataVencimento"), F.lit("01/01/2026"))
    items = F.array(F.create_map(F.lit("quantidade"), F.lit("2"), F.lit("precoUnitario"), F.lit("10,00")), F.create_map(F.lit("valor"), F.lit("10")))
    d = spark.range(1).select(V.run_validators(list(V.VALIDATORS), f, items, F.lit("nfe"), F.lit("2026-06-01").cast("date")).alias("i"))
    r = d.select("i", V.is_ok(F.col("i")).alias("ok")).first()
    assert [x["code"] for x in r.i] == ["nfe_key_missing", "cnpj_invalido", "vencimento_antes_emissao", "campo_faltando"] and not r.ok
    assert [x["code"] for x in spark.range(1).select(V.run_validators(["zzz"], f)).first()[0]] == ["validador_desconhecido"]


def test_text(spark):
    x = F.col("x")
    assert values(spark, T.slugify(x), "Ação & Reação", "", None) == ["acao-reacao", "project", "project"]
    assert values(spark, T.estimate_tokens(x), "", "12345", "😀😀😀") == [1, 2, 2]
    assert values(spark, T.column_index(x), "A", "AA12", "") == [0, 26, -1]
    assert values(spark, T.decode_entities(x), "&amp;lt; &#233;&#xe9; &nada; &EACUTE;") == ["&lt; éé &nada; é"]
    assert values(spark, T.guess_delimiter(x), "a;b;c\n1;2;3", "plain") == [";", ","]
    assert values(spark, T.snippet(x, "word", 20), "short", "x" * 30 + " word " + "y" * 30)[0] == "short"
    html = "<title>T</title><style>p{}</style><h2>Head</h2><p><b>bold</b> <a href='/u'>link</a></p><ul><li>one</li></ul>"
    assert values(spark, T.html_to_markdown(F.col("x")), html) == ["# T\n\nT\n## Head\n**bold** [link](/u)\n- one"]
    assert values(spark, T.quant_from_name(x), "m-Q4_K_M.gguf", "a.bin") == ["Q4_K_M", None]
    assert values(spark, T.params_from_name(x), "qwen-4B-it", "none") == [4000000000, None]
    refs = values(spark, T.parse_ref(x)["label"], "org/repo:Q4_K_M", "https://huggingface.co/org/repo/blob/main/a/b.gguf", "https://civitai.com/models/12?modelVersionId=34", "recipe:flux", "https://x.test/f%20g.bin", "hf://o/r/p.gguf", "nothing here")
    assert refs == ["org/repo", "org/repo/a/b.gguf", "civitai:34", "recipe:flux", "f g.bin", "o/r/p.gguf", None]


def test_bm25_against_fts5(spark):
    docs = [(1, "nota fiscal eletrônica número 5"), (2, "recibo de padaria"), (3, "nota de débito e nota fiscal"), (4, ""), (5, None), (6, "Fiscal das notas a_b x")]
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(id UNINDEXED, text, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, t or "") for i, t in docs])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for q, match in (("nota fiscal", '"nota" OR "fiscal"'), ("nota nota débito", '"nota" OR "nota" OR "débito"'), ("a_b recibo", '"a_b" OR "recibo"')):
        want = {r[0]: round(r[1], 6) for r in con.execute("SELECT id, -bm25(t) FROM t WHERE t MATCH ?", (match,))}
        assert {r["id"]: round(r["score"], 6) for r in search.bm25(df, q).collect()} == pytest.approx(want)
    assert search.bm25(df, "! ?").count() == 0


def test_fusion_and_degraded_search(spark):
    a, b = (spark.createDataFrame([(x, i + 1) for i, x in enumerate(s)], "id string, rank int") for s in ("ab", "bc"))
    assert [r["id"] for r in search.rank_fusion([a, b], 10).orderBy("rank").collect()] == ["b", "a", "c"]
    d = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0]), (2, "beta", [0.0, 1.0])], "doc_id long, text string, embedding array<float>")
    assert [r["doc_id"] for r in search.hybrid(d, "beta", [0.0, 1.0]).collect()] == [2, 1]
    assert [r["doc_id"] for r in search.hybrid(d, "alpha", None).collect()] == [1]
    hits = search.hybrid(d, "beta", None)
    assert [r["doc_id"] for r in search.rerank(hits, "q", lambda q, t: [0.0, 1.0]).collect()] != [r["doc_id"] for r in search.rerank(hits, "q", lambda q, t: [1.0, 0.0]).collect()]
    assert search.rerank(hits, "q", lambda q, t: 1 / 0).count() == 2


def test_batches_of_queries_agree(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    q = v.select(v.vec_id.alias("query_id"), v.embedding.alias("query_vector"))
    rows = lambda block: sorted(tuple(r) for r in search.semantic_batch(v, q, 3, block=block).select("query_id", "id", "score", "rank").collect())
    assert rows(1000) == rows(16)


def test_chunker(spark):
    md = "<!-- página 1 -->\n\n# Um\n\n" + "palavra " * 30 + "\n\n| a | b |\n|---|---|\n" + "| x | y |\n" * 60 + "\n\n<!-- página 2 -->\n\n## Dois\n\nfim"
    got = chunk.chunks_of(md, 40, 0)
    tables = [c for c in got if "| x | y |" in c[1]]
    assert len(tables) == 1 and tables[0][1].count("| x | y |") == 60
    assert [c[2] for c in got] == sorted(c[2] for c in got) and got[-1][1] == "## Dois\n\nfim" and got[-1][3] == "Dois"
    assert chunk.sentence_pieces("linha um\nlinha dois. fim", 3, False) == ["linha dois.", "fim"]
    assert "linha um" in " ".join(chunk.sentence_pieces("linha um\nlinha dois. fim", 3, True))
    d = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")
    assert chunk.chunk_markdown(d, limit=40).where("doc_id > 1").count() == 0
    parts = chunk.speech_parts("Uma frase curta. Outra frase curta! " + "x" * 40, 30)
    assert parts == ["Uma frase curta.", "Outra frase curta!", "x" * 40]
