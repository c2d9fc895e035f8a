"""Questions to a model about documents, with a stand-in that now and then answers without JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.operators import models as M

from .common import table
from .search import HINTS, _HINT


def _stand_in(answer):
    """A model whose first answer is no JSON for a third of the questions, and the second for a seventh of them."""

    def run(talks: list[list[dict[str, str]]]) -> list[str]:
        out = []
        for talk in talks:
            n, second = len(talk[1]["content"]), len(talk) > 2
            broken = n % 7 == 0 if second else n % 3 == 0
            out.append("Claro, aqui está." if broken else "```json\n" + answer(n) + "\n```")
        return out

    return run


def model_classify(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose hints are no proof are shown to the model; it names a type, or one that there isn't."""
    return M.classify_documents(table(spark, sf, "documents"), HINTS, {"alpha": "Alpha"}, _stand_in(lambda n: f'{{"tipo": "{["alpha", "beta ", "gamma", "outro"][n % 4]}"}}'))


def model_extract(spark: SparkSession, sf: str) -> DataFrame:
    schemas = {"en": ("Letter", {"type": "object", "properties": {"size": {"type": "string"}}}), "de": ("Brief", {"type": "object", "properties": {}})}
    got = M.extract_fields(table(spark, sf, "documents"), schemas, _stand_in(lambda n: f'Ok: {{"size": "{n}", "odd": {"null" if n % 2 == 0 else 1}, "none": ""}} fim'), type_col="lang")
    return got.select("id", "type", F.try_element_at("fields", F.lit("size")).alias("size"), F.size("fields").alias("n_fields"), "calls", "error")


def model_remember(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", F.col("source").alias("name"), F.coalesce("lang", F.lit("none")).alias("project_id"))
    old = table(spark, sf, "nation").select(F.lit("en").alias("project_id"), F.concat(F.lit("f"), F.col("n_nationkey").cast("string"), F.lit(" dito")).alias("text"))
    return M.remember(d, old, _stand_in(lambda n: f'{{"summary": "s{n % 50}", "facts": ["f{n % 90} dito ", "x"], "glossary": ["g{n % 5} — termo"]}}'))


QUERIES = {f.__name__: f for f in (model_classify, model_extract, model_remember)}

_CALLS = "CASE WHEN n % 3 <> 0 THEN 1 ELSE 2 END AS calls, n % 3 <> 0 OR n % 7 <> 0 AS good"
ORACLE = {
    "model_classify": _HINT.rstrip() + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, place) AS k, count(*) OVER (PARTITION BY id) AS c, lead(score) OVER (PARTITION BY id ORDER BY score DESC, place) AS nxt FROM h WHERE score > 0),
b AS (SELECT d.doc_id AS id, type, coalesce(c = 1 OR score >= nxt + 2, false) AS sure, length(substr(coalesce(text, ''), 1, 4000)) + {len('Tipos possíveis: alpha (Alpha), beta (beta), gamma (gamma), ou "outro".' + chr(10) * 2 + 'Documento:' + chr(10) + chr(10) * 2 + 'Responda: {"tipo": "<id>"}')} AS n FROM documents d LEFT JOIN r ON r.id = d.doc_id AND r.k = 1),
a AS (SELECT *, {_CALLS}, ['alpha', 'beta', 'gamma', 'outro'][n % 4 + 1] AS said FROM b)
SELECT id, CASE WHEN NOT sure AND good AND said <> 'outro' THEN said ELSE type END AS type, CASE WHEN sure THEN 0 ELSE calls END AS calls FROM a""",
    "model_extract": f"""WITH b AS (SELECT doc_id AS id, lang AS type, trim(coalesce(text, ''), ' ') = '' AS bare, length(substr(coalesce(text, ''), 1, 16000)) + CASE lang WHEN 'en' THEN @en ELSE @de END AS n FROM documents),
a AS (SELECT *, {_CALLS}, NOT bare AND type IN ('en', 'de') AS asked FROM b)
SELECT id, type, CASE WHEN asked AND good THEN n::VARCHAR END AS size, CASE WHEN asked AND good THEN CASE WHEN n % 2 = 0 THEN 1 ELSE 2 END END AS n_fields,
CASE WHEN coalesce(asked, false) THEN calls ELSE 0 END AS calls, CASE WHEN bare THEN '{M.NO_TEXT}' WHEN NOT coalesce(asked, false) THEN '{M.NO_TYPE}' WHEN NOT good THEN '{M.NO_JSON}' END AS error FROM a""",
    "model_remember": f"""WITH b AS (SELECT doc_id, coalesce(source, 'documento') AS name, coalesce(lang, 'none') AS project, length(substr(text, 1, 12000)) + length(coalesce(source, 'documento')) + {len('Documento: ') + 4 + len(M.REMEMBER_ASK)} AS n FROM documents WHERE length(text) >= 400),
a AS (SELECT *, {_CALLS} FROM b),
e AS (SELECT project, doc_id, 0 AS place, 'summary' AS kind, name || ': s' || (n % 50) AS text FROM a WHERE good
UNION ALL SELECT project, doc_id, 1, 'fact', 'f' || (n % 90) || ' dito' FROM a WHERE good
UNION ALL SELECT project, doc_id, 2, 'glossary', 'g' || (n % 5) || ' — termo' FROM a WHERE good),
u AS (SELECT *, row_number() OVER (PARTITION BY project, text ORDER BY doc_id, place) AS k FROM e)
SELECT project, text, kind, doc_id AS source_id FROM u WHERE k = 1 AND NOT (project = 'en' AND text IN (SELECT 'f' || n_nationkey || ' dito' FROM nation))""",
}
_HEADS = {"en": 'Tipo: Letter\nEsquema JSON esperado:\n{\n  "type": "object",\n  "properties": {\n    "size": {\n      "type": "string"\n    }\n  }\n}\n\nDocumento:\n', "de": 'Tipo: Brief\nEsquema JSON esperado:\n{\n  "type": "object",\n  "properties": {}\n}\n\nDocumento:\n'}
for _k, _v in _HEADS.items():
    ORACLE["model_extract"] = ORACLE["model_extract"].replace(f"@{_k}", str(len(_v)))
