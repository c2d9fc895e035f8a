"""What an injected model decides about documents: types, fields, memories, with one more question where its answer isn't JSON.

A model is a function from conversations (lists of role and content) to texts.  It is called in batches inside tasks, for a bounded
number of rows at a time.  Only the rows whose answer holds no JSON that is accepted are asked again, once and together; a model that
fails, or fails twice, leaves an error in the row and never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .catalog import json_in
from .documents import classify, hint_scores, prune

Model = Callable[[list[list[dict[str, str]]]], list[str]]
#: What a model is told.
AGAIN = "Responda SOMENTE com o JSON pedido, sem texto em volta."
NO_JSON = "o modelo não devolveu JSON válido"
CLASSIFY = "Você classifica documentos brasileiros. Responda só com JSON."
EXTRACT = "Você extrai campos de documentos brasileiros. Copie os valores exatamente como aparecem (inclusive pontuação de CNPJ e datas). Se um campo não existir no documento, use null. Responda só o JSON."
REMEMBER = "Você extrai memória de documentos em português do Brasil. Só registre o que está escrito; nada de suposições."
REMEMBER_ASK = 'Responda em JSON: {"summary": "resumo em 2 linhas", "facts": ["fatos objetivos, com números e datas"], "glossary": ["termo — significado usado neste projeto"]}'
NO_TEXT, NO_TYPE = "documento sem texto extraído", "não consegui identificar o tipo do documento"
#: Signs of a document that a question shows, and most facts and terms that are kept of one.
SHOWN = {"classify": 4000, "extract": 16000, "remember": 12000}
FACTS = 8

ANSWER = T.StructType([T.StructField("json", T.StringType()), T.StructField("calls", T.IntegerType()), T.StructField("error", T.StringType())])


def ask_json(system: str, user: Column, model: Model, accept: Callable[[object], bool] = lambda _: True, batch: int = 16) -> Column:
    """struct<json, calls, error> of one question per row: the JSON text in the answer, how often the model was asked, what went wrong.

    A null question isn't asked.  ``accept`` may refuse a parsed answer, which then counts as none.
    """

    def good(text: str | None) -> str | None:
        found = json_in(text) if text is not None else None
        return found if found is not None and accept(json.loads(found)) else None

    def called(talks: list[list[dict[str, str]]]) -> tuple[list[str | None], str | None]:
        try:
            got = model(talks)
            if len(got) != len(talks):
                raise ValueError("the model returned another number of answers")
            return list(got), None
        except Exception as e:  # noqa: BLE001 - a failing model is an error of its rows
            return [None] * len(talks), f"{type(e).__name__}: {e}"

    @F.arrow_udf(ANSWER)
    def run(questions: pa.Array) -> pa.Array:
        out: list[dict] = []
        for start in range(0, len(questions), batch):
            part = questions.slice(start, batch).to_pylist()
            rows = [{"json": None, "calls": 0, "error": None} for _ in part]
            todo = [(r, [{"role": "system", "content": system}, {"role": "user", "content": q}]) for r, q in zip(rows, part, strict=True) if q is not None]
            for _ in range(2):
                if not todo:
                    break
                texts, error = called([talk for _, talk in todo])
                again = []
                for (row, talk), text in zip(todo, texts, strict=True):
                    row["calls"] += 1
                    row["json"], row["error"] = good(text), error
                    if row["json"] is None and error is None:
                        row["error"] = NO_JSON
                        again.append((row, [*talk, {"role": "assistant", "content": text[:500]}, {"role": "user", "content": AGAIN}]))
                todo = again
            for row in rows:
                row["error"] = None if row["json"] is not None else row["error"]
            out += rows
        return pa.array(out, pa.struct([("json", pa.string()), ("calls", pa.int32()), ("error", pa.string())]))

    return run(user)


def classify_documents(docs: DataFrame, types: list[tuple], names: dict[str, str], model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, type, calls): the type that hints make sure of, else the one a model names, else the likeliest by hints, else null.

    Only documents that hints leave open are shown to the model.
    """
    hints = classify(hint_scores(docs, types, id_col, text))
    d = docs.select(F.col(id_col).alias("id"), F.col(text).alias("_text")).join(hints.select("id", F.col("type").alias("_type"), "sure"), "id", "left")
    sure = F.coalesce("sure", F.lit(False))
    listed = ", ".join(f"{t[0]} ({names.get(t[0], t[0])})" for t in types)
    asked = F.concat(F.lit(f'Tipos possíveis: {listed}, ou "outro".\n\nDocumento:\n'), F.substring(F.coalesce("_text", F.lit("")), 1, SHOWN["classify"]), F.lit('\n\nResponda: {"tipo": "<id>"}'))
    open_ = d.where(~sure).withColumn("_a", ask_json(CLASSIFY, asked, model))
    said = F.trim(F.coalesce(F.get_json_object("_a.json", "$.tipo"), F.lit("")))
    told = open_.select("id", F.when(said.isin(*[t[0] for t in types]), said).otherwise(F.col("_type")).alias("type"), F.col("_a.calls").alias("calls"))
    return d.where(sure).select("id", F.col("_type").alias("type"), F.lit(0).alias("calls")).unionByName(told)


def extract_fields(docs: DataFrame, schemas: dict[str, tuple[str, dict]], model: Model, id_col: str = "doc_id", text: str = "text", type_col: str = "type") -> DataFrame:
    """(id, type, fields, calls, error): the fields that a type's schema asks for, as a model reads them, without empty ones.

    ``schemas`` maps a type to its name and JSON schema.  A document without text or with an unknown type isn't asked about.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.trim(body) == ""
    question = F.lit(None).cast("string")
    for name, (title, schema) in schemas.items():
        head = f"Tipo: {title}\nEsquema JSON esperado:\n{json.dumps(schema, ensure_ascii=False, indent=2)}\n\nDocumento:\n"
        question = F.when(F.col(type_col) == name, F.concat(F.lit(head), F.substring(body, 1, SHOWN["extract"]))).otherwise(question)
    d = docs.select(F.col(id_col).alias("id"), F.col(type_col).alias("type"), F.when(~bare, question).alias("_q"), bare.alias("_bare"))
    d = d.withColumn("_a", ask_json(EXTRACT, F.col("_q"), model, lambda x: isinstance(x, dict)))
    error = F.when(F.col("_bare"), NO_TEXT).when(F.col("_q").isNull(), NO_TYPE).otherwise(F.col("_a.error"))
    return d.select("id", "type", prune(F.from_json("_a.json", "map<string,string>")).alias("fields"), F.col("_a.calls").alias("calls"), error.alias("error"))


def remember(docs: DataFrame, existing: DataFrame, model: Model, id_col: str = "doc_id", name: str = "name", text: str = "text", project: str = "project_id") -> DataFrame:
    """(project, text, kind, source_id): a summary, facts and terms of each document of 400 signs or more that aren't remembered yet.

    ``existing`` has (project, text).  Texts are trimmed and have 3 to 400 signs; what several documents say is the first one's.
    A model that fails leaves nothing.
    """
    long = docs.where(F.length(text) >= 400).select(F.col(project).alias("project"), F.col(id_col).alias("source_id"), F.coalesce(name, F.lit("documento")).alias("_name"), F.col(text).alias("_text"))
    asked = F.concat(F.lit("Documento: "), "_name", F.lit("\n\n"), F.substring("_text", 1, SHOWN["remember"]), F.lit("\n\n" + REMEMBER_ASK))
    told = long.withColumn("_j", F.from_json(ask_json(REMEMBER, asked, model, lambda x: isinstance(x, dict))["json"], "summary string, facts array<string>, glossary array<string>"))
    entry = lambda kind, place: lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(place).alias("place"), x.alias("text"))
    none = F.array().cast("array<string>")
    first = F.when(F.coalesce("_j.summary", F.lit("")) != "", F.array(F.concat("_name", F.lit(": "), "_j.summary"))).otherwise(none)
    lists = [(first, "summary"), (F.slice(F.coalesce("_j.facts", none), 1, FACTS), "fact"), (F.slice(F.coalesce("_j.glossary", none), 1, FACTS), "glossary")]
    every = F.concat(*[F.transform(texts, entry(kind, i)) for i, (texts, kind) in enumerate(lists)])
    rows = told.select("project", "source_id", F.explode(every).alias("e")).select("project", "source_id", "e.kind", "e.place", F.trim("e.text").alias("text"))
    rows = rows.where(F.length("text").between(3, 400)).groupBy("project", "text").agg(F.min(F.struct("source_id", "place", "kind")).alias("r"))
    old = existing.select(F.col(project).alias("_p"), F.col("text").alias("_t"))
    return rows.join(old, (F.col("project") == F.col("_p")) & (F.col("text") == F.col("_t")), "left_anti").select("project", "text", F.col("r.kind").alias("kind"), F.col("r.source_id").alias("source_id"))
