"""Reconciliation, classification, deduplication and changes of document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions.text import normalize_name
from docengine.functions.validate import normalize_value

#: Document types with their hints, validators and reconciliation columns.
DOC_TYPES = (
    ("nfe", ("nota fiscal eletrônica", "danfe", "chave de acesso", "protocolo de autorização", "/nfe\\b/", "natureza da operação"), ("nfeKey", "cnpj", "cpf", "itemsSum", "dates", "positiveAmounts", "required"), ("numero",), ("valorTotal", "dataEmissao", "cnpjEmitente")),
    ("nfse", ("nota fiscal de serviço", "nfs-e", "iss", "prestador de serviços", "tomador", "código do serviço"), ("cnpj", "cpf", "dates", "positiveAmounts", "required"), ("numero",), ("valorTotal", "dataEmissao", "cnpjPrestador")),
    ("recibo", ("recibo", "recebi de", "importância de", "quantia de"), ("cnpj", "cpf", "dates", "positiveAmounts"), (), ()),
    ("boleto", ("boleto", "linha digitável", "cedente", "sacado", "nosso número", "vencimento", "beneficiário"), ("cnpj", "cpf", "dates", "positiveAmounts"), ("nossoNumero",), ("valorTotal", "dataVencimento")),
    ("fatura", ("fatura", "invoice", "vencimento", "total a pagar", "período de referência"), ("cnpj", "itemsSum", "dates", "positiveAmounts"), ("numero",), ("valorTotal", "dataVencimento")),
    ("contrato", ("contrato", "cláusula", "contratante", "contratada", "foro da comarca", "rescisão"), ("cnpj", "cpf", "dates"), (), ()),
    ("extrato", ("extrato", "saldo anterior", "lançamentos", "agência", "conta corrente", "saldo disponível"), ("cnpj", "cpf", "dates"), (), ()),
)


#: The edge of a word of ASCII signs (Java's own takes all letters).
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def doc_types(spark: SparkSession) -> DataFrame:
    """The types as a small dimension table."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(DOC_TYPES)], "place int, id string, hints array<string>, validators array<string>, key array<string>, compare array<string>")


def latest_types(types: DataFrame, extra: DataFrame) -> DataFrame:
    """Types of two folders; a later row replaces an earlier one of the same id."""
    both = types.withColumn("_load", F.lit(0)).unionByName(extra.withColumn("_load", F.lit(1)))
    cols = [c for c in types.columns if c != "id"]
    return both.groupBy("id").agg(F.max_by(F.struct(*cols), "_load").alias("r")).select("id", "r.*").select(*types.columns)


def hint_scores(docs: DataFrame, types: list[tuple], id_col: str = "doc_id", text: str = "text", size: int = 6000) -> DataFrame:
    """(id, type, place, score > 0): 1 for each hint in the head of the text, 2 for each pattern (between slashes).

    The hints are literals of the plan, so documents are read once and never multiplied by hints.
    """
    sample = F.lower(F.substring(F.col(text), 1, size))
    scores = []
    for place, (name, hints, *_) in enumerate(types):
        total = F.lit(0)
        for h in (h.lower() for h in hints):
            pattern = h.startswith("/") and h.rfind("/") > 0
            hit = F.regexp_like(sample, F.lit("(?i)" + h[1 : h.rfind("/")].replace(r"\b", WORD_EDGE))) if pattern else F.contains(sample, F.lit(h))
            total = total + F.when(hit, 2 if pattern else 1).otherwise(0)
        scores.append(F.struct(F.lit(name).alias("type"), F.lit(place).alias("place"), total.alias("score")))
    all_ = docs.select(F.col(id_col).alias("id"), F.inline(F.array(*scores)))
    return all_.where("score > 0")


def classify(scores: DataFrame) -> DataFrame:
    """(id, type, score, second, sure): the best type of each document; sure if alone or at least two ahead."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "place", "type")))
    top = scores.groupBy("id").agg(best.alias("t"))  # at most one entry per type
    second = F.coalesce(-F.try_element_at("t", F.lit(2))["neg"], F.lit(0))
    out = top.select("id", F.col("t")[0]["type"].alias("type"), (-F.col("t")[0]["neg"]).alias("score"), second.alias("second"), F.size("t").alias("_n"))
    return out.withColumn("sure", (F.col("_n") == 1) | (F.col("score") >= F.col("second") + 2)).drop("_n")


def loose_column(columns: list[str], want: str) -> str | None:
    """The column of that name, else the first whose name differs only in case, accents or punctuation."""
    return want if want in columns else next((c for c in columns if normalize_name(c) == normalize_name(want)), None)


def _key(df: DataFrame, key: list[str]) -> Column:
    parts = []
    for k in key:
        c = loose_column(df.columns, k)
        parts.append(normalize_value(F.col(f"`{c}`")) if c else F.lit(""))
    return F.concat_ws("|", *parts)


def crosscheck(documents: DataFrame, table: DataFrame, key: list[str], compare: list[str], id_col: str = "id", order: Column | None = None) -> DataFrame:
    """(key, id, status, differences): documents against a table on a normalised key.

    status: matched, different, missing_in_table (documents), missing_in_documents (table rows).  Of table rows with one key the
    last by ``order`` counts.  Missing key parts are empty and match each other.  One shuffle of either side.
    """
    value = lambda df, c: normalize_value(F.col(f"`{n}`")) if (n := loose_column(df.columns, c)) else F.lit("")
    d = documents.select(_key(documents, key).alias("_k"), F.col(id_col).alias("id"), F.lit(True).alias("_d"), *[value(documents, c).alias(f"_d{i}") for i, c in enumerate(compare)])
    t = table.select(_key(table, key).alias("_tk"), (order if order is not None else F.lit(0)).alias("_o"), F.struct(*[value(table, c).alias(f"_t{i}") for i, c in enumerate(compare)]).alias("_row"))
    t = t.groupBy("_tk").agg(F.max_by("_row", F.struct("_o", "_row")).alias("_row")).select("_tk", "_row.*")
    j = d.join(t, F.col("_k") == F.col("_tk"), "full_outer")
    diffs = F.filter(F.array(*[F.when(F.col(f"_d{i}") != F.col(f"_t{i}"), F.struct(F.lit(c).alias("column"), F.col(f"_d{i}").alias("document"), F.col(f"_t{i}").alias("table"))) for i, c in enumerate(compare)]), lambda x: x.isNotNull())
    status = F.when(F.col("_d").isNull(), "missing_in_documents").when(F.col("_tk").isNull(), "missing_in_table").when(F.size(diffs) > 0, "different").otherwise("matched")
    both = F.col("_d").isNotNull() & F.col("_tk").isNotNull()
    return j.select(F.coalesce("_k", "_tk").alias("key"), "id", status.alias("status"), F.when(both, diffs).alias("differences"))


def crosscheck_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("matched", "different", "missing_in_table", "missing_in_documents")])


def dedup_by_content(docs: DataFrame, id_col: str = "doc_id", content: str = "text") -> DataFrame:
    """(digest, id, copies): the first registered row of each content.  Digests are shuffled, not contents."""
    hashed = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(content).cast("binary"), 256).alias("digest"))
    return hashed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def new_memories(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of 3 to 400 signs that aren't remembered yet, once each."""
    good = found.withColumn("text", F.trim("text")).where(F.length("text").between(3, 400)).dropDuplicates(["text"])
    return good.join(existing.select("text"), "text", "left_anti").select(*found.columns)


def memory_markdown(memory: DataFrame, by: str = "project_id") -> DataFrame:
    """(by, markdown): remembered lines under a heading per kind; pinned and new ones first."""
    kinds = (("user", "Anotado por você"), ("fact", "Fatos"), ("glossary", "Glossário"), ("summary", "Resumos"))
    order = F.struct((~F.col("pinned")).alias("a"), (-F.unix_micros("created_at")).alias("b"), "text")
    g = memory.groupBy(by, "kind").agg(F.array_sort(F.collect_list(order)).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    title = F.create_map(*[F.lit(x) for k in kinds for x in k])
    place = F.create_map(*[F.lit(x) for i, k in enumerate(kinds) for x in (k[0], i)])
    s = g.where(F.col("kind").isin(*[k[0] for k in kinds])).select(by, place[F.col("kind")].alias("p"), F.concat(F.lit("## "), title[F.col("kind")], F.lit("\n\n"), body).alias("s"))
    return s.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "s"))), lambda x: x["s"]), "\n\n").alias("markdown"))


def _all(table: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in table.columns]


def replace_rows(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of the keys in ``new`` are replaced by its rows, in one plan, so readers see the old or the new."""
    return table.join(new.select(key).distinct(), key, "left_anti").select(*_all(table)).unionByName(new.select(*_all(table)))


def delete_cascade(keys: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    return [t.join(keys.select(key).distinct(), key, "left_anti").select(*_all(t)) for t in tables]


def partial_update(table: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Columns of the patch replace values where they are not null; other values stay."""
    cols = [c for c in patch.columns if c != key]
    p = patch.select(key, *[F.col(f"`{c}`").alias(f"_patch{i}") for i, c in enumerate(cols)])
    return table.join(p, key, "left").select(*[F.coalesce(f"_patch{cols.index(c)}", F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in table.columns])


def upsert_meta(table: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in table.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "_new").alias("r")).select(key, "r.*").select(*_all(table))


def unique_names(files: DataFrame, name: str = "name", order: str = "id") -> DataFrame:
    """Equal names get `` (2)``, `` (3)`` before their extension, in order."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return files.withColumn("_n", n).withColumn("unique_name", F.when(F.col("_n") == 1, F.col(name)).otherwise(F.concat(stem, F.lit(" ("), F.col("_n").cast("string"), F.lit(")"), ext))).drop("_n")


def prune(fields: Column) -> Column:
    """A map without null and empty values."""
    return F.map_filter(fields, lambda _, v: v.isNotNull() & (v != ""))


def citations(answers: DataFrame, hits: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """(id, place, n, ...): hits that an answer cites as [n], in order of first use; the first three if it cites none.

    ``hits`` has the id, n (from 1) and columns to show.
    """
    size = hits.groupBy(F.col(id_col).alias("_h")).agg(F.max("n").alias("_size"))
    a = answers.join(size, F.col(id_col) == F.col("_h"))
    used = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\[([0-9]{1,2})\]")), lambda x: x.cast("int"))
    good = F.array_distinct(F.filter(used, lambda n: (n >= 1) & (n <= F.col("_size"))))
    list_ = F.when(F.size(good) > 0, good).otherwise(F.sequence(F.lit(1), F.least(F.lit(3), F.col("_size"))))
    return a.select(id_col, F.posexplode(list_).alias("place", "n")).join(hits, [id_col, "n"])
