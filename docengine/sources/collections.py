"""Folders of small JSON and YAML files: collections, document types, field sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None

FIELD_TYPES = {"string": T.StringType(), "number": T.DoubleType(), "integer": T.LongType(), "boolean": T.BooleanType()}


def json_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per readable JSON file of a folder, with its ``id`` (the name); files that can't be parsed are skipped."""
    s = T.StructType.fromDDL(schema).add("_broken", T.StringType())
    rows = spark.read.schema(s).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return rows.withColumn("id", name).where("_broken is null").drop("_broken")


def _parsed(name: str, content: bytes) -> list[dict]:
    """The types in a file: a list, a ``doctypes`` list or one type; none if it can't be read."""
    try:
        text = content.decode("utf-8")
        data = json.loads(text) if name.endswith(".json") else yaml.safe_load(text) if yaml else None
    except Exception:  # noqa: BLE001 - a broken file must not hide the others
        return []
    found = data if isinstance(data, list) else data.get("doctypes", [data]) if isinstance(data, dict) else []
    return [d for d in found or [] if isinstance(d, dict) and d.get("id")]


def type_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, name, hints, validators, key, compare, schema): document types of several folders of YAML or JSON files; later files replace earlier ones.

    ``schema`` is the type's JSON schema as text.  A dimension of a few files: they are read by the driver.
    """
    rows: dict[str, tuple] = {}
    for path in paths:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{yaml,yml,json}").load(path).select("path", "content").orderBy("path").collect()
        for f in files:
            for d in _parsed(f.path, bytes(f.content)):
                check = d.get("crossCheck") or {}
                rows[d["id"]] = (d["id"], d.get("name"), d.get("hints") or [], d.get("validators") or [], check.get("key") or [], check.get("compare") or [], json.dumps(d.get("schema") or {}, ensure_ascii=False))
    return spark.createDataFrame(list(rows.values()), "id string, name string, hints array<string>, validators array<string>, key array<string>, compare array<string>, schema string")


def field_schema(schema: str | dict) -> T.DataType:
    """A JSON schema as a Spark type: what fields a model is asked for, and how its answer is read."""
    s = json.loads(schema) if isinstance(schema, str) else schema
    kind = s.get("type", "object" if "properties" in s else "string")
    if kind == "object":
        needed = set(s.get("required", ()))
        return T.StructType([T.StructField(k, field_schema(v), k not in needed, {"comment": v["description"]} if v.get("description") else None) for k, v in s.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(field_schema(s.get("items", {})))
    return FIELD_TYPES.get(kind, T.StringType())


def read_fields(answers: DataFrame, schema: str | dict, answer: str = "answer") -> DataFrame:
    """Add ``fields`` read from a model's JSON by the schema, and ``missing``: the required fields without a value."""
    t = field_schema(schema)
    out = answers.withColumn("fields", F.from_json(F.col(answer), t))
    missing = [F.when(F.col(f"fields.`{f.name}`").isNull(), F.lit(f.name)) for f in t.fields if not f.nullable]
    return out.withColumn("missing", F.filter(F.array(*missing), lambda x: x.isNotNull()) if missing else F.array().cast("array<string>"))
