"""Operator 9: chat formatting.  Schema fingerprints choose declarative mappings to canonical turns.

Native: DataFrame functions only.  A layout is described by the sorted paths of its nested fields
(``messages[].role`` and so on); the hash of these paths picks a mapping, and the mapping is a SQL
expression that yields ``array<struct<role, text>>``.  For tables the paths come from the schema
(no data is read); for columns of JSON records they come from each record and each message, so one table may mix layouts.

Canonical turns are rendered with a template that marks turns and escapes control characters inside texts:
backslash, hash, less-than and (in roles) colon become two-character codes, so no text can contain
a turn header or terminator, and decoding is exact.
"""

from __future__ import annotations

from collections.abc import Iterable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: Character and its code, in the order of encoding.
CODES = (("\\", "\\\\"), ("#", "\\h"), ("<", "\\l"))
ROLE_CODES = (*CODES, (":", "\\c"))


def escape(text: Column, codes: tuple = CODES) -> Column:
    out = F.coalesce(text, F.lit(""))
    for plain, code in codes:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, codes: tuple = CODES) -> Column:
    """Split at encoded backslashes, decode the other codes in each piece, join with a backslash."""

    def piece(p: Column) -> Column:
        for plain, code in codes[1:]:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix + "[]")
    return [prefix]


def fingerprint(paths: Column) -> Column:
    """Hash of an array of field paths, whatever their order."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fingerprint_of(paths: Iterable[str]) -> int:
    """The same number for paths known before any data is read (Spark's hash is XXH64 with seed 42)."""
    h = xxhash.xxh64_intdigest("\n".join(sorted(set(paths))), 42)
    return h - (1 << 64) if h >> 63 else h


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', cast({role} as string), 'text', cast({text} as string))"


#: Fields of one message -> its turn; {m} stands for the message.
MESSAGES: dict[tuple[str, ...], str] = {
    ("role", "text"): _turn("{m}.role", "{m}.text"),
    ("content", "role"): _turn("{m}.role", "{m}.content"),
    ("from", "value"): _turn("case {m}.`from` when 'human' then 'user' when 'gpt' then 'assistant' else {m}.`from` end", "{m}.value"),
}
#: Fields that hold a list of messages.
LISTS = ("messages", "conversations")
#: Field paths of a layout -> SQL for its turns; {r} stands for the record.  Of several that a table has, the first counts.
MAPPINGS: dict[tuple[str, ...], str] = {
    **{m: f"array({sql.replace('{m}', '{r}')})" for m, sql in MESSAGES.items()},
    **{tuple(f"{f}[].{p}" for p in m): f"transform({{r}}.{f}, m -> {sql.replace('{m}', 'm')})" for f in LISTS for m, sql in MESSAGES.items()},
    ("completion", "prompt"): f"array({_turn("'user'", '{r}.prompt')}, {_turn("'assistant'", '{r}.completion')})",
    ("prompt", "response"): f"array({_turn("'user'", '{r}.prompt')}, {_turn("'assistant'", '{r}.response')})",
    ("input", "instruction", "output"): f"array({_turn("'user'", "concat_ws('\n\n', {r}.instruction, nullif({r}.input, ''))")}, {_turn("'assistant'", '{r}.output')})",
    ("instruction", "output"): f"array({_turn("'user'", '{r}.instruction')}, {_turn("'assistant'", '{r}.output')})",
    ("answer", "question"): f"array({_turn("'user'", '{r}.question')}, {_turn("'assistant'", '{r}.answer')})",
}
_TURNS = "array<struct<role:string,text:string>>"


def layout_of(schema: T.StructType, mappings: dict[tuple[str, ...], str] = MAPPINGS) -> tuple[int, tuple[str, ...]] | None:
    """Fingerprint and field paths of the layout of a schema; paths that no layout knows stay out of the hash.

    If the known paths together are no layout (extra columns named like another's fields), the first layout among them counts.
    """
    by_print = {fingerprint_of(p): p for p in mappings}
    known = {p for m in mappings for p in m}
    have = [p for p in field_paths(schema) if p in known]
    tries = [have, *(p for p in mappings if set(p) <= set(have))]
    return next(((h, by_print[h]) for h in map(fingerprint_of, tries) if h in by_print), None)


def canonical_turns(df: DataFrame, mappings: dict[tuple[str, ...], str] = MAPPINGS, keep: list[str] | None = None) -> DataFrame:
    """Add ``turns`` to a table whose schema follows one of the layouts (a column of that name is replaced); ``keep`` names the columns to keep."""
    found = layout_of(df.schema, mappings)
    if found is None:
        raise ValueError(f"no mapping for fields {field_paths(df.schema)}")
    fields = sorted({p.split("[]")[0] for p in found[1]})
    record = F.struct(*[F.col(f"`{c}`") for c in fields])
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c != "turns"]
    out = df.select(*kept, record.alias("_chat_record"))
    return out.withColumn("turns", F.expr(mappings[found[1]].replace("{r}", "_chat_record"))).drop("_chat_record")


def _prefixed(prefix: str):
    return lambda k: F.concat(F.lit(prefix), k)


def _known(names: set[str]):
    return lambda k: k.isin(*sorted(names))


def canonical_turns_json(df: DataFrame, column: str = "record") -> DataFrame:
    """Add ``layout`` (fingerprint) and ``turns`` to a table of JSON records in mixed layouts.

    A record's fingerprint is of its known top-level fields, and each message of a list has a fingerprint of its own, so messages of one
    list may differ in their fields.  Records that are null, malformed, of an unknown layout or with a message of an unknown one
    get null turns; other fields are ignored.
    """
    flat = {p: sql for p, sql in MAPPINGS.items() if not any("[]" in x for x in p)}
    plain = sorted({x for p in flat for x in p})
    ddl = ", ".join([*(f"`{x}` string" for x in plain), *(f"{x} array<map<string,string>>" for x in LISTS)])
    none = F.array().cast("array<string>")
    keys = F.filter(F.coalesce(F.expr(f"json_object_keys(`{column}`)"), none), _known({*plain, *LISTS}))
    out = df.withColumn("layout", fingerprint(keys)).withColumn("_rec", F.from_json(F.col(f"`{column}`"), ddl))

    def message(m: Column) -> Column:
        mark = fingerprint(F.filter(F.map_keys(m), _known({x for p in MESSAGES for x in p})))
        turn = F.lit(None).cast(_TURNS[6:-1])
        for p in MESSAGES:
            role, text = ("from", "value") if "from" in p else ("role", next(x for x in p if x != "role"))
            said = F.when(m[role] == "human", "user").when(m[role] == "gpt", "assistant").otherwise(m[role]) if role == "from" else m[role]
            turn = F.when(mark == fingerprint_of(p), F.struct(said.alias("role"), m[text].alias("text"))).otherwise(turn)
        return turn

    turns = F.lit(None).cast(_TURNS)
    for p, sql in flat.items():
        turns = F.when(F.col("layout") == fingerprint_of(p), F.expr(sql.replace("{r}", "_rec"))).otherwise(turns)
    for name in LISTS:
        said = F.transform(F.col(f"_rec.{name}"), message)
        turns = F.when(F.col("layout") == fingerprint_of([name]), F.when(~F.exists(said, lambda t: t.isNull()), said)).otherwise(turns)
    return out.withColumn("turns", turns).drop("_rec")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role, ROLE_CODES), F.lit(MID), escape(text), F.lit(TAIL))


def read_back(formatted: Column) -> Column:
    """Formatted conversation -> array<struct<role, text>>, exactly as rendered."""
    pieces = F.filter(F.split(formatted, TAIL), lambda p: p != "")

    def one(p: Column) -> Column:
        head = F.substring_index(p, MID, 1)
        body = F.substring(p, F.length(head) + 1 + len(MID), F.length(p))
        role = unescape(F.substring(head, 1 + len(HEAD), F.length(head)), ROLE_CODES)
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def format_conversations(df: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Rows of any known layout -> one formatted conversation each.

    Turns are ordered by ``order``, ties by rendered text; null text is empty, null role an empty role, null
    order first.  Repeated rows are repeated turns.  No rows, no conversations; extra columns are ignored.
    Returns (conv, formatted, turns), the turns read back from the formatted text.
    """
    turns = canonical_turns(df, keep=[conv, order])
    lines = turns.select(conv, order, F.array_join(F.transform("turns", lambda t: render_turn(t["role"], t["text"])), "").alias("line"))
    whole = lines.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("lines"))
    whole = whole.select(conv, F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("formatted"))
    return whole.withColumn("turns", read_back(F.col("formatted")))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text"))
    f = format_conversations(c.unionAll(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    f = f.withColumn("loss", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""))
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, 4 + length(role) + 2 + length(text) + 8
            + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUERIES = {"op9_chat_format": op9_chat_format}
ORACLE = {"op9_chat_format": OP9_SQL}
