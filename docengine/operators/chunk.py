"""Structure-aware chunks of Markdown and packing of sentences for speech.

Both carry state along a text, so they are Arrow-batched pandas UDFs that return arrays; rows stay where they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHUNK = "ordinal int, text string, page int, heading string, tokens int"
PAGE = re.compile(r"<!--\s*página\s+(\d+)\s*-->", re.IGNORECASE)
HEADING = re.compile(r"#{1,6}\s")


def _estimate(text: str) -> int:
    return max(1, math.ceil(len(text.encode("utf-16-le")) / 8))


def blocks(markdown: str) -> list[tuple[str, str]]:
    """(kind, block) with kind page, heading, table or text."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    kind = "text"

    def close() -> None:
        if whole := "\n".join(held).strip():
            out.append((kind, whole))
        held.clear()

    for line in re.split(r"\r?\n", markdown):
        bare = line.strip()
        if not bare:
            if kind == "table":
                held.append(line)
            else:
                close()
        elif HEADING.match(line) or re.match(r"<!--\s*página", line, re.IGNORECASE):
            close()
            out.append(("page" if PAGE.fullmatch(bare) else "heading" if HEADING.match(bare) else "text", bare))
            kind = "text"
        else:
            now = "table" if bare.startswith("|") else "text"
            if now != kind:
                close()
                kind = now
            held.append(line)
    close()
    return out


def sentence_pieces(block: str, limit: int, lossless: bool) -> list[str]:
    pattern = r"[^.!?\n]+(?:[.!?]+|\n+|$)|[.!?\n]+" if lossless else r"[^.!?\n]+[.!?]+|\S[^.!?\n]*\Z"
    out, now = [], ""
    for s in re.findall(pattern, block) or [block]:
        if now and _estimate(now + s) > limit:
            out.append(now.strip())
            now = ""
        now += s
    return [p for p in [*out, now.strip()] if p]


def chunks_of(markdown: str, limit: int = 400, overlap: int = 60, lossless: bool = True, page: int | None = None) -> list[tuple[int, str, int | None, str | None, int]]:
    """Chunks of one text.  Headings start a chunk and are repeated, tables stay whole, the tail of a full chunk is repeated.

    ``lossless`` keeps lines that end without a stop when a long block is cut; without it they are lost, as in the model pipeline
    that this engine mirrors.
    """
    overlap = min(overlap, limit // 2)
    out: list[tuple[int, str, int | None, str | None, int]] = []
    heading: str | None = None
    buffer: list[tuple[str, int]] = []

    def flush() -> None:
        text = "\n\n".join(b for b, _ in buffer).strip()
        size = sum(n for _, n in buffer)
        buffer.clear()
        if text:
            out.append((len(out), f"{heading}\n\n{text}" if heading and not text.startswith("#") else text, page, heading, size))

    for kind, block in blocks(markdown):
        size = _estimate(block)
        if kind == "page":
            flush()
            page = int(PAGE.fullmatch(block)[1])
        elif kind == "heading":
            flush()
            heading = re.sub(r"^#+\s*", "", block).strip()
            buffer.append((block, size))
        else:
            if buffer and sum(n for _, n in buffer) + size > limit:
                words = re.split(r"\s+", "\n\n".join(b for b, _ in buffer))
                take = int(overlap * 0.75 + 0.5) if kind != "table" else 0
                flush()
                if take and (tail := " ".join(words[max(0, len(words) - take) :])):
                    buffer.append((tail, _estimate(tail)))
            if size > limit and kind != "table":
                for piece in sentence_pieces(block, limit, lossless):
                    buffer.append((piece, _estimate(piece)))
                    flush()
            else:
                buffer.append((block, size))
    flush()
    return out


def chunk_markdown(docs: DataFrame, text: str = "text", limit: int = 400, overlap: int = 60, lossless: bool = True) -> DataFrame:
    """One row per chunk: the other columns, then ordinal, text, page, heading, tokens.  Null texts have no chunks."""

    rest = [c for c in docs.columns if c != text]
    own = T.StructType.fromDDL(CHUNK)
    schema = T.StructType([*docs.select(*[F.col(f"`{c}`") for c in rest]).schema.fields, *own.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *c) for i, t in enumerate(b.column(len(rest)).to_pylist()) if t for c in chunks_of(t, limit, overlap, lossless)]
            row = pa.array([f[0] for f in found], pa.int64())
            kept = [b.column(k).take(row) for k in range(len(rest))]
            cols = [pa.array([f[k + 1] for f in found], to_arrow_type(field.dataType)) for k, field in enumerate(own.fields)]
            yield pa.RecordBatch.from_arrays([*kept, *cols], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`")).mapInArrow(run, schema)


def speech_parts(text: str, limit: int = 600) -> list[str]:
    """Sentences packed to at most ``limit`` signs; longer ones are wrapped at words, a longer word stays whole."""
    clean = re.sub(r"\s+", " ", text).strip()
    if len(clean) <= limit:
        return [clean]
    out: list[str] = []

    def pack(units: list[str], now: str) -> str:
        for u in units:
            if now and len(now) + 1 + len(u) > limit:
                out.append(now)
                now = u
            else:
                now = f"{now} {u}" if now else u
        return now

    now = ""
    for s in (s.strip() for s in re.findall(r"[^.!?…]+[.!?…]+[\"'”’)]*\s*|[^.!?…]+$", clean) or [clean]):
        if not s:
            continue
        if len(s) > limit:
            if now:
                out.append(now)
            if rest := pack(s.split(" "), ""):
                out.append(rest)
            now = ""
        else:
            now = pack([s], now)
    return [*out, now] if now else out


def split_for_speech(docs: DataFrame, text: str = "text", limit: int = 600) -> DataFrame:
    """One row per part: the other columns, part number and text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: speech_parts(t or "", limit))

    rest = [c for c in docs.columns if c != text]
    return docs.withColumn("_parts", run(F.col(text))).select(*rest, F.posexplode("_parts").alias("part", "text"))
