"""File sources: listing, detection by bytes, decoding, delimited text, office packages, mail, model headers.

Files are rows of Spark's ``binaryFile`` source; detection and decoding are Column expressions.  Packages and mail are opened
inside tasks by small helpers, one file at a time; a file that can't be read gives a row with an error, never a failed task.
"""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.text import html_to_markdown, looks_tabular, markdown_table


def read_files(spark: SparkSession, path: str, name: str | None = None, recursive: bool = False) -> DataFrame:
    """path, name, ext, modified, size, content; ``name`` is a pattern for file names, whatever their case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    base = F.substring_index("path", "/", -1)
    f = f.select("path", F.try_url_decode(base).alias("name"), F.lower(F.regexp_extract(base, r"\.([^.]+)$", 1)).alias("ext"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")
    return f.where(F.regexp_like("name", F.lit(f"(?i){name}"))) if name else f


def decode_text(content: Column) -> Column:
    """UTF-8 without its mark where valid, else Latin-1."""
    s = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(s, "^﻿", "")


def file_kind(content: Column, ext: Column, compat: bool = False) -> Column:
    """Kind of a file from its first bytes, then its text, then its name.

    ``compat`` keeps two oddities: a UTF-16 mark reads as audio, and WEBP in RIFF as video.
    """
    head = F.hex(F.substring(content, 1, 16))
    starts = lambda *x: F.regexp_like(head, F.lit("^(" + "|".join(x) + ")"))
    text = decode_text(F.substring(content, 1, 8192))
    riff = F.when(F.substring(head, 17, 8) == "57415645", "audio")
    riff = riff.otherwise("video") if compat else riff.when(F.substring(head, 17, 8) == "57454250", "image").otherwise("video")
    names = F.decode(content, "ISO-8859-1")
    zipped = F.when(F.contains(names, F.lit("word/document.xml")), "docx").when(F.contains(names, F.lit("xl/workbook.xml")) | F.contains(names, F.lit("xl/worksheets/")), "xlsx").when(F.regexp_like(names, F.lit(r"ppt/slides/slide\d+\.xml")), "pptx").otherwise("archive")
    sync = starts("FF[EF]") if compat else starts("FF[EF]") & ~starts("FFFE")
    kind = F.when(starts("255044462D"), "pdf").when(starts("504B"), zipped).when(starts("494433") | sync, "audio").when(starts("52494646"), riff)
    kind = kind.when(starts("4F676753", "664C6143"), "audio").when(F.substring(head, 9, 8) == "66747970", F.when(ext.isin("m4a", "m4b", "aac"), "audio").otherwise("video"))
    kind = kind.when(starts("1A45DFA3"), "video").when(starts("89504E470D0A1A0A", "FFD8", "47494638", "424D", "49492A00"), "image").when(ext.isin("tif", "tiff", "webp"), "image")
    mail = F.regexp_like(F.substring(text, 1, 2000), F.lit(r"(?im)^\s*(from|to|subject|date|received|message-id|mime-version)\s*:")) & F.regexp_like(text, F.lit(r"\n\s*\n"))
    html = F.regexp_like(F.substring(text, 1, 4000), F.lit(r"(?i)<html|<!doctype html|<body|<div|<p>"))
    kind = kind.when(mail, "eml").when(html, "html").when(ext.isin("csv", "tsv") | looks_tabular(text), "csv").when(ext.isin("eml", "mbox"), "eml")
    return kind.when(F.trim(text) != "", "text").otherwise("unknown")


def model_format(content: Column) -> Column:
    """Format of a model file from its first bytes."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    starts = lambda x: F.startswith(head, F.lit(x))
    size = F.conv(F.concat(*[F.substring(head, i, 2) for i in range(15, 0, -2)]), 16, 10).cast("decimal(20,0)")
    kind = F.when(F.length(content) < 4, "unknown").when(starts("47475546"), "gguf").when(starts("6C6D6767") | starts("67676D6C"), "ggml").when(F.regexp_like(head, F.lit("^504B0[35]")), "zip")
    kind = kind.when((F.length(content) >= 9) & (size > 0) & (size < 512 << 20) & (F.substring(head, 17, 2) == "7B"), "safetensors")
    return kind.when(F.regexp_like(text, F.lit(r"^(<!doctype|<html|<\?xml)|<head>")), "html").when(F.regexp_like(text, F.lit(r"^[{\[]")), "json").when(starts("08") & (F.regexp_like(F.substring(text, 1, 64), F.lit("onnx|pytorch")) | (F.substring(head, 5, 2) == "12")), "onnx").otherwise("bin")


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited table: trimmed headers and values, missing cells empty, blank rows dropped."""
    t = spark.read.csv(path, header=True, sep=sep, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    t = t.select(*[F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip()) for c in t.columns])
    return t.where(F.concat(*[F.col(f"`{c}`") for c in t.columns]) != "")


def delimited_rows(text: Column, sep: Column) -> Column:
    """Rows of cells of unquoted delimited text; carriage returns and blank rows go."""
    quoted = F.concat(F.lit(r"\Q"), sep, F.lit(r"\E"))
    lines = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(F.replace(x, sep, F.lit(""))) != "")
    return F.transform(lines, lambda x: F.split(x, quoted, F.lit(-1)))


def delimited_markdown(text: Column, sep: Column) -> Column:
    return markdown_table(delimited_rows(text, sep))


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ElementTree.Element, name: str) -> str:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


def _said(e: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in e.iter() if _name(x) == "t")


def _docx(z: zipfile.ZipFile) -> list[tuple[str, list]]:
    body = next(e for e in ElementTree.fromstring(z.read("word/document.xml")) if _name(e) == "body")
    out: list[tuple[str, list]] = []
    for e in body:
        if _name(e) == "tbl":
            out.append(("table", [[_said(c) for c in r if _name(c) == "tc"] for r in e if _name(r) == "tr"]))
        elif _name(e) == "p" and (text := _said(e).strip()):
            style = next((_attr(s, "val") for s in e.iter() if _name(s) == "pStyle"), "")
            level = re.search(r"(?:heading|t[ií]tulo)\s*(\d)?", style, re.IGNORECASE)
            mark = "#" * int(level[1] or 1) + " " if level else "- " if "ListParagraph" in style else ""
            out.append(("text", [mark + text]))
    return out


def _xlsx(z: zipfile.ZipFile) -> list[tuple[str, list]]:
    names = z.namelist()
    shared = [_said(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [_attr(e, "name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _name(e) == "sheet"] if "xl/workbook.xml" in names else []
    out: list[tuple[str, list]] = []
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)), key=lambda n: (len(n), n))
    for i, sheet in enumerate(sheets):
        rows = []
        for r in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if _name(e) == "row"):
            cells: dict[int, str] = {}
            for c in r:
                at = 0
                for letter in re.sub("[^A-Z]", "", _attr(c, "r")):
                    at = at * 26 + ord(letter) - 64
                v = next((x.text or "" for x in c if _name(x) == "v"), "")
                cells[at - 1 if at else len(cells)] = shared[int(v)] if _attr(c, "t") == "s" and v else _said(c) if _attr(c, "t") == "inlineStr" else v
            if any(cells.values()):
                rows.append([cells.get(k, "") for k in range(max(k for k, v in cells.items() if v) + 1)])
        out += [("text", [f"## {titles[i] if i < len(titles) else sheet}"]), ("table", rows)]
    return out


def _pptx(z: zipfile.ZipFile) -> list[tuple[str, list]]:
    out: list[tuple[str, list]] = []
    number = lambda n: int(re.search(r"\d+", n.rsplit("/", 1)[-1])[0])
    for name in sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number):
        lines = [s for e in ElementTree.fromstring(z.read(name)).iter() if _name(e) == "p" and (s := _said(e).strip())]
        out.append(("text", [f"## Slide {number(name)}", *lines[:1], *[f"- {x}" for x in lines[1:]]]))
    return out


def _eml(content: bytes) -> list[tuple[str, list]]:
    m = email.message_from_bytes(content, policy=email.policy.default)
    body = m.get_body(("plain", "html"))
    head = [f"**{k}:** {m[k]}" for k in ("From", "To", "Date") if m[k]]
    files = [a.get_filename() or "" for a in m.iter_attachments()]
    text = body.get_content().strip() if body else ""
    kind = "html" if body is not None and body.get_content_subtype() == "html" else "text"
    return [("text", [f"# {m['Subject'] or ''}".strip(), *head]), (kind, [text]), *([("text", [f"Anexos: {', '.join(files)}"])] if files else [])]


def package_parts(files: DataFrame) -> DataFrame:
    """(path, kind, content) of DOCX, XLSX, PPTX and mail -> path, part, type (text, html, table), lines, cells, error: parts in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}
        for b in batches:
            for path, kind, content in zip(b["path"], b["kind"], b["content"], strict=True):
                try:
                    found, error = (_eml(content) if kind == "eml" else readers[kind](zipfile.ZipFile(io.BytesIO(content)))), None
                except Exception as e:  # noqa: BLE001 - one bad file is a row, not a failed task
                    found, error = [("text", [])], f"{type(e).__name__}: {e}"
                yield pd.DataFrame([(path, i, t, None if t == "table" else x, x if t == "table" else None, error) for i, (t, x) in enumerate(found)], columns=["path", "part", "type", "lines", "cells", "error"])

    wanted = files.where(F.col("kind").isin("docx", "xlsx", "pptx", "eml")).select("path", "kind", "content")
    return wanted.mapInPandas(run, "path string, part int, type string, lines array<string>, cells array<array<string>>, error string")


def extract(files: DataFrame) -> DataFrame:
    """(path, ext, content) -> path, kind, markdown, needs_ocr, needs_transcription, error.

    Text, HTML and delimited files stay in Columns; packages go through ``package_parts`` and their tables and HTML come back to
    Columns.  PDF and images wait for OCR, sound for transcription; both are injected elsewhere.
    """
    from docengine.functions.text import guess_delimiter

    f = files.withColumn("kind", file_kind(F.col("content"), F.col("ext")))
    text = decode_text(F.col("content"))
    plain = F.when(F.col("kind") == "html", html_to_markdown(text)).when(F.col("kind") == "csv", delimited_markdown(text, guess_delimiter(text))).when(F.col("kind") == "text", F.trim(text))
    p = package_parts(f)
    body = F.when(F.col("type") == "table", markdown_table(F.col("cells"))).when(F.col("type") == "html", html_to_markdown(F.array_join("lines", "\n"))).otherwise(F.array_join("lines", "\n"))
    p = p.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", body.alias("b")))), lambda x: x["b"]), "\n\n").alias("_markdown"), F.first("error").alias("error"))
    out = f.join(p, "path", "left")
    return out.select("path", "kind", F.coalesce(plain, F.trim("_markdown")).alias("markdown"), F.col("kind").isin("pdf", "image").alias("needs_ocr"), F.col("kind").isin("audio", "video").alias("needs_transcription"), "error")
