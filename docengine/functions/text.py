"""Text functions as Column expressions: folding, tokens, snippets, slugs, HTML, references, clocks.

Nothing here runs Python per row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_table() -> tuple[str, str]:
    """Latin letters with diacritics and their base letters, by canonical decomposition."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


_MARKED, _PLAIN = _fold_table()


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def fold(text: Column) -> Column:
    """Small letters without diacritics; plain ASCII, most text, only changes case."""
    full = F.lower(F.translate(F.regexp_replace(text, r"\p{M}+", ""), _MARKED, _PLAIN))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(full)


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; null text has none."""
    return F.filter(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(query: str) -> list[list[str]]:
    """A query's phrases: words of more than one sign, each a list of index tokens (``_`` joins words, not tokens)."""
    words = [w for w in re.split(r"[^\w]+", unicodedata.normalize("NFC", query.lower())) if len(w) > 1]
    out = []
    for w in words:
        plain = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))
        if parts := [t for t in re.split(r"[\W_]+", plain) if t]:
            out.append(parts)
    return out


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the UTF-16 length, rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(utf16_length(text) / 4)).cast("int")


def last_words(text: Column, n_tokens: int) -> Column:
    """The last three quarters of ``n_tokens`` in words."""
    words = F.split(text, r"\s+")
    n = int(n_tokens * 0.75 + 0.5)
    return F.array_join(F.slice(words, F.greatest(F.size(words) - n + 1, F.lit(1)), F.greatest(F.lit(n), F.lit(1))), " ") if n else F.lit("")


def snippet(text: Column, query: str, size: int = 320) -> Column:
    """A window around the first query term, in query order, that occurs; short texts whole."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    low = F.lower(flat)
    at = F.lit(0)
    for t in reversed([t for t in re.split(r"[^0-9A-Za-z_]+", query.lower()) if len(t) > 2]):
        here = F.locate(t, low)
        at = F.when(here > 0, here).otherwise(at)
    start = F.greatest(at - 1 - size // 3, F.lit(0))
    window = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, F.lit(size)), F.lit("…"))
    return F.when(F.length(flat) <= size, flat).when(at == 0, F.concat(F.substring(flat, 1, size), F.lit("…"))).otherwise(window)


def slugify(text: Column, size: int = 48, keep: str = "", fallback: str = "project") -> Column:
    dashed = F.regexp_replace(fold(text), f"[^a-z0-9{keep}]+", "-")
    cut = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, size)
    return F.when(F.coalesce(cut, F.lit("")) == "", fallback).otherwise(cut)


def normalize_key(name: Column) -> Column:
    return F.regexp_replace(fold(name), "[^a-z0-9]", "")


def normalize_name(name: str) -> str:
    """The same for a column name on the driver."""
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return re.sub("[^a-z0-9]", "", plain.lower())


def replace_matches(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """Replace every match by an expression of it, in one pass."""
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.array_join(F.zip_with(between, found, lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(new(b)))), "")


#: Named entities and their characters.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "hellip": "…", "laquo": "«", "raquo": "»", "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "atilde": "ã", "otilde": "õ", "ccedil": "ç", "acirc": "â", "ecirc": "ê", "ocirc": "ô", "agrave": "à"}


def _character(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Hexadecimal, decimal and named entities, each in one pass; unknown ones stay; text without a sign for them isn't looked through."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    steps = (
        ("&#[xX][0-9a-fA-F]{1,6};", lambda m: F.coalesce(_character(F.regexp_extract(m, "([0-9a-fA-F]+);", 1)), m)),
        ("&#[0-9]{1,7};", lambda m: F.coalesce(_character(F.hex(F.regexp_extract(m, "([0-9]+)", 1).cast("long"))), m)),
        ("&[A-Za-z]+;", lambda m: F.coalesce(F.try_element_at(names, F.lower(F.regexp_extract(m, "([A-Za-z]+)", 1))), m)),
    )

    def decoded(x: Column) -> Column:
        out = x
        for pattern, new in steps:
            out = once(out, _replacing(pattern, new))
        return F.when(F.contains(x, F.lit("&")), out).otherwise(x)

    return once(text, decoded)


def _replacing(pattern: str, new: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: replace_matches(x, pattern, new)


def html_title(html: Column) -> Column:
    """The trimmed title, or null."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(F.regexp_like(html, F.lit(r"(?is)<title[^>]*>.*?</title>")), F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")))


#: What a tag leaves behind; all other tags leave nothing.
TAGS = {"br": "\n", "li": "- ", "td": " | ", "th": " | ", **{f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}, **{f"/{t}": "\n" for t in ("p", "div", "section", "article", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6")}}
_TAG = r"(?is)^<(?:(h[1-6]|li|t[dh])[^>]*|(br)\s*/?|(/(?:p|div|section|article|tr|li|h[1-6])))>"
_INLINE = r"(?i)^</?(?:a|strong|b|em|i|code)\b"
_LINK = r"""(?is)<a\s[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
_MARKS = (("strong|b", ">", "**"), ("em|i", ">", "*"), ("code", "[^>]*>", "`"))


def _tagged(piece: Column) -> Column:
    """A tag and the text up to the next: what the tag leaves behind, then the text; tags inside lines wait for their partners."""
    known = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    name = F.lower(F.concat(*[F.regexp_extract(piece, _TAG, i) for i in (1, 2, 3)]))
    leaves = F.coalesce(F.try_element_at(known, name), F.lit(""))
    return F.when(F.regexp_like(piece, F.lit(_INLINE)) | ~F.startswith(piece, F.lit("<")), piece).otherwise(F.concat(leaves, F.regexp_replace(piece, "^<[^>]+>", "")))


def _linked(link: Column) -> Column:
    words, target = F.trim(F.regexp_replace(F.regexp_extract(link, _LINK, 2), "<[^>]+>", "")), F.regexp_extract(link, _LINK, 1)
    return once(words, lambda w: F.when(w == "", target).otherwise(F.concat(F.lit("["), w, F.lit("]("), target, F.lit(")"))))


def _inlined(text: Column) -> Column:
    out = once(text, lambda x: replace_matches(x, _LINK, _linked))
    for names, rest, mark in _MARKS:
        out = F.regexp_replace(out, f"(?is)<({names}){rest}(.*?)</\\1>", f"{mark}$2{mark}")
    return decode_entities(F.regexp_replace(out, "<[^>]+>", ""))


def _tidy(text: Column) -> Column:
    """Single spaces, trimmed lines, at most one empty line between two."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_to_markdown(html: Column) -> Column:
    """Headings, lists, links, tables, emphasis and code; other tags go, entities are decoded.

    The page is cut before every tag once, and each piece is rewritten by its own tag; then links and emphasis are paired.
    """
    seen = F.regexp_replace(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|noscript|svg).*?</\1>", ""), r"\r\n?", "\n")

    def page(s: Column) -> Column:
        body = _tidy(_inlined(F.array_join(F.transform(F.split(s, "(?=<[^<>]+>)"), lambda x: _tagged(x)), "")))
        head = lambda t: F.concat(F.lit("# "), t)
        return once(F.struct(html_title(s).alias("t"), body.alias("b")), lambda x: F.when(x["t"].isNotNull() & (x["t"] != "") & ~F.startswith(x["b"], head(x["t"])), F.concat(head(x["t"]), F.lit("\n\n"), x["b"])).otherwise(x["b"]))

    return once(seen, page)


def markdown_table(rows: Column) -> Column:
    """array<array<string>> -> pipe table, padded to the widest row; the first row is the head."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


def guess_delimiter(text: Column) -> Column:
    """The most frequent of comma, semicolon, tab and pipe in the first five lines; earlier ones win ties."""
    head = F.array_join(F.slice(F.split(text, r"\r?\n"), 1, 5), "\n")
    marks = [",", ";", "\t", "|"]
    count = F.array_max(F.array(*[F.struct((F.length(head) - F.length(F.replace(head, F.lit(d), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(marks)]))
    return F.when(count["n"] > 0, count["d"]).otherwise(",")


def _counter(sign: str) -> Callable[[Column], Column]:
    """A function of one argument (Spark would pass the place in the array as a second)."""
    return lambda x: F.length(x) - F.length(F.replace(x, F.lit(sign), F.lit("")))


def looks_tabular(text: Column) -> Column:
    """The first five filled lines hold the same number, one or more, of one separator."""
    lines = F.slice(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""), 1, 5)
    hit = F.lit(False)
    for d in (",", ";", "\t"):
        n = F.transform(lines, _counter(d))
        hit = hit | ((F.array_min(n) == F.array_max(n)) & (F.array_min(n) >= 1))
    return F.coalesce((F.size(lines) >= 2) & hit, F.lit(False))


def column_index(ref: Column) -> Column:
    """Spreadsheet column letters to a number from 0; empty is -1."""
    letters = F.filter(F.split(F.regexp_replace(F.upper(ref), "[^A-Z]", ""), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda a, c: a * 26 + F.ascii(c) - 64) - 1


def clock(seconds: Column) -> Column:
    s = F.greatest(F.floor(seconds + 0.5), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(r))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(r)))


def cue_time(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm"""
    ms = F.greatest(F.floor(seconds * 1000 + 0.5), F.lit(0)).cast("long")
    part = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
    return F.concat(part(F.floor(ms / 3600000), 2), F.lit(":"), part(F.floor(ms % 3600000 / 60000), 2), F.lit(":"), part(F.floor(ms % 60000 / 1000), 2), F.lit(mark), part(ms % 1000, 3))


def file_size(n: Column) -> Column:
    kib, mib, gib = 1024.0, 1024.0**2, 1024.0**3
    whole = lambda x: F.floor(x + 0.5).cast("string")
    return F.when(n.isNull() | (n == 0), "?").when(n >= gib, F.concat(F.call_function("format_number", n / gib, F.lit("0.00")), F.lit(" GB"))).when(n >= mib, F.concat(whole(n / mib), F.lit(" MB"))).otherwise(F.concat(whole(n / kib), F.lit(" KB")))


def parse_duration(text: Column) -> Column:
    """HH:MM:SS.ff in seconds, or null."""
    g = lambda i: F.regexp_extract(text, r"(\d+):(\d+):(\d+(?:\.\d+)?)", i).try_cast("double")
    return g(1) * 3600 + g(2) * 60 + g(3)


def quant_from_name(name: Column) -> Column:
    """The quantisation named in a file name, or null."""
    found = F.regexp_extract(name, r"(?i)(?<![a-z0-9])(IQ\d_[A-Z0-9]+|Q\d_K_[SML]|Q\d_[01]|Q\d_K|q8f16|F16|BF16|F32|fp8(?:_e4m3fn(?:_scaled)?)?|fp16|fp32|int8|int4|Q\d)(?![a-z0-9])", 1)
    return F.when(found != "", F.regexp_replace(F.upper(found), "FP", "fp"))


def params_from_name(name: Column) -> Column:
    """Parameters from a part such as 4B or 0.6b, or null."""
    return F.floor(F.regexp_extract(name, r"(?i)(?:^|[-_ /.])(\d+(?:\.\d+)?)\s*b(?:[-_ /.]|$)", 1).try_cast("double") * 1e9 + 0.5).cast("long")


def parse_ref(raw: Column) -> Column:
    """A pasted reference -> struct(provider, repo, revision, path, subpath, quant, model_id, version_id, label); nulls if not known."""
    s = F.trim(raw)
    url = F.regexp_like(s, F.lit(r"(?i)^https?://"))
    host = F.lower(F.try_parse_url(s, F.lit("HOST")))
    path = F.coalesce(F.try_parse_url(s, F.lit("PATH")), F.lit(""))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parts = F.transform(F.when(F.try_element_at(parts, F.lit(1)) == "models", F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1)))).otherwise(parts), F.try_url_decode)
    hub = url & host.isin("huggingface.co", "www.huggingface.co", "hf.co", "huggingface.com", "hf-mirror.com")
    shop = url & host.isin("civitai.com", "www.civitai.com")
    nth = lambda a, i: F.try_element_at(a, F.lit(i))
    rest = F.nullif(F.array_join(F.slice(parts, F.lit(5), F.greatest(F.size(parts), F.lit(1))), "/"), F.lit(""))
    kind = nth(parts, 3)
    short = F.split(F.regexp_replace(F.regexp_replace(s, "^hf://", ""), "^/+", ""), "/")
    bare = r"^([\w.-]+)/([\w.-]+)(?::([\w.-]+))?(?:/(.+))?$"
    g = lambda i: F.nullif(F.regexp_extract(s, bare, i), F.lit(""))
    is_hf, is_recipe, is_bare = F.startswith(s, F.lit("hf://")), F.startswith(s, F.lit("recipe:")), F.regexp_like(s, F.lit(bare))
    two = lambda a: F.concat_ws("/", nth(a, 1), nth(a, 2))
    provider = F.when(is_recipe, "recipe").when(is_hf & (F.size(short) > 1), "huggingface").when(hub & (F.size(parts) > 1), "huggingface").when(shop, "civitai").when(url & ~hub, "url").when(~url & ~is_hf & is_bare, "huggingface")
    repo = F.when(is_hf, two(short)).when(hub, two(parts)).when(~url & is_bare & ~is_recipe, F.concat_ws("/", g(1), g(2)))
    revision = F.when(hub & kind.isin("blob", "resolve", "tree"), F.coalesce(nth(parts, 4), F.lit("main"))).when(provider == "huggingface", "main")
    file = F.when(is_recipe, None).when(is_hf, F.nullif(F.array_join(F.slice(short, F.lit(3), F.greatest(F.size(short), F.lit(1))), "/"), F.lit(""))).when(hub & kind.isin("blob", "resolve"), rest).when(~url & is_bare, g(4))
    model = F.when(shop, F.regexp_extract(path, r"/models/(\d+)", 1).try_cast("long"))
    download = F.regexp_extract(path, r"/api/download/models/(\d+)", 1).try_cast("long")
    version = F.when(shop, F.coalesce(download, F.try_parse_url(s, F.lit("QUERY"), F.lit("modelVersionId")).try_cast("long")))
    label = F.when(provider == "recipe", F.concat(F.lit("recipe:"), F.trim(F.substring(s, 8, 4000)))).when(provider == "huggingface", F.concat_ws("/", repo, file)).when(provider == "civitai", F.concat(F.lit("civitai:"), F.coalesce(version, model).cast("string")))
    label = label.when(provider == "url", F.coalesce(F.nullif(F.try_url_decode(F.substring_index(path, "/", -1)), F.lit("")), F.lit("download")))
    return F.struct(provider.alias("provider"), repo.alias("repo"), revision.alias("revision"), file.alias("path"), F.when(hub & (kind == "tree"), rest).alias("subpath"), F.when(~url & ~is_hf & ~is_recipe, g(3)).alias("quant"), model.alias("model_id"), version.alias("version_id"), label.alias("label"))


def fingerprint(key: Column) -> Column:
    """The key's first eight signs and twelve hex digits of its digest."""
    return F.concat(F.substring(key, 1, 8), F.lit("…"), F.substring(F.sha2(key, 256), 1, 12))
