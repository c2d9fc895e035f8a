"""Operator 10: secret scans by assignment-aware lexing, beside three fixed patterns.

The lexer reads source and configuration syntax token by token into name-literal pairs: plain, dotted, quoted and subscripted
names, annotated and typed declarations, key and value attributes, keys above a block (by indentation or brackets), joined
and triple-quoted literals, block scalars and literals in calls that wrap them; what a call fetches or a subscript reads is
no literal.  It keeps what names stand for while it goes through the text (constants assigned to another name), and scores
each literal by the name it ends up under and by its own make-up.  A literal that reaches the threshold is a span of
kind ``lex``.  Texts are handled whole, one by one, in Arrow batches; rows never meet, so there is no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings, table

KINDS = ("assign", "access", "hex", "lex")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weight of the parts of a name, matched inside it in lower case.
NAME_WEIGHTS = {"password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api_key": 3.0, "api-key": 3.0, "access_key": 3.0, "accesskey": 3.0, "private_key": 3.0, "privatekey": 3.0, "credential": 2.5, "auth": 1.5, "bearer": 2.5, "signing": 1.5, "connection_string": 2.0}
#: Literals that stand for no secret.
PLACEHOLDERS = {"", "none", "null", "true", "false", "changeme", "example", "placeholder", "undefined", "password", "secret", "token", "xxxx", "xxxxxxxx"}
LEX_THRESHOLD = 3.5
#: More characters than the longest placeholder has.
HEAD = 16

_HINT = re.compile(r"passw|passphrase|pwd|secret|token|key|credential|auth|bearer|signing|connection_string")
_STRING = r"""(?:(?<!\w)[rRbBfFuUL]{1,2})?(?:\"{3}(?P<dq3>(?:[^"\\]|\\.|"(?!""))*+)\"{3}|'{3}(?P<sq3>(?:[^'\\]|\\.|'(?!''))*+)'{3}|"(?P<dq>(?:[^"\\\n]|\\.)*+)"|(?<![A-Za-z0-9])'(?P<sq>(?:[^'\\\n]|\\.)*+)'|`(?P<bq>[^`\n]*+)`)"""
STRINGS = ("dq3", "sq3", "dq", "sq", "bq")
#: Tokens of source and configuration files alike; a line break takes the next line's indentation along.
TOKEN = re.compile(rf"""(?P<str>{_STRING})|(?P<name>[A-Za-z_$@][A-Za-z0-9_$]*(?:-[A-Za-z0-9_]+)*)|(?P<assign>:=|=>|=(?![=~])|:(?![:/]))|(?P<skip>[=!<>]=|::|->|[0-9]+)|(?P<line>\n[\x20\t]*(?:-[\x20]+)?)|(?P<op>[^\s])""", re.DOTALL)
_VALUE = re.compile(rf"(?P<str>{_STRING})|(?P<bare>[A-Za-z0-9+/_.=$@!%~^*#?&-]++)", re.DOTALL)
_BLANK = re.compile(r"(?:[\x20\t]|\\\n)*")
_LOOSE = re.compile(r"[\s]*")
_BLOCK = re.compile(r"[|>][+-]?[\x20\t]*\n[\x20\t]+(?P<block>[^\n]+)")
_PATH = re.compile(r"[A-Za-z_$][A-Za-z_]*(?:\.[A-Za-z_]+)+")
_NAME = re.compile(r"[A-Za-z_$@][A-Za-z0-9_$]*(?:[.-][A-Za-z0-9_$]+)*")
#: Calls of these kinds fetch what they return; their arguments aren't it.
_FETCHES = re.compile(r"env|get|read|input|prompt|fetch|load|find|param|query|vault|lookup|config|request", re.IGNORECASE)
_DECLARES = ("var", "let", "const", "val", "static", "final", "auto")


def name_score(name: str) -> float:
    low = name.lower()
    return max((w for part, w in NAME_WEIGHTS.items() if part in low), default=0.0)


class Held:
    """What a name stands for: spans of its own, other names' parts, and the value's first characters and character counts.

    Parts are referred to, not copied, so a text's names take room in proportion to it however they are joined.
    """

    def __init__(self, value: str = ""):
        self.spans: list[tuple[int, int]] = []
        self.parts: list[Held] = []
        self.head, self.counts, self.found = value[:HEAD], Counter(value), False

    def join(self, head: str, chars: str | Counter) -> None:
        self.head = (self.head + head)[:HEAD]
        self.counts.update(chars)

    def score(self) -> float:
        """0 for placeholders, words and short literals; up to 2 for long ones of mixed characters."""
        n = self.counts.total()
        if n < 6 or self.head.lower() in PLACEHOLDERS or self.head.startswith(("$", "%", "<", "{")):
            return -10.0
        bits = -sum(p * math.log2(p) for p in (c / n for c in self.counts.values()) if p)
        chars = "".join(self.counts)
        kinds = sum(bool(re.search(p, chars)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(1.0, bits / 4) + (0.5 if kinds >= 2 else 0.0) + (0.5 if n >= 16 else 0.0)

    def collect(self, found: set[tuple[int, int]]) -> None:
        """Add the spans of all parts, each part once in a text."""
        stack = [self]
        while stack:
            at = stack.pop()
            if not at.found:
                at.found = True
                found.update((s, e) for s, e in at.spans if e > s)
                stack += at.parts


def literal_score(value: str) -> float:
    return Held(value).score()


class Lexer:
    """One pass over a text's tokens: name-literal pairs, with what names stand for and the keys around them."""

    def __init__(self, text: str):
        self.text = text
        self.held: dict[str, Held] = {}
        self.found: set[tuple[int, int]] = set()

    def _string(self, m: re.Match) -> tuple[int, int]:
        return next(m.span(k) for k in STRINGS if m.group(k) is not None)

    def _call(self, at: int, new: Held | None) -> int:
        """From an opening bracket to behind its partner (or the line's end); literals inside go to ``new``."""
        depth = 0
        while (m := TOKEN.search(self.text, at)) and m.lastgroup != "line":
            at = m.end()
            if m["str"] is not None:
                if new is not None:
                    self._add(new, *self._string(m))
            elif m[0] in "([{":
                depth += 1
            elif m[0] in ")]}":
                depth -= 1
                if depth <= 0:
                    break
        return at

    def _add(self, new: Held, s: int, e: int) -> None:
        new.spans.append((s, e))
        new.join(self.text[s : min(e, s + HEAD)], self.text[s:e])

    def value(self, at: int) -> tuple[Held, int, bool]:
        """The expression from ``at`` on: joined literals and names -> (what it stands for, its end, is there one)."""
        text, new, gap, some = self.text, Held(), _BLANK, False
        at = gap.match(text, at).end()
        if text[at : at + 1] == "(":
            gap, at = _LOOSE, _LOOSE.match(text, at + 1).end()
        elif block := _BLOCK.match(text, at):
            self._add(new, *block.span("block"))
            return new, block.end(), True
        while m := _VALUE.match(text, at):
            if m["str"] is not None:
                self._add(new, *self._string(m))
                at = m.end()
            else:
                bare, at = m["bare"], m.end()
                follows = text[at : at + 1]
                if follows in ("(", "["):
                    at = self._call(at, None if follows == "[" or _FETCHES.search(bare) else new)
                    while text[at : at + 1] in ("(", "["):
                        at = self._call(at, None)
                elif bare in self.held:
                    new.parts.append(self.held[bare])
                    new.join(self.held[bare].head, self.held[bare].counts)
                elif not some and not _PATH.fullmatch(bare):
                    self._add(new, *m.span("bare"))
                    return new, at, True
            some = True
            nxt = gap.match(text, at).end()
            if text[nxt : nxt + 1] in ("+", "."):
                at = gap.match(text, nxt + 1).end()
            elif nxt < len(text) and text[nxt] in "\"'" and m["str"] is not None:  # literals side by side
                at = nxt
            else:
                break
        return new, at, some

    def assign(self, names: list[str], new: Held) -> None:
        """The last name is the target; those before it are the keys around it, which count a little less."""
        self.held[names[-1]] = new
        score = max(name_score(names[-1]), *(name_score(n) - 0.5 for n in names[:-1]), 0.0)
        if score > 0 and score + new.score() >= LEX_THRESHOLD:
            new.collect(self.found)

    def run(self) -> list[tuple[int, int]]:
        text, at = self.text, 0
        line: list[tuple[str, str]] = []  # (kind, text) of the statement's tokens so far
        around: list[tuple[int, str]] = []  # keys above, by indentation; inside brackets by depth from 1000 on
        indent = depth = 0
        label: str | None = None  # the literal of a key= or name= attribute, until its value comes
        while m := TOKEN.search(text, at):
            at, kind = m.end(), m.lastgroup if m["str"] is None else "str"
            if kind == "line":
                line, indent = [], len(m[0]) - 1
                continue
            if kind == "str":
                s, e = self._string(m)
                line.append(("str", text[s:e]))
                continue
            if kind == "op" and m[0] in "{};,()<>":
                depth += (m[0] == "{") - (m[0] == "}")
                if m[0] in "}>;":
                    label = None
                if m[0] == "}":
                    around = [a for a in around if a[0] <= 1000 + depth]
                line = [] if m[0] not in "<>" or not any(k == "assign" for k, _ in line) else line + [("op", m[0])]
                continue
            if kind != "assign":
                line.append((kind, m[0]))
                continue
            name = _target(line, m[0])
            line.append(("assign", m[0]))
            if name is None:
                continue
            new, end, some = self.value(at)
            level = 1000 + depth if depth > 0 else indent
            around = [a for a in around if a[0] < level or depth > 0 and a[0] < 1000]
            if not some:  # a key alone on its line, or before a bracket: it stands around what follows
                around.append((level, name))
                continue
            short = name.rpartition(".")[2].lower()
            if short in ("key", "name", "id") and new.spans and not new.parts:
                label = text[new.spans[0][0] : new.spans[0][1]]
            names = [n for _, n in around] + [name]
            if short in ("value", "val", "content", "default") and label:
                names, label = [*names, label], None
            self.assign(names, new)
            # A value that is a bare type (as in name: type = literal) leaves its target to the next sign.
            tail = text[at:end].strip().lstrip("&*")
            line.append(("name", tail) if _NAME.fullmatch(tail) else ("value", ""))
            at = max(at, end)
        return sorted(self.found)


def _target(line: list[tuple[str, str]], sign: str) -> str | None:
    """What the tokens before an assignment sign name: a key, a dotted name, a subscript, a declared or an annotated name."""
    i = len(line)
    if sign == "=":  # name: type = ...  The type may have brackets and dots.
        k = i - 1
        while k > 0 and line[k][0] in ("name", "op", "skip") and line[k][1] not in ("{", "}"):
            k -= 1
        if 0 < k < i - 1 and line[k] == ("assign", ":"):
            i = k
    if not i:
        return None
    kind, word = line[i - 1]
    if kind == "str":
        return word if 0 < len(word) <= 256 and "\n" not in word else None
    if kind == "op" and word == "]":
        k = next((k for k in range(i - 2, -1, -1) if line[k] == ("op", "[")), None)
        if k is None:
            return None
        inner = [w for kd, w in line[k + 1 : i - 1] if kd in ("str", "name")]
        base = _target(line[:k], ":")
        return ".".join([*([base] if base else []), *inner]) or None
    if kind != "name":
        return None
    k = i - 1
    while k >= 2 and line[k - 1][1] in (".", "-") and line[k - 2][0] == "name":
        k -= 2
    if k and line[k - 1][1] == "/":  # a path or an address
        return None
    name = ".".join(w for _, w in line[k:i:2])
    # var name type = ...
    if sign == "=" and k == i - 1 and i >= 3 and line[i - 2][0] == "name" and line[i - 3][1] in _DECLARES and not name_score(name):
        return line[i - 2][1]
    return name


def lex_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that a sensitive name stands for, in order."""
    if ("=" not in text and ":" not in text) or not _HINT.search(text.lower()):
        return []
    return Lexer(text).run()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the three patterns, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def all_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return sorted({*base, *((s, 3, e) for s, e in lex_spans(text))})


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCAN = T.StructType([T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


@F.arrow_udf(SCAN)
def scan_udf(texts: pa.Array) -> pa.Array:
    counts: list[list[int]] = [[], [], []]
    digests, spans = [], []
    for text in strings(texts):
        base = base_spans(text)
        for k in range(3):
            counts[k].append(sum(x[1] == k for x in base))
        digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
        spans.append(shown(all_spans(text, base)))
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=SCAN.names)


@F.arrow_udf(T.StringType())
def redact_udf(texts: pa.Array) -> pa.Array:
    out = []
    for text, null in zip(strings(texts), texts.is_null().to_pylist(), strict=True):
        pieces, at = [], 0
        for s, _, e in all_spans(text, base_spans(text)):
            if s >= at:
                pieces += [text[at:s], "[SECRET]"]
            at = max(at, e)
        out.append(None if null else "".join([*pieces, text[at:]]) if pieces else text)
    return pa.array(out, pa.string())


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the result of the scan in ``_scan`` (a column of that name is replaced).  Null texts scan as empty; rows are independent."""
    return docs.withColumn("_scan", scan_udf(F.col(text)))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``; null stays null, other columns and clean texts are unchanged."""
    return docs.withColumn(text, redact_udf(F.col(text)))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_scan.*")


QUERIES = {"op10_secrets": op10_secrets}
ORACLE: dict[str, str] = {}
