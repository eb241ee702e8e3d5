"""Analyzers: typed observations from source files, one row each.

Line patterns run inside the JVM. What needs a state across lines (comments and
strings, nesting by indentation, open elements) is a generator per file in
``mapInPandas``; a file that breaks it gives a failure row, not a failed job.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OBSERVATIONS = "path string, line int, type string, name string, detail string"

def _rows(files: DataFrame, parse: Callable[[str], Iterator[tuple[int, str, str, str | None]]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                try:
                    out += [(path, *o) for o in parse(text or "")]
                except Exception as e:  # noqa: BLE001 - isolation of one file's failure
                    out.append((path, 0, "failure", type(e).__name__, str(e)[:200]))
            yield pd.DataFrame(out, columns=["path", "line", "type", "name", "detail"])

    return files.select("path", "text").mapInPandas(run, OBSERVATIONS)


@lru_cache
def _noise(comments: tuple[tuple[str, str], ...], quotes: tuple[str, ...]) -> re.Pattern:
    """Comments (group 1) and strings (group 2); a string of one quote ends with its line."""
    said = [rf"{re.escape(o)}.*?(?=\n|\Z)" if c == "\n" else rf"{re.escape(o)}.*?(?:{re.escape(c)}|\Z)" for o, c in comments]
    long = [rf"{re.escape(q)}(?:\\.|(?!{re.escape(q)}).)*(?:{re.escape(q)}|\Z)" for q in quotes if len(q) > 1]
    short = [rf"{q}(?:\\.|[^{q}\\\n])*{q}?" for q in quotes if len(q) == 1]
    return re.compile(f"({'|'.join(said)})|({'|'.join(long + short)})", re.DOTALL)


def blank_noise(text: str, comments: tuple[tuple[str, str], ...], quotes: tuple[str, ...], keep_strings: bool = False) -> str:
    """The text with comments, and string contents unless kept, made spaces; line
    breaks stay, so that lines keep their numbers."""
    return _noise(comments, quotes).sub(lambda m: m[0] if keep_strings and m[2] is not None else _NO_BREAK.sub(" ", m[0]), text)


_NO_BREAK = re.compile(r"[^\n]")
# Names that the observations depend on.
_NO_METHOD = frozenset(("if", "for", "while", "switch", "catch", "return", "new", "throw", "else", "try", "do", "synchronized", "super", "this", "assert", "class", "interface", "enum", "record"))
_KINDS = ("class", "interface", "enum", "record")
_VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
_CONFIG_CALLS = ("System.getProperty", "System.getenv", "ConfigProvider.getConfig")


@dataclass
class Token:
    kind: str  # name, string or mark
    text: str
    line: int
    spaced: bool  # begins a line or follows white space


_JAVA_TOKEN = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<string>"""(?:\\.|.)*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<mark>\S)', re.DOTALL)


class Tokens:
    """The words, strings and marks of a source without its comments."""

    def __init__(self, text: str):
        self.all: list[Token] = []
        line, at = 1, 0
        for m in _JAVA_TOKEN.finditer(text):
            line, at = line + text.count("\n", at, m.start()), m.start()
            if m.lastgroup:
                self.all.append(Token(m.lastgroup, m[0].strip("\"'") if m.lastgroup == "string" else m[0], line, at == 0 or text[at - 1].isspace()))
        self.end = Token("end", "", line, True)

    def __getitem__(self, i: int) -> Token:
        return self.all[i] if 0 <= i < len(self.all) else self.end

    def dotted(self, i: int, star: bool = False) -> tuple[str, int]:
        """Names joined by dots from place i on ("" if there is none), and what follows."""
        if self[i].kind != "name":
            return "", i
        parts = [self[i].text]
        while self[i + 1].text == "." and (self[i + 2].kind == "name" or star and self[i + 2].text == "*"):
            parts.append(self[i + 2].text)
            i += 2
        return ".".join(parts), i + 1

    def closed(self, i: int, stop: str = "") -> int:
        """The place of the bracket that closes that at i; -1 if a mark of ``stop`` is inside."""
        depth, k = 0, i
        while self[k].kind != "end":
            if self[k].kind == "mark":
                depth += (self[k].text == "(") - (self[k].text == ")")
                if depth == 0:
                    return k
                if self[k].text in stop and k > i:
                    return -1
            k += 1
        return -1


class JavaReader:
    """Reads declarations off the tokens, and the paths of HTTP endpoints: that of
    the first type, and what annotations say before a method."""

    def __init__(self, text: str):
        self.t, self.out = Tokens(text), []
        self.base, self.path, self.verb, self.inside = "", None, None, False

    def say(self, at: int, kind: str, name: str, detail: str | None = None) -> None:
        self.out.append((self.t[at].line, kind, name, detail))

    def read(self) -> list[tuple[int, str, str, str | None]]:
        i = 0
        while self.t[i].kind != "end":
            i = self.step(i)
        return self.out

    def step(self, i: int) -> int:
        t = self.t
        word = t[i].text if t[i].kind == "name" else ""
        if word in ("package", "import") and t[i + 1].kind == "name":
            return self.header(i, word)
        if t[i].kind == "mark" and t[i].text == "@" and t[i].spaced:
            return self.annotation(i)
        if word in _KINDS and t[i + 1].kind == "name" and t[i - 1].text != ".":
            return self.type(i)
        if word == "new":
            name, k = t.dotted(i + 1)
            if name and t[i - 1].text == "throw":
                self.say(i, "throw", name)
            elif name and t[k].text in ("(", "<"):
                self.say(i, "construct", name)
            return i + 1
        if word and t[i + 1].text == "." and t[i + 2].kind == "name" and t[i + 3].text == "(":
            call = f"{word}.{t[i + 2].text}"
            self.say(i, "call", call)
            if call in _CONFIG_CALLS and t[i + 4].kind == "string":
                self.say(i, "config_access", t[i + 4].text)
        if word and t[i + 1].text == "(" and t[i].spaced:
            self.method(i)
        return i + 1

    def header(self, i: int, word: str) -> int:
        static = word == "import" and self.t[i + 1].text == "static" and self.t[i + 2].kind == "name"
        name, k = self.t.dotted(i + 1 + static, star=word == "import")
        if self.t[k].text == ";":
            self.say(i, word, name, "static" if static else None)
        return k

    def annotation(self, i: int) -> int:
        t = self.t
        name, k = t.dotted(i + 1)
        if not name or name == "interface":
            return i + 1
        self.say(i, "annotation", name)
        last = name.rpartition(".")[2]
        if last in _VERBS:
            self.verb = last
        inside = range(k + 1, t.closed(k)) if t[k].text == "(" else range(0)
        given = {t[j - 2].text: t[j].text for j in inside if t[j].kind == "string" and t[j - 1].text == "="}
        if last == "ConfigProperty" and "name" in given:
            self.say(i, "config_property", given["name"])
        if last == "Path" and len(inside):
            first = t[inside[0]]
            self.path = first.text if first.kind == "string" else given.get("value", self.path)
        return k

    def type(self, i: int) -> int:
        t, kind, name, k = self.t, self.t[i].text, self.t[i + 1].text, i + 2
        self.say(i, "type", name, kind)
        role, depth = "", 0
        while t[k].kind != "end" and t[k].text not in ("{", ";"):
            depth += (t[k].text in ("<", "(")) - (t[k].text in (">", ")"))
            if depth == 0 and t[k].text in ("extends", "implements"):
                role = t[k].text
            elif depth == 0 and role and t[k].kind == "name":
                other, k = t.dotted(k)
                self.say(i, role, other, name)
                continue
            k += 1
        if not self.inside:
            self.base, self.path, self.inside = self.path or "", None, True
        return k

    def method(self, i: int) -> None:
        """A name with parameters after a type, and before a body or a semicolon."""
        t, before = self.t, self.t[i - 1]
        if t[i].text in _NO_METHOD or before.text in _NO_METHOD or not (before.kind == "name" or before.text in (">", "]")):
            return
        k = t.closed(i + 1, stop="(;{}")
        if k < 0:
            return
        thrown, k = [], k + 1
        if t[k].text == "throws":
            while t[k].text in ("throws", ","):
                name, k = t.dotted(k + 1)
                thrown.append(name)
        if t[k].text not in ("{", ";"):
            return
        self.say(i, "method", t[i].text)
        for name in thrown:
            self.say(i, "throws", name, t[i].text)
        if self.verb:
            parts = [p.strip("/") for p in (self.base, self.path or "")]
            self.say(i, "endpoint", "/" + "/".join(p for p in parts if p), self.verb)
        self.path = self.verb = None


def _java(text: str) -> Iterator[tuple[int, str, str, str | None]]:
    yield from JavaReader(text).read()


def java_observations(files: DataFrame) -> DataFrame:
    """Packages, imports, types and their supertypes, methods, annotations,
    configuration keys, exceptions, constructions, calls and HTTP endpoints."""
    return _rows(files, _java)


# Calls of the framework that are told.
FRAMEWORK_OWNERS = ("frappe", "frappe.db")
FRAMEWORK_CALLS = ("get_doc", "get_all", "get_value")
CONFIG_READ, CONFIG_SOURCE = "frappe.conf.get", "frappe.get_conf"
_CALL = re.compile(r"(?<![\w.])([^\W\d]\w*(?:\.[^\W\d]\w*)*)\s*\(\s*")
_ASKED = re.compile(r"\)\s*\.\s*get\s*\(\s*")
_STRING = re.compile(r"([\"'])(.+?)\1")
_PYTHON_NOISE = ((("#", "\n"),), ('"""', "'''", '"', "'"))


def _python(text: str) -> Iterator[tuple[int, str, str, str | None]]:
    bare = blank_noise(text, *_PYTHON_NOISE).split("\n")
    literal = blank_noise(text, *_PYTHON_NOISE, keep_strings=True).split("\n")
    scope: list[tuple[int, str]] = []
    out: list[tuple[int, str, str, str | None]] = []
    dynamic = False
    for n, (code, said) in enumerate(zip(bare, literal, strict=True), 1):
        if not code.strip():
            continue
        indent = len(code) - len(code.lstrip())
        while scope and scope[-1][0] >= indent:
            scope.pop()
        if m := re.match(r"\s*from\s+(\.*[\w.]*)\s+import\s+(.+)", code):
            for name in re.findall(r"([\w*]+)(?:\s+as\s+\w+)?\s*(?:,|$|\))", m[2].strip(" ()")):
                out.append((n, "import", f"{m[1]}.{name}" if not m[1].endswith(".") else m[1] + name, "from"))
        elif m := re.match(r"\s*import\s+(.+)", code):
            for name in re.findall(r"([\w.]+)(?:\s+as\s+\w+)?\s*(?:,|$)", m[1].strip()):
                out.append((n, "import", name, None))
        elif m := re.match(r"\s*(class|(?:async\s+)?def)\s+(\w+)", code):
            full = ".".join([s for _, s in scope] + [m[2]])
            out.append((n, "symbol", full, "class" if m[1] == "class" else "function"))
            scope.append((indent, m[2]))
        elif m := re.match(r"([A-Za-z_]\w*)\s*=(?!=)", code):
            out.append((n, "assignment", m[1], None))
        for m in _CALL.finditer(said):
            owner, _, method = m[1].rpartition(".")
            argument = said[m.end() :]
            text_of = _STRING.match(argument)
            if owner in FRAMEWORK_OWNERS and method in FRAMEWORK_CALLS:
                if text_of:
                    out.append((n, "framework_call", text_of[2], method))
                elif not dynamic:
                    dynamic = True
                    out.append((n, "gap", "dynamic_argument", method))
            elif m[1] == CONFIG_SOURCE:  # a call without arguments, whose result is asked
                asked = _ASKED.match(argument)
                text_of = asked and _STRING.match(argument, asked.end())
            if text_of and m[1] in (CONFIG_READ, CONFIG_SOURCE):
                out.append((n, "config_access", text_of[2], None))
    yield from sorted(out, key=lambda o: o[:3])


def python_observations(files: DataFrame) -> DataFrame:
    """Imports, symbols with their qualified names, assignments, framework calls."""
    return _rows(files, _python)


# Elements and attributes of integration artefacts.
XML_TYPES = frozenset(("api", "endpoint", "inboundendpoint", "localentry", "proxy", "proxyservice", "sequence", "template", "task", "property", "data", "dataservice", "eventsource", "message-store", "messageprocessor"))
XML_ENDPOINTS = frozenset(("api", "proxy", "proxyservice", "endpoint", "inboundendpoint", "address", "http"))
XML_MESSAGES = frozenset(("payloadfactory", "message", "publishevent"))
XML_CONFIG = frozenset(("property", "parameter", "param"))
XML_IMPORTS = frozenset(("href", "schemalocation", "location", "file", "include", "import"))
XML_REFERENCES = frozenset(("ref", "key", "uri", "url", "value", "endpoint", "sequence", "target", "targetendpoint", "insequence", "outsequence", "onerror", "faultsequence", "template"))
XML_DYNAMIC = ("${", "{{", "$ctx", "get-property", "xpath(", "synapse(", "synapse:")
_SECRET_WORD = re.compile(r"(?i)password|passwd|secret|token|api[-_]?key|bearer")


def clean_literal(value: str) -> str:
    """A literal without secrets: marked if it may be one or is too long; of a
    URL the user, query and fragment go."""
    value = value.strip()
    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://", value):
        value = re.sub(r"[?#].*$", "", re.sub(r"//[^/@]*@", "//", value))
    return "[redacted]" if _SECRET_WORD.search(value) or len(value.encode()) > 512 else value


def _xml(text: str) -> Iterator[tuple[int, str, str, str | None]]:
    out: list[tuple[int, str, str, str | None]] = []
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(tag: str, attributes: dict[str, str]) -> None:
        n, tag = parser.CurrentLineNumber, tag.split(" ")[-1].lower()
        given = {k.split(" ")[-1].lower(): v for k, v in attributes.items()}
        name = clean_literal(given.get("name", given.get("key", "")))
        if tag in XML_TYPES and name:
            out.append((n, "type", name, tag))
        if tag in XML_CONFIG and name:
            out.append((n, "config", name, tag))
        if tag in XML_MESSAGES:
            out.append((n, "message", name or tag, tag))
        for k, v in sorted(given.items()):
            if not v.strip():
                continue
            if any(d in v for d in XML_DYNAMIC):
                out.append((n, "gap", "dynamic_expression", f"{tag}.{k}"))
            elif tag in XML_ENDPOINTS and k in ("uri", "url", "context", "uri-template"):
                out.append((n, "endpoint", clean_literal(v), tag))
            elif k in XML_IMPORTS:
                out.append((n, "include", clean_literal(v), tag))
            elif k in XML_REFERENCES and k != "value":
                out.append((n, "reference", clean_literal(v), f"{tag}.{k}"))

    parser.StartElementHandler = start
    parser.Parse(text.encode(), True)
    yield from out


def xml_observations(files: DataFrame) -> DataFrame:
    """Types, endpoints, messages, configuration, includes, references and gaps."""
    return _rows(files, _xml)


def _html(text: str) -> Iterator[tuple[int, str, str, str | None]]:
    out: list[tuple[int, str, str, str | None]] = []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attributes):
            n, _ = self.getpos()
            for k, v in attributes:
                if v and k in ("href", "src"):
                    out.append((n, "include" if k == "src" or tag == "link" else "reference", clean_literal(v), f"{tag}.{k}"))
                elif v and k == "content":
                    out.append((n, "config", clean_literal(v), tag))

    reader = Reader()
    reader.feed(text)
    reader.close()
    yield from out


def html_observations(files: DataFrame) -> DataFrame:
    """References, includes and metadata of pages, however ill-formed."""
    return _rows(files, _html)


def generic_observations(files: DataFrame, most_lines: int = 8) -> DataFrame:
    """One inventory row per file with its first block of non-blank lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    blank = F.transform(lines, lambda x: F.trim(x) == "")
    first = F.array_position(blank, False)
    rest = F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x: F.trim(x) == ""), True)
    length = F.least(F.when(stop == 0, F.size(rest)).otherwise(stop - 1), F.lit(most_lines)).cast("int")
    block = F.when(first > 0, F.array_join(F.slice(rest, F.lit(1), length), "\n"))
    return files.select("path", first.cast("int").alias("line"), F.lit("inventory").alias("type"), F.lit("text_block").alias("name"), block.alias("detail"))


def link_lines(pages: DataFrame) -> DataFrame:
    """Includes and references in markup by patterns alone, inside the JVM."""
    tags = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(tags).alias("position", "href"))


def select_analyzers(artifacts: DataFrame, registry: DataFrame) -> DataFrame:
    """Analyzers for each artifact: type equal or ``any``, in a fixed order. The
    registry has a row per analyzer."""
    joined = artifacts.join(F.broadcast(registry), (artifacts["type"] == registry["artifact_type"]) | (registry["artifact_type"] == "any"))
    order = F.row_number().over(Window.partitionBy("path").orderBy("analyzer_id", "version", "method"))
    return joined.withColumn("position", order)


def capped_evidence(drafts: DataFrame, per_artifact: int = 8) -> DataFrame:
    """The first units of each artifact by line and id."""
    order = Window.partitionBy("artifact_id").orderBy("line", "evidence_id")
    return drafts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= per_artifact)


def truncated(text: Column, characters: int) -> Column:
    return F.substring(text, 1, characters)


def truncate_bytes(limit: int):
    """A pandas UDF: the longest prefix of whole characters within the bytes."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else t.encode()[:limit].decode(errors="ignore"))

    return cut
