"""Documented functions of Scala sources: a scanner, its table, and their index schema.

A function is a ``def`` with a body; secondary constructors and abstract members are none. It takes
the latest doc comment that begins before it; comments are not used up. A parameter's description
is that of the tag with its very name. A body ends with its brackets, or before the next line that
is not indented further than the line of its ``def``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.model import Field, Schema
from quillon.operators.index import SearchIndex, build_index

RECORD = "name string, description string, annotations array<string>, params array<string>, return_type string, start_line int, end_line int"
_DOC = re.compile(r"/\*\*(?!/)(.*?)\*/", re.S)
_MARKS = r"[!#%&*+\-/:<=>?@\\^|~]"
_DEF = re.compile(rf"(?<![\w.$`])def\s+(`[^`\n]+`|{_MARKS}+|[\w$]+(?:(?<=_){_MARKS}+)?)")
_MODIFIER = re.compile(r"(?<![@\w])(?:private|protected|final|override|implicit|inline|lazy|transparent|abstract)(?:\[\w+\])?\s*$")
_OPEN, _CLOSE = "([{", ")]}"


@dataclass
class Doc:
    at: int
    description: str
    params: dict[str, str]


def _doc(at: int, raw: str) -> Doc:
    lines = [re.sub(r"^\s*\*?\s?", "", line).strip() for line in raw.strip("* \n").split("\n")]
    text: list[str] = []
    tags: list[list[str]] = []
    for line in lines:
        if line.startswith("@"):
            tags.append([line])
        elif tags and line:
            tags[-1].append(line)
        elif line and not tags:
            text.append(line)
    params: dict[str, str] = {}
    for t in tags:
        if m := re.match(r"@t?param\s+(\S+)\s*(.*)", " ".join(t)):
            params[m[1]] = m[2]
    return Doc(at, " ".join(text), params)


#: Stands for what a string or character literal holds: no blank, bracket, comma or line break.
_HELD = "\x01"
_TOKENS = re.compile(r'''/\*.*?\*/|//[^\n]*|""".*?"""+|"(?:\\.|[^"\\\n])*"|'(?:\\u[0-9a-fA-F]{4}|\\.|[^'\\\n])'|`[^`\n]+`''', re.S)


def _masked(source: str) -> str:
    """The source with comments blanked and literals held by fillers, places kept."""

    def mask(m: re.Match) -> str:
        if m[0][0] == "`":
            return m[0]
        return (" " if m[0].startswith("/") else _HELD) * len(m[0])

    return _TOKENS.sub(mask, source)


def _closing(code: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] in _OPEN:
            depth += 1
        elif code[i] in _CLOSE:
            depth -= 1
            if not depth:
                return i + 1
    return len(code)


def _parts(code: str, masked: str, begin: int, end: int) -> list[str]:
    """Text between top-level commas."""
    out, depth, last = [], 0, begin
    for i in range(begin, end):
        c = masked[i]
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE:
            depth -= 1
        elif c == "," and not depth:
            out.append(code[last:i])
            last = i + 1
    out.append(code[last:end])
    return [p.strip() for p in out if p.strip()]


def _skip(masked: str, at: int) -> int:
    while at < len(masked) and masked[at].isspace():
        at += 1
    return at


def _param(text: str, implicit: bool, doc: dict[str, str]) -> str:
    name, _, rest = text.partition(":")
    name = name.split()[-1] if name.split() else name
    depth, cut = 0, len(rest)
    for i, c in enumerate(rest):
        depth += c in "([{"
        depth -= c in ")]}"
        if c == "=" and not depth and rest[i : i + 2] != "=>":
            cut = i
            break
    kind = rest[:cut].strip() or "Unknown Type"
    shown = f"{name}: {doc[name]}" if doc.get(name) else name
    return f"{shown}: {kind}" + (" (Optional)" if cut < len(rest) else " (Implicit)" if implicit else "")


def _annotations(source: str, masked: str, at: int) -> tuple[list[str], int]:
    """Annotations right before ``at``, and where the first of them or of the modifiers begins."""
    found: list[str] = []
    while True:
        before = masked[:at].rstrip()
        if m := _MODIFIER.search(before):
            at = m.start()
            continue
        line = before.rfind("\n") + 1
        text = source[line : len(before)].strip()
        if m := re.match(r"@\w[\w.]*", text):
            end = line + len(source[line:]) - len(source[line:].lstrip()) + m.end()
            stop = _closing(masked, end) if masked[end : end + 1] == "(" else end
            if masked[stop : len(before)].strip() == "":
                at = line + len(source[line:]) - len(source[line:].lstrip())
                found.insert(0, source[at:stop])
                continue
        return found, at


def _indent(masked: str, at: int) -> int:
    """Blanks that the line of ``at`` begins with."""
    line = masked.rfind("\n", 0, at) + 1
    return _skip(masked, line) - line


def _body_end(masked: str, at: int, indent: int) -> int:
    """Where the expression after ``=`` of a ``def`` in a line with ``indent`` blanks ends."""
    at = _skip(masked, at)
    i = at
    while i < len(masked):
        c = masked[i]
        if c in _OPEN:
            i = _closing(masked, i)
            continue
        if c in _CLOSE or c == ";":
            break
        if c == "\n":
            after = _skip(masked, i)
            if after == len(masked) or _indent(masked, after) <= indent:
                break
            i = after
            continue
        i += 1
    return max(at, len(masked[:i].rstrip()))


def parse_scaladoc(source: str) -> list[tuple]:
    """A :data:`RECORD` for each ``def``, in order; lines count from 0."""
    masked = _masked(source)
    docs = [_doc(m.start(), m[1]) for m in _DOC.finditer(source)]
    out = []
    for m in _DEF.finditer(masked):
        if m[1] == "this":
            continue
        annotations, first = _annotations(source, masked, m.start())
        doc = next((d for d in reversed(docs) if d.at < first), Doc(0, "", {}))
        at = _skip(masked, m.end())
        params: list[str] = []
        if masked[at : at + 1] == "[":
            end = _closing(masked, at)
            names = [re.match(r"[\w+\-_]*", p)[0].lstrip("+-") or p for p in _parts(source, masked, at + 1, end - 1)]
            params += [f"{n}: {doc.params[n]}" if doc.params.get(n) else n for n in names]
            at = _skip(masked, end)
        while masked[at : at + 1] == "(":
            end = _closing(masked, at)
            inside = _parts(source, masked, at + 1, end - 1)
            implicit = bool(inside) and re.match(r"(implicit|using)\s", inside[0]) is not None
            params += [_param(re.sub(r"^(implicit|using)\s+", "", p), implicit, doc.params) for p in inside]
            at = _skip(masked, end)
        kind, stop = "Unit", at
        if masked[at : at + 1] == ":":
            depth, stop = 0, at + 1
            while stop < len(masked):
                c = masked[stop]
                if c in _OPEN and not (c == "{" and not depth):
                    depth += 1
                elif c in _CLOSE:
                    if not depth:
                        break
                    depth -= 1
                elif not depth and (c in "={\n") and masked[stop : stop + 2] != "=>":
                    break
                stop += 1
            kind = source[at + 1 : stop].strip()
        if masked[stop : stop + 1] == "=":
            end = _body_end(masked, stop + 1, _indent(masked, m.start()))
        elif masked[stop : stop + 1] == "{":
            end = _closing(masked, stop)
        else:
            continue
        out.append((m[1].strip("`"), doc.description, annotations, params, kind, source.count("\n", 0, first), source.count("\n", 0, end)))
    return out


def read_sources(spark: SparkSession, folder: str, suffix: str = "*.scala") -> DataFrame:
    """``path, source``: every source file below ``folder``, one row each."""
    return spark.read.text(folder, wholetext=True, pathGlobFilter=suffix, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def documented(sources: DataFrame) -> DataFrame:
    """``sources`` by documented function: the other columns, and :data:`RECORD`'s in place of ``source``."""
    keep = [c for c in sources.columns if c != "source"]
    fields = [f for f in sources.schema.fields if f.name != "source"]
    record = T.StructType.fromDDL(RECORD)
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for i, source in enumerate(b.column("source").to_pylist()):
                own = parse_scaladoc(source) if source is not None else []
                rows += [i] * len(own)
                found += own
            at = pa.array(rows, pa.int64())
            made = [pa.array([r[k] for r in found], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], *made], [*keep, *record.names])

    return sources.select(*[f"`{c}`" for c in sources.columns]).mapInArrow(run, T.StructType([*fields, *record.fields]))


#: Fields of an index of functions; the first is the default one.
SCHEMA = Schema.of(*[Field(n) for n in ("functionName", "description", "annotations", "params", "returnType", "startLine", "endLine")])


def index_functions(rows: DataFrame, key: str = "doc_id") -> SearchIndex:
    """Index :data:`RECORD` rows that have a key; lists are joined by commas."""
    values = {"functionName": F.col("name"), "description": F.col("description"), "annotations": F.array_join("annotations", ", "), "params": F.array_join("params", ", "), "returnType": F.col("return_type"), "startLine": F.col("start_line").cast("string"), "endLine": F.col("end_line").cast("string")}
    return build_index(rows, SCHEMA, key, values)
