"""Imports and symbols of source files, and outlines of them.

Four languages are read: typescript, javascript, python and go. Symbols are functions and classes, and interfaces and
types where the language has them, at any depth; in python methods are functions. Imports are import statements only.
Results: files of another or no language, and null contents, give nothing; a repeated row of a file counts once.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import lexing
from cairnfield.functions.arrow import map_rows, spread

LANGUAGES = ("typescript", "javascript", "python", "go")
NAME = r"[A-Za-z_$¡-￿][\w$]*"
AT_START = r"(?:(?<=[\n;{}])|^)[ \t\r]*(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
SYMBOLS = {
    "javascript": ((re.compile(rf"{AT_START}((?:async[ \t]+)?function[ \t]*\*?[ \t]*({NAME})[ \t\r\n]*[(<])", re.M), "function"), (re.compile(rf"{AT_START}((?:abstract[ \t]+)?class[ \t]+({NAME}))", re.M), "class")),
    "go": ((re.compile(r"^()func[ \t]+(\w+)[ \t]*[(\[]", re.M), "function"),),
    "python": ((re.compile(r"^[ \t]*((?:async[ \t]+)?def[ \t]+(\w+)[ \t]*[(\[])", re.M), "function"), (re.compile(r"^[ \t]*(class[ \t]+(\w+)[ \t]*[(:\[])", re.M), "class")),
}
SYMBOLS["typescript"] = (*SYMBOLS["javascript"], (re.compile(rf"{AT_START}(interface[ \t]+({NAME}))", re.M), "interface"), (re.compile(rf"{AT_START}(type[ \t]+({NAME})[ \t]*(?:<[^=\n]*>)?[ \t]*=)", re.M), "type"))
SCRIPT_IMPORT = re.compile(r"(?:^|;)[ \t]*import\b[ \t\r\n]*(?![(.])(?:[^;'\"]*?\bfrom[ \t\r\n]*)?(?=['\"])", re.M)
PYTHON_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n#;]+)|^[ \t]*from[ \t]+(\.*[\w.]*)[ \t]+import\b", re.M)
# A type declaration begins a statement, at any depth; an alias declares no type.
GO_TYPE = re.compile(r"(?:^|(?<=[\n;{]))[ \t]*(type\b)[ \t\r\n]*(?=[\w(])")
GO_SPEC = re.compile(r"[ \t\r\n;]*([^\W\d]\w*)[ \t]*(?![\w \t]*=)")
GO_IMPORT = re.compile(r"^import\b[ \t]*(\([^)]*\)|[^\n]*)", re.M)
QUOTED = re.compile(r"\"([^\"\n]*)\"|'([^'\n]*)'|`([^`\n]*)`")


def _mask(text: str, language: str) -> str:
    pieces: list[str] = []
    lexing.scan(text, language, "C", pieces, even=True)
    mask = "".join(pieces)
    return mask + lexing.BLANK.sub(" ", text[len(mask) :])


def _indent_end(text: str, mask: str, at: int) -> int:
    """Place after the indented body of the definition at ``at``."""
    indent = at - mask.rfind("\n", 0, at) - 1
    depth, colon = 0, -1
    for m in re.compile(r"[()\[\]{}:]").finditer(mask, at):
        depth += (m[0] in "([{") - (m[0] in ")]}")
        if m[0] == ":" and not depth:
            colon = m.end()
            break
    if colon < 0:
        return len(text)
    end = len(text)
    for m in re.compile(r"^([ \t]*)\S", re.M).finditer(mask, colon):
        if m.start() >= colon and mask[m.start() - 1 : m.start()] == "\n" and len(m[1]) <= indent:
            end = m.start()
            break
    lines = text[at:end].split("\n")
    while len(lines) > 1 and (not lines[-1].strip() or lines[-1].lstrip().startswith("#")):
        lines.pop()
    return at + len("\n".join(lines))


def _go_types(mask: str) -> Iterator[tuple[str, int, int]]:
    """(name, begin, end) of the types of a Go text; those declared in one group all have the group's place."""
    for m in GO_TYPE.finditer(mask):
        begin, at = m.start(1), m.end()
        grouped = mask[at] == "("
        end = lexing.balanced(mask, at) if grouped else None
        at += grouped
        while spec := GO_SPEC.match(mask, at):
            at = spec.end()
            # A spec ends with its line, or with the line that closes its last bracket.
            stop = at
            for b in GO_STOP.finditer(mask, at):
                if b.start() < stop:
                    continue
                if b[0] in "([{":
                    stop = lexing.balanced(mask, b.start())
                else:
                    stop = b.start()
                    break
            else:
                stop = len(mask)
            yield spec[1], begin, stop if end is None else end
            at = stop
            if end is None:
                break


GO_STOP = re.compile(r"[(\[{\n;)]")


def symbols(text: str, language: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, kind, start line, end line) of the symbols of a text."""
    mask = _mask(text, language)
    ends: list[int] = []

    def line_of(place: int) -> int:
        if not ends:
            ends.extend(m.start() for m in re.finditer("\n", text))
            ends.append(len(text))
        return bisect_left(ends, place) + 1

    if language == "go":
        for name, begin, end in _go_types(mask):
            yield name, "type", line_of(begin), line_of(max(begin, end - 1))
    for pattern, kind in SYMBOLS[language]:
        for m in pattern.finditer(mask):
            begin = m.start(1) if m[1] else m.start()
            if language == "python":
                end = _indent_end(text, mask, begin)
            elif kind == "type":
                stop = mask.find("\n", begin)
                end = stop if stop >= 0 else len(mask)
            else:
                after = begin
                if kind == "function":
                    # Type parameters and a receiver come before the parameters.
                    name_end = m.end(2)
                    params = mask.find("(", name_end)
                    if params < 0:
                        continue
                    after = lexing.balanced(mask, params)
                if language == "go":
                    line_end = mask.find("\n", after)
                    brace = mask.rfind("{", after, line_end if line_end >= 0 else len(mask))
                    brace = brace if kind == "function" else mask.find("{", after)
                else:
                    brace = lexing.body_brace(mask, after) if kind == "function" else mask.find("{", after)
                if brace < 0:
                    continue  # a signature without a body
                end = lexing.balanced(mask, brace)
            yield m[2], kind, line_of(begin), line_of(max(begin, end - 1))


def imports(text: str, language: str) -> Iterator[str]:
    """Specifiers of the import statements of a text, in order of appearance."""
    mask = _mask(text, language)
    if language in ("javascript", "typescript"):
        # Literals are blank in the mask, so the statement is found there and its literal read from the text.
        for m in re.compile(r"^[ \t]*import\b(?![ \t]*[(.])[^;]*?(?=^[ \t]*(?:import|export|const|let|var|function|class|async|if|for|//|/\*|\Z)|;|\n[ \t]*\n|\Z)", re.M).finditer(mask):
            head = re.compile(r"import\b(?:[\w\s{},*$]*?\bfrom\b)?\s*(['\"])([^'\"\n]*)\1").match(text, mask.index("import", m.start()))
            if head:
                yield head[2]
    elif language == "python":
        for m in PYTHON_IMPORT.finditer(mask):
            if m[2] is not None:
                yield m[2]
            else:
                for part in m[1].split(","):
                    if part.strip() and " as " not in part:
                        yield part.strip()
    else:
        for m in GO_IMPORT.finditer(mask):
            for q in QUOTED.finditer(text, m.start(), m.end()):
                if q[1] is not None:
                    yield q[1]


def _files(files: DataFrame) -> DataFrame:
    return spread(files.filter(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull()).select(F.col("id").cast("bigint").alias("file_id"), "language", "content"))


def code_symbols(files: DataFrame) -> DataFrame:
    """(file_id, name, kind, start_line, end_line) of all files; a file that can't be read gives none."""

    def kernel(columns: list[list]):
        for i, language, text in zip(*columns):
            for row in symbols(text.removeprefix("﻿"), language):
                yield (i, *row)

    return map_rows(_files(files), ["file_id", "language", "content"], kernel, "file_id bigint, name string, kind string, start_line int, end_line int").distinct()


def code_imports(files: DataFrame) -> DataFrame:
    """(source_file_id, target_path) of all files, each specifier once a file."""

    def kernel(columns: list[list]):
        for i, language, text in zip(*columns):
            for spec in dict.fromkeys(imports(text.removeprefix("﻿"), language)):
                yield i, spec

    return map_rows(_files(files), ["file_id", "language", "content"], kernel, "source_file_id bigint, target_path string").distinct()


def file_outline(symbols_: DataFrame, file_ids: DataFrame) -> DataFrame:
    """Symbols of the given files (file_id), in order of line."""
    return symbols_.join(file_ids.select("file_id").distinct(), "file_id", "left_semi").select("file_id", "name", "kind", "start_line", "end_line").distinct()
