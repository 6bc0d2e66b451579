"""Functions paired with their documentation (problem 2).

An island grammar a language: documentation, annotations, signatures and balanced bodies are parsed, the rest is water
that is skipped. Comments and literals are blanked first (``lexing.scan``), so nothing inside them looks like code.

Results: a function counts once, however often its file or symbol row was delivered; a file whose language is null has
the one of its path; files with null content or an unknown language have none. Line numbers are 1-based and count ``\\n``. A body that a truncated file leaves open runs to
the file's end. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.arrow import map_rows, spread
from cairnfield.functions import lexing
from cairnfield.functions.paths import language_of

LANGUAGES = ("typescript", "javascript", "python", "go")

# Signatures, on blanked text.
ISLAND = {
    "javascript": re.compile(r"function(?<![\w$.]function)[ \t]*\*?[ \t\r\n]*([A-Za-z_$¡-￿][\w$]*)[ \t\r\n]*(?=[(<])"),
    "go": re.compile(r"(?m:^func[ \t]*(?:\([^()]*\)[ \t]*)?([A-Za-z_¡-￿]\w*)[ \t]*(?=[(\[]))"),
    "python": re.compile(r"(?m:^[ \t]*(?:async[ \t]+)?def[ \t]+([^\W\d]\w*)[ \t]*(?=[(\[]))"),
}
ISLAND["typescript"] = ISLAND["javascript"]
BEFORE_FUNCTION = re.compile(r"(?:^|[\n;{}])[ \t\r]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?\Z")
HEAD_SIGN, INDENT, BLANKS = re.compile(r"[()\[\]{}:\n]"), re.compile(r"(?m)^([ \t]*)\S"), re.compile(r"[ \t]*")
DOC_STRING = re.compile(r"""[ \t]*(?:[rRuU]?)(\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')""")

# Tool directives, which document nothing.
DIRECTIVE = re.compile(
    r"^\s*(?:(?:eslint|tslint|jshint|jslint|prettier|biome|istanbul|c8|v8|webpack|vite|sonar|codeql|stylelint|cspell|spell-checker|deno-lint|noinspection|region|endregion)\b[-\w]*(?:[ :].*)?|ts-(?:ignore|expect-error|nocheck|check)\b.*|"
    r"(?:noqa|nosec|nolint|nosemgrep|pylint|flake8|mypy|pyright|isort|yapf|fmt|ruff|black|type|pragma|coverage|doctest)\s*:.*|(?:noqa|nosec|nolint|NOSONAR)\s*$|"
    r"(?:go|lint|line|export|extern|cgo|build)[:].*|\+build\b.*|#nosec.*)$",
    re.I,
)
TAG = re.compile(r"^\s*(?:[@\\]\w+|:\w[^:\n]*:).*$")
MARK = re.compile(r"\b(?:TODO|FIXME)\b(?:\([^)]*\))?:?", re.I)
WORDS = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_]+")
ARTICLES = frozenset(("a", "an", "the"))


def trivial(doc: str, name: str) -> bool:
    """Whether a documentation says nothing: fewer than four words, or only the function's name and articles."""
    kept = []
    for line in doc.split("\n"):
        if TAG.match(line) or DIRECTIVE.match(line):
            continue
        kept.append(MARK.sub(" ", line))
    found = WORDS.findall(" ".join(kept))
    if len(found) < 4:
        return True
    own = {p.lower() for p in NAME_PART.findall(name)} | {name.lower()} | ARTICLES
    return all(all(part.lower() in own for part in re.split(r"['’-]", w)) for w in found)


def unwrap(comment: str) -> str:
    """Text of a block or of comment lines without its frame."""
    if comment.startswith("/*"):
        body = comment[2:-2] if comment.endswith("*/") else comment[2:]
        return "\n".join(re.sub(r"^\s*\*+ ?", "", line) for line in body.lstrip("*").split("\n")).strip()
    return "\n".join(re.sub(r"^\s*//[/!]? ?", "", line) for line in comment.split("\n")).strip()


def block_above(text: str, line_start: int) -> str | None:
    """The block comment that ends on the line before ``line_start`` and is the last thing on that line."""
    end = line_start - 1
    while end > 0 and text[end - 1] in " \t\r":
        end -= 1
    if end < 2 or not text.endswith("*/", 0, end):
        return None
    begin = text.rfind("/*", 0, end - 2)
    # A block ends at its first */, so an earlier /* that is still open owns the text.
    while begin > 0 and (earlier := text.rfind("/*", 0, begin)) >= 0 and text.find("*/", earlier + 2, begin) < 0:
        begin = earlier
    return text[begin:end] if begin >= 0 and text.find("*/", begin + 2, end - 2) < 0 else None


def lines_above(text: str, line_start: int) -> str | None:
    """The comment lines directly above ``line_start``."""
    out: list[str] = []
    end = line_start - 1
    while end >= 0:
        begin = text.rfind("\n", 0, end) + 1
        line = text[begin:end].strip()
        if not line.startswith("//"):
            break
        out.append(line)
        end = begin - 1
        if begin == 0:
            break
    return "\n".join(reversed(out)) or None


def python_doc(text: str, mask: str, at: int) -> tuple[str | None, int]:
    """Documentation of the function whose parameters open at ``at``, and the place after its body."""
    end = lexing.balanced(mask, at)
    if mask[at] == "[":
        end = lexing.balanced(mask, mask.find("(", end)) if "(" in mask[end : end + 2] else end
    colon, depth = -1, 0
    for m in HEAD_SIGN.finditer(mask, end):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and not depth:
            colon = m.start()
            break
        elif c == "\n" and not depth:
            break
    if colon < 0:
        return None, end
    head = text.rfind("\n", 0, at) + 1
    # The def may have begun on an earlier line than its parameters' bracket only by a continuation.
    indent = len(mask[head:at]) - len(mask[head:at].lstrip(" \t"))
    body_end = len(text)
    for m in INDENT.finditer(mask, colon + 1):
        if len(m[1]) <= indent:
            body_end = m.start()
            break
    after = colon + 1
    line_end = text.find("\n", after)
    rest = text[after : line_end if line_end >= 0 else len(text)]
    if rest.strip() and not rest.lstrip().startswith("#"):
        m = DOC_STRING.match(text, after)
    else:
        while 0 <= line_end < len(text):
            nxt = text.find("\n", line_end + 1)
            line = text[line_end + 1 : nxt if nxt >= 0 else len(text)]
            if line.strip() and not line.lstrip().startswith("#"):
                break
            line_end = nxt
        if line_end < 0:
            return None, body_end
        if BLANKS.match(text, line_end + 1).end() - line_end - 1 <= indent:
            return None, body_end
        m = DOC_STRING.match(text, line_end + 1)
    if not m:
        return None, body_end
    tail_end = text.find("\n", m.end())
    tail = text[m.end() : tail_end if tail_end >= 0 else len(text)].strip()
    if tail and tail[0] not in "#;":
        return None, body_end  # the string is only part of the statement
    raw = m[1]
    inner = raw[3:-3] if raw[:3] in ('"""', "'''") else raw[1:-1]
    return inner.strip(), body_end


def islands(text: str, language: str) -> Iterator[tuple[str, int, int, int, int, str | None]]:
    """(name, start line, end line, begin, end, documentation) of each function declaration."""
    if text[:1] == "\ufeff":
        text = " " + text[1:]
    pieces: list[str] = []
    if language == "go" and "func" not in text or language == "python" and "def" not in text or language in ("javascript", "typescript") and "function" not in text:
        return
    state = lexing.scan(text, language, "C", pieces, even=True)
    mask = "".join(pieces)
    if len(mask) < len(text):
        # Unsound from here on: what follows is read as code again from the next line.
        rest = text[len(mask) :]
        cut = rest.find("\n") + 1
        mask += lexing.BLANK.sub(" ", rest[:cut]) + rest[cut:] if state.bad and cut else lexing.BLANK.sub(" ", rest) if not state.bad else rest
    line, counted = 1, 0
    for m in ISLAND[language].finditer(mask):
        begin = m.start()
        if language in ("javascript", "typescript"):
            line_at = max(mask.rfind("\n", 0, begin), 0)
            head = BEFORE_FUNCTION.match(mask, max(line_at, *(mask.rfind(c, line_at, begin) for c in ";{}")), begin)
            if not head:
                continue
            begin = head.start() + (len(head[0]) - len(head[0].lstrip("\n;{} \t\r")))
        else:
            begin += len(m[0]) - len(m[0].lstrip(" \t"))
        line += mask.count("\n", counted, begin)
        counted = begin
        line_start = mask.rfind("\n", 0, begin) + 1
        at = m.end()
        if language == "python":
            doc, end = python_doc(text, mask, at)
            lines = text[begin:end].split("\n")
            while len(lines) > 1 and (not lines[-1].strip() or lines[-1].lstrip().startswith("#")):
                lines.pop()
            end = begin + len("\n".join(lines))
        else:
            if mask[at] == "<":
                at = mask.find("(", at)
                if at < 0:
                    continue
            elif mask[at] == "[":
                at = lexing.balanced(mask, at)
            after = lexing.balanced(mask, at)
            if language == "go":
                line_end = mask.find("\n", after)
                brace_at = mask.find("{", after, line_end if line_end >= 0 else len(mask))
                end = lexing.balanced(mask, mask.rfind("{", after, line_end if line_end >= 0 else len(mask))) if brace_at >= 0 else after
                comment = block_above(text, line_start)
                if comment is None:
                    comment = lines_above(text, line_start)
            else:
                brace = lexing.body_brace(mask, after)
                if brace < 0:
                    continue  # a signature without a body declares no function
                end = lexing.balanced(mask, brace)
                comment = block_above(text, line_start) if not mask[line_start:begin].strip() else None
                if comment is not None and (not comment.startswith("/**") or comment.startswith("/**/")):
                    comment = None
            doc = unwrap(comment) if comment is not None else None
        code = text[begin:end].rstrip()
        yield m[1], line, line + code.count("\n"), begin, begin + len(code), doc


def documented_functions(files: DataFrame) -> DataFrame:
    """(file_id, language, name, start_line, end_line, code, documentation) of every function that says what it does."""
    language = F.coalesce(F.lower("language"), language_of(F.col("path")))
    source = files.select(F.col("id").cast("bigint").alias("file_id"), language.alias("language"), "content").filter(F.col("language").isin(*LANGUAGES) & F.col("content").isNotNull())

    def kernel(columns: list[list]):
        for i, language, text in zip(*columns):
            for name, start, end, begin, stop, doc in islands(text, language):
                if doc is not None and not trivial(doc, name):
                    yield i, language, name, start, end, text[begin:stop], doc

    return map_rows(spread(source), ["file_id", "language", "content"], kernel, "file_id bigint, language string, name string, start_line bigint, end_line bigint, code string, documentation string")


def _symbols(symbols: DataFrame) -> DataFrame:
    return symbols.filter("kind = 'function'").select(F.col("file_id").cast("bigint").alias("file_id"), "name", F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("symbol_end_line")).distinct()


def documented_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, name, start_line): function symbols that the content bears out and whose documentation isn't trivial."""
    # The islands are narrow rows, so the shuffle carries no file content.
    found = documented_functions(files).select("file_id", "name", "start_line")
    return found.join(_symbols(symbols).drop("symbol_end_line"), ["file_id", "name", "start_line"], "left_semi").distinct()


def code_description_pairs(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, language, name, start_line, end_line, code, documentation) of those symbols."""
    keys = _symbols(symbols).drop("symbol_end_line").distinct()
    return documented_functions(files).join(keys, ["file_id", "name", "start_line"], "left_semi").dropDuplicates(["file_id", "name", "start_line"])
