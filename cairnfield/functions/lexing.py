"""Lexer states, bracket summaries and tokens of source text, shared by the operators on code.

``scan`` reads one chunk from a known lexer state and returns the state it ends in with a summary of its brackets:
the closers that nothing in the chunk opened and the openers that nothing in it closed. Two summaries in a row combine
associatively (``join``). A chunk whose start state isn't known is represented by ``state_map``: the summary for every
state in which a line can begin. A summary carries the chunk's mask for its start state, so that the masks of chunks in
a row make up the mask of the text.

States: C code, B block comment, T template text, R raw string, D and S triple-quoted strings, m and q strings of many
lines, H a documentation block. Chunks are cut after line ends, never after a backslash, so that no other string
is carried from chunk to chunk.
"""

from __future__ import annotations

import re
from typing import NamedTuple

OPEN = {")": "(", "]": "[", "}": "{", "`": "`"}
#: Conflict markers stand alone on their line; these never begin a line of code in the languages here.
MARK = r"(?m:^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$))"
#: Characters no language here allows outside of strings and comments.
ALIEN = r"[\x00-\x08\x0e-\x1f\x7f‘-‟�]"
DQ = r'"(?:[^"\\\n]|\\(?:\r\n|[\s\S]))*+"'
SQ = r"'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*+'"
# Python's formatted strings may hold their own quotes inside of braces.
FSTRING = "|".join(rf"(?<![\w])(?i:fr?|rf){q}(?!{q}{q})(?:[^{q}\\\n{{]|\\[\s\S]|\{{\{{|\{{(?:[^{{}}\n{q}]|{q}[^{q}\n]*{q}|\{{[^{{}}\n{q}]*\}})*+\}})*+{q}" for q in "\"'")
DQ_ML = r'"(?:[^"\\]|\\[\s\S])*+"'
LINE, BLOCK = r"//[^\n]*", r"/\*[\s\S]*?\*/"
# A word, a number's rest or a closer before a slash makes it a division.
OPERAND_BEFORE = re.compile(r"(?:[\w$)\]}\"'`]|\+\+|--)[ \t]*$")
REGEX_WORDS = re.compile(r"(?:^|[^\w$.])(?:return|typeof|case|in|of|do|else|void|delete|instanceof|new|throw|yield|await)[ \t]*$")
REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[A-Za-z]*")

_SCAN = {
    "javascript": rf"{LINE}|{BLOCK}|{DQ}|{SQ}|[(){{}}\[\]`]|/\*?|[\"']|{MARK}|{ALIEN}",
    "go": rf"{LINE}|{BLOCK}|{DQ}|'(?:\\[^\n']+|\\'|[^'\\\n])'|`[^`]*`|[(){{}}\[\]]|/\*|[\"'`]|{MARK}|{ALIEN}",
    "java": rf"{LINE}|{BLOCK}|\"\"\"[\s\S]*?(?<!\\)\"\"\"|\"\"\"|{DQ}|{SQ}|[(){{}}\[\]]|/\*|[\"']|{MARK}|{ALIEN}",
    "c": rf"{LINE}|{BLOCK}|(?m:^[ \t]*#(?:[^\n\\]|\\\r?\n|\\.)*)|{DQ}|{SQ}|[(){{}}\[\]]|/\*|[\"']|{MARK}|{ALIEN}",
    "rust": rf"{LINE}|{BLOCK}|b?r(#*)\"[\s\S]*?\"\1|{DQ_ML}|b?'(?:\\(?:x\w\w|u\{{\w+\}}|.)|[^'\\\n])'|'(?=[A-Za-z_])|[(){{}}\[\]]|/\*|[\"']|{MARK}|{ALIEN}",
    "ruby": rf"#[^\n]*|(?m:^=begin\b(?:[\s\S]*?^=end\b)?)|{DQ_ML}|'(?:[^'\\]|\\[\s\S])*+'|(?<!\S)%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}})|[(){{}}\[\]]|[\"']|{MARK}|{ALIEN}",
    "python": rf"#[^\n]*|{FSTRING}|\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''|\"\"\"|'''|{DQ}|{SQ}|[(){{}}\[\]]|[\"']|{MARK}|{ALIEN}",
}
_SCAN["typescript"] = _SCAN["javascript"]
_SCAN["cpp"] = _SCAN["c"]
SCAN = {k: re.compile(v) for k, v in _SCAN.items()}
LANGUAGES = frozenset(SCAN)

#: How each state that a chunk can begin in ends.
RESUME = {
    "B": re.compile(r"\*/"),
    "R": re.compile(r"`"),
    "D": re.compile(r'(?<!\\)"""'),
    "S": re.compile(r"(?<!\\)'''"),
    "m": re.compile(r'(?:[^"\\]|\\[\s\S])*+"'),
    "q": re.compile(r"(?:[^'\\]|\\[\s\S])*+'"),
    "H": re.compile(r"(?m)^=end\b"),
}
STATES = {"javascript": "CBT", "typescript": "CBT", "go": "CBR", "java": "CBD", "c": "CB", "cpp": "CB", "rust": "CBm", "ruby": "CmqH", "python": "CDS"}
TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{)")


BLANK = re.compile(r"[^\r\n]")


class Summary(NamedTuple):
    """What a chunk does from one start state; ``clear`` is false if only a scan of what precedes it can tell."""

    end: str
    closers: str
    openers: str
    bad: bool
    clear: bool
    mask: str = ""


def _opens(language: str, text: str, at: int) -> str:
    """State in which text[at:], an unfinished literal or comment, leaves the chunk; '' if it can't go on."""
    if text.startswith("/*", at):
        return "B"
    if language == "ruby" and text[at] == "=":
        return "H"
    if text.startswith('"""', at):
        return "D" if language in ("python", "java") else ""
    if text.startswith("'''", at):
        return "S" if language == "python" else ""
    if text[at] == "`":
        return "R" if language == "go" else ""
    if language in ("rust", "ruby") and text[at] == '"':
        return "m"
    if language == "ruby":
        return "q"
    return ""


def scan(text: str, language: str, state: str = "C", mask: list[str] | None = None, even: bool = False, within: str = "") -> Summary:
    """Lexer state and brackets of a chunk of text that is read from ``state``, inside of the open brackets ``within``.

    ``mask`` receives the chunk in pieces without comments (a blank, or a line end if they have one) and with empty
    literals: `` for raw strings and templates, "" for other strings and regular expressions. With ``even`` the pieces
    keep their length and their line ends instead, so that places in the mask are places in the chunk.
    """
    at, kept = 0, 0
    stack: list[str] = list(within)
    closers: list[str] = []
    # Depth of the template whose text and inner code the mask leaves out; a template that an earlier chunk opened
    # counts as one more level if the brackets around this chunk aren't known.
    beyond = 1 if state == "T" and "`" not in within else 0
    inside = within.index("`") + 1 if "`" in within else beyond
    find = SCAN[language]
    template = language in ("javascript", "typescript")
    hash_comment = language in ("python", "ruby")

    def unfinished(start: int) -> Summary:
        going = _opens(language, text, start)
        if going and mask is not None and not inside:
            mask.append(text[kept:start])
            if even:
                mask.append(BLANK.sub(" ", text[start:]))
        return Summary(going or "C", "".join(closers), "".join(stack), not going, True)

    if state == "T":
        stack_mode = True
    else:
        stack_mode = False
        if state != "C":
            m = RESUME[state].match(text) if state in "mq" else RESUME[state].search(text)
            if not m:
                if mask is not None and even:
                    mask.append(BLANK.sub(" ", text))
                return Summary(state, "", "".join(stack), False, True)
            at = kept = m.end()
            if mask is not None:
                mask.append(BLANK.sub(" ", text[:at]) if even else "\n" if state in "BH" else "``" if state == "R" else '""')
    while True:
        if stack_mode:
            m = TEMPLATE.match(text, at)
            if not m:
                return Summary("T", "".join(closers), "".join(stack), False, True)
            at = m.end()
            if m[1] == "`":
                if mask is not None and inside == len(stack) + beyond:
                    mask.append(BLANK.sub(" ", text[kept:at]) if even else "``")
                    kept, inside = at, 0
                if stack:
                    stack.pop()
                else:
                    closers.append("`")
                    beyond = 0
            else:
                stack.append("$")
            stack_mode = m[1] == "`" and bool(stack) and stack[-1] == "`"
            if stack_mode:
                continue
        jumped = False
        for m in find.finditer(text, at):
            tok = m[0]
            c = tok[0]
            if len(tok) == 1 and c != "#":
                if c in "([{":
                    stack.append(c)
                    continue
                if c in ")]}":
                    if not stack:
                        closers.append(c)
                        continue
                    top = stack.pop()
                    if top == OPEN[c]:
                        continue
                    if top == "$" and c == "}":
                        at, stack_mode, jumped = m.end(), True, True
                        break
                    return Summary("C", "".join(closers), "", True, True)
                if c == "`" and template:
                    stack.append("`")
                    if mask is not None and not inside:
                        mask.append(text[kept : m.start()])
                        kept, inside = m.start(), len(stack) + beyond
                    at, stack_mode, jumped = m.end(), True, True
                    break
                if c == "/":
                    before = text[max(0, m.start() - 24) : m.start()].rpartition("\n")[2]
                    if not OPERAND_BEFORE.search(before) or REGEX_WORDS.search(before):
                        r = REGEX.match(text, m.start())
                        if r:
                            at, jumped = r.end(), True
                            if mask is not None and not inside:
                                mask += (text[kept : m.start()], " " * (at - m.start()) if even else '""')
                                kept = at
                            break
                    continue
                if c in "\"'`":
                    if c == "'" and language == "rust":
                        continue
                    return unfinished(m.start())
                return Summary("C", "".join(closers), "", True, True)
            if tok in ("/*", '"""', "'''", "=begin"):
                return unfinished(m.start())
            if c in "<=>|" and not (c == "=" and language == "ruby" and tok.startswith("=begin")):
                return Summary("C", "".join(closers), "", True, True)
            if mask is not None and not inside:
                if c == "#" and not hash_comment or c == "'" and tok[-1] != "'":
                    continue
                mask.append(text[kept : m.start()])
                kept = m.end()
                if even:
                    mask.append(BLANK.sub(" ", tok))
                elif c in "/#=":
                    mask.append("\n" if "\n" in tok else " ")
                else:
                    mask.append("``" if c == "`" else '""')
        if not jumped:
            if mask is not None and not inside:
                mask.append(text[kept:])
            return Summary("C", "".join(closers), "".join(stack), False, True)


def summary(text: str, language: str, state: str = "C", within: str = "") -> Summary:
    """Summary of a chunk read from ``state``, with its mask; Python's keeps all places, as its statements are cut out."""
    mask: list[str] = []
    return scan(text, language, state, mask, even=language == "python", within=within)._replace(mask="".join(mask))


UNCLEAR = Summary("C", "", "", False, False)


def state_map(text: str, language: str, first: bool = False) -> dict[str, Summary]:
    """Summaries of a chunk for each state it can begin in; a text's first chunk begins in code."""
    out = {s: summary(text, language, s) for s in ("C" if first else STATES[language])}
    if not first and language in ("javascript", "typescript"):
        # A brace that closes more than the chunk opened may end a template's code: what follows is text, not wrong code.
        out = {s: UNCLEAR if x.bad and "}" in x.closers else x for s, x in out.items()}
    return out


def join(a: Summary, b: dict[str, Summary]) -> Summary:
    """Summary of a chunk followed by another, of which all states are known."""
    if a.bad or not a.clear:
        return a
    # Code inside of a template's braces: where it ends, and that it isn't part of the mask, only the template's chunk knows.
    nxt = UNCLEAR if "$" in a.openers else b.get(a.end, UNCLEAR)
    if nxt.bad or not nxt.clear:
        return nxt
    openers, closers = list(a.openers), list(a.closers)
    for c in nxt.closers:
        if not openers:
            closers.append(c)
        elif openers.pop() != OPEN[c]:
            return Summary("C", "", "", True, True)
    return Summary(nxt.end, "".join(closers), "".join(openers) + nxt.openers, False, True, a.mask + nxt.mask)


def join_maps(a: dict[str, Summary], b: dict[str, Summary]) -> dict[str, Summary]:
    """Maps of two chunks in a row as the map of both; associative."""
    return {s: join(x, b) for s, x in a.items()}


def follow(a: Summary, b: dict[str, Summary], text: str, language: str) -> Summary:
    """``join``, with the text of the second chunk at hand: what its map can't tell is read from the known state."""
    both = join(a, b)
    if both.clear or not a.clear:
        return both
    nxt = summary(text, language, a.end, within=a.openers)
    return nxt if nxt.bad else Summary(nxt.end, a.closers + nxt.closers, nxt.openers, False, True, a.mask + nxt.mask)


def chunks(text: str, size: int) -> list[str]:
    """A text cut after line ends, none after a backslash, into chunks of about ``size`` characters (a longer line stays whole)."""
    out, at = [], 0
    while len(text) - at > size:
        end = at + size
        while (end := text.rfind("\n", at, end)) > at and text.endswith(("\\", "\\\r"), at, end):
            pass
        if end <= at:
            end = at + size - 1
            while (end := text.find("\n", end + 1)) >= 0 and text.endswith(("\\", "\\\r"), at, end):
                pass
            if end < 0:
                break
        out.append(text[at : end + 1])
        at = end + 1
    if at < len(text):
        out.append(text[at:])
    return out or [""]


BRACKET = re.compile(r"[()\[\]{}]")


def balanced(mask: str, at: int) -> int:
    """Place after the bracket that closes the one at ``at``; the text's end if none does."""
    depth = 0
    for m in BRACKET.finditer(mask, at):
        if m[0] in "([{":
            depth += 1
        else:
            depth -= 1
            if depth <= 0:
                return m.end()
    return len(mask)


def body_brace(mask: str, at: int) -> int:
    """Place of the brace that opens the body after parameters that end at ``at``; -1 if there is no body."""
    first = at
    while True:
        m = re.compile(r"[{;\n]").search(mask, at)
        if not m:
            return -1 if mask[first:].strip() else len(mask)
        if m[0] == ";":
            return -1
        before = mask[first : m.start()].rstrip()
        if m[0] == "\n":
            if before and before[-1] not in ":|&<,(>" and not mask[m.end() :].lstrip().startswith(("{", "|", "&")):
                return -1
            at = m.end()
        elif before and (before[-1] in ":|&<,(" or before.endswith("=>")):
            at = balanced(mask, m.start())  # a type made of braces
        else:
            return m.start()
