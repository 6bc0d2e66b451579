"""Local grammars: what a balanced statement of a language can't contain.

They read text whose comments are blanks and whose literals are empty (``lexing.scan`` makes it), so each rule is a
regular expression over a statement or its border. A text that no rule objects to is taken as valid.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

NAME = r"[A-Za-z_$\u00a1-\uffff][\w$]*+"
#: No binary operator or keyword that expects more may end a text.
OPEN_END = r"(?:[=%&|^,.?:\\(\[]|(?<![-+])[-+]|(?<![\w$.])(?:{words}))\s*\Z"

# Keywords of the languages.
JS_LEFT = "abstract|accessor|as|async|await|case|class|const|default|delete|do|else|enum|export|extends|finally|for|from|function|get|if|implements|import|in|instanceof|interface|let|new|of|return|set|static|throw|try|type|typeof|var|void|while|yield"
TS_LEFT = JS_LEFT + "|asserts|declare|global|infer|is|keyof|module|namespace|override|private|protected|public|readonly|satisfies|unique|out"
TS_ONLY = "abstract|enum|implements|interface|type"
JS_RIGHT = "as|else|extends|from|in|instanceof|of|while"
TS_RIGHT = JS_RIGHT + "|implements|is|satisfies|keyof"


SIDE_BY_SIDE = re.compile(r"([\w$]++)[ \t]+(?=([\w$]+|\"))")


def _script(ts: bool) -> Callable[[str], bool]:
    left = TS_LEFT if ts else "|".join(w for w in JS_LEFT.split("|") if w not in TS_ONLY.split("|"))
    right = TS_RIGHT if ts else JS_RIGHT
    after_const = r"[=:!]|in\b|of\b" if ts else r"=(?![=>])|in\b|of\b"
    clause = rf"(?:{NAME}|\*\s*as\s+{NAME}|\{{[^{{}}]*\}})"
    # A rule applies only to texts that have its needle, so most texts skip most rules.
    rules: list[tuple[str, str]] = [
        # An operand next to an operand on one line.
        ('"', rf"(?:\"\"|``)[ \t]*(?!(?:{right})\b)[\w$\"]"),
        ('"', r"\b(?!(?:" + left + r")\b)[\w$]++\"\""),
        ("]", rf"\][ \t]*(?!(?:{right})\b)[\w$\"]"),
        (")", r"\)[ \t]*[\d\"]"),
        # Keywords and what must follow them.
        *((w, rf"{w}(?<![\w$.]{w})\b(?!\s*[(:=,)}}?;])") for w in ("if", "while", "switch", "with")),
        ("for", r"for(?<![\w$.]for)\b(?!\s*(?:await\s*)?[(:=,)}?;])"),
        *((w, rf"{w}(?<![\w$.]{w})\b(?!\s*[{{:=,)}}?;(])") for w in ("try", "finally")),
        ("catch", r"catch(?<![\w$.]catch)\b(?!\s*[{(:=,)}?;])"),
        ("const", rf"const(?<![\w$.<]const)(?<!as const)\s++(?!enum\b)[\w$]++\s*+(?!{after_const})"),
        ("const", r"const(?<![\w$.<]const)(?<!as const)\b(?!\s*[\w${\[:=,)};>])"),
        ("class", rf"class(?<![\w$.]class)\s++{NAME}\s*+(?!\{{|extends\b{'|implements' + chr(92) + 'b|<' if ts else ''})"),
        ("function", r"function(?<![\w$.]function)\b(?!\s*\*?\s*(?:" + NAME + r"\s*)?" + (r"(?:<[^()]*(?:\([^()]*\)[^()]*)*>\s*)?" if ts else "") + r"[(:=,)}?;])"),
        ("import", rf"import(?<![\w$.]import)\b(?!\s*[.(:=])(?!\s*(?:type\s+)?(?:{clause}(?:\s*,\s*{clause})?\s*from\s*)?\"\")" + (rf"(?!\s*(?:type\s+)?{NAME}\s*=)" if ts else "")),
        ("export", r"export(?<![\w$.]export)\b(?!\s*(?:default|const|let|var|function|class|async|[{*:=,)}?]" + ("|type|interface|enum|abstract|declare|namespace|module|import|as|@" if ts else "") + "))"),
        # Operators without an operand.
        ("=", r"=(?<![<>=!+\-*/%&|?^]=)(?>===?|(?!>))\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("!=", r"!==?\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("&&", r"&&\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("||", r"\|\|\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("??", r"\?\?\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("%", r"%=?\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("=", r"[-+*/]=\s*(?:[)\]},;%]|==|&&|\|\||\?\?)"),
        ("=>", r"=>\s*[)\]},;=]"),
        (".", r"\.(?<![\d.]\.)\s*[)\]};,=]"),
        ("", r"[(\[{,]\s*(?:=(?!>)|&&|\|\||\?\?|%|\.(?![.\d]))"),
        ("(", r"\(\s*,"),
        (")", rf"[=+/%&|?,(\[:{'' if ts else '<>!'}]\s*\(\s*\)(?!\s*(?:=>{'|:' if ts else ''}))"),
        ("#", r"#(?![A-Za-z_$!])"),
        ("<", r"\A\s*<"),
    ]
    if not ts:
        rules += [
            (":", r"function\s*\*?\s*[\w$]*\s*\((?:[^(){}:?]|\{[^{}]*\})*[\w$\]}]\s*\??:"),
            (":", r"(?m:^[ \t]*(?:static\s+)?(?:async\s+)?(?!(?:if|for|while|switch|catch|return)\b)[\w$]+\s*\((?:[^(){}:?]|\{[^{}]*\})*[\w$\]}]\s*\??:[^()]*\)\s*(?::[^{;\n]*)?\{)"),
            (":", r"(?m:\)\s*:\s*[A-Za-z_][\w$<>\[\]., |]*\{[ \t\r]*$)"),
            (":", r"(?:const|let|var)\s+[\w$]+\s*:"),
            ("", r"(?m:^[ \t]*(?:export\s+)?(?:(?:interface|enum|namespace)\s+[\w$]+[^\n(]*\{|type\s+[\w$]+\s*(?:<[^=\n]*>\s*)?=|declare\s+\w|abstract\s+class))"),
        ]
    words = "const|let|var|import|export|function|class|new|typeof|extends|from|if|for|while|else|try|case|in|of|instanceof|delete|void|await"
    ends = re.compile(OPEN_END.format(words=words + ("|interface|type|implements" if ts else "")))
    compiled = [(needle, re.compile(r)) for needle, r in rules]
    lefts, rights = frozenset(left.split("|")), frozenset(right.split("|"))

    def objects(masked: str) -> bool:
        if any(a not in lefts and b not in rights for a, b in set(SIDE_BY_SIDE.findall(masked))):
            return True
        return any(needle in masked and rule.search(masked) for needle, rule in compiled) or bool(ends.search(masked[-200:].lstrip("\n")))

    return objects


GO = re.compile(
    "|".join([
        r"(?m:^[ \t]*(?:if|for|switch|select)\b(?![^\n]*\{)(?![^\n]*[(,][ \t]*$))",
        r"(?m:^[ \t]*\}?[ \t]*else\b(?![ \t]*(?:\{|if\b)))",
        r"(?<![\w.])func\b(?!\s*(?:\([^()]*\)\s*)?(?:\w+\s*)?[(\[])",
        r"(?<![\w.])(?!(?:return|case|import|range|map|chan|go|defer|const|var|type|else|func)\b)[A-Za-z_]\w*+[ \t]+[\d\"](?!\"\s*$)",
        r"\"\"[ \t]*[\w\"]",
        r"(?<![\w.])\d[\w.]*+[ \t]+[\w\"]",
        r"\)[ \t]*[\d\"]",
        r"(?<![<>=!+\-*/%&|^:])(?>==|!=|&&|\|\||[-+*/%:]=|=|%)\s*(?:[)\]},;%]|==|&&|\|\|)",
        r"[(\[,]\s*(?:=|&&|\|\||%|,)",
        r"(?<![\d.])\.\s*[)\]};,=]",
        r"[#?@$\\~](?!=)|=>|===|(?<![\w.])(?:def|elif|lambda|let|export|async|await|class|public|fn|pub)[ \t]+\w",
        r"(?m:^[ \t]*(?:var|const|type)[ \t]*$)",
        r"(?m:^[ \t]*(?:var|const|type)[ \t]+\w+[ \t]*$(?!\s*=))",
        OPEN_END.format(words="package|import|func|var|const|type|if|for|else|return(?=x)|range|go|defer"),
    ])
)
GO_TOP = re.compile(r"(?:package|import|func|var|const|type)\b|[);}]")
JAVA = re.compile(
    "|".join([
        r"(?<![\w.])(?:if|while|for|switch)\b(?!\s*\()",
        r"(?<![\w.$])(?!(?:return|case|throw|else|default|yield|assert|instanceof)\b)[A-Za-z_]\w*+[ \t]+[\d\"]",
        r"\"\"[ \t]*[\w\"]",
        r"(?<![\w.])\d[\w.]*+[ \t]+[\w\"]",
        r"[)\]][ \t]*[\d\"]",
        r"(?<![<>=!+\-*/%&|^:])(?>==|!=|&&|\|\||[-+*/%]=|=|%)\s*(?:[)\]};%]|==|&&|\|\|)",
        r"[(\[{,]\s*(?:=|&&|\|\||%)|\(\s*,|,\s*\)",
        r"(?<![\d.])\.\s*[)\]};,=]",
        r"[#`\\$]|=>|===|:=|(?<![\w.])(?:def|elif|lambda|let|export|function|fn|pub|async|func)[ \t]+\w",
        # A statement that ends in no semicolon before a block's end or before another statement.
        r"[\w)\]\"]\s*\n\s*(?:return|throw|break|continue|if|for|while|int|char|String|try)\b(?<!\)\s)",
        r"\):[ \t\r]*(?:\n|\Z)",
        OPEN_END.format(words="package|import|class|new|return|throw|public|private|static|extends|implements"),
    ])
)
JAVA_TOP = re.compile(r"(?:package|import|class|interface|enum|record|public|private|protected|final|abstract|sealed|non-sealed|strictfp|static|open|module|extends|implements|permits|throws)\b|[@;}{)]|[\w.<>, ]+\{")
C = re.compile(
    "|".join([
        r"(?<![\w.])(?:if|while|for|switch)\b(?!\s*\()",
        r"(?<![\w.$])(?!(?:return|case|else|sizeof|goto|extern|u8|L|u|U)\b)[A-Za-z_]\w*+[ \t]+[\d\"](?!\"\w)",
        r"\"\"[ \t]*(?![A-Z_])[\w]",
        r"(?<![\w.])\d[\w.]*+[ \t]+[\w\"]",
        r"\][ \t]*[\w\"]|\)[ \t]*[\d\"]",
        r"(?<![<>=!+\-*/%&|^:])(?>==|!=|&&|\|\||[-+*/%]=|=|%)\s*(?:[)\]};%]|==|&&|\|\|)",
        r"[(\[,]\s*(?:=|\|\||%)|\(\s*,|,\s*\)",
        r"[`@$\\]|=>|===|:=|(?<![\w.])(?:def|elif|lambda|let|export|function|fn|pub|async|func|package|import|from)[ \t]+[\w\"]",
        r"(?<![\w.])(?!(?:static|const|unsigned|signed|struct|enum|union|extern|inline|volatile|register|long|short|typedef|restrict|return|else|void|int|char|float|double)\b)[A-Za-z_]\w*+[ \t]+(?!(?:const|restrict)\b)[A-Za-z_]\w*+[ \t]+[A-Za-z_]",
        r"\):[ \t\r]*(?:\n|\Z)",
        r"\A\s*<",
        r"(?<![;}\s])\s*\Z",
    ])
)
RUST = re.compile(
    "|".join([
        r"(?<![\w.])(?:if|while|match|loop)\b(?![^;{}]*\{)",
        r"(?<![\w.])for\b(?!\s*<)(?![^;{}]*\{)",
        r"(?<![\w.'])(?!(?:as|async|await|break|const|crate|default|dyn|else|enum|extern|fn|for|if|impl|in|let|loop|match|mod|move|mut|pub|ref|return|static|struct|super|trait|type|union|unsafe|use|where|while|yield|raw)\b)[A-Za-z_]\w*+[ \t]+(?!(?:as|else|for|in|if|where)\b)[\w\"]",
        r"\"\"[ \t]*(?!(?:as|if)\b)[\w\"]",
        r"(?<![\w.])\d[\w.]*+[ \t]+(?!(?:as|if|else)\b)[\w\"]",
        r"\][ \t]*(?!as\b|where\b|pub\b|fn\b|struct\b|impl\b|enum\b|const\b|static\b|type\b|trait\b|mod\b|use\b|unsafe\b|if\b|for\b)[\w\"]|\)[ \t]*[\d\"]",
        r"(?<![<>=!+\-*/%&|^.])(?>==|!=|&&|[-+*/%]=|=(?!>)|%)\s*(?:[)\]};%]|==|&&)",
        r"[(\[{,]\s*(?:=(?!>)|%)|\(\s*,",
        r"(?<![\d.])\.\s*[)\]};,=]",
        r"`|\\|===|:=|(?<![\w.])(?:def|elif|lambda|export|function|class|func|package|import|from|var|int|public)[ \t]+\w",
        r"[\w)\]\"]\s*\n\s*(?:let|return|for|while)\b",
        OPEN_END.format(words="fn|let|mut|use|pub|struct|enum|impl|mod|return(?=x)|if|else|for|in|match"),
    ])
)
RUST_TOP = re.compile(r"(?:use|pub|fn|struct|enum|impl|mod|trait|const|static|type|extern|unsafe|async|macro_rules|union|where|default)\b|[#})\];{>]|[\w:]+!|->")
RUBY = re.compile(
    "|".join([
        r"(?<![\w.@$:?!])(?!(?:if|unless|while|until|and|or|not|in|do|then|else|elsif|when|case|return|def|class|module|rescue|ensure|yield|raise|puts|begin|end|super|alias|undef|private|public|protected|defined)\b)[a-z_]\w*+[ \t]+(?!(?:if|unless|while|until|and|or|not|in|do|then|rescue)\b)[A-Za-z_]\w*+[ \t]+(?!(?:if|unless|while|until|and|or|not|in|do|then|rescue)\b)[A-Za-z_\"]",
        r"(?<![\w.])\d[\w.]*+[ \t]+(?!(?:if|unless|while|until|and|or|in|do|then|rescue)\b)[\w\"]",
        r"\"\"[ \t]*(?!(?:if|unless|while|until|and|or|in|do|then|rescue|for)\b)[A-Za-z_\d]",
        r"[)\]][ \t]*(?!(?:if|unless|while|until|and|or|in|do|then|rescue|end)\b)[\w\"]",
        r"(?m:[^:\s]:[ \t\r]*$)",
        r"(?<![\w.])for\b(?![^\n]*\bin\b)",
        r"(?<![<>=!+\-*/%&|^~])(?>===?|!=|&&|\|\|(?!\s*[\w]+\s*\|)|[-+*/]=|=)\s*(?:[)\]},;%](?![wWiIqQ])|==|&&)",
        r"[(\[,]\s*(?:=(?!>)|&&|%(?![wWiIqQ]))|\(\s*,",
        r"=>\s*[)\]},;]",
        r"`|\\(?!\r?\n)|:=|===\s*\d|(?m:^[ \t]*[<>=%,)](?!=begin|=end))",
        r"(?<![\w.])(?:function|export|import|from|const|let|var|fn|pub|func|package|elif|lambda[ \t]+\w+:|public[ \t]+(?:static|class)|static|int|async)[ \t]+[\w{*\"]",
        r"\A\s*<",
        OPEN_END.format(words="def|class|module|if|unless|while|until|case|when|and|or|not|else(?=x)"),
    ])
)
RUBY_BLOCKS = re.compile(
    r"(?<![\w.@$:])(?:(end)(?![\w?!:=])|(def|class|module|begin|case)(?![\w?!:])|(do)(?![\w?!:])|(?:(?m:(?<=^)|(?<=\n))|(?<=[=(,;|]))?[ \t]*(?<![\w.@$:])(if|unless|while|until|for)(?![\w?!:]))"
)

BRACES = re.compile(r"\{[^{}]*\}")
PARENS = re.compile(r"\([^()]*\)")


def flat(masked: str) -> str:
    """Text at depth 0: what braces and parentheses hold is dropped, from the inside out."""
    for pattern, empty in ((PARENS, "\x01"), (BRACES, "\x02")):
        while True:
            masked, n = pattern.subn(empty, masked)
            if not n:
                break
    return masked.replace("\x01", "()").replace("\x02", "{}")


def _tops(masked: str, allowed: re.Pattern) -> bool:
    return all(allowed.match(line) for line in map(str.strip, flat(masked).split("\n")) if line)


def _go(masked: str) -> bool:
    body = masked.lstrip()
    if not re.match(r"package[ \t]+\w+[ \t]*(?:;|\r?\n|\Z)", body):
        return False
    if re.search(r"(?m:^import\b(?!\s*(?:\(|(?:[\w.]+[ \t]+)?(?:\"\"|``))))", body):
        return False
    plain = re.sub(r"(?m)^import\s*(?:\([^()]*\)|[^\n]*)", "", body)
    return not GO.search(plain) and _tops(plain, GO_TOP)


def _semicolons(masked: str) -> bool:
    """Every statement of a block ends in a semicolon; array initialisers and enumerations hold none."""
    for m in re.finditer(r"[\w)\]\"]\s*\}", masked):
        depth, at = 0, m.end() - 1
        while at > 0:
            at -= 1
            c = masked[at]
            if c == "}":
                depth += 1
            elif c == "{":
                if not depth:
                    break
                depth -= 1
        head = masked[max(0, at - 200) : at].rstrip()
        if head.endswith(("=", "]", ",", "{", "(")) or re.search(r"(?:\benum\b[^;{}]*|->|@\w+)\Z", head):
            continue
        return False
    return True


def _ruby(masked: str) -> bool:
    if RUBY.search(masked):
        return False
    depth = 0
    for line in re.split(r"[\n;]", masked):
        loop = False
        for m in re.finditer(r"(?<![\w.@$:])(end|def|class|module|begin|case|do|if|unless|while|until|for)(?![\w?!:]|[ \t]*=[^=~>])", line):
            word, before = m[1], line[: m.start()].rstrip()
            if word == "end":
                depth -= 1
                if depth < 0:
                    return False
            elif word in ("if", "unless", "while", "until", "for"):
                if not before or before[-1] in "=(|{" or before.endswith((" then", " do", " else", "begin")):
                    depth += 1
                    loop = word in ("while", "until", "for")
            elif word == "do":
                depth += not loop
                loop = False
            elif word == "def" and re.match(r"\s+[\w.?!]+(?:\([^()]*\))?\s*=\s", line[m.end() :]):
                pass
            elif word == "class" and line[m.end() :].lstrip().startswith("<<") or word != "class" or not before:
                depth += 1
    return depth == 0


# Clauses that go on with the statement before them.
CLAUSE = re.compile(r"(?:elif|else|except|finally)\b")


def python_statements(text: str, mask: str) -> Iterator[str]:
    """The balanced top-level statements of a text; the mask keeps its places and blanks its literals and comments."""
    begin = at = depth = 0
    decorated = False
    while at < len(text):
        # A line of the first column begins a statement unless a bracket or a backslash holds the one before open.
        if at and mask[at] not in " \t\r\n\f" and not depth and not CLAUSE.match(mask, at) and not decorated and not mask.endswith(("\\\n", "\\\r\n"), begin, at):
            yield text[begin:at]
            begin = at
        end = mask.find("\n", at) + 1 or len(text)
        decorated = not depth and mask[at] == "@" or decorated and (depth > 0 or not mask[at:end].strip() or mask[at] in " \t")
        depth += sum(mask.count(c, at, end) for c in "([{") - sum(mask.count(c, at, end) for c in ")]}")
        at = end
    yield text[begin:]


def valid_python(text: str, mask: str) -> bool:
    """Whether each statement parses; one nested too deeply for the parser counts as what its brackets say, valid."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for statement in python_statements(text, mask):
            try:
                ast.parse(statement)
            except (SyntaxError, ValueError):
                return False
            except (RecursionError, MemoryError):
                continue
    return True


JS, TS = _script(False), _script(True)


def valid_statements(masked: str, language: str) -> bool:
    """Whether the statements of a balanced text, as ``lexing.scan`` masks it, could be of the language."""
    if not masked.strip():
        return True
    if language == "javascript":
        return not JS(masked)
    if language == "typescript":
        return not TS(masked)
    if language == "go":
        return _go(masked)
    if language == "java":
        return not JAVA.search(masked) and _tops(masked, JAVA_TOP) and _semicolons(masked)
    if language in ("c", "cpp"):
        masked = re.sub(r"(?m)^[ \t]*#[ \t]*(?:include|define|undef|ifn?def|if|elif|else|endif|error|warning|pragma|line)\b(?:[^\n\\]|\\\r?\n|\\.)*", "", masked)
        return not masked.strip() or ("#" not in masked and not C.search(masked) and _semicolons(masked))
    if language == "rust":
        return not RUST.search(masked) and _tops(masked, RUST_TOP)
    if language == "ruby":
        return _ruby(masked)
    return True
