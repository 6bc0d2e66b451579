"""Credentials written out in files: found, located and blanked (problem 1).

A text is searched for key blocks, tokens of known form, connection URLs with a password, authorization headers, login
remarks, and values given to names that mean a credential. Literals that are put together are joined first, so a value
in several pieces is one. Runs of base64, hex, percent or backslash escapes are decoded and searched again until nothing
decodes, as every layer is shorter than the one around it; decoded bytes are also read as key containers by their
grammar (DER and OpenSSH), and their stretches of UTF-8 and UTF-16 text are searched. What is found inside an encoded
run blanks the run. A key block without an end is blanked to the end of its base64 body.

Results: null and empty contents have no credentials; repeated rows of a file count once. Line numbers are 1-based and
count ``\\n``; each is the line on which the credential begins, for joined literals the first. Whole texts are searched.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.arrow import map_rows, spread

BLANK = "REDACTED"


class Finding(NamedTuple):
    kind: str
    begin: int  # where the credential begins
    spans: tuple[tuple[int, int], ...]  # what is blanked


# Forms of issued tokens.
KNOWN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{24,}|"
    r"xox[abeoprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{36}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{24,}|dop_v1_[0-9a-f]{64}|hv[sb]\.[A-Za-z0-9_-]{24,})"
)
KNOWN_HINTS = ("AKIA", "ASIA", "gh", "glpat-", "k_live_", "sk-", "xox", "AIza", "eyJ", "npm_", "SG.", "dop_", "hvs.", "hvb.")
BEGIN_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
END_KEY = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`<>(){}]*:([^\s/@\"'`]+)@(?=[\w.\[-])")
HEADER = re.compile(r"(?i)(?:authorization|x-[a-z-]*(?:key|token))[\"'`]?\s*[:=,]\s*[\"'`]?(?:(bearer|basic|token|apikey)\s+)?([A-Za-z0-9._~+/=-]{8,})")
BEARER = re.compile(r"(?i)\bbearer\s+([A-Za-z0-9._~+/-]{16,}=*)")
LOGIN = re.compile(r"(?i)\b(?:log-?in|credentials?|creds|account)\b[ \t]*[:=][ \t]*[^\s/]+[ \t]*/[ \t]*([^\s\"'`]+)")
REMARK = re.compile(r"(?i)\b(?:password|passwd|passphrase|pwd)\b(?:[ \t]+(?:is|was|for\b[^:\n]{1,40}:)|[ \t]*:)[ \t]+[\"'`]?([^\s\"'`,;()]+)")

# Names that mean a credential, with at most a short ending; read on lower-case text.
NAME = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|access|auth|sign(?:ing)?|private|secret|client|account|master|session|encrypt(?:ion)?|service|storage|shared|deploy|license|hmac)[_. -]?key|auth)"
    r"(?:[_-]?[a-z0-9]{0,3})(?![a-z0-9])"
    r"(?:[\"'`]?\]?[ \t]*(?::[ \t]*(?:string|str|&str|\[\]byte|optional\[str\]|string\?)[ \t]*=|[ \t]+string[ \t]*=|:=|=>|==?|:|\?\?|,(?=[ \t]*[\"'`]))|[ \t]+(?:was|is)\b[ \t]*:?)[ \t]*"
)
NAME_HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth")
# What a name's value isn't if the name also says one of these.
OTHER_NAME = re.compile(r"(?:hash|digest|checksum|fingerprint|sha\d*|public|hint|label|placeholder|example|count|limit|max|min|length|size|type|regex|pattern|csrf_?field)[_-]?$")
ENVIRONMENT = re.compile(r"(?:environ(?:\.get)?|getenv|env(?:\.get|\.fetch|\.var)?|fetch|lookup_?env|getproperty|get_?secret|config\.get|vault\.read|secrets?)\s*[\[(]\s*$", re.I)
OWN = re.compile(
    r"\s*(?:[({\[]\s*)?(?:(?:await|new|str|string|String|bytes|Buffer\.from|SecretStr|Secret|\[\]byte|[A-Za-z]*Secret\w*)\s*\(\s*|[\w.$]+(?:\[\s*)?\s*(?:\?\?|\|\||\bor\b|\?:)\s*|(?:[\w$]+\.)*(?:environ(?:\.get)?|getenv|Getenv|env(?:\.get|\.fetch|\.var)?|ENV(?:\.fetch)?|fetch|lookup_?env|LookupEnv|getProperty|get_?[sS]ecret|config\.get|secrets?)\s*[\[(]\s*)*"
)
LITERAL = re.compile(r"(?:[rbuf]{1,2})?(?:\"\"\"([\s\S]*?)\"\"\"|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`]*)`)", re.I)
CONFIG = re.compile(r"(?:\.(?:env|ya?ml|ini|cfg|conf|config|properties|toml|sh|bash|zsh|tf|tfvars|npmrc|pypirc|netrc|service|hcl)|/(?:dockerfile|makefile|procfile|credentials|config|\.npmrc|\.pypirc|\.netrc|\.pgpass))$|\.env\.[a-z.]+$|(?:^|/)\.?env$", re.I)
OWN_LITERAL = re.compile(rf"({OWN.pattern})(?i:[rbuf]{{1,2}})?[\"'`]")
CALL = re.compile(r"\w+\(")
BARE = re.compile(r"[^\s\"'`,;(){}\[\]]+")

# What stands where a credential would.
PLACEHOLDER = re.compile(
    r"(?:^|[^a-z])(?:your|example|sample|placeholder|change[-_ ]?me|replace[-_ ]?me|insert|dummy|redacted|hidden|masked|removed|todo|fixme|none|null|undefined|unset|empty|not[-_ ]?set|set[-_ ]?me|xxx+|foo|foobar|secret|token|password|passwd|passw0rd|api[-_]?key)(?:$|[^a-z])|"
    r"example|[x*.#_•-]{6,}|(.)\1{5,}|^(?:1234567890?|0123456789)|[<{\[(]{2}|\$[{(A-Z_]|%\(|#\{|^%[sdv]|^\$|^<.*>$|^\{.*\}$|^\[.*\]$|^process\.|^os\.",
    re.I,
)
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\Z")
PATH = re.compile(r"(?:\.{0,2}|~)/(?:[a-z0-9._-]+/)*[a-z0-9._-]+/?\Z|[a-z]+://[^:@]*\Z|[\w./-]+\.(?:ya?ml|json|pem|key|crt|txt|env|ini|conf|toml)\Z")
DOTTED = re.compile(r"[A-Za-z_]+\d{0,2}(?:(?:\.|::|->)[A-Za-z_]+\d{0,2})+(?:\(\))?\Z")
WORDY = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[-_. ]?(?:[A-Z]?[a-z]+|[A-Z]+))*[-_.]?\d{0,2}\Z")
DIGEST = re.compile(r"(?:sha\d{1,3}|md5)[-:=]", re.I)


def strong(value: str) -> bool:
    """Whether a value given to a credential's name can be one."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value):
        return False
    if PLACEHOLDER.search(value) or UUID.match(value) or DIGEST.match(value) or PATH.match(value) or DOTTED.match(value):
        return False
    if len(set(value)) < min(5, n // 2):
        return False
    has_digit, has_letter = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if has_letter and has_digit:
        return not re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[a-z]+(?:[-_][a-z]+)*[-_]?\d{1,2}", value)
    if has_letter:
        return not WORDY.match(value) and n >= 10 or n >= 20 and len(re.findall(r"[a-z][A-Z]|[A-Z]{2}", value)) >= 4
    return False


def real(value: str) -> bool:
    """Whether a token of known form isn't a masked or sample one."""
    body = value[value.find("_", 2) + 1 :] if "_" in value[:9] else value
    return len(set(body)) >= 8 and not re.search(r"(?i)example|x{5,}|\*{3,}|your[-_]", value)


def url_password(value: str) -> bool:
    if re.search(r"[$%{}<>]|\*{2,}|x{3,}", value) and not re.search(r"\d[^$]*[A-Za-z]|[A-Za-z][^$]*\d", re.sub(r"\$\{[^}]*\}|\$\w+|\{[^}]*\}|<[^>]*>|%[sdv]", "", value)):
        return False
    return value.lower() not in ("password", "passwd", "pass", "pw", "secret", "changeme", "example", "token", "xxx", "redacted", "your-password", "yourpassword", "pwd") and not re.fullmatch(r"[*x.•]+|:+", value, re.I)


# Key containers by their grammar.


def der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, begin, end) of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or at + k > end:
            return None
        size, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + size) if at + size <= end else None


OPENSSH = b"openssh-key-v1\0"
# Object identifiers of password-based encryption (PKCS#5 and PKCS#12) and of PKCS#7 data.
PBE = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
PKCS7_DATA = b"\x2a\x86\x48\x86\xf7\x0d\x01\x07\x01"


def openssh_container(data: bytes) -> bool:
    """Whether bytes are an OpenSSH key: cipher, key derivation, its options, public keys, private block, by their lengths."""
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out, at = data[at + 4 : end], end
        return out

    cipher, derivation, options = field(), field(), field()
    if not cipher or not derivation or options is None or at + 4 > len(data):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= count <= len(data) // 4:
        return False
    for _ in range(count):
        public = field()
        if not public or int.from_bytes(public[:4], "big") > len(public) - 4:
            return False
    private = field()
    # Unencrypted private blocks begin with one random number, twice.
    return bool(private) and len(private) % 8 == 0 and (cipher != b"none" or private[:4] == private[4:8])


def private_container(data: bytes) -> bool:
    """Whether bytes are a private key: PKCS#1, PKCS#8, SEC1, DSA, an encrypted PKCS#8, PKCS#12 or an OpenSSH container."""
    if data.startswith(OPENSSH):
        return openssh_container(data)
    top = der(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] < len(data) - 3:
        return False
    items, at = [], top[1]
    while at < top[2] and len(items) < 12:
        e = der(data, at, top[2])
        if not e:
            return False
        items.append(e)
        at = e[2]
    tags = [t for t, _, _ in items]
    if tags[:1] == [0x02] and items[0][2] - items[0][1] == 1:
        version = data[items[0][1]]
        if version == 0 and len(tags) >= 9 and set(tags[:9]) == {0x02}:
            return True  # PKCS#1
        if version in (0, 1) and tags[1:3] == [0x30, 0x04]:
            return True  # PKCS#8
        if version == 1 and tags[1:2] == [0x04] and items[1][2] - items[1][1] in range(16, 73):
            return True  # SEC1
        if version == 0 and len(tags) == 6 and set(tags) == {0x02}:
            return True  # DSA
        if version == 3 and tags[1:2] == [0x30]:
            inner = der(data, items[1][1], items[1][2])
            return bool(inner and inner[0] == 0x06 and data[inner[1] : inner[2]] == PKCS7_DATA)  # PKCS#12
    if tags == [0x30, 0x04]:
        inner = der(data, items[0][1], items[0][2])
        return bool(inner and inner[0] == 0x06 and data[inner[1] : inner[2]].startswith(PBE))
    return False


RUN = re.compile(r"[A-Za-z0-9+/_-]++(?<=[A-Za-z0-9+/_-]{24})={0,2}")
ESCAPES = re.compile(r"(?:\\x[0-9a-fA-F]{2}|\\u00[0-9a-fA-F]{2}){8,}")
PERCENTS = re.compile(r"(?:[A-Za-z0-9._~-]{0,40}%[0-9a-fA-F]{2}){3,}[A-Za-z0-9._~-]*")
HEX = re.compile(r"(?:[0-9a-fA-F]{2}){16,}\Z")
# Stretches of bytes that are text: UTF-8, or the ASCII part of UTF-16.
TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")
WIDE = re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){12,}|(?:\0[\t\n\r\x20-\x7e]){12,}")


def unescaped(run: str) -> bytes:
    return bytes(int(x, 16) for x in re.findall(r"([0-9a-fA-F]{2})(?=\\|$)", run))


def unpercented(run: str) -> bytes:
    return re.sub(rb"%([0-9a-fA-F]{2})", lambda x: bytes([int(x[1], 16)]), run.encode())


def unpacked(run: str) -> bytes | None:
    if HEX.match(run):
        return bytes.fromhex(run)
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def texts(data: bytes) -> Iterator[str]:
    """The stretches of text in decoded bytes."""
    for m in TEXT.finditer(data):
        yield m[0].decode("utf-8", "replace")
    if b"\0" in data:
        for m in WIDE.finditer(data):
            yield m[0].replace(b"\0", b"").decode("ascii")


def layers(text: str) -> Iterator[tuple[int, int, bytes]]:
    """(begin, end, bytes) of every run of a text that decodes."""
    for m in RUN.finditer(text):
        data = unpacked(m[0])
        if data:
            yield m.start(), m.end(), data
    if "\\x" in text or "\\u00" in text:
        for m in ESCAPES.finditer(text):
            yield m.start(), m.end(), unescaped(m[0])
    if text.count("%") >= 3:
        for m in PERCENTS.finditer(text):
            yield m.start(), m.end(), unpercented(m[0])


GLUE = re.compile(r"([\"'`])(?:[ \t]*(?:[+.\\]|\+?[ \t]*\r?\n[ \t]*\+?|\\\r?\n)[ \t\r\n]*|[ \t]+)(?:[rbuf])?\1")


def joined(text: str) -> tuple[str, list[int], list[int]]:
    """A text with adjoining literals as one, and where each kept stretch begins: in it, and in the text."""
    out, inside, outside, at, size = [], [0], [0], 0, 0
    for m in GLUE.finditer(text):
        if m.start() < at:
            continue
        # Only glue that closes a literal: an odd number of these quotes stands before it on its line.
        line = text.rfind("\n", 0, m.start()) + 1
        if text.count(m[1], line, m.start()) % 2 == 0:
            continue
        out.append(text[at : m.start()])
        size += m.start() - at
        at = m.end()
        inside.append(size)
        outside.append(at)
    out.append(text[at:])
    return "".join(out), inside, outside


# One line of a key's body, with what may stand around it: comment signs, quotes, escaped line ends.
KEY_LINE = re.compile(r"((?:[ \t#>|\"'`,;]|(?://|/?\*)[ \t]|\r?\n|\\[nrt]|\\\r?\n)*)([A-Za-z0-9+/]+={0,2})(?=[ \t]*(?:\r?\n|[\"'`,;\\]|\Z))")
KEY_HEADER = re.compile(r"(?:[ \t#>|\"'`,;]|(?://|/?\*)[ \t]|\r?\n|\\[nrt])*(?:[A-Z][A-Za-z]*-[A-Z][A-Za-z]*|Comment|Version|Hash):[^\n\\]*")


def body_end(text: str, at: int) -> int:
    """Where the base64 body that begins at ``at`` ends: after lines of one width and a shorter one."""
    while m := KEY_HEADER.match(text, at):
        at = m.end()
    width = 0
    while m := KEY_LINE.match(text, at):
        size = len(m[2])
        if width and (size > width or not m[1] or m[1].count("\n") > 1):
            break
        at = m.end()
        if size < width:
            break
        width = size
    return at


def key_blocks(text: str) -> Iterator[tuple[int, int]]:
    """(begin, end) of the private key blocks of a text; one without an end of its own ends with its body."""
    blocks = list(BEGIN_KEY.finditer(text))
    for m, after in zip(blocks, [*(b.start() for b in blocks[1:]), len(text)]):
        end = END_KEY.search(text, m.end(), after)
        stop = end.start() if end else body_end(text, m.end())
        if len(re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", text[m.end() : stop])) >= 40:
            yield m.start(), end.end() if end else stop


def _search(text: str, low: str, config: bool) -> Iterator[tuple[str, int, int, int]]:
    """(kind, begin, begin and end of what is blanked) in a text without glue."""
    if "-----BEGIN " in text:
        for begin, end in key_blocks(text):
            yield "private_key", begin, begin, end
    if any(h in text for h in KNOWN_HINTS):
        for m in KNOWN.finditer(text):
            if real(m[0]):
                yield "token", m.start(), m.start(), m.end()
    if "://" in text:
        for m in URL.finditer(text):
            if url_password(m[1]):
                yield "url_password", m.start(), m.start(1), m.end(1)
    if "authorization" in low or "x-" in low:
        for m in HEADER.finditer(text):
            value, scheme = m[2], (m[1] or "").lower()
            if scheme == "basic":
                try:
                    user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4)).decode("utf-8").partition(":")
                except (binascii.Error, ValueError, UnicodeDecodeError):
                    continue
                if colon and len(password) >= 3 and not PLACEHOLDER.search(password):
                    yield "authorization", m.start(2), m.start(2), m.end(2)
            elif scheme and strong(value) or not scheme and strong(value) and "-key" in m[0].lower():
                yield "authorization", m.start(2), m.start(2), m.end(2)
    if "bearer" in low:
        for m in BEARER.finditer(text):
            if strong(m[1]):
                yield "authorization", m.start(1), m.start(1), m.end(1)
    for pattern, near in ((LOGIN, " / " in text), (REMARK, "pass" in low or "pwd" in low)):
        if near:
            for m in pattern.finditer(text):
                if strong(m[1].rstrip(".,;)")) and (pattern is LOGIN or any(c.isdigit() for c in m[1])):
                    yield "login", m.start(1), m.start(1), m.start(1) + len(m[1].rstrip(".,;)"))
    if any(h in low for h in NAME_HINTS):
        for m in NAME.finditer(low):
            yield from _named(text, low, m, config)
    for begin, end, data in layers(text):
        if private_container(data):
            yield "encoded_key", begin, begin, end
        elif any(True for inner in texts(data) for _ in _search(inner, lowered(inner), True)):
            yield "encoded", begin, begin, end


def lowered(text: str) -> str:
    """The text in lower case, letter by letter, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _named(text: str, low: str, m: re.Match, config: bool) -> Iterator[tuple[str, int, int, int]]:
    begin = m.start()
    while begin > 0 and (low[begin - 1].isalnum() or low[begin - 1] in "_-"):
        begin -= 1
    if OTHER_NAME.search(low[begin : m.start()]):
        return
    at = m.end()
    # The value begins on this line, or on the next if the line ends with the sign.
    head = re.compile(r"(?:\(|\[\]byte\(|\\|[ \t\r\n]|new\b|string\b)*").match(text, at)
    start = head.end() if text[at : head.end()].count("\n") <= 2 else at
    line_end = text.find("\n", start)
    line_end = line_end if line_end >= 0 else len(text)
    # Only what can stand before a name's own value: look-ups with a fallback, and wrappers that take one literal.
    own = OWN_LITERAL.match(text, start, line_end)
    literal = LITERAL.match(text, own.end(1)) if own else None
    if literal is None and (literal := LITERAL.match(text, start)) and literal[1] is None and literal[4] is None:
        literal = None
    between = text[start : literal.start()] if literal else ""
    quoted_name = m[0].rstrip().endswith(",")
    if literal:
        group = next(k for k in range(1, 5) if literal[k] is not None)
        value = literal[group]
        lookup = ENVIRONMENT.search(between)
        if lookup or not quoted_name and re.fullmatch(r"[A-Z][A-Z0-9_]*", value) and re.search(r"[\[(]\s*$", between):
            # The name of a variable or store; a value may follow it as the fallback.
            rest = re.compile(r"\s*[\])]*\s*(?:,|\?\?|\|\||\bor\b|\?:|\.unwrap_or\(|\.orElse\()\s*").match(text, literal.end())
            literal = LITERAL.match(text, rest.end()) if rest else None
            if not literal:
                return
            group = next(k for k in range(1, 5) if literal[k] is not None)
            value = literal[group]
        stripped = value.strip()
        default = re.fullmatch(r"\$\{[A-Za-z_]\w*:?-([^}]+)\}", stripped)
        if default and strong(default[1]):
            yield "named", literal.start(), literal.start(group) + value.index(default[1]), literal.start(group) + value.index(default[1]) + len(default[1])
        elif strong(stripped):
            yield "named", literal.start(), literal.start(group), literal.end(group)
        return
    was = m[0].rstrip(" :").endswith(("was", "is"))
    if (config or was) and at == start or config:
        bare = BARE.match(text, start)
        if not bare or text[at:start].count("\n"):
            default = re.compile(r"\$\{[A-Za-z_]\w*:?-([^}\s]+)\}").match(text, start)
            if default and strong(default[1]):
                yield "named", start, default.start(1), default.end(1)
            return
        value = bare[0].rstrip(".") if was else bare[0]
        if strong(value) and not CALL.match(text, start, line_end):
            yield "named", start, start, start + len(value)


def find(text: str | None, path: str | None = None) -> list[Finding]:
    """The credentials of a text, in order; overlapping ones once."""
    if not text:
        return []
    whole, inside, outside = joined(text) if '"' in text or "'" in text or "`" in text else (text, [0], [0])
    config = bool(path and CONFIG.search(path))
    found = sorted(_search(whole, lowered(whole), config), key=lambda x: (x[2], -x[3]))
    out: list[Finding] = []
    last = -1
    for kind, begin, first, end in found:
        if first < last:
            continue
        last = end
        k = bisect_right(inside, begin) - 1
        spans = []
        j = bisect_right(inside, first) - 1
        while True:
            stop = inside[j + 1] if j + 1 < len(inside) else len(whole)
            a, b = max(first, inside[j]), min(end, stop)
            if b > a:
                spans.append((outside[j] + a - inside[j], outside[j] + b - inside[j]))
            if end <= stop:
                break
            j += 1
        out.append(Finding(kind, outside[k] + begin - inside[k], tuple(spans)))
    return out


def redact(text: str, found: list[Finding]) -> str:
    """The text with every credential blanked; line ends stay, so lines keep their numbers."""
    out, at = [], 0
    for begin, end in sorted(s for f in found for s in f.spans):
        if begin < at:
            continue
        out.append(text[at:begin])
        out.append("\n".join(BLANK + ("\r" if part.endswith("\r") else "") if part.strip() else part for part in text[begin:end].split("\n")))
        at = end
    out.append(text[at:])
    return "".join(out)


def _source(files: DataFrame) -> DataFrame:
    return spread(files.filter(F.col("content") != "").select(F.col("id").cast("bigint").alias("file_id"), "path", "content"))


def credential_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, kind) of every credential."""

    def kernel(columns: list[list]):
        for i, path, text in zip(*columns):
            for f in find(text, path):
                yield i, text.count("\n", 0, f.begin) + 1, f.kind

    return map_rows(_source(files), ["file_id", "path", "content"], kernel, "file_id bigint, line_no bigint, kind string").distinct()


def found_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no): the lines on which a credential begins."""
    return credential_lines(files).select("file_id", "line_no").distinct()


def redacted_files(files: DataFrame) -> DataFrame:
    """(file_id, content, blanked): every file with its credentials blanked; ``blanked`` counts them.

    Files without content keep it as it is, null or empty, with a count of 0. Rows are as many as went in.
    """

    def kernel(columns: list[list]):
        for i, path, text in zip(*columns):
            found = find(text, path)
            yield i, redact(text, found) if found else text, len(found)

    source = spread(files.select(F.col("id").cast("bigint").alias("file_id"), "path", "content"))
    return map_rows(source, ["file_id", "path", "content"], kernel, "file_id bigint, content string, blanked int", out_rows=512)
