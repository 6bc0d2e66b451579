"""Personal information in free text, found and replaced by typed placeholders (problem 3).

Weak supervision. Patterns propose spans of each kind. Labelers vote on each span: its form, gazetteers, and the words
beside it say yes, no or nothing. Over all notes the patterns of votes are counted, and expectation-maximisation
estimates from these counts how reliable each labeler is, without labels, and so a probability for each pattern. On
these a logistic span classifier is trained, over the votes and over hashed features of the span and its context; it
decides on every span of every note. A gazetteer that doesn't know a name abstains, and the classifier also sees each
name of the sample without its gazetteer vote and its own words, so that it learns what stands around names. Names of
things (teams, products, towns) are learned from all notes: word pairs that come up often, of which the first word
hardly ever goes with another; for these the gazetteer says no.

Results: null and empty bodies hold nothing; overlapping spans are settled in favour of the likelier one; repeated
rows count once. Bodies are read whole. Reliabilities come from all notes; the classifier's sample is bounded by
``FIT_NOTES`` notes and ``FIT_SPANS`` spans, both in the order of a hash of the note's id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.arrow import map_rows, spread
from cairnfield.functions.lineage import cut

KINDS = ("email", "phone", "id_number", "street_address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "street_address": "[STREET_ADDRESS]", "name": "[NAME]"}
#: Notes the model is fitted on, and spans kept of them: the bounds of what reaches the driver.
FIT_NOTES, FIT_SPANS = 3000, 40_000
DIMENSIONS = 1 << 14
#: A pair of words names a thing if it makes up this share of all names that no gazetteer knows (so there are at most
#: ``1 / THING_SHARE`` things) and this share of what its first word begins.
THING_SHARE, THING_FIRST = 1 / 2000, 0.9

UP, LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
WORD = rf"[{UP}](?:['’][{UP}])?[{LOW}]+(?:-[{UP}][{LOW}]+)*"

PATTERNS = {
    "email": (
        re.compile(r"(?<![\w.+@-])[\w.+'-]*[\w+]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]|\.[A-Za-z0-9])|(?<![\w.+@-])[\w.+'-]*[\w+] @ [A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@]|\.[A-Za-z0-9])"),
        re.compile(r"(?<![\w.+@-])[\w.+'-]*[\w+] ?(?:\(at\)|\[at\]|\{at\}|<at>) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\.) ?[A-Za-z0-9-]+)*? ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\.) ?[A-Za-z]{2,}(?![\w@])(?! ?(?:\(dot\)|\[dot\]))"),
        re.compile(r"(?<![\w.+@-])[\w.+-]*\w at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)* dot [A-Za-z]{2,}(?!\w)"),
    ),
    "phone": (re.compile(r"(?<![\w.,/:#$€£-])(?:\+\d{1,3}[ .-]?)?(?:\(0?\d{1,5}\)[ .-]?)?\d{1,5}(?:[ .-]\d{1,8}|/\d{3,8}){1,6}(?![\w/]|[.,:]\d|-\w)|(?<![\w.])(?:\+|00)\d{9,14}(?!\w)|(?<![\w.,/:#-])0\d{9,11}(?!\w|[.,:]\d)"),),
    "id_number": (re.compile(r"(?<![\w.,/:#$€£-])(?:[A-Z]{1,4}-?)?\d(?:[\d -]{4,18})\d(?:[ -]?[A-Z]\d?)?(?![\w/]|[.,:]\d|-\w)|(?<![\w.,/:#-])[A-Z]{1,2}[A-Z\d]{1,3}\d{4,9}[A-Z\d]{0,3}(?![\w-])"),),
    "street_address": (
        re.compile(
            rf"(?<![\w.,/-])\d{{1,5}}[a-zA-Z]? (?:{WORD} ){{1,3}}(?:Street|St\.|St\b|Avenue|Ave|Road|Rd|Lane|Ln|Close|Boulevard|Blvd|Drive|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Row|Crescent|Hill|Gardens|Parkway|Pkwy|Alley|Mews)(?!\w)"
            rf"|(?<![\w.,/-])\d{{1,5}}[a-zA-Z]?(?: bis| ter)?,? (?:rue|avenue|boulevard|place|chemin|all[ée]e|impasse|quai|route|cours|square)(?: (?:de la|de l['’]|des|du|de|d['’]|la|le))? ?{WORD}(?:[ -]{WORD})*"
        ),
        re.compile(rf"(?<!\w)(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Carrera|Camino|Ronda|Via|Viale|Piazza|Corso|Rua|Praça|Largo|Travessa)(?: (?:de la|de los|de las|de|del|della|dei|do|da|dos|das))? {WORD}(?: {WORD})*,? \d{{1,5}}[a-zA-Z]?(?![\w.])"),
        re.compile(rf"(?<!\w)(?:{WORD}[ -])?[{UP}][{LOW}]+(?:straße|strasse|str\.|weg|allee|gasse|platz|ring|damm|ufer|steig|pfad|straat|laan|plein|gracht|kade|dijk) \d{{1,4}}[a-zA-Z]?(?![\w.])"),
    ),
    "name": (re.compile(rf"(?<![\w’'@./+-])(?:{WORD} (?:[{UP}]\. |(?:van|von|de|der|del|da|di|du|la|le|ten|ter|el|bin|ibn) ){{0,2}}{WORD}|[{UP}]{{2,}} (?:[{UP}]\. )?[{UP}]{{2,}}(?:-[{UP}]{{2,}})*)(?![\w@]|['’][a-z]{{2}})"),),
}
# A place where digits stand close enough for a number of a person, and a house number.
NUMBER_ZONE, HOUSE = re.compile(r"\d(?:\D{0,3}\d){5}"), re.compile(r" \d")
STREET_ENDS = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer", "steig", "pfad", "straat", "laan", "plein", "gracht", "kade", "dijk")
STREET_WORDS = re.compile(r"Calle|Aven|Avda|Pla|Paseo|Carrera|Camino|Ronda|Via|Piazza|Corso|Rua|Pra|Largo|Trav")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")


def is_account(found: str) -> bool:
    """Whether a text is an account number by its check digits; such numbers are neither phones nor of documents."""
    plain = found.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _lines(text: str, zones: re.Pattern) -> Iterator[tuple[int, int]]:
    """(begin, end) of the lines of a text that have a zone."""
    at = 0
    while m := zones.search(text, at):
        begin, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = end if end >= 0 else len(text)
        yield max(begin, at), end
        at = end


def proposals(text: str, kind: str) -> Iterator[re.Match]:
    """What the patterns of a kind find; texts and lines without a pattern's marks are skipped."""
    patterns = PATTERNS[kind]
    if kind == "email":
        near = ("@" in text, "at)" in text or "at]" in text or "at}" in text or "at>" in text, " dot " in text)
        for pattern, go in zip(patterns, near):
            if go:
                yield from pattern.finditer(text)
    elif kind in ("phone", "id_number"):
        accounts = None
        for begin, end in _lines(text, NUMBER_ZONE):
            for m in patterns[0].finditer(text, begin, end):
                if accounts is None:
                    accounts = [a.span() for a in IBAN.finditer(text) if is_account(a[0])]
                if not any(m.start() < b and m.end() > a for a, b in accounts):
                    yield m
    elif kind == "street_address":
        yield from patterns[0].finditer(text)
        if STREET_WORDS.search(text):
            yield from patterns[1].finditer(text)
        if any(text.endswith(STREET_ENDS, max(0, m.start() - 8), m.start()) for m in HOUSE.finditer(text)):
            yield from patterns[2].finditer(text)
    else:
        yield from patterns[0].finditer(text)

# Gazetteers.
GIVEN = frozenset(
    """Adam Adrian Agnes Alan Albert Alessandro Alexander Alice Amadea Amelia Amina Ana Andrea Andreas Andrew Angela Anita Anna Anne Antonio Arthur Astrid
    Barbara Bastiaan Beatriz Benjamin Bernd Bianca Birgit Brian Camille Carla Carlos Carmen Caroline Casimir Catherine Cecilia Charles Charlotte Chiara Chloe Christian
    Claire Clara Claudia Corwin Daniel David Diana Diego Dieter Dmitri Edward Elena Elisa Elizabeth Emil Emily Emma Eric Erika Eva Evander Fatima Federico Felix Fenja Fernando
    Francesca Francis Frank Gabriel George Gideon Giulia Giuseppe Grace Greta Hadrian Hannah Hans Harriet Heather Helen Helga Henry Hugo Ilka Imke Ines Ingrid Irene Isabel
    Jack Jacob James Jan Jane Jason Javier Jean Jennifer Jessica Joan Johan John Jonas Joren Jorge Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Lars Laura Laurent
    Lena Linda Lisa Lorcan Louis Lucas Lucia Luigi Luis Maelle Manuel Marco Maren Margaret Maria Marie Mark Marta Martin Mary Matteo Michael Miguel Monika Nadia Nicolas
    Nina Nuria Odile Olga Oliver Ottilie Pablo Paolo Patricia Paul Pedro Perrine Peter Philippa Pierre Rachel Renzo Richard Robert Rosa Ruth Samuel Sandra Sara Sergio Simon
    Sofia Solvei Sophie Stefan Susan Sunniva Tamsin Thaddeus Thomas Tovira Ulrika Victor Wiebke William Xanthe Yolanthe Yusuf Zoran""".split()
)
GIVEN_UPPER = frozenset(w.upper() for w in GIVEN)
COMMON = frozenset(
    """a after all an and any april as august ask at badge bitte both build but by call can clone commit contact copy dal das december der desde die each ein el emergency en es every falls february
    for friday from hay he her his how if il in invoice is it january jedes joindre july june la le les los mail main march may mention metric mit monday most mondays no nobody noch notes november numbers
    october on one only open or our parcel ping project reviewer road saturday section see seit send september she signed since so spoke street sunday team ten the their then there they this
    thursday ticket tuesday two übrig una une version via view was we wednesday were what when where which while who why will wir with you your""".split()
)
PLACE = frozenset("street st avenue ave road rd lane close boulevard blvd drive court way place square terrace row view port rue calle apt".split())
# Words beside a span that speak for or against its kind.
LEFT_YES = {
    "email": re.compile(r"(?i)(?:mail(?:to:|\b)|contact|write|schicken|escribir|user=|<|\bto\b|an|:)\W*$"),
    "phone": re.compile(r"(?i)(?:\b(?:call|phone|tel(?:ephone|\.)?|mobile|cell|fax|reachable|numbers?|ring|dial|au|anrufen|ruf|reach|text|sms)\b[^\w+(]*(?:me|under|on|at|is|us)?|phone=|\bunder|/)\W*$"),
    "id_number": re.compile(r"(?i)(?:passport|licen[cs]e|social(?: security)?|ssn|tax|insurance|national id|identity|id|dni|nif|nie|steuer-?id|ni|nino|personalausweis|ausweis|cpf|siren|codice fiscale|bsn)(?: (?:card|number|no\.?|nr\.?|num|id|security number))?\W*(?:is|:|=)?\W*$"),
    "street_address": re.compile(r"(?i)(?:\b(?:at|to|lives|live|en|moves|address|in|from|vive|habite|wohnt|residing|badge|went|visit)\b|^|\n|\||:)\W*$"),
    "name": re.compile(r"(?:\b(?:Dr|Mr|Mrs|Ms|Prof|Herr|Frau|Mme|M|Sra?|Don|Doña)\.? |(?i:ask|asked|ask for|call|called|met|meet|meeting with|saw|told|tell|thank|thanks to|invited?|hired?|interviewed|emailed|phoned|emergency|spoke with|ping|joindre|bitte|contact|parcel for|from|by|owner|author|with|and|as|assigned_to|to|signed,|regards,|thanks,|dear|[a-z]+day)[\s|:]+|\[[ x]\] )$"),
}
LEFT_NO = {
    "email": re.compile(r"(?i)(?:clone with|git|ssh://|remote)\W*$"),
    "phone": re.compile(r"(?i)(?:invoice|ticket|build|version|commit|order|section|issue|since|ssn|social|id|dni|no\.?|licen[cs]e|passport|security number|tax id|steuer-id|insurance|#|v|range|covers|isbn)\W*(?:is)?\W*$"),
    "id_number": re.compile(r"(?i)(?:invoice|ticket|build|version|commit|order|issue|since|call|phone|tel|under|numbers|au|anrufen|me|on|#|range|covers|isbn|in|about|of|to|from)\W*$"),
    "street_address": re.compile(r"(?i)(?:section|page|step|figure|table|part|item|release|phase|room|build|version|day|week|since|of|lists)\W*$"),
    "name": re.compile(r"(?:belongs to|run the|and run|Section \d+|points for|Project|the|Team|product|\#+|on)\s*$"),
}
RIGHT_YES = {
    "email": re.compile(r"\W"),
    "phone": re.compile(r"(?i)\W*(?:ext|if\b|or\b|avant|sonst|between|before|please|\||\)|/|$)"),
    "id_number": re.compile(r"(?i)\W*(?:and\b|in the|$|\n|\.)|\)"),
    "street_address": re.compile(r"(?:,|\.|\n|$| by | in | \(|;)"),
    "name": re.compile(r"(?:,| (?:said|says|wrote|writes|left|moves|went|about|anrufen|au|asked|asks|called|calls|told|thinks|agreed|agrees|suggested|noted|reported|works|worked|<|\||lives|joined|is|has|was|will|replied)\b| <| \||\.|\n|$)"),
}
RIGHT_NO = {
    "email": re.compile(r":\w"),
    "phone": re.compile(r"(?i) (?:finished|belongs|covers|ms\b|rows|open|%|items|notes|bytes|kb|mb)|\.\d"),
    "id_number": re.compile(r"(?i) (?:finished|belongs|covers|ms\b|rows|open|items|notes|bytes)|\.\d"),
    "street_address": re.compile(rf" (?:[{UP}]|lists|covers|shows|ahead)"),
    "name": re.compile(r" (?:share|setup|lists|belongs|finished|covers|loses|team|project|release)\b"),
}
FORM_YES = {
    "email": re.compile(r"(?i)[\w.+'-]+ ?@ ?[\w.-]+\.[a-z]{2,}\Z|.*[(\[](?:at)[)\]]"),
    "phone": re.compile(r"\+\d[\d ().-]{7,}\Z|00\d{9,}\Z|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}\Z|0\d{1,4}[/ -]\d[\d -]{4,}\Z|\(0\d{1,4}\) ?\d"),
    "id_number": re.compile(r"\d{3}([ -])\d{2}\1\d{4}\Z|\d{8}-?[A-Z]\Z|[A-Z]\d{8}\Z|[A-Z]{2}\d{6}[A-Z]\Z|[A-Z]{2}-\d{4}-\d{5}\Z|\d{2} \d{3} \d{3} \d{3}\Z|\d{3}\.\d{3}\.\d{3}-\d{2}\Z"),
    "street_address": re.compile(r".*\b(?:Street|St\.|Avenue|Ave|Road|Rd|Lane|Close|Blvd|rue|Calle)\b|.*(?:straße|weg|allee|gasse|platz|straat|laan) \d"),
    "name": re.compile(rf"{WORD} (?:[{UP}]\. )?{WORD}\Z|[{UP}]+ (?:[{UP}]\. )?[{UP}-]+\Z"),
}
FORM_NO = {
    "email": re.compile(r"(?i)git@|.*@\d"),
    "phone": re.compile(r"\d{4}-\d\d-\d\d\Z|(?:\d{1,3}\.){3}\d{1,3}\Z|\d{1,2}[.-]\d{1,2}[.-]\d{2,4}\Z|\d{3}([ -])\d{2}\1\d{4}\Z|\d{4}-\d{3}-\d{2}\Z|\d{2} \d{3} \d{3} \d{3}\Z|\d{8}\Z|[\d ]{1,8}\Z"),
    "id_number": re.compile(r"\d{4}-\d\d-\d\d\Z|\d{3}-\d{3}-\d{4}\Z|\d{4}-\d{3}-\d{2}\Z|0\d{4} |\d{1,5} \d{1,4}\Z|\d{9}\Z"),
    "street_address": re.compile(r"\d+ (?:Long|Main|High|Short|Old|New) Road"),
    "name": re.compile(r"[A-Z]+_|(?:ERROR|WARNING|TODO|NOTE|HEAD|README)\b"),
}
# What a true span's labelers are believed to vote at first (no, nothing, yes); a false span's is the mirror image.
BELIEF = np.array([0.1, 0.3, 0.6])
START = np.array([0.5, 1.0, 1.0, 2.5, 0.7, 2.0])
VOTERS = ("form", "left", "right", "gazetteer", "count", "against")


class Span(NamedTuple):
    kind: int
    begin: int
    end: int
    votes: tuple[int, ...]
    features: tuple[int, ...]


def _hashed(kind: str, *parts: str) -> int:
    return len(VOTERS) * 2 * len(KINDS) + zlib.crc32("\0".join((kind, *parts)).encode("utf-8", "replace")) % (DIMENSIONS - len(VOTERS) * 2 * len(KINDS))


def spans(text: str) -> list[Span]:
    """All proposed spans of a text, with votes and features."""
    out = []
    for k, kind in enumerate(KINDS):
        for m in proposals(text, kind):
            begin, end = m.span()
            found = m[0]
            if kind == "name" and found[0].isupper() and found.split(" ", 1)[0].lower() in COMMON:
                # A sentence's first word isn't a given name; the name may begin after it.
                inner = PATTERNS["name"][0].match(text, begin + found.index(" ") + 1)
                if not inner:
                    continue
                begin, end = inner.span()
                found = inner[0]
            if kind == "email" and text[end : end + 1] == ":" and re.match(r":[\w~/]", text[end : end + 2]) and not found.isupper():
                against = True
            else:
                against = False
            if kind == "name":
                ends = found.lower().split(" ")
                known = found.split(" ", 1)[0] in GIVEN or found.isupper() and found.split(" ", 1)[0] in GIVEN_UPPER
                if ends[-1] in COMMON or not known and (ends[0] in PLACE or ends[-1] in PLACE):
                    continue
            if kind in ("phone", "id_number") and not 6 <= sum(c.isdigit() for c in found) <= 15:
                continue
            if kind == "phone" and found[0] == "(" and ")" not in found:
                continue
            left, right = text[max(0, begin - 40) : begin], text[end : end + 24]
            words = re.findall(r"[^\W_]+", found)
            gazetteer = 0
            if kind == "name":
                gazetteer = 1 if known else 0
            elif kind == "street_address":
                gazetteer = -1 if re.search(r"\b(?:Long|Main|Hard)\b", found) else 0
            elif kind == "email":
                gazetteer = -1 if re.match(r"(?i)(?:git|svn|hg|noreply|no-reply)@", found) else 0
            digits = sum(c.isdigit() for c in found)
            count = 0
            if kind == "phone":
                count = 1 if 9 <= digits <= 14 else -1
            elif kind == "id_number":
                count = 1 if digits in (6, 8, 9, 11) else -1
            elif kind == "name":
                count = -1 if any(w.lower() in PLACE for w in words[1:]) or words[0].lower() in PLACE else 0
            votes = (
                1 if FORM_YES[kind].match(found) else -1 if FORM_NO[kind].match(found) else 0,
                -1 if kind == "name" and LEFT_NO[kind].search(left) else 1 if LEFT_YES[kind].search(left) else -1 if LEFT_NO[kind].search(left) else 0,
                1 if RIGHT_YES[kind].match(right) else -1 if RIGHT_NO[kind].match(right) else 0,
                gazetteer,
                count,
                -1 if against or FORM_NO[kind].match(found) or RIGHT_NO[kind].match(right) or LEFT_NO[kind].search(left) and (kind == "name" or not LEFT_YES[kind].search(left)) else 0,
            )
            near = re.findall(r"[^\W\d_]+", left)
            after = re.findall(r"[^\W\d_]+", right)
            shape = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]", "A", re.sub(r"\d", "0", found)))[:24]
            features = [
                _hashed(kind, "bias"),
                _hashed(kind, "shape", shape),
                _hashed(kind, "left", near[-1].lower() if near else ""),
                _hashed(kind, "left2", *(w.lower() for w in near[-2:])),
                _hashed(kind, "right", after[0].lower() if after else ""),
                _hashed(kind, "before", left[-1:]),
                _hashed(kind, "after", right[:1]),
            ]
            if kind in ("name", "street_address"):
                own = (_hashed(kind, "first", words[0].lower()), _hashed(kind, "end", words[-1].lower()[-4:]))
                features += own
            features += [(k * len(VOTERS) + j) * 2 + (v > 0) for j, v in enumerate(votes) if v]
            out.append(Span(k, begin, end, votes, tuple(features)))
    return out


def reliabilities(votes: np.ndarray, rounds: int = 40, counts: np.ndarray | None = None) -> np.ndarray:
    """Probability that each span is true, from votes (-1, 0, 1) alone: EM over independent labelers.

    ``counts`` says how many spans each row stands for. A gazetteer's silence is no evidence, as no list is complete.
    """
    n, m = votes.shape
    if not n:
        return np.zeros(0)
    size = np.ones(n) if counts is None else counts.astype(float)
    total = size.sum()
    # Labelers start out as mostly right and keep a part of that belief, so that the classes can't change places;
    # the gazetteer and the counter-evidence are believed most, the form (which proposed the span) least.
    p = 1 / (1 + np.exp(-(votes @ START - 0.5).astype(float)))
    weight = max(4.0, 0.05 * total)
    one_hot = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)
    heard = one_hot.copy()
    heard[:, VOTERS.index("gazetteer"), 1] = 0.0
    for _ in range(rounds):
        prior = np.clip((p @ size + 1) / (total + 2), 0.02, 0.98)
        yes = (np.einsum("n,nmv->mv", p * size, one_hot) + weight * BELIEF) / (p @ size + weight)
        no = (np.einsum("n,nmv->mv", (1 - p) * size, one_hot) + weight * BELIEF[::-1]) / ((1 - p) @ size + weight)
        log = np.log(prior / (1 - prior)) + np.einsum("mv,nmv->n", np.log(yes) - np.log(no), heard)
        p = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return p


def train(features: list[tuple[int, ...]], targets: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a logistic model over sparse features, by Adagrad on soft targets."""
    weights, squares = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    if not features:
        return weights
    width = max(map(len, features))
    index = np.zeros((len(features), width), np.int64)
    mask = np.zeros((len(features), width))
    for r, f in enumerate(features):
        index[r, : len(f)] = f
        mask[r, : len(f)] = 1
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            x, on = index[rows], mask[rows]
            p = 1 / (1 + np.exp(-(weights[x] * on).sum(1)))
            grad = np.zeros(DIMENSIONS)
            np.add.at(grad, x, ((p - targets[rows])[:, None] * on) / len(rows))
            hit = np.flatnonzero(grad)
            g = grad[hit] + 1e-5 * weights[hit]
            squares[hit] += g * g
            weights[hit] -= 0.3 * g / np.sqrt(squares[hit])
    return weights


SPAN = "struct<kind int, begin int, end int, votes array<int>, features array<int>, text string>"


def proposed(notes: DataFrame) -> DataFrame:
    """(note_id, spans): the spans proposed in each note, with votes and features; notes without spans have no row."""

    def kernel(columns: list[list]):
        for i, body in zip(*columns):
            if found := spans(body):
                yield i, [(s.kind, s.begin, s.end, list(s.votes), list(s.features), body[s.begin : s.end]) for s in found]

    source = notes.filter(F.col("body") != "").select(F.col("id").cast("bigint").alias("note_id"), "body")
    return map_rows(spread(source), ["note_id", "body"], kernel, f"note_id bigint, spans array<{SPAN}>", out_rows=512)


def hidden(kind: int, features: tuple[int, ...]) -> tuple[int, ...]:
    """A name's features without its own words and its gazetteer vote: what is left is its context."""
    vote = (kind * len(VOTERS) + VOTERS.index("gazetteer")) * 2
    # ``spans`` puts the two features of a name's words after seven others.
    return tuple(f for k, f in enumerate(features) if k not in (7, 8) and f not in (vote, vote + 1))


class Model(NamedTuple):
    weights: np.ndarray
    things: frozenset[str]


NAME, GAZETTEER = KINDS.index("name"), VOTERS.index("gazetteer")
#: The feature of a name that the gazetteer denies.
DENIED = (NAME * len(VOTERS) + GAZETTEER) * 2


def names_of_things(each: DataFrame) -> DataFrame:
    """(text) of the names of things among the name spans that no gazetteer knows; see ``THING_SHARE``."""
    unknown = each.filter((F.col("s.kind") == NAME) & (F.col("s.votes")[GAZETTEER] == 0)).select("note_id", "s.text").distinct()
    pairs = unknown.groupBy("text").agg(F.count("*").alias("n")).withColumn("first", F.substring_index("text", " ", 1))
    firsts = pairs.groupBy("first").agg(F.sum("n").alias("of_first"))
    least = pairs.agg(F.greatest(F.lit(5.0), F.sum("n") * THING_SHARE).alias("least"))
    # One row, so its join is no product.
    frequent = pairs.join(F.broadcast(least), F.col("n") >= F.col("least"))
    return frequent.join(firsts, "first").filter(F.col("n") >= THING_FIRST * F.col("of_first")).select("text")


def fit(spans_of_notes: DataFrame, fit_notes: int = FIT_NOTES, fit_spans: int = FIT_SPANS) -> Model:
    """The span classifier: names of things and reliabilities from all spans, weights from a sample of bounded size."""
    each = spans_of_notes.select("note_id", F.explode("spans").alias("s"))
    things = frozenset(r["text"] for r in names_of_things(each).collect())
    thing = (F.col("s.kind") == NAME) & (F.col("s.votes")[GAZETTEER] == 0) & (F.col("s.text").isin(*things) if things else F.lit(False))
    votes = F.when(thing, F.transform("s.votes", lambda v, n: F.when(n == GAZETTEER, -1).otherwise(v))).otherwise(F.col("s.votes"))
    features = F.when(thing, F.concat("s.features", F.array(F.lit(DENIED)))).otherwise(F.col("s.features"))
    each = each.select("note_id", "s.kind", "s.begin", votes.alias("votes"), features.alias("features"))
    # At most 3 to the power of the number of labelers a kind.
    patterns = each.select("note_id", "kind", "begin", "votes").distinct().groupBy("kind", "votes").count().collect()
    sure: dict[tuple, float] = {}
    for k in range(len(KINDS)):
        part = sorted((tuple(r["votes"]), r["count"]) for r in patterns if r["kind"] == k)
        if part:
            p = reliabilities(np.array([v for v, _ in part]), counts=np.array([n for _, n in part]))
            sure.update(((k, v), x) for (v, _), x in zip(part, p))
    chosen = spans_of_notes.select("note_id", F.xxhash64("note_id").alias("by")).distinct().orderBy("by", "note_id").limit(fit_notes)
    sample = each.join(F.broadcast(chosen), "note_id").select("by", "note_id", "kind", "begin", "votes", "features").distinct()
    rows = sample.orderBy("by", "note_id", "kind", "begin", "features").limit(fit_spans).collect()
    rows = [(r["kind"], tuple(r["votes"]), tuple(r["features"])) for r in rows]
    seen = [(f, sure[k, v]) for k, v, f in rows] + [(hidden(k, f), sure[k, v]) for k, v, f in rows if k == NAME]
    return Model(train([f for f, _ in seen], np.array([p for _, p in seen])), things)


def settled(found: list[tuple[int, int, int, list[int], str]], model: Model) -> list[int]:
    """Which of the spans (kind, begin, end, features, text) of a note are personal information, without overlaps, in order."""
    scored = []
    listed = DENIED + 1
    for n, (kind, begin, end, features, text) in enumerate(found):
        score = float(model.weights[features].sum())
        if kind == NAME and text in model.things and listed not in features:
            score += float(model.weights[DENIED])
        if score > 0:
            scored.append((-score, begin, -end, n))
    taken: list[int] = []
    for _, begin, end, n in sorted(scored):
        if all(-end <= found[t][1] or begin >= found[t][2] for t in taken):
            taken.append(n)
    return sorted(taken, key=lambda n: found[n][1])


def decide(text: str, model: Model) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the personal information in a text."""
    found = [(s.kind, s.begin, s.end, list(s.features), text[s.begin : s.end]) for s in spans(text)]
    return [(KINDS[found[n][0]], found[n][1], found[n][2]) for n in settled(found, model)]


def found_items(notes: DataFrame, fit_notes: int = FIT_NOTES) -> DataFrame:
    """(note_id, kind, found_text) of each item of personal information, once a note."""
    # Bodies are read once; the fit and the decision work on the narrow spans.
    narrow = cut(proposed(notes))
    shared = notes.sparkSession.sparkContext.broadcast(fit(narrow, fit_notes))

    def kernel(columns: list[list]):
        model = shared.value
        for i, found in zip(*columns):
            for n in settled([(s["kind"], s["begin"], s["end"], s["features"], s["text"]) for s in found], model):
                yield i, KINDS[found[n]["kind"]], found[n]["text"]

    return map_rows(narrow, ["note_id", "spans"], kernel, "note_id bigint, kind string, found_text string").distinct()


def masked_notes(notes: DataFrame, fit_notes: int = FIT_NOTES) -> DataFrame:
    """(note_id, body, found): every note with placeholders for personal information; null bodies stay null."""
    shared = notes.sparkSession.sparkContext.broadcast(fit(cut(proposed(notes)), fit_notes))

    def kernel(columns: list[list]):
        model = shared.value
        for i, body in zip(*columns):
            out, at, n = [], 0, 0
            for kind, begin, end in decide(body, model) if body else ():
                out += (body[at:begin], PLACEHOLDER[kind])
                at, n = end, n + 1
            yield i, "".join(out) + body[at:] if body else body, n

    source = spread(notes.select(F.col("id").cast("bigint").alias("note_id"), "body"))
    return map_rows(source, ["note_id", "body"], kernel, "note_id bigint, body string, found int", out_rows=512)
