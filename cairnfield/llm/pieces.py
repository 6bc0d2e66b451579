"""Cutting oversized texts into overlapping pieces at natural boundaries (problem 6).

A hierarchy of separators: section, paragraph, line, sentence, word, character. A text is cut into atoms at the coarsest
separators; an atom above the limit is cut again at the next finer ones, down to single characters. Atoms are then
packed greedily; each piece begins with the last ``overlap`` characters of the piece before it.

Lengths are in Unicode code points. Results: a text of at most ``limit`` characters, an empty text and a null text
have no pieces. For every other text, piece 0 and the tails of the others after their overlap give the text back
exactly. Repeated rows (the same id and text) give each piece once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.arrow import map_rows

LIMIT, OVERLAP = 6000, 300

#: From coarse to fine; a cut is at the end of a match. The last level, single characters, needs no pattern.
LEVELS: tuple[tuple[str, re.Pattern], ...] = (
    ("section", re.compile(r"\n(?=#{1,6} |={3,}|-{3,}\n|(?:export |public |async |pub |abstract )*(?:class|def|func|function|fn|impl|interface|struct|type|module)\b)")),
    ("paragraph", re.compile(r"\n[ \t\r]*\n\s*")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[.!?…。！？]+[\"'”’)\]]*\s+|[;{}]\s*|[。！？]")),
    ("word", re.compile(r"\s+|[,:]\s*")),
)


def cuts(text: str, begin: int, end: int, room: int, level: int = 0) -> Iterator[tuple[int, str]]:
    """Ends of the atoms of text[begin:end], each of at most ``room`` characters, with the kind of boundary."""
    if level == len(LEVELS):
        for at in range(begin + room, end, room):
            yield at, "character"
        yield end, "character"
        return
    kind, pattern = LEVELS[level]
    at = begin
    for found in [*(m.end() for m in pattern.finditer(text, begin, end)), end]:
        if found <= at:
            continue
        if found - at > room:
            last = None
            for inner in cuts(text, at, found, room, level + 1):
                if last is not None:
                    yield last
                last = inner
            # The atom's own end is a boundary of this level.
            yield found, kind
        else:
            yield found, kind
        at = found


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(begin, end, boundary at the end) of the pieces of a text above the limit; the last boundary is ``end``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    n = len(text)
    if n <= limit:
        return []
    # Coarse boundaries first: an end is moved back to the coarsest boundary that keeps the piece at least half full.
    rank = {k: i for i, (k, _) in enumerate(LEVELS)} | {"character": len(LEVELS)}
    atoms = list(cuts(text, 0, n, limit - overlap))
    out: list[tuple[int, int, str]] = []
    begin, k = 0, 0
    while True:
        if n - begin <= limit:
            out.append((begin, n, "end"))
            return out
        least = begin + (limit + overlap) // 2 if out else begin + limit // 2
        first, best = k, -1
        while k < len(atoms) and atoms[k][0] - begin <= limit:
            if atoms[k][0] >= least and (best < 0 or rank[atoms[k][1]] <= rank[atoms[best][1]]):
                best = k
            k += 1
        if best < 0:
            best = k - 1
        assert best >= first, "an atom is larger than a piece"
        out.append((begin, atoms[best][0], atoms[best][1]))
        k = best + 1
        begin = atoms[best][0] - overlap


def split_column(df: DataFrame, id_col: str, text_col: str, label: str | Column, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_id, piece_no, begin_at, end_at, boundary, piece) of the texts above ``limit``.

    The length test runs in the JVM, so only oversized texts reach Python; identical rows are dropped among those.
    """
    item = F.lit(label) if isinstance(label, str) else label
    large = df.select(item.alias("item_table"), F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).filter(F.char_length("text") > limit)

    def kernel(columns: list[list]):
        for table, i, text in zip(*columns):
            for no, (begin, end, boundary) in enumerate(pieces(text, limit, overlap)):
                yield table, i, no, begin, end, boundary, text[begin:end]

    schema = "item_table string, item_id bigint, piece_no int, begin_at int, end_at int, boundary string, piece string"
    return map_rows(large, ["item_table", "item_id", "text"], kernel, schema, out_rows=256)


def split_items(notes: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of all oversized notes and files; each piece once, however often a row was delivered."""
    both = split_column(notes, "id", "body", "notes", limit, overlap).unionByName(split_column(files, "id", "content", "repository_files", limit, overlap))
    return both.dropDuplicates(["item_table", "item_id", "piece_no", "begin_at", "end_at"])


def oversized_items(notes: DataFrame, files: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_id) of the items that were split."""
    both = split_column(notes, "id", "body", "notes", limit, overlap).unionByName(split_column(files, "id", "content", "repository_files", limit, overlap))
    return both.filter("piece_no = 0").select("item_table", "item_id").distinct()
