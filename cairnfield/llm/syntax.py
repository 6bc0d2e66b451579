"""Source files that are not valid in their language (problem 5).

A file is cut into chunks at line ends. Each chunk becomes a map from every lexer state it may begin in to a summary
of its brackets and its mask (``lexing``); maps combine associatively into the file's verdict on literals, comments and
brackets, and into the mask from which the balanced statements are read by the local grammars of the language
(``grammars``; Python's statements are parsed one by one).

Every text takes this path. What differs is where it runs: a text of one segment is reduced in the task that reads it;
the segments of longer texts become rows that are dealt out by (file, segment), mapped there, and reduced by file, in
the order of their segments, in a second shuffle. Short texts are never shuffled.

Results: files whose language is null or none of those known are not judged; null content counts as empty; empty
files and files of only comments are valid; a leading byte order mark is ignored. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import lexing
from cairnfield.functions.arrow import map_rows, spread
from cairnfield.llm import grammars

#: Characters of a chunk, and of the segments in which longer texts are dealt out.
CHUNK, SEGMENT = 4_096, 262_144

States = dict[str, lexing.Summary]


def plain(text: str, language: str) -> str:
    """The text that is judged: without a byte order mark, and for ruby without the data at its end."""
    if text[:1] == "\ufeff":
        text = text[1:]
    return text.partition("\n__END__\n")[0] if language == "ruby" else text


def segment_map(text: str, language: str, first: bool, size: int) -> States:
    """The state map of a segment, reduced from those of its chunks."""
    parts = lexing.chunks(text, size)
    out = lexing.state_map(parts[0], language, first)
    for part in parts[1:]:
        if first:
            # From a text's begin on the state is known, so what the map of a chunk can't tell is read again at once.
            out = {"C": lexing.follow(out["C"], lexing.state_map(part, language), part, language)}
        else:
            out = lexing.join_maps(out, lexing.state_map(part, language))
    return out


def verdict(text: str, language: str, whole: lexing.Summary) -> str | None:
    """What is wrong with a text by its reduced summary: ``lexical``, ``bracket`` or ``statement``; None if it is valid."""
    if whole.bad or whole.end != "C":
        return "lexical"
    if whole.openers or whole.closers:
        return "bracket"
    if language == "python":
        return None if grammars.valid_python(text, whole.mask) else "statement"
    return None if grammars.valid_statements(whole.mask, language) else "statement"


def judge(text: str, language: str, chunk: int = CHUNK, segment: int = SEGMENT) -> str | None:
    """The verdict on a text, reduced in one place."""
    text = plain(text, language)
    parts = lexing.chunks(text, segment)
    whole = segment_map(parts[0], language, True, chunk)["C"]
    for part in parts[1:]:
        whole = lexing.follow(whole, segment_map(part, language, False, chunk), part, language)
    return verdict(text, language, whole)


def _packed(states: States) -> list[tuple]:
    return [(s, *x) for s, x in states.items()]


MAP = "array<struct<state string, end string, closers string, openers string, bad boolean, clear boolean, mask string>>"


def judged_files(files: DataFrame, chunk: int = CHUNK, segment: int = SEGMENT) -> DataFrame:
    """(file_id, repository_id, language, problem): every file of a known language; ``problem`` is null if valid."""
    named = files.filter(F.lower("language").isin(sorted(lexing.LANGUAGES)))
    source = named.select(F.col("id").cast("bigint").alias("file_id"), "repository_id", F.lower("language").alias("language"), F.coalesce("content", F.lit("")).alias("content"))
    kind = files.schema["repository_id"].dataType.simpleString()
    keys = f"file_id bigint, repository_id {kind}, language string"

    def whole(columns: list[list]):
        for i, repository, language, text in zip(*columns):
            yield i, repository, language, judge(text, language, chunk, segment)

    def cut(columns: list[list]):
        for i, repository, language, text in zip(*columns):
            for n, part in enumerate(lexing.chunks(plain(text, language), segment)):
                yield i, repository, language, n, part

    def represent(columns: list[list]):
        for i, repository, language, n, part in zip(*columns):
            yield i, repository, language, n, part, _packed(segment_map(part, language, n == 0, chunk))

    def reduce(batches: Iterator):
        # Segments arrive sorted by file and place; one file at a time is open.
        import pyarrow as pa

        now, whole, parts = None, None, []

        def closed() -> pa.RecordBatch:
            i, repository, language = now
            row = (i, repository, language, verdict("".join(parts), language, whole))
            return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types)], names=["file_id", "repository_id", "language", "problem"])

        for batch in batches:
            types = [batch.schema.field(k).type for k in range(3)] + [pa.string()]
            for i, repository, language, n, part, packed in zip(*(c.to_pylist() for c in batch.columns)):
                states = {x["state"]: lexing.Summary(*(x[f] for f in lexing.Summary._fields)) for x in packed}
                if n == 0:
                    if now is not None and now != (i, repository, language):
                        yield closed()
                    now, whole, parts = (i, repository, language), states["C"], [part]
                elif len(parts) == n:  # a repeated row's segments stand next to the first one's
                    whole = lexing.follow(whole, states, part, language)
                    parts.append(part)
        if now is not None:
            yield closed()

    columns = ["file_id", "repository_id", "language", "content"]
    short = map_rows(spread(source.filter(F.char_length("content") <= segment)), columns, whole, f"{keys}, problem string")
    rows = map_rows(source.filter(F.char_length("content") > segment), columns, cut, f"{keys}, n int, part string", out_rows=8)
    dealt = rows.repartition("file_id", "n")
    mapped = map_rows(dealt, ["file_id", "repository_id", "language", "n", "part"], represent, f"{keys}, n int, part string, map {MAP}", out_rows=8)
    order = ["file_id", "repository_id", "language", "n"]
    long = mapped.dropDuplicates(order).repartition("file_id", "repository_id", "language").sortWithinPartitions(*order).mapInArrow(reduce, f"{keys}, problem string")
    return short.unionByName(long)


def invalid_files(files: DataFrame) -> DataFrame:
    """(file_id) of the files that are not valid in their language."""
    return judged_files(files).filter(F.col("problem").isNotNull()).select("file_id").distinct()


def invalid_rates(files: DataFrame) -> DataFrame:
    """(repository_id, language, files, invalid, rate): the share of invalid files; repeated rows count once."""
    return judged_files(files).distinct().groupBy("repository_id", "language").agg(F.count("*").alias("files"), F.count("problem").alias("invalid"), F.round(F.count("problem") / F.count("*"), 6).alias("rate"))
