"""Notes as markdown files with frontmatter: parsing, checking, serialising, links.

Results: a text without a frontmatter fence, or with one that isn't a mapping, gives an error and no fields; a null
text gives null fields and the error ``empty``. Links are trimmed and each kept once, in order of appearance.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of slugs, fences and links.
SLUG = "^[a-z0-9][a-z0-9-]*$"
FENCE = r"^---\n([\s\S]*?)\n?---\n?([\s\S]*)$"
LINK = r"\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]"


def wikilinks(body: Column) -> Column:
    """Targets of the links in a body, without alias or heading."""
    found = F.transform(F.regexp_extract_all(body, F.lit(LINK), 1), lambda t: F.trim(t))
    return F.array_distinct(F.filter(found, lambda t: t != ""))


def is_slug(name: Column) -> Column:
    return F.coalesce(name.rlike(SLUG), F.lit(False))


def valid_path(path: Column) -> Column:
    """Whether a path is a type and a name, both slugs."""
    parts = F.split(path, "/")
    return F.coalesce((F.size(parts) == 2) & F.forall(parts, is_slug), F.lit(False))


def problem_of(type_: Column, name: Column, frontmatter: Column, body: Column) -> Column:
    """The first rule a note breaks, in a fixed order; null if it is valid. ``frontmatter`` is JSON text."""
    fields = F.try_parse_json(frontmatter)
    kind = lambda v: F.schema_of_variant(v)
    field = lambda name: F.try_variant_get(fields, f"$.{name}", "variant")
    elements = lambda v: F.try_variant_get(v, "$", "array<variant>")
    nested = lambda v: kind(v).startswith("OBJECT") | kind(v).startswith("ARRAY")
    bad_value = lambda v: kind(v).startswith("OBJECT") | F.coalesce(F.exists(elements(v), nested), F.lit(False))
    fm_type, tags, time, resource = (field(n) for n in ("type", "tags", "timestamp", "resource"))
    type_text, time_text = (F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")) for v in (fm_type, time))
    return (
        F.when(~is_slug(type_), "type is not a slug")
        .when(~is_slug(name), "name is not a slug")
        .when(type_text.isNull() | (type_text != type_), "frontmatter type differs")
        .when(tags.isNotNull() & ~F.coalesce(F.forall(elements(tags), lambda x: kind(x) == "STRING"), F.lit(False)), "tags are not a list of strings")
        .when(time.isNotNull() & F.try_to_timestamp(time_text).isNull(), "timestamp is not a date")
        .when(resource.isNotNull() & (kind(resource) != "STRING"), "resource is not a string")
        .when(F.exists(F.map_values(F.try_variant_get(fields, "$", "map<string,variant>")), bad_value), "a value is neither a scalar nor a list of scalars")
        .when(body.isNull(), "body is missing")
    )


def parse_note(raw: Column) -> Column:
    """Frontmatter as JSON, body and error of raw note texts, as a struct."""
    return F.pandas_udf(_parsed, "struct<frontmatter string, body string, error string>")(raw)


def _parsed(raw: pd.Series) -> pd.DataFrame:
    import re

    import yaml

    fence, out = re.compile(FENCE), []
    for text in raw:
        if text is None:
            out.append((None, None, "empty"))
            continue
        m = fence.match(text)
        if not m:
            out.append((None, None, "missing frontmatter"))
            continue
        try:
            fields = yaml.safe_load(m[1])
        except yaml.YAMLError:
            out.append((None, None, "frontmatter is not YAML"))
            continue
        if not isinstance(fields, dict):
            out.append((None, None, "frontmatter is not a mapping"))
            continue
        out.append((json.dumps(fields, default=str, ensure_ascii=False), m[2], None))
    return pd.DataFrame(out, columns=["frontmatter", "body", "error"])


def serialize_note(frontmatter: Column, body: Column) -> Column:
    """Raw note texts from frontmatter (JSON) and body; null frontmatter is an empty mapping."""
    return F.pandas_udf(_serialized, "string")(frontmatter, body)


def _serialized(frontmatter: pd.Series, body: pd.Series) -> pd.Series:
    import yaml

    def one(fm, text):
        fields = json.loads(fm) if fm else {}
        head = yaml.safe_dump(fields, sort_keys=False, allow_unicode=True, default_flow_style=False) if fields else "{}\n"
        return f"---\n{head}---\n{text or ''}"

    return pd.Series([one(f, b) for f, b in zip(frontmatter, body)])


def canonical_json(frontmatter: Column) -> Column:
    """JSON text with its keys in order, so that equal maps are equal texts."""
    entries = F.array_sort(F.map_entries(F.from_json(frontmatter, "map<string,string>")))
    return F.to_json(F.map_from_entries(entries))


def note_links(notes: DataFrame) -> DataFrame:
    """(source_note_id, target_path) of all links in bodies."""
    return notes.select(F.col("id").alias("source_note_id"), F.explode(wikilinks(F.col("body"))).alias("target_path"))


def type_index(notes: DataFrame) -> DataFrame:
    """(vault_id, type, content): an index page for each type of a vault, its live notes ordered by name."""
    rows = notes.filter("deleted_at is null").groupBy("vault_id", "type").agg(F.array_sort(F.collect_set(F.struct("name", "path"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda n: F.concat(F.lit("- [["), n["path"], F.lit("]]"))), "\n")
    return rows.select("vault_id", "type", F.concat(F.lit("# "), F.col("type"), F.lit("\n"), lines).alias("content"))
