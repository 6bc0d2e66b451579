"""Paths and file names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions tried for an import, in this order.
IMPORT_EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go")
# Languages by extension.
LANGUAGE_OF = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp",
}


def language_of(path: Column) -> Column:
    """Language by a path's last extension, in any case; null if it is none of those known."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def folder_of(path: Column) -> Column:
    """Directory part of a path, ``.`` if it has none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(?s:(.*))/[^/]*$", 1)).otherwise(F.lit("."))


def normalized(path: Column) -> Column:
    """A posix path without ``.``, ``..`` and empty parts; leading ``..`` of a relative path stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    up = F.lit("..")
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == up) & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("")), acc), -1) != up), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.array_join(folded, "/")


def import_candidates(source: Column, specifier: Column) -> Column:
    """The paths a relative specifier may mean, in the order in which they are tried; null for any other specifier."""
    base = normalized(F.concat(folder_of(source), F.lit("/"), specifier))
    # A specifier that ends in a slash names a folder, never a file; the root's own files have no folder.
    file = F.when(specifier.endswith("/"), F.concat(base, F.lit("/"))).otherwise(F.when(base == "", F.lit(".")).otherwise(base))
    index = F.when(base == "", F.lit("index")).otherwise(F.concat(base, F.lit("/index")))
    tries = [file, *(F.concat(file, F.lit(e)) for e in IMPORT_EXTENSIONS), *(F.concat(index, F.lit(e)) for e in IMPORT_EXTENSIONS)]
    return F.when(specifier.startswith("."), F.array(*tries))
