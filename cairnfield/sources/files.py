"""Notes and source trees as files; archives of vaults; pushed and signed requests.

Paths may be of any filesystem that Spark reads. Files that vanish between listing and reading are skipped. Archives
are read and written one vault a task, so a vault must fit a task's memory, as it does in the zip itself.
"""

from __future__ import annotations

import hashlib
import hmac
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.paths import language_of
from cairnfield.operators.ingest import IGNORED
from cairnfield.operators.markdown import parse_note, problem_of, serialize_note

ENTRY = r"^vaults/([0-9a-f-]+)/(.+)\.md$"


def _relative(root: str) -> Column:
    base = root.rstrip("/").removeprefix("file:").removeprefix("//")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/*", "/")
    return F.substring(path, len(base) + 2, 1 << 20)


def read_tree(spark: SparkSession, root: str, ignore: str = IGNORED) -> DataFrame:
    """(path, language, content, size) of the text files under a folder that the ignore pattern leaves."""
    raw = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").option("recursiveFileLookup", "true").load(root)
    rows = raw.select(_relative(root).alias("path"), F.decode("content", "UTF-8").alias("content"), F.col("length").cast("int").alias("size"))
    return rows.filter(~F.col("path").rlike(ignore)).select("path", language_of(F.col("path")).alias("language"), "content", "size")


def list_files(paths: DataFrame, ignore: str = IGNORED) -> DataFrame:
    """Paths of a listing that the ignore pattern leaves."""
    return paths.filter(~F.col("path").rlike(ignore))


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, frontmatter, body, error) of the markdown files of a vault's folder; index pages aren't notes."""
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(_relative(root).alias("file"), "value").filter("file not rlike '(^|/)index[.]md$'")
    parsed = raw.select(F.regexp_replace("file", r"\.md$", "").alias("path"), parse_note(F.col("value")).alias("n"))
    return parsed.select("path", "n.frontmatter", "n.body", "n.error")


def write_notes(notes: DataFrame, root: str) -> None:
    """Serialised notes as one text file a task, beside a column of paths: written whole, by the commit protocol."""
    notes.select("path", serialize_note(F.col("frontmatter"), F.col("body")).alias("text")).write.mode("overwrite").json(root)


def write_pushes(files: DataFrame, manifest: DataFrame, folder: str, chunk: int = 200) -> None:
    """The requests that push files (repository_id, path, content) and a manifest (repository_id, path), one a line.

    A request has about ``chunk`` paths at most, dealt out by a hash, so a repository of any size is many requests.
    """
    size = files.select("repository_id", "path").unionByName(manifest.select("repository_id", "path")).groupBy("repository_id").agg(F.ceil(F.count("*") / chunk).alias("parts"))
    rows = files.select("repository_id", "path", F.struct("path", "content").alias("f")).unionByName(manifest.select("repository_id", "path"), allowMissingColumns=True)
    part = F.pmod(F.xxhash64("path"), F.col("parts"))
    each = rows.join(size, "repository_id").groupBy("repository_id", part.alias("part"))
    # ``collect_list`` skips nulls: a row is either a file or an entry of the manifest.
    requests = each.agg(F.collect_list("f").alias("files"), F.collect_list(F.when(F.col("f").isNull(), F.col("path"))).alias("currentPaths"))
    requests.drop("part").write.mode("overwrite").json(folder)


def pushed_files(spark: SparkSession, folder: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files, manifest) of pushed JSON requests: {repository_id, files: [{path, content}], currentPaths: []}.

    Each file of the folder is one request, or with ``lines`` has a request a line.
    """
    schema = "repository_id bigint, files array<struct<path:string,content:string>>, currentPaths array<string>"
    raw = spark.read.schema(schema).json(folder, multiLine=not lines)
    files = raw.select("repository_id", F.explode("files").alias("f")).select("repository_id", "f.path", "f.content")
    return files, raw.select("repository_id", F.explode("currentPaths").alias("path"))


def signature_valid(secret: str) -> Column:
    """A vectorised check of ``signature`` ('sha256=<hex>') against the HMAC of ``body``, in constant time."""

    @F.pandas_udf("boolean")
    def check(body: pd.Series, signature: pd.Series) -> pd.Series:
        key = secret.encode()
        return pd.Series([isinstance(b, str) and isinstance(s, str) and hmac.compare_digest("sha256=" + hmac.new(key, b.encode(), hashlib.sha256).hexdigest(), s) for b, s in zip(body, signature)])

    return check(F.col("body"), F.col("signature"))


def archive_entries(names: Column) -> tuple[Column, Column]:
    """Vault id and note path of an archive entry's name; null for entries that are no notes."""
    hit = names.rlike(ENTRY)
    return F.when(hit, F.regexp_extract(names, ENTRY, 1)), F.when(hit, F.regexp_extract(names, ENTRY, 2))


def vault_archives(notes: DataFrame, manifests: DataFrame) -> DataFrame:
    """(vault_id, archive): a zip of each vault's live notes and its manifest (vault_id, manifest as JSON)."""
    texts = notes.filter("deleted_at is null").select("vault_id", "path", serialize_note(F.col("frontmatter"), F.col("body")).alias("text")).dropDuplicates(["vault_id", "path"])
    rows = texts.unionByName(manifests.select("vault_id", F.lit("manifest.json").alias("path"), F.col("manifest").alias("text")))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for path, text in sorted(zip(frame["path"], frame["text"])):
                z.writestr(zipfile.ZipInfo(path if path == "manifest.json" else f"{path}.md"), text or "")
        return pd.DataFrame({"vault_id": [frame["vault_id"].iloc[0]], "archive": [data.getvalue()]})

    return rows.groupBy("vault_id").applyInPandas(pack, f"vault_id {notes.schema['vault_id'].dataType.simpleString()}, archive binary")


def import_archives(archives: DataFrame) -> DataFrame:
    """(vault_id, path, frontmatter, body, problem) of the notes in zips; notes that break a rule say which."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for vault, data in zip(frame["vault_id"], frame["archive"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    rows += [(vault, n[:-3], z.read(n).decode("utf-8", "replace")) for n in z.namelist() if n.endswith(".md")]
            yield pd.DataFrame(rows, columns=["vault_id", "path", "text"])

    kind = archives.schema["vault_id"].dataType.simpleString()
    raw = archives.select("vault_id", "archive").mapInPandas(unpack, f"vault_id {kind}, path string, text string")
    parsed = raw.select("vault_id", "path", parse_note(F.col("text")).alias("n"))
    rule = problem_of(F.split_part("path", F.lit("/"), F.lit(1)), F.split_part("path", F.lit("/"), F.lit(2)), F.col("n.frontmatter"), F.col("n.body"))
    return parsed.select("vault_id", "path", F.col("n.frontmatter").alias("frontmatter"), F.col("n.body").alias("body"), F.coalesce(F.col("n.error"), rule).alias("problem"))


def manifests(vaults: DataFrame, shares: DataFrame, users: DataFrame, teams: DataFrame) -> DataFrame:
    """(vault_id, manifest): name and shares of each vault as JSON, grantees by e-mail or team name."""
    named = shares.join(users.select(F.col("id").alias("grantee_id"), F.lit("user").alias("grantee_type"), F.col("email").alias("user_name")), ["grantee_type", "grantee_id"], "left")
    named = named.join(teams.select(F.col("team_id").alias("grantee_id"), F.lit("team").alias("grantee_type"), F.col("name").alias("team_name")), ["grantee_type", "grantee_id"], "left")
    each = named.groupBy("vault_id").agg(F.array_sort(F.collect_set(F.struct("grantee_type", F.coalesce("user_name", "team_name").alias("grantee"), "permission"))).alias("shares"))
    full = vaults.select(F.col("id").alias("vault_id"), "name").join(each, "vault_id", "left")
    return full.select("vault_id", F.to_json(F.struct("name", "shares")).alias("manifest"))


def backup(tables: dict[str, DataFrame], folder: str) -> None:
    """Every table as JSON lines in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def restore(spark: SparkSession, folder: str, schemas: dict[str, str], existing: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a backup with their ids and times as they were. ``schemas``: DDL by table.

    Only an empty instance is restored: if any of the ``existing`` tables has a row, it is an error.
    """
    for name, df in (existing or {}).items():
        if not df.isEmpty():
            raise ValueError(f"{name} has rows; only an empty instance can be restored")
    return {name: spark.read.schema(ddl).json(f"{folder}/{name}") for name, ddl in schemas.items()}

