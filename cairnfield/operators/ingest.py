"""Snapshot ingestion of files: what was created, updated, deleted or left as it was, by content hash.

Results: an incoming path may come once only; repeated paths are an error, reported by ``repeated_paths``. Null content
hashes as empty. ``unchanged`` counts only files that were submitted; a path that is merely listed counts nowhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.paths import import_candidates, language_of

IGNORED = r"(^|/)(\.git|node_modules|dist|build|\.next|coverage|__pycache__|\.venv)(/|$)"


def content_hash(content: Column) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def repeated_paths(incoming: DataFrame) -> DataFrame:
    return incoming.groupBy("repository_id", "path").agg(F.count("*").alias("copies")).filter("copies > 1")


def sync_diff(existing: DataFrame, incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """(repository_id, path, status). existing: repository_id, path, content_hash; incoming: repository_id, path,
    content; manifest: repository_id, path of all files that are there now. Only repositories in ``incoming`` or
    ``manifest`` are synced; an empty manifest of a repository that has incoming files deletes all its older files."""
    old = existing.select("repository_id", "path", "content_hash").dropDuplicates(["repository_id", "path"])
    new = incoming.select("repository_id", "path", content_hash(F.col("content")).alias("new_hash"))
    synced = incoming.select("repository_id").unionByName(manifest.select("repository_id")).distinct()
    joined = old.join(new, ["repository_id", "path"], "full_outer")
    changed = joined.filter("new_hash is not null").select("repository_id", "path", F.when(F.col("content_hash").isNull(), "created").when(F.col("content_hash") == F.col("new_hash"), "unchanged").otherwise("updated").alias("status"))
    gone = old.join(synced, "repository_id", "left_semi").join(manifest.select("repository_id", "path").distinct(), ["repository_id", "path"], "left_anti").select("repository_id", "path", F.lit("deleted").alias("status"))
    return changed.unionByName(gone)


def sync_summary(diff: DataFrame) -> DataFrame:
    """(repository_id, created, updated, deleted, unchanged)."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("created", "updated", "deleted", "unchanged")]
    return diff.groupBy("repository_id").agg(*counts)


def next_files(existing: DataFrame, incoming: DataFrame, manifest: DataFrame, now: Column) -> DataFrame:
    """Files after a sync: ids of updated files stay, new files get none yet, unchanged ones keep their times.

    A just created file that the manifest lacks goes again, if the sync also deletes an older file.
    """
    diff = sync_diff(existing, incoming, manifest)
    fresh = incoming.select("repository_id", "path", F.col("content").alias("_content"))
    old = existing.dropDuplicates(["repository_id", "path"])
    listed = manifest.select("repository_id", "path").distinct().withColumn("_listed", F.lit(True))
    deletes = diff.filter("status = 'deleted'").select("repository_id").distinct().withColumn("_deletes", F.lit(True))
    out = diff.join(fresh, ["repository_id", "path"], "left").join(old, ["repository_id", "path"], "full_outer").join(listed, ["repository_id", "path"], "left").join(deletes, "repository_id", "left")
    out = out.filter("(status is null or status <> 'deleted') and not (coalesce(status, '') in ('created', 'updated') and _listed is null and coalesce(_deletes, false))")
    write = F.coalesce(F.col("status").isin("created", "updated"), F.lit(False))
    text = F.coalesce("_content", F.lit(""))
    return out.select("id", "repository_id", "path", F.when(write, language_of(F.col("path"))).otherwise(F.col("language")).alias("language"), F.when(write, text).otherwise(F.col("content")).alias("content"), F.when(write, F.sha2(text, 256)).otherwise(F.col("content_hash")).alias("content_hash"), F.when(write, F.octet_length(text)).otherwise(F.col("size")).alias("size"), F.when(write, now).otherwise(F.col("updated_at")).alias("updated_at"))


def should_poll(last_webhook: Column, last_sync: Column, now: Column, threshold_seconds: int) -> Column:
    """Whether a repository must be polled: it never had a webhook, or the last one is stale and newer than the sync."""
    age = F.unix_micros(now) - F.unix_micros(last_webhook)
    return F.when(last_webhook.isNull(), True).when(age <= threshold_seconds * 1_000_000, False).otherwise(last_sync.isNull() | (last_sync < last_webhook))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file_id, target_path, resolved_file_id) of relative imports: the first candidate path that exists.

    Of files with one path the smallest id counts; imports that find nothing have a null id.
    """
    sources = files.groupBy(F.col("id").alias("source_file_id")).agg(F.max("repository_id").alias("repository_id"), F.max("path").alias("source_path"))
    known = files.groupBy("repository_id", "path").agg(F.min("id").alias("file_id"))
    asked = imports.filter("target_path like '.%'").select("source_file_id", "target_path").distinct().join(sources, "source_file_id")
    tried = asked.select("source_file_id", "target_path", "repository_id", F.posexplode(import_candidates(F.col("source_path"), F.col("target_path"))).alias("pos", "path"))
    hits = tried.join(known, ["repository_id", "path"]).groupBy("source_file_id", "target_path").agg(F.min_by("file_id", "pos").alias("resolved_file_id"))
    return asked.select("source_file_id", "target_path").join(hits, ["source_file_id", "target_path"], "left")
