"""References to records that don't exist, are in the trash or came later (problem 7).

The keys of all parents go into a Bloom filter, built in parallel and sent to every executor; its size is bounded, so
it stays sendable however many keys there are (from about 20 million on it lets more and more references through, which
costs time but no result). A reference that the filter denies is an orphan for certain. Only those it lets through are
looked up by an exact join, which also compares times. Relative imports are tried in the order of their candidate
paths; all other references have one candidate. Each reference is tested once, and all kinds share one join.

Results: a reference is reported once, however often it was delivered. A source that is missing from its table has no
time to compare, so its references are orphans with a null period. Null targets refer to nothing and are skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.paths import import_candidates

#: Most bits of the filter (32 MB, in whole words of 64) and hashes of a key.
FILTER_BITS, FILTER_HASHES = 1 << 28, 4
BITS_A_KEY = 12
#: Copies of each parent that its references are dealt out to.
COPIES = 8


class Bloom:
    """Bits of a Bloom filter over 64-bit hashes."""

    def __init__(self, words: np.ndarray, bits: int) -> None:
        self.words, self.bits = words, bits

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        """Bit numbers of each key, one row a hash: double hashing of the two halves."""
        k = keys.view(np.uint64)
        with np.errstate(over="ignore"):
            a = k & np.uint64(0xFFFFFFFF)
            b = (k >> np.uint64(32)) | np.uint64(1)
            steps = np.arange(1, FILTER_HASHES + 1, dtype=np.uint64)[:, None]
            return (a[None] * np.uint64(0x9E3779B1) + b[None] * steps * np.uint64(0x85EBCA77)) % np.uint64(bits)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self.places(keys, self.bits)
        found = (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return found.all(0)


def build_filter(keys: DataFrame, bits: int = FILTER_BITS) -> Bloom:
    """A filter of the 64-bit hashes in the column ``key``; words are merged by key range before they reach the driver."""
    size = keys.count()
    bits = max(64, min(bits, 1 << max(6, int(size * BITS_A_KEY).bit_length())))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        field = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            at = Bloom.places(batch["key"].to_numpy(np.int64), bits).ravel()
            np.bitwise_or.at(field, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(field)
        for a in range(0, len(used), 65536):
            part = used[a : a + 65536]
            yield pd.DataFrame({"at": part.astype(np.int64), "bits": field[part].view(np.int64)})

    rows = keys.select("key").mapInPandas(words, "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    field = np.zeros(bits // 64, np.uint64)
    if rows.num_rows:
        field[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Bloom(field, bits)


def _key(*parts: str) -> Column:
    """Hash of a key and of the kind of parent it belongs to; one filter holds the keys of all kinds."""
    return F.xxhash64(*parts)


def _tested(refs: DataFrame, shared) -> DataFrame:
    """``refs`` with the column ``possible``: false if no parent has the reference's ``key``."""

    def possible(key: pd.Series) -> pd.Series:
        return pd.Series(shared.value.may_hold(key.to_numpy(np.int64)))

    return refs.withColumn("possible", F.pandas_udf(possible, "boolean")("key"))


def orphan_references(notes: DataFrame, note_links: DataFrame, repositories: DataFrame, files: DataFrame, imports: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """(ref_table, source_id, target_path, updated_at, reason) of every orphan reference, each once."""
    spark = notes.sparkSession
    # A repeated row is dropped by its key; of records under one key the earliest counts.
    note_rows = notes.select(F.col("id").cast("bigint").alias("source_id"), F.col("vault_id").cast("bigint").alias("vault_id"), F.col("path").alias("path"), "deleted_at", "created_at", "updated_at")
    file_rows = files.select(F.col("id").cast("bigint").alias("source_id"), F.col("repository_id").cast("bigint").alias("repository_id"), F.col("path").alias("path"), "created_at", "updated_at")
    note_sources = note_rows.groupBy("source_id").agg(F.max("vault_id").alias("vault_id"), F.max("updated_at").alias("updated_at"))
    file_sources = file_rows.groupBy("source_id").agg(F.max("repository_id").alias("repository_id"), F.max("updated_at").alias("updated_at"), F.max("path").alias("source_path"))
    # All parents as one frame: a note by vault and path, a file by repository and path, and a file by its id.
    parent = lambda df, kind, number, path: df.select(F.lit(kind).alias("parent"), F.col(number).alias("number"), path.alias("path"), "created_at")
    parents = parent(note_rows.filter("deleted_at is null and path is not null"), "note", "vault_id", F.col("path"))
    parents = parents.unionByName(parent(file_rows.filter("path is not null"), "file", "repository_id", F.col("path"))).unionByName(parent(file_rows, "id", "source_id", F.lit("")))

    links = note_links.filter("target_path is not null").select(F.col("source_note_id").cast("bigint").alias("source_id"), "target_path").distinct().join(note_sources, "source_id", "left").withColumn("ref_table", F.lit("note_links"))
    is_repo = F.col("target_path").startswith("repo:") & F.col("target_path").contains("/")
    plain = links.filter(~is_repo).withColumn("path", F.col("target_path"))
    named = repositories.select(F.col("id").cast("bigint").alias("repository_id"), F.col("name").alias("repository_name")).groupBy("repository_name").agg(F.max("repository_id").alias("repository_id"))
    to_files = links.filter(is_repo).select(
        "ref_table", "source_id", "target_path", "updated_at",
        F.regexp_extract("target_path", r"^repo:([^/]*)/(?s:(.*))$", 1).alias("repository_name"),
        F.regexp_extract("target_path", r"^repo:([^/]*)/(?s:(.*))$", 2).alias("path"),
    ).join(named, "repository_name", "left")

    refs = imports.filter("target_path is not null or resolved_target_file_id is not null").select(F.col("source_file_id").cast("bigint").alias("source_id"), "target_path", F.col("resolved_target_file_id").cast("bigint").alias("target_id"))
    # Packages, the bulk of the table and its hottest key, go before any shuffle.
    refs = refs.filter("target_id is not null or target_path like '.%'").distinct().join(file_sources, "source_id", "left").withColumn("ref_table", F.lit("repository_file_imports"))
    by_id = refs.filter("target_id is not null")
    relative = refs.filter("target_id is null")

    # Repeated keys set the same bits, so the filter is built from the scans as they are, without a shuffle.
    shared = spark.sparkContext.broadcast(build_filter(parents.select(_key("parent", "number", "path").alias("key")), bits))

    def tried(df: DataFrame, kind: str, number: str, path: Column, pos: Column = F.lit(0), ref: Column = F.lit(None)) -> DataFrame:
        return df.select("ref_table", "source_id", "target_path", "updated_at", ref.cast("bigint").alias("ref"), pos.alias("pos"), F.lit(kind).alias("parent"), F.col(number).alias("number"), path.alias("path"))

    candidates = relative.select("*", F.posexplode_outer(import_candidates(F.col("source_path"), F.col("target_path"))).alias("pos", "candidate"))
    refs = tried(plain, "note", "vault_id", F.col("path"))
    refs = refs.unionByName(tried(to_files, "file", "repository_id", F.col("path")))
    refs = refs.unionByName(tried(by_id, "id", "target_id", F.lit(""), ref=F.col("target_id")))
    refs = refs.unionByName(tried(candidates, "file", "repository_id", F.col("candidate"), F.coalesce("pos", F.lit(0))))
    tested = _tested(refs.withColumn("key", _key("parent", "number", "path")), shared).drop("key")
    # What the filter denies is missing; one row of each reference stays, under a key of its own that matches nothing.
    # A parent that a third of all references name is no single task's: references are dealt out to copies of it.
    number = F.when(F.col("possible"), F.col("number")).otherwise(F.xxhash64("source_id", "target_path")).alias("number")
    key = (F.when(F.col("possible"), F.col("parent")).otherwise("none").alias("parent"), number, "path", F.pmod(F.xxhash64("source_id"), F.lit(COPIES)).cast("int").alias("copy"))
    kept = tested.filter("possible or pos = 0").select("ref_table", "source_id", "target_path", "updated_at", "ref", "pos", *key)
    known = parents.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).groupBy("parent", "number", "path", "copy").agg(F.min("created_at").alias("created_at"), F.lit(True).alias("there"))
    both = kept.join(known, ["parent", "number", "path", "copy"], "left")
    ref_keys = ["ref_table", "source_id", "target_path"]
    # Each reference is judged by its first candidate that exists, then the references of one source and target together.
    first = F.min(F.when(F.col("there"), F.struct("pos", "created_at"))).alias("hit")
    judged = both.repartition(*ref_keys).groupBy(*ref_keys, "ref").agg(F.max("updated_at").alias("updated_at"), first)
    late = judged.filter("hit is null or updated_at is null or hit.created_at is null or hit.created_at > updated_at").withColumn("reason", F.when(F.col("hit").isNull(), "missing").otherwise("later"))
    return late.groupBy(*ref_keys).agg(F.max("updated_at").alias("updated_at"), F.min("reason").alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(ref_table, period, reason, orphans): counts per table and month of the source's last update."""
    return orphans.groupBy("ref_table", F.date_format("updated_at", "yyyy-MM").alias("period"), "reason").agg(F.count("*").alias("orphans"))
