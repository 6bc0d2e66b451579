"""State transitions of the versioned store: pure functions from frames to frames.

A change never edits a table; it returns the next state, to be written beside the old one and swapped. Where order
matters a ``seq`` column gives it. Null keys are never equal to each other unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row a key: the last by ``order``."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*(o.desc() for o in order)))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn")


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """State after changes that update on conflict; the change with the largest ``order`` wins, then the larger row."""
    old = state.withColumn(order, F.lit(None).cast(changes.schema[order].dataType))
    rest = [F.col(c) for c in state.columns if c not in keys]
    both = old.unionByName(changes.select(*state.columns, order))
    return last_by(both, keys, F.coalesce(F.col(order), F.lit(-1)), *rest).select(*state.columns)


def insert_ignore(state: DataFrame, rows: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """State after inserts that do nothing on conflict; of new rows with one key the first by ``order`` is kept."""
    new = rows.join(state.select(*keys).distinct(), list(keys), "left_anti")
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(*([F.col(order)] if order else []), *(F.col(c) for c in state.columns if c not in keys)))
    return state.unionByName(new.withColumn("_rn", rn).filter("_rn = 1").select(*state.columns))


def replace_by_key(state: DataFrame, keys: DataFrame, rows: DataFrame) -> DataFrame:
    """State in which all rows of the given keys give way to ``rows``."""
    return state.join(keys.distinct(), keys.columns, "left_anti").unionByName(rows.select(*state.columns))


def compare_and_set(state: DataFrame, condition: Column, column: str, value: Column) -> tuple[DataFrame, DataFrame]:
    """(next state, affected rows) of an update that applies only where ``condition`` holds."""
    cond = F.coalesce(condition, F.lit(False))
    return state.withColumn(column, F.when(cond, value).otherwise(F.col(column))), state.filter(cond)


def unique_violations(df: DataFrame, keys: Sequence[str], live: Column | None = None) -> DataFrame:
    """(keys, copies) of keys that more than one record has; ``live`` limits the check, as a partial index does."""
    rows = df if live is None else df.filter(live)
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def soft_delete(notes: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Notes with those of the given (vault_id, path) that are live moved to the trash."""
    hit = keys.select("vault_id", "path").distinct().withColumn("_hit", F.lit(True))
    joined = notes.join(hit, ["vault_id", "path"], "left")
    return joined.withColumn("deleted_at", F.when(F.col("_hit") & F.col("deleted_at").isNull(), now).otherwise(F.col("deleted_at"))).select(*notes.columns)


def restorable(notes: DataFrame) -> DataFrame:
    """(id, vault_id, path, outcome) for all trashed notes: ``restored``, or ``taken`` if a live note has the path.

    Of several trashed notes with one path the last deleted, then the largest id, can come back.
    """
    live = notes.filter("deleted_at is null").select("vault_id", "path").distinct().withColumn("_live", F.lit(True))
    trash = notes.filter("deleted_at is not null").select("id", "vault_id", "path", "deleted_at").distinct()
    rn = F.row_number().over(W.partitionBy("vault_id", "path").orderBy(F.desc("deleted_at"), F.desc("id")))
    return trash.withColumn("_rn", rn).join(live, ["vault_id", "path"], "left").select("id", "vault_id", "path", F.when(F.col("_live") | (F.col("_rn") > 1), "taken").otherwise("restored").alias("outcome"))


# Revisions: note_id, seq, action, frontmatter, body, created_at.


def dedupe_consecutive(revisions: DataFrame, content: Sequence[str] = ("frontmatter", "body")) -> DataFrame:
    """Revisions without those that only repeat the one before; the first of a note always stays."""
    w = W.partitionBy("note_id").orderBy("seq")
    same = F.lit(True)
    for c in content:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return revisions.withColumn("_same", same & (F.row_number().over(w) > 1)).filter("not _same").drop("_same")


def latest_revision(revisions: DataFrame) -> DataFrame:
    return last_by(revisions, ["note_id"], F.col("seq"))


def state_as_of(revisions: DataFrame, at: Column) -> DataFrame:
    """The last revision of each note that isn't later than ``at``."""
    return last_by(revisions.filter(F.col("created_at") <= at), ["note_id"], F.col("created_at"), F.col("seq"))


def revert(revisions: DataFrame, targets: DataFrame) -> DataFrame:
    """Revisions after notes are put back to an earlier one. targets: note_id, target_seq.

    A revision with the target's content is added unless the newest already has it; either way the newest is then
    called ``revert``. Targets that don't exist change nothing.
    """
    newest = latest_revision(revisions).select("note_id", F.col("seq").alias("last_seq"), F.col("frontmatter").alias("f0"), F.col("body").alias("b0"), F.col("created_at").alias("c0"))
    wanted = targets.join(revisions.withColumnRenamed("seq", "target_seq").select("note_id", "target_seq", "frontmatter", "body"), ["note_id", "target_seq"]).join(newest, "note_id")
    same = F.col("frontmatter").eqNullSafe(F.col("f0")) & F.col("body").eqNullSafe(F.col("b0"))
    added = wanted.filter(~same).select("note_id", (F.col("last_seq") + 1).alias("seq"), F.lit("revert").alias("action"), "frontmatter", "body", F.col("c0").alias("created_at"))
    relabel = wanted.filter(same).select("note_id", F.col("last_seq").alias("seq")).withColumn("_re", F.lit(True))
    old = revisions.join(relabel, ["note_id", "seq"], "left").withColumn("action", F.when(F.col("_re"), F.lit("revert")).otherwise(F.col("action"))).select(*revisions.columns)
    return old.unionByName(added.select(*revisions.columns))


def purge(revisions: DataFrame, keys: DataFrame) -> DataFrame:
    """Revisions without those of the given (note_id, seq)."""
    return revisions.join(keys.select("note_id", "seq").distinct(), ["note_id", "seq"], "left_anti")


def create_notes(notes: DataFrame, inputs: DataFrame) -> DataFrame:
    """(vault_id, path, outcome) of notes to be created: ``created``, ``taken`` or the rule that is broken.

    inputs: vault_id, type, name, frontmatter, body, seq; of inputs with one path the first is created.
    """
    from cairnfield.operators.markdown import problem_of

    checked = inputs.withColumn("path", F.concat_ws("/", "type", "name")).withColumn("problem", problem_of(F.col("type"), F.col("name"), F.col("frontmatter"), F.col("body")))
    live = notes.filter("deleted_at is null").select("vault_id", "path").distinct().withColumn("_live", F.lit(True))
    rn = F.row_number().over(W.partitionBy("vault_id", "path", F.col("problem").isNull()).orderBy("seq"))
    return checked.withColumn("_rn", rn).join(live, ["vault_id", "path"], "left").select("vault_id", "path", "seq", F.coalesce("problem", F.when(F.col("_live") | (F.col("_rn") > 1), F.lit("taken")), F.lit("created")).alias("outcome"))


def update_notes(notes: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Notes after updates of (vault_id, path): frontmatter is replaced, body only if given; trashed ones stay."""
    new = last_by(changes, ["vault_id", "path"], F.col("seq")).select("vault_id", "path", F.col("frontmatter").alias("_fm"), F.col("body").alias("_body"), F.lit(True).alias("_hit"))
    hit = F.coalesce(F.col("_hit"), F.lit(False)) & F.col("deleted_at").isNull()
    out = notes.join(new, ["vault_id", "path"], "left")
    out = out.withColumn("frontmatter", F.when(hit, F.col("_fm")).otherwise(F.col("frontmatter"))).withColumn("body", F.when(hit, F.coalesce("_body", "body")).otherwise(F.col("body"))).withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
    return out.select(*notes.columns)


def rename_notes(notes: DataFrame, renames: DataFrame) -> DataFrame:
    """Notes with new names within their type; links to the old paths stay. renames: vault_id, path, new_name.

    A rename to a path that a live note has, or to no slug, changes nothing.
    """
    live = notes.filter("deleted_at is null").select("vault_id", F.col("path").alias("_new")).distinct().withColumn("_taken", F.lit(True))
    asked = renames.filter(F.col("new_name").rlike("^[a-z0-9][a-z0-9-]*$")).withColumn("_new", F.concat(F.split_part("path", F.lit("/"), F.lit(1)), F.lit("/"), F.col("new_name")))
    first = asked.groupBy("vault_id", "_new").agg(F.min("path").alias("path"), F.min("new_name").alias("new_name")).groupBy("vault_id", "path").agg(F.min("_new").alias("_new"), F.min("new_name").alias("new_name"))
    free = first.join(live, ["vault_id", "_new"], "left").filter("_taken is null").select("vault_id", "path", "_new", F.col("new_name").alias("_name"))
    out = notes.join(free, ["vault_id", "path"], "left")
    hit = F.col("_new").isNotNull() & F.col("deleted_at").isNull()
    return out.withColumn("name", F.when(hit, F.col("_name")).otherwise(F.col("name"))).withColumn("path", F.when(hit, F.col("_new")).otherwise(F.col("path"))).select(*notes.columns)


def deactivate(user_ids: DataFrame, sessions: DataFrame, memberships: DataFrame, shares: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, memberships, shares) left when users are deactivated: theirs go, shares to teams stay."""
    gone = user_ids.select("user_id").distinct()
    direct = gone.select(F.col("user_id").alias("grantee_id"), F.lit("user").alias("grantee_type"))
    return sessions.join(gone, "user_id", "left_anti"), memberships.join(gone, "user_id", "left_anti"), shares.join(direct, ["grantee_type", "grantee_id"], "left_anti")
