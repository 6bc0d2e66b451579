"""Oversight: counts, roll-ups, audit trails, pages. None of these shows a body, frontmatter, secret or token hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.grid import grid_join

REPOSITORY_VIEW = ("id", "name", "owner_id", "ingestion_method", "git_url", "local_path", "mergeable", "sync_status")
CONNECTION_VIEW = ("id", "user_id", "scope")


def distinct_notes(notes: DataFrame) -> DataFrame:
    """Notes without repeated rows, without their texts."""
    return notes.select("id", "vault_id", "type", "name", "path", "deleted_at", "created_at", "updated_at").distinct()


def admin_stats(users: DataFrame, vaults: DataFrame, memberships: DataFrame, notes: DataFrame) -> DataFrame:
    """(metric, value): one row each, counted apart and put side by side."""
    live = distinct_notes(notes).filter("deleted_at is null")
    frames = {"users": users, "vaults": vaults, "teams": memberships.select("team_id").distinct(), "live_notes": live}
    out = None
    for name, frame in frames.items():
        row = frame.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = row if out is None else out.unionByName(row)
    return out


def users_by_status(users: DataFrame) -> DataFrame:
    return users.groupBy("status").agg(F.count("*").alias("users"))


def share_counts(vaults: DataFrame, shares: DataFrame) -> DataFrame:
    """(vault_id, shares), 0 for vaults without any."""
    counts = shares.groupBy("vault_id").agg(F.count("*").alias("shares"))
    return vaults.select(F.col("id").alias("vault_id")).join(counts, "vault_id", "left").select("vault_id", F.coalesce("shares", F.lit(0)).alias("shares"))


def vault_overview(vaults: DataFrame, users: DataFrame, notes: DataFrame, shares: DataFrame) -> DataFrame:
    """(vault_id, name, owner_email, notes, last_activity, shares); vaults without live notes keep a 0."""
    live = distinct_notes(notes).filter("deleted_at is null").groupBy("vault_id").agg(F.count("*").alias("notes"), F.max("updated_at").alias("last_activity"))
    owners = users.select(F.col("id").alias("owner_id"), F.col("email").alias("owner_email"))
    out = vaults.select(F.col("id").alias("vault_id"), "name", "owner_id").join(owners, "owner_id").join(live, "vault_id", "left").join(share_counts(vaults, shares), "vault_id")
    return out.select("vault_id", "name", "owner_email", F.coalesce("notes", F.lit(0)).alias("notes"), "last_activity", "shares")


def team_overview(teams: DataFrame, memberships: DataFrame) -> DataFrame:
    counts = memberships.groupBy("team_id").agg(F.count("user_id").alias("members"))
    return teams.join(counts, "team_id", "left").select("team_id", "name", F.coalesce("members", F.lit(0)).alias("members"))


def storage_chars(notes: DataFrame) -> DataFrame:
    """(vault_id, chars): characters, not bytes, of live bodies and frontmatter; nulls count 0."""
    rows = notes.filter("deleted_at is null").select("id", "vault_id", F.coalesce(F.char_length("body"), F.lit(0)).alias("b"), F.coalesce(F.char_length("frontmatter"), F.lit(0)).alias("f")).distinct()
    return rows.groupBy("vault_id").agg(F.sum(F.col("b") + F.col("f")).cast("bigint").alias("chars"))


def page(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """One page; ``order`` must end in a unique column. Sizes above ``most`` are cut to it."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))


def audit_trail(revisions: DataFrame, notes: DataFrame) -> DataFrame:
    """(note_id, seq, action, vault_id, path): revisions with where they belong, never their content."""
    where = distinct_notes(notes).select(F.col("id").alias("note_id"), "vault_id", "path").distinct()
    return revisions.select("note_id", "seq", "action").join(where, "note_id")


def vault_tree(notes: DataFrame) -> DataFrame:
    """(vault_id, type, names): live notes of each type in order of name."""
    return distinct_notes(notes).filter("deleted_at is null").groupBy("vault_id", "type").agg(F.array_sort(F.collect_set("name")).alias("names"))


def shares_expanded(shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(id, vault_id, grantee_type, grantee_id, members): team shares with their members' ids, user shares with null."""
    members = memberships.groupBy(F.col("team_id").alias("grantee_id")).agg(F.array_sort(F.collect_set("user_id")).alias("members"), F.lit("team").alias("grantee_type"))
    return shares.join(members, ["grantee_type", "grantee_id"], "left").select("id", "vault_id", "grantee_type", "grantee_id", "members")


def notify_fanout(changes: DataFrame, memberships: DataFrame) -> DataFrame:
    """(change_id, recipient_id): a share to a user notifies the user, one to a team all members but the actor.

    changes: change_id, grantee_type, grantee_id, actor_id. Repeated rows of either table leave before they are joined;
    then only changes with several grantees can name a recipient twice, and only their results are compared.
    """
    user = F.col("grantee_type") == "user"
    target = F.struct("grantee_type", "grantee_id", F.when(~user, F.col("actor_id")).alias("actor_id"))
    asked = changes.filter(F.col("grantee_type").isin("user", "team")).select("change_id", target.alias("target"))
    ends = asked.groupBy("change_id").agg(F.min("target").alias("target"), F.max("target").alias("last"))
    single = F.col("target").eqNullSafe(F.col("last"))
    more = ends.filter(~single).select(F.col("change_id").alias("id"))
    several = asked.join(more, F.col("change_id").eqNullSafe(F.col("id")), "left_semi").distinct()
    members = memberships.select(F.col("team_id").alias("grantee_id"), F.col("user_id").alias("recipient_id")).distinct()
    return _recipients(ends.filter(single), members).unionByName(_recipients(several, members).distinct())


def _recipients(targets: DataFrame, members: DataFrame) -> DataFrame:
    rows = targets.select("change_id", "target.*")
    direct = rows.filter("grantee_type = 'user'").select("change_id", F.col("grantee_id").alias("recipient_id"))
    team = grid_join(rows.filter("grantee_type = 'team'").drop("grantee_type"), members, "grantee_id")
    return direct.unionByName(team.filter("recipient_id <> actor_id").select("change_id", "recipient_id"))


def match_shares(shares: DataFrame, users: DataFrame, importer_id: int) -> DataFrame:
    """(email, user_id, outcome) of an archive's shares: matched by e-mail to active users other than the importer."""
    known = users.filter(F.col("status") == "active").select(F.lower("email").alias("k"), F.col("id").alias("user_id"))
    joined = shares.select("email").distinct().join(known, F.lower("email") == F.col("k"), "left")
    return joined.select("email", "user_id", F.when(F.col("user_id").isNull(), "unmatched").when(F.col("user_id") == importer_id, "own").otherwise("matched").alias("outcome"))
