"""Queries on access, sharing and oversight."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnfield.functions.lineage import shared_folder
from cairnfield.sources.files import backup, restore

from cairnfield.operators import access, admin, store
from cairnfield.plans.tables import NOW_SECONDS, Tables, sql
from cairnfield.sources import files

def now():
    """The instant at which things are judged."""
    return F.timestamp_seconds(F.lit(NOW_SECONDS))

# Grants as SQL: the same three branches, the highest wins.
GRANT = """grant_row as (
    select owner_id as user_id, id as vault_id, 3 as rank from vaults
    union all select grantee_id, vault_id, case permission when 'edit' then 2 else 1 end from shares where grantee_type = 'user' and vault_id in (select id from vaults)
    union all select m.user_id, s.vault_id, case s.permission when 'edit' then 2 else 1 end from shares s join memberships m on m.team_id = s.grantee_id where s.grantee_type = 'team' and s.vault_id in (select id from vaults)),
  access as (
    select user_id, vault_id, case max(rank) when 3 then 'owner' when 2 then 'edit' else 'read' end as access from grant_row
    where user_id in (select id from users where status = 'active') group by user_id, vault_id)"""
REPOSITORY = """repo_grant as (
    select owner_id as user_id, id as repository_id, 2 as rank from repositories
    union all select grantee_id, repository_id, 1 from repository_shares where grantee_type = 'user' and repository_id in (select id from repositories)
    union all select m.user_id, s.repository_id, 1 from repository_shares s join memberships m on m.team_id = s.grantee_id where s.grantee_type = 'team' and s.repository_id in (select id from repositories)),
  repo_access as (
    select user_id, repository_id, case max(rank) when 2 then 'owner' else 'viewer' end as access from repo_grant
    where user_id in (select id from users where status = 'active') group by user_id, repository_id)"""


def _accessible(t: Tables):
    return access.accessible_vaults(t("users"), t("vaults"), t("shares"), t("memberships"))


def _repositories(t: Tables):
    return access.accessible_repositories(t("users"), t("repositories"), t("repository_shares"), t("memberships"))


def _requests(t: Tables, container: str):
    return t("users").select(F.col("id").alias("user_id"), (F.col("id") % (64 if container == "vault_id" else 96) + 1).alias(container))


def _valid(t: Tables):
    expires = F.timestamp_seconds(F.lit(NOW_SECONDS) + (F.col("minutes") - 50) * 60)
    c = t("connections").withColumn("expires_at", F.when(F.col("id") % 13 == 0, F.lit(None)).otherwise(expires))
    revoked = F.when(F.col("revoked"), now())
    return c.select("id", access.token_valid(F.col("expires_at"), revoked, now()).alias("token_valid"), F.coalesce(access.session_valid(F.col("expires_at"), now()), F.lit(False)).alias("session_valid"))


def _changes(t: Tables):
    return t("vaults").filter("id % 9 = 0").select(F.col("id").alias("change_id"), F.array("owner_id").alias("user_ids"), F.array("id").alias("vault_ids"))


def _fanout_changes(t: Tables):
    return t("shares").select(F.col("id").alias("change_id"), "grantee_type", "grantee_id", F.lit(10).alias("actor_id"))


def _consumed(t: Tables):
    state = t("connections").withColumn("used_at", F.when(F.col("used"), F.lit(1).cast("bigint")))
    after, hit = store.compare_and_set(state, F.col("used_at").isNull() & ~F.col("revoked") & (F.col("minutes") > 20), "used_at", F.lit(2).cast("bigint"))
    return after.groupBy("used_at").agg(F.count("*").alias("tokens")).crossJoin(hit.agg(F.count("*").alias("affected")))


def _upserted(t: Tables):
    shares = t("shares")
    keys = ["vault_id", "grantee_type", "grantee_id"]
    first = shares.filter("id % 2 = 0").groupBy(*keys).agg(F.min_by("permission", "id").alias("permission"))
    return store.upsert(first, shares.filter("id % 2 = 1").select(*keys, "permission", F.col("id").alias("seq")), keys)


def _inserted(t: Tables):
    shares = t("repository_shares")
    keys = ["repository_id", "grantee_type", "grantee_id"]
    state = shares.filter("id % 2 = 0").groupBy(*keys).agg(F.min("id").alias("id"))
    return store.insert_ignore(state, shares.filter("id % 2 = 1").select(*keys, "id"), keys)


def _deactivated(t: Tables):
    gone = t("users").filter("status = 'deactivated'").select(F.col("id").alias("user_id"))
    sessions, members, shares = store.deactivate(gone, t("connections"), t("memberships"), t("shares"))
    counts = [(n, f) for n, f in (("sessions", sessions), ("memberships", members), ("shares", shares))]
    parts = [f.agg(F.count("*").alias("left")).select(F.lit(n).alias("what"), "left") for n, f in counts]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _session_user(t: Tables):
    live = t("connections").filter("minutes > 20 and not revoked")
    active = t("users").filter("status = 'active'").select(F.col("id").alias("user_id"), "email", "role")
    return live.join(active, "user_id").select("id", "user_id", "email", "role")


def _token_user(t: Tables):
    wanted = t("connections").select("token_hash").distinct()
    found = wanted.join(t("connections").filter("not revoked"), "token_hash")
    return found.join(t("users").select(F.col("id").alias("user_id"), "status"), "user_id").select("id", "user_id", "scope", "status")


def _redacted(t: Tables):
    repos = t("repositories").select(*admin.REPOSITORY_VIEW).select(F.lit("repository").alias("view"), F.col("id").cast("string").alias("id"), F.col("name").alias("label"))
    links = t("connections").select(*admin.CONNECTION_VIEW).select(F.lit("connection").alias("view"), F.col("id").cast("string").alias("id"), F.col("scope").alias("label"))
    return repos.unionByName(links)


def _import_shares(t: Tables):
    wanted = t("users").select(F.concat(F.upper("email"), F.when(F.col("id") % 9 == 0, "x").otherwise("")).alias("email"))
    return admin.match_shares(wanted, t("users"), 33)


def _manifest(t: Tables):
    return files.manifests(t("vaults"), t("shares"), t("users"), t("teams")).select("vault_id", F.get_json_object("manifest", "$.name").alias("name"), F.size(F.from_json(F.get_json_object("manifest", "$.shares"), "array<string>")).alias("shares"))


def queries() -> dict:
    def q(f):
        return lambda s, d: f(Tables(s, d))

    return {
        "direct_shares": q(lambda t: access.direct_shares(t("shares"))),
        "team_shares": q(lambda t: access.team_shares(t("shares"), t("memberships"))),
        "via_team_vaults": q(lambda t: access.grouped_team_shares(t("shares"), t("memberships")).join(t("vaults").select(F.col("id").alias("vault_id"), "name"), "vault_id").groupBy("vault_id", "name").agg(F.count_distinct("user_id").alias("users"))),
        "accessible_vaults": q(_accessible),
        "resolve_access": q(lambda t: access.resolve_access(_requests(t, "vault_id"), t("users"), t("vaults"), t("shares"), t("memberships"))),
        "users_with_access": q(lambda t: access.users_with_access(t("vaults"), t("shares"), t("memberships"))),
        "accessible_repos": q(_repositories),
        "resolve_repo_access": q(lambda t: access.resolve_repository_access(_requests(t, "repository_id"), t("users"), t("repositories"), t("repository_shares"), t("memberships"))),
        "access_at_least": q(lambda t: _accessible(t).groupBy("vault_id").agg(F.count_if(access.at_least(F.col("access"), "read")).alias("readers"), F.count_if(access.at_least(F.col("access"), "edit")).alias("editors"), F.count_if(access.at_least(F.col("access"), "owner")).alias("owners"))),
        "merged_scope": q(lambda t: access.merged_scope(t("preferences"), t("vaults"), _accessible(t))),
        "affected_connections": q(lambda t: access.affected_connections(_changes(t), t("connections").select(F.col("id").alias("connection_id"), "user_id", "vault_id"))),
        "valid_tokens": q(_valid),
        "session_user": q(_session_user),
        "mcp_token_resolve": q(_token_user),
        "consume_tokens": q(_consumed),
        "upsert_shares": q(_upserted),
        "insert_ignore": q(_inserted),
        "deactivate_cascade": q(_deactivated),
        "team_members": q(lambda t: t("memberships").join(t("users").select(F.col("id").alias("user_id"), "email"), "user_id").join(t("teams"), "team_id").select("team_id", "name", "user_id", "email", "role")),
        "users_by_status": q(lambda t: admin.users_by_status(t("users"))),
        "users_by_status_filter": q(lambda t: t("users").filter((F.col("status") == "pending_approval") & (F.col("role") == "member")).select("id", "email")),
        "admin_stats": q(lambda t: admin.admin_stats(t("users"), t("vaults"), t("memberships"), t("notes"))),
        "share_counts": q(lambda t: admin.share_counts(t("vaults"), t("shares"))),
        "vault_overview": q(lambda t: admin.vault_overview(t("vaults"), t("users"), t("notes"), t("shares")).withColumn("last_activity", F.unix_micros("last_activity"))),
        "team_overview": q(lambda t: admin.team_overview(t("teams"), t("memberships"))),
        "storage_chars": q(lambda t: admin.storage_chars(t("notes"))),
        "vault_tree": q(lambda t: admin.vault_tree(t("notes"))),
        "shares_expanded": q(lambda t: admin.shares_expanded(t("shares"), t("memberships"))),
        "notify_fanout": q(lambda t: admin.notify_fanout(_fanout_changes(t), t("memberships"))),
        "import_shares": q(_import_shares),
        "audit_trail": q(lambda t: admin.audit_trail(t("revisions"), t("notes"))),
        "redacted_views": q(_redacted),
        "vault_manifest": q(_manifest),
        "security_events_page": q(lambda t: admin.page(t("events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), F.desc("us"), F.desc("event_id"), limit=50, offset=100)),
        "notifications_page": q(lambda t: admin.page(t("events").filter("user_id = 7").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")), F.desc("us"), F.desc("event_id"), limit=500, most=100)),
        "backup_counts": q(lambda t: _counts(t)),
    }


ACCOUNT_TABLES = ("users", "teams", "memberships", "vaults", "shares", "preferences", "repositories", "repository_shares")


def _counts(t: Tables):
    """Rows of each table as a backup's restore gives them."""
    folder, out = f"{shared_folder(t.spark)}/backup-{uuid.uuid4().hex}", None
    tables = {name: t(name) for name in ACCOUNT_TABLES}
    backup(tables, folder)
    restored = restore(t.spark, folder, {n: df.schema.simpleString()[7:-1].replace(":", " ") for n, df in tables.items()}, existing={"users": tables["users"].limit(0)})
    for name in ACCOUNT_TABLES:
        row = restored[name].agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def oracle_sql() -> dict[str, str]:
    who = ("users", "memberships", "shares")
    acc = lambda text: sql("", *who).rstrip() + f", {GRANT} " + text
    repo = lambda text: sql("", "users", "memberships", "repository_shares").rstrip() + f", {REPOSITORY} " + text
    minutes = f"to_timestamp({NOW_SECONDS} + (minutes - 50) * 60)"
    return {
        "direct_shares": sql("select grantee_id as user_id, vault_id, permission from shares where grantee_type = 'user'", "shares"),
        "team_shares": sql("select m.user_id, s.vault_id, s.permission, m.team_id from shares s join memberships m on m.team_id = s.grantee_id where s.grantee_type = 'team'", "shares", "memberships"),
        "via_team_vaults": sql("select s.vault_id, v.name, count(distinct m.user_id) as users from shares s join memberships m on m.team_id = s.grantee_id join vaults v on v.id = s.vault_id where s.grantee_type = 'team' group by all", "shares", "memberships"),
        "accessible_vaults": acc("select user_id, vault_id, access from access"),
        "resolve_access": acc("select u.id as user_id, u.id % 64 + 1 as vault_id, a.access from users u left join access a on a.user_id = u.id and a.vault_id = u.id % 64 + 1"),
        "users_with_access": acc("select distinct vault_id, user_id from grant_row"),
        "accessible_repos": repo("select user_id, repository_id, access from repo_access"),
        "resolve_repo_access": repo("select u.id as user_id, u.id % 96 + 1 as repository_id, a.access from users u left join repo_access a on a.user_id = u.id and a.repository_id = u.id % 96 + 1"),
        "access_at_least": acc("select vault_id, count(*) as readers, count(*) filter (where access <> 'read') as editors, count(*) filter (where access = 'owner') as owners from access group by vault_id"),
        "merged_scope": sql("", *who, "preferences").rstrip() + f", {GRANT} select distinct p.user_id, p.vault_id from preferences p join vaults v on v.id = p.vault_id and v.mergeable join access a using (user_id, vault_id) where p.include",
        "affected_connections": sql("select id as connection_id from connections c where user_id in (select owner_id from vaults where id % 9 = 0) or vault_id in (select id from vaults where id % 9 = 0)", "connections"),
        "valid_tokens": sql(
            f"""select id, not revoked and (id % 13 = 0 or not ({minutes} < to_timestamp({NOW_SECONDS}))) as token_valid, id % 13 <> 0 and {minutes} > to_timestamp({NOW_SECONDS}) as session_valid from connections""", "connections"
        ),
        "session_user": sql("select c.id, c.user_id, u.email, u.role from connections c join users u on u.id = c.user_id where u.status = 'active' and c.minutes > 20 and not c.revoked", "connections", "users"),
        "mcp_token_resolve": sql("select c.id, c.user_id, c.scope, u.status from connections c join users u on u.id = c.user_id where not c.revoked", "connections", "users"),
        "consume_tokens": sql(
            """select used_at, count(*) as tokens, (select count(*) from connections where not used and not revoked and minutes > 20) as affected
            from (select case when used then 1 when not revoked and minutes > 20 then 2 end::bigint as used_at from connections) group by used_at""", "connections"
        ),
        "upsert_shares": sql(
            """select vault_id, grantee_type, grantee_id, coalesce(arg_max(permission, id) filter (where id % 2 = 1), arg_min(permission, id) filter (where id % 2 = 0)) as permission from shares group by all""", "shares"
        ),
        "insert_ignore": sql("select repository_id, grantee_type, grantee_id, coalesce(min(id) filter (where id % 2 = 0), min(id)) as id from repository_shares group by all", "repository_shares"),
        "deactivate_cascade": sql(
            """select 'sessions' as what, count(*) as left from connections where user_id not in (select id from users where status = 'deactivated')
            union all select 'memberships', count(*) from memberships where user_id not in (select id from users where status = 'deactivated')
            union all select 'shares', count(*) from shares where grantee_type = 'team' or grantee_id not in (select id from users where status = 'deactivated')""", "connections", "users", "memberships", "shares"
        ).replace("as left from", 'as "left" from'),
        "team_members": sql("select m.team_id, t.name, m.user_id, u.email, m.role from memberships m join users u on u.id = m.user_id join teams t on t.team_id = m.team_id", "memberships", "users", "teams"),
        "users_by_status": sql("select status, count(*) as users from users group by status", "users"),
        "users_by_status_filter": sql("select id, email from users where status = 'pending_approval' and role = 'member'", "users"),
        "admin_stats": sql(
            """select 'users' as metric, count(*) as value from users union all select 'vaults', count(*) from vaults union all select 'teams', count(distinct team_id) from memberships
            union all select 'live_notes', count(*) from (select distinct id from notes where deleted_at is null)""", "users", "memberships"
        ),
        "share_counts": sql("select v.id as vault_id, count(s.id) as shares from vaults v left join shares s on s.vault_id = v.id group by v.id", "shares"),
        "vault_overview": sql(
            """select v.id as vault_id, v.name, u.email as owner_email, count(n.id) as notes, epoch_us(max(n.updated_at)) as last_activity, (select count(*) from shares s where s.vault_id = v.id) as shares
            from vaults v join users u on u.id = v.owner_id left join (select distinct id, vault_id, updated_at from notes where deleted_at is null) n on n.vault_id = v.id group by v.id, v.name, u.email""", "users", "shares"
        ),
        "team_overview": sql("select t.team_id, t.name, count(m.user_id) as members from teams t left join memberships m on m.team_id = t.team_id group by all", "teams", "memberships"),
        "storage_chars": sql("select vault_id, cast(sum(coalesce(length(body), 0) + coalesce(length(frontmatter), 0)) as bigint) as chars from live_notes group by vault_id", "live_notes"),
        "vault_tree": sql("select vault_id, type, list(distinct name order by name) as names from live_notes group by vault_id, type", "live_notes"),
        "shares_expanded": sql(
            """select s.id, s.vault_id, s.grantee_type, s.grantee_id, case when s.grantee_type = 'team' then m.members end as members from shares s
            left join (select team_id, list(distinct user_id order by user_id) as members from memberships group by team_id) m on s.grantee_type = 'team' and m.team_id = s.grantee_id""", "shares", "memberships"
        ),
        "notify_fanout": sql(
            """select id as change_id, grantee_id as recipient_id from shares where grantee_type = 'user'
            union select s.id, m.user_id from shares s join memberships m on m.team_id = s.grantee_id where s.grantee_type = 'team' and m.user_id <> 10""", "shares", "memberships"
        ),
        "import_shares": sql(
            """select w.email, u.id as user_id, case when u.id is null then 'unmatched' when u.id = 33 then 'own' else 'matched' end as outcome
            from (select distinct upper(email) || case when id % 9 = 0 then 'x' else '' end as email from users) w left join users u on u.email = lower(w.email) and u.status = 'active'""", "users"
        ),
        "audit_trail": sql("select r.note_id, r.seq, r.action, n.vault_id, n.path from revisions r join (select distinct id, vault_id, path from notes) n on n.id = r.note_id", "revisions"),
        "redacted_views": sql("""select 'repository' as "view", cast(id as varchar) as id, name as label from repositories union all select 'connection', cast(id as varchar), scope from connections""", "connections"),
        "vault_manifest": sql(
            """select v.id as vault_id, v.name, cast((select count(*) from (select distinct grantee_type, grantee_id, permission from shares s where s.vault_id = v.id)) as int) as shares from vaults v""", "shares"
        ),
        "security_events_page": "select event_id, user_id, event_type, epoch_us(ts) as us from events order by ts desc, event_id desc limit 50 offset 100",
        "notifications_page": "select event_id, event_type, epoch_us(ts) as us from events where user_id = 7 order by ts desc, event_id desc limit 100",
        "backup_counts": sql(
            " union all ".join(f"select '{n}' as table_name, count(*) as rows from {n}" for n in ("users", "teams", "memberships", "vaults", "shares", "preferences", "repositories", "repository_shares")).replace("as rows", 'as "rows"'),
            "users", "teams", "memberships", "shares", "preferences", "repository_shares",
        ),
    }
