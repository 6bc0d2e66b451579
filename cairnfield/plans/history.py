"""Queries on the versioned store, on ingestion and on event rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairnfield.functions.lineage import shared_folder
from cairnfield.operators import events, ingest, store
from cairnfield.operators.markdown import canonical_json, is_slug, valid_path
from cairnfield.plans.tables import NOW_SECONDS, Tables, sql
from cairnfield.sources import files as file_sources

def now():
    """The instant at which things are judged."""
    return F.timestamp_seconds(F.lit(NOW_SECONDS))
#: Limits at which the logs here show denials.
FEW, SIX_HOURS_MS = 3, 6 * 3_600_000
FAILURES, DAY_MS = 5, 24 * 3_600_000
GAP_MS = 3_600_000


def _notes(t: Tables):
    return t("note_rows")


def _snapshot(t: Tables):
    """An earlier state of the files, what is submitted, and what is there now."""
    now = t("file_rows").select("id", "repository_id", "path", "content").dropDuplicates(["repository_id", "path"])
    old = now.filter("id % 7 <> 0").select("repository_id", F.when(F.col("id") % 11 == 0, F.concat("path", F.lit(".old"))).otherwise(F.col("path")).alias("path"), F.sha2(F.when(F.col("id") % 5 == 0, F.lit("before")).otherwise(F.coalesce("content", F.lit(""))), 256).alias("content_hash"))
    return old, now.filter("id % 3 <> 1").select("repository_id", "path", "content"), now.select("repository_id", "path")


_FILES = """snap as (select repository_id, path, min(id) as id, arg_min(content, id) as content from repository_files group by all),
  old as (select repository_id, case when id % 11 = 0 then path || '.old' else path end as path, sha256(case when id % 5 = 0 then 'before' else coalesce(content, '') end) as hash from snap where id % 7 <> 0),
  new as (select repository_id, path, sha256(coalesce(content, '')) as hash from snap where id % 3 <> 1),
  diff as (
    select n.repository_id, n.path, case when o.hash is null then 'created' when o.hash = n.hash then 'unchanged' else 'updated' end as status from new n left join old o using (repository_id, path)
    union all select repository_id, path, 'deleted' from old where (repository_id, path) not in (select (repository_id, path) from snap))"""


def _diff(t: Tables):
    return ingest.sync_diff(*_snapshot(t))


def _next(t: Tables):
    rows = t("file_rows").select("id", "repository_id", "path", "language", "content", "content_hash", "size", "updated_at").dropDuplicates(["repository_id", "path"])
    incoming = rows.select("repository_id", "path", F.when(F.col("id") % 4 == 0, F.concat("content", F.lit("\n"))).otherwise(F.col("content")).alias("content"))
    out = ingest.next_files(rows, incoming, rows.select("repository_id", "path"), now())
    return out.select("id", "size", F.unix_micros("updated_at").alias("updated"))


def _pushed(t: Tables):
    """What a sync of pushed requests would change."""
    old, incoming, manifest = _snapshot(t)
    folder = f"{shared_folder(t.spark)}/pushes-{uuid.uuid4().hex}"
    file_sources.write_pushes(incoming, manifest, folder)
    return ingest.sync_diff(old, *file_sources.pushed_files(t.spark, folder, lines=True))


def _replaced(t: Tables):
    links = t("note_links").distinct()
    fresh = _notes(t).filter("deleted_at is null").select(F.col("id").alias("source_note_id"), F.concat(F.lit("type/"), "type").alias("target_path"))
    return store.replace_by_key(links, fresh.select("source_note_id"), fresh)


def _deleted(t: Tables):
    notes = _notes(t).select("id", "vault_id", "path", "deleted_at")
    return store.soft_delete(notes, notes.filter("path like 'notes/%'").select("vault_id", "path"), now()).select("id", F.col("deleted_at").isNotNull().alias("deleted"))


def _created(t: Tables):
    inputs = t("documents").select((F.col("doc_id") % 64 + 1).alias("vault_id"), F.when(F.col("doc_type").isNull(), "No Type").otherwise(F.col("doc_type")).alias("type"), F.concat(F.lit("doc-"), F.floor(F.col("doc_id") / 3)).alias("name"), F.concat(F.lit('{"type": "'), F.coalesce("doc_type", F.lit("x")), F.lit('"}')).alias("frontmatter"), F.col("text").alias("body"), F.col("doc_id").alias("seq"))
    return store.create_notes(_notes(t).select("vault_id", "path", "deleted_at"), inputs)


def _updated(t: Tables):
    notes = _notes(t).select("id", "vault_id", "path", "frontmatter", F.sha2("body", 256).alias("body"), "deleted_at", "updated_at")
    changes = notes.filter("path like 'meetings/%'").select("vault_id", "path", F.lit('{"type": "meetings"}').alias("frontmatter"), F.when(F.col("id") % 2 == 0, "new").alias("body"), F.col("id").alias("seq"))
    out = store.update_notes(notes, changes, now())
    return out.select("id", "frontmatter", "body", F.unix_micros("updated_at").alias("updated"))


def _renamed(t: Tables):
    notes = _notes(t).select("id", "vault_id", "name", "path", "deleted_at")
    renames = notes.filter("deleted_at is null").select("vault_id", "path", F.concat(F.lit("renamed-"), F.floor(F.col("id") / 4)).alias("new_name"))
    return store.rename_notes(notes, renames).select("id", "name", "path")


def _reverted(t: Tables):
    r = t("revisions").withColumn("created_at", F.col("stamp")).drop("stamp")
    targets = r.filter("seq = 0 and note_id % 2 = 0").select("note_id", F.col("seq").alias("target_seq"))
    again = r.filter("seq = 2 and note_id % 6 = 1").select("note_id", F.col("seq").alias("target_seq"))
    return store.revert(r, targets.unionByName(again)).select("note_id", "seq", "action", "body")


def _entries(t: Tables):
    names = _notes(t).select(F.concat(F.lit("vaults/"), F.hex("vault_id"), F.lit("/"), "path", F.when(F.col("id") % 5 == 0, ".txt").otherwise(".md")).alias("name"))
    lower = F.lower("name")
    vault, path = file_sources.archive_entries(lower)
    return names.select(lower.alias("name"), vault.alias("vault"), path.alias("path"))


def _import_report(t: Tables):
    """What an import of every vault's archive takes and skips; every fifth note breaks a rule."""
    notes = _notes(t).dropDuplicates(["vault_id", "path", "deleted_at"]).withColumn("frontmatter", F.when(F.col("id") % 5 == 0, F.lit('{"type": "other"}')).otherwise(F.col("frontmatter")))
    first = notes.filter("deleted_at is null").groupBy("vault_id", "path").agg(F.min("id").alias("id"))
    archives = file_sources.vault_archives(notes.join(first, ["vault_id", "path", "id"], "left_semi"), t("vaults").select(F.col("id").alias("vault_id"), F.lit("{}").alias("manifest")))
    found = file_sources.import_archives(archives)
    return found.groupBy("vault_id").agg(F.count_if(F.col("problem").isNull()).alias("imported"), F.count_if(F.col("problem").isNotNull()).alias("skipped"))


def _log(t: Tables):
    return t("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))


def _updates(t: Tables):
    return t("events").select((F.col("user_id") % 64).alias("vault_id"), F.col("event_type").alias("path"), F.col("props").alias("state"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def queries() -> dict:
    def q(f):
        return lambda s, d: f(Tables(s, d))

    return {
        "scan_notes": q(lambda t: _notes(t).filter("deleted_at is null").select("vault_id", "type", "name", "path").orderBy("vault_id", "name", "path")),
        "get_live_note": q(lambda t: _notes(t).filter("vault_id = 43 and path = 'notes/willow-sync-0' and deleted_at is null").select("id", "name").orderBy("id").limit(1)),
        "trash_list": q(lambda t: _notes(t).filter("deleted_at is not null").select("id", "vault_id", "path", F.unix_micros("deleted_at").alias("deleted"))),
        "soft_delete": q(_deleted),
        "restore_notes": q(lambda t: store.restorable(_notes(t))),
        "create_note": q(_created),
        "update_note": q(_updated),
        "rename_note": q(_renamed),
        "unique_violations": q(lambda t: store.unique_violations(_notes(t).select("vault_id", "path", "deleted_at"), ["vault_id", "path"])),
        "replace_links": q(_replaced),
        "revision_dedupe": q(lambda t: store.dedupe_consecutive(t("revisions").withColumn("frontmatter", canonical_json(F.col("frontmatter")))).select("note_id", "seq")),
        "latest_revision": q(lambda t: store.latest_revision(t("revisions")).select("note_id", "seq", "body")),
        "note_history": q(lambda t: t("revisions").join(_notes(t).filter("deleted_at is null").select(F.col("id").alias("note_id")).distinct(), "note_id", "left_semi").select("note_id", "seq", "action").orderBy("note_id", F.desc("seq"))),
        "revert_note": q(_reverted),
        "purge_revision": q(lambda t: store.purge(t("revisions"), t("revisions").filter("seq = 1").select("note_id", "seq")).select("note_id", "seq")),
        "state_as_of": q(lambda t: store.state_as_of(t("revisions").withColumn("created_at", F.col("stamp") % 40), F.lit(21)).select("note_id", "seq", "body")),
        "sync_diff": q(_diff),
        "sync_summary": q(lambda t: ingest.sync_summary(_diff(t))),
        "watch_batch_diff": q(_next),
        "push_sync": q(_pushed),
        "list_files": q(lambda t: file_sources.list_files(t("file_rows").select("path").distinct())),
        "poll_candidates": q(lambda t: t("repositories").filter("ingestion_method = 'git' and sync_status <> 'syncing'").filter(ingest.should_poll(F.col("last_webhook_at"), F.col("last_synced_at"), now(), 600)).select("id", "name")),
        "archive_entries": q(_entries),
        "import_report": q(_import_report),
        "validate_paths": q(lambda t: _notes(t).select("id", valid_path(F.col("path")).alias("valid")).unionByName(t("file_rows").select("id", valid_path(F.col("path")).alias("valid")))),
        "rate_limit": q(lambda t: events.rate_limit(_log(t), limit=FEW, window_ms=SIX_HOURS_MS)),
        "lockout": q(lambda t: events.lockouts(t("logins").withColumn("ts", F.col("ts").cast("timestamp")), failures=FAILURES, window_ms=DAY_MS)),
        "lockout_by_account_and_address": q(lambda t: events.lockouts_by(t("logins").select("event_id", F.col("user_id").alias("account"), (F.col("event_id") % 40).alias("address"), "outcome", F.col("ts").cast("timestamp").alias("ts")), failures=FAILURES, window_ms=DAY_MS)),
        "debounce_with_maximum": q(lambda t: events.debounce(_log(t), gap_ms=20 * GAP_MS, most_ms=50 * GAP_MS)),
        "debounce": q(lambda t: events.debounce(_log(t), gap_ms=GAP_MS)),
        "live_latest_state": q(lambda t: events.latest_state(_updates(t))),
        "last_valid_state": q(lambda t: events.last_valid_state(_updates(t), F.get_json_object("state", "$.k").cast("int") < 50)),
    }


def oracle_sql() -> dict[str, str]:
    n = lambda text: sql(text, "note_rows")
    now_us = NOW_SECONDS * 1_000_000
    fold = """with recursive log as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
        fold as (
            select user_id, event_id, n, us as start, 1 as count from log where n = 1
            union all select l.user_id, l.event_id, l.n, case when l.us - f.start > {w} then l.us else f.start end, case when l.us - f.start > {w} then 1 else f.count + 1 end
            from fold f join log l on l.user_id = f.user_id and l.n = f.n + 1) """
    lock = """with recursive logins as ({logins}), log as (select event_id, user_id, outcome, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from logins where outcome in ('failure', 'success')),
        fold as (
            select user_id, event_id, n, false as locked, case when outcome = 'failure' then us end as start, case when outcome = 'failure' then 1 else 0 end as count from log where n = 1
            union all select user_id, event_id, n, locked,
                case when locked then start when outcome = 'success' then null when inside then start else us end,
                case when locked then count when outcome = 'success' then 0 when inside then count + 1 else 1 end
            from (select l.user_id, l.event_id, l.n, l.outcome, l.us, f.start, f.count, coalesce(l.us - f.start <= {w}, false) as inside, coalesce(l.us - f.start <= {w} and f.count >= {k}, false) as locked
                  from fold f join log l on l.user_id = f.user_id and l.n = f.n + 1)) """
    from cairnfield.plans.knowledge import PROBLEM
    from cairnfield.plans.tables import DERIVED

    return {
        "scan_notes": n("select vault_id, type, name, path from note_rows where deleted_at is null order by vault_id, name, path"),
        "get_live_note": n("select id, name from note_rows where vault_id = 43 and path = 'notes/willow-sync-0' and deleted_at is null order by id limit 1"),
        "trash_list": n("select id, vault_id, path, epoch_us(deleted_at) as deleted from note_rows where deleted_at is not null"),
        "soft_delete": n("select id, deleted_at is not null or path like 'notes/%' as deleted from note_rows"),
        "restore_notes": n(
            """select id, vault_id, path, case when (vault_id, path) in (select (vault_id, path) from note_rows where deleted_at is null) or row_number() over (partition by vault_id, path order by deleted_at desc, id desc) > 1 then 'taken' else 'restored' end as outcome
            from note_rows where deleted_at is not null"""
        ),
        "create_note": n(
            """select vault_id, path, seq, case when problem is not null then problem when taken or row_number() over (partition by vault_id, path, problem is null order by seq) > 1 then 'taken' else 'created' end as outcome from (
                select doc_id % 64 + 1 as vault_id, coalesce(doc_type, 'No Type') || '/doc-' || cast(floor(doc_id / 3) as bigint) as path, doc_id as seq,
                    case when doc_type is null then 'type is not a slug' when text is null then 'body is missing' end as problem,
                    (vault_id, path) in (select (vault_id, path) from note_rows where deleted_at is null) as taken from documents)"""
        ),
        "update_note": n(
            f"""select id, case when hit then '{{"type": "meetings"}}' else frontmatter end as frontmatter, case when hit and newest % 2 = 0 then 'new' else sha256(body) end as body, case when hit then {now_us} else epoch_us(updated_at) end as updated
            from (select *, deleted_at is null and path like 'meetings/%' as hit, max(id) over (partition by vault_id, path) as newest from note_rows)"""
        ),
        "rename_note": n(
            """, asked as (select vault_id, path, split_part(path, '/', 1) || '/renamed-' || cast(floor(id / 4) as bigint) as new from note_rows where deleted_at is null),
            first as (select vault_id, path, min(new) as new from (select vault_id, new, min(path) as path from asked group by all) group by all)
            select r.id, case when f.new is not null and r.deleted_at is null then split_part(f.new, '/', 2) else r.name end as name, case when f.new is not null and r.deleted_at is null then f.new else r.path end as path
            from note_rows r left join first f on f.vault_id = r.vault_id and f.path = r.path and (f.vault_id, f.new) not in (select (vault_id, path) from note_rows where deleted_at is null)"""
        ).replace(") , asked", "), asked"),
        "unique_violations": n("select vault_id, path, count(*) as copies from note_rows group by all having count(*) > 1"),
        "replace_links": n(
            """select source_note_id, target_path from (select distinct * from note_links) where source_note_id not in (select id from note_rows where deleted_at is null)
            union all select id, 'type/' || type from note_rows where deleted_at is null"""
        ),
        "revision_dedupe": sql(
            """select note_id, seq from (select *, lag(body) over w as b, lag(frontmatter) over w as f, row_number() over w as n from revisions window w as (partition by note_id order by seq))
            where n = 1 or body is distinct from b or frontmatter is distinct from f""", "revisions"
        ),
        "latest_revision": sql("select note_id, max(seq) as seq, arg_max(body, seq) as body from revisions group by note_id", "revisions"),
        "note_history": sql("select note_id, seq, action from revisions where note_id in (select id from notes where deleted_at is null)", "revisions"),
        "revert_note": sql(
            """, last as (select note_id, max(seq) as last_seq, arg_max(body, seq) as last_body from revisions group by all),
            wanted as (select r.note_id, r.body, r.frontmatter, l.last_seq, r.body = l.last_body as same from revisions r join last l using (note_id) where (seq = 0 and note_id % 2 = 0) or (seq = 2 and note_id % 6 = 1))
            select r.note_id, r.seq, case when w.note_id is not null then 'revert' else r.action end as action, r.body from revisions r left join wanted w on w.note_id = r.note_id and w.last_seq = r.seq and w.same
            union all select note_id, last_seq + 1, 'revert', body from wanted where not same""", "revisions"
        ).replace(") , last", "), last"),
        "purge_revision": sql("select note_id, seq from revisions where seq <> 1", "revisions"),
        "state_as_of": sql("select note_id, arg_max(seq, stamp % 40 * 10 + seq) as seq, arg_max(body, stamp % 40 * 10 + seq) as body from revisions where stamp % 40 <= 21 group by note_id", "revisions"),
        "sync_diff": f"with {_FILES} select repository_id, path, status from diff",
        "sync_summary": f"""with {_FILES} select repository_id, count(*) filter (where status = 'created') as created, count(*) filter (where status = 'updated') as updated,
            count(*) filter (where status = 'deleted') as deleted, count(*) filter (where status = 'unchanged') as unchanged from diff group by repository_id""",
        "watch_batch_diff": f"""select id, case when id % 4 = 0 then strlen(content) + 1 else size end as size, case when id % 4 = 0 then {now_us} else epoch_us(updated_at) end as updated from (select distinct * from repository_files)""",
        "push_sync": f"with {_FILES} select repository_id, path, status from diff",
        "list_files": r"select distinct path from repository_files where not regexp_matches(path, '(^|/)(\.git|node_modules|dist|build|\.next|coverage|__pycache__|\.venv)(/|$)')",
        "poll_candidates": f"""select id, name from repositories where ingestion_method = 'git' and sync_status <> 'syncing'
            and case when last_webhook_at is null then true when epoch_us(to_timestamp({NOW_SECONDS})) - epoch_us(last_webhook_at) <= 600000000 then false else last_synced_at is null or last_synced_at < last_webhook_at end""",
        "archive_entries": n(
            """select name, case when hit then regexp_extract(name, '^vaults/([0-9a-f-]+)/(.+)[.]md$', 1) end as vault, case when hit then regexp_extract(name, '^vaults/([0-9a-f-]+)/(.+)[.]md$', 2) end as path
            from (select name, regexp_matches(name, '^vaults/([0-9a-f-]+)/(.+)[.]md$') as hit from (select lower('vaults/' || printf('%X', vault_id) || '/' || path || case when id % 5 = 0 then '.txt' else '.md' end) as name from note_rows))"""
        ),
        "import_report": n(
            f"""select vault_id, count(*) filter (where problem is null) as imported, count(*) filter (where problem is not null) as skipped from (
            select vault_id, {PROBLEM} as problem from (select vault_id, split_part(path, '/', 1) as type, split_part(path, '/', 2) as name, case when id % 5 = 0 then '{{"type": "other"}}' else frontmatter end as frontmatter, coalesce(body, '') as body
                from note_rows where deleted_at is null qualify row_number() over (partition by vault_id, path order by id) = 1)) group by vault_id"""
        ),
        "validate_paths": sql("select id, coalesce(regexp_matches(path, '^[a-z0-9][a-z0-9-]*/[a-z0-9][a-z0-9-]*$'), false) as valid from note_rows union all select id, coalesce(regexp_matches(path, '^[a-z0-9][a-z0-9-]*/[a-z0-9][a-z0-9-]*$'), false) from file_rows", "note_rows", "file_rows"),
        "rate_limit": fold.format(w=SIX_HOURS_MS * 1000) + f"select user_id, event_id, count <= {FEW} as allowed from fold",
        "lockout": lock.format(logins=DERIVED["logins"].replace("{events}", "events"), w=DAY_MS * 1000, k=FAILURES) + "select user_id, event_id, locked from fold",
        "lockout_by_account_and_address": f"""with recursive logins as ({DERIVED["logins"].replace("{events}", "events")}),
            attempt as (select event_id, outcome, epoch_us(ts) as us, 'account' as who, user_id as key from logins union all select event_id, outcome, epoch_us(ts), 'address', event_id % 40 from logins),
            log as (select *, row_number() over (partition by who, key order by us, event_id) as n from attempt where outcome in ('failure', 'success')),
            fold as (
                select who, key, event_id, n, false as locked, case when outcome = 'failure' then us end as start, case when outcome = 'failure' then 1 else 0 end as count from log where n = 1
                union all select who, key, event_id, n, locked, case when locked then start when outcome = 'success' then null when inside then start else us end,
                    case when locked then count when outcome = 'success' then 0 when inside then count + 1 else 1 end
                from (select l.*, f.start, f.count, coalesce(l.us - f.start <= {DAY_MS * 1000}, false) as inside, coalesce(l.us - f.start <= {DAY_MS * 1000} and f.count >= {FAILURES}, false) as locked
                      from fold f join log l on l.who = f.who and l.key = f.key and l.n = f.n + 1))
            select event_id, bool_or(locked) as locked, coalesce(string_agg(who, ',' order by who) filter (where locked), '') as locked_by from fold group by event_id""",
        "debounce_with_maximum": f"""with recursive log as (select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as n from events),
            fold as (select user_id, n, us, us as first, 1 as burst from log where n = 1
                union all select user_id, n, us, case when fresh then us else first end, burst + fresh::int from (
                    select l.user_id, l.n, l.us, f.first, f.burst, l.us >= least(f.us + {20 * GAP_MS * 1000}, f.first + {50 * GAP_MS * 1000}) as fresh from fold f join log l on l.user_id = f.user_id and l.n = f.n + 1))
            select user_id, min(us) as first_us, least(max(us) + {20 * GAP_MS * 1000}, min(us) + {50 * GAP_MS * 1000}) as fire_us, count(*) as events from fold group by user_id, burst""",
        "debounce": f"""select user_id, min(us) as first_us, max(us) + {GAP_MS * 1000} as fire_us, count(*) as events from (
            select *, sum(fresh) over (partition by user_id order by us, event_id) as burst from (
                select user_id, event_id, epoch_us(ts) as us, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < {GAP_MS * 1000} then 0 else 1 end as fresh from events))
            group by user_id, burst""",
        "live_latest_state": "select user_id % 64 as vault_id, event_type as path, arg_max(props, (ts, event_id)) as state from events group by all",
        "last_valid_state": "select user_id % 64 as vault_id, event_type as path, arg_max(props, (ts, event_id)) as state from events where cast(json_extract_string(props, '$.k') as int) < 50 group by all",
    }
