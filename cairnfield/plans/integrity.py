"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnfield.operators import references
from cairnfield.sources.tables import table


def _orphans(s: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(*(table(s, d, t) for t in ("notes", "note_links", "repositories", "repository_files", "repository_file_imports")))


def queries() -> dict:
    return {
        "p7_found": lambda s, d: _orphans(s, d).select("ref_table", "source_id", "target_path"),
        "p7_report": lambda s, d: references.orphan_report(_orphans(s, d)),
    }


_NORMAL = """list_reduce(list_prepend('', list_filter(string_split(case when contains(f.path, '/') then regexp_replace(f.path, '/[^/]*$', '') else '.' end || '/' || i.target_path, '/'), lambda p: p <> '' and p <> '.')),
            lambda acc, p: case when p = '..' then regexp_replace(acc, '(^|/)[^/]*$', '') when acc = '' then p else acc || '/' || p end)"""

ORPHANS = f"""
    with note as (select distinct id, vault_id, path, deleted_at, created_at, updated_at from notes),
    file as (select distinct id, repository_id, path, created_at, updated_at from repository_files),
    link as (select distinct source_note_id as source_id, target_path, n.vault_id, n.updated_at from note_links l left join note n on n.id = l.source_note_id where target_path is not null),
    by_path as (select repository_id, path, min(created_at) as created_at from file group by all),
    to_note as (
        select 'note_links' as ref_table, source_id, target_path, link.updated_at, min(t.created_at) as created_at from link
        left join note t on t.vault_id = link.vault_id and t.path = target_path and t.deleted_at is null
        where not regexp_matches(target_path, '^repo:.*/') group by all),
    to_file as (
        select 'note_links', source_id, target_path, link.updated_at, min(b.created_at) from link
        left join repositories r on r.name = regexp_extract(target_path, '^repo:([^/]*)/', 1)
        left join by_path b on b.repository_id = r.id and b.path = regexp_replace(target_path, '^repo:[^/]*/', '')
        where regexp_matches(target_path, '^repo:.*/') group by all),
    imp as (select distinct source_file_id as source_id, target_path, resolved_target_file_id as target_id from repository_file_imports where resolved_target_file_id is not null or target_path like '.%'),
    by_id as (
        select 'repository_file_imports', source_id, target_path, f.updated_at, min(t.created_at) from imp left join file f on f.id = source_id left join file t on t.id = target_id
        where target_id is not null group by all),
    base as (select source_id, i.target_path, f.updated_at, f.repository_id, {_NORMAL} as base from imp i join file f on f.id = i.source_id where target_id is null),
    tried as (
        select *, unnest([base] || list_transform(['.ts', '.tsx', '.js', '.jsx', '.py', '.go'], lambda e: base || e) || list_transform(['.ts', '.tsx', '.js', '.jsx', '.py', '.go'], lambda e: base || '/index' || e)) as path, unnest(range(13)) as pos from base),
    relative as (
        select 'repository_file_imports', source_id, target_path, updated_at, arg_min(b.created_at, case when b.path is not null then pos end) from tried left join by_path b using (repository_id, path) group by all),
    every as (select * from to_note union all select * from to_file union all select * from by_id union all select * from relative),
    orphan as (
        select ref_table, source_id, target_path, max(updated_at) as updated_at, min(case when created_at is null then 'missing' else 'later' end) as reason from every
        where created_at is null or updated_at is null or created_at > updated_at group by all)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": f"{ORPHANS} select distinct ref_table, source_id, target_path from orphan",
        "p7_report": f"{ORPHANS} select ref_table, strftime(updated_at, '%Y-%m') as period, reason, count(*) as orphans from orphan group by all",
    }
