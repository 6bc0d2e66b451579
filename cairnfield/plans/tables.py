"""Frames that queries start from: stored tables, and relations that are derived from them by plain SQL.

The data folders hold no users, teams, shares, tokens or revisions; these are projections of other tables. The SQL is
one text for Spark and for DuckDB; table names stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from cairnfield.sources.tables import table

#: The instant at which tokens, polls and updates are judged, in seconds.
NOW_SECONDS = 1_756_684_800

DERIVED = {
    "users": """select c_custkey as id, lower(c_name) as email, case c_mktsegment when 'HOUSEHOLD' then 'deactivated' when 'MACHINERY' then 'pending_approval' else 'active' end as status,
        case when c_custkey % 50 = 0 then 'admin' else 'member' end as role from {customer}""",
    "teams": "select cast(n_nationkey as bigint) as team_id, n_name as name from {nation}",
    "memberships": "select cast(c_nationkey as bigint) as team_id, c_custkey as user_id, case when c_custkey % 20 = 0 then 'owner' else 'member' end as role from {customer} where c_custkey % 10 = 0",
    "shares": """select p_partkey as id, p_partkey % 64 + 1 as vault_id, case when p_size % 2 = 0 then 'team' else 'user' end as grantee_type,
        case when p_size % 2 = 0 then cast(p_size % 25 as bigint) else (p_partkey * 7) % 150 end as grantee_id, case when p_size > 25 then 'edit' else 'read' end as permission from {part}""",
    "repository_shares": """select p_partkey as id, p_partkey % 96 + 1 as repository_id, case when p_size % 2 = 0 then 'team' else 'user' end as grantee_type,
        case when p_size % 2 = 0 then cast(p_size % 25 as bigint) else (p_partkey * 7) % 150 end as grantee_id from {part} where p_partkey % 3 = 0""",
    "preferences": "select (p_partkey * 11) % 150 as user_id, p_partkey % 64 + 1 as vault_id, p_size % 3 <> 0 as include from {part}",
    "connections": """select event_id as id, user_id, event_id % 64 + 1 as vault_id, sha2(cast(event_id as string), 256) as token_hash, case event_id % 3 when 0 then 'account' when 1 then 'vault' else 'repository' end as scope,
        floor(value) as minutes, event_id % 11 = 0 as revoked, event_id % 7 = 0 as used from {events}""",
    "revisions": """select id as note_id, s.seq, case when s.seq = 0 then 'create' else 'update' end as action, frontmatter,
        case when s.seq = 0 then coalesce(name, '') when s.seq = 3 and id % 3 = 0 then concat(coalesce(name, ''), '!') else coalesce(path, '') end as body, id * 10 + s.seq as stamp
        from (select distinct id, name, path, frontmatter from {notes}) n cross join (select 0 as seq union all select 1 union all select 2 union all select 3) s""",
    "logins": "select event_id, user_id, ts, case when event_type in ('error', 'view') then 'failure' when event_type = 'signup' then 'success' else 'other' end as outcome from {events}",
    "live_notes": "select distinct * from {notes} where deleted_at is null",
    "note_rows": "select distinct * from {notes}",
    "file_rows": "select distinct * from {repository_files}",
}


class Tables:
    """The frames of one data folder by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        text = DERIVED.get(name)
        if text is None:
            return table(self.spark, self.folder, name)
        parents = {p: self(p) for p in re.findall(r"\{(\w+)\}", text)}
        return self.spark.sql(text, **parents)


def sql(text: str, *names: str) -> str:
    """DuckDB's text of a query over derived relations."""
    parts = [f"{n} as ({re.sub(r'[{}]', '', DERIVED[n]).replace('sha2(cast(event_id as string), 256)', 'sha256(cast(event_id as varchar))')})" for n in names]
    return (f"with {', '.join(parts)} " if parts else "") + text
