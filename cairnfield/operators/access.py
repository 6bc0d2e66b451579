"""Who may see and change what: live permission resolution as joins.

Grants come from owning a container, from a direct share, and from shares to teams one is a member of; the highest
wins. Every result is computed from the frames given, nothing is kept between calls. Frames and columns:
users(id, email, status, role), vaults(id, name, owner_id, mergeable), memberships(team_id, user_id, role),
shares(vault_id, grantee_type, grantee_id, permission), repositories(id, name, owner_id, mergeable),
repository_shares(repository_id, grantee_type, grantee_id). Null ids join nothing; repeated grants count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.grid import grid_join

RANKS = {"read": 1, "edit": 2, "owner": 3}
REPOSITORY_RANKS = {"viewer": 1, "owner": 2}


def rank_of(access: Column, ranks: dict[str, int] = RANKS) -> Column:
    """1, 2 or 3 of an access level; null if it is none."""
    return F.create_map(*(F.lit(x) for pair in ranks.items() for x in pair))[access]


def level_of(rank: Column, ranks: dict[str, int] = RANKS) -> Column:
    return F.create_map(*(F.lit(x) for name, n in ranks.items() for x in (n, name)))[rank]


def at_least(access: Column, needed: str) -> Column:
    """Whether an access level reaches another; no access never does."""
    return F.coalesce(rank_of(access) >= RANKS[needed], F.lit(False))


def direct_shares(shares: DataFrame) -> DataFrame:
    """(user_id, vault_id, permission) of shares to users."""
    return shares.filter("grantee_type = 'user'").select(F.col("grantee_id").alias("user_id"), "vault_id", "permission")


def team_shares(shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, vault_id, permission, team_id) of shares through a team, each as often as its share and its membership."""
    whole = F.xxhash64(*shares.columns).alias("_row")  # tells shares of equal permission apart where they are dealt out
    to_team = shares.filter("grantee_type = 'team'").select(F.col("grantee_id").alias("team_id"), "vault_id", "permission", whole)
    return grid_join(to_team, memberships.select("team_id", "user_id"), "team_id").select("user_id", "vault_id", "permission", "team_id")


def grouped_team_shares(shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, vault_id, permission) of shares through a team, by a plain join, for results that are grouped at once."""
    to_team = shares.filter("grantee_type = 'team'").select(F.col("grantee_id").alias("team_id"), "vault_id", "permission")
    return to_team.join(memberships.select("team_id", "user_id"), "team_id").select("user_id", "vault_id", "permission")


def grants(vaults: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, vault_id, rank) of every grant, of whatever origin."""
    owned = vaults.select(F.col("owner_id").alias("user_id"), F.col("id").alias("vault_id"), F.lit(3).alias("rank"))
    shared = direct_shares(shares).unionByName(grouped_team_shares(shares, memberships))
    known = shared.join(vaults.select(F.col("id").alias("vault_id")), "vault_id", "left_semi")
    return owned.unionByName(known.select("user_id", "vault_id", rank_of(F.col("permission")).alias("rank")))


def accessible_vaults(users: DataFrame, vaults: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, vault_id, access) for all active users at once; the highest grant of each pair."""
    active = users.filter("status = 'active'").select(F.col("id").alias("user_id"))
    best = grants(vaults, shares, memberships).groupBy("user_id", "vault_id").agg(F.max("rank").alias("rank"))
    return best.join(active, "user_id", "left_semi").select("user_id", "vault_id", level_of(F.col("rank")).alias("access"))


def resolve_access(requests: DataFrame, users: DataFrame, vaults: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, vault_id, access) of asked pairs; access is null without a grant and for users who aren't active."""
    asked = requests.select("user_id", "vault_id").distinct()
    found = accessible_vaults(users, vaults, shares, memberships)
    return asked.join(found, ["user_id", "vault_id"], "left").select("user_id", "vault_id", "access")


def users_with_access(vaults: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(vault_id, user_id) of all who hold a grant, active or not."""
    return grants(vaults, shares, memberships).select("vault_id", "user_id").distinct()


def accessible_repositories(users: DataFrame, repositories: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    """(user_id, repository_id, access): owner beats viewer; active users only."""
    active = users.filter("status = 'active'").select(F.col("id").alias("user_id"))
    owned = repositories.select(F.col("owner_id").alias("user_id"), F.col("id").alias("repository_id"), F.lit(2).alias("rank"))
    direct = shares.filter("grantee_type = 'user'").select(F.col("grantee_id").alias("user_id"), "repository_id", F.lit(1).alias("rank"))
    team = shares.filter("grantee_type = 'team'").select(F.col("grantee_id").alias("team_id"), "repository_id").join(memberships.select("team_id", "user_id"), "team_id").select("user_id", "repository_id", F.lit(1).alias("rank"))
    known = direct.unionByName(team).join(repositories.select(F.col("id").alias("repository_id")), "repository_id", "left_semi")
    best = owned.unionByName(known).groupBy("user_id", "repository_id").agg(F.max("rank").alias("rank"))
    return best.join(active, "user_id", "left_semi").select("user_id", "repository_id", level_of(F.col("rank"), REPOSITORY_RANKS).alias("access"))


def resolve_repository_access(requests: DataFrame, users: DataFrame, repositories: DataFrame, shares: DataFrame, memberships: DataFrame) -> DataFrame:
    found = accessible_repositories(users, repositories, shares, memberships)
    return requests.select("user_id", "repository_id").distinct().join(found, ["user_id", "repository_id"], "left").select("user_id", "repository_id", "access")


def merged_scope(preferences: DataFrame, vaults: DataFrame, accessible: DataFrame) -> DataFrame:
    """(user_id, vault_id) that a user's merged view covers: wanted, mergeable and accessible."""
    wanted = preferences.filter("include").select("user_id", "vault_id")
    open_ones = vaults.filter("mergeable").select(F.col("id").alias("vault_id"))
    return wanted.join(open_ones, "vault_id", "left_semi").join(accessible.select("user_id", "vault_id"), ["user_id", "vault_id"], "left_semi").select("user_id", "vault_id").distinct()


def affects(user_ids: Column, vault_ids: Column, user_id: Column, vault_id: Column) -> Column:
    """Whether a permission change concerns a connection."""
    return F.coalesce(F.array_contains(user_ids, user_id), F.lit(False)) | F.coalesce(F.array_contains(vault_ids, vault_id), F.lit(False))


def affected_connections(changes: DataFrame, connections: DataFrame) -> DataFrame:
    """(connection_id) of connections that any change concerns: two equi-joins, not a scan of all pairs."""
    by_user = connections.join(changes.select(F.explode("user_ids").alias("user_id")).distinct(), "user_id", "left_semi")
    by_vault = connections.join(changes.select(F.explode("vault_ids").alias("vault_id")).distinct(), "vault_id", "left_semi")
    return by_user.select("connection_id").unionByName(by_vault.select("connection_id")).distinct()


def token_valid(expires_at: Column, revoked_at: Column, now: Column) -> Column:
    """A connection token is still valid at the instant it expires; one without expiry always is."""
    return revoked_at.isNull() & ~F.coalesce(expires_at < now, F.lit(False))


def session_valid(expires_at: Column, now: Column) -> Column:
    """A session, e-mail token or export link is expired at the instant it expires."""
    return expires_at > now
