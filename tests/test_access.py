from pyspark.sql import functions as F

from cairnfield.operators import access
from tests.conftest import rows


def frames(spark):
    users = spark.createDataFrame([(1, "active"), (2, "active"), (3, "deactivated"), (4, "active"), (None, "active")], "id bigint, status string")
    vaults = spark.createDataFrame([(10, 1, True), (11, 3, True), (12, 4, False)], "id bigint, owner_id bigint, mergeable boolean")
    members = spark.createDataFrame([(7, 2), (7, 2), (7, 4)], "team_id bigint, user_id bigint")
    shares = spark.createDataFrame(
        [(10, "user", 2, "read"), (10, "team", 7, "edit"), (11, "user", 2, "read"), (99, "user", 2, "edit"), (10, "user", 1, "read"), (None, "user", 2, "read"), (11, "user", 2, "read")],
        "vault_id bigint, grantee_type string, grantee_id bigint, permission string",
    )
    return users, vaults, shares, members


def test_highest_grant_wins_and_only_active_users_get_in(spark):
    users, vaults, shares, members = frames(spark)
    got = rows(access.accessible_vaults(users, vaults, shares, members))
    assert got == sorted([(1, 10, "owner"), (2, 10, "edit"), (2, 11, "read"), (4, 10, "edit"), (4, 12, "owner")], key=repr)


def test_leaving_the_team_revokes(spark):
    users, vaults, shares, members = frames(spark)
    got = rows(access.accessible_vaults(users, vaults, shares, members.filter("user_id <> 2")))
    assert (2, 10, "read") in got and (2, 10, "edit") not in got


def test_users_with_access_ignores_status(spark):
    users, vaults, shares, members = frames(spark)
    assert (11, 3) in rows(access.users_with_access(vaults, shares, members))


def test_requests_without_a_grant_are_null_and_empty_tables_work(spark):
    users, vaults, shares, members = frames(spark)
    asked = spark.createDataFrame([(1, 12), (1, 12), (3, 11)], "user_id bigint, vault_id bigint")
    assert rows(access.resolve_access(asked, users, vaults, shares, members)) == [(1, 12, None), (3, 11, None)]
    none = shares.limit(0)
    assert rows(access.accessible_vaults(users, vaults.limit(0), none, members.limit(0))) == []


def test_levels_and_expiry_at_the_instant(spark):
    df = spark.createDataFrame([("read",), ("edit",), ("owner",), (None,)], "access string")
    assert [r[0] for r in df.select(access.at_least(F.col("access"), "edit")).collect()] == [False, True, True, False]
    t = spark.sql("select timestamp'2024-01-01' as at, timestamp'2024-01-01' as now, cast(null as timestamp) as never")
    got = t.select(access.token_valid(F.col("at"), F.col("never"), F.col("now")), access.session_valid(F.col("at"), F.col("now")), access.token_valid(F.col("never"), F.col("never"), F.col("now"))).first()
    assert tuple(got) == (True, False, True)


def test_merged_scope_needs_preference_and_mergeable(spark):
    users, vaults, shares, members = frames(spark)
    prefs = spark.createDataFrame([(2, 10, True), (2, 11, False), (4, 12, True)], "user_id bigint, vault_id bigint, include boolean")
    assert rows(access.merged_scope(prefs, vaults, access.accessible_vaults(users, vaults, shares, members))) == [(2, 10)]
