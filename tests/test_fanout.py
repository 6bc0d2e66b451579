from collections import Counter

import pytest
from pyspark.sql import functions as F

from cairnfield.functions import grid
from cairnfield.operators import access, admin
from tests.conftest import rows


@pytest.fixture
def large(spark, monkeypatch):
    """Joins as of large tables: nothing is broadcast, a block has few rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(grid, "BLOCK", 64)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled_rows(df):
    """Rows that the exchanges of the plan wrote when it ran."""
    df._jdf.queryExecution().toRdd().count()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        written = node.metrics().get("shuffleRecordsWritten")
        found += written.get().value() if written.isDefined() else 0
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def recipients(changes, members):
    """By hand; null is unequal to everything and in no team."""
    out = set()
    for change, kind, grantee, actor in changes:
        if kind == "user":
            out.add((change, grantee))
        if kind == "team" and grantee is not None and actor is not None:
            out |= {(change, user) for team, user in members if team == grantee and user is not None and user != actor}
    return sorted(out, key=repr)


def test_fanout_shuffles_its_inputs_only(spark, large):
    changes = spark.range(0, 400, 1, 4).selectExpr("id as change_id", "'team' as grantee_type", "floor(id / 1000) as grantee_id", "cast(10 as bigint) as actor_id")
    members = spark.range(0, 300, 1, 4).selectExpr("floor(id / 1000) as team_id", "id as user_id")
    found = admin.notify_fanout(changes, members)
    assert shuffled_rows(found) < 400 * 299 / 4
    assert found.count() == found.distinct().count() == 400 * 299


def test_fanout_of_repeated_null_and_several_grantees(spark, large):
    changes = [
        (1, "team", 7, 10), (1, "team", 7, 10), (2, "team", 7, 10), (2, "team", 8, 10), (2, "user", 11, 10), (2, "user", 10, 10), (3, "user", 11, 10), (3, "user", 11, 12), (4, "team", 7, 10), (4, "team", 7, 11),
        (5, "team", 7, None), (6, "team", None, 10), (7, "user", None, 10), (None, "team", 7, 10), (None, "user", 50, 10), (None, "user", 11, 10), (8, "group", 7, 10), (8, "team", 8, 10), (9, None, 7, 10), (10, "team", 99, 10), (11, "team", 7, None), (11, "team", 7, 10),
    ]
    members = [(7, u) for u in range(10, 210)] * 2 + [(8, u) for u in range(100, 300)] + [(7, None), (None, 11), (None, None), (9, 11)]
    frames = spark.createDataFrame(changes, "change_id bigint, grantee_type string, grantee_id bigint, actor_id bigint"), spark.createDataFrame(members, "team_id bigint, user_id bigint")
    assert rows(admin.notify_fanout(*frames)) == recipients(changes, members)
    assert rows(admin.notify_fanout(frames[0].limit(0), frames[1])) == rows(admin.notify_fanout(*frames).limit(0)) == []


def test_grid_join_has_each_pair_as_often_as_a_plain_join(spark, large):
    left = [(k, i // 2) for k, n in ((1, 500), (2, 3), (3, 200), (5, 1)) for i in range(n)] + [(None, 1)]
    right = [(k, i // 3) for k, n in ((1, 200), (2, 400), (4, 100), (5, 1)) for i in range(n)] + [(None, 2)]
    a, b = spark.createDataFrame(left, "k bigint, l bigint"), spark.createDataFrame(right, "k bigint, r bigint")
    got = grid.grid_join(a, b, "k")
    assert got.columns == ["k", "l", "r"]
    assert Counter(map(tuple, got.collect())) == Counter((k, x, y) for k, x in left if k is not None for j, y in right if j == k)


def test_grid_join_deals_a_hot_key_out(spark, large):
    a, b = (spark.range(0, n, 1, 4).selectExpr("floor(id / 1000) as k", f"id as {c}") for n, c in ((400, "l"), (300, "r")))
    sizes = [r["count"] for r in grid.grid_join(a, b, "k").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) < 40_000


def test_shares_of_a_large_team_are_dealt_out(spark, large):
    shares = spark.range(0, 400, 1, 4).selectExpr("id", "id % 2 as vault_id", "'team' as grantee_type", "floor(id / 1000) as grantee_id", "'read' as permission")
    members = spark.range(0, 300, 1, 4).selectExpr("floor(id / 1000) as team_id", "id as user_id")
    sizes = [r["count"] for r in access.team_shares(shares, members).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 120_000 and max(sizes) < 40_000


def test_team_shares_count_repeated_rows_and_skip_null(spark, large):
    shares = [(v % 3, "team", 7, "edit" if v % 2 else "read") for v in range(200)] + [(1, "team", 8, None), (None, "team", 8, "read"), (1, "team", None, "read"), (1, "user", 7, "read"), (1, "team", 99, "read")]
    members = [(7, u // 2) for u in range(150)] + [(8, None), (8, 5), (None, 5), (6, 1)]
    frames = spark.createDataFrame(shares, "vault_id bigint, grantee_type string, grantee_id bigint, permission string"), spark.createDataFrame(members, "team_id bigint, user_id bigint")
    wanted = Counter((u, v, p, t) for v, kind, g, p in shares if kind == "team" and g is not None for t, u in members if t == g)
    got = access.team_shares(*frames)
    assert got.columns == ["user_id", "vault_id", "permission", "team_id"] and Counter(map(tuple, got.collect())) == wanted
    assert access.team_shares(frames[0].limit(0), frames[1]).count() == 0
