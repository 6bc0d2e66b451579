import datetime

from pyspark.sql import functions as F

from cairnfield.operators import events, ingest, store
from tests.conftest import rows

REV = "note_id bigint, seq int, action string, frontmatter string, body string, created_at int"


def test_upsert_last_change_wins_and_insert_ignore_first(spark):
    state = spark.createDataFrame([("a", "read"), ("b", "edit")], "k string, v string")
    changes = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("c", "z", 1)], "k string, v string, seq int")
    assert rows(store.upsert(state, changes, ["k"])) == [("a", "y"), ("b", "edit"), ("c", "z")]
    assert rows(store.insert_ignore(state, changes, ["k"], "seq")) == [("a", "read"), ("b", "edit"), ("c", "z")]
    assert rows(store.replace_by_key(state, state.filter("k = 'a'").select("k"), spark.createDataFrame([("a", "n"), ("a", "m")], "k string, v string"))) == [("a", "m"), ("a", "n"), ("b", "edit")]
    assert rows(store.upsert(state.limit(0), changes.limit(0), ["k"])) == []


def test_compare_and_set_applies_once(spark):
    state = spark.createDataFrame([(1, None), (2, 5)], "id int, used int")
    after, hit = store.compare_and_set(state, F.col("used").isNull(), "used", F.lit(9))
    assert rows(after) == [(1, 9), (2, 5)] and rows(hit) == [(1, None)]
    assert store.compare_and_set(after, F.col("used").isNull(), "used", F.lit(10))[1].count() == 0


def revisions(spark):
    return spark.createDataFrame([(1, 0, "create", "{}", "a", 1), (1, 1, "update", "{}", "b", 2), (1, 2, "delete", "{}", "b", 3), (1, 3, "update", None, None, 4), (1, 4, "update", None, None, 5), (2, 0, "create", "{}", "z", 1)], REV)


def test_revisions(spark):
    r = revisions(spark)
    assert rows(store.dedupe_consecutive(r).select("note_id", "seq")) == [(1, 0), (1, 1), (1, 3), (2, 0)]
    assert rows(store.latest_revision(r).select("note_id", "seq")) == [(1, 4), (2, 0)]
    assert rows(store.state_as_of(r, F.lit(2)).select("note_id", "body")) == [(1, "b"), (2, "z")]
    out = store.revert(r, spark.createDataFrame([(1, 0), (2, 0), (2, 77)], "note_id bigint, target_seq int"))
    assert (1, 5, "revert", "a") in rows(out.select("note_id", "seq", "action", "body")) and (2, 0, "revert", "z") in rows(out.select("note_id", "seq", "action", "body"))
    assert store.purge(r, r.filter("seq = 0")).count() == 4


def test_restore_and_delete(spark):
    at = datetime.datetime(2024, 1, 1)
    notes = spark.createDataFrame([(1, 1, "a/b", None), (2, 1, "a/b", at), (3, 1, "c/d", at), (4, 1, "c/d", at + datetime.timedelta(1))], "id bigint, vault_id bigint, path string, deleted_at timestamp")
    assert rows(store.restorable(notes).select("id", "outcome")) == [(2, "taken"), (3, "taken"), (4, "restored")]
    gone = store.soft_delete(notes, notes.select("vault_id", "path"), F.timestamp_seconds(F.lit(0)))
    assert gone.filter("deleted_at is null").count() == 0 and gone.filter("id = 2").first()["deleted_at"] == at


def test_sync_counters(spark):
    schema = "repository_id bigint, path string, content string"
    empty = spark.createDataFrame([], "repository_id bigint, path string, content_hash string")
    two = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], schema)
    assert rows(ingest.sync_summary(ingest.sync_diff(empty, two, two))) == [(1, 2, 0, 0, 0)]
    state = two.select("repository_id", "path", ingest.content_hash(F.col("content")).alias("content_hash"))
    change = spark.createDataFrame([(1, "a", "z")], schema)
    assert rows(ingest.sync_summary(ingest.sync_diff(state, change, change))) == [(1, 0, 1, 1, 0)]
    assert rows(ingest.sync_summary(ingest.sync_diff(state, two.filter("path = 'a'"), two))) == [(1, 0, 0, 0, 1)]
    assert rows(ingest.repeated_paths(two.unionByName(two.filter("path = 'a'")))) == [(1, "a", 2)]


def test_should_poll_truth_table(spark):
    rows_ = [(None, None), (95, None), (80, 85), (80, None), (80, 70)]
    df = spark.createDataFrame(rows_, "w int, s int").select(*(F.when(F.col(c).isNotNull(), F.timestamp_seconds(F.col(c) * 60)).alias(c) for c in "ws"))
    got = [r[0] for r in df.select(ingest.should_poll(F.col("w"), F.col("s"), F.timestamp_seconds(F.lit(6000)), 600)).collect()]
    assert got == [True, False, False, True, True]


def test_import_resolution_order(spark):
    files = spark.createDataFrame([(1, 1, "src/main.ts"), (2, 1, "src/helper.ts"), (3, 1, "src/helper.js"), (4, 1, "src/lib/index.py"), (5, 2, "src/main.ts"), (6, 1, "root.ts")], "id bigint, repository_id bigint, path string")
    imports = spark.createDataFrame([(1, "./helper"), (1, "./helper"), (1, "./lib"), (1, "../root"), (1, "./helper.js"), (1, "react"), (5, "./helper"), (1, "../../up")], "source_file_id bigint, target_path string")
    got = {(a, b): c for a, b, c in rows(ingest.resolve_imports(imports, files))}
    assert got == {(1, "./helper"): 2, (1, "./lib"): 4, (1, "../root"): 6, (1, "./helper.js"): 3, (5, "./helper"): None, (1, "../../up"): None}


def log(spark, times, outcomes=None):
    base = datetime.datetime(2024, 1, 1)
    data = [(i, 1, base + datetime.timedelta(seconds=t), (outcomes or ["failure"] * len(times))[i]) for i, t in enumerate(times)]
    return spark.createDataFrame([*data, (99, 1, None, "failure")], "event_id bigint, user_id bigint, ts timestamp, outcome string")


def test_rate_limit_is_anchored_at_the_first_event(spark):
    got = [r["allowed"] for r in events.rate_limit(log(spark, [0, 10, 20, 60, 61, 62]), limit=2, window_ms=60_000).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True]


def test_lockout_and_success(spark):
    df = log(spark, [0, 1, 2, 3, 70, 71], ["failure", "failure", "failure", "success", "failure", "failure"])
    got = [r["locked"] for r in events.lockouts(df, failures=2, window_ms=60_000).orderBy("event_id").collect()]
    assert got == [False, False, True, True, False, False]


def test_debounce(spark):
    got = events.debounce(log(spark, [0, 0.2, 0.4, 5]), gap_ms=300).orderBy("first_us").collect()
    assert [r["events"] for r in got] == [3, 1] and got[0]["fire_us"] - got[0]["first_us"] == 700_000


def test_debounce_fires_at_the_latest_after_its_maximum(spark):
    got = events.debounce(log(spark, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 20]), gap_ms=2000, most_ms=10_000).orderBy("first_us").collect()
    assert [((r["fire_us"] - r["first_us"]) / 1e6, r["events"]) for r in got] == [(10.0, 10), (3.0, 2), (2.0, 1)]


def test_lockout_by_account_and_address(spark):
    rows_ = [(i, 1 if i < 6 else 2, "a" if i % 2 else "b", "failure") for i in range(10)]
    df = spark.createDataFrame(rows_, "event_id bigint, account bigint, address string, outcome string").withColumn("ts", F.timestamp_seconds("event_id"))
    got = {r["event_id"]: r["locked_by"] for r in events.lockouts_by(df, failures=3).collect()}
    assert got == {0: "", 1: "", 2: "", 3: "account", 4: "account", 5: "account", 6: "address", 7: "address", 8: "address", 9: "account,address"}
    assert events.lockouts_by(df.limit(0)).count() == 0 and events.rate_limit(df.limit(0), "account").count() == 0


def test_folds_of_one_hot_key(spark):
    df = spark.range(30_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("user_id"), F.timestamp_seconds("id").alias("ts"))
    got = events.rate_limit(df.unionByName(df.limit(10)), limit=120, window_ms=60_000_000).groupBy("user_id").agg(F.count_if("allowed").alias("n"), F.count("*").alias("all")).filter("user_id = -1").first()
    assert (got["n"], got["all"]) == (120, 20_000)
