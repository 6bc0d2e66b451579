import importlib
import sys

import __spark_entry__ as entry
from cairnfield.api import Engine
from cairnfield.plans.tables import Tables
from pyspark.sql import functions as F


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "cairnfield.llm", None)
    module = importlib.reload(entry)
    assert "p7_found" in module.queries() and "p8_ids" not in module.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark, folder):
    df = entry.entry(spark)
    assert df.columns == ["kind", "id", "score", "title", "frontmatter", "language"] and df.count() == 20


def test_engine(spark, folder):
    t = Tables(spark, folder)
    frames = {n: t(n) for n in ("users", "teams", "memberships", "vaults", "shares", "preferences", "repositories", "repository_shares", "note_links", "repository_file_imports")}
    frames |= {"notes": t("note_rows"), "repository_files": t("file_rows"), "embeddings": t("embeddings").select(F.lit("note").alias("kind"), F.col("vec_id").alias("id"), "embedding")}
    engine = Engine(spark, frames)
    assert engine.search("note index", [1.0] * 64, user_id=20).count() <= 20
    g = engine.graph(user_id=20, types="notes,people")
    keys = {r[0] for r in g.nodes.select("key").collect()}
    assert {x for r in g.edges.select("a", "b").collect() for x in r} <= keys
    assert engine.search("note index", [1.0] * 64, user_id=-1).count() == 0


def test_opened_engine_loads_the_stored_semantic_edges(spark, folder, tmp_path):
    t = Tables(spark, folder)
    frames = {n: t(n) for n in ("users", "memberships", "vaults", "shares", "repositories", "repository_shares", "repository_file_imports")} | {"notes": t("note_rows"), "repository_files": t("file_rows")}
    engine = Engine(spark, frames)
    user = engine.access().groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()[0]
    a, b = sorted(r[0] for r in engine.graph(user_id=user).nodes.select("key").orderBy("key").limit(2).collect())
    frames["semantic_edges"] = spark.createDataFrame([(a, b, 0.9)], "a string, b string, similarity double")
    for name, df in frames.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    edges = Engine.open(spark, str(tmp_path)).graph(user_id=user).edges
    assert [tuple(r) for r in edges.filter("kind = 'semantic'").collect()] == [(a, b, "semantic")]
