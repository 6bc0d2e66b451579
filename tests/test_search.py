import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.operators import embedding, search
from tests.conftest import rows

SCHEMA = "kind string, id bigint, scope_id string, title string, text string, embedding array<float>, score int"


def items(spark):
    return spark.createDataFrame(
        [
            ("note", 1, "a", "people/margaret", "wrote the guidance software for the mission", [1.0, 0.0], 9),
            ("note", 1, "a", "people/margaret", "wrote the guidance software for the mission", [1.0, 0.0], 9),
            ("note", 2, "a", "people/wernher", "built the rocket", [0.0, 1.0], 9),
            ("note", 3, "b", "notes/grocery", "milk and eggs", None, 9),
            ("code", 1, "r", "src/guidance.ts", "export const software = guidance", [0.9, 0.1], 9),
            ("code", 4, "r", None, None, [0.0, 0.0], 9),
        ],
        SCHEMA,
    )


def test_query_syntax():
    assert search.parse_query('"open points" or vault -digest') == [[search.Clause(("open", "points"), False)], [search.Clause(("vault",), False), search.Clause(("digest",), True)]]
    assert search.parse_query("a or or vault or") == [[search.Clause(("vault",), False)]]
    assert search.parse_query("") == [] and search.parse_query("the or") == []


def test_first_hit_and_headline(spark):
    got = search.hybrid_search(items(spark), "guidance software", [1.0, 0.0]).collect()
    assert (got[0]["kind"], got[0]["id"]) == ("note", 1) and "<b>guidance</b>" in got[0]["snippet"]
    assert max(r["score"] for r in got) <= round(2 / 61, 9) + 1e-9
    assert len({(r["kind"], r["id"]) for r in got}) == len(got)
    scores = [r["score"] for r in got]
    assert scores == sorted(scores, reverse=True)


def test_scope_is_inside_and_blank_finds_nothing(spark):
    scope = spark.createDataFrame([("note", "b")], "kind string, scope_id string")
    assert rows(search.hybrid_search(items(spark), "guidance", [1.0, 0.0], scope=scope)) == []
    assert rows(search.hybrid_search(items(spark), "  ", [1.0, 0.0])) == []
    assert rows(search.hybrid_search(items(spark).limit(0), "guidance", [1.0, 0.0])) == []
    assert [r["id"] for r in search.hybrid_search(items(spark), "milk", []).collect()] == [3]


@pytest.mark.parametrize(("query", "ids"), [("guidance -rocket", [1]), ('"guidance software"', [1]), ('"software guidance"', []), ("rocket or milk", [2, 3]), ("built milk or guidance", [1]), ("guidance or built milk", [1]), ("built rocket or eggs milk", [2, 3]), ("guidance -mission or -rocket", [1, 3]), ("-rocket", [1, 3])])
def test_matches(spark, query, ids):
    notes = items(spark).filter("kind = 'note'").dropDuplicates(["id"])
    got = notes.filter(search.matches(query, search.tokens(F.col("text")))).select("id")
    assert sorted(r[0] for r in got.collect()) == ids
    found = search.keyword_hits(notes.withColumn("title", F.lit("")), query)
    assert sorted(r["id"] for r in found.collect()) == ids


def test_index_equals_the_scan(spark, tmp_path):
    data = items(spark).withColumn("frontmatter", F.when(F.col("kind") == "note", '{"tags":["alpha"]}')).withColumn("language", F.when(F.col("kind") == "code", "typescript"))
    search.write_index(data, str(tmp_path), buckets=3, salts=2)
    index = search.open_index(spark, str(tmp_path))
    scope = spark.createDataFrame([("note", "a"), ("note", "a"), ("code", "r")], "kind string, scope_id string")
    for query in ('"guidance software"', '"software guidance"', "alpha guidance -rocket or milk", "-rocket", "the"):
        assert rows(search.index_hits(index, query)) == rows(search.keyword_hits(data, query).distinct())
    for query, s in (("guidance software", None), ("guidance", scope), ("-rocket", scope), ("", None)):
        got, want = (search.indexed_search(index, query, [1.0, 0.0], scope=s), search.hybrid_search(data, query, [1.0, 0.0], scope=s))
        assert got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]
    first = search.indexed_search(index, "guidance", [1.0, 0.0]).collect()
    assert {(r["kind"], r["frontmatter"] is None, r["language"]) for r in first} <= {("note", False, None), ("code", True, "typescript")}
    search.write_index(data.limit(0), f"{tmp_path}/none", buckets=3)
    assert rows(search.indexed_search(search.open_index(spark, f"{tmp_path}/none"), "guidance", [1.0, 0.0])) == []


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(230, 8)).round(3)
    data = [(f"n:{i}", i, [float(x) for x in v]) for i, v in enumerate(m)] + [("n:0", 0, [float(x) for x in m[0]]), ("zero", 900, [0.0] * 8), ("none", 901, None), ("empty", 902, [])]
    df = spark.createDataFrame(data, "key string, seq bigint, embedding array<float>")
    unit = m.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    for block in (64, 4096):
        got = {(r["key"], r["rank"]): r["neighbour"] for r in embedding.knn(df, 3, block).collect()}
        for i in range(230):
            order = sorted((j for j in range(230) if j != i), key=lambda j: (-sims[i, j], f"n:{j}"))[:3]
            assert [got[f"n:{i}", k] for k in (1, 2, 3)] == [f"n:{j}" for j in order]
    some = df.filter("seq % 100 = 0").select("key")
    assert {r["key"] for r in embedding.knn(df, 3, 64, some).collect()} == {"n:0", "n:100", "n:200"}


def test_replay_admits_only_earlier_neighbours(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("b", 2, [1.0, 0.1]), ("c", 3, [0.9, 0.1])], "key string, seq bigint, embedding array<float>")
    assert {(r["a"], r["b"]) for r in embedding.replayed_edges(df, k=1, threshold=0.5).collect()} == {("a", "b"), ("b", "c")}


def test_hash_embedding_is_unit(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, None), (3, "---")], "id bigint, text string")
    got = embedding.hash_embedding(df, "id", F.col("text")).collect()
    assert {r["id"] for r in got} == {1} and abs(sum(r["value"] ** 2 for r in got) - 1) < 1e-5


def test_registered_semantic_edges_ask_for_every_vector(spark, tmp_path):
    from cairnfield.plans import catalog

    rng = np.random.default_rng(4)
    m = rng.normal(size=(130, 8)).astype(np.float32)
    spark.createDataFrame([(i, m[i].tolist()) for i in range(130)], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    key = lambda i: f"{'note' if i % 2 == 0 else 'code'}:{i}"

    def brute(earlier):
        out = set()
        for i in range(130):
            others = sorted((j for j in range(i if earlier else 130) if j != i), key=lambda j: (-sims[i, j], key(j)))[:8]
            out |= {tuple(sorted((key(i), key(j)))) for j in others if sims[i, j] >= 0.3}
        return out

    got = {n: {(r["a"], r["b"]) for r in catalog.queries()[n](spark, str(tmp_path)).collect()} for n in ("semantic_edges", "semantic_edges_replay", "semantic_edges_scoped")}
    assert got["semantic_edges"] == brute(False) and got["semantic_edges_replay"] == brute(True)
    assert got["semantic_edges_scoped"] == {(a, b) for a, b in brute(False) if a.startswith("note:") and b.startswith("note:")}
