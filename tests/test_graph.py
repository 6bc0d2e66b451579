import random

from cairnfield.operators import graph
from tests.conftest import rows

NOTE = "id bigint, vault_id bigint, type string, name string, path string, frontmatter string, body string, deleted_at timestamp"
FILE = "id bigint, repository_id bigint, path string, language string, content string"


def corpus(spark):
    notes = spark.createDataFrame(
        [
            (1, 1, "projects", "apollo", "projects/apollo", '{"type": "projects"}', "[[people/wernher]] [[people/wernher|him]] [[repo:my-repo/src/auth.ts]] [[nowhere/x]] [[projects/apollo]]", None),
            (2, 1, "people", "wernher", "people/wernher", '{"type": "people", "tags": ["engineering", "engineering"], "timestamp": "1960-01-01"}', "", None),
            (3, 1, "people", "margaret", "people/margaret", '{"type": "people", "tags": ["engineering"]}', None, None),
            (4, 2, "notes", "grocery", "notes/grocery", '{"type": "notes", "tags": "none"}', "[[people/wernher]]", None),
            (3, 1, "people", "margaret", "people/margaret", '{"type": "people", "tags": ["engineering"]}', None, None),
        ],
        NOTE,
    )
    files = spark.createDataFrame([(1, 5, "src/auth.ts", "typescript", ""), (2, 5, "src/index.ts", "typescript", ""), (3, 5, "other.py", "python", ""), (4, 5, "x.bin", None, None)], FILE)
    repos = spark.createDataFrame([(5, "my-repo"), (6, "other")], "id bigint, name string")
    return notes, files, repos


def test_nodes_and_filters(spark):
    notes, files, _ = corpus(spark)
    nodes = graph.nodes(notes, files)
    assert nodes.count() == 8
    assert rows(nodes.filter(graph.node_filter(types=["people"])).select("key")) == [("note:2",), ("note:3",)]
    assert rows(nodes.filter(graph.node_filter(tags=["engineering"])).select("key")) == [("note:2",), ("note:3",)]
    assert rows(nodes.filter(graph.node_filter(since="1960-01-01")).select("key")) == [("note:2",)]
    assert graph.parse_list("a,,b") == ["a", "b"] and graph.parse_list(None) == []


def test_edges(spark):
    notes, files, repos = corpus(spark)
    nodes = graph.nodes(notes, files)
    assert rows(graph.link_edges(notes, nodes)) == [("note:1", "note:2", "extracted")]
    assert rows(graph.repository_link_edges(notes, nodes, repos)) == [("code:1", "note:1", "extracted")]
    assert rows(graph.repository_link_edges(notes, nodes.filter("kind = 'note'"), repos)) == []
    imports = spark.createDataFrame([(2, "./auth", 1), (2, "./auth", 1), (2, "react", None), (2, "./gone", 77), (1, "./self", 1)], "source_file_id bigint, target_path string, resolved_target_file_id bigint")
    assert rows(graph.import_edges(imports, nodes)) == [("code:1", "code:2", "extracted")]
    structural = {(a, b) for a, b, _ in rows(graph.structural_edges(graph.structural_groups(nodes)))}
    assert ("note:2", "note:3") in structural and ("code:1", "code:2") in structural and ("code:1", "code:3") not in structural


def test_groups_above_the_cap_are_reported_and_give_no_edges(spark):
    groups = spark.createDataFrame([("g", f"k{i}") for i in range(51)] + [("h", "k1"), ("h", "k1"), ("h", "k2")], "group_key string, key string")
    assert rows(graph.capped_groups(groups)) == [("g", 51)]
    assert rows(graph.structural_edges(groups)) == [("k1", "k2", "structural")]


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    pairs = [(f"n{rng.randrange(120):03}", f"n{rng.randrange(120):03}") for _ in range(70)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    keys = sorted({x for p in pairs for x in p} | {"alone"})
    edges = spark.createDataFrame([(*sorted(p), "extracted") for p in pairs], "a string, b string, kind string")
    got = dict(rows(graph.components(edges, spark.createDataFrame([(k,) for k in keys], "key string"))))
    assert got == {k: find(k) for k in keys}


def modularity(pairs, member):
    m = len(pairs)
    degree = {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    inside = sum(member[a] == member[b] for a, b in pairs) / m
    total = {}
    for n, d in degree.items():
        total[member[n]] = total.get(member[n], 0) + d
    return inside - sum((d / (2 * m)) ** 2 for d in total.values())


def test_louvain_finds_cliques_and_is_deterministic():
    cliques = [[f"{c}{i}" for i in range(6)] for c in "abc"]
    pairs = [(x, y) for c in cliques for i, x in enumerate(c) for y in c[i + 1 :]] + [("a0", "b0"), ("b1", "c1")]
    found = graph.louvain(pairs, ["lonely"])
    assert len({found[n] for n in cliques[0]}) == 1 and found["a0"] != found["b0"] != found["c1"]
    assert found == graph.louvain(list(reversed(pairs)), ["lonely"])
    rng = random.Random(0)
    assert modularity(pairs, found) > modularity(pairs, {n: rng.randrange(3) for n in found})
    assert graph.louvain([], ["x", "y"]) == {"x": 0, "y": 0}


def test_communities_and_propagation(spark):
    edges = spark.createDataFrame([("a", "b", "k"), ("b", "c", "k"), ("a", "c", "k"), ("x", "y", "k")], "a string, b string, kind string")
    nodes = spark.createDataFrame([(1, k) for k in "abcxyz"], "scope bigint, key string")
    got = {r["key"]: r["community"] for r in graph.communities(edges, nodes).collect()}
    assert got["a"] == got["b"] == got["c"] != got["x"] == got["y"] and len(got) == 6
    labels = dict(rows(graph.label_propagation(edges, nodes.select("key"))))
    assert labels["a"] == labels["b"] == labels["c"] == "a" and labels["z"] == "z"


def test_registered_graphs_hold_every_kind_of_edge(spark, tmp_path):
    from cairnfield.plans import catalog

    note = lambda i, vault, kind: (i, vault, kind, f"n{i}", f"{kind}/n{i}", "{}", "", None)
    # The type is above the cap in the whole graph, but not within vault 1.
    notes = [note(2, 1, "people"), note(4, 1, "people"), note(6, 1, "plans"), note(8, 1, "logs"), *(note(i, 9, "people") for i in range(100, 151))]
    frames = {
        "notes": (notes, NOTE),
        "repository_files": ([(1, 5, "x/a.go", "go", ""), (3, 5, "y/b.py", "python", ""), (5, 5, "y/c.rs", "rust", "")], FILE),
        "repositories": ([(5, "my-repo")], "id bigint, name string"),
        "repository_file_imports": ([], "source_file_id bigint, target_path string, resolved_target_file_id bigint"),
        "embeddings": ([(1, [1.0, 0.0, 0.0]), (3, [0.9, 0.1, 0.0]), (6, [0.0, 0.0, 1.0]), (8, [0.0, 0.1, 0.9]), (77, [0.0, 1.0, 0.0])], "vec_id bigint, embedding array<float>"),
    }
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: rows(catalog.queries()[name](spark, str(tmp_path)))
    assert run("edges_all") == [("semantic", 2), ("structural", 1)]
    assert run("communities") == [("code:5", 1, 3), ("note:1", 2, 4), ("note:9", 1, 51)]
    for name in ("components", "label_propagation"):
        got = dict(run(name))
        assert got["code:1"] == got["code:3"] == got["code:5"] and got["note:6"] == got["note:8"] and len({got[f"note:{i}"] for i in (2, 4, 6)}) == 3
