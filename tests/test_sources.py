import datetime
import hashlib
import hmac
import re

from pyspark.sql import functions as F

from cairnfield.operators import code, events, markdown
from cairnfield.operators.references import Bloom, build_filter, orphan_references, orphan_report
from cairnfield.sources import files
from cairnfield.streaming import rules
from tests.conftest import rows


def test_links_and_paths(spark):
    df = spark.createDataFrame([("[[people/jane|Jane]] [[ projects/apollo#goals ]] [[people/jane]] [[ ]] [[#x]]",), (None,), ("",)], "body string")
    assert [r[0] for r in df.select(markdown.wikilinks(F.col("body"))).collect()] == [["people/jane", "projects/apollo"], None, []]
    p = spark.createDataFrame([("a/b",), ("a",), ("A/b",), ("a/b/c",), (None,)], "p string")
    assert [r[0] for r in p.select(markdown.valid_path(F.col("p"))).collect()] == [True, False, False, False, False]


def test_rules_in_order(spark):
    data = [("people", "x", '{"type": "people"}', ""), ("People", "x", "{}", ""), ("people", "x", '{"type": "other"}', ""), ("people", "x", '{"type": "people", "tags": "a"}', ""), ("people", "x", '{"type": "people", "timestamp": "soon"}', ""), ("people", "x", '{"type": "people"}', None)]
    fields = ['"tags": [1, 2]', '"tags": ["a", null]', '"tags": null', '"tags": []', '"tags": ["a"], "x": [1, "b", null, true], "y": null, "z": 1.5', '"timestamp": 5', '"timestamp": "2024-01-02T03:04:05Z"', '"resource": 5', '"resource": "r"', '"x": {"y": 1}', '"x": [[1]]', '"x": [{}]', '"type": 5']
    data += [("people", "x", '{"type": "people", ' + f + "}", "") for f in fields] + [("people", "x", "not JSON", ""), ("people", "x", "[1]", ""), ("people", "x", None, "")]
    df = spark.createDataFrame(data, "t string, n string, f string, b string")
    got = [r[0] for r in df.select(markdown.problem_of(F.col("t"), F.col("n"), F.col("f"), F.col("b"))).collect()]
    assert got == [None, "type is not a slug", "frontmatter type differs", "tags are not a list of strings", "timestamp is not a date", "body is missing"] + ["tags are not a list of strings"] * 3 + [None, None, "timestamp is not a date", None, "resource is not a string", None] + ["a value is neither a scalar nor a list of scalars"] * 3 + ["frontmatter type differs"] * 4


def test_notes_and_archives_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([(1, "people/jane", '{"type": "people", "tags": ["a", "b"]}', "Hello\n---\nthere", None), (1, "bad/Name", '{"type": "bad"}', "x", None), (2, "notes/n", None, None, None), (1, "people/gone", "{}", "", datetime.datetime(2024, 1, 1))], "vault_id bigint, path string, frontmatter string, body string, deleted_at timestamp")
    manifest = spark.createDataFrame([(1, "{}"), (2, "{}")], "vault_id bigint, manifest string")
    back = {(r["vault_id"], r["path"]): r for r in files.import_archives(files.vault_archives(notes, manifest)).collect()}
    assert back[1, "people/jane"]["body"] == "Hello\n---\nthere" and back[1, "people/jane"]["problem"] is None
    assert back[1, "bad/Name"]["problem"] == "name is not a slug" and (1, "people/gone") not in back
    root = tmp_path / "vault" / "people"
    root.mkdir(parents=True)
    (root / "jane.md").write_text("---\ntype: people\n---\nHi")
    (root / "index.md").write_text("# people")
    (root / "raw.md").write_text("no fence")
    got = {r["path"]: (r["body"], r["error"]) for r in files.read_notes(spark, str(tmp_path / "vault")).collect()}
    assert got == {"people/jane": ("Hi", None), "people/raw": (None, "missing frontmatter")}
    (tmp_path / "tree" / "node_modules").mkdir(parents=True)
    (tmp_path / "tree" / "a.TS").write_text("é")
    (tmp_path / "tree" / "node_modules" / "b.js").write_text("")
    assert rows(files.read_tree(spark, str(tmp_path / "tree"))) == [("a.TS", "typescript", "é", 2)]


def test_signatures_and_entries(spark):
    good = "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()
    df = spark.createDataFrame([("{}", good), ("{}", "sha256=0"), (None, good), ("{}", None)], "body string, signature string")
    assert [r[0] for r in df.select(files.signature_valid("k")).collect()] == [True, False, False, False]
    e = spark.createDataFrame([("vaults/0a-1/people/x.md",), ("manifest.json",), (None,)], "n string")
    assert [tuple(r) for r in e.select(*files.archive_entries(F.col("n"))).collect()] == [("0a-1", "people/x"), (None, None), (None, None)]


def test_code_extraction(spark):
    ts = 'import { a } from "./a"\nimport "side"\nexport { z } from "./no"\n// function hidden() {}\nexport async function one<T>(x: T): Promise<{ y: number }> {\n  return `${x}`\n}\nabstract class Two {\n  m() {}\n}\ninterface Three { a: string }\ntype Four = { b: string }\nfunction sig(a: string): void;\n'
    assert list(code.imports(ts, "typescript")) == ["./a", "side"]
    assert set(code.symbols(ts, "typescript")) == {("one", "function", 5, 7), ("Two", "class", 8, 10), ("Three", "interface", 11, 11), ("Four", "type", 12, 12)}
    py = "import os, re\nimport x as y\nfrom .u import v\n\n@deco\nclass A:\n    def m(self):\n        '''def no(): pass'''\n        return 1\n\n# end\nasync def f(a,\n            b):\n    pass\n"
    assert list(code.imports(py, "python")) == ["os", "re", ".u"]
    assert set(code.symbols(py, "python")) == {("A", "class", 6, 9), ("m", "function", 7, 9), ("f", "function", 12, 14)}
    go = 'package p\nimport (\n\t"fmt"\n\tm "a/b"\n)\ntype T struct {\n\tA int\n}\nfunc F(a int) error {\n\treturn nil\n}\n'
    assert list(code.imports(go, "go")) == ["fmt", "a/b"]
    assert ("F", "function", 9, 11) in set(code.symbols(go, "go")) and ("T", "type", 6, 8) in set(code.symbols(go, "go"))
    df = spark.createDataFrame([(1, "rust", "fn a() {}"), (2, None, "x"), (3, "python", None), (4, "python", "def f(): pass"), (4, "python", "def f(): pass")], "id bigint, language string, content string")
    assert rows(code.code_symbols(df)) == [(4, "f", "function", 1, 1)]


def test_filter_never_denies_a_member(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    bloom = build_filter(keys)
    members = keys.toPandas()["key"].to_numpy()
    others = spark.range(5000, 25000).select(F.xxhash64("id").alias("key")).toPandas()["key"].to_numpy()
    assert bloom.may_hold(members).all() and bloom.may_hold(others).mean() < 0.05
    small = build_filter(keys, bits=64)
    assert isinstance(small, Bloom) and small.may_hold(members).all()
    assert not build_filter(keys.limit(0)).may_hold(members).any()


def test_orphans(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    notes = spark.createDataFrame([(1, 1, "a/x", None, t(1), t(10)), (2, 1, "a/y", None, t(20), t(21)), (3, 1, "a/z", t(5), t(1), t(6)), (4, 2, "a/x", None, t(1), t(2)), (1, 1, "a/x", None, t(1), t(10))], "id bigint, vault_id bigint, path string, deleted_at timestamp, created_at timestamp, updated_at timestamp")
    links = spark.createDataFrame([(1, "a/x"), (1, "a/y"), (1, "a/z"), (1, "gone"), (1, "gone"), (4, "a/y"), (1, "repo:r/f.ts"), (1, "repo:r/no"), (1, "repo:none/f.ts"), (9, "a/x"), (1, None), (3, "gone")], "source_note_id bigint, target_path string")
    repos = spark.createDataFrame([(7, "r")], "id bigint, name string")
    files_ = spark.createDataFrame([(1, 7, "f.ts", t(1), t(3)), (2, 7, "lib/index.js", t(9), t(9)), (3, 7, "lib/g.ts", t(1), t(2))], "id bigint, repository_id bigint, path string, created_at timestamp, updated_at timestamp")
    imports = spark.createDataFrame([(1, "x", 3), (1, "y", 99), (1, "./lib", None), (2, "./g", None), (2, "./none", None), (1, "react", None), (1, "z", 2), (3, "..", None)], "source_file_id bigint, target_path string, resolved_target_file_id bigint")
    got = {(a.split("_")[-1], b, c): r for a, b, c, _, r in rows(orphan_references(notes, links, repos, files_, imports))}
    assert got == {
        ("links", 1, "a/y"): "later", ("links", 1, "a/z"): "missing", ("links", 1, "gone"): "missing", ("links", 4, "a/y"): "missing", ("links", 1, "repo:r/no"): "missing", ("links", 1, "repo:none/f.ts"): "missing",
        ("links", 9, "a/x"): "missing", ("links", 3, "gone"): "missing", ("imports", 1, "y"): "missing", ("imports", 1, "./lib"): "later", ("imports", 2, "./none"): "missing", ("imports", 1, "z"): "later", ("imports", 3, ".."): "missing",
    }
    empty = orphan_references(notes.limit(0), links.limit(0), repos.limit(0), files_.limit(0), imports.limit(0))
    assert rows(orphan_report(empty)) == []


def test_stream_twin_equals_batch(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    data = [(i, i % 3, base + datetime.timedelta(seconds=7 * i)) for i in range(60)]
    df = spark.createDataFrame(data, "event_id bigint, user_id bigint, ts timestamp")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = rules.rate_limit(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), limit=3, window_ms=120_000, delay="1 day")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(events.rate_limit(df, limit=3, window_ms=120_000))


def test_go_types_at_any_depth():
    go = 'package p\n\nimport (\n\t"fmt"\n\tx `raw`\n)\n\ntype (\n\tA struct {\n\t\tB int\n\t}\n\tC[T any] map[string]T\n\tD = int\n)\n\ntype E = int\n\ntype F func(a int) error\n\nfunc G(x any) {\n\ttype H struct {\n\t\ta int\n\t}\n\tswitch x.(type) {\n\t}\n\tif true { type I int }\n}\n\nfunc (s *A) M() {}\n'
    assert sorted(code.symbols(go, "go")) == [("A", "type", 8, 14), ("C", "type", 8, 14), ("F", "type", 18, 18), ("G", "function", 20, 27), ("H", "type", 21, 23), ("I", "type", 26, 26)]
    assert list(code.imports(go, "go")) == ["fmt"]


def test_symbols_of_the_tables(spark, folder):
    files_, stored = spark.read.parquet(f"{folder}/repository_files.parquet"), spark.read.parquet(f"{folder}/repository_file_symbols.parquet").distinct()
    texts = {r["id"]: (r["content"] or "").split("\n") for r in files_.select("id", "content", "language").filter("language is not null").collect()}
    # A stored symbol is up to date if its first line declares its name.
    declares = lambda r: re.search(rf"\b(?:def|class|func|function|type|interface)\b.*\b{re.escape(r['name'])}\b", (texts.get(r["file_id"]) or [""])[r["start_line"] - 1 : r["start_line"]][0] if r["start_line"] <= len(texts.get(r["file_id"], ())) else "")
    want = {(r["file_id"], r["name"], r["kind"], r["start_line"]) for r in stored.collect() if declares(r)}
    got = {(r["file_id"], r["name"], r["kind"], r["start_line"]) for r in code.code_symbols(files_).collect()}
    assert len(want) > 50 and len(want & got) >= 0.97 * len(want)
