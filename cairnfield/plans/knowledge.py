"""Queries on search, embeddings, the graph and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.lineage import shared_folder
from cairnfield.functions.paths import LANGUAGE_OF, language_of
from cairnfield.operators import access, code, embedding, graph, ingest, search
from cairnfield.operators.markdown import parse_note, note_links, problem_of, serialize_note, type_index, wikilinks
from cairnfield.plans.tables import Tables, sql

QUERY, PHRASE_QUERY = "note index", '"revision list" or vault -digest'
#: The vectors here are far apart: this similarity gives edges.
THRESHOLD = 0.3


def items(t: Tables) -> DataFrame:
    """Live notes and files, with the vectors that exist for them (even numbers are notes')."""
    vectors = t("embeddings").select(_kind_of_vector().alias("kind"), F.col("vec_id").alias("id"), "embedding")
    none = F.lit(None).cast("string")
    notes = t("note_rows").filter("deleted_at is null").select(F.lit("note").alias("kind"), "id", F.concat(F.lit("vault-"), "vault_id").alias("scope_id"), F.col("path").alias("title"), F.col("body").alias("text"), "frontmatter", none.alias("language"))
    files = t("file_rows").select(F.lit("code").alias("kind"), "id", F.concat(F.lit("repository-"), "repository_id").alias("scope_id"), F.col("path").alias("title"), F.col("content").alias("text"), none.alias("frontmatter"), "language")
    return notes.unionByName(files).join(vectors, ["kind", "id"], "left")


def _kind_of_vector() -> F.Column:
    return F.when(F.col("vec_id") % 2 == 0, "note").otherwise("code")


def _probe(t: Tables) -> list[float]:
    """The stored vector that stands for the query's."""
    first = t("embeddings").orderBy("vec_id").select("embedding").first()
    return first[0] if first else []


def _scope(t: Tables) -> DataFrame:
    """What user 20 may see."""
    vaults = access.accessible_vaults(t("users"), t("vaults"), t("shares"), t("memberships")).filter("user_id = 20").select(F.lit("note").alias("kind"), F.concat(F.lit("vault-"), "vault_id").alias("scope_id"))
    repos = access.accessible_repositories(t("users"), t("repositories"), t("repository_shares"), t("memberships")).filter("user_id = 20").select(F.lit("code").alias("kind"), F.concat(F.lit("repository-"), "repository_id").alias("scope_id"))
    return vaults.unionByName(repos)


#: Indexes that this session has written, by session and folder of tables.
_WRITTEN: dict[tuple[str, str], search.Index] = {}


def _index(t: Tables) -> search.Index:
    """The stored index over a folder's items; written by the first query of a session that needs it."""
    import uuid

    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _WRITTEN:
        folder = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
        search.write_index(items(t), folder, buckets=16, salts=2)
        _WRITTEN[key] = search.open_index(t.spark, folder)
    return _WRITTEN[key]


def _written(t: Tables) -> DataFrame:
    """Rebuild the index; how much it holds."""
    _WRITTEN.pop((t.spark.sparkContext.applicationId, t.folder), None)
    index = _index(t)
    count = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), "rows")
    return count(index.postings, "postings").unionByName(count(index.vectors, "vectors")).unionByName(count(index.items, "items"))


def _hybrid(t: Tables, scope: DataFrame | None = None) -> DataFrame:
    return search.indexed_search(_index(t), QUERY, _probe(t), scope=scope).select("kind", "id", "score", "title", "frontmatter", "language")


def _nodes(t: Tables) -> DataFrame:
    return graph.nodes(t("notes"), t("repository_files"))


def _note_rows(t: Tables) -> DataFrame:
    return t("note_rows").filter("deleted_at is null").select("id", "vault_id", "body")


def _vectors(t: Tables) -> DataFrame:
    return t("embeddings").select(F.concat(F.when(F.col("vec_id") % 2 == 0, "note:").otherwise("code:"), "vec_id").alias("key"), F.col("vec_id").alias("seq"), "embedding")


def _asked(t: Tables) -> DataFrame:
    """The stated queries of a neighbour search: every vector whose id is divisible by 100, against all."""
    return _vectors(t).filter("seq % 100 = 0").select("key")


def _knn(t: Tables) -> DataFrame:
    return embedding.knn(_vectors(t), queries=_asked(t))


def _semantic(t: Tables) -> DataFrame:
    """The similarity graph: either end may select an edge, so every vector asks."""
    return embedding.semantic_edges(embedding.knn(_vectors(t)), THRESHOLD)


def _extracted(t: Tables) -> DataFrame:
    n = _nodes(t)
    return graph.all_edges(graph.link_edges(_note_rows(t), n), graph.repository_link_edges(_note_rows(t), n, t("repositories")), graph.import_edges(t("repository_file_imports"), n))


def _groups(t: Tables) -> DataFrame:
    return graph.structural_groups(_nodes(t))


def _scoped_semantic(t: Tables) -> DataFrame:
    return graph.scoped_semantic_edges(_semantic(t), _nodes(t))


def _every_edge(t: Tables) -> DataFrame:
    """Edges of all three kinds."""
    return graph.all_edges(_extracted(t), graph.structural_edges(_groups(t)), _scoped_semantic(t))


def _merged(t: Tables) -> DataFrame:
    scope = access.merged_scope(t("preferences"), t("vaults"), access.accessible_vaults(t("users"), t("vaults"), t("shares"), t("memberships")))
    mine = scope.select(F.col("vault_id").alias("resource_id")).distinct()
    n = graph.note_nodes(t("notes")).join(mine, "resource_id", "left_semi")
    return graph.link_edges(_note_rows(t), n)


def _communities(t: Tables) -> DataFrame:
    scoped = _nodes(t).select(F.concat("kind", F.lit(":"), "resource_id").alias("scope"), "key")
    # A scope is a view of its own, so a group's size is that within the scope.
    groups = _groups(t).join(scoped, "key").select(F.concat("scope", F.lit("|"), "group_key").alias("group_key"), "key")
    return graph.communities(graph.all_edges(_extracted(t), graph.structural_edges(groups), _scoped_semantic(t)), scoped)


def _modularity_ready(t: Tables) -> DataFrame:
    return _communities(t).groupBy("scope").agg(F.count_distinct("community").alias("communities"), F.count("*").alias("nodes"))


def _reparsed(t: Tables) -> DataFrame:
    """Notes from their raw texts, most of them sound, some without a fence or with frontmatter that is none."""
    case = F.col("id") % 10
    good = serialize_note(F.col("frontmatter"), F.col("body"))
    raw = F.when(case == 0, F.col("body")).when(case == 1, F.concat(F.lit("---\n- a\n---\n"), F.col("body"))).when(case == 2, F.concat(F.lit("---\na: [\n---\n"), F.col("body"))).when(case == 3, F.lit(None)).otherwise(good)
    raw = t("note_rows").select("id", raw.alias("raw"))
    return raw.select("id", parse_note(F.col("raw")).alias("n")).select("id", F.get_json_object("n.frontmatter", "$.type").alias("type"), F.octet_length("n.body").alias("size"), "n.error")


def _embed_texts(t: Tables) -> DataFrame:
    notes = t("note_rows").filter("deleted_at is null").select(F.concat(F.lit("note:"), "id").alias("key"), F.sha2(embedding.embed_text(F.col("path"), F.col("frontmatter"), F.col("body")), 256).alias("hash"))
    files = t("file_rows").select(F.concat(F.lit("code:"), "id").alias("key"), F.sha2(F.concat_ws("\n", "path", F.coalesce("content", F.lit(""))), 256).alias("hash"))
    return notes.unionByName(files)


def _embed_errors(t: Tables) -> DataFrame:
    bad = F.when(F.col("text").isNull(), "no text").when(F.size(embedding.hash_dims(F.col("text"))) == 0, "no tokens")
    return t("documents").select("doc_id", bad.alias("error")).filter("error is not null")


def _reindex(t: Tables) -> DataFrame:
    """Links and embeddings of all live notes and files, built anew, stored and read back: rows and their checksum."""
    import uuid

    folder = f"{shared_folder(t.spark)}/reindex-{uuid.uuid4().hex}"
    note_links(_note_rows(t)).write.parquet(f"{folder}/links")
    notes = t("note_rows").filter("deleted_at is null").select(F.concat(F.lit("note:"), "id").alias("key"), embedding.embed_text(F.col("path"), F.col("frontmatter"), F.col("body")).alias("text"))
    files = t("file_rows").select(F.concat(F.lit("code:"), "id").alias("key"), F.concat_ws("\n", "path", F.coalesce("content", F.lit(""))).alias("text"))
    embedding.hash_embedding(notes.unionByName(files), "key", F.col("text")).write.parquet(f"{folder}/embeddings")
    links, vectors = t.spark.read.parquet(f"{folder}/links"), t.spark.read.parquet(f"{folder}/embeddings")
    of = lambda df, part, key: df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("items")).select(F.lit(part).alias("part"), "rows", "items")
    return of(links, "links", "source_note_id").unionByName(of(vectors, "embeddings", "key"))


def queries() -> dict:
    def q(f):
        return lambda s, d: f(Tables(s, d))

    tok = search.tokens
    return {
        "hybrid_search": q(_hybrid),
        "search_everywhere": q(lambda t: _hybrid(t, _scope(t))),
        "search_index": q(_written),
        "search_by_scan": q(lambda t: search.hybrid_search(items(t), QUERY, _probe(t)).select("kind", "id", "score")),
        "fts_match_indexed": q(lambda t: search.index_hits(_index(t), PHRASE_QUERY).select("kind", "id")),
        "keyword_top30": q(lambda t: search.keyword_branch(items(t), QUERY).select("kind", "id", "score")),
        "semantic_top30": q(lambda t: search.vector_branch(items(t), _probe(t)).select("kind", "id", "score")),
        "fts_tokens": q(lambda t: items(t).select("kind", "id", F.explode(tok(F.concat_ws(" ", "title", "frontmatter", "text"))).alias("token")).groupBy("kind", "id", "token").agg(F.count("*").alias("tf"))),
        "fts_match": q(lambda t: items(t).select("kind", "id", tok(F.concat_ws(" ", "title", "frontmatter", "text")).alias("t")).filter(search.matches(PHRASE_QUERY, F.col("t"))).select("kind", "id")),
        "postings": q(lambda t: search.postings(items(t)).groupBy("token").agg(F.count("*").alias("items"), F.sum("tf").alias("tf"))),
        "headline": q(lambda t: search.keyword_branch(items(t), QUERY).select("kind", "id", "snippet")),
        "snippets": q(lambda t: t("documents").select("doc_id", F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("snippet"), F.octet_length(F.coalesce("text", F.lit(""))).alias("size"))),
        "scope_filter": q(lambda t: items(t).join(_scope(t), ["kind", "scope_id"], "left_semi").groupBy("kind", "scope_id").agg(F.count("*").alias("items"))),
        "hash_embed": q(lambda t: embedding.hash_embedding(t("documents"), "doc_id", F.col("text"))),
        "embed_text": q(_embed_texts),
        "embed_errors": q(_embed_errors),
        "l2_norm": q(lambda t: t("embeddings").select("vec_id", F.round(embedding.l2_norm(F.col("embedding")), 6).alias("norm"))),
        "cosine_pairs": q(lambda t: t("embeddings").select("vec_id", "label", "embedding").join(t("embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), "label", F.col("embedding").alias("other")), "label").select("vec_id", "probe", F.round(search.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))),
        "knn_topk": q(lambda t: _knn(t).select("key", "neighbour", "similarity", "rank")),
        "semantic_edges": q(_semantic),
        "semantic_edges_replay": q(lambda t: embedding.replayed_edges(_vectors(t), threshold=THRESHOLD)),
        "semantic_edges_scoped": q(lambda t: graph.scoped_semantic_edges(_semantic(t), _vectors(t).filter("key like 'note:%'").select("key"))),
        "missing_embeddings": q(lambda t: t("note_rows").filter("deleted_at is null").select("id").join(t("embeddings").select(F.col("vec_id").alias("id")), "id", "left_anti")),
        "nodes_union": q(lambda t: _nodes(t).select("key", "kind", "resource_id", "path", "type", "tags", "timestamp")),
        "graph_filters": q(lambda t: _nodes(t).filter(graph.node_filter(types=["notes", "people", "decisions"], tags=["token", "graph"], since="2023-01-01", until="2024-06-30")).select("key", "path")),
        "wikilinks": q(lambda t: t("note_rows").select(F.col("id").alias("source_note_id"), F.explode(wikilinks(F.col("body"))).alias("target_path"))),
        "wikilink_edges": q(lambda t: graph.link_edges(_note_rows(t), _nodes(t)).select("a", "b")),
        "repo_link_edges": q(lambda t: graph.repository_link_edges(_note_rows(t), _nodes(t), t("repositories")).select("a", "b")),
        "import_edges": q(lambda t: graph.import_edges(t("repository_file_imports"), _nodes(t)).select("a", "b")),
        "structural_groups": q(lambda t: _groups(t).groupBy("group_key").agg(F.count("*").alias("size"))),
        "capped_groups": q(lambda t: graph.capped_groups(_groups(t))),
        "structural_edges": q(lambda t: graph.structural_edges(_groups(t)).select("a", "b")),
        "edges_all": q(lambda t: _every_edge(t).groupBy("kind").agg(F.count("*").alias("edges"))),
        "edge_endpoints": q(lambda t: _extracted(t).join(_nodes(t).select(F.col("key").alias("a"), F.col("path").alias("a_path")), "a").join(_nodes(t).select(F.col("key").alias("b"), F.col("path").alias("b_path")), "b").select("a", "b", "a_path", "b_path")),
        "edges_touching": q(lambda t: graph.touching(_extracted(t), graph.note_nodes(t("notes")).filter("type = 'people'").select("key"))),
        "merged_graph": q(lambda t: _merged(t).select("a", "b")),
        "backlinks": q(lambda t: graph.backlinks(t("note_links"))),
        "components": q(lambda t: graph.components(_every_edge(t), _nodes(t))),
        "communities": q(_modularity_ready),
        "label_propagation": q(lambda t: graph.label_propagation(_every_edge(t), _nodes(t))),
        "type_index": q(lambda t: type_index(t("notes"))),
        "validate_notes": q(lambda t: t("note_rows").select("id", problem_of(F.col("type"), F.col("name"), F.col("frontmatter"), F.col("body")).alias("problem"))),
        "parse_notes": q(_reparsed),
        "serialize_notes": q(lambda t: t("note_rows").select("id", serialize_note(F.col("frontmatter"), F.col("body")).alias("raw"))),
        "detect_language": q(lambda t: t("file_rows").select("id", language_of(F.col("path")).alias("detected"))),
        "import_resolution": q(lambda t: ingest.resolve_imports(t("repository_file_imports"), t("file_rows"))),
        "file_outline": q(lambda t: code.file_outline(t("repository_file_symbols"), t("file_rows").filter("language = 'go'").select(F.col("id").alias("file_id")))),
        "code_symbols": q(lambda t: code.code_symbols(t("repository_files"))),
        "code_imports": q(lambda t: code.code_imports(t("repository_files"))),
        "reindex": q(_reindex),
    }


PROBLEM = """case when not coalesce(regexp_matches(type, '^[a-z0-9][a-z0-9-]*$'), false) then 'type is not a slug' when not coalesce(regexp_matches(name, '^[a-z0-9][a-z0-9-]*$'), false) then 'name is not a slug'
        when json_extract_string(frontmatter, '$.type') is distinct from type then 'frontmatter type differs' when json_exists(frontmatter, '$.tags') and (json_type(frontmatter, '$.tags') <> 'ARRAY' or len(list_filter(json_extract(frontmatter, '$.tags[*]'), lambda x: json_type(x) <> 'VARCHAR')) > 0) then 'tags are not a list of strings'
        when json_exists(frontmatter, '$.timestamp') and (json_type(frontmatter, '$.timestamp') <> 'VARCHAR' or try_cast(json_extract_string(frontmatter, '$.timestamp') as timestamptz) is null) then 'timestamp is not a date'
        when json_exists(frontmatter, '$.resource') and json_type(frontmatter, '$.resource') <> 'VARCHAR' then 'resource is not a string'
        when len(list_filter(json_extract(frontmatter, '$.*'), lambda x: json_type(x) = 'OBJECT' or json_type(x) = 'ARRAY' and len(list_filter(json_extract(x, '$[*]'), lambda y: json_type(y) in ('OBJECT', 'ARRAY'))) > 0)) > 0 then 'a value is neither a scalar nor a list of scalars' when body is null then 'body is missing' end"""
_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_ITEM = f"""item as (select 'note' as kind, id, 'vault-' || vault_id as scope_id, path as title, body as text, frontmatter, null as language from note_rows where deleted_at is null
    union all select 'code', id, 'repository-' || repository_id, path, content, null, language from file_rows),
  tok as (select kind, id, scope_id, list_filter(regexp_extract_all(lower(concat_ws(' ', title, frontmatter, text)), '[a-z0-9]+'), lambda w: w not in ({_STOP})) as t from item),
  kw as (select kind, id, scope_id, cast(len(list_filter(t, lambda w: w in ('index', 'note'))) as double) as score from tok where list_contains(t, 'note') and list_contains(t, 'index')),
  probe as (select embedding as p from embeddings order by vec_id limit 1),
  vec as (select kind, id, scope_id, round(list_cosine_similarity(e.embedding::double[], (select p from probe)::double[]), 6) as score from item join embeddings e on e.vec_id = item.id and item.kind = case when e.vec_id % 2 = 0 then 'note' else 'code' end)"""
_FUSE = """branch as (
    select kind, id, 0 as b, row_number() over (order by score desc, id) - 1 as r from vec_in where kind = 'note' qualify r < 30
    union all select kind, id, 1, row_number() over (order by score desc, id) - 1 as r from vec_in where kind = 'code' qualify r < 30
    union all select kind, id, 2, row_number() over (order by score desc, id) - 1 as r from kw_in where kind = 'note' qualify r < 30
    union all select kind, id, 3, row_number() over (order by score desc, id) - 1 as r from kw_in where kind = 'code' qualify r < 30),
  fused as (select kind, id, round(sum(1.0 / (61 + r)), 9) as score, min(b * 100 + r) as first from branch group by all order by score desc, first limit 20)"""
_CARRY = "select f.kind, f.id, f.score, title, frontmatter, language from fused f join item using (kind, id)"
# Words side by side bind tighter than "or".
_MATCH = "select kind, id from tok where contains(' ' || array_to_string(t, ' ') || ' ', ' revision list ') or list_contains(t, 'vault') and not list_contains(t, 'digest')"
_NODE = """node as (
    select 'note:' || id as key, 'note' as kind, vault_id as resource_id, path, type, case when json_type(frontmatter, '$.tags') = 'ARRAY' then from_json(json_extract(frontmatter, '$.tags'), '["VARCHAR"]') else [] end as tags,
        json_extract_string(frontmatter, '$.timestamp') as timestamp from note_rows where deleted_at is null
    union all select 'code:' || id, 'code', repository_id, path, language, [], null from file_rows),
  link as (select distinct 'note:' || id as x, vault_id, target from (select id, vault_id, unnest(list_transform(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1), lambda s: trim(s))) as target from note_rows where deleted_at is null) where target <> ''),
  wiki as (select distinct least(x, key) as a, greatest(x, key) as b from link join node on node.kind = 'note' and node.resource_id = vault_id and node.path = target where x <> key),
  rlink as (select distinct least(x, key) as a, greatest(x, key) as b from link join (select name, max(id) as rid from repositories group by name) r on regexp_matches(target, '^repo:[^/]*/') and r.name = regexp_extract(target, '^repo:([^/]*)/', 1)
    join node on node.kind = 'code' and resource_id = rid and path = regexp_replace(target, '^repo:[^/]*/', '')),
  imp as (select distinct least('code:' || source_file_id, 'code:' || resolved_target_file_id) as a, greatest('code:' || source_file_id, 'code:' || resolved_target_file_id) as b from repository_file_imports
    where resolved_target_file_id is not null and source_file_id <> resolved_target_file_id and source_file_id in (select id from file_rows) and resolved_target_file_id in (select id from file_rows)),
  extracted as (select a, b, 'extracted' as kind from wiki union select a, b, 'extracted' from rlink union select a, b, 'extracted' from imp),
  grp as (
    select 'type:' || type as group_key, key from node where kind = 'note' union all select 'tag:' || unnest(tags), key from node where kind = 'note'
    union all select 'language:' || type, key from node where kind = 'code' and type is not null
    union all select 'dir:' || resource_id || ':' || case when contains(path, '/') then split_part(path, '/', 1) else '.' end, key from node where kind = 'code'),
  structural as (select distinct x.key as a, y.key as b from grp x join grp y on x.group_key = y.group_key and x.key < y.key where x.group_key in (select group_key from grp group by all having count(*) <= 50))"""
_VEC = """v as (select case when vec_id % 2 = 0 then 'note:' else 'code:' end || vec_id as key, vec_id, embedding::double[] as e from embeddings),
  near as (select q.key, v.key as neighbour, round(list_cosine_similarity(q.e, v.e), 6) as similarity, row_number() over (partition by q.key order by round(list_cosine_similarity(q.e, v.e), 6) desc, v.key) as rank from v q join v on q.key <> v.key qualify rank <= 8)"""
# The semantic edges between nodes that are there, and the edges of all three kinds.
_SEMANTIC = f"""{_VEC}, semantic as (select least(key, neighbour) as a, greatest(key, neighbour) as b from near where similarity >= {THRESHOLD} and key in (select key from node) and neighbour in (select key from node)),
  every as (select a, b, kind from extracted union select a, b, 'structural' from structural union select a, b, 'semantic' from semantic)"""
_EDGE = "select least(key, neighbour) as a, greatest(key, neighbour) as b, max(similarity) as similarity from near where similarity >= 0.3 group by all"


def oracle_sql() -> dict[str, str]:
    from cairnfield.plans.people import GRANT, REPOSITORY

    rows = ("note_rows", "file_rows")
    item = lambda text: sql("", *rows).rstrip() + f", {_ITEM} {text}"
    node = lambda text: sql("", *rows).rstrip() + f", {_NODE} {text}"
    scope = sql("", *rows, "users", "memberships", "shares", "repository_shares").rstrip() + f""", {_ITEM}, {GRANT}, {REPOSITORY},
        scope as (select 'note' as kind, 'vault-' || vault_id as scope_id from access where user_id = 20 union select 'code', 'repository-' || repository_id from repo_access where user_id = 20) """
    language = "case lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) " + " ".join(f"when '{a}' then '{b}'" for a, b in LANGUAGE_OF.items()) + " end"
    from cairnfield.plans.integrity import _NORMAL

    return {
        "hybrid_search": item(f", vec_in as (select * from vec), kw_in as (select * from kw), {_FUSE} {_CARRY}").replace(" , vec_in", ", vec_in"),
        "search_by_scan": item(f", vec_in as (select * from vec), kw_in as (select * from kw), {_FUSE} select kind, id, score from fused").replace(" , vec_in", ", vec_in"),
        "search_index": item("select 'postings' as part, count(*) as rows from (select distinct kind, id, unnest(t) from tok) union all select 'vectors', count(*) from vec union all select 'items', count(*) from item"),
        "search_everywhere": scope.rstrip() + f", vec_in as (select * from vec where (kind, scope_id) in (select (kind, scope_id) from scope)), kw_in as (select * from kw where (kind, scope_id) in (select (kind, scope_id) from scope)), {_FUSE} {_CARRY}",
        "keyword_top30": item("select kind, id, score from kw order by score desc, kind, id limit 30"),
        "semantic_top30": item("select kind, id, score from vec order by score desc, kind, id limit 30"),
        "fts_tokens": item("select kind, id, token, count(*) as tf from (select kind, id, unnest(t) as token from tok) group by all"),
        "fts_match": item(_MATCH),
        "fts_match_indexed": item(_MATCH),
        "postings": item("select token, count(*) as items, cast(sum(tf) as bigint) as tf from (select kind, id, token, count(*) as tf from (select kind, id, unnest(t) as token from tok) group by all) group by token"),
        "snippets": "select doc_id, left(coalesce(text, ''), 200) as snippet, cast(strlen(coalesce(text, '')) as int) as size from documents",
        "scope_filter": scope + "select kind, scope_id, count(*) as items from item where (kind, scope_id) in (select (kind, scope_id) from scope) group by all",
        "hash_embed": """with word as (select doc_id, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) as h from documents where text is not null),
            s as (select doc_id, cast(('0x' || h[1:4])::int % 384 as int) as dim, sum(case when ('0x' || h[5:6])::int % 2 = 0 then 1.0 else -1.0 end) as v from word group by all)
            select doc_id, dim, round(v / sqrt(sum(v * v) over (partition by doc_id)), 6) as value from s qualify v <> 0""",
        "embed_text": sql("""select 'note:' || id as key, sha256(concat_ws(chr(10), path, coalesce(frontmatter, '{}'), coalesce(body, ''))) as hash from note_rows where deleted_at is null
            union all select 'code:' || id, sha256(path || chr(10) || coalesce(content, '')) from file_rows""", *rows),
        "embed_errors": "select doc_id, case when text is null then 'no text' else 'no tokens' end as error from documents where text is null or not regexp_matches(lower(text), '[a-z0-9]')",
        "l2_norm": "select vec_id, round(sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) as norm from embeddings",
        "cosine_pairs": "select a.vec_id, b.vec_id as probe, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.label = b.label where b.vec_id % 100 = 0",
        "knn_topk": f"with {_VEC} select key, neighbour, similarity, rank from near where key in (select key from v where vec_id % 100 = 0)",
        "semantic_edges": f"with {_VEC} {_EDGE}",
        "semantic_edges_replay": f"with {_VEC.replace('on q.key <> v.key', 'on v.vec_id < q.vec_id')} {_EDGE}",
        "semantic_edges_scoped": f"with {_VEC} select a, b, 'semantic' as kind from ({_EDGE}) where a like 'note:%' and b like 'note:%'",
        "missing_embeddings": sql("select id from note_rows where deleted_at is null and id not in (select vec_id from embeddings)", "note_rows"),
        "nodes_union": node("select key, kind, resource_id, path, type, tags, timestamp from node"),
        "graph_filters": node("select key, path from node where type in ('notes', 'people', 'decisions') and list_has_any(tags, ['token', 'graph']) and timestamp >= '2023-01-01' and timestamp <= '2024-06-30'"),
        "wikilinks": sql(r"select distinct id as source_note_id, target as target_path from (select id, trim(unnest(regexp_extract_all(body, '\[\[([^\]|#]+)(?:[|#][^\]]*)?\]\]', 1))) as target from note_rows) where target <> ''", "note_rows"),
        "wikilink_edges": node("select a, b from wiki"),
        "repo_link_edges": node("select a, b from rlink"),
        "import_edges": node("select a, b from imp"),
        "structural_groups": node("select group_key, count(*) as size from grp group by group_key"),
        "capped_groups": node("select group_key, count(*) as size from grp group by group_key having count(*) > 50"),
        "structural_edges": node("select a, b from structural"),
        "edges_all": node(f", {_SEMANTIC} select kind, count(*) as edges from every group by kind").replace(" , v as", ", v as"),
        "edge_endpoints": node("select e.a, e.b, x.path as a_path, y.path as b_path from extracted e join node x on x.key = e.a join node y on y.key = e.b"),
        "edges_touching": node("select a, b, kind from extracted where a in (select key from node where type = 'people' and node.kind = 'note') or b in (select key from node where type = 'people' and node.kind = 'note')"),
        "merged_graph": sql("", *rows, "users", "memberships", "shares", "preferences").rstrip() + f", {_NODE}, {GRANT}, mine as (select distinct p.vault_id from preferences p join vaults v on v.id = p.vault_id and v.mergeable join access a using (user_id, vault_id) where p.include)"
        " select w.a, w.b from wiki w join node x on x.key = w.a join node y on y.key = w.b where x.resource_id in (select vault_id from mine) and y.resource_id in (select vault_id from mine)",
        "backlinks": "select target_path, count(distinct source_note_id) as backlinks from note_links group by target_path",
        "components": (sql("", *rows).replace("with ", "with recursive ", 1).rstrip() + f""", {_NODE}, {_SEMANTIC}, two_way as (select a as u, b as v from every union select b, a from every),
            walk as (select key, key as reached from node union select w.key, t.v from walk w join two_way t on t.u = w.reached) select key, min(reached) as component from walk group by key"""),
        "type_index": sql(r"select vault_id, type, '# ' || type || chr(10) || string_agg('- [[' || path || ']]', chr(10) order by name, path) as content from (select distinct vault_id, type, name, path from live_notes) group by vault_id, type", "live_notes"),
        "validate_notes": sql(f"select id, {PROBLEM} as problem from note_rows", "note_rows"),
        "parse_notes": sql("""select id, case when error is null then json_extract_string(frontmatter, '$.type') end as type, case when error is null then cast(strlen(body) as int) end as size, error from (
            select *, case id % 10 when 0 then case when body is null then 'empty' else 'missing frontmatter' end when 1 then case when body is null then 'empty' else 'frontmatter is not a mapping' end
                when 2 then case when body is null then 'empty' else 'frontmatter is not YAML' end when 3 then 'empty' end as error from note_rows)""", "note_rows"),
        "reindex": sql("""select 'links' as part, count(*) as rows, count(distinct id) as items from (select distinct id, target from (select id, trim(unnest(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:[|#][^\\]]*)?\\]\\]', 1))) as target from note_rows where deleted_at is null) where target <> '')
            union all select 'embeddings', count(*), count(distinct key) from (
                select key, cast(('0x' || h[1:4])::int % 384 as int) as dim, sum(case when ('0x' || h[5:6])::int % 2 = 0 then 1.0 else -1.0 end) as v from (
                    select key, sha256(unnest(regexp_extract_all(lower(text), '[a-z0-9]+'))) as h from (
                        select 'note:' || id as key, concat_ws(chr(10), path, coalesce(frontmatter, '{}'), coalesce(body, '')) as text from note_rows where deleted_at is null
                        union all select 'code:' || id, concat_ws(chr(10), path, coalesce(content, '')) from file_rows)) group by all) where v <> 0""", *rows),
        "detect_language": sql(f"select id, {language} as detected from file_rows", "file_rows"),
        "import_resolution": f"""with file as (select distinct id, repository_id, path from repository_files), known as (select repository_id, path, min(id) as file_id from file group by all),
            imp as (select distinct source_file_id as source_id, target_path from repository_file_imports where target_path like '.%'),
            base as (select source_id, i.target_path, f.repository_id, {_NORMAL} as base from imp i join file f on f.id = i.source_id),
            tried as (select *, unnest([base] || list_transform(['.ts', '.tsx', '.js', '.jsx', '.py', '.go'], lambda e: base || e) || list_transform(['.ts', '.tsx', '.js', '.jsx', '.py', '.go'], lambda e: base || '/index' || e)) as path, unnest(range(13)) as pos from base)
            select source_id as source_file_id, target_path, arg_min(file_id, case when file_id is not null then pos end) as resolved_file_id from tried left join known using (repository_id, path) group by all""",
        "file_outline": "select distinct file_id, name, kind, start_line, end_line from repository_file_symbols where file_id in (select id from repository_files where language = 'go')",
    }
