"""The knowledge graph: nodes, explicit links, shared structure, semantic neighbours, communities.

Nodes are notes and files in one frame: key ('note:1', 'code:2'), kind, id, resource_id (vault or repository), path,
type (for files the language), tags, timestamp (text, compared as text). Edges are undirected: a < b, one per pair and
kind. An edge exists only if both ends survive the node filters. Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.lineage import cut
from cairnfield.operators.markdown import wikilinks

GROUP_CAP = 50


def note_nodes(notes: DataFrame) -> DataFrame:
    tags = F.get_json_object("frontmatter", "$.tags")
    listed = F.when(tags.startswith("["), F.from_json(tags, "array<string>"))
    return notes.filter("deleted_at is null").select(
        F.concat(F.lit("note:"), F.col("id")).alias("key"), F.lit("note").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("vault_id").cast("bigint").alias("resource_id"), "path", "type",
        F.coalesce(listed, F.array().cast("array<string>")).alias("tags"), F.get_json_object("frontmatter", "$.timestamp").alias("timestamp"),
    ).dropDuplicates(["key"])


def file_nodes(files: DataFrame) -> DataFrame:
    return files.select(
        F.concat(F.lit("code:"), F.col("id")).alias("key"), F.lit("code").alias("kind"), F.col("id").cast("bigint").alias("id"), F.col("repository_id").cast("bigint").alias("resource_id"), "path", F.col("language").alias("type"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("timestamp"),
    ).dropDuplicates(["key"])


def nodes(notes: DataFrame, files: DataFrame) -> DataFrame:
    return note_nodes(notes).unionByName(file_nodes(files))


def node_filter(types: Sequence[str] = (), tags: Sequence[str] = (), since: str | None = None, until: str | None = None) -> Column:
    """Types and tags match any of those given; times are inclusive; a node without the value fails."""
    cond = F.lit(True)
    if types:
        cond = cond & F.col("type").isin(*types)
    if tags:
        cond = cond & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if since is not None:
        cond = cond & (F.col("timestamp") >= since)
    if until is not None:
        cond = cond & (F.col("timestamp") <= until)
    return F.coalesce(cond, F.lit(False))


def parse_list(text: str | None) -> list[str]:
    """Values of a comma-separated request parameter."""
    return [x for x in (text or "").split(",") if x]


def _edges(pairs: DataFrame, kind: str) -> DataFrame:
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(kind).alias("kind")).distinct()


def link_edges(note_rows: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges of the links in bodies to notes of the source's own vault, by exact path. note_rows: id, vault_id, body."""
    sources = note_rows.select(F.concat(F.lit("note:"), F.col("id")).alias("x"), F.col("vault_id").cast("bigint").alias("resource_id"), F.explode(wikilinks(F.col("body"))).alias("path")).distinct()
    ends = all_nodes.filter("kind = 'note'").select(F.col("key").alias("y"), "resource_id", "path")
    live = all_nodes.select(F.col("key").alias("x"))
    return _edges(sources.join(ends, ["resource_id", "path"]).join(live, "x", "left_semi"), "extracted")


def repository_link_edges(note_rows: DataFrame, all_nodes: DataFrame, repositories: DataFrame) -> DataFrame:
    """Edges of ``repo:<name>/<path>`` links; of repositories with one name the one with the largest id counts."""
    link = F.explode(wikilinks(F.col("body"))).alias("link")
    sources = note_rows.select(F.concat(F.lit("note:"), F.col("id")).alias("x"), link).filter("link rlike '^repo:[^/]*/'").distinct()
    parts = sources.select("x", F.regexp_extract("link", "^repo:([^/]*)/", 1).alias("name"), F.regexp_replace("link", "^repo:[^/]*/", "").alias("path"))
    named = repositories.groupBy("name").agg(F.max(F.col("id").cast("bigint")).alias("resource_id"))
    ends = all_nodes.filter("kind = 'code'").select(F.col("key").alias("y"), "resource_id", "path")
    live = all_nodes.select(F.col("key").alias("x"))
    return _edges(parts.join(named, "name").join(ends, ["resource_id", "path"]).join(live, "x", "left_semi"), "extracted")


def import_edges(imports: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Edges of resolved imports with both ends among the nodes."""
    pairs = imports.filter("resolved_target_file_id is not null").select(F.concat(F.lit("code:"), F.col("source_file_id")).alias("x"), F.concat(F.lit("code:"), F.col("resolved_target_file_id")).alias("y")).distinct()
    live = all_nodes.select("key")
    return _edges(pairs.join(live.withColumnRenamed("key", "x"), "x", "left_semi").join(live.withColumnRenamed("key", "y"), "y", "left_semi"), "extracted")


def scoped_semantic_edges(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Semantic edges (a, b, similarity), kept globally, whose ends are both among the caller's nodes."""
    live = all_nodes.select("key")
    kept = edges.join(live.withColumnRenamed("key", "a"), "a", "left_semi").join(live.withColumnRenamed("key", "b"), "b", "left_semi")
    return kept.select("a", "b", F.lit("semantic").alias("kind")).distinct()


def structural_groups(all_nodes: DataFrame) -> DataFrame:
    """(group_key, key) of shared type, tags, language and top folder; a tag named twice in a note counts twice."""
    typed = F.array(F.concat(F.lit("type:"), F.col("type")))
    tagged = F.transform("tags", lambda t: F.concat(F.lit("tag:"), t))
    top = F.when(F.instr("path", "/") > 0, F.split_part("path", F.lit("/"), F.lit(1))).otherwise(".")
    code = F.array(F.concat(F.lit("language:"), F.col("type")), F.concat(F.lit("dir:"), F.col("resource_id"), F.lit(":"), top))
    keys = F.when(F.col("kind") == "note", F.concat(typed, tagged)).otherwise(code)
    return all_nodes.select("key", F.explode(keys).alias("group_key")).filter("group_key is not null").select("group_key", "key")


def capped_groups(groups: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """(group_key, size) of the groups above the cap, which give no edges."""
    return groups.groupBy("group_key").agg(F.count("*").alias("size")).filter(F.col("size") > cap)


def structural_edges(groups: DataFrame, cap: int = GROUP_CAP) -> DataFrame:
    """All pairs within each group of at most ``cap``: a reference rule, so a group's pairs are bounded by it.

    Sizes are counted with partial aggregation first; groups above the cap never reach a task of their own.
    """
    small = groups.groupBy("group_key").agg(F.count("*").alias("size")).filter((F.col("size") <= cap) & (F.col("size") > 1)).select("group_key")
    members = groups.join(small, "group_key", "left_semi").groupBy("group_key").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    pairs = members.select(F.explode(F.flatten(F.transform("keys", lambda x, i: F.transform(F.slice("keys", i + 2, F.size("keys")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    return _edges(pairs.select("p.x", "p.y"), "structural")


def all_edges(*parts: DataFrame) -> DataFrame:
    """Edges of every kind; one per pair and kind."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def touching(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Edges with either end among ``keys``: two semi-joins."""
    k = keys.select("key").distinct()
    return edges.join(k.withColumnRenamed("key", "a"), "a", "left_semi").select("a", "b", "kind").unionByName(edges.join(k.withColumnRenamed("key", "b"), "b", "left_semi").select("a", "b", "kind")).distinct()


def backlinks(links: DataFrame) -> DataFrame:
    """(target_path, backlinks): how many notes link to each target."""
    return links.select("source_note_id", "target_path").distinct().groupBy("target_path").agg(F.count("*").alias("backlinks"))


def components(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """(key, component): connected components, named by their smallest key; isolated nodes are their own.

    Alternating star contraction: each round moves links to smaller neighbours, so the rounds grow with the logarithm
    of the size, not with the diameter; a hot key only loses links to partial aggregation. Lineage is cut each round;
    rounds end when none of the links moved.
    """
    links = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct())
    before: tuple | None = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every larger neighbour is linked to the smallest around the node.
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m2, "u")
        new = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m2.select("u", F.col("m").alias("v"))).distinct()
        new = cut(new)
        links = new
        # One pass tells whether anything moved: the links' number and the sum of their hashes.
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == before:
            break
        before = now
    named = links.groupBy("u").agg(F.min("v").alias("component"))
    return all_nodes.select("key").distinct().join(named, F.col("key") == F.col("u"), "left").select("key", F.coalesce("component", "key").alias("component"))


def louvain(pairs: list[tuple[str, str]], isolated: list[str]) -> dict[str, int]:
    """Community numbers of a small undirected graph: local moves and merging until modularity stops rising.

    Deterministic: nodes go by name, ties to the smallest community; communities are numbered by their smallest node.
    """
    names = sorted({x for p in pairs for x in p} | set(isolated))
    at = {n: i for i, n in enumerate(names)}
    links: list[dict[int, float]] = [{} for _ in names]
    for a, b in {tuple(sorted((at[x], at[y]))) for x, y in pairs if x != y}:
        links[a][b] = links[b][a] = 1.0
    if not any(links):
        return dict.fromkeys(names, 0)
    member = list(range(len(names)))
    loops = [0.0] * len(links)
    total = sum(sum(d.values()) for d in links)
    while True:
        size = len(links)
        own = list(range(size))
        degree = [sum(d.values()) + loops[i] for i, d in enumerate(links)]
        weight = degree[:]
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in range(size):
                around: dict[int, float] = {}
                for j, w in links[i].items():
                    around[own[j]] = around.get(own[j], 0.0) + w
                weight[own[i]] -= degree[i]
                best, gain = own[i], around.get(own[i], 0.0) - weight[own[i]] * degree[i] / total
                for c in sorted(around):
                    g = around[c] - weight[c] * degree[i] / total
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] += degree[i]
                if best != own[i]:
                    own[i] = best
                    moved = moved_any = True
        if not moved_any:
            break
        order = {c: n for n, c in enumerate(sorted(set(own)))}
        new_links: list[dict[int, float]] = [{} for _ in order]
        new_loops = [0.0] * len(order)
        for i, d in enumerate(links):
            a = order[own[i]]
            new_loops[a] += loops[i]
            for j, w in d.items():
                b = order[own[j]]
                if a == b:
                    new_loops[a] += w
                else:
                    new_links[a][b] = new_links[a].get(b, 0.0) + w
        member = [order[own[m]] for m in member]
        links, loops = new_links, new_loops
    order: dict[int, int] = {}
    return {n: order.setdefault(member[i], len(order)) for i, n in enumerate(names)}


def communities(edges: DataFrame, scoped_nodes: DataFrame) -> DataFrame:
    """(scope, key, community): communities of each scope's graph; kinds are merged, isolated nodes are included.

    scoped_nodes: scope, key; an edge counts in the scopes that hold both ends. One scope's view must fit one task, as
    it does in the caller's screen; for whole corpora use ``components`` or ``label_propagation``.
    """
    ends = edges.select("a", "b").distinct()
    inside = ends.join(scoped_nodes.select("scope", F.col("key").alias("a")), "a").join(scoped_nodes.select("scope", F.col("key").alias("b")), ["scope", "b"])
    rows = inside.select("scope", "a", "b").unionByName(scoped_nodes.select("scope", F.col("key").alias("a"), F.lit(None).cast("string").alias("b")))

    def detect(frame: pd.DataFrame) -> pd.DataFrame:
        pairs = [(a, b) for a, b in zip(frame["a"], frame["b"]) if isinstance(b, str)]
        found = louvain(pairs, [a for a, b in zip(frame["a"], frame["b"]) if not isinstance(b, str)])
        scope = frame["scope"].iloc[0]
        return pd.DataFrame({"scope": scope, "key": list(found), "community": list(found.values())})

    kind = scoped_nodes.schema["scope"].dataType.simpleString()
    return rows.groupBy("scope").applyInPandas(detect, f"scope {kind}, key string, community int")


def label_propagation(edges: DataFrame, all_nodes: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(key, label): communities of graphs of any size, by the commonest label around each node, its own vote included.

    A node moves to a label with more votes than its own, or with as many and a smaller name. Each round a half of the
    nodes, chosen by a hash, may move, so that neighbours don't swap labels forever; rounds end when no node would
    move. A graph that is not settled after ``max_rounds`` raises an error.
    """
    links = edges.select("a", "b").filter("a <> b").distinct()
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    keys = all_nodes.select("key").distinct()
    both = cut(both.unionByName(keys.select(F.col("key").alias("a"), F.col("key").alias("b"))))
    labels = keys.select("key", F.col("key").alias("label"))
    for n in range(max_rounds):
        # Counts are aggregated before they are compared, so a hub's neighbours never sit in one task.
        votes = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("x")).select(F.col("a").alias("key"), F.col("x.label").alias("next"))
        moves = cut(labels.join(best, "key", "left").select("key", "label", F.coalesce("next", "label").alias("next")))
        if moves.filter("next <> label").isEmpty():
            return moves.select("key", "label")
        labels = moves.select("key", F.when(F.pmod(F.xxhash64("key", F.lit(n)), F.lit(2)) == 0, F.col("next")).otherwise(F.col("label")).alias("label"))
    raise RuntimeError(f"labels still move after {max_rounds} rounds")
