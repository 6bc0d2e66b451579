"""One entry point to the engine: every call returns DataFrames and keeps nothing between calls.

    engine = Engine.open(spark, folder)          # or Engine(spark, {"notes": df, ...})
    engine.search("guidance software", vector, user_id=7)
    engine.graph(user_id=7, types="people,notes")
    engine.access().filter("user_id = 7")
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions.shipping import ship
from cairnfield.operators import access, admin, code, embedding, graph, ingest, search, store
from cairnfield.operators.references import orphan_references, orphan_report
from cairnfield.sources.tables import table

TABLES = ("users", "teams", "memberships", "vaults", "shares", "preferences", "notes", "note_links", "revisions", "repositories", "repository_shares", "repository_files", "repository_file_imports", "repository_file_symbols", "embeddings", "semantic_edges")


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    capped_groups: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]) -> None:
        self.spark, self.frames = spark, frames
        ship(spark)

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> Engine:
        """An engine over the Parquet tables of a folder; each is read when it is first used."""
        engine = cls(spark, {})
        engine._load = lambda name: table(spark, folder, name) if name in names else None  # type: ignore[attr-defined]
        return engine

    def get(self, name: str) -> DataFrame | None:
        """A table, loaded if it wasn't yet; None if this engine has none of that name."""
        if name not in self.frames:
            loaded = getattr(self, "_load", lambda _: None)(name)
            if loaded is None:
                return None
            self.frames[name] = loaded
        return self.frames[name]

    def __getitem__(self, name: str) -> DataFrame:
        if (found := self.get(name)) is None:
            raise KeyError(f"no table {name}")
        return found

    def access(self) -> DataFrame:
        """(user_id, vault_id, access) of all active users."""
        return access.accessible_vaults(self["users"], self["vaults"], self["shares"], self["memberships"])

    def repository_access(self) -> DataFrame:
        return access.accessible_repositories(self["users"], self["repositories"], self["repository_shares"], self["memberships"])

    def _scope(self, user_id: int) -> DataFrame:
        vaults = self.access().filter(F.col("user_id") == user_id).select(F.lit("note").alias("kind"), F.col("vault_id").cast("string").alias("scope_id"))
        repositories = self.repository_access().filter(F.col("user_id") == user_id).select(F.lit("code").alias("kind"), F.col("repository_id").cast("string").alias("scope_id"))
        return vaults.unionByName(repositories)

    def items(self) -> DataFrame:
        """Live notes and files as search items; vectors are joined by (kind, id) where the table has them."""
        notes = self["notes"].filter("deleted_at is null").select(F.lit("note").alias("kind"), "id", F.col("vault_id").cast("string").alias("scope_id"), F.col("path").alias("title"), F.concat_ws(" ", "frontmatter", "body").alias("text"))
        files = self["repository_files"].select(F.lit("code").alias("kind"), "id", F.col("repository_id").cast("string").alias("scope_id"), F.col("path").alias("title"), F.col("content").alias("text"))
        return notes.unionByName(files).join(self["embeddings"].select("kind", "id", "embedding"), ["kind", "id"], "left")

    def search(self, query: str, vector: list[float], user_id: int, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
        """Best notes and files that a user may see."""
        return search.hybrid_search(self.items(), query, vector, limit, self._scope(user_id))

    def graph(self, user_id: int, types: str | None = None, tags: str | None = None, since: str | None = None, until: str | None = None) -> Graph:
        """The graph of everything a user may see; filters as comma-separated text, times inclusive."""
        scope = self._scope(user_id).select("kind", F.col("scope_id").cast("bigint").alias("resource_id"))
        nodes = graph.nodes(self["notes"], self["repository_files"]).join(scope, ["kind", "resource_id"], "left_semi")
        nodes = nodes.filter(graph.node_filter(graph.parse_list(types), graph.parse_list(tags), since, until))
        live = self["notes"].filter("deleted_at is null").select("id", "vault_id", "body")
        groups = graph.structural_groups(nodes)
        parts = [graph.link_edges(live, nodes), graph.repository_link_edges(live, nodes, self["repositories"]), graph.import_edges(self["repository_file_imports"], nodes), graph.structural_edges(groups)]
        if (stored := self.get("semantic_edges")) is not None:
            parts.append(graph.scoped_semantic_edges(stored, nodes))
        return Graph(nodes, graph.all_edges(*parts), graph.capped_groups(groups))

    def semantic_edges(self, threshold: float = embedding.THRESHOLD, k: int = embedding.K) -> DataFrame:
        """Pairs of nearest nodes over all that have vectors."""
        vectors = self["embeddings"].select(F.concat_ws(":", "kind", "id").alias("key"), "embedding")
        return embedding.semantic_edges(embedding.knn(vectors, k), threshold)

    def sync(self, incoming: DataFrame, manifest: DataFrame, now) -> tuple[DataFrame, DataFrame]:
        """(files after a sync, counters a repository); the stored tables stay as they are."""
        files = self["repository_files"]
        return ingest.next_files(files, incoming, manifest, now), ingest.sync_summary(ingest.sync_diff(files, incoming, manifest))

    def extract(self) -> tuple[DataFrame, DataFrame]:
        """(symbols, resolved imports) of all files."""
        files = self["repository_files"]
        imports = code.code_imports(files)
        return code.code_symbols(files), ingest.resolve_imports(imports, files)

    def history(self) -> DataFrame:
        return store.dedupe_consecutive(self["revisions"])

    def overview(self) -> DataFrame:
        return admin.vault_overview(self["vaults"], self["users"], self["notes"], self["shares"])

    def orphans(self) -> tuple[DataFrame, DataFrame]:
        """(references to records that aren't there, counts per table and month)."""
        found = orphan_references(*(self[n] for n in ("notes", "note_links", "repositories", "repository_files", "repository_file_imports")))
        return found, orphan_report(found)
