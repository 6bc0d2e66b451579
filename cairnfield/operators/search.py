"""Hybrid search: keyword and vector branches over notes and files, fused by reciprocal rank.

Items are one frame: kind ('note' or 'code'), id, scope_id (vault or repository), title (path), text (body or content),
embedding and, if they are there, frontmatter (of notes, indexed too) and language (of files); results carry both.
Scope is applied inside each branch, before its cap. Ranks are deterministic: ties go by kind and id. Text is split
into lower-case [a-z0-9]+ tokens without stop words; there is no stemming, and keyword rank is the sum of term
frequencies (fusion uses only the order). In a query, words side by side are and-ed and bind tighter than ``or``. Null
texts count as empty; blank queries and empty scopes find nothing. Repeated items count once.

``write_index`` stores what a search needs: postings in folders by token, vectors, and texts in folders by item. A
search over the index reads the postings of the query's words, the vectors of its scope, and the final items' texts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnfield.functions.lineage import cut

CANDIDATES, RRF_K, DEFAULT_LIMIT, MAX_LIMIT = 30, 60, 20, 100
HEADLINE_WORDS, SNIPPET_CHARS = 30, 200
# Words that are not indexed.
STOP_WORDS = tuple("a an and are as at be but by for from had has have he her his if in into is it its no not of on or she so such than that the their then there these they this to was were will with you".split())


def words_of(text: Column) -> Column:
    """Tokens of a text in order, stop words among them."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def tokens(text: Column) -> Column:
    """Tokens of a text in order, stop words left out."""
    return F.filter(words_of(text), lambda w: ~w.isin(*STOP_WORDS))


class Clause(NamedTuple):
    """One term or phrase of a query; the clauses of a group must all hold, groups are alternatives."""

    words: tuple[str, ...]
    negated: bool


def parse_query(query: str) -> list[list[Clause]]:
    """Web-search syntax: words are and-ed, "a phrase", ``or`` between alternatives (it binds last), ``-word`` for without."""
    groups: list[list[Clause]] = [[]]
    for m in re.finditer(r'(-?)"([^"]*)"|(-?)([^\s"]+)', query or ""):
        if m[4] is not None and not m[3] and m[4].lower() == "or":
            groups.append([])
            continue
        raw = m[2] if m[2] is not None else m[4]
        words = tuple(w for w in re.findall("[a-z0-9]+", raw.lower()) if w not in STOP_WORDS)
        if words:
            groups[-1].append(Clause(words, bool(m[1] or m[3])))
    return [g for g in groups if g]


def _holds(clause: Clause, tokens_: Column) -> Column:
    if len(clause.words) == 1:
        found = F.array_contains(tokens_, clause.words[0])
    else:
        text = F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))
        found = text.contains(" " + " ".join(clause.words) + " ")
    return ~found if clause.negated else found


def matches(query: str, tokens_: Column) -> Column:
    """Whether a token list satisfies a query; a query without words matches nothing."""
    groups = parse_query(query)
    if not groups:
        return F.lit(False)
    return reduce(Column.__or__, (reduce(Column.__and__, (_holds(c, tokens_) for c in g)) for g in groups))


def wanted_words(query: str) -> list[str]:
    """The words that a query asks for, without those it excludes."""
    return sorted({w for g in parse_query(query) for c in g if not c.negated for w in c.words})


def term_frequency(query: str, tokens_: Column) -> Column:
    """How many of a text's tokens are words that the query asks for."""
    words = wanted_words(query)
    return F.size(F.filter(tokens_, lambda t: t.isin(*words))) if words else F.lit(0)


def headline(query: str, text: Column) -> Column:
    """Up to thirty words around the first hit, hits in bold; the text's beginning if nothing hits."""
    words = wanted_words(query)
    parts = F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), " ")
    if not words:
        return F.array_join(F.slice(parts, 1, HEADLINE_WORDS), " ")
    pattern = r"(?i)(?<![a-z0-9])(" + "|".join(words) + r")(?![a-z0-9])"
    hit = F.array_position(F.transform(parts, lambda p: p.rlike(pattern)), True)
    start = F.greatest(hit - HEADLINE_WORDS // 2, F.lit(1)).cast("int")
    return F.regexp_replace(F.array_join(F.slice(parts, start, HEADLINE_WORDS), " "), pattern, "<b>$1</b>")


def may_match(query: str, text: Column) -> Column:
    """What a text must contain to match: a plain substring test, run before any text is split."""
    low = F.lower(text)
    groups = [[w for c in g if not c.negated for w in c.words] for g in parse_query(query)]
    return reduce(Column.__or__, (reduce(Column.__and__, (low.contains(w) for w in g), F.lit(True)) for g in groups), F.lit(False))


def document(items: DataFrame) -> Column:
    """The indexed text of an item: its path, a note's frontmatter, its body or content."""
    return F.concat_ws(" ", *(c for c in ("title", "frontmatter", "text") if c in items.columns))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null if either vector is null, empty or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine similarity to one known vector, whose length is computed once; null for null, empty and zero vectors."""
    length = sum(float(x) ** 2 for x in vector) ** 0.5
    unit = F.array(*(F.lit(float(x)) for x in vector))
    both = F.aggregate(
        F.zip_with(a, unit, lambda x, y: F.struct((x.cast("double") * y).alias("d"), (x.cast("double") * x.cast("double")).alias("n"))),
        F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n")),
        lambda s, v: F.struct((s["d"] + v["d"]).alias("d"), (s["n"] + v["n"]).alias("n")),
    )
    return both["d"] / F.nullif(F.sqrt(both["n"]) * F.lit(length), F.lit(0.0))


def _top(scored: DataFrame, limit: int) -> DataFrame:
    """(kind, id, score, rank): the best of each kind. Scores are narrow rows, so repeated items cost little to drop;
    each task keeps only its own best before the shuffle."""
    return _ranked(scored.distinct(), limit)


def _ranked(scored: DataFrame, limit: int) -> DataFrame:
    """(kind, id, score, rank): the best of each kind, of rows that don't repeat."""
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= limit)


def keyword_hits(items: DataFrame, query: str) -> DataFrame:
    """(kind, id, score) of all items that match."""
    text = document(items)
    phrases = any(len(c.words) > 1 for g in parse_query(query) for c in g)
    hits = items.filter(may_match(query, text)).select("kind", "id", (tokens(text) if phrases else words_of(text)).alias("t"))
    return hits.filter(matches(query, F.col("t"))).select("kind", "id", term_frequency(query, F.col("t")).cast("double").alias("score"))


def vector_hits(items: DataFrame, vector: list[float]) -> DataFrame:
    """(kind, id, score) of all items with a vector; there is no similarity floor. An empty vector is near nothing."""
    if not len(vector):
        return items.select("kind", "id", F.lit(0.0).alias("score")).limit(0)
    scored = items.filter("embedding is not null").select("kind", "id", F.round(cosine_to(F.col("embedding"), vector), 6).alias("score"))
    return scored.filter("score is not null")


def with_snippets(items: DataFrame, top: DataFrame, snippet: Column) -> DataFrame:
    """``top`` with snippets from the items' texts; at most a few dozen rows are sent to find them."""
    carried = [c for c in ("scope_id", "title", "frontmatter", "language") if c in items.columns]
    found = items.select("kind", "id", "text", *carried).join(F.broadcast(top), ["kind", "id"])
    return found.select(*top.columns, *carried, snippet.alias("snippet")).dropDuplicates(["kind", "id"])


def keyword_branch(items: DataFrame, query: str, limit: int = CANDIDATES) -> DataFrame:
    """(kind, id, score, snippet) of the best keyword hits of all kinds together."""
    top = keyword_hits(items, query).distinct().orderBy(F.desc("score"), "kind", "id").limit(limit)
    return with_snippets(items, top, headline(query, F.col("text")))


def vector_branch(items: DataFrame, vector: list[float], limit: int = CANDIDATES) -> DataFrame:
    """(kind, id, score, snippet) of the nearest items of all kinds together."""
    top = vector_hits(items, vector).distinct().orderBy(F.desc("score"), "kind", "id").limit(limit)
    return with_snippets(items, top, F.left(F.coalesce("text", F.lit("")), F.lit(SNIPPET_CHARS)))


def fuse(ranked: DataFrame) -> DataFrame:
    """(kind, id, score, by_keyword, first) of ranked candidates by reciprocal rank. Columns in: kind, id, branch, rank
    (from 1), keyword."""
    return ranked.groupBy("kind", "id").agg(
        F.round(F.sum(1.0 / (F.lit(RRF_K) + F.col("rank"))), 9).alias("score"),
        F.max("keyword").alias("by_keyword"),
        F.min(F.struct("branch", "rank")).alias("first"),
    )


def _best(near: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """(kind, id, score, by_keyword, first): the best candidates of all branches, fused."""
    code = (F.col("kind") == "code").cast("int")
    near = _top(near, CANDIDATES).select("kind", "id", "rank", code.alias("branch"), F.lit(False).alias("keyword"))
    hits = _top(hits, CANDIDATES).select("kind", "id", "rank", (code + 2).alias("branch"), F.lit(True).alias("keyword"))
    return fuse(near.unionByName(hits)).orderBy(F.desc("score"), "first").limit(min(max(limit, 1), MAX_LIMIT))


def _shown(items: DataFrame, top: DataFrame, query: str) -> DataFrame:
    text = F.when(F.col("by_keyword"), headline(query, F.col("text"))).otherwise(F.left(F.coalesce("text", F.lit("")), F.lit(SNIPPET_CHARS)))
    return with_snippets(items, top, text).orderBy(F.desc("score"), "first").drop("by_keyword", "first")


def hybrid_search(items: DataFrame, query: str, vector: list[float], limit: int = DEFAULT_LIMIT, scope: DataFrame | None = None) -> DataFrame:
    """(kind, id, score, scope_id, title, frontmatter and language where items have them, snippet): best items, in order.

    Four branches (vectors and keywords, notes and code) give at most ``CANDIDATES`` each; ties keep the order in which
    items first appear, by branch and then by rank. ``scope``: (kind, scope_id) of what the caller may see; None is all.
    """
    if not (query or "").strip():
        items = items.limit(0)
    seen = items if scope is None else items.join(scope.distinct(), ["kind", "scope_id"], "left_semi")
    return _shown(items, _best(vector_hits(seen, vector), keyword_hits(seen, query), limit), query)


def postings(items: DataFrame) -> DataFrame:
    """(token, kind, id, tf, positions): the inverted index, for lookups by equi-join."""
    # A group is one token of one item, so its places are at most an item's words; a set, as items may be repeated.
    each = items.select("kind", "id", F.posexplode(tokens(document(items))).alias("pos", "token"))
    places = F.array_sort(F.collect_set("pos"))
    return each.groupBy("token", "kind", "id").agg(places.alias("positions")).select("token", "kind", "id", F.size("positions").cast("bigint").alias("tf"), "positions")


#: Folders that tokens and items are dealt out to, and files that a folder's tokens are dealt out to, so that a token
#: that a third of all items have is no single task's.
BUCKETS, SALTS = 64, 4


class Index(NamedTuple):
    """A stored index: its frames and the number of its folders."""

    postings: DataFrame
    vectors: DataFrame
    items: DataFrame
    buckets: int


def _token_bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(token, "utf-8")), F.lit(buckets)).cast("int")


def _token_buckets(words: list[str], buckets: int) -> list[int]:
    """The folders of some tokens, as ``_token_bucket`` gives them."""
    return sorted({zlib.crc32(w.encode()) % buckets for w in words})


def _item_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "id"), F.lit(buckets)).cast("int")


def write_index(items: DataFrame, folder: str, buckets: int = BUCKETS, salts: int = SALTS) -> None:
    """Store the index of ``items`` below ``folder``, replacing what is there."""
    spark = items.sparkSession
    stored = items.withColumn("bucket", _item_bucket(buckets)).dropDuplicates(["kind", "id"])
    stored.drop("embedding").repartition("bucket").sortWithinPartitions("bucket", "kind", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/items")
    items.filter("embedding is not null").select("kind", "id", "scope_id", "embedding").dropDuplicates(["kind", "id"]).write.mode("overwrite").parquet(f"{folder}/vectors")
    kept = spark.read.schema(stored.drop("embedding").schema).parquet(f"{folder}/items")
    rows = postings(kept).join(kept.select("kind", "id", "scope_id"), ["kind", "id"]).withColumn("bucket", _token_bucket(F.col("token"), buckets))
    dealt = rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(salts))).sortWithinPartitions("bucket", "token")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    # Schemas and the number of folders are stored too, so that an empty index can be read.
    vectors = items.select("kind", "id", "scope_id", "embedding")
    about = [(name, df.schema.json(), buckets) for name, df in (("postings", dealt), ("vectors", vectors), ("items", stored.drop("embedding")))]
    spark.createDataFrame(about, "part string, schema string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/about")


def open_index(spark: SparkSession, folder: str) -> Index:
    about = {r["part"]: r for r in spark.read.parquet(f"{folder}/about").collect()}
    read = lambda name: spark.read.schema(StructType.fromJson(json.loads(about[name]["schema"]))).parquet(f"{folder}/{name}")
    return Index(read("postings"), read("vectors"), read("items"), about["items"]["buckets"])


def index_hits(index: Index, query: str, scope: DataFrame | None = None) -> DataFrame:
    """(kind, id, score) of all items that match, from the postings of the query's words alone."""
    groups = parse_query(query)
    words = sorted({w for g in groups for c in g for w in c.words})
    # The folders are named, so that the scan skips the others.
    rows = index.postings.filter(F.col("bucket").isin(*_token_buckets(words, index.buckets)) & F.col("token").isin(*words)) if words else index.postings.limit(0)
    if scope is not None:
        rows = rows.join(scope.distinct(), ["kind", "scope_id"], "left_semi")
    frequency = lambda n: F.coalesce(F.max(F.when(F.col("token") == words[n], F.col("tf"))), F.lit(0)).alias(f"f{n}")
    places = lambda n: F.max(F.when(F.col("token") == words[n], F.col("positions"))).alias(f"p{n}")
    found = rows.groupBy("kind", "id").agg(F.lit(0).alias("none"), *(f(n) for n in range(len(words)) for f in (frequency, places)))
    if any(all(c.negated for c in g) for g in groups):
        # Only what a query excludes is named: items without any of its words match too.
        ids = index.items.select("kind", "id", "scope_id")
        ids = (ids if scope is None else ids.join(scope.distinct(), ["kind", "scope_id"], "left_semi")).drop("scope_id")
        found = ids.join(found, ["kind", "id"], "left").fillna(0, [f"f{n}" for n in range(len(words))])

    def holds(clause: Clause) -> Column:
        at = [words.index(w) for w in clause.words]
        if len(at) == 1:
            there = F.col(f"f{at[0]}") > 0
        else:
            there = F.coalesce(F.exists(F.col(f"p{at[0]}"), lambda p: reduce(Column.__and__, (F.array_contains(F.col(f"p{n}"), p + k) for k, n in enumerate(at) if k))), F.lit(False))
        return ~there if clause.negated else there

    match = reduce(Column.__or__, (reduce(Column.__and__, map(holds, g)) for g in groups), F.lit(False))
    score = reduce(Column.__add__, (F.col(f"f{words.index(w)}") for w in wanted_words(query)), F.lit(0))
    return found.filter(match).select("kind", "id", score.cast("double").alias("score"))


def indexed_search(index: Index, query: str, vector: list[float], limit: int = DEFAULT_LIMIT, scope: DataFrame | None = None) -> DataFrame:
    """What ``hybrid_search`` gives, from a stored index."""
    # Who may see what is asked once, for both branches.
    scope = None if scope is None else cut(scope.select("kind", "scope_id").distinct())
    vectors = index.vectors if scope is None else index.vectors.join(scope.distinct(), ["kind", "scope_id"], "left_semi")
    if not (query or "").strip():
        vectors = vectors.limit(0)
    # Both branches are jobs of their own, side by side; each gives at most two times ``CANDIDATES`` rows.
    branches = (vector_hits(vectors, vector), index_hits(index, query, scope))
    with ThreadPoolExecutor(2) as pool:
        near, hits = pool.map(lambda df: [tuple(r) for r in _ranked(df, CANDIDATES).select("kind", "id", "rank", _item_bucket(index.buckets)).collect()], branches)
    score: dict[tuple, float] = defaultdict(float)
    first: dict[tuple, tuple] = {}
    for branch, rows in ((0, near), (2, hits)):
        for kind, i, rank, bucket in rows:
            key = (kind, i, bucket)
            score[key] += 1.0 / (RRF_K + rank)
            first[key] = min(first.get(key, (9, 0)), (branch + (kind == "code"), rank))
    found = {r[:2] for r in hits}
    order = sorted(score, key=lambda k: (-round(score[k], 9), first[k]))[: min(max(limit, 1), MAX_LIMIT)]
    spark, kind_of_id = index.items.sparkSession, index.items.schema["id"].dataType.simpleString()
    best = spark.createDataFrame([(k, i, round(score[k, i, b], 9), (k, i) in found, first[k, i, b]) for k, i, b in order], f"kind string, id {kind_of_id}, score double, by_keyword boolean, first struct<branch int, rank int>")
    # At most ``MAX_LIMIT`` rows: their folders and ids are named to the scan of the texts.
    texts = index.items.filter(F.col("bucket").isin(*{b for _, _, b in order}) & F.col("id").isin(*{i for _, i, _ in order})) if order else index.items.limit(0)
    return _shown(texts, best, query)
