"""Vectors of texts, nearest neighbours and semantic edges.

Neighbours are exact. Vectors are normalised once; each task multiplies its block of query vectors with blocks of all
vectors that stream past it: the two sides meet by block number, so neither is broadcast whole and no pairs are
written, only each query's best ``k`` of a block. Null, empty and zero vectors have no neighbours; ties go by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DIMENSIONS, K, THRESHOLD = 384, 8, 0.75
#: Vectors of a block on either side.
BLOCK = 4096


def hash_dims(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """(dim, sign) of every token of a text, by its SHA-256."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)

    def one(word: Column) -> Column:
        h = F.sha2(word, 256)
        dim = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") % dimensions
        sign = F.when(F.conv(F.substring(h, 5, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
        return F.struct(dim.alias("dim"), sign.alias("sign"))

    return F.transform(words, one)


def hash_embedding(items: DataFrame, id_col: str, text: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id_col, dim, value): sparse, L2-normalised hash embedding; texts without tokens have no rows."""
    each = items.select(id_col, F.explode(hash_dims(text, dimensions)).alias("x"))
    summed = each.groupBy(id_col, F.col("x.dim").alias("dim")).agg(F.sum("x.sign").cast("double").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy(id_col)))
    return summed.withColumn("n", norm).filter("n > 0 and v <> 0").select(id_col, "dim", F.round(F.col("v") / F.col("n"), 6).alias("value"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def embed_text(path: Column, frontmatter: Column, body: Column) -> Column:
    """The text of a note that is embedded."""
    return F.concat_ws("\n", path, F.coalesce(frontmatter, F.lit("{}")), F.coalesce(body, F.lit("")))


def knn(vectors: DataFrame, k: int = K, block: int = BLOCK, queries: DataFrame | None = None, earlier_only: bool = False) -> DataFrame:
    """(key, neighbour, similarity, rank): the ``k`` nearest other vectors of each query.

    vectors: key (string), embedding, and seq if ``earlier_only``, which admits only neighbours of a smaller seq.
    queries: the keys to ask for; None asks for all. A grid of query blocks by vector blocks is filled, one task a
    field: vectors are copied once for each query block, queries once for each vector block.
    """
    cols = ["key", F.col("embedding").cast("array<float>").alias("embedding"), F.col("seq").cast("bigint").alias("seq") if earlier_only else F.lit(0).cast("bigint").alias("seq")]
    kept = vectors.filter("embedding is not null and size(embedding) > 0 and key is not null").select(*cols).dropDuplicates(["key"])
    asked = kept if queries is None else kept.join(queries.select("key").distinct(), "key", "left_semi")
    rows = max(1, -(-asked.count() // block))
    columns = max(1, -(-kept.count() // block))

    def place(count: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(count)).cast("int")

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = asked.select("*", place(rows).alias("r"), each(columns).alias("c"))
    # Other names, as both sides come from one frame.
    right = kept.select("*", place(columns).alias("c"), each(rows).alias("r")).toDF("v_key", "v_embedding", "v_seq", "v_c", "v_r")

    def unit(s: pd.Series) -> np.ndarray:
        m = np.array(s.tolist(), np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.full_like(m, np.nan), where=n > 0)

    def best(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[str, str, float]] = []
        if len(q) and len(v):
            mq, mv, names, seqs = unit(q["embedding"]), unit(v["v_embedding"]), v["v_key"].to_numpy(), v["v_seq"].to_numpy()
            for at in range(0, len(q), 1024):
                sims = np.round(mq[at : at + 1024] @ mv.T, 6)
                keys, own_seqs = q["key"].to_numpy()[at : at + 1024], q["seq"].to_numpy()[at : at + 1024]
                sims[keys[:, None] == names[None, :]] = np.nan
                if earlier_only:
                    sims[seqs[None, :] >= own_seqs[:, None]] = np.nan
                for own, s in zip(keys, sims):
                    ok = np.flatnonzero(~np.isnan(s))
                    if len(ok) > k:
                        edge = np.partition(s[ok], len(ok) - k)[len(ok) - k]
                        ok = ok[s[ok] >= edge]
                    found += [(own, names[n], float(s[n])) for n in sorted(ok, key=lambda n: (-s[n], names[n]))[:k]]
        return pd.DataFrame(found, columns=["key", "neighbour", "similarity"])

    pairs = left.groupBy("r", "c").cogroup(right.groupBy("v_r", "v_c")).applyInPandas(best, "key string, neighbour string, similarity double")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc("similarity"), "neighbour"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def semantic_edges(neighbours: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity): pairs that either end selects, each once, the threshold applied after the selection."""
    near = neighbours.filter(F.col("similarity") >= threshold)
    return near.groupBy(F.least("key", "neighbour").alias("a"), F.greatest("key", "neighbour").alias("b")).agg(F.max("similarity").alias("similarity"))


def replayed_edges(vectors: DataFrame, k: int = K, threshold: float = THRESHOLD, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity) as one-by-one recomputation in order of ``seq`` leaves them: an edge lives iff its later end
    selects the earlier one among the vectors embedded before it. vectors: key, seq, embedding."""
    return semantic_edges(knn(vectors, k, queries=queries, earlier_only=True), threshold)
