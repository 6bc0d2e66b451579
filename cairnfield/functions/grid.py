"""Equi-joins whose result is far larger than their inputs, dealt out to the tasks in cells of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: About as many rows of a key stand in a block; a block of one side meets a block of the other in a cell.
BLOCK = 1024
#: Tasks for each shuffle partition: cells are small beside their results, so their bytes say nothing on how many to put together.
TASKS = 4


def _blocks(rows: str) -> Column:
    return F.ceil(F.col(rows) / BLOCK).cast("int")


def _dealt(df: DataFrame, sizes: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """``df`` with the blocks of its rows (``own``), once for each block of the other side (``other``)."""
    known = df.join(sizes, key, "left")
    block = F.pmod(F.xxhash64(*df.columns), F.coalesce(f"{own}s", F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1))
    tasks = TASKS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return known.select(*df.columns, block.alias(own), copies.alias(other)).repartition(tasks, key, own, other)


def grid_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join on ``key``, every pair of rows as often as in a plain join.

    A plain join puts all pairs of a key into one task. Here only keys without many rows stay together; the rows of any
    other are put into blocks by their hash, and each pair of blocks is a cell of its own, which any task may take.
    Beside the result, of up to BLOCK² rows a cell, the copies of up to 2 BLOCK rows are few.
    """
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    both = count(left, "_left").join(count(right, "_right"), key)
    sizes = both.select(key, _blocks("_left").alias("_is"), _blocks("_right").alias("_js")).filter("_is > 1 or _js > 1")
    cell = [key, "_i", "_j"]
    return _dealt(left, sizes, key, "_i", "_j").join(_dealt(right, sizes, key, "_j", "_i"), cell).drop("_i", "_j")
