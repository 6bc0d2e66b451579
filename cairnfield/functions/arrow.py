"""Arrow-batched Python stages: one kernel call per record batch, never per JVM row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of output that a stage gathers before it hands a batch back to the JVM.
OUT_ROWS = 4096


def spread(df: DataFrame) -> DataFrame:
    """Spread an input that arrives as a single split over the cluster's cores.

    Inputs with more than one split are left alone, so a large scan is never shuffled for this.
    """
    spark = df.sparkSession
    if df.rdd.getNumPartitions() == 1:
        cores = spark.sparkContext.defaultParallelism
        if cores > 1:
            return df.repartition(cores)
    return df


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    kernel: Callable[[list[list]], Iterable[tuple]],
    schema: StructType | str,
    out_rows: int = OUT_ROWS,
) -> DataFrame:
    """Run ``kernel`` over the named columns of every batch.

    ``kernel`` gets one Python list per column and yields result tuples in the order of ``schema``.
    Columns that are not named never leave the JVM, so extra columns (clashing names included) cost nothing.
    Results are returned in batches of ``out_rows``: a batch of long texts can't pile up its results.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    arrow = to_arrow_schema(schema)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [()] * len(arrow)
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for row in kernel([c.to_pylist() for c in batch.columns]):
                rows.append(row)
                if len(rows) >= out_rows:
                    yield pack(rows)
                    rows = []
            if rows:
                yield pack(rows)

    return df.select(*columns).mapInArrow(stage, schema)
