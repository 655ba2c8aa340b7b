"""Running a vectorised function over sorted groups, many groups at a time, with hot groups cut into segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countflow.functions.common import bounded, cut

#: A group of more rows than this is cut into segments of this size.
SEGMENT_ROWS = 20_000
#: Rows handed to the function at once.
BLOCK_ROWS = 60_000


def prefix_number(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str) -> DataFrame:
    """df with `name`: the exact 0-based number of each row within its keys, by (bucket, order).

    bucket must not decrease along the order. Rows are counted per key and bucket, the
    counts are prefix-summed, and numbering within one bucket adds its offset, so the rows
    of a hot key spread over its buckets instead of meeting in one task.
    """
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(*keys).orderBy(F.col("_b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_b").alias("_ob"), F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_b").eqNullSafe(F.col("_ob"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    out = df.join(offsets, same, "left").withColumn(name, F.row_number().over(inside) - 1 + F.col("_offset"))
    return out.drop("_b", "_ob", "_offset", *[f"_o_{k}" for k in keys])


def split_hot(df: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows of the other groups, rows of groups of more than `rows` rows, keys of those groups); None where there are none."""
    hot = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > rows).drop("_k"))
    if hot.limit(1).count() == 0:
        return df, None, None
    named = bounded(hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return df.join(named, same, "left_anti"), df.join(named, same, "left_semi"), hot


def new_group(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """True where any key differs from the row before (null equals null); True at row 0."""
    n = table.num_rows
    out = np.zeros(n, bool)
    if not n:
        return out
    for k in keys:
        a = table.column(k)
        if isinstance(a, pa.ChunkedArray):
            a = a.combine_chunks()
        if n > 1:
            b, c = a[1:], a[:-1]
            differ = pc.fill_null(pc.not_equal(b, c), False).to_numpy(zero_copy_only=False)
            nulls = a.is_null().to_numpy(zero_copy_only=False)
            out[1:] |= differ.astype(bool) | (nulls[1:] != nulls[:-1])
    out[0] = True
    return out


def map_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType | str, block_rows: int = BLOCK_ROWS, ranged: bool = False) -> DataFrame:
    """Shuffles by keys, sorts, and calls fn(rows, starts) with whole groups, many in one call.

    Groups stream through in blocks of about block_rows rows, so a partition is never held
    whole; only one group has to fit, so hot ones are split or combined before. ranged partitions by key
    ranges instead of hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(new_group(t, keys))
            if not last:
                end = int(starts[-1])
                held, rows = t.slice(end).to_batches(), t.num_rows - end
                if end == 0:
                    return
                t, starts = t.slice(0, end), starts[:-1]
            if t.num_rows:
                yield from fn(t, starts).combine_chunks().to_batches()

        limit = block_rows
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= limit:
                    yield from flush(False)
                    limit = max(block_rows, 2 * rows)
        if held:
            yield from flush(True)

    parts = df.repartitionByRange(*keys) if ranged else df.repartition(*keys)
    return parts.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def floats(t: pa.Table, name: str) -> np.ndarray:
    """A numeric column as float64 with NaN for null."""
    a = t.column(name)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.int64())
    return pc.fill_null(a.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)


def ints(t: pa.Table, name: str) -> np.ndarray:
    a = t.column(name)
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if pa.types.is_timestamp(a.type):
        a = a.cast(pa.int64())
    return a.to_numpy(zero_copy_only=False)
