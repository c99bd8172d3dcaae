"""Ordered work on keys of any size.

A window over a key puts the whole key into one task.  The helpers here cut all rows into ranges of (key, order)
instead, whatever the size of a key: each range is worked on alone, and per key and range one small total is
carried forward.  There is one plan for every size, and a null key is a key like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allelegate.plans.session import scratch_path

#: Rows of a range that one task holds at once.
RANGE_ROWS = 500_000


def same_keys(keys: list[str], prefix: str = "_h_") -> Column:
    """Null-safe equality of columns with their renamed counterparts."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def in_ranges(df: DataFrame, keys: list[str], order: list[str], segments: int | None = None) -> DataFrame:
    """`df` cut into ranges of (keys, order), numbered in order by `_seg`, from a table in the shared folder.

    The cut is written because it samples its input: a second evaluation could place a row elsewhere.  There are
    as many ranges as the session has shuffle partitions, so they hold what any other task holds.
    """
    segments = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(df.sparkSession, "ranges")
    cut = df.repartitionByRange(segments, *keys, *order).withColumn("_seg", F.spark_partition_id())
    cut.write.parquet(path)
    return df.sparkSession.read.schema(cut.schema).parquet(path)


def segment_count(df: DataFrame) -> int:
    """Ranges for work that holds a whole range: as many as other tasks, or as RANGE_ROWS rows each need."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(df.count() / RANGE_ROWS))


def in_order(table: pa.Table, sort: list[str]) -> tuple[pa.Table, list[int]]:
    """A range in order, and where its keys begin, with the end."""
    table = table.take(pc.sort_indices(table, [(c, "ascending") for c in sort], null_placement="at_start"))
    keys = table.column(sort[0]).combine_chunks()
    new = pc.fill_null(pc.not_equal(keys[1:], keys[:-1]), True).to_numpy(zero_copy_only=False)
    both_null = pc.and_(keys[1:].is_null(), keys[:-1].is_null()).to_numpy(zero_copy_only=False)
    return table, [0, *(np.flatnonzero(new & ~both_null) + 1).tolist(), table.num_rows]


def _carried(cut: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """Join what lies before a range to its rows: one row per (key, range), so no side is skewed."""
    side = totals.select(*[F.col(k).alias(f"_h_{k}") for k in [*keys, "_seg"]], "_base")
    return cut.join(side, same_keys([*keys, "_seg"]), "left").drop(*[f"_h_{k}" for k in [*keys, "_seg"]])


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def with_position(df: DataFrame, keys: list[str], order: list[str], name: str = "position", segments: int | None = None) -> DataFrame:
    """1-based position of each row inside its key, in ascending `order` (unique per key)."""
    cut = in_ranges(df, keys, order, segments)
    counts = cut.groupBy(*keys, "_seg").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.withColumn("_base", F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)))
    local = F.row_number().over(Window.partitionBy(*keys, "_seg").orderBy(*order))
    placed = _carried(cut, totals, keys).withColumn(name, (local + F.col("_base")).cast("bigint"))
    return placed.select(*df.columns, name)


def with_prior(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, segments: int | None = None) -> DataFrame:
    """Last non-null `value` among the earlier rows of the same key."""
    cut = in_ranges(df, keys, order, segments)
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    lasts = cut.groupBy(*keys, "_seg").agg(F.max_by(value, at).alias("_last"))
    totals = lasts.withColumn("_base", F.last("_last", ignorenulls=True).over(_before(keys)))
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = _carried(cut, totals, keys).withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(inside), F.col("_base")))
    return placed.select(*df.columns, name)
