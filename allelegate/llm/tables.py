"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from allelegate.plans.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: cuts the lineage, and a lost executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widths(df: DataFrame) -> int:
    """Tasks for a shuffle of wide rows: the session's own number."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def computed(df: DataFrame, column: str, added: str, make: Callable[[], Callable[[list], dict]], keep: bool = False) -> DataFrame:
    """`df` without `column` (with it, if `keep`), with the columns `added` (a schema) computed from its values.

    `make` runs once per task and returns a function from a list of values to lists by
    name.  The other columns pass through as Arrow arrays, so ids keep every bit.
    """
    kept = [c for c in df.columns if keep or c != column]
    schema = StructType.fromDDL(added)
    total = StructType([df.schema[c] for c in kept] + list(schema))
    types = pa_types(total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            new = step(batch.column(batch.schema.get_field_index(column)).to_pylist())
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [pa.array(new[f], types[f]) for f in schema.names]
            yield pa.RecordBatch.from_arrays(arrays, names=total.names)
        release()

    return df.mapInArrow(run, total)


def pa_types(schema: StructType) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema}


def release() -> None:
    """Give freed memory back at a task's end: workers of earlier stages stay, idle, beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim:
        trim(0)


_KEPT: dict = {}


def per_worker(key: object, make: Callable):
    """What `make` gives, kept for the next tasks of this Python worker; one such object at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]
