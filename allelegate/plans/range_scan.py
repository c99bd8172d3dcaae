"""What each range of (key, order) starts from, by a scan over maps of states.

Rows cut into ranges (`plans.skew.in_ranges`) can be worked on alone but for one thing: the state that the first key
of a range has reached in the ranges before.  Each range is a map from the state before it to the state after it.  A map
has its `first` and `last` key, and

    after(state)    the state after the range,
    then(other)     the map of this range and the next one together.

`then` is associative, so any bracketing gives the same map.  The scan has two levels and three passes, whatever the data:
the ranges of a block (as many as there are blocks) are composed, one task walks over the blocks' maps with the state
at hand, and each block walks over its ranges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Maps:
    """How maps and states of one kind are stored: a map is one row or more, with its places and the columns STEPS."""

    STEPS: list[str]
    key: T.DataType
    #: Columns of a state besides its key; the first one is never null.
    state: list[tuple[str, T.DataType]]

    def schema(self, places: list[str]) -> T.StructType:
        raise NotImplementedError

    def rows(self, m: Any, places: tuple[int, ...], schema: T.StructType) -> pa.RecordBatch:
        raise NotImplementedError

    def whole(self, head: dict, steps: list) -> Any:
        """The map of a row's other columns and, row by row, its STEPS."""
        raise NotImplementedError

    def pack(self, state: Any) -> tuple | None:
        """The columns of a state; none if it is what a key starts with anyway."""
        raise NotImplementedError

    def unpack(self, key: Any, *values: Any) -> Any:
        raise NotImplementedError

    def read(self, batches: Iterator[pa.RecordBatch], places: list[str]) -> Iterator[tuple[dict, Any]]:
        """Maps of rows in the order of `places` and chunk, each with its other columns."""
        head, steps = None, []
        for batch in batches:
            slim = batch.select([c for c in batch.schema.names if c not in self.STEPS]).to_pylist()
            for i, row in enumerate(slim):
                if head is not None and any(row[p] != head[p] for p in places):
                    yield head, self.whole(head, steps)
                    head, steps = None, []
                head = head or row
                steps.append([batch.column(c)[i] for c in self.STEPS])
        if head is not None:
            yield head, self.whole(head, steps)


def as_batch(rows: list, schema: T.StructType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrays = [pa.array(column, to_arrow_type(f.dataType)) for column, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=schema.names)


def entering_states(maps: DataFrame, ranges: int, kind: Maps) -> DataFrame:
    """(seg, key, *state): what each range starts from whose first key goes on from the range before.

    `maps` has the columns of `kind.schema(["seg"])`, one map per non-empty range.
    """
    size = max(1, math.ceil(math.sqrt(ranges)))
    placed = maps.withColumn("block", (F.col("seg") / size).cast("int"))
    block_schema = kind.schema(["block"])
    blocks = placed.repartition(size, "block").sortWithinPartitions("block", "seg", "chunk").mapInArrow(_composed(kind, block_schema), block_schema)
    found = [T.StructField("key", kind.key), *(T.StructField(f"at_{n}", t) for n, t in kind.state)]
    known = T.StructType([T.StructField("block", T.IntegerType()), *found])
    before = blocks.repartition(1).sortWithinPartitions("block", "chunk").mapInArrow(_walked(kind, ["block"], known, ""), known)
    given = before.select("block", *[F.col(f.name).alias(f"given_{f.name}") for f in found])
    out = T.StructType([T.StructField("seg", T.IntegerType()), *found])
    # one row per block
    ordered = placed.join(F.broadcast(given), "block", "left").repartition(size, "block").sortWithinPartitions("block", "seg", "chunk")
    return ordered.mapInArrow(_walked(kind, ["block", "seg"], out, "given_"), out).select("seg", "key", *[F.col(f"at_{n}").alias(n) for n, _ in kind.state])


def _composed(kind: Maps, schema: T.StructType) -> Callable:
    """One map per block of the maps of its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, None
        for row, m in kind.read(batches, ["block", "seg"]):
            if total is not None and row["block"] != block:
                yield kind.rows(total, (block,), schema)
                total = None
            block, total = row["block"], m if total is None else total.then(m)
        if total is not None:
            yield kind.rows(total, (block,), schema)

    return run


def _walked(kind: Maps, places: list[str], schema: T.StructType, given: str) -> Callable:
    """The state before each map that goes on with its key, walking from map to map; a block may bring one along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, block = None, None
        found: list[tuple] = []
        for row, m in kind.read(batches, places):
            if given and row["block"] != block:
                block = row["block"]
                values = [row[f"{given}{f.name}"] for f in schema.fields[1:]]
                state = kind.unpack(*values) if values[1] is not None else None
            if state is not None and state.key == m.first and (packed := kind.pack(state)) is not None:
                found.append((row[places[-1]], state.key, *packed))
            state = m.after(state)
        yield as_batch(found, schema)

    return run
