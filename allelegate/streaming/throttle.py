"""Throttling on a stream of attempts: one (start, count) of state per key.

`throttle_stream` keeps the state in Spark's state store, where a timer forgets a window that no attempt can fall
into any more.  One task sees all rows that a key has in a micro-batch, but it holds few of them: they arrive batch by
batch, sorted runs go to the state store, and the runs are read back piece by piece in time order.
`throttle_batches` keeps the state as a table and decides each micro-batch by
the batch operator, which splits a key of any size.
"""

from __future__ import annotations

import bisect
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from allelegate.operators.throttle import (
    MAX_ATTEMPTS,
    WINDOW_SECONDS,
    last_windows,
    number_sorted,
    throttle_attempts,
)
from allelegate.sources.tables import version_before


# Fixed value: how long a key without attempts is remembered by default.
KEEP_SECONDS = 24 * 3600
#: Rows of a key that are sorted at once, and rows of a run that are read back at once.
RUN, PIECE = 50_000, 1_000
#: The state store that the processor needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Numbering(StatefulProcessor):
    """Numbers a key's attempts in time order and keeps its open window.

    Rows are (place, row): time and order columns, and all columns of the attempt.
    """

    def __init__(self, width: int, run: int, piece: int):
        self.width, self.run, self.piece = width, run, piece

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start bigint, count bigint")
        # sorted runs of this micro-batch only; pieces leave as they are read
        self.runs = handle.getMapState("runs", "run int, piece int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, count = self.window.get() if self.window.exists() else (None, 0)
        held: list[tuple] = []
        pieces: list[int] = []
        for batch in rows:
            none = batch["us"].isna()
            if none.any():
                yield pd.DataFrame({"row": batch["row"][none], "us": None, "start": None, "attempt_no": None})
                batch = batch[~none]
            orders = [batch[c] for c in batch.columns if c[0] == "o"]
            places = zip(batch["us"].astype("int64"), *(map(_nulls_first, c) for c in orders), strict=True)
            held += zip(places, batch["row"], strict=True)
            if len(held) >= self.run:
                pieces.append(self._put(len(pieces), held))
                held = []
        if pieces and held:
            pieces.append(self._put(len(pieces), held))
            held = []
        for part in self._merged(pieces) if pieces else [sorted(held, key=_first)] if held else []:
            times = np.array([p[0] for p, _ in part], "int64")
            starts, numbers, start, count = number_sorted(times, self.width, start, count)
            yield pd.DataFrame({"row": [r for _, r in part], "us": times, "start": starts, "attempt_no": numbers})
        if start is not None:
            self.window.update((start, count))
            self.handle.registerTimer(max(self._over(start), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # an earlier window's timer finds a later window
        if self.window.exists() and self._over(self.window.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _over(self, start: int) -> int:
        """First millisecond after a window."""
        return (start + self.width) // 1000 + 1

    def _put(self, run: int, rows: list[tuple]) -> int:
        """A sorted run into the state store; the number of its pieces."""
        rows = sorted(rows, key=_first)
        cuts = range(0, len(rows), self.piece)
        for piece, at in enumerate(cuts):
            self.runs.updateValue((run, piece), (pickle.dumps(rows[at : at + self.piece]),))
        return len(cuts)

    def _merged(self, pieces: list[int]) -> Iterator[list[tuple]]:
        """All rows in order, from one piece per run at a time."""
        ahead = [iter(range(n)) for n in pieces]
        open_runs: dict[int, list[tuple]] = {}
        waiting = set(range(len(pieces)))
        while True:
            for run in waiting:
                piece = next(ahead[run], None)
                if piece is not None:
                    open_runs[run] = pickle.loads(self.runs.getValue((run, piece))[0])
                    self.runs.removeKey((run, piece))
            waiting = set()
            if not open_runs:
                return
            # no later piece holds anything before here
            bound = min(rows[-1][0] for rows in open_runs.values())
            taken: list[tuple] = []
            for run, rows in list(open_runs.items()):
                n = bisect.bisect_right(rows, bound, key=_first)
                taken += rows[:n]
                if n == len(rows):
                    del open_runs[run]
                    waiting.add(run)
                else:
                    open_runs[run] = rows[n:]
            yield sorted(taken, key=_first)


def _nulls_first(value) -> tuple:
    return (False, 0) if pd.isna(value) else (True, value)


def _first(row: tuple) -> tuple:
    return row[0]


def _as_text(field: T.StructField):
    """A column's values as text that `_from_text` turns back, and pandas leaves alone."""
    kind, column = field.dataType, F.col(field.name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.base64(column)
    return F.to_json(F.struct(column.alias("v"))) if isinstance(kind, T.ArrayType | T.MapType | T.StructType) else column.cast("string")


def _from_text(field: T.StructField, text):
    kind = field.dataType
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    if isinstance(kind, T.BinaryType):
        return F.unbase64(text)
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.from_json(text, T.StructType([T.StructField("v", kind)]))["v"]
    return text.cast(kind)


def throttle_stream(
    attempts: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    window_seconds: int = WINDOW_SECONDS,
    maximum: int = MAX_ATTEMPTS,
    watermark: str = "1 day",
    run: int = RUN,
    piece: int = PIECE,
) -> DataFrame:
    """Stream form of `throttle_attempts`, with the same columns.

    Attempts of a key are taken in time order inside a micro-batch; across micro-batches in the order they arrive,
    so an attempt older than the open window counts in it.  Attempts later than `watermark` are dropped, and a window
    that lies before it is forgotten: no attempt can fall into it any more.  `run` rows of a key are sorted at once, and
    `piece` rows of each run are read back at once.  Columns travel as texts, so no value changes on the way; `us`,
    `start` and `attempt_no` are no names of theirs.  Sets the session's state store, which must be STORE.
    """
    width = window_seconds * 1_000_000
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.col(ts).cast("timestamp")
    timed = attempts.withColumns({"_us": F.unix_micros(at), "_at": at}).withWatermark("_at", watermark)
    fields = attempts.schema.fields
    # whole numbers with nulls among them would be floats in pandas
    exact = [F.col(c).cast("decimal(20,0)") if isinstance(timed.schema[c].dataType, T.LongType) else F.col(c) for c in order]
    packed = timed.select(
        F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string"))).alias("key"),
        F.col("_at").alias("at"),
        F.col("_us").alias("us"),
        *[c.alias(f"o{i}") for i, c in enumerate(exact)],
        F.array(*map(_as_text, fields)).alias("row"),
    )
    schema = "row array<string>, us long, start long, attempt_no long"
    numbered = packed.groupBy("key").transformWithStateInPandas(_Numbering(width, run, piece), schema, "append", "eventTime")
    numbered = numbered.select(*[_from_text(f, F.col("row")[i]).alias(f.name) for i, f in enumerate(fields)], "us", "start", "attempt_no")
    back = F.make_dt_interval(secs=((F.col("us") - F.col("start")) / 1_000_000).cast("decimal(18,6)"))
    return numbered.select(
        *attempts.columns,
        (F.col(ts) - back).alias("window_start"),
        "attempt_no",
        F.coalesce(F.col("attempt_no") > maximum, F.lit(False)).alias("throttled"),
    )


def throttle_batches(
    attempts: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    root: str,
    checkpoint: str,
    window_seconds: int = WINDOW_SECONDS,
    maximum: int = MAX_ATTEMPTS,
    keep_seconds: int = KEEP_SECONDS,
    **trigger,
) -> StreamingQuery:
    """Numbered attempts under `root`/attempts, one folder per micro-batch, open windows beside them.

    A batch reads the windows of the batch before and writes its own version, so running it again gives the
    same files.  Windows that opened `keep_seconds` before the newest attempt seen are dropped.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, f"{number:010d}"
        before = version_before(spark, root, "windows", version)
        windows = spark.read.parquet(f"{root}/windows/version={before}") if before else None
        numbered = throttle_attempts(batch, key, ts, order, window_seconds, maximum, windows)
        numbered.write.mode("overwrite").parquet(f"{root}/attempts/batch={version}")
        # Read back, so that the attempts are numbered once.
        done = spark.read.schema(numbered.schema).parquet(f"{root}/attempts/batch={version}")
        last_windows(done, key, windows, max(keep_seconds, window_seconds)).write.mode("overwrite").parquet(f"{root}/windows/version={version}")

    return (
        attempts.writeStream.foreachBatch(decide)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
