"""Attempts per key in windows that open at an attempt.

The first attempt opens a window; the first attempt at or after its end opens
the next.  Where a window starts depends on the one before, so tumbling or
session windows do not fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from allelegate.functions.text import match_key
from allelegate.plans.session import scratch_path
from allelegate.plans.range_scan import entering_states
from allelegate.plans.skew import in_order, in_ranges, segment_count
from allelegate.plans.window_scan import WindowMaps, map_of

# Window length and maximum of sign-ins and of registrations.
WINDOW_SECONDS = 15 * 60
MAX_ATTEMPTS = 5

def throttle_key(action: str, ip: str, subject: str | None):
    """Key of a sign-in (with subject) or of a registration (one subject per address)."""
    who = match_key(subject) if subject else F.lit("registration")
    address = F.coalesce(F.nullif(F.col(ip), F.lit("")), F.lit("unknown"))
    return F.concat(F.lit(f"{action}:"), address, F.lit(":"), who)


def throttle_attempts(
    attempts: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    window_seconds: int = WINDOW_SECONDS,
    maximum: int = MAX_ATTEMPTS,
    open_windows: DataFrame | None = None,
    segments: int | None = None,
) -> DataFrame:
    """Each attempt with its window start, its number in the window and `throttled`.

    `order` breaks ties of equal times.  Attempts are cut into ranges of (key, time), so a key of any size is
    spread over tasks, at least as many as bounded ranges need.
    A range needs one thing from the one before it: the window that its first key has open.  Each range gives a map
    from that window to the one it leaves open, a scan composes the maps (`plans.window_scan`), and then all ranges
    are numbered at once.  The number of Spark jobs is the same for any data.

    `open_windows` (the key, `start_us`, `count`) holds the last window of keys seen before.  A null key is one
    key; an attempt without time has no window, no number and is not throttled.  Columns pass through as Arrow
    arrays, unchanged.
    """
    width = window_seconds * 1_000_000
    timed = attempts.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    if open_windows is None:
        seeded = timed.withColumns({"_seed": F.lit(None).cast("bigint"), "_seen": F.lit(0).cast("bigint")})
    else:
        seeds = open_windows.select(F.col(key).alias("_k"), F.col("start_us").alias("_seed"), F.col("count").alias("_seen"))
        seeded = timed.join(seeds, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k").withColumn("_seen", F.coalesce("_seen", F.lit(0)))
    segments = segments or segment_count(attempts)
    cut = in_ranges(seeded, [key], ["_us", *order], segments)
    sort = [key, "_us", *order]
    entering = _entering(cut, sort, width, segments)
    numbered = cut.groupBy("_seg").applyInArrow(_numbering(sort, width, entering), _numbered_schema(cut.schema))
    back = F.make_dt_interval(secs=((F.col("_us") - F.col("_start")) / 1_000_000).cast("decimal(18,6)"))
    return numbered.select(
        *attempts.columns,
        (F.col(ts) - back).alias("window_start"),
        "attempt_no",
        F.coalesce(F.col("attempt_no") > maximum, F.lit(False)).alias("throttled"),
    )


def last_windows(numbered: DataFrame, key: str, open_windows: DataFrame | None = None, keep_seconds: int | None = None) -> DataFrame:
    """The open window of each key after `numbered`, to go on from with the next attempts.

    With `keep_seconds`, windows that opened longer than that before the newest one are left out.
    """
    start = F.unix_micros(F.col("window_start").cast("timestamp"))
    new = numbered.where("attempt_no is not null").select(key, start.alias("start_us"), F.col("attempt_no").alias("count"))
    if open_windows is not None:
        new = new.unionByName(open_windows.select(*new.columns))
    last = new.groupBy(key).agg(F.max(F.struct("start_us", "count")).alias("w"))
    last = last.select(key, "w.start_us", "w.count")
    if keep_seconds is None:
        return last
    newest = last.agg(F.max("start_us").alias("_newest"))
    recent = last.join(F.broadcast(newest), F.col("start_us") >= F.col("_newest") - keep_seconds * 1_000_000)
    return recent.drop("_newest")


def number_sorted(values: np.ndarray, width: int, start: int | None, count: int):
    """Window starts and numbers of sorted times; `start` and `count` are the open window."""
    starts = np.empty(len(values), dtype="int64")
    numbers = np.empty(len(values), dtype="int64")
    at = 0
    while at < len(values):
        if start is None or values[at] - start >= width:
            start, count = int(values[at]), 0
        end = at + int(np.searchsorted(values[at:], start + width, side="left"))
        starts[at:end] = start
        numbers[at:end] = np.arange(count + 1, count + 1 + end - at)
        count += end - at
        at = end
    return starts, numbers, start, count


def _numbered_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_start", T.LongType()), T.StructField("attempt_no", T.LongType())])


def _number_range(table: pa.Table, cuts: list[int], width: int, entering: tuple[int, int] | None):
    """Starts, numbers (0: no time) and the last key's open window of a range in order."""
    times = table.column("_us").combine_chunks()
    timeless = times.is_null().to_numpy(zero_copy_only=False)
    times = pc.fill_null(times, 0).to_numpy(zero_copy_only=False)
    starts, numbers = np.zeros(len(times), "int64"), np.zeros(len(times), "int64")
    start, count = None, 0
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        start, count = table.column("_seed")[a].as_py(), table.column("_seen")[a].as_py()
        if k == 0 and entering is not None:
            start, count = entering
        a += int(timeless[a:b].sum())  # attempts without time come first
        starts[a:b], numbers[a:b], start, count = number_sorted(times[a:b], width, start, count)
    return starts, numbers, start, count


def _numbering(sort: list[str], width: int, entering: dict[int, tuple[int, int]]):
    def number(group: tuple, table: pa.Table) -> pa.Table:
        table, cuts = in_order(table, sort)
        starts, numbers, _, _ = _number_range(table, cuts, width, entering.get(group[0].as_py()))
        none = numbers == 0
        return table.append_column("_start", pa.array(starts, mask=none)).append_column("attempt_no", pa.array(numbers, mask=none))

    return number


def _maps(sort: list[str], width: int, kind: WindowMaps, schema: T.StructType):
    """The window map of each range."""

    def make(group: tuple, table: pa.Table) -> pa.Table:
        table, cuts = in_order(table, sort)
        keys, a = table.column(sort[0]), cuts[-2]
        times = table.column("_us")[a:].drop_null().to_numpy()
        found = map_of(keys[0].as_py(), keys[-1].as_py(), times, width, table.column("_seed")[a].as_py(), table.column("_seen")[a].as_py())
        return pa.Table.from_batches([kind.rows(found, (group[0].as_py(),), schema)])

    return make


def _entering(cut: DataFrame, sort: list[str], width: int, ranges: int) -> dict[int, tuple[int, int]]:
    """The window that is open where each range begins, for ranges whose first key goes on from the one before.

    The number of passes does not depend on the data, and the driver sees one row per range.
    """
    spark, kind = cut.sparkSession, WindowMaps(cut.schema[sort[0]].dataType)
    schema, path = kind.schema(["seg"]), scratch_path(spark, "window_maps")
    cut.select("_seg", *sort, "_seed", "_seen").groupBy("_seg").applyInArrow(_maps(sort, width, kind, schema), schema).write.parquet(path)
    maps = spark.read.schema(schema).parquet(path)
    return {r["seg"]: (r["until"] - width, r["count"]) for r in entering_states(maps, ranges, kind).collect()}
