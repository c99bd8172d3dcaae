"""Throttling on streams: the state processor against a loop, with runs in the state store, and forgotten windows."""

import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from allelegate.operators.throttle import number_sorted
from allelegate.plans.session import scratch_path
from allelegate.streaming import throttle as st


def streamed(spark, slices, **settings):
    """Rows of all slices, each streamed as one micro-batch."""
    path, out, log = (scratch_path(spark, n) for n in ("attempts", "throttled", "throttled-log"))
    for rows in slices:
        df = spark.createDataFrame(rows, "key string, id int, s bigint, big bigint").select("key", "id", F.timestamp_seconds("s").alias("ts"), "big")
        df.write.mode("append").parquet(path)
        stream = st.throttle_stream(spark.readStream.schema(df.schema).parquet(path), "key", "ts", ["id"], **settings)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return {r["id"]: (r["w"], r["attempt_no"], r["throttled"], r["big"]) for r in spark.read.parquet(out).select("*", F.unix_seconds("window_start").alias("w")).collect()}


def looped(slices, width=900, maximum=5):
    """Slice after slice, each key in order."""
    out, open_windows = {}, {}
    for rows in slices:
        keys = {r[0] for r in rows}
        for key in keys:
            own = sorted((r for r in rows if r[0] == key and r[2] is not None), key=lambda r: (r[2], r[1]))
            if own:
                starts, numbers, *window = number_sorted(np.array([r[2] for r in own]), width, *open_windows.get(key, (None, 0)))
                open_windows[key] = window
                out |= {r[1]: (int(s), int(n), bool(n > maximum), r[3]) for r, s, n in zip(own, starts, numbers, strict=True)}
        out |= {r[1]: (None, None, False, r[3]) for r in rows if r[2] is None}
    return out


def made(seed, sizes):
    rng, slices, id = random.Random(seed), [], 0
    for n, base in sizes:
        rows = []
        for _ in range(n):
            id += 1
            rows.append((rng.choice(["hot", "hot", "hot", "b", None]), id, 100_000 + base + rng.choice([0, 1000, 3000]) + rng.randrange(900), 2**53 + 1 if id % 3 else None))
        slices.append(rows)
    slices[0].append(("b", 10_000, None, 5))
    return slices


@pytest.mark.parametrize(("run", "piece"), [(50_000, 1_000), (40, 7)])
def test_runs_of_any_size(spark, run, piece):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        slices = made(run, [(200, 0), (120, 4500)])
        assert streamed(spark, slices, run=run, piece=piece) == looped(slices)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


class Memory(dict):
    """A state store's value or map in memory, which counts what it holds at most."""

    most = 0

    def exists(self):
        return "v" in self

    def get(self, key=None):
        return self["v"] if key is None else dict.get(self, key)

    def update(self, value):
        self["v"] = value

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        Memory.most = max(Memory.most, len(self))

    def removeKey(self, key):
        del self[key]


class Handle:
    def __init__(self):
        self.window, self.runs, self.timers = Memory(), Memory(), []

    def getValueState(self, name, schema):
        return self.window

    def getMapState(self, name, key, value):
        return self.runs

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_a_key_holds_one_run_or_one_piece_per_run(monkeypatch):
    rng = random.Random(1)
    times = [rng.choice([7, rng.randrange(10_000)]) for _ in range(1000)]
    rows = [(times[i], None if i % 9 == 0 else Decimal(i), [str(i)]) for i in range(1000)]
    frames = [pd.DataFrame(rows[a : a + 10], columns=["us", "o0", "row"]) for a in range(0, 1000, 10)]
    handle, processor = Handle(), st._Numbering(100, 50, 5)
    processor.init(handle)
    sizes, merged = [], processor._merged
    monkeypatch.setattr(processor, "_merged", lambda pieces: (sizes.append(len(part)) or part for part in merged(pieces)))
    found = []
    for out in processor.handleInputRows(("hot",), iter(frames), Clock(0)):
        found += list(zip((int(r[0]) for r in out["row"]), out["start"], out["attempt_no"], strict=True))
    order = sorted(range(1000), key=lambda i: (times[i], i % 9 != 0, i if i % 9 else 0))
    starts, numbers, start, count = number_sorted(np.array([times[i] for i in order]), 100, None, 0)
    assert sorted((s, n) for _, s, n in found) == sorted((int(s), int(n)) for s, n in zip(starts, numbers, strict=True))
    assert [(times[i], i % 9 != 0) for i, _, _ in found] == [(times[i], i % 9 != 0) for i in order]
    assert max(sizes) <= 5 * 20 and not handle.runs and Memory.most == 200
    assert handle.window["v"] == (start, count)


def test_timers_forget_windows():
    handle, processor = Handle(), st._Numbering(1_000_000, 50, 5)
    processor.init(handle)
    handle.window["v"] = (5_000_000, 3)
    list(processor.handleExpiredTimer(("a",), Clock(0), Clock(4_000)))
    assert handle.window["v"] == (5_000_000, 3)
    list(processor.handleExpiredTimer(("a",), Clock(0), Clock(6_001)))
    assert not handle.window.exists()


def test_old_windows_leave_the_state(spark):
    """A window that the watermark has passed is gone, so the key starts anew."""
    day = 86_400
    slices = [[("a", 1, 1, 1), ("a", 2, 10, 1)], [("b", 3, 5 * day, 1)], [("b", 4, 5 * day + 1, 1)], [("a", 5, 9 * day, 1)]]
    assert streamed(spark, slices, watermark="1 hour") == looped(slices)
