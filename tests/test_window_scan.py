"""Windows by a scan over maps: any bracketing, any cut, one key over all ranges, a fixed number of jobs."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from allelegate.operators.throttle import number_sorted, throttle_attempts
from allelegate.plans import window_scan as ws

WIDTH = 20


def walk(keys_times, seeds):
    """The window open after all attempts, one by one."""
    window = None
    for key, t in keys_times:
        if window is None or window.key != key:
            start, count = seeds.get(key, (None, 0))
            window = ws.Window(key, None if start is None else start + WIDTH, count)
        if window.until is None or t >= window.until:
            window = ws.Window(key, t + WIDTH, 1)
        else:
            window = ws.Window(key, window.until, window.count + 1)
    return window


def maps(ranges, seeds):
    out = []
    for rows in ranges:
        last = rows[-1][0]
        times = np.array([t for k, t in rows if k == last], "int64")
        out.append(ws.map_of(rows[0][0], last, times, WIDTH, *seeds.get(last, (None, 0))))
    return out


def bracketed(parts, rng):
    if len(parts) == 1:
        return parts[0]
    cut = rng.randrange(1, len(parts))
    return bracketed(parts[:cut], rng).then(bracketed(parts[cut:], rng))


attempts = st.lists(st.tuples(st.sampled_from(["a", "a", "a", "b", None]), st.integers(0, 90)), min_size=1, max_size=60)


@settings(max_examples=400, deadline=None)
@given(attempts, st.dictionaries(st.sampled_from(["a", "b", None]), st.tuples(st.integers(-30, 110), st.integers(1, 9))), st.randoms())
def test_any_bracketing_of_any_cut(rows, seeds, rng):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    cuts = sorted(rng.sample(range(1, len(rows)), min(len(rows) - 1, rng.randrange(8))))
    ranges = [rows[a:b] for a, b in itertools.pairwise([0, *cuts, len(rows)])]
    whole = walk(rows, seeds)
    parts = maps(ranges, seeds)
    for _ in range(3):
        assert bracketed(parts, rng).after(None) == whole
    window = None
    for m in parts:
        window = m.after(window)
    assert window == whole


def test_a_map_holds_one_window_length():
    times = np.arange(0, 100_000, 2)
    m = ws.map_of("a", "a", times, WIDTH, None, 0)
    assert len(m.breaks) <= WIDTH // 2 + 1
    total = m
    for k in range(1, 4):
        total = total.then(ws.map_of("a", "a", times + 100_000 * k, WIDTH, None, 0))
    assert len(total.breaks) <= WIDTH // 2 + 1


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_maps_as_rows(chunk, monkeypatch):
    from pyspark.sql import types as T

    monkeypatch.setattr(ws, "CHUNK", chunk)
    kind = ws.WindowMaps(T.StringType())
    given_maps = maps([[("a", t) for t in range(0, 60, 3)], [("a", 61), ("b", 2)], [("b", 9)]], {"b": (1, 4)})
    back = [m for _, m in kind.read(iter([kind.rows(m, (i,), kind.schema(["seg"])) for i, m in enumerate(given_maps)]), ["seg"])]
    for m, n in zip(given_maps, back, strict=True):
        assert (m.first, m.last, m.fresh, m.same, m.rows, m.limit) == (n.first, n.last, n.fresh, n.same, n.rows, n.limit)
        assert all((x == y).all() for x, y in ((m.breaks, n.breaks), (m.untils, n.untils), (m.counts, n.counts)))


def jobs(spark, group, work):
    """Spark jobs that `work` starts."""
    spark.sparkContext.setJobGroup(group, "")
    try:
        out = work()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_one_key_over_all_ranges(spark):
    """Steady attempts of one key: where a window opens depends on all ranges before, and no more jobs are run for that."""
    rng = random.Random(5)
    steady = sorted(rng.randrange(40_000) for _ in range(3000))
    made = lambda seconds, keys: spark.createDataFrame(
        [(keys[i % len(keys)], i, t) for i, t in enumerate(seconds)], "key string, id int, s bigint"
    ).select("key", "id", F.timestamp_seconds("s").alias("ts"))
    one = made(steady, ["a"])
    found, many = jobs(spark, "one", lambda: throttle_attempts(one, "key", "ts", ["id"], segments=25).collect())
    starts, numbers, _, _ = number_sorted(np.array(steady), 900, None, 0)
    got = {r["id"]: (int(r["window_start"].timestamp()), r["attempt_no"]) for r in found}
    assert got == {i: (int(s), int(n)) for i, (s, n) in enumerate(zip(starts, numbers, strict=True))}
    # the same cut with every range a key of its own
    _, few = jobs(spark, "many", lambda: throttle_attempts(made(steady, [f"k{i}" for i in range(25)]), "key", "ts", ["id"], segments=25).collect())
    assert many == few
