"""Ordered work on hot keys gives the same answers as plain windows."""

import random

import pytest
from pyspark.sql import functions as F

from allelegate.operators.throttle import last_windows, number_sorted, throttle_attempts
from allelegate.plans.skew import with_position, with_prior


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(600):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        data.append((key, rng.randrange(50), i, rng.choice([None, None, True, False])))
    data += [(None, 1, 1000 + i, True) for i in range(5)]
    return spark.createDataFrame(data, "k string, o int, id int, v boolean")


@pytest.mark.parametrize("segments", [1, 3, 7, 60])
def test_position_and_prior_match_a_loop(skewed, segments):
    state, position, prior = {}, {}, {}
    for r in sorted(skewed.collect(), key=lambda r: (r.o, r.id)):
        count, last = state.get(r.k, (0, None))
        position[r.id], prior[r.id] = count + 1, last
        state[r.k] = (count + 1, last if r.v is None else r.v)
    got = with_position(skewed, ["k"], ["o", "id"], segments=segments)
    assert {r.id: r.position for r in got.collect()} == position
    got = with_prior(skewed, ["k"], ["o", "id"], "v", "p", segments=segments)
    assert {r.id: r.p for r in got.collect()} == prior


def loop(times, width, maximum):
    start, count, out = None, 0, []
    for t in times:
        if start is None or t - start >= width:
            start, count = t, 1
        else:
            count += 1
        out.append((start, count, count > maximum))
    return out


def test_number_sorted_matches_a_loop():
    rng = random.Random(1)
    times = sorted(rng.randrange(5000) for _ in range(400))
    import numpy as np

    values = np.array(times, dtype="int64")
    starts, numbers, _, _ = number_sorted(values, 97, None, 0)
    assert [(s, n) for s, n in zip(starts, numbers)] == [(s, n) for s, n, _ in loop(times, 97, 5)]


@pytest.mark.parametrize("segments", [1, 4, 40])
def test_throttle_matches_a_loop_in_any_cut(spark, segments):
    rng = random.Random(3)
    data, expected = [], {}
    for key in ["a", "b", "c", None]:
        size = {"a": 300, "b": 60}.get(key, 8)
        # Bursts, idle gaps and equal times.
        seconds = sorted(rng.choice([0, 4000, 90_000]) + rng.randrange(3000) for _ in range(size))
        for i, (t, said) in enumerate(zip(seconds, loop(seconds, 900, 5))):
            data.append((key, f"{key}{i:04d}", t, 2**53 + 1 if i % 3 else None))
            expected[f"{key}{i:04d}"] = said
    rng.shuffle(data)
    attempts = spark.createDataFrame(data, "key string, id string, s bigint, big bigint").select(
        "key", "id", F.timestamp_seconds("s").alias("ts"), "big"
    )
    got = throttle_attempts(attempts, "key", "ts", ["id"], segments=segments)
    found = got.select("id", F.unix_seconds("window_start").alias("w"), "attempt_no", "throttled", "big").collect()
    assert {r.id: (r.w, r.attempt_no, r.throttled) for r in found} == expected
    assert {r.id: r.big for r in found} == {r[1]: r[3] for r in data}


@pytest.mark.parametrize("segments", [1, 5])
def test_null_numbers_are_one_key_and_timeless_attempts_none(spark, segments):
    data = [(None, i, 600 * i) for i in range(5)] + [(1, 10, None), (1, 11, 5), (None, 12, None)]
    attempts = spark.createDataFrame(data, "key bigint, id int, s bigint").select("key", "id", F.timestamp_seconds("s").alias("ts"))
    got = throttle_attempts(attempts, "key", "ts", ["id"], segments=segments)
    found = {r.id: (r.w, r.attempt_no, r.throttled) for r in got.select("id", F.unix_seconds("window_start").alias("w"), "attempt_no", "throttled").collect()}
    assert found == {i: (1200 * (i // 2), i % 2 + 1, False) for i in range(5)} | {10: (None, None, False), 11: (5, 1, False), 12: (None, None, False)}


def test_sixth_attempt_is_throttled(spark):
    data = [("x", i, i) for i in range(6)] + [("x", 6, 900)]
    attempts = spark.createDataFrame(data, "key string, id int, s bigint").select(
        "key", "id", F.timestamp_seconds("s").alias("ts")
    )
    got = {r.id: r.throttled for r in throttle_attempts(attempts, "key", "ts", ["id"]).collect()}
    assert got == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True, 6: False}


@pytest.mark.parametrize("segments", [1, 9])
def test_open_windows_carry_over(spark, segments):
    rng = random.Random(9)
    seconds = sorted(rng.randrange(6000) for _ in range(80))
    data = [("a", i, t) for i, t in enumerate(seconds)] + [("b", 200, 10), ("b", 201, 950)]
    df = spark.createDataFrame(data, "key string, id int, s bigint").select("key", "id", F.timestamp_seconds("s").alias("ts"))
    whole = throttle_attempts(df, "key", "ts", ["id"]).collect()
    first = throttle_attempts(df.where("ts < timestamp_seconds(3000)"), "key", "ts", ["id"], segments=segments)
    windows = last_windows(first, "key")
    rest = throttle_attempts(
        df.where("ts >= timestamp_seconds(3000)"), "key", "ts", ["id"], segments=segments, open_windows=windows
    )
    assert sorted(first.collect() + rest.collect()) == sorted(whole)
    assert last_windows(rest, "key", windows).count() == 2
