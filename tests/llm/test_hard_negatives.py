"""Hard negatives against all pairs, with odd rows, ties, repeated rows and numbers past exact doubles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelegate.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, row string, part int"


def brute(rows, every=50, positives=5, negatives=3):
    good = []
    for i, (id, label, v, *_) in enumerate(rows):
        if id is None or label is None or v is None or any(x is None or not math.isfinite(x * 256) for x in v):
            continue
        good.append((i, id, label, [math.floor(x * 256) for x in v]))
    out = []
    for i, id, label, v in good:
        if id % every:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, k, other) for k, j, other, w in good if k != i)
        for ps, pid, _, _ in [s for s in scores if s[3] == label][:positives]:
            found = [s for s in scores if s[3] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:negatives]
            out += [(id, pid, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(found)]
    return sorted(out)


def mined(spark, rows, every=50, **settings):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in hn.mined(df, lambda id: id % every == 0, **settings).collect())


def made(seed, n, d, size=1.0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(4)), [float(x) for x in rng.normal(size=d) * size], "x", 7) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "part"), [(400, 6, 16384), (700, 3, 90), (300, 1, 50)])
def test_all_pairs(spark, n, d, part, monkeypatch):
    monkeypatch.setattr(hn, "ASK", 7)
    rows = made(n, n, d)
    assert mined(spark, rows, 10, part=part) == brute(rows, 10)


def test_ties_hot_copies_and_repeats(spark):
    rows = made(1, 200, 2)
    rows += [(1000 + i, i % 2, [0.5, 0.25], "x", 7) for i in range(150)]
    rows += [(50, 0, [0.5, 0.5], "x", 7)] * 3 + [(2000 + i, 3, [0.4, 0.4], "y", 7) for i in range(5)]
    assert mined(spark, rows, part=64) == brute(rows)


def test_odd_rows(spark):
    rows = made(2, 120, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(None, 1, [9.0] * 3, None, None), (200, None, [9.0] * 3, "", 1), (201, 1, None, "", 1), (202, 1, [9.0, None, 9.0], "", 1)]
    rows += [(203, 1, [nan] * 3, "", 1), (204, 2, [inf] * 3, "", 1), (250, 1, [], "", 1), (300, 1, [2.0], "", 1), (205, 2, [1.0, 1.0, 1.0, 5.0], "", 1)]
    assert mined(spark, rows, part=40) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, rows[:1]) == []


def test_numbers_past_exact_doubles(spark):
    rows = made(3, 120, 2, 2.0**20)
    assert mined(spark, rows, part=50) == brute(rows)


def test_boxes_leave_out_most_leaves():
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(8192, 2)) * 256)
    ids = np.arange(8192)
    tree = hn.Tree(ids, ids, ids % 3, v, [0, 1], leaf=16)
    q = np.array([[200.0, 40.0]])
    least, most = tree.intervals(q)
    scores = tree.v @ q[0]
    for node, (a, b) in enumerate(tree.spans[: tree.leaves]):
        assert least[0, node] <= scores[a:b].min() and scores[a:b].max() <= most[0, node]
    asked = []
    for low, high in [(None, None), (20000.0, 40000.0)]:
        asked.clear()
        found = tree.best(least[0], most[0], 5, lambda n: asked.append(n) or tree.leaf(q[0], n, 1, True, -1), low, high)
        ok = sorted((-s, i, i) for s, i in zip(tree.v @ q[0], tree.ids, strict=True) if i % 3 == 1 and (low is None or low <= s <= high))[:5]
        assert [tuple(f) for f in found] == ok
        assert len(asked) < tree.leaves / 8


def test_extra_columns_and_kinds(spark):
    rows = made(5, 100, 2)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"v": F.lit(1), "id": F.lit("a"), "embedding": F.col("embedding").cast("array<float>")})
    got = sorted(tuple(r) for r in hn.mined(df, lambda id: id % 50 == 0).collect())
    assert got == brute([(r[0], r[1], [float(np.float32(x)) for x in r[2]]) for r in rows])
