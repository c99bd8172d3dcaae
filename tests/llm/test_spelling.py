"""Spelling variants against a plain comparison of all words, and the index against edit distance."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from allelegate.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {ord(a): ord(b) for a, b in zip(sp.UPPER, sp.LOWER, strict=True)}


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, least=7, modulus=31, ratio=10):
    counts = collections.Counter()
    for id, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    out = {}
    for w, n in words.items():
        near = [v for v in words if is_near(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = [best if best and words[best] >= ratio * n else None, n, len(near)]
    found = []
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        found.append((w, form, root, n, near, words[form] if form else None))
    return sorted(found)


def variants(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, word string, n int, part int")
    return sorted(tuple(r) for r in sp.variants(df, **settings).collect())


def made(seed, docs, letters="abÀéz", size=(7, 9), often=300):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(*size))) for _ in range(often)]
    return [(i, " ".join(rng.choice(words[: 1 + int(rng.paretovariate(0.4)) % often]) for _ in range(rng.randrange(80)))) for i in range(docs)]


@pytest.mark.parametrize("block", [8192, 16])
def test_all_words(spark, block, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", block)
    monkeypatch.setattr(sp, "SHARED", 40)
    monkeypatch.setattr(sp, "AT_ONCE", 200)
    rows = made(1, 120) + made(2, 60, "aaab", (7, 14)) + made(3, 60, "Ab", (10, 12))
    want = brute(rows)
    assert sum(r[4] > 0 for r in want) > 100 and sum(r[1] is not None for r in want) > 20
    assert variants(spark, rows) == want


def test_large_groups_are_joined_too(spark, monkeypatch):
    monkeypatch.setattr(sp, "BLOCK", 16)
    monkeypatch.setattr(sp, "HOT_ROWS", 0)
    rows = made(5, 80, "ab", (7, 10))
    assert variants(spark, rows) == brute(rows)


def test_chains_of_forms(spark):
    base = "abcdefgh"
    chain = [(base + "x" * i, 2 * 10**i) for i in range(5)]
    rows = [(None, " ".join([w] * n)) for w, n in chain]
    got = variants(spark, rows, modulus=2**40)
    assert got == brute(rows, modulus=2**40)
    assert {r[2] for r in got} == {chain[-1][0]}


def test_odd_rows(spark):
    long = "a" * 5000
    rows = [(None, None), (1, ""), (2, "short words"), (3, f"{long} {long} {long}b {long}b"), (4, "Straße×÷ Straße×÷ straſses"), (5, "abcdefg " * 9), (5, "abcdefg " * 9), (None, "abcdefh " * 4)]
    assert variants(spark, rows) == brute(rows)
    assert variants(spark, []) == []
    assert variants(spark, rows[:3]) == []


words = st.text("abc", min_size=6, max_size=7)


@settings(max_examples=200, deadline=None)
@given(st.lists(words, min_size=1, max_size=70, unique=True), st.lists(words, min_size=1, max_size=10), st.booleans())
def test_index_is_edit_distance(stand, asks, last_half):
    m = 6
    index = sp.Index(stand, np.zeros(len(stand), np.int64), m)
    for size in (m, m + 1):
        some = [w for w in asks if len(w) == size]
        if some:
            found = index.near(sp.codes_of(some, m + 1), size, np.zeros(len(some), np.int64), last_half)
            for w, bits in zip(some, found, strict=True):
                got = {stand[i] for i in range(len(stand)) if bits[i // 64] >> np.uint64(i % 64) & np.uint64(1)}
                assert got == {v for v in stand if is_near(w, v) and m in (len(w), len(v)) and not (last_half and w[:3] == v[:3])}
