"""Classifier and weak supervision: held-out accuracy, counts against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from allelegate.llm import quality, weak_rules

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    marks = {r["doc_id"]: r["quality"] for r in labels.collect() if got[r["doc_id"]]["held_out"]}
    right = Counter((q, got[i]["predicted"] == q) for i, q in marks.items())
    assert right[1, True] >= 0.97 * (right[1, True] + right[1, False])
    assert right[0, True] >= 0.7 * (right[0, True] + right[0, False])


def test_labels_that_are_held_out_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", (labels.quality - quality.held_out("doc_id").cast("int")) * (labels.quality - quality.held_out("doc_id").cast("int")))
    a, b = (sorted(map(tuple, quality.scored(docs, x).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_odd_rows(spark):
    rows = [(1, "good words here"), (1, "good words here"), (None, None), (2, ""), (3, "bad " * 400_000)]
    docs = spark.createDataFrame([(*r, 1.5, 7) for r in rows], "doc_id long, text string, score double, predicted int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.scored(docs, none).collect()] == [0.5] * 5
    labels = spark.createDataFrame([(2, 1), (2, 1), (3, None), (None, 0), (1, 0)], "doc_id long, quality int")
    got = quality.scored(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_context_vectors(spark):
    """Sums of neighbours' index vectors, whatever the slices."""
    text = " ".join(f"t{i % 7}" for i in range(50))
    buckets, (places, dense) = quality.Buckets(), quality.index_vectors()
    tokens = next(buckets.slices(text))
    want = np.zeros((quality.BUCKETS, quality.DIM))
    for i, t in enumerate(tokens):
        for j in range(max(0, i - 2), min(len(tokens), i + 3)):
            if j != i:
                want[t] += dense[tokens[j]]
    got = np.zeros(quality.BUCKETS * quality.DIM, np.int64)
    quality._add_context(got, tokens, places)
    assert (got.reshape(want.shape) == want).all()


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


def test_base_counts_and_verdicts(spark):
    rnd = random.Random(2)
    texts = [None, "", " \n ", "a b c a b c a b c", "x\nx\n\n\nx \n<#*|>", "\x0b\x1c\x85\xa0 a\xa0b ÄÖ", "one two three " * 60]
    texts += ["\n".join(" ".join(rnd.choice("ab cd. ef| G!! %% the".split(" ")) for _ in range(9)) for _ in range(8)) for _ in range(40)]
    texts += [" ".join(f"word{rnd.randrange(500)}" for _ in range(120)) + "." for _ in range(120)]
    texts += [" ".join(f"x{rnd.randrange(500)}%%% |" for _ in range(120)) for _ in range(15)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, texts[-1], 5)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in weak_rules.judged(docs).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        want = base_counts(t)
        assert tuple(got[i][c] for c in weak_rules.COUNTS[:5]) == want, t
        assert got[i]["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    n = len(texts)
    assert all(got[i]["kept"] for i in range(n - 135, n - 15)) and not any(got[i]["kept"] for i in range(n - 15, n))
    assert weak_rules.judged(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [0, 1])
def test_rules_keep_good_documents_of_the_labels(spark, kind):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = weak_rules.judged(docs).join(labels.where(f"quality = {kind}"), "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == bool(kind) for r in rows) >= 0.97 * len(rows) > 10
