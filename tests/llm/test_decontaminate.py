"""Leaks that are planted in small tables, and the alignment against a plain one."""

import random

import numpy as np

from allelegate.llm import decontaminate as d


def plain_score(item, text):
    table = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (d.MATCH if a == b else d.MISS), table[i - 1][j] + d.GAP, table[i][j - 1] + d.GAP)
    return max(map(max, table))


def test_alignment():
    rnd = np.random.default_rng(3)
    items = [rnd.integers(1, 6, rnd.integers(1, 30)).astype(np.uint64) for _ in range(80)]
    texts = [rnd.integers(1, 6, rnd.integers(1, 90)).astype(np.uint64) for _ in range(80)]
    scores = d.best_scores(items, texts)
    assert list(scores) == [plain_score(list(a), list(b)) for a, b in zip(items, texts, strict=True)]
    for item, text, score in zip(items, texts, scores, strict=True):
        start, stop, equal = d.span(item, text)
        assert plain_score(list(item), list(text[start:stop])) == score and equal <= stop - start


def words(rnd, n):
    return [f"w{int(rnd.paretovariate(0.4)) % 5000}" for _ in range(n)]


def tables(spark):
    rnd = random.Random(6)
    items = [(i, words(rnd, rnd.randrange(20, 50))) for i in range(30)]
    rows, planted = [], set()
    for k in range(300):
        text = words(rnd, rnd.randrange(30, 300))
        if k % 3 == 0:
            i, own = items[0 if k % 2 else k % 30]
            own = list(own)
            if k % 4 == 1:  # every fifth word replaced
                own = [f"q{k}" if j % 5 == 4 else x for j, x in enumerate(own)]
            if k % 4 == 2:  # words added
                own = [y for j, x in enumerate(own) for y in ([x, "extra"] if j % 6 == 5 else [x])]
            if k % 4 == 3:  # the first three quarters
                own = own[: 3 * len(own) // 4]
            text[10:10] = own
            planted.add((k, i))
        rows.append((k, " ".join(text).capitalize() + ".", "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "one two", "x"), (None, ", ".join(items[3][1]).upper(), "x"), (903, rows[0][1], "x"), (903, rows[0][1], "x")]
    bench = [(i, " ".join(w), 1) for i, w in items] + [(90, None, 1), (91, "", 1), (92, "w1 w2", 1), (None, " ".join(items[5][1]), 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id string"), spark.createDataFrame(bench, "item_id long, text string, doc_id long"), planted


def test_planted_leaks(spark):
    docs, bench, planted = tables(spark)
    rows = d.leaks(docs, bench).collect()
    got = [(r["doc_id"], r["item_id"]) for r in rows]
    first = next(i for k, i in planted if k == 0)
    five = {(k, None) for k, i in planted if i == 5}
    assert set(got) == planted | five | {(None, 3), (903, first)}
    assert got.count((903, first)) == 2
    assert all(r["similarity"] == 1.0 for r in rows if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 4 == 0)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    docs, bench, _ = tables(spark)
    whole = sorted(map(tuple, d.leaks(docs, bench).collect()), key=repr)
    clean = sorted(map(tuple, d.decontaminated(docs, bench).collect()), key=repr)
    monkeypatch.setattr(d, "BLOCK_WORDS", 400)
    assert len(list(d.blocks(bench, "item_id", "text"))) > 2
    assert sorted(map(tuple, d.leaks(docs, bench).collect()), key=repr) == whole
    assert sorted(map(tuple, d.decontaminated(docs, bench).collect()), key=repr) == clean
    leaked = {r[0] for r in whole}
    assert [r for r in sorted(map(tuple, docs.collect()), key=repr) if r[0] not in leaked] == clean


def test_empty_tables(spark):
    docs, bench, _ = tables(spark)
    assert d.leaks(docs.limit(0), bench).count() == 0
    assert d.leaks(docs, bench.limit(0)).count() == 0
    assert d.decontaminated(docs, bench.limit(0)).count() == docs.count()
