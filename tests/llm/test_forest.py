"""Near duplicates against all pairs of small tables."""

import random
import re

import pytest

from allelegate.llm import forest
from allelegate.llm.components import components


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(rows, n, percent):
    """Rows of (id, text) as (id, size, smallest id reachable, kept)."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            same = len(s & t)
            if (i is not None and i == j) or (same and 100 * same >= percent * len(s | t)):
                root[find(a)] = find(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(rows)) if find(b) == find(a) and sets[b][0] is not None]
        least = min(ids, default=None)
        out.append((i, len(s), least, i == least))
    return sorted(out, key=repr)


def edited(words, rnd, times):
    words = list(words)
    for _ in range(times):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def sample():
    rnd = random.Random(8)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "one two"), (7, "ONE two"), (8, "a a a a a a"), (9, "a a a a")]
    for group in range(12):
        base = [f"g{rnd.randrange(60)}" for _ in range(rnd.choice([20, 90, 400]))]
        for k in range(rnd.choice([2, 5, 14])):
            rows.append((100 * (group + 1) + k, edited(base, rnd, rnd.choice([0, 0, 1, 2, 4]))))
    rows += [(100, rows[9][1]), (None, rows[9][1]), (None, "alone here"), (5, "another text for an id that is there")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_agrees_with_all_pairs(spark, words, percent):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 0, 0, "x") for i, t in rows], "doc_id long, text string, rep int, component_id int, _set string")
    got = sorted((tuple(r) for r in forest.near_duplicates(docs, words=words, percent=percent).collect()), key=repr)
    assert got == brute(rows, words, percent)


def test_large_group_of_copies(spark):
    """Hundreds of edited copies are one group; documents that share a passage only are not."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, edited(base, rnd, 2)) for i in range(400)]
    rows += [(1000 + i, " ".join(base[:60] + [f"x{i}y{k}" for k in range(80)])) for i in range(200)]
    got = {r[0]: r[2] for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(400)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(200))


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g", "k"), (1, "a b c d e f g", "k"), (2, "a b c d e f g", "l"), (3, "", "m"), (4, None, "n"), (None, "a b c d e f g", "o")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    assert sorted(map(tuple, forest.deduplicated(docs).collect()), key=repr) == sorted([rows[0], rows[3], rows[4], rows[5]], key=repr)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert forest.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert forest.near_duplicates(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3), (200, 201)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0}
    assert {got[100 + i] for i in range(30)} == {100}
    assert got[201] == 200 and got[200] == 200


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_wide_regions_agree_with_all_pairs(spark, monkeypatch, words, percent):
    """One site template of distinct texts with few near pairs among them: every region is wide."""
    monkeypatch.setattr(forest, "WIDE", 16)
    rnd = random.Random(12)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = base + [f"x{i}y{k}" for k in range(20)]
        rows.append((i, " ".join(own)))
        if i % 5 == 0:
            rows += [(1000 + 10 * i + k, edited(own, rnd, rnd.choice([1, 2, 3, 4]))) for k in range(3)]
    rows += [(0, "another text for an id that is there"), (0, rows[9][1])]
    rnd.shuffle(rows)
    asked = []
    monkeypatch.setattr(forest, "_rare_pairs", lambda *a, f=forest._rare_pairs: asked.append(1) or f(*a))
    got = sorted((tuple(r) for r in forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()), key=repr)
    assert asked and got == brute(rows, words, percent)


def test_rare_pairs_hold_every_link(spark):
    """The join alone, without the trees: all linked pairs of a family, and few others."""
    rnd = random.Random(3)
    base = [f"b{i}" for i in range(100)]
    rows = [(i, edited(base + [f"x{i // 3}y{k}" for k in range(25)], rnd, i % 4)) for i in range(240)]
    docs = spark.createDataFrame(rows, "_id long, _text string")
    sets = [shingles(t, 3) for _, t in rows]
    linked = {(a, b) for b in range(len(rows)) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    keys = [(i, i, forest.xxhash.xxh3_128_digest(forest.shingle_set(forest.WordHashes().of(forest.lower_words(t)), 3).tobytes())) for i, t in rows]
    wide = spark.createDataFrame(keys, "rep long, root long, _set binary")
    got = set(map(tuple, forest._rare_pairs(docs, wide, 3, 85).collect()))
    assert linked and linked <= got
    assert len(got) < len(rows) * len(rows) / 20


def test_regions_cut_by_the_end_of_a_task_are_whole_in_the_second_round(spark):
    """More tasks than classes: ranges end inside the regions."""
    rnd = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, edited(base, rnd, 2)) for i in range(6)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = sorted((tuple(r) for r in forest.near_duplicates(docs).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows, 3, 85)


def region_rows(n, roots=None):
    """Classes of one region in the order of a tree; the fourth value tells them apart, the first and the last class have equal sketches."""
    keys = [forest.np.array([1, 1, 1, k, *range(100 * k, 100 * k + 5), *[7] * 11], ">u2").tobytes() for k in range(n)]
    rnd = random.Random(n)
    fine = [rnd.randbytes(forest.BINS) for _ in range(n)]
    fine[-1] = fine[0]
    columns = {"tree": forest.pa.array([0] * n, "int32"), "key": forest.pa.array(keys, "binary"), "rep": forest.pa.array(range(n), "int64"), "size": forest.pa.array([600] * n, "int64")}
    if roots:
        sets = [forest.np.sort(forest.np.frombuffer(rnd.randbytes(8 * 600), forest.np.uint64)) for _ in range(n - 1)]
        sets.append(forest.np.sort(forest.np.append(sets[0][:-9], sets[1][:9])))
        columns |= {"root": forest.pa.array(roots, "int64"), "fine": forest.pa.array(fine, "binary"), "hashes": forest.pa.array([x.tobytes() for x in sets], "binary")}
    return forest.pa.RecordBatch.from_pydict(columns)


def test_pairs_across_a_whole_region(monkeypatch):
    """Also where the region is wider than WIDE and the two stand far apart in it."""
    monkeypatch.setattr(forest, "WIDE", 16)
    found = [(a, b) for out in forest._second_round(85)(iter([region_rows(60, list(range(60)))])) for a, b in zip(*map(list, out.to_pydict().values()), strict=True)]
    assert found == [(0, 59)]


@pytest.mark.parametrize("at_once", [0, 1 << 22])
def test_a_region_gives_links_that_connect_and_no_more(monkeypatch, at_once):
    """A family near the wanted similarity: rows stay below the classes, and groups are those of all pairs."""
    monkeypatch.setattr(forest, "AT_ONCE", at_once)
    rng = forest.np.random.default_rng(8)
    pool = forest.np.sort(rng.integers(0, 2**63, 500).astype(forest.np.uint64))
    sets = [forest.np.sort(pool[rng.permutation(500)[:445]]) for _ in range(150)]
    n, roots = len(sets), [i // 3 * 3 for i in range(150)]
    columns = {
        "tree": forest.pa.array([0] * n, "int32"), "key": forest.pa.array([forest.np.full(20, 7, ">u2").tobytes()] * n, "binary"),
        "rep": forest.pa.array(range(n), "int64"), "size": forest.pa.array([445] * n, "int64"), "root": forest.pa.array(roots, "int64"),
        "fine": forest.pa.array([forest.sketch(x) for x in sets], "binary"), "hashes": forest.pa.array([x.tobytes() for x in sets], "binary"),
    }
    got = [tuple(r.values()) for out in forest._second_round(80)(iter([forest.pa.RecordBatch.from_pydict(columns)])) for r in out.to_pylist()]
    shared = lambda a, b: len(forest.np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for b in range(n) for a in range(b) if 100 * shared(a, b) >= 80 * (890 - shared(a, b))}
    assert 500 < len(links) < n * (n - 1) / 2 and set(got) <= links and len(got) < n

    def groups(pairs):
        root = list(roots)
        for a, b in pairs:
            old = root[b]
            root = [root[a] if r == old else r for r in root]
        return {tuple(i for i in range(n) if root[i] == r) for r in set(root)}

    assert groups(got) == groups(links)


def test_a_region_at_the_end_of_a_task_goes_on():
    """Its classes reach the second round, however few of them a task saw."""
    both = region_rows(4)
    reps = {r for task in (both.slice(0, 1), both.slice(1)) for out in forest._first_round(85)(iter([task])) for r in out.column("rep").to_pylist() if r is not None}
    assert reps == {0, 1, 2, 3}
