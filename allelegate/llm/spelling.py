"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced letter.

A bit-sliced position index holds, for each (position, letter), the bit set of the words that have that letter there.
All queries of a block run at once, 64 words to a machine word: three sets per query start from all words of its
group and are carried over its letters together,

    same      words that agree so far,
    replaced  words that differ in one place so far, read at the same position,
    longer    words with one letter more so far, read one position further,
    shorter   words with one letter less so far, read one position back,

so that after the last letter the words of the right length in the last three are those with exactly one error.

The vocabulary is dealt to tasks by half words.  Of two near words, the shorter one of m letters, the first or the last
m // 2 letters are the same, so both stand in the group (m, first half) or in the group (m, last half), each with its
words of m and of m + 1 letters.  A pair in both counts in the first one only: the set `same` after m // 2 letters
tells.  Many small groups share one index, each query starting from its own group's words.  A group of more than BLOCK
words is cut into blocks, and each of its words asks each of the blocks, in tasks of their own; so memory is bounded
by a block, and no pair is ever emitted: a task returns, per word, the number of near words and the best of them.

Words and counts come from native functions.  Forms are followed by pointer doubling; a form is at least `ratio` times as
frequent, so the greatest count bounds the rounds, and they are fixed before the first one.

Nulls and odd rows: no text and the empty text have no words.  A null id reads as the empty text, so its runs hash as
`:<run>`.  Repeated rows count as often as they stand there.  Other columns are not read.  An empty table gives no rows.
Words may be of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import stored, widths

#: Letters of a word: A to Z in both cases, and U+00C0 to U+00FF.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Codes of letters in the index: 0 none, then a to z, then U+00C0 to U+00FF.
CODES = 1 + 26 + 64
#: Words of an index at most, words that several groups share one index of, and letters of the queries run at once.
BLOCK, SHARED, AT_ONCE = 8192, 1024, 1 << 20
#: Sizes past which the table of large groups is joined instead of broadcast.
HOT_ROWS = 100_000
FOUND = "word string, n long, n_near long, neg long, form string"
FOUND_NAMES, FOUND_TYPES = ["word", "n", "n_near", "neg", "form"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]


def lowered(word: Column) -> Column:
    """A to Z in lower case, nothing else."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, UPPER, LOWER)).otherwise(word)


def vocabulary(docs: DataFrame, least: int, modulus: int, id: str = "doc_id", text: str = "text", at_least: int = 2) -> DataFrame:
    """(word, n): runs of letters, some of them with one letter deleted, of `least` letters and `at_least` occurrences.

    With h the crc32 of `<id>:<run>`, a run whose h is a multiple of `modulus` loses its letter number h % length.
    Runs too short to matter are never built, and counts are summed before the shuffle.
    """
    runs = docs.select(
        F.coalesce(F.col(id).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("_run"),
    ).withColumn("_run", lowered(F.col("_run")))
    hashed = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
    at = (F.col("_h") % F.length("_run")).cast("int")
    short = F.concat(F.col("_run").substr(F.lit(1), at), F.col("_run").substr(at + 2, F.length("_run")))
    words = hashed.select(F.when(F.col("_h") % modulus == 0, short).otherwise(F.col("_run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)


def grouped(words: DataFrame, least: int) -> DataFrame:
    """(kind, m, half, part, role, word, n): each word in the groups where its near words of m or m + 1 letters stand.

    role 0 is in the index and asks, 1 is in the index only, 2 asks only; `part` numbers the blocks of a large group.
    """
    size = F.length("word")
    half = F.expr("if(kind = 0, left(word, m div 2), right(word, m div 2))")
    sizes = F.when(size > least, F.array(size, size - 1)).otherwise(F.array(size))
    rows = (
        words.select("word", "n", F.explode(sizes).alias("m"))
        .select("word", "n", "m", F.explode(F.array(F.lit(0), F.lit(1))).alias("kind"))
        .withColumn("half", half)
    )
    key = ["kind", "m", "half"]
    hot = stored(
        rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select(*key, F.ceil(F.col("_n") / (BLOCK // 2)).cast("int").alias("_parts")),
        "hot_groups",
    )
    if hot.isEmpty():
        return rows.withColumns({"part": F.lit(0), "role": F.lit(0)})
    side = F.broadcast(hot) if hot.count() <= HOT_ROWS else hot
    cut = rows.join(side, key, "left")
    own = F.pmod(F.xxhash64("word"), F.col("_parts").cast("bigint")).cast("int")
    asks = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(2).alias("role")))
    places = F.when(F.col("_parts").isNull(), F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("role")))).otherwise(
        F.concat(F.array(F.struct(own.alias("part"), F.lit(1).alias("role"))), asks)
    )
    return cut.select("word", "n", "m", "kind", "half", F.inline(places))


def codes_of(words: list[str], width: int) -> np.ndarray:
    """Letter codes, one row per word, 0 past its end."""
    if not words:
        return np.zeros((0, width), np.uint8)
    points = np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)
    return np.where(points == 0, 0, np.where(points < 0xC0, points - 96, points - 0xC0 + 27)).astype(np.uint8)


class Index:
    """Bit sets per (position, letter) over the words of a block; one position's sets are built when they are needed."""

    def __init__(self, words: list[str], groups: np.ndarray, m: int):
        self.size, self.m = len(words), m
        self.codes = codes_of(words, m + 1)
        self.lanes = -(-max(self.size, 1) // 64)
        self.all = self.bits(np.ones((1, self.size), bool))
        self.long = self.bits((self.codes[:, m] != 0)[None])
        self.group = self.bits(groups[None, :] == np.arange(groups.max(initial=-1) + 1)[:, None])
        self.slices: dict[int, np.ndarray] = {}

    def bits(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros((len(flags), self.lanes * 8), np.uint8)
        packed[:, : -(-self.size // 8)] = np.packbits(flags, axis=1, bitorder="little")
        return packed.view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """Words that have the letter at the position, one row per letter asked."""
        found = self.slices.get(position)
        if found is None:
            self.slices.pop(position - 3, None)
            found = self.slices[position] = self.bits(self.codes[None, :, position] == np.arange(CODES, dtype=np.uint8)[:, None])
        return found[letters]

    def near(self, codes: np.ndarray, size: int, groups: np.ndarray, last_half: bool) -> np.ndarray:
        """Bit sets of the words near each query: for queries of m letters words of m and m + 1, else words of m."""
        m, half = self.m, self.m // 2
        same = self.group[groups]
        both = None
        if size == m:
            replaced, longer = np.zeros_like(same), same.copy()
            for i in range(m):
                here = self.at(i, codes[:, i])
                replaced = (replaced & here) | (same & ~here)
                same &= here
                longer = (longer & self.at(i + 1, codes[:, i])) | same
                if i + 1 == half:
                    both = same.copy()
            found = (replaced & ~self.long) | (longer & self.long)
        else:
            shorter = np.zeros_like(same)
            for i in range(m + 1):
                if i:
                    shorter &= self.at(i - 1, codes[:, i])
                shorter |= same
                if i < m:
                    same &= self.at(i, codes[:, i])
                if i + 1 == half:
                    both = same.copy()
            found = shorter & ~self.long
        return found & ~both if last_half and both is not None else found


def _best(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of bits per row, and the first one."""
    counts = np.bitwise_count(found).sum(axis=1, dtype=np.int64)
    return counts, np.unpackbits(found.view(np.uint8), axis=1, bitorder="little").argmax(axis=1)


class _Block:
    """An index over words with their counts, the most frequent first, so that the first bit of a set is the best word."""

    def __init__(self, rows: Rows, kind: int, m: int):
        halves = {h: i for i, h in enumerate(dict.fromkeys(rows.half.tolist()))}
        self.kind, self.m, self.halves = kind, m, halves
        order = sorted(range(len(rows.n)), key=lambda i: (-rows.n[i], rows.word[i]))
        self.word, self.n = rows.word[order], rows.n[order]
        self.index = Index(self.word.tolist(), self.groups(rows)[order], m)

    def groups(self, rows: Rows) -> np.ndarray:
        return np.fromiter(map(self.halves.__getitem__, rows.half), np.int64, len(rows.half))

    def asked(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        """What each word finds; those of m letters in the group of their first half always give a row."""
        m, lanes = self.m, self.index.lanes
        groups, sizes = self.groups(rows), np.fromiter(map(len, rows.word), np.int64, len(rows.word))
        step = max(1, min(AT_ONCE // (m + 1), AT_ONCE // lanes))
        for size in (m, m + 1):
            of_size = np.flatnonzero(sizes == size)
            for at in range(0, len(of_size), step):
                some = of_size[at : at + step]
                words = rows.word[some]
                near, first = _best(self.index.near(codes_of(words.tolist(), m + 1), size, groups[some], self.kind == 1))
                hit = near > 0
                keep = hit if self.kind or size > m else np.ones(len(some), bool)
                none = ~hit[keep]
                values = [words[keep], rows.n[some][keep], near[keep], -self.n[first[keep]], self.word[first[keep]]]
                arrays = [pa.array(v, t, mask=none if i > 2 else None) for i, (v, t) in enumerate(zip(values, FOUND_TYPES, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=FOUND_NAMES)


class Rows(NamedTuple):
    half: np.ndarray
    word: np.ndarray
    n: np.ndarray

    def part(self, a: int, b: int) -> Rows:
        return Rows(*(c[a:b] for c in self))

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*map(np.concatenate, zip(*parts, strict=True)))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order (kind, m, large, half, part, role): small groups of one (kind, m) share an index, a block has its own."""
    held: list[Rows] = []
    where = name = block = None

    def shared(last: bool) -> Iterator[pa.RecordBatch]:
        """Ask the groups that are held; the last one may go on in the next batch."""
        nonlocal held
        if not held:
            return
        rows = Rows.joined(held)
        end = len(rows.half)
        if not last:
            cuts = np.flatnonzero(rows.half[1:] != rows.half[:-1])
            end = int(cuts[-1]) + 1 if len(cuts) else 0
        held = [rows.part(end, len(rows.half))] if end < len(rows.half) else []
        if end:
            whole = rows.part(0, end)
            yield from _Block(whole, *where).asked(whole)

    stand: list[Rows] = []
    for batch in batches:
        kind, m, part, role = (batch.column(c).to_numpy() for c in ("kind", "m", "part", "role"))
        rows = Rows(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("half", "word", "n")))
        new = (kind[1:] != kind[:-1]) | (m[1:] != m[:-1]) | (role[1:] != role[:-1]) | (part[1:] != part[:-1])
        new |= (role[1:] > 0) & (rows.half[1:] != rows.half[:-1])
        starts = [0, *(np.flatnonzero(new) + 1).tolist(), len(kind)]
        for a, b in zip(starts, starts[1:], strict=False):
            some, at = rows.part(a, b), (int(kind[a]), int(m[a]))
            if a == b:
                continue
            if where != at or role[a]:
                yield from shared(True)
            where = at
            if role[a] == 0:
                held.append(some)
                if sum(len(r.n) for r in held) >= SHARED:
                    yield from shared(False)
                continue
            if name != (*at, some.half[0], part[a]):
                name, block, stand = (*at, some.half[0], part[a]), None, []
            if role[a] == 1:
                stand.append(some)
            elif stand:
                block = block or _Block(Rows.joined(stand), *at)
                yield from block.asked(some)
    yield from shared(True)


def near_words(words: DataFrame, least: int) -> DataFrame:
    """(word, n, n_near, neg, form): all words, with their near words' number, and the best one and its count as -neg."""
    key = ["kind", "m", "half", "part"]
    dealt = grouped(words, least).repartition(widths(words), *key)
    found = dealt.sortWithinPartitions("kind", "m", F.col("role") > 0, "half", "part", "role").mapInArrow(_search, FOUND)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct("neg", "form"))).alias("_b")
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best).select("word", "n", "n_near", "_b.neg", "_b.form")


def variants(docs: DataFrame, least: int = 7, modulus: int = 31, ratio: int = 10, id: str = "doc_id", text: str = "text", at_least: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    A word's form is its near word of the greatest count, the first in code-point order of equals, if that count is at
    least `ratio` times the word's own.
    """
    words = stored(vocabulary(docs, least, modulus, id, text, at_least), "vocabulary")
    good = -F.col("neg") >= ratio * F.col("n")
    near = stored(
        near_words(words, least).select(
            "word", "n", "n_near", F.when(good, F.col("form")).alias("form"), F.when(good, -F.col("neg")).alias("form_n")
        ),
        "near_words",
    )
    largest = words.agg(F.max("n")).first()[0]
    links = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    # every step of a chain multiplies the count by `ratio` at least
    steps = int(math.log(max(largest or 1, at_least) / at_least, ratio) + 1e-9) if largest else 0
    for _ in range(max(steps - 1, 0).bit_length()):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = stored(links.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return near.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
