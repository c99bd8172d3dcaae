"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1. One pass over all documents counts, for each window of N words of the benchmark, the documents that hold it.
2. A window is a seed if at most one document in 1 / COMMON holds it, or if it is among the rarer half of its
   item's windows: an item that leaked everywhere still has seeds.
3. A second pass finds seeds, puts a window of text around each (document, item) diagonal, and aligns the words of
   window and item.  The similarity is the local alignment's score (MATCH for equal words, MISS for other words,
   GAP for a left-out word) over the score of the whole item, so edited, cut and paraphrased copies count by how
   much of the item they keep in order.  From `least` on, the document leaks the item.

The benchmark is a query set against all rows: it is taken in blocks of at most BLOCK_WORDS words, each sent to
all tasks; a larger benchmark makes more passes and the same rows.  Nothing of the documents is shuffled or sent
to the driver but one count per window of a block.

Words are runs of letters and digits in lower case.  Nulls and odd rows: no text, on either side, leaks nothing;
items of fewer than N words cannot be told from chance and leak nothing.  Repeated documents each get their
rows; items that share an id give one row per document, of the best alignment.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import computed, per_worker, release
from allelegate.llm.words import MIX, WordHashes

N = 3
MATCH, MISS, GAP = 2, -1, -1
COMMON = 1e-3
LEAST = 0.45
BLOCK_WORDS = 500_000
MAP_BITS = 22

ASCII_SIGNS = bytes(32 if chr(b) in string.punctuation or b < 32 else b for b in range(256))
OTHER_SIGNS = re.compile("[\u0080-©«-´¶-¹»-¿ -⁯←-⯿　-〿]+")
LEAK = "array<struct<item:long,similarity:double,start_word:long,stop_word:long,n_matches:long>>"


def plain_words(text: str | None) -> list[bytes]:
    if not text:
        return []
    text = text.lower()
    if OTHER_SIGNS.search(text):
        text = OTHER_SIGNS.sub(" ", text)
    return text.encode("utf-8", "surrogatepass").translate(ASCII_SIGNS).split()


def windows(words: np.ndarray) -> np.ndarray:
    """One hash per window of N words; the words' own hashes are spread already."""
    total = np.zeros(max(0, len(words) - N + 1), np.uint64)
    for i in range(N):
        total += words[i : len(words) - N + 1 + i] * MIX[i]
    return total


class Known:
    """A sorted set of window hashes, with a bit map that rules out most others."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.map = np.zeros(1 << MAP_BITS, bool)
        self.map[hashes >> np.uint64(64 - MAP_BITS)] = True

    def find(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `found` that are in the set, and where there."""
        may = np.flatnonzero(self.map[found >> np.uint64(64 - MAP_BITS)])
        if not len(may):
            return may, may
        at = np.searchsorted(self.hashes, found[may])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == found[may]
        return may[hit], at[hit]


class Items:
    """A block of benchmark items, their windows and which of these are seeds."""

    def __init__(self, ids: list[int | None], words: list[np.ndarray]):
        self.ids, self.words = ids, words
        grams = [windows(w) for w in words]
        self.grams = np.unique(np.concatenate([np.empty(0, np.uint64), *grams]))
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.rows = [np.searchsorted(self.grams, g) for g in grams]

    def choose(self, counts: np.ndarray, documents: int) -> None:
        """Fix the seeds, given how many documents hold each window."""
        chosen: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item, rows in enumerate(self.rows):
            if len(rows):
                bar = max(np.median(counts[rows]), COMMON * documents)
                for place, row in enumerate(rows):
                    if counts[row] <= bar:
                        chosen[int(row)].append((item, place))
        self.places = dict(chosen)
        self.seeds = Known(self.grams[sorted(self.places)])
        self.seed_rows = np.array(sorted(self.places), np.int64)


def counts_in(docs: DataFrame, text: str, items: Items) -> tuple[np.ndarray, int]:
    """How many documents hold each window of the block, and how many documents there are."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, known = sent.value, per_worker("words", WordHashes)
        grams = Known(block.grams)
        counts, documents = np.zeros(len(block.grams), np.int64), 0
        for batch in batches:
            documents += batch.num_rows
            for value in batch.column(0).to_pylist():
                words = known.of(plain_words(value))
                if len(words) >= N:
                    _, rows = grams.find(windows(words))
                    counts[np.unique(rows)] += 1
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(counts[held], documents))], names=["gram", "n"])
        release()

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows["gram"].to_pylist(), rows["n"].to_pylist(), strict=True))
    documents = found.pop(-1, 0)
    counts = np.zeros(len(items.grams), np.int64)
    counts[list(found)] = list(found.values())
    return counts, documents


def best_scores(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman score of each pair, many pairs a step."""
    out = np.zeros(len(items), np.int32)
    order = sorted(range(len(items)), key=lambda i: (len(windows[i]), len(items[i])))
    start = 0
    while start < len(order):
        # pairs of like width; few at once where they are wide
        stop = start + 1
        while stop < len(order) and (stop - start) * len(windows[order[stop]]) < 200_000 and len(windows[order[stop]]) <= 2 * len(windows[order[start]]) + 16:
            stop += 1
        part = order[start:stop]
        wide, long = max(len(windows[i]) for i in part), max(len(items[i]) for i in part)
        text = np.zeros((len(part), wide), np.uint64)
        item = np.ones((len(part), long), np.uint64)
        for row, i in enumerate(part):
            text[row, : len(windows[i])] = windows[i]
            item[row, : len(items[i])] = items[i]
        ramp = (-GAP * np.arange(wide + 1)).astype(np.int32)
        lengths = np.array([len(items[i]) for i in part])
        last, best = np.zeros((len(part), wide + 1), np.int32), np.zeros(len(part), np.int32)
        for k in range(long):
            now = np.zeros_like(last)
            now[:, 1:] = np.maximum(last[:, :-1] + np.where(text == item[:, k : k + 1], MATCH, MISS), last[:, 1:] + GAP)
            np.maximum(now, 0, out=now)
            # a run of left-out words: the best cell to the left, less GAP for each step
            last = np.maximum.accumulate(now + ramp, axis=1) - ramp
            best = np.where(k < lengths, np.maximum(best, last.max(axis=1)), best)
        out[part] = best
        start = stop
    return out


def span(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """First word, end and equal words of the best local alignment in the window."""
    table = np.zeros((len(item) + 1, len(window) + 1), np.int32)
    ramp = (-GAP * np.arange(len(window) + 1)).astype(np.int32)
    for k in range(len(item)):
        now = np.zeros(len(window) + 1, np.int32)
        now[1:] = np.maximum(table[k, :-1] + np.where(window == item[k], MATCH, MISS), table[k, 1:] + GAP)
        table[k + 1] = np.maximum.accumulate(np.maximum(now, 0) + ramp) - ramp
    i, j = np.unravel_index(table.argmax(), table.shape)
    stop, equal = int(j), 0
    while table[i, j] > 0:
        same = item[i - 1] == window[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISS):
            equal += int(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return int(j), stop, equal


def _leaks(block: Items, least: float):
    known = per_worker("words", WordHashes)

    def step(values: list) -> list[list[dict]]:
        pairs: list[tuple[int, int, int, int]] = []
        texts: dict[int, np.ndarray] = {}
        for row, value in enumerate(values):
            words = known.of(plain_words(value))
            if len(words) < N:
                continue
            places, found = block.seeds.find(windows(words))
            diagonals: dict[int, set[int]] = defaultdict(set)
            for place, seed in zip(places, block.seed_rows[found], strict=True):
                for item, at in block.places[int(seed)]:
                    diagonals[item].add(int(place) - at)
            for item, starts in diagonals.items():
                size = len(block.words[item])
                slack = size // 4 + 4
                low = high = None
                for start in sorted(starts):
                    if high is not None and start - slack <= high:
                        high = start + size + slack
                        continue
                    if high is not None:
                        pairs.append((row, item, max(low, 0), min(high, len(words))))
                    low, high = start - slack, start + size + slack
                pairs.append((row, item, max(low, 0), min(high, len(words))))
                texts[row] = words
        scores = best_scores([block.words[p[1]] for p in pairs], [texts[p[0]][p[2] : p[3]] for p in pairs])
        out: list[dict] = [{} for _ in values]
        for (row, item, low, high), score in zip(pairs, scores, strict=True):
            similarity = float(score) / (MATCH * len(block.words[item]))
            if similarity >= least and similarity > out[row].get(block.ids[item], {"similarity": 0})["similarity"]:
                start, stop, equal = span(block.words[item], texts[row][low:high])
                out[row][block.ids[item]] = {"item": block.ids[item], "similarity": similarity, "start_word": low + start, "stop_word": low + stop, "n_matches": equal}
        return [sorted(x.values(), key=lambda r: (r["item"] is None, r["item"])) for x in out]

    return step


def blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Items]:
    known, ids, words, n = WordHashes(), [], [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text)).toLocalIterator():
        found = known.of(plain_words(row[1]))
        if len(found) < N:
            continue
        ids.append(row[0])
        words.append(found)
        n += len(found)
        if n >= BLOCK_WORDS:
            yield Items(ids, words)
            ids, words, n = [], [], 0
    if ids:
        yield Items(ids, words)


def flagged(docs: DataFrame, block: Items, least: float, text: str) -> DataFrame:
    """`docs` with the column _leaks: the items of the block that a row leaks."""
    sent = docs.sparkSession.sparkContext.broadcast(block)  # BLOCK_WORDS bounds it

    def make():
        step = _leaks(sent.value, least)
        return lambda values: {"_leaks": step(values)}

    return computed(docs, text, f"_leaks {LEAK}", make, keep=True)


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, stop_word, n_matches) of every leak; places count words of the document."""
    slim = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    found = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start_word long, stop_word long, n_matches long")
    for block in blocks(benchmark, item, item_text):
        block.choose(*counts_in(slim, "_text", block))
        found = found.union(flagged(slim, block, least, "_text").select("doc_id", F.inline("_leaks")))
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that leak no item."""
    clean = docs
    for block in blocks(benchmark, item, item_text):
        block.choose(*counts_in(docs, text, block))
        clean = flagged(clean, block, least, text).where(F.size("_leaks") == 0).drop("_leaks")
    return clean
