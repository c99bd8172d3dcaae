"""Near-duplicate documents by an LSH forest of sorted MinHash signatures.

A document's set holds its different windows of `words` words (with fewer words, all of
them as one window).  Two documents are linked if 100 * common >= percent * united; a
group is whatever links connect.

1. One pass gives each document the size of its set, a 128-bit key of the set and a
   signature of TREES * DEPTH MinHash values.  Documents with equal sets form a class,
   so copies cost one row from here on.
2. Every class enters TREES sorted orders: in each, its signature starts with other
   values.  Classes that agree in the first DEPTH values stand next to each other: a
   region.  Ranges of the order, not regions, make up a task, so a region of any size
   is spread over tasks.
3. Inside a region, classes whose remaining values agree well enough become candidates.
   A small region gives all of these pairs.  A large one, or one that a task's end may
   cut, first gives, for each class, its best neighbour and the smallest neighbour in a
   piece; once those are confirmed, classes that are already connected need no further
   pair.  The task of a whole region then compares the sets of unconnected ones whose finer sketches (one byte for
   the first shingle of each of BINS ranges of hashes) come near the wanted similarity, and gives only links, one for
   each two groups that meet.
   Classes of regions past WIDE are joined instead on their rarest shingles: of two linked
   sets, the first common shingle in any one order of all shingles stands so early in both
   that the rest suffices for the wanted similarity.  This misses no link of these classes,
   and there is no region that is too large for it.
4. A candidate counts only after the whole sets of both were compared; the finer sketches sort out most that
   would not.

A pair at 80 % similarity agrees in three values of a tree with probability 0.51, so all
of 20 trees miss it once in 1.6 million pairs; at 85 % once in 180 million.  With the
other values and the finer sketch, which is the same in all trees, simulated pairs of
large sets at the threshold are missed 8 times (80 %) or 4 times (85 %) in a million.

Nulls and odd rows: no text or no words gives an empty set, linked with nothing.  Rows
that share an id are one document; rows without an id belong to the group of their text
but never name it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allelegate.llm.components import components
from allelegate.llm.tables import computed, per_worker, stored, widths
from allelegate.llm.words import WordHashes, lower_words, scramble, shingle_set

TREES, DEPTH = 20, 3
VALUES = TREES * DEPTH
#: Values of its signature that a tree's row carries, from the tree's own first one on.
CARRIED = 20
#: Regions up to this size give all their pairs at once.
SMALL = 8
#: Classes of a region that one task compares with each other; a wider one is joined on rare shingles.
WIDE = 2048
#: Shingles of a region that are numbered at once; the sets of a larger one are compared pair by pair.
AT_ONCE = 1 << 22
#: Bits of the filter of ids whose sets are made, as a power of two: 8 MB.
FILTER = 26
#: Bits of a shingle's hash that choose its count; a shared count only makes a shingle look more frequent.
COUNTED = 18
#: How far the share of equal carried values may fall below the wanted similarity.
SLACK = 0.16
#: Values of the finer sketch, and how many deviations its agreement may fall below the wanted similarity.
BINS, DEVIATIONS = 512, 4
SEEDS = scramble(np.arange(1, VALUES + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> bytes:
    """VALUES MinHash values of two bytes each."""
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[start : start + 2048, None] * SEEDS[None, :]).min(axis=0))
    return (scramble(low) & np.uint64(0xFFFF)).astype(">u2").tobytes()


def sketch(shingles: np.ndarray) -> bytes:
    """For each of BINS ranges of hashes a byte of the first shingle there; 0 without one."""
    starts = np.searchsorted(shingles, np.arange(BINS, dtype=np.uint64) * np.uint64(2**64 // BINS))
    ends = np.append(starts[1:], len(shingles))
    low = shingles[np.minimum(starts, len(shingles) - 1)] % np.uint64(255) + np.uint64(1)
    return np.where(starts < ends, low, 0).astype(np.uint8).tobytes()


def _signatures(words: int):
    def make():
        known = per_worker("words", WordHashes)

        def step(texts: list) -> dict:
            sets = [shingle_set(known.of(lower_words(text)), words) for text in texts]
            return {
                "_size": [len(x) for x in sets],
                "_set": [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets],
                "_sign": [signature(x) if len(x) else None for x in sets],
                "_fine": [sketch(x) if len(x) else None for x in sets],
            }

        return step

    return make


def may_be_linked(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of sketches that a link does not contradict."""
    equal = ((a == b) & (a > 0)).sum(axis=1)
    used = ((a > 0) | (b > 0)).sum(axis=1)
    # `used` of the united shingles were drawn, without putting any back
    united = (size_a + size_b) / (1 + percent / 100)
    spread = np.sqrt(percent / 100 * (1 - percent / 100) / used * np.maximum(1 - used / united, 0))
    return equal >= (percent / 100 - DEVIATIONS * spread - 0.01) * used


class Region:
    """Classes that agree in their first values, in the order of one tree; `part` if other tasks may have more of them."""

    def __init__(self, columns: dict[str, np.ndarray], start: int, stop: int, part: bool = False):
        self.part = part
        self.columns = {k: v[start:stop] for k, v in columns.items()}
        self.ids, self.sizes, self.values = (self.columns[k] for k in ("rep", "size", "key"))
        self.roots = self.columns.get("root")

    def __len__(self) -> int:
        return len(self.ids)

    def likeness(self, start: int, stop: int, percent: int) -> np.ndarray:
        """How many values rows start to stop share with all; 0 where the sizes rule a link out."""
        if len(self) <= 64:
            equal = (self.values[start:stop, None, :] == self.values[None, :, :]).sum(axis=2)
        else:
            equal = np.zeros((stop - start, len(self)), np.int16)
            for k in range(CARRIED):
                equal += self.values[start:stop, k][:, None] == self.values[None, :, k]
        small = np.minimum(self.sizes[start:stop, None], self.sizes[None, :])
        large = np.maximum(self.sizes[start:stop, None], self.sizes[None, :])
        equal[(100 * small < percent * large) | (self.ids[start:stop, None] == self.ids[None, :])] = 0
        return equal

    def few(self, percent: int) -> np.ndarray:
        """All like pairs of a small region; else each row with its smallest like id and its best."""
        equal = self.likeness(0, len(self), percent)
        like = equal >= least_equal(percent)
        if len(self) <= SMALL:
            i, j = np.nonzero(like)
        else:
            some = np.flatnonzero(like.any(axis=1))
            first = np.where(like, self.ids[None, :], np.iinfo(np.int64).max).argmin(axis=1)
            best = np.where(like, equal, -1).argmax(axis=1)
            i, j = np.concatenate([some, some]), np.concatenate([first[some], best[some]])
        return in_order(self.ids[i], self.ids[j])

    def linked(self, percent: int) -> np.ndarray:
        """Links between classes with different roots, as many as connect all that any link connects.

        Both sketches sort out pairs, whole sets decide, and classes that a link has connected meet no more.
        """
        roots, fine, out = self.roots.copy(), self.columns["fine"], []
        common = self._common()
        for start in range(0, len(self), 256):
            if (roots == roots[0]).all():
                break
            stop = min(start + 256, len(self))
            like = np.triu(self.likeness(start, stop, percent) >= least_equal(percent), start + 1)
            like &= roots[start:stop, None] != roots[None, :]
            for i in np.flatnonzero(like.any(axis=1)):
                others = np.flatnonzero(like[i])
                i += start
                others = others[roots[others] != roots[i]]
                if not len(others):
                    continue
                near = may_be_linked(fine[others], fine[i][None, :], self.sizes[others], self.sizes[i], percent)
                others = others[near]
                shared = common(i, others)
                united = self.sizes[i] + self.sizes[others] - shared
                others = others[(shared > 0) & (100 * shared >= percent * united)]
                met, first = np.unique(roots[others], return_index=True)
                out += [(self.ids[i], self.ids[j]) for j in others[first]]
                roots[np.isin(roots, met)] = roots[i]
        return in_order(*np.array(out, np.int64).reshape(-1, 2).T)

    def _common(self):
        """Function of a row and some others: how many shingles each of them shares with it."""
        sets = [np.frombuffer(x, np.uint64) for x in self.columns["hashes"]]
        if self.sizes.sum() > AT_ONCE:
            return lambda i, others: np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in others], np.int64)
        numbers, ends = None, np.cumsum([len(x) for x in sets])

        def count(i: int, others: np.ndarray) -> np.ndarray:
            nonlocal numbers
            if not len(others):
                return np.empty(0, np.int64)
            if numbers is None:
                different, found = np.unique(np.concatenate(sets), return_inverse=True)
                numbers = np.zeros(len(different), bool), found
            here, found = numbers
            own = found[ends[i] - len(sets[i]) : ends[i]]
            here[own] = True
            lengths = self.sizes[others]
            starts = np.cumsum(lengths) - lengths
            at = np.arange(lengths.sum()) + np.repeat(ends[others] - lengths - starts, lengths)
            shared = np.add.reduceat(here[found[at]], starts, dtype=np.int64)
            here[own] = False
            return shared

        return count


def least_equal(percent: int) -> int:
    return max(1, int(CARRIED * (percent / 100 - SLACK)))


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if name == "hashes":
            out[name] = np.array([*column.to_pylist(), None], object)[:-1]
        elif pa.types.is_binary(column.type):
            kind = ">u2" if name == "key" else np.uint8
            out[name] = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    out["key"] = out["key"].astype(np.uint16)
    return out


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[Region]:
    """Regions of two or more of the sorted rows, the first and the last of any size; one of more than 4 * WIDE rows comes in overlapping parts."""
    rest: dict[str, np.ndarray] = {}
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        new = _columns(batch)
        rest = {k: np.concatenate([rest[k], v]) for k, v in new.items()} if rest else new
        tree, key = rest["tree"], rest["key"]
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (key[1:, :DEPTH] != key[:-1, :DEPTH]).any(axis=1)) + 1
        starts = np.concatenate([[0], cuts])
        for k in range(len(cuts)):
            if first or starts[k + 1] - starts[k] > 1:
                yield Region(rest, starts[k], starts[k + 1], part=first)
            first = False
        rest = {k: v[starts[-1] :] for k, v in rest.items()}
        while len(rest["tree"]) > 4 * WIDE:
            yield Region(rest, 0, 4 * WIDE, part=True)
            rest = {k: v[3 * WIDE :] for k, v in rest.items()}
    if rest:
        yield Region(rest, 0, len(rest["tree"]), part=True)


def _rows(pairs: list[np.ndarray], members: list[Region]) -> pa.RecordBatch:
    both = np.unique(np.concatenate([np.empty((0, 2), np.int64), *pairs]), axis=0)
    none = lambda n, kind: pa.nulls(n, kind)
    n, m = len(both), sum(map(len, members))
    of = lambda k: np.concatenate([np.empty(0, np.int64), *(x.columns[k].astype(np.int64) for x in members)])
    keys = [row.astype(">u2").tobytes() for x in members for row in x.values]
    join = lambda x, y: pa.concat_arrays([x, y])
    return pa.RecordBatch.from_arrays(
        [
            join(pa.array(both[:, 0], pa.int64()), none(m, pa.int64())),
            join(pa.array(both[:, 1], pa.int64()), none(m, pa.int64())),
            join(none(n, pa.int32()), pa.array(of("tree"), pa.int32())),
            join(none(n, pa.binary()), pa.array(keys, pa.binary())),
            join(none(n, pa.int64()), pa.array(of("rep"), pa.int64())),
            join(none(n, pa.int64()), pa.array(of("size"), pa.int64())),
        ],
        names=["a", "b", "tree", "key", "rep", "size"],
    )


def _first_round(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: list[np.ndarray] = []
        members: list[Region] = []
        for region in _regions(batches):
            for start in range(0, len(region), WIDE):
                pairs.append(Region(region.columns, start, min(start + WIDE, len(region))).few(percent))
            if region.part or len(region) > SMALL:
                members.append(region)
            if len(pairs) > 2000 or sum(map(len, members)) > 20_000:
                yield _rows(pairs, members)
                pairs, members = [], []
        yield _rows(pairs, members)

    return run


def _second_round(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region in _regions(batches):
            pairs = region.linked(percent)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _id_bits(ids: DataFrame, column: str) -> np.ndarray:
    """A bit per hash of an id; a fixed number of them, so that many ids only let more others pass."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << FILTER))
    bits = ids.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))").alias("bit"))
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << (FILTER - 6), np.int64)
    words[found["word"].to_numpy()] = found["bit"].to_numpy()
    return words.view(np.uint64)


def _sets(words: int, sent: Broadcast):
    """(rep, _set, hashes): the whole sets of the rows (id, hash of the id, text) whose id may be among those sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = per_worker("words", WordHashes), sent.value
        for batch in batches:
            place = batch.column(1).to_numpy() & ((1 << FILTER) - 1)
            asked = (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
            some = batch.filter(pa.array(asked, pa.bool_()))
            sets = [shingle_set(known.of(lower_words(text)), words) for text in some.column(2).to_pylist()]
            keys = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            arrays = [some.column(0), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["rep", "_set", "hashes"])

    return run


def _counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("words", WordHashes)
        total = np.zeros(1 << COUNTED, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = shingle_set(known.of(lower_words(text)), words)
                total += np.bincount((found >> np.uint64(64 - COUNTED)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "n"])

    return run


def _prefixes(words: int, percent: int, sent: Broadcast):
    """For each set its rarest shingles, as many as may stand before the first one that a linked set shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("words", WordHashes)
        often = sent.value
        for batch in batches:
            tokens, left, rows, sizes = [], [], [], []
            for text, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingle_set(known.of(lower_words(text)), words)
                if xxhash.xxh3_128_digest(found.tobytes()) != key:  # another text of the same id
                    found = found[:0]
                n = len(found)
                order = np.lexsort((found, often[(found >> np.uint64(64 - COUNTED)).astype(np.int64)]))
                some = found[order[: n - -(-percent * n // 100) + 1]]
                tokens.append(some.view(np.int64))
                left.append(n - np.arange(len(some)))
                rows.append(len(some))
                sizes.append(n)
            take = lambda k: pa.array(np.repeat(batch.column(k).to_numpy(), rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(left)), pa.array(np.repeat(sizes, rows)), take(2), take(3)],
                names=["token", "left", "n", "rep", "root"],
            )

    return run


def _rare_pairs(docs: DataFrame, wide: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs of the classes `wide` (rep, root, _set) with different roots that may be linked; every linked one is among them.

    They are joined on (shingle, root) first, so that classes of one root, however many, meet only those of another.
    """
    texts = docs.join(wide, docs["_id"] == wide["rep"]).select("_text", "_set", "rep", "root").distinct()
    texts = stored(texts, "wide_texts")
    counts = texts.select("_text").mapInArrow(_counts(words), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(1 << COUNTED, np.int64)  # a fixed number of counts, whatever the size of the input
    often[counts["at"].to_numpy()] = counts["n"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(often)
    rare = stored(texts.mapInArrow(_prefixes(words, percent, sent), "token long, left long, n long, rep long, root long"), "rare")
    # the smaller set of a pair meets the larger one still earlier
    early = rare.where((100 + percent) * F.col("left") >= 2 * percent * F.col("n"))
    a, b = (x.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("left", "n", "rep", "root"))) for x, s in ((early, "a"), (rare, "b")))
    meet = a.select("token", "root_a").distinct().join(b.select("token", "root_b").distinct(), "token").where("root_a <> root_b")
    both = meet.join(a, ["token", "root_a"]).join(b, ["token", "root_b"]).where("n_a <= n_b")
    both = both.where((100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b")))
    return both.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()


def _compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, BINS) for k in (2, 3))
            near = may_be_linked(left, right, batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = per_worker("words", WordHashes)
        last, own = None, shingle_set(np.empty(0, np.uint64), words)
        for batch in batches:
            kept = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last != left:
                    last, own = left, shingle_set(known.of(lower_words(left)), words)
                other = shingle_set(known.of(lower_words(right)), words)
                common = len(np.intersect1d(own, other, assume_unique=True))
                kept.append(common > 0 and 100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return run


def _in_order(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartitionByRange(tasks, "tree", "key", "rep").sortWithinPartitions("tree", "key", "rep")


def _whole(rows: DataFrame, tasks: int) -> DataFrame:
    """Each region in one task."""
    return rows.repartition(tasks, "tree", F.substring("key", 1, 2 * DEPTH)).sortWithinPartitions("tree", "key", "rep")


def _sketched(signs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose finer sketches allow a link."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    own = signs.where("_size > 0").join(ends, "_id", "left_semi").select("_id", "_size", "_fine").distinct()
    both = pairs.join(own.select(F.col("_id").alias("a"), F.col("_fine").alias("left"), F.col("_size").alias("n_left")), "a").join(
        own.select(F.col("_id").alias("b"), F.col("_fine").alias("right"), F.col("_size").alias("n_right")), "b"
    )
    rows = both.select("a", "b", "left", "right", "n_left", "n_right")
    return stored(rows.mapInArrow(_compare(percent), "a long, b long").distinct(), "sketched")


def _links(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole texts are similar enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("_id")).distinct()
    texts = stored(docs.join(ends, "_id", "left_semi").select("_id", "_text"), "texts")
    both = pairs.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("right")), "b").join(
        texts.select(F.col("_id").alias("a"), F.col("_text").alias("left")), "a"
    )
    found = both.select("a", "b", "left", "right").sortWithinPartitions("a").mapInArrow(_confirm(words, percent), "a long, b long")
    return stored(found.distinct(), "confirmed")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    component_id is the smallest id reachable by links, the row's own included; kept tells
    the rows that carry it.  A row without id in a group of such rows only has none.
    """
    tasks = widths(docs)
    docs = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    signs = stored(computed(docs, "_text", "_size long, _set binary, _sign binary, _fine binary", _signatures(words)), "signatures")
    classes = stored(
        signs.where("_size > 0 and _id is not null")
        .groupBy("_set")
        .agg(F.min("_id").alias("rep"), F.first("_size").alias("size"), F.first("_sign").alias("sign")),
        "classes",
    )
    # rotated signatures: tree t starts at its own DEPTH values and goes on cyclically
    rotated = F.concat(F.expr("substring(sign, 2 * %d * tree + 1)" % DEPTH), F.col("sign"))
    entries = (
        classes.select("rep", "size", "sign", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("tree", F.substring(rotated, 1, 2 * CARRIED).alias("key"), "rep", "size")
    )
    first = stored(
        _in_order(entries, tasks).mapInArrow(_first_round(percent), "a long, b long, tree int, key binary, rep long, size long"),
        "regions",
    )
    pairs = stored(first.where("a is not null").select("a", "b").distinct(), "pairs")
    # one id with several texts ties their classes
    tied = classes.join(signs.where("_size > 0").select("_set", F.col("_id").alias("b")).distinct(), "_set").where("rep <> b")
    tied = tied.join(classes.select(F.col("rep").alias("b")), "b", "left_semi").select(F.col("rep").alias("a"), "b")
    links = stored(_links(docs, _sketched(signs, pairs, percent), words, percent).union(tied), "links")
    roots = stored(components(links), "roots")

    # regions that hold more than one group, with the finer sketch of their classes
    known = classes.join(roots, classes["rep"] == roots["node"], "left").select("rep", F.coalesce("root", "rep").alias("root"), "_set")
    members = first.where("rep is not null").select("tree", "key", "rep", "size").distinct().join(known, "rep")
    region = ["tree", F.substring("key", 1, 2 * DEPTH).alias("region")]
    mixed = members.select(*region, "root").groupBy("tree", "region").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    mixed = mixed.select(F.col("tree").alias("_tree"), "region", (F.col("n") > WIDE).alias("wide"))
    open_members = stored(members.join(mixed, (F.col("tree") == F.col("_tree")) & (F.substring("key", 1, 2 * DEPTH) == F.col("region"))).drop("_tree", "region"), "open")
    wide = open_members.where("wide").select("rep", "root", "_set").distinct()
    open_members = open_members.where("not wide")
    needed = open_members.select("_set").distinct()
    fine = signs.select("_set", F.col("_fine").alias("fine")).join(needed, "_set", "left_semi").groupBy("_set").agg(F.first("fine").alias("fine"))
    # sets are made where the texts lie, so texts are not shuffled
    sent = docs.sparkSession.sparkContext.broadcast(_id_bits(open_members.select("rep").distinct(), "rep"))
    texts = docs.where("_id is not null").select("_id", F.xxhash64("_id").alias("hash"), "_text")
    # a row may stand there twice; the join then finds the sets dealt as it needs them
    whole = texts.mapInArrow(_sets(words, sent), "rep long, _set binary, hashes binary").groupBy("rep", "_set").agg(F.first("hashes").alias("hashes"))
    rooted = open_members.join(fine, "_set").join(whole, ["rep", "_set"]).select("tree", "key", "rep", "size", "root", "fine", "hashes")
    late = stored(_whole(rooted, tasks).mapInArrow(_second_round(percent), "a long, b long").distinct(), "late_links")
    if not wide.isEmpty():
        rare = _sketched(signs, _rare_pairs(docs, wide, words, percent), percent).join(pairs, ["a", "b"], "left_anti")
        late = late.union(_links(docs, rare, words, percent))
    if not late.isEmpty():
        roots = stored(components(links.union(late)), "roots")

    named = classes.join(roots, classes["rep"] == roots["node"], "left").select("_set", F.coalesce("root", "rep").alias("root"))
    return signs.join(named, "_set", "left").select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("n_shingles"),
        F.coalesce("root", "_id").alias("component_id"),
        F.col("_id").eqNullSafe(F.coalesce("root", "_id")).alias("kept"),
    )


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, all columns, one for each group: that of its smallest id.

    Of several rows with that id the one with the smallest text stays.  Rows without an id cannot stand for a
    group and stay as they are.
    """
    kept = near_duplicates(docs.where(F.col(id).isNotNull()), id, text, words, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_row"))
    first = Window.partitionBy("_id").orderBy("_text")
    ids = rows.where("_id is not null").join(kept, F.col("_id") == F.col("_kept"), "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return ids.select("_row.*").union(rows.where("_id is null").select("_row.*"))
