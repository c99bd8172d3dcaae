"""Hard negatives by inner product, from STR-packed R-trees.

All vectors are dealt into parts of about PART rows by sort and tile: slabs by one coordinate, and runs by a second one
inside each slab, the coordinates of the greatest variance first.  Inside its task each part is tiled on by the
next coordinates into leaves of LEAF rows, and the minimum bounding boxes of FAN neighbours are packed level by level up to
the root.  For a query, a box gives an interval of inner products coordinate by coordinate: the product with its lower
or its upper side, whichever is less or more.  A best-first queue takes the box of the highest possible score next, and
leaves out boxes whose interval lies outside the score window, or strictly below the k-th score found; equal scores
stay, since the smaller id decides between them.

The anchors are a stated query set.  They are cut into blocks of about ASK, and each (block, part) pair is one task that holds
just those two; each task returns its own first k per question, and a ranked window merges them.  So the work is
anchors times rows less what the boxes rule out, no task or driver holds more, and rows that are equal (even a third of
them) are dealt out like any others, because ids continue the sort keys.

Numbers are exact: components are whole numbers, multiplied as doubles while every sum stays below 2 ** 53, as Python
integers beyond.  A score outside the range of long is given as the nearest long.

Nulls and odd rows: rows with a null id or label, a null vector, or a component that is null, not finite, or not finite
when scaled take no part.  A shorter vector reads as filled up with zeros.  Rows that repeat an id are rows of their own:
each asks and is found, but a row never finds itself.  Other columns are not read.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from allelegate.llm.tables import pa_types, stored

#: Rows of a part and of a leaf, boxes of a node, anchors of a block, and of those the ones whose intervals are held at once.
PART, LEAF, FAN, ASK, AT_ONCE = 16384, 128, 8, 4096, 256
EXACT = 2**53
LONG = (-(2**63), 2**63 - 1)


def vectors(rows: DataFrame, scale: int = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(row, id, label, v): the rows that take part, their components times `scale` rounded down, still as doubles."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x * scale)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    named = rows.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), v.alias("v"))
    taken = named.where("id is not null and label is not null and v is not null").where(whole)
    return taken.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v")


def _moments(batches):
    """Per coordinate, how often it is there, its sum and its sum of squares, one row per task and coordinate."""
    total = np.zeros((3, 0))
    for batch in batches:
        v = batch.column(0)
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        flat = v.flatten().to_numpy(zero_copy_only=False)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.arange(len(flat)) - starts
        d = max(total.shape[1], int(lengths.max(initial=0)))
        total = np.pad(total, ((0, 0), (0, d - total.shape[1])))
        for k in range(3):
            total[k] += np.bincount(at, flat**k, minlength=d)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.shape[1])), *map(pa.array, total)], names=["at", "n", "s", "q"])


def tiled(rows: DataFrame, part: int) -> tuple[DataFrame, list[int], int]:
    """`rows` in parts of about `part` rows by sort and tile, with the coordinates that tile on, and their number."""
    moments = rows.select("v").mapInArrow(_moments, "at long, n double, s double, q double")
    spread = F.sum("q") - F.sum("s") * F.sum("s") / F.sum("n")
    axes = [r["at"] for r in moments.groupBy("at").agg(spread.alias("spread")).orderBy(F.desc("spread"), "at").collect()]
    first, second = (F.coalesce(F.try_element_at("v", F.lit(a + 1)), F.lit(0.0)) for a in (*axes, 0, 0)[:2])
    parts = max(1, math.ceil(rows.count() / part))
    slabs = math.ceil(math.sqrt(parts))
    # slabs of equal size: their borders are one number per slab
    placed = rows.withColumns({"_a": first, "_b": second})
    borders = placed.approxQuantile("_a", [i / slabs for i in range(1, slabs)], 0.1 / slabs) if slabs > 1 else []
    slab = F.size(F.filter(F.array(*map(F.lit, borders)).cast("array<double>"), lambda x: x <= F.col("_a")))
    cut = placed.withColumn("_slab", slab).repartitionByRange(parts, "_slab", "_b", "_a", "id", "row")
    return cut.select(F.spark_partition_id().alias("part"), *rows.columns), axes, len(axes)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows of whole numbers, shorter ones filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
    if (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d))
    out[np.arange(d) < lengths[:, None]] = flat
    return out


class Tree:
    """An R-tree over the rows of a part: leaves of LEAF rows in sort-and-tile order, then FAN boxes to a node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, v: np.ndarray, axes: list[int], leaf: int = LEAF, fan: int = FAN):
        order = np.lexsort((rows, ids))
        # the first two coordinates made the part
        order = self._tile(v, order, [*axes[2:], *axes[:2]], leaf)
        self.ids, self.rows, self.labels, self.v = ids[order], rows[order], labels[order], v[order]
        self.spans: list[tuple[int, int]] = [(a, min(a + leaf, len(order))) for a in range(0, len(order), leaf)]
        self.leaves = len(self.spans)
        starts = [a for a, _ in self.spans]
        low, high = np.minimum.reduceat(self.v, starts), np.maximum.reduceat(self.v, starts)
        lows, highs, first = [low], [high], 0
        while len(low) > 1:
            starts = list(range(0, len(low), fan))
            self.spans += [(first + a, first + min(a + fan, len(low))) for a in starts]
            first += len(low)
            low, high = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)
        self.root = len(self.spans) - 1
        self.largest = max(abs(float(self.low.min(initial=0))), abs(float(self.high.max(initial=0))))

    @staticmethod
    def _tile(v: np.ndarray, order: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
        """Sort by the first coordinate, cut into slabs, and so on by the next ones inside each slab."""
        if len(order) <= leaf or not axes:
            return order
        leaves = math.ceil(len(order) / leaf)
        levels = min(len(axes), max(1, math.ceil(math.log2(leaves))))
        size = math.ceil(leaves / math.ceil(leaves ** (1 / levels))) * leaf
        order = order[np.argsort(v[order, axes[0]], kind="stable")]
        return np.concatenate([Tree._tile(v, order[a : a + size], axes[1:], leaf) for a in range(0, len(order), size)])

    def intervals(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with any point of each box, one column per box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def exactly(self, q: np.ndarray) -> tuple[Tree, np.ndarray]:
        """Tree and queries whose products are exact: as doubles if all sums are small enough, else as integers."""
        largest = float(np.abs(q).max(initial=0))
        if largest * self.largest * max(q.shape[1], 1) < EXACT:
            return self, q
        wide = object.__new__(Tree)
        wide.__dict__ = self.__dict__ | {k: _integers(getattr(self, k)) for k in ("v", "low", "high")}
        return wide, _integers(q)

    def best(self, least: np.ndarray, most: np.ndarray, k: int, scored, low=None, high=None) -> list[tuple]:
        """The first k (-score, id, row) inside [low, high], best first, ties by id.

        `scored` gives the scores of a leaf, best first, as (-scores, ids, rows) of those that may be taken.
        """
        found: list[tuple] = []
        heap = [(-most[self.root], self.root)]
        while heap:
            bound, node = heapq.heappop(heap)
            floor = -found[-1][0] if len(found) == k else low
            if floor is not None and -bound < floor:
                break
            if node < self.leaves:
                minus, ids, rows = scored(node)
                a = 0 if high is None else int(np.searchsorted(minus, -high, "left"))
                b = a + k if floor is None else min(a + k, int(np.searchsorted(minus, -floor, "right")))
                if a < b:
                    found = sorted([*found, *zip(minus[a:b].tolist(), ids[a:b].tolist(), rows[a:b].tolist(), strict=True)])[:k]
                continue
            for child in range(*self.spans[node]):
                if (floor is None or most[child] >= floor) and (high is None or least[child] <= high):
                    # above the window all boxes promise the same
                    heapq.heappush(heap, (-most[child] if high is None else -min(most[child], high), child))
        return found

    def leaf(self, q: np.ndarray, node: int, label: int, same: bool, row: int) -> tuple:
        a, b = self.spans[node]
        take = (self.labels[a:b] == label) == same
        if same:
            take &= self.rows[a:b] != row
        minus, ids, rows = -(self.v[a:b] @ q)[take], self.ids[a:b][take], self.rows[a:b][take]
        order = np.lexsort((rows, ids, minus))
        return minus[order], ids[order], rows[order]


def _integers(x: np.ndarray) -> np.ndarray:
    return np.array([int(y) for y in x.ravel()], dtype=object).reshape(x.shape)


def _long(score) -> int:
    return min(max(int(score), LONG[0]), LONG[1])


def _tree(table: pa.Table, d: int, axes: list[int]) -> Tree:
    ids, rows, labels = (table.column(c).to_numpy() for c in ("id", "row", "label"))
    return Tree(ids, rows, labels, matrix(table.column("v").combine_chunks(), d), axes)


def _asking(d: int, axes: list[int], ask, names: list[str], types: list[pa.DataType]):
    """One (block, part): `ask` yields the output rows of an anchor, given the tree, its intervals and the anchor."""

    def run(part: pa.Table, block: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if part.num_rows and block.num_rows:
            tree = _tree(part, d, axes)
            queries = matrix(block.column("v").combine_chunks(), d)
            anchors = block.drop_columns(["v"]).to_pylist()
            for a in range(0, len(anchors), AT_ONCE):
                exact, q = tree.exactly(queries[a : a + AT_ONCE])
                least, most = exact.intervals(q)
                for i, anchor in enumerate(anchors[a : a + AT_ONCE]):
                    out += ask(exact, q[i], least[i], most[i], anchor)
        columns = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def _positives(k: int):
    def ask(tree: Tree, q, least, most, anchor: dict):
        scored = lambda node: tree.leaf(q, node, anchor["label"], True, anchor["row"])
        for minus, id, row in tree.best(least, most, k, scored):
            yield anchor["row"], id, row, _long(-minus)

    return ask


def _negatives(k: int, low: int, high: int):
    def ask(tree: Tree, q, least, most, anchor: dict):
        known: dict[int, tuple] = {}

        def scored(node: int) -> tuple:
            if node not in known:
                known[node] = tree.leaf(q, node, anchor["label"], False, anchor["row"])
            return known[node]

        for p in anchor["positives"]:
            # low * positive <= 100 * score <= high * positive, in whole scores
            floor, top = -(-low * p["score"] // 100), high * p["score"] // 100
            if floor <= top:
                for minus, id, row in tree.best(least, most, k, scored, floor, top):
                    yield anchor["row"], p["place"], id, row, _long(-minus)

    return ask


def _per_task(parts: DataFrame, anchors: DataFrame, d: int, axes: list[int], ask, schema: str) -> DataFrame:
    """`ask` for every anchor and part, one task per pair of a block of anchors and a part."""
    kinds = pa_types(StructType.fromDDL(schema))
    blocks = max(1, math.ceil(anchors.count() / ASK))
    last = parts.agg(F.max("part")).first()[0] or 0
    asks = anchors.withColumns(
        {"block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), "part": F.explode(F.sequence(F.lit(0), F.lit(last)))}
    )
    stands = parts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    run = _asking(d, axes, ask, list(kinds), list(kinds.values()))
    return stands.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInArrow(run, schema)


def mined(
    rows: DataFrame, anchors, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, part: int = PART,
    scale: int = 256, id: str = "vec_id", label: str = "label", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), for the rows where `anchors` holds on `id`.

    An anchor's positives are its first `positives` other rows of its label by score.  For each, the negatives are the
    first rows of other labels whose score is at least `low` and at most `high` percent of the positive's.
    """
    taken = stored(vectors(rows, scale, id, label, vector), "vectors")
    cut, axes, d = tiled(taken, part)
    parts = stored(cut, "parts")
    asks = taken.where(anchors(F.col("id")))

    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    found = _per_task(parts, asks, d, axes, _positives(positives), "anchor long, id long, row long, score long")
    first = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    pairs = stored(first.select("anchor", "place", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # at most `positives` of them per anchor
    per = pairs.groupBy(F.col("anchor").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", F.col("positive_score").alias("score")))).alias("positives"))
    asks = stored(asks.join(per, "row"), "questions")
    best = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id", "row")
    found = _per_task(parts, asks, d, axes, _negatives(negatives, low, high), "anchor long, place int, id long, row long, score long")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    named = asks.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return (
        ranked.join(pairs, ["anchor", "place"])
        .join(named, "anchor")
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


#: The registered query in DuckDB's SQL: all anchors against all rows.
SQL = """
WITH given AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), vectors AS (
  SELECT id, label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM given
), scores AS (
  SELECT a.id AS anchor, a.label = b.label AS same, b.id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.id % 50 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor, id, score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS place FROM scores WHERE same
), negatives AS (
  SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score,
    row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM positives p JOIN scores s ON p.anchor = s.anchor AND NOT s.same
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
  WHERE p.place <= 5
)
SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, id AS negative_id,
  ps AS positive_score, score AS negative_score
FROM negatives WHERE rank <= 3
"""
