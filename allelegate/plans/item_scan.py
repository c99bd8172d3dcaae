"""Which item a (patient, medication) pair holds at the start of each range of its changes, by a scan over maps.

A pair holds no item or the item of some id.  An add turns no item into a new one and leaves any other; a remove
turns the item that it names into none and leaves any other.  Both are maps of "no item or an id", and so is any run of
them: it says what becomes of no item, and of each id that is removed on the way; other ids stay.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import types as T

from allelegate.plans.range_scan import Maps, as_batch

CHUNK = 2048


@dataclass(frozen=True)
class Held:
    """The item that a pair holds; None: none."""

    key: str | None
    id: str | None


@dataclass(frozen=True)
class ItemMap:
    """From the item held before a range to the one held after it; any other key than `first` ends as `fresh`."""

    first: str | None
    last: str | None
    fresh: Held
    same: bool
    absent: str | None
    moved: dict[str, str | None]

    def image(self, id: str | None) -> str | None:
        return self.absent if id is None else self.moved.get(id, id)

    def after(self, held: Held | None) -> Held:
        return Held(self.last, self.image(held.id)) if self.same and held is not None and held.key == self.first else self.fresh

    def then(self, other: ItemMap) -> ItemMap:
        """This range and the one after it as one."""
        fresh = other.after(self.fresh)
        if not (self.same and other.same and self.last == other.first):
            return ItemMap(self.first, other.last, fresh, False, None, {})
        moved = other.moved | {k: other.image(v) for k, v in self.moved.items()}
        return ItemMap(self.first, other.last, fresh, True, other.image(self.absent), moved)


def item_map(first: str | None, last: str | None, stored: str | None, changes: Iterable[tuple[str | None, str | None]]) -> ItemMap:
    """Map of a range from the last key's changes (id added, id removed) in order; `stored` is what that key held before all."""
    # ids before the range by what has become of them; 0 stands for no item before it
    now: dict[str | None, list] = {None: [0]}
    seen = set()
    for added, removed in changes:
        if added is not None and now.get(None):
            now.setdefault(added, []).extend(now.pop(None))
        elif removed is not None:
            gone = now.pop(removed, [])
            if removed not in seen:
                gone.append(removed)
            seen.add(removed)
            rest = now.get(None, [])
            long, short = (rest, gone) if len(rest) > len(gone) else (gone, rest)
            long.extend(short)
            now[None] = long
    ends = {k: value for value, keys in now.items() for k in keys}
    absent = ends.pop(0)
    whole = ItemMap(last, last, Held(last, None), True, absent, ends)
    fresh = whole.after(Held(last, stored))
    return ItemMap(first, last, fresh, True, absent, ends) if first == last else ItemMap(first, last, fresh, False, None, {})


def held_before(stored: str | None, changes: Iterable[tuple[str | None, str | None]]) -> list[str | None]:
    """The item held before each change, one after the other."""
    out, held = [], stored
    for added, removed in changes:
        out.append(held)
        if held is None:
            held = added
        elif removed == held:
            held = None
    return out


class ItemMaps(Maps):
    """Item maps as rows of at most CHUNK moved ids."""

    STEPS = ["ids", "ends"]
    key = T.StringType()
    state = [("there", T.BooleanType()), ("id", T.StringType())]

    def schema(self, places: list[str]) -> T.StructType:
        text, many = T.StringType(), T.ArrayType(T.StringType())
        names = [("first", text), ("last", text), ("fresh", text), ("same", T.BooleanType()), ("absent", text), ("ids", many), ("ends", many)]
        return T.StructType([T.StructField(p, T.IntegerType()) for p in [*places, "chunk"]] + [T.StructField(*n) for n in names])

    def rows(self, m: ItemMap, places: tuple[int, ...], schema: T.StructType) -> pa.RecordBatch:
        ids, ends = list(m.moved), list(m.moved.values())
        cuts = range(0, max(len(ids), 1), CHUNK)
        return as_batch([[*places, i, m.first, m.last, m.fresh.id, m.same, m.absent, ids[a : a + CHUNK], ends[a : a + CHUNK]] for i, a in enumerate(cuts)], schema)

    def whole(self, head: dict, steps: list) -> ItemMap:
        moved = {k: v for ids, ends in steps for k, v in zip(ids.as_py(), ends.as_py(), strict=True)}
        return ItemMap(head["first"], head["last"], Held(head["last"], head["fresh"]), head["same"], head["absent"], moved)

    def pack(self, held: Held) -> tuple:
        return held.id is not None, held.id

    def unpack(self, key: str | None, there: bool, id: str | None) -> Held:
        return Held(key, id)
