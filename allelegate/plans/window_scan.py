"""The open window at the start of each range of (key, time), by a scan over maps.

What a range does to the window that is open where it begins is a map from windows to windows, and such maps compose:
`then` is associative, so any bracketing gives the same map.  A range's map is a step function.  With `until` the
time from which on a new window may open, it depends on the first attempt at or after `until` only; from there the
chain of openers is fixed, and its last one inside the range comes from doubling the links from each attempt to the
next opener.  An `until` after the last attempt is handed on, with all attempts counted.

Maps are rows for `plans.range_scan`, cut into chunks of CHUNK steps.  A map holds the attempts of one key in one window
length at most, because no window that is open at a key's first attempt of a range lasts longer.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from allelegate.plans.range_scan import Maps, as_batch

CHUNK = 2048
NO_STEPS = np.empty(0, "int64")


@dataclass(frozen=True)
class Window:
    """The window of `key` that is open: until when, and its attempts so far; `until` None: none is."""

    key: Any
    until: int | None
    count: int


@dataclass(frozen=True)
class WindowMap:
    """From the window open before a range to the one open after it.

    The window before matters only if the range has one key (`same`) and it is that window's key; for any other, the
    window after is `fresh`.  Then an `until` in (breaks[i - 1], breaks[i]] gives (untils[i], counts[i]), and a
    later one stays, with `rows` more attempts.
    """

    first: Any
    last: Any
    fresh: Window
    same: bool
    rows: int
    #: No window open before the range is open longer than this; None: any may be.
    limit: int | None
    breaks: np.ndarray
    untils: np.ndarray
    counts: np.ndarray

    def after(self, window: Window | None) -> Window:
        if not self.same or window is None or window.key != self.first or window.until is None:
            return self.fresh
        i = int(np.searchsorted(self.breaks, window.until, "left"))
        if i < len(self.breaks):
            return Window(self.last, int(self.untils[i]), int(self.counts[i]))
        return Window(self.last, window.until, window.count + self.rows)

    def then(self, other: WindowMap) -> WindowMap:
        """This range and the one after it as one."""
        fresh = other.after(self.fresh)
        if not (self.same and other.same and self.last == other.first):
            return WindowMap(self.first, other.last, fresh, False, 0, None, NO_STEPS, NO_STEPS, NO_STEPS)
        i = np.searchsorted(other.breaks, self.untils, "left")
        inside = i < len(other.breaks)
        untils, counts = self.untils.copy(), self.counts + other.rows
        untils[inside], counts[inside] = other.untils[i[inside]], other.counts[i[inside]]
        # windows that are still open when the second range begins
        more = other.breaks > self.breaks[-1] if len(self.breaks) else np.ones(len(other.breaks), bool)
        steps = [np.concatenate(x) for x in ((self.breaks, other.breaks[more]), (untils, other.untils[more]), (counts, other.counts[more]))]
        limit = self.limit if self.rows else other.limit
        return WindowMap(self.first, other.last, fresh, True, self.rows + other.rows, limit, *_needed(*steps, limit))


def _needed(breaks: np.ndarray, untils: np.ndarray, counts: np.ndarray, limit: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Steps up to `limit`, each run of equal ones as one."""
    if limit is not None:
        end = int(np.searchsorted(breaks, limit, "left")) + 1
        breaks, untils, counts = breaks[:end], untils[:end], counts[:end]
    last = np.ones(len(breaks), bool)
    last[:-1] = (untils[1:] != untils[:-1]) | (counts[1:] != counts[:-1])
    return breaks[last], untils[last], counts[last]


def last_openers(times: np.ndarray, width: int) -> np.ndarray:
    """For each of the sorted `times`, the last one to open a window if that one opens one, by doubling the links."""
    ahead = np.searchsorted(times, times + width, "left")
    link = np.where(ahead < len(times), ahead, np.arange(len(times)))
    while True:
        further = link[link]
        if (further == link).all():
            return link
        link = further


def map_of(first: Any, last: Any, times: np.ndarray, width: int, start: int | None, count: int) -> WindowMap:
    """Map of a range from the last key's sorted `times`; `start` and `count` are the window that this key had open before all."""
    link = last_openers(times, width)
    seed = None if start is None else start + width
    at = 0 if seed is None else int(np.searchsorted(times, seed, "left"))
    if at < len(times):
        fresh = Window(last, int(times[link[at]]) + width, int(len(times) - link[at]))
    else:
        fresh = Window(last, seed, count + len(times))
    if first != last:
        return WindowMap(first, last, fresh, False, 0, None, NO_STEPS, NO_STEPS, NO_STEPS)
    new = np.ones(len(times), bool)
    new[1:] = times[1:] != times[:-1]
    limit = None if not len(times) else max(int(times[0]), int(times[0]) if start is None else start) + width
    steps = _needed(times[new], times[link[new]] + width, len(times) - link[new], limit)
    return WindowMap(first, last, fresh, True, len(times), limit, *steps)


class WindowMaps(Maps):
    """Window maps as rows of at most CHUNK steps."""

    STEPS = ["breaks", "untils", "counts"]

    def __init__(self, key: T.DataType):
        self.key = key
        self.state = [("until", T.LongType()), ("count", T.LongType())]

    def schema(self, places: list[str]) -> T.StructType:
        whole, steps = T.LongType(), T.ArrayType(T.LongType())
        names = [("first", self.key), ("last", self.key), ("until", whole), ("count", whole), ("same", T.BooleanType()), ("rows", whole), ("limit", whole)]
        names += [(c, steps) for c in self.STEPS]
        return T.StructType([T.StructField(p, T.IntegerType()) for p in [*places, "chunk"]] + [T.StructField(*n) for n in names])

    def rows(self, m: WindowMap, places: tuple[int, ...], schema: T.StructType) -> pa.RecordBatch:
        head = [m.first, m.last, m.fresh.until, m.fresh.count, m.same, m.rows, m.limit]
        cuts = range(0, max(len(m.breaks), 1), CHUNK)
        return as_batch([[*places, i, *head, *(x[a : a + CHUNK] for x in (m.breaks, m.untils, m.counts))] for i, a in enumerate(cuts)], schema)

    def whole(self, head: dict, steps: list[list[pa.ListScalar]]) -> WindowMap:
        joined = [np.concatenate([x[i].values.to_numpy() for x in steps]) for i in range(3)]
        fresh = Window(head["last"], head["until"], head["count"])
        return WindowMap(head["first"], head["last"], fresh, head["same"], head["rows"], head["limit"], *joined)

    def pack(self, window: Window) -> tuple | None:
        return None if window.until is None else (window.until, window.count)

    def unpack(self, key: Any, until: int, count: int) -> Window:
        return Window(key, until, count)
