"""Token counts of whole texts by byte-pair merging, without any ids.

The characters of a text stand in a doubly linked list; a heap holds every adjacent pair that the model can join, by
the pair's rank and then its place.  The best pair is popped and joined until none is left; each join makes the list
one shorter, so the count is the number of characters less the number of joins, plus what characters without a
piece of their own take in bytes.  A heap entry whose two parts have changed since it was pushed is passed over.

No join reaches across two characters that stand side by side in no piece, so a text falls into units there, whose
counts add up: at spaces, and between letters and other signs as far as the model allows.  The constructor derives
both from the vocabulary.  Counts of words and units are remembered, up to CACHE of each per worker; any other is
counted anew.  A unit of more than LONG characters is cut at every pair of characters that no piece holds, and what
then remains uncut is one heap: memory follows the longest stretch that the model could join.

Nulls and odd rows: no text and the empty text have 0 bytes and 0 tokens.  Special strings in a text are plain text.
Every row gives one row, repeated ones too, whatever else the table holds; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import computed, per_worker

SPACE = "▁"
#: Entries of a worker's memory, of words and of units.
CACHE = 600_000
#: Characters of a text that are split into words at once, and of a unit from which on it is cut finer.
SLICE = 1 << 16
LONG = 256


class Merges:
    """Joins of a SentencePiece BPE model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(model.get_piece_size())
        plain = [i for i in pieces if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        if sum(map(model.is_byte, pieces)) != 256 or any(SPACE in n.lstrip(SPACE) for n in names):
            raise ValueError("needs a model with byte pieces and no piece across words")
        if model.encode("  A  ﬁ", out_type=str) != self.spelled(model, "  A  ﬁ"):
            raise ValueError("needs a model that leaves texts as they are, with one space before")
        self.rank = names
        self.adjacent = {n[i : i + 2] for n in names for i in range(len(n) - 1)}
        apart = self._signs()
        letter = f"[^\\W\\d_{re.escape(''.join(sorted(apart)))}]"
        other = f"(?:(?!{letter})[^{SPACE}])"
        self.units = re.compile(f"{SPACE}*{letter}+|{SPACE}*{other}+|{SPACE}+")
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.of_unit: dict[str, int] = {}
        self.of_word = _Words(self)

    @staticmethod
    def spelled(model, text: str) -> list[str]:
        """`text` joined by the model from characters without any change, which `encode` must agree with."""
        ids = model.encode(text)
        back = b"".join(bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids)
        return [model.id_to_piece(i) for i in ids] if back == b" " + text.encode() else []

    def _signs(self) -> set[str]:
        """Letters that stand beside a sign in some piece, which therefore count as signs themselves."""
        letter = re.compile(r"[^\W\d_]")
        found: set[str] = set()
        while True:
            is_letter = lambda c: bool(letter.match(c)) and c not in found
            more = {c for a in self.adjacent if SPACE not in a and is_letter(a[0]) != is_letter(a[1]) for c in a if is_letter(c)}
            if not more:
                return found
            found |= more

    def merged(self, unit: str) -> int:
        """Tokens of one unit by the heap and the linked list."""
        rank, size = self.rank, len(unit)
        parts = list(unit)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        heap = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, parts, parts[1:])) if pair in rank]
        heapq.heapify(heap)
        joins = 0
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            # the left part is gone, or the two are no longer these
            if not parts[left] or right >= size or parts[left] + parts[right] != pair:
                continue
            parts[left], parts[right] = pair, ""
            joins += 1
            end = after[left] = after[right]
            if end < size:
                before[end] = left
                wider = pair + parts[end]
                if wider in rank:
                    heapq.heappush(heap, (rank[wider], left, wider))
            start = before[left]
            if start >= 0:
                wider = parts[start] + pair
                if wider in rank:
                    heapq.heappush(heap, (rank[wider], start, wider))
        return size - joins + sum(len(c.encode()) - 1 for c in unit if c not in rank)

    def unit(self, unit: str) -> int:
        found = self.of_unit.get(unit)
        if found is None:
            if len(unit) > LONG:
                return sum(map(self.merged, self._cut(unit)))
            found = self.merged(unit)
            if len(self.of_unit) < CACHE:
                self.of_unit[unit] = found
        return found

    def _cut(self, unit: str):
        start = 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in self.adjacent:
                yield unit[start:i]
                start = i
        yield unit[start:]

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        total, start = 0, 0
        # a slice ends before a space that follows another sign, so no unit is cut
        while start < len(text):
            stop = start + SLICE
            if stop < len(text):
                found = _BREAK.search(text, stop - 1)
                stop = found.start() + 1 if found else len(text)
            total += self._slice(text[start:stop] if start else " " + text[start:stop])
            start = stop
        return total

    def _slice(self, part: str) -> int:
        words = part.split(" ")
        # single spaces only, each before a word
        if not words[0] and "" not in words[1:] and SPACE not in part:
            return sum(map(self.of_word.__getitem__, words[1:]))
        return sum(map(self.of_word.spaced, self.words.findall(part.replace(" ", SPACE))))


#: A sign with a space after it.
_BREAK = re.compile("[^ ▁](?= )")


class _Words(dict):
    """Tokens of a word with one space before it, by the word alone."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, word: str) -> int:
        value = sum(map(self.merges.unit, self.merges.units.findall(SPACE + word)))
        if len(self) < CACHE and len(word) <= LONG:
            self[word] = value
        return value

    def spaced(self, word: str) -> int:
        """The same of a word with any number of spaces before it."""
        if word[:1] == SPACE != word[1:2] and len(word) > 1:
            return self[word[1:]]
        return sum(map(self.merges.unit, self.merges.units.findall(word)))


def counted(docs: DataFrame, model: str, limit: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) of each row with n_bytes, n_tokens and over_limit (n_tokens > `limit`).

    One narrow pass: no shuffle, and each text is read once in the task that holds it.
    """

    def make():
        merges = per_worker(("counts", model), lambda: Merges(model))
        return lambda texts: {"n_tokens": [merges.count(t) for t in texts]}

    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_bytes"), F.col(text).alias("_text"))
    return computed(rows, "_text", "n_tokens long", make).withColumn("over_limit", F.col("n_tokens") > limit)
