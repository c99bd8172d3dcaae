"""SentencePiece encoding and decoding by a max-plus scan.

The pieces of a BPE model over a text form a lattice: an arc from i to j for each piece that is the text between them.
A pair of pieces is compatible if the model encodes their joint text as just these two.  With weight 0 for a
compatible step and minus infinity for any other, exactly one path through the lattice has weight 0, and it is the
model's own encoding; so the best path under (max, +) gives the ids, without any order of merges.

That makes the encoding of a text a product of matrices.  A long text is cut into chunks of CHUNK characters,
wherever that falls.  The states of a cut are the pieces that start before it and end at it or after it; they depend on
a few characters to either side, so both neighbours list them alike.  Each chunk gives, by itself, the transfer
matrix from the states of its left cut to those of its right cut (0 or minus infinity, kept as bit masks).  A scan
over a document's matrices, forward and backward, leaves one state per cut, and each chunk then traces its own pieces
back, again by itself.  The scan sees a few numbers per chunk.

No piece crosses from a word to the space after it, so whatever lies between two spaces is one lattice of its own
and its path is remembered.  The constructor refuses models for which this does not hold.

Nulls and odd rows: no text and the empty text have no ids.  Characters without a piece become their UTF-8 bytes.
U+2581 is the model's sign for a space and decodes to one.  Every row gives one row, repeated ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import computed, per_worker, stored, widths

SPACE = "▁"
START, OTHER = -2, -1
#: Characters of a chunk; longer texts are encoded in several.
CHUNK = 1 << 15
#: Places in a worker's memory of encoded words.
CACHE = 400_000
#: Characters of texts whose new words are learned at once.
BLOCK = 1 << 19


class Pieces:
    """The lattice of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(len(self.names))]
        self.ids = {self.names[i]: i for i in range(len(self.names)) if plain[i]}
        self.rank = {name: (-model.get_score(i), i) for name, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # pieces by their signs from the first on, and from the last back
        self.tree: dict = {}
        self.ends: dict = {}
        for name, i in self.ids.items():
            for node, signs in ((self.tree, name), (self.ends, name[::-1])):
                for sign in signs:
                    node = node.setdefault(sign, {})
                node[0] = i
        self.bytes = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        if len(self.bytes) != 256 or any(SPACE in n.lstrip(SPACE) for n in self.ids):
            raise ValueError("needs a model with byte pieces and no piece across words")
        self.raw = [n.replace(SPACE, " ").encode() if plain[i] else b"" for i, n in enumerate(self.names)]
        for value, i in self.bytes.items():
            self.raw[i] = bytes([value])
        # a character without a piece stands alone, so text splits there as well
        self.units = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if "\n" in self.ids else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        self.made: dict[int, tuple[list, list, list]] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def history(self, piece: int) -> tuple[list, list, list]:
        """How the model makes a piece of its characters: the rank of each join, and what stands first and last before each and at the end."""
        found = self.made.get(piece)
        if found is None:
            parts, ranks = list(self.names[piece]), []
            first, last = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                rank, i = min((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                ranks.append(rank)
                first.append(parts[0])
                last.append(parts[-1])
            found = self.made[piece] = (ranks, first, last)
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether the model keeps a and b apart when b follows a.

        Both grow from characters, the join of best rank first and the left one of equals, until a join across
        the border would come next, or both are done.
        """
        if a < 0 or b < 0:
            return True
        key = a * len(self.names) + b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 2 * CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._apart(self.history(a), self.history(b))
        return found

    def _apart(self, a: tuple[list, list, list], b: tuple[list, list, list]) -> bool:
        i = j = 0
        while True:
            across = self.rank.get(a[2][i] + b[1][j])
            left = a[0][i] if i < len(a[0]) else None
            right = b[0][j] if j < len(b[0]) else None
            if across is not None and (left is None or across < left) and (right is None or across <= right):
                return False
            if left is not None and (right is None or left <= right):
                i += 1
            elif right is not None:
                j += 1
            else:
                return True

    def size(self, piece: int) -> int:
        return 1 if piece == OTHER else len(self.names[piece])

    def arcs(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of every piece that starts there."""
        node = self.tree
        if 0 not in node.get(text[start], ()):
            yield start + 1, OTHER
        for end in range(start, len(text)):
            node = node.get(text[end])
            if node is None:
                return
            if 0 in node:
                yield end + 1, node[0]

    def lattice(self, text: str, start: int, stop: int, entering: list[dict[int, int]]) -> list[dict[int, int]]:
        """Per place, the pieces that end there on a path of weight 0, with the mask of states it may have entered by.

        Pieces start in [start, stop); `entering` has the pieces that end from `start` on but start before it.
        """
        at: list[dict[int, int]] = [{} for _ in range(len(text) + 1 - start)]
        for k, found in enumerate(entering):
            at[k] = dict(found)
        compatible = self.compatible
        for place in range(start, stop):
            here = at[place - start]
            if not here:
                continue
            for end, piece in self.arcs(text, place):
                mask = 0
                for before, own in here.items():
                    if compatible(before, piece):
                        mask |= own
                if mask:
                    to = at[end - start]
                    to[piece] = to.get(piece, 0) | mask
        return at

    def trace(self, at: list[dict[int, int]], base: int, start: int, end: int, piece: int) -> list[int]:
        """Pieces of the path from place `start` to the one that ends with `piece`; `at` begins at place `base`."""
        out = []
        while end > start:
            out.append(piece)
            end -= self.size(piece)
            piece = next(p for p in at[end - base] if self.compatible(p, piece))
        return out[::-1]

    def learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of different words: each one's lattice with one way in, and the path of weight 0 through it.

        Up to any place just one path has weight 0, the encoding of what stands before it, so a place has one piece.
        It depends on the text before the place alone: words go in order, and one keeps the places that it shares with the
        word before.
        """
        pairs, wide, ends, names, compatible = self.pairs, len(self.names), self.ends, self.names, self.compatible
        found: dict[str, tuple[int, ...]] = {}
        at, previous = [START], ""
        for text in sorted(words):
            same = 0
            for x, y in zip(previous, text, strict=False):
                if x != y:
                    break
                same += 1
            del at[same + 1 :]
            previous = text
            for place in range(same + 1, len(text) + 1):
                node, begin, last = ends, place, None
                while begin:
                    begin -= 1
                    node = node.get(text[begin])
                    if node is None:
                        break
                    piece = node.get(0)
                    if piece is None:
                        continue
                    before = at[begin]
                    if before is None:
                        continue
                    fits = True if before < 0 else pairs.get(before * wide + piece)
                    if fits or fits is None and compatible(before, piece):
                        last = piece
                        break
                if last is None and text[place - 1] not in self.ids and at[place - 1] is not None:
                    last = OTHER
                at.append(last)
            path, place, plain = [], len(text), True
            while place:
                piece = at[place]
                path.append(piece)
                if piece == OTHER:
                    plain = False
                    place -= 1
                else:
                    place -= len(names[piece])
            path.reverse()
            found[text] = tuple(path) if plain else tuple(self.spelled(text, 0, path))
        return found

    def ids_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ids of texts that are given as their words."""
        known = self.known
        new = set().union(*texts).difference(known)
        if new and len(known) < CACHE:
            known.update(self.learn(new))
            new = set()
        if new:
            more = self.learn(new)
            of = lambda word: known.get(word) or more[word]
        else:
            of = known.__getitem__
        return [np.fromiter(chain.from_iterable(map(of, words)), np.int32) for words in texts]

    def spelled(self, text: str, start: int, pieces: list[int]) -> Iterator[int]:
        """Ids of pieces that stand in `text` from `start` on; characters without a piece give their bytes."""
        for piece in pieces:
            if piece == OTHER:
                yield from (self.bytes[b] for b in text[start].encode("utf-8", "surrogatepass"))
            else:
                yield piece
            start += self.size(piece)

    def begins(self, text: str, place: int) -> bool:
        """Whether `units` starts a new one there."""
        if not place:
            return True
        before, here = text[place - 1], text[place]
        return here == SPACE != before or "\n" not in self.ids and "\n" in (before, here)

    def words(self, text: str | None) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text that is one chunk."""
        return self.ids_of([self.words(text)])[0].tolist()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts that are one chunk each; the words of about BLOCK characters are learned together."""
        out: list[np.ndarray] = []
        start = held = 0
        for stop, text in enumerate(texts, 1):
            held += len(text or "")
            if held >= BLOCK or stop == len(texts):
                out += self.ids_of([self.words(t) for t in texts[start:stop]])
                start, held = stop, 0
        return out

    def decode(self, ids) -> str:
        """The text of ids, without the space that encoding puts first."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


class Chunk:
    """A cut-out of a text with as many characters to either side as a piece is long."""

    def __init__(self, pieces: Pieces, left: str, body: str, right: str):
        self.pieces, self.text = pieces, left + body + right
        self.start, self.stop = len(left), len(left) + len(body)
        self.first = not left
        self.entering = [(self.start, START)] if self.first else self.states(self.start)
        self.leaving = self.states(self.stop)
        inside = range(self.start, self.stop)
        #: The first and the last place inside where a word begins, if there is one.
        self.head = next((i for i in inside if pieces.begins(self.text, i)), None)
        self.tail = next((i for i in reversed(inside) if pieces.begins(self.text, i)), None)

    def states(self, cut: int) -> list[tuple[int, int]]:
        """(end, piece) of all pieces that start before the cut and end at it or later, in one fixed order."""
        found = []
        for begin in range(max(0, cut - self.pieces.longest), cut):
            found += [(end, piece) for end, piece in self.pieces.arcs(self.text, begin) if end >= cut]
        return sorted(found)

    def opened(self, masks: list[int], stop: int) -> list[dict[int, int]]:
        """The lattice from the left cut on, of pieces that start before `stop`."""
        text = self.text if stop == self.stop else self.text[:stop]
        entering: list[dict[int, int]] = [{} for _ in range(self.pieces.longest + 1)]
        for (end, piece), mask in zip(self.entering, masks, strict=True):
            if mask:
                entering[end - self.start][piece] = mask
        return self.pieces.lattice(text, self.start, stop, entering[: len(text) + 1 - self.start])

    def closed(self) -> list[dict[int, int]]:
        """The lattice of the last word that begins inside."""
        return self.pieces.lattice(self.text[self.tail :], 0, self.stop - self.tail, [{START: 1}])

    def matrix(self) -> list[int]:
        """For each leaving state the mask of entering ones that lead to it.

        Any two pieces may meet where a word begins, so a word inside has one state for all who come there: a matrix is
        the column of its first word times the row of its last, and words between them pass everything on.
        """
        masks = [1 << k for k in range(len(self.entering))]
        if self.head is None:
            at = self.opened(masks, self.stop)
            return [at[end - self.start].get(piece, 0) for end, piece in self.leaving]
        through = 0
        for mask in self.opened(masks, self.head)[self.head - self.start].values():
            through |= mask
        at = self.closed()
        return [through if at[end - self.tail].get(piece) else 0 for end, piece in self.leaving]

    def ids(self, entered: int, left: int) -> list[int]:
        """Ids of the pieces that start inside, on the path from one entering to one leaving state."""
        masks = [int(k == entered) for k in range(len(self.entering))]
        end, piece = self.leaving[left]
        begin = self.entering[entered][0]
        pieces, text = self.pieces, self.text
        if self.head is None:
            path = pieces.trace(self.opened(masks, self.stop), self.start, begin, end, piece)
            return list(pieces.spelled(text, begin, path))
        first: list[int] = []
        if begin < self.head:
            at = self.opened(masks, self.head)
            first = pieces.trace(at, self.start, begin, self.head, next(iter(at[self.head - self.start])))
        between = pieces.ids_of([pieces.units.findall(text[self.head : self.tail])])[0].tolist()
        last = pieces.trace(self.closed(), 0, 0, end - self.tail, piece)
        return [*pieces.spelled(text, begin, first), *between, *pieces.spelled(text, self.tail, last)]


def scan(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(entering, leaving) state of each chunk on the one path of weight 0 through all of them."""
    forward = [1]
    for matrix in matrices:
        forward.append(sum(1 << k for k, mask in enumerate(matrix) if mask & forward[-1]))
    out: list[tuple[int, int]] = []
    left = forward[-1].bit_length() - 1
    for matrix, before in zip(reversed(matrices), reversed(forward[:-1]), strict=True):
        entered = (matrix[left] & before).bit_length() - 1
        out.append((entered, left))
        left = entered
    return out[::-1]


def _chunks(longest: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = SPACE + text.replace(" ", SPACE)
                for no, start in enumerate(range(0, len(text), chunk)):
                    stop = min(start + chunk, len(text))
                    parts = [text[max(0, start - longest) : start], text[start:stop], text[stop : stop + longest]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key], pa.string()), pa.array([no], pa.int32()), *(pa.array([p], pa.string()) for p in parts)],
                        names=["key", "no", "left", "body", "right"],
                    )

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_worker(path, lambda: Pieces(path))
        for batch in batches:
            masks = [[str(m) for m in Chunk(pieces, *parts).matrix()] for parts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.list_(pa.string()))], names=["key", "no", "masks"])

    return run


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("no")
    states = scan([[int(m) for m in masks] for masks in rows["masks"]])
    return pd.DataFrame({"key": rows["key"].to_numpy(), "no": rows["no"].to_numpy(), "entered": [s[0] for s in states], "leaves": [s[1] for s in states]})


def _traced(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = per_worker(path, lambda: Pieces(path))
        for batch in batches:
            r = batch.to_pydict()
            ids = [
                Chunk(pieces, left, body, right).ids(entered, leaves)
                for left, body, right, entered, leaves in zip(r["left"], r["body"], r["right"], r["entered"], r["leaves"], strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "no", "ids"])

    return run


def long_texts(texts: DataFrame, path: str, chunk: int = CHUNK) -> DataFrame:
    """(key, ids, n_chunks) of (key, text): different texts, each encoded in chunks on many tasks."""
    pieces = Pieces(path)
    parts = stored(texts.select("key", "text").mapInArrow(_chunks(pieces.longest, chunk), "key string, no int, left string, body string, right string"), "chunks")
    spread = parts.repartition(widths(texts), "key", "no")
    matrices = spread.mapInArrow(_matrices(path), "key string, no int, masks array<string>")
    states = matrices.groupBy("key").applyInPandas(_scan, "key string, no int, entered int, leaves int")
    traced = parts.join(states, ["key", "no"]).mapInArrow(_traced(path), "key string, no int, ids array<int>")
    whole = traced.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("all"))
    return whole.select("key", F.flatten("all.ids").alias("ids"), F.size("all").alias("n_chunks"))


def encoded(docs: DataFrame, path: str, text: str = "text", chunk: int = CHUNK, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but `text`) of every row with ids, n_tokens, n_chunks and round_trip.

    round_trip: whether decoding the ids gives the text back.
    """
    keep = [c for c in docs.columns if c != text and c not in ("ids", "n_tokens", "n_chunks", "round_trip")] if keep is None else keep
    rows = docs.select(*keep, F.col(text).alias("_text"))
    long = F.coalesce(F.length("_text") >= chunk, F.lit(False))

    def short():
        pieces = per_worker(path, lambda: Pieces(path))

        def step(values: list) -> dict:
            ids = pieces.encode_all(values)
            same = [pieces.decode(i.tolist()) == (t or "").replace(SPACE, " ") for i, t in zip(ids, values, strict=True)]
            return {"ids": ids, "n_tokens": [len(i) for i in ids], "n_chunks": [int(len(i) > 0) for i in ids], "round_trip": same}

        return step

    added = "ids array<int>, n_tokens long, n_chunks int, round_trip boolean"
    out = computed(rows.where(~long), "_text", added, short)

    key = F.concat_ws("-", F.sha2("_text", 256), F.length("_text").cast("string"))
    large = rows.where(long).withColumn("_key", key)
    texts = large.groupBy(F.col("_key").alias("key")).agg(F.first("_text").alias("text"))
    found = stored(long_texts(texts, path, chunk).join(texts, "key"), "long_ids")

    def back():
        pieces = per_worker(path, lambda: Pieces(path))
        return lambda values: {"round_trip": [pieces.decode(v["ids"]) == v["text"].replace(SPACE, " ") for v in values]}

    checked = computed(found.withColumn("_both", F.struct("ids", "text")).drop("text"), "_both", "round_trip boolean", back)
    ids = large.drop("_text").join(checked.withColumnRenamed("key", "_found"), F.col("_key") == F.col("_found"))
    return out.union(ids.select(*keep, "ids", F.size("ids").cast("long").alias("n_tokens"), "n_chunks", "round_trip"))


def decoded(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns but `ids`, with the text of these; null ids give no text."""

    def make():
        pieces = per_worker(path, lambda: Pieces(path))
        return lambda values: {"text": [None if v is None else pieces.decode(v) for v in values]}

    return computed(rows.drop("text"), ids, "text string", make)
