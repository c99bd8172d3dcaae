"""Token ids in fixed-width bit packing.

File format (version 1): a folder of Parquet files, one row per block, in ascending order of document.
A block holds whole documents and closes once it has BLOCK ids; a longer document has a block of its own.

| column | meaning |
|---|---|
| shard, block | place of the block: task that wrote it, and number in it, both from 0 |
| bits | bits per id: the fewest that hold the vocabulary's largest id |
| first | ids of the same shard before the block |
| doc_ids, starts | the block's documents, and where each begins in the block, with the end as last entry |
| payload | ids back to back, `bits` bits each, lowest bit first, padded to a byte at the end |

Id i of a block lies at bit `bits * i`, so any range is read without what stands before it (`unpack`), and
`starts` is the block's offset table.  Spark's writer commits files task by task: a lost executor's task is
written again, and no half-written file is ever seen.

Nulls and odd rows: no text is the empty text, which has the end id only.  A null document id comes first.
Rows with the same id stay separate rows, in the order of their texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelegate.llm.tables import per_worker, widths
from allelegate.plans.session import scratch_path

BLOCK = 1 << 16
#: Places in a worker's memory of encoded words.
CACHE = 700_000
FORMAT = "shard int, block int, bits int, first long, doc_ids array<long>, starts array<long>, payload binary"


def width(largest: int) -> int:
    """Fewest bits that hold ids up to `largest`."""
    return max(1, int(largest).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`bits` low bits of each id, back to back."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()).bit_length() > bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):  # whole bytes, in the same order
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=bits, bitorder="little")
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block; only their own bytes are touched."""
    if stop <= start:
        return np.empty(0, np.uint32)
    if bits in (8, 16, 32):
        size = bits // 8
        return np.frombuffer(payload, f"<u{size}", stop - start, size * start).astype("<u4")
    low = bits * start // 8
    raw = np.frombuffer(payload, np.uint8)[low : (bits * stop + 7) // 8]
    skip = bits * start - 8 * low
    flags = np.zeros((stop - start, 32), np.uint8)
    flags[:, :bits] = np.unpackbits(raw, bitorder="little")[skip : skip + bits * (stop - start)].reshape(-1, bits)
    return np.packbits(flags, axis=1, bitorder="little").view("<u4").ravel()


#: A word of letters that normalisation only lower-cases, and signs that stand apart from it.
PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?%&*#$|()]*)")


class Encoder:
    """Ids of whole texts by the `tokenizers` library.

    The vocabulary's pattern never joins text across a space or line feed and drops both, so the ids of a
    text are those of its parts between them one after the other; repeated parts are encoded once.  Likewise
    it sets letters apart from the signs after them, and folds case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.bar = self.tokenizer.encode_batch_fast(["|"], add_special_tokens=False)[0].ids

    def words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters, many of them in one text: a text costs more than a word, and bars tell words apart."""
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        texts = [" | ".join(group) for group in groups]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            bars = 4 * np.flatnonzero(ids == self.bar[0])
            if len(self.bar) != 1 or len(bars) != len(group) - 1:
                raise ValueError("the vocabulary has no token of its own for |")
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip([0, *(bars + 4).tolist()], [*bars.tolist(), len(raw)], strict=True))

    def learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of new parts, as bytes of unsigned 32-bit numbers; remembered while there is room."""
        known = self.known
        plain, letters, others = {}, set(), set()
        for part in parts:
            found = PLAIN.fullmatch(part)
            if found:
                plain[part] = pieces = found[1].lower(), found[2]
                letters.add(pieces[0])
                others.add(pieces[1])
            else:
                plain[part] = (part,)
                others.add(part)
        words = [word for word in letters if word not in known]
        new = [piece for piece in others if piece not in known]
        fresh = {"": b""} | dict(zip(words, self.words(words), strict=True))
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            fresh[piece] = np.array(found.ids, "<u4").tobytes()
        out = {part: b"".join([fresh[x] if x in fresh else known[x] for x in pieces]) for part, pieces in plain.items()}
        if len(known) < CACHE:
            known.update(fresh)
            known.update(out)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = [(t or "").replace("\n", " ").split(" ") for t in texts]
        held = [list(map(self.known.get, words)) for words in parts]
        new = {w for words, ids in zip(parts, held, strict=True) if None in ids for w, x in zip(words, ids, strict=True) if x is None}
        if new:
            learned = self.learn(new)
            for words, ids in zip(parts, held, strict=True):
                if None in ids:
                    ids[:] = [learned[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return [np.frombuffer(b"".join(ids), "<u4") for ids in held]


def _blocks(path: str, end: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, first = TaskContext.get().partitionId(), 0, 0
        encoder = per_worker(path, lambda: Encoder(path))
        ids: list[np.ndarray] = []
        docs: list[int | None] = []
        starts = [0]

        def row() -> pa.RecordBatch:
            values = [[shard], [block], [bits], [first], [docs], [starts], [pack(np.concatenate(ids), bits)]]
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["shard", "block", "bits", "first", "doc_ids", "starts", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, found in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    docs.append(doc)
                    ids.append(np.append(found, np.uint32(end)))
                    starts.append(starts[-1] + len(ids[-1]))
                    if starts[-1] >= BLOCK:
                        yield row()
                        block, first = block + 1, first + starts[-1]
                        ids, docs, starts = [], [], [0]
        if docs:
            yield row()

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int, id: str = "doc_id", text: str = "text") -> None:
    """Encode every row's whole text, append `end`, and write the files in ascending order of id."""
    from tokenizers import Tokenizer

    bits = width(max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end))
    rows = docs.select(F.col(id).cast("long").alias("_id"), F.col(text).alias("_text"))
    # equal ids stand in the order of their texts, wherever they came from
    spread = F.xxhash64("_text")
    ordered = rows.repartitionByRange(widths(docs), F.col("_id"), spread).sortWithinPartitions("_id", spread, "_text")
    ordered.mapInArrow(_blocks(tokenizer, end, bits), FORMAT).write.parquet(folder)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: dict[str, list] = {"shard": [], "doc_id": [], "within": [], "n_tokens": [], "ids_crc32": []}
        for r in batch.to_pylist():
            stops = r["starts"]
            for doc, start, stop in zip(r["doc_ids"], stops[:-1], stops[1:], strict=True):
                ids = unpack(r["payload"], r["bits"], start, stop)
                rows["shard"].append(r["shard"])
                rows["doc_id"].append(doc)
                rows["within"].append(r["first"] + start)
                rows["n_tokens"].append(len(ids))
                rows["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
        types = [pa.int32()] + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the written documents; start counts the ids of all documents before."""
    files = spark.read.schema(FORMAT).parquet(folder)
    # one number per shard, so the table and its running sum have as many rows as there are files
    totals = files.groupBy("shard").agg(F.sum(F.element_at("starts", -1)).alias("ids")).collect()
    before, base = 0, []
    for shard, n in sorted((r["shard"], r["ids"]) for r in totals):
        base.append((shard, before))
        before += n
    bases = spark.createDataFrame(base, "shard int, base long")
    rows = files.mapInArrow(_documents, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(bases), "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def read_range(spark: SparkSession, folder: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """Ids of a few named documents, from their blocks only."""
    asked = F.array(*(F.lit(d).cast("long") for d in doc_ids))
    rows = spark.read.schema(FORMAT).parquet(folder).where(F.arrays_overlap("doc_ids", asked)).collect()
    return {d: unpack(r["payload"], r["bits"], r["starts"][k], r["starts"][k + 1]) for r in rows for k, d in enumerate(r["doc_ids"]) if d in set(doc_ids)}


def packed(docs: DataFrame, tokenizer: str, end: int = 1, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write `docs` into a folder of this run, and return what the files hold per document."""
    folder = scratch_path(docs.sparkSession, "ids")
    write_ids(docs, folder, tokenizer, end, id, text)
    return read_documents(docs.sparkSession, folder)
