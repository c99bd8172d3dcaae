"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

1. Every token falls into one of BUCKETS hash buckets, each with a fixed index vector of
   +1 and -1 in NONZERO of DIM places.  One pass over all documents adds to a bucket the index vectors of
   the tokens beside it: its context vector.  The sums are whole numbers, so the order of tasks changes
   nothing, and their table has BUCKETS rows however large the corpus is.
2. A document is the mean of its tokens' context and index vectors.
3. A two-layer network is fitted with numpy on at most `sample` labelled documents (taken by the hash of
   their id) and its probabilities are calibrated with a temperature on a fifth of them.
4. A second pass scores every document.

Nulls and odd rows: a document without tokens has the zero vector and gets the network's score for it.
Labels without id or mark are not used; several marks of one document count as their majority, and a tie as 0.
Without labels of both kinds, every score is the share of label 1 (0.5 without labels).
Every row of the input gives one row, repeated ones too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelegate.llm.tables import computed, per_worker

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 32, 4, 2
#: Tokens handled at once, in long texts too.
SLICE = 1 << 16
#: Default bound of the labelled documents that the network sees.
SAMPLE = 20_000
#: Places in a worker's memory of token buckets.
CACHE = 250_000

TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """NONZERO places of each bucket: the first half counts +1, the rest -1.  The last row is the end of a text: no vector."""
    rng = np.random.default_rng(20_11)
    places = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
    dense = np.zeros((BUCKETS, DIM), np.float32)
    rows = np.arange(BUCKETS)
    for k in range(NONZERO):
        dense[rows, places[:, k]] = 1 if k < NONZERO // 2 else -1
    return places, dense


class Buckets(dict):
    def __missing__(self, token):
        value = xxhash.xxh3_64_intdigest(token) % BUCKETS
        if len(self) < CACHE:
            self[token] = value
        return value

    def slices(self, text: str | None) -> Iterator[np.ndarray]:
        """Buckets of a text's tokens, at most about SLICE at a time."""
        if not text:
            return
        if len(text) <= 4 * SLICE:
            tokens = TOKEN.findall(text)
            yield np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
            return
        found = TOKEN.finditer(text)
        while tokens := [m.group() for m in islice(found, SLICE)]:
            yield np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def _add_context(total: np.ndarray, tokens: np.ndarray, places: np.ndarray) -> None:
    """Add to each token's row the index vectors of its neighbours; bucket BUCKETS separates texts."""
    size = BUCKETS * DIM
    for away in range(1, WINDOW + 1):
        for own, near in ((tokens[:-away], tokens[away:]), (tokens[away:], tokens[:-away])):
            real = (own < BUCKETS) & (near < BUCKETS)
            base, near = own[real] * DIM, near[real]
            for k in range(NONZERO):
                counts = np.bincount(base + places[near, k], minlength=size)
                if k < NONZERO // 2:
                    total += counts
                else:
                    total -= counts


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    buckets, (places, _) = per_worker("buckets", Buckets), index_vectors()
    total, waiting, n = np.zeros(BUCKETS * DIM, np.int64), [], 0
    end = np.full(WINDOW, BUCKETS)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for part in buckets.slices(text):
                waiting.append(part)
                n += len(part)
                if n > 8 * SLICE:
                    _add_context(total, np.concatenate(waiting), places)
                    # a long text goes on: its last tokens are the next part's neighbours
                    waiting, n = [end], 0
            waiting.append(end)
    if n:
        _add_context(total, np.concatenate(waiting), places)
    table = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(table.any(axis=1))
    names = ["bucket", *(f"c{i}" for i in range(DIM))]
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(table[used, i]) for i in range(DIM))], names=names)


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """BUCKETS x 2 DIM: context direction and index vector of each bucket, from all documents."""
    columns = [f"c{i}" for i in range(DIM)]
    parts = docs.select(F.col(text).alias("_text")).mapInArrow(_contexts, "bucket long, " + ", ".join(f"{c} long" for c in columns))
    # at most BUCKETS rows, whatever the corpus holds
    rows = parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    context = np.zeros((BUCKETS, DIM), np.float32)
    if rows.num_rows:
        context[rows["bucket"].to_numpy()] = np.stack([rows[c].to_numpy() for c in columns], axis=1)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    context = np.divide(context, length, out=np.zeros_like(context), where=length > 0)
    return np.concatenate([context, index_vectors()[1] / np.sqrt(NONZERO, dtype=np.float32)], axis=1)


def pooled(buckets: Buckets, vectors: np.ndarray, text: str | None) -> np.ndarray:
    """Mean vector of a whole text."""
    total, n = np.zeros(vectors.shape[1]), 0
    for part in buckets.slices(text):
        total += vectors[part].sum(axis=0, dtype=np.float64)
        n += len(part)
    return total / max(n, 1)


class Network:
    """Two layers on standardised vectors; `probability` is temperature-calibrated."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 5):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.constant = len(np.unique(y)) < 2
        if self.constant:
            return
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        held, own = order[: len(y) // 5], order[len(y) // 5 :]
        if len(np.unique(y[own])) < 2 or not len(held):
            held = own = order
        self.mean, self.scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
        z = self.standard(x)
        weights = [
            rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
            np.zeros(hidden),
            rng.normal(0, 1 / np.sqrt(hidden), hidden),
            np.array(np.log(y[own].mean() / (1 - y[own].mean()))),
        ]
        mean, square, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
        for _ in range(epochs):
            shuffled = rng.permutation(own)
            for start in range(0, len(shuffled), 256):
                part = shuffled[start : start + 256]
                inner = np.tanh(z[part] @ weights[0] + weights[1])
                p = 1 / (1 + np.exp(-(inner @ weights[2] + weights[3])))
                d = (p - y[part]) / len(part)
                back = d[:, None] * weights[2][None, :] * (1 - inner**2)
                grads = [z[part].T @ back + 1e-4 * weights[0], back.sum(axis=0), inner.T @ d + 1e-4 * weights[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g**2
                    weights[k] = weights[k] - 0.01 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        self.weights, self.temperature = weights, 1.0
        logits, marks = self.logits(x[held]), y[held]
        loss = {t: float(np.mean(np.logaddexp(0, logits / t) - marks * logits / t)) for t in np.geomspace(0.25, 8, 61)}
        self.temperature = float(min(loss, key=loss.get))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        inner = np.tanh(self.standard(x) @ self.weights[0] + self.weights[1])
        return inner @ self.weights[2] + self.weights[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))


def held_out(id: str) -> F.Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", mark: str = "quality") -> Network:
    """The network of at most `sample` labelled documents that are not held out."""
    marks = (
        labels.where(F.col(id).isNotNull() & F.col(mark).isNotNull() & ~held_out(id))
        .groupBy(F.col(id).alias("_id"))
        .agg((F.avg(F.col(mark)) > 0.5).cast("int").alias("_mark"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(sample)
    )
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(marks), "_id").groupBy("_id", "_mark").agg(F.min("_text").alias("_text"))

    def make():
        buckets = per_worker("buckets", Buckets)
        return lambda values: {"_vector": [pooled(buckets, vectors, t) for t in values]}

    rows = computed(texts.select("_id", "_mark", "_text"), "_text", "_vector array<double>", make).toArrow().sort_by("_id")
    x = np.array(rows["_vector"].to_pylist()).reshape(rows.num_rows, vectors.shape[1])
    return Network(x, rows["_mark"].to_numpy().astype(float))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id: str = "doc_id", text: str = "text", mark: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of every row (its id by default) with held_out, score and predicted."""
    vectors = word_vectors(docs, text)
    network = fit(docs, labels, vectors, sample, id, text, mark)
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))  # BUCKETS x 2 DIM numbers and the weights

    def make():
        buckets, (table, model) = per_worker("buckets", Buckets), sent.value

        def step(values: list) -> dict:
            x = np.array([pooled(buckets, table, t) for t in values]).reshape(len(values), table.shape[1])
            return {"score": model.probability(x)}

        return step

    keep = [id] if keep is None else keep
    rows = docs.select(*keep, held_out(id).alias("held_out"), F.col(text).alias("_text"))
    return computed(rows, "_text", "score double", make).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
