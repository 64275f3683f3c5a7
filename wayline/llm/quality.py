"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network in numpy.

Words are hashed to buckets. A bucket's index vector is sparse and random, from its number alone; its word
vector is the sum of the index vectors of its neighbours over the whole corpus, added up in Spark as partial
sums per task. A document is the mean and the spread of its words' vectors. The network is trained on a
bounded sample of labelled documents and its probabilities are calibrated by a temperature on held-back rows.

Defined cases: doc_id is an integer or null; null and empty texts have zero vectors and get a score like any other; documents without a
label are scored; labels other than 0 and 1 are left out; without both labels in the sample every score
is the share of label 1, or 0.5 where there is none; repeated rows give repeated rows, and repeated labels of one id
count as often; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import hashed_sample, written

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 15, 32, 2, 2
#: Labelled rows that the network learns from, at most, chosen by a hash of the id.
SAMPLE_ROWS = 20_000
HIDDEN, EPOCHS, RATE, SEED = 32, 40, 3e-3, 7
#: Steps of 64 rows that training takes, within EPOCHS to MOST_EPOCHS passes.
STEPS, MOST_EPOCHS = 40_000, 400
#: Words of a chunk that is summed at once; words a worker remembers the bucket of, and the bytes of the longest of these.
CHUNK, REMEMBERED, LONGEST = 1 << 20, 500_000, 64
TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[!-/:-@\[-`{-~]+").findall


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        k = zlib.crc32(word) % BUCKETS
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = k
        return k


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero entries of every bucket's index vector; one more bucket, of zeros, ends documents."""
    rng = np.random.default_rng(SEED)
    places = rng.integers(0, DIMENSIONS, (BUCKETS + 1, NONZERO))
    signs = rng.choice([-1.0, 1.0], (BUCKETS + 1, NONZERO))
    signs[BUCKETS] = 0
    return places, signs


def _ids(text: str | None, buckets: _Buckets) -> np.ndarray:
    words = TOKENS((text or "").encode("utf-8", "replace").lower())
    return np.fromiter(map(buckets.__getitem__, words), np.int64, len(words))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places, signs = index_vectors()
    total = np.zeros((BUCKETS + 1) * DIMENSIONS)
    buckets, held, n, end = _Buckets(), [], 0, np.full(REACH, BUCKETS)

    def add() -> None:
        ids = np.concatenate(held)
        for k in range(1, REACH + 1):
            for a, b in ((ids[:-k], ids[k:]), (ids[k:], ids[:-k])):
                for j in range(NONZERO):
                    total[:] += np.bincount(a * DIMENSIONS + places[b, j], signs[b, j], len(total))

    for batch in batches:
        for t in batch.column(0):
            ids = _ids(t.as_py(), buckets)
            held += [ids, end]
            n += len(ids)
            if n >= CHUNK:
                add()
                held, n = [], 0
    if held:
        add()
    rows = total.reshape(-1, DIMENSIONS)[:BUCKETS]
    some = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, k]) for k in range(DIMENSIONS))], names=["bucket", *(f"v{k}" for k in range(DIMENSIONS))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Word vectors of unit length by bucket, from all texts; a table of BUCKETS x DIMENSIONS whatever the input."""
    cols = [f"v{k}" for k in range(DIMENSIONS)]
    rows = docs.select("text").mapInArrow(_sums, "bucket int, " + ", ".join(f"{c} double" for c in cols))
    found = rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in cols)).toArrow()
    out = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32)
    out[found["bucket"].to_numpy()] = np.column_stack([found[c].to_numpy() for c in cols])
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def _pooled(batches: Iterator[pa.RecordBatch], vectors: object) -> Iterator[pa.RecordBatch]:
    table, buckets = vectors.value, _Buckets()
    for batch in batches:
        rows = np.zeros((batch.num_rows, 2 * DIMENSIONS), np.float32)
        for i, t in enumerate(batch.column("text")):
            ids = _ids(t.as_py(), buckets)
            if len(ids):
                seen, counts = np.unique(ids, return_counts=True)
                held, share = table[seen], (counts / len(ids)).astype(np.float32)
                mean = share @ held
                rows[i, :DIMENSIONS] = mean
                rows[i, DIMENSIONS:] = np.sqrt(np.maximum(share @ (held * held) - mean * mean, 0))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "vector"])


def document_vectors(docs: DataFrame) -> DataFrame:
    """doc_id, vector (float32 bytes) of every row."""
    vectors = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(partial(_pooled, vectors=vectors), "doc_id bigint, vector binary"), "vectors")


class Network:
    """Two layers and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.constant = None
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        check, train = order[: max(1, len(y) // 5)], order[max(1, len(y) // 5) :]
        self.shift, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        z, d = (x - self.shift) / self.scale, x.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(max(EPOCHS, min(MOST_EPOCHS, STEPS * 64 // len(train)))):
            for rows in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                step += 1
                for k, g in enumerate(self._gradients(z[rows], y[rows])):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.temperature = 1.0
        logits = self._logits(z[check])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, -(2 * y[check] - 1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3][0]

    def _gradients(self, z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        h = np.maximum(z @ self.w[0] + self.w[1], 0)
        out = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -30, 30))) - y) / len(y)
        back = np.outer(out, self.w[2]) * (h > 0)
        return [z.T @ back + 1e-4 * self.w[0], back.sum(axis=0), h.T @ out + 1e-4 * self.w[2], np.array([out.sum()])]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.shift) / self.scale) / self.temperature, -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.float32).reshape(-1, 2 * DIMENSIONS).astype(np.float64)


def _scored(batches: Iterator[pa.RecordBatch], network: Network) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(network.scores(_matrix(b.column("vector"))))], names=["doc_id", "score"])


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, score of every row of docs; labels: doc_id, label (0 or 1) of the rows to learn from."""
    vectors = document_vectors(docs)
    known = labels.where("label IN (0, 1)").select(F.col("doc_id").alias("l_id"), F.col("label").cast("double").alias("label"))
    chosen = F.broadcast(hashed_sample(known, "l_id", sample_rows, known.count()))  # ids and labels of a bounded number of rows
    sample = vectors.join(chosen, F.col("doc_id") == F.col("l_id")).select("doc_id", "vector", "label")
    rows = sample.orderBy("doc_id", "vector", "label").limit(sample_rows).toArrow()
    network = Network(_matrix(rows["vector"]), rows["label"].to_numpy())
    return vectors.mapInArrow(partial(_scored, network=network), "doc_id bigint, score double")
