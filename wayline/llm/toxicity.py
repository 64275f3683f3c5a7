"""Toxicity: a convolutional text classifier in numpy, with thresholds calibrated by language.

A word's embedding is several parts from hashes of it: two of the whole word, so that only words that collide in both are
confused, and one each of its first 3, 5 and 7 bytes, so that inflected forms share weight. Filters of several widths slide over a
document's embeddings; each is pooled over the whole text by its greatest and its third greatest activation, so that one odd
word differs from a habit, and a logistic layer sums them up. The network is
trained on all labelled documents, in which the languages of a class weigh alike; embeddings begin with the log-odds of their
buckets in these. Five further networks, each trained without a fifth of the documents, score that
fifth; on these scores the final network's probabilities and the decision thresholds are calibrated. The documents are dealt into shards, a
Spark task trains one network on one shard, and the changes of a network's shards are averaged; counts, weights and thresholds come from aggregates over all rows. A language's threshold is drawn
towards the common one as far as it has few toxic rows. Language is never an input of a row's score: the model that scores doesn't see it. It weighs the
labelled rows that train and calibrate the model, so that a language with few of them isn't left to chance, and chooses thresholds.

Defined cases: null and empty texts have no words and score by the bias alone; documents without a
label are scored; labels other than 0 and 1 are left out; without both labels among the rows to learn from every score is
0 (nothing known to be toxic) or 1; labelled texts count whole, however long; unknown and null languages get the common threshold; repeated rows give repeated rows;
an empty table gives no rows; further columns pass through ``score_toxicity``, of the names it adds the input's are replaced.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import give_back, others, set_aside, tidy, written

BUCKETS, DIM = 1 << 16, 4
#: Seeds of the hashes of a whole word, and bytes of the beginnings that have a part of their own.
SEEDS, STEMS = (0, 0x5BD1E995), (3, 5, 7)
PARTS = len(SEEDS) + len(STEMS)
#: Widths of filters, filters of each, and which of the greatest activations of a filter are pooled.
WIDTHS, FILTERS, RANKS = (1, 2, 3), 12, (1, 3)
SLOTS = len(WIDTHS) * FILTERS
#: A filter of width w is w rows of the weights; for each row, which filter (of all widths) it belongs to and how many words into it.
SLOT_OF = np.array([k * FILTERS + i for k, w in enumerate(WIDTHS) for _ in range(w) for i in range(FILTERS)])
SHIFT_OF = np.array([j for w in WIDTHS for j in range(w) for _ in range(FILTERS)])
EACH = np.arange(SLOTS)
#: Where each part's buckets begin in one table of all.
OFFSETS, COLUMN = np.arange(PARTS, dtype=np.int64) * BUCKETS, np.arange(DIM)
#: Labelled documents and words, about, that a task trains a network on; more of them make more shards.
SAMPLE_DOCS, SAMPLE_WORDS = 16_000, 6_000_000
#: Training takes at least about so many steps of one document, within these numbers of passes over all of them, and at most so many rounds of shards.
STEPS, PASSES, ROUNDS = 40_000, (1, 20), 2
#: Labelled rows up to which their ids and labels, of some dozen bytes, are broadcast.
BROADCAST_ROWS = 2_000_000
#: Steps of a logit that calibration tells apart.
BINS = 1024
RATE, SEED, FOLDS = 0.05, 11, 5
#: Documents with a bucket at which its first log-odds count by a quarter.
SHRINK = 3.0
#: Toxic rows of a language at which its own threshold and the common one count alike.
LANGUAGE_ROWS = 20
#: Words that ``word_ids`` remembers, and bytes of the longest of these; longer words are hashed one by one.
REMEMBERED, LONGEST = 400_000, 64
#: Bytes of texts, about, whose words are hashed at once.
AT_ONCE = 1 << 20
#: Words in one convolution; longer texts are taken in overlapping parts, all of them.
PART = 1 << 16
#: ASCII that is no letter or digit, as spaces.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


class _Buckets(dict):
    """Bucket numbers of a word's parts, as 16-bit integers."""

    def __missing__(self, word: bytes) -> bytes:
        parts = [zlib.crc32(word, s) for s in SEEDS] + [zlib.crc32(word[:n], n) for n in STEMS]
        held = b"".join((p & (BUCKETS - 1)).to_bytes(2, "little") for p in parts)
        if len(word) <= LONGEST:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = held
        return held


def word_ids(text: str | None, buckets: _Buckets) -> np.ndarray:
    """(words, parts) bucket numbers."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    return np.frombuffer(b"".join(map(buckets.__getitem__, words)), "<u2").reshape(-1, PARTS)


def _shifts(seed: int) -> np.ndarray:
    """What a seed changes in the hash of a word, by its bytes: the same for all words of a length."""
    return np.array([zlib.crc32(bytes(n), seed) ^ zlib.crc32(bytes(n)) for n in range(LONGEST + 1)], np.uint32)


CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)
SHIFTS = [_shifts(s) for s in (*SEEDS, *STEMS)]


def _hashed(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(where the words of a folded text begin, their bucket numbers): the words advance together, byte by byte."""
    held = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(held != 32, prepend=False, append=False))
    starts, sizes = edges[::2], np.diff(edges)[::2]
    short = np.minimum(sizes, LONGEST)
    order = np.argsort((LONGEST - short).astype(np.uint8), kind="stable")  # longest first, so that words that go on are in front
    going = len(starts) - np.cumsum(np.bincount(short, minlength=LONGEST + 1))
    at, state, states = starts[order], np.full(len(starts), 0xFFFFFFFF, np.uint32), {}
    for n in range(1, LONGEST + 1):
        m = int(going[n - 1])
        if m:
            c = state[:m]
            state[:m] = CRC[(c ^ held[at[:m] + (n - 1)]) & 255] ^ (c >> 8)
        elif n > max(STEMS):
            break
        if n in STEMS:
            states[n] = state.copy()
    sizes_in_order, out = short[order], np.empty((len(starts), PARTS), "<u2")
    for p, (n, shift) in enumerate(zip([None] * len(SEEDS) + list(STEMS), SHIFTS, strict=True)):
        ended = states[n] if n else state
        out[order, p] = (~ended ^ shift[sizes_in_order if n is None else np.minimum(sizes_in_order, n)]) & (BUCKETS - 1)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        word = raw[starts[i] : starts[i] + sizes[i]]
        out[i, : len(SEEDS)] = [zlib.crc32(word, s) & (BUCKETS - 1) for s in SEEDS]
    return starts, out


def many_word_ids(texts: pa.Array) -> Iterator[np.ndarray]:
    """What ``word_ids`` gives for each text; the words of many texts are hashed at once."""
    group, size = [], 0
    for i, t in enumerate(texts):
        group.append((t.as_py() or "").encode("utf-8", "replace"))
        size += len(group[-1])
        if size >= AT_ONCE or i == len(texts) - 1:
            starts, ids = _hashed(b" ".join(group).translate(FOLD))
            ends = np.searchsorted(starts, np.cumsum([len(g) + 1 for g in group]))
            yield from (ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True))
            group, size = [], 0


class Convolution:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray):
        counts = np.zeros((2, PARTS, BUCKETS))
        for d, y in zip(docs, labels, strict=True):
            for p in range(PARTS):
                counts[int(y), p, np.unique(d[:, p])] += 1
        self._begin(counts, (int(np.sum(labels == 0)), int(np.sum(labels == 1))))
        if self.constant is None:
            self.learn(docs, labels, weights, passes_of(len(docs)), SEED)

    @classmethod
    def begun(cls, counts: np.ndarray, totals: tuple[int, int]) -> Convolution:
        """A network before its first step: counts (label, part, bucket) of documents that have the bucket, totals of documents by label."""
        made = cls.__new__(cls)
        made._begin(counts, totals)
        return made

    def _begin(self, counts: np.ndarray, totals: tuple[int, int]) -> None:
        self.constant, self.slope, self.shift = None, 1.0, 0.0
        if not all(totals):
            self.constant = float(totals[1] > 0)
            return
        rng = np.random.default_rng(SEED)
        self.tables = np.stack([self._start(counts[:, p], totals, rng) for p in range(PARTS)])
        filters = [rng.normal(0, 0.1, (k, PARTS * DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for f in filters:
            f[:, ::DIM, : FILTERS // 2] += 0.25 / len(f)
            f[:, ::DIM, FILTERS // 2 :] -= 0.25 / len(f)
        self.rows = np.concatenate([part.T for f in filters for part in f])
        self.biases = np.full(SLOTS, -0.5, np.float32)
        n = len(RANKS) * len(WIDTHS) * FILTERS
        self.out, self.base = rng.normal(0, 0.1, n).astype(np.float32), 0.0
        self.seen = {"out": np.full(n, 1e-2), "base": 1e-2, "rows": np.full(self.rows.shape, 1e-2), "biases": np.full(SLOTS, 1e-2)}

    def _start(self, counts: np.ndarray, totals: tuple[int, int], rng: np.random.Generator) -> np.ndarray:
        rates = (counts + 0.5) / (np.array(totals)[:, None] + 1)
        surprise = (counts.sum(axis=0) / (counts.sum(axis=0) + SHRINK)) ** 2 * np.log(rates[1] / rates[0])
        table = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        table[:, 0] += surprise
        return table

    @property
    def filters(self) -> list[np.ndarray]:
        """The filters of each width, as (words, embedding, filter)."""
        ends = np.cumsum(WIDTHS) * FILTERS
        return [self.rows[end - w * FILTERS : end].reshape(w, FILTERS, PARTS * DIM).transpose(0, 2, 1) for w, end in zip(WIDTHS, ends, strict=True)]

    @property
    def bias(self) -> list[np.ndarray]:
        """The biases of the filters of each width."""
        return list(self.biases.reshape(len(WIDTHS), FILTERS))

    def flat(self) -> np.ndarray:
        """All that is trained but the embeddings, as one array."""
        held, seen = [self.rows, self.biases, self.out, np.array([self.base])], self.seen
        held += [seen["rows"], seen["biases"], seen["out"], np.array([seen["base"]])]
        return np.concatenate([x.ravel() for x in held]).astype(np.float64)

    def unflat(self, values: np.ndarray) -> None:
        """What ``flat`` gives, put in its places."""
        at = 0

        def taken(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return values[at - like.size : at].reshape(like.shape).astype(like.dtype)

        self.rows, self.biases, self.out, self.base = taken(self.rows), taken(self.biases), taken(self.out), float(taken(np.zeros(1))[0])
        seen = self.seen
        self.seen = {"rows": taken(seen["rows"]), "biases": taken(seen["biases"]), "out": taken(seen["out"]), "base": float(taken(np.zeros(1))[0])}

    def _embedded(self, ids: np.ndarray) -> np.ndarray:
        return self.tables.reshape(-1, DIM).take(ids + OFFSETS, axis=0).reshape(len(ids), PARTS * DIM)

    def _pool(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pooled activations by width, rank and filter; the places of those by rank and filter, of all widths). Long texts go part by part, all of them."""
        most, held = max(RANKS), []
        starts = range(0, max(1, len(ids) - max(WIDTHS) - most + 2), PART)
        for start in starts:
            # the last words of a part come again in the next: only filters that begin in this part count, and all that are left in the last one
            final = start == starts[-1]
            x = self._embedded(ids[start:] if final else ids[start : start + PART + max(WIDTHS) - 1])
            if len(x) < max(WIDTHS) + most - 1:  # short texts are filled up with zeros
                x = np.concatenate([x, np.zeros((max(WIDTHS) + most - 1 - len(x), x.shape[1]), np.float32)])
            every, first = self.rows @ x.T, 0
            a = np.empty((SLOTS, len(x) if final else PART), np.float32)
            for k, w in enumerate(WIDTHS):
                n = len(x) - w + 1 if final else PART
                mine = a[k * FILTERS : (k + 1) * FILTERS]
                mine[:, n:] = -np.inf
                mine[:, :n] = every[first : first + FILTERS, :n]
                for j in range(1, w):
                    mine[:, :n] += every[first + j * FILTERS : first + (j + 1) * FILTERS, j : j + n]
                first += w * FILTERS
            for _ in range(most):
                at = a.argmax(axis=1)
                held.append((a[EACH, at], at + start))
                a[EACH, at] = -np.inf
        if len(starts) > 1:
            values, at = (np.stack([x[i] for x in held]) for i in (0, 1))
            order = np.argsort(-values, axis=0, kind="stable")[[r - 1 for r in RANKS]]
            values, at = np.take_along_axis(values, order, axis=0), np.take_along_axis(at, order, axis=0)
        else:
            values, at = (np.array([held[r - 1][i] for r in RANKS]) for i in (0, 1))
        best = np.maximum(values + self.biases, 0)
        return best.reshape(len(RANKS), len(WIDTHS), FILTERS).transpose(1, 0, 2).ravel(), at

    def learn(self, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, passes: int, seed: int) -> None:
        """Passes of single steps over the documents, in a random order each."""
        rng, seen = np.random.default_rng(seed), self.seen
        table = self.tables.reshape(-1)
        for _ in range(passes):
            for i in rng.permutation(len(docs)):
                ids = docs[i]
                if len(ids) > 8:  # leaving out words at random keeps the filters from learning single documents
                    ids = ids.take(np.flatnonzero(rng.random(len(ids)) > 0.2), axis=0)
                pooled, at = self._pool(ids)
                g = weights[i] * (1 / (1 + math.exp(-min(max(float(pooled @ self.out) + self.base, -30.0), 30.0))) - labels[i])
                back = (g * self.out * (pooled > 0)).astype(np.float32)
                step = g * pooled + 1e-4 * self.out
                seen["out"] += step * step
                self.out -= (RATE * step / np.sqrt(seen["out"])).astype(np.float32)
                seen["base"] += g * g
                self.base -= RATE * g / math.sqrt(seen["base"])
                back = back.reshape(len(WIDTHS), len(RANKS), FILTERS).transpose(1, 0, 2).reshape(len(RANKS), SLOTS)  # by rank and filter
                slope = back.sum(axis=0)
                seen["biases"] += slope * slope
                self.biases -= (RATE * slope / np.sqrt(seen["biases"])).astype(np.float32)
                # words of the pooled places; what pools to zero moves nothing, and words past the end are not there
                part, place = back.take(SLOT_OF, axis=1), at.take(SLOT_OF, axis=1) + SHIFT_OF
                rank, row = np.nonzero((place < len(ids)) & (part != 0))
                words = ids[place[rank, row]]
                pull = part[rank, row][:, None]
                x = np.zeros((len(RANKS), *self.rows.shape), np.float32)
                x[rank, row] = self._embedded(words) * pull
                change = x.sum(axis=0) + 1e-4 * self.rows
                seen["rows"] += change * change
                moves = -0.02 * pull * self.rows[row]
                self.rows -= (RATE * change / np.sqrt(seen["rows"])).astype(np.float32)
                # one index for each number is several times faster here than one for each row
                np.add.at(table, (((words + OFFSETS) * DIM)[:, :, None] + COLUMN).ravel(), moves.ravel())

    def score(self, ids: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(ids) + self.shift, -30, 30))))

    def logit(self, ids: np.ndarray) -> float:
        if self.constant is not None:
            return 0.0
        return float(self._pool(ids)[0] @ self.out + self.base)


def passes_of(n: int) -> int:
    return max(PASSES[0], min(PASSES[1], STEPS // n))


def best_threshold(scores: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The threshold with the best weighted F1, in the middle of the gap that it falls in."""
    order = np.argsort(-scores, kind="stable")
    s, w = scores[order], weights[order]
    real = w * labels[order]
    f1 = 2 * np.cumsum(real) / (np.cumsum(w) + real.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(np.argmax(f1))
    return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)


def calibration(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through held-back logits, drawn a little to (1, 0)."""
    x, at, drawn = np.stack([logits, np.ones(len(logits))], axis=1), np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (weights * (p - labels)) + drawn @ (at - [1.0, 0.0])
        step = np.linalg.solve((x.T * (weights * p * (1 - p))) @ x + drawn, slope)
        at = at - step / max(1.0, float(np.linalg.norm(step)))
        at[0] = np.clip(at[0], 0.05, 5)
    return float(at[0]), float(at[1])


class ToxicityModel:
    def __init__(self, network: Convolution, common: float, by_language: dict[str, float]):
        self.network, self.common, self.by_language = network, common, by_language


def _as_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = pa.array([d.tobytes() for d in many_word_ids(b.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("nth", "fold", "lang", "label")), ids], names=["nth", "fold", "lang", "label", "ids"])


def _read(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").reshape(-1, PARTS) for x in ids.to_pylist()]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's documents of each fold and label have a bucket (``place`` numbers the buckets of all parts)."""
    counts = np.zeros((FOLDS * 2, PARTS * BUCKETS), np.int32)
    for b in batches:
        for d, k, y in zip(_read(b.column("ids")), b.column("fold").to_pylist(), b.column("label").to_pylist(), strict=True):
            counts[2 * k + y, np.unique(d + OFFSETS)] += 1
    for group, held in enumerate(counts):
        place = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), group), pa.int32()), pa.array(place, pa.int32()), pa.array(held[place], pa.int64())], names=["group", "place", "n"])


def _shares(counts: dict[tuple[int, str], int]) -> dict[tuple[int, str], float]:
    """Training weights by label and language: a class's languages count alike, within a factor of four of a plain balance, and both classes alike."""
    out, n = {}, sum(counts.values())
    for y in (0, 1):
        mine = {lang: c for (label, lang), c in counts.items() if label == y}
        share = {lang: float(np.clip(sum(mine.values()) / (len(mine) * c), 0.25, 4)) for lang, c in mine.items()}
        scale = n / 2 / max(1e-9, sum(share[lang] * c for lang, c in mine.items()))
        out |= {(y, lang): float(np.clip(x * scale, 0.1, 8)) for lang, x in share.items()}
    return out


MOVES = ["v0", "v1", "v2", "v3"]


def _trained(batches: Iterator[pa.RecordBatch], networks: list[object], shares: dict[tuple[int, str], float], passes: int, seed: int) -> Iterator[pa.RecordBatch]:
    """What a shard changes in the embeddings of its network, by place, and from place -1 downwards all else as it is then."""
    docs, labels, weights, k = [], [], [], None
    for b in batches:
        mine = b.column("label").to_pylist()
        docs += _read(b.column("ids"))
        labels += mine
        weights += map(shares.__getitem__, zip(mine, b.column("lang").to_pylist(), strict=True))
        k = b.column("network")[0].as_py() if b.num_rows else k
    if k is None:
        return
    begun = networks[k].value  # a broadcast is read when its value is asked for: a task holds its own network only
    network = copy.deepcopy(begun)
    network.learn(docs, np.array(labels), np.array(weights), passes, seed)
    moves = (network.tables - begun.tables).reshape(-1, DIM)
    place, rest = np.flatnonzero(moves.any(axis=1)), network.flat()
    values = np.concatenate([moves[place], np.stack([rest, *[np.zeros(len(rest))] * (DIM - 1)], axis=1)])
    place = np.concatenate([place, -1 - np.arange(len(rest))])
    for a in range(0, len(place), 1 << 16):
        part = slice(a, a + (1 << 16))
        columns = [pa.array(values[part, d], pa.float64()) for d in range(DIM)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place[part]), k), pa.int32()), pa.array(place[part], pa.int32()), *columns], names=["network", "place", *MOVES])


def _held_back(batches: Iterator[pa.RecordBatch], networks: object) -> Iterator[pa.RecordBatch]:
    """The logits that the networks trained without a document's fold give it, in whole steps."""
    for b in batches:
        logits = [networks.value[k + 1].logit(d) for d, k in zip(_read(b.column("ids")), b.column("fold").to_pylist(), strict=True)]
        steps = np.rint(np.clip(logits, -30, 30) * BINS).astype(np.int64) if logits else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("label"), b.column("lang"), pa.array(steps, pa.int64())], names=["label", "lang", "step"])


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """A model from docs (doc_id, text, lang) and labels (doc_id, label) of the rows to learn from, all of them."""
    spark = docs.sparkSession
    known = labels.where("label IN (0, 1)").select(F.col("doc_id").alias("l_id"), F.col("label").cast("int").alias("label"))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    # ids and labels of fewer rows are broadcast, so texts are not shuffled
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    held = docs.select("doc_id", "text", F.coalesce(lang, F.lit("")).alias("lang"), F.xxhash64("doc_id", "text").alias("nth"), F.length("text").alias("chars"))
    picked = held.join(known, F.col("doc_id") == F.col("l_id")).withColumn("fold", F.pmod("nth", F.lit(FOLDS)).cast("int"))
    told = picked.groupBy("label", "lang", "fold").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).collect()
    counts, totals = Counter(), np.zeros((FOLDS, 2), np.int64)
    for r in told:
        counts[r["label"], r["lang"]] += r["n"]
        totals[r["fold"], r["label"]] += r["n"]
    n, found = int(totals.sum()), {y for y, _ in counts}
    if len(found) < 2:
        return ToxicityModel(Convolution.begun(np.zeros(0), (0, int(found == {1}))), 0.5, {})
    # a word and its space have six characters, about
    shards = max(-(-n // SAMPLE_DOCS), -(-sum(r["chars"] or 0 for r in told) // (6 * SAMPLE_WORDS)), 1)
    coded = picked.select("nth", "fold", "lang", "label", "text").mapInArrow(tidy(_as_ids), "nth long, fold int, lang string, label int, ids binary")
    sample = written(coded.repartition(shards, "nth").sortWithinPartitions(F.xxhash64("nth")), "sample")
    had = sample.mapInArrow(tidy(_counted), "group int, place int, n long").groupBy("group", "place").agg(F.sum("n").alias("n")).toArrow()
    having = np.zeros((FOLDS * 2, PARTS * BUCKETS), np.int64)
    having[had["group"].to_numpy(), had["place"].to_numpy()] = had["n"].to_numpy()
    having = having.reshape(FOLDS, 2, PARTS, BUCKETS)
    # the first network learns from all rows, the others each without a fold
    networks = [Convolution.begun(having.sum(axis=0) - left, tuple((totals.sum(axis=0) - gone).tolist())) for left, gone in [(0, 0), *zip(having, totals)]]
    del had, having
    give_back()
    rounds = 1 if shards == 1 else min(ROUNDS, passes_of(n))
    shares, passes = _shares(counts), -(-passes_of(n) // rounds)
    for turn in range(rounds):
        held = [spark.sparkContext.broadcast(x) for x in networks]
        # files are read without a shuffle, a shard or more of them in a task
        parts = [sample.where(F.col("fold") != k - 1).coalesce(shards).select(F.lit(k).alias("network"), "label", "lang", "ids") for k, x in enumerate(networks) if x.constant is None]
        work = partial(_trained, networks=held, shares=shares, passes=passes, seed=SEED + turn)
        moved = reduce(DataFrame.unionAll, parts).mapInArrow(tidy(work), "network int, place int, " + ", ".join(f"{v} double" for v in MOVES))
        # an embedding moves by the mean of the shards that moved it
        moved = moved.groupBy("network", "place").agg(*(F.avg(v).cast("float" if v != MOVES[0] else "double").alias(v) for v in MOVES)).toArrow()
        whose, place, values = moved["network"].to_numpy(), moved["place"].to_numpy(), np.stack([moved[v].to_numpy() for v in MOVES], axis=1)
        for k, network in enumerate(networks):
            rest = np.flatnonzero((whose == k) & (place < 0))
            if len(rest):
                network.unflat(values[rest[np.argsort(-place[rest])], 0])
                table = np.flatnonzero((whose == k) & (place >= 0))
                network.tables.reshape(-1, DIM)[place[table]] += values[table].astype(np.float32)
        # the driver's copies of broadcasts go too
        for x in held:
            x.destroy()
        del moved, whose, place, values
        give_back()
    held = spark.sparkContext.broadcast(networks)
    judged = sample.mapInArrow(tidy(partial(_held_back, networks=held)), "label int, lang string, step long").groupBy("label", "lang", "step").count().toArrow()
    held.destroy()
    network, y, langs = networks[0], judged["label"].to_numpy(), np.array(judged["lang"].to_pylist(), object)
    logits, weights = judged["step"].to_numpy() / BINS, judged["count"].to_numpy().astype(float)
    network.slope, network.shift = calibration(logits, y, weights)
    # a score of one half is where the best F1 is when all languages weigh alike
    evened = weights.copy()
    for name in set(langs.tolist()):
        evened[langs == name] /= weights[langs == name].sum()
    middle = best_threshold(1 / (1 + np.exp(-np.clip(network.slope * logits + network.shift, -30, 30))), y, evened)
    middle = float(np.clip(middle, 1e-6, 1 - 1e-6))
    network.shift -= float(np.log(middle / (1 - middle)))
    scores = 1 / (1 + np.exp(-np.clip(network.slope * logits + network.shift, -30, 30)))
    common, found = best_threshold(scores, y, weights), {}
    for name in sorted(set(langs.tolist()) - {""}):
        own = langs == name
        toxic = int(weights[own & (y == 1)].sum())
        if 0 < toxic < weights[own].sum():
            found[name] = (toxic * best_threshold(scores[own], y[own], weights[own]) + LANGUAGE_ROWS * common) / (toxic + LANGUAGE_ROWS)
    return ToxicityModel(network, common, found)


def _scored(batches: Iterator[pa.RecordBatch], model: object, passed: list[str]) -> Iterator[pa.RecordBatch]:
    m = model.value
    for b in batches:
        scores = [m.network.score(d) for d in many_word_ids(b.column("text"))]
        langs = b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * b.num_rows
        limits = [m.by_language.get(x or "", m.common) for x in langs]
        made = [pa.array(scores, pa.float64()), pa.array(limits, pa.float64()), pa.array([s >= t for s, t in zip(scores, limits, strict=True)], pa.bool_())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in passed), *made], names=[*passed, *ADDED])


ADDED = ("score", "threshold", "toxic")


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of docs (default all) with score, threshold (of the language) and toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in others(docs.columns, ADDED) if keep is None or c in keep]
    added = [T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    read = docs.select(*dict.fromkeys([*names, "text", *(["lang"] if "lang" in docs.columns else [])]))
    return read.mapInArrow(tidy(partial(_scored, model=held, passed=names)), T.StructType([*(docs.schema[c] for c in names), *added]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their columns; labels: doc_id, label of the rows to learn from."""
    held, back = set_aside(docs, ADDED)
    return score_toxicity(held, train(docs, labels)).where("NOT toxic").select(*held.columns).withColumnsRenamed(back)
