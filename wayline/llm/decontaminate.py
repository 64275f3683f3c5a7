"""Benchmark decontamination with an FM-index over each training shard.

A shard is the documents that a task has read up to a size. Its words become symbols of the benchmark's
vocabulary; a word that no benchmark item has cannot be part of a hit, so it only separates, and runs of
symbols shorter than the shortest window are left out. Over that text the task builds a suffix array, the
Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions; all windows are searched
backwards at once, their occurrences located from the samples and merged into removal spans per document.

Windows reach the tasks as broadcast blocks, which the driver passes on one at a time; a task's worker
searches a shard for one block after the other, so no shuffle of documents is needed. Benchmarks are small beside a corpus: work grows
with documents times blocks of BLOCK_WINDOWS windows (with their items).

Defined cases: null and empty texts have no words; an item without words has no window; items with equal
ids count as one item, a null id as the empty string; repeated documents give repeated rows; empty tables
give no hits; further columns pass through, and of the names this operator adds the input's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import others, set_aside, written

WINDOW = 10
#: Windows of a block, counted once for each item that has one: bounds what the driver passes on at once.
BLOCK_WINDOWS = 200_000
#: Bytes of text of a shard.
SHARD_BYTES = 6 << 20
#: Every so many suffix positions are sampled, and those that start a run.
SAMPLE = 8
#: Every ASCII character to itself, a lower-case letter, or (if no letter or digit) a space; bytes of other characters stay.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() and b < 128 else 32 for b in range(256)).lower()
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
ARROW_ADDED = [
    pa.field("n_words", pa.int64()),
    pa.field("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
    pa.field("items", pa.list_(pa.string())),
]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


class FMIndex:
    """Full-text index of a symbol array in which 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = SAMPLE):
        n = len(text)
        sa = suffix_array(text)
        before = text[sa - 1]  # for the first suffix the last symbol, a separator
        self.n, self.levels = n, []
        self.first = np.zeros(sigma + 2, np.int64)
        self.first[1:] = np.cumsum(np.bincount(text, minlength=sigma + 1))
        column = before
        for level in reversed(range(max(1, int(sigma).bit_length()))):
            bit = (column >> level) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, ones, n - int(ones[-1])))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        symbols = np.arange(sigma + 1)
        self.start = self._down(symbols, np.zeros(sigma + 1, np.int64))
        kept = (sa % sample == 0) | (before == 0)
        self.kept, self.nth, self.samples = kept, np.cumsum(kept) - 1, sa[kept]

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, ones, zeros in self.levels:
            up = ones[i]
            i = np.where((symbol >> level) & 1, zeros + up, i - up)
        return i

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Rows that come before row i once the symbol is put in front."""
        return self.first[symbol] + self._down(symbol, i) - self.start[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, lo, hi) of phrases that occur; phrases: right-aligned rows of symbols."""
        at, lo, hi = np.arange(len(phrases)), np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        done: list[tuple[np.ndarray, ...]] = []
        for j in range(phrases.shape[1]):
            ended = lengths[at] == j
            if ended.any():
                done.append((at[ended], lo[ended], hi[ended]))
                at, lo, hi = at[~ended], lo[~ended], hi[~ended]
            symbol = phrases[at, -1 - j]
            lo, hi = self.step(symbol, lo), self.step(symbol, hi)
            some = lo < hi
            at, lo, hi = at[some], lo[some], hi[some]
        done.append((at, lo, hi))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to the next sampled position."""
        out, at, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(at):
            here = self.kept[rows]
            out[at[here]] = self.samples[self.nth[rows[here]]] + steps
            at, rows, steps = at[~here], rows[~here], steps + 1
            symbol, i = np.zeros(len(rows), np.int64), rows
            for level, ones, zeros in self.levels:
                up = ones[i]
                bit = ones[i + 1] - up
                symbol += bit.astype(np.int64) << level
                i = np.where(bit, zeros + up, i - up)
            rows = self.first[symbol] + i - self.start[symbol]
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; every separator is a symbol of its own, so comparisons end there."""
    n, ends = len(text), text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, ends.sum() + text.astype(np.int64))
    k = 1
    order = np.argsort(rank, kind="stable")
    rank = _ranks(rank, order)
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        rank = _ranks(key, order)
        k *= 2
    return order


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    held = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
    return out


class _Block:
    """A block of windows in symbols: what a task needs to search for."""

    def __init__(self, rows: list[tuple[list[bytes], list[str]]]):
        self.items = [i for _, i in rows]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for ws, _ in rows for w in ws}))}
        self.lengths = np.array([len(ws) for ws, _ in rows], np.int64)
        self.phrases = np.zeros((len(rows), max(self.lengths, default=1)), np.int64)
        for i, (ws, _) in enumerate(rows):
            self.phrases[i, -len(ws) :] = [self.vocabulary[w] for w in ws]
        self.shortest = int(min(self.lengths, default=1))

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of each occurrence in a shard's words; 0: a word outside the vocabulary or a document's end."""
        none = np.zeros(0, np.int64)
        inside = np.concatenate([[False], ids > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, stops = edge[::2], edge[1::2]
        long = stops - starts >= self.shortest
        starts, stops = starts[long], stops[long]
        if not len(starts):
            return none, none
        sizes = stops - starts + 1  # with the separator behind each run
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        text = np.append(ids, 0)[place]
        text[ends - 1] = 0
        index = FMIndex(text, len(self.vocabulary))
        window, lo, hi = index.search(self.phrases, self.lengths)
        if not len(window):
            return none, none
        many = hi - lo
        rows = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
        return np.repeat(window, many), place[index.locate(rows)]


def _search(blocks: list[object], clean: bool, passed: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """blocks: broadcast rows of windows and their items."""

    def shard(batch: pa.RecordBatch, folded: list[bytes]) -> pa.RecordBatch:
        words = [f.split() for f in folded]
        counts = np.array([len(ws) for ws in words], np.int64)
        begin = np.cumsum(counts + 1) - counts - 1  # each document is followed by a separator
        diff, found = np.zeros(int(counts.sum()) + len(counts) + 1, np.int32), {}
        for k in range(len(blocks)):
            block = _block(blocks, k)
            marks = np.zeros(len(diff) - 1, np.int32)
            for at, ws in zip(begin.tolist(), words, strict=True):
                marks[at : at + len(ws)] = np.fromiter(map(block.vocabulary.get, ws, repeat(0)), np.int32, len(ws))
            window, place = block.occurrences(marks)
            doc = np.searchsorted(begin, place, side="right") - 1
            np.add.at(diff, place, 1)
            np.add.at(diff, place + block.lengths[window], -1)
            for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                found.setdefault(d, set()).update(block.items[w])
        hit = np.cumsum(diff) > 0
        spans, items = [[] for _ in folded], [[] for _ in folded]
        for d, ids in found.items():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[begin[d] : begin[d] + counts[d]].astype(np.int8), [0]])))
            spans[d] = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            items[d] = sorted(ids)
        made = {"n_words": counts, "spans": spans, "items": items}
        if clean:
            texts = batch.column("text").to_pylist()
            made["text"] = [without(t, f, s) if s else t for t, f, s in zip(texts, folded, spans, strict=True)]
        schema = pa.schema([*(batch.schema.field(c) for c in passed), *ARROW_ADDED])
        return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else batch.column(f.name) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            start, size, folded = 0, 0, []
            for i in range(len(texts)):
                folded.append((texts[i].as_py() or "").encode("utf-8", "replace").translate(FOLD))
                size += len(folded[-1])
                if size >= SHARD_BYTES:
                    yield shard(batch.slice(start, i + 1 - start), folded)
                    start, size, folded = i + 1, 0, []
            if folded:
                yield shard(batch.slice(start), folded)

    return run


#: Blocks that a worker keeps ready for searching.
READY = 4
_held: list[tuple[object, int, _Block]] = []


def _block(blocks: list[object], k: int) -> _Block:
    for owner, n, block in _held:
        if owner is blocks and n == k:
            return block
    del _held[: max(0, len(_held) + 1 - READY)]
    _held.append((blocks, k, _Block([(w.encode().split(b" "), i) for w, i in blocks[k].value])))
    return _held[-1][2]


def without(text: str | None, folded: bytes, spans: list[dict]) -> str | None:
    """The text without the words of the spans and the blanks behind them."""
    raw, at, words = (text or "").encode("utf-8", "replace"), 0, []
    for w in folded.split():
        at = folded.index(w, at)
        words.append((at, at + len(w)))
        at += len(w)
    out, last = [], 0
    for s in spans:
        out.append(raw[last : words[s["start"]][0]])
        last = words[s["stop"] - 1][1]
        while last < len(raw) and raw[last] in b" \t":
            last += 1
    return b"".join([*out, raw[last:]]).decode("utf-8", "replace")


def _windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        made = [(" ".join(x.decode() for x in ws[i : i + WINDOW]), item or "") for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (ws := words_of(text)) for i in range(max(1, len(ws) - WINDOW + 1))]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.string()) for k in (0, 1)], names=["window", "item"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, clean: bool = False, keep: tuple[str, ...] | None = None, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The kept columns of docs (default all) with n_words, spans (word positions, merged) and items (ids that hit).

    clean: put the text without its spans in ``text``.
    """
    spark = docs.sparkSession
    windows = (
        benchmark.select(F.col("item_id").cast("string"), "text")
        .mapInArrow(_windows, "window string, item string")
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    windows = written(windows.withColumn("n", F.size("items")), "windows")
    total = windows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = max(1, -(-total // block_windows))
    blocks = []
    for k in range(count):
        rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(count)) == k).select("window", "items").collect()
        blocks.append(spark.sparkContext.broadcast([(r.window, list(r["items"])) for r in rows]))
    passed = [c for c in others(docs.columns, ADDED.names) if keep is None or c in keep or (c == "text" and clean)]
    read = docs.select(*dict.fromkeys([*passed, "text"]))
    return read.mapInArrow(_search(blocks, clean, passed), T.StructType([*(docs.schema[c] for c in passed), *ADDED]))


def remove_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with contaminated passages cut out of their texts; every document stays, n_chars follows its text."""
    held, back = set_aside(docs, ADDED.names)
    out = find_contamination(held, benchmark, clean=True)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*held.columns).withColumnsRenamed(back)
