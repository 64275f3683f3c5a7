"""Substring deduplication with a log-structured index of window fingerprints.

A window is a number of consecutive words. Equal windows contain equal shorter grams, so each window is filed
under its least gram hash (its key), and neighbouring windows that share one make a block. Each batch of
documents flushes its distinct blocks, each with its first document, as an immutable run in buckets by block hash, sorted in them. The batch's run is
merged with the runs before it bucket by bucket, without shuffling history: a block that a document with a smaller id has too is
removed whole; where the blocks of a key differ, the windows of each block in its first document are compared one by one,
wherever rows of that id have it (another document's window can only equal one of those). All matches are on one 64-bit hash and
verified by a second one from other bits of the words' 128-bit hashes. Compaction merges runs, in their buckets, and keeps the first
document of every block. A manifest lists the runs, so an index can be reopened for the next batch; single windows are read
again from the texts, which the index does not hold.

So what is stored and shuffled is about one row for a dozen words, and windows only where shared passages end.

Defined cases: doc_id is an integer or null; null and empty texts have no words; texts shorter than a window are kept whole; a
null doc_id counts as larger than all others; rows with equal ids never remove from each other; repeated
rows give repeated rows; an empty table gives no rows; further columns pass through, of the names that this
operator adds the input's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import append_run, buckets, drop, free, load_manifest, others, presence_bitmap, reopened, save_manifest, shared_dir, text_key, written

WINDOW = 50
#: Runs before they are compacted into one.
FANOUT = 4
#: Blocks, and bytes of text, of a task's output batch.
BATCH_ROWS, BATCH_BYTES = 300_000, 4 << 20
#: Odd multipliers of the two rolling hashes, with their inverses: any odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)
NAMES = ("key", "hash", "check", "doc", "ref", "start", "size")
BLOCK = "key bigint, hash bigint, check bigint, doc bigint, ref bigint, start int, size int"
#: A block with its first document, the last one, and whether rows of the first have it in several places.
RUN = f"{BLOCK}, last bigint, more boolean"
SINGLE = "hash bigint, check bigint, doc bigint, ref bigint, start int, mine boolean"
NO_ID = (1 << 63) - 1

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64; a worker keeps the longest so far."""
    if len(_powers.get(base, ())) <= n:
        held = np.full(max(2 * n, 1 << 16) + 1, base, np.uint64)
        held[0] = 1
        _powers[base] = np.cumprod(held)
    return _powers[base]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Hashes of any span of a text's words, from running sums."""

    def __init__(self, words: list[bytes]):
        of = xxhash.xxh3_128_digest
        halves = np.frombuffer(b"".join([of(w) for w in words]), ">u8").astype(np.uint64).reshape(-1, 2)
        self.n, self.sums = len(words), []
        for k, base in enumerate(BASES):
            sums = np.zeros(len(halves) + 1, np.uint64)
            np.cumsum(halves[:, k] * _power(base, len(halves))[: len(halves)], out=sums[1:])
            self.sums.append(sums)

    def spans(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        sums = self.sums[which]
        return _mixed((sums[stop] - sums[start]) * _power(INVERSES[which], self.n)[start])


def blocks_of(words: list[bytes], window: int) -> tuple[np.ndarray, ...] | None:
    """(key, hash, check, start, size) of the blocks of a text; size: windows in the block."""
    if len(words) < window:
        return None
    rolling, gram = Rolling(words), max(1, window // 2)
    at = np.arange(len(words) - gram + 1)
    grams = rolling.spans(at, at + gram, 0)
    least = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(len(words) - window + 1)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    size = np.diff(np.append(start, len(least)))
    stop = start + size + window - 1
    return grams[least[start]], rolling.spans(start, stop, 0), rolling.spans(start, stop, 1), start, size


def _batch(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    def typed(name: str, c: np.ndarray) -> pa.Array:
        if c.dtype == bool:
            return pa.array(c)
        kind = np.int32 if name in ("start", "size") else np.int64
        return pa.array(c.view(kind) if c.dtype == np.uint64 else c.astype(kind))

    return pa.RecordBatch.from_arrays([typed(n, c) for n, c in cols.items()], names=list(cols))


def _folded(cols: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Equal blocks as one row with the first document, the last one, and whether the first has it in several places."""
    order = np.argsort(cols["hash"], kind="stable")
    h = cols["hash"][order]
    twice = np.zeros(len(h), bool)
    twice[1:] = h[1:] == h[:-1]
    twice[:-1] |= twice[1:].copy()
    alone, rest = order[~twice], order[twice]
    c = {n: x[rest] for n, x in cols.items()}
    at = np.lexsort((c["size"], c["start"], c["ref"], c["doc"], c["key"], c["check"], c["hash"]))
    c = {n: x[at] for n, x in c.items()}
    new = np.ones(len(at), bool)
    new[1:] = (c["hash"][1:] != c["hash"][:-1]) | (c["check"][1:] != c["check"][:-1]) | (c["key"][1:] != c["key"][:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(at)) - 1 if len(first) else first
    again = np.zeros(len(at), bool)  # the next place of a block's first document
    again[1:] = ~new[1:] & (c["doc"][1:] == c["doc"][:-1])
    more = np.zeros(len(first), bool)
    some = first[first + 1 <= final]
    more[first + 1 <= final] = again[some + 1]
    out = {n: np.concatenate([cols[n][alone], c[n][first]]) for n in NAMES}
    return out | {"last": np.concatenate([cols["doc"][alone], c["doc"][final]]), "more": np.concatenate([np.zeros(len(alone), bool), more])}


def _blocks(batches: Iterator[pa.RecordBatch], window: int, fold: bool) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def out() -> pa.RecordBatch:
        cols = {name: np.concatenate([h[k] for h in held]) for k, name in enumerate(NAMES)}
        return _batch(_folded(cols) if fold else cols)

    for b in batches:
        for text, doc, ref in zip(b.column("text"), b.column("doc").to_pylist(), b.column("ref").to_pylist(), strict=True):
            found = blocks_of((text.as_py() or "").encode("utf-8", "replace").split(), window)
            if found:
                key, hashed, check, start, size = found
                held.append((key, hashed, check, np.full(len(key), doc), np.full(len(key), ref), start, size))
                n += len(key)
                if n >= BATCH_ROWS:
                    yield out()
                    held, n = [], 0
    if held:
        yield out()


def _single_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Every window of the listed blocks."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        return _batch({name: np.concatenate([h[k] for h in held]) for k, name in enumerate(("hash", "check", "doc", "ref", "start", "mine"))})

    for b in batches:
        for text, doc, ref, mine, spans in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("doc", "ref", "mine", "spans")), strict=True):
            rolling = Rolling((text.as_py() or "").encode("utf-8", "replace").split())
            start = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["size"]) for s in spans]))
            hashed, check = (rolling.spans(start, start + window, k) for k in (0, 1))
            held.append((hashed, check, np.full(len(start), doc), np.full(len(start), ref), start, np.full(len(start), mine)))
            n += len(start)
            if n >= BATCH_ROWS:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _referred(docs: DataFrame) -> DataFrame:
    """text, doc (id, or a number after all ids) and ref (64 bits of id and text)."""
    return docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("doc_id", text_key(F.col("text"))).alias("ref"))


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each distinct block of several runs; groups by hash, so runs in buckets are not shuffled."""
    first = F.min(F.struct("doc", "ref", "start", "size")).alias("f")
    end = F.max(F.struct(F.bitwise_not("doc"), "more", "ref", "start")).alias("e")
    more = F.col("e.more") | (F.col("e.ref") != F.col("f.ref")) | (F.col("e.start") != F.col("f.start"))
    return rows.groupBy("hash", "check", "key").agg(first, end, F.max("last").alias("last")).select("key", "hash", "check", "f.*", "last", more.alias("more"))


def _later(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows whose hashes a smaller document has; repeated: hash, check and the smallest doc of those in several, from a written table."""
    few = repeated.select(F.col("hash").alias("m_hash"), F.col("check").alias("m_check"), F.col("doc").alias("m_doc"))
    return rows.join(few, (F.col("hash") == F.col("m_hash")) & (F.col("check") == F.col("m_check")) & (F.col("doc") > F.col("m_doc")))


def _listed(rows: DataFrame) -> DataFrame:
    """(s_ref, spans): spans of one document together; their number is bounded by its words."""
    return rows.groupBy(F.col("ref").alias("s_ref")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))


class SubstringIndex:
    """Immutable runs of distinct blocks, in buckets by hash, in the shared folder, and a manifest of them."""

    def __init__(self, spark: SparkSession, window: int = WINDOW, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.window, self.path, self.fanout = spark, window, path or shared_dir(spark, "windows"), fanout
        self.n = buckets(spark)
        self.runs: list[int] = []
        self.version, self._table = 0, None

    @classmethod
    def reopen(cls, spark: SparkSession, path: str) -> SubstringIndex:
        version, said = load_manifest(spark, path)
        index = cls(spark, said["window"], path, said["fanout"])
        index.n, index.version, index.runs = said["buckets"], version, said["runs"]
        index._table = reopened(spark, "hash", f"{path}/runs", index.n, RUN)
        return index

    def table(self, runs: list[int] | None = None) -> DataFrame:
        """Blocks of some runs (default: all), a bucket of all of them in one task."""
        return self.spark.table(self._table).where(F.col("run").isin(self.runs if runs is None else runs)).drop("run")

    def add(self, docs: DataFrame, former: DataFrame | None = None) -> DataFrame:
        """Index a batch (doc_id, text); (s_ref, spans) of its documents with windows that a smaller document has.

        former: the documents indexed before, to read windows again where blocks differ.
        """
        rows = _referred(docs)
        folded = rows.mapInArrow(partial(_blocks, window=self.window, fold=True), RUN)
        before = list(self.runs)
        new = self._write(_merged(folded.repartition(self.n, "hash")))
        size = new.count()
        # keys that documents of the batch share with others: of the history, only rows of the batch's keys are looked at
        by_key = new.select("key", "doc", "last", "hash", "check")
        if before:
            mine = presence_bitmap(new, F.col("key"), size)
            by_key = by_key.unionByName(mine.maybe(self.table(before).select(*by_key.columns), F.col("key")))
        sides = [f(c).alias(f"{c}_{name}") for c in ("hash", "check") for name, f in (("lo", F.min), ("hi", F.max))]
        keys = by_key.groupBy("key").agg(F.min("doc").alias("lo"), F.max("last").alias("hi"), *sides).where("lo < hi")
        keys = written(keys.select("key", ((F.col("hash_lo") != F.col("hash_hi")) | (F.col("check_lo") != F.col("check_hi"))).alias("differ"), "lo"), "keys")
        shared = presence_bitmap(keys, F.col("key"), keys.count())
        firsts = written(_merged(shared.maybe(self.table(), F.col("key"))), "firsts")

        # whole blocks, and places of blocks that the first document has several times; both sides are plain tables, so Spark splits hot keys
        differ = keys.where("differ").select(F.col("key").alias("d_key"), "lo")
        under = written(firsts.join(differ, F.col("key") == F.col("d_key")).drop("d_key"), "under")
        repeated = firsts.where("last > doc").select("hash", "check", "doc")
        several = under.where("more AND doc > lo").select("hash", "check", "doc")
        wanted = repeated.select("hash").unionByName(several.select("hash"))
        bitmap = presence_bitmap(wanted, F.col("hash"), wanted.count())
        near = written(bitmap.maybe(rows.mapInArrow(partial(_blocks, window=self.window, fold=False), BLOCK).select("hash", "check", "doc", "ref", "start", "size"), F.col("hash")), "near")
        whole = _later(near, repeated).select("ref", "start", "size")
        few = several.select(F.col("hash").alias("m_hash"), F.col("check").alias("m_check"), F.col("doc").alias("m_doc"))
        places = near.join(few, (F.col("hash") == F.col("m_hash")) & (F.col("check") == F.col("m_check")) & (F.col("doc") == F.col("m_doc"))).select("ref", "start", "size")

        # single windows of the blocks that differ
        asked = written(_listed(under.select("ref", "start", "size").unionByName(places)), "asked")
        asking = presence_bitmap(asked, F.col("s_ref"), asked.count())
        texts = rows.withColumn("mine", F.lit(True))
        texts = texts if former is None else texts.unionByName(_referred(former).withColumn("mine", F.lit(False)))
        texts = asking.maybe(texts, F.col("ref")).join(asked, F.col("ref") == F.col("s_ref")).select("text", "doc", "ref", "mine", "spans")
        single = written(texts.mapInArrow(partial(_single_windows, window=self.window), SINGLE), "single")
        again = single.groupBy("hash", "check").agg(F.min("doc").alias("doc"), F.max("doc").alias("last")).where("last > doc")
        again = written(again.select("hash", "check", "doc"), "again")
        parts = _later(single.where("mine"), again).select("ref", "start", F.lit(1).alias("size"))
        found = written(_listed(whole.unionByName(parts)), "found")
        if len(self.runs) > self.fanout:
            self.compact()
        return found

    def compact(self) -> None:
        """Merge all runs, bucket by bucket, into one that has the first document of every block."""
        old = list(self.runs)
        self._write(_merged(self.table(old)), replaced=old)
        for run in old:
            self.spark.sql(f"ALTER TABLE `{self._table}` DROP IF EXISTS PARTITION (run = {run})")
            drop(self.spark, f"{self.path}/runs/run={run}")

    def _write(self, rows: DataFrame, replaced: list[int] = ()) -> DataFrame:
        run = self.version + 1
        self._table = append_run(rows, run, "hash", f"{self.path}/runs", self.n, self._table)
        self.runs = [*(r for r in self.runs if r not in replaced), run]
        self.version += 1
        save_manifest(self.spark, self.path, self.version, {"runs": self.runs, "window": self.window, "fanout": self.fanout, "buckets": self.n})
        return self.table([run])


def _cut(batches: Iterator[pa.RecordBatch], window: int, passed: list[str], spans: str) -> Iterator[pa.RecordBatch]:
    def out(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
        part = batch.slice(start, len(rows))
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], names=[*passed, *ADDED])

    for batch in batches:
        rows, start, size = [], 0, 0
        for i, (text, own) in enumerate(zip(batch.column("text"), batch.column(spans).to_pylist(), strict=True)):
            words = (text.as_py() or "").encode("utf-8", "replace").split()
            kept = words
            if own:
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, [s["start"] for s in own], 1)
                np.add.at(edge, [s["start"] + s["size"] + window - 1 for s in own], -1)
                kept = [words[k] for k in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
            joined = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), joined.decode("utf-8", "replace")))
            size += len(joined)
            if size >= BATCH_BYTES:
                yield out(batch, start, rows)
                rows, start, size = [], i + 1, 0
        if rows:
            yield out(batch, start, rows)


ADDED = ("n_words", "n_removed", "kept")


def remove_repeats(docs: DataFrame, window: int = WINDOW, batches: int = 1, keep: tuple[str, ...] | None = None, fanout: int = FANOUT) -> DataFrame:
    """The kept columns of docs (default all) with n_words, n_removed and kept (the words that stay, one space between).

    batches: documents are indexed in so many ranges of ascending ids.
    """
    index = SubstringIndex(docs.sparkSession, window, fanout=fanout)
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    names = [c for c in others(docs.columns, ADDED) if keep is None or c in keep]
    columns = list(dict.fromkeys([*names, "doc_id", "text"]))
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    found, texts = [], docs.select("doc_id", "text")
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if lo is None else F.coalesce(F.col("doc_id") > lo, F.lit(True))
        before = F.lit(True) if hi is None else F.col("doc_id") <= hi
        found.append(index.add(texts.where(inside & before), None if lo is None else texts.where(F.col("doc_id") <= lo)))
    found = reduce(DataFrame.unionByName, found)
    ref, maybe, s_ref, spans = free(columns, "ref", "maybe", "s_ref", "spans")
    held = docs.select(*columns).withColumn(ref, F.xxhash64("doc_id", text_key(F.col("text"))))
    bitmap = presence_bitmap(found, F.col("s_ref"), found.count())
    # documents that surely stay whole stream through; only the others meet their spans in a shuffle
    split = bitmap.marked(held, F.col(ref), maybe)
    none = F.lit(None).cast("array<struct<start:int,size:int>>").alias(spans)
    whole = split.where(~F.col(maybe)).select(*columns, none)
    cut = found.select(F.col("s_ref").alias(s_ref), F.col("spans").alias(spans))
    parts = split.where(F.col(maybe)).join(cut, F.col(ref) == F.col(s_ref), "left").select(*columns, spans)
    return whole.unionByName(parts).mapInArrow(partial(_cut, window=window, passed=names, spans=spans), schema)
