"""Removal of byte strings that were there before, by distributed prefix doubling over sparse suffixes.

A string is a number of consecutive bytes of one text (100 by default). Suffixes are named by their prefixes: a prefix of twice the length has the
pair of two names at an offset as its name (hashes take the place of dense ranks, so names of pairs need no round trip; 64 bits
name a prefix and 64 independent ones the bytes it stands for). In each round Spark deals the names out, sorts them with their
places, and drops what is unique; the others double, until prefixes are as long as the strings.

Suffixes are sparse: of the prefixes inside a string the one with the least name stands for it, which equal strings
choose alike, and neighbouring strings with the same choice make a block, one row. A round finds for each name:

* one place only, or equal blocks only, of which the first stays: decided;
* a block that is there before as a whole: all its strings go;
* different blocks: the first of each goes to the next round, where its strings have longer prefixes. Any string
  of the corpus has its first place in such a block, so later rounds miss nothing.

In the last round every string left has a row of its own, and its name is that of all its bytes. So a text has about a row for 35 bytes in the
first round, and rows for single strings only where repeated passages end. Names so frequent that one task would have too
many (found in a sample of texts, which decides the plan, never the result) are spread over all tasks and judged by aggregates and joins that
Spark can split.

Defined cases: null and empty texts have no bytes; shorter texts than a string stay whole; a null doc_id counts as larger
than all others; rows with equal ids never remove from each other, but each from itself; repeated rows give repeated rows; an
empty table gives no rows; further columns pass through, of the names that this operator adds the input's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import buckets, free, others, presence_bitmap, text_key, written

#: Bytes of a string whose repeats go, and of the prefixes that the first round names.
LENGTH, GRAM = 100, 32
#: String starts that are worked on together.
SEGMENT = 1 << 16
#: One text in so many is looked at for frequent names; a name with a share of the sample's rows above 1 / (SHARE * tasks), and of so many at least, is spread.
SAMPLE, SHARE, FREQUENT = 64, 4, 40
#: Rows, and bytes of text, of a task's output batch.
BATCH_ROWS, BATCH_BYTES = 200_000, 4 << 20
#: Odd multipliers of two rolling hashes: any odd numbers do.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1
#: States of a judged row.
FREQUENT_NAME, REPEATED, OPEN = 0, 1, 2
ROW = "key bigint, check bigint, doc bigint, ref bigint, start int, size int"
JUDGED = f"state tinyint, {ROW}"
ADDED = ("n_bytes", "n_removed", "n_spans", "kept")

#: A number for each byte and hash, from a fixed sequence.
_BYTES = [np.random.PCG64(7 + k).random_raw(256).astype(np.uint64) for k in range(2)]
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** n modulo 2 ** 64; a worker keeps the longest so far."""
    if len(_powers.get(base, ())) <= n:
        held = np.full(max(n, 2 * SEGMENT) + 1, base, np.uint64)
        held[0] = 1
        _powers[base] = np.cumprod(held)
    return _powers[base]


class Names:
    """Names of spans of some bytes, from running sums of a rolling hash."""

    def __init__(self, data: np.ndarray, which: int):
        self.inverse = _power(pow(BASES[which], -1, 1 << 64), len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[which][data] * _power(BASES[which], len(data))[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, stop: np.ndarray | slice) -> np.ndarray:
        """start and stop: numbers, or slices for all in a row."""
        h = (self.sums[stop] - self.sums[start]) * self.inverse[: len(self.sums)][start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return h


def paired(names: np.ndarray, offset: int) -> np.ndarray:
    """Names of longer prefixes: each pair of names at an offset makes one."""
    h = names[:-offset] * np.uint64(0x9FB21C651E98DF25) + names[offset:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(29)
    return h


def _least(names: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of ``width`` names from each place on; of equal ones the first."""
    bits = max(1, (len(names) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    held, span = (names & ~low) | np.arange(len(names), dtype=np.uint64), 1
    while 2 * span <= width:
        held, span = np.minimum(held[:-span], held[span:]), 2 * span
    if span < width:
        held = np.minimum(held[: len(held) - (width - span)], held[width - span :])
    return (held & low).astype(np.int64)


def rounds(length: int, gram: int) -> list[int]:
    """Lengths of prefixes, doubling up to the strings' own."""
    out = [min(gram, length)]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def blocks_of(data: np.ndarray, edges: np.ndarray, length: int, prefixes: list[int]) -> tuple[np.ndarray, ...]:
    """(key, check, start, size) of the blocks of pieces of bytes, which lie between ``edges``; strings never cross those.

    key: name of the prefix (of the last length in ``prefixes``, doubled up to it) that stands for the block's strings;
    check: a name of all its bytes, by another hash; start: in data; size: strings in the block.
    """
    gram, n, out = prefixes[-1], len(data) - length + 1, [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    width = length - gram + 1
    for at in range(0, n, SEGMENT):
        lo, hi = max(at - 1, 0), min(at + SEGMENT, n)
        part = data[lo : hi + width + length - 1]
        names = Names(part, 0).of(slice(0, len(part) - prefixes[0] + 1), slice(prefixes[0], len(part) + 1))
        for short, long in zip(prefixes, prefixes[1:]):
            names = paired(names, long - short)
        least = _least(names, width)
        fresh = np.zeros(len(least), bool)
        fresh[1:] = least[1:] != least[:-1]
        fresh[edges[np.searchsorted(edges, lo) : np.searchsorted(edges, lo + len(least))] - lo] = True
        fresh[0] |= at == 0
        new = np.flatnonzero(fresh)
        ends, mine = np.append(new[1:], len(least)), (new >= at - lo) & (new < hi - lo)
        start = new[mine] + lo
        limit = edges[np.searchsorted(edges, start, "right")] - length + 1  # of the starts in the piece
        size = np.minimum(ends[mine] + lo, limit) - start
        start, size = start[size > 0], size[size > 0]
        out[0].append(names[least[start - lo]])
        out[1].append(Names(part, 1).of(start - lo, start - lo + size + length - 1))
        out[2].append(start)
        out[3].append(size)
    return tuple(np.concatenate(o) for o in out)


def _runs(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(start, stop) of the maximal runs of string starts in spans."""
    start = np.array([s["start"] for s in spans], np.int64)
    stop = start + np.array([s["size"] for s in spans], np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.append(True, start[1:] > stop[:-1]))
    return start[new], stop[np.append(new[1:], len(stop)) - 1]


def _pieces(batch: pa.RecordBatch, length: int, open_: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a batch's texts, or of their open runs, one after the other: (data, edges, row of each piece, its start in the row's text)."""
    texts = batch.column("text").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    if not open_:
        return data[offsets[0] : offsets[-1]], offsets - offsets[0], np.arange(len(texts)), np.zeros(len(texts), np.int64)
    parts, rows, starts = [], [], []
    for i, spans in enumerate(batch.column("spans").to_pylist()):
        lo, hi = _runs(spans)
        parts += [data[offsets[i] + a : offsets[i] + b + length - 1] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
        rows.append(np.full(len(lo), i))
        starts.append(lo)
    edges = np.append(0, np.cumsum([len(p) for p in parts]))
    return np.concatenate(parts), edges, np.concatenate(rows), np.concatenate(starts)


def _batches(cols: list[np.ndarray], names: list[str], kinds: list) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cols[0]), BATCH_ROWS):
        held = [c[at : at + BATCH_ROWS] for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(k)) for c, k in zip(held, kinds, strict=True)], names=names)


NAMES, KINDS = ["key", "check", "doc", "ref", "start", "size"], [np.int64] * 4 + [np.int32] * 2


def _named(batches: Iterator[pa.RecordBatch], length: int, prefixes: list[int], open_: bool) -> Iterator[pa.RecordBatch]:
    """Rows of the blocks of a batch's texts, or of their open runs."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, edges, row, base = _pieces(batch, length, open_)
        key, check, start, size = blocks_of(data, edges, length, prefixes)
        piece = np.searchsorted(edges, start, "right") - 1
        doc, ref = (batch.column(c).to_numpy(zero_copy_only=False)[row[piece]] for c in ("doc", "ref"))
        yield from _batches([key, check, doc, ref, start - edges[piece] + base[piece], size], NAMES, KINDS)


def judged(c: dict[str, np.ndarray]) -> np.ndarray:
    """States of rows sorted by key, check, doc, ref and start, with all rows of their keys; -1: decided, nothing goes."""
    n = len(c["key"])
    key = np.append(True, c["key"][1:] != c["key"][:-1])
    block = key | np.append(True, c["check"][1:] != c["check"][:-1])
    row = block | np.append(True, (c["doc"][1:] != c["doc"][:-1]) | (c["ref"][1:] != c["ref"][:-1]))

    def first(new: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(new, np.arange(n), 0))

    later = (c["doc"] > c["doc"][first(block)]) | (c["start"] > c["start"][first(row)])
    of = np.cumsum(key) - 1
    several = np.bincount(of, weights=block)[of] > 1
    return np.where(later, REPEATED, np.where(several, OPEN, -1))


def _judged(batches: Iterator[pa.RecordBatch], frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows that go or stay open, of a sorted partition; those of frequent names as they are."""
    held: list[list[np.ndarray]] = []
    size = 0

    def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        c = dict(zip(NAMES, cols, strict=True))
        often = np.isin(c["key"], frequent)
        state = np.full(len(often), FREQUENT_NAME)
        rest = {k: v[~often] for k, v in c.items()}
        if len(rest["key"]):
            state[~often] = judged(rest)
        kept = state >= 0
        yield from _batches([state[kept], *(v[kept] for v in cols)], ["state", *NAMES], [np.int8, *KINDS])

    for batch in batches:
        held.append([batch.column(n).to_numpy() for n in NAMES])
        size += batch.num_rows
        if size >= BATCH_ROWS:
            cols = [np.concatenate([h[k] for h in held]) for k in range(len(NAMES))]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last key may go on
            if cut:
                yield from out([c[:cut] for c in cols])
            held = [[c[cut:] for c in cols]]
            size = len(cols[0]) - cut
    if size:
        yield from out([np.concatenate([h[k] for h in held]) for k in range(len(NAMES))])


def _frequent(sample: DataFrame, tasks: int) -> list[int]:
    """Names of which one task would have too many; SHARE times the number of tasks of them at most."""
    sample = written(sample.select("key"), "sample")
    least = max(FREQUENT, sample.count() // (SHARE * tasks))
    return [r["key"] for r in sample.groupBy("key").count().where(F.col("count") >= least).select("key").collect()]


def _spread(rows: DataFrame) -> DataFrame:
    """States of rows of frequent names, which any number of tasks may have: by aggregates with partial ones before the shuffle."""
    first = rows.groupBy("key", "check").agg(F.min("doc").alias("f_doc"))
    first = written(first, "firsts")
    several = first.groupBy(F.col("key").alias("s_key")).agg((F.count("*") > 1).alias("several"))  # a row for each frequent name
    first = first.select(F.col("key").alias("f_key"), F.col("check").alias("f_check"), "f_doc")
    held = rows.join(first, (F.col("key") == F.col("f_key")) & (F.col("check") == F.col("f_check"))).select(*rows.columns, "f_doc")
    gone = held.where("doc > f_doc").select(F.lit(REPEATED).cast("tinyint").alias("state"), *NAMES)
    own = written(held.where("doc = f_doc").select(*NAMES), "own")
    start = own.groupBy(*(F.col(c).alias(f"m_{c}") for c in ("key", "check", "doc", "ref"))).agg(F.min("start").alias("m_start"))
    same = [F.col(c) == F.col(f"m_{c}") for c in ("key", "check", "doc", "ref")]
    own = own.join(start, same).join(F.broadcast(several), F.col("key") == F.col("s_key"))
    state = F.when(F.col("start") > F.col("m_start"), REPEATED).when(F.col("several"), OPEN)
    return gone.unionByName(own.select(state.cast("tinyint").alias("state"), *NAMES).where("state IS NOT NULL"))


def _round(texts: DataFrame, length: int, prefixes: list[int], open_: bool) -> DataFrame:
    """Judged rows of one round (state, doc, ref, start, size), from a written table. texts: text, doc, ref, and spans where open."""
    spark, tasks = texts.sparkSession, buckets(texts.sparkSession)
    named = partial(_named, length=length, prefixes=prefixes, open_=open_)
    frequent = _frequent(texts.where(F.pmod(F.xxhash64("doc", "ref"), F.lit(SAMPLE)) == 0).mapInArrow(named, ROW), tasks)
    deal = F.when(F.col("key").isin(frequent), F.xxhash64("key", "doc", "start")).otherwise(F.col("key")) if frequent else F.col("key")
    rows = texts.mapInArrow(named, ROW).repartition(tasks, deal).sortWithinPartitions("key", "check", "doc", "ref", "start")
    rows = written(rows.mapInArrow(partial(_judged, frequent=np.array(frequent, np.int64)), JUDGED), "judged", compression="zstd")
    found = rows.where(F.col("state") != FREQUENT_NAME)
    if frequent:
        found = found.unionByName(_spread(rows.where(F.col("state") == FREQUENT_NAME)))
    return found.select("state", "doc", "ref", "start", "size")


def _listed(rows: DataFrame) -> DataFrame:
    """(s_doc, s_ref, spans): spans of one text together; their number is bounded by its bytes."""
    return written(rows.groupBy(F.col("doc").alias("s_doc"), F.col("ref").alias("s_ref")).agg(F.collect_list(F.struct("start", "size")).alias("spans")), "spans")


def _with_spans(texts: DataFrame, listed: DataFrame, doc: str, ref: str) -> tuple[DataFrame, DataFrame]:
    """(rows of texts that may have spans, with them; all others). Only the first are shuffled."""
    hashed, (maybe, s_doc, s_ref, spans) = F.xxhash64(doc, ref), free(texts.columns, "maybe", "s_doc", "s_ref", "spans")
    bitmap = presence_bitmap(listed, F.xxhash64("s_doc", "s_ref"), listed.count())
    split = bitmap.marked(texts, hashed, maybe)
    own = listed.select(F.col("s_doc").alias(s_doc), F.col("s_ref").alias(s_ref), F.col("spans").alias(spans))
    held = split.where(F.col(maybe)).join(own, (F.col(doc) == F.col(s_doc)) & (F.col(ref) == F.col(s_ref)), "left").select(*texts.columns, spans)
    return held, split.where(~F.col(maybe)).select(*texts.columns, F.lit(None).cast("array<struct<start:int,size:int>>").alias(spans))


def repeated_strings(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(s_doc, s_ref, spans) of texts (text, doc, ref): starts of strings that begin earlier too, as runs (start, size)."""
    prefixes, gone, held = rounds(length, gram), [], texts
    for k in range(len(prefixes)):
        found = _round(held, length, prefixes[: k + 1], k > 0)
        gone.append(found.where(F.col("state") == REPEATED))
        if k + 1 < len(prefixes):
            held, _ = _with_spans(texts, _listed(found.where(F.col("state") == OPEN)), "doc", "ref")
            held = held.where("spans IS NOT NULL")
    return _listed(reduce(DataFrame.unionByName, gone).select("doc", "ref", "start", "size"))


def _cut(batches: Iterator[pa.RecordBatch], length: int, passed: list[str], spans: str) -> Iterator[pa.RecordBatch]:
    def out(batch: pa.RecordBatch, start: int, rows: list[tuple]) -> pa.RecordBatch:
        part = batch.slice(start, len(rows))
        made = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in passed), *made], names=[*passed, *ADDED])

    for batch in batches:
        rows, start, size = [], 0, 0
        for i, (text, own) in enumerate(zip(batch.column("text").cast(pa.large_binary()), batch.column(spans).to_pylist(), strict=True)):
            data = text.as_py() or b""
            kept, removed, n = data, 0, 0
            if own:
                lo, hi = _runs([{"start": s["start"], "size": s["size"] + length - 1} for s in own])
                removed, n = int((hi - lo).sum()), len(lo)
                kept = b"".join(data[a:b] for a, b in zip([0, *hi.tolist()], [*lo.tolist(), len(data)], strict=True))
            rows.append((len(data), removed, n, kept))
            size += len(kept)
            if size >= BATCH_BYTES:
                yield out(batch, start, rows)
                rows, start, size = [], i + 1, 0
        if rows:
            yield out(batch, start, rows)


def remove_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns of docs (default all) with n_bytes, n_removed, n_spans (maximal runs removed) and kept (binary: the bytes that stay)."""
    names = [c for c in others(docs.columns, ADDED) if keep is None or c in keep]
    columns = list(dict.fromkeys([*names, "doc_id", "text"]))
    doc, ref, spans = free([*columns, *ADDED], "doc", "ref", "spans")
    # texts tell rows of one id apart, where ids repeat
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    place = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(doc), (text_key(F.col("text")) if repeated else F.lit(0).cast("long")).alias(ref)]
    texts = docs.select("text", place[0].alias("doc"), place[1].alias("ref"))
    found = repeated_strings(texts, length, gram)
    held, rest = _with_spans(docs.select(*columns, *place), found, doc, ref)
    kinds = [T.StructField(c, T.BinaryType() if c == "kept" else T.LongType()) for c in ADDED]
    schema = T.StructType([*(docs.schema[c] for c in names), *kinds])
    return held.unionByName(rest).mapInArrow(partial(_cut, length=length, passed=names, spans=held.columns[-1]), schema)
