"""BPE encoding and decoding with a table of distinct words.

Spark splits every text at white space. A block of documents, bounded in words and bytes, becomes its distinct words and,
for each document, the numbers of its words in order of position; blocks are written once, in buckets. The
distinct words of all blocks are brought together by word (packed, as lists of a block's words for each part of the word space; a task takes its parts one after
another), so each word of the corpus reaches the encoder once, however many blocks have it, and its ids go back to every block that has the word. Then each block
meets its words' ids again, joins them to their pieces, once for each word of the block, by their places in the task's vocabulary, and the ids of every document
are put together by position. Nothing is left out of the table: frequent, rare and very long words go the same way.

The tokenizer splits at white space before anything else that spans characters, so the ids of a text are
those of its words in turn; its decoder joins pieces by spaces, so the decoded text is that of its words in turn too.
``decode`` turns any ids into text, by a join with a table of the vocabulary at every position.

Defined cases: null counts as the empty text, which has no ids and decodes to the empty string; special
strings inside texts are special tokens, as in the library; ids outside the vocabulary are skipped when decoding;
a text without white space is one word; repeated rows give repeated rows; an empty table gives no rows; further columns pass
through, of the names that this operator adds the input's are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from wayline.llm.common import bucketed, buckets, free, give_back, others, shared_dir, tidy

#: Words, and bytes of text, of a block; a single larger text is a block of its own.
BLOCK_WORDS, BLOCK_BYTES = 2 << 20, 16 << 20
#: Bytes of pieces, with their ids, that an encoder remembers; it starts afresh beyond.
REMEMBERED_BYTES = 16 << 20
#: Longest piece that it remembers.
REMEMBERED_PIECE = 64
#: Below this character normalisation changes nothing but case, letter by letter; fixed value.
PLAIN = "ɐ"
#: How the tokenizer splits words: fixed value.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

IDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]
DECODED = T.StructField("decoded", T.StringType())


def words_of(text: str | None) -> list[bytes]:
    """Words at ASCII white space, A-Z lowered but where a special string may be."""
    raw = (text or "").encode("utf-8", "replace")
    return [w if b"<|" in w else w.lower() for w in raw.split()] if b"<|" in raw else raw.lower().split()


class _Codes(dict):
    """Numbers of a block's words, in order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def _short(codes: np.ndarray) -> bytes:
    """Numbers in two bytes each, those that need more behind them: most words of a text are among the first of its block."""
    low = np.minimum(codes, 0xFFFF).astype("<u2")
    return len(codes).to_bytes(4, "little") + low.tobytes() + codes[codes >= 0xFFFF].astype("<u4").tobytes()


def _long(held: bytes) -> np.ndarray:
    n = int.from_bytes(held[:4], "little")
    codes = np.frombuffer(held, "<u2", n, 4).astype(np.int64)
    codes[codes == 0xFFFF] = np.frombuffer(held, "<u4", -1, 4 + 2 * n)
    return codes


def _blocks(batches: Iterator[pa.RecordBatch], passed: list[str], names: list[str], most_words: int) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their block, codes (numbers of its words, as ``_short`` has them) and, in a block's first row, its words."""
    table, held, codes, n, size = _Codes(), [], [], 0, 0

    def out() -> pa.RecordBatch:
        rows = pa.concat_batches(held) if passed else None
        block = int.from_bytes(os.urandom(8), "little") >> 1
        lists = pa.array([list(table), *[None] * (len(codes) - 1)], pa.list_(pa.binary()))
        made = [pa.array(np.full(len(codes), block)), pa.array(codes, pa.binary()), lists]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in passed), *made], names=[*passed, *names])

    for batch in batches:
        texts, start = batch.column("text"), 0
        for i in range(batch.num_rows):
            words = words_of(texts[i].as_py())
            codes.append(_short(np.fromiter(map(table.__getitem__, words), np.uint32, len(words))))
            n, size = n + len(words), size + sum(map(len, words)) + len(words)
            if n >= most_words or size >= BLOCK_BYTES:
                held.append(batch.slice(start, i + 1 - start).select(passed))
                yield out()
                table, held, codes, n, size, start = _Codes(), [], [], 0, 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start).select(passed))
    if codes:
        yield out()


_loaded: dict[str, Tokenizer] = {}


def tokenizer_of(path: str) -> Tokenizer:
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Tokenizer.from_file(path)
        _loaded[path].no_truncation()
        _loaded[path].no_padding()
    return _loaded[path]


class WordEncoder:
    """Ids of words, as little-endian 32-bit integers; remembers short pieces up to a number of bytes."""

    def __init__(self, path: str):
        self.tokenizer, self.pieces, self.held = tokenizer_of(path), {}, 0
        self.split = regex.compile(PIECES).findall

    def __call__(self, word: bytes) -> bytes:
        text = word.decode("utf-8")
        if b"<|" in word or max(text) >= PLAIN:
            return self._encode(text)
        return b"".join(map(self._piece, self.split(text.lower())))

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._encode(piece)
            if len(piece) <= REMEMBERED_PIECE:
                self.held += 200 + 4 * len(piece)
                if self.held > REMEMBERED_BYTES:
                    self.pieces.clear()
                    self.held = 0
                self.pieces[piece] = ids
        return ids


def _parted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Lists of words (sorted, one a line) and their codes, for each block and part of the word space."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        for block, held in zip(batch.column("block").to_pylist(), batch.column("words"), strict=True):
            listed = held.as_py()
            part = np.fromiter(map(xxhash.xxh64_intdigest, listed), np.uint64, len(listed)) % np.uint64(parts)
            order = np.array(sorted(range(len(listed)), key=listed.__getitem__), np.int64)
            order = order[np.argsort(part[order], kind="stable")]
            edges = np.append(np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1)), len(order)).tolist()
            made = [(int(part[order[a]]), block, pack(b"\n".join([listed[i] for i in order[a:b].tolist()])), pack(order[a:b].astype(np.uint32).tobytes())) for a, b in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "block", "words", "codes"])


#: Parts of the word space that a task takes one after another: so much less of it is in memory.
TURNS = 4
GATHERED = ("block", "codes", "sizes", "ids")


def _repeated(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all numbers in spans."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


_vocabularies: dict[str, pa.Array] = {}


def _spelt(ids: np.ndarray, sizes: np.ndarray, path: str) -> np.ndarray:
    """Texts of words of so many ids each: every id is joined to its piece by its place in the vocabulary, and pieces are joined by spaces."""
    if path not in _vocabularies:
        tokenizer = tokenizer_of(path)
        _vocabularies[path] = pa.array([tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), _vocabularies[path].take(pa.array(ids)))
    return pc.binary_join(lists, " ").cast(pa.binary()).to_numpy(zero_copy_only=False)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, encoder: type = WordEncoder) -> Iterator[pa.RecordBatch]:
    """For each block and part of the word space, in order of part: codes with the ids of their words, packed. Each word of a part is encoded once."""
    encode = encoder(path)
    pack, unpack = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
    held, last = [], None

    def out() -> pa.RecordBatch:
        table, rows = _Codes(), []
        for block, words, codes in held:
            numbers = np.fromiter(map(table.__getitem__, unpack(words).split(b"\n")), np.int64)
            rows.append((block, np.frombuffer(unpack(codes), np.uint32), numbers))
        ids = [encode(w) for w in table]
        sizes, flat = np.array([len(x) // 4 for x in ids], np.int64), np.frombuffer(b"".join(ids), "<u4")
        starts, made = np.cumsum(sizes) - sizes, []
        for block, codes, numbers in rows:
            order = np.argsort(codes)  # in order of code, so that numbers pack well
            numbers, own = numbers[order], sizes[numbers[order]]
            taken = flat[_repeated(starts[numbers], own)]
            narrow = taken.astype("<u2") if len(taken) == 0 or taken.max() <= 0xFFFF else taken
            made.append((block, pack(np.diff(codes[order], prepend=np.uint32(0)).tobytes()), pack(own.astype(np.uint32).tobytes()), pack(bytes([narrow.itemsize]) + narrow.tobytes())))
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), *[pa.binary()] * 3))], names=list(GATHERED))

    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "words", "codes")), strict=True):
            if part != last and held:
                yield out()
                held.clear()
            held.append(row)
            last = part
    if held:
        yield out()


def _listed(held: list[bytes]) -> pa.ListArray:
    """Ids as arrays; a last part of under four bytes is no id."""
    sizes = np.array([len(x) // 4 for x in held], np.int64)
    flat = np.frombuffer(b"".join(x[: 4 * n] for x, n in zip(held, sizes.tolist(), strict=True)), "<i4")
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))


def _as_lists(batches: Iterator[pa.RecordBatch], ids: str, seq: str) -> Iterator[pa.RecordBatch]:
    """The rows with the ids as an array too."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, _listed([x.as_py() or b"" for x in b.column(ids)])], names=[*b.schema.names, seq])


def _spoken(batches: Iterator[pa.RecordBatch], passed: list[str], output: str) -> Iterator[pa.RecordBatch]:
    """Rows (passed columns in the first of a sequence, position, piece) as one row for each sequence, pieces joined by spaces."""
    row, parts, at = None, [], -1

    def out(done: list[tuple]) -> pa.RecordBatch:
        rows = pa.concat_batches([d[0] for d in done])
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in passed), pa.array([d[1] for d in done], pa.string())], names=[*passed, output])

    for batch in batches:
        where = batch.column("pos").fill_null(0).to_numpy()
        before = np.append(at, where[:-1])
        if not ((where == 0) | (where == before + 1)).all():
            raise RuntimeError("the pieces of a sequence came out of order")
        at = where[-1] if len(where) else at
        some = batch.column("piece").is_valid()
        pieces, count = batch.column("piece").drop_null(), np.append(0, np.cumsum(some.to_numpy(zero_copy_only=False)))
        starts = np.flatnonzero(where == 0)
        edges = np.concatenate([[0], starts, [len(where)]])
        lists = pa.ListArray.from_arrays(pa.array(count[edges], pa.int32()), pieces)
        said, full = pc.binary_join(lists, " ").to_pylist(), np.diff(count[edges]) > 0
        held = batch.select(passed)
        parts += said[:1] if full[0] else []
        done, firsts = [], held.take(pa.array(starts)) if len(starts) else None
        for k in range(len(starts)):
            if row is not None:
                done.append((row, " ".join(parts)))
            row, parts = firsts.slice(k, 1), [said[k + 1]] if full[k + 1] else []
        if done:
            yield out(done)
    if row is not None:
        yield out([(row, " ".join(parts))])


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece) of the vocabulary: its size, which the tokenizer's file fixes, bounds a broadcast."""
    tokenizer = tokenizer_of(path)
    pieces = [(i, p) for i in range(tokenizer.get_vocab_size()) if (p := tokenizer.id_to_token(i)) is not None]
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in pieces], pa.int32()), "piece": [p for _, p in pieces]}))


def _joined(listed: DataFrame, seq: str, passed: list[str], path: str) -> DataFrame:
    """Rows (passed columns, in the first row of each sequence, as p0, p1 ...; pos, piece): each id of an array joined to its piece.

    Exploding and the broadcast join keep the order of rows, so sequences are put together behind it without a shuffle.
    """
    pos, piece_id = free(passed, "pos", "piece_id")
    exploded = listed.select(*passed, F.posexplode_outer(seq).alias(pos, piece_id))
    table = F.broadcast(piece_table(listed.sparkSession, path).select(F.col("id").alias("v_id"), F.col("piece").alias("v_piece")))
    first = F.coalesce(F.col(pos), F.lit(0)) == 0
    kept = [F.when(first, F.col(c)).alias(f"p{i}") for i, c in enumerate(passed)]
    exploded = exploded.select(*kept, F.col(pos).alias("pos"), F.col(piece_id).alias("piece_id"))
    return exploded.join(table, F.col("piece_id") == F.col("v_id"), "left").select(*(f"p{i}" for i in range(len(passed))), "pos", F.col("v_piece").alias("piece"))


def with_pieces(df: DataFrame, ids: str, path: str, output: str) -> DataFrame:
    """df with the text of its ids (little-endian 32-bit integers): each id is joined to its piece, position by position."""
    passed = others(df.columns, [output])
    (seq,) = free(df.columns, "seq")
    listed = df.select(*passed).mapInArrow(partial(_as_lists, ids=ids, seq=seq), T.StructType([*(df.schema[c] for c in passed), T.StructField(seq, T.ArrayType(T.IntegerType()))]))
    names = [f"p{i}" for i in range(len(passed))]
    schema = T.StructType([*(T.StructField(n, df.schema[c].dataType) for n, c in zip(names, passed, strict=True)), T.StructField(output, T.StringType())])
    said = _joined(listed, seq, passed, path).mapInArrow(partial(_spoken, passed=names, output=output), schema)
    return said.select(*(F.col(n).alias(c) for n, c in zip(names, passed, strict=True)), output)


def _placed(rows: pa.Table, words: pa.Table, passed: list[str], codes: str, decoded: bool, path: str) -> pa.Table:
    """Documents of a block with the ids (and texts) of their words in order of position."""
    unpack = zstandard.ZstdDecompressor().decompress

    def column(name: str, read: Callable[[bytes], np.ndarray], kind: type) -> np.ndarray:
        return np.concatenate([np.zeros(0, kind), *(read(unpack(x.as_py())) for x in words[name])])

    at = column("codes", lambda b: np.cumsum(np.frombuffer(b, np.uint32), dtype=np.int64), np.int64)
    size = column("sizes", lambda b: np.frombuffer(b, np.uint32), np.int64)
    flat = column("ids", lambda b: np.frombuffer(b, f"<u{b[0]}", offset=1), np.uint32).astype("<u4")
    order = np.argsort(at)
    start, size = (np.cumsum(size) - size)[order], size[order]
    said = _spelt(flat[_repeated(start, size)], size, path) if decoded and len(order) else np.zeros(0, object)
    ids, counts, texts = [], [], []
    for c in rows[codes]:
        at = _long(c.as_py())
        own = size[at]
        ids.append(flat[_repeated(start[at], own)].tobytes())
        counts.append(int(own.sum()))
        if decoded:
            texts.append(b" ".join(said[at[own > 0]].tolist()).decode("utf-8", "replace"))
    made = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array(counts, pa.int64())} | ({"decoded": pa.array(texts, pa.string())} if decoded else {})
    return pa.table([*(rows[c] for c in passed), *made.values()], names=[*passed, *made])


def _coded(docs: DataFrame, path: str, keep: tuple[str, ...] | None, decoded: bool, block_words: int) -> DataFrame:
    spark, added = docs.sparkSession, [*IDS, *([DECODED] if decoded else [])]
    passed = [c for c in others(docs.columns, [a.name for a in added]) if keep is None or c in keep]
    block, codes, words = names = free([*passed, *(a.name for a in added)], "block", "codes", "words")
    fields = [docs.schema[c] for c in passed]
    made = [T.StructField(block, T.LongType()), T.StructField(codes, T.BinaryType()), T.StructField(words, T.ArrayType(T.BinaryType()))]
    rows = docs.select(*dict.fromkeys([*passed, "text"])).mapInArrow(tidy(partial(_blocks, passed=passed, names=names, most_words=block_words)), T.StructType([*fields, *made]))
    rows = bucketed(rows, block, shared_dir(spark, "blocks"), buckets(spark), compression="zstd")
    tasks = buckets(spark)
    entries = rows.where(F.size(words) > 0).select(F.col(block).alias("block"), F.col(words).alias("words")).mapInArrow(tidy(partial(_parted, parts=TURNS * tasks)), "part int, block long, words binary, codes binary")
    entries = entries.repartitionById(tasks, F.pmod("part", F.lit(tasks)).cast("int")).sortWithinPartitions("part")
    entries = entries.mapInArrow(tidy(partial(_encoded, path=path)), "block long, codes binary, sizes binary, ids binary")
    entries = entries.withColumnRenamed("block", block)
    place = partial(_placed, passed=passed, codes=codes, decoded=decoded, path=path)

    def placed(rows: pa.Table, words: pa.Table) -> pa.Table:
        made = place(rows, words)
        give_back()  # a block takes much more than its documents
        return made

    left = rows.select(block, *passed, codes)
    return left.groupBy(block).cogroup(entries.groupBy(block)).applyInArrow(placed, T.StructType([*fields, *added]))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The kept columns of docs (default all) with ids (binary: little-endian unsigned 32-bit) and n_tokens."""
    return _coded(docs, path, keep, False, block_words)


def round_trip(docs: DataFrame, path: str, keep: tuple[str, ...] | None = None, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``encode`` and ``decode`` together: ids meet their pieces once for each word of a block, not at every position."""
    return _coded(docs, path, keep, True, block_words)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids, ...) with decoded: the pieces of the ids, joined by spaces (this vocabulary's word ends show them)."""
    return with_pieces(encoded, "ids", path, "decoded")
