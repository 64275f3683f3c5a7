"""Exact deduplication over a log-structured merge index of text digests.

Each task fills a memtable of (digest, smallest identifier, count), sorts it and flushes it to an
immutable run: Parquet sorted by digest, with a Bloom filter on that column for point lookups and bitmap filters for whole tables.
Compaction merges runs and keeps the smallest identifier of every digest. Texts that the compacted run's filter
lets through are verified byte for byte before the index is believed.

Defined cases: doc_id is an integer or null; a null text counts as empty; a null doc_id sorts after all others, so it is kept only
where no row of its group has an id; of rows with equal text and equal doc_id one is kept; an empty
table gives no rows; further columns are ignored by ``find_copies`` and passed through by ``drop_copies``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import Bitmap, free, keep_rows, load_manifest, presence_bitmap, save_manifest, shared_dir, text_key, written

#: White space that one space replaces: fixed values.
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a memtable before it is flushed.
MEMTABLE_ROWS = 100_000
#: Runs on a level before they are compacted.
FANOUT = 8
RUN = "digest binary, doc_id bigint, row bigint, n bigint"
FILTERED = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(MEMTABLE_ROWS)}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _memtables(rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).sort_by([("digest", "ascending"), ("doc_id", "ascending"), ("row", "ascending")])
        d = t["digest"].combine_chunks()
        new = pa.concat_arrays([pa.array([True]), pc.not_equal(d.slice(1), d.slice(0, len(d) - 1))])
        at = pc.indices_nonzero(new).to_numpy()
        counts = [*(at[1:] - at[:-1]), len(d) - at[-1]] if len(at) else []
        t = t.filter(new).append_column("n", pa.array(counts, pa.int64()))
        return t.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
            if n >= rows:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return run


class DigestIndex:
    """Immutable sorted runs of (digest, doc_id, row, n) by level, each with its filters, in the shared folder.

    A run's filters are bitmaps over its digests (seen) and over those that it counts more than once (again). A manifest for each
    change lists runs and filters, so that ``reopen`` goes on in another session. Runs that were compacted away are left for readers.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, memtable_rows: int = MEMTABLE_ROWS, fanout: int = FANOUT):
        self.spark, self.path, self.memtable_rows, self.fanout = spark, path or shared_dir(spark, "digests"), memtable_rows, fanout
        self.levels: list[list[str]] = [[]]
        self.filters: dict[str, dict[str, int]] = {}  # words of a run's bitmaps
        self.version = self._made = 0

    @classmethod
    def reopen(cls, spark: SparkSession, path: str) -> DigestIndex:
        version, said = load_manifest(spark, path)
        index = cls(spark, path, said["memtable_rows"], said["fanout"])
        index.levels, index.filters, index.version, index._made = said["levels"], said["filters"], version, said["made"]
        return index

    def add(self, entries: DataFrame) -> None:
        """Flush entries (digest, doc_id, row) as sorted runs of level 0; compact where a level is full."""
        self._write(entries.select("digest", "doc_id", "row").mapInArrow(_memtables(self.memtable_rows), RUN), 0)
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                self.compact(level)
            level += 1

    def compact(self, upto: int | None = None) -> None:
        """Merge all runs up to a level (default: all) into one run of the next, with the smallest identifiers."""
        upto = len(self.levels) - 1 if upto is None else upto
        runs = [r for level in self.levels[: upto + 1] for r in level]
        self.levels[: upto + 1] = [[] for _ in range(upto + 1)]
        if upto + 1 == len(self.levels):
            self.levels.append([])
        self._write(_merged(self._read(runs)).sortWithinPartitions("digest"), upto + 1)

    @property
    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def table(self) -> DataFrame:
        """One row per digest: digest, doc_id and row that stay, n; merged over the runs if there are several."""
        return self._read(self.runs) if len(self.runs) == 1 and not self.levels[0] else _merged(self._read(self.runs))

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Index rows of a few digests; Bloom filters and sorted statistics skip the other row groups."""
        return _merged(self._read(self.runs).where(F.col("digest").isin(digests)))

    def repeated(self, rows: DataFrame) -> DataFrame:
        """Those rows (digest, ...) whose digest may stand for several texts: what the filter of the one compacted run lets through."""
        if len(self.runs) != 1 or self.levels[0]:
            self.compact()
        return self._filter(self.runs[0], "again").maybe(rows, F.xxhash64("digest"))

    def known(self, rows: DataFrame) -> DataFrame:
        """Those rows (digest, ...) whose digest some run may hold; the others are surely new."""
        flags = free(rows.columns, *(f"in{i}" for i in range(len(self.runs))))
        out = rows
        for run, flag in zip(self.runs, flags, strict=True):
            out = self._filter(run, "seen").marked(out, F.xxhash64("digest"), flag)
        return out.where(reduce(lambda a, b: a | b, map(F.col, flags), F.lit(False))).select(*rows.columns)

    def _filter(self, run: str, kind: str) -> Bitmap:
        return Bitmap(self.spark.read.schema("bm_word int, bm_bits long").parquet(f"{self.path}/filters/{run}/{kind}"), self.filters[run][kind])

    def _read(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(*(f"{self.path}/{r}" for r in runs)) if runs else self.spark.createDataFrame([], RUN)

    def _write(self, df: DataFrame, level: int) -> None:
        self._made += 1
        run = f"level{level}_run{self._made}"
        df.write.options(**FILTERED).parquet(f"{self.path}/{run}")
        rows = self._read([run])
        counts = rows.agg(F.count("*").alias("seen"), F.count_if(F.col("n") > 1).alias("again")).first()
        self.filters[run] = {}
        for kind, part in (("seen", rows), ("again", rows.where("n > 1"))):
            made = presence_bitmap(part, F.xxhash64("digest"), counts[kind])
            made.rows.write.parquet(f"{self.path}/filters/{run}/{kind}")
            self.filters[run][kind] = made.words
        self.levels[level].append(run)
        self.version += 1
        save_manifest(self.spark, self.path, self.version, {"levels": self.levels, "filters": {r: self.filters[r] for r in self.runs}, "memtable_rows": self.memtable_rows, "fanout": self.fanout, "made": self._made})


def _merged(runs: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k")
    return runs.groupBy("digest").agg(first, F.sum("n").alias("n")).select("digest", "k.doc_id", "k.row", "n")


def find_copies(docs: DataFrame, digest: Callable[[Column], Column] = sha256, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_key.

    digest: the index key of a normalised text. Equal digests of different texts are found by the
    verification and such groups are built on the texts themselves, so a weak digest stays exact.
    """
    keyed = docs.select("doc_id", normalised(F.col("text")).alias("t"), text_key(F.col("text")).alias("text_key")).withColumn("digest", digest(F.col("t")))
    entries = written(
        keyed.select("doc_id", "digest", "text_key", F.monotonically_increasing_id().alias("row"), *([] if digest is sha256 else [F.sha2("t", 256).alias("sha")])),
        "entries",
    )
    index = index or DigestIndex(docs.sparkSession)
    index.add(entries)
    index.compact()
    kept = index.table()
    hits = index.repeated(keyed.drop("text_key"))
    wrong = written(
        hits.groupBy("digest").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo <> hi").select("digest"), "collisions"
    )
    sha = F.lower(F.hex("digest")) if digest is sha256 else F.col("sha")
    found = entries.join(kept.select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "n"), "digest")
    out = [F.col("doc_id"), F.col("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), sha.alias("text_sha256"), F.col("text_key")]
    if not wrong.take(1):
        return found.select(*out)
    return found.join(wrong, "digest", "left_anti").select(*out).unionByName(_by_text(keyed.join(wrong, "digest", "left_semi")))


def _by_text(rows: DataFrame) -> DataFrame:
    """The same result for rows whose digests collide, from groups of the texts themselves."""
    rows = written(rows.select("doc_id", "t", "text_key", F.monotonically_increasing_id().alias("row")), "collided")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("k")
    groups = rows.groupBy("t").agg(first, F.count("*").alias("n"))
    return rows.join(groups, "t").select(
        "doc_id", F.col("k.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("k.row")).alias("kept"), F.sha2("t", 256).alias("text_sha256"), "text_key"
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    return keep_rows(docs, written(find_copies(docs).select("doc_id", "text_key", "kept"), "copies"))
