"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words (64 bits each) of a presence bitmap: at least, and at most, which bounds its broadcast to about 64 MB as a hash table.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 20
#: Bits of a bitmap for each key, as long as MOST_WORDS allows.
BITS_PER_KEY = 16
#: Spark's own limit to buckets of a table.
MOST_BUCKETS = 100_000

_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)
#: Paths of tables with buckets, by their names in this session's catalog.
_tables: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the current workspace, or ``spark.checkpoint.dir``, which driver and executors share.

    Where a session on one machine (master ``local``) names none, a temporary folder is set once; a cluster must name one.
    """
    if base := _workspace.get():
        return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("wayline.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wayline-", dir="/tmp")
        spark.conf.set("wayline.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[str]:
    """All tables that operators write inside the block go below one folder, whose name it gives; ``drop`` it once their results are used."""
    path = shared_dir(spark, name)
    token = _workspace.set(path)
    try:
        yield path
    finally:
        _workspace.reset(token)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables."""
    for table in [t for t, at in _tables.items() if f"{at}/".startswith(f"{path}/")]:
        spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        del _tables[table]
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, path: str, **options: str) -> DataFrame:
    """The rows of df from a table at path: cuts lineage and survives lost executors."""
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The rows of df from a new table in the shared folder."""
    return stored(df, shared_dir(df.sparkSession, name), **options)


def buckets(spark: SparkSession) -> int:
    return min(MOST_BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def bucketed(df: DataFrame, key: str, path: str, n: int, **options: str) -> DataFrame:
    """The rows of df from a new table at path with n buckets by key: joins and groups on the key shuffle only other sides."""
    df.write.bucketBy(n, key).options(path=path, **options).format("parquet").saveAsTable(name := _table_name(path))
    return df.sparkSession.table(name)


def append_run(df: DataFrame, run: int, key: str, path: str, n: int, table: str | None) -> str:
    """df as one more partition of a table of runs at path, in n buckets by key, sorted in them; the table's name.

    All runs are one table, so that a single scan reads a bucket of all of them together (a union of bucketed tables is not to be
    relied on: Spark 4.1.2 takes it for partitioned by the key and then does not bring the tables' buckets together).
    """
    table = table or _table_name(path)
    writer = df.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").bucketBy(n, key).sortBy(key)
    writer.option("path", path).format("parquet").saveAsTable(table)
    return table


def _table_name(path: str) -> str:
    name = f"wayline_{uuid.uuid4().hex}"
    _tables[name] = path
    return name


def reopened(spark: SparkSession, key: str, path: str, n: int, schema: str) -> str:
    """The name of a table of runs that ``append_run`` wrote, perhaps in another session."""
    name = _table_name(path)
    spark.sql(f"CREATE TABLE `{name}` ({schema}, run int) USING parquet PARTITIONED BY (run) CLUSTERED BY ({key}) SORTED BY ({key}) INTO {n} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(name)
    return name


def save_manifest(spark: SparkSession, path: str, version: int, content: dict) -> None:
    """What an index consists of, as a text file for each version."""
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.text(f"{path}/manifest/{version:09d}")


def load_manifest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(version, content) of the newest manifest."""
    rows = spark.read.text(f"{path}/manifest/*").select("value", F.input_file_name().alias("f"))
    newest = rows.orderBy(F.desc("f")).first()
    return int(re.search(r"/manifest/(\d{9})/", newest["f"])[1]), json.loads(newest["value"])


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work for mapInArrow, after whose end the worker's freed memory goes back to the machine: workers outlive their tasks, and wait with it beside those of later stages."""
    return partial(_tidied, work)


def _tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    try:
        yield from work(batches)
    finally:
        give_back()


def give_back() -> None:
    """Free memory that Arrow and the C library hold goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of GNU's C library only
        trim(0)


def others(columns: Iterable[str], added: Iterable[str]) -> list[str]:
    """Columns whose names are not among the added ones, in any case."""
    taken = {a.casefold() for a in added}
    return [c for c in columns if c.casefold() not in taken]


def free(columns: Iterable[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front where columns have them, in any case."""
    taken, out = {c.casefold() for c in columns}, []
    for w in wanted:
        while w.casefold() in taken:
            w = f"_{w}"
        taken.add(w.casefold())
        out.append(w)
    return out


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns of these names (in any case) renamed, and their names by the new ones, for ``withColumnsRenamed`` back."""
    taken = {n.casefold() for n in names}
    clash = [c for c in df.columns if c.casefold() in taken]
    renamed = free([*df.columns, *names], *(f"own_{c}" for c in clash))
    return df.withColumnsRenamed(dict(zip(clash, renamed, strict=True))), dict(zip(renamed, clash, strict=True))


@dataclass(frozen=True)
class Bitmap:
    """Bits of 64-bit hashes as rows (bm_word, bm_bits), at most MOST_WORDS of them whatever the input's size.

    A full bitmap lets more rows through; it never hides one, so a join behind it stays exact. It keeps rows out
    of shuffles up to about MOST_WORDS * 64 keys; with many times as many it lets nearly all through.
    """

    rows: DataFrame
    words: int

    def _word(self, h: Column) -> Column:
        return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(self.words - 1)).cast("int")

    def maybe(self, df: DataFrame, hashed: Column) -> DataFrame:
        """Rows of df whose hash may be in the bitmap; the bitmap's size is bounded, so it is broadcast."""
        (name,) = free(df.columns, "maybe")
        return self.marked(df, hashed, name, "inner").where(F.col(name)).select(*df.columns)

    def marked(self, df: DataFrame, hashed: Column, name: str, how: str = "left") -> DataFrame:
        """All rows of df with a column that says whether their hash may be in the bitmap."""
        h, w, b = free([*df.columns, name], "hash", "word", "bits")
        words = F.broadcast(self.rows.select(F.col("bm_word").alias(w), F.col("bm_bits").alias(b)))
        inside = F.coalesce(F.getbit(b, _bit(F.col(h))) == 1, F.lit(False))
        return df.withColumn(h, hashed).join(words, self._word(F.col(h)) == F.col(w), how).select(*df.columns, inside.alias(name))


def bitmap_words(n: int) -> int:
    return max(LEAST_WORDS, min(MOST_WORDS, 1 << max(0, n * BITS_PER_KEY // 64 - 1).bit_length()))


def presence_bitmap(keys: DataFrame, hashed: Column, n: int) -> Bitmap:
    """A bitmap of about n keys."""
    made = Bitmap(keys, bitmap_words(n))
    bits = keys.select(made._word(hashed).alias("bm_word"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(hashed)).alias("b"))
    return Bitmap(bits.groupBy("bm_word").agg(F.bit_or("b").alias("bm_bits")), made.words)


def _bit(h: Column) -> Column:
    return h.bitwiseAND(F.lit(63)).cast("int")


def text_key(text: Column) -> Column:
    """64 bits of a text as it is, to tell rows with equal ids apart; null and empty differ."""
    return F.xxhash64(text.isNull(), text)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of docs that a decision keeps; decided: doc_id, text_key, kept for every row of docs, from a written table.

    Rows that are surely kept stream through; only those whose key may be among the dropped ones are shuffled.
    Of rows with equal id and text one stays where any is kept and any is dropped.
    """
    hashed = F.xxhash64("doc_id", "text_key")
    dropped = decided.where("NOT kept")
    bitmap = presence_bitmap(dropped, hashed, dropped.count())
    bitmap = Bitmap(written(bitmap.rows, "dropped"), bitmap.words)
    key, maybe, k_id, k_key = free(docs.columns, "key", "maybe", "k_id", "k_key")
    keyed = docs.withColumn(key, text_key(F.col("text")))
    split = bitmap.marked(keyed, F.xxhash64("doc_id", key), maybe)
    sure = split.where(~F.col(maybe)).select(*docs.columns)
    kept = bitmap.maybe(decided.where("kept").select("doc_id", "text_key"), hashed)
    kept = kept.select(F.col("doc_id").alias(k_id), F.col("text_key").alias(k_key))
    same = F.col("doc_id").eqNullSafe(F.col(k_id)) & (F.col(key) == F.col(k_key))
    rest = split.where(F.col(maybe)).join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).select(*docs.columns)
    return sure.unionByName(rest)


def hashed_sample(rows: DataFrame, key: str, most: int, n: int) -> DataFrame:
    """At most ``most`` of n rows, chosen by a hash of their key; only about twice as many are ever sorted."""
    if n > 2 * most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(1_000_000)) < int(2_000_000 * most / n) + 1)
    return rows.orderBy(F.xxhash64(key), key).limit(most)
