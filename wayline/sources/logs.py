"""Logs in and out: CSV files per lane, pose messages, and complete snapshots as Parquet with their roles."""

from __future__ import annotations

import csv
import os
import re
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from itertools import groupby
from operator import itemgetter
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.frame import LaneFrame, RoleError
from wayline.functions import spatial as sp

#: Names that a time column may have when none is given: fixed values.
TIME_NAMES = ("time", "t", "timestamp", "stamp", "time_s")


@dataclass(frozen=True)
class CsvOptions:
    """How CSV logs are read.

    order: what a lane's times must be as they are read (after sorting, with sort_time): nondecreasing, increasing, or any.
    normalize: repeated times of an increasing order are left out but for their first sample, instead of being an error.
    metadata: columns that say the same in every row of a file; they become lane attributes (``lane_metadata``) and leave the samples.
    """

    time: str | None = None
    values: Sequence[str] | None = None
    metadata: Sequence[str] = ()
    sort_time: bool = True
    order: str = "nondecreasing"
    normalize: bool = False
    invalid_time: str = "fail"  # or drop
    exact_integers: bool = False  # times as BIGINT
    lane: str = "trial"


@dataclass(frozen=True)
class CsvExport:
    """How CSV logs are written; float_format: such as ``%.3f`` (default: all digits)."""

    float_format: str | None = None
    header: bool = True


def _header(spark: SparkSession, paths: list[str]) -> list[str]:
    """Names of the columns, which the first lines of all files must agree on; each file's first line is found where the file is read."""
    lines = spark.read.text(paths, wholetext=False).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    firsts = lines.where("at = 0").groupBy("f").agg(F.min_by("value", "n").alias("head"))
    heads = [r["head"] for r in firsts.select(F.regexp_replace("head", "^\ufeff", "").alias("head")).distinct().limit(2).collect()]
    if not heads:
        raise RoleError("no header")
    names = [[h.strip() for h in next(csv.reader([head]), [])] for head in heads]
    if len(names) > 1 and names[0] != names[1]:
        raise RoleError(f"files have different headers, {names[0]} and {names[1]}")
    if "" in names[0] or len(set(names[0])) < len(names[0]) or any("\x00" in n for n in names[0]):
        raise RoleError(f"empty, repeated or broken names in the header {names[0]}")
    return names[0]


def _csv(spark: SparkSession, path: str | Sequence[str], options: CsvOptions) -> tuple[DataFrame, list[str], str, list[str]]:
    """(rows, lane keys, time, values): lane keys are the folders' (``key=value``), or else the file's name under the option's."""
    paths = [path] if isinstance(path, str) else list(path)
    names = _header(spark, paths)
    time = options.time or next((n for n in TIME_NAMES if n in names), None)
    if time not in names:
        raise RoleError("no time column")
    if missing := [n for n in (*(options.values or ()), *options.metadata) if n not in names]:
        raise RoleError(f"no columns {missing}")
    values = list(options.values or [n for n in names if n != time and n not in options.metadata])
    kinds = {n: T.DoubleType() for n in values} | {time: T.LongType() if options.exact_integers else T.DoubleType()}
    schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    df = spark.read.csv(paths, schema=schema, header=True, enforceSchema=False, mode="FAILFAST")
    if keys := [c for c in df.columns if c not in names]:
        return df, keys, time, values
    again = [stem for stem, n in Counter(PurePosixPath(f).name.rpartition(".")[0] or PurePosixPath(f).name for f in df.inputFiles()).items() if n > 1]
    if again:
        raise RoleError(f"files of the same name in several folders would be one lane: {again[:3]}")
    lane = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return df.withColumn(options.lane, lane), [options.lane], time, values


def read_csv_logs(spark: SparkSession, path: str | Sequence[str], options: CsvOptions = CsvOptions()) -> LaneFrame:
    """Many CSV files as one LaneFrame; a file's name without its ending is its lane, or in folders as ``write_csv_logs`` makes them their keys are the lane's.

    All files must have the same header; empty, repeated and broken names fail, and so do files of the same name in several folders. Names may be quoted.
    Value columns must be numbers.
    """
    if options.order not in ("nondecreasing", "increasing", "any"):
        raise ValueError(f"unknown order {options.order}")
    df, keys, time, values = _csv(spark, path, options)
    kind = df.schema[time].dataType
    df = df.select(*keys, F.col(f"`{time}`").alias("time"), *(F.col(f"`{v}`") for v in values), F.monotonically_increasing_id().alias("__row"))
    bad = F.col("time").isNull() if options.exact_integers else F.col("time").isNull() | F.isnan("time")
    df = df.where(~bad) if options.invalid_time == "drop" else df.withColumn("time", F.when(bad, F.raise_error(F.lit("a time is missing")).cast(kind)).otherwise(F.col("time")))
    names = {v: v.replace(".", "_") for v in values}
    out = LaneFrame.of(df.withColumnsRenamed({**names, "__row": "seq"}), keys, "time", list(names.values()))
    return in_time(out.renumbered(*(["time", "seq"] if options.sort_time else ["seq"])), options)


def in_time(out: LaneFrame, options) -> LaneFrame:
    """The frame with its times held to the options' order, or an error where they are not."""
    if options.order == "any":
        return out
    before = F.lag(out.clock).over(out.ordered)
    if options.order == "increasing" and options.normalize:
        out = out.over(out.df.withColumn("__again", F.coalesce(before == F.col(out.clock), F.lit(False))).where("NOT __again").drop("__again")).renumbered()
        before = F.lag(out.clock).over(out.ordered)
    fault = F.coalesce(before > F.col(out.clock) if options.order == "nondecreasing" else before >= F.col(out.clock), F.lit(False))
    checked = F.when(fault, F.raise_error(F.lit(f"times are not {options.order}")).cast("boolean")).otherwise(F.lit(True))
    return out.over(out.df.withColumn("__good", checked).where("__good").drop("__good"))


def lane_metadata(spark: SparkSession, path: str | Sequence[str], options: CsvOptions) -> DataFrame:
    """Lane and its metadata columns, one row for each file; a file that says several things in one is an error."""
    df, keys, _, _ = _csv(spark, path, options)
    one = [F.when(F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`")), F.min(f"`{c}`")).otherwise(F.raise_error(F.lit(f"{c} changes inside a file")).cast("string")).alias(c.replace(".", "_")) for c in options.metadata]
    return df.groupBy(*keys).agg(*one) if one else df.select(*keys).distinct()


def write_csv_logs(frame: LaneFrame, path: str, options: CsvExport = CsvExport()) -> None:
    """One folder per lane with its samples in order, in one file each: lanes are not split between tasks.

    Below a mounted folder (``file:`` or a plain path) tasks write the lanes' files themselves, with the lines that Spark's CSV writer would write: its own files take several
    milliseconds each there. All lanes appear at once, by one rename. Elsewhere Spark's writer is used.
    """
    df = frame.df.select(*frame.keys, frame.seq, *([frame.clock] if frame.clock else []), *frame.fields)
    columns = [c for c in df.columns if c not in (*frame.keys, frame.seq)]
    if options.float_format:
        floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name in columns]
        df = df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(options.float_format, F.col(c))) for c in floats})
    at = _mounted(df.sparkSession, path)
    if at is None or not columns or not all(isinstance(df.schema[c].dataType, LINES) for c in columns):
        df = df.repartition(*(F.col(k) for k in frame.keys)).sortWithinPartitions(*frame.keys, frame.seq).drop(frame.seq)
        df.write.partitionBy(*frame.keys).option("header", options.header).csv(path)
        return
    if os.path.exists(at):
        raise FileExistsError(path)
    names = [f"__k{i}" for i in range(len(frame.keys))]
    lines = df.select(*(F.col(k).cast("string").alias(n) for k, n in zip(frame.keys, names, strict=True)), F.col(frame.seq).alias("__n"), F.to_csv(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("__line"))
    lines = lines.repartition(*names).sortWithinPartitions(*names, "__n").drop("__n")
    head = df.sparkSession.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(c) for c in columns))).alias("head")).first()[0] if options.header else None
    hidden = os.path.join(os.path.dirname(at), f".{os.path.basename(at)}-{uuid.uuid4().hex}")
    os.makedirs(hidden)
    try:
        lines.mapInArrow(partial(_lane_files, at=hidden, keys=list(frame.keys), head=head), "lanes long").agg(F.sum("lanes")).collect()
        open(os.path.join(hidden, "_SUCCESS"), "w").close()
        os.rename(hidden, at)
    except BaseException:
        shutil.rmtree(hidden, ignore_errors=True)
        raise


#: Types of columns that tasks write as lines; others are left to Spark's writer, which refuses them.
LINES = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: Characters of keys that Spark escapes in folders' names.
ESCAPED = {c: f"%{c:02X}" for c in (*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^"))}


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The path in the local file tree, if that is where Spark would write it."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme is None:
        plain = os.path.isabs(path) and spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
        return os.path.normpath(path) if plain else None
    return os.path.normpath(re.sub(r"^file:/+", "/", path)) if scheme[1] == "file" and "%" not in path else None


def _lane_files(batches: Iterator[pa.RecordBatch], at: str, keys: list[str], head: str | None) -> Iterator[pa.RecordBatch]:
    """Writes each lane's lines, which come one after another; a file has a hidden name until it is whole, so a repeated task does no harm."""
    lane, sink, hidden, final, n = None, None, "", "", 0

    def close() -> None:
        if sink is not None:
            sink.close()
            os.replace(hidden, final)

    for b in batches:
        lanes = zip(*(c.to_pylist() for c in b.columns[:-1]), strict=True)
        for found, rows in groupby(zip(lanes, b.column("__line").to_pylist(), strict=True), key=itemgetter(0)):
            if sink is None or found != lane:
                close()
                lane, n = found, n + 1
                folder = os.path.join(at, *(f"{k.translate(ESCAPED)}={v.translate(ESCAPED) if v else '__HIVE_DEFAULT_PARTITION__'}" for k, v in zip(keys, lane, strict=True)))
                os.makedirs(folder, exist_ok=True)
                # null and empty keys share a folder, not a file
                hidden, final = os.path.join(folder, f".{uuid.uuid4().hex}"), os.path.join(folder, f"part-{''.join('n' if v is None else 'v' for v in lane)}.csv")
                sink = open(hidden, "w", encoding="utf-8", newline="")
                if head is not None:
                    sink.write(head + "\n")
            sink.write("\n".join(line for _, line in rows) + "\n")
    close()
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["lanes"])


def save(frame: LaneFrame, path: str, replace: bool = False) -> None:
    """Rows as Parquet and roles beside them; an existing snapshot is an error unless it may be replaced."""
    mode = "overwrite" if replace else "errorifexists"
    frame.df.write.mode(mode).parquet(f"{path}/rows")
    spark = frame.df.sparkSession
    spark.createDataFrame([(frame.to_json(),)], "roles string").coalesce(1).write.mode(mode).text(f"{path}/roles")


def load(spark: SparkSession, path: str) -> LaneFrame:
    """A snapshot, lazily; roles are checked against its columns."""
    return LaneFrame.from_json(spark.read.parquet(f"{path}/rows"), spark.read.text(f"{path}/roles").first()[0])


def poses_from_messages(messages: DataFrame, lane: str = "trial") -> LaneFrame:
    """Pose samples of decoded pose messages (PoseStamped, Odometry or TransformStamped fields as nested structs).

    The header's stamp in whole nanoseconds is the clock. ``bags`` reads bag files themselves.
    """
    fields = dict(messages.dtypes)
    if "transform" in fields:
        p, q = F.col("transform.translation"), F.col("transform.rotation")
    elif "pose" in fields and "pose:struct" in fields["pose"]:
        p, q = F.col("pose.pose.position"), F.col("pose.pose.orientation")
    elif "pose" in fields:
        p, q = F.col("pose.position"), F.col("pose.orientation")
    else:
        raise RoleError("no pose in the messages")
    stamp = F.col("header.stamp.sec").cast("long") * 1_000_000_000 + F.col("header.stamp.nanosec").cast("long")
    df = messages.select(lane, stamp.alias("time"), F.struct(p.alias("p"), q.alias("q")).alias("pose"))
    return LaneFrame.of(df, [lane], "time", ["pose"])


@dataclass(frozen=True)
class Layout:
    """Roles to be given to many tables: which columns are lane keys, sample number, clock and fields."""

    keys: Sequence[str]
    clock: str | None
    fields: Sequence[str] | None = None
    seq: str = "seq"
    size: str | None = None
    order: Sequence[str] = ()

    def frame(self, df: DataFrame) -> LaneFrame:
        """df in these roles; without named fields all other numbers are fields."""
        taken = {*self.keys, self.clock, self.seq, self.size, *self.order}
        fields = self.fields or [f.name for f in df.schema if f.name not in taken and isinstance(f.dataType, T.NumericType)]
        return LaneFrame.of(df, self.keys, self.clock, fields, self.order, self.seq, self.size)


@dataclass(frozen=True)
class Recipe:
    """A position, a rotation, or with both a pose, from columns named by patterns such as ``drone.position.{x,y,z}``."""

    position: str | None = None
    rotation: str | None = None

    def build(self, frame: LaneFrame, output: str, prefix: str = "", **ids: str | None) -> LaneFrame:
        """The frame with the field added; ids: frame ids (parent, child, expressed_in)."""
        if not self.position and not self.rotation:
            raise ValueError("a recipe names a position or a rotation")
        parts = [sp.vector_of(frame.df, prefix + p) if p else None for p in (self.position, self.rotation)]
        field = sp.pose(*parts) if all(p is not None for p in parts) else next(p for p in parts if p is not None)
        return frame.with_fields(**{output: field}).retag(**ids)
