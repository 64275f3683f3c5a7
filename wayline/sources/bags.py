"""Recorded bags of pose messages as a data source of Spark: read by byte ranges, written one bag a lane.

Read are bags of format 2.0 (``.bag``; chunks plain, bz2 or lz4) and bags in SQLite files (``.db3``, messages in CDR), which may be several in
a folder that is one lane. A task has a byte range of a file, reads the file's index and the chunks that begin in its range, or its share of row
numbers; the driver only lists files. Files are opened through ``pyarrow.fs``, so paths are those of a mounted folder or URIs it knows; SQLite files
must be on a mounted folder.

Defined cases: a bag without messages has no samples; one that was not closed (no index) is an error, as are a chunk or message that breaks off, a
topic or type that is missing or not told apart, messages other than PoseStamped, Odometry and TransformStamped, and bags of one name. Repeated
messages stay, in the order of their receive times, then of the file.
"""

from __future__ import annotations

import bz2
import json
import os
import re
import sqlite3
import struct
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wayline.frame import LaneFrame, RoleError
from wayline.functions import spatial as sp
from wayline.sources.logs import in_time

#: The format's first line, and its codes of records: fixed values.
MAGIC = b"#ROSBAG V2.0\n"
MESSAGE, HEADER, INDEX, CHUNK, CHUNK_INFO, CONNECTION = 2, 3, 4, 5, 6, 7
#: Types of messages by their last name, and whether they name a child frame: fixed values.
FAMILIES = {"PoseStamped": False, "Odometry": True, "TransformStamped": True}
#: Digests by which other readers know the two types that are written: fixed values.
SUMS = {"geometry_msgs/PoseStamped": "d3812c3cbc69362b77dc0b19b345f8f5", "geometry_msgs/TransformStamped": "b5764a33bfeb3588febc2682852579b0"}
NUMBERS = ("x", "y", "z", "qx", "qy", "qz", "qw")
SECOND = 1_000_000_000
#: Rows of a batch, messages of a written chunk, and what opening a file counts for in bytes, as for Spark's own files.
ROWS, CHUNK_ROWS, OPENING = 8192, 4096, 4 << 20

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("lane", "topic", "type", "parent", "child")]
    + [T.StructField(c, T.LongType()) for c in ("stamp", "received", "chunk", "place")]
    + [T.StructField(c, T.DoubleType()) for c in NUMBERS]
)
ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[f.dataType.simpleString()]) for f in SCHEMA])


@dataclass(frozen=True)
class BagOptions:
    """How bags are read.

    timestamp: the header's stamp (``header``; a stamp of zero is missing), the time of receipt (``receive``), or the first where there is one (``auto``).
    split: bytes of a file for each task. The others are those of ``logs.CsvOptions``.
    """

    topic: str | None = None
    message_type: str | None = None
    timestamp: str = "auto"
    sort_time: bool = True
    order: str = "nondecreasing"
    normalize: bool = False
    invalid_time: str = "fail"  # or drop
    lane: str = "trial"
    split: int = 64 << 20


def read_bag_logs(spark: SparkSession, path: str | Sequence[str], options: BagOptions = BagOptions()) -> LaneFrame:
    """Lanes of poses, one for each bag, with whole nanoseconds since 1970 as the clock."""
    df = messages(spark, path, options)
    stamp = F.when(F.col("stamp") != 0, F.col("stamp"))
    sources: dict[str, Column] = {"auto": F.coalesce(stamp, F.col("received")), "header": stamp, "receive": F.col("received")}
    if options.timestamp not in sources:
        raise ValueError(f"timestamp is one of {sorted(sources)}")
    df = df.withColumn("time", sources[options.timestamp])
    bad = F.col("time").isNull()
    df = df.where(~bad) if options.invalid_time == "drop" else df.withColumn("time", F.when(bad, F.raise_error(F.lit("a time is missing")).cast("long")).otherwise(F.col("time")))
    pose = sp.pose(sp.vector(*(F.col(c) for c in NUMBERS[:3])), sp.quaternion(*(F.col(c) for c in NUMBERS[3:])))
    df = df.select(F.col("lane").alias(options.lane), "time", pose.alias("pose"), "received", "chunk", "place")
    by = ["received", "chunk", "place"]
    out = LaneFrame.of(df, [options.lane], "time", ["pose"], by) if options.sort_time else LaneFrame.of(df, [options.lane], None, ["time", "pose"], by).set_roles(clock="time", fields=("pose",))
    return in_time(out, options)


def messages(spark: SparkSession, path: str | Sequence[str], options: BagOptions = BagOptions()) -> DataFrame:
    """The pose messages of a topic, as they are."""
    spark.dataSource.register(Bags)
    asked = {"paths": json.dumps([path] if isinstance(path, str) else list(path)), "topic": options.topic, "type": options.message_type, "split": str(options.split)}
    return spark.read.format(Bags.name()).options(**{k: v for k, v in asked.items() if v is not None}).load()


def bag_frames(spark: SparkSession, path: str | Sequence[str], options: BagOptions = BagOptions()) -> DataFrame:
    """Lane, parent and child frame: null where a bag has none or names several."""
    return messages(spark, path, options).groupBy(F.col("lane").alias(options.lane)).agg(*_one_frame())


def bag_index(spark: SparkSession, path: str | Sequence[str], options: BagOptions = BagOptions()) -> DataFrame:
    """``bag_frames`` with the number of messages and their first and last time of receipt, from one reading of the bags."""
    told = [F.count("*").alias("messages"), F.min("received").alias("first"), F.max("received").alias("last")]
    return messages(spark, path, options).groupBy(F.col("lane").alias(options.lane)).agg(*_one_frame(), *told)


def _one_frame() -> list[Column]:
    return [F.when(F.min(c).eqNullSafe(F.max(c)) & (F.count(c) == F.count("*")), F.min(c)).alias(c) for c in ("parent", "child")]


def write_bag_logs(frame: LaneFrame, path: str, field: str = "pose", topic: str = "/pose", parent: str = "", child: str = "") -> None:
    """A plain bag for each lane, named after its key, in a new folder: PoseStamped, or TransformStamped with a child frame.

    The frame has one lane key, without nulls, and whole nanoseconds since 1970 as its clock, which become stamps and times of receipt. Missing numbers
    are NaN. A task writes lane after lane as a stream, under a hidden name until the bag is whole, so one that is repeated does no harm.
    """
    if len(frame.keys) != 1 or dict(frame.df.dtypes).get(frame.clock) != "bigint":
        raise RoleError("a bag needs one lane key and whole nanoseconds")
    files, at = _located(path)
    if files.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    spark = frame.df.sparkSession
    spark.dataSource.register(Bags)
    key, t = F.col(frame.keys[0]), F.col(frame.clock)
    bad = t.isNull() | (t < 0) | (t >= (1 << 32) * SECOND)
    lane = F.when(key.isNull(), F.raise_error(F.lit("a bag needs a lane's name")).cast("string")).otherwise(key.cast("string"))
    time = F.when(bad, F.raise_error(F.lit("a bag can't hold this time")).cast("long")).otherwise(t)
    parts = {"x": "p.x", "y": "p.y", "z": "p.z", "qx": "q.x", "qy": "q.y", "qz": "q.z", "qw": "q.w"}
    numbers = [F.coalesce(F.col(f"{field}.{c}").cast("double"), F.lit(float("nan"))).alias(n) for n, c in parts.items()]
    size = F.count(F.lit(1)).over(frame.lane)
    df = frame.df.select(lane.alias("lane"), frame.seq, time.alias("time"), size.alias("size"), *numbers)
    df = df.repartition("lane").sortWithinPartitions("lane", frame.seq).drop(frame.seq)
    df.write.format(Bags.name()).options(path=path, topic=topic, parent=parent, child=child).mode("append").save()


class Bags(DataSource):
    """``spark.read.format("wayline_bags")``, with options paths (JSON) or path, topic, type and split."""

    @classmethod
    def name(cls) -> str:
        return "wayline_bags"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return BagReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BagWriter(self.options)


@dataclass
class Part:
    """A range of a file's bytes."""

    lane: str
    path: str
    begin: int
    end: int
    size: int


@dataclass
class Parts(InputPartition):
    """Ranges that one task reads, one after the other."""

    held: list[Part]


class BagReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.topic, self.kind, self.split = options.get("topic"), options.get("type"), int(options.get("split", BagOptions.split))

    def partitions(self) -> Sequence[InputPartition]:
        """Ranges of files; short ones are put together in a task, where each file counts as OPENING bytes more."""
        found, seen, room = [], {}, 0
        for lane, home, path, size in (x for p in self.paths for x in _bags(p)):
            if seen.setdefault(lane, home) != home:
                raise RoleError(f"two bags are named {lane}")
            for a in range(0, size, self.split):
                part = Part(lane, path, a, min(a + self.split, size), size)
                cost = part.end - part.begin + OPENING
                if cost > room:
                    found.append(Parts([]))
                    room = self.split + OPENING
                found[-1].held.append(part)
                room -= cost
        return found

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        rows, columns = 0, [[] for _ in ARROW]
        for part in partition.held:
            for row in (self._sqlite if part.path.endswith(".db3") else self._chunked)(part):
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
                rows += 1
                if rows == ROWS:
                    yield _batch(columns)
                    rows, columns = 0, [[] for _ in ARROW]
        if rows:
            yield _batch(columns)

    def _chosen(self, path: str, known: Mapping[int, tuple[str, str]]) -> dict[int, tuple[str, str]]:
        """Numbers of the connections asked for, with topic and type; of one topic and one type, or else an error."""
        for what, at, asked in (("topic", 0, self.topic), ("type", 1, self.kind)):
            names = {x[at] for x in known.values()}
            if asked is not None and asked not in names:
                raise ValueError(f"no {what} {asked} in {path}, but {sorted(names)}")
            if asked is None and len(names) > 1:
                raise ValueError(f"{path} has more than one {what}, name one of {sorted(names)}")
            known = {k: x for k, x in known.items() if asked in (None, x[at])}
        for _, kind in known.values():
            if kind.rsplit("/", 1)[-1] not in FAMILIES:
                raise ValueError(f"messages of type {kind} have no pose")
        return dict(known)

    def _chunked(self, part: Part) -> Iterator[tuple]:
        files, at = _located(part.path)
        with files.open_input_file(at) as f:
            known, chunks = _index(f, part)
            wanted = self._chosen(part.path, {c: x for c, x in known.items() if any(c in held for _, held in chunks)}) if chunks else {}
            for position, held in chunks:
                if not part.begin <= position < part.end or not held & wanted.keys():
                    continue
                head, data = _record(f, position)
                for place, (said, body) in enumerate(_records(_plain(head, data))):
                    number = int.from_bytes(said.get("conn", b""), "little")
                    if said["op"][0] == MESSAGE and number in wanted:
                        topic, kind = wanted[number]
                        secs, nanos = struct.unpack("<II", said["time"])
                        yield part.lane, topic, kind, *_pose(kind, body, None), _whole(secs, nanos), position, place, *_numbers(kind, body, None)

    def _sqlite(self, part: Part) -> Iterator[tuple]:
        _, at = _located(part.path)
        db = sqlite3.connect(f"file:{quote(at)}?mode=ro", uri=True)
        try:
            known = {n: (topic, kind) for n, topic, kind in db.execute("SELECT id, name, type FROM topics t WHERE EXISTS (SELECT 1 FROM messages m WHERE m.topic_id = t.id)")}
            if not known:
                return
            wanted = self._chosen(part.path, known)
            low, high = db.execute("SELECT min(id), max(id) FROM messages").fetchone()
            span = high - low + 1
            bounds = [low + -(-span * x // part.size) for x in (part.begin, part.end)]
            for place, number, received, body in db.execute("SELECT id, topic_id, timestamp, data FROM messages WHERE id >= ? AND id < ? ORDER BY id", bounds):
                if number in wanted:
                    topic, kind = wanted[number]
                    order = {0: ">", 1: "<"}.get(body[1])
                    if order is None:
                        raise ValueError(f"a message in {part.path} is not plain CDR")
                    yield part.lane, topic, kind, *_pose(kind, body, order), received, 0, place, *_numbers(kind, body, order)
        finally:
            db.close()


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def _located(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[a-z][a-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), os.path.abspath(path)


def _bags(path: str) -> Iterator[tuple[str, str, str, int]]:
    """(lane, what the lane is kept in, file, bytes) of a bag, or of all in a folder, but for hidden files; SQLite files are their folder's lane."""
    files, at = _located(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    scheme = path[: path.index(":/") + 1] if re.match(r"[a-z][a-z0-9+.-]*:/", path) and not path.startswith("file:") else ""
    for x in sorted([info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda x: x.path):
        if x.type != fs.FileType.File or x.extension not in ("bag", "db3") or re.search(r"/[._][^/]*$", x.path):
            continue
        home = os.path.dirname(x.path) if x.extension == "db3" else x.path
        name = os.path.basename(home)
        yield unquote(name if x.extension == "db3" else name[:-4]), home, f"{scheme}//{x.path}" if scheme else x.path, x.size


def _fields(header: bytes) -> dict[str, bytes]:
    found, at = {}, 0
    while at < len(header):
        n = int.from_bytes(header[at : at + 4], "little")
        name, _, value = header[at + 4 : at + 4 + n].partition(b"=")
        found[name.decode()] = value
        at += 4 + n
    return found


def _record(f: pa.NativeFile, at: int) -> tuple[dict[str, bytes], bytes]:
    """A record's header and data."""
    f.seek(at)
    held = []
    for _ in range(2):
        n = int.from_bytes(f.read(4), "little")
        held.append(f.read(n))
        if len(held[-1]) < n:
            raise ValueError("a bag's record breaks off")
    return _fields(held[0]), held[1]


def _records(data: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    at = 0
    while at < len(data):
        held = []
        for _ in range(2):
            n = int.from_bytes(data[at : at + 4], "little")
            held.append(data[at + 4 : at + 4 + n])
            if len(held[-1]) < n:
                raise ValueError("a bag's record breaks off")
            at += 4 + n
        yield _fields(held[0]), held[1]


def _index(f: pa.NativeFile, part: Part) -> tuple[dict[int, tuple[str, str]], list[tuple[int, set[int]]]]:
    """Connections (topic, type) by number, and the place and connections of each chunk with messages."""
    if f.read(len(MAGIC)) != MAGIC:
        raise ValueError(f"{part.path} is no bag of format 2.0")
    at = int.from_bytes(_record(f, len(MAGIC))[0]["index_pos"], "little")
    if not at:
        raise ValueError(f"{part.path} was not closed, so it has no index")
    f.seek(at)
    known, chunks = {}, []
    for said, body in _records(f.read()):
        if said["op"][0] == CONNECTION:
            known[int.from_bytes(said["conn"], "little")] = (said["topic"].decode(), _fields(body)["type"].decode())
        elif said["op"][0] == CHUNK_INFO:
            counts = struct.iter_unpack("<II", body)
            chunks.append((int.from_bytes(said["chunk_pos"], "little"), {c for c, n in counts if n}))
    return known, chunks


def _plain(head: Mapping[str, bytes], data: bytes) -> bytes:
    kind = head["compression"].decode()
    if kind == "none":
        return data
    if kind == "bz2":
        return bz2.decompress(data)
    if kind == "lz4":
        return pa.decompress(data, decompressed_size=int.from_bytes(head["size"], "little"), codec="lz4", asbytes=True)
    raise ValueError(f"chunks packed by {kind} can't be read")


def _whole(secs: int, nanos: int) -> int:
    if not 0 <= nanos < SECOND:
        raise ValueError("nanoseconds of a time are a second or more")
    return secs * SECOND + nanos


def _text(body: bytes, at: int, order: str | None) -> tuple[str, int]:
    """A text and where it ends; CDR aligns its length and counts a closing zero."""
    at = at if order is None else 4 + -(-(at - 4) // 4) * 4
    (n,) = struct.unpack_from(f"{order or '<'}I", body, at)
    text = body[at + 4 : at + 4 + n]
    return (text if order is None else text[:-1]).decode(), at + 4 + n


def _opened(kind: str, body: bytes, order: str | None) -> tuple[str, str | None, int, int]:
    """Parent, child, stamp and where the numbers begin; order: None for messages without CDR."""
    secs, nanos = struct.unpack_from("<II", body, 4) if order is None else struct.unpack_from(f"{order}iI", body, 4)
    parent, at = _text(body, 12, order)
    child = None
    if FAMILIES[kind.rsplit("/", 1)[-1]]:
        child, at = _text(body, at, order)
    return parent, child, _whole(secs, nanos), at if order is None else 4 + -(-(at - 4) // 8) * 8


def _pose(kind: str, body: bytes, order: str | None) -> tuple[str | None, str | None, int]:
    parent, child, stamp, _ = _opened(kind, body, order)
    return parent or None, child or None, stamp


def _numbers(kind: str, body: bytes, order: str | None) -> tuple[float, ...]:
    return struct.unpack_from(f"{order or '<'}7d", body, _opened(kind, body, order)[3])


# writing


def _made(data: bytes, **fields: bytes) -> bytes:
    header = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(header)) + header + struct.pack("<I", len(data)) + data


def _u32(x: int) -> bytes:
    return struct.pack("<I", x)


class _Form:
    """What bags of one topic and type have in common; all their messages have one length, so every place follows from the number of messages."""

    def __init__(self, topic: str, parent: str, child: str) -> None:
        kind = "geometry_msgs/TransformStamped" if child else "geometry_msgs/PoseStamped"
        self.text = _u32(len(parent.encode())) + parent.encode() + (_u32(len(child.encode())) + child.encode() if child else b"")
        told = {"topic": topic.encode(), "type": kind.encode(), "md5sum": SUMS[kind].encode(), "message_definition": b""}
        about = b"".join(_u32(len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in told.items())
        self.connection = _made(about, op=bytes([CONNECTION]), conn=_u32(0), topic=topic.encode())
        self.blank = _made(bytes(12) + self.text + bytes(56), op=bytes([MESSAGE]), conn=_u32(0), time=bytes(8))
        body = len(self.blank) - 68 - len(self.text)
        self.time, self.stamp, self.numbers = self.blank.index(b"time=") + 5, body + 4, len(self.blank) - 56

    def begin(self, n: int) -> bytes:
        """The first line and the header of a bag of n messages."""
        full, rest = divmod(n, CHUNK_ROWS)
        at = len(MAGIC) + 4096 + full * self.length(CHUNK_ROWS) + (self.length(rest) if rest else 0)
        header = _made(b"", index_pos=struct.pack("<Q", at), conn_count=_u32(1), chunk_count=_u32(full + bool(rest)), op=bytes([HEADER]))
        pad = 4096 - len(header)
        return MAGIC + header[:-4] + _u32(pad) + b" " * pad

    def length(self, n: int) -> int:
        return len(self.chunk(np.zeros(1, "i8"), np.zeros((1, 7)))) + (n - 1) * (len(self.blank) + 12)

    def chunk(self, times: np.ndarray, numbers: np.ndarray) -> bytes:
        n = len(times)
        rows = np.tile(np.frombuffer(self.blank, "u1"), (n, 1))
        pair = np.stack([times // SECOND, times % SECOND], axis=1).astype("<u4")
        for at in (self.time, self.stamp):
            rows[:, at : at + 8] = pair.view("u1").reshape(n, 8)
        rows[:, self.numbers :] = np.ascontiguousarray(numbers, "<f8").view("u1").reshape(n, 56)
        data = self.connection + rows.tobytes()
        places = len(self.connection) + np.arange(n, dtype="<u4")[:, None] * len(self.blank)
        index = np.concatenate([pair, places.astype("<u4")], axis=1).tobytes()
        return _made(data, op=bytes([CHUNK]), compression=b"none", size=_u32(len(data))) + _made(index, op=bytes([INDEX]), ver=_u32(1), conn=_u32(0), count=_u32(n))

    def end(self, chunks: list[tuple[int, int, int, int]]) -> bytes:
        """The index: place, first and last time and messages of each chunk."""
        pair = lambda t: struct.pack("<II", t // SECOND, t % SECOND)
        infos = [_made(_u32(0) + _u32(n), op=bytes([CHUNK_INFO]), ver=_u32(1), chunk_pos=struct.pack("<Q", at), start_time=pair(a), end_time=pair(b), count=_u32(1)) for at, a, b, n in chunks]
        return self.connection + b"".join(infos)


class BagWriter(DataSourceArrowWriter):
    def __init__(self, options: Mapping[str, str]) -> None:
        self.path, self.named = options["path"], (options["topic"], options.get("parent", ""), options.get("child", ""))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        form, (files, at) = _Form(*self.named), _located(self.path)
        files.create_dir(at, recursive=True)
        lane, sink, told, held, total = None, None, [], [], 0

        def flush(least: int) -> None:
            nonlocal held
            rows = sum(len(t) for t, _ in held)
            if rows < least or not rows:
                return
            times, numbers = (np.concatenate(x) for x in zip(*held, strict=True))
            while len(times) >= least and len(times):
                t, v = times[:CHUNK_ROWS], numbers[:CHUNK_ROWS]
                told.append((sink.tell(), int(t.min()), int(t.max()), len(t)))
                sink.write(form.chunk(t, v))
                times, numbers = times[CHUNK_ROWS:], numbers[CHUNK_ROWS:]
            held = [(times, numbers)]

        def close() -> None:
            if sink is None:
                return
            flush(1)
            if sum(n for *_, n in told) != total:
                raise RuntimeError(f"lane {lane} has not the {total} samples that were counted")
            sink.write(form.end(told))
            sink.close()
            files.move(hidden, f"{at}/{quote(lane, safe='')}.bag")

        for batch in iterator:
            lanes = batch.column("lane")
            starts = [0, *(np.flatnonzero(np.array(lanes[1:].to_pylist(), object) != np.array(lanes[:-1].to_pylist(), object)) + 1).tolist(), len(lanes)] if len(lanes) else [0]
            times = batch.column("time").to_numpy()
            numbers = np.stack([batch.column(c).to_numpy() for c in NUMBERS], axis=1) if len(lanes) else np.zeros((0, 7))
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if lanes[a].as_py() != lane:
                    close()
                    lane, total, told, held = lanes[a].as_py(), batch.column("size")[a].as_py(), [], []
                    hidden = f"{at}/.{uuid.uuid4().hex}"
                    sink = files.open_output_stream(hidden)
                    sink.write(form.begin(total))
                held.append((times[a:b], numbers[a:b]))
                flush(CHUNK_ROWS)
        close()
        return WriterCommitMessage()
