"""Bags made here byte by byte, and bags written and read again."""

import bz2
import os
import sqlite3
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayline.frame import LaneFrame, RoleError
from wayline.functions import spatial as sp
from wayline.sources import bags
from wayline.sources.bags import BagOptions

S = 1_000_000_000


def u32(x):
    return struct.pack("<I", x)


def record(data, **fields):
    header = b"".join(u32(len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return u32(len(header)) + header + u32(len(data)) + data


def connection(number, topic, kind):
    told = b"".join(u32(len(x)) + x for x in (b"topic=" + topic, b"type=" + kind, b"md5sum=*", b"message_definition="))
    return record(told, op=b"\x07", conn=u32(number), topic=topic)


def message(number, received, body):
    return record(body, op=b"\x02", conn=u32(number), time=struct.pack("<II", *divmod(received, S)))


def plain(stamp, parent, child, numbers):
    """A message without CDR; Odometry's further numbers follow those of the pose."""
    body = u32(7) + struct.pack("<II", *divmod(stamp, S)) + u32(len(parent)) + parent
    return body + (u32(len(child)) + child if child is not None else b"") + struct.pack("<7d", *numbers) + bytes(8 * 36)


def bag(path, connections, chunks, closed=True):
    """chunks: (packing, [(connection, received, body)])."""
    known = b"".join(connection(n, t, k) for n, (t, k) in connections.items())
    body, infos = b"", b""
    for packing, held in chunks:
        data = known + b"".join(message(*m) for m in held)
        packed = {"none": bytes, "bz2": bz2.compress, "lz4": lambda d: pa.compress(d, codec="lz4", asbytes=True)}[packing](data)
        counts = b"".join(u32(n) + u32(sum(m[0] == n for m in held)) for n in connections)
        infos += record(counts, op=b"\x06", ver=u32(1), chunk_pos=struct.pack("<Q", 13 + 4096 + len(body)), start_time=bytes(8), end_time=bytes(8), count=u32(len(connections)))
        body += record(packed, op=b"\x05", compression=packing.encode(), size=u32(len(data))) + record(bytes(12), op=b"\x04", ver=u32(1), conn=u32(0), count=u32(1))
    at = 13 + 4096 + len(body) if closed else 0
    head = record(b"", op=b"\x03", index_pos=struct.pack("<Q", at), conn_count=u32(len(connections)), chunk_count=u32(len(chunks)))
    pad = 4096 - len(head)
    with open(path, "wb") as f:
        f.write(b"#ROSBAG V2.0\n" + head[:-4] + u32(pad) + b" " * pad + body + known + infos)


def numbers(i):
    return (i + 0.5, -i, 2.0 * i, 0.0, 0.0, 0.6, 0.8)


TWO = {0: (b"/odom", b"nav_msgs/Odometry"), 3: (b"/arm", b"geometry_msgs/PoseStamped")}


@pytest.fixture
def recorded(tmp_path):
    """Forty messages of either topic in chunks of three packings; stamps run half a second behind receipts; /arm has no stamps."""
    held = [[(0, (100 + i) * S + 7, plain((100 + i) * S - S // 2, b"map", b"base", numbers(i))), (3, (100 + i) * S, plain(0, b"", None, numbers(-i)))] for i in range(40)]
    chunks = [(("none", "bz2", "lz4")[k % 3], sum(held[4 * k : 4 * k + 4], [])) for k in range(10)]
    bag(tmp_path / "one.bag", TWO, chunks)
    return tmp_path


def rows(frame):
    return [(r.trial, r.seq, r.time, r.pose.p.x, r.pose.q.w) for r in frame.df.orderBy("trial", "seq").collect()]


@pytest.mark.parametrize("split", [64 << 20, 1000])
def test_chunks_of_every_packing(spark, recorded, split):
    got = bags.read_bag_logs(spark, str(recorded), BagOptions(topic="/odom", split=split))
    assert rows(got) == [("one", i, (100 + i) * S - S // 2, i + 0.5, 0.8) for i in range(40)]
    found = bags.bag_frames(spark, str(recorded / "one.bag"), BagOptions(topic="/odom", split=split)).collect()
    assert [tuple(r) for r in found] == [("one", "map", "base")]


def test_sources_of_time(spark, recorded):
    at = str(recorded)
    assert rows(bags.read_bag_logs(spark, at, BagOptions(topic="/odom", timestamp="receive")))[1][2] == 101 * S + 7
    assert rows(bags.read_bag_logs(spark, at, BagOptions(topic="/arm")))[39] == ("one", 39, 139 * S, -38.5, 0.8)
    assert rows(bags.read_bag_logs(spark, at, BagOptions(topic="/arm", timestamp="header", invalid_time="drop"))) == []
    with pytest.raises(Exception, match="a time is missing"):
        rows(bags.read_bag_logs(spark, at, BagOptions(topic="/arm", timestamp="header")))
    assert [tuple(r) for r in bags.bag_frames(spark, at, BagOptions(topic="/arm")).collect()] == [("one", None, None)]


def test_topics_and_types_must_be_told_apart(spark, recorded):
    for options, words in ((BagOptions(), "more than one topic"), (BagOptions(topic="/none"), "no topic /none"), (BagOptions(topic="/arm", message_type="a/B"), "no type a/B")):
        with pytest.raises(Exception, match=words):
            rows(bags.read_bag_logs(spark, str(recorded), options))
    bag(recorded / "other.bag", {0: (b"/scan", b"sensor_msgs/LaserScan")}, [("none", [(0, S, b"")])])
    with pytest.raises(Exception, match="have no pose"):
        rows(bags.read_bag_logs(spark, str(recorded / "other.bag")))


def test_orders_of_time(spark, tmp_path):
    stamps = [3, 1, 2, 2]
    bag(tmp_path / "b.bag", {0: TWO[3]}, [("none", [(0, (10 + i) * S, plain(t * S, b"map", None, numbers(i))) for i, t in enumerate(stamps)])])
    got = rows(bags.read_bag_logs(spark, str(tmp_path)))
    assert [(r[2] // S, r[3]) for r in got] == [(1, 1.5), (2, 2.5), (2, 3.5), (3, 0.5)]
    kept = rows(bags.read_bag_logs(spark, str(tmp_path), BagOptions(order="increasing", normalize=True)))
    assert [(r[1], r[2] // S, r[3]) for r in kept] == [(0, 1, 1.5), (1, 2, 2.5), (2, 3, 0.5)]
    assert [r[2] // S for r in rows(bags.read_bag_logs(spark, str(tmp_path), BagOptions(sort_time=False, order="any")))] == stamps
    for options in (BagOptions(sort_time=False), BagOptions(order="increasing")):
        with pytest.raises(Exception, match="times are not"):
            rows(bags.read_bag_logs(spark, str(tmp_path), options))


def test_empty_open_and_broken_bags(spark, tmp_path):
    bag(tmp_path / "none.bag", {0: TWO[3]}, [])
    assert rows(bags.read_bag_logs(spark, str(tmp_path / "none.bag"))) == []
    bag(tmp_path / "open.bag", {0: TWO[3]}, [], closed=False)
    with pytest.raises(Exception, match="was not closed"):
        rows(bags.read_bag_logs(spark, str(tmp_path / "open.bag")))
    (tmp_path / "text.bag").write_bytes(b"time,x\n1,2\n")
    with pytest.raises(Exception, match="no bag of format"):
        rows(bags.read_bag_logs(spark, str(tmp_path / "text.bag")))
    with pytest.raises(Exception, match="none_here"):
        rows(bags.read_bag_logs(spark, str(tmp_path / "none_here")))
    os.makedirs(tmp_path / "more")
    bag(tmp_path / "more" / "none.bag", {0: TWO[3]}, [])
    with pytest.raises(Exception, match="two bags are named none"):
        rows(bags.read_bag_logs(spark, [str(tmp_path / "none.bag"), str(tmp_path / "more")]))


def cdr(stamp, parent, child, values, order):
    body = bytes([0, order == "<", 0, 0]) + struct.pack(f"{order}iI", *divmod(stamp, S))
    for text in (parent, child):
        if text is not None:
            body += bytes(-(len(body) - 4) % 4) + struct.pack(f"{order}I", len(text) + 1) + text + b"\0"
    return body + bytes(-(len(body) - 4) % 8) + struct.pack(f"{order}7d", *values)


@pytest.mark.parametrize("parent, child", [(b"map", b"base_link"), (b"a", b"bcd"), (b"", b"")])
@pytest.mark.parametrize("split", [64 << 20, 700])
def test_sqlite_bags(spark, tmp_path, parent, child, split):
    home = tmp_path / "run 1"
    os.makedirs(home)
    for part in range(2):
        db = sqlite3.connect(home / f"run_{part}.db3")
        db.execute("CREATE TABLE topics (id INTEGER PRIMARY KEY, name TEXT, type TEXT, serialization_format TEXT)")
        db.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, topic_id INTEGER, timestamp INTEGER, data BLOB)")
        db.executemany("INSERT INTO topics VALUES (?, ?, ?, 'cdr')", [(1, "/tf", "geometry_msgs/msg/TransformStamped"), (2, "/idle", "std_msgs/msg/String")])
        made = [(5 + i, 1, (part * 10 + i) * S, cdr((part * 10 + i) * S + 1, parent, child, numbers(part * 10 + i), "<>"[i % 2])) for i in range(10)]
        db.executemany("INSERT INTO messages VALUES (?, ?, ?, ?)", made)
        db.commit()
        db.close()
    got = bags.read_bag_logs(spark, str(home), BagOptions(split=split))
    assert rows(got) == [("run 1", i, i * S + 1, i + 0.5, 0.8) for i in range(20)]
    assert [tuple(r) for r in bags.bag_frames(spark, str(home)).collect()] == [("run 1", parent.decode() or None, child.decode() or None)]


@pytest.mark.parametrize("child", ["", "tool"])
def test_written_bags_come_back(spark, tmp_path, child):
    sizes = {"a/b": 1, "c d": bags.CHUNK_ROWS, "é": bags.CHUNK_ROWS * 2 + 3}
    df = spark.createDataFrame(list(sizes.items()), "trial string, n long").select("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("seq"))
    x = F.when(F.col("seq") % 5 != 4, F.col("seq").cast("double"))
    pose = sp.pose(sp.vector(x, F.lit(1.0), F.lit(-2.5)), sp.quaternion(*(F.lit(v) for v in (0.0, 0.0, 0.6, 0.8))))
    f = LaneFrame.of(df.withColumns({"time": F.col("seq") * 3 + S, "pose": pose}), ["trial"], "time", ["pose"])
    at = str(tmp_path / "out")
    bags.write_bag_logs(f, at, parent="map", child=child)
    assert sorted(os.listdir(at)) == ["%C3%A9.bag", "a%2Fb.bag", "c%20d.bag"]
    got = bags.read_bag_logs(spark, at, BagOptions(split=100_000)).df
    assert got.groupBy("trial").count().rdd.collectAsMap() == sizes
    back = f.df.join(got, ["trial", "seq"])
    same = (f.df["time"] == got["time"]) & (F.coalesce(f.df["pose.p.x"], F.lit(float("nan"))) == got["pose.p.x"]) & (got["pose.p.z"] == -2.5) & (got["pose.q.w"] == 0.8)
    assert back.where(same).count() == sum(sizes.values())
    found = {tuple(r)[1:] for r in bags.bag_frames(spark, at).collect()}
    assert found == {("map", child or None)}
    with pytest.raises(FileExistsError):
        bags.write_bag_logs(f, at)
    with pytest.raises(RoleError):
        bags.write_bag_logs(f.over(f.df.withColumn("time", F.col("time").cast("double"))), at + "2")


def test_short_bags_share_tasks_and_long_ones_are_cut(tmp_path):
    for i in range(40):
        bag(tmp_path / f"{i:02}.bag", {0: TWO[3]}, [])
    tasks = bags.BagReader({"path": str(tmp_path)}).partitions()
    assert len(tasks) == 3 and sorted(p.lane for t in tasks for p in t.held) == [f"{i:02}" for i in range(40)]
    cut = bags.BagReader({"path": str(tmp_path / "00.bag"), "split": "1000"}).partitions()
    size = os.path.getsize(tmp_path / "00.bag")
    assert [(p.begin, p.end) for t in cut for p in t.held] == [(a, min(a + 1000, size)) for a in range(0, size, 1000)] and all(len(t.held) == 1 for t in cut)


def test_the_index_reads_the_bags_once(spark):
    from wayline.plans import catalog

    plan = catalog.QUERIES["bag_index"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RelationV2") == 1 and "Join" not in plan
