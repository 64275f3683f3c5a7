"""Rules of the lane operators on small hand-made lanes."""

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayline.frame import LaneFrame, RoleError
from wayline.functions import geo, motion, numeric, vectors
from wayline.functions import spatial as sp
from wayline.operators import asof, combine, events, frames, kinematics, places
from wayline.operators import reduce as rd
from wayline.sources import logs
from wayline.streaming import live


def frame(spark, rows, fields=("v",)):
    df = spark.createDataFrame(rows, "k string, t double, " + ", ".join(f"{f} double" for f in fields))
    return LaneFrame.of(df, ["k"], "t", list(fields))


@pytest.fixture(scope="module")
def ramp(spark):
    return frame(spark, [("a", 0.0, 0.0), ("a", 1.0, 10.0), ("a", 2.0, None), ("a", 3.0, 30.0), ("b", 0.0, 5.0)])


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def queries(spark, *ts, k="a"):
    return spark.createDataFrame([(k, t) for t in ts], "k string, q double")


def test_linear_rules(spark, ramp):
    got = dict(values(asof.at(ramp, queries(spark, -1.0, 0.0, 0.5, 1.0, 1.5, 3.0, 4.0, None), "q"), "q", "v"))
    assert got == {-1.0: None, 0.0: 0.0, 0.5: 5.0, 1.0: 10.0, 1.5: None, 3.0: 30.0, 4.0: None, None: None}


def test_exact_inner_sample_with_missing_left_neighbour_is_missing(spark):
    f = frame(spark, [("a", 0.0, 1.0), ("a", 1.0, None), ("a", 2.0, 3.0), ("a", 3.0, 4.0)])
    assert values(asof.at(f, queries(spark, 2.0), "q"), "v") == [(None,)]


def test_nearest_clamps_and_ties_go_left(spark, ramp):
    got = dict(values(asof.index(ramp, queries(spark, -5.0, 0.5, 0.6, 9.0), "q"), "q", "sample_index"))
    assert got == {-5.0: 0, 0.5: 0, 0.6: 1, 9.0: 3}


def test_duplicate_policies(spark):
    f = frame(spark, [("a", 0.0, 0.0), ("a", 1.0, 1.0), ("a", 1.0, 2.0), ("a", 2.0, 3.0)])
    q = queries(spark, 1.0)
    assert [values(asof.at(f, q, "q", duplicates=p), "v")[0][0] for p in ("invalid", "left", "right")] == [None, 1.0, 2.0]
    with pytest.raises(PySparkException):
        asof.at(f, q, "q", duplicates="raise").collect()


def test_tolerance_thins_the_common_clock(spark):
    a, b = frame(spark, [("a", 0.0, 1.0), ("a", 1.0, 1.0)]), frame(spark, [("a", 0.05, 1.0), ("a", 2.0, 1.0)])
    assert sorted(t for (t,) in values(asof.join_clocks([a, b], "outer", 0.1), "t")) == [0.0, 1.0, 2.0]
    assert [t for (t,) in values(asof.join_clocks([a, b], "inner", 0.1), "t")] == [0.0]
    with pytest.raises(PySparkException):
        asof.join_clocks([a, b], "exact").collect()


def test_nan_becomes_missing_and_padding_goes(spark):
    df = spark.createDataFrame([("a", 0, float("nan"), 1), ("a", 1, 2.0, 1)], "k string, seq long, v double, size int")
    assert values(LaneFrame.of(df, ["k"], None, ["v"], size="size").df, "seq", "v") == [(0, None)]


def test_roles_are_checked(spark, ramp):
    with pytest.raises(RoleError):
        LaneFrame(ramp.df, ("k",), "seq", "t", ("nothing",))
    with pytest.raises(RoleError):
        ramp.define_components(x=["v"], y=["v"])
    assert ramp.validate() == []
    assert LaneFrame.from_json(ramp.df, ramp.to_json()).fields == ("v",)


@pytest.mark.parametrize("at", [slice(None, None, 2), slice(-2, None), slice(None, None, -1), slice(1, 3), slice(3, 0, -2), [2, -1, 0], -1])
def test_isel_like_numpy(spark, at):
    f = frame(spark, [("a", float(i), float(i)) for i in range(5)])
    got = [v for (v,) in values(f.isel(at).df.orderBy("seq"), "v")]
    assert got == np.atleast_1d(np.arange(5.0)[at]).tolist()


def test_initial_island_and_last_exit(spark):
    f = frame(spark, [("a", float(i), v) for i, v in enumerate([9.0, 0.0, 9.0, 9.0])])
    on = F.col("v") > 5
    assert values(events.events(f, on), "time", "edge_code", "sample_index_after") == [(0.0, 2, 1), (2.0, 1, 2), (3.0, 2, -1)]
    assert values(events.intervals(f, on), "start_time", "end_time") == [(2.0, 3.0)]
    assert len(events.intervals(f, on, include_initial=True).collect()) == 2


def test_tau_grid_has_zero():
    assert events.tau_grid(0.5, 0.5, 0.5) == [-0.5, 0.0, 0.5]
    assert events.tau_grid(0.3, 0.5, 0.4) == pytest.approx([-0.3, 0.0, 0.1, 0.5])


def test_reducers_of_nothing_and_weights(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("b", 2.0, 1.0), ("b", 4.0, 3.0)], "k string, v double, w double")
    got = {op: dict(values(rd.reduce_by(df, ["k"], op, ["v"]), "k", "v")) for op in rd.REDUCERS}
    assert (got["sum"]["a"], got["mean"]["a"], got["count"]["a"], got["any"]["a"]) == (0.0, None, 0, True)
    assert got["var"]["b"] == 1.0
    assert dict(values(rd.reduce_by(df, ["k"], "mean", ["v"], weight=F.col("w")), "k", "v"))["b"] == 3.5
    with pytest.raises(PySparkException):
        rd.reduce_by(df, ["k"], "sum", ["v"], weight=-F.col("w")).collect()


def test_overlap_and_conflicts_are_errors(spark):
    a, b = frame(spark, [("a", 0.0, 1.0), ("a", 2.0, 1.0)]), frame(spark, [("a", 1.0, 2.0), ("a", 3.0, 2.0)])
    with pytest.raises(PySparkException):
        combine.concat_sequence([a, b]).df.collect()
    assert [v for (v,) in values(combine.concat_sequence([a, b], "sort").df.orderBy("seq"), "v")] == [1.0, 2.0, 1.0, 2.0]
    with pytest.raises(PySparkException):
        combine.merge(a, b).df.collect()


def test_kinematics_against_numpy(spark):
    t = np.array([0.0, 0.5, 1.5, 2.0, 3.5])
    f = frame(spark, [("a", float(x), float(x) ** 2) for x in t])
    v = t**2
    slope = np.diff(v) / np.diff(t)
    assert [x for (x,) in values(kinematics.differentiate(f).df.orderBy("seq"), "v")] == pytest.approx([slope[0], *slope])
    area = np.concatenate([[0], np.cumsum(0.5 * (v[1:] + v[:-1]) * np.diff(t))])
    assert [x for (x,) in values(kinematics.integrate(f).df.orderBy("seq"), "v")] == pytest.approx(area)
    assert [x for (x,) in values(kinematics.integrate(f, "cumulative_simpson").df.orderBy("seq"), "v")] == pytest.approx(t**3 / 3)
    assert [x for (x,) in values(kinematics.smooth(f, "local_polynomial").df.orderBy("seq"), "v")] == pytest.approx(v)
    assert [x for (x,) in values(kinematics.differentiate(f, "local_polynomial").df.orderBy("seq"), "v")] == pytest.approx(2 * t)


def test_numpy_division(spark):
    n, d = F.col("n"), F.col("d")
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (7.0, -3.0)], "n double, d double")
    assert values(df.select(numeric.divide(n, d).alias("x")), "x")[:2] == [(math.inf,), (-math.inf,)]
    assert values(df.where("d <> 0").select(numeric.mod(n, d).alias("m"), numeric.floor_divide(n, d).alias("f")), "m", "f") == [(-2.0, -3.0)]


def test_quaternions_and_frames(spark):
    df = spark.createDataFrame([(0.7,)], "a double").withColumn("q", sp.axis_angle(sp.vector(F.lit(0.0), F.lit(0.6), F.lit(0.8)), F.col("a")))
    back = df.select(sp.from_matrix(sp.to_matrix(F.col("q"))).alias("b"), "q").first()
    assert list(back.b) == pytest.approx(list(back.q))
    there = sp.pose(sp.vector(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.col("q"))
    none = df.select(sp.pose_compose(there, sp.pose_inverse(there)).alias("p")).first().p
    assert [*none.p, *none.q] == pytest.approx([0, 0, 0, 0, 0, 0, 1], abs=1e-12)
    same = df.select(sp.pose_from_matrix(sp.pose_matrix(there)).alias("p")).first().p
    assert list(same.p) == pytest.approx([1, 2, 3])
    g = frames.FrameGraph()
    g.bind("world", "ship", there)
    g.bind("ship", "cam", there)
    assert [s.inverted for s in g.path("cam", "world")] == [False, False]
    assert [s.inverted for s in g.path("world", "cam")] == [True, True]
    with pytest.raises(ValueError):
        g.add("world", "cam")


def test_interpolated_pose(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 2.0)], "k string, t double")
    f = LaneFrame.of(df.withColumn("pose", sp.pose(sp.vector(F.col("t"), F.lit(0.0), F.lit(0.0)), sp.yaw(F.col("t")))), ["k"], "t", ["pose"])
    got = frames.interpolated_poses(f, "pose", queries(spark, 1.0, 3.0), "q", "p").orderBy("q").collect()
    assert list(got[0].p.p) == pytest.approx([1, 0, 0]) and got[0].p.q.z == pytest.approx(math.sin(0.5)) and got[1].p is None


def test_solvers(spark):
    df = spark.createDataFrame([([[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0])], "m array<array<double>>, v array<double>")
    row = df.select(vectors.solve("m", "v").alias("s"), vectors.inv("m").alias("i"), vectors.inv_small(F.col("m"), 2).alias("j"), vectors.pinv(F.col("m")).alias("p"), vectors.matmul(F.col("m"), F.col("m")).alias("mm")).first()
    m = np.array([[2.0, 1.0], [1.0, 3.0]])
    assert row.s == pytest.approx(np.linalg.solve(m, [3, 5]))
    assert np.allclose(row.i, np.linalg.inv(m)) and np.allclose(row.j, row.i) and np.allclose(row.p, row.i) and np.allclose(row.mm, m @ m)


def test_geodesic_quarter(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0)], "a double, b double, c double, d double")
    got = df.select(geo.geodesic("a", "b", "c", "d").alias("g")).first().g
    assert got.distance == pytest.approx(math.pi / 2 * geo.SEMI_MAJOR, rel=1e-9) and got.initial_bearing == pytest.approx(90)


def test_csv_and_snapshot_round_trip(spark, tmp_path, ramp):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/run1.csv").write_text("time,speed\n1.0,2.0\n0.0,1.0\n")
    (tmp_path / "in/run2.csv").write_text("time,speed\n0.0,7.0\n")
    f = logs.read_csv_logs(spark, str(tmp_path / "in"))
    assert sorted(values(f.df, "trial", "seq", "time", "speed")) == [("run1", 0, 0.0, 1.0), ("run1", 1, 1.0, 2.0), ("run2", 0, 0.0, 7.0)]
    logs.write_csv_logs(f, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("trial=*")} == {"trial=run1", "trial=run2"}
    logs.save(ramp, str(tmp_path / "snap"))
    again = logs.load(spark, str(tmp_path / "snap"))
    assert again.fields == ramp.fields and again.df.count() == 5
    with pytest.raises(PySparkException):
        logs.save(ramp, str(tmp_path / "snap"))


def test_live_intervals(spark, tmp_path):
    src = str(tmp_path / "s")
    rows = [("a", 0.0, 9.0), ("a", 1.0, 9.0), ("a", 2.0, 0.0), ("a", 3.0, 9.0)]
    spark.createDataFrame(rows, "k string, t double, v double").coalesce(1).write.parquet(src)
    stream = live.live_intervals(live.read_samples(spark, src, "k string, t double, v double"), "k", "t", F.col("v") > 5)
    q = stream.writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert values(spark.table("live"), "key", "start_time", "end_time") == [("a", 0.0, 1.0)]


def test_a_clock_that_goes_back_is_an_error(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 2.0, 2.0), ("a", 2, 1.0, 3.0)], "k string, seq long, t double, v double")
    back = LaneFrame(df, ("k",), "seq", "t", ("v",))
    for out in (asof.at(back, queries(spark, 0.5), "q"), asof.index(back, queries(spark, 0.5), "q"), asof.select_range(back, 0.0, 5.0).df, asof.synchronized([back, back.rename(v="w")], join="outer").df):
        with pytest.raises(PySparkException, match="goes back"):
            out.collect()
    again = LaneFrame(df.withColumn("t", F.least("t", F.lit(1.0))), ("k",), "seq", "t", ("v",))
    assert asof.at(again, queries(spark, 0.5), "q").count() == 1


def test_nan_made_later_is_missing_too(spark, ramp):
    f = ramp.with_fields(w=F.when(F.col("v") > 0, F.lit(float("nan"))).otherwise(F.col("v")))
    assert f.df.where(F.isnan("w")).count() == 0
    assert f.map_fields(lambda x: x / F.lit(float("nan"))).df.where("v IS NOT NULL").count() == 0
    raw = spark.createDataFrame([("a", float("nan")), ("a", 2.0), ("b", float("nan"))], "k string, v double")
    got = {op: dict(values(rd.reduce_by(raw, ["k"], op, ["v"]), "k", "v")) for op in ("mean", "max", "count", "sum")}
    assert got == {"mean": {"a": 2.0, "b": None}, "max": {"a": 2.0, "b": None}, "count": {"a": 1, "b": 0}, "sum": {"a": 2.0, "b": 0.0}}


def test_signs_infinities_and_whole_numbers(spark):
    inf = math.inf
    rows = [(-0.0, 1.0), (0.0, -0.0), (-inf, -inf), (inf, inf), (-inf, 2.0), (3.0, -2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    a, b = F.col("a"), F.col("b")
    out = df.select(numeric.UNARY["signbit"](a).alias("s"), numeric.BINARY["copysign"](F.lit(1.0), a).alias("c"), numeric.BINARY["logaddexp"](a, b).alias("l"), numeric.BINARY["nextafter"](a, b).alias("n"), numeric.UNARY["spacing"](b).alias("p")).collect()
    x, y = np.array(rows).T
    with np.errstate(all="ignore"):
        assert [r.s for r in out] == np.signbit(x).tolist()
        assert [r.c for r in out] == np.copysign(1.0, x).tolist()
        assert np.allclose([r.l for r in out], np.logaddexp(x, y))
        assert [r.n for r in out] == np.nextafter(x, y).tolist()
        assert np.array_equal(np.array([math.nan if r.p is None else r.p for r in out]), np.spacing(y), equal_nan=True)
    whole = spark.createDataFrame([(12, 18), (0, 5), (0, 0), (-7, 21), (2**61, 2**40 * 3), (None, 1)], "a long, b long")
    got = whole.select(numeric.gcd(a, b).alias("g"), numeric.lcm(F.least(a, F.lit(1000)), b).alias("l")).collect()
    assert [r.g for r in got] == [6, 5, 0, 7, 2**40, None] and [r.l for r in got][:4] == [36, 0, 0, 21]
    none = spark.createDataFrame([(None,)], "a double").select(numeric.UNARY["isnan"](a).alias("n"), numeric.UNARY["isfinite"](a).alias("f")).first()
    assert none.n and not none.f


def test_rotation_mean_skips_what_is_not_finite(spark):
    turn = [(0.0, 0.0, math.sin(x / 2), math.cos(x / 2)) for x in (0.2, 0.4)]
    rows = [("a", turn[0]), ("a", turn[1]), ("a", (math.nan, 0.0, 0.0, 1.0)), ("a", None), ("b", (math.inf, 0.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "k string, q struct<x:double,y:double,z:double,w:double>")
    got = {r.k: r.m for r in sp.rotation_mean(df, ["k"], "q", output="m").collect()}
    assert got["a"].z == pytest.approx(math.sin(0.15)) and (got["b"] is None or got["b"].z is None or math.isnan(got["b"].z))
    strict = {r.k: r.m for r in sp.rotation_mean(df, ["k"], "q", output="m", skipna=False).collect()}
    assert strict["a"] is None or strict["a"].z is None or math.isnan(strict["a"].z)


def test_exact_clocks_within_a_tolerance(spark):
    a = frame(spark, [("a", float(i), float(i)) for i in range(3)])
    b = frame(spark, [("a", i + 0.05, 100.0 * (i + 1)) for i in range(3)]).rename(v="w")
    out = asof.synchronized([a, b], join="exact", how="nearest", tol=0.1)
    assert values(out.df.orderBy("t"), "t", "v", "w") == [(0.0, 0.0, 100.0), (1.0, 1.0, 200.0), (2.0, 2.0, 300.0)]
    with pytest.raises(PySparkException):
        asof.synchronized([a, b], join="exact", how="nearest", tol=0.01).df.collect()


def test_lanes_of_synchronised_frames(spark):
    a, b = frame(spark, [("a", 0.0, 1.0), ("b", 0.0, 2.0)]), frame(spark, [("b", 0.0, 3.0), ("c", 0.0, 4.0)]).rename(v="w")
    for lanes, want in (("inner", {"b"}), ("left", {"a", "b"}), ("outer", {"a", "b", "c"})):
        out = asof.synchronized([a, b], join="outer", how="nearest", lanes=lanes).df
        assert {k for (k,) in values(out, "k")} == want
    with pytest.raises(PySparkException, match="lanes"):
        asof.synchronized([a, b], join="outer", lanes="exact").df.collect()
    x, y = asof.synchronize([a, b], join="outer", how="nearest")
    assert x.fields == ("v",) and y.fields == ("w",) and values(y.df, "k", "w") == [("b", 3.0)]


def test_labels_by_nearness(spark, ramp):
    assert [t for (t,) in values(ramp.sel(method="nearest", t=1.4).df.where("k = 'a'"), "t")] == [1.0]
    assert ramp.sel(method="pad", tolerance=0.1, t=1.4).df.count() == 0
    assert [t for (t,) in values(ramp.sel(method="backfill", t=1.4).df.where("k = 'a'"), "t")] == [2.0]


def test_schemas_are_merged(spark, ramp):
    a, b = ramp.define_components(x=["v"]).retag(parent="world"), ramp.retag(child="ship")
    both = a.merge_schema(b)
    assert both.components == {"x": ("v",)} and both.attrs == {"parent": "world", "child": "ship"}
    with pytest.raises(RoleError):
        a.merge_schema(ramp.retag(parent="sea"))
    assert both.remap_ids({"world": "earth"}).frame_ids()["parent"] == "earth"
    with pytest.raises(RoleError):
        both.remap_ids({"world": "x", "ship": "x"})
    parts = LaneFrame.compose_components({"one": ramp, "two": ramp.rename(v="w")})
    assert parts.components == {"one": ("v",), "two": ("w",)} and parts.df.where("v <> w").count() == 0
    with pytest.raises(RoleError):
        LaneFrame.compose_components({"one": ramp, "two": ramp})


def test_motion_of_frames_and_inertia(spark):
    g = frames.FrameGraph()
    g.add("body", "world")
    assert g.motion_class("body") == "unknown" and g.inertial_status("world") == "unknown"
    g.set_inertial("world", "inertial")
    for kind, want in (("static", "inertial"), ("galilean", "inertial"), ("dynamic", "non_inertial"), ("unknown", "unknown")):
        g.set_motion_class("body", kind)
        assert g.inertial_status("body") == want
    with pytest.raises(ValueError):
        g.set_motion_class("body", "bad")
    with pytest.raises(ValueError):
        g.set_inertial("body", "bad")
    assert g.snapshot(["body"])["body"] == {"parent": "world", "bound": False, "motion": "unknown", "inertial": "unknown", "reachable": True}
    df = frame(spark, [("a", 0.0, 1.0)])
    assert g.resolve(df.retag(parent="world", child="body"))["child"] == "body"
    with pytest.raises(KeyError):
        g.resolve(df.retag(parent="moon"))


def test_edges_may_be_functions_of_their_step(spark):
    f = frame(spark, [("a", 0.0, 1.0)])
    g = frames.FrameGraph()
    g.bind("world", "ship", lambda step: sp.pose(sp.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0)), sp.yaw(F.lit(math.pi / 2))))
    rows = f.with_fields(p=sp.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0))).select("p")
    got = frames.to_frame(g, rows, "p", "ship", "world").df.first().p
    assert list(got) == pytest.approx([1.0, 1.0, 0.0])
    with pytest.raises(ValueError, match="motion"):
        frames.couple_motion(g, rows, "p", "ship", "world", lambda step: None)


def test_rotation_policies_on_a_clock(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 0.2), ("a", 1.0, 0.8), ("a", 2.0, 1.0)], "k string, t double, x double")
    f = LaneFrame.of(df, ["k"], "t", ["x"], order=["x"]).with_fields(r=sp.yaw(F.col("x"))).select("r")

    def turn(q, **options):
        r = frames.interpolated_rotations(f, "r", queries(spark, q), "q", "out", **options).first().out
        return None if r is None else 2 * math.asin(r.z)

    assert turn(0.5) == pytest.approx(0.1) and turn(1.5) == pytest.approx(0.9) and turn(3.0) is None
    assert turn(1.0) is None and turn(1.0, duplicates="left") == pytest.approx(0.2) and turn(1.0, duplicates="right") == pytest.approx(0.8)
    assert turn(3.0, method="nearest") == pytest.approx(1.0) and turn(0.5, method="linear") == pytest.approx(0.1)
    with pytest.raises(PySparkException, match="repeated"):
        turn(1.0, duplicates="raise")


def test_staged_slerp_is_slerp(spark):
    rng = np.random.default_rng(0)
    rows = [(*(tuple(map(float, q)) for q in rng.normal(size=(2, 4))), float(k)) for k in np.linspace(0, 1, 9)]
    q = "struct<x:double,y:double,z:double,w:double>"
    df = spark.createDataFrame(rows, f"a {q}, b {q}, k double")
    out = sp.with_slerp(df, F.col("a"), F.col("b"), F.col("k"), "s").withColumn("t", sp.slerp(F.col("a"), F.col("b"), F.col("k")))
    for r in out.collect():
        assert list(r.s) == pytest.approx(list(r.t))
    assert set(out.columns) == {"a", "b", "k", "s", "t"}


def test_six_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],), (None,)], "s array<double>")
    m = motion.from_vector6(F.col("s"))
    got = df.select(motion.linear(m).alias("l"), motion.angular(m).alias("a"), motion.as_vector6(m).alias("s"), *(motion.norm(m["linear"], o).alias(f"n{i}") for i, o in enumerate((2, 1, math.inf, -math.inf, 0, 3)))).collect()
    assert list(got[0].l) == [1, 2, 3] and list(got[0].a) == [4, 5, 6] and got[0].s == [1, 2, 3, 4, 5, 6] and got[1].s is None
    assert [got[0][f"n{i}"] for i in range(6)] == pytest.approx([np.linalg.norm([1, 2, 3], o) for o in (2, 1, np.inf, -np.inf, 0, 3)])
    with pytest.raises(PySparkException, match="six"):
        spark.createDataFrame([([1.0],)], "s array<double>").select(m.alias("m")).collect()


def test_kinds_of_derivatives(spark):
    f = frame(spark, [("a", float(i), float(i * i)) for i in range(4)]).with_fields(p=sp.vector(F.col("v"), F.lit(0.0), F.col("t"))).select("p").retag(kind="position")
    twice = kinematics.differentiate(f, order=2)
    assert twice.attrs["kind"] == "linear_acceleration"
    assert [r.p.x for r in twice.df.orderBy("seq").collect()] == [0.0, 0.0, 2.0, 2.0]
    with pytest.raises(ValueError):
        kinematics.integrate(f)


def test_close_events_are_told_once(spark):
    f = frame(spark, [("a", t, v) for t, v in [(0.0, 0.0), (1.0, 9.0), (1.1, 0.0), (1.15, 9.0), (1.3, 0.0), (2.0, 9.0)]])
    on = F.col("v") > 5
    enter = lambda **o: [t for t, c in values(events.events(f, on, **o), "time", "edge_code") if c == 1]
    assert enter() == [1.0, 1.15, 2.0] and enter(dedupe_atol=0.2) == [1.0, 2.0]
    with pytest.raises(ValueError):
        events.at_boundaries(f, F.col("v") > 100, on_empty="error")
    with pytest.raises(ValueError):
        events.when(f, F.col("v") > 100, on_empty="error")


def test_labelled_vectors_and_matrix_norms(spark):
    df = spark.createDataFrame([([1.0, 2.0], [10.0, 20.0], [[1.0, 2.0], [3.0, -4.0]])], "a array<double>, b array<double>, m array<array<double>>")
    row = df.select(vectors.add_labelled(F.col("a"), ["x", "y"], F.col("b"), ["y", "x"]).alias("s"), vectors.dot_labelled(F.col("a"), ["x", "y"], F.col("b"), ["y", "x"]).alias("d"), *(vectors.matrix_norm(F.col("m"), o).alias(f"n{i}") for i, o in enumerate(("fro", 1, -1, math.inf, -math.inf, "nuc", 2, -2)))).first()
    assert row.s == [21.0, 12.0] and row.d == 40.0
    m = np.array([[1.0, 2.0], [3.0, -4.0]])
    assert [row[f"n{i}"] for i in range(8)] == pytest.approx([np.linalg.norm(m, o) for o in ("fro", 1, -1, np.inf, -np.inf, "nuc", 2, -2)])
    with pytest.raises(ValueError):
        vectors.by_label(F.col("a"), ["x", "y"], ["z"])


def test_merges_and_cores_of_frames(spark):
    a, b = frame(spark, [("a", 0.0, 1.0), ("a", 1.0, 2.0)]), frame(spark, [("a", 0.0, 3.0), ("a", 1.0, 4.0)])
    with pytest.raises(PySparkException):
        combine.merge(a, b, compat="equals").df.collect()
    with pytest.raises(ValueError):
        combine.merge(a, a.retag(parent="x"), compat="identical")
    core = combine.assemble_core([[a, b], [b, a]], "m").df.orderBy("seq").first().m
    assert core == [[1.0, 3.0], [3.0, 1.0]]
    with pytest.raises(ValueError):
        combine.assemble_core([[a], [a, b]], "m")
    assert combine.stack_frames([a, b], "v2").df.orderBy("seq").first().v2 == [1.0, 3.0]
    assert set(combine.decompose_core(a.with_fields(w=F.array("v", "v")).select("w"), "w", ["x", "y"], "index")) == {0, 1}
    assert combine.topology(a, b) == "same"
    with pytest.raises(ValueError):
        combine.topology(a, LaneFrame(b.df.withColumnRenamed("k", "z"), ("z",), "seq", "t", ("v",)))
    with pytest.raises(Exception, match="samples"):  # several tasks may report it at once, which Spark wraps in another error
        combine.concat_batch({"x": a, "y": b.isel(slice(0, 1))}, sequence="exact").df.collect()


def test_csv_policies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/r1.csv").write_text("time,speed,car\n0.0,2.0,red\n0.0,3.0,red\n1.0,4.0,red\n")
    (tmp_path / "in/r2.csv").write_text("time,speed,car\n5.0,7.25,blue\n")
    at, of = str(tmp_path / "in"), logs.CsvOptions
    assert logs.read_csv_logs(spark, at, of(metadata=["car"])).fields == ("speed",)
    assert sorted(values(logs.lane_metadata(spark, at, of(metadata=["car"])), "trial", "car")) == [("r1", "red"), ("r2", "blue")]
    with pytest.raises(PySparkException, match="increasing"):
        logs.read_csv_logs(spark, at, of(metadata=["car"], order="increasing")).df.collect()
    once = logs.read_csv_logs(spark, at, of(metadata=["car"], order="increasing", normalize=True))
    assert sorted(values(once.df, "trial", "seq", "speed")) == [("r1", 0, 2.0), ("r1", 1, 4.0), ("r2", 0, 7.25)]
    logs.write_csv_logs(once, str(tmp_path / "out"), logs.CsvExport(float_format="%.1f"))
    (written,) = (tmp_path / "out/trial=r1").glob("*.csv")
    assert written.read_text().splitlines() == ["time,speed", "0.0,2.0", "1.0,4.0"]
    (tmp_path / "in/r3.csv").write_text("time,other,car\n5.0,7.0,blue\n")
    with pytest.raises(RoleError, match="different headers"):
        logs.read_csv_logs(spark, at, of(metadata=["car"]))


def test_layouts_and_recipes(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0)], ["k", "seq", "d.p.x", "d.p.y", "d.p.z", "d.r.x", "d.r.y", "d.r.z", "d.r.w"])
    f = LaneFrame(df.withColumn("t", F.lit(0.0)), ("k",), "seq", "t", ())
    out = logs.Recipe("p.{x,y,z}", "r.{x,y,z,w}").build(f, "pose", prefix="d.", parent="world")
    assert list(out.df.first().pose.p) == [1.0, 2.0, 3.0] and out.frame_ids()["parent"] == "world"
    laid = logs.Layout(("k",), "t").frame(spark.createDataFrame([("a", 0.5, 1.0, "x")], "k string, t double, v double, note string"))
    assert laid.fields == ("v",) and laid.df.columns == ["k", "seq", "t", "v"]


def test_geodesic_points_and_places(spark):
    df = spark.createDataFrame([(10.0, 20.0, 40.0, 60.0)], "a double, b double, c double, d double")
    way = df.withColumn("g", geo.geodesic("a", "b", "c", "d"))
    p = way.select(geo.geodesic_point("a", "b", "g.initial_bearing", "g.distance").alias("p")).first().p
    assert (p.lat, p.lon) == pytest.approx((40.0, 60.0), abs=1e-9)
    rows = spark.createDataFrame([("a", 0.0, 0.0, 179.0), ("a", 2.0, 0.0, -179.0)], "k string, t double, lat double, lon double")
    f = LaneFrame.of(rows, ["k"], "t", ["lat", "lon"])
    f = f.with_fields(g=geo.lla(F.col("lat"), F.col("lon"), F.lit(5.0))).select("g")
    for method in ("geodesic_linear", "ecef_linear", "local_enu_linear"):
        got = places.at(f, "g", queries(spark, 1.0), "q", "g", method).first().g
        assert abs(got.lon) == pytest.approx(180.0, abs=1e-6) and got.lat == pytest.approx(0.0, abs=1e-9)
    assert places.at(f, "g", queries(spark, 9.0), "q", "g", "nearest").first().g.lon == -179.0


def test_displacements_are_only_turned(spark):
    f = frame(spark, [("a", 0.0, 1.0)])
    g = frames.FrameGraph()
    g.bind("world", "ship", sp.pose(sp.vector(F.lit(5.0), F.lit(0.0), F.lit(0.0)), sp.yaw(F.lit(math.pi / 2))))
    rows = f.with_fields(p=sp.vector(F.lit(1.0), F.lit(0.0), F.lit(0.0))).select("p")
    assert list(frames.to_frame(g, frames.as_delta(rows), "p", "ship", "world").df.first().p) == pytest.approx([0.0, 1.0, 0.0])


def test_labels_of_missing_groups(spark, ramp):
    key = {"g": F.when(F.col("k") == "a", F.lit("x"))}
    assert {r.g for r in rd.Grouped(ramp, key, "group", "none").reduce("count").collect()} == {"x", "none"}
    with pytest.raises(PySparkException, match="label"):
        rd.Grouped(ramp, key, "group", "x").reduce("count").collect()
    assert {r.g for r in rd.Grouped(ramp, key, "drop").reduce("count").collect()} == {"x"}
    with pytest.raises(PySparkException, match="missing"):
        rd.Grouped(ramp, key).reduce("count").collect()
