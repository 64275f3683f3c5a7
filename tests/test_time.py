"""Clocks of instants, slices, folds, split lanes, exact medians and ranks, geodesics, frame graphs and logs by their rules."""

import datetime as dt
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayline.frame import LaneFrame, RoleError
from wayline.functions import geo, numeric
from wayline.functions import spatial as sp
from wayline.functions.clocks import Clock
from wayline.functions.ellipsoid import WGS84
from wayline.operators import asof, combine, events, folds, frames, kinematics, scan
from wayline.operators import reduce as rd
from wayline.sources import logs

T0 = dt.datetime(2026, 1, 1)


def s(x):
    return T0 + dt.timedelta(seconds=x)


def clocked(spark, rows, kind="timestamp_ntz", field="v"):
    df = spark.createDataFrame([(k, s(t).isoformat(sep=" "), v) for k, t, v in rows], f"k string, t string, {field} double").withColumn("t", F.col("t").cast(kind))
    return LaneFrame.of(df, ["k"], "t", [field])


def values(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_instants_select_and_interpolate(spark, kind):
    f = clocked(spark, [("a", 0, 0.0), ("a", 10, 20.0), ("a", 20, 40.0)], kind)
    q = asof.grid_for(f, [s(3), str(s(18)), s(5), s(-1)]).withColumnRenamed("t", "q")
    assert sorted(values(asof.index(f, q, "q"), "seq", "sample_index")) == [(0, 0), (1, 2), (2, 0), (3, 0)]
    assert sorted(values(asof.at(f, q, "q"), "seq", "v"), key=repr) == [(0, 6.0), (1, 36.0), (2, 10.0), (3, None)]
    assert values(asof.select_range(f, s(5), None).df.orderBy("seq"), "v") == [(20.0,), (40.0,)]


def test_instants_in_the_far_future_differ_exactly(spark):
    base = "2262-04-11 00:00:00.00000"
    df = spark.createDataFrame([("a", f"{base}{i}", float(i)) for i in range(3)], "k string, t string, v double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    f = LaneFrame.of(df, ["k"], "t", ["v"])
    assert values(asof.resample_to(f, [f"{base}1"]).df, "v") == [(1.0,)]
    assert values(kinematics.differentiate(f).df, "v") == [(1e6,)] * 3
    whole = LaneFrame.of(spark.createDataFrame([("a", (1 << 60) + i, float(i)) for i in range(3)], "k string, t long, v double"), ["k"], "t", ["v"])
    assert values(asof.resample_to(whole, [(1 << 60) + 1]).df, "v") == [(1.0,)]


@pytest.mark.parametrize("kind, text", [("timestamp_ntz", "2024-03-31 02:30:00.123456"), ("date", "1969-12-30"), ("timestamp_ntz", "1960-01-01 23:59:59.999999")])
def test_ticks_and_back(spark, kind, text):
    df = spark.createDataFrame([(text,)], "x string").withColumn("x", F.col("x").cast(kind))
    clock = Clock.of(df, "x")
    assert df.select((clock.value(clock.ticks(F.col("x"))) == F.col("x")).alias("same")).first().same


def test_kinds_do_not_mix(spark):
    f, n = clocked(spark, [("a", 0, 0.0), ("a", 1, 1.0)]), LaneFrame.of(spark.createDataFrame([("a", 0.0, 1.0)], "k string, t double, w double"), ["k"], "t", ["w"])
    with pytest.raises(ValueError, match="same kind"):
        asof.synchronized([f, n], "outer")
    with pytest.raises(ValueError, match="timedelta"):
        asof.synchronized([f, f.rename(v="w")], "outer", tol=1.0)
    with pytest.raises(ValueError, match="instants only"):
        asof.synchronized([n, n.rename(w="x")], "outer", tol=dt.timedelta(seconds=1))
    with pytest.raises(ValueError, match="needs instants"):
        asof.resample_to(f, [1.0])
    with pytest.raises(ValueError, match="number or an instant"):
        asof.at(f.over(f.df.withColumn("t", F.lit("x"))), n.df.select("k", "t"), "t")


def test_instants_synchronise_with_a_tolerance(spark):
    a, b = clocked(spark, [("a", 0, 0.0), ("a", 10, 10.0)], field="a"), clocked(spark, [("a", 5, 5.0), ("a", 10, 10.0)], field="b")
    out = asof.synchronized([a, b], "outer", "fill", tol=dt.timedelta(0)).df.orderBy("seq")
    assert values(out, "t", "a", "b") == [(s(0), 0.0, None), (s(5), None, 5.0), (s(10), 10.0, 10.0)]
    thin = asof.synchronized([a, b], "outer", tol=dt.timedelta(seconds=5)).df.orderBy("seq")
    assert values(thin, "t") == [(s(0),), (s(10),)]


def test_around_instants(spark):
    f = clocked(spark, [("a", t, float(t)) for t in range(10)])
    found = events.events(f, F.col("v") >= 4)
    taus = events.tau_grid(*(dt.timedelta(seconds=x) for x in (1, 2, 1)))
    out = events.around(f, events.pick(found, ["k"], "enter"), taus).orderBy("tau")
    assert values(out, "tau", "v") == [(dt.timedelta(seconds=x), 4.0 + x) for x in (-1, 0, 1, 2)]


def test_bounds_by_lane(spark):
    f = clocked(spark, [("a", 0, 0.0), ("a", 10, 1.0), ("a", 20, 2.0), ("b", 5, 3.0)])
    b = spark.createDataFrame([("a", 5, None, 1), ("a", None, 10, 2), ("a", 10, 10, 3), ("b", 6, 9, 4), ("c", 0, 9, 5), ("a", 15, 5, 6)], "k string, lo int, hi int, n int")
    b = b.withColumns({c: F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col(c).cast("decimal(18,6)")) for c in ("lo", "hi")})
    got = {r.n: (r.i0, r.i1) for r in asof.bounds_map(f, b, "lo", "hi").collect()}
    assert got == {1: (1, 3), 2: (0, 2), 3: (1, 2), 4: (1, 1), 5: (0, 0), 6: (2, 2)}
    rows = sorted(values(asof.select_slices(f, b, "lo", "hi"), "n", "seq", "sample_index", "v"))
    assert rows == [(1, 0, 1, 1.0), (1, 1, 2, 2.0), (2, 0, 0, 0.0), (2, 1, 1, 1.0), (3, 0, 1, 1.0)]


def test_slices_meet_by_blocks_without_a_nested_loop(spark, monkeypatch):
    monkeypatch.setattr(asof, "BLOCK", 4)
    f = LaneFrame.of(spark.createDataFrame([("a", float(t), float(t)) for t in range(50)], "k string, t double, v double"), ["k"], "t", ["v"])
    b = spark.createDataFrame([("a", float(i), float(i + i % 9)) for i in range(-3, 55)], "k string, lo double, hi double")
    out = asof.select_slices(f, b, "lo", "hi")
    assert sorted(values(out, "lo", "v")) == sorted((float(i), float(t)) for i in range(-3, 55) for t in range(50) if i <= t <= i + i % 9)
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_folds_carry_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(k, float(t), float(t)) for k in ("a", None, "c") for t in range(10)]
        f = LaneFrame.of(spark.createDataFrame(rows, "k string, t double, v double"), ["k"], "t", ["v"])

        def step(state, batch):
            out = []
            for x in batch.column("v").to_pylist():
                state += x
                out.append(state)
            return state, [pa.array(out, pa.float64())]

        out = folds.fold_lanes(f, float, step, "total double")
        assert out.fields == ("total",) and sorted(values(out.df, "k", "seq", "total"), key=repr) == sorted(((k, t, sum(range(t + 1)) + 0.0) for k in ("a", None, "c") for t in range(10)), key=repr)
        rng = random.Random(1)
        times = [(k, rng.random() * 20) for k in "ab" for _ in range(60)]
        got = sorted(values(folds.thinned(spark.createDataFrame(times, "k string, t double"), ["k"], "t", 0.7), "k", "t"))
        want = []
        for k in "ab":
            last = None
            for t in sorted(t for j, t in times if j == k):
                if last is None or t - last > 0.7:
                    want.append((k, t))
                    last = t
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_split_lanes_have_the_rows_of_whole_ones(spark):
    rng = random.Random(4)
    rows = [(k, float(sum(rng.random() < 0.8 for _ in range(t)) if k == "b" else t) + (0.25 if k == "a" else 0), rng.random()) for k, n in (("a", 200), ("b", 150), (None, 90), ("d", 3)) for t in range(n)]
    f = LaneFrame.of(spark.createDataFrame([(k, t, v, i) for i, (k, t, v) in enumerate(rows)], "k string, t double, v double, i long"), ["k"], "t", ["v"], order=["i"])
    cut = scan.split_lanes(f, 10)
    assert cut.cuts.count() == 3
    q = spark.createDataFrame([(k, rng.random() * 220 - 10) for k in ("a", "b", None, "d", "e") for _ in range(60)] + [("b", float(x)) for x in range(20)] + [("a", None)], "k string, q double")
    for options in ({}, {"method": "nearest"}, {"duplicates": "left"}, {"duplicates": "right"}):
        whole, split = (sorted(values(asof.at(x, q, "q", **options), "k", "q", "v"), key=repr) for x in (f, cut))
        assert whole == split
    g = f.over(f.df.dropDuplicates(["k", "t"])).renumbered("t")
    for join in ("outer", "inner", "domain", "left"):
        other = g.over(g.df.where("v < 0.7")).rename(v="w")
        whole, split = (sorted(values(asof.synchronized([x, other], join).df, "k", "seq", "t", "v", "w"), key=repr) for x in (g, scan.split_lanes(g, 10)))
        assert whole == split
    whole, split = ({(r.k, r.seq): r.v for r in kinematics.integrate(x, initial=2.0).df.collect()} for x in (g, scan.split_lanes(g, 10)))
    assert whole.keys() == split.keys() and all(whole[k] == pytest.approx(split[k]) for k in whole)
    holes = g.map_fields(lambda x: F.when(x > 0.1, x))
    whole, split = ({(r.k, r.seq): r.v for r in kinematics.integrate(x).df.collect()} for x in (holes, scan.split_lanes(holes, 10)))
    assert all((whole[k] is None) == (split[k] is None) for k in whole)
    assert sorted(values(cut.renumbered("t", "seq").df, "k", "seq", "v"), key=repr) == sorted(values(f.renumbered("t", "seq").df, "k", "seq", "v"), key=repr)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = asof.at(cut, q, "q").where("k = 'a'").groupBy(F.spark_partition_id().alias("task")).agg(F.sum("v").alias("v")).collect()
        assert len(tasks) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("case", ["even", "odd", "ties", "wide", "few"])
def test_median_of_all_is_exact(spark, monkeypatch, case):
    monkeypatch.setattr(rd, "LAST_VALUES", 20)
    rng = random.Random(7)
    x = {"even": [rng.random() for _ in range(3000)], "odd": [rng.gauss(0, 1) for _ in range(2001)], "ties": [rng.choice([1.0, 2.0, 5.0]) for _ in range(1500)], "wide": [10.0 ** rng.uniform(-300, 300) for _ in range(1000)], "few": [3.0]}[case]
    df = spark.createDataFrame([(v,) for v in [*x, None, float("nan")]], "v double").repartition(5)
    assert rd.median_of_all(df, ["v"]).first().v == pytest.approx(float(np.median(x)), rel=1e-15)
    assert rd.median_of_all(df, ["v"], skipna=False).first().v is None
    assert rd.median_of_all(df.where("v IS NULL"), ["v"]).first().v is None


def test_many_groups_are_numbered_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(rd, "RANKED_ROWS", 40)
    rng = random.Random(3)
    rows = [(f"g{rng.randint(0, 300)}", rng.choice(["a", "b", None]), float(t)) for t in range(2000)]
    f = LaneFrame.of(spark.createDataFrame([(k, t, g) for g, k, t in rows], "k string, t double, g string"), ["k"], "t", ["g"])
    got = {r.g: r.group_rank for r in rd.Grouped(f, {"g": F.col("g")}).ranks().collect()}
    first = {}
    for g, k, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2])):
        first.setdefault(g, len(first))
    assert got == first


#: Published test lines (latitude, longitude, latitude, longitude; bearings; metres): fixed values.
LINES = [
    (40.6, -73.8, 51.6, -0.5, 51.198882845579824, 107.82177673554, 5551759.400319),
    (-41.32, 174.81, 40.96, -5.50, 161.06766998616, 18.82519512325, 19959679.267354),
    (35.60777, -139.44815, -11.17491, -69.95921, 111.098748429560326, 129.289270889708762, 8935244.5604818305),
    (55.52454, 106.05087, 77.03196, 197.18234, 22.020059880982801, 109.112041110671519, 4105086.1713924406),
    (-21.97856, 142.59065, 41.84138, 98.56635, -32.44456876433189, -41.84359951440466, 8394328.894657671),
    (-66.99028, 112.2363, -12.70631, 285.90344, 173.73491240878403, 2.512956620913668, 11150344.2312080241),
    (-17.42761, 173.34268, -15.84784, 5.93557, -159.033557661192928, -20.787484651536988, 16076603.1631180673),
    (32.84994, 48.28919, -56.28556, 202.29132, 150.492927788121982, 48.113449399816759, 16727068.9438164461),
    (6.96833, 52.74123, -7.39675, 206.17291, 92.581585386317712, 90.721692165923907, 17102477.2496958388),
    (-50.56724, -16.30485, -33.56571, -94.97412, -105.439679907590164, -47.348547835650331, 6455670.5118668696),
    (0, 0, 0.5, 179.5, 25.67187286829, 154.32708546994, 19936288.578965),
    (0, 0, 0, 180, 0, 180, 20003931.458625),
    (0, 0, 0, 179.5, 55.96650, 124.03350, 19980861.908891),
]


def test_geodesics_of_published_lines():
    a, b, c, d, first, last, distance = np.array(LINES, float).T
    got = WGS84.inverse(a, b, c, d)
    assert np.abs(got[0] - distance).max() < 1e-6
    exact = np.abs(distance - 19980861.908891) > 1  # that line's bearings are given to five places
    assert np.abs(got[1] - first)[exact].max() < 1e-9 and np.abs(got[2] - last)[exact].max() < 1e-9
    assert np.allclose(got[1], first, atol=1e-5) and np.allclose(got[2], last, atol=1e-5)


def test_direct_problem_comes_back_from_everywhere():
    rng = np.random.default_rng(2)
    n = 20_000
    a, b, c, d = rng.uniform(-90, 90, n), rng.uniform(-180, 180, n), rng.uniform(-90, 90, n), rng.uniform(-180, 180, n)
    c[: n // 2], d[: n // 2] = np.clip(-a[: n // 2] + rng.normal(0, 0.3, n // 2), -90, 90), b[: n // 2] + 180 + rng.normal(0, 0.3, n // 2)
    a[:9], c[:9] = (90, -90, 0, 0, 0, 45, 90, 10, 10), (10, 20, 0, 1e-9, -1e-9, -45, -90, 10, -10)
    distance, first, _ = WGS84.inverse(a, b, c, d)
    lat, lon, _ = WGS84.direct(a, b, first, distance)
    gap = np.hypot(lat - c, ((lon - d + 180) % 360 - 180) * np.cos(np.radians(c))) * 111_000
    assert gap.max() < 1e-6 and distance.max() <= 20_003_931.4587
    assert np.isnan(WGS84.inverse(np.array([91.0, np.nan]), *np.zeros((3, 2)))[0]).all()


def test_bearings_at_poles_are_errors(spark):
    df = spark.createDataFrame([(90.0, 0.0, 10.0, 5.0), (10.0, 5.0, 10.0, 5.0)], "a double, b double, c double, d double")
    p, q = (geo.lla(F.col(x), F.col(y), F.lit(0.0)) for x, y in ("ab", "cd"))
    with pytest.raises(PySparkException, match="pole"):
        df.where("a = 90").select(geo.initial_bearing(p, q)).collect()
    same = df.where("a = 10").select(geo.final_bearing(p, q).alias("x")).first().x
    assert same is None or np.isnan(same)
    with pytest.raises(PySparkException, match="pole"):
        df.where("a = 90").select(geo.geodesic_between("a", "b", "c", "d", F.lit(0.5))).collect()


def test_frames_keep_and_lose_what_is_theirs(spark):
    g = frames.FrameGraph()
    g.add("ship", "world")
    g.add("deck", "ship")
    g.set_motion_class("ship", "galilean")
    g.set_inertial("ship", "inertial")
    g.rename("ship", "boat")
    assert g.motion_class("boat") == "galilean" and g.inertial_status("boat") == "inertial" and g.motion_class("ship") == "unknown"
    g.remove("boat")
    g.add("boat", "world")
    assert g.motion_class("boat") == "unknown" and g.inertial_status("boat") == "unknown"


def test_motion_is_asked_of_edges_that_move_what_is_moved(spark):
    g = frames.FrameGraph()
    turn = sp.pose(sp.vector(*(F.lit(0.0),) * 3), sp.quaternion(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))
    g.bind("world", "ship", turn)
    g.set_motion_class("ship", "galilean")
    rows = LaneFrame.of(spark.createDataFrame([("a", 0.0, 1.0)], "k string, t double, x double"), ["k"], "t", ["x"])
    rows = rows.with_fields(v=sp.vector(F.col("x"), F.lit(2.0), F.lit(3.0))).select("v")
    own = sp.vector(F.lit(10.0), F.lit(0.0), F.lit(0.0))
    moved = {kind: frames.couple_motion(g, rows.retag(kind=kind), "v", "ship", "world", (lambda step: own) if "velocity" in kind else None).df.first().v.x for kind in ("linear_velocity", "linear_acceleration")}
    assert moved == {"linear_velocity": 11.0, "linear_acceleration": 1.0}
    g.set_motion_class("ship", "dynamic")
    with pytest.raises(ValueError, match="no motion"):
        frames.couple_motion(g, rows.retag(kind="linear_acceleration"), "v", "ship", "world", None)
    with pytest.raises(ValueError, match="inertial"):
        frames.couple_motion(g, rows, "v", "ship", "world", lambda step: own, inertial_roles=["parent"])
    g.set_inertial("ship", "inertial")
    frames.couple_motion(g, rows, "v", "ship", "world", lambda step: own, inertial_roles=["parent"])


def test_csv_names_may_be_quoted_and_repeated_stems_fail(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "run.csv").write_text('"time","speed, fast"\n0.0,1.0\n1.0,2.0\n')
    got = logs.read_csv_logs(spark, str(tmp_path / "a"))
    assert got.fields == ("speed, fast",) and values(got.df.orderBy("seq"), "trial", "time", "speed, fast") == [("run", 0.0, 1.0), ("run", 1.0, 2.0)]
    (tmp_path / "b" / "run.csv").write_text('"time","speed, fast"\n0.0,3.0\n')
    with pytest.raises(RoleError, match="one lane"):
        logs.read_csv_logs(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_values_at_the_edges(spark):
    df = spark.createDataFrame([(1e20, 0.0), (float("inf"), 1.0), (float("nan"), 1.0), (-2.5, float("inf"))], "x double, y double")
    x, y = F.col("x"), F.col("y")
    got = df.select(numeric.floor(x).alias("f"), numeric.floor_divide(x, y).alias("q"), numeric.fmax(x, y).alias("m"), numeric.minimum(x, y).alias("n")).collect()
    assert got[0].f == 1e20 and got[1].f == float("inf") and np.isnan(got[2].f) and got[3].f == -3.0
    assert got[0].q == float("inf") and got[3].q == -1.0 and got[2].m == 1.0 and got[2].n is None


def test_reserved_names_and_repeated_right_keys_fail(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0)], "k string, t double, __v double")
    with pytest.raises(RoleError, match="own"):
        LaneFrame.of(df, ["k"], "t", ["__v"])
    left = LaneFrame.of(spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 2.0)], "k string, t double, v double"), ["k"], "t", ["v"])
    with pytest.raises(PySparkException, match="several rows"):
        combine.binary(left, left, lambda a, b: a + b, broadcast=True).df.collect()


def test_schema_patches_and_faults(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 1.0, 2), ("a", 1, 2.0, 2.0, 2), ("a", 2, 1.0, 3.0, 2), ("a", 2, 1.0, 3.0, 2), (None, 0, None, 4.0, 1)], "k string, seq long, t double, v double, n int")
    f = LaneFrame(df, ("k",), "seq", "t", ("v", "n"), {"speed": ("v",)}, {"parent": "ship", "unit": "m"})
    assert f.faults() == [("samples", "seq.repeated", 1), ("samples", "key.missing", 1), ("clock", "clock.missing", 1), ("clock", "clock.back", 1), ("clock", "clock.repeated", 1)]
    assert f.faults(["roles"]) == [] and f.set_roles(clock="k").faults(["roles"]) == [("roles", "clock.dtype.invalid", 1)]
    got = f.patch_schema({"attrs": {"parent": None, "child": "deck"}, "components": {"speed": None, "size": ["n"]}})
    assert dict(got.attrs) == {"unit": "m", "child": "deck"} and dict(got.components) == {"size": ("n",)}
    assert dict(f.patch_schema({"fields": ["n"]}).components) == {} and dict(f.patch_schema({"attrs": None}).attrs) == {}
    with pytest.raises(RoleError):
        f.patch_schema({"fields": ["nothing"]})
    with pytest.raises(RoleError, match="no"):
        f.patch_schema({"role": 1})
    assert f.set_validity("n").df.count() == 3 and f.set_validity("n").fields == ("v",) and f.set_validity(F.col("v") > 2).df.count() == 3


def test_attributes_combine_and_alignments_follow_one_side(spark):
    def made(keys, **attrs):
        return LaneFrame(spark.createDataFrame([(k, n, 1.0) for k, n in keys], "k string, seq long, v double"), ("k",), "seq", None, ("v",), {}, attrs)

    a, b = made([("a", 0), ("a", 1), (None, 0)], unit="m", parent="x"), made([("a", 1), (None, 0), ("c", 0)], unit="m", parent="y").rename(v="w")
    attrs = {how: dict(combine.merge(a, b, lanes="outer", samples="outer", combine_attrs=how).attrs) for how in ("override", "drop", "drop_conflicts")}
    assert attrs == {"override": {"unit": "m", "parent": "x"}, "drop": {}, "drop_conflicts": {"unit": "m"}}
    for how in ("no_conflicts", "identical"):
        with pytest.raises(ValueError):
            combine.merge(a, b, lanes="outer", samples="outer", combine_attrs=how)
    rows = {side: sorted(values(combine.align_many([a, b], side, side)[1].df, "k", "seq", "w"), key=repr) for side in ("left", "right", "inner")}
    assert rows["left"] == sorted([("a", 0, None), ("a", 1, 1.0), (None, 0, 1.0)], key=repr)
    assert rows["right"] == sorted([("a", 1, 1.0), (None, 0, 1.0), ("c", 0, 1.0)], key=repr) and rows["inner"] == sorted([("a", 1, 1.0), (None, 0, 1.0)], key=repr)
