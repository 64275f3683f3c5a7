"""Labelled arrays: axes survive Parquet, arithmetic and products meet by label."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayline.functions import labels as lb

XY, YX, AB, YZ = lb.Axis("part", ("x", "y")), lb.Axis("part", ("y", "x")), lb.Axis("row", ("a", "b")), lb.Axis("part", ("y", "z"))


@pytest.fixture(scope="module")
def arrays(spark, tmp_path_factory):
    df = spark.createDataFrame([([1.0, 2.0], [20.0, 10.0], [[1.0, 2.0], [3.0, 4.0]], [[4.0, 3.0], [2.0, 1.0]]), (None, [1.0, 1.0], None, None)], "p array<double>, q array<double>, m array<array<double>>, n array<array<double>>")
    for c, axes in (("p", [XY]), ("q", [YX]), ("m", [AB, XY]), ("n", [lb.Axis("row", ("b", "a")), YX])):
        df = lb.set_axes(df, c, *axes)
    at = str(tmp_path_factory.mktemp("labels") / "t")
    df.write.parquet(at)
    return spark.read.parquet(at).where("p IS NOT NULL")


def test_axes_survive_parquet(arrays):
    assert lb.axes_of(arrays, "p") == (XY,) and lb.axes_of(arrays, "m") == (AB, XY) and lb.axis(arrays, "m", "row") == AB
    with pytest.raises(ValueError, match="no axis"):
        lb.axis(arrays, "p", "row")


def test_sums_meet_by_label(arrays):
    assert lb.add(arrays, "p", "q", "s").first().s == [11.0, 22.0] and lb.sub(arrays, "q", "p", "s").first().s == [18.0, 9.0]
    assert lb.add(arrays, "m", "n", "s").first().s == [[2.0, 4.0], [6.0, 8.0]]
    other = lb.set_axes(arrays.withColumn("q", F.array(F.lit(5.0), F.lit(6.0))), "q", YZ)
    with pytest.raises(ValueError, match="different labels"):
        lb.add(other, "p", "q", "s")
    inner = lb.add(other, "p", "q", "s", "inner")
    assert inner.first().s == [7.0] and lb.axes_of(inner, "s") == (lb.Axis("part", ("y",)),)
    with pytest.raises(ValueError, match="do not meet"):
        lb.add(arrays, "p", "m", "s")


def test_products_meet_over_the_shared_axis(arrays):
    assert lb.matmul(arrays, "m", "q", "r").first().r == [1 * 10 + 2 * 20, 3 * 10 + 4 * 20]
    assert lb.matmul(arrays, "q", "m", "r").first().r == [50.0, 110.0]
    assert lb.matmul(arrays, "p", "q", "r").first().r == 50.0
    turned = lb.set_axes(arrays.withColumn("k", F.array(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(5.0), F.lit(7.0)))), "k", YX, lb.Axis("col", ("u", "v")))
    out = lb.matmul(turned, "m", "k", "r")
    assert np.allclose(out.first().r, np.array([[1, 2], [3, 4]]) @ np.array([[5, 7], [1, 0]])) and [a.name for a in lb.axes_of(out, "r")] == ["row", "col"]
    with pytest.raises(ValueError, match="one axis"):
        lb.matmul(arrays, "m", "n", "r")


def test_norms_and_parts(arrays):
    assert lb.norm(arrays, "p", "r").first().r == pytest.approx(5**0.5)
    assert lb.norm(arrays, "m", "r", over="row").first().r == pytest.approx([10**0.5, 20**0.5])
    assert lb.pick(arrays, "m", "r", part="y").first().r == [2.0, 4.0] and lb.pick(arrays, "m", "r", row="b", part="x").first().r == 3.0


def test_wrong_sizes_and_axes_fail(spark):
    df = spark.createDataFrame([([1.0],), (None,)], "p array<double>")
    with pytest.raises(PySparkException, match="size"):
        lb.set_axes(df, "p", XY).collect()
    assert lb.set_axes(df.where("p IS NULL"), "p", XY).first().p is None
    with pytest.raises(ValueError, match="axes"):
        lb.set_axes(df, "p", AB, XY)
    with pytest.raises(ValueError, match="differ"):
        lb.Axis("part", ("x", "x"))
