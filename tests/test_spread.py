"""Lanes of larger tables are dealt over more tasks."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wayline.operators import scan
from wayline.plans import catalog, q_time

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("lanes", [catalog.lanes, q_time.ts_lanes])
def test_tasks_grow_with_the_rows_and_keep_lanes_whole(spark, monkeypatch, lanes):
    monkeypatch.setattr(scan, "TASK_ROWS", 50)
    df = lanes(spark, SF).df
    parts = df.groupBy(F.spark_partition_id().alias("p"), "user_id").count().collect()
    assert df.rdd.getNumPartitions() == -(-df.count() // 50) > 4
    assert len({r.user_id for r in parts}) == len(parts)
    assert max(sum(r["count"] for r in parts if r.p == p) for p in {r.p for r in parts}) < df.count() / 4


@pytest.mark.parametrize("name", ["motion_to_frame", "around_stacked", "around_segments", "around_segments_ts", "rot_path", "param_bounds"])
def test_rows_are_those_of_few_tasks(spark, monkeypatch, name):
    want = sorted(map(str, catalog.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(scan, "TASK_ROWS", 50)
    got = catalog.QUERIES[name](spark, SF)
    assert got.rdd.getNumPartitions() > 4 and sorted(map(str, got.collect())) == want
