"""Lanes' CSV files that tasks write themselves against those of Spark's CSV writer."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from wayline.frame import LaneFrame
from wayline.sources import logs

ODD = ["run1", None, "", "a/b=c%d", "x y", "é'\"{1}[2]^#*?:\\", "tab\there", "last."]
TEXT = [None, "", "plain", " led by a space", 'said "so"', "two\nlines", "a,b", "back\\slash"]


def told(folder):
    """Text of the files by lane folder; several files of a folder in order of their text."""
    out = {}
    for p in folder.rglob("*.csv"):
        out.setdefault(str(p.parent.relative_to(folder)), []).append(p.read_bytes())
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("header", [True, False])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_files_are_those_of_sparks_writer_without_its_checksums(spark, tmp_path, header, scheme):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # lanes go on in the next batch
    try:
        rows = [(k, j % 2 + 5, i, i * 0.1, v * 1e8 / 3 if i % 3 else None, TEXT[(i + j) % len(TEXT)], i % 2 == 0) for j, k in enumerate(ODD) for i, v in enumerate([1.0, -0.0, 1e-9, 12.5, float("inf")])]
        df = spark.createDataFrame(rows, '`run` string, part int, seq long, t double, `a,b` double, note string, ok boolean').withColumn("ts", F.timestamp_seconds(F.col("seq") + 0.25))
        frame = LaneFrame(df, ("run", "part"), "seq", "t", ("a,b", "note", "ok", "ts"))
        logs.write_csv_logs(frame, f"{scheme}{tmp_path}/out", logs.CsvExport(header=header))
        plain = df.repartition("run", "part").sortWithinPartitions("run", "part", "seq").select("run", "part", "t", "`a,b`", "note", "ok", "ts")
        plain.write.partitionBy("run", "part").option("header", header).csv(f"{tmp_path}/spark")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got, want = told(tmp_path / "out"), told(tmp_path / "spark")
    assert got == want and len(got) == 8
    names = [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert "_SUCCESS" in names and not [n for n in names if n.startswith(".")]
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    with pytest.raises(FileExistsError):
        logs.write_csv_logs(frame, f"{tmp_path}/out")


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.range(20).select(F.lit("a").alias("k"), F.col("id").alias("seq"), F.when(F.col("id") == 19, F.raise_error(F.lit("broken")).cast("double")).otherwise(1.0).alias("v"))
    with pytest.raises(PySparkException, match="broken"):
        logs.write_csv_logs(LaneFrame(df, ("k",), "seq", None, ("v",)), f"{tmp_path}/out")
    assert list(tmp_path.iterdir()) == []
