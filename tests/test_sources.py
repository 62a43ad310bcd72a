"""Data sources of raw records: files that tasks write and read in parts."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from framelake.sources import catalog as src
from framelake.sources import records


def test_clouds_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/clouds"
    points = spark.range(5000).select((F.col("id") % 7 * 3).alias("frame"), F.col("id").alias("pid"), *((F.col("id") / k).alias(c) for k, c in enumerate("xyzr", 2)))
    records.write_clouds(points, path)
    assert sorted(p.name for p in (tmp_path / "clouds").iterdir()) == [f"{k * 3:010d}.bin" for k in range(7)]
    back = sorted(tuple(r) for r in records.read_clouds(spark, path).collect())
    plain = sorted((r["id"] % 7, r["id"] // 7, *(struct.unpack("<f", struct.pack("<f", r["id"] / k))[0] for k in range(2, 6))) for r in spark.range(5000).collect())
    assert back == plain
    assert sorted(tuple(r) for r in src.read_velodyne_bin(spark, path).collect()) == plain  # Spark's own reader of bytes agrees
    records.write_clouds(points.where("frame = 3"), path, "overwrite")
    assert [p.name for p in (tmp_path / "clouds").iterdir()] == ["0000000003.bin"]


def test_parts_of_a_folder(spark, tmp_path, monkeypatch):
    records.write_clouds(spark.range(900).select((F.col("id") % 9).alias("frame"), F.col("id").alias("pid"), *(F.lit(1.0).alias(c) for c in "xyzr")), str(tmp_path / "c"))
    reader = records.CloudReader({"path": str(tmp_path / "c")})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(records, "PART", 2000)  # two files of 1,600 bytes pass it
    assert [len(p.files) for p in reader.partitions()] == [2, 2, 2, 2, 1]
    assert records.CloudReader({"path": str(tmp_path / "none")}).partitions() == [records.Files([])]
    assert records.read_clouds(spark, str(tmp_path / "none")).count() == 0


def test_nothing_is_left_of_a_job_that_fails(spark, tmp_path):
    bad = spark.range(100).select((F.col("id") % 4).alias("frame"), F.col("id").alias("pid"), *(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(1.0).alias(c) for c in "xyzr"))
    (tmp_path / "c").mkdir()
    with pytest.raises(Exception, match="broken"):
        records.write_clouds(bad, str(tmp_path / "c"))
    assert list((tmp_path / "c").iterdir()) == []


@pytest.mark.parametrize("per_file", [1, 16])
def test_records_round_trip(spark, tmp_path, per_file):
    track = spark.range(50).select("id", (F.col("id") / 8 + 1_700_000_000).alias("ts"), (F.col("id") / 100).alias("lat"), (F.col("id") / 50).alias("lon"), F.col("id").alias("vf"))
    records.write_records(track, str(tmp_path / "o"), per_file)
    assert len(list((tmp_path / "o" / "data").iterdir())) == -(-50 // per_file)
    got = records.read_records(spark, str(tmp_path / "o")).orderBy("id").collect()
    assert [(r.id, r.ts, r.vf, r.wx) for r in got] == [(k, 1_700_000_000 + k / 8, float(k), 0.0) for k in range(50)]
    assert [r.lon for r in got] == pytest.approx([k / 50 for k in range(50)])


def test_records_with_one_file_of_times(spark, tmp_path):
    (tmp_path / "data").mkdir()
    for k in range(3):
        (tmp_path / "data" / f"{k:010d}.txt").write_text("45 90 " + " ".join(str(k) for _ in range(28)))
    (tmp_path / "timestamps.txt").write_text("".join(f"2011-09-26 13:02:{k:02d}.500000000\n" for k in range(3)))
    got = records.read_records(spark, str(tmp_path)).orderBy("id").collect()
    plain = src.read_oxts(spark, str(tmp_path / "data"), str(tmp_path / "timestamps.txt")).orderBy("id").collect()
    assert [(r.id, r.ts, r.lat, r.alt, r.orimode) for r in got] == [(r.id, r.ts, r.lat, r.alt, r.orimode) for r in plain]
    (tmp_path / "timestamps.txt").write_text("2011-09-26 13:02:00.5\n")
    with pytest.raises(Exception, match="other times than records"):
        records.read_records(spark, str(tmp_path)).collect()
