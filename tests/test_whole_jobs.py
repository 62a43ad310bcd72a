"""Queries and operators that have to take in all of their input."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framelake.operators import lidar, ordered, tracks
from framelake.plans import catalog
from framelake.sources.adapters import Views, with_views
from framelake.streaming import live, run


def test_frames_and_sequences_are_whole(spark, data):
    d = f"{data}/sf0.001"
    v = Views(spark, d)
    samples, pixels, frames = v("samples").count(), v("pixels").count(), v("samples").select("frame").distinct().count()
    written = catalog.queries()["write_all_frames"](spark, d).agg(F.sum("n"), F.count("frmidx"), F.max("frmidx")).first()
    assert tuple(written) == (samples, frames, frames - 1)
    joined = catalog.queries()["concat_whole_sequences"](spark, d).agg(F.sum("n"), F.count("frame")).first()
    assert tuple(joined) == (2 * pixels, 2 * frames)


def _steps(values, n):
    m, out = 0.0, []
    for k, x in enumerate(values):
        m = (m * k + x) / (k + 1) if k < n else (m * n + x) / (n + 1)
        out.append(m)
    return out


def test_long_series_are_cut(spark):
    values = [float(k * 7919 % 101) for k in range(70)]
    d = spark.createDataFrame([(s, 3 * k, x) for s in (1, None) for k, x in enumerate(values)], "series long, ord long, v double")
    got = ordered.running_average(d, 2, chunk=4).collect()
    for s in (1, None):
        mine = sorted((r.ord, r.v, r.avg) for r in got if r.series == s)
        assert [r[:2] for r in mine] == [(3 * k, x) for k, x in enumerate(values)]
        assert [r[2] for r in mine] == pytest.approx(_steps(values, 2))
    days = d.where("series = 1").select("series", F.timestamp_seconds("ord").alias("ord"), "v")
    assert [r.avg for r in sorted(ordered.running_average(days, 2, chunk=4).collect(), key=lambda r: r.ord)] == pytest.approx(_steps(values, 2))
    gap = d.where("series = 1").withColumn("v", F.when(F.col("ord") != 60, F.col("v")))
    assert [r.avg is None for r in sorted(ordered.running_average(gap, 2, chunk=4).collect(), key=lambda r: r.ord)] == [k >= 20 for k in range(70)]


def test_streams_come_in_bounded_parts(spark, data):
    d, sizes = f"{data}/sf0.001", []
    stream = run.replay_in_order(spark, d, "firings", "pkt", width=100)

    def pick(df):
        sizes.append(df.groupBy("sensor").count().agg(F.max("count")).first()[0])
        return df

    got = run.finish(live.live_rotation_frames(stream, 9000), pick=pick)
    want = lidar.packet_frames(Views(spark, d)("firings"), seam=9000).select("sensor", "pkt", "frame")
    assert len(sizes) > 1 and max(sizes) <= 100
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parts_of_several_files(spark, data):
    """Files dealt out by key: still in order for each key, and a batch holds few rows of it."""
    d, sizes = f"{data}/sf0.001", []
    stream = run.replay_in_order(spark, d, "firings", "pkt", width=60, key="sensor", files=3)

    def pick(df):
        sizes.append(df.count())
        return df

    got = run.finish(live.live_rotation_frames(stream, 9000), pick=pick)
    want = lidar.packet_frames(Views(spark, d)("firings"), seam=9000).select("sensor", "pkt", "frame")
    assert len(sizes) > 1 and max(sizes) <= 2 * 3 * 60
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_parts_of_many_series_are_dealt_out(spark, data, tmp_path, monkeypatch):
    """All series lie in the first parts: their rows are in many files, no one has more than the part of a series beyond its share."""
    d, made = f"{data}/sf0.001", []

    def scratch(session, name):
        made.append(str(tmp_path / f"{name}{len(made)}"))
        return made[-1]

    monkeypatch.setattr(run, "scratch", scratch)
    change = lambda df: df.select("series", "ord", F.col("v").cast("double").alias("v"))
    stream = run.replay_in_order(spark, d, "signal", "ord", change, 30, key="series", files=None)
    rows = change(Views(spark, d)("signal"))
    files = spark.read.parquet(made[0]).groupBy(F.input_file_name().alias("f"), "__part").agg(F.count("*").alias("n"), F.countDistinct("series").alias("k")).collect()
    assert sum(r.n for r in files) == rows.count() and len(files) > 2 * len({r["__part"] for r in files})
    assert max(r.n for r in files) < max(rows.groupBy(F.floor(F.col("ord") / 30)).count().toPandas()["count"]) / 2
    got = run.finish(live.live_running_average(stream)).collect()
    want = ordered.running_average(rows).select("series", "ord", "avg").collect()
    assert [r[:2] for r in sorted(got)] == [r[:2] for r in sorted(want)]
    assert [r.avg for r in sorted(got)] == pytest.approx([r.avg for r in sorted(want)])


def test_a_batch_that_is_tried_again_is_there_once(spark, data, tmp_path):
    stream = run.replay_in_order(spark, f"{data}/sf0.001", "firings", "pkt", width=100)
    put, failed = run.batch_sink(str(tmp_path / "out")), []

    def flaky(df, batch):
        put(df, batch)
        if batch == 1 and not failed:
            failed.append(batch)
            raise RuntimeError("after writing")

    start = lambda: stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(flaky).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="after writing"):
        start().awaitTermination()
    start().awaitTermination()
    assert failed == [1]
    got, want = run.written(spark, str(tmp_path / "out")), Views(spark, f"{data}/sf0.001")("firings")
    assert sorted(map(tuple, got.select("sensor", "pkt").collect())) == sorted(map(tuple, want.select("sensor", "pkt").collect()))


def test_firings_are_numbered_in_parts(spark, data):
    """The view's numbers by days are those of one window for each sensor."""
    v = Views(spark, f"{data}/sf0.001")
    plain = spark.sql(with_views("SELECT sensor, pkt, azimuth, toh FROM firings", "firings").replace("FROM events", f"FROM parquet.`{data}/sf0.001/events.parquet`"))
    assert sorted(map(tuple, v("firings").select("sensor", "pkt", "azimuth", "toh").collect())) == sorted(map(tuple, plain.collect()))


def test_no_frame_ends_with_its_partition(spark):
    """Such a frame is computed anew for each row, which is quadratic in a series; what comes after is found in the reversed order."""
    d = spark.createDataFrame([(1, k, None if k % 3 else float(k * k)) for k in range(20)], "series long, ord long, v double")
    filled = ordered.interpolate_gaps(d)
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    got = {r.ord: (r.filled, r.distance) for r in filled.collect()}
    assert got[3] == (9.0, 0) and got[4] == (9.0 + 27 / 3, 1) and got[19] == (324.0, 1)
    for depth in (1, 2):
        near = tracks.neighbours(d.where("ord % 2 = 0").select(F.col("ord").alias("ts")), d.where("ord % 3 = 0").select(F.col("ord").alias("ts"), F.col("ord").alias("o")), ("o",), depth=depth, buckets=3)
        assert "unboundedfollowing" not in near._jdf.queryExecution().toString().lower()
        for r in near.collect():
            want = [r.ts // 3 * 3, r.ts // 3 * 3 + 3] + [r.ts // 3 * 3 - 3, r.ts // 3 * 3 + 6] * (depth - 1)
            names = ["p1", "n1", "p2", "n2"][: len(want)]
            assert [r[n].o if r[n] else None for n in names] == [w if 0 <= w <= 18 else None for w in want]


@pytest.mark.parametrize("name", ["ecef_to_gps", "interpolate_track", "gpx_for_frame", "ego_motion_compensate"])
def test_half_turns_and_whole_turns_are_those_of_the_sql(spark, tmp_path, name):
    """Records on opposite meridians (-26 and 154 degrees, a last digit off half a turn), and one at 1,005 degrees."""
    import duckdb

    rows = [(0, 0, 49, "signup", 3.0), (20, 300, 7, "click", 5.0), (30, 700, 8, "click", 6.0), (50, 1000, 229, "signup", 4.0), (70, 2000, 1080, "signup", 2.0)]
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s) AS ts", "user_id", "event_type", "value").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
    df = catalog.queries()[name](spark, str(tmp_path))
    want = sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalog.oracle_sql()[name]})").fetchall())
    got = sorted(map(tuple, df.collect()))
    assert len(got) == len(want) > 0
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=0.011)
