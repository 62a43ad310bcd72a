"""Hand-made tables, properties, and files."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from framelake.functions import formula
from framelake.functions import geometry as geo
from framelake.functions import pixels as px
from framelake.functions import scalar as sc
from framelake.operators import consensus, geodesic, joins, lidar, match, nearest, ordered, regression, select, stack, stats, thresholds, topk, tracks, warp
from framelake.plans.chains import STEPS, run_chain
from framelake.sources import catalog as src
from framelake.sources.adapters import Views
from framelake.sources.storage import cut


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.fixture(scope="module")
def two_frames(spark):
    data = [(0, 0, 0, 10.0, 1.0, True), (0, 0, 1, 20.0, 1.0, True), (0, 1, 0, 30.0, 0.0, True), (0, 1, 1, 40.0, 2.0, False), (1, 0, 0, 30.0, 3.0, True), (1, 0, 1, None, 1.0, True), (1, 1, 0, 50.0, 1.0, False), (1, 1, 1, 60.0, 2.0, False)]
    return spark.createDataFrame(data, "frame long, y int, x int, v double, w double, valid boolean")


def test_stacks(two_frames):
    by = ("y", "x")
    assert rows(stack.stack_average(two_frames, by), *by) == [(0, 0, 20.0, 2), (0, 1, 20.0, 1), (1, 0, 40.0, 2), (1, 1, 50.0, 2)]
    assert rows(stack.stack_masked_average(two_frames, by), *by)[3] == (1, 1, None, 0)
    assert rows(stack.stack_weighted_average(two_frames, by), *by) == [(0, 0, 25.0, 4.0), (0, 1, 20.0, 1.0), (1, 0, 50.0, 1.0), (1, 1, 50.0, 4.0)]
    assert rows(stack.dark_frame(two_frames, by), *by)[3] == (1, 1, 0.0, 0)


def test_resume_is_one_stack(two_frames):
    by = ("y", "x")
    a, b = two_frames.where("frame = 0"), two_frames.where("frame = 1")
    assert rows(stack.stack_resume(stack.weighted_sums(a, by), b, by), *by) == rows(stack.weighted_sums(two_frames, by), *by)


def test_stack_ignores_order_and_partitions(two_frames):
    by = ("y", "x")
    assert rows(stack.stack_average(two_frames.repartition(5).orderBy(F.rand(1)), by), *by) == rows(stack.stack_average(two_frames, by), *by)


def test_bayer(spark):
    d = spark.createDataFrame([(0, y, x, float(10 * y + x)) for y in range(2) for x in range(2)], "frame long, y int, x int, v double")
    assert [r[2] for r in rows(stack.bayer_average(d), "y", "x")] == ["R", "G", "G", "B"]


def test_running_average(spark):
    d = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate((1, 2, 3, 10))], "series long, ord long, v double")
    want = [1.0, 1.5, (1.5 * 2 + 3) / 3, ((1.5 * 2 + 3) / 3 * 2 + 10) / 3]
    assert [r[3] for r in rows(ordered.running_average(d, 2), "ord")] == pytest.approx(want)
    assert [r[3] for r in rows(ordered.running_average_series(d, 2), "ord")] == pytest.approx(want)


def test_gaps(spark):
    d = spark.createDataFrame([(0, i, v) for i, v in enumerate((None, 2.0, None, None, 8.0, None))], "series long, ord long, v double")
    assert [tuple(r)[3:] for r in rows(ordered.interpolate_gaps(d), "ord")] == [(2.0, 1), (2.0, 0), (4.0, 1), (6.0, 1), (8.0, 0), (8.0, 1)]


def test_ground_scan(spark):
    z = [0.0, -1.5, -2.1, -2.05, None, -0.5, -0.4, -0.3, -0.2, -0.1, -2.0]
    d = spark.createDataFrame([(0, 0, c, v) for c, v in enumerate(z)], "frame long, r int, c int, z double")
    assert [r[4] for r in rows(lidar.ground_scan(d), "c")] == [False, False, True, True, False, False, False, False, False, False, True]


def plain_mixture(depths):
    """The rules of the mixture for one cell, mode by mode; depths[n - 1] is 0 without a return."""
    modes, out = [], []
    for n, d in enumerate(depths, 1):
        frames = min(n, 200)
        e, updated, found = 1 / (frames + 1), -1, False
        if 0 < d < 1:
            out.append(False)
            continue
        if d > 0:
            near = 0
            for k in range(1, len(modes)):
                if abs(d - modes[k][1]) > abs(d - modes[near][1]):
                    break
                near = k
            if modes and (d - modes[near][1]) ** 2 < 25 * modes[near][2]:
                w, m, s = modes[near]
                modes[near] = [(1 - e) * w + e, (1 - e) * m + e * d, max((1 - e) * s + e * (d - m) ** 2, 0.01)]
                updated, found = near, modes[near][0] < 0.2
            else:
                found, before = True, modes[near][1] if modes else 0
                if len(modes) == 4:
                    oldest = min(range(4), key=lambda k: (modes[k][0], k))
                    del modes[oldest]
                    near -= near > oldest
                    before = modes[near][1] if near < len(modes) else before
                place = min(len(modes), near if d > before else near + 1)
                updated = place if modes else -1  # a first mode ages with the others
                modes.insert(place, [2 * e, d, 0.04])
        for k in range(len(modes) - 1, updated, -1):
            modes[k][0] *= frames / (1 + frames)
            if modes[k][0] < 1 / frames:
                del modes[k]
        for k in range(len(modes) - 1, 0, -1):
            (w1, m1, s1), (w2, m2, s2) = modes[k], modes[k - 1]
            if (m1 - m2) ** 2 <= 25 * (s1 + s2):
                modes[k - 1 : k + 1] = [[(w1 * w1 + w2 * w2) / (w1 + w2), (m1 * w1 + m2 * w2) / (w1 + w2), (s1 * w1 + s2 * w2) / (w1 + w2)]]
        out.append(found)
    return out, modes


def test_mixture_by_hand():
    """Insert in front and behind, decay, removal, replacement, fusion."""
    m, one = lidar.Mixtures(1), np.zeros(1, np.int64)
    # One depth in five frames: N = 1 leaves 1 * 1/2 < 1, N = 2 leaves 2/3 * 2/3 < 1/2, N = 3 leaves 1/2 * 3/4 >= 1/3.
    trace = [(bool(m.update(one, np.array([5.0]), n)[0]), int(m.n[0])) for n in range(1, 6)]
    assert trace == [(True, 0), (True, 0), (True, 1), (False, 1), (False, 1)] and m.w[0, 0] == pytest.approx((0.375 * 0.8 + 0.2) * 5 / 6 + 1 / 6)
    m = lidar.Mixtures(1)
    assert m.update(one, np.array([10.0]), 3)[0] and m.n[0] == 1 and m.w[0, 0] == 0.375  # 2 / (3 + 1), aged once
    assert not m.update(one, np.array([10.2]), 4)[0] and m.m[0, 0] == pytest.approx(10 + 0.2 / 5)  # fits, heavy
    assert m.update(one, np.array([40.0]), 5)[0] and m.m[0, :2].tolist() == pytest.approx([40.0, 10 + 0.2 / 5])  # more distant: in front
    w = m.w[0, :2].copy()
    m.pass_by(one, 6)
    assert m.w[0, :2].tolist() == pytest.approx((w * 6 / 7).tolist())
    m.update(one, np.array([0.5]), 7)
    assert m.w[0, :2].tolist() == pytest.approx((w * 6 / 7).tolist())  # nearer than 1: nothing happens
    for n in range(8, 700):
        m.update(one, np.array([40.0]), n)
    assert m.n[0] == 1 and m.w[0, 0] > 0.8  # what lies behind is seen no more and goes
    m = lidar.Mixtures(1)
    for n, d in enumerate((90.0, 70.0, 50.0, 30.0, 10.0), 200):
        assert m.update(one, np.array([d]), n)[0]
    assert m.n[0] == 4 and 10.0 in m.m[0]  # the weakest made room
    m = lidar.Mixtures(1)
    m.update(one, np.array([10.0]), 200)
    m.update(one, np.array([11.3]), 201)  # beyond 5 deviations of 0.2, within 25 (s1 + s2)
    assert m.n[0] == 1 and m.m[0, 0] == pytest.approx(10.65, abs=0.01)


def test_mixtures_of_many_cells(spark):
    rng = np.random.default_rng(4)
    depth = np.where(rng.random((60, 80)) < 0.15, 0.0, rng.choice([0.5, 5.0, 20.0, 35.0, 60.0, 90.0], (60, 80), p=[0.02, 0.08, 0.5, 0.1, 0.1, 0.2]) + rng.normal(0, 0.3, (60, 80)))
    want = [plain_mixture(depth[:, c].tolist())[0] for c in range(80)]
    state, got = lidar.Mixtures(80), []
    for n in range(60):
        got.append(state.update(np.arange(80), depth[n], n + 1))
    assert np.array(got).T.tolist() == want and 0.05 < np.mean(want) < 0.95
    # As a table, cells without a return having no row; frames count by their order.
    d = spark.createDataFrame([(n * 3, 0, c, float(depth[n, c])) for n in range(60) for c in range(80) if depth[n, c] > 0 or c == 0], "frame long, r int, c int, depth double")
    for r in lidar.motion_filter(d).collect():
        assert r["foreground"] == want[r["c"]][r["frame"] // 3]


def test_ground_scan_counts_missing_cells(spark):
    """5 cells without a return end the ground, whether they have rows or not; the roof line is 0.1 below zroof."""
    z = [-1.05, -2.0, -2.05, None, None, None, None, None, -2.0, -0.5, -2.1]
    want = [False, True, True, False, False, False, False, False, True, False, True]
    d = spark.createDataFrame([(0, 0, c, v) for c, v in enumerate(z)], "frame long, r int, c int, z double")
    assert [r[4] for r in rows(lidar.ground_scan(d), "c")] == want
    assert [r[4] for r in rows(lidar.ground_scan(d.where("z IS NOT NULL"), rings=11), "c")] == [w for w, v in zip(want, z, strict=True) if v is not None]
    line = spark.createDataFrame([(0, 0, c, v) for c, v in enumerate([-1.05, -1.9])], "frame long, r int, c int, z double")
    assert [r[4] for r in rows(lidar.ground_scan(line, h0=1.05), "c")] == [False, False]  # not below the roof, then not near


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_parts_of_an_order(spark, chunk):
    """Cut into parts of any size, the same as one window."""
    rng = np.random.default_rng(7)
    f = spark.createDataFrame([(s, p, int(rng.integers(0, 36000)), int(rng.integers(0, 3600)) * 1_000_000) for s in range(2) for p in range(40)], "sensor long, pkt long, azimuth long, toh long")
    w = Window.partitionBy("sensor").orderBy("pkt")
    sums = lambda c: F.sum(F.coalesce((F.col(c) < F.col(f"last_{c}")).cast("long"), F.lit(0))).over(w)
    plain = f.withColumns({"last_azimuth": F.lag("azimuth").over(w), "last_toh": F.lag("toh").over(w)}).select("sensor", "pkt", sums("azimuth").alias("frame"), (F.col("toh") / 1e6 + 3600 * sums("toh")).alias("t"))
    got = lidar.toh_unwrap(lidar.packet_frames(f, chunk=chunk), chunk=chunk).select("sensor", "pkt", "frame", "t")
    assert rows(got, "sensor", "pkt") == rows(plain, "sensor", "pkt")
    t = spark.createDataFrame([(k, int(rng.integers(0, 50)), float(rng.random()), float(rng.random())) for k in range(60)], "id long, ts long, lat double, lon double")
    one = tracks.track_summary(t, bucket=1e9).first()
    assert tuple(tracks.track_summary(t, bucket=float(chunk)).first()) == (one[0], one[1], pytest.approx(one[2]))
    track = t.withColumn("alt", F.lit(1.0))
    assert rows(src.export_rows(track, float(chunk)), "I") == rows(src.export_rows(track, 1e9), "I")
    assert [r[0] for r in rows(src.export_rows(track, float(chunk)), "I")] == list(range(60))


@pytest.mark.parametrize(("pivots", "part"), [(128, 20_000), (4, 3), (1, 1)])
def test_matching_by_indexes(spark, monkeypatch, pivots, part):
    monkeypatch.setattr(nearest.VoronoiIndex.__init__, "__defaults__", (pivots, part))
    rng = np.random.default_rng(11)
    vec, octave, size = rng.integers(0, 4, (40, 3)), rng.integers(0, 3, 40), rng.integers(0, 5, 40)
    d = spark.createDataFrame([(i, [float(x) for x in vec[i]], int(vec[i] @ (1, 8, 64)), int(octave[i]), int(size[i])) for i in range(40)], "id long, desc_vec array<double>, bits long, octave int, size int")
    q = d.where("id % 4 = 0")
    l1 = np.abs(vec[:, None] - vec[None]).sum(-1).astype(float)
    np.fill_diagonal(l1, np.inf)
    assert set(rows(match.match_l1(q, d, 2.0))) == {(i, j, l1[i, j]) for i in range(0, 40, 4) for j in range(40) if l1[i, j] == l1[i].min() <= 2}
    bits = vec @ (1, 8, 64)
    want = []
    for i in range(0, 40, 4):
        found = [(int(bits[i] ^ bits[j]).bit_count(), abs(int(size[i] - size[j])), j) for j in range(40) if i != j and abs(octave[i] - octave[j]) <= 1]
        if (best := min(found))[0] <= 3:
            want.append((i, best[2], best[0]))
    assert rows(match.match_hamming(q, d, 3, tie=("size",), max_octaves=1), "q") == want
    l2 = ((vec[:, None] - vec[None]) ** 2).sum(-1).astype(float)
    np.fill_diagonal(l2, np.inf)
    order = [sorted((l2[i, j], j) for j in range(40)) for i in range(0, 40, 4)]
    assert rows(match.match_knn_ratio(q, d, None), "q") == [(4 * k, o[0][1], pytest.approx(math.sqrt(o[0][0]))) for k, o in enumerate(order)]
    assert [r[0] for r in rows(match.match_knn_ratio(q, d, 0.8), "q")] == [4 * k for k, o in enumerate(order) if math.sqrt(o[0][0]) < 0.8 * math.sqrt(o[1][0])]
    assert match.match_l1(q.limit(0), d).count() == 0 and match.match_knn_ratio(q, d.limit(0)).count() == 0


def _clustered(spark, n=1500, groups=30):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(groups, 8))[rng.integers(0, groups, n)] + 0.01 * rng.normal(size=(n, 8))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(n, None)], "id long, desc_vec array<double>")


def test_pivots_rule_out_most_pairs(spark):
    x, d = _clustered(spark)
    q = d.where("id % 50 = 0")
    assert nearest.l1_candidates(q, d, 0.5, "desc_vec").count() < 0.2 * 30 * 1500
    l1 = np.abs(x[::50, None] - x[None]).sum(-1)
    l1[np.arange(30), np.arange(0, 1500, 50)] = np.inf
    assert rows(match.match_l1(q, d, 0.5), "q") == [(50 * i, int(l1[i].argmin()), pytest.approx(l1[i].min())) for i in range(30) if l1[i].min() <= 0.5]


def test_cells_hold_each_row_once(spark):
    """Rows are never copied; queries go to few of the cells, and the two nearest are exact, ratio or not."""
    x, d = _clustered(spark)
    index, q = nearest.VoronoiIndex(d, "desc_vec", 40, 20), d.where("id % 50 = 0")
    assert index.table.count() == index.table.select("id").distinct().count() == 1500
    cells = int((index.cells.rows > 0).sum())
    reached = index.sent(nearest._rows(q, "desc_vec").withColumn("radius", F.lit(0.1)), 2, True).select("id", "cell").distinct().count()
    assert cells > 10 and reached < 0.3 * 30 * cells
    l2 = ((x[::50, None] - x[None]) ** 2).sum(-1)
    l2[np.arange(30), np.arange(0, 1500, 50)] = np.inf
    two = np.argsort(l2, axis=1)[:, :2]
    got = rows(index.nearest(q, "desc_vec", 2).select("q", "r", "t"), "q", "r")
    assert got == [(50 * i, k + 1, int(two[i, k])) for i in range(30) for k in range(2)]
    plan = match.match_knn_ratio(q, d, 0.8)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_radius_grows_over_segments(spark):
    """Copies, ties, and codes that differ in one segment only or in all; those beyond the limit have no match."""
    rng = np.random.default_rng(9)
    code = rng.integers(0, 2**63, 400)
    code[100:200] = code[:100] ^ 1  # near copies
    code[200:230] = code[0]  # copies
    code[230:260] = code[1] ^ np.int64(0b1111111)  # seven bits of a segment
    code[260:290] = code[2] ^ np.int64(0x0101010101010101)  # a bit of each byte
    d = spark.createDataFrame([(i, int(c), i % 3) for i, c in enumerate(code)] + [(500, None, 1), (None, 5, 1)], "id long, bits long, octave int")
    q = d.where("id < 300")
    for limit, segments in ((9, 8), (9, 4), (3, 5)):
        got = {r["q"]: (r["best"]["dist"], r["best"]["t"]) for r in nearest.hamming_nearest(q, d, limit, "bits", segments=segments).collect()}
        want = {i: min((int(code[i] ^ code[j]).bit_count(), j) for j in range(400) if j != i) for i in range(300)}
        assert got == {i: w for i, w in want.items() if w[0] <= limit}


def test_queries_that_go_to_all_cells_go_in_small_batches():
    """3,000 queries with an open radius go to each of 128 cells: once each, and no batch holds more than a bounded number of them."""

    class Given:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            x = np.random.default_rng(4).normal(size=(3000, 8))
            columns = [pa.array(range(3000)), pa.array(x.tolist()), pa.array([math.inf] * 3000)]
            return [b.select(["id", "cell"]) for b in run(iter([pa.RecordBatch.from_arrays(columns, names=["id", "v", "radius"])]))]

    cells = nearest.Cells(np.random.default_rng(3).normal(size=(128, 8)))
    cells.rows[:], cells.near[:], cells.far[:] = 10, 0, 9
    first, again = (nearest._sent(Given(), cells, 1, second) for second in (False, True))
    assert max(b.num_rows for b in first + again) <= 4096
    sent = [pair for b in first + again for pair in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(sent) == len(set(sent)) == 3000 * 128


@pytest.mark.parametrize("kind", ["similarity", "affine"])
def test_fits_are_unmoved_by_outliers(spark, kind):
    """Three tenths of the pairs are far off; the fit is that of the others alone. Groups without a sample have no row."""
    rng = np.random.default_rng(3)
    m = np.array([[0.9, -0.3, 5.0], [0.3, 0.9, -7.0]] if kind == "similarity" else [[1.2, -0.1, 5.0], [0.4, 0.8, -7.0]])
    pairs = []
    for g in (1, 2):
        x = rng.uniform(0, 500, (200, 2))
        y = x @ m[:, :2].T + m[:, 2] + rng.normal(0, 0.1, (200, 2))
        wrong = np.arange(200) % 10 < 3
        y[wrong] += rng.uniform(30, 300, (60, 2))
        pairs += [(g, k, *map(float, a), *map(float, b), bool(w)) for k, (a, b, w) in enumerate(zip(x, y, wrong, strict=True))]
    pairs += [(3, 0, 1.0, 1.0, 2.0, 2.0, False), (4, 0, 1.0, 1.0, 2.0, 2.0, False), (4, 1, 1.0, 1.0, 3.0, 2.0, False), (4, 2, 1.0, 1.0, 3.0, 2.0, False)]
    d = spark.createDataFrame(pairs, "frame long, k long, x0 double, y0 double, x1 double, y1 double, wrong boolean")
    found = consensus.inliers(d, kind, [F.xxhash64("k"), "k"])
    assert {(r["frame"], r["k"]) for r in found.collect()} == {(g, k) for g in (1, 2) for k in range(200) if k % 10 >= 3}
    fit = {"similarity": consensus.consensus_similarity, "affine": consensus.consensus_affine}[kind](d, [F.xxhash64("k"), "k"])
    plain = {"similarity": match.estimate_similarity, "affine": match.estimate_affine}[kind](d.where("NOT wrong AND frame < 3"))
    assert [tuple(r) for r in rows(fit, "frame")] == [tuple(pytest.approx(v) for v in r) for r in rows(plain, "frame")]


@pytest.mark.parametrize("tile", [3, 128])
def test_reconstruction_in_tiles(spark, tile):
    """A winding way through many tiles, holes of one frame, missing cells: as by spreading over the whole grid."""
    v = np.full((13, 13), 9.0)
    for k in range(0, 13, 4):  # a way of low cells back and forth
        v[k, :] = 1.0
        v[k : k + 4, 12 if k % 8 == 0 else 0] = 1.0
    v[6, 6] = 2.0  # a hole
    cells = [(f, y, x, float(v[y, x]) + f) for f in range(2) for y in range(13) for x in range(13) if (f, y, x) != (1, 5, 5)]
    d = spark.createDataFrame(cells, "frame long, y int, x int, v double")
    for eight in (False, True):
        got = {(r["frame"], r["y"], r["x"]): r["m"] for r in geodesic.geo_fill_holes(d, eight, tile).collect()}
        for f in range(2):
            own = {(y, x): 9 + f - c for g, y, x, c in cells if g == f}
            m = {k: c if k[0] in (0, 12) or k[1] in (0, 12) else 0.0 for k, c in own.items()}
            while True:
                near = lambda k: [m[k[0] + i, k[1] + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if (eight or not (i and j)) and (k[0] + i, k[1] + j) in m]  # noqa: E731, B023
                new = {k: min(own[k], max(near(k))) for k in m}
                if new == m:
                    break
                m = new
            assert {k: got[f, *k] for k in own} == {k: 9 + f - c for k, c in m.items()}
    assert got[0, 6, 6] == 9.0 and got[0, 0, 6] == 1.0


def test_reconstruction_goes_any_way_in_few_steps(spark, monkeypatch):
    """A marker at the end of a line of 50 tiles reaches what lies before a cell without a limit; tables grow with the logarithm of the tiles."""
    made = []

    def counted(df, name):
        made.append(name)
        assert len(made) <= 5
        return cut(df, name)

    monkeypatch.setattr(geodesic, "cut", counted)
    limit = [9.0 - x % 4 for x in range(150)]
    cells = [(f, 0, x, 8.0 if x == 149 else float(x % 2), None if (f, x) == (1, 70) else limit[x]) for f in (0, 1, None) for x in range(150)]
    d = spark.createDataFrame(cells, "frame long, y int, x int, marker double, limit double")
    got = {(r["frame"], r["x"]): r["marker"] for r in geodesic.reconstruct(d, tile=3).collect()}
    assert got == {(f, x): float(x < 70) if f == 1 and x <= 70 else 6.0 if x < 148 else 8.0 for f in (0, 1, None) for x in range(150)}


def test_dense_tracks_fill_no_single_bucket(spark):
    """Nearly all records of a track in one second: buckets between its quantiles hold a few each; the neighbours are those of wide buckets."""
    rec = [(1, 1000 + k / 5000) for k in range(5000)] + [(1, 86_400.0 * k) for k in range(2, 60)] + [(2, 50.0 * k) for k in range(40)] + [(None, 3.0)]
    records = spark.createDataFrame([(b, t, k) for k, (b, t) in enumerate(rec)], "track long, ts double, v long")
    asked = [(1, 900.0), (1, 1000.5), (1, 1000.50005), (1, 999_999.0), (1, 9e9), (2, -5.0), (2, 60.0), (2, 1950.0), (3, 1.0), (None, 2.0)]
    q = spark.createDataFrame([(b, t, k) for k, (b, t) in enumerate(asked)], "track long, ts double, id long")
    _, held = tracks._bucketed(q, records, "ts", ["track"], None, 64)
    assert held.groupBy("track", "__k").count().agg(F.max("count")).first()[0] <= 2 * 5058 / 64
    assert held.where("track = 1").select("__k").distinct().count() >= 50
    order = held.groupBy("track", "__k").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).where("track = 1").orderBy("__k").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:], strict=False))
    for depth in (1, 2):
        plain, cut = (rows(tracks.neighbours(q, records, ["v"], by=["track"], bucket=b, depth=depth, buckets=64), "id") for b in (1e12, None))
        assert plain == cut and len(cut) == len(asked)


def test_fits_per_key(spark):
    """Against NumPy, weights and nulls included; keys that don't determine a fit have no row."""
    rng = np.random.default_rng(4)
    data = [(s, float(x), float(2 + 0.5 * x - 0.1 * x * x + e), float(w)) for s in (1, 2) for x, e, w in zip(rng.uniform(-5, 9, 60), rng.normal(0, 0.3, 60), rng.integers(1, 5, 60), strict=True)]
    d = spark.createDataFrame([*data, (1, None, 3.0, 1.0), (2, 1.0, None, 1.0), (2, 1.0, 1.0, None), (3, 4.0, 5.0, 1.0), (4, 2.0, 1.0, 1.0), (4, 2.0, 3.0, 1.0)], "series long, x double, y double, w double")
    line = {r["series"]: r for r in regression.line_fit(d, weight="w").collect()}
    quad = {r["series"]: r for r in regression.quadratic_fit(d, weight="w").collect()}
    slope = {r["series"]: r for r in regression.slope_fit(d, weight="w").collect()}
    two = {r["series"]: r for r in regression.two_factor_fit(d.withColumn("x1", F.col("x") * F.col("x")), x0="x", x1="x1", weight="w").collect()}
    assert set(line) == set(quad) == set(two) == {1, 2} and set(slope) == {1, 2, 3, 4} and slope[3]["slope"] == pytest.approx(1.25)
    for s in (1, 2):
        x, y, w = (np.array(c) for c in zip(*((x, y, w) for k, x, y, w in data if k == s), strict=True))
        k = np.sqrt(w)
        fit = lambda columns: np.linalg.lstsq(np.stack(columns, 1) * k[:, None], y * k, rcond=None)[0]  # noqa: E731, B023
        one = np.ones_like(x)
        assert (line[s]["shift"], line[s]["slope"]) == pytest.approx(tuple(fit([one, x]))) and line[s]["n"] == 60
        rss = (w * (y - line[s]["shift"] - line[s]["slope"] * x) ** 2).sum()
        assert line[s]["stdev2"] == pytest.approx(rss / w.sum()) and line[s]["r2"] == pytest.approx(1 - rss / (w * (y - np.average(y, weights=w)) ** 2).sum())
        assert [quad[s][f"a{i}"] for i in range(3)] == pytest.approx(fit([one, x, x * x]).tolist())
        assert slope[s]["slope"] == pytest.approx(fit([x])[0]) and (two[s]["a0"], two[s]["a1"]) == pytest.approx(tuple(fit([x, x * x])))


def test_median_by_digits(spark):
    """Of groups of odd and even size, with ties, signs, zeros, infinities and nulls, and over all rows."""
    rng = np.random.default_rng(12)
    groups = {
        "odd": rng.normal(size=501).tolist(), "even": rng.normal(size=500).tolist(), "one": [3.0], "two": [1.0, 2.0], "powers": [2.0**k for k in range(-300, 300)], "ties": [5.0] * 40 + [7.0] * 40,
        "signs": [-3.0, -2.0, -0.0, 0.0, 1e-310, 4.0], "inf": [float("-inf"), 1.0, float("inf")], "close": [1 + k * 2.0**-50 for k in range(99)], "nulls": [None, 1.0, None, 9.0], "none": [None], None: [1.0, 5.0],
    }
    d = spark.createDataFrame([(g, v) for g, x in groups.items() for v in x], "g string, v double")
    got = {r["g"]: r["median"] for r in stats.frame_median(d, ("g",)).collect()}
    plain = lambda x: float(np.median(x)) if x else None
    assert got == {g: plain([v for v in x if v is not None]) for g, x in groups.items()}
    every = [v for x in groups.values() for v in x if v is not None]
    assert stats.frame_median(d, ()).first()[0] == plain(every)
    assert stats.frame_median(d.limit(0), ("g",)).count() == 0


def test_random_functions(spark):
    d = formula.formula(formula.formula(spark.range(20_000), "rand(2, 5)", "u"), "noise(10, 3)", "g")
    r = d.agg(F.min("u"), F.max("u"), F.avg("u"), F.avg("g"), F.stddev("g")).first()
    assert 2 <= r[0] < 2.01 and 4.99 < r[1] < 5 and r[2] == pytest.approx(3.5, abs=0.05) and r[3] == pytest.approx(10, abs=0.15) and r[4] == pytest.approx(3, abs=0.15)
    d = spark.range(1000).withColumn("k", F.col("id") * 2)
    one, two, other = (rows(formula.formula(x, "rand(0, 1) + rand(0, 1)", "u", seed, ["id"]).select("id", "u"), "id") for x, seed in ((d, 1), (d.repartition(7, "k"), 1), (d, 2)))
    assert one == two != other and len({u for _, u in one}) == 1000  # by seed and key, not by partition
    assert np.corrcoef([u for _, u in one], [u for _, u in other])[0, 1] == pytest.approx(0, abs=0.12)


def test_every_step_of_chains_runs(spark, caplog):
    """Each by name, in any case, with the least it needs; none is left out."""
    d = spark.createDataFrame([(f, y, x, float(f + y * x % 7), 1.0, True, 1.0 * x, 2.0 * y, 3.0, x, 0.5 * x, float(y)) for f in range(2) for y in range(6) for x in range(6)],
                              "frame long, y int, x int, v double, w double, valid boolean, v0 double, v1 double, v2 double, ord int, dx double, dy double")
    d = d.withColumns({"series": F.col("frame") * 10 + F.col("y"), "sharpness": F.col("v"), "azimuth": F.col("v0") / 10, "laser_ring": F.col("y"), "depth": F.col("v"), "sel": F.lit(True), "c": F.lit(0), "kp": F.col("x"), "response": F.col("v"), "q": F.col("v"), "label": F.col("y"), "area": F.col("x") + 4, "n": F.col("x"), "a": F.col("v0") + 1, "b": F.col("v1") + 1, "elongation": F.lit(1.0)})
    needs = {
        "push": {"name": "k"}, "pop": {"name": "kept"}, "filter": {"expr": "v > 1"}, "column": {"name": "z", "expr": "v + 1"}, "clip": {"low": 0, "high": 3}, "average": {"by": ["y", "x"]}, "threshold": {"limit": 2}, "combine_selection": {"mode": "OR", "new": "v > 2"},
        "pixel_func": {"name": "sqrt"}, "math_expression": {"expr": "v + x"}, "frame_calc": {"other": "kept", "name": "add", "on": ["frame", "y", "x"]}, "merge": {"other": "kept"}, "select": {"exprs": ["frame", "v"]},
        "neighbourhood_average": {"r": 1, "axis": "y"}, "gradient": {"axis": "y"}, "convolve_1d": {"kernel": [0.25, 0.5, 0.25]}, "lowpass": {"sigma": 1.0}, "dog": {"s1": 1.0, "s2": 2.0}, "highpass": {"sigma": 1.0}, "rolling_median": {"r": 1}, "median_hat": {"r": 1},
        "median_outlier_replace": {"k": 3.0}, "morph": {"op": "open", "axes": ["x", "y"]}, "local_minmax": {"r": 1}, "local_peak": {"r": 1}, "local_variance": {"r": 1}, "frame_interval": {"by": ["y", "x"], "ts": "frame"}, "dropped_frames": {"by": ["y"], "index": "frame"},
        "bad_rows": {"threshold": 1.0}, "select_pixels": {"expr": "v > 1"}, "line_profile": {"x0": 0, "y0": 0, "x1": 5, "y1": 5}, "point_expression": {"expr": "v + 1", "out": "z"}, "color_saturation": {"scale": 0.5}, "range_normalize": {"omin": 0, "omax": 1},
        "normalize_mean_stdev": {"k": 1.0, "omin": 0, "omax": 1}, "flow_to_hsv": {"dx": "dx", "dy": "dy"}, "crop": {"x": 1, "y": 1, "width": 3, "height": 3}, "flip": {"width": 6, "height": 6}, "rotate90": {"width": 6, "height": 6}, "grid_downsample": {"k": 2},
        "range_bin": {"resolution": 0.1}, "saturate": {"depth": "8u"}, "convert_depth": {"to": "8u"}, "to_unit_float": {"bpp": 8}, "pow_gamma": {"gamma": 2.0}, "extract_channel": {"mode": "max"}, "reduce_channels": {"kind": "avg"}, "color_diff": {"channel": 1}, "color_balance": {"alpha": 0.1},
        "scale_channels": {"stretch": [1, 2, 3], "shift": [0, 0, 1]}, "convert_color": {"kind": "hsv"}, "desaturate_shadows": {"wmin": 0.1, "wmax": 0.5}, "histogram": {"minv": 0.0, "maxv": 8.0, "bins": 4}, "top_keypoints": {"n": 2}, "best_percent": {"p": 50},
        "drop_parasitic_returns": {}, "clear_mask": {}, "interpolate_gaps": {}, "rank_frames": {},
    }
    failed = {}
    for name in sorted(STEPS):
        caplog.clear()
        run_chain(d, [{"step": name.upper(), **needs.get(name, {})}], {"kept": d})
        if caplog.records:
            failed[name] = caplog.records[0].getMessage()[:200]
    assert failed == {} and len(STEPS) > 75


def test_chain_goes_on_after_a_failing_step(spark, two_frames):
    got = run_chain(two_frames, [{"step": "filter", "expr": "no_such_column > 1"}, {"step": "column", "name": "k", "expr": "v * 2"}, {"step": "pop", "name": "nothing"}])
    assert got.columns[-1] == "k" and got.count() == two_frames.count()


def test_histogram_and_thresholds(spark):
    values = [10.0] * 50 + [12.0] * 30 + [200.0] * 40 + [205.0] * 60
    d = spark.createDataFrame([(0, v) for v in values], "frame long, v double")
    h = stats.histogram(d, ("frame",), bins=32)
    assert h.count() == 32 and h.agg(F.sum("n")).first()[0] == len(values)
    for f in (thresholds.otsu_threshold, thresholds.isodata_threshold, thresholds.huang_threshold, thresholds.yen_threshold, thresholds.moments_threshold, thresholds.minimum_threshold):
        t = f(h, ("frame",), 32).first()["threshold"]
        assert 10 <= t < 205, f.__name__
    assert stats.histogram_mode(h, ("frame",), 32).count() == 1


def test_triangles_match_a_moved_copy(spark):
    pts = [(1, 0, 0), (2, 100, 7), (3, 40, 80), (4, 130, 55), (5, 77, 150)]
    moved = [(k + 10, -y + 300, x + 20) for k, x, y in pts]
    a = spark.createDataFrame([(0, *p) for p in pts], "frame int, kp long, x long, y long")
    b = spark.createDataFrame([(1, *p) for p in moved], "frame int, kp long, x long, y long")
    m = match.match_triangles(match.triangle_descriptors(a), match.triangle_descriptors(b), 1e-6)
    assert [(p, q) for p, q, _ in rows(m, "p")] == [(k, k + 10) for k in range(1, 6)]
    pairs = match.matched_positions(m.select(F.col("p").alias("q"), F.col("q").alias("t")), a, b).withColumn("frame", F.lit(0))
    s = match.estimate_similarity(pairs).first()
    assert (s["scale"], s["angle"], s["tx"], s["ty"]) == pytest.approx((1.0, math.pi / 2, 300.0, 20.0))
    f = match.estimate_affine(pairs).first()
    assert tuple(f)[1:] == pytest.approx((0, -1, 300, 1, 0, 20), abs=1e-9)


def test_track_interpolation_wraps(spark):
    t = spark.createDataFrame([(0.0, 0.0, 3.1, 0.0, 0.0, 0.0, 3.0), (10.0, 1.0, -3.1, 10.0, 0.0, 0.0, -3.0), (90_000.0, 2.0, -3.0, 20.0, 0.0, 0.0, -2.9)], "ts double, lat double, lon double, alt double, roll double, pitch double, yaw double")
    q = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, 180_000.0), (4, 10.0), (5, 45_005.0)], "id long, ts double")
    got = {r["id"]: r for r in tracks.interpolate_track(q, t, bucket=100.0).collect()}
    assert got[1]["alt"] == 5.0 and abs(got[1]["lon"]) == pytest.approx(math.pi, abs=1e-6) and got[1]["ok"]
    assert got[2]["alt"] == -1.0 and not got[2]["ok"]
    assert got[3]["alt"] == pytest.approx(20 + 90_000 * 10 / 89_990) and not got[3]["ok"]
    assert got[4]["alt"] == 10.0 and got[5]["alt"] == pytest.approx(10 + 44_995 * 10 / 89_990)


def test_toh_and_frames(spark):
    d = spark.createDataFrame([(0, 1, 100, 3_599_000_000), (0, 2, 20_000, 3_599_500_000), (0, 3, 50, 500_000)], "sensor long, pkt long, azimuth long, toh long")
    assert [r[4] for r in rows(lidar.toh_unwrap(d), "pkt")] == [3599.0, 3599.5, 3600.5]
    assert [r[4] for r in rows(lidar.packet_frames(d), "pkt")] == [0, 0, 1]


def test_file_names(spark):
    d = spark.createDataFrame([("/a/x-20240102_030405_GMT.SER",), ("b.noext/file",), ("c.GPX",), ("20241399_000000_GMT.ser",)], "p string")
    got = d.select(src.source_kind("p"), F.unix_timestamp(src.timestamp_from_filename("p"))).collect()
    assert [tuple(r) for r in got] == [("ser", 1704164645), ("unknown", None), ("track", None), ("ser", None)]


def test_files(spark, tmp_path):
    (tmp_path / "vel").mkdir()
    for k in range(2):
        (tmp_path / "vel" / f"00{k}.bin").write_bytes(struct.pack("<8f", *(k + i for i in range(8))))
    assert rows(src.read_velodyne_bin(spark, str(tmp_path / "vel")), "frame", "pid")[3] == (1, 1, 5.0, 6.0, 7.0, 8.0)
    (tmp_path / "a.gpx").write_text('<gpx><trk><trkseg><trkpt lat="45.0" lon="90.0"><ele>5</ele><time>1970-01-01T00:00:10Z</time></trkpt><trkpt lat="1" lon="2"/></trkseg></trk></gpx>')
    assert rows(src.read_gpx_xml(spark, str(tmp_path / "a.gpx"))) == [(10.0, pytest.approx(math.pi / 4), pytest.approx(math.pi / 2), 5.0)]
    (tmp_path / "l.csv").write_text("Time,Seconds_Elapsed,Latitude,Longitude,Altitude\n# c\n1000,1.5,90,180,3\n/x,1,2,3,4\n1000,2.5,x,180,3\n")
    assert rows(src.read_gps_csv(spark, str(tmp_path / "l.csv"))) == [(1.5, pytest.approx(math.pi / 2), pytest.approx(math.pi), 3.0)]
    (tmp_path / "oxts").mkdir()
    (tmp_path / "oxts" / "0.txt").write_text("45 90 " + " ".join(map(str, range(28))))
    (tmp_path / "ts.txt").write_text("1970-01-01 00:00:02.500000000\n")
    o = src.read_oxts(spark, str(tmp_path / "oxts"), str(tmp_path / "ts.txt")).first()
    assert (o["ts"], o["lat"], o["alt"], o["roll"]) == (2.5, pytest.approx(math.pi / 4), 0.0, 1.0)
    (tmp_path / "bad.txt").write_text("3\nx\n5\n")
    assert rows(src.read_bad_frames(spark, str(tmp_path / "bad.txt")), "frame") == [(3,), (5,)]


def test_sinks(spark, tmp_path, two_frames, data):
    src.write_frames(two_frames.withColumn("frame", F.col("frame") * 7), str(tmp_path / "f"))
    assert rows(spark.read.parquet(str(tmp_path / "f/mapping")), "seqidx") == [(0, 0), (7, 1)]
    assert spark.read.parquet(str(tmp_path / "f/frames")).where("frmidx = 1").count() == 4
    v = Views(spark, f"{data}/sf0.001")
    src.export_track(v("track"), str(tmp_path / "t"))
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "t")).count() == v("track").count()
    src.write_points(v("lidar_points"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == v("lidar_points").count()
    m = spark.createDataFrame([(1, 2, 0, 0, 1, 1)], "q long, t long, x0 long, y0 long, x1 long, y1 long")
    src.write_matches_csv(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).columns == ["q", "t", "x0", "y0", "x1", "y1"]


def test_seek_and_index_agree(spark):
    s = spark.createDataFrame([("a", 0, 5), ("b", 1, 0), ("c", 2, 3)], "src string, ord long, n_frames long")
    cat = src.sequence_catalog(s)
    assert rows(src.seek(spark.createDataFrame([(0,), (4,), (5,), (7,), (8,), (-1,)], "pos long"), cat, 2), "pos") == [(0, "a", 0), (4, "a", 4), (5, "c", 0), (7, "c", 2)]
    assert rows(src.global_frame_index(spark.createDataFrame([("c", 2), ("c", 3), ("b", 0)], "src string, local long"), cat)) == [("c", 2, 7)]


def test_selection_de_morgan(spark):
    d = spark.createDataFrame([(a, b) for a in (True, False) for b in (True, False)], "a boolean, b boolean")
    c = lambda m: select.combine_selection(F.col("a"), F.col("b"), m)
    assert all(r[0] for r in d.select(c("NAND") == (~F.col("a") | ~F.col("b"))).collect())
    assert all(r[0] for r in d.select(c("NOR") == (~F.col("a") & ~F.col("b"))).collect())


def test_tiles_and_earth(spark):
    d = spark.createDataFrame([(48.2, 16.4), (-33.9, 151.2), (89.0, -180.0)], "lat double, lon double")
    x, y = geo.geo_tile("lat", "lon", 10)
    assert all(r[0] for r in d.select(geo.tile_contains(6, *geo.tile_parent(x, y, 4), 10, x, y)).collect())
    assert d.select(geo.quadkey(F.lit(3), F.lit(5), 3)).first()[0] == "213"
    assert d.select(geo.geodesic_meters(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(math.pi))).first()[0] == pytest.approx(math.pi * 6378137)


def test_formulas(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).first()[0]
    assert v(sc.fractional_year(F.lit(2024), F.lit(12), F.lit(31))) == pytest.approx(2024 + 365 / 366)
    assert v(sc.fractional_year(F.lit(2023), F.lit(2), F.lit(30))) == 0
    assert v(sc.fmax(F.lit(float("nan")), F.lit(2.0))) == 2.0
    assert v(sc.wrap_pi(F.lit(-math.pi))) == pytest.approx(math.pi)
    assert v(px.mtf(F.lit(0.5), midtones=0.3)) == pytest.approx(0.3, abs=1e-6)
    assert v(px.anscombe_inverse(px.anscombe(F.lit(7.0)))) == pytest.approx(7.0)


def test_tops(spark):
    q = spark.createDataFrame([(i, float(i % 7)) for i in range(300)], "frame long, q double")
    assert rows(topk.master_frame(q)) == [(104,)]
    assert rows(topk.master_frame(q, full_window=True)) == [(104,)]
    assert topk.best_percent(q, 10).count() >= 1


def test_chain_stops_at_errors(spark, two_frames):
    with pytest.raises(KeyError):
        run_chain(two_frames, [{"step": "no such step"}])
    frames = {}
    run_chain(two_frames, [{"step": "push", "name": "a"}], frames)
    assert list(frames) == ["a"]


def test_annotations_keep_old_labels(spark):
    points = spark.createDataFrame([(0, 1, 5.0, 5.0, 2.0), (0, 2, 50.0, 5.0, 2.0), (0, 3, 6.0, 6.0, 9.0)], "frame long, pid long, x double, y double, depth double")
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 10.0, 1.0, 3.0, "k", 4)], "frame long, x0 double, y0 double, x1 double, y1 double, depth0 double, depth1 double, cmap string, label int")
    labels = spark.createDataFrame([(1, "k", 2), (2, "k", 0)], "pid long, cmap string, label int")
    assert rows(joins.annotate_points(points, boxes, labels), "pid") == [(1, "k", 2), (2, "k", 0)]
    assert rows(joins.annotate_points(points, boxes, labels, overwrite=True), "pid") == [(1, "k", 4), (2, "k", 0)]


def test_bessel_functions():
    x = np.array([1e-3, 0.5, 1.0, 7.0, 24.9, 25.1, 300.0, 5000.0])
    (j0, y0), (j1, y1) = sc.bessel(0, x), sc.bessel(1, x)
    np.testing.assert_allclose(j1 * y0 - j0 * y1, 2 / (np.pi * x), rtol=1e-9)
    np.testing.assert_allclose([j0[2], j1[2], y0[2], y1[2]], [0.7651976865579666, 0.4400505857449335, 0.08825696421567698, -0.7812128213002887], rtol=1e-12)
    np.testing.assert_array_equal(sc.bessel(1, np.array([0.0, -2.0, np.nan]))[1], [-np.inf, np.nan, np.nan])
    assert sc.bessel(1, np.array([-2.0]))[0][0] == -sc.bessel(1, np.array([2.0]))[0][0]
    assert sc.bessel(0, np.array([np.inf]))[0][0] == 0.0 and len(sc.bessel(0, np.zeros(0))[0]) == 0


def test_special_functions(spark):
    sc.register_special(spark)
    df = spark.createDataFrame([(1.0, 2.0), (0.0, -1.0), (None, 1.0)], "x double, y double").coalesce(1)
    got = df.selectExpr("nextafter(x, y) AS n", "erf(x) AS e", "j0(x) AS j", "y0(x) AS k").collect()
    assert (got[0].n, got[1].n) == (math.nextafter(1.0, 2.0), math.nextafter(0.0, -1.0))
    assert got[0].e == math.erf(1.0) and got[1].j == pytest.approx(1.0) and got[1].k == -math.inf
    assert all(v is None or v != v for v in got[2])


@pytest.mark.parametrize("kind", ["semi_quadratic", "quadratic"])
def test_curved_fits_reject_outliers(spark, kind):
    """As by least squares over all pairs, pass by pass; points in a line, few points and nulls."""
    rng, size = np.random.default_rng(11), warp.TERMS[kind]
    a = np.array([[0.9, -0.2, 30, 1e-4, 2e-5, -3e-5], [0.25, 1.1, -12, -2e-4, 1e-5, 4e-5]])[:, :size]
    terms = lambda p: np.stack([p[:, 0], p[:, 1], np.ones(len(p)), p[:, 0] * p[:, 1], p[:, 0] ** 2, p[:, 1] ** 2][:size], axis=1)
    pairs, want = [], {}
    for g in (1, 2):
        x = rng.uniform(0, 4000, (300, 2))
        y = terms(x) @ a.T + rng.normal(0, 0.3, (300, 2))
        if g == 2:
            y[::12] += rng.uniform(50, 900, (25, 2))
        pairs += [(g, *map(float, p), *map(float, q)) for p, q in zip(x, y, strict=True)]
        left = np.ones(300, bool)
        while True:
            z = terms(x / 4000)
            c = np.linalg.lstsq(z[left], y[left], rcond=None)[0]
            off = ((z @ c - y) ** 2).sum(axis=1)
            new = left & (off <= 9 * off[left].sum() / (2 * left.sum()))
            if (new == left).all():
                break
            left = new
        want[g] = left.sum(), c
    pairs += [(3, float(k), 2.0 * k, 1.0, float(k)) for k in range(20)]  # a line
    pairs += [(4, 1.0, 2.0, 3.0, 4.0), (5, None, 2.0, 3.0, 4.0), (1, 1.0, 2.0, None, 4.0), (1, float("nan"), 2.0, 3.0, 4.0), (1, 0.0, 0.0, float("inf"), 4.0)]
    d = spark.createDataFrame(pairs, "frame long, x0 double, y0 double, x1 double, y1 double")
    out = {r["frame"]: r for r in warp.estimate_warp(d, kind).collect()}
    assert set(out) == {1, 2}
    probe = rng.uniform(0, 4000, (50, 2))
    for g, (n, c) in want.items():
        got = np.array([[out[g][f"a{k}{i}"] for i in range(size)] for k in (0, 1)])
        assert out[g]["n"] == n and np.allclose(terms(probe) @ got.T, terms(probe / 4000) @ c, atol=1e-6)
    assert want[2][0] <= 275 and np.allclose(terms(probe) @ a.T, terms(probe / 4000) @ want[2][1], atol=0.3)
    assert warp.estimate_warp(d.limit(0), kind).count() == 0


def test_l1_leaves_parts_with_few_rows(spark):
    """Of vectors that no pivot rules out only the nearest of each part go on, not all pairs; rows alike are dealt out and all found."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    x[300:900] = x[300]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, desc_vec array<double>")
    q = d.where("id % 50 = 0 AND (id < 300 OR id >= 850)")
    found = nearest.l1_nearest(q, d, 100.0, "desc_vec", 9, part=100)
    l1 = np.abs(x[:, None] - x[None]).sum(-1)
    np.fill_diagonal(l1, np.inf)
    want = {(i, int(j)) for i in range(0, 1500, 50) if i < 300 or i >= 850 for j in np.flatnonzero(l1[i] <= l1[i].min() + 1e-9)}
    assert found.where("q <> 850").count() <= 30 * 15 + 600 * 15
    assert {r[:2] for r in rows(match.match_l1(q, d, 100.0))} == want and len(want) > 599


def test_nearest_points_meet_few(spark, monkeypatch):
    """Dense points: as by brute force, ties by the smaller pid, and a far query goes on to coarser grids. No join makes all pairs of a cell."""
    rng = np.random.default_rng(3)
    xy = rng.integers(0, 60, (4000, 2))
    p = spark.createDataFrame([(int(i % 2), i, int(a), int(b)) for i, (a, b) in enumerate(xy)], "frame long, pid long, x long, y long")
    asked = [(0, 1, 30.5, 30.5), (1, 2, 100.0, 59.0), (0, 3, 500.0, 0.0), (1, 4, -70.0, 10.0), (0, 5, 12.0, 12.0)]
    q = spark.createDataFrame(asked, "frame long, qid long, x double, y double")
    want = []
    for f, k, x, y in asked:
        d, i = min(((x - a) ** 2 + (y - b) ** 2, i) for i, (a, b) in enumerate(xy) if i % 2 == f)
        if d <= 100.0**2:
            want.append((f, k, i, pytest.approx(math.sqrt(d))))
    sides = []
    monkeypatch.setattr(match, "cut", lambda d, name, cut=match.cut: sides.append(name) or cut(d, name))
    assert rows(match.nearest_point(p, q, 100.0), "qid") == want and len(want) == 4
    assert sides.count("nearest") > 2


def test_bessel_values_come_in_blocks(monkeypatch):
    """Equal values are computed once, and a call's work does not go value by value."""
    calls, sinh = [], np.sinh
    monkeypatch.setattr(sc.np, "sinh", lambda u: calls.append(1) or sinh(u))
    x = np.tile([0.0, -1.5, 2.5, 3.7, 12.0, 30.0, np.nan], 200)
    for n in (0, 1):
        first, second = sc.bessel(n, x)
        alone = [sc.bessel(n, np.array([v])) for v in x[:7]]
        assert np.allclose(first[:7], [a[0][0] for a in alone], atol=1e-12, equal_nan=True) and np.allclose(second[7:14], [a[1][0] for a in alone], atol=1e-12, equal_nan=True)
    assert len(calls) < 30


def test_dense_boxes_meet_points_once(spark):
    """Points of a full cell in several parts, most of them in hundreds of boxes: labels as by brute force, and no join of points with boxes."""
    rng = np.random.default_rng(4)
    xyd = rng.integers(0, 50, (600, 3))
    lows, label, kind = rng.integers(-10, 40, (300, 3)), rng.integers(1, 6, 300), rng.integers(0, 3, 300)
    p = spark.createDataFrame([(0, i, *map(int, r)) for i, r in enumerate(xyd)], "frame long, pid long, x long, y long, depth long")
    names = ["a", "b", None]
    b = spark.createDataFrame([(0, *map(int, lo[:2]), *(int(v) + 15 for v in lo[:2]), int(lo[2]), int(lo[2]) + 15, names[k], int(n)) for lo, k, n in zip(lows, kind, label, strict=True)], "frame long, x0 long, y0 long, x1 long, y1 long, depth0 long, depth1 long, cmap string, label int")
    got = joins.annotate_points(p, b, spark.createDataFrame([], "pid long, cmap string, label int"), part=100)
    holds = ((xyd[:, None] >= lows) & (xyd[:, None] <= lows + 15)).all(-1)
    want = {(i, names[k], int(label[(kind == k) & holds[i]].max())) for i in range(600) for k in range(3) if (holds[i] & (kind == k)).any()}
    assert set(rows(got)) == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().toString()
