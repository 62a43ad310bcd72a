"""Registered queries: tracks, matching, annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import geometry as geo
from framelake.operators import consensus, joins, match, topk, tracks, warp
from framelake.plans.base import reg, rounded

_ONE = "one AS (SELECT ts, min((lat, lon, alt, roll, pitch, yaw)) AS f FROM track GROUP BY ts)"
_FIELDS = ("lat", "lon", "alt", "roll", "pitch", "yaw")
_WRAP = "(pi() - ((pi() - ({0})) - 2 * pi() * floor((pi() - ({0})) / (2 * pi()))))"
_ORDERED = """nb AS (SELECT ts, f, lag(ts) OVER o AS pts, lag(f) OVER o AS pf, lead(ts) OVER o AS nts, lead(f) OVER o AS nf FROM one WINDOW o AS (ORDER BY ts)),
 bk AS (SELECT q.id, q.ts, p.ts AS t1, p.f AS f1, p.pts AS t0, p.pf AS f0 FROM track_queries q ASOF LEFT JOIN nb p ON q.ts >= p.ts),
 br AS (SELECT b.*, n.ts AS t2, n.f AS f2, n.nts AS t3, n.nf AS f3 FROM bk b ASOF LEFT JOIN nb n ON b.ts <= n.ts),
 ab AS (SELECT id, ts, CASE WHEN t1 IS NULL THEN t2 WHEN t2 IS NULL THEN coalesce(t0, t1) ELSE t1 END AS ta, CASE WHEN t1 IS NULL THEN f2 WHEN t2 IS NULL THEN coalesce(f0, f1) ELSE f1 END AS fa,
   CASE WHEN t1 IS NULL THEN coalesce(t3, t2) WHEN t2 IS NULL THEN t1 ELSE t2 END AS tb, CASE WHEN t1 IS NULL THEN coalesce(f3, f2) WHEN t2 IS NULL THEN f1 ELSE f2 END AS fb,
   coalesce(CASE WHEN t1 IS NULL THEN t2 - ts WHEN t2 IS NULL THEN ts - t1 ELSE 0 END, 0) <= 0.1e0 AS ok FROM br),
 sh AS (SELECT *, CASE WHEN tb > ta THEN (ts - ta) / CAST(tb - ta AS DOUBLE) ELSE 0e0 END AS s FROM ab)"""


def _lerp(k: int, name: str, digits: int = 6) -> str:
    a, b = f"fa[{k}]", f"fb[{k}]"
    if name in tracks.ANGLES:
        step = _WRAP.format(f"{b} - {a}")
        return f"round({_WRAP.format(f'{a} + {step} * s')}, {digits}) AS {name}"
    return f"round({a} + ({b} - {a}) * s, {digits}) AS {name}"


_LERP = ", ".join(_lerp(k, n) for k, n in enumerate(_FIELDS, 1))
reg("interpolate_track", "track track_queries", lambda v: rounded(tracks.interpolate_track(v("track_queries"), v("track"))), f"WITH {_ONE}, {_ORDERED} SELECT id, ts, {_LERP}, ok FROM sh")
reg("nearest_record", "track track_queries", lambda v: rounded(tracks.nearest_record(v("track_queries"), v("track"), ("lat", "lon", "alt", "roll", "pitch", "yaw")).select("id", "ts", "record_ts", "record_lat", "record_alt")),
    f"WITH {_ONE} SELECT q.id, q.ts, o.ts AS record_ts, round(f[1], 6) AS record_lat, round(f[3], 6) AS record_alt FROM track_queries q ASOF LEFT JOIN one o ON q.ts <= o.ts")
reg("correct_track", "track", lambda v: rounded(tracks.correct_track(v("track"), 0.01, -0.02, 3.5, 5).select("id", "ts", "roll", "pitch", "yaw")),
    f"SELECT id, ts + 5 AS ts, round({_WRAP.format('roll + 0.01e0')}, 6) AS roll, round({_WRAP.format('pitch - 0.02e0')}, 6) AS pitch, round({_WRAP.format('yaw + 3.5e0')}, 6) AS yaw FROM track")
_LAND = "land AS (SELECT id AS frame, min(ts) AS time FROM track WHERE id % 50 = 0 GROUP BY id)"


def _landmarks(v):
    return v("track").where("id % 50 = 0").select(F.col("id").alias("frame"), "ts")


_TIMES = """ln AS (SELECT frame, time, lag(frame) OVER o AS pf, lag(time) OVER o AS pt, lead(frame) OVER o AS nf, lead(time) OVER o AS nt FROM land WINDOW o AS (ORDER BY frame)),
 b1 AS (SELECT q.id AS frame, p.frame AS f1, p.time AS t1, p.pf AS f0, p.pt AS t0 FROM track_queries q ASOF LEFT JOIN ln p ON q.id >= p.frame), b2 AS (SELECT b.*, n.frame AS f2, n.time AS t2, n.nf AS f3, n.nt AS t3 FROM b1 b ASOF LEFT JOIN ln n ON b.frame <= n.frame),
 ends AS (SELECT frame, CASE WHEN f1 IS NULL THEN f2 WHEN f2 IS NULL THEN coalesce(f0, f1) ELSE f1 END AS fa, CASE WHEN f1 IS NULL THEN t2 WHEN f2 IS NULL THEN coalesce(t0, t1) ELSE t1 END AS ta, CASE WHEN f1 IS NULL THEN coalesce(f3, f2) WHEN f2 IS NULL THEN f1 ELSE f2 END AS fb, CASE WHEN f1 IS NULL THEN coalesce(t3, t2) WHEN f2 IS NULL THEN t1 ELSE t2 END AS tb FROM b2),
 times AS (SELECT frame, ta + (frame - fa) * CASE WHEN fb > fa THEN (tb - ta) / CAST(fb - fa AS DOUBLE) ELSE 0 END AS ts FROM ends)"""
reg("frame_times", "track track_queries", lambda v: rounded(tracks.frame_times(v("track_queries").select(F.col("id").alias("frame")), _landmarks(v)), 5), f"WITH {_LAND}, {_TIMES} SELECT frame, round(ts, 5) AS ts FROM times")
reg("gpx_for_frame", "track track_queries", lambda v: rounded(tracks.gpx_for_frame(v("track_queries").select(F.col("id").alias("frame")), _landmarks(v), v("track")).select("frame", "lat", "lon", "alt"), 5),
    f"""WITH {_LAND}, {_TIMES}, tq AS (SELECT frame AS id, least(greatest(ts, t0), t1) AS ts FROM times, (SELECT min(ts) AS t0, max(ts) AS t1 FROM track)), {_ONE}, {_ORDERED.replace('track_queries q', 'tq q')}
        SELECT id AS frame, {', '.join(_lerp(k, n, 5) for k, n in enumerate(('lat', 'lon', 'alt'), 1))} FROM sh""")  # fmt: skip
reg("track_summary", "track", lambda v: rounded(tracks.track_summary(v("track")), 2),
    "SELECT count(*) AS points, max(ts) - min(ts) AS duration, round(coalesce(sum(2 * 6378137e0 * asin(sqrt(least(pow(sin((lat - a) / 2), 2) + cos(a) * cos(lat) * pow(sin((lon - o) / 2), 2), 1)))), 0), 2) AS length FROM (SELECT *, lag(lat) OVER w AS a, lag(lon) OVER w AS o FROM track WINDOW w AS (ORDER BY ts, id))")


def _moving(v):
    return v("track").select("id", "ts", (F.col("id") % 10).alias("series"), "roll", "pitch", "yaw", (F.col("alt") / 100).alias("vf"), (F.col("lat") / 10).alias("vl"), F.lit(0.01).alias("vu"))


_ROT = (("cos(yaw) * cos(pitch)", "cos(yaw) * sin(pitch) * sin(roll) - sin(yaw) * cos(roll)", "cos(yaw) * sin(pitch) * cos(roll) + sin(yaw) * sin(roll)"),
        ("sin(yaw) * cos(pitch)", "sin(yaw) * sin(pitch) * sin(roll) + cos(yaw) * cos(roll)", "sin(yaw) * sin(pitch) * cos(roll) - cos(yaw) * sin(roll)"),
        ("-sin(pitch)", "cos(pitch) * sin(roll)", "cos(pitch) * cos(roll)"))
_AT0 = [[e.replace("yaw", "yaw0").replace("pitch", "pitch0").replace("roll", "roll0") for e in row] for row in _ROT]
reg("integrate_velocity", "track", lambda v: rounded(tracks.integrate_velocity(_moving(v), ("series",)).select("id", "px", "py", "pz"), 2),
    f"""WITH m AS (SELECT id, ts, id % 10 AS series, roll, pitch, yaw, alt / 100 AS vf, lat / 10 AS vl, 0.01e0 AS vu FROM track),
        e AS (SELECT *, {', '.join(f'({a}) * vf + ({b}) * vl + ({c}) * vu AS e{k}' for k, (a, b, c) in enumerate(_ROT))}, first_value(roll) OVER w AS roll0, first_value(pitch) OVER w AS pitch0, first_value(yaw) OVER w AS yaw0 FROM m WINDOW w AS (PARTITION BY series ORDER BY ts, id)),
        s AS (SELECT *, {', '.join(f'coalesce((e{k} + lag(e{k}) OVER w) / 2 * (ts - lag(ts) OVER w), 0) AS s{k}' for k in range(3))} FROM e WINDOW w AS (PARTITION BY series ORDER BY ts, id)),
        t AS (SELECT *, {', '.join(f'sum(s{k}) OVER w AS w{k}' for k in range(3))} FROM s WINDOW w AS (PARTITION BY series ORDER BY ts, id ROWS UNBOUNDED PRECEDING))
        SELECT id, {', '.join(f'round(({_AT0[0][k]}) * w0 + ({_AT0[1][k]}) * w1 + ({_AT0[2][k]}) * w2, 2) AS {n}' for k, n in enumerate(('px', 'py', 'pz')))} FROM t""")  # fmt: skip


def _ego(v):
    x, y, z = geo.lidar_to_cartesian()
    points = v("lidar_points").where("distance > 0").select("frame", "pid", x.alias("x"), y.alias("y"), z.alias("z"), (F.col("frame") * 86400 + F.col("t")).cast("double").alias("t"))
    target = v("track").orderBy("ts", "id").limit(1)
    return tracks.ego_motion_compensate(points, v("track"), target, step=60.0)


_E2 = "(1 - (6356752.314245e0 / 6378137e0) * (6356752.314245e0 / 6378137e0))"
_N = f"6378137e0 / sqrt(1 - {_E2} * sin({{0}}lat) * sin({{0}}lat))"
_ECEF = [f"({_N} + {{0}}alt) * cos({{0}}lat) * cos({{0}}lon)", f"({_N} + {{0}}alt) * cos({{0}}lat) * sin({{0}}lon)", f"({_N} * (1 - {_E2}) + {{0}}alt) * sin({{0}}lat)"]
_ENU = (("-sin({0}lon)", "cos({0}lon)", "0e0"), ("-sin({0}lat) * cos({0}lon)", "-sin({0}lat) * sin({0}lon)", "cos({0}lat)"), ("cos({0}lat) * cos({0}lon)", "cos({0}lat) * sin({0}lon)", "sin({0}lat)"))
_OF_TARGET = [[e.replace("yaw", "g.yaw").replace("pitch", "g.pitch").replace("roll", "g.roll") for e in row] for row in _ROT]
# Points of a step of 60 s share its middle pose; vehicle axes to east, north, up, to the earth's axes, and back in the target's.
_EGO = f"""WITH pt AS (SELECT frame, pid, distance * cos(elevation) * sin(azimuth) AS x, distance * cos(elevation) * cos(azimuth) AS y, distance * sin(elevation) AS z, CAST(frame * 86400 + t AS DOUBLE) AS t FROM lidar_points WHERE distance > 0),
 tq AS (SELECT DISTINCT floor(t / 60) AS id, (floor(t / 60) + 0.5e0) * 60 AS ts FROM pt), {_ONE}, {_ORDERED.replace('track_queries q', 'tq q')}, ps AS (SELECT id, {', '.join(_lerp(k, n, 13) for k, n in enumerate(_FIELDS, 1))} FROM sh),
 g AS (SELECT * FROM track ORDER BY ts, id LIMIT 1),
 a AS (SELECT pt.frame, pt.pid, pt.t, ps.*, {', '.join(f'({r0}) * x + ({r1}) * y + ({r2}) * z AS e{k}' for k, (r0, r1, r2) in enumerate(_ROT))} FROM pt JOIN ps ON ps.id = floor(pt.t / 60)),
 b AS (SELECT frame, pid, t, {', '.join(f"{_ECEF[j].format('a.')} + ({_ENU[0][j].format('a.')}) * e0 + ({_ENU[1][j].format('a.')}) * e1 + ({_ENU[2][j].format('a.')}) * e2 AS c{j}" for j in range(3))} FROM a),
 c AS (SELECT b.frame, b.pid, b.t, {', '.join(' + '.join(f"({_ENU[k][j].format('g.')}) * (c{j} - {_ECEF[j].format('g.')})" for j in range(3)) + f' AS n{k}' for k in range(3))} FROM b, g)
 SELECT frame, pid, {', '.join('round(' + ' + '.join(f'({_OF_TARGET[j][k]}) * n{j}' for j in range(3)) + f', 2) AS {n}' for k, n in enumerate('xyz'))}, t FROM c, g"""
reg("ego_motion_compensate", "lidar_points track", lambda v: rounded(_ego(v), 2), _EGO)


def _imu(v, method: str):
    x, y, z = geo.lidar_to_cartesian()
    points = v("lidar_points").where("distance > 0").select("frame", "pid", x.alias("x"), y.alias("y"), z.alias("z"), (F.col("frame") * 86400 + F.col("t")).cast("double").alias("t"))
    track = _moving(v).join(v("track").select("id", "lat", "lon", "alt"), "id")
    target = track.where("id % 100 < 50").orderBy(F.abs(F.col("ts") - 1_000_000), "id").limit(1)
    return tracks.ego_motion_compensate(points, track, target, step=3600.0, method=method)


_NINE = (*_FIELDS, "vf", "vl", "vu")
_ORDERED9 = _ORDERED.replace("track_queries q", "tq q")
# Records (one a time), the groups' poses and the target
_IMU = f"""WITH RECURSIVE pt AS (SELECT frame, pid, distance * cos(elevation) * sin(azimuth) AS x, distance * cos(elevation) * cos(azimuth) AS y, distance * sin(elevation) AS z, CAST(frame * 86400 + t AS DOUBLE) AS t FROM lidar_points WHERE distance > 0),
 tk AS (SELECT *, alt / 100 AS vf, lat / 10 AS vl, 0.01e0 AS vu FROM track), one AS (SELECT ts, min((lat, lon, alt, roll, pitch, yaw, vf, vl, vu)) AS f FROM tk GROUP BY ts),
 tq AS (SELECT DISTINCT floor(t / 3600) AS id, (floor(t / 3600) + 0.5e0) * 3600 AS ts FROM pt), {_ORDERED9}, ps AS (SELECT id, ts, {', '.join(_lerp(k, n, 13) for k, n in enumerate(_NINE, 1))} FROM sh),
 g AS (SELECT * FROM tk WHERE id % 100 < 50 ORDER BY abs(ts - 1000000), id LIMIT 1),
 rc AS (SELECT row_number() OVER (ORDER BY ts) AS k, CAST(ts AS DOUBLE) AS ts, f[4] AS roll, f[5] AS pitch, f[6] AS yaw, f[7] AS vf, f[8] AS vl, f[9] AS vu FROM one)"""


def _axes(turn: str, order: str) -> list[list[str]]:
    """Rows of a rotation by the differences roll, pitch, yaw (turn formats each); order "zyx": Rz Ry Rx, "xyz": Rx Ry Rz."""
    a = {n: (f"sin({turn.format(n)})", f"cos({turn.format(n)})") for n in ("roll", "pitch", "yaw")}
    (sr, cr), (sp, cp), (sy, cy) = a["roll"], a["pitch"], a["yaw"]
    if order == "zyx":
        return [[f"{cy}*{cp}", f"({cy}*{sp}*{sr}-{sy}*{cr})", f"({cy}*{sp}*{cr}+{sy}*{sr})"], [f"{sy}*{cp}", f"({sy}*{sp}*{sr}+{cy}*{cr})", f"({sy}*{sp}*{cr}-{cy}*{sr})"], [f"(-{sp})", f"{cp}*{sr}", f"{cp}*{cr}"]]
    return [[f"{cp}*{cy}", f"(-{cp}*{sy})", sp], [f"({sr}*{sp}*{cy}+{cr}*{sy})", f"({cr}*{cy}-{sr}*{sp}*{sy})", f"(-{sr}*{cp})"], [f"({sr}*{sy}-{cr}*{sp}*{cy})", f"({cr}*{sp}*{sy}+{sr}*{cy})", f"{cr}*{cp}"]]


_BY_IMU = _axes("(ps.{0} - g.{0})", "zyx")
reg("ego_motion_imu", "lidar_points track", lambda v: rounded(_imu(v, "imu"), 2),
    f"""{_IMU} SELECT frame, pid, {', '.join(f"round({row[0]} * x + {row[1]} * y + {row[2]} * z + 0.5e0 * (ps.ts - g.ts) * (g.{s} + ps.{s}), 2) AS {n}" for n, row, s in zip('xyz', _BY_IMU, ('vf', 'vl', 'vu'), strict=True))}, t
        FROM pt JOIN ps ON ps.id = floor(pt.t / 3600), g""")  # fmt: skip
reg("ego_motion_none", "lidar_points track", lambda v: rounded(_imu(v, "none"), 2), f"{_IMU} SELECT frame, pid, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z, t FROM pt")
# Record by record from a group's time to the target's, forward or backward; w: where the way has come to.
_STEP = [" + ".join(f"{row[k]} * 0.5e0 * dt * (a.{s} + b.{s})" for k, s in enumerate(("vf", "vl", "vu"))) for row in _axes("(CASE WHEN fwd THEN a.{0} ELSE b.{0} END - gp.{0})", "xyz")]
_BACK = _axes("(ps.{0} - g.{0})", "xyz")
reg("ego_motion_imue", "lidar_points track", lambda v: rounded(_imu(v, "imue"), 1),
    f"""{_IMU}, gp AS (SELECT ps.id AS grp, ps.*, g.ts AS te, (SELECT count(*) FROM rc WHERE rc.ts <= ps.ts) AS u, (SELECT count(*) FROM rc, g WHERE rc.ts <= g.ts) AS nb FROM ps, g),
        nodes AS (SELECT grp, 0 AS ord, ts, roll, pitch, yaw, vf, vl, vu FROM gp
          UNION ALL SELECT grp, CASE WHEN gp.ts < te THEN rc.k - u ELSE u - rc.k + 1 END, rc.ts, rc.roll, rc.pitch, rc.yaw, rc.vf, rc.vl, rc.vu FROM gp JOIN rc ON (gp.ts < te AND rc.k > u AND rc.k <= nb) OR (gp.ts > te AND rc.k <= u AND rc.k > nb + 1)
          UNION ALL SELECT grp, 1000000000, g.ts, g.roll, g.pitch, g.yaw, g.vf, g.vl, g.vu FROM gp, g WHERE gp.ts <> te),
        legs AS (SELECT grp, ts AS t0, (roll, pitch, yaw, vf, vl, vu) AS f0, lead(ts) OVER w AS t1, lead((roll, pitch, yaw, vf, vl, vu)) OVER w AS f1 FROM nodes WINDOW w AS (PARTITION BY grp ORDER BY ord)),
        way AS (SELECT gp.grp, {', '.join(f'sum({e}) AS o{k}' for k, e in enumerate(_STEP))}
          FROM (SELECT grp, t1 - t0 AS dt, {{'roll': f0[1], 'pitch': f0[2], 'yaw': f0[3], 'vf': f0[4], 'vl': f0[5], 'vu': f0[6]}} AS a, {{'roll': f1[1], 'pitch': f1[2], 'yaw': f1[3], 'vf': f1[4], 'vl': f1[5], 'vu': f1[6]}} AS b FROM legs WHERE t1 IS NOT NULL) l
          JOIN (SELECT *, ts < te AS fwd FROM gp) gp ON gp.grp = l.grp GROUP BY gp.grp)
        SELECT frame, pid, {', '.join(f"round({row[0]} * (x - coalesce(o0, 0)) + {row[1]} * (y - coalesce(o1, 0)) + {row[2]} * (z - coalesce(o2, 0)), 1) AS {n}" for n, row in zip('xyz', _BACK, strict=True))}, t
        FROM pt JOIN ps ON ps.id = floor(pt.t / 3600) LEFT JOIN way ON way.grp = ps.id, g""")  # fmt: skip

# Matching


def _sides(v):
    """The stated query set, every id divisible by 50, and all rows."""
    return v("descriptors").where("id % 50 = 0"), v("descriptors")


_QT = "q AS (SELECT * FROM descriptors WHERE id % 50 = 0), t AS (SELECT * FROM descriptors)"
_L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(CAST(q.desc_vec[i] AS DOUBLE) - CAST(t.desc_vec[i] AS DOUBLE))))"
_L2 = "list_sum(list_transform(range(1, 65), lambda i: pow(CAST(q.desc_vec[i] AS DOUBLE) - CAST(t.desc_vec[i] AS DOUBLE), 2)))"
reg("match_l1", "descriptors", lambda v: rounded(match.match_l1(*_sides(v), max_dist=8.0, digits=6)),
    f"WITH {_QT}, j AS (SELECT q.id AS q, t.id AS t, round({_L1}, 6) AS dist FROM q, t WHERE q.id <> t.id) SELECT q, t, dist FROM j WHERE dist <= 8 QUALIFY rank() OVER (PARTITION BY q ORDER BY dist) = 1")
reg("match_hamming", "descriptors", lambda v: match.match_hamming(*(s.withColumn("bits", match.sign_bits("desc_vec")) for s in _sides(v)), max_dist=20),
    f"""WITH {_QT}, j AS (SELECT q.id AS q, t.id AS t, CAST(list_sum(list_transform(range(1, 65), lambda i: CAST((q.desc_vec[i] > 0) <> (t.desc_vec[i] > 0) AS INT))) AS INT) AS dist FROM q, t WHERE q.id <> t.id)
        SELECT q, t, dist FROM j WHERE dist <= 20 QUALIFY row_number() OVER (PARTITION BY q ORDER BY dist, t) = 1""")  # fmt: skip
reg("match_knn_ratio", "descriptors", lambda v: rounded(match.match_knn_ratio(*_sides(v), ratio=0.99)),
    f"""WITH {_QT}, j AS (SELECT q.id AS q, t.id AS t, round({_L2}, 9) AS d FROM q, t WHERE q.id <> t.id), k AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS d1 FROM j WINDOW w AS (PARTITION BY q ORDER BY d, t))
        SELECT q, t, round(sqrt(d), 6) AS dist FROM k WHERE n = 1 AND (d1 IS NULL OR sqrt(d) < 0.99e0 * sqrt(d1))""")  # fmt: skip
# A ratio of 0.85 over descriptors of which a third have a scaled copy nearby


def _coarse(v):
    d = v("descriptors").select((F.col("id") * 2).alias("id"), F.col("desc_vec").cast("array<double>").alias("desc_vec"))
    moved = d.where("id % 3 = 0").select((F.col("id") + 1).alias("id"), F.transform("desc_vec", lambda x: x * 0.75).alias("desc_vec"))
    return d.unionByName(moved)


_COARSE = """d AS (SELECT id * 2 AS id, list_transform(desc_vec, lambda x: CAST(x AS DOUBLE)) AS desc_vec FROM descriptors),
 c AS (SELECT * FROM d UNION ALL SELECT id + 1, list_transform(desc_vec, lambda x: x * 0.75e0) FROM d WHERE id % 3 = 0)"""
reg("match_knn_ratio_strict", "descriptors", lambda v: rounded(match.match_knn_ratio(_coarse(v).where("id % 50 = 0"), _coarse(v), ratio=0.85)),
    f"""WITH {_COARSE}, j AS (SELECT q.id AS q, t.id AS t, round({_L2}, 9) AS d FROM c q, c t WHERE q.id % 50 = 0 AND q.id <> t.id), k AS (SELECT *, row_number() OVER w AS n, lead(d) OVER w AS d1 FROM j WINDOW w AS (PARTITION BY q ORDER BY d, t))
        SELECT q, t, round(sqrt(d), 6) AS dist FROM k WHERE n = 1 AND (d1 IS NULL OR sqrt(d) < 0.85e0 * sqrt(d1))""")  # fmt: skip
_MATCHES = f"mt AS (SELECT q, t FROM (SELECT q.id AS q, t.id AS t, round({_L2}, 9) AS d FROM q, t WHERE q.id <> t.id) QUALIFY row_number() OVER (PARTITION BY q ORDER BY d, t) = 1)"
reg("unmatched", "descriptors", lambda v: match.unmatched(_sides(v)[1].select("id", "label"), match.match_knn_ratio(*_sides(v), ratio=None), "t"), f"WITH {_QT}, {_MATCHES} SELECT id, label FROM t WHERE id NOT IN (SELECT t FROM mt)")
reg("matched", "descriptors", lambda v: match.matched(_sides(v)[1].select("id", "label"), match.match_knn_ratio(*_sides(v), ratio=None), "t"), f"WITH {_QT}, {_MATCHES} SELECT id, label FROM t WHERE id IN (SELECT t FROM mt)")
_TOP = "top AS (SELECT frame, kp, x, y FROM keypoints QUALIFY row_number() OVER (PARTITION BY frame ORDER BY response DESC, kp) <= 12)"
_SQ = lambda a, b: f"({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)"
_TRI = f"""{_TOP}, tr AS (SELECT p.frame, list_sort([(-({_SQ('q', 'r')}), -p.kp), (-({_SQ('p', 'r')}), -q.kp), (-({_SQ('p', 'q')}), -r.kp)]) AS s FROM top p JOIN top q ON p.frame = q.frame AND p.kp < q.kp JOIN top r ON q.frame = r.frame AND q.kp < r.kp),
 td AS (SELECT frame, -s[1][2] AS i, -s[2][2] AS j, -s[3][2] AS k, sqrt(s[2][1] / CAST(s[1][1] AS DOUBLE)) AS u, sqrt(s[3][1] / CAST(s[1][1] AS DOUBLE)) AS w FROM tr WHERE s[1][1] < s[2][1] AND s[2][1] < s[3][1] AND -s[3][1] >= 1)"""


def _triangles(v):
    return match.triangle_descriptors(topk.top_keypoints(v("keypoints"), 12))


reg("triangle_descriptors", "keypoints", lambda v: rounded(_triangles(v), 8), f"WITH {_TRI} SELECT frame, i, j, k, round(u, 8) AS u, round(w, 8) AS w FROM td")
reg("match_triangles", "keypoints", lambda v: match.match_triangles(_triangles(v).where("frame = 0"), _triangles(v).where("frame = 1"), 0.02),
    f"""WITH {_TRI}, vt AS (SELECT unnest([(a.i, b.i), (a.j, b.j), (a.k, b.k)]) AS z FROM td a JOIN td b ON a.frame = 0 AND b.frame = 1 AND (a.u - b.u) * (a.u - b.u) + (a.w - b.w) * (a.w - b.w) <= 0.0004e0),
        ct AS (SELECT z[1] AS p, z[2] AS q, count(*) AS votes FROM vt GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY votes DESC, q) AS r, max(votes) OVER (PARTITION BY q) AS m FROM ct),
        nn AS (SELECT *, count(*) FILTER (votes = m) OVER (PARTITION BY q) AS n FROM rk) SELECT p, q, votes FROM nn WHERE r = 1 AND votes = m AND n = 1""")  # fmt: skip
reg("match_single", "keypoints", lambda v: match.match_single(topk.top_keypoints(v("keypoints"), 1), v("keypoints").withColumn("response", -F.col("response")).transform(lambda d: topk.top_keypoints(d, 1))).select("frame", "q", "t"),
    "SELECT frame, arg_max(kp, (response, -kp)) AS q, arg_min(kp, (response, kp)) AS t FROM keypoints GROUP BY frame")
_PAIRS = "pr AS (SELECT a.frame, a.kp AS q, b.kp AS t, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM keypoints a JOIN keypoints b ON b.kp = a.kp + 1)"


def _pairs(v):
    m = v("keypoints").select(F.col("kp").alias("q"), (F.col("kp") + 1).alias("t"))
    return match.matched_positions(m, v("keypoints"), v("keypoints")).join(v("keypoints").select(F.col("kp").alias("q"), "frame"), "q")


reg("matched_positions", "keypoints", lambda v: _pairs(v).select("q", "t", "x0", "y0", "x1", "y1"), f"WITH {_PAIRS} SELECT q, t, x0, y0, x1, y1 FROM pr")
_STEP = lambda src, n: f"d{n} AS (SELECT frame, dx, dy FROM (SELECT *, avg(dx) OVER w AS mx, stddev_pop(dx) OVER w AS sx, avg(dy) OVER w AS my, stddev_pop(dy) OVER w AS sy FROM {src} WINDOW w AS (PARTITION BY frame)) WHERE abs(dx - mx) <= 2 * sx + 1e-9 AND abs(dy - my) <= 2 * sy + 1e-9)"
reg("estimate_translation", "keypoints", lambda v: rounded(match.estimate_translation(_pairs(v), factor=2.0)), f"WITH {_PAIRS}, d0 AS (SELECT frame, CAST(x1 - x0 AS DOUBLE) AS dx, CAST(y1 - y0 AS DOUBLE) AS dy FROM pr), {_STEP('d0', 1)}, {_STEP('d1', 2)}, {_STEP('d2', 3)} SELECT frame, round(avg(dx), 6) AS dx, round(avg(dy), 6) AS dy, count(*) AS n FROM d3 GROUP BY frame")
_COV = lambda a, b: f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
reg("estimate_similarity", "keypoints", lambda v: rounded(match.estimate_similarity(_pairs(v)), 5),
    f"""WITH {_PAIRS}, s AS (SELECT frame, {_COV('x0', 'x0')} + {_COV('y0', 'y0')} AS v, {_COV('x0', 'x1')} + {_COV('y0', 'y1')} AS p, {_COV('x0', 'y1')} - {_COV('y0', 'x1')} AS q, avg(x0) AS x0, avg(y0) AS y0, avg(x1) AS x1, avg(y1) AS y1 FROM pr GROUP BY frame), c AS (SELECT *, p / v AS a, q / v AS b FROM s)
        SELECT frame, round(sqrt(a * a + b * b), 5) AS scale, round(atan2(b, a), 5) AS angle, round(x1 - a * x0 + b * y0, 5) AS tx, round(y1 - b * x0 - a * y0, 5) AS ty FROM c""")  # fmt: skip
reg("estimate_affine", "keypoints", lambda v: rounded(match.estimate_affine(_pairs(v)), 5),
    f"""WITH {_PAIRS}, s AS (SELECT frame, {_COV('x0', 'x0')} AS xx, {_COV('x0', 'y0')} AS xy, {_COV('y0', 'y0')} AS yy, {', '.join(f"{_COV(a, b)} AS {a}{b}" for a in ('x0', 'y0') for b in ('x1', 'y1'))}, avg(x0) AS mx0, avg(y0) AS my0, avg(x1) AS mx1, avg(y1) AS my1 FROM pr GROUP BY frame),
        c AS (SELECT *, (x0x1 * yy - y0x1 * xy) / (xx * yy - xy * xy) AS a00, (y0x1 * xx - x0x1 * xy) / (xx * yy - xy * xy) AS a01, (x0y1 * yy - y0y1 * xy) / (xx * yy - xy * xy) AS a10, (y0y1 * xx - x0y1 * xy) / (xx * yy - xy * xy) AS a11 FROM s)
        SELECT frame, round(a00, 5) AS a00, round(a01, 5) AS a01, round(mx1 - a00 * mx0 - a01 * my0, 5) AS a02, round(a10, 5) AS a10, round(a11, 5) AS a11, round(my1 - a10 * mx0 - a11 * my0, 5) AS a12 FROM c""")  # fmt: skip
reg("nearest_point", "keypoints", lambda v: rounded(match.nearest_point(v("keypoints").select("frame", F.col("kp").alias("pid"), "x", "y"), v("keypoints").where("kp % 50 = 0").select("frame", F.col("kp").alias("qid"), (F.col("x") + 3).alias("x"), (F.col("y") + 4).alias("y")), 100.0).select("frame", "qid", "pid", "dist")),
    """WITH q AS (SELECT frame, kp AS qid, x + 3 AS qx, y + 4 AS qy FROM keypoints WHERE kp % 50 = 0) SELECT q.frame, qid, kp AS pid, round(sqrt((x - qx) * (x - qx) + (y - qy) * (y - qy)), 6) AS dist FROM q JOIN keypoints k ON k.frame = q.frame AND (x - qx) * (x - qx) + (y - qy) * (y - qy) <= 10000
       QUALIFY row_number() OVER (PARTITION BY q.frame, qid ORDER BY (x - qx) * (x - qx) + (y - qy) * (y - qy), kp) = 1""")  # fmt: skip


def _annotated(v):
    points = v("keypoints").select("frame", F.col("kp").alias("pid"), "x", "y", F.col("response").alias("depth"))
    boxes = v("keypoints").where("kp % 50 = 0").select("frame", (F.col("x") - 60).alias("x0"), (F.col("y") - 60).alias("y0"), (F.col("x") + 60).alias("x1"), (F.col("y") + 60).alias("y1"), (F.col("response") - 300).alias("depth0"), (F.col("response") + 300).alias("depth1"), F.lit("quality").alias("cmap"), (F.col("kp") % 7 + 1).cast("int").alias("label"))
    return joins.annotate_points(points, boxes, v("point_labels"))


reg("annotate_points", "keypoints point_labels", _annotated,
    """WITH b AS (SELECT frame, x - 60 AS x0, y - 60 AS y0, x + 60 AS x1, y + 60 AS y1, response - 300 AS d0, response + 300 AS d1, CAST(kp % 7 + 1 AS INT) AS label FROM keypoints WHERE kp % 50 = 0),
       hit AS (SELECT kp AS pid, 'quality' AS cmap, max(label) AS new FROM keypoints k JOIN b ON b.frame = k.frame AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 AND response BETWEEN d0 AND d1 GROUP BY kp)
       SELECT coalesce(h.pid, l.pid) AS pid, coalesce(h.cmap, l.cmap) AS cmap, CAST(coalesce(nullif(l.label, 0), new, 0) AS INT) AS label FROM hit h FULL JOIN point_labels l ON h.pid = l.pid AND h.cmap = l.cmap""")  # fmt: skip
reg("label_names", "point_labels", lambda v: joins.label_names(v("point_labels"), v("point_labels").select("cmap", "label").distinct().withColumn("name", F.concat_ws("-", "cmap", F.col("label").cast("string")))), "SELECT pid, cmap, label, cmap || '-' || label AS name FROM point_labels")


# Fits of which three tenths of the pairs are wrong
_MOVED = """kq AS (SELECT frame, kp, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, 0.9e0 * x - 0.2e0 * y + 30 + CASE WHEN kp % 10 < 3 THEN kp % 97 * 5 + 20 ELSE kp % 3 * 0.2e0 END AS x1,
 0.25e0 * x + 1.1e0 * y - 12 - CASE WHEN kp % 10 < 3 THEN kp % 89 * 4 + 25 ELSE kp % 5 * 0.1e0 END AS y1, (kp * 7919 + 13) % 10007 AS o FROM keypoints),
 kr AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY o, kp) - 1 AS r FROM kq)"""


def _moved(v):
    wrong, k, x, y = F.col("kp") % 10 < 3, F.col("kp"), F.col("x").cast("double"), F.col("y").cast("double")
    x1 = 0.9 * x - 0.2 * y + 30 + F.when(wrong, k % 97 * 5 + 20).otherwise(k % 3 * 0.2)
    y1 = 0.25 * x + 1.1 * y - 12 - F.when(wrong, k % 89 * 4 + 25).otherwise(k % 5 * 0.1)
    return v("keypoints").select("frame", "kp", x.alias("x0"), y.alias("y0"), x1.alias("x1"), y1.alias("y1"), ((k * 7919 + 13) % 10007).alias("o"))


def _consensus(kind: str, threshold: float) -> str:
    """The inliers of the best sample as table pr, by the same samples."""
    n = consensus.NEEDS[kind]
    rows = ", ".join(f"({k}, {', '.join(map(str, t))})" for k, t in enumerate(consensus.sampled(n)))
    pick = " ".join(f"JOIN kr p{k} ON p{k}.r = s.i{k}" + (" AND p{0}.frame = p0.frame".format(k) if k else "") for k in range(n))
    d = lambda c, k: f"(p{k}.{c} - p0.{c})"
    if kind == "similarity":
        size = f"nullif({d('x0', 1)} * {d('x0', 1)} + {d('y0', 1)} * {d('y0', 1)}, 0)"
        a, b = f"({d('x0', 1)} * {d('x1', 1)} + {d('y0', 1)} * {d('y1', 1)}) / {size}", f"({d('x0', 1)} * {d('y1', 1)} - {d('y0', 1)} * {d('x1', 1)}) / {size}"
        m = [[a, f"-({b})"], [b, a]]
    else:
        det = f"nullif({d('x0', 1)} * {d('y0', 2)} - {d('x0', 2)} * {d('y0', 1)}, 0)"
        m = [[f"({d(c, 1)} * {d('y0', 2)} - {d(c, 2)} * {d('y0', 1)}) / {det}", f"({d(c, 2)} * {d('x0', 1)} - {d(c, 1)} * {d('x0', 2)}) / {det}"] for c in ("x1", "y1")]
    off = "pow(a00 * x0 + a01 * y0 + x1_ - a00 * x0_ - a01 * y0_ - x1, 2) + pow(a10 * x0 + a11 * y0 + y1_ - a10 * x0_ - a11 * y0_ - y1, 2)"
    return f"""{_MOVED}, sm(t, {', '.join(f'i{k}' for k in range(n))}) AS (VALUES {rows}),
 md AS (SELECT p0.frame, s.t, {m[0][0]} AS a00, {m[0][1]} AS a01, {m[1][0]} AS a10, {m[1][1]} AS a11, p0.x0 AS x0_, p0.y0 AS y0_, p0.x1 AS x1_, p0.y1 AS y1_ FROM sm s {pick}),
 sc AS (SELECT kq.frame, t, count(*) AS n, round(sum({off}), 6) AS e FROM kq JOIN md ON md.frame = kq.frame WHERE {off} <= {threshold * threshold} GROUP BY 1, 2),
 bs AS (SELECT frame, t FROM sc QUALIFY row_number() OVER (PARTITION BY frame ORDER BY n DESC, e, t) = 1),
 pr AS (SELECT kq.* FROM kq JOIN bs ON bs.frame = kq.frame JOIN md ON md.frame = kq.frame AND md.t = bs.t WHERE {off} <= {threshold * threshold})"""


reg("consensus_similarity", "keypoints", lambda v: rounded(consensus.consensus_similarity(_moved(v), ["o", "kp"], threshold=40.0), 5),
    f"""WITH {_consensus('similarity', 40.0)}, s AS (SELECT frame, {_COV('x0', 'x0')} + {_COV('y0', 'y0')} AS v, {_COV('x0', 'x1')} + {_COV('y0', 'y1')} AS p, {_COV('x0', 'y1')} - {_COV('y0', 'x1')} AS q, avg(x0) AS x0, avg(y0) AS y0, avg(x1) AS x1, avg(y1) AS y1 FROM pr GROUP BY frame), c AS (SELECT *, p / v AS a, q / v AS b FROM s)
        SELECT frame, round(sqrt(a * a + b * b), 5) AS scale, round(atan2(b, a), 5) AS angle, round(x1 - a * x0 + b * y0, 5) AS tx, round(y1 - b * x0 - a * y0, 5) AS ty FROM c WHERE v > 0""")  # fmt: skip
reg("consensus_affine", "keypoints", lambda v: rounded(consensus.consensus_affine(_moved(v), ["o", "kp"]), 5),
    f"""WITH {_consensus('affine', 3.0)}, s AS (SELECT frame, {_COV('x0', 'x0')} AS xx, {_COV('x0', 'y0')} AS xy, {_COV('y0', 'y0')} AS yy, {', '.join(f"{_COV(a, b)} AS {a}{b}" for a in ('x0', 'y0') for b in ('x1', 'y1'))}, avg(x0) AS mx0, avg(y0) AS my0, avg(x1) AS mx1, avg(y1) AS my1 FROM pr GROUP BY frame),
        e AS (SELECT *, xx * yy - xy * xy AS det FROM s), f AS (SELECT *, (x0x1 * yy - y0x1 * xy) / det AS a00, (y0x1 * xx - x0x1 * xy) / det AS a01, (x0y1 * yy - y0y1 * xy) / det AS a10, (y0y1 * xx - x0y1 * xy) / det AS a11 FROM e WHERE det <> 0)
        SELECT frame, round(a00, 5) AS a00, round(a01, 5) AS a01, round(mx1 - a00 * mx0 - a01 * my0, 5) AS a02, round(a10, 5) AS a10, round(a11, 5) AS a11, round(my1 - a10 * mx0 - a11 * my0, 5) AS a12 FROM f""")  # fmt: skip


# Curved fits: a bent transform of every point, one pair in eleven off
_BENT = """wq AS (SELECT frame, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, 0.9e0 * x - 0.2e0 * y + 30 + 3e-4 * x * y + 2e-4 * x * x + kp % 7 * 0.3e0 + CASE WHEN kp % 11 = 0 THEN kp % 97 + 60 ELSE 0 END AS x1,
 0.25e0 * x + 1.1e0 * y - 12 - 2e-4 * x * y + 1e-4 * y * y - kp % 5 * 0.4e0 - CASE WHEN kp % 11 = 0 THEN kp % 89 + 80 ELSE 0 END AS y1 FROM keypoints)"""


def _bent(v):
    wrong, k, x, y = F.col("kp") % 11 == 0, F.col("kp"), F.col("x").cast("double"), F.col("y").cast("double")
    x1 = 0.9 * x - 0.2 * y + 30 + 3e-4 * x * y + 2e-4 * x * x + k % 7 * 0.3 + F.when(wrong, k % 97 + 60).otherwise(0)
    y1 = 0.25 * x + 1.1 * y - 12 - 2e-4 * x * y + 1e-4 * y * y - k % 5 * 0.4 - F.when(wrong, k % 89 + 80).otherwise(0)
    return v("keypoints").select("frame", x.alias("x0"), y.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _warp(kind: str, passes: int, factor: float) -> str:
    """Normal equations in centred coordinates, solved by elimination; errors of the pairs that are left, pass by pass."""
    size = warp.TERMS[kind]
    every, terms = range(size), ["px", "py", "1.0e0", "px * py", "px * px", "py * py"][:size]
    parts = [_BENT, "wc AS (SELECT frame, avg(x0) AS mx, avg(y0) AS my, avg(x1) AS mu, avg(y1) AS mv, sqrt(var_pop(x0) + var_pop(y0)) AS s FROM wq GROUP BY frame)",
             "p0 AS MATERIALIZED (SELECT frame, (x0 - mx) / s AS px, (y0 - my) / s AS py, x1 - mu AS pu, y1 - mv AS pv FROM wq JOIN wc USING (frame))"]
    for k in range(passes):
        sums = [f"sum({terms[i]} * {terms[j]}) AS m{i}{j}" for i in every for j in every] + [f"sum({terms[i]} * p{c}) AS {c}{i}" for c in "uv" for i in every]
        parts.append(f"g{k}_0 AS MATERIALIZED (SELECT frame, count(*) AS n, {', '.join(sums)} FROM p{k} GROUP BY frame)")
        for p in every:
            row = [f"m{p}{j} / m{p}{p} AS m{p}{j}" for j in every] + [f"{c}{p} / m{p}{p} AS {c}{p}" for c in "uv"]
            row += [f"{x} - m{i}{p} * {y} / m{p}{p} AS {x}" for i in every if i != p for x, y in [*((f"m{i}{j}", f"m{p}{j}") for j in every), (f"u{i}", f"u{p}"), (f"v{i}", f"v{p}")]]
            parts.append(f"g{k}_{p + 1} AS MATERIALIZED (SELECT frame, n, {', '.join(row)} FROM g{k}_{p})")
        off = " + ".join(f"pow({' + '.join(f'{c}{i} * {terms[i]}' for i in every)} - p{c}, 2)" for c in "uv")
        parts.append(f"r{k} AS (SELECT frame, px, py, pu, pv, {off} AS off FROM p{k} JOIN g{k}_{size} USING (frame))")
        parts.append(f"p{k + 1} AS MATERIALIZED (SELECT frame, px, py, pu, pv FROM r{k} QUALIFY off <= {factor * factor} * avg(off) OVER (PARTITION BY frame) / 2)")
    out = []
    for k, (c, middle) in enumerate((("u", "mu"), ("v", "mv"))):
        x, y, one, xy, xx, yy = [f"{c}{i}" for i in every] + ["0"] * (6 - size)
        whole = [f"{x} / s - {xy} * my / s / s - 2 * {xx} * mx / s / s", f"{y} / s - {xy} * mx / s / s - 2 * {yy} * my / s / s", f"{middle} + {one} - ({x} * mx + {y} * my) / s + ({xy} * mx * my + {xx} * mx * mx + {yy} * my * my) / s / s", f"{xy} / s / s", f"{xx} / s / s", f"{yy} / s / s"]
        out += [f"round({w}, 6) AS a{k}{i}" for i, w in enumerate(whole[:size])]
    return f"WITH {', '.join(parts)} SELECT frame, n, {', '.join(out)} FROM g{passes - 1}_{size} JOIN wc USING (frame)"


reg("estimate_semi_quadratic", "keypoints", lambda v: rounded(warp.estimate_warp(_bent(v), "semi_quadratic", passes=3), 6), _warp("semi_quadratic", 3, 3.0))
reg("estimate_quadratic", "keypoints", lambda v: rounded(warp.estimate_warp(_bent(v), "quadratic", passes=3), 6), _warp("quadratic", 3, 3.0))
