"""Time series of positions: as-of joins, interpolation, ego motion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions.geometry import ecef_to_vehicle, geodesic_meters, vehicle_axes, vehicle_to_ecef
from framelake.functions.scalar import angle_between, wrap_0_2pi, wrap_pi
from framelake.operators.ordered import _same, number_rows, previous, running_total, running_totals
from framelake.sources.storage import cut

ANGLES = ("lon", "roll", "pitch", "yaw")


#: Buckets of a track's records.
BUCKETS = 256


def _bucketed(queries: DataFrame, records: DataFrame, ts: str, by: Sequence[str], bucket: float | None, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both with __k, a bucket of time that rises with it: of `bucket` seconds, or (None) between quantiles of each track's records, so that
    a dense track fills no single one. The quantiles come from a sketch, an array for each track."""
    if bucket is not None:
        k = F.floor(F.col(ts) / bucket).cast("long")
        return queries.withColumn("__k", k), records.withColumn("__k", k)
    by, shares = list(by), [i / buckets for i in range(1, buckets)]
    edges = records.groupBy(*by).agg(F.array_distinct(F.percentile_approx(F.col(ts).cast("double"), shares, 10 * buckets)).alias("__e"))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(buckets.bit_length()))))
    x = F.col(ts).cast("double")
    # Edges at or below the time, by bisection; a track without records is one bucket.
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("__e")) & (F.get("__e", at + step - 1) <= x), at + step).otherwise(at))
    out = []
    for df in (queries, records):
        known = _same(df, edges, by, "left") if by else df.crossJoin(F.broadcast(edges))  # one row
        out.append(known.withColumn("__k", F.coalesce(F.when(F.col("__e").isNotNull(), place), F.lit(0)).cast("long")).drop("__e"))
    return out[0], out[1]


def neighbours(queries: DataFrame, records: DataFrame, fields: Sequence[str], ts: str = "ts", by: Sequence[str] = (), bucket: float | None = None, depth: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Each query with the last `depth` records at or before its time and the first `depth` records after it: p1, p2 and n1, n2 (structs of ts and fields, or null). depth is 1 or 2.

    Records and queries meet in windows over (by, time bucket), never in one over all; see _bucketed. A bucket's window also gets
    the records that come last before it and first after it, carried over from its neighbours; that carry is
    computed on one row per bucket.
    """
    by = list(by)
    asked_at, rec = _bucketed(queries, records, ts, by, bucket, buckets)
    rec = rec.select(*by, "__k", F.struct(F.col(ts).alias("ts"), *fields).alias("__r"))
    kind = T.ArrayType(rec.schema["__r"].dataType)
    none = F.array().cast(kind)
    # One row per bucket with its first and last records (at most `depth` of each leave the window below).
    w = Window.partitionBy(*by, "__k")
    ranked = rec.withColumns({"__i": F.row_number().over(w.orderBy("__r")), "__j": F.row_number().over(w.orderBy(F.col("__r").desc()))})
    ends = ranked.groupBy(*by, "__k").agg(F.array_sort(F.collect_list(F.when(F.col("__i") <= depth, F.col("__r")))).alias("__first"), F.array_sort(F.collect_list(F.when(F.col("__j") <= depth, F.col("__r")))).alias("__last"))
    asked = asked_at.select(*by, "__k").distinct().withColumns({"__first": F.lit(None).cast(kind), "__last": F.lit(None).cast(kind)})
    buckets = ends.unionByName(asked).groupBy(*by, "__k").agg(F.coalesce(F.max("__first"), none).alias("__first"), F.coalesce(F.max("__last"), none).alias("__last"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    # What comes after is what came before in the reversed order: frames that end with the partition are computed anew for every row.
    before, after = (over.orderBy(k).rowsBetween(Window.unboundedPreceding, -1) for k in (F.col("__k"), F.col("__k").desc()))
    filled = lambda c: F.when(F.size(c) > 0, F.col(c))
    carry = buckets.withColumns({"__b": F.coalesce(F.last(filled("__last"), True).over(before), none), "__a": F.coalesce(F.last(filled("__first"), True).over(after), none)})
    for _ in range(depth - 1):  # a bucket with fewer records than `depth` hands on those before and after it as well
        carry = carry.withColumns({"__l": F.slice(F.concat("__b", "__last"), F.greatest(F.size("__b") + F.size("__last") - depth + 1, F.lit(1)), F.lit(depth)), "__f": F.slice(F.concat("__first", "__a"), 1, depth)})
        carry = carry.withColumns({"__b": F.coalesce(F.last(filled("__l"), True).over(before), none), "__a": F.coalesce(F.last(filled("__f"), True).over(after), none)})
    carried = carry.select(*by, "__k", F.explode(F.concat("__b", "__a")).alias("__r"))
    row = F.struct(*queries.columns)
    row_type = queries.select(row.alias("q")).schema["q"].dataType
    events = rec.unionByName(carried).select(*by, "__k", F.col("__r.ts").cast("double").alias("__t"), F.lit(0).alias("__s"), "__r", F.lit(None).cast(row_type).alias("__q"))
    points = asked_at.select(*by, "__k", F.col(ts).cast("double").alias("__t"), F.lit(1).alias("__s"), F.lit(None).cast(rec.schema["__r"].dataType).alias("__r"), row.alias("__q"))
    order = [F.col(c) for c in ("__t", "__s", "__r")]
    o, back = w.orderBy(*order), w.orderBy(*(c.desc() for c in order))
    up, down = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (o, back))
    both = events.unionByName(points)
    if depth == 1:
        found = {"p1": F.last("__r", True).over(up), "n1": F.last("__r", True).over(down)}
    else:
        beside = {"__p": F.last("__r", True).over(o.rowsBetween(Window.unboundedPreceding, -1)), "__n": F.last("__r", True).over(back.rowsBetween(Window.unboundedPreceding, -1))}
        both = both.withColumns(beside).withColumn("__both", F.when(F.col("__r").isNotNull(), F.struct("__r", "__p", "__n")))
        both = both.withColumns({"__up": F.last("__both", True).over(up), "__down": F.last("__both", True).over(down)})
        found = {"p1": F.col("__up.__r"), "p2": F.col("__up.__p"), "n1": F.col("__down.__r"), "n2": F.col("__down.__n")}
    return both.withColumns(found).where("__s = 1").select("__q.*", *found)


def interpolate_track(queries: DataFrame, track: DataFrame, ts: str = "ts", by: Sequence[str] = (), bucket: float | None = None, slack: float = 0.1, fields: Sequence[str] = ("lat", "lon", "alt", "roll", "pitch", "yaw")) -> DataFrame:
    """Fields at a query's time: linear between its neighbours, angles by the shortest way; from the first or last two records beyond the ends. ok: not more than slack beyond."""
    # Records of one time are one; the one with the smallest values stands for them.
    one = track.groupBy(*by, ts).agg(F.min(F.struct(*fields)).alias("__f")).select(*by, ts, "__f.*")
    n = neighbours(queries, one, fields, ts, by, bucket, depth=2)
    a = F.when(F.col("p1").isNull(), F.col("n1")).when(F.col("n1").isNull(), F.coalesce("p2", "p1")).otherwise(F.col("p1"))
    b = F.when(F.col("p1").isNull(), F.coalesce("n2", "n1")).when(F.col("n1").isNull(), F.col("p1")).otherwise(F.col("n1"))
    n = n.withColumns({"__a": a, "__b": b})
    t0, t1 = F.col("__a.ts").cast("double"), F.col("__b.ts").cast("double")
    share = F.when(t1 > t0, (F.col(ts) - t0) / (t1 - t0)).otherwise(0.0)
    n = n.withColumn("__s", share)
    out = []
    for f in fields:
        x, y = F.col(f"__a.{f}"), F.col(f"__b.{f}")
        out.append((angle_between(x, y, F.col("__s")) if f in ANGLES else x + (y - x) * F.col("__s")).alias(f))
    beyond = F.when(F.col("p1").isNull(), F.col("n1.ts") - F.col(ts)).when(F.col("n1").isNull(), F.col(ts) - F.col("p1.ts")).otherwise(0)
    return n.select(*queries.columns, *out, (beyond <= slack).alias("ok"))


def nearest_record(queries: DataFrame, records: DataFrame, fields: Sequence[str], ts: str = "ts", by: Sequence[str] = (), bucket: float | None = None) -> DataFrame:
    """The first record at or after a query's time; of records of one time that with the smallest fields."""
    one = records.groupBy(*by, ts).agg(F.min(F.struct(*fields)).alias("__f")).select(*by, ts, "__f.*")
    n = neighbours(queries, one, fields, ts, by, bucket)
    r = F.when(F.col("p1.ts") == F.col(ts), F.col("p1")).otherwise(F.col("n1"))
    return n.select(*queries.columns, r.alias("__r")).select(*queries.columns, F.col("__r.ts").alias("record_ts"), *(F.col(f"__r.{f}").alias(f"record_{f}") for f in fields))


def correct_track(track: DataFrame, roll: float = 0.0, pitch: float = 0.0, yaw: float = 0.0, dt: float = 0.0) -> DataFrame:
    moved = {n: wrap_pi(F.col(n) + d) for n, d in (("roll", roll), ("pitch", pitch), ("yaw", yaw))}
    return track.withColumns({**moved, "ts": F.col("ts") + dt})


def frame_times(frames: DataFrame, landmarks: DataFrame, bucket: float | None = None) -> DataFrame:
    """landmarks: frame, ts. The time of every frame (frame): linear between landmarks, by the end pairs beyond them."""
    n = neighbours(frames.withColumn("__f", F.col("frame").cast("double")), landmarks.select(F.col("frame").cast("double").alias("__f"), F.col("ts").cast("double").alias("time")), ("time",), "__f", (), bucket, depth=2)
    a = F.when(F.col("p1").isNull(), F.col("n1")).when(F.col("n1").isNull(), F.coalesce("p2", "p1")).otherwise(F.col("p1"))
    b = F.when(F.col("p1").isNull(), F.coalesce("n2", "n1")).when(F.col("n1").isNull(), F.col("p1")).otherwise(F.col("n1"))
    n = n.withColumns({"__a": a, "__b": b})
    slope = F.when(F.col("__b.ts") > F.col("__a.ts"), (F.col("__b.time") - F.col("__a.time")) / (F.col("__b.ts") - F.col("__a.ts"))).otherwise(0.0)
    return n.select(*frames.columns, (F.col("__a.time") + (F.col("__f") - F.col("__a.ts")) * slope).alias("ts"))


def gpx_for_frame(frames: DataFrame, landmarks: DataFrame, track: DataFrame, bucket: float | None = None) -> DataFrame:
    """lat, lon and alt of every frame at its time; at the ends of the track its end points."""
    times = frame_times(frames, landmarks)
    ends = track.agg(F.min("ts").cast("double").alias("__t0"), F.max("ts").cast("double").alias("__t1"))
    clamped = times.crossJoin(F.broadcast(ends)).withColumn("ts", F.least(F.greatest("ts", "__t0"), F.col("__t1"))).drop("__t0", "__t1")  # one row
    return interpolate_track(clamped, track.withColumn("ts", F.col("ts").cast("double")), bucket=bucket, fields=("lat", "lon", "alt")).drop("ok")


#: Times this near are one.
NEAR = 1.1920929e-7
POSE, SPEED = ("lat", "lon", "alt", "roll", "pitch", "yaw"), ("vf", "vl", "vu")


def _about(axis: int, angle: Column) -> list[list[Column]]:
    """The rotation about an axis (0: x, 1: y, 2: z)."""
    s, c, one, zero = F.sin(angle), F.cos(angle), F.lit(1.0), F.lit(0.0)
    return ([[one, zero, zero], [zero, c, -s], [zero, s, c]], [[c, zero, s], [zero, one, zero], [-s, zero, c]], [[c, -s, zero], [s, c, zero], [zero, zero, one]])[axis]


def _times(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(len(b[0]))] for i in range(3)]


def _rolled(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Rx(roll) Ry(pitch) Rz(yaw)."""
    return _times(_times(_about(0, roll), _about(1, pitch)), _about(2, yaw))


def _walked(groups: DataFrame, track: DataFrame, target: DataFrame, bucket: float) -> DataFrame:
    """groups: ts and pose; with ox, oy, oz: the way from the group's time to the target's (__t_ columns), by trapezoids between records, in the axes of the group.

    The rotation of a record against a group's axes is Rx(r - r0) Ry(p - p0) Rz(y - y0) = Rx(-r0) [Rx(r) Ry(p)] [Ry(-p0) Rz(-y0)] [Rz(y)]. Products of
    the parts in brackets that hang on records alone, times the step, are 27 numbers a record whose running sums serve all groups.
    """
    one = track.groupBy("ts").agg(F.min(F.struct(*POSE, *SPEED)).alias("__f")).select(F.col("ts").cast("double").alias("ts"), "__f.*")
    part = F.floor(F.col("ts") / bucket)
    d = number_rows(previous(one, [], ["ts"], ["ts", "roll", "pitch", "yaw", *SPEED], part), [], ["ts"], part, "place")
    half = 0.5 * (F.col("ts") - F.col("__before.ts"))
    step = _times(_about(2, F.col("__before.yaw")), [[half * (F.col(f"__before.{n}") + F.col(n))] for n in SPEED])
    turn = _times(_about(0, F.col("__before.roll")), _about(1, F.col("__before.pitch")))
    terms = {f"w{9 * i + 3 * j + k}": F.coalesce(turn[i][j] * step[k][0], F.lit(0.0)) for i in range(3) for j in range(3) for k in range(3)}
    known = cut(running_totals(d, [], ["ts"], terms, part).select("ts", "place", "roll", "pitch", "yaw", *SPEED, F.array(*terms).alias("sums")), "sums")
    fields = ("place", "roll", "pitch", "yaw", *SPEED, "sums")
    here = neighbours(groups, known, fields).withColumnsRenamed({"p1": "__u", "n1": "__a"})
    there = neighbours(target.select(F.col("__t_ts").alias("ts")), known, fields, depth=2)
    j = here.crossJoin(F.broadcast(there.select(F.col("p1").alias("__b"), F.col("n1").alias("__e"), F.col("n2").alias("__n")).limit(1)))  # one row
    speed = lambda side: [F.col(f"{side}{n}") for n in SPEED]
    way = lambda dt, v, w: [[0.5 * dt * (x + y)] for x, y in zip(v, w, strict=True)]
    # Matrices and sums are columns of their own, so that each is computed once.
    matrix = lambda name: [[F.col(f"__{name}{i}{k}") for k in range(3)] for i in range(3)]
    stored = lambda name, m: {f"__{name}{i}{k}": m[i][k] for i in range(3) for k in range(3)}
    turn_of = lambda side: _rolled(*(F.col(f"{side}{a}") - F.col(a) for a in ("roll", "pitch", "yaw")))
    j = j.withColumns(stored("M", _times(_about(1, -F.col("pitch")), _about(2, -F.col("yaw")))) | stored("B", turn_of("__b.")) | stored("U", turn_of("__u.")) | stored("T", turn_of("__t_")))
    forward = F.col("__t_ts") > F.col("ts")
    first, last = F.when(forward, F.col("__a.sums")).otherwise(F.col("__n.sums")), F.when(forward, F.col("__b.sums")).otherwise(F.col("__u.sums"))
    j = cut(j.withColumn("__d", F.zip_with(last, first, lambda x, y: x - y)), "moves")
    middle = matrix("M")
    inner = {f"__i{i}": sum((middle[m][k] * F.col("__d")[9 * i + 3 * m + k] for m in range(3) for k in range(3) if m or k), middle[0][0] * F.col("__d")[9 * i]) for i in range(3)}
    j = j.withColumns(inner)
    between = {f"__w{k}": r[0] for k, r in enumerate(_times(_about(0, -F.col("roll")), [[F.col(f"__i{i}")] for i in range(3)]))}
    j = j.withColumns(between)
    ts, te, own, end = F.col("ts"), F.col("__t_ts"), speed(""), speed("__t_")
    direct = way(te - ts, own, end)
    # Forward: to the first record, on to the last one before the target, and to the target.
    from_b = _times(matrix("B"), way(te - F.col("__b.ts"), speed("__b."), end))
    ahead = [x[0] + F.col(f"__w{k}") + y[0] for k, (x, y) in enumerate(zip(way(F.col("__a.ts") - ts, own, speed("__a.")), from_b, strict=True))]
    # Backward: to the last record, back to the second one behind the target (the first is passed over), and to the target.
    to_u, from_n = _times(matrix("U"), way(F.col("__u.ts") - ts, own, speed("__u."))), _times(matrix("T"), way(te - F.col("__n.ts"), speed("__n."), end))
    back = [x[0] - F.col(f"__w{k}") + y[0] for k, (x, y) in enumerate(zip(to_u, from_n, strict=True))]
    straight = [r[0] for r in _times(matrix("T"), direct)]
    pick = lambda x, y, z, w: F.when(F.abs(te - ts) < NEAR, 0.0).when(forward, F.when(F.col("__a.ts") <= te, x).otherwise(y)).when(F.col("__u.place") > F.col("__e.place"), z).otherwise(w)
    names = {n: pick(a, d0[0], b, s0) for n, a, d0, b, s0 in zip(("ox", "oy", "oz"), ahead, direct, back, straight, strict=True)}
    return j.withColumns(names)


def ego_motion_compensate(points: DataFrame, track: DataFrame, target: DataFrame, step: float = 0.1, bucket: float = 86400.0, method: str = "gps") -> DataFrame:
    """points: frame, pid, x, y, z, t in vehicle axes at their times. In the axes of the target pose (one row: lat, lon, alt, roll, pitch, yaw); points of one time step share the pose at its middle.

    method: "gps" by positions; "imu" by the differences of angles and the mean of both speeds (target and track also have ts, vf, vl, vu);
    "imue" by the speeds of all records on the way; "none" leaves points as they are.
    """
    if method == "none":
        return points.select("frame", "pid", "x", "y", "z", "t")
    if method not in ("gps", "imu", "imue"):
        raise ValueError(f"no method {method}")
    fields = POSE if method == "gps" else (*POSE, *SPEED)
    grouped = points.withColumn("__g", F.floor(F.col("t") / step))
    asked = grouped.select("__g").distinct().withColumn("ts", (F.col("__g") + 0.5) * step)
    poses = interpolate_track(asked, track.withColumn("ts", F.col("ts").cast("double")), fields=fields).drop("ok")
    t = target.select(*(F.col(c).cast("double").alias(f"__t_{c}") for c in (*fields, *(("ts",) if method != "gps" else ()))))
    if method == "gps":
        j = grouped.join(poses.drop("ts"), "__g").crossJoin(F.broadcast(t))  # one row
        e = vehicle_to_ecef(("x", "y", "z"), "lat", "lon", "alt", "roll", "pitch", "yaw")
        j = j.withColumns({"__x": e[0], "__y": e[1], "__z": e[2]})
        v = ecef_to_vehicle(("__x", "__y", "__z"), *(f"__t_{c}" for c in POSE))
        return j.select("frame", "pid", v[0].alias("x"), v[1].alias("y"), v[2].alias("z"), "t")
    poses = poses.crossJoin(F.broadcast(t))  # one row
    turns = [F.col(a) - F.col(f"__t_{a}") for a in ("roll", "pitch", "yaw")]
    if method == "imu":
        shift = {f"o{n}": 0.5 * (F.col("ts") - F.col("__t_ts")) * (F.col(f"__t_{v}") + F.col(v)) for n, v in zip("xyz", SPEED, strict=True)}
        moves, m = poses.withColumns(shift), vehicle_axes(*turns)
        place = lambda p: [row[0] * p[0] + row[1] * p[1] + row[2] * p[2] + F.col(f"__o{n}") for row, n in zip(m, "xyz", strict=True)]
    else:
        moves, m = _walked(poses, track, target.select(F.col("ts").cast("double").alias("__t_ts")), bucket), _rolled(*turns)
        place = lambda p: [r[0] for r in _times(m, [[c - F.col(f"__o{n}")] for c, n in zip(p, "xyz", strict=True)])]
    near = F.abs(F.col("ts") - F.col("__t_ts")) < NEAR
    new = {f"__m{i}{k}": F.when(near, float(i == k)).otherwise(x) for i, row in enumerate(m) for k, x in enumerate(row)}
    moves = moves.withColumns(new).select("__g", *new, *(F.col(f"o{n}").alias(f"__o{n}") for n in "xyz"))
    m = [[F.col(f"__m{i}{k}") for k in range(3)] for i in range(3)]
    x, y, z = place([F.col("x"), F.col("y"), F.col("z")])
    return grouped.join(moves, "__g").select("frame", "pid", x.alias("x"), y.alias("y"), z.alias("z"), "t")


def integrate_velocity(track: DataFrame, by: Sequence[str] = (), ts: str = "ts", order: Sequence[str] = ("ts", "id"), bucket: float = 86400.0) -> DataFrame:
    """track: vf, vl, vu (forward, left, up), roll, pitch, yaw. px, py, pz: the way since the start, by trapezoids, in the axes of the start.
    Steps and sums go by buckets of time (see previous and running_total)."""
    part, angles = F.floor(F.col(ts) / bucket), ("roll", "pitch", "yaw")
    m = vehicle_axes(*angles)
    v = [row[0] * F.col("vf") + row[1] * F.col("vl") + row[2] * F.col("vu") for row in m]
    d = track.withColumns({f"__e{k}": x for k, x in enumerate(v)}).withColumn("__t", F.col(ts))
    d = previous(d, by, order, ["__t", "__e0", "__e1", "__e2"], part)
    dt = F.col("__t") - F.col("__before.__t")
    for k in range(3):
        d = running_total(d, by, order, F.coalesce((F.col(f"__e{k}") + F.col(f"__before.__e{k}")) / 2 * dt, F.lit(0.0)), part, f"__w{k}")
    start = track.groupBy(*by).agg(F.min_by(F.struct(*angles), F.struct(*order)).alias("__start"))
    d = d.join(start, list(by)) if by else d.crossJoin(F.broadcast(start))  # one row
    m0 = vehicle_axes(*(F.col(f"__start.{a}") for a in angles))
    back = [m0[0][k] * F.col("__w0") + m0[1][k] * F.col("__w1") + m0[2][k] * F.col("__w2") for k in range(3)]
    return d.select(*track.columns, *(b.alias(n) for b, n in zip(back, ("px", "py", "pz"), strict=True)))


def track_summary(track: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ("ts", "id"), bucket: float = 86400.0) -> DataFrame:
    """points, duration and length (m). Steps are taken within buckets of time, and from the last row of the buckets before."""
    d = previous(track, by, order, ["lat", "lon"], F.floor(F.col("ts") / bucket))
    d = d.withColumn("__d", geodesic_meters(F.col("__before.lat"), F.col("__before.lon"), "lat", "lon"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), (F.max("ts") - F.min("ts")).alias("duration"), F.coalesce(F.sum("__d"), F.lit(0.0)).alias("length"))


def heading(lat0: Column, lon0: Column, lat1: Column, lon1: Column) -> Column:
    """The bearing from one position to another, from north."""
    y = F.sin(lon1 - lon0) * F.cos(lat1)
    return wrap_0_2pi(F.atan2(y, F.cos(lat0) * F.sin(lat1) - F.sin(lat0) * F.cos(lat1) * F.cos(lon1 - lon0)))
