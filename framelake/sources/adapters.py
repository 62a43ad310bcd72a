"""Domain tables as views over the given tables: one SQL text per view, valid in Spark and in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.operators.ordered import number_rows

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_T = "CAST((day(ts) - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT)"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "samples": (("lineitem",), """
        SELECT l_orderkey % 32 AS frame, CAST(floor(l_partkey / 50e0) AS INT) AS y, CAST(l_partkey % 50 AS INT) AS x,
               CAST(l_suppkey % 3 AS INT) AS c, CAST(l_extendedprice AS DECIMAL(12,2)) AS v,
               CAST(l_quantity AS DECIMAL(6,0)) AS w, l_returnflag <> 'R' AS valid
        FROM lineitem"""),
    "pixels": (("samples",), "SELECT frame, y, x, max(v) AS v, max(w) AS w, count(*) AS n, bool_or(valid) AS valid FROM samples GROUP BY frame, y, x"),
    "bgr": (("samples",), """
        SELECT frame, y, x, max(CASE WHEN c = 0 THEN v END) AS v0, max(CASE WHEN c = 1 THEN v END) AS v1, max(CASE WHEN c = 2 THEN v END) AS v2
        FROM samples GROUP BY frame, y, x"""),
    "signal": (("events",), """
        SELECT user_id AS series, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS ord, event_id AS id,
               CAST(value AS DECIMAL(12,2)) AS v, event_type <> 'error' AS valid
        FROM events"""),
    "lidar_points": (("events",), """
        SELECT CAST(day(ts) - 1 AS BIGINT) AS frame, event_id AS pid, CAST(user_id % 16 AS INT) AS laser_ring,
               ((event_id * 37) % 3600) / 1e1 * pi() / 180e0 AS azimuth, (2 * (user_id % 16) - 15) * pi() / 180e0 AS elevation,
               CASE WHEN event_type = 'error' THEN 0e0 ELSE value / 5e0 END AS distance, (event_id % 256) / 255e0 AS intensity,
               CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS t
        FROM events"""),
    "firings": (("events",), """
        SELECT user_id % 3 AS sensor, CAST(row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS BIGINT) AS pkt,
               (event_id * 37) % 36000 AS azimuth, (minute(ts) * 60 + second(ts)) * CAST(1000000 AS BIGINT) AS toh
        FROM events"""),
    "track": (("events",), f"""
        SELECT event_id AS id, {_T} AS ts, radians(40e0 + value / 1e3) AS lat, radians(user_id / 1e0 - 75e0) AS lon, value / 1e1 AS alt,
               radians((event_id % 7 - 3) / 1e0) AS roll, radians((event_id % 5 - 2) / 1e0) AS pitch, radians((event_id % 360 - 180) / 1e0) AS yaw
        FROM events WHERE event_type = 'signup'"""),
    "track_queries": (("events",), f"SELECT event_id AS id, {_T} AS ts FROM events WHERE event_type = 'click'"),
    "gps_points": (("customer",), "SELECT c_custkey AS id, (c_custkey * 7919 % 17000) / 1e2 - 85e0 AS lat, (c_custkey * 104729 % 36000) / 1e2 - 180e0 AS lon FROM customer"),
    "keypoints": (("part",), "SELECT p_size % 5 AS frame, p_partkey AS kp, p_partkey * 31 % 997 AS x, p_partkey * 57 % 991 AS y, p_retailprice AS response FROM part"),
    "descriptors": (("embeddings",), "SELECT vec_id AS id, label, embedding AS desc_vec, CASE WHEN vec_id % 2 = 0 THEN 'query' ELSE 'train' END AS role FROM embeddings"),
    "sources": (("documents",), "SELECT source AS src, CAST(row_number() OVER (ORDER BY source) - 1 AS BIGINT) AS ord, count(*) AS n_frames FROM documents GROUP BY source"),
    "badframes": (("nation",), "SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS frame FROM nation WHERE n_regionkey = 0"),
    "point_labels": (("labels",), "SELECT doc_id AS pid, 'quality' AS cmap, quality AS label FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels"),
}


def _firings(events: DataFrame) -> DataFrame:
    """The view of that name, numbered within days and over the counts of the days before."""
    rows = events.select((F.col("user_id") % 3).alias("sensor"), "ts", "event_id")
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date"))
    clock = (F.minute("ts") * 60 + F.second("ts")) * F.lit(1_000_000).cast("long")
    numbered = number_rows(rows, ["sensor"], ["ts", "event_id"], day, "__i")
    return numbered.select("sensor", (F.col("__i") + 1).alias("pkt"), (F.col("event_id") * 37 % 36000).alias("azimuth"), clock.alias("toh"))


#: Views that Spark makes in parts where their SQL numbers all rows of a key in one window.
IN_PARTS: dict[str, Callable[[DataFrame], DataFrame]] = {"firings": _firings}


class Views:
    """The views of one folder of tables; each is registered when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                needs, sql = VIEWS[name]
                for n in needs:
                    self(n).createOrReplaceTempView(n)
                self._made[name] = IN_PARTS[name](self(*needs)) if name in IN_PARTS else self.spark.sql(sql)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def with_views(sql: str, *names: str) -> str:
    """sql with the named views (and what they need) in front, for an engine that has the tables."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for n in VIEWS[name][0]:
                add(n)
            order.append(name)

    for name in names:
        add(name)
    head = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
