"""Queries of captures as streams of events, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..streaming import session
from .common import read, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


PLAN = session.Plan(directions=tuple((math.sin(math.radians(90 * k)), 0.0, math.cos(math.radians(90 * k))) for k in range(4)))


def capture_events(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events as the log of one capture: six previews of a sweep, then bursts of three frames, direction by direction."""
    e = read(spark, sf, "events", "user_id", "event_id", "value")
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    n, u, i, v = (F.col(c) for c in ("n", "user_id", "event_id", "value"))
    cycle, p = F.when(n >= 8, F.floor((n - 8) / 6)).otherwise(0), (n - 8) % 6
    kind = F.when(n == 0, "scan").when(n < 7, "preview").when(n == 7, "plan").when(p < 2, "orientation").when(p < 5, "frame").when(u % 5 == 0, "preview").otherwise("burst_finished")
    e = e.select(u, i, v, n, cycle.cast("long").alias("cycle"), p.alias("p"), kind.alias("kind"))
    kind, cycle = F.col("kind"), F.col("cycle")
    yaw = F.radians(F.when((kind == "preview") & (n < 7), i * 37 % 360 + 0.5).when(kind == "orientation", 90 * (cycle % 4) + u % 30 + 0.5))
    clipped = F.when(kind == "preview", i % 7 / 20.0).otherwise(F.when(v < 5, 0.3).when(v < 12, 0.02).otherwise(0.0))
    return e.select(
        u.cast("string").alias("capture"), i.alias("seq"), ((n * 200 + cycle * 13000) * session.MS).cast("long").alias("now_ns"), "kind", F.sin(yaw).alias("x"), F.when(yaw.isNotNull(), 0.0).alias("y"), F.cos(yaw).alias("z"),
        (i % 9 > 0).alias("stable"), (cycle + 1).alias("burst_id"), (F.col("p") - 2).cast("int").alias("bracket"), F.lit(True).alias("stored"), clipped.alias("clipped"), (v / 2000).alias("low"), (v / 25).alias("high"),
        (v / 200 + 0.001).alias("median"), (i % 11 / 10.0).alias("high_value"), F.pow(F.lit(2.0), -(i % 5)).alias("exposure"),
    )


SWEPT = """WITH RECURSIVE m AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
c AS (SELECT *, CASE WHEN n >= 8 THEN (n - 8) // 6 ELSE 0 END AS cycle, (n - 8) % 6 AS p FROM m),
k AS (SELECT *, CASE WHEN n = 0 THEN 'scan' WHEN n < 7 THEN 'preview' WHEN n = 7 THEN 'plan' WHEN p < 2 THEN 'orientation' WHEN p < 5 THEN 'frame' WHEN user_id % 5 = 0 THEN 'none' ELSE 'burst_finished' END AS kind FROM c),
y AS (SELECT *, CASE WHEN kind = 'preview' THEN event_id * 37 % 360 + 0.5 WHEN kind = 'orientation' THEN 90 * (cycle % 4) + user_id % 30 + 0.5 END AS yaw FROM k),
e AS (SELECT user_id, n, kind, n * 200 + cycle * 13000 AS tm, event_id % 9 > 0 AS stable, cycle + 1 AS b, CAST(p - 2 AS INT) AS br, value,
  CASE WHEN kind = 'preview' THEN event_id % 7 / 20.0 WHEN value < 5 THEN 0.3 WHEN value < 12 THEN 0.02 ELSE 0.0 END AS cl, event_id % 11 / 10.0 AS hv, power(2.0, -(event_id % 5)) AS ex,
  coalesce(CAST(list_filter([0, 1, 2, 3], lambda d: abs((yaw - 90 * d + 540) % 360 - 180) <= 25)[1] AS INT), -1) AS dir FROM y),
r AS (
  SELECT user_id, CAST(-1 AS BIGINT) AS n, 'IDLE' AS st, CAST(NULL AS BIGINT) AS steady, CAST(0 AS BIGINT) AS free, CAST(0 AS BIGINT) AS burst, -1 AS target, CAST(0 AS BIGINT) AS began, 0 AS got, 0 AS wanted, CAST(0 AS BIGINT) AS bursts, false AS anyf, 0 AS stored,
    CAST(0 AS DOUBLE) AS expo, 0 AS cmds, CAST(0 AS DOUBLE) AS clip, false AS lb, CAST([] AS DOUBLE[]) AS ladder, CAST([NULL, NULL, NULL, NULL] AS DOUBLE[]) AS lo, CAST([NULL, NULL, NULL, NULL] AS DOUBLE[]) AS hi,
    [1, 1, 1, 1] AS f, [2, 2, 2, 2] AS l, [0, 0, 0, 0] AS dk, [0, 0, 0, 0] AS att, [0, 0, 0, 0] AS ds FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, st4, steady2, CASE WHEN fin THEN tm + 250 ELSE free END, CASE WHEN starts THEN bursts + 1 ELSE burst2 END, CASE WHEN starts THEN dir WHEN burst2 = 0 THEN -1 ELSE target END, CASE WHEN starts THEN tm ELSE began END,
    CASE WHEN starts OR burst2 = 0 THEN 0 WHEN arrived THEN got | (1 << br) ELSE got END, CASE WHEN starts THEN l2[dir + 1] - f2[dir + 1] + 1 ELSE wanted END, CASE WHEN starts THEN bursts + 1 ELSE bursts END, anyf OR arrived,
    CASE WHEN arrived AND got & (1 << br) = 0 THEN stored + 1 ELSE stored END, CASE WHEN asks THEN want ELSE expo END, CASE WHEN asks THEN cmds + 1 ELSE cmds END, CASE WHEN starts THEN 0.0 WHEN arrived AND br = 0 THEN cl ELSE clip END,
    lb OR (hot AND NOT grows), ladder2, lo2, hi2, f2, l2, dk2, att2, ds2
  FROM (
    SELECT *, CASE WHEN st = 'IDLE' AND kind = 'scan' THEN 'SCANNING' WHEN st = 'SCANNING' AND kind = 'plan' THEN 'CAPTURING' WHEN gave AND NOT anyf THEN 'FAILED' WHEN ended AND list_min(ds2) > 0 THEN 'FINISHED' ELSE st END AS st4,
      live AND kind = 'orientation' AND stable AND st4 = 'CAPTURING' AND burst2 = 0 AND dir >= 0 AND ds2[dir + 1] = 0 AND tm - steady2 >= 150 AND tm >= free AS starts
    FROM (
      SELECT *, CASE WHEN ended OR grows THEN 0 ELSE burst END AS burst2, CASE WHEN live AND kind = 'orientation' THEN CASE WHEN stable THEN coalesce(steady, tm) END ELSE steady END AS steady2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN ended AND i = target + 1 THEN CASE WHEN ok THEN 1 WHEN gave AND anyf THEN 2 ELSE ds[i] END ELSE ds[i] END) AS ds2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN ended AND NOT ok AND i = target + 1 THEN att[i] + 1 ELSE att[i] END) AS att2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN grows AND i = target + 1 THEN dk[i] + 1 ELSE dk[i] END) AS dk2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN NOT grows THEN f[i] WHEN i = target + 1 THEN greatest(0, f[i] - 1) WHEN adds THEN f[i] + 1 ELSE f[i] END) AS f2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN NOT grows THEN l[i] WHEN i = target + 1 THEN least(CASE WHEN adds THEN l[i] + 1 ELSE l[i] END, greatest(0, f[i] - 1) + 8) WHEN adds THEN l[i] + 1 ELSE l[i] END) AS l2,
        CASE WHEN st = 'SCANNING' AND kind = 'plan' THEN [power(2.0, -6), power(2.0, -3), 1.0] WHEN grows AND adds THEN list_prepend(darker, ladder) ELSE ladder END AS ladder2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN st = 'SCANNING' AND kind = 'preview' AND i = dir + 1 THEN least(coalesce(lo[i], value / 2000), value / 2000) ELSE lo[i] END) AS lo2,
        list_transform([1, 2, 3, 4], lambda i: CASE WHEN st = 'SCANNING' AND kind = 'preview' AND i = dir + 1 THEN greatest(coalesce(hi[i], 0), value / 25) ELSE hi[i] END) AS hi2
      FROM (
        SELECT *, expired OR (fin AND NOT grows) AS ended, fin AND whole AND NOT grows AS ok, ended AND NOT ok AND att[target + 1] + 1 >= 3 AS gave
        FROM (
          SELECT *, hot AND dk[target + 1] < 4 AND (f[target + 1] > 0 OR darker < ladder[1] * (1 - 1e-9)) AS grows, hot AND f[target + 1] = 0 AS adds, st = 'SCANNING' AND kind = 'preview' AND want IS NOT NULL AND want <> expo AS asks
          FROM (
            SELECT r.* REPLACE (e.n AS n), e.kind, e.tm, e.stable, e.b, e.br, e.cl, e.hv, e.ex, e.dir, e.value, r.st = 'CAPTURING' AS live, greatest(1e-4, ladder[1] / 8) AS darker,
              live AND kind = 'orientation' AND burst > 0 AND tm - began > CASE WHEN anyf THEN 12000 ELSE 4000 END AS expired, live AND kind = 'burst_finished' AND burst > 0 AND b = burst AS fin, bit_count(got) >= wanted AS whole,
              fin AND whole AND clip > 1e-4 AND clip >= 0.0010000000000000009 AS hot, live AND kind = 'frame' AND burst > 0 AND b = burst AS arrived,
              least(16.0, greatest(1e-4, CASE WHEN cl > 0.01 THEN ex / CASE WHEN cl > 0.2 THEN 8 WHEN cl > 0.05 THEN 4 ELSE 2 END WHEN hv < 0.3 OR hv > 0.9 THEN ex * least(64.0, greatest(1 / 64.0, 0.6 / greatest(hv, 1e-9))) END)) AS want0,
              CASE WHEN cl > 0.01 OR hv < 0.3 OR hv > 0.9 THEN want0 END AS want
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))))))
SELECT CAST(user_id AS VARCHAR) AS capture, st AS state, CAST(len(list_filter(ds, lambda d: d = 1)) AS INT) AS shot, CAST(len(list_filter(ds, lambda d: d = 2)) AS INT) AS abandoned, stored, CAST(bursts AS INT) AS bursts, CAST(list_count(lo) AS INT) AS metered,
  round(list_min(lo), 9) AS low, round(list_max(hi), 9) AS high, round(expo, 9) AS exposure, cmds AS commands, CAST(len(ladder) AS INT) AS rungs, round(ladder[1], 9) AS darkest, CAST(list_sum(dk) AS INT) AS added, lb AS lower_bound
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS last FROM r) WHERE last = 1"""


@query(SWEPT)
def swept_capture(spark, sf):
    """Captures from sweep to last burst: previews find their direction, burnt out directions extend the ladder."""
    return rounded(session.fold(capture_events(spark, sf), PLAN).drop("message"), low=9, high=9, exposure=9, darkest=9)


def logged(spark: SparkSession, records: DataFrame, kind: str) -> DataFrame:
    """Records pushed to a log in the shared folder, read back by the data source."""
    import uuid

    from ..operators.graph import shared_folder
    from ..sources import devices

    devices.register(spark)
    path = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    devices.push(records, path)
    return spark.read.format("capture_log").option("path", path).option("kind", kind).option("block", 1 << 16).load()


LOGGED = SWEPT[: SWEPT.index("e AS (SELECT user_id, n, kind")].replace("WITH RECURSIVE", "WITH").rstrip().rstrip(",")


@query(LOGGED + """ SELECT CAST(user_id AS VARCHAR) AS capture, event_id AS seq, CASE kind WHEN 'none' THEN 'preview' ELSE kind END AS kind, CAST((n * 200 + cycle * 13000) * 1000000 AS BIGINT) AS now_ns, cycle + 1 AS burst_id,
  event_id % 9 > 0 AS stable, CASE WHEN kind IN ('preview', 'none') THEN event_id % 7 / 20.0 WHEN value < 5 THEN 0.3 WHEN value < 12 THEN 0.02 ELSE 0.0 END AS clipped, round(sin(radians(yaw)), 9) + 0.0 AS x FROM y""")
def camera_log(spark, sf):
    """What a camera pushed, as its source reads it."""
    out = logged(spark, capture_events(spark, sf), "camera")
    return out.select("capture", "seq", "kind", "now_ns", "burst_id", "stable", "clipped", (F.round("x", 9) + 0.0).alias("x"))


@query("""WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, radians(event_id * 37 % 360) AS yaw FROM events),
d AS (SELECT *, yaw - lag(yaw) OVER (PARTITION BY user_id ORDER BY n) AS turn FROM p)
SELECT CAST(user_id AS VARCHAR) AS capture, event_id AS seq, round(sin(yaw), 6) + 0.0 AS x, round(cos(yaw), 6) + 0.0 AS z, turn IS NOT NULL AND degrees(acos(greatest(-1.0, least(1.0, cos(turn))))) / 20 < 3 AS stable FROM d""")
def pose_log(spark, sf):
    """A sensor's poses, every two seconds, as its source reads them, turned to orientation events."""
    from ..sources import devices

    e = read(spark, sf, "events", "user_id", "event_id")
    n, half = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")), F.radians(F.col("event_id") * 37 % 360) / 2
    poses = e.select(F.col("user_id").cast("string").alias("capture"), F.col("event_id").alias("seq"), (n.cast("long") * 2_000_000_000).alias("now_ns"), F.lit(0.0).alias("x"), F.sin(half).alias("y"), F.lit(0.0).alias("z"), F.cos(half).alias("w"))
    seen = devices.orientations(logged(spark, poses, "pose"))
    return seen.select("capture", "seq", *[(F.round(a, 6) + 0.0).alias(a) for a in "xz"], "stable")
