"""Queries of the device catalogue and of frame features, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.radiometry import positive
from ..operators import features
from .common import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LENSES = """l AS (SELECT p_partkey // 10 AS device, p_partkey AS id, p_size % 4 = 0 AS front, p_size % 3 <> 0 AS raw, p_partkey % 3 = 0 AS physical, (p_partkey * 7) % 90 + 30.0 AS hfov FROM part)"""


def lenses(spark: SparkSession, sf: str) -> DataFrame:
    p, k = read(spark, sf, "part", "p_partkey", "p_size"), F.col("p_partkey")
    return p.select(F.floor(k / 10).alias("device"), k.alias("id"), (F.col("p_size") % 4 == 0).alias("front"), (F.col("p_size") % 3 != 0).alias("raw"), (k % 3 == 0).alias("physical"), ((k * 7) % 90 + 30.0).alias("hfov"))


@query(f"WITH {LENSES} SELECT device, id, CAST(row_number() OVER (PARTITION BY device ORDER BY front, raw DESC, hfov DESC, id) AS INT) AS place FROM l")
def lens_order(spark, sf):
    """Rear lenses first, then those that measure radiance, then the widest."""
    order = Window.partitionBy("device").orderBy("front", F.col("raw").desc(), F.col("hfov").desc(), "id")
    return lenses(spark, sf).select("device", "id", F.row_number().over(order).alias("place"))


@query(f"WITH {LENSES} SELECT device, arg_min(id, [CAST(front AS INT), CAST(NOT raw AS INT), CAST(physical AS INT), -hfov, id]) AS id FROM l GROUP BY 1")
def default_lens(spark, sf):
    """The lens to start on: rear, raw, whole rather than physical, widest; each only where there is one."""
    rank = F.struct("front", (~F.col("raw")).alias("r"), "physical", (-F.col("hfov")).alias("h"), "id")
    return lenses(spark, sf).groupBy("device").agg(F.min_by("id", rank).alias("id"))


SIZES = "s AS (SELECT l_suppkey AS device, CAST(l_quantity AS INT) * 80 AS w, CAST(l_quantity AS INT) * 80 * (CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END) // 4 AS h FROM lineitem)"


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_linenumber")
    w = F.col("l_quantity").cast("int") * 80
    return li.select(F.col("l_suppkey").alias("device"), w.alias("w"), F.floor(w * F.when(F.col("l_linenumber") % 2 == 0, 3).otherwise(2) / 4).cast("int").alias("h"))


@query(f"WITH {SIZES} SELECT device, arg_min(w, [abs(w - 1280), -w * h]) AS w, arg_min(h, [abs(w - 1280), -w * h]) AS h FROM s WHERE w <= 1920 AND abs(w / h - 4 / 3.0) < 0.02 GROUP BY 1")
def preview_size(spark, sf):
    """The preview nearest 1280 wide among those of the capture's shape, the larger of equals."""
    near = F.struct(F.abs(F.col("w") - 1280).alias("d"), (-F.col("w") * F.col("h")).alias("p"))
    fit = sizes(spark, sf).where((F.col("w") <= 1920) & (F.abs(F.col("w") / F.col("h") - 4 / 3) < 0.02))
    return fit.groupBy("device").agg(F.min_by("w", near).alias("w"), F.min_by("h", near).alias("h"))


@query(f"WITH {SIZES}, u AS (SELECT DISTINCT device, w, h FROM s) SELECT device, w, h, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY w * h DESC, w) AS place FROM u) WHERE place <= 2")
def raw_sizes(spark, sf):
    """The two largest distinct sizes of each device; a top-k report."""
    order = Window.partitionBy("device").orderBy((F.col("w") * F.col("h")).desc(), "w")
    return sizes(spark, sf).distinct().withColumn("place", F.row_number().over(order)).where("place <= 2")


@query("SELECT o_orderkey, CASE WHEN n = 0 THEN 'nothing to capture' WHEN f = 0 THEN 'nothing was captured' WHEN r > 0 THEN printf('%d of %d directions captured, %d given up', f, n, r) ELSE printf('%d of %d directions captured', f, n) END AS message FROM (SELECT o_orderkey, count(l_orderkey) AS n, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_returnflag = 'R') AS r FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def finish_text(spark, sf):
    from ..functions.text import finish_message

    li = read(spark, sf, "lineitem", "l_orderkey", "l_linestatus", "l_returnflag")
    n = li.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    o = read(spark, sf, "orders", "o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n", "f", "r"])
    return o.select("o_orderkey", finish_message(F.col("f"), F.col("r"), F.col("n")).alias("message"))


@query("SELECT min(v) AS low, max(v) AS high, count(*) AS covered FROM (SELECT l_partkey, sum(l_quantity) AS c, round(avg(l_extendedprice), 4) AS v FROM lineitem GROUP BY 1) WHERE c > 20 AND v > 0")
def radiance_range(spark, sf):
    """Extremes over well-covered pixels."""
    li = read(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_extendedprice")
    px = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("c"), F.round(F.avg("l_extendedprice"), 4).alias("v"))
    return px.where((F.col("c") > 20) & positive(F.col("v"))).agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("covered"))


@query("")
def frame_features(spark, sf):
    """Corners and descriptors of a frame drawn for each nation."""
    i = F.col("i")
    y, x = F.floor(i / 160), i % 160
    blocks = ((F.floor(x / 20) * 7 + F.floor(y / 20) * 13 + F.col("id") * 5) % 11) / 10.0 + 0.05
    cells = read(spark, sf, "nation", "n_nationkey").select(F.col("n_nationkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(160 * 120 - 1))).alias("i")).select("id", "i", blocks.cast("float").alias("v"))
    frames = cells.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("data"))
    frames = frames.select(F.col("id").alias("frame_id"), F.lit(160).alias("width"), F.lit(120).alias("height"), F.lit(1).alias("channels"), "data")
    return features.features(frames)


REPLAY = """WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type AS k, epoch_us(ts) * 1000 AS tm, CAST(event_id % 3 AS INT) AS t, CAST(event_id % 4 AS INT) AS b, CAST(event_id % 2 AS INT) AS br FROM events),
r AS (
  SELECT user_id, CAST(0 AS BIGINT) AS n, 'CAPTURING' AS state, CAST(NULL AS BIGINT) AS steady, CAST(0 AS BIGINT) AS free_at, 0 AS burst, 0 AS target, CAST(0 AS BIGINT) AS began, 0 AS got, 0 AS shot, 0 AS gone, [0, 0, 0] AS att, false AS any_frame, 0 AS bursts, 0 AS stored
  FROM (SELECT DISTINCT user_id FROM events)
  UNION ALL
  SELECT user_id, n, state3, steady2, free2, CASE WHEN fire THEN bursts + 1 ELSE burst2 END, CASE WHEN fire THEN t ELSE target END, CASE WHEN fire THEN tm ELSE began END,
    CASE WHEN fire OR ended THEN 0 WHEN fresh THEN got | (1 << br) ELSE got END, shot2, gone2, att2, any_frame OR arrived, CASE WHEN fire THEN bursts + 1 ELSE bursts END, CASE WHEN fresh THEN stored + 1 ELSE stored END
  FROM (
    SELECT *, live AND k = 'view' AND state3 = 'CAPTURING' AND burst2 = 0 AND ((shot2 | gone2) >> t) & 1 = 0 AND tm - steady2 >= 150000000 AND tm >= free2 AS fire, arrived AND (got >> br) & 1 = 0 AS fresh
    FROM (
      SELECT *, CASE WHEN ended AND state2 = 'CAPTURING' AND (shot2 | gone2) = 7 THEN 'FINISHED' ELSE state2 END AS state3, CASE WHEN fin THEN tm + 250000000 ELSE free_at END AS free2,
        CASE WHEN live AND k = 'view' THEN coalesce(steady, tm) ELSE steady END AS steady2, CASE WHEN ended THEN 0 ELSE burst END AS burst2, live AND k = 'click' AND burst > 0 AND b = burst AS arrived
      FROM (
        SELECT *, CASE WHEN gave AND NOT any_frame THEN 'FAILED' ELSE state END AS state2, CASE WHEN ok THEN shot | (1 << target) ELSE shot END AS shot2, CASE WHEN gave AND any_frame THEN gone | (1 << target) ELSE gone END AS gone2,
          list_transform(range(1, 4), lambda i: CASE WHEN ended AND NOT ok AND i = target + 1 THEN att[i] + 1 ELSE att[i] END) AS att2
        FROM (
          SELECT *, ended AND NOT ok AND att[target + 1] + 1 >= 3 AS gave
          FROM (
            SELECT *, expired OR fin OR failed AS ended, fin AND bit_count(got) >= [1, 1, 2][target + 1] AS ok
            FROM (
              SELECT *, live AND k = 'view' AND burst > 0 AND tm - began > CASE WHEN any_frame THEN 12000000000 ELSE 4000000000 END AS expired, live AND k IN ('purchase', 'signup') AND burst > 0 AND b = burst AS fin, live AND k = 'error' AND burst > 0 AS failed
              FROM (SELECT r.* REPLACE (e.n AS n), e.k, e.tm, e.t, e.b, e.br, r.state = 'CAPTURING' AS live FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))))))
)
SELECT CAST(user_id AS VARCHAR) AS capture, state, CAST(bit_count(shot) AS INT) AS shot, CAST(bit_count(gone) AS INT) AS abandoned, stored, bursts, bit_count(shot) / 3.0 AS progress
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS last FROM r) WHERE last = 1"""


@query(REPLAY)
def capture_replay(spark, sf):
    """Each user's events as one capture, folded by the state machine."""
    from ..streaming.controller import fold

    e = read(spark, sf, "events", "user_id", "event_id", "ts", "event_type", "value")
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    kind = F.when(F.col("event_type") == "view", "orientation").when(F.col("event_type") == "click", "frame").when(F.col("event_type") == "error", "error").otherwise("burst_finished")
    body = F.to_json(F.struct(kind.alias("kind"), ns.alias("now_ns"), F.lit(True).alias("stable"), (F.col("event_id") % 3).cast("string").alias("target"), (F.col("event_id") % 4).alias("burst_id"), (F.col("event_id") % 2).alias("bracket")))
    plan = e.select("user_id").distinct().select(F.col("user_id").cast("string").alias("capture"), F.lit(-1).cast("long").alias("seq"), F.lit('{"kind": "plan", "now_ns": 0, "targets": {"0": 1, "1": 1, "2": 2}}').alias("event"))
    log = e.select(F.col("user_id").cast("string").alias("capture"), F.col("event_id").alias("seq"), body.alias("event")).unionByName(plan)
    return fold(log)
