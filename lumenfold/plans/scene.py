"""Queries of geometry, matching, graphs, solves, compositing, progress and text, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..functions import radiometry as r
from ..functions import text
from ..operators import composite, graph, matching, progress, solve
from .common import grid, read, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- geometry -------------------------------------------------------------------------------------------

WIDTH, HEIGHT = 128, 64
EQUIRECT = f"""WITH p AS (SELECT c_custkey AS k, CAST(c_custkey * 53 % {HEIGHT} AS INT) AS y, CAST(c_custkey * 37 % {WIDTH} AS INT) AS x FROM customer),
a AS (SELECT k, y, x, (x + 0.5) / {WIDTH} * 2 * pi() - pi() AS lon, pi() / 2 - (y + 0.5) / {HEIGHT} * pi() AS lat FROM p),
d AS (SELECT k, y, x, -sin(lon) * cos(lat) AS dx, sin(lat) AS dy, cos(lon) * cos(lat) AS dz FROM a) """


def sphere(spark: SparkSession, sf: str) -> DataFrame:
    """A pixel of the sphere for each customer."""
    k = F.col("c_custkey")
    p = read(spark, sf, "customer", "c_custkey").select(k.alias("k"), (k * 53 % HEIGHT).cast("int").alias("y"), (k * 37 % WIDTH).cast("int").alias("x"))
    return p.select("k", "y", "x", g.direction(F.col("x"), F.col("y"), WIDTH, HEIGHT).alias("d"))


@query(EQUIRECT + "SELECT k, y, x, round(dx, 9) AS dx, round(dy, 9) AS dy, round(dz, 9) AS dz, CAST(x AS DOUBLE) AS u, CAST(y AS DOUBLE) AS v FROM d")
def equirect_grid(spark, sf):
    """Directions of pixels, and the pixels that these lead back to."""
    s = sphere(spark, sf).withColumn("p", g.pixel(F.col("d"), WIDTH, HEIGHT))
    return s.select("k", "y", "x", *[F.round(f"d.{k}", 9).alias(f"d{k}") for k in "xyz"], F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"))


@query(EQUIRECT + f"""SELECT k, y, round(2 * pi() / {WIDTH} * (sin(pi() / 2 - y / {HEIGHT} * pi()) - sin(pi() / 2 - (y + 1) / {HEIGHT} * pi())), 12) AS sr FROM p""")
def solid_angle(spark, sf):
    """How much of the sphere each customer's pixel covers."""
    return sphere(spark, sf).select("k", "y", F.round(g.row_solid_angle(F.col("y"), WIDTH, HEIGHT), 12).alias("sr"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN d > 64 THEN d - 128 WHEN d < -64 THEN d + 128 ELSE d END AS du
FROM (SELECT l_orderkey, l_linenumber, ((l_quantity - 25) * 17) % 128 AS d FROM lineitem)""")
def wrap_delta(spark, sf):
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    return li.select("l_orderkey", "l_linenumber", g.wrapped((F.col("l_quantity") - 25) * 17, 128).alias("du"))


LENS = c.Lens(k1=-0.09, k2=0.01)


@query(EQUIRECT + f""", n AS (SELECT k, y, x, dx / dz AS a, dy / dz AS b, (dx * dx + dy * dy) / (dz * dz) AS r2, dz FROM d WHERE dz > 1e-12),
f AS (SELECT *, 1 + r2 * ({LENS.k1} + r2 * {LENS.k2}) AS f, 1 + r2 * (3 * {LENS.k1} + r2 * 5 * {LENS.k2}) AS slope FROM n)
SELECT k, y, x, round({LENS.fx} * a * f + {LENS.cx}, 6) AS u, round({LENS.fy} * b * f + {LENS.cy}, 6) AS v FROM f
WHERE slope > 0 AND {LENS.fx} * a * f + {LENS.cx} BETWEEN -0.5 - 1e-9 AND {LENS.width} - 0.5 + 1e-9 AND {LENS.fy} * b * f + {LENS.cy} BETWEEN -0.5 - 1e-9 AND {LENS.height} - 0.5 + 1e-9""")
def project_visible(spark, sf):
    """Sphere pixels that a camera with radial distortion sees, and where."""
    s = sphere(spark, sf).where(g.visible(F.col("d"), LENS)).withColumn("p", g.project(F.col("d"), LENS))
    return s.select("k", "y", "x", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"))


@query("SELECT p_partkey, CAST((p_partkey * 37) % 800 AS DOUBLE) AS u, CAST((p_partkey * 53) % 600 AS DOUBLE) AS v FROM part")
def unproject_round_trip(spark, sf):
    """Pixels unprojected by Newton steps and projected again."""
    i = F.col("p_partkey")
    p = read(spark, sf, "part", "p_partkey").select(i, g.unproject((i * 37) % 800, (i * 53) % 600, LENS).alias("d"))
    return p.withColumn("p", g.project(F.col("d"), LENS)).select("p_partkey", F.round("p.u", 6).alias("u"), F.round("p.v", 6).alias("v"))


PLACES = """(SELECT n_nationkey AS id, (n_nationkey * 37) % 360 - 180.0 AS yaw, (n_nationkey * 23) % 160 - 80.0 AS pitch FROM nation)"""
POSES = """(SELECT c_custkey AS id, (c_custkey * 41) % 360 - 180.0 AS yaw, (c_custkey * 29) % 170 - 85.0 AS pitch FROM customer)"""
DIR = "-sin(radians(yaw)) * cos(radians(pitch)) AS x, sin(radians(pitch)) AS y, cos(radians(yaw)) * cos(radians(pitch)) AS z"
TARGETS = f"t AS (SELECT id AS target, {DIR} FROM {PLACES}), p AS (SELECT id AS pose, {DIR} FROM {POSES})"
ANGLE = "atan2(sqrt(power({a}.y * {b}.z - {a}.z * {b}.y, 2) + power({a}.z * {b}.x - {a}.x * {b}.z, 2) + power({a}.x * {b}.y - {a}.y * {b}.x, 2)), {a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"
PT = ANGLE.format(a="p", b="t")


def targets(spark: SparkSession, sf: str) -> DataFrame:
    """A capture plan, a direction for each of the 25 nations."""
    k = F.col("n_nationkey")
    return read(spark, sf, "nation", "n_nationkey").select(k.alias("target"), g.from_angles((k * 37) % 360 - 180.0, (k * 23) % 160 - 80.0).alias("direction"))


def poses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf, "customer", "c_custkey").select(k.alias("pose"), g.from_angles((k * 41) % 360 - 180.0, (k * 29) % 170 - 85.0).alias("direction"))


@query(f"WITH {TARGETS} SELECT pose, arg_min(target, [round({PT}, 12), target]) AS target, round(min({PT}), 9) AS angle FROM p, t GROUP BY pose")
def nearest_target(spark, sf):
    return rounded(matching.nearest_target(poses(spark, sf), targets(spark, sf)), angle=9)


@query(f"WITH {TARGETS} SELECT pose, arg_min(target, [round({PT}, 12), target]) AS target, round(min({PT}), 9) AS angle FROM p, t GROUP BY pose HAVING min({PT}) < 0.2")
def within_cone(spark, sf):
    return rounded(matching.nearest_target(poses(spark, sf), targets(spark, sf), within=0.2), angle=9)


@query(f"WITH {TARGETS} SELECT pose AS id, CAST(count(*) FILTER ({PT} <= 0.6) AS INT) AS n FROM p, t GROUP BY pose")
def coverage_count(spark, sf):
    return matching.coverage(poses(spark, sf).withColumnRenamed("pose", "id"), targets(spark, sf), 0.6)


@query(f"WITH {TARGETS} SELECT a.target, count(b.target) AS n FROM t a LEFT JOIN t b ON a.target <> b.target AND {ANGLE.format(a='a', b='b')} <= 0.5 GROUP BY 1")
def neighbour_count(spark, sf):
    return matching.neighbours(targets(spark, sf), 0.5)


@query(f"""WITH f AS (SELECT id AS frame, id % 7 = 0 AS unknown, {DIR} FROM (SELECT s_suppkey - 1 AS id, (s_suppkey * 37) % 360 - 180.0 AS yaw, (s_suppkey * 23) % 160 - 80.0 AS pitch FROM supplier)), n AS (SELECT count(*) AS n FROM f)
SELECT a.frame AS a, b.frame AS b, CAST(a.frame * (2 * n - 1 - a.frame) // 2 + b.frame - a.frame - 1 AS BIGINT) AS pair FROM n, f a JOIN f b ON a.frame < b.frame AND (a.unknown OR b.unknown OR {ANGLE.format(a='a', b='b')} <= 0.9)""")
def pair_overlap_join(spark, sf):
    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier", "s_suppkey")
    f = s.select((k - 1).alias("frame"), F.when((k - 1) % 7 != 0, g.from_angles((k * 37) % 360 - 180.0, (k * 23) % 160 - 80.0)).alias("direction"))
    return matching.overlap_pairs(f, s.count(), 0.8, 0.1)


@query(f"""WITH {TARGETS}, r AS (SELECT *, cos(0.5) AS c, sin(0.5) AS s FROM t)
SELECT target, round(degrees(atan2(c * x - s * z, s * x + c * z)), 6) AS yaw, round(-degrees(atan2(y, sqrt(power(c * x - s * z, 2) + power(s * x + c * z, 2)))), 6) AS pitch FROM r""")
def guidance_offset(spark, sf):
    """How far a camera turned by half a radian about the vertical is off each target."""
    turn = g.exp_so3(g.vec(F.lit(0.0), F.lit(0.5), F.lit(0.0)))
    o = targets(spark, sf).select("target", g.guidance(g.rotate(turn, F.col("direction"), transposed=True)).alias("o"))
    return o.select("target", F.round("o.yaw", 6).alias("yaw"), F.round("o.pitch", 6).alias("pitch"))


@query("""WITH v AS (SELECT c_custkey, ((c_custkey * 13) % 21 - 10) / 16.0 AS x, ((c_custkey * 7) % 19 - 9) / 16.0 AS y, ((c_custkey * 11) % 17 - 8) / 16.0 AS z FROM customer)
SELECT c_custkey, round(sqrt(x * x + y * y + z * z), 9) AS angle, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, 1.0 AS det FROM v""")
def rotation_round_trip(spark, sf):
    """Rotation vectors to matrices and back."""
    k = F.col("c_custkey")
    v = g.vec(((k * 13) % 21 - 10) / 16.0, ((k * 7) % 19 - 9) / 16.0, ((k * 11) % 17 - 8) / 16.0)
    m = read(spark, sf, "customer", "c_custkey").select("c_custkey", g.exp_so3(v).alias("m"))
    m = m.select("c_custkey", g.rotation_angle(F.col("m")).alias("angle"), g.log_so3(F.col("m")).alias("w"), g.determinant(F.col("m")).alias("det"))
    plain = lambda c_: F.round(c_, 9) + 0.0
    return m.select("c_custkey", F.round("angle", 9).alias("angle"), *[plain(F.col(f"w.{a}")).alias(a) for a in "xyz"], F.round("det", 9).alias("det"))


@query("""WITH q AS (SELECT c_custkey, ((c_custkey * 13) % 21 - 10) / 20.0 AS x, ((c_custkey * 7) % 19 - 9) / 20.0 AS y, ((c_custkey * 11) % 17 - 8) / 20.0 AS z FROM customer),
u AS (SELECT *, sqrt(greatest(0.0, 1 - x * x - y * y - z * z)) AS w FROM q)
SELECT c_custkey, round(1 - 2 * (y * y + z * z), 9) AS m00, round(2 * (x * y - w * z), 9) AS m01, round(2 * (x * z + w * y), 9) AS m02, round(2 * (y * z - w * x), 9) AS m12 FROM u""")
def device_orientation(spark, sf):
    """Sensor rotation vectors of three values to rotation matrices."""
    k = F.col("c_custkey")
    q = g.quaternion(((k * 13) % 21 - 10) / 20.0, ((k * 7) % 19 - 9) / 20.0, ((k * 11) % 17 - 8) / 20.0)
    m = read(spark, sf, "customer", "c_custkey").select("c_custkey", g.matrix_of(q).alias("m"))
    return m.select("c_custkey", *[F.round(F.col("m")[i], 9).alias(n) for i, n in ((0, "m00"), (1, "m01"), (2, "m02"), (5, "m12"))])


FOV_H, FOV_V = g.fov_deg(LENS.width, LENS.fx), g.fov_deg(LENS.height, LENS.fy)


PLAN_SQL = f"""WITH s AS (SELECT {FOV_H!r} AS hf, {FOV_V!r} AS vf), m AS (SELECT hf * 0.65 AS hs, vf * 0.65 AS vs, 90 - vf / 2 AS top FROM s),
k AS (SELECT *, greatest(1, ceil(2 * top / vs - 1e-9)) AS steps FROM m),
r AS (SELECT CAST(i AS INT) AS ring, -top + 2 * top * i / steps AS pitch, hs FROM (SELECT *, unnest(range(0, CAST(steps AS INT) + 1)) AS i FROM k)),
n AS (SELECT *, CAST(greatest(1, ceil(360 / (hs / greatest(0.15, cos(radians(pitch)))) - 1e-9)) AS INT) AS count FROM r),
t AS (SELECT ring, pitch, count, unnest(range(0, count)) AS j FROM n),
a AS (SELECT ring, CASE WHEN ring % 2 = 1 THEN count - 1 - j ELSE j END AS seq, -180 + 360.0 * j / count AS yaw, pitch FROM t
  UNION ALL SELECT -1, 0, 0.0, -90.0 UNION ALL SELECT 1000, 0, 0.0, 90.0)
SELECT CAST(row_number() OVER (ORDER BY ring, seq) - 1 AS INT) AS target, round(yaw, 9) AS yaw, round(pitch, 9) AS pitch FROM a"""


@query("""WITH s AS (SELECT s_suppkey, 40.0 + s_suppkey % 40 AS hf, 30.0 + s_suppkey * 7 % 30 AS vf FROM supplier), m AS (SELECT s_suppkey, hf * 0.65 AS hs, vf * 0.65 AS vs, 90 - vf / 2 AS top FROM s),
k AS (SELECT *, CAST(greatest(1, ceil(2 * top / vs - 1e-9)) AS INT) AS steps FROM m), r AS (SELECT s_suppkey, hs, CAST(range AS INT) AS ring, -top + 2 * top * range / steps AS pitch FROM k, range(60) WHERE range <= steps),
n AS (SELECT *, CAST(greatest(1, ceil(360 / (hs / greatest(0.15, cos(radians(pitch)))) - 1e-9)) AS INT) AS count FROM r),
t AS (SELECT s_suppkey, ring, pitch, count, range AS j FROM n, range(200) WHERE range < count),
a AS (SELECT s_suppkey, ring, CASE WHEN ring % 2 = 1 THEN count - 1 - j ELSE j END AS seq, -180 + 360.0 * j / count AS yaw, pitch FROM t UNION ALL SELECT s_suppkey, -1, 0, 0.0, -90.0 FROM s UNION ALL SELECT s_suppkey, 1000, 0, 0.0, 90.0 FROM s)
SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY ring, seq) - 1 AS INT) AS target, round(yaw, 9) AS yaw, round(pitch, 9) AS pitch FROM a""")
def capture_plan_rings(spark, sf):
    """Where each device shoots, by its fields of view."""
    from ..operators.planning import capture_plans

    k = F.col("s_suppkey")
    return rounded(capture_plans(read(spark, sf, "supplier", "s_suppkey"), ["s_suppkey"], 40.0 + k % 40, 30.0 + k * 7 % 30), yaw=9, pitch=9)


# --- matching -------------------------------------------------------------------------------------------

def descriptors(spark: SparkSession, sf: str) -> DataFrame:
    """The signs of an embedding as 64 packed bits; its label stands for the frame."""
    bit = lambda i: F.when(F.col("embedding")[i] > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    e = read(spark, sf, "embeddings", "vec_id", "embedding", "label")
    packed = bit(0)
    for i in range(1, 64):
        packed = packed.bitwiseOR(bit(i))
    return e.select("label", F.col("vec_id").alias("kp"), packed.alias("desc"))


KNN = """WITH b AS (SELECT label, vec_id AS kp, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings),
l AS (SELECT label, kp, bits FROM b WHERE kp % 2 = 0), r AS (SELECT label, kp, bits FROM b WHERE kp % 2 = 1),
m AS (SELECT l.label, l.kp AS ka, r.kp AS kb, list_sum(list_transform(list_zip(l.bits, r.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS d FROM l JOIN r USING (label)),
k AS (SELECT *, row_number() OVER (PARTITION BY label, ka ORDER BY d, kb) AS rank, lead(d) OVER (PARTITION BY label, ka ORDER BY d, kb) AS second,
  row_number() OVER (PARTITION BY label, kb ORDER BY d, ka) AS back FROM m),
h AS (SELECT * FROM k WHERE rank = 1 AND d <= 96 AND (second IS NULL OR d < second * 0.95 OR d = 0 AND second = 0)) """


def matched(spark: SparkSession, sf: str, cross: bool) -> DataFrame:
    d = descriptors(spark, sf)
    cfg = c.Matching(ratio=0.95)
    return matching.knn_ratio(d.where("kp % 2 = 0"), d.where("kp % 2 = 1"), ["label"], cfg, cross).withColumn("distance", F.col("distance").cast("int"))


@query(KNN + "SELECT label, ka, kb, CAST(d AS INT) AS distance FROM h")
def hamming_knn_ratio(spark, sf):
    return matched(spark, sf, False)


@query(KNN + "SELECT label, ka, kb, CAST(d AS INT) AS distance FROM h WHERE back = 1")
def hamming_cross_check(spark, sf):
    return matched(spark, sf, True)


POINTS = "SELECT l_orderkey * 8 + l_linenumber AS id, l_returnflag = 'N' AS side, min((l_partkey * 3779 + l_orderkey) % 40000 / 4.0) AS x, min((l_suppkey * 7919 + l_orderkey * 31) % 40000 / 4.0) AS y FROM lineitem GROUP BY 1, 2"


@query(f"""WITH p AS ({POINTS}), m AS (SELECT a.id AS a, b.id AS b, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d2 FROM p a JOIN p b ON a.x BETWEEN b.x - 16 AND b.x + 16 AND a.y BETWEEN b.y - 16 AND b.y + 16
  WHERE NOT a.side AND b.side AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 16 * 16),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, a) AS rb FROM m)
SELECT a, b, d2 FROM k WHERE ra = 1 AND rb = 1""")
def grid_range_knn(spark, sf):
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")
    x, y = (F.col("l_partkey") * 3779 + F.col("l_orderkey")) % 40000 / 4.0, (F.col("l_suppkey") * 7919 + F.col("l_orderkey") * 31) % 40000 / 4.0
    p = li.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_returnflag") == "N").alias("side")).agg(F.min(x).alias("x"), F.min(y).alias("y"))
    return matching.mutual_nearest(p.where("not side"), p.where("side"), 16.0)


@query("""WITH plan AS (SELECT o_orderkey, unnest(range(1, CAST(2 + o_orderkey % 2 AS INT) + 1)) AS rung FROM orders),
t AS (SELECT o_orderkey, count(*) AS wanted FROM plan GROUP BY 1), s AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT o_orderkey, count(*) AS brackets FROM plan JOIN s ON l_orderkey = o_orderkey AND l_linenumber = rung JOIN t USING (o_orderkey) GROUP BY o_orderkey, wanted HAVING count(*) = wanted""")
def complete_bracket(spark, sf):
    o = read(spark, sf, "orders", "o_orderkey")
    plan = o.select("o_orderkey", F.explode(F.sequence(F.lit(1), (F.col("o_orderkey") % 2 + 2).cast("int"))).alias("rung"))
    frames = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("rung"))
    return matching.complete(frames, plan, "o_orderkey", "rung")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_record(spark, sf):
    e = read(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return matching.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""WITH RECURSIVE a AS (SELECT CAST(user_id % 10 AS VARCHAR) AS camera, event_id, event_id // 40 AS stamp, event_type IN ('view', 'click') AS image FROM events WHERE event_type <> 'error'),
e AS (SELECT *, row_number() OVER (PARTITION BY camera ORDER BY event_id) AS n FROM a),
r AS (
  SELECT DISTINCT camera, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(s BIGINT, v BIGINT)[]) AS images, CAST([] AS STRUCT(s BIGINT, v BIGINT)[]) AS metas, CAST(NULL AS BIGINT) AS stamp, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS m FROM e
  UNION ALL
  SELECT camera, n, CASE WHEN image AND half IS NULL THEN kept WHEN NOT image AND half IS NOT NULL THEN rest ELSE images END, CASE WHEN NOT image AND half IS NULL THEN kept WHEN image AND half IS NOT NULL THEN rest ELSE metas END,
    CASE WHEN half IS NOT NULL THEN tick END, CASE WHEN half IS NULL THEN NULL WHEN image THEN event_id ELSE half END, CASE WHEN half IS NULL THEN NULL WHEN image THEN half ELSE event_id END
  FROM (
    SELECT *, list_filter(other, lambda x: x.s = tick)[1].v AS half, list_filter(other, lambda x: x.s <> tick) AS rest, list_append(list_filter(own, lambda x: x.s <> tick), struct_pack(s := tick, v := event_id)) AS grown,
      CASE WHEN len(grown) > 3 THEN list_filter(grown, lambda x: x.s <> list_min(list_transform(grown, lambda y: y.s))) ELSE grown END AS kept
    FROM (SELECT e.camera, e.n, e.event_id, e.image, e.stamp AS tick, r.images, r.metas, CASE WHEN e.image THEN r.images ELSE r.metas END AS own, CASE WHEN e.image THEN r.metas ELSE r.images END AS other FROM r JOIN e ON e.camera = r.camera AND e.n = r.n + 1))
)
SELECT camera, stamp, i AS image, m AS meta FROM r WHERE stamp IS NOT NULL""")
def pair_by_timestamp(spark, sf):
    """Images and results of each camera, paired as they arrive; three of a side may wait."""
    from ..streaming.pairing import pair

    return pair(arrivals(spark, sf), 3)


def arrivals(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events", "event_id", "user_id", "event_type").where("event_type <> 'error'")
    side = F.when(F.col("event_type").isin("view", "click"), "image").otherwise("meta")
    return e.select((F.col("user_id") % 10).cast("string").alias("camera"), F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 40).cast("long").alias("stamp"), side.alias("side"), F.col("event_id").alias("value"))


LENSES = "SELECT p_partkey // 40 AS device, p_partkey AS id, p_size % 2 = 0 AS front, p_size // 10 AS sensor, (p_partkey * 7) % 40 / 100.0 AS focal, p_partkey % 3 = 0 AS physical FROM part"


@query(f"WITH l AS ({LENSES}) SELECT id FROM l a WHERE NOT (physical AND EXISTS (SELECT 1 FROM l b WHERE NOT b.physical AND a.device = b.device AND a.front = b.front AND a.sensor = b.sensor AND abs(a.focal - b.focal) <= 0.05))")
def lens_dedup(spark, sf):
    """Devices of forty parts, which stand for lenses."""
    p = read(spark, sf, "part", "p_partkey", "p_size")
    k = F.col("p_partkey")
    lenses = p.select(F.floor(k / 40).alias("device"), k.alias("id"), (F.col("p_size") % 2 == 0).alias("front"), F.floor(F.col("p_size") / 10).alias("sensor"), ((k * 7) % 40 / 100.0).alias("focal"), (k % 3 == 0).alias("physical"))
    return matching.dedupe_lenses(lenses, ["device"]).select("id")


# --- graphs and solves ----------------------------------------------------------------------------------

EDGES = "SELECT o_orderkey AS a, o_orderkey - CASE WHEN (o_orderkey * 7) % 10 < 8 THEN 1 ELSE 0 END AS b FROM orders"
CC = f"""WITH RECURSIVE e AS ({EDGES}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS id FROM u),
reach AS (SELECT id, id AS c FROM n UNION SELECT u.b, reach.c FROM reach JOIN u ON u.a = reach.id), l AS (SELECT id, min(c) AS component FROM reach GROUP BY id) """


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is a node, most are tied to the one before."""
    k = F.col("o_orderkey")
    e = read(spark, sf, "orders", "o_orderkey").select(k.alias("a"), (k - F.when((k * 7) % 10 < 8, 1).otherwise(0)).alias("b"))
    nodes = e.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return graph.components(nodes, e)


@query(CC + "SELECT id, component FROM l")
def connected_components(spark, sf):
    return labels(spark, sf)


@query(CC + "SELECT component, count(*) AS members FROM l GROUP BY 1")
def component_sizes(spark, sf):
    return graph.component_sizes(labels(spark, sf))


@query("SELECT CAST(least(25, floor(n / 4)) AS INT) AS bucket, count(*) AS pairs FROM (SELECT l_suppkey, l_linenumber, count(*) // 3 AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def inlier_histogram(spark, sf):
    pairs = read(spark, sf, "lineitem", "l_suppkey", "l_linenumber").groupBy("l_suppkey", "l_linenumber").agg(F.floor(F.count("*") / 3).alias("n"))
    return graph.inlier_histogram(pairs, "n")


@query("""SELECT count(*) AS pairs, count(*) FILTER (m >= 12) AS matched, count(*) FILTER (i >= 12) AS verified, count(*) FILTER (m >= 12 AND i <= 3) AS inconsistent
FROM (SELECT l_partkey, count(*) AS m, count(*) FILTER (l_returnflag = 'R') AS i FROM lineitem GROUP BY 1)""")
def match_funnel(spark, sf):
    pairs = read(spark, sf, "lineitem", "l_partkey", "l_returnflag").groupBy("l_partkey").agg(F.count("*").alias("m"), F.count_if(F.col("l_returnflag") == "R").alias("i"))
    return graph.match_funnel(pairs, "m", "i")


def photometric(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount")
    return li.select((F.col("l_suppkey") % 12).alias("a"), (F.col("l_partkey") % 12).alias("b"), F.col("l_extendedprice").alias("va"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("vb"), F.col("l_quantity").alias("w"))


@query("""SELECT l_suppkey % 12 AS a, l_partkey % 12 AS b, round(sum(l_quantity), 4) AS w, round(sum(l_quantity * (ln(l_extendedprice * (1 - l_discount)) - ln(l_extendedprice))), 4) AS wr
FROM lineitem WHERE l_suppkey % 12 <> l_partkey % 12 AND l_quantity > 0 AND l_extendedprice > 0 AND l_discount < 1 GROUP BY 1, 2""")
def gain_normal_equations(spark, sf):
    return rounded(solve.gain_equations(photometric(spark, sf)), w=4, wr=4)


@query("SELECT CAST(range AS INT) AS frame, round(exp((range * 5 % 12 - 5.5) / 20), 6) AS gain FROM range(12)")
def gain_solve(spark, sf):
    """Robust gains of twelve frames, solved on the driver from sums; the samples follow known gains."""
    log = lambda k: (k * 5 % 12 - 5.5) / 20
    p = photometric(spark, sf)
    seen = p.withColumn("vb", F.col("va") * F.exp(log(F.col("a")) - log(F.col("b"))))
    gains = solve.gains(seen, 12, rounds=4)
    table = F.array(*[F.lit(v) for v in gains])
    return spark.range(12).select(F.col("id").cast("int").alias("frame"), F.round(F.element_at(table, F.col("id").cast("int") + 1), 6).alias("gain"))


def bearings(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    d = read(spark, sf, "customer", "c_custkey", "c_nationkey").select("c_nationkey", g.from_angles((k * 41) % 360 - 180.0, (k * 29) % 170 - 85.0).alias("p"))
    return d.withColumn("q", g.rotate(g.exp_so3(g.vec(F.lit(0.02), F.lit(0.3), F.lit(-0.1))), F.col("p")))


@query(f"""WITH p AS (SELECT c_nationkey, {DIR} FROM (SELECT c_nationkey, (c_custkey * 41) % 360 - 180.0 AS yaw, (c_custkey * 29) % 170 - 85.0 AS pitch FROM customer))
SELECT c_nationkey, round(sum(x * x), 6) AS s_xx, round(sum(x * y), 6) AS s_xy, round(sum(y * z), 6) AS s_yz, round(sum(z * z), 6) AS s_zz FROM p GROUP BY 1""")
def kabsch_sums(spark, sf):
    s = solve.outer_sums(bearings(spark, sf).withColumn("q", F.col("p")), ["c_nationkey"])
    return s.select("c_nationkey", *[(F.round(k, 6) + 0.0).alias(k) for k in ("s_xx", "s_xy", "s_yz", "s_zz")])


T = math.sqrt(0.02**2 + 0.3**2 + 0.1**2)


@query(f"SELECT c_nationkey, CAST(count(*) AS INT) AS matches, CAST(count(*) AS INT) AS inliers, round({T!r}, 6) AS angle FROM customer GROUP BY 1 HAVING count(*) > 1")
def pair_rotation(spark, sf):
    """The rotation of each nation's bearings by consensus."""
    m = bearings(spark, sf).select("c_nationkey", *[F.col(f"{v}.{a}").alias(v + a) for v in "pq" for a in "xyz"])
    out = solve.pair_rotations(m, ["c_nationkey"])
    angle = g.rotation_angle(F.col("rotation"))
    return out.where("matches > 1").select("c_nationkey", "matches", "inliers", F.round(angle, 6).alias("angle"))


@query("SELECT c_nationkey, round(degrees(sqrt(0.0)), 6) + 0.0 AS rms_deg FROM customer GROUP BY 1")
def rms_error(spark, sf):
    """Error left after the true rotation is taken back."""
    back = g.exp_so3(g.vec(F.lit(-0.02), F.lit(-0.3), F.lit(0.1)))
    b = bearings(spark, sf).withColumn("q", g.rotate(back, F.col("q")))
    return rounded(solve.rms_angle(b, ["c_nationkey"]), rms_deg=6)


# --- compositing ----------------------------------------------------------------------------------------

@query("""SELECT l_partkey, round(sum(l_quantity * l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS value, sum(l_quantity) AS coverage, count(*) AS contributors
FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def composite_weighted_mean(spark, sf):
    li = read(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_extendedprice", "l_discount").withColumn("gain", 1 - F.col("l_discount"))
    return rounded(composite.composite(li, ["l_partkey"], "l_extendedprice", "l_quantity", "gain"), value=4)


@query("SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45) THEN 1.0 ELSE 0.0 END), 9) AS covered FROM part")
def covered_fraction(spark, sf):
    li = read(spark, sf, "lineitem", "l_partkey", "l_quantity", "l_extendedprice").where("l_quantity >= 45").withColumnRenamed("l_partkey", "p_partkey")
    done = composite.composite(li, ["p_partkey"], "l_extendedprice", "l_quantity")
    return rounded(composite.covered_fraction(read(spark, sf, "part", "p_partkey"), done, ["p_partkey"]), covered=9)


@query("""SELECT l_orderkey, l_linenumber, round(u * u * (3 - 2 * u), 9) AS w FROM (SELECT *, greatest(0.0, least(1.0, least(x + 0.5, 47.5 - x, y + 0.5, 31.5 - y) / 10)) AS u
FROM (SELECT l_orderkey, l_linenumber, l_suppkey % 32 AS y, l_partkey % 48 AS x FROM lineitem))""")
def feather_weight(spark, sf):
    """How much of a frame's pixel is blended, by its distance to the frame's edge."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").withColumns({"y": F.col("l_suppkey") % 32, "x": F.col("l_partkey") % 48})
    return li.select("l_orderkey", "l_linenumber", F.round(r.feather(F.col("x"), F.col("y"), 48, 32, 10.0), 9).alias("w"))


def sphere_sql(k: c.Lens, width: int, height: int, feather: float, select: str, pixels: str) -> str:
    """SQL of a whole capture plan seen from every sphere pixel; pixels has n, y, x; w has these, target, u, v and the smooth weight g."""
    return f"""WITH plan AS ({PLAN_SQL}),
f AS (SELECT target, -sin(radians(yaw)) * cos(radians(pitch)) AS fx, sin(radians(pitch)) AS fy, cos(radians(yaw)) * cos(radians(pitch)) AS fz FROM plan),
u AS (SELECT *, CASE WHEN abs(fy) > 0.999 THEN fx * fz ELSE fx * fy END AS ax, CASE WHEN abs(fy) > 0.999 THEN fy * fz ELSE fy * fy - 1 END AS ay, CASE WHEN abs(fy) > 0.999 THEN fz * fz - 1 ELSE fz * fy END AS az FROM f),
n AS (SELECT target, fx, fy, fz, ax / m AS dx, ay / m AS dy, az / m AS dz FROM (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS m FROM u)),
t AS (SELECT *, dy * fz - dz * fy AS rx, dz * fx - dx * fz AS ry, dx * fy - dy * fx AS rz FROM n),
p AS (SELECT n, y, x, (x + 0.5) / {width} * 2 * pi() - pi() AS lon, pi() / 2 - (y + 0.5) / {height} * pi() AS lat FROM ({pixels})),
d AS (SELECT n, y, x, -sin(lon) * cos(lat) AS a, sin(lat) AS b, cos(lon) * cos(lat) AS c FROM p),
s AS (SELECT n, y, x, target, a * rx + b * ry + c * rz AS cx, a * dx + b * dy + c * dz AS cy, a * fx + b * fy + c * fz AS cz FROM d, t),
i AS (SELECT n, y, x, target, {k.fx} * cx / cz + {k.cx} AS u, {k.fy} * cy / cz + {k.cy} AS v FROM s WHERE cz > 1e-12),
e AS (SELECT *, greatest(0.0, least(1.0, least(u + 0.5, {k.width} - 0.5 - u, v + 0.5, {k.height} - 0.5 - v) / {feather})) AS k FROM i WHERE u BETWEEN -0.5 AND {k.width} - 0.5 AND v BETWEEN -0.5 AND {k.height} - 0.5),
w AS (SELECT *, k * k * (3 - 2 * k) AS g FROM e) {select}"""


@query(sphere_sql(c.Lens(), WIDTH, HEIGHT, 60, "SELECT n, y, x, round(sum(g * (1 + (target * 7 + n) % 5 / 10.0) * (u + v) / 1400) / sum(g), 6) AS value, round(sum(g), 6) AS coverage, count(*) AS contributors FROM w WHERE g > 0 GROUP BY 1, 2, 3",
  f"SELECT DISTINCT c_nationkey AS n, CAST(c_custkey * 53 % {HEIGHT} AS INT) AS y, CAST(c_custkey * 37 % {WIDTH} AS INT) AS x FROM customer"))
def composite_sphere(spark, sf):
    """Frames of a whole capture plan blended onto spheres by inverse mapping: for each nation, the pixels of its customers."""
    from ..operators.planning import capture_plan

    plan = capture_plan(spark, c.Lens()).select(F.col("target").alias("frame"), g.looking_at(F.col("yaw"), F.col("pitch")).alias("rotation"), F.lit(1.0).alias("gain"))
    k = F.col("c_custkey")
    pixels = read(spark, sf, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey").alias("n"), (k * 53 % HEIGHT).cast("int").alias("y"), (k * 37 % WIDTH).cast("int").alias("x")).distinct()
    s = composite.contributions(pixels, plan, WIDTH, HEIGHT, c.Lens(), 60.0).withColumn("v", (1 + (F.col("frame") * 7 + F.col("n")) % 5 / 10.0) * (F.col("u") + F.col("v")) / 1400)
    return rounded(composite.composite(s, ["n", "y", "x"], "v", "w", "gain"), value=6, coverage=6)


SMALL = c.Lens(40, 30, 30.0, 30.0, 19.5, 14.5)


LIGHT = "l AS (SELECT avg(l_discount) AS p, avg(l_tax) AS q, avg(l_quantity) / 500 AS r FROM lineitem)"


@query(sphere_sql(SMALL, 64, 32, 4, f", {LIGHT} SELECT d.y, d.x, round(0.4 + p * a + q * b + r * c, 6) AS scene, true AS near FROM d SEMI JOIN (SELECT y, x FROM w WHERE g > 0) w USING (y, x), l",
  "SELECT 0 AS n, CAST(range // 64 AS INT) AS y, CAST(range % 64 AS INT) AS x FROM range(2048)"))
def sphere_pipeline(spark, sf):
    """A whole capture in one call: brackets of a plan's frames, each dimmer or brighter than it should be and its prior
    turned a little off, aligned from what they see together, balanced, cut along seams and blended, to the light
    that the table says; `near` where a pixel comes within a hundredth of it."""
    import numpy as np

    from ..operators import sphere
    from ..operators.planning import capture_plan

    plan = capture_plan(spark, SMALL).select("target", g.looking_at(F.col("yaw"), F.col("pitch")).alias("r")).orderBy("target").collect()  # tens of frames
    truth = [np.array(p["r"]).reshape(3, 3) for p in plan]
    n, i = len(truth), F.col("id")
    table = F.array(*[F.array(*[F.lit(float(v)) for v in r.ravel()]) for r in truth])
    light = read(spark, sf, "lineitem", "l_discount", "l_tax", "l_quantity").agg(F.avg("l_discount"), F.avg("l_tax"), F.avg("l_quantity") / 500).first()
    scene = lambda d: g.bind(d, lambda v: 0.4 + light[0] * v["x"] + light[1] * v["y"] + light[2] * v["z"])
    frame = F.floor(i / 1200).cast("int")
    log_gain = (F.col("frame") * 5 % n - (n - 1) / 2.0) / 100.0
    px = spark.range(n * 1200).select(frame.alias("frame"), (F.floor(i / 40) % 30).cast("int").alias("y"), (i % 40).cast("int").alias("x"))
    px = px.withColumn("radiance", F.exp(-log_gain) * scene(g.rotate(F.element_at(table, F.col("frame") + 1), g.unproject(F.col("x"), F.col("y"), SMALL))))
    rungs = F.explode(F.array(*[F.lit(v) for v in (0.25, 1.0, 4.0)])).alias("rel")
    samples = px.select("frame", "y", "x", "radiance", rungs).select("frame", "y", "x", F.least(F.lit(1.0), F.col("radiance") * F.col("rel")).alias("v"), "rel", F.lit(1.0).alias("gain"))
    world = spark.range(600).select(g.from_angles((i * 41) % 360 - 180.0, F.degrees(F.asin((i * 29 % 599) / 299.5 - 1.0))).alias("d"))
    seen = world.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("p", g.rotate(F.element_at(table, F.col("frame") + 1), F.col("d"), transposed=True)).where(g.visible(F.col("p"), SMALL))
    both = seen.select("d", F.col("frame").alias("a"), "p").join(seen.select("d", F.col("frame").alias("b"), F.col("p").alias("q")), "d").where("a < b")
    matches = both.select("a", "b", *[F.col(f"{v}.{x}").alias(v + x) for v in "pq" for x in "xyz"])
    priors = [solve.exp_so3(np.array([0.01 * (k % 3 - 1), 0.01 * (k % 5 - 2), 0.0])) @ r for k, r in enumerate(truth)]
    rotations, _, _ = sphere.aligned(matches, priors)
    level = truth[0] @ rotations[0].T  # the priors' consensus is off by what they are; the sphere is put level again
    out = sphere.process(samples, [level @ r for r in rotations], SMALL, 64, 32, 4.0, seam_width=16)
    light_at = scene(g.direction(F.col("x"), F.col("y"), 64, 32))
    return out.select("y", "x", F.round(light_at, 6).alias("scene"), (F.abs(F.col("value") - light_at) < 0.01).alias("near"))


SEAM_SQL = "s AS (SELECT l_partkey % 1536 AS pixel, l_suppkey % 4 AS label, round(avg(l_extendedprice) / 10000, 6) AS log_value, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2)"
INIT_SQL = "i AS (SELECT pixel, arg_max(label, [weight, -label]) AS label FROM s GROUP BY pixel)"


def seam_samples(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return li.groupBy((F.col("l_partkey") % 1536).alias("pixel"), (F.col("l_suppkey") % 4).alias("label")).agg(F.round(F.avg("l_extendedprice") / 10000, 6).alias("log_value"), F.sum("l_quantity").alias("weight"))


@query(f"WITH {SEAM_SQL}, {INIT_SQL} SELECT pixel, label FROM i")
def seam_init_argmax(spark, sf):
    return composite.initial_labels(seam_samples(spark, sf))


@query(f"""WITH {SEAM_SQL}, {INIT_SQL}, x AS (SELECT pixel, max(weight) AS best FROM s GROUP BY 1),
d AS (SELECT sum(CASE WHEN s.weight IS NULL THEN 1e6 ELSE best - s.weight END) AS data FROM i JOIN x USING (pixel) LEFT JOIN s USING (pixel, label)),
e AS (SELECT pixel AS a, CASE WHEN pixel % 48 + 1 < 48 THEN pixel + 1 ELSE pixel // 48 * 48 END AS b FROM i UNION ALL SELECT pixel, pixel + 48 FROM i WHERE pixel // 48 + 1 < 32),
f AS (SELECT e.a, e.b, p.label AS la, q.label AS lb FROM e JOIN i p ON p.pixel = e.a JOIN i q ON q.pixel = e.b WHERE p.label <> q.label),
c AS (SELECT coalesce(sum(8 * (coalesce(abs(a1.log_value - a2.log_value), 0) + coalesce(abs(b1.log_value - b2.log_value), 0) + 0.02)), 0) AS seam FROM f
  LEFT JOIN s a1 ON a1.pixel = a AND a1.label = la LEFT JOIN s a2 ON a2.pixel = a AND a2.label = lb LEFT JOIN s b1 ON b1.pixel = b AND b1.label = la LEFT JOIN s b2 ON b2.pixel = b AND b2.label = lb)
SELECT round(data, 3) AS data, round(seam, 3) AS seam, round(data + seam, 3) AS energy FROM d, c""")
def seam_energy(spark, sf):
    s = seam_samples(spark, sf)
    init = composite.initial_labels(s)
    return rounded(composite.seam_energy(init, s, composite.grid_edges(init.select("pixel"), 48, 32)), data=3, seam=3, energy=3)


@query(f"""WITH {SEAM_SQL}, {INIT_SQL}, o AS (SELECT dy, dx, 1 - sqrt(dy * dy + dx * dx) / 3 AS w FROM (SELECT range - 2 AS dy FROM range(5)), (SELECT range - 2 AS dx FROM range(5)) WHERE sqrt(dy * dy + dx * dx) <= 2),
n AS (SELECT (pixel // 48 + dy) * 48 + (pixel % 48 + dx + 48) % 48 AS pixel, label, sum(w) AS w FROM i, o WHERE pixel // 48 + dy BETWEEN 0 AND 31 GROUP BY 1, 2),
k AS (SELECT n.* FROM n SEMI JOIN s USING (pixel, label))
SELECT pixel, label, round(w / sum(w) OVER (PARTITION BY pixel), 9) AS share FROM k""")
def region_feather(spark, sf):
    s = seam_samples(spark, sf)
    return rounded(composite.region_feather(composite.initial_labels(s), s, 48, 32, 2), share=9)


# --- progress, cost and text ----------------------------------------------------------------------------

STAGES = [(0, "view", 3.0), (1, "click", 1.0), (2, "signup", 0.0), (3, "purchase", 4.0)]
STAGE_SQL = "st AS (SELECT * FROM (VALUES (0, 'view', 3.0), (1, 'click', 1.0), (2, 'signup', 0.0), (3, 'purchase', 4.0)) v(seq, stage, weight)), so AS (SELECT seq, stage, (sum(weight) OVER (ORDER BY seq) - weight) / 8 AS begin, weight / 8 AS width FROM st)"


def stages(spark: SparkSession) -> DataFrame:
    return progress.stage_offsets(spark.sql("SELECT * FROM VALUES (0, 'view', 3.0D), (1, 'click', 1.0D), (2, 'signup', 0.0D), (3, 'purchase', 4.0D) AS v(seq, stage, weight)"))


@query("""WITH s AS (SELECT user_id, event_type AS stage, greatest(0, count(*) - 3) AS w FROM events GROUP BY 1, 2)
SELECT user_id, stage, round(coalesce((sum(w) OVER o - w) / nullif(sum(w) OVER k, 0), 0), 9) AS begin, round(coalesce(w / nullif(sum(w) OVER k, 0), 0), 9) AS width FROM s WINDOW k AS (PARTITION BY user_id), o AS (PARTITION BY user_id ORDER BY stage)""")
def prefix_offsets(spark, sf):
    """Where each stage of a user's job begins, by what the stages weigh; few events weigh nothing."""
    s = read(spark, sf, "events", "user_id", "event_type").groupBy("user_id", F.col("event_type").alias("stage")).agg((F.count("*") - 3.0).alias("weight"))
    return rounded(progress.stage_offsets(s.withColumn("seq", F.col("stage")), ["user_id"]).drop("seq"), begin=9, width=9)


@query(f"""WITH {STAGE_SQL} SELECT user_id, event_id, event_type AS stage, round(coalesce(max(begin + width * greatest(0.0, least(1.0, value / 100))) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0), 9) AS overall
FROM events LEFT JOIN so ON stage = event_type""")
def stage_progress_running_max(spark, sf):
    e = read(spark, sf, "events", "user_id", "ts", "event_id", "event_type", "value").select("user_id", "ts", "event_id", F.col("event_type").alias("stage"), (F.col("value") / 100).alias("fraction"))
    return rounded(progress.overall_progress(e, stages(spark), ["user_id"], ["ts", "event_id"]), overall=9).drop("ts")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_totalprice AS p, o_totalprice * (0.5 + o_orderkey % 7 / 4.0) AS a FROM orders WHERE o_totalprice >= 1),
f AS (SELECT o_custkey, CAST(0 AS BIGINT) AS n, CAST(1 AS DOUBLE) AS factor FROM (SELECT DISTINCT o_custkey FROM o)
  UNION ALL SELECT f.o_custkey, o.n, CASE WHEN a >= 1 THEN greatest(0.01, least(100.0, exp(0.6 * ln(factor) + 0.4 * ln(greatest(factor / 3, least(factor * 3, a / p)))))) ELSE factor END FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.n = f.n + 1)
SELECT o_custkey, round(arg_max(factor, n), 9) AS factor FROM f GROUP BY 1""")
def work_correction_fold(spark, sf):
    o = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_totalprice >= 1")
    jobs = o.withColumn("actual", F.col("o_totalprice") * (F.col("o_orderkey") % 7 / 4.0 + 0.5))
    return rounded(progress.work_factor(jobs, ["o_custkey"], "o_orderkey", "o_totalprice", "actual"), factor=9)


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN f >= 1 THEN 0 ELSE greatest(0, (CASE WHEN f <= 0 OR l_quantity <= 0 THEN 60.0 ELSE 60 * (1 - least(1, 3 * f)) + l_quantity / f * least(1, 3 * f) END) - l_quantity) END, 6) AS seconds
FROM (SELECT *, l_discount * 10 AS f FROM lineitem)""")
def time_remaining(spark, sf):
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return li.select("l_orderkey", "l_linenumber", F.round(progress.time_remaining(F.lit(60.0), F.col("l_quantity"), F.col("l_discount") * 10), 6).alias("seconds"))


@query("""SELECT p_partkey, round(n * px * 2 / (200.0 * 1048576) + n * px * 55e-9, 6) AS merge, round(p_size * (307200 + 921600) * 90e-9, 6) AS align, round(8388608.0 * p_size * 12e-9, 6) AS render,
  round(8388608 * 6 / (40.0 * 1048576), 6) AS write FROM (SELECT p_partkey, p_size, p_size * 4.0 AS n, 3000000.0 AS px FROM part)""")
def work_estimate(spark, sf):
    e = progress.work_estimate(F.col("p_size"), F.lit(4), F.lit(3000000), F.lit(4096), 55.0, 90.0, 12.0)
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", e.alias("e")).select("p_partkey", *[F.round(f"e.{k}", 6).alias(k) for k in ("merge", "align", "render", "write")])


@query("""SELECT o_orderkey, CASE WHEN s < 45 THEN 'about ' || s || ' seconds' WHEN s < 90 THEN 'about a minute' WHEN s < 3600 THEN 'about ' || CAST(floor(o_totalprice / 20 / 60 + 0.5) AS BIGINT) || ' minutes'
  ELSE printf('about %.1f hours', o_totalprice / 20 / 3600) END AS text FROM (SELECT *, CAST(floor(o_totalprice / 20 + 0.5) AS BIGINT) AS s FROM orders)""")
def duration_text(spark, sf):
    return read(spark, sf, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", progress.duration_text(F.col("o_totalprice") / 20).alias("text"))


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus, count(DISTINCT l_linenumber) AS targets, count(DISTINCT l_linenumber) FILTER (l_linestatus = 'F') AS shot FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN targets = 0 THEN 'NOTHING_SHOT' WHEN o_orderstatus = 'P' THEN 'PROCESSED' WHEN shot = 0 THEN 'NOTHING_SHOT' WHEN shot < targets THEN 'PARTLY_SHOT' ELSE 'SHOT_NOT_PROCESSED' END AS stage FROM s""")
def capture_stage(spark, sf):
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus")
    shots = li.groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("targets"), F.countDistinct(F.when(F.col("l_linestatus") == "F", F.col("l_linenumber"))).alias("shot"))
    s = read(spark, sf, "orders", "o_orderkey", "o_orderstatus").join(shots, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["targets", "shot"])
    return s.select("o_orderkey", progress.capture_stage(F.col("targets") > 0, F.col("o_orderstatus") == "P", F.col("targets"), F.col("shot")).alias("stage"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, value < 100 AS h, sum(CASE WHEN value < 100 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS run FROM events)
SELECT user_id, min(us) AS began, max(us) AS ended, count(*) AS events, max(us) - min(us) >= 3600000000 AS dwelt FROM e WHERE h GROUP BY user_id, run""")
def dwell_islands(spark, sf):
    e = read(spark, sf, "events", "user_id", "ts", "value").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return progress.dwell_islands(e, "user_id", "us", F.col("value") < 100, F.lit(3600000000))


@query(r"""SELECT doc_id, nullif(trim(substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 80)), '') AS name FROM documents""")
def name_clean(spark, sf):
    return read(spark, sf, "documents", "doc_id", "text").select("doc_id", text.clean_name(F.col("text")).alias("name"))


@query(r"""SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(p_name || ' / ' || p_brand, '[^\p{L}\p{Nd}_-]+', '-', 'g'), '-{2,}', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'part') AS slug FROM part""")
def file_slug(spark, sf):
    p = read(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    return p.select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_brand"), F.lit("part")).alias("slug"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) ELSE (1700000000000 + event_id) * 1000 END AS us FROM events")
def captured_at(spark, sf):
    e = read(spark, sf, "events", "event_id", "ts")
    folder = F.when(F.col("event_id") % 3 == 0, F.lit("holiday")).otherwise(F.concat(F.lit("capture-"), (F.col("event_id") + 1700000000000).cast("string")))
    return e.select("event_id", F.unix_micros(text.captured_at(folder, F.col("ts").cast("timestamp"))).alias("us"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_access(spark, sf):
    return read(spark, sf, "events", "event_id", "props").select("event_id", text.json_number(F.col("props"), "$.k").alias("k"))
