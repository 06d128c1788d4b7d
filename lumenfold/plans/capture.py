"""Queries of capture geometry, predicates, poses, device catalogues and small solves, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..functions import radiometry as r
from ..functions import text
from ..operators import capture, catalogue, composite, exposure, features, matching, raster, sampling, solve
from .common import read, rounded
from .scene import ANGLE, DIR

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def look(yaw: str, pitch: str, source: str, keep: str) -> str:
    """SQL of a camera that looks somewhere: its right, down and forward axes r*, d*, f*."""
    return f"""(SELECT {keep}, dy_ * fz - dz_ * fy AS rx, dz_ * fx - dx_ * fz AS ry, dx_ * fy - dy_ * fx AS rz, dx_ AS dx, dy_ AS dy, dz_ AS dz, fx, fy, fz FROM (
  SELECT *, fx * fy / n AS dx_, (fy * fy - 1) / n AS dy_, fz * fy / n AS dz_ FROM (SELECT *, sqrt(1 - fy * fy) AS n FROM (
  SELECT *, -sin(radians({yaw})) * cos(radians({pitch})) AS fx, sin(radians({pitch})) AS fy, cos(radians({yaw})) * cos(radians({pitch})) AS fz FROM {source}))))"""


K = c.Lens()
POSES_SQL = "(SELECT c_custkey AS id, (c_custkey * 41) % 360 - 180.0 AS yaw, (c_custkey * 29) % 160 - 80.0 AS pitch FROM customer)"


def customer_poses(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf, "customer", "c_custkey", "c_nationkey").select(k.alias("id"), F.col("c_nationkey").alias("nation"), ((k * 41) % 360 - 180.0).alias("yaw"), ((k * 29) % 160 - 80.0).alias("pitch"))


# --- predicates -----------------------------------------------------------------------------------------

@query(f"""WITH p AS (SELECT id, {DIR} FROM {POSES_SQL}), q AS (SELECT id, cos(a) * x + sin(a) * z AS x, y, cos(a) * z - sin(a) * x AS z FROM (SELECT *, (id % 20) / 100.0 AS a FROM p))
SELECT id FROM p JOIN q USING (id) WHERE id % 5 = 0 OR {ANGLE.format(a='p', b='q')} <= 0.0825""")
def believable_matches(spark, sf):
    """Matches seen where the poses predict them, within a tolerance; without a prediction they stay."""
    p = customer_poses(spark, sf).withColumn("d", g.from_angles(F.col("yaw"), F.col("pitch")))
    turned = g.rotate(g.exp_so3(g.vec(F.lit(0.0), F.col("id") % 20 / 100.0, F.lit(0.0))), F.col("d"))
    m = p.select("id", F.when(F.col("id") % 5 != 0, F.col("d")).alias("predicted"), turned.alias("seen"))
    return capture.believable(m, 0.0825).select("id")


@query(f"""WITH p AS (SELECT *, CASE WHEN id % 2 = 0 THEN (id % 25) / 50.0 ELSE 0 END AS roll, CASE WHEN id % 2 = 1 THEN (id % 15) / 40.0 ELSE 0 END AS turn FROM {POSES_SQL}),
e AS (SELECT *, 2 * asin(sin(turn / 2) * cos(radians(pitch))) AS aim, abs(roll) + abs(turn * sin(radians(pitch))) AS off FROM p)
SELECT id, round(aim, 6) AS aim, round(off, 6) AS roll, aim <= 0.1512 AND off <= 0.2011 AS within FROM e""")
def aim_and_roll(spark, sf):
    """Where a camera points and how it is rolled, judged apart; every other pose is rolled, the others turned."""
    p, k = customer_poses(spark, sf), F.col("id")
    roll = F.when(k % 2 == 0, (k % 25) / 50.0).otherwise(0.0)
    turn = F.when(k % 2 == 1, (k % 15) / 40.0).otherwise(0.0)
    zero = F.lit(0.0)
    pose = g.multiply(g.looking_at(F.col("yaw") + F.degrees(turn), F.col("pitch")), g.exp_so3(g.vec(zero, zero, roll)))
    t = p.select("id", pose.alias("pose"), g.looking_at(F.col("yaw"), F.col("pitch")).alias("target"))
    t = t.select("id", g.aim_error(F.col("pose"), F.col("target")).alias("a"), F.abs(g.roll_error(F.col("pose"), F.col("target"))).alias("o"))
    return t.select("id", F.round("a", 6).alias("aim"), F.round("o", 6).alias("roll"), ((F.col("a") <= 0.1512) & (F.col("o") <= 0.2011)).alias("within"))


@query("""SELECT p_partkey, p_size % 9 <> 0 AND sqrt(power(p_size / 100.0, 2) + power(p_partkey % 7 / 50.0, 2) + 0.01) < 0.3001 AS still FROM part""")
def device_still(spark, sf):
    """Whether a device turns slower than a threshold; without a reading it doesn't stand still."""
    x = F.when(F.col("p_size") % 9 != 0, F.col("p_size") / 100.0)
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", g.still(x, F.col("p_partkey") % 7 / 50.0, F.lit(0.1), 0.3001).alias("still"))


@query("""WITH d AS (SELECT l_suppkey AS capture, l_partkey % 12 AS direction, max(l_quantity) >= 30 AS metered, max(l_quantity) >= 49.5 AS clipped FROM lineitem GROUP BY 1, 2),
s AS (SELECT capture, avg(CASE WHEN metered THEN 1.0 ELSE 0.0 END) AS c, bool_or(metered AND clipped) AS w FROM d GROUP BY 1)
SELECT capture, round(c, 9) AS coverage, c >= 0.85 AND NOT w AS ready, c >= 0.85 AND w AS waits_for_highlights FROM s""")
def scan_ready(spark, sf):
    """Whether a sweep has metered enough of the sphere, or waits for its highlights only."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_quantity").groupBy(F.col("l_suppkey").alias("capture"), F.col("l_partkey") % 12)
    d = li.agg((F.max("l_quantity") >= 30).alias("metered"), (F.max("l_quantity") >= 49.5).alias("highlights_clipped"))
    return rounded(capture.scan_ready(d, keys=["capture"]), coverage=9)


@query("""WITH f AS (SELECT o_custkey AS capture, o_orderkey AS frame, o_orderstatus = 'F' AND o_custkey % 4 <> 0 AS placed FROM orders),
k AS (SELECT * FROM (SELECT *, bool_or(placed) OVER (PARTITION BY capture) AS has FROM f) WHERE placed OR NOT has)
SELECT capture, frame, CAST(row_number() OVER (PARTITION BY capture ORDER BY frame) - 1 AS INT) AS index FROM k""")
def keep_placed(spark, sf):
    """Each capture's placed frames, or all of them if none is, numbered anew."""
    o = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_orderstatus")
    f = o.select(F.col("o_custkey").alias("capture"), F.col("o_orderkey").alias("frame"), ((F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 4 != 0)).alias("placed"))
    return capture.keep_placed(f, keys=["capture"]).drop("placed")


PX = "px AS (SELECT f.range AS frame, y.range AS y, x.range AS x, greatest(0, (f.range * 5 + y.range * 3 + x.range * 7) % 11 - 2) / 8.0 AS v FROM range(12) f, range(8) y, range(8) x)"


@query(f"""WITH {PX}, s AS (SELECT DISTINCT l_suppkey % 12 AS a, l_partkey % 12 AS b, l_orderkey % 8 AS x, l_linenumber AS y, CAST(l_quantity AS INT) % 8 AS xb, (l_orderkey + l_linenumber) % 8 AS yb FROM lineitem)
SELECT s.a, s.b, s.x, s.y, xb, yb, p.v AS va, q.v AS vb FROM s JOIN px p ON p.frame = a AND p.y = s.y AND p.x = s.x JOIN px q ON q.frame = b AND q.y = yb AND q.x = xb WHERE p.v > 1e-6 AND q.v > 1e-6""")
def photometric_pairs(spark, sf):
    """Values that two frames have of one place; where either is dark, the pair drops out."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    s = li.select((F.col("l_suppkey") % 12).alias("a"), (F.col("l_partkey") % 12).alias("b"), (F.col("l_orderkey") % 8).alias("x"), F.col("l_linenumber").cast("long").alias("y"),
                  (F.col("l_quantity").cast("int") % 8).alias("xb"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 8).alias("yb")).distinct()
    i = F.col("id")
    px = spark.range(12 * 64).select(F.floor(i / 64).alias("frame"), (F.floor(i / 8) % 8).alias("y"), (i % 8).alias("x"))
    px = px.withColumn("v", F.greatest(F.lit(0), (F.col("frame") * 5 + F.col("y") * 3 + F.col("x") * 7) % 11 - 2) / 8.0)
    return sampling.valued_pairs(s, px).select("a", "b", "x", "y", "xb", "yb", "va", "vb")


REACH = g.max_angle(K) + 1e-3


@query(f"""WITH f AS (SELECT id AS frame, {DIR} FROM {POSES_SQL}), b AS (SELECT range AS band, pi() / 2 - (range * 16 + 0.5) / 256 * pi() AS top, pi() / 2 - (range * 16 + 15 + 0.5) / 256 * pi() AS bottom FROM range(16))
SELECT frame, band, round(cos({REACH!r}), 9) AS cos_limit FROM f, b WHERE asin(y) + {REACH!r} >= bottom AND asin(y) - {REACH!r} <= top""")
def cone_bands(spark, sf):
    """Bands of sixteen rows that each frame's view cone touches."""
    f = customer_poses(spark, sf).select(F.col("id").alias("frame"), g.looking_at(F.col("yaw"), F.col("pitch")).alias("rotation"))
    return rounded(composite.touched_bands(composite.cones(f, K), 256, 16).select("frame", "band", "cos_limit"), cos_limit=9)


# --- coverage and compositing ---------------------------------------------------------------------------

PLAN25 = look("yaw", "pitch", "(SELECT n_nationkey AS target, (n_nationkey * 37) % 360 - 180.0 AS yaw, (n_nationkey * 23) % 160 - 80.0 AS pitch FROM nation)", "target")


def plan25(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    return read(spark, sf, "nation", "n_nationkey").select(k.alias("target"), g.looking_at((k * 37) % 360 - 180.0, (k * 23) % 160 - 80.0).alias("rotation"))


SEEN = f"""cz > 1e-12 AND {K.fx} * cx / cz + {K.cx} BETWEEN -0.5 - 1e-9 AND {K.width} - 0.5 + 1e-9 AND {K.fy} * cy / cz + {K.cy} BETWEEN -0.5 - 1e-9 AND {K.height} - 0.5 + 1e-9"""


@query(f"""WITH t AS {PLAN25}, d AS (SELECT id, {DIR} FROM {POSES_SQL}),
s AS (SELECT id, target, x * rx + y * ry + z * rz AS cx, x * t.dx + y * t.dy + z * t.dz AS cy, x * fx + y * fy + z * fz AS cz FROM d, t)
SELECT id, CAST(count(*) FILTER ({SEEN}) AS INT) AS n FROM s GROUP BY id""")
def frame_cover(spark, sf):
    """In how many frames of a plan each direction lies."""
    d = customer_poses(spark, sf).select("id", g.from_angles(F.col("yaw"), F.col("pitch")).alias("direction"))
    return matching.frame_count(d, plan25(spark, sf), K)


@query(f"""WITH t AS {PLAN25}, g AS (SELECT ((i.range + 0.5) * {K.width} / 12 - 0.5 - {K.cx}) / {K.fx} AS a, ((j.range + 0.5) * {K.height} / 12 - 0.5 - {K.cy}) / {K.fy} AS b FROM range(12) i, range(12) j),
w AS (SELECT target, a * rx + b * dx + fx AS x, a * ry + b * dy + fy AS y, a * rz + b * dz + fz AS z FROM t, g),
s AS (SELECT w.target, o.target AS other, x * rx + y * ry + z * rz AS cx, x * o.dx + y * o.dy + z * o.dz AS cy, x * fx + y * fy + z * fz AS cz FROM w JOIN t o ON o.target <> w.target),
n AS (SELECT target, other FROM s WHERE {SEEN} GROUP BY 1, 2 HAVING count(*) >= 0.05 * 144)
SELECT t.target, count(other) AS n FROM t LEFT JOIN n USING (target) GROUP BY 1""")
def shared_neighbours(spark, sf):
    """Other frames that hold at least a twentieth of a grid of samples of each frame."""
    return matching.frame_neighbours(plan25(spark, sf), K)


@query("""WITH s AS (SELECT l_partkey % 1024 AS pixel, l_suppkey % 4 AS label, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2), n AS (SELECT pixel, label, w / sum(w) OVER (PARTITION BY pixel) AS share FROM s),
q AS (SELECT c_custkey AS id, (c_custkey * 17 % 1000) / 1000.0 AS u, (c_custkey * 29 % 1000) / 1000.0 AS v, c_custkey % 4 AS label FROM customer),
f AS (SELECT *, u * 32 - 0.5 - floor(u * 32 - 0.5) AS tx, v * 32 - 0.5 - floor(v * 32 - 0.5) AS ty, CAST(floor(u * 32 - 0.5) AS BIGINT) AS x0, CAST(floor(v * 32 - 0.5) AS BIGINT) AS y0 FROM q),
t AS (SELECT id, label, (CASE WHEN i.range = 0 THEN 1 - tx ELSE tx END) * (CASE WHEN j.range = 0 THEN 1 - ty ELSE ty END) AS w, greatest(0, least(31, y0 + j.range)) * 32 + (x0 + i.range + 32) % 32 AS pixel FROM f, range(2) i, range(2) j)
SELECT id, round(sum(t.w * coalesce(share, 0)), 9) AS share FROM t LEFT JOIN n USING (pixel, label) GROUP BY id""")
def seam_share(spark, sf):
    """A frame's share between the pixels of a seam grid, across the join of the canvas."""
    li = read(spark, sf, "lineitem", "l_partkey", "l_suppkey", "l_quantity")
    s = li.groupBy((F.col("l_partkey") % 1024).alias("pixel"), (F.col("l_suppkey") % 4).alias("label")).agg(F.sum("l_quantity").alias("w"))
    s = s.select("pixel", "label", (F.col("w") / F.sum("w").over(Window.partitionBy("pixel"))).alias("share"))
    k = F.col("c_custkey")
    q = read(spark, sf, "customer", "c_custkey").select(k.alias("id"), (k * 17 % 1000 / 1000.0).alias("u"), (k * 29 % 1000 / 1000.0).alias("v"), (k % 4).alias("label"))
    return rounded(composite.share_at(q, s, 32, 32).select("id", "share"), share=9)


# --- poses ----------------------------------------------------------------------------------------------

@query("SELECT n_nationkey AS nation, round(cos(n_nationkey * 0.1), 6) AS m00, round(sin(n_nationkey * 0.1), 6) + 0.0 AS m02, 1.0 AS m11 FROM nation SEMI JOIN customer ON c_nationkey = n_nationkey")
def pose_consensus(spark, sf):
    """The one rotation that takes solved poses to their references, of each nation's customers."""
    p = customer_poses(spark, sf)
    solved = g.looking_at(F.col("yaw"), F.col("pitch"))
    turn = g.exp_so3(g.vec(F.lit(0.0), F.col("nation") * 0.1, F.lit(0.0)))
    m = p.select("nation", solved.alias("solved"), g.multiply(turn, solved).alias("reference"))
    out = solve.pose_consensus(m, ["nation"])
    return out.select("nation", *[(F.round(F.col("rotation")[i], 6) + 0.0).alias(n) for i, n in ((0, "m00"), (2, "m02"), (4, "m11"))])


@query("SELECT n_nationkey AS nation, round(sin(n_nationkey * 0.02), 6) + 0.0 AS x, round(-cos(n_nationkey * 0.02), 6) AS y, 0.0 AS z, 0.0 AS tilt_deg FROM nation SEMI JOIN customer ON c_nationkey = n_nationkey")
def pose_horizon(spark, sf):
    """Which way is up, from what the frames' horizontal axes have least in common with, and their tilt against it."""
    zero = F.lit(0.0)
    pose = g.multiply(g.exp_so3(g.vec(zero, zero, F.col("nation") * 0.02)), g.exp_so3(g.vec(zero, F.radians("yaw"), zero)))
    h = solve.pose_horizon(customer_poses(spark, sf).select("nation", pose.alias("rotation")), ["nation"])
    return h.select("nation", *[(F.round(f"up.{a}", 6) + 0.0).alias(a) for a in "xyz"], (F.round("tilt_deg", 4) + 0.0).alias("tilt_deg"))


@query("SELECT l_suppkey, round(avg(abs(power(l_quantity / 50, 3) - power(l_discount * 10, 3))), 9) AS leverage FROM lineitem GROUP BY 1")
def distortion_leverage(spark, sf):
    """How much matched radii differ where distortion acts."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_discount")
    return rounded(capture.distortion_leverage(li.select("l_suppkey", (F.col("l_quantity") / 50).alias("ra"), (F.col("l_discount") * 10).alias("rb")), keys=["l_suppkey"]), leverage=9)


@query(f"""WITH t AS {look('yaw', 'pitch', POSES_SQL, 'id')}
SELECT id, round(rx, 9) + 0.0 AS rx, round(ry, 9) + 0.0 AS ry, round(dy, 9) + 0.0 AS dy, round(dz, 9) + 0.0 AS dz, round(fx, 9) + 0.0 AS fx, round(fy, 9) + 0.0 AS fy FROM t""")
def look_at(spark, sf):
    """The camera that looks in a direction, level."""
    m = customer_poses(spark, sf).select("id", g.looking_at(F.col("yaw"), F.col("pitch")).alias("m"))
    return m.select("id", *[(F.round(F.col("m")[i], 9) + 0.0).alias(n) for i, n in ((0, "rx"), (3, "ry"), (4, "dy"), (7, "dz"), (2, "fx"), (5, "fy"))])


@query("""WITH a AS (SELECT c_custkey AS id, (c_custkey % 90) / 40.0 + 0.2 AS a, (c_custkey % 11) / 10.0 AS t FROM customer)
SELECT id, round(cos(a * t / 2), 6) AS w, round(sin(a * t / 2), 6) + 0.0 AS y, round(cos(a), 6) AS turned FROM a""")
def quaternion_slerp(spark, sf):
    """From no rotation part of the way to one about the vertical; and the whole way as the product of two halves."""
    k, zero = F.col("c_custkey"), F.lit(0.0)
    a, t = k % 90 / 40.0 + 0.2, k % 11 / 10.0
    turn = lambda x: g.quaternion(zero, F.sin(x / 2), zero, F.cos(x / 2))
    q = read(spark, sf, "customer", "c_custkey").select(k.alias("id"), g.slerp(turn(zero), turn(a), t).alias("s"), g.matrix_of(g.quaternion_product(turn(a / 2), turn(a / 2))).alias("m"))
    return q.select("id", F.round("s.w", 6).alias("w"), (F.round("s.y", 6) + 0.0).alias("y"), F.round(F.col("m")[0], 6).alias("turned"))


@query("SELECT c_custkey AS id, round(cos((c_custkey % 90) / 40.0), 6) AS m00, round(sin((c_custkey % 90) / 40.0), 6) + 0.0 AS m02, 1.0 AS m11, 1.0 AS det FROM customer")
def orthonormal(spark, sf):
    """The rotation nearest to a matrix: here one about the vertical, scaled."""
    k, zero = F.col("c_custkey"), F.lit(0.0)
    m = g.exp_so3(g.vec(zero, k % 90 / 40.0, zero))
    scaled = read(spark, sf, "customer", "c_custkey").select(k.alias("id"), F.transform(m, lambda v: v * (k % 5 + 0.5)).alias("m"))
    out = solve.orthonormal(scaled, "m")
    return out.select("id", *[(F.round(F.col("m")[i], 6) + 0.0).alias(n) for i, n in ((0, "m00"), (2, "m02"), (4, "m11"))], F.round(g.determinant(F.col("m")), 6).alias("det"))


# --- intrinsics and exposure ----------------------------------------------------------------------------

@query(f"""WITH s AS (SELECT p_partkey, p_size / 20.0 AS s FROM part)
SELECT p_partkey, CAST(greatest(1, floor({K.width} * s + 0.5)) AS INT) AS width, round({K.fx} * s, 9) AS fx, round(({K.cx} + 0.5) * s - 0.5, 9) AS cx,
  round(degrees(2 * atan(greatest(1, floor({K.width} * s + 0.5)) / 2 / ({K.fx} * s))), 6) AS hfov FROM s""")
def scaled_intrinsics(spark, sf):
    """One camera at other sizes: centres of pixels stay centres."""
    s = F.col("p_size") / 20.0
    k = g.scaled_columns(K, s)
    out = read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", k.alias("k"))
    hfov = F.degrees(F.atan(F.col("k.width") / 2 / F.col("k.fx")) * 2)
    return out.select("p_partkey", "k.width", F.round("k.fx", 9).alias("fx"), F.round("k.cx", 9).alias("cx"), F.round(hfov, 6).alias("hfov"))


@query("""WITH s AS (SELECT p_partkey, 4000 AS aw, 3000 AS ah, 400 + p_size * 16 AS w, 300 + p_partkey % 40 * 8 AS h, 2 + p_size % 3 AS f FROM part),
u AS (SELECT *, CASE WHEN w / h < aw / ah THEN ah * (w / h) ELSE aw END AS uw, CASE WHEN w / h > aw / ah THEN aw / (w / h) ELSE ah END AS uh FROM s)
SELECT p_partkey, round(w * 4.38 / (6.4 * uw / aw), 6) AS fx, round(h * 4.38 / (4.8 * uh / ah), 6) AS fy, CAST(w // f AS INT) AS sub_width, round(w * 4.38 / (6.4 * uw / aw) / f, 6) AS sub_fx,
  round(((w - 1) / 2.0 - (f - 1) / 2.0) / f, 6) AS sub_cx FROM u""")
def cropped_intrinsics(spark, sf):
    """A camera model from a sensor's size for an output that trims it, and the same at a whole-number subsample."""
    k = F.col("p_partkey")
    p = read(spark, sf, "part", "p_partkey", "p_size").select(k, (F.col("p_size") * 16 + 400).alias("w"), (k % 40 * 8 + 300).alias("h"), (F.col("p_size") % 3 + 2).alias("f"))
    model = g.sensor_intrinsics(F.lit(4000), F.lit(3000), 6.4, 4.8, 4.38, F.col("w"), F.col("h"))
    out = p.withColumn("k", model).withColumn("s", g.subsampled(F.col("k"), F.col("f")))
    return out.select("p_partkey", F.round("k.fx", 6).alias("fx"), F.round("k.fy", 6).alias("fy"), F.col("s.width").cast("int").alias("sub_width"), F.round("s.fx", 6).alias("sub_fx"), F.round("s.cx", 6).alias("sub_cx"))


@query("""WITH e AS (SELECT p_partkey, power(2.0, p_size % 12 - 9) AS s, 100 * (1 + p_partkey % 5) AS iso FROM part)
SELECT p_partkey, round(s * iso / 100, 9) AS relative, round(ln(3.24 / s) / ln(2.0) - ln(iso / 100.0) / ln(2.0), 9) AS ev100, CAST(floor(s * 1e9 + 0.5) AS BIGINT) AS ns,
  (CASE WHEN s >= 0.5 THEN printf('%.1f s', s) ELSE printf('1/%.0f s', 1 / s) END) || printf(' ISO %d f/1.8', iso) AS text FROM e""")
def exposure_text(spark, sf):
    """Relative exposure, EV100, nanoseconds and the text form of exposure settings."""
    s, iso = F.pow(F.lit(2.0), F.col("p_size") % 12 - 9), (F.col("p_partkey") % 5 + 1) * 100
    out = read(spark, sf, "part", "p_partkey", "p_size")
    return out.select("p_partkey", F.round(r.relative_exposure(s, iso, F.lit(100)), 9).alias("relative"), F.round(r.ev100(F.lit(1.8), s, iso), 9).alias("ev100"), r.half_up(s * 1e9).cast("long").alias("ns"), r.exposure_text(s, iso, F.lit(1.8)).alias("text"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'relative' ELSE 'absolute' END AS kind, round(CASE WHEN p_size % 4 = 0 THEN -1 ELSE p_retailprice * p_size END, 6) AS value FROM part")
def absolute_scale(spark, sf):
    """Radiance in cd/m2 where a scale is absolute; a relative one refuses, so it's never asked."""
    known = F.col("p_size") % 4 != 0
    cd = r.absolute(F.col("p_retailprice"), F.col("p_size").cast("double"))
    out = read(spark, sf, "part", "p_partkey", "p_size", "p_retailprice")
    return out.select("p_partkey", F.when(known, "absolute").otherwise("relative").alias("kind"), F.round(F.when(known, cd).otherwise(-1.0), 6).alias("value"))


@query("SELECT p_partkey, greatest(1, p_size * 1000, p_partkey % 50 * 900) AS ns FROM part")
def frame_duration(spark, sf):
    """The longest of what the exposure needs and what the stream can sustain."""
    out = read(spark, sf, "part", "p_partkey", "p_size")
    return out.select("p_partkey", capture.frame_duration((F.col("p_size") * 1000).cast("long"), F.col("p_partkey") % 50 * 900).alias("ns"))


@query("SELECT p_partkey, width, height, label FROM part JOIN (VALUES (8192, 4096, '8K'), (4096, 2048, '4K'), (2048, 1024, '2K')) v(width, height, label) ON width <= p_size * 200")
def resolution_options(spark, sf):
    """Output sizes that each device can hold."""
    return capture.resolution_options(read(spark, sf, "part", "p_partkey", "p_size"), F.col("p_size") * 200).drop("p_size")


# --- projections of rasters -----------------------------------------------------------------------------

@query("""WITH g AS (SELECT p_partkey, 1 + p_size / 10.0 AS red, 1 + p_partkey % 3 / 10.0 AS green, 1 + p_partkey % 5 / 4.0 AS blue FROM part)
SELECT p_partkey, round(1.6 * red / green, 9) AS m0, -0.5 AS m1, round(-0.1 * blue / green, 9) AS m2, round(1.6 * blue / green, 9) AS m8 FROM g""")
def white_balance(spark, sf):
    """Gains relative to green composed into a colour matrix."""
    m = F.array(*[F.lit(v) for v in (1.6, -0.5, -0.1, -0.2, 1.5, -0.3, 0.0, -0.6, 1.6)])
    k = F.col("p_partkey")
    out = read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", r.balance(m, 1 + F.col("p_size") / 10.0, 1 + k % 3 / 10.0, 1 + k % 5 / 4.0).alias("m"))
    return out.select("p_partkey", F.round(F.col("m")[0], 9).alias("m0"), F.col("m")[1].alias("m1"), F.round(F.col("m")[2], 9).alias("m2"), F.round(F.col("m")[8], 9).alias("m8"))


@query("SELECT p_partkey, round(power(p_size / 51.0, 2.2), 9) AS linear FROM part")
def encoding_inverse(spark, sf):
    """Where an encoding reaches a value, by bisection."""
    at = r.bisected(F.col("p_size") / 51.0, lambda x: F.pow(x, F.lit(1 / 2.2)))
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", F.round(at, 9).alias("linear"))


PLANES = [[[1.8, 1.2, 1.7], [1.1, 1.0, 1.15]], [[1.5, 1.1, 1.4], [1.2, 1.0, 1.3]], [[1.4, 1.2, 1.3], [1.1, 1.05, 1.2]], [[1.9, 1.3, 1.6], [1.3, 1.0, 1.25]]]
CELL = "px AS (SELECT p_partkey, p_partkey // 16 % 16 AS y, p_partkey % 16 AS x FROM part)"


def _bilinear(plane: str) -> str:
    at = lambda dj, di: f"{plane}[j + {dj + 1}][i + {di + 1}]"
    return f"(({at(0, 0)} * (1 - fx) + {at(0, 1)} * fx) * (1 - fy) + ({at(1, 0)} * (1 - fx) + {at(1, 1)} * fx) * fy)"


GAINS = f"WITH {CELL}, a AS (SELECT *, x / 15.0 * 2 AS gx, y / 15.0 AS gy FROM px), s AS (SELECT *, CAST(least(1, floor(gx)) AS INT) AS i, CAST(least(0, floor(gy)) AS INT) AS j FROM a), b AS (SELECT *, gx - i AS fx, gy - j AS fy FROM s) "


def cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, sf, "part", "p_partkey").select(k, (F.floor(k / 16) % 16).cast("int").alias("y"), (k % 16).cast("int").alias("x"))


@query(GAINS + f"SELECT p_partkey, round(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN {_bilinear(str(PLANES[0]))} WHEN y % 2 = 1 AND x % 2 = 1 THEN {_bilinear(str(PLANES[3]))} WHEN y % 2 = 0 THEN {_bilinear(str(PLANES[1]))} ELSE {_bilinear(str(PLANES[2]))} END, 9) AS gain FROM b")
def shading_sampler(spark, sf):
    """Shading of mosaic positions from tables worked out once for each row and column of a frame."""
    return raster.shading_sampler(cells(spark, sf), 16, 16, PLANES).select("p_partkey", F.round("gain", 9).alias("gain"))


@query(GAINS + f"SELECT p_partkey, round({_bilinear(str(PLANES[0]))}, 9) AS r, round(({_bilinear(str(PLANES[1]))} + {_bilinear(str(PLANES[2]))}) / 2, 9) AS g, round({_bilinear(str(PLANES[3]))}, 9) AS b FROM b")
def shading_rgb(spark, sf):
    """Shading of a merged pixel: one plane for red, the mean of two for green, one for blue."""
    gains = raster.shaded_rgb(F.col("x"), F.col("y"), 16, 16, PLANES)
    return cells(spark, sf).select("p_partkey", *[F.round(v, 9).alias(n) for v, n in zip(gains, "rgb", strict=True)])


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 65504.0 WHEN 2 THEN -65504.0 WHEN 3 THEN 65504.0 ELSE round(p_retailprice, 6) END AS v FROM part")
def finite_clamp(spark, sf):
    """What a half float can hold: NaN is 0, infinities and too large values are the limit."""
    v = F.when(F.col("p_partkey") % 5 == 0, float("nan")).when(F.col("p_partkey") % 5 == 1, float("inf")).when(F.col("p_partkey") % 5 == 2, float("-inf")).when(F.col("p_partkey") % 5 == 3, F.col("p_retailprice") * 1e6).otherwise(F.col("p_retailprice"))
    return read(spark, sf, "part", "p_partkey", "p_retailprice").select("p_partkey", F.round(r.half_range(v), 6).alias("v"))


@query("""WITH px AS (SELECT s_suppkey AS frame, y.range AS y, x.range AS x, (s_suppkey * 5 + y.range * 3 + x.range * 7) % 13 / 4.0 AS v FROM supplier, range(6) y, range(8) x),
p AS (SELECT l_suppkey AS frame, l_orderkey, l_linenumber, min(greatest(0.0, least(7.0, l_quantity / 5 - 1.3))) AS u, min(greatest(0.0, least(5.0, l_discount * 70 - 0.6))) AS w FROM lineitem GROUP BY 1, 2, 3),
f AS (SELECT *, CAST(least(6, floor(u)) AS INT) AS x0, CAST(least(4, floor(w)) AS INT) AS y0 FROM p),
t AS (SELECT f.*, y0 + j.range AS y, x0 + i.range AS x, (CASE WHEN i.range = 0 THEN x0 + 1 - u ELSE u - x0 END) * (CASE WHEN j.range = 0 THEN y0 + 1 - w ELSE w - y0 END) AS k FROM f, range(2) i, range(2) j)
SELECT t.frame, l_orderkey, l_linenumber, round(sum(k * v), 9) AS value FROM t JOIN px ON px.frame = t.frame AND px.y = t.y AND px.x = t.x GROUP BY 1, 2, 3""")
def bilinear_sample(spark, sf):
    """Values between the pixels of each frame, edges repeated."""
    i = F.explode(F.sequence(F.lit(0), F.lit(47)))
    px = read(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("frame"), i.alias("i")).select("frame", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"))
    px = px.withColumn("v", (F.col("frame") * 5 + F.col("y") * 3 + F.col("x") * 7) % 13 / 4.0)
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    at = li.select(F.col("l_suppkey").alias("frame"), "l_orderkey", "l_linenumber", r.clamp(F.col("l_quantity") / 5 - 1.3, 0.0, 7.0).alias("u"), r.clamp(F.col("l_discount") * 70 - 0.6, 0.0, 5.0).alias("v"))
    p = at.groupBy("frame", "l_orderkey", "l_linenumber").agg(F.min("u").alias("u"), F.min("v").alias("v"))
    return rounded(raster.bilinear_samples(p, px, ["frame"], 8, 6).drop("u", "v"), value=9)


@query("""WITH l AS (SELECT l_suppkey AS frame, l_orderkey, l_linenumber, ln(greatest(min(l_extendedprice), 1e-8)) AS v FROM lineitem GROUP BY 1, 2, 3),
q AS (SELECT frame, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM l GROUP BY 1)
SELECT frame, l_orderkey, l_linenumber, round(greatest(0.0, least(1.0, (v - lo) / greatest(hi - lo, 1e-3))), 9) AS seen FROM l JOIN q USING (frame)""")
def detection_image(spark, sf):
    """Log luminance of each frame, stretched between percentiles."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    v = li.groupBy(F.col("l_suppkey").alias("frame"), "l_orderkey", "l_linenumber").agg(F.min("l_extendedprice").alias("v"))
    return rounded(raster.detection_values(v, ["frame"], "v").drop("v"), seen=9)


_RING = "[" + ", ".join(f"d[(y + {dy}) * 40 + x + {dx} + 1]" for dx, dy in features.RING) + "]"


@query(f"""WITH g AS (SELECT s_suppkey AS frame, list((((i % 40) // 5 * 7 + i // 40 // 4 * 13 + s_suppkey * 5) % 11) / 10.0 ORDER BY i) AS d FROM supplier, (SELECT range AS i FROM range(1200)) GROUP BY 1),
p AS (SELECT frame, d, y.range AS y, x.range AS x FROM g, range(3, 27) y, range(3, 37) x),
r AS (SELECT frame, y, x, d[y * 40 + x + 1] AS mid, {_RING} AS ring FROM p),
b AS (SELECT *, list_transform(ring, lambda v: CASE WHEN v > mid + 0.05 THEN '+' WHEN v < mid - 0.05 THEN '-' ELSE '.' END) AS m FROM r),
s AS (SELECT *, array_to_string(m || m[1:8], '') AS t FROM b),
h AS (SELECT frame, y, x, CAST(list_sum(list_transform(ring, lambda v: greatest(0, abs(v - mid) - 0.05))) AS FLOAT) AS score FROM s
  WHERE (contains(t, '+++++++++') AND len(list_filter([m[1], m[5], m[9], m[13]], lambda v: v = '+')) >= 2) OR (contains(t, '---------') AND len(list_filter([m[1], m[5], m[9], m[13]], lambda v: v = '-')) >= 2))
SELECT frame, y, x, round(CAST(score AS DOUBLE), 5) AS score FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.frame = b.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1
  AND (b.score > a.score OR b.score = a.score AND (b.y < a.y OR b.y = a.y AND b.x < a.x)))""")
def fast_corners(spark, sf):
    """Corners of nine ring pixels in a row, by how much the ring differs, the strongest of each 3 x 3."""
    i = F.col("i")
    v = ((F.floor(i % 40 / 5) * 7 + F.floor(i / 160) * 13 + F.col("s_suppkey") * 5) % 11) / 10.0
    px = read(spark, sf, "supplier", "s_suppkey").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1199)))).select(F.col("s_suppkey").alias("frame_id"), "i", v.alias("v"))
    frames = px.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("data")).select("frame_id", F.lit(40).alias("width"), F.lit(30).alias("height"), "data")
    return features.frame_corners(frames, 0.05, border=3, most=100_000).select(F.col("frame_id").alias("frame"), "y", "x", F.round("score", 5).alias("score"))


# --- sums, order and state ------------------------------------------------------------------------------

@query("""SELECT l_orderkey AS target, count(*) AS shots, round(sum(power(2.0, -l_linenumber)), 9) AS seconds, count(*) FILTER (l_linestatus = 'F') AS stored, round(avg(l_discount), 9) AS black_level FROM lineitem GROUP BY 1""")
def shot_totals(spark, sf):
    """Shots, exposure seconds, stored frames and the mean black level of each direction."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_linestatus", "l_discount")
    shots = li.select(F.col("l_orderkey").alias("target"), F.pow(F.lit(2.0), -F.col("l_linenumber")).alias("seconds"), (F.col("l_linestatus") == "F").alias("stored"), F.col("l_discount").alias("black_level"))
    return rounded(capture.shot_totals(shots, ["target"]), seconds=9, black_level=9)


@query("""WITH p AS (SELECT DISTINCT l_suppkey AS a, l_partkey % 100 AS b FROM lineitem WHERE l_suppkey <> l_partkey % 100), e AS (SELECT a AS frame FROM p UNION ALL SELECT b FROM p)
SELECT frame, count(*) AS degree FROM e GROUP BY 1""")
def frame_degrees(spark, sf):
    """How many pairs each frame is part of."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")).where("a <> b").distinct()
    return capture.degrees(li)


@query("""WITH l AS (SELECT p_partkey // 20 AS device, p_partkey AS k, p_size / 50.0 AS v FROM part), m AS (SELECT *, max(v) OVER (PARTITION BY device ORDER BY k) AS top, max(v) OVER (PARTITION BY device) AS white FROM l)
SELECT device, k, round(top / white, 9) AS linear FROM m""")
def monotone_response(spark, sf):
    """A response table that never falls and ends at 1, of each device."""
    k = F.col("p_partkey")
    p = read(spark, sf, "part", "p_partkey", "p_size").select(F.floor(k / 20).alias("device"), k.alias("k"), (F.col("p_size") / 50.0).alias("v"))
    return rounded(solve.rising(p, ["device"], "k", "v").select("device", "k", "linear"), linear=9)


@query(f"""WITH f AS (SELECT c_nationkey AS capture, id AS frame, {DIR} FROM {POSES_SQL} JOIN customer ON c_custkey = id), n AS (SELECT *, lag(frame) OVER w AS before FROM f WINDOW w AS (PARTITION BY capture ORDER BY frame))
SELECT a.capture, a.frame, a.before, round({ANGLE.format(a='a', b='b')}, 9) AS turned, degrees({ANGLE.format(a='a', b='b')}) >= 6 AS parallax FROM n a JOIN f b ON b.capture = a.capture AND b.frame = a.before""")
def previous_frame(spark, sf):
    """Each frame with the one before it in its capture, and whether the camera turned far enough between."""
    f = customer_poses(spark, sf).select(F.col("nation").alias("capture"), F.col("id").alias("frame"), g.from_angles(F.col("yaw"), F.col("pitch")).alias("direction"))
    return rounded(sampling.with_previous(f, ["capture"], "frame", "direction", 6.0), turned=9)


@query("""WITH p AS (SELECT l_suppkey AS scene, l_partkey AS pair, count(*) AS inliers FROM lineitem GROUP BY 1, 2) SELECT scene, pair, CAST(row_number() OVER (PARTITION BY scene ORDER BY inliers DESC, pair) AS INT) AS place FROM p""")
def pair_order(spark, sf):
    """Pairs by inliers, the strongest first, in pair order among equals."""
    p = read(spark, sf, "lineitem", "l_suppkey", "l_partkey").groupBy(F.col("l_suppkey").alias("scene"), F.col("l_partkey").alias("pair")).agg(F.count("*").alias("inliers"))
    return solve.strongest_first(p, ["scene"]).select("scene", "pair", "place")


@query("""WITH RECURSIVE z AS (SELECT s_suppkey AS frame, CAST(0 AS BIGINT) AS n, CAST(xor(s_suppkey, 25214903917) AS HUGEINT) AS s FROM supplier UNION ALL SELECT frame, n + 1, (s * 25214903917 + 11) % 281474976710656 FROM z WHERE n < 4 * 48),
d AS (SELECT frame, (n - 1) // 2 AS draw, max(CASE WHEN n % 2 = 1 THEN s // 4194304 END) AS hi, max(CASE WHEN n % 2 = 0 THEN s // 2097152 END) AS lo FROM z WHERE n > 0 GROUP BY 1, 2),
u AS (SELECT frame, draw // 2 AS cell, max(CASE WHEN draw % 2 = 0 THEN (hi * 134217728 + lo) / 9007199254740992.0 END) AS a, max(CASE WHEN draw % 2 = 1 THEN (hi * 134217728 + lo) / 9007199254740992.0 END) AS b FROM d GROUP BY 1, 2)
SELECT frame, CAST(cell AS INT) AS sample, CAST(least(79, floor((cell % 8 + a) * 10)) AS INT) AS x, CAST(least(59, floor((cell // 8 + b) * 10)) AS INT) AS y FROM u""")
def jittered_grid(spark, sf):
    """One drawn pixel in each cell of a grid over each frame; the draws are those of the documented generator, seeded by frame."""
    s = read(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("frame"), F.col("s_suppkey").alias("seed"))
    return sampling.drawn_grids(s, "frame", "seed", 80, 60, 48)


# --- devices --------------------------------------------------------------------------------------------

_DEV = """dv AS (SELECT s_suppkey AS device, ['LEGACY', 'EXTERNAL', 'LIMITED', 'FULL', 'LEVEL_3'][s_suppkey % 5 + 1] AS level, s_suppkey % 3 <> 0 AS raw, s_suppkey % 4 <> 0 AS manual FROM supplier),
sz AS (SELECT DISTINCT l_suppkey AS device, CAST(l_quantity AS INT) * 80 AS w, CAST(l_quantity AS INT) * 80 * (CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 2 END) // 4 AS h, l_linenumber <= 2 AS is_raw FROM lineitem WHERE l_quantity > 3),
rz AS (SELECT device, w, h FROM sz WHERE is_raw), yz AS (SELECT device, w, h FROM sz WHERE NOT is_raw),
us AS (SELECT * FROM yz WHERE w <= 1920 UNION ALL SELECT device, arg_min(w, [w * h, w]), arg_min(h, [w * h, w]) FROM yz GROUP BY device HAVING min(w) > 1920),
pv AS (SELECT device, arg_min(w, [abs(w - 1280), -w * h, w]) AS w, arg_min(h, [abs(w - 1280), -w * h, w]) AS h FROM us GROUP BY 1),
yc AS (SELECT device, arg_max(w, [w * h, -w]) AS w, arg_max(h, [w * h, -w]) AS h FROM yz GROUP BY 1 UNION SELECT device, arg_max(w, [w * h, -w]), arg_max(h, [w * h, -w]) FROM yz WHERE w * h <= 1920 * 1080 GROUP BY 1
  UNION SELECT * FROM pv UNION SELECT device, arg_min(w, [w * h, w]), arg_min(h, [w * h, w]) FROM yz GROUP BY 1),
cz AS (SELECT device, 'RAW' AS format, w, h FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY w * h DESC, w) AS n FROM rz) JOIN dv USING (device) WHERE n <= 2 AND raw AND manual AND level <> 'LEGACY' UNION ALL SELECT device, 'YUV', w, h FROM yc),
mp AS (SELECT c.device, c.format, c.w, c.h, arg_min(u.w, [CASE WHEN abs(u.w / u.h - c.w / c.h) < 0.02 THEN 0 ELSE 1 END, abs(u.w - 1280), -u.w * u.h, u.w]) AS pw,
  arg_min(u.h, [CASE WHEN abs(u.w / u.h - c.w / c.h) < 0.02 THEN 0 ELSE 1 END, abs(u.w - 1280), -u.w * u.h, u.w]) AS ph FROM cz c JOIN us u ON u.device = c.device GROUP BY 1, 2, 3, 4),
pl AS (SELECT m.*, CASE WHEN format = 'RAW' THEN 0 WHEN manual AND level <> 'LEGACY' THEN 1 ELSE 2 END AS tier, unnest(CASE WHEN format = 'YUV' AND level IN ('FULL', 'LEVEL_3') THEN [true, false] ELSE [false] END) AS metering FROM mp m JOIN dv USING (device))"""


@query(f"""WITH {_DEV} SELECT device, format, w, h, pw, ph, metering, ['LINEAR_RAW', 'MANUAL_YUV', 'LOCKED_AUTO'][tier + 1] AS tier,
  CAST(row_number() OVER (PARTITION BY device ORDER BY tier, CASE WHEN metering THEN 0 ELSE 1 END, w * h DESC, w) AS INT) AS place FROM pl""")
def stream_plans(spark, sf):
    """The stream configurations to try on each device, best first: raw sizes, then YUV sizes with and without metering."""
    k = F.col("s_suppkey")
    level = F.get(F.array(*[F.lit(x) for x in catalogue.LEVELS]), (k % 5).cast("int"))
    devices = read(spark, sf, "supplier", "s_suppkey").select(k.alias("device"), level.alias("level"), (k % 3 != 0).alias("raw"), (k % 4 != 0).alias("manual"))
    li = read(spark, sf, "lineitem", "l_suppkey", "l_quantity", "l_linenumber").where("l_quantity > 3")
    w = F.col("l_quantity").cast("int") * 80
    s = li.select(F.col("l_suppkey").alias("device"), w.alias("w"), F.floor(w * F.when(F.col("l_linenumber") % 2 == 0, 3).otherwise(2) / 4).cast("int").alias("h"), (F.col("l_linenumber") <= 2).alias("is_raw")).distinct()
    return catalogue.stream_plans(devices, s.where("is_raw").drop("is_raw"), s.where("not is_raw").drop("is_raw"))


@query("""WITH l AS (SELECT p_partkey AS id, p_size % 5 = 0 AS front, 40 + p_partkey % 80 AS hfov, p_size % 3 AS tier, p_partkey % 4 = 0 AS physical, 10 + p_size AS n FROM part)
SELECT id, (CASE WHEN front THEN 'Front' WHEN hfov >= 95 THEN 'Ultrawide' WHEN hfov >= 60 THEN 'Wide' ELSE 'Tele' END) || ', ' || hfov || ' degrees, ' || n || ' directions, ' ||
  ['RAW', 'no RAW, relative values', 'camera picks the exposure'][tier + 1] || CASE WHEN physical THEN ', untested on this phone' ELSE '' END AS line FROM l""")
def lens_text(spark, sf):
    """One line to choose a lens by."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf, "part", "p_partkey", "p_size").select(k.alias("id"), text.lens_line(s % 5 == 0, (k % 80 + 40).cast("double"), s + 10, F.get(F.array(*[F.lit(t) for t in catalogue.TIERS]), s % 3), k % 4 == 0).alias("line"))


# --- cost, text and containers --------------------------------------------------------------------------

_PEAK = lambda f: f"(px * 4 + CASE WHEN {f} >= 2 THEN px // 4 * 12 ELSE px * 12 END + rungs * (px // ({f} * {f})) * 12 + px // ({f} * {f}) * 16)"


@query(f"""WITH j AS (SELECT p_partkey, p_size * 400000 AS px, 1 + p_partkey % 7 AS rungs, 100000000 + p_partkey % 11 * 60000000 AS budget FROM part)
SELECT p_partkey, CAST(CASE WHEN {_PEAK(1)} <= budget THEN 1 WHEN {_PEAK(2)} <= budget THEN 2 WHEN {_PEAK(4)} <= budget THEN 4 ELSE 8 END AS INT) AS factor, {_PEAK(1)} AS peak FROM j""")
def merge_subsample(spark, sf):
    """By how much frames must shrink for one bracket to merge within a memory budget, and what it takes at full size."""
    k, px = F.col("p_partkey"), (F.col("p_size") * 400000).cast("long")
    rungs, budget = k % 7 + 1, k % 11 * 60000000 + 100000000
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", capture.merge_subsample(px, rungs, budget).alias("factor"), capture.merge_peak_bytes(px, rungs, 1).alias("peak"))


@query("SELECT p_partkey, printf('%.3f', p_retailprice / 7) AS plain, printf('%+d', p_size - 25) AS signed, printf('%05d', p_partkey) AS padded FROM part")
def formatted_numbers(spark, sf):
    """Numbers as text, the same in every locale."""
    return read(spark, sf, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.format_string("%.3f", F.col("p_retailprice") / 7).alias("plain"), F.format_string("%+d", F.col("p_size") - 25).alias("signed"), F.format_string("%05d", "p_partkey").alias("padded"))


@query("SELECT l_orderkey * 4096 + l_linenumber AS packed, l_orderkey AS target, l_linenumber AS bracket, count(*) AS n FROM lineitem GROUP BY ALL")
def packed_keys(spark, sf):
    """Target and rung in one number, and apart again."""
    p = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber").select((F.col("l_orderkey") * 4096 + F.col("l_linenumber")).alias("packed"))
    return p.groupBy("packed").agg(F.count("*").alias("n")).select("packed", F.floor(F.col("packed") / 4096).alias("target"), (F.col("packed") % 4096).cast("int").alias("bracket"), "n")


@query("""SELECT l_suppkey, CAST(len(list(DISTINCT l_returnflag)) AS INT) AS fields, count(*) FILTER (l_returnflag = 'R') AS returned, max(l_linenumber) AS largest, CAST(count(DISTINCT l_linenumber) FILTER (l_linenumber > 2) AS INT) AS above FROM lineitem GROUP BY 1""")
def fields_and_arrays(spark, sf):
    """A map of counts and an array of rungs for each supplier, asked for sizes, values and a filter."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_returnflag", "l_linenumber")
    counts = li.groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.collect_set("l_linenumber").alias("s"))
    m = counts.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("a"))
    return m.select("l_suppkey", F.size("m").alias("fields"), F.coalesce(F.try_element_at("m", F.lit("R")), F.lit(0)).alias("returned"), F.array_max("a").alias("largest"), F.size(F.filter("a", lambda x: x > 2)).alias("above"))


# --- solves with a known answer -------------------------------------------------------------------------

@query("SELECT p_partkey // 40 AS scene, -0.42 AS a2, 0.09 AS a4 FROM part GROUP BY 1")
def vignette_fit(spark, sf):
    """Falloff fitted to ratios of values at two radii, scene by scene; here they follow one falloff exactly."""
    k, s = F.col("p_partkey"), F.col("p_size")
    f = lambda x: 1 - 0.42 * x * x + 0.09 * x * x * x * x
    r1, r2 = s / 50.0, (k * 7 % 40) / 45.0
    o = read(spark, sf, "part", "p_partkey", "p_size").select(F.floor(k / 40).alias("scene"), r1.alias("r1"), r2.alias("r2"), (f(r1) / f(r2)).alias("ratio"))
    return rounded(solve.vignettes(o, ["scene"]), a2=5, a4=5)


@query("""WITH y AS (SELECT s_suppkey, (s_suppkey * 37 % 100) / 100.0 AS yaw FROM supplier), z AS (SELECT arg_min(yaw, s_suppkey) AS yaw FROM y)
SELECT s_suppkey AS frame, round(cos(y.yaw - z.yaw), 6) AS m00, round(sin(y.yaw - z.yaw), 6) + 0.0 AS m02 FROM y, z""")
def spanning_rotations(spark, sf):
    """Rotations grown over the strongest pairs, from frame to frame; the root is the first frame of the strongest pair."""
    s = read(spark, sf, "supplier", "s_suppkey")
    k = F.col("s_suppkey")
    yaw = lambda x: (x * 37 % 100) / 100.0
    later = s.select(k.alias("b"), (k - 1).alias("a")).join(s.select(k.alias("a")), "a")
    turn = g.exp_so3(g.vec(F.lit(0.0), yaw(F.col("b")) - yaw(F.col("a")), F.lit(0.0)))
    pairs = later.select("a", "b", (F.lit(100000) - F.col("a")).alias("inliers"), turn.alias("rotation"))
    out = solve.grown(pairs)
    return out.select("frame", *[(F.round(F.col("rotation")[i], 6) + 0.0).alias(n) for i, n in ((0, "m00"), (2, "m02"))])


@query("""WITH p AS (SELECT l_orderkey AS scene, l_linenumber % 3 AS node, max(l_quantity) AS s, max(l_discount * 500) AS t, max(l_tax * 100) AS e FROM lineitem GROUP BY 1, 2),
w AS (SELECT scene, list(s ORDER BY node) AS s, list(t ORDER BY node) AS t, list(e ORDER BY node) AS e FROM p GROUP BY 1 HAVING count(*) = 3),
c AS (SELECT scene, list_sum([CASE WHEN m & 1 = 0 THEN s[1] ELSE t[1] END, CASE WHEN m & 2 = 0 THEN s[2] ELSE t[2] END, CASE WHEN m & 4 = 0 THEN s[3] ELSE t[3] END,
  CASE WHEN (m & 1 > 0) <> (m & 2 > 0) THEN e[1] ELSE 0 END, CASE WHEN (m & 2 > 0) <> (m & 4 > 0) THEN e[2] ELSE 0 END, CASE WHEN (m & 1 > 0) <> (m & 4 > 0) THEN e[3] ELSE 0 END]) AS cost FROM w, (SELECT range AS m FROM range(8)))
SELECT scene, round(min(cost), 6) AS flow FROM c GROUP BY 1""")
def min_cut(spark, sf):
    """The least cut of small networks of three nodes, one for each order; SQL tries all eight."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    n = li.groupBy(F.col("l_orderkey").alias("scene"), (F.col("l_linenumber") % 3).alias("node")).agg(F.max("l_quantity").alias("source"), (F.max("l_discount") * 500).alias("sink"), (F.max("l_tax") * 100).alias("e"))
    whole = n.groupBy("scene").agg(F.count("*").alias("n")).where("n = 3").select("scene")
    n = n.join(whole, "scene")
    ends = F.when(F.col("node") == 0, F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"))).when(F.col("node") == 1, F.struct(F.lit(1).alias("a"), F.lit(2).alias("b"))).otherwise(F.struct(F.lit(0).alias("a"), F.lit(2).alias("b")))
    edges = n.select("scene", ends["a"].alias("a"), ends["b"].alias("b"), F.col("e").alias("capacity"))
    return rounded(solve.min_cuts(n.drop("e"), edges, "scene"), flow=6)


@query("""WITH p AS (SELECT l_orderkey AS scene, l_linenumber % 4 AS pixel, max(l_extendedprice) / 10000 AS v0, min(l_extendedprice) / 10000 + 0.5 AS v1, max(l_quantity) AS w0, min(l_quantity) + l_orderkey % 13 AS w1 FROM lineitem GROUP BY 1, 2),
w AS (SELECT scene, list([v0, v1] ORDER BY pixel) AS v, list([w0, w1] ORDER BY pixel) AS w FROM p GROUP BY 1 HAVING count(*) = 4),
l AS (SELECT scene, v, w, [m & 1, (m >> 1) & 1, (m >> 2) & 1, (m >> 3) & 1] AS l FROM w, (SELECT range AS m FROM range(16))),
c AS (SELECT scene, list_sum(list_transform(range(1, 5), lambda i: greatest(w[i][1], w[i][2]) - w[i][l[i] + 1]))
  + list_sum(list_transform([[1, 2], [3, 4], [1, 3], [2, 4]], lambda e: CASE WHEN l[e[1]] = l[e[2]] THEN 0 ELSE 8 * (abs(v[e[1]][1] - v[e[1]][2]) + abs(v[e[2]][1] - v[e[2]][2]) + 0.02) END)) AS energy FROM l)
SELECT scene, round(min(energy), 6) AS energy FROM c GROUP BY 1""")
def seam_labels(spark, sf):
    """Seams of two labels over 2 x 2 pixels, one problem for each order: with two labels a cut finds the least energy."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # the one shuffle
    p = li.groupBy(F.col("l_orderkey").alias("scene"), (F.col("l_linenumber") % 4).alias("pixel")).agg(
        (F.max("l_extendedprice") / 10000).alias("v0"), (F.min("l_extendedprice") / 10000 + 0.5).alias("v1"), F.max("l_quantity").alias("w0"), F.min("l_quantity").alias("w1"))
    p = p.withColumn("w1", F.col("w1") + F.col("scene") % 13)
    p = p.withColumn("n", F.count("*").over(Window.partitionBy("scene"))).where("n = 4").drop("n")
    s = p.select("scene", "pixel", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(f"v{k}").alias("log_value"), F.col(f"w{k}").alias("weight")) for k in (0, 1)])).alias("s")).select("scene", "pixel", "s.*")
    return rounded(composite.solved_seams(s, "scene", 2, 2, wrap=False), energy=6).select("scene", "energy")


@query("""WITH t AS (SELECT p_partkey AS id, power(2.0, -(p_size % 14)) AS wanted, p_partkey % 3 AS target FROM part),
r AS (SELECT *, [4, 3, 2][target + 1] AS last, [2, 1, 0][target + 1] AS first FROM t),
s AS (SELECT *, power(2.0, first - 8) AS low FROM r),
g AS (SELECT *, CASE WHEN low <= wanted * (1 + 1e-9) THEN 0 ELSE CAST(ceil(ln(low / wanted) / ln(2.0) - 1e-9) AS INT) END AS steps FROM s),
h AS (SELECT *, least(steps, first) AS inside, greatest(0, least(CAST(ceil((steps - first) / 3.0 - 1e-9) AS INT), 1)) AS added FROM g)
SELECT id, CASE WHEN steps = 0 THEN 0 ELSE added END AS added, first - inside AS new_first, last + added AS new_last FROM h""")
def grown_bracket(spark, sf):
    """A bracket that must reach darker: rungs of the ladder first, then a new one below it, as far as the device goes."""
    k = F.col("p_partkey")
    p = read(spark, sf, "part", "p_partkey", "p_size").select(k.alias("id"), F.pow(F.lit(2.0), -(F.col("p_size") % 14)).alias("wanted"), F.get(F.array(F.lit(2), F.lit(1), F.lit(0)), (k % 3).cast("int")).alias("first"), F.get(F.array(F.lit(4), F.lit(3), F.lit(2)), (k % 3).cast("int")).alias("last"))
    ladder = F.array(*[F.lit(2.0 ** (i - 8)) for i in range(6)])
    return exposure.extended(p, ladder, 2.0**-11, 3.0, 9).select("id", "added", "new_first", "new_last")


@query("SELECT p_partkey // 40 AS scene, CAST(5 + p_partkey // 40 % 7 AS DOUBLE) AS level, -0.42 AS a2, 0.09 AS a4 FROM part GROUP BY 1, 2")
def flat_field(spark, sf):
    """Falloff and level of evenly lit frames; here they follow one falloff exactly."""
    k = F.col("p_partkey")
    scene, r2 = F.floor(k / 40), F.pow(k * 7 % 40 / 39.0, F.lit(2.0))
    v = (5 + scene % 7) * (1 - 0.42 * r2 + 0.09 * r2 * r2)
    out = solve.flat_fields(read(spark, sf, "part", "p_partkey").select(scene.alias("scene"), r2.alias("r2"), v.alias("v")), ["scene"])
    return rounded(out, level=5, a2=5, a4=5)


@query("SELECT CAST(range AS INT) AS level, CASE WHEN range = 255 THEN 1.0 ELSE round(exp(ln(2.0) / 16), 4) END AS step FROM range(256)")
def response_curve(spark, sf):
    """A camera's response from brackets of samples, as the factor from each level to the next, and the last one's value;
    here levels rise with the logarithm of exposure, a line that smoothing keeps."""
    p = read(spark, sf, "part", "p_partkey", "p_size").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(3))))
    s = p.select(F.col("p_partkey").alias("sample"), ((F.col("p_size") * 4 + F.col("j") * 16) / 255.0).alias("encoded"), F.pow(F.lit(2.0), F.col("j")).alias("rel")).where("encoded < 1")
    table = F.array(*[F.lit(v) for v in solve.response_curve(s)])
    i = F.col("id").cast("int")
    own, onward = F.get(table, i), F.get(table, i + 1)
    return spark.range(256).select(i.alias("level"), F.round(F.coalesce(onward / own, own), 4).alias("step"))
