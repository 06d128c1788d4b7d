"""Queries of lens solves, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .. import config as c
from ..functions import geometry as g
from ..functions import geometry as g
from ..operators import distortion, sampling, solve
from .common import read, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


#: capture, coefficient of its lens, degrees from frame to frame, bound of the fit, the gate that refuses it
LENSES = [("swept", -0.09, 34.0, 0.4, None), ("straight", 0.0, 34.0, 0.4, "gain"), ("one aim", -0.09, 0.3, 0.4, "signal"), ("tight", -0.09, 34.0, 0.02, "bound")]
FRAMES, PLAIN = 8, c.Lens(800, 600, 571.26, 571.26, 399.5, 299.5)


def lens_matches(spark, sf):
    """Each customer is a point of the plane before a frame's camera; the next frame sees it turned about the vertical."""
    k = F.col("k")
    points = read(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("k"), F.explode(F.array(*[F.struct(F.lit(n).alias("capture"), F.lit(k1).alias("k1"), F.lit(math.radians(t)).alias("t")) for n, k1, t, _, _ in LENSES])).alias("s")).select("k", "s.*")
    x = F.when(F.col("t") > 0.1, k * 37 % 101 / 101.0 * 0.65 + 0.02).otherwise(k * 37 % 101 / 101.0 * 1.2 - 0.6)
    seen = points.withColumns({"a": k % (FRAMES - 1), "x": x, "y": k * 53 % 89 / 89.0 - 0.5})
    z = F.sin("t") * F.col("x") + F.cos("t")
    seen = seen.withColumns({"b": F.col("a") + 1, "x2": (F.cos("t") * F.col("x") - F.sin("t")) / z, "y2": F.col("y") / z})
    for u, v, px, py in (("ua", "va", "x", "y"), ("ub", "vb", "x2", "y2")):
        far = 1 + F.col("k1") * (F.col(px) * F.col(px) + F.col(py) * F.col(py))
        seen = seen.withColumns({u: PLAIN.cx + PLAIN.fx * F.col(px) * far, v: PLAIN.cy + PLAIN.fy * F.col(py) * far})
    inside = F.col("ub").between(0, PLAIN.width - 1) & F.col("vb").between(0, PLAIN.height - 1)
    return seen.where(inside).select("capture", "a", "b", "ua", "va", "ub", "vb", F.lit(1.0).alias("w"))


@query(f"""WITH s(capture, k1, t, kept, refused) AS (VALUES {', '.join(f"('{n}', {k1}, radians({t}), {0.0 if r else k1}, {f"'{r}'" if r else 'CAST(NULL AS VARCHAR)'})" for n, k1, t, _, r in LENSES)}),
p AS (SELECT s.*, c_custkey AS k, CASE WHEN t > 0.1 THEN c_custkey * 37 % 101 / 101.0 * 0.65 + 0.02 ELSE c_custkey * 37 % 101 / 101.0 * 1.2 - 0.6 END AS x, c_custkey * 53 % 89 / 89.0 - 0.5 AS y FROM customer, s),
q AS (SELECT *, (cos(t) * x - sin(t)) / (sin(t) * x + cos(t)) AS x2, y / (sin(t) * x + cos(t)) AS y2 FROM p),
d AS (SELECT *, x * (1 + k1 * (x * x + y * y)) AS xa, y * (1 + k1 * (x * x + y * y)) AS ya,
  x2 * (1 + k1 * (x2 * x2 + y2 * y2)) AS xb, y2 * (1 + k1 * (x2 * x2 + y2 * y2)) AS yb FROM q),
i AS (SELECT * FROM d WHERE 399.5 + 571.26 * xb BETWEEN 0 AND 799 AND 299.5 + 571.26 * yb BETWEEN 0 AND 599)
SELECT capture, round(kept, 4) AS k1, refused, count(*) AS matches, round(avg(abs(power(hypot(xa, ya), 3) - power(hypot(xb, yb), 3))), 6) AS leverage, 0.0 AS pose_error_deg FROM i GROUP BY capture, kept, refused""".replace("hypot(xa, ya)", "sqrt(xa * xa + ya * ya)").replace("hypot(xb, yb)", "sqrt(xb * xb + yb * yb)"))
def lens_distortion(spark, sf):
    """One radial coefficient fitted with the rotations of four captures: kept for a swept one, refused by each gate once.

    The pose error is that of the swept capture, to a hundredth of a degree; the others don't claim one.
    """
    matches = lens_matches(spark, sf)
    off = lambda k: solve.exp_so3(np.radians(2.0) * np.array([math.sin(k), math.cos(2 * k), math.sin(3 * k)]) / math.sqrt(3)) if k else np.eye(3)
    truth = {n: [solve.exp_so3(np.array([0.0, math.radians(t) * k, 0.0])) for k in range(FRAMES)] for n, _, t, _, _ in LENSES}
    start = {n: [off(k) @ r for k, r in enumerate(rs)] for n, rs in truth.items()}
    found = distortion.adjusted(matches, start, PLAIN, {n: c.Distortion(limit=limit) for n, _, _, limit, _ in LENSES})
    error = max(math.degrees(math.acos(min(1.0, (np.trace(a.T @ b) - 1) / 2))) for a, b in zip(truth["swept"], found["swept"].rotations, strict=True))
    rows = [(n, round(f.k1, 4) + 0.0, f.refused, round(error, 2) if n == "swept" else 0.0) for n, f in found.items()]
    fitted = spark.createDataFrame(rows, "capture string, k1 double, refused string, pose_error_deg double")
    radius3 = lambda u, v: F.pow(F.hypot((F.col(u) - PLAIN.cx) / PLAIN.fx, (F.col(v) - PLAIN.cy) / PLAIN.fy), F.lit(3.0))
    seen = matches.groupBy("capture").agg(F.count("*").alias("matches"), F.round(F.avg(F.abs(radius3("ua", "va") - radius3("ub", "vb"))), 6).alias("leverage"))
    return fitted.join(seen, "capture").select("capture", "k1", "refused", "matches", "leverage", "pose_error_deg")


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS pair, radians(5 + s_suppkey % 40) AS t FROM supplier),
z AS (SELECT pair, CAST(0 AS BIGINT) AS n, CAST(xor(11 + pair, 25214903917) AS HUGEINT) AS s FROM p UNION ALL SELECT pair, n + 1, (s * 25214903917 + 11) % 281474976710656 FROM z WHERE n < 4 * 240),
d AS (SELECT pair, (n - 1) // 4 AS try, max(CASE WHEN n % 4 = 1 THEN s // 4194304 END) AS a, max(CASE WHEN n % 4 = 2 THEN s // 2097152 END) AS b, max(CASE WHEN n % 4 = 3 THEN s // 4194304 END) AS c, max(CASE WHEN n % 4 = 0 THEN s // 2097152 END) AS d FROM z WHERE n > 0 GROUP BY 1, 2),
w AS (SELECT pair, try, 800 * (0.2 + 0.6 * ((a * 134217728 + b) / 9007199254740992.0)) AS u, 600 * (0.2 + 0.6 * ((c * 134217728 + d) / 9007199254740992.0)) AS v FROM d),
q AS (SELECT w.*, 600 * (cos(t) * ((u - 399.5) / 600) - sin(t)) / (sin(t) * ((u - 399.5) / 600) + cos(t)) + 399.5 AS ub, 600 * ((v - 299.5) / 600) / (sin(t) * ((u - 399.5) / 600) + cos(t)) + 299.5 AS vb FROM w JOIN p USING (pair)),
k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY try) AS n FROM q WHERE ub BETWEEN 120 AND 680 AND vb BETWEEN 90 AND 510)
SELECT pair, CAST(n - 1 AS INT) AS sample, round(u, 6) AS u, round(v, 6) AS v, round(ub, 6) AS ub, round(vb, 6) AS vb FROM k WHERE n <= 6""")
def photometric_draws(spark, sf):
    """Places that two frames of each pair see, drawn until there are six; pairs overlap more or less."""
    k = F.col("s_suppkey")
    zero = F.lit(0.0)
    turned = lambda t: g.exp_so3(g.vec(zero, t, zero))
    pairs = read(spark, sf, "supplier", "s_suppkey").select(k.alias("pair"), k.alias("a"), (k + 1).alias("b"), turned(zero).alias("ra"), turned(F.radians(5 + k % 40)).alias("rb"))
    return rounded(sampling.drawn_positions(pairs, c.Lens(), 6, 11).drop("a", "b"), u=6, v=6, ub=6, vb=6)
