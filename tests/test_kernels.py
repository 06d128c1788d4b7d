from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from lumenfold.config import Seam
from lumenfold.operators import cut, features, solve

R = np.random.default_rng(5)


def test_max_flow_equals_the_least_of_all_cuts():
    for _ in range(60):
        n = int(R.integers(2, 7))
        caps = R.integers(0, 9, (n, 2)).astype(float)
        arcs = [(a, b, *map(float, R.integers(0, 9, 2))) for a, b in itertools.combinations(range(n), 2) if R.random() < 0.6]
        net = cut.Network(n)
        for i, (s, t) in enumerate(caps):
            net.terminal(i, s, t)
        for arc in arcs:
            net.edge(*arc)
        costs = []
        for side in itertools.product((True, False), repeat=n):  # True: with the source
            costs.append(sum(caps[i][1] if side[i] else caps[i][0] for i in range(n)) + sum((ab if side[a] and not side[b] else 0) + (ba if side[b] and not side[a] else 0) for a, b, ab, ba in arcs))
        assert net.flow() == min(costs)


def test_seams_are_near_the_optimum():
    edges = np.array([(y * 3 + x, y * 3 + x + d) for y in range(3) for x in range(3) for d in ((1,) if x < 2 else ()) + ((3,) if y < 2 else ())])
    cfg, hits = Seam(smoothness=1.0), 0
    for _ in range(12):
        value, weight = R.normal(size=(9, 2)), R.uniform(0, 2, (9, 2))
        weight[R.random((9, 2)) < 0.1] = np.nan
        weight[np.isnan(weight).all(axis=1)] = 1.0
        got = cut.energy(cut.label_seams(value, weight, edges, cfg), value, weight, edges, cfg)
        best = min(cut.energy(np.array(x), value, weight, edges, cfg) for x in itertools.product((0, 1), repeat=9))
        assert got >= best - 1e-9
        hits += got <= best + 1e-6
    assert hits >= 10


def square() -> np.ndarray:
    img = np.full((120, 160), 0.8)
    img[40:80, 50:110] = 0.15
    return img


def test_corners_of_a_square():
    got = features.corners(square())
    assert len(got) and {(min(abs(x - 50), abs(x - 109)) <= 3, min(abs(y - 40), abs(y - 79)) <= 3) for x, y, _ in got} == {(True, True)}
    assert not len(features.corners(np.full((90, 90), 0.5))) and not len(features.corners(np.tile(np.arange(200) / 200, (90, 1))))


def test_descriptors_follow_a_turn():
    img = features.blurred(R.random((140, 140)), 1.5)
    img = (img - img.min()) / (img.max() - img.min())
    at = np.array([[70.0, 60.0], [60.0, 75.0]])
    a, wa = features.describe(img, at)
    turned = np.rot90(img)  # (x, y) goes to (y, 139 - x)
    b, wb = features.describe(turned, np.column_stack([at[:, 1], 139 - at[:, 0]]))
    apart = [sum(bin(int(x) & (2**64 - 1)).count("1") for x in wa[k] ^ wb[k]) for k in range(2)]
    other = sum(bin(int(x) & (2**64 - 1)).count("1") for x in wa[0] ^ wb[1])
    assert max(apart) < 30 < other and np.allclose(np.cos(a - b - math.pi / 2), 1, atol=1e-3)


def test_features_of_frames(spark):
    img = square().astype(np.float32)
    df = spark.createDataFrame([(1, 160, 120, 1, img.ravel().tolist())], "frame_id long, width int, height int, channels int, data array<float>")
    got = features.features(df).collect()
    assert got and all(len(r["desc"]) == 4 for r in got)


def test_horizon_and_consensus():
    level = [solve.exp_so3(np.array([0, y, 0])) for y in np.linspace(0, 5, 9)]
    lean = solve.exp_so3(np.array([0.1, 0, 0.05]))
    up, confidence, tilt = features.horizon([lean @ r @ np.diag([1, -1, -1]) for r in level])
    assert abs(abs(up @ (lean @ np.array([0, 1, 0]))) - 1) < 1e-9 and confidence > 0.5 and tilt < 1e-4
    assert np.allclose(features.consensus(level, [lean @ r for r in level], [True] * 9), lean)
    assert features.consensus(level, level, [False] * 9) is None


def test_guided_matches_compare_descriptors(spark):
    from lumenfold.operators import matching

    def points(rows):
        return spark.createDataFrame(rows, "pair int, kp int, desc long, x double, y double")

    left = points([(1, 0, 0b0, 10.0, 10.0), (1, 1, 0b111, 50.0, 50.0), (1, 2, 0b1, 10.0, 11.0), (1, 3, 0, None, 1.0), (1, 4, 0, float("nan"), 1.0), (2, 0, 0, 50.0, 50.0), (1, 5, 0, 90.0, 90.0), (1, 6, -1, 200.0, 200.0)])
    right = points([
        (1, 0, 0xFFFF, 10.0, 10.5), (1, 1, 0b0, 14.0, 10.0), (1, 2, 0b0, 16.0, 50.0),  # 1 resembles, 0 is nearest
        (1, 3, 0b11, 50.0, 51.0), (1, 4, 0b110, 51.0, 50.0),  # too much alike
        (1, 5, 0xFF, 90.0, 91.0), (1, 6, 0, 200.0, 200.0), (2, 0, 0, 50.0, 58.1),
    ])
    cfg = matching.Matching(max_distance=8)
    got = sorted(tuple(r) for r in matching.match_near(left, right, ("pair",), 8.0, cfg).collect())
    assert got == [(1, 0, 1, 0), (1, 5, 5, 8)]
    words = "transform(array(0, 1, 2, 3), k -> if(k = 3, desc, 0L)) as desc"
    left, right = (side.selectExpr("pair", "kp", words, "x", "y") for side in (left, right))
    assert sorted(tuple(r) for r in matching.match_near(left, right, ("pair",), 8.0, cfg).collect()) == got


def test_coverage_is_of_the_frame(spark):
    from lumenfold.config import Lens
    from lumenfold.operators import matching

    lens = Lens()

    def turned(deg, roll=0.0):
        return solve.exp_so3(np.array([0, math.radians(deg), 0])) @ solve.exp_so3(np.array([0, 0, math.radians(roll)]))

    frames = {0: turned(0), 1: turned(60), 2: turned(66), 3: turned(200), 4: turned(60, 90)}

    def sees(r, d):
        x, y, z = r.T @ d
        return z > 0 and -0.5 <= x / z * lens.fx + lens.cx <= lens.width - 0.5 and -0.5 <= y / z * lens.fy + lens.cy <= lens.height - 0.5

    targets = spark.createDataFrame([(t, r.ravel().tolist()) for t, r in frames.items()], "target int, rotation array<double>")
    dirs = [v / np.linalg.norm(v) for v in np.random.default_rng(2).normal(size=(200, 3))]
    dirs += [np.array([0.6, 0.0, 1.0]), np.array([0.0, 0.6, 1.0])]  # as far from the axis, in and out of the frame
    rows = spark.createDataFrame([(i, tuple(map(float, d))) for i, d in enumerate(dirs)], "id int, direction struct<x: double, y: double, z: double>")
    got = {r["id"]: r["n"] for r in matching.frame_count(rows, targets, lens).collect()}
    assert got == {i: sum(sees(r, d) for r in frames.values()) for i, d in enumerate(dirs)} and got[200] > 0 == got[201]
    want = {}
    for t, r in frames.items():
        at = [((i + 0.5) * lens.width / 12 - 0.5, (j + 0.5) * lens.height / 12 - 0.5) for i in range(12) for j in range(12)]
        d = [r @ np.array([(u - lens.cx) / lens.fx, (v - lens.cy) / lens.fy, 1.0]) for u, v in at]
        want[t] = sum(sum(sees(q, x) for x in d) >= 0.05 * 144 for o, q in frames.items() if o != t)
    assert {r["target"]: r["n"] for r in matching.frame_neighbours(targets, lens).collect()} == want and want[3] == 0
    assert want[0] == 1  # 1 shares more than 5 %, 2 and the rolled 4 less


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_order_statistics_equal_a_sort(spark, keys):
    from lumenfold.operators import statistics

    r = np.random.default_rng(3)
    values = np.concatenate([r.normal(size=400), np.full(300, 0.25), [np.nan, 1e300, -1e300], r.integers(0, 3, 200)])
    rows = [(None if i % 3 == 0 else int(i % 2), None if i % 17 == 0 else float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, v double")
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r["k"] if keys else 0: r["p"] for r in statistics.exact_percentiles(df, keys, "v", shares).collect()}
    half = {r["k"] if keys else 0: r["median"] for r in statistics.upper_median(df, keys, "v").collect()}
    for key in {k for k, _ in rows} if keys else {0}:
        mine = np.sort([v for k, v in rows if v is not None and v == v and (not keys or k == key)])
        assert np.allclose(got[key], np.quantile(mine, shares)) and half[key] == mine[len(mine) // 2]
    assert statistics.exact_percentiles(df.limit(0), keys, "v", shares).count() == 0


@pytest.mark.parametrize("splits", [1, 3])
def test_matches_equal_plain_loops(spark, splits):
    """Ties, repeated descriptors, a lone candidate, missing descriptors; one pair of frames holds most features."""
    from lumenfold.operators import matching

    r = np.random.default_rng(3)
    frame = lambda: int(r.choice([1, 1, 1, 2, 3]))
    left = [(frame(), k, int(r.integers(0, 64))) for k in range(60)] + [(4, 0, 5), (1, 60, None)]
    right = [(frame(), k, int(r.integers(0, 64))) for k in range(60)] + [(4, 0, 7), (5, 0, 7), (1, 60, None)]
    cfg = matching.Matching(max_distance=2, ratio=0.9)

    def nearest(own, others):
        out = {}
        for pair, k, desc in own:
            met = sorted(((desc ^ e).bit_count(), j) for p, j, e in others if p == pair and e is not None) if desc is not None else []
            if met:
                out[pair, k] = (*met[0], met[1][0] if len(met) > 1 else None)
        return out

    there, back = nearest(left, right), nearest(right, left)
    want = {(p, k, j, d) for (p, k), (d, j, second) in there.items() if d <= 2 and (second is None or d < 0.9 * second or d == second == 0)}
    tables = [spark.createDataFrame(x, "pair int, kp int, desc long") for x in (left, right)]
    got = [tuple(x) for x in matching.knn_ratio(*tables, ["pair"], cfg, splits=splits).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    got = matching.knn_ratio(*tables, ["pair"], cfg, cross_check=True, splits=splits)
    assert {tuple(x) for x in got.collect()} == {(p, k, j, d) for p, k, j, d in want if back[p, j][1] == k}
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_demosaic_broadcasts_no_raster(spark):
    """A raster spread from a few rows looks small to the optimizer; it must not travel whole. Edges mirror, missing samples add nothing."""
    from pyspark.sql import functions as F

    from lumenfold.operators import raster

    i, w, h = F.col("i"), 5, 4
    px = spark.range(3).select(F.col("id").alias("frame"), F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("i")).where("i <> 7")
    px = px.select("frame", F.floor(i / w).cast("int").alias("y"), (i % w).cast("int").alias("x"), ((i * i * 7 + F.col("frame")) % 23).cast("double").alias("v"))
    out = raster.demosaic(px, ["frame"], w, h)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    v = {(r["frame"], r["y"], r["x"]): r["v"] for r in px.collect()}
    mirror = lambda k, n: -k if k < 0 else 2 * n - 2 - k if k >= n else k
    got = out.collect()
    assert len(got) == len(v) == 3 * (w * h - 1)
    for r in got:
        f, y, x = r["frame"], r["y"], r["x"]
        at = lambda filt: sum(k / 8 * v.get((f, mirror(y + dy, h), mirror(x + dx, w)), 0.0) for dy, dx, k in filt)  # noqa: B023, E731
        here = "rggb"[y % 2 * 2 + x % 2]
        rows = {"r": (v[f, y, x], at(raster.GREEN_AT_COLOUR), at(raster.OPPOSITE)), "b": (at(raster.OPPOSITE), at(raster.GREEN_AT_COLOUR), v[f, y, x])}
        across = at(raster.SAME_ROW), v[f, y, x], at(raster.SAME_COLUMN)
        want = rows.get(here) or (across if y % 2 == 0 else across[::-1])
        assert np.allclose([r["r"], r["g"], r["b"]], want)
