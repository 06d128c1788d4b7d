from __future__ import annotations

import math

import numpy as np
import pytest

from lumenfold.functions.lcg import JavaRandom
from lumenfold.operators import solve

R = np.random.default_rng(3)


def test_java_random_is_the_documented_sequence():
    assert JavaRandom(42).next_int(10) == 0 and [JavaRandom(0).bits(32)] == [-1155484576]


def test_gains_recover_scales(spark):
    true = np.array([1, 1.8, 0.55, 3.2, 0.9, 2.1])
    rows = []
    for a in range(6):
        for b in range(a + 1, 6):
            for v in R.uniform(0.1, 5, 25):
                rows.append((a, b, float(v / true[a]), float(v / true[b]), 1.0))
    df = spark.createDataFrame(rows, "a int, b int, va double, vb double, w double")
    want = true / np.exp(np.log(true).mean())
    assert np.allclose(solve.gains(df, 6), want, rtol=1e-5)
    bad = spark.createDataFrame([(a, b, x, y * (float(10 ** R.uniform(-1, 1)) if k % 5 == 0 else 1.0), w) for k, (a, b, x, y, w) in enumerate(rows)], df.schema)
    assert np.allclose(solve.gains(bad, 6, rounds=5), want, rtol=0.06)


def test_ransac_and_bundle(spark):
    def unit(n):
        v = R.normal(size=(n, 3))
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    true = [np.eye(3), *[solve.exp_so3(R.normal(size=3) * 0.4) for _ in range(3)]]
    p = unit(80)
    q = p @ true[1].T
    q[:20] = unit(20)
    r, inside, error = solve.ransac(p, q, math.radians(0.4), 200, 12345)
    assert inside.sum() >= 60 and np.allclose(r, true[1], atol=1e-6) and error < 1e-6
    rows = []
    for a in range(4):
        for b in range(a + 1, 4):
            for w in unit(30):
                rows.append((a, b, *map(float, true[a].T @ w), *map(float, true[b].T @ w), 1.0))
    df = spark.createDataFrame(rows, "a int, b int, px double, py double, pz double, qx double, qy double, qz double, w double").cache()
    start = [true[0], *[solve.exp_so3(R.normal(size=3) * 0.03) @ t for t in true[1:]]]
    got, costs = solve.bundle_adjust(df, start, rounds=12)
    assert all(y < x for x, y in zip(costs, costs[1:], strict=False))
    assert max(np.abs(g - t).max() for g, t in zip(got, true, strict=True)) < math.radians(0.05)


def test_spanning_rotations():
    r = [solve.exp_so3(np.array([0, 0.1 * k, 0])) for k in range(4)]
    pairs = [(0, 1, 20, r[0].T @ r[1]), (1, 2, 50, r[1].T @ r[2]), (2, 3, 10, r[2].T @ r[3])]
    placed = solve.spanning_rotations(pairs, 4)
    assert len(placed) == 4 and np.allclose(placed[0].T @ placed[3], r[0].T @ r[3])


def test_response_and_vignette(spark):
    encode = lambda x: float(np.clip(min(1.0, x) ** (1 / 2.2) + R.normal() * 0.002, 0, 1))
    rows = [(s, encode(x * e), e) for s, x in enumerate(10 ** R.uniform(-2, 1, 220)) for e in (0.0625, 0.125, 0.25, 0.5, 1.0)]
    lut = np.array(solve.response_curve(spark.createDataFrame(rows, "sample int, encoded double, rel double")))
    true = (np.arange(256) / 255) ** 2.2
    k = np.arange(40, 231)
    assert lut[-1] == 1.0 and (np.diff(lut) >= 0).all() and np.allclose(lut[k] / true[k], 1, atol=0.08)
    assert np.allclose(lut[k] / lut[128], true[k] / true[128], rtol=0.02)  # the shape, whatever white is scaled to
    f = lambda r: 1 - 0.42 * r**2 + 0.09 * r**4
    obs = [(float(a), float(b), float(f(a) / f(b))) for a, b in R.uniform(0, 1, (300, 2))]
    assert solve.vignette(spark.createDataFrame(obs, "r1 double, r2 double, ratio double")) == pytest.approx((-0.42, 0.09), abs=1e-3)


def test_initial_rotations_are_levelled_and_filled():
    r = np.random.default_rng(8)
    true = [solve.exp_so3(v) for v in r.normal(size=(6, 3))]
    tilt = [solve.exp_so3(np.array(v)) for v in ((0.1, 0, 0), (-0.1, 0, 0), (0, 0, 0))]
    pairs = [(0, 1, 20, true[0].T @ true[1]), (2, 1, 30, true[2].T @ true[1]), (4, 5, 10, true[4].T @ true[5])]
    priors = [tilt[0] @ true[0], tilt[1] @ true[1], true[2], true[3], true[4], None]
    got, placed, alone = solve.initial_rotations(pairs, priors)
    assert all(np.allclose(got[i], true[i]) for i in range(5)) and np.allclose(got[5], np.eye(3))
    assert placed == [True] * 5 + [False] and alone == [False, False, False, True, True, False]
    got, placed, alone = solve.initial_rotations([], [true[0], None, true[2]])
    assert np.allclose(got[0], true[0]) and np.allclose(got[2], true[2]) and placed == alone == [True, False, True]
    got, placed, alone = solve.initial_rotations(pairs[:1], [None] * 3)
    assert placed == [True, True, False] and np.allclose(got[0].T @ got[1], true[0].T @ true[1]) and not any(alone)


def test_queries_use_the_production_rounds(spark, sf, monkeypatch):
    from lumenfold.plans import scene

    seen = []
    gains = solve.gains
    monkeypatch.setattr(solve, "gains", lambda *a, **k: seen.append(k) or gains(*a, **k))
    monkeypatch.setattr(solve, "_pair_solver", lambda keys, limit, rounds, seed: seen.append(rounds) or (lambda pdf: pdf))
    assert scene.gain_solve(spark, sf).count() == 12
    scene.pair_rotation(spark, sf)
    assert seen == [{"rounds": 4}, 1000]


def test_bordered_step_is_that_of_the_whole_system():
    from lumenfold.operators import distortion

    r = np.random.default_rng(3)
    j = r.normal(size=(40, 7))
    whole, rhs = j.T @ j, r.normal(size=7)
    turn, shift = distortion.bordered_step(whole[:6, :6], rhs[:6], whole[:6, 6], whole[6, 6], rhs[6], 1e-9, (-9.0, 9.0))
    assert np.allclose([*turn, shift], np.linalg.solve(whole + 1e-9 * np.eye(7), -rhs), atol=1e-9)
    turn, shift = distortion.bordered_step(whole[:6, :6], rhs[:6], whole[:6, 6], whole[6, 6], rhs[6], 0.0, (0.0, 0.0))
    assert shift == 0.0 and np.allclose(turn, np.linalg.solve(whole[:6, :6], -rhs[:6]))


def test_distortion_needs_pixels(spark):
    from lumenfold.operators import distortion

    with pytest.raises(ValueError, match="pixels"):
        distortion.adjusted(spark.createDataFrame([("c", 0, 1, 0.0, 0.0)], "capture string, a int, b int, px double, py double"), {"c": [np.eye(3)] * 2})


def test_growth_over_the_cluster_is_that_of_strongest_edges(spark):
    r = np.random.default_rng(8)
    truth = [solve.exp_so3(r.normal(size=3)) for _ in range(24)]
    edges = [(int(a), int(b), int(r.integers(1, 6))) for a in range(24) for b in range(a + 1, 24) if r.random() < 0.12 and (a < 20) == (b < 20)]  # two parts, many equal counts
    noisy = [(a, b, n, truth[a].T @ truth[b] @ solve.exp_so3(0.05 * r.normal(size=3))) for a, b, n in edges]
    want = solve.spanning_rotations(noisy, 24)
    rows = [(a, b, n, [float(x) for x in m.ravel()]) for a, b, n, m in noisy]
    got = {x["frame"]: np.array(x["rotation"]).reshape(3, 3) for x in solve.grown(spark.createDataFrame(rows, "a long, b long, inliers int, rotation array<double>")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert solve.grown(spark.createDataFrame([], "a long, b long, inliers int, rotation array<double>")).count() == 0


def test_pair_sums_are_those_of_single_matches(spark):
    """Sums by arrays, over several batches and tasks, against one match at a time; a fit's rotations are its own."""
    from lumenfold.config import Lens
    from lumenfold.operators import distortion

    rng, lens = np.random.default_rng(3), Lens(800, 600, 571.26, 571.26, 399.5, 299.5)
    states = [(c, fit, k1, 0.02, np.array([solve.exp_so3(rng.normal(0, 0.1, 3)) for _ in range(n)])) for c, n in (("p", 3), ("q", 2)) for fit, k1 in (("straight", 0.0), ("free", -0.08))]
    rows = [(c, a, a + 1, *[float(x) for x in rng.uniform(50, 550, 4)], float(rng.uniform(0.5, 2))) for c, most in (("p", 2), ("q", 1), ("none", 1)) for a in rng.integers(0, most, 40).tolist()]
    matches = spark.createDataFrame(rows, "capture string, a int, b int, ua double, va double, ub double, vb double, w double").repartition(3)
    got = {(r["capture"], r["fit"], r["a"], r["b"]): r for r in distortion.pair_sums(matches, states, lens).collect()}
    assert {k[0] for k in got} == {"p", "q"}

    def bearing(u, v, k1):
        x, y = (u - lens.cx) / lens.fx, (v - lens.cy) / lens.fy
        low, high, seen = 0.0, 2.0, math.hypot(x, y)
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if mid * (1 + k1 * mid * mid) < seen else (low, mid)
        p = np.array([x * low / seen, y * low / seen, 1.0])
        return p / np.linalg.norm(p)

    for c, fit, k1, huber, turns in states:
        want = {}
        for cap, a, b, ua, va, ub, vb, w in rows:
            if cap == c:
                at = lambda k: turns[b] @ bearing(ub, vb, k) - turns[a] @ bearing(ua, va, k)  # noqa: B023, E731
                u, r = turns[a] @ bearing(ua, va, k1), at(k1)
                e, miss = (at(k1 + 1e-5) - at(k1 - 1e-5)) / 2e-5, float(np.linalg.norm(r))
                k = w * min(1.0, huber / miss)
                cost = w * (miss**2 if miss <= huber else huber * (2 * miss - huber))
                want[a, b] = want.get((a, b), 0) + np.array([1, cost, k * u[0] * u[1], k * np.cross(u, e)[2], k * (e @ e), k * (e @ r)])
        for (a, b), sums in want.items():
            r = got[c, fit, a, b]
            assert np.allclose([r["n"], r["cost"], r["uu01"], r["ue2"], r["ee"], r["er"]], sums, rtol=1e-5, atol=1e-8)


def test_cuts_are_solved_by_the_batch(spark):
    """Many networks a call, not one; a network without edges has no flow between its nodes."""
    nodes = spark.createDataFrame([("a", 0, 5.0, 0.0), ("a", 1, 0.0, 4.0), ("b", 0, 3.0, 2.0), (None, 0, 1.0, 0.0), (None, 1, 0.0, 9.0)], "k string, node int, source double, sink double")
    edges = spark.createDataFrame([("a", 0, 1, 2.5), (None, 1, 0, 0.5)], "k string, a int, b int, capacity double")
    out = solve.min_cuts(nodes, edges, "k")
    assert {r["k"]: r["flow"] for r in out.collect()} == {"a": 2.5, "b": 2.0, None: 0.5}
    assert "CoGroups" not in out._jdf.queryExecution().executedPlan().toString()
