"""What kept steps from larger tables: calls a group, rows a pixel, expressions worked out again and again."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from compare import rows
from pyspark.sql import functions as F

from lumenfold.config import Lens
from lumenfold.functions import geometry as g
from lumenfold.functions.lcg import JavaRandom


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairing_holds_a_batch(spark):
    """arrivals stream through a task in their order; cameras of one task, also one without a name, don't mix."""
    from lumenfold.streaming import pairing

    rng = np.random.default_rng(2)
    log = [(c, k, int(rng.integers(0, 12)), ("image", "meta")[int(rng.integers(0, 2))], k) for k, c in enumerate([None, "a", "b", "c"] * 60)]
    df = spark.createDataFrame(log, pairing.ARRIVALS).repartition(3)
    out = pairing.pair(df, 3)
    assert "FlatMapGroupsInPandas" not in plan(out)
    want = []
    for camera in (None, "a", "b", "c"):
        waiting = {"image": {}, "meta": {}}
        want += [(camera, *p) for c, _, stamp, side, value in log if c == camera and (p := pairing.step(waiting, {"stamp": stamp, "side": side, "value": value}, 3))]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want)) and len(want) > 20
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_bilinear_points_are_neither_grouped_nor_repeated(spark):
    """equal points stay two; missing pixels add nothing, where all are missing there is no value; no raster travels whole."""
    from lumenfold.operators import raster

    v = {(f, y, x): float((f * 5 + y * 3 + x * 7) % 13) for f in (0, 1) for y in range(3) for x in range(4) if (f, y, x) != (1, 1, 1)}
    px = spark.createDataFrame([(*k, w) for k, w in v.items()], "frame long, y int, x int, v double")
    points = [(0, 1, 1.25, 0.5), (0, 1, 1.25, 0.5), (0, 2, -3.0, 9.0), (0, 3, 3.0, 2.0), (1, 4, 0.5, 0.25), (1, 5, 2.75, 1.75), (2, 6, 1.0, 1.0)]
    out = raster.bilinear_samples(spark.createDataFrame(points, "frame long, id int, u double, v double"), px, ["frame"], 4, 3)
    assert "Broadcast" not in plan(out) and out.columns == ["frame", "id", "u", "v", "value"]

    def value(f, u, w):
        u, w = min(max(u, 0.0), 3.0), min(max(w, 0.0), 2.0)
        x, y = min(math.floor(u), 2), min(math.floor(w), 1)
        return sum((u - x if dx else x + 1 - u) * (w - y if dy else y + 1 - w) * v.get((f, y + dy, x + dx), 0.0) for dy in (0, 1) for dx in (0, 1))

    assert rows(out.select("id", "value").toPandas()) == rows(pd.DataFrame([(i, value(f, u, w)) for f, i, u, w in points if f < 2], columns=["id", "value"]))


def test_brackets_are_spread_once_they_are_wanted(spark):
    """a mosaic in one row or several; only frames of complete brackets are spread, and they move once."""
    from lumenfold.operators import exposure

    frames = [(t, r, y) for t, rungs in ((1, (1, 2, 5)), (2, (1,)), (3, (2, 3))) for r in rungs for y in range(0, 4, 2)]
    df = spark.createDataFrame(frames, "target long, rung int, top int")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((F.col("top") + F.floor(i / 4)).alias("y"), (i % 4).alias("x"), (F.col("rung") * 100.0 + (F.col("top") + F.floor(i / 4)) * 4 + i % 4).alias("v")))
    wanted = spark.createDataFrame([(1, 2), (1, 1), (1, 1), (2, 1), (2, 2), (3, 3)], "target long, rung int")
    out = exposure.read_brackets(df, pixels, wanted, 4, 4, reductions=1)
    assert plan(out).count("Exchange hashpartitioning") <= 2
    got = [(x["target"], x["rung"], x["place"], x["y"], x["x"], x["r"], x["g"], x["b"]) for x in out.collect()]
    mean = lambda r, *at: r * 100.0 + sum(at) / len(at)
    one = lambda t, r, p: (t, r, p, 0, 0, mean(r, 0, 2, 8, 10), mean(r, 1, 3, 9, 11, 4, 6, 12, 14), mean(r, 5, 7, 13, 15))
    assert sorted(got) == [one(1, 1, 0), one(1, 2, 1), one(3, 3, 0)]


def test_rotations_are_worked_out_once(spark):
    """F16: neither a matrix in a rotation nor a bearing in an angle is copied for each time that it is named."""
    from lumenfold.operators import capture

    m = spark.range(10).select("id", g.from_angles(F.col("id") * 7.0, F.col("id") * 3.0).alias("predicted"))
    turned = m.withColumn("seen", g.rotate(g.exp_so3(g.vec(F.lit(0.0), F.col("id") / 100.0, F.lit(0.0))), F.col("predicted")))
    out = capture.believable(turned, 0.045)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("SIN(") < 30
    assert [x["id"] for x in out.select("id").orderBy("id").collect()] == [0, 1, 2, 3, 4]


def test_draws_side_by_side_equal_one_by_one():
    """the places of all pairs of a batch at once, each from its own stream."""
    from lumenfold.operators import sampling, solve

    lens, most, seed = Lens(), 6, 11
    pair = np.array([0, 5, -3, 7, 1 << 40, 9], np.int64)
    turn = np.stack([solve.exp_so3(np.array([0.0, t, 0.0])) for t in (0.1, 0.6, 0.3, 2.5, -0.4, 0.75)])
    row, sample, u, v, ub, vb = sampling.draws(pair, turn, lens, most, seed)
    want = []
    for k in range(len(pair)):
        rng, n = JavaRandom(seed + int(pair[k])), 0
        for _ in range(most * sampling.TRIES):
            if n == most:
                break
            p, q = (size * (0.2 + 0.6 * rng.next_double()) for size in (lens.width, lens.height))
            x, y, z = turn[k] @ np.array([(p - lens.cx) / lens.fx, (q - lens.cy) / lens.fy, 1.0])
            if z > 1e-12 and 0.15 * lens.width <= (a := lens.fx * x / z + lens.cx) <= 0.85 * lens.width and 0.15 * lens.height <= (b := lens.fy * y / z + lens.cy) <= 0.85 * lens.height:
                want.append((k, n, p, q, a, b))
                n += 1
    assert list(zip(row.tolist(), sample.tolist(), strict=True)) == [w[:2] for w in want] and 3 not in row
    assert np.allclose(np.column_stack([u, v, ub, vb]), [w[2:] for w in want])


def test_a_long_log_is_read_in_few_blocks(tmp_path):
    """blocks of a few bytes would be a task each; every line is still read once."""
    from lumenfold.sources import devices

    for part in ("a", "b"):
        (tmp_path / part).write_text("".join(f'{{"capture": "{part}", "seq": {k}}}\n' for k in range(4000)))
    reader = devices.LogReader({"path": str(tmp_path), "block": "16"}, type("S", (), {"names": ["capture", "seq"]})())
    parts = reader.partitions()
    assert len(parts) <= devices.TASKS + 2
    assert sorted(r for p in parts for r in reader.read(p)) == [(part, k) for part in "ab" for k in range(4000)]
