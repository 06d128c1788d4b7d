from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.functions import geometry as g
from lumenfold.operators import capture


def test_growing_a_run():
    device = lambda x: max(x, 1e-4)
    rungs, runs = [0.01, 0.08, 0.64], {0: (1, 2), 1: (0, 1)}
    assert capture.grow(rungs, runs, 0, 0.02, device) == (rungs, {0: (0, 2), 1: (0, 1)})
    ladder, grown = capture.grow(rungs, runs, 1, 0.0001, device)
    assert ladder == [1e-4, 0.01 / 64, 0.00125, 0.01, 0.08, 0.64] and grown == {0: (4, 5), 1: (0, 4)}
    assert capture.grow([1e-4, 1e-3], {0: (0, 1)}, 0, 1e-6, device) is None
    assert capture.grow(rungs, runs, 1, 0.0001, device, most=3)[1][1] == (0, 2)


def test_small_operators(spark):
    frames = spark.createDataFrame([(3, True), (1, False), (7, True)], "frame int, placed boolean")
    assert [(r["frame"], r["index"]) for r in capture.keep_placed(frames).orderBy("index").collect()] == [(3, 0), (7, 1)]
    assert capture.keep_placed(frames.withColumn("placed", F.lit(False))).count() == 3
    d = lambda yaw: g.from_angles(F.lit(float(yaw)), F.lit(0.0))
    m = spark.range(3).select(F.when(F.col("id") < 2, F.when(F.col("id") == 0, d(0)).otherwise(d(10))).alias("predicted"), d(1).alias("seen"))
    assert capture.believable(m, 0.1).count() == 2
    assert capture.distortion_leverage(spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "ra double, rb double")).first()[0] == 0.5
    scan = spark.createDataFrame([(True, False)] * 9 + [(False, None)], "metered boolean, highlights_clipped boolean")
    assert tuple(capture.scan_ready(scan).first()) == (0.9, True, False)
    held = capture.resolution_options(spark.createDataFrame([(1, 9000), (2, 4096), (3, 100)], "device int, widest int"), F.col("widest"))
    assert [(r["device"], r["width"], r["height"], r["label"]) for r in held.orderBy("device", "width").collect()] == [(1, 2048, 1024, "2K"), (1, 4096, 2048, "4K"), (1, 8192, 4096, "8K"), (2, 2048, 1024, "2K"), (2, 4096, 2048, "4K")]
