from __future__ import annotations

import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.config import Lens
from lumenfold.functions import geometry as g
from lumenfold.operators import sampling
from lumenfold.sources import store


def test_store_keeps_the_last_and_repeats_replace(spark, tmp_path):
    frames = lambda rows: spark.createDataFrame(rows, "target int, bracket int, value int")
    write = store.store_batch(str(tmp_path))
    for batch, number in ((frames([(0, 0, 1), (0, 1, 2)]), 0), (frames([(0, 0, 3)]), 1), (frames([(0, 0, 3)]), 1)):
        write(batch, number)
    got = {(r["target"], r["bracket"]): r["value"] for r in store.stored(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 3, (0, 1): 2}
    store.create(frames([(1, 1, 1)]), str(tmp_path))
    with pytest.raises(Exception, match="exist"):
        store.create(frames([(1, 1, 1)]), str(tmp_path))


def test_report_subsample_and_png(spark):
    poses = spark.createDataFrame([(1, 2.0), (0, 1.0)], "frame int, yaw double")
    doc = json.loads(store.report(spark.range(1).selectExpr("0.5 covered"), poses).first()[0])
    assert doc["version"] == 2 and [p["frame"] for p in doc["poses"]] == [0, 1]
    got = spark.createDataFrame([(100, 100), (101, 100), (400, 100), (1700, 100)], "p int, l int").select(store.subsample(F.col("p"), F.col("l"))).collect()
    assert [r[0] for r in got] == [1, 2, 2, 8]
    data = store.png(np.arange(24).reshape(2, 4, 3))
    assert data[:4] == b"\x89PNG" and zlib.decompress(data[41:-16])[1:13] == bytes(range(12))


def test_jittered_grid_and_photometric_samples(spark):
    at = sampling.jittered_grid(80, 60, 48, 7)
    assert len(at) == 48 and len({(x // 10, y // 10) for x, y in at}) == 48
    lens = Lens(80, 60, 60.0, 60.0, 39.5, 29.5)
    frames = spark.range(2).select(F.col("id").cast("int").alias("frame"), g.looking_at(F.col("id") * 15.0, F.lit(0.0)).alias("rotation"))
    pairs = spark.createDataFrame([(0, 1)], "a int, b int")
    shared = sampling.shared_positions(pairs, sampling.grid_samples(spark, 80, 60, 48, 7), frames, lens)
    assert 0 < shared.count() < 48
    px = spark.range(2 * 80 * 60).selectExpr("cast(id div 4800 as int) frame", "cast(id % 4800 div 80 as int) y", "cast(id % 80 as int) x", "cast(1 + id div 4800 as double) v")
    got = sampling.photometric_samples(shared, px).collect()
    assert len(got) == shared.count() and {(r["va"], r["vb"]) for r in got} == {(1.0, 2.0)}


def test_tracking_follows_the_frame_before(spark):
    f = spark.createDataFrame([(0, 1, 5), (0, 2, -9), (3, 7, 5), (3, 8, -9), (9, 4, 5), (9, 5, -9)], "frame int, kp int, desc long")
    got = {(r["frame"], r["ka"], r["kb"]) for r in sampling.tracked(f).collect()}
    assert got == {(3, 1, 7), (3, 2, 8), (9, 7, 4), (9, 8, 5)}


def test_a_reader_sees_one_plan_during_a_revision(spark, tmp_path):
    path, kind = f"{tmp_path}/capture", "format string, rungs int"
    plan = lambda n: spark.createDataFrame([("x", n)], kind)
    with pytest.raises(FileNotFoundError):
        store.revise(plan(1), path)
    store.create(plan(3), path)
    with pytest.raises(FileExistsError):
        store.create(plan(3), path)
    pinned = store.header(spark, path, kind)
    assert store.revise(plan(4), path) == 1 and store.version(spark, path) == 1
    assert pinned.first()["rungs"] == 3 and store.header(spark, path, kind).first()["rungs"] == 4 and store.header(spark, path, kind, 0).first()["rungs"] == 3
    plan(9).write.json(f"{path}/session/version=2")  # another revision of version 1 is under way
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        store.revise(plan(5), path)
    assert store.header(spark, path, kind).first()["rungs"] == 4


def test_a_batch_that_does_not_fit_is_refused(spark, tmp_path):
    frames = spark.createDataFrame([(0, 0, 60), (0, 1, 60)], "target int, bracket int, bytes long")
    with pytest.raises(OSError, match="doesn't fit"):
        store.store_batch(f"{tmp_path}/s", lambda: 100)(frames, 0)
    store.store_batch(f"{tmp_path}/s", lambda: 120)(frames, 0)
    store.store_batch(f"{tmp_path}/s")(frames, 1)
    assert store.stored(spark, f"{tmp_path}/s").count() == 2
