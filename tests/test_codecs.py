from __future__ import annotations

import json

import numpy as np
import pytest

from lumenfold.sources import codecs, exr_sink, files

R = np.random.default_rng(7)
IMAGE = (10 ** R.uniform(-3, 4, (43, 67, 3))).astype(np.float32)


@pytest.mark.parametrize("compression", [codecs.EXR_NONE, codecs.EXR_ZIPS])
def test_exr_round_trip(compression):
    for image in (IMAGE, np.ones((3, 5, 3), np.float32)):
        assert np.allclose(codecs.read_exr(codecs.write_exr(image, compression)), image, rtol=1e-3)


def test_rgbe_round_trip():
    for image in (IMAGE, np.ones((4, 40, 3), np.float32), IMAGE[:, :5]):
        got = codecs.read_rgbe(codecs.write_rgbe(image))
        assert (np.abs(got - image) <= image.max(axis=-1, keepdims=True) / 128).all()


def test_plane_and_dng():
    got, cfa = codecs.read_plane(codecs.write_plane(IMAGE, "GBRG"))
    assert cfa == "GBRG" and np.allclose(got, IMAGE, rtol=1e-3)
    with pytest.raises(ValueError):
        codecs.read_plane(codecs.write_plane(IMAGE)[:-2])
    counts = R.integers(0, 65536, (9, 7))
    assert np.array_equal(codecs.read_dng(codecs.write_dng(counts)), counts)


def test_half_clamps():
    assert codecs.to_half(np.array([np.nan, np.inf, -np.inf, 1e9])).tolist() == [0, 65504, -65504, 65504]


def test_journal_survives_a_torn_tail(spark, tmp_path):
    record = lambda t, b, name: json.dumps({"target": t, "bracket": b, "t": 0.1, "iso": 100, "f": 1.8, "w": 4, "h": 2, "c": 1, "linear": True, "ts": 5, "file": name, "pose": [1.0] * 9 if b else [1.0]})
    plane = codecs.write_plane(np.ones((2, 4, 1), np.float32))
    (tmp_path / "a.hrf").write_bytes(plane)
    (tmp_path / "b.hrf").write_bytes(plane[:-1])  # truncated
    (tmp_path / "c.hrf").write_bytes(plane)
    lines = [record(0, 0, "a.hrf"), "{ not json", record(0, 1, "b.hrf"), record(0, 2, "gone.hrf"), record(0, 0, "c.hrf")]
    (tmp_path / "journal.jsonl").write_text("\n".join(lines) + "\n" + record(1, 0, "a.hrf")[:20])
    got = files.journal(spark, str(tmp_path)).collect()
    assert [(r["target"], r["bracket"], r["file"], r["pose"]) for r in got] == [(0, 0, "c.hrf", None)]
    x = files.exploded(files.rasters(spark, f"{tmp_path}/a.hrf", "plane"))
    assert x.count() == 8 and x.where("v = 1 and x < 4 and y < 2").count() == 8


def test_exr_sink(spark, tmp_path):
    from lumenfold.plans.common import grid

    px = grid(spark, 16, 8).selectExpr("y", "x", "v r", "v * 2 g", "v * 3 b")
    exr_sink.write_exr(px, 16, 8, f"{tmp_path}/o.exr")
    got = codecs.read_exr((tmp_path / "o.exr").read_bytes())
    want = px.orderBy("y", "x").toPandas()[["r", "g", "b"]].to_numpy().reshape(8, 16, 3)
    assert np.allclose(got, want, rtol=1e-3, atol=1e-6)
