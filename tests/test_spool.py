"""Parked frames and 8-bit images."""

from __future__ import annotations

import os
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import codecs, spool


def rows(spark, frames=3, width=5, height=7):
    k = F.col("id")
    px = spark.range(frames * height).select((k % frames).alias("frame"), F.floor(k / frames).alias("y"))
    x = F.sequence(F.lit(0), F.lit(width - 1))
    return px.select("frame", "y", F.transform(x, lambda i: F.col("frame") * 100 + F.col("y") * 10 + i).alias("radiance"), F.transform(x, lambda i: i / 8).alias("confidence"))


def test_frames_come_back_by_strips_and_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(spool, "STRIP_BYTES", 40)
    folder = tmp_path / "run"
    with spool.Spool(spark, str(folder)) as s:
        s.put(rows(spark).repartition(4), 5, 7, 1, True, 3)
        assert s.bytes_on_disk() == spool.bytes_needed(3, 5, 7, 1, True)
        assert sorted(map(str, s.read().collect())) == sorted(map(str, rows(spark).selectExpr("int(frame) frame", "int(y) y", "cast(radiance as array<float>) radiance", "cast(confidence as array<float>) confidence").collect()))
        os.remove(folder / "merged-0001.bin")
        (folder / "merged-0001.bin").write_bytes(b"broken")
        assert s.read().where("frame = 2").count() == 7  # the filter is the reader's: the broken frame isn't opened
        assert s.read("confidence").where("frame = 0 and radiance is null and confidence is not null").count() == 7
        with pytest.raises(Exception, match="another format"):
            s.read().count()
    assert not folder.exists()


def test_a_frame_is_whole_or_absent(spark, tmp_path):
    s = spool.Spool(spark, str(tmp_path / "run"))
    with pytest.raises(Exception, match="isn't whole"):
        s.put(rows(spark).where("frame <> 1 or y <> 3"), 5, 7, 1, True)
    assert os.listdir(tmp_path / "run") == []
    with pytest.raises(Exception, match="free"):
        s.put(rows(spark), 1 << 20, 1 << 20, 4, True, 1000)
    s.close()


def test_png_filters():
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert np.array_equal(codecs.read_png(codecs.png(image)), image)
    flat, lines, above = image.reshape(5, 18).astype(int), [], np.zeros(18, int)
    for kind, line in enumerate(flat):  # one line of each kind of difference
        left = np.concatenate([[0, 0, 0], line[:-3]])
        corner = np.concatenate([[0, 0, 0], above[:-3]])
        p = left + above - corner
        nearest = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left + above) // 2, nearest][kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    plain = codecs.png(image)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    whole = plain[:33] + chunk(b"IDAT", zlib.compress(b"".join(lines))) + chunk(b"IEND", b"")
    assert np.array_equal(codecs.read_png(whole), image)
    assert np.allclose(codecs.linear_image(plain), ((image / 255 + 0.055) / 1.055) ** 2.4, atol=3e-3)
    with pytest.raises(ValueError, match="not a PNG"):
        codecs.read_png(b"x")


def test_a_task_parks_more_frames_than_it_may_open(spark, tmp_path):
    """Rows of many frames in one task, line by line over all frames: few files are open at a time."""
    frames = 300
    code = f"""
import resource, sys
from lumenfold.sources import spool
resource.setrlimit(resource.RLIMIT_NOFILE, (128, resource.getrlimit(resource.RLIMIT_NOFILE)[1]))
w = spool.SpoolWriter({{"path": {str(tmp_path / "run")!r}, "width": "2", "height": "3", "channels": "1", "confidence": "0"}})
w.commit([w.write((f, y, [f, y], None) for y in range(3) for f in range({frames}))])
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    back = spool.Spool(spark, str(tmp_path / "run")).read()
    assert back.count() == 3 * frames and back.where("radiance[0] = frame and radiance[1] = y").count() == 3 * frames
