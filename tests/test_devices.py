"""Sources of camera and pose records, and the EXR sink."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest

from lumenfold.sources import codecs, devices, exr_sink


def lines(first: int, n: int) -> str:
    return "".join(json.dumps({"capture": f"c{k % 3}", "seq": k, "now_ns": k, "kind": "frame", "bracket": k % 4}) + "\n" for k in range(first, first + n))


def test_blocks_hold_each_line_once(spark, tmp_path):
    devices.register(spark)
    (tmp_path / "a.jsonl").write_text(lines(0, 200) + '{"capture": "half')
    (tmp_path / "b.jsonl").write_text(lines(200, 3))
    (tmp_path / "_ignored").write_text("x")
    for block in (1, 40, 97, 1 << 20):
        log = devices.CaptureLog({"path": str(tmp_path), "block": str(block)})
        from pyspark.sql.types import StructType

        reader = log.reader(StructType.fromDDL(devices.EVENTS))
        got = [r for p in reader.partitions() for r in reader.read(p)]
        assert sorted(r[1] for r in got) == list(range(203)), block
    read = spark.read.format("capture_log").option("path", str(tmp_path)).load()
    assert read.count() == 203 and read.where("kind = 'frame' and x is null").count() == 203
    (tmp_path / "empty").mkdir()
    assert spark.read.format("capture_log").option("path", f"{tmp_path}/empty").load().count() == 0


def test_a_stream_that_resumes_reads_each_record_once(spark, tmp_path):
    devices.register(spark)
    log = tmp_path / "log"
    log.mkdir()

    def run():
        s = spark.readStream.format("capture_log").option("path", str(log)).option("block", 500).load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(100)
        assert q.exception() is None

    whole = lines(0, 90)
    (log / "a.jsonl").write_text(whole[:1000])  # ends within a line
    run()
    seen = spark.read.parquet(f"{tmp_path}/out").count()
    assert 0 < seen < 90
    (log / "a.jsonl").write_text(whole)
    (log / "b.jsonl").write_text(lines(90, 40))
    run()
    run()
    assert sorted(r["seq"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(130))


def image(spark, width=16, height=9):
    from pyspark.sql import functions as F

    i = F.col("id")
    return spark.range(width * height).select(F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"), *[((i * k) % 31 / 31.0).alias(c) for k, c in ((3, "r"), (5, "g"), (7, "b"))])


@pytest.mark.parametrize("compression", [codecs.EXR_NONE, codecs.EXR_ZIPS])
def test_bytes_are_those_of_a_file_written_at_once(spark, tmp_path, compression):
    px = image(spark).repartition(5)
    path = f"{tmp_path}/o.exr"
    exr_sink.write_exr(px, 16, 9, path, compression)
    got = (tmp_path / "o.exr").read_bytes()
    want = px.orderBy("y", "x").toPandas()[["r", "g", "b"]].to_numpy(np.float32).reshape(9, 16, 3)
    assert np.array_equal(codecs.read_exr(got), codecs.read_exr(codecs.write_exr(want, compression)))
    assert len(got) == len(codecs.write_exr(want, compression)) and os.listdir(tmp_path) == ["o.exr"]


def test_missing_lines_leave_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="8 lines for 9 rows"):
        exr_sink.write_exr(image(spark).where("y <> 4"), 16, 9, f"{tmp_path}/o.exr")
    assert os.listdir(tmp_path) == []


def test_a_repeated_task_writes_the_same_and_an_abort_cleans_up(tmp_path):
    raw = [codecs.exr_line(y, np.full((4, 3), y, np.float32), codecs.EXR_NONE) for y in range(3)]
    rows = [(y, y * len(raw[0]), raw[y]) for y in range(3)]
    options = {"path": f"{tmp_path}/o.exr", "width": "4", "height": "3", "compression": str(codecs.EXR_NONE)}
    w = exr_sink.ExrWriter(options, True)
    w.write(iter(rows[:2]))  # an attempt that is lost before it is told of
    w.commit([w.write(iter(rows[2:])), w.write(iter([])), w.write(iter(rows[:2]))])
    assert codecs.read_exr((tmp_path / "o.exr").read_bytes())[2].max() == 2 and os.listdir(tmp_path) == ["o.exr"]
    with pytest.raises(ValueError, match="exists"):
        exr_sink.ExrWriter(options, False)
    w = exr_sink.ExrWriter({**options, "path": f"{tmp_path}/p.exr"}, False)
    w.write(iter(rows))
    w.abort([])
    assert os.listdir(tmp_path) == ["o.exr"]
