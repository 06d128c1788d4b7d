"""Merged frames parked for a run: little-endian floats in a file a frame, read by strips, gone when the run ends.

A file has five numbers (magic, width, height, channels, whether there is a confidence), then the radiance of all rows, then
the confidence. Rows have known places, so tasks write theirs into an unfinished file and the commit names it; a
frame is whole or absent. A reader cuts files into strips, opens only the frames that a filter names, and leaves the
plane unread that isn't asked for. The folder lies on a file system that driver and executors mount.
"""

from __future__ import annotations

import os
import re
import shutil
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MAGIC, HEADER = 0x484D5246, 20  #: fixed values of the format
OPEN_FILES = 64  #: of a task that writes
STRIP_BYTES = 4 << 20  #: of radiance that a task reads at once
ROWS = "frame int, y int, radiance array<float>, confidence array<float>"  #: a row of a frame; radiance is width x channels


def frame_bytes(width: int, height: int, channels: int, confidence: bool) -> int:
    return HEADER + 4 * width * height * (channels + confidence)


def bytes_needed(frames: int, width: int, height: int, channels: int, confidence: bool) -> int:
    """What a run parks, for a look at the free space before it starts."""
    return frames * frame_bytes(width, height, channels, confidence)


def _local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


def _file(folder: str, frame: int) -> str:
    return os.path.join(folder, f"merged-{frame:04d}.bin")


@dataclass
class Parked(WriterCommitMessage):
    rows: dict[int, bytes]  #: by frame, the numbers of the rows written


class SpoolWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.run = _local(options["path"]), uuid.uuid4().hex
        self.width, self.height, self.channels, self.confidence = (int(options[k]) for k in ("width", "height", "channels", "confidence"))
        os.makedirs(self.folder, exist_ok=True)
        wanted = bytes_needed(int(options.get("frames", 1)), self.width, self.height, self.channels, bool(self.confidence))
        free = shutil.disk_usage(self.folder).free
        if free and free < wanted:
            raise ValueError(f"{wanted} bytes to park, {free} free")

    def _part(self, frame: int) -> str:
        return f"{_file(self.folder, frame)}.{self.run}.part"

    def write(self, rows: Iterator) -> Parked:
        files, seen, wide = OrderedDict(), {}, self.width * self.channels

        def close(file: int) -> None:
            try:
                os.fsync(file)
            finally:
                os.close(file)

        try:
            for frame, y, radiance, confidence in rows:
                if frame not in files:
                    if len(files) >= OPEN_FILES:  # a task may hold rows of more frames than it may have files open
                        close(files.popitem(last=False)[1])
                    files[frame] = os.open(self._part(frame), os.O_CREAT | os.O_WRONLY, 0o644)
                files.move_to_end(frame)
                values = np.asarray(radiance, "<f4")
                if len(values) != wide or not 0 <= y < self.height:
                    raise ValueError(f"row {y} of frame {frame} has {len(values)} values")
                os.pwrite(files[frame], values.tobytes(), HEADER + 4 * wide * y)
                if self.confidence:
                    os.pwrite(files[frame], np.asarray(confidence, "<f4").tobytes(), HEADER + 4 * (wide * self.height + self.width * y))
                seen.setdefault(frame, []).append(y)
        finally:
            while files:
                close(files.popitem()[1])
        return Parked({k: np.array(v, "<i4").tobytes() for k, v in seen.items()})

    def commit(self, messages: list[Parked | None]) -> None:
        rows: dict[int, list] = {}
        for m in messages:
            for frame, ys in (m.rows if m else {}).items():
                rows.setdefault(frame, []).append(np.frombuffer(ys, "<i4"))
        for frame, ys in rows.items():
            if not np.array_equal(np.sort(np.concatenate(ys)), np.arange(self.height)):
                self.abort(messages)
                raise ValueError(f"frame {frame} isn't whole")
        for frame in rows:
            with open(self._part(frame), "r+b") as out:
                out.write(struct.pack("<5i", MAGIC, self.width, self.height, self.channels, self.confidence))
            os.replace(self._part(frame), _file(self.folder, frame))

    def abort(self, messages: list[Parked | None]) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(f".{self.run}.part"):
                os.remove(os.path.join(self.folder, name))


class Strip(InputPartition):
    def __init__(self, frame: int, first: int, rows: int):
        self.frame, self.first, self.rows = frame, first, rows


class SpoolReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.frames = _local(options["path"]), None
        self.planes = {p.strip() for p in options.get("planes", "radiance,confidence").split(",")}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Frames that are named; other filters are Spark's."""
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if named is not None and f.attribute == ("frame",):
                self.frames = named if self.frames is None else self.frames & named
            else:
                yield f

    def header(self, frame: int) -> tuple[int, int, int, int]:
        with open(_file(self.folder, frame), "rb") as f:
            head = f.read(HEADER)
        if len(head) < HEADER or struct.unpack_from("<i", head)[0] != MAGIC:
            raise ValueError(f"{_file(self.folder, frame)} has another format")
        return struct.unpack("<5i", head)[1:]

    def partitions(self) -> list[Strip]:
        there = sorted(int(m[1]) for m in (re.fullmatch(r"merged-(\d+)\.bin", n) for n in os.listdir(self.folder)) if m)
        out = []
        for frame in there:
            if self.frames is None or frame in self.frames:
                w, h, c, _ = self.header(frame)
                rows = max(1, STRIP_BYTES // max(1, 4 * w * c))
                out += [Strip(frame, y, min(rows, h - y)) for y in range(0, h, rows)]
        return out or [Strip(-1, 0, 0)]

    def read(self, strip: Strip) -> Iterator[pa.RecordBatch]:
        if strip.rows:
            w, h, c, sure = self.header(strip.frame)
            with open(_file(self.folder, strip.frame), "rb") as f:
                radiance = self._plane(f, HEADER, strip, w * c) if "radiance" in self.planes else None
                confidence = self._plane(f, HEADER + 4 * w * h * c, strip, w) if sure and "confidence" in self.planes else None
            none = pa.nulls(strip.rows, pa.list_(pa.float32()))
            columns = [pa.array([strip.frame] * strip.rows, pa.int32()), pa.array(range(strip.first, strip.first + strip.rows), pa.int32()), none if radiance is None else radiance, none if confidence is None else confidence]
            yield pa.RecordBatch.from_arrays(columns, names=["frame", "y", "radiance", "confidence"])

    @staticmethod
    def _plane(f, begin: int, strip: Strip, wide: int) -> pa.Array:
        f.seek(begin + 4 * wide * strip.first)
        data = f.read(4 * wide * strip.rows)
        if len(data) < 4 * wide * strip.rows:
            raise ValueError(f"the file of frame {strip.frame} ends early")
        return pa.ListArray.from_arrays(pa.array(np.arange(0, wide * strip.rows + 1, wide), pa.int32()) if wide else pa.array([0] * (strip.rows + 1), pa.int32()), pa.array(np.frombuffer(data, "<f4")))


class MergedFrames(DataSource):
    """format("merged_frames"), options path; to read: planes (radiance, confidence); to write: width, height, channels, confidence (0 or 1), frames."""

    @classmethod
    def name(cls) -> str:
        return "merged_frames"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options)


class Spool:
    """The frames of one run; with a with statement they are removed at its end, however it ends."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, _local(folder)
        spark.dataSource.register(MergedFrames)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def put(self, rows: DataFrame, width: int, height: int, channels: int, confidence: bool, frames: int = 1) -> None:
        """rows: frame, y, radiance, confidence; frames that are parked already are replaced."""
        out = rows.selectExpr("cast(frame as int) frame", "cast(y as int) y", "cast(radiance as array<float>) radiance", "cast(confidence as array<float>) confidence").write.format("merged_frames").mode("append")
        out.option("path", self.folder).option("width", width).option("height", height).option("channels", channels).option("confidence", int(confidence)).option("frames", frames).save()

    def read(self, *planes: str) -> DataFrame:
        return self.spark.read.format("merged_frames").option("path", self.folder).option("planes", ",".join(planes or ("radiance", "confidence"))).load()

    def bytes_on_disk(self) -> int:
        return sum(os.path.getsize(os.path.join(self.folder, n)) for n in os.listdir(self.folder) if n.endswith(".bin"))

    def close(self) -> None:
        for name in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if re.fullmatch(r"merged-\d+\.bin(\.\w+\.part)?", name):
                os.remove(os.path.join(self.folder, name))
        if os.path.isdir(self.folder) and not os.listdir(self.folder):
            os.rmdir(self.folder)

    def __enter__(self) -> Spool:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
