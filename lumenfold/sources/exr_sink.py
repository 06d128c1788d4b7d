"""An EXR file written by tasks: each puts its scanlines where they belong, and the commit adds the table of offsets.

Lines are encoded first, so that their sizes say where each begins; a task writes at these places of an unfinished file
beside the target, and one that is repeated writes the same bytes again. The commit counts lines, writes header and
table and renames; an abort removes the file. The driver sees a line's number and place, never its pixels.
The target lies on a file system that driver and executors mount.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import codecs
from .files import exr_lines


@dataclass
class Written(WriterCommitMessage):
    """Where a task's lines begin: int32 line numbers and int64 places."""

    lines: bytes
    places: bytes
    size: int


class ExrWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = re.sub(r"^file:/+", "/", options["path"])
        self.width, self.height, self.compression = int(options["width"]), int(options["height"]), int(options.get("compression", codecs.EXR_ZIPS))
        if os.path.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.begin = len(codecs.exr_header(self.width, self.height, self.compression)) + 8 * self.height

    def write(self, rows: Iterator) -> Written:
        lines, places, size, out = [], [], 0, None
        try:
            for y, before, line in rows:
                if out is None:
                    out = os.open(self.part, os.O_CREAT | os.O_WRONLY, 0o644)
                at, data = self.begin + before, memoryview(line)
                lines.append(y)
                places.append(at)
                size += len(data)
                while data:
                    done = os.pwrite(out, data, at)
                    at, data = at + done, data[done:]
        finally:
            if out is not None:
                os.fsync(out)
                os.close(out)
        return Written(np.array(lines, "<i4").tobytes(), np.array(places, "<i8").tobytes(), size)

    def commit(self, messages: list[Written | None]) -> None:
        told = [m for m in messages if m is not None]
        lines, places = np.concatenate([np.frombuffer(m.lines, "<i4") for m in told] or [[]]), np.concatenate([np.frombuffer(m.places, "<i8") for m in told] or [[]])
        if len(lines) != self.height or not np.array_equal(np.sort(lines), np.arange(self.height)):
            self.abort(messages)
            raise ValueError(f"{len(lines)} lines for {self.height} rows")
        table = np.empty(self.height, "<i8")
        table[lines.astype(int)] = places
        with open(self.part, "r+b") as out:
            out.write(codecs.exr_header(self.width, self.height, self.compression) + table.tobytes())
            out.flush()
            os.fsync(out.fileno())
            if out.seek(0, os.SEEK_END) != self.begin + sum(m.size for m in told):
                raise ValueError("lines overlap or leave gaps")
        os.replace(self.part, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.part):
            os.remove(self.part)


class ExrSink(DataSource):
    """df.write.format("exr"), options path, width, height and compression; rows y, before, line as `placed_lines` has them."""

    @classmethod
    def name(cls) -> str:
        return "exr"

    def schema(self) -> str:
        return "y int, before long, line binary"

    def writer(self, schema: StructType, overwrite: bool) -> ExrWriter:
        if schema.names != ["y", "before", "line"]:
            raise ValueError("rows must be y, before, line")
        return ExrWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExrSink)


def placed_lines(lines: DataFrame) -> DataFrame:
    """y, line -> y, before, line: the bytes of all lines above. Sizes alone are summed in order, a number a row of the image."""
    sizes = lines.select("y", F.length("line").cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.select("y", before.alias("before")), "y").select(F.col("y").cast("int").alias("y"), F.col("before").cast("long").alias("before"), "line")


def write_exr(pixels: DataFrame, width: int, height: int, path: str, compression: int = codecs.EXR_ZIPS, overwrite: bool = True) -> None:
    """pixels: y, x, r, g, b of a whole image -> one EXR file. Encoded lines are settled, as their sizes are needed before they are written."""
    from ..operators.graph import settle

    spark = pixels.sparkSession
    register(spark)
    lines = settle(exr_lines(pixels, width, compression), "lines")
    out = placed_lines(lines).write.format("exr").mode("overwrite" if overwrite else "append")
    out.option("width", width).option("height", height).option("compression", compression).option("path", path).save()
