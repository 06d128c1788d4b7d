"""Readers and writers of capture folders as DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import codecs

RASTER = "path string, width int, height int, channels int, data array<float>"
JOURNAL = "target int, bracket int, t double, iso int, f double, w int, h int, c int, cfa string, linear boolean, ts long, file string, pose array<double>"
SESSION = (
    "format string, camera string, tier string, note string, apertureF double, focalLengthMm double, cfa string, whiteLevel int, blackLevel array<double>, baseIso int, "
    "imageWidth int, imageHeight int, fx double, fy double, cx double, cy double, k1 double, k2 double, k3 double, ladder array<struct<t:double,iso:int,f:double>>, "
    "indicesPerTarget array<array<int>>, neutralGains array<double>, colorMatrix array<double>, shadingCols int, shadingRows int, shadingGains array<double>"
)
MANIFEST = "path string, exposure double, iso int, focal double, focal35 double"
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {
    "plane": lambda b: codecs.read_plane(b)[0],
    "exr": codecs.read_exr,
    "rgbe": codecs.read_rgbe,
    "image": codecs.linear_image,
    "dng": lambda b: codecs.read_dng(b)[..., None].astype(np.float32),
}

ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {
    "plane": codecs.write_plane,
    "exr": codecs.write_exr,
    "rgbe": codecs.write_rgbe,
    "image": lambda x: codecs.png(np.clip(x, 0, 255)),
    "dng": lambda x: codecs.write_dng(x[..., 0]),
}


def _decode(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    read = DECODERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):  # a raster at a time
                x = read(bytes(content))
                yield pd.DataFrame({"path": [path], "width": [x.shape[1]], "height": [x.shape[0]], "channels": [x.shape[2]], "data": [x.ravel().astype(np.float32)]})

    return run


def rasters(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Files of one format as blocked rasters, decoded where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_decode(kind), RASTER)


def exploded(blocked: DataFrame) -> DataFrame:
    """path, y, x, c, v of blocked rasters."""
    i = F.col("pos")
    long = blocked.select("path", "width", "channels", F.posexplode("data").alias("pos", "v"))
    return long.select("path", F.floor(i / (F.col("width") * F.col("channels"))).cast("int").alias("y"), (F.floor(i / F.col("channels")) % F.col("width")).cast("int").alias("x"), (i % F.col("channels")).cast("int").alias("c"), "v")


def encoded(frames: DataFrame, kind: str) -> DataFrame:
    """frames: path, width, height, channels, data -> path, content: each raster as the bytes of one format."""
    return frames.select("path", "width", "height", "channels", "data").mapInPandas(_encode(kind), "path string, content binary")


def _encode(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    write = ENCODERS[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():  # a raster at a time
                yield pd.DataFrame({"path": [r.path], "content": [write(np.asarray(r.data, np.float32).reshape(r.height, r.width, r.channels))]})

    return run


def decoded(files: DataFrame, kind: str) -> DataFrame:
    """files: path, content -> blocked rasters, decoded where the rows are."""
    return files.select("path", "content").mapInPandas(_decode(kind), RASTER)


def session_text(sessions: DataFrame) -> DataFrame:
    """path and header columns -> path, value: each header as one JSON document."""
    return sessions.select("path", F.to_json(F.struct(*[c for c in sessions.columns if c != "path"])).alias("value"))


def parse_sessions(docs: DataFrame, format_tag: str) -> DataFrame:
    """docs: path, value -> session headers; another format tag refuses, malformed shading is null."""
    s = docs.select("path", F.from_json("value", SESSION).alias("s")).select("path", "s.*")
    whole = F.size("shadingGains") == F.col("shadingCols") * F.col("shadingRows") * 4
    checked = s.where(F.when(F.col("format") == format_tag, True).otherwise(F.raise_error(F.lit("another session format")).cast("boolean")))
    return checked.withColumn("shadingGains", F.when(whole, F.col("shadingGains")))


def session(spark: SparkSession, path: str, format_tag: str) -> DataFrame:
    """Session headers of files that hold one document each."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_sessions(docs, format_tag).drop("path")


def parse_journal(lines: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """The records that count, per journal: lines that parse, whose file has its exact length; the last of a key wins.

    lines: keys, pos, line, each a whole line; listing: keys, file, length. A pose needs nine numbers.
    """
    records = lines.select(*keys, "pos", F.from_json("line", JOURNAL + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    records = records.select(*keys, "pos", "r.*").where("_bad is null and file is not null").drop("_bad")
    records = records.withColumn("pose", F.when(F.size("pose") == 9, F.col("pose")))
    here = listing.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("file").alias("file_"), "length")
    same = [F.col(k) == F.col(f"{k}_") for k in keys]
    sound = records.join(here, [*same, F.col("file") == F.col("file_"), F.col("length") == F.col("w") * F.col("h") * F.col("c") * 2 + 20], "left_semi")
    last = Window.partitionBy(*keys, "target", "bracket").orderBy(F.col("pos").desc())
    return sound.withColumn("n_", F.row_number().over(last)).where("n_ = 1").drop("n_", "pos")


def journal(spark: SparkSession, folder: str) -> DataFrame:
    """The records of one folder. A journal is some thousands of lines; a torn last line is left out."""
    text = spark.read.text(f"{folder}/journal.jsonl", wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\n", -1)).alias("pos", "line"), F.size(F.split("value", "\n", -1)).alias("n")).where("pos < n - 1 and line <> ''")
    here = spark.read.format("binaryFile").load(f"{folder}/*.hrf").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    return parse_journal(lines, here, [])


def parse_manifests(docs: DataFrame) -> DataFrame:
    """docs: set, value -> set, entries of each JSON array, and the sensor's width in mm by the crop to a 36 mm frame."""
    e = docs.select("set", F.inline(F.from_json("value", f"array<struct<{MANIFEST.replace(' string', ':string').replace(' double', ':double').replace(' int', ':int')}>>")))
    return e.withColumn("sensor_mm", F.when(F.col("focal35") > 0, F.col("focal") / F.col("focal35") * 36.0))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def summaries(docs: DataFrame) -> DataFrame:
    """docs: folder, value, modified -> folder, captured, name, directions, coverage, stops; missing keys defaulted."""
    from ..functions.text import captured_at

    r = docs.withColumn("r", F.from_json("value", "name string, directions int, coverage double, dynamicRangeStops double"))
    return r.select(
        *[c for c in docs.columns if c not in ("value", "modified")],
        captured_at(F.col("folder"), F.col("modified")).alias("captured"),
        F.coalesce("r.name", "folder").alias("name"),
        F.coalesce("r.directions", F.lit(0)).alias("directions"),
        F.coalesce("r.coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("r.dynamicRangeStops", F.lit(0.0)).alias("stops"),
    )


def catalogue(spark: SparkSession, pattern: str) -> DataFrame:
    """Report documents of capture folders, newest first, then by folder."""
    docs = spark.read.text(pattern, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1).alias("folder"), "value", F.col("_metadata.file_modification_time").alias("modified"))
    return summaries(docs).orderBy(F.col("captured").desc(), "folder")


def dropped_by_plan(records: DataFrame, plan: DataFrame) -> DataFrame:
    """Stored frames that a new plan (target, wanted) no longer wants."""
    keep = records.join(plan, (records["target"] == plan["target"]) & (records["bracket"] < plan["wanted"]), "left_semi")
    return records.join(keep.select("target", "bracket"), ["target", "bracket"], "left_anti")


def exr_lines(pixels: DataFrame, width: int, compression: int = codecs.EXR_ZIPS) -> DataFrame:
    """pixels: y, x, r, g, b -> y, line: encoded scanlines, one task each however many rows there are."""
    lines = pixels.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("x", "r", "g", "b"))).alias("p"))
    flat = lines.select("y", F.flatten(F.transform("p", lambda p: F.array(p["r"], p["g"], p["b"]))).alias("rgb"))
    return flat.mapInPandas(_lines(width, compression), "y int, line binary")


def _lines(width: int, compression: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "line": [codecs.exr_line(int(y), np.asarray(rgb, np.float32).reshape(width, 3), compression) for y, rgb in zip(batch["y"], batch["rgb"], strict=True)]})

    return run
