"""The frame store as a table, its retention, and the report of a finished sphere."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.radiometry import display, to_byte
from ..operators.matching import latest
from .codecs import png  # noqa: F401  previews are written by the store's callers


def create(session: DataFrame, path: str) -> None:
    """A new session's header, its first version; an existing one refuses."""
    if version(session.sparkSession, path) is not None:
        raise FileExistsError(f"a session exists at {path}")
    session.write.mode("errorifexists").json(f"{path}/session/version=0")
    _point(session.sparkSession, path, 0)


def revise(session: DataFrame, path: str) -> int:
    """The header after a change of plan, as the next version; the number of it.

    A version is written aside and becomes the session's by one rename, which a reader sees before or after, never in
    part. Of two revisions of one version the second finds its folder taken and fails.
    """
    now = version(session.sparkSession, path)
    if now is None:
        raise FileNotFoundError(f"{path} holds no session")
    session.write.mode("errorifexists").json(f"{path}/session/version={now + 1}")
    _point(session.sparkSession, path, now + 1)
    return now + 1


def version(spark: SparkSession, path: str) -> int | None:
    """The session's version, or null without one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/session/_current")
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        return None
    source = store.open(where)
    try:
        return int(bytes(source.readAllBytes()).decode())
    finally:
        source.close()


def header(spark: SparkSession, path: str, schema: str, at: int | None = None) -> DataFrame:
    """The header of a version, the present one if none is given; later revisions don't change what this reads."""
    now = version(spark, path) if at is None else at
    if now is None:
        raise FileNotFoundError(f"{path} holds no session")
    return spark.read.schema(schema).json(f"{path}/session/version={now}")


def _point(spark: SparkSession, path: str, number: int) -> None:
    """The pointer's new content is written beside it and takes its place by one rename of the file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/session/_current")
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}/session/_current.{uuid.uuid4().hex}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf)
    out = target.getFileSystem(conf).create(aside, False)
    out.write(f"{number}\n".encode())
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, target, overwrite)


def store_batch(path: str, free_bytes: Callable[[], int] = lambda: 0):
    """A foreachBatch sink: frames (target, bracket, ...) of a batch, under its number, so a repeat replaces itself.

    Frames have `bytes` where their size is known; a batch that doesn't fit what `free_bytes` says is refused whole,
    and the stream stops before it: 0 is unknown, which is no obstacle.
    """

    def write(batch: DataFrame, number: int) -> None:
        """Rows keep their place in the batch, so that of two records of one key the later counts."""
        free = free_bytes()
        if free and "bytes" in batch.columns:
            wanted = F.coalesce(F.sum("bytes"), F.lit(0))
            if not batch.agg(has_room(F.lit(free), wanted)).first()[0]:
                raise OSError(f"batch {number} doesn't fit {free} free bytes")
        placed = batch if "pos" in batch.columns else batch.withColumn("pos", F.monotonically_increasing_id())
        placed.write.mode("overwrite").parquet(f"{path}/frames/batch={number}")

    return write


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What the store holds: the last record of each target and bracket, by batch and place in its batch."""
    frames = spark.read.parquet(f"{path}/frames")
    return last_stored(frames, ["target", "bracket"], ["batch", "pos"])


def last_stored(frames: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key."""
    return latest(frames, keys, order)


def has_room(free_bytes: Column, wanted_bytes: Column) -> Column:
    """Whether a frame fits; unknown free space, 0, is no obstacle."""
    return (free_bytes == 0) | (free_bytes >= wanted_bytes)


def to_delete(captures: DataFrame, now_ms: int, keep_ms: int) -> DataFrame:
    """Folders without a sphere that are older than `keep_ms`, unless they hold a whole direction."""
    return captures.where(~F.col("has_sphere") & (F.col("whole_directions") == 0) & (F.col("captured_ms") < now_ms - keep_ms))


def raw_to_delete(captures: DataFrame) -> DataFrame:
    return captures.where(F.col("has_sphere") & (F.col("raw_bytes") > 0))


def subsample(pixels: Column, limit: Column) -> Column:
    """The least power of two by which both sides must shrink for a frame to have at most `limit` pixels."""
    step = F.ceil(F.log2(F.greatest(F.lit(1.0), pixels / limit)) / 2 - 1e-12)
    return F.pow(F.lit(2.0), step).cast("int")


def reports(statistics: DataFrame, poses: DataFrame, keys: list[str]) -> DataFrame:
    """keys and report: one JSON document of each sphere, its statistics and its poses by frame, tens of frames each."""
    of = [c for c in poses.columns if c not in ("frame", *keys)]
    placed = poses.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("frame", *of))).alias("poses"))
    own = [c for c in statistics.columns if c not in keys]
    document = F.to_json(F.struct(F.lit(2).alias("version"), *own, F.coalesce("poses", F.array()).alias("poses")))
    return statistics.join(placed, keys, "left").select(*keys, document.alias("report"))


def bytes_of(listing: DataFrame, folder: Column) -> DataFrame:
    """listing: path, length -> folder, files, bytes."""
    return listing.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def running_statistics(values: DataFrame, keys: list[str], strip: str, value: str) -> DataFrame:
    """keys, strip, top, mean, pixels after each strip; strips are summed up first."""
    sums = values.groupBy(*keys, strip).agg(F.max(value).alias("top_"), F.sum(value).alias("sum_"), F.count(value).alias("n_"))
    w = Window.partitionBy(*keys).orderBy(strip)
    return sums.select(*keys, strip, F.max("top_").over(w).alias("top"), (F.sum("sum_").over(w) / F.sum("n_").over(w)).alias("mean"), F.sum("n_").over(w).alias("pixels"))


def preview_bytes(cells: DataFrame, keys: list[str], key: Column) -> DataFrame:
    """cells: keys, y, x, v, coverage -> shown and covered, bytes of the preview and of the coverage map."""
    most = cells.groupBy(*keys).agg(F.max("coverage").alias("most_"))
    met = cells.join(most, keys)
    return met.select(*keys, "y", "x", to_byte(display(F.col("v"), key)).alias("shown"), to_byte(F.try_divide(F.col("coverage"), F.col("most_"))).alias("covered"))


def report(statistics: DataFrame, poses: DataFrame) -> DataFrame:
    """One JSON document of a sphere: its statistics, one row, and its poses by frame; tens of frames."""
    placed = poses.agg(F.array_sort(F.collect_list(F.struct("frame", *[c for c in poses.columns if c != "frame"]))).alias("poses"))
    return statistics.join(F.broadcast(placed)).select(F.to_json(F.struct(F.lit(2).alias("version"), *statistics.columns, "poses")).alias("report"))

