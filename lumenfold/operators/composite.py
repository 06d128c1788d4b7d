"""Compositing onto the sphere, and seams between frames."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Lens, Seam
from ..functions import geometry as g
from ..functions.radiometry import feather
from .bounds import small


BAND = 16  #: rows of the canvas that are pruned together


def cones(frames: DataFrame, lens: Lens) -> DataFrame:
    """frames: frame, rotation and others -> also axis, cos_limit, lat_min and lat_max of each frame's view cone."""
    reach = g.max_angle(lens) + 1e-3
    axis = g.vec(F.col("rotation")[2], F.col("rotation")[5], F.col("rotation")[8])
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("axis.y"))))
    out = frames.withColumn("axis", axis)
    return out.withColumns({"cos_limit": F.lit(math.cos(min(math.pi, reach))), "lat_min": lat - reach, "lat_max": lat + reach})


def touched_bands(coned: DataFrame, height: int, rows: int = BAND) -> DataFrame:
    """A row for each band of canvas rows that a frame's cone touches: band from 0, others kept."""
    band = F.col("band")
    top, bottom = g.latitude(band * rows, height), g.latitude(F.least(band * rows + rows, F.lit(height)) - 1, height)
    spread = coned.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(-(-height // rows) - 1))))
    return spread.where((F.col("lat_max") - F.col("lat_min") >= math.pi) | ((F.col("lat_max") >= bottom) & (F.col("lat_min") <= top)))


def contributions(pixels: DataFrame, frames: DataFrame, width: int, height: int, lens: Lens, feather_pixels: float) -> DataFrame:
    """pixels: y, x and others, which stay; frames: frame, rotation (camera to world), gain.

    Every frame that sees a pixel's centre, with where it falls there and its feather weight. Pixels meet only the
    frames whose cone touches their band of rows, then those whose cone holds them. The frames of one sphere are tens;
    thousands are joined by shuffle.
    """
    near = touched_bands(cones(frames, lens), height).select("band", "frame", "rotation", "gain", "axis", "cos_limit")
    near = small(near)
    d = g.direction(F.col("x"), F.col("y"), width, height)
    met = pixels.withColumns({"d_": d, "band": F.floor(F.col("y") / BAND).cast("int")}).join(near, "band").where(g.dot(F.col("d_"), F.col("axis")) >= F.col("cos_limit"))
    seen = met.withColumn("p_", g.project(g.rotate(F.col("rotation"), F.col("d_"), transposed=True), lens))
    inside = F.col("p_.u").between(-0.5, lens.width - 0.5) & F.col("p_.v").between(-0.5, lens.height - 0.5)
    w = feather(F.col("p_.u"), F.col("p_.v"), lens.width, lens.height, feather_pixels)
    return seen.where(inside).select(*pixels.columns, "frame", "gain", F.col("p_.u").alias("u"), F.col("p_.v").alias("v"), w.alias("w"))


def composite(samples: DataFrame, keys: list[str], value: str, weight: str, gain: str | None = None) -> DataFrame:
    """Weighted mean of each output pixel, its coverage and how many samples it has; combined before the shuffle."""
    v = F.col(value) if gain is None else F.col(value) * F.col(gain)
    use = samples.where(F.col(weight) > 0)
    s = use.groupBy(*keys).agg(F.sum(F.col(weight) * v).alias("acc_"), F.sum(weight).alias("coverage"), F.count("*").alias("contributors"))
    return s.select(*keys, (F.col("acc_") / F.col("coverage")).alias("value"), "coverage", "contributors")


def covered_fraction(pixels: DataFrame, composed: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.join(composed, keys, "left").agg(F.avg(F.when(F.coalesce(F.col("coverage"), F.lit(0.0)) > 0, 1.0).otherwise(0.0)).alias("covered"))


def share_at(points: DataFrame, shares: DataFrame, width: int, height: int) -> DataFrame:
    """points: id, u, v (0 to 1 over the canvas), label; shares: pixel, label, share of a seam grid -> id, share.

    Between four pixels; rows close around the canvas, its upper and lower edge repeat; a label that a pixel doesn't
    have has no share there.
    """
    fx, fy = F.col("u") * width - 0.5, F.col("v") * height - 0.5
    x, y = F.floor(fx), F.floor(fy)
    tap = lambda dy, dx: F.struct(
        (F.greatest(F.lit(0), F.least(F.lit(height - 1), y + dy)) * width + F.pmod(x + dx, F.lit(width))).cast("long").alias("pixel"),
        ((fx - x if dx else x + 1 - fx) * (fy - y if dy else y + 1 - fy)).alias("w"),
    )
    taps = points.select("id", "label", F.explode(F.array(*[tap(dy, dx) for dy in (0, 1) for dx in (0, 1)])).alias("t"))
    met = taps.select("id", "label", "t.pixel", "t.w").join(shares.select(F.col("pixel").cast("long").alias("pixel"), "label", "share"), ["pixel", "label"], "left")
    return met.groupBy("id").agg(F.sum(F.col("w") * F.coalesce("share", F.lit(0.0))).alias("share"))


SEAMS = "labels array<int>, energy double"


def solved_seams(samples: DataFrame, key: str, width: int, height: int, wrap: bool = True, cfg: Seam = Seam()) -> DataFrame:
    """samples: key, pixel, label, log_value, weight -> key, labels by pixel, energy: seams of each sphere.

    A seam problem is one sphere at preview size, so it is one task's; spheres are solved side by side. Very small ones are
    a row each, and a task takes the steps of a batch of them at once.
    """
    from .cut import SMALL

    kind = samples.schema[key].dataType.simpleString()
    if width * height <= SMALL:
        s = F.struct(F.col("pixel").cast("int").alias("pixel"), F.col("label").cast("int").alias("label"), F.col("log_value").cast("double").alias("log_value"), F.col("weight").cast("double").alias("weight"))
        return samples.groupBy(key).agg(F.collect_list(s).alias("s")).mapInArrow(_many_seams(key, width, height, wrap, cfg), f"{key} {kind}, {SEAMS}")
    return samples.groupBy(key).applyInPandas(_seams(key, width, height, wrap, cfg), f"{key} {kind}, {SEAMS}")


def _seam_edges(width: int, height: int, wrap: bool) -> np.ndarray:
    at = np.arange(width * height).reshape(height, width)
    across = [(at[:, :-1], at[:, 1:])] + ([(at[:, -1:], at[:, :1])] if wrap and width > 2 else [])
    return np.concatenate([np.column_stack([a.ravel(), b.ravel()]) for a, b in [*across, (at[:-1], at[1:])]])


def _many_seams(key: str, width: int, height: int, wrap: bool, cfg: Seam):
    edges = _seam_edges(width, height, wrap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .cut import label_many

        for batch in batches:
            lists = batch.column("s")
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            pixel, label, log_value, weight = (lists.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("pixel", "label", "log_value", "weight"))
            sizes = np.zeros(len(lists), np.int64)
            np.maximum.at(sizes, row, label + 1)
            for n in np.unique(sizes):  # labels of a problem are those it names
                own = np.flatnonzero(sizes == n)
                place = np.full(len(lists), -1)
                place[own] = np.arange(len(own))
                of = place[row] >= 0
                tables = np.full((2, len(own), width * height, n), np.nan)
                tables[:, place[row[of]], pixel[of], label[of]] = log_value[of], weight[of]
                labels, energies = label_many(*tables, edges, cfg)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * width * height), pa.array(labels.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(own)), each, pa.array(energies)], names=[key, "labels", "energy"])

    return run


def _seams(key: str, width: int, height: int, wrap: bool, cfg: Seam):
    edges = _seam_edges(width, height, wrap)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .cut import energy, label_seams

        n = int(pdf["label"].max()) + 1
        value, weight = np.full((width * height, n), np.nan), np.full((width * height, n), np.nan)
        value[pdf["pixel"], pdf["label"]], weight[pdf["pixel"], pdf["label"]] = pdf["log_value"], pdf["weight"]
        labels = label_seams(value, weight, edges, cfg)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "labels": [labels.tolist()], "energy": [energy(labels, value, weight, edges, cfg)]})

    return run


def candidates(samples: DataFrame, pixel: str = "pixel", cfg: Seam = Seam()) -> DataFrame:
    """The first candidates of each pixel by frame, as many as a seam problem holds; slot from 0."""
    order = Window.partitionBy(pixel).orderBy("label")
    return samples.withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < cfg.max_candidates)


def initial_labels(samples: DataFrame, pixel: str = "pixel") -> DataFrame:
    """The label of most weight, the first of equals."""
    return samples.groupBy(pixel).agg(F.max_by("label", F.struct("weight", (-F.col("label")).alias("n"))).alias("label"))


def grid_edges(pixels: DataFrame, width: int, height: int, wrap: bool = True) -> DataFrame:
    """Right and lower neighbours of pixels y * width + x; rows close around where they wrap."""
    y, x = F.floor(F.col("pixel") / width), F.col("pixel") % width
    right = F.when(x + 1 < width, F.col("pixel") + 1)
    if wrap and width > 2:
        right = right.otherwise(y * width)
    down = F.when(y + 1 < height, F.col("pixel") + width)
    return pixels.select(F.col("pixel").alias("a"), F.explode(F.array_compact(F.array(right.cast("long"), down.cast("long")))).alias("b"))


def seam_energy(labels: DataFrame, samples: DataFrame, edges: DataFrame, cfg: Seam = Seam()) -> DataFrame:
    """One row: data, seam and total cost of a labelling.

    samples: pixel, label, log_value, weight. A pixel costs what its label's weight lacks of the best there, and
    an unavailable label its penalty. An edge between labels costs how much both labels disagree at its ends.
    """
    best = samples.groupBy("pixel").agg(F.max("weight").alias("best"))
    own = labels.join(samples, ["pixel", "label"], "left").join(best, "pixel")
    data = own.agg(F.sum(F.when(F.col("weight").isNull(), cfg.unavailable).otherwise(F.col("best") - F.col("weight"))).alias("data"))
    cut = edges.join(labels.select(F.col("pixel").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("pixel").alias("b"), F.col("label").alias("lb")), "b").where("la <> lb")
    value = lambda p, l, n: samples.select(F.col("pixel").alias(p), F.col("label").alias(l), F.col("log_value").alias(n))
    for p in "ab":
        for l in ("la", "lb"):
            cut = cut.join(value(p, l, f"{p}{l}"), [p, l], "left")
    gap = lambda p: F.coalesce(F.abs(F.col(f"{p}la") - F.col(f"{p}lb")), F.lit(0.0))
    seam = cut.agg(F.coalesce(F.sum((gap("a") + gap("b") + cfg.min_cost) * cfg.smoothness), F.lit(0.0)).alias("seam"))
    return data.join(F.broadcast(seam)).select("data", "seam", (F.col("data") + F.col("seam")).alias("energy"))


def region_feather(labels: DataFrame, samples: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """labels: pixel, label -> pixel, label, share of each label around each pixel, where that label has a sample.

    Neighbours count by how near they are; rows wrap; shares of a pixel sum to 1.
    """
    offsets = [(dy, dx, 1.0 - float(np.hypot(dy, dx)) / (radius + 1)) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if np.hypot(dy, dx) <= radius]
    table = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("w")) for dy, dx, w in offsets])
    at = labels.select(F.floor(F.col("pixel") / width).alias("y"), (F.col("pixel") % width).alias("x"), "label", F.explode(table).alias("o"))
    at = at.select((F.col("y") + F.col("o.dy")).alias("y"), F.pmod(F.col("x") + F.col("o.dx"), F.lit(width)).alias("x"), "label", F.col("o.w").alias("w")).where(F.col("y").between(0, height - 1))
    near = at.groupBy((F.col("y") * width + F.col("x")).cast("long").alias("pixel"), "label").agg(F.sum("w").alias("w"))
    own = near.join(samples.select("pixel", "label").distinct(), ["pixel", "label"], "left_semi")
    return own.select("pixel", "label", (F.col("w") / F.sum("w").over(Window.partitionBy("pixel"))).alias("share"))


