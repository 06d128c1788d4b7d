"""From brackets to a sphere in one call: merge, align, balance, composite, and what the result holds."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Lens
from ..functions import geometry as g
from . import composite, exposure, matching, raster, sampling, solve, statistics
from .graph import settle


def aligned(matches: DataFrame, priors: list[np.ndarray | None], huber_deg: float = 0.5, least: int = 6) -> tuple[list[np.ndarray], list[bool], list[float]]:
    """matches: a, b, px..pz, qx..qz, bearings in both cameras -> (rotations, placed, costs of the adjustment).

    Pairs are solved by consensus, grown from the strongest, levelled onto the priors and adjusted together. What
    reaches the driver are rotations and sums per pair of frames; a sphere has tens of frames.
    """
    matches = settle(matches, "matches")  # read again in every round of the adjustment
    # A pair's rotation takes bearings of its first camera to its second; growing wants the other way.
    number = F.floor(F.col("a") * (F.lit(2 * len(priors) - 1) - F.col("a")) / 2) + F.col("b") - F.col("a") - 1
    pairs = solve.pair_rotations(matches.select("a", "b", number.cast("long").alias("pair"), *[f"{v}{x}" for v in "pq" for x in "xyz"]), ["a", "b"])
    found = pairs.where((F.col("inliers") >= least) & F.col("rotation").isNotNull()).orderBy("a", "b").collect()
    edges = [(r["a"], r["b"], r["inliers"], np.array(r["rotation"]).reshape(3, 3).T) for r in found]
    rotations, placed, _ = solve.initial_rotations(edges, priors)
    if not edges:
        return rotations, placed, []
    adjusted, costs = solve.bundle_adjust(matches.withColumn("w", F.lit(1.0)), rotations, huber_deg)
    back = rotations[0] @ adjusted[0].T
    return [back @ r for r in adjusted], placed, costs


def auto_seam_width(width: int) -> int:
    """A seam grid a quarter as wide as the output, within bounds and even."""
    return max(128, min(1024, width // 4)) // 2 * 2


def _canvas(spark: SparkSession, width: int, height: int) -> DataFrame:
    i = F.col("id")
    return spark.range(width * height).select(F.floor(i / width).cast("int").alias("y"), (i % width).cast("int").alias("x"))


def seam_shares(frames: DataFrame, pixels: DataFrame, lens: Lens, width: int, feather_pixels: float, radius: int) -> DataFrame:
    """frames: frame, rotation, gain; pixels: frame, y, x, v -> pixel, label, share on a seam grid of this width.

    Each grid pixel's candidates are the frames that see it, with their balanced radiance in logs; seams are solved over
    them, and a region's share fades over `radius` grid pixels. The grid is of preview size, so its problem fits a task.
    """
    height = width // 2
    met = composite.contributions(_canvas(pixels.sparkSession, width, height), frames, width, height, lens, feather_pixels).where("w > 0")
    valued = raster.bilinear_samples(met, pixels, ["frame"], lens.width, lens.height).where("value * gain > 0")
    samples = valued.select(F.lit(0).alias("sphere"), (F.col("y") * width + F.col("x")).cast("long").alias("pixel"), F.col("frame").alias("label"), F.ln(F.col("value") * F.col("gain")).alias("log_value"), F.col("w").alias("weight"))
    samples = settle(composite.candidates(samples).drop("slot"), "candidates")
    labels = composite.solved_seams(samples, "sphere", width, height).select(F.posexplode("labels").alias("pixel", "label")).where("label >= 0")
    return composite.region_feather(labels, samples, width, height, radius)


def seamed(met: DataFrame, shares: DataFrame, width: int, height: int, seam_width: int) -> DataFrame:
    """Contributions weighed by how much of their surroundings the seams gave them; where that is nothing to all, as before."""
    numbered = met.withColumn("id", (F.col("y") * width + F.col("x")).cast("long") * (1 << 20) + F.col("frame"))
    points = numbered.select("id", ((F.col("x") + 0.5) / width).alias("u"), ((F.col("y") + 0.5) / height).alias("v"), F.col("frame").alias("label"))
    own = composite.share_at(points, shares, seam_width, seam_width // 2)
    return numbered.join(own, "id").withColumn("w", F.col("w") * (F.col("share") + 1e-6)).drop("id", "share")


def process(
    samples: DataFrame, rotations: list[np.ndarray], lens: Lens, width: int, height: int, feather_pixels: float, grid: int = 48, seed: int = 7, rounds: int = 4, seam_width: int | None = 0, seam_radius: int = 2,
    progress: Callable[[str, float], None] = lambda stage, done: None,
) -> DataFrame:
    """samples: frame, y, x, v, rel, gain, brackets of every pixel -> y, x, value, coverage, contributors of the sphere.

    With seams (a width of their grid, or None for a quarter of the output), regions are cut along them before
    they are blended. `progress` hears of each stage, in 0..1 and never falling.

    Radiance of each pixel is merged once and written to the shared folder; frames that overlap give photometric
    pairs on a grid of positions, whose log ratios give each frame's gain; then every sphere pixel meets the frames
    that see it. Frames (tens) are known to the driver; pixels never are.
    """
    spark = samples.sparkSession
    pixels = settle(exposure.merge(samples, ["frame", "y", "x"]).select("frame", "y", "x", F.col("radiance").alias("v")), "radiance")
    table = F.array(*[F.struct(F.lit(k).alias("frame"), F.array(*[F.lit(float(v)) for v in r.ravel()]).alias("rotation")) for k, r in enumerate(rotations)])
    frames = spark.range(1).select(F.inline(table))
    axis = g.vec(F.col("rotation")[2], F.col("rotation")[5], F.col("rotation")[8])
    pairs = matching.overlap_pairs(frames.select("frame", axis.alias("direction")), len(rotations), 2 * g.max_angle(lens), 0.0)
    shared = sampling.shared_positions(pairs.select("a", "b"), sampling.grid_samples(spark, lens.width, lens.height, grid, seed), frames, lens)
    progress("merge", 0.4)
    gains = solve.gains(sampling.photometric_samples(shared, pixels), len(rotations), rounds=rounds)
    progress("balance", 0.6)
    known = frames.withColumn("gain", F.element_at(F.array(*[F.lit(v) for v in gains]), F.col("frame") + 1))
    met = composite.contributions(_canvas(spark, width, height), known, width, height, lens, feather_pixels)
    if seam_width != 0:
        grid_width = seam_width or auto_seam_width(width)
        shares = settle(seam_shares(known, pixels, lens, grid_width, feather_pixels, seam_radius), "shares")
        met = seamed(met, shares, width, height, grid_width)
    progress("seams", 0.8)
    valued = raster.bilinear_samples(met, pixels, ["frame"], lens.width, lens.height)
    out = settle(composite.composite(valued, ["y", "x"], "value", "w", "gain"), "sphere")
    progress("blend", 1.0)
    return out


def summary(sphere: DataFrame, width: int, height: int) -> DataFrame:
    """One row: statistics of the covered pixels and how much of the canvas they are."""
    return statistics.output_statistics(sphere, [], "value").drop("covered").join(sphere.agg((F.count_if(F.col("coverage") > 0) / (width * height)).alias("covered")))
