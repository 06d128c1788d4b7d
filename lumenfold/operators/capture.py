"""Small operators around a capture: growing a bracket, keeping placed frames, believing matches, output sizes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import angle, bind


def grow(
    rungs: list[float], runs: dict[int, tuple[int, int]], target: int, wanted: float, realised: Callable[[float], float], ev_step: float = 3.0, most: int = 9
) -> tuple[list[float], dict[int, tuple[int, int]]] | None:
    """A ladder and its runs after one direction reaches down to an exposure; null if it can't go any darker.

    Its run takes darker rungs of the ladder first, then new ones a step apart as far as the device goes, and
    gives up bright ones beyond `most`; the numbers of all other runs follow the ladder.
    """
    ladder, (first, last), added, moved = list(rungs), runs[target], 0, False
    while ladder[first] > wanted * (1 + 1e-9):
        if first:
            first -= 1
        else:
            darker = realised(ladder[0] / 2**ev_step)
            if darker >= ladder[0] * (1 - 1e-9):
                break
            ladder.insert(0, darker)
            last, added = last + 1, added + 1
        moved = True
    if not moved:
        return None
    grown = {k: (a + added, b + added) for k, (a, b) in runs.items()}
    grown[target] = (first, min(last, first + most - 1))
    return ladder, grown


def keep_placed(frames: DataFrame, key: str = "frame", keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Placed frames of each capture, or all if none is, numbered anew. A capture has tens of frames; without keys
    the table is one capture."""
    any_placed = F.max(F.col("placed").cast("int")).over(Window.partitionBy(*keys)) == 1
    kept = frames.withColumn("any_", any_placed).where(F.col("placed") | ~F.col("any_")).drop("any_")
    return kept.withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy(key)) - 1)


def believable(matches: DataFrame, tolerance: float, predicted: str = "predicted", seen: str = "seen") -> DataFrame:
    """Matches whose bearing lies within a tolerance of what the poses predict; those without prediction stay."""
    both = F.struct(F.col(predicted).alias("p"), F.col(seen).alias("s"))  # what they are worked out from is done once, not for each time that the angle names them
    return matches.where(F.col(predicted).isNull() | (bind(both, lambda k: angle(k["p"], k["s"])) <= tolerance))


def distortion_leverage(matches: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """How much the radii of matched pixels differ where distortion acts: the mean of |ra^3 - rb^3|."""
    return matches.groupBy(*keys).agg(F.avg(F.abs(F.pow("ra", F.lit(3.0)) - F.pow("rb", F.lit(3.0)))).alias("leverage"))


def scan_ready(directions: DataFrame, share: float = 0.85, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """For each capture: how much of the sphere is metered, whether that will do, and whether only highlights are waited for."""
    metered = F.avg(F.when(F.col("metered"), 1.0).otherwise(0.0))
    clipped = F.coalesce(F.bool_or(F.col("metered") & F.col("highlights_clipped")), F.lit(False))
    return directions.groupBy(*keys).agg(metered.alias("coverage"), ((metered >= share) & ~clipped).alias("ready"), ((metered >= share) & clipped).alias("waits_for_highlights"))


def resolution_options(devices: DataFrame, widest: Column, widths: tuple[int, ...] = (8192, 4096, 2048)) -> DataFrame:
    """Each device with the output sizes that it can hold: width, height, label."""
    w = F.col("width")
    rows = devices.withColumn("width", F.explode(F.filter(F.array(*[F.lit(x) for x in widths]), lambda x: x <= widest)))
    return rows.withColumns({"height": F.floor(w / 2).cast("int"), "label": F.concat(F.floor(w / 1024).cast("string"), F.lit("K"))})


def frame_duration(exposure_ns: Column, least_ns: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), exposure_ns, least_ns)


def shot_totals(shots: DataFrame, keys: list[str]) -> DataFrame:
    """shots: keys, seconds, stored, black_level -> shots, exposure seconds, stored frames and the mean black level."""
    return shots.groupBy(*keys).agg(F.count("*").alias("shots"), F.sum("seconds").alias("seconds"), F.count_if("stored").alias("stored"), F.avg("black_level").alias("black_level"))


def degrees(pairs: DataFrame) -> DataFrame:
    """pairs: a, b -> frame, degree."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("frame"))
    return ends.groupBy("frame").agg(F.count("*").alias("degree"))


def merge_peak_bytes(pixels: Column, rungs: Column, factor: int) -> Column:
    """What merging one bracket takes: its mosaic, its colour image, the rungs held and the result, shrunk by a factor."""
    small = F.floor(pixels / (factor * factor))
    colour = F.floor(pixels / 4) * 12 if factor >= 2 else pixels * 12
    return pixels * 4 + colour + rungs * small * 12 + small * 16


def merge_subsample(pixels: Column, rungs: Column, budget: Column, most: int = 8) -> Column:
    """The least power of two, up to `most`, by which frames must shrink to merge within a budget; 1 if nothing is known."""
    fits, factor = F.lit(False), 1
    out = F.when((pixels <= 0) | (rungs <= 0) | (budget <= 0), 1)
    while factor < most:
        fits = merge_peak_bytes(pixels, rungs, factor) <= budget
        out, factor = out.when(fits, factor), factor * 2
    return out.otherwise(most)
