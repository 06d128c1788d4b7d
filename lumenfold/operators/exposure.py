"""Merging, metering and bracket planning over sample tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as c
from ..functions import radiometry as r
from . import raster
from .bounds import gathered
from .statistics import exact_percentiles


def merge(samples: DataFrame, keys: list[str], value: str = "v", exposure: str = "rel", gain: str = "gain", cfg: c.Merge = c.Merge()) -> DataFrame:
    """Radiance of each key (pixel, channel) from its bracket.

    A first weighted mean predicts what each rung should read; the second mean weighs by the noise there. One
    shuffle: the window and the final aggregate share a partitioning. radiance, weight, saturated, noise_limited.
    """
    v, e, g = F.col(value), F.col(exposure), F.col(gain)
    whole = Window.partitionBy(*keys)
    w1 = r.sample_weight(v, e, g, cfg=cfg)
    first = F.coalesce(F.try_divide(F.sum(w1 * v / e).over(whole), F.sum(w1).over(whole)), F.lit(0.0))
    seen = samples.withColumn("e1_", first)
    w2 = r.sample_weight(v, e, g, noise_at=r.clamp(F.col("e1_") * e, 0.0, 1.0), cfg=cfg)
    snr = F.coalesce(F.try_divide(v, F.sqrt(r.noise_variance(v, g, cfg))), F.lit(0.0))
    out = seen.withColumns({"w2_": w2, "snr_": snr}).groupBy(*keys).agg(
        F.sum(F.col("w2_") * v / e).alias("acc_"),
        F.sum("w2_").alias("weight"),
        F.max("e1_").alias("e1_"),
        F.min_by(v, e).alias("dark_"),
        F.min(e).alias("rel_"),
        F.max("snr_").alias("snr_"),
    )
    saturated = F.col("dark_") >= cfg.sat_high
    radiance = F.when(saturated, F.lit(cfg.sat_high) / F.col("rel_")).otherwise(F.coalesce(F.try_divide(F.col("acc_"), F.col("weight")), F.col("e1_")))
    return out.select(*keys, radiance.alias("radiance"), "weight", saturated.alias("saturated"), (F.col("snr_") < cfg.min_snr).alias("noise_limited"))


def flags(merged: DataFrame, pixel: list[str]) -> DataFrame:
    """Channels folded to pixels: flag bits or-ed, weight averaged."""
    bits = F.when(F.col("saturated"), c.FLAG_SATURATED).otherwise(0) + F.when(F.col("noise_limited"), c.FLAG_NOISE_LIMITED).otherwise(0)
    return merged.groupBy(*pixel).agg(F.bit_or(bits).alias("flags"), F.avg("weight").alias("weight"))


def meter(values: DataFrame, keys: list[str], value: str, exposure: Column, m: c.Meter = c.Meter()) -> DataFrame:
    """Scene statistics of each key from one frame's values. Percentiles are exact, interpolated."""
    v = F.col(value)
    share = lambda hit: F.avg(F.when(hit, 1.0).otherwise(0.0))
    s = exact_percentiles(values, keys, value, [m.low_percentile, 0.5, m.high_percentile], clipped_fraction=share(v >= m.saturation), black_fraction=share(v <= m.noise_floor))
    high, low, med = F.col("p")[2], F.col("p")[0], F.col("p")[1]
    clipped = (F.col("clipped_fraction") > m.clip_tolerance) & (high >= m.saturation)
    crushed = F.col("black_fraction") > m.black_tolerance
    low_radiance = F.greatest(F.lit(1e-12), F.when(crushed, m.noise_floor).otherwise(F.greatest(low, F.lit(m.noise_floor))) / exposure)
    return s.select(
        *keys,
        low_radiance.alias("low_radiance"),
        F.greatest(low_radiance, F.when(clipped, m.saturation).otherwise(high) / exposure).alias("high_radiance"),
        (med / exposure).alias("median_radiance"),
        "clipped_fraction",
        "black_fraction",
        clipped.alias("highlights_clipped"),
        crushed.alias("shadows_crushed"),
        high.alias("high_value"),
    )


def well_exposed(m: c.Meter = c.Meter()) -> Column:
    high = F.col("high_value")
    return ~F.col("highlights_clipped") & (high.isNull() | F.isnan(high) | high.between(m.target_low, m.target_high))


def union(stats: DataFrame, *keys: str) -> DataFrame:
    """The envelope of scene statistics: widest range, geometric mean of medians, worst fractions and flags."""
    med = F.col("median_radiance")
    usable = r.positive(med) & (med < float("inf"))
    return stats.groupBy(*keys).agg(
        F.min("low_radiance").alias("low_radiance"),
        F.max("high_radiance").alias("high_radiance"),
        F.coalesce(F.exp(F.avg(F.when(usable, F.ln(med)))), F.lit(0.0)).alias("median_radiance"),
        F.max("clipped_fraction").alias("clipped_fraction"),
        F.max("black_fraction").alias("black_fraction"),
        F.bool_or("highlights_clipped").alias("highlights_clipped"),
        F.bool_or("shadows_crushed").alias("shadows_crushed"),
    )


def ladder(spark: SparkSession, low: float, high: float, d: c.Limits = c.Limits(), ev_step: float = 3.0, least: int = 2, most: int = 24) -> DataFrame:
    """Rungs (rung, seconds, iso, rel) in equal steps of log exposure within the device's reach.

    Widened towards the bright, else the dark end until there are `least`; rungs that whole ISO numbers make
    equal to the one before are dropped.
    """
    base = d.min_time * d.min_iso / d.base_iso
    reach = min(d.handheld, d.max_time) * d.max_iso / d.base_iso
    lo, hi = max(min(low, high), base), min(max(low, high), reach)
    hi = max(lo, hi)
    count = lambda: max(1, math.ceil(math.log2(hi / lo) / ev_step - 1e-9)) + 1
    while count() < least:
        brighter, darker = min(reach, hi * 2**ev_step), max(base, lo / 2**ev_step)
        if brighter > hi * (1 + 1e-12):
            hi = brighter
        elif darker < lo * (1 - 1e-12):
            lo = darker
        else:
            break
    n = min(count(), most)
    wanted = F.lit(lo) * F.pow(F.lit(hi / lo), F.col("id") / max(1, n - 1))
    rungs = spark.range(n).select("id", r.realise(wanted, d).alias("s")).select("id", "s.*", (F.col("s.seconds") * F.col("s.iso") / d.base_iso).alias("rel"))
    before = F.max("rel").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    kept = rungs.withColumn("b", before).where(F.col("b").isNull() | (F.col("rel") > F.col("b") * (1 + 1e-9)))
    return kept.select((F.row_number().over(Window.orderBy("id")) - 1).alias("rung"), "seconds", "iso", "rel")


def ladders(scenes: DataFrame, keys: list[str], d: c.Limits = c.Limits(), ev_step: float = 3.0, most: int = 24) -> DataFrame:
    """scenes: keys, low, high -> keys, rung, seconds, iso, rel: the ladder of each scene, as `ladder` has it for two rungs at least."""
    base, reach = d.min_time * d.min_iso / d.base_iso, min(d.handheld, d.max_time) * d.max_iso / d.base_iso
    lo = F.greatest(F.least("low", "high"), F.lit(base))
    hi = F.greatest(lo, F.least(F.greatest("low", "high"), F.lit(reach)))
    count = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.log2(F.col("hi_") / F.col("lo_")) / ev_step - 1e-9)) + 1).cast("int")
    spread = scenes.select(*keys, lo.alias("lo_"), hi.alias("hi_")).withColumn("n_", count).withColumn("i_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    wanted = F.col("lo_") * F.pow(F.col("hi_") / F.col("lo_"), F.col("i_") / F.greatest(F.lit(1), F.col("n_") - 1))
    rungs = spread.select(*keys, "i_", r.realise(wanted, d).alias("s")).select(*keys, "i_", "s.*", (F.col("s.seconds") * F.col("s.iso") / d.base_iso).alias("rel"))
    before = F.max("rel").over(Window.partitionBy(*keys).orderBy("i_").rowsBetween(Window.unboundedPreceding, -1))
    kept = rungs.withColumn("b_", before).where(F.col("b_").isNull() | (F.col("rel") > F.col("b_") * (1 + 1e-9)))
    return kept.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("i_")) - 1).alias("rung"), "seconds", "iso", "rel")


def runs(scenes: DataFrame, rungs: DataFrame, b: c.Bracket = c.Bracket()) -> DataFrame:
    """For each scene (low_radiance, high_radiance): the run of ladder rungs that spans it, first to last.

    The ladder has at most max_rungs rows and is broadcast.
    """
    dark = F.lit(b.saturation_target) / F.col("high_radiance")
    bright = F.lit(b.shadow_target) / F.col("low_radiance")
    size = F.col("size_")
    steps = gathered(rungs, F.struct("rung", "rel"), "steps_").select(F.array_sort("steps_").alias("steps_"), F.size("steps_").alias("size_"))
    s = scenes.join(F.broadcast(steps))
    fit = F.filter("steps_", lambda x: x["rel"] <= dark * (1 + 1e-9))
    start = F.coalesce(F.array_max(F.transform(fit, lambda x: x["rung"])), F.lit(0))
    reach = F.filter("steps_", lambda x: x["rel"] >= bright * (1 - 1e-9))
    end = F.greatest(F.coalesce(F.array_min(F.transform(reach, lambda x: x["rung"])), size - 1), start)
    s = s.withColumns({"start_": start, "end_": end})
    short = F.greatest(F.lit(0), F.lit(b.min_per_target) - (F.col("end_") - F.col("start_") + 1))
    up = F.least(short, size - 1 - F.col("end_"))
    s = s.withColumns({"up_": up, "down_": F.least(short - up, F.col("start_"))})
    first = F.col("start_") - F.col("down_")
    last = F.least(F.col("end_") + F.col("up_"), first + b.max_per_target - 1)
    return s.select(*scenes.columns, first.alias("first_rung"), last.alias("last_rung"))


def nearest_rung(wanted: DataFrame, rungs: DataFrame, key: str, rel: str) -> DataFrame:
    """The rung nearest in log exposure, the darker one of equals; the ladder is broadcast, a few rows."""
    steps = gathered(rungs, F.struct("rung", "rel"), "steps_")
    best = F.array_min(F.transform("steps_", lambda s: F.struct(F.round(F.abs(F.ln(s["rel"] / F.col(rel))), 12).alias("d"), s["rung"].alias("rung"))))
    return wanted.join(F.broadcast(steps)).select(key, rel, best["rung"].alias("rung"))


def read_brackets(frames: DataFrame, pixels: Column, plan: DataFrame, width: int, height: int, reductions: int = 0) -> DataFrame:
    """frames: target, rung and what `pixels` names, an array of y, x, v: mosaics, each in one row or several;
    plan: target, rung -> place, y, x, r, g, b of complete brackets.

    A direction without one of its rungs is left out; places number a bracket's rungs from 0. Mosaics are taken at
    half resolution, then halved `reductions` times. Frames meet their plan by target, in one shuffle; only those it
    wants are spread to pixels.
    """
    rungs = plan.groupBy("target").agg(F.sort_array(F.collect_set("rung")).alias("rungs_"))
    there = frames.withColumn("there_", F.collect_set("rung").over(Window.partitionBy("target")))
    whole = (F.size(F.array_except("rungs_", "there_")) == 0) & F.array_contains("rungs_", F.col("rung"))
    wanted = there.join(rungs, "target").where(whole).withColumn("place", (F.array_position("rungs_", F.col("rung")) - 1).cast("int"))
    rgb = raster.half_resolution(wanted.select("target", "rung", "place", F.inline(pixels)), ["target", "rung", "place"])
    for _ in range(reductions):
        width, height = width // 2, height // 2
        cell = rgb.where((F.col("x") < width // 2 * 2) & (F.col("y") < height // 2 * 2))
        rgb = cell.groupBy("target", "rung", "place", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(*[F.avg(c).alias(c) for c in "rgb"])
    return rgb


def extended(scenes: DataFrame, ladder: Column, darkest: float, ev_step: float, most: int) -> DataFrame:
    """scenes: wanted, first, last and others; ladder: exposures, rising -> also added, new_first and new_last.

    A run that must reach a darker exposure takes darker rungs of the ladder first, then new ones `ev_step` below it
    as far as the device goes, and gives up bright ones beyond `most`; numbers follow the longer ladder.
    """
    start = F.struct(F.col("first").alias("first"), F.lit(0).alias("added"), F.get(ladder, F.col("first")).alias("at"), F.get(ladder, F.lit(0)).alias("bottom"))

    def step(s: Column, _: Column) -> Column:
        reach = s["at"] > F.col("wanted") * (1 + 1e-9)
        darker = F.greatest(F.lit(darkest), s["bottom"] / 2**ev_step)
        inside, grows = s["first"] > 0, darker < s["bottom"] * (1 - 1e-9)
        down = F.struct((s["first"] - 1).alias("first"), s["added"].alias("added"), F.get(ladder, s["first"] - 1).alias("at"), s["bottom"].alias("bottom"))
        new = F.struct(s["first"].alias("first"), (s["added"] + 1).alias("added"), darker.alias("at"), darker.alias("bottom"))
        return F.when(reach & inside, down).when(reach & grows, new).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(c.Bracket().max_rungs * 2)), start, step)
    out = scenes.withColumn("e_", end)
    last = F.least(F.col("last") + F.col("e_.added"), F.col("e_.first") + most - 1)
    return out.select(*scenes.columns, F.col("e_.added").alias("added"), F.col("e_.first").alias("new_first"), last.alias("new_last"))
