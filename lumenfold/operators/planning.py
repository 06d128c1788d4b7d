"""Capture plans: rings of targets around the sphere, in the order in which they are shot."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Lens
from ..functions.geometry import fov_deg


def capture_plans(devices: DataFrame, keys: list[str], hfov: Column, vfov: Column, overlap: float = 0.35) -> DataFrame:
    """devices: keys and fields of view in degrees -> keys, target, yaw, pitch: the plan of each device, as `capture_plan` has it."""
    keep = max(0.05, 1 - overlap)
    top = F.greatest(F.lit(0.0), 90 - vfov / 2)
    steps = F.when(top < 1e-9, 0).otherwise(F.greatest(F.lit(1), F.ceil(2 * top / (vfov * keep) - 1e-9))).cast("int")
    d = devices.select(*keys, (hfov * keep).alias("h_"), top.alias("top_"), steps.alias("steps_"))
    rings = d.withColumn("ring_", F.explode(F.sequence(F.lit(0), F.col("steps_")))).withColumn("pitch", F.when(F.col("steps_") > 0, -F.col("top_") + 2 * F.col("top_") * F.col("ring_") / F.col("steps_")).otherwise(0.0))
    count = F.greatest(F.lit(1), F.ceil(360 / (F.col("h_") / F.greatest(F.lit(0.15), F.cos(F.radians("pitch")))) - 1e-9)).cast("int")
    spots = rings.withColumn("n_", count).withColumn("j_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
    seq = F.when(F.col("ring_") % 2 == 1, F.col("n_") - 1 - F.col("j_")).otherwise(F.col("j_"))
    plan = spots.select(*keys, "ring_", seq.alias("seq_"), (-180 + 360.0 * F.col("j_") / F.col("n_")).alias("yaw"), "pitch")
    ends = d.select(*keys, F.explode(F.array(*[F.struct(ring.cast("int").alias("ring_"), F.lit(0).alias("seq_"), F.lit(0.0).alias("yaw"), F.lit(p).alias("pitch")) for ring, p in ((F.lit(-1), -90.0), (F.col("steps_") + 1, 90.0))])).alias("e")).select(*keys, "e.*")
    return plan.unionByName(ends).select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("ring_", "seq_")) - 1).alias("target"), "yaw", "pitch")


def capture_plan(spark: SparkSession, lens: Lens, overlap: float = 0.35, poles: bool = True, roll_deg: float = 0.0) -> DataFrame:
    """target, yaw, pitch: rings from the lower to the upper end, every other one backwards, poles first and last."""
    fov = [fov_deg(lens.width, lens.fx), fov_deg(lens.height, lens.fy)]
    h, v = fov[::-1] if round(abs(roll_deg) / 90) % 2 else fov
    keep = max(0.05, 1 - overlap)
    top = max(0.0, 90 - v / 2)
    steps = max(1, math.ceil(2 * top / (v * keep) - 1e-9)) if top >= 1e-9 else 0
    ring = F.col("id").cast("int")
    pitch = ring * (2 * top / max(1, steps)) - top if steps else F.lit(0.0)
    count = F.greatest(F.lit(1), F.ceil(F.lit(360.0) / (F.lit(h * keep) / F.greatest(F.lit(0.15), F.cos(F.radians(pitch)))) - 1e-9)).cast("int")
    rings = spark.range(steps + 1).select(ring.alias("ring"), pitch.alias("pitch"), count.alias("count"))
    spots = rings.select("ring", "pitch", "count", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("j"))
    yaw = F.col("j") * 360.0 / F.col("count") - 180.0
    order = F.when(F.col("ring") % 2 == 1, F.col("count") - 1 - F.col("j")).otherwise(F.col("j"))
    plan = spots.select("ring", order.alias("seq"), yaw.alias("yaw"), "pitch")
    if poles:
        ends = spark.sql(f"SELECT * FROM VALUES (-1, 0, 0.0D, -90.0D), ({steps + 1}, 0, 0.0D, 90.0D) AS v(ring, seq, yaw, pitch)")
        plan = plan.unionByName(ends)
    return plan.select((F.row_number().over(Window.orderBy("ring", "seq")) - 1).alias("target"), "yaw", "pitch")
