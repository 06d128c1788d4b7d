"""What cameras offer, and the stream configurations to try on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hardware levels from the least capable up, capture tiers from the best down.
LEVELS = ("LEGACY", "EXTERNAL", "LIMITED", "FULL", "LEVEL_3")
TIERS = ("LINEAR_RAW", "MANUAL_YUV", "LOCKED_AUTO")
PREVIEW_WIDTH, PREVIEW_MOST, RECORD_PIXELS = 1280, 1920, 1920 * 1080
SAME_SHAPE = 0.02


def _pixels() -> Column:
    return F.col("w") * F.col("h")


def stream_plans(devices: DataFrame, raw_sizes: DataFrame, yuv_sizes: DataFrame, raw_most: int = 2) -> DataFrame:
    """devices: device, level, raw, manual; sizes: device, w, h, each once -> the plans of each device and their place.

    Raw sizes come first, the `raw_most` largest, where a device has raw frames and a sensor it can drive; then the
    largest YUV size, a record-sized one, the preview's and the smallest, with a metering stream of their own from level
    FULL up, and without. Each plan has the preview of its own shape nearest the usual width. Within a tier more
    streams come first, then more pixels. A device without YUV sizes has no plan; sizes of a device are tens of rows.
    """
    area = _pixels()
    usable = yuv_sizes.withColumn("n_", F.count_if(F.col("w") <= PREVIEW_MOST).over(Window.partitionBy("device")))
    least = F.row_number().over(Window.partitionBy("device").orderBy(area, "w"))
    usable = usable.withColumn("k_", least).where((F.col("w") <= PREVIEW_MOST) | ((F.col("n_") == 0) & (F.col("k_") == 1))).drop("n_", "k_")
    near = F.struct(F.abs(F.col("w") - PREVIEW_WIDTH), -area, "w")
    size = F.struct("w", "h")
    picked = lambda df, of: df.groupBy("device").agg(of.alias("s")).select("device", "s.w", "s.h")
    wanted = [
        picked(yuv_sizes, F.max_by(size, F.struct(area, -F.col("w")))),
        picked(yuv_sizes.where(area <= RECORD_PIXELS), F.max_by(size, F.struct(area, -F.col("w")))),
        picked(usable, F.min_by(size, near)),
        picked(yuv_sizes, F.min_by(size, F.struct(area, "w"))),
    ]
    yuv = wanted[0].unionByName(wanted[1]).unionByName(wanted[2]).unionByName(wanted[3]).distinct().withColumn("format", F.lit("YUV"))
    largest = F.row_number().over(Window.partitionBy("device").orderBy(area.desc(), "w"))
    drivable = devices.where(F.col("raw") & F.col("manual") & (F.col("level") != LEVELS[0]))
    raw = raw_sizes.join(drivable.select("device"), "device", "left_semi").withColumn("n_", largest).where(F.col("n_") <= raw_most).drop("n_").withColumn("format", F.lit("RAW"))
    captures = raw.unionByName(yuv)
    preview = usable.select("device", F.col("w").alias("pw"), F.col("h").alias("ph"))
    off = F.when(F.abs(F.col("pw") / F.col("ph") - F.col("w") / F.col("h")) < SAME_SHAPE, 0).otherwise(1)
    rank = F.struct(off, F.abs(F.col("pw") - PREVIEW_WIDTH), -F.col("pw") * F.col("ph"), "pw")
    matched = captures.join(preview, "device").groupBy("device", "format", "w", "h").agg(F.min_by(F.struct("pw", "ph"), rank).alias("p")).select("device", "format", "w", "h", "p.pw", "p.ph")
    known = matched.join(devices, "device")
    three = (F.col("format") == "YUV") & F.col("level").isin(*LEVELS[3:])
    metered = F.explode(F.when(three, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    tier = F.when(F.col("format") == "RAW", 0).when(F.col("manual") & (F.col("level") != LEVELS[0]), 1).otherwise(2)
    plans = known.select("device", "format", "w", "h", "pw", "ph", metered.alias("metering"), tier.alias("t_"))
    order = Window.partitionBy("device").orderBy("t_", F.col("metering").desc(), area.desc(), "w")
    named = F.get(F.array(*[F.lit(t) for t in TIERS]), F.col("t_"))
    return plans.withColumn("place", F.row_number().over(order)).withColumn("tier", named).drop("t_")
