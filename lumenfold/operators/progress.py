"""Progress, cost and capture-state operators over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Work
from ..functions.radiometry import half_up, positive


def stage_offsets(stages: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """stages: keys, seq, stage, weight -> begin and width of each stage in 0..1; weights not positive have none. Each key
    is a job of its own; its stages are few."""
    w = F.greatest(F.lit(0.0), F.col("weight"))
    order, whole = Window.partitionBy(*keys).orderBy("seq"), Window.partitionBy(*keys)
    total = F.sum(w).over(whole)
    width = F.when(total > 0, w / total).otherwise(0.0)
    s = stages.withColumn("width", width)
    return s.select(*keys, "seq", "stage", (F.sum("width").over(order) - F.col("width")).alias("begin"), "width")


def overall_progress(reports: DataFrame, stages: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """reports: key, order, stage, fraction -> overall, which never falls; unknown stages change nothing.

    `stages` are the few rows of stage_offsets, broadcast.
    """
    met = reports.join(F.broadcast(stages.select("stage", "begin", "width")), "stage", "left")
    at = F.col("begin") + F.col("width") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fraction")))
    high = F.coalesce(F.max(at).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))
    return met.select(*key, *order, "stage", high.alias("overall"))


def corrected(factor: Column, predicted: Column, actual: Column, w: Work = Work()) -> Column:
    """The work factor after one job: a bounded step in log space towards what was observed."""
    use = positive(predicted) & positive(actual) & (predicted >= w.least_seconds) & (actual >= w.least_seconds) & (predicted < float("inf")) & (actual < float("inf"))
    seen = F.greatest(factor / w.max_step, F.least(factor * w.max_step, F.try_divide(actual, predicted)))
    blended = F.exp(F.ln(factor) * (1 - w.weight) + F.ln(seen) * w.weight)
    return F.when(use, F.greatest(F.lit(w.least_factor), F.least(F.lit(w.most_factor), blended))).otherwise(factor)


def work_factor(jobs: DataFrame, keys: list[str], order: str, predicted: str, actual: str) -> DataFrame:
    """The factor learnt from each key's jobs in order; jobs of a key are one row's array, some hundreds."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(predicted).cast("double").alias("p"), F.col(actual).cast("double").alias("a"))))
    return jobs.groupBy(*keys).agg(seq.alias("jobs")).select(*keys, F.aggregate("jobs", F.lit(1.0), lambda f, j: corrected(f, j["p"], j["a"])).alias("factor"))


def time_remaining(estimate: Column, elapsed: Column, fraction: Column) -> Column:
    """Seconds left: the estimate, then what the pace says, which is trusted fully from a third on."""
    usable = lambda c: F.when(positive(c) & (c < float("inf")), c).otherwise(0.0)
    el, es = usable(elapsed), usable(estimate)
    done = F.greatest(F.lit(0.0), F.least(F.lit(1.0), usable(fraction)))
    pace = F.when((done > 0) & (el > 0), F.try_divide(el, done)).otherwise(0.0)
    trust = F.least(F.lit(1.0), done * 3.0)
    total = F.when(pace <= 0, es).when(es <= 0, pace).otherwise(es * (F.lit(1.0) - trust) + pace * trust)
    return F.when(done >= 1.0, 0.0).otherwise(F.greatest(F.lit(0.0), total - el))


def work_estimate(directions: Column, rungs: Column, frame_pixels: Column, width: Column, merge_ns: float, align_ns: float, render_ns: float, decode_ns: float = 0.0, w: Work = Work()) -> Column:
    """struct of seconds: merge with reading and decoding, align, render, write, and their sum."""
    frames, out = directions * rungs, width * F.floor(width / 2)
    merge = frames * frame_pixels * 2 / w.read_bytes + frames * frame_pixels * (decode_ns / 1e9) + frames * frame_pixels * (merge_ns / 1e9)
    align = directions * (w.feature_pixels + w.match_pixels) * (align_ns / 1e9)
    render = out * directions * (render_ns / 1e9)
    write = out * 6 / w.write_bytes
    return F.struct(merge.alias("merge"), align.alias("align"), render.alias("render"), write.alias("write"), (merge + align + render + write).alias("seconds"))


def tenths(x: Column) -> Column:
    """Whole tenths nearest to what a positive double holds exactly, of two equally near the even one, as C prints it.

    format_string rounds the shortest decimal instead, so 1.45, which is held a little below, becomes 1.5. Twenty times the
    value against an odd number decides; sixteen and four times are exact, and so is what their sum leaves out.
    """
    total = x * 16.0 + x * 4.0
    left_out = x * 4.0 - (total - x * 16.0)
    low = F.floor(total / 2)
    over = (total - (low * 2 + 1)) + left_out
    return low + F.when((over > 0) | ((over == 0) & (low % 2 == 1)), 1).otherwise(0)


def duration_text(seconds: Column) -> Column:
    s, hours = half_up(seconds), seconds / 3600.0
    n = tenths(hours)
    return (
        F.when(s < 45, F.format_string("about %d seconds", s))
        .when(s < 90, F.lit("about a minute"))
        .when(s < 3600, F.format_string("about %d minutes", half_up(seconds / 60.0)))
        .when(hours < 2.0**45, F.format_string("about %d.%d hours", F.floor(n / 10), n % 10))
        .otherwise(F.format_string("about %.1f hours", hours))
    )


def capture_stage(has_session: Column, has_done: Column, targets: Column, shot: Column) -> Column:
    """Where a capture stands, from its session, its result and how many of its targets are shot."""
    return F.when(~has_session, "NOTHING_SHOT").when(has_done, "PROCESSED").when((targets == 0) | (shot == 0), "NOTHING_SHOT").when(shot < targets, "PARTLY_SHOT").otherwise("SHOT_NOT_PROCESSED")


def dwell_islands(events: DataFrame, key: str, time: str, holds: Column, least: Column) -> DataFrame:
    """Runs of consecutive events for which a condition holds, from first to last, and whether they lasted `least`."""
    order = Window.partitionBy(key).orderBy(time)
    at = events.withColumn("h_", F.coalesce(holds, F.lit(False))).withColumn("run_", F.sum(F.when(F.col("h_"), 0).otherwise(1)).over(order))
    runs = at.where("h_").groupBy(key, "run_").agg(F.min(time).alias("began"), F.max(time).alias("ended"), F.count("*").alias("events"))
    return runs.select(key, "began", "ended", "events", (F.col("ended") - F.col("began") >= least).alias("dwelt"))
