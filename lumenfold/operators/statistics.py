"""Raster statistics: exact order statistics, log keys, histograms."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radiometry import log2, positive


ACCURACY, WIDEN = 1000, 0.004  #: of the sketch that brackets a rank; how far a bracket reaches to both sides, as a share of all values
FEW = 1000  #: values of a key that need no bracket
HELD = 1 << 20  #: values of a whole table's bracket that are put in order by one task


def order_statistics(values: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], list[Column]], shares: list[float], **sums: Column) -> DataFrame:
    """keys, n, at: for each key the values at these ranks, from 0, of its sorted values; a rank lies near one of these shares.

    One pass sketches all keys (rank error below 1/ACCURACY, partial before the shuffle) and brackets each share; a
    second counts what lies below, between and above the brackets, and distinct values within. Values are sorted
    only there: WIDEN to both sides. A rank outside its bracket would be an error. Null and NaN don't count. `sums` are
    aggregates of all of a key's values that the first pass brings along, for tables with keys.
    """
    v = F.col(value).cast("double")
    if not keys:
        return _whole_statistics(values.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("o_v")), ranks, shares)
    by = [f"o_{k}" for k in range(len(keys))]
    valued = F.when(v.isNotNull() & ~F.isnan(v), v)
    named = values.withColumns({n: F.col(k) for k, n in zip(keys, by, strict=True)})
    near = named.groupBy(*by).agg(F.percentile_approx(valued, _around(shares), ACCURACY).alias("o_q"), F.count(valued).alias("o_n"), *[x.alias(n) for n, x in sums.items()])
    near = near.where("o_n > 0")
    use = named.where(valued.isNotNull()).select(*by, v.alias("o_v"))
    few = F.col("o_n") <= FEW
    brackets = [(F.when(few, float("-inf")).otherwise(F.col("o_q")[2 * k]), F.when(few, float("inf")).otherwise(F.col("o_q")[2 * k + 1])) for k in range(len(shares))]
    counts = _bucketed(_same(use, near, by), [*by, "o_n", *sums], brackets)
    upto = F.sum("o_c").over(Window.partitionBy(*by).orderBy("o_top"))
    out = _at_ranks(counts.withColumn("o_upto", upto).groupBy(*by, "o_n", *sums), ranks(F.col("o_n")), F.lit(0))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, by, strict=True)], F.col("o_n").alias("n"), "at", *sums)


def _around(shares: list[float]) -> list[float]:
    return [x for s in shares for x in (max(0.0, s - WIDEN), min(1.0, s + WIDEN))]


def _bucketed(values: DataFrame, by: list[str], brackets: list[tuple[Column, Column]]) -> DataFrame:
    """Counts of each distinct value within a bracket, and of all values between two of them; o_top puts them in order."""
    v = F.col("o_v")
    within = functools.reduce(lambda a, b: a | b, [(v >= low) & (v <= high) for low, high in brackets])
    gap = sum(((v > high).cast("int") for _, high in brackets), F.lit(0))
    return values.groupBy(*by, gap.alias("o_gap"), F.when(within, v).alias("o_in")).agg(F.count("*").alias("o_c"), F.max("o_v").alias("o_top"))


def _at_ranks(grouped, ranks: list[Column], before: Column) -> DataFrame:
    """n's map of values by rank, of counts in order with their running sums."""
    found = []
    for k, rank in enumerate(ranks):
        inside = rank.cast("long") - before
        hit = (inside >= F.col("o_upto") - F.col("o_c")) & (inside < F.col("o_upto"))
        found.append(F.max(F.when(hit, F.struct(rank.cast("long").alias("rank"), "o_in"))).alias(f"o_f{k}"))
    out = grouped.agg(*found)
    known = F.array_distinct(F.array(*[F.col(f"o_f{k}") for k in range(len(ranks))]))
    sound = F.when(F.forall(known, lambda f: f["o_in"].isNotNull()), known).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")))
    return out.withColumn("at", F.map_from_entries(sound))


def _whole_statistics(values: DataFrame, ranks: Callable[[Column], list[Column]], shares: list[float]) -> DataFrame:
    """n, at of a whole table. A share whose bracket holds more than a task should sort is bracketed again within it."""
    spark = values.sparkSession
    quantiles = F.percentile_approx("o_v", _around(shares), ACCURACY)
    first = values.agg(quantiles.alias("q"), F.count("*").alias("n")).first()
    n = first["n"]
    if not n:
        return values.select(F.lit(0).cast("long").alias("n"), F.lit(None).cast("map<bigint,double>").alias("at")).limit(0)
    whole = n <= FEW
    brackets = [(-math.inf, math.inf) if whole else (first["q"][2 * k], first["q"][2 * k + 1]) for k in range(len(shares))]
    for k, s in enumerate(shares):
        while 5 * WIDEN * n > HELD:  # else its bracket holds less for certain
            low, high = brackets[k]
            v = F.col("o_v")
            seen = values.agg(F.count_if(v < low), F.count_if(v.between(low, high))).first()
            if seen[1] <= HELD or low == high:
                break
            local = min(1.0, max(0.0, (s * n - seen[0]) / seen[1]))
            a, b = values.where(v.between(low, high)).agg(F.percentile_approx("o_v", _around([local]), ACCURACY)).first()[0]
            if (a, b) == (low, high):
                break
            brackets[k] = (a, b)
    counts = _bucketed(values, [], [(F.lit(low), F.lit(high)) for low, high in brackets])
    upto = F.sum("o_c").over(Window.orderBy("o_top"))
    return _at_ranks(counts.withColumn("o_upto", upto).groupBy(), ranks(F.lit(n)), F.lit(0)).select(F.lit(n).cast("long").alias("n"), "at")


def _same(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """An inner join on keys that may be null; the columns of both, keys once."""
    other = right.select(*[F.col(k).alias(f"{k}_r") if k in by else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in by]
    return left.join(other, on).drop(*[f"{k}_r" for k in by])


def exact_percentiles(values: DataFrame, keys: list[str], value: str, shares: list[float], **sums: Column) -> DataFrame:
    """keys, p and sums: exact percentiles, interpolated linearly at share * (n - 1)."""
    ends = lambda n: [f(F.lit(s) * (n - 1)) for s in shares for f in (F.floor, F.ceil)]
    got = order_statistics(values, keys, value, ends, shares, **sums)

    def between(s: float) -> Column:
        at = F.lit(s) * (F.col("n") - 1)
        low, high = (F.element_at("at", f(at).cast("long")) for f in (F.floor, F.ceil))
        return low + (high - low) * (at - F.floor(at))

    return got.select(*keys, F.array(*[between(s) for s in shares]).alias("p"), *sums)


def upper_median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The element n div 2 of each key's sorted values, from 0, without interpolation."""
    got = order_statistics(values, keys, value, lambda n: [F.floor(n / 2)], [0.5])
    return got.select(*keys, F.element_at("at", F.floor(F.col("n") / 2).cast("long")).alias("median"))


def log_key(values: DataFrame, keys: list[str], value: str, grey: float = 0.18) -> DataFrame:
    """Grey over the geometric mean of positive values; 1 where there is none."""
    v = F.col(value)
    mean = F.exp(F.avg(F.when(positive(v), F.ln(v + 1e-9))))
    return values.groupBy(*keys).agg(F.coalesce(F.lit(grey) / mean, F.lit(1.0)).alias("key"))


BINS, LOW, HIGH = 512, -24.0, 24.0


def bin_of(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((log2(v) - LOW) / (HIGH - LOW) * BINS))).cast("int")


def histogram(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Positive finite values by log2 bin."""
    v = F.col(value)
    return values.where(positive(v) & (v < float("inf"))).groupBy(*keys, bin_of(v).alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(bins: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The middle of the first bin at which the running count reaches a share of all."""
    order = Window.partitionBy(*keys).orderBy("bin")
    at = bins.withColumns({"upto": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(*keys))})
    middle = F.pow(F.lit(2.0), (F.min("bin") + 0.5) * ((HIGH - LOW) / BINS) + LOW)
    return at.where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*keys).agg(middle.alias("value"))


def output_statistics(values: DataFrame, keys: list[str], value: str, limit: float = 65504.0) -> DataFrame:
    v = F.col(value)
    good = positive(v) & (v < float("inf"))
    return values.groupBy(*keys).agg(
        F.min(F.when(good, v)).alias("min_value"),
        F.max(F.when(good, v)).alias("max_value"),
        F.avg(F.when(good, v)).alias("mean_value"),
        F.avg(F.when(good, 1.0).otherwise(0.0)).alias("covered"),
        F.count(F.when(v > limit, 1)).alias("clamped"),
    )
