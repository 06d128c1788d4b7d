"""Column expressions of exposure, noise, tone and photometry; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as c


def positive(x: Column) -> Column:
    """x > 0 as a guard that NaN and null fail."""
    return F.coalesce((x > 0) & ~F.isnan(x), F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def smoothstep(u: Column) -> Column:
    return u * u * (F.lit(3.0) - F.lit(2.0) * u)


def log2(x: Column) -> Column:
    return F.ln(x) / F.ln(F.lit(2.0))


def luminance(r: Column, g: Column, b: Column) -> Column:
    return c.LUMA[0] * r + c.LUMA[1] * g + c.LUMA[2] * b


def noise_variance(v: Column, gain: Column, cfg: c.Merge = c.Merge()) -> Column:
    return cfg.shot * gain * F.greatest(F.lit(0.0), v) + cfg.read * gain * gain


def rolloff(v: Column, cfg: c.Merge = c.Merge()) -> Column:
    """How far a sample is trusted near saturation: 1, falling smoothly to 0."""
    u = (v - cfg.sat_low) / (cfg.sat_high - cfg.sat_low)
    return F.when(v >= cfg.sat_high, 0.0).when(v <= cfg.sat_low, 1.0).otherwise(F.lit(1.0) - smoothstep(u))


def sample_weight(v: Column, exposure: Column, gain: Column, noise_at: Column | None = None, cfg: c.Merge = c.Merge()) -> Column:
    """Inverse variance of v / exposure, rolled off by v; 0 where it can't be trusted."""
    var = noise_variance(v if noise_at is None else noise_at, gain, cfg)
    return F.when((rolloff(v, cfg) > 0) & (var > 0), rolloff(v, cfg) * exposure * exposure / var).otherwise(0.0)


def filmic(x: Column) -> Column:
    """The usual rational fit of a film curve; 0 for what isn't positive."""
    y = (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)
    return F.when(positive(x), clamp(y, 0.0, 1.0)).otherwise(0.0)


def display(v: Column, key: Column, gamma: float = 2.2) -> Column:
    return F.pow(filmic(v * key), F.lit(1.0 / max(1e-6, gamma)))


def to_byte(x: Column) -> Column:
    return half_up(clamp(x, 0.0, 1.0) * 255.0).cast("int")


def falloff(r2: Column, a2: Column | float, a4: Column | float) -> Column:
    """Vignetting at a squared radius, 1 at the corner."""
    return F.greatest(F.lit(1e-3), 1.0 + a2 * r2 + a4 * r2 * r2)


def corner_radius2(x: Column, y: Column, width: int, height: int) -> Column:
    cx, cy = (width - 1) * 0.5, (height - 1) * 0.5
    norm = cx * cx + cy * cy
    return (F.pow(x - cx, F.lit(2.0)) + F.pow(y - cy, F.lit(2.0))) / norm if norm > 0 else F.lit(0.0)


def lut_decode(encoded: Column, lut: Sequence[float]) -> Column:
    """Linear interpolation in a response table."""
    table = F.array(*[F.lit(float(v)) for v in lut])
    t = clamp(encoded, 0.0, 1.0) * (len(lut) - 1)
    i = F.least(F.floor(t).cast("int"), F.lit(len(lut) - 2))
    low, high = F.element_at(table, i + 1), F.element_at(table, i + 2)
    return low + (high - low) * (t - i)


def invert_encoding(n: int, encode, steps: int = 60) -> list[float]:
    """A response table from a rising encoding, by bisection."""
    out = []
    for k in range(n):
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if encode(mid) < k / (n - 1) else (low, mid)
        out.append((low + high) / 2)
    return out


def colour(r: Column, g: Column, b: Column, matrix: Sequence[float]) -> list[Column]:
    """A 3x3 matrix; what turns negative is 0."""
    return [F.greatest(F.lit(0.0), matrix[3 * k] * r + matrix[3 * k + 1] * g + matrix[3 * k + 2] * b) for k in range(3)]


def balanced(matrix: Sequence[float], gains: Sequence[float]) -> list[float]:
    """The matrix after white balance by (red, green, blue) gains relative to green."""
    scale = (gains[0] / gains[1], 1.0, gains[2] / gains[1])
    return [m * scale[k % 3] for k, m in enumerate(matrix)]


def confidence(radiance_over_noise: Column, saturated: Column) -> Column:
    """Blend confidence of a pixel from its signal to noise over a reference."""
    base = F.least(F.lit(1.0), radiance_over_noise)
    return F.greatest(F.lit(1e-4), F.when(saturated, base * 0.15).otherwise(base))


def half_range(v: Column, limit: float = 65504.0) -> Column:
    """What a half float can hold: finite, NaN is 0."""
    return F.when(F.isnan(v), 0.0).otherwise(clamp(v, -limit, limit))


def feather(u: Column, v: Column, width: int, height: int, pixels: float) -> Column:
    """Smooth fall to 0 towards the nearest frame edge."""
    edge = F.least(u + 0.5, width - 0.5 - u, v + 0.5, height - 0.5 - v)
    return smoothstep(clamp(edge / pixels, 0.0, 1.0))


def luminance_scale(aperture: Column, base_iso: Column, p: c.Photometry = c.Photometry()) -> Column:
    """cd/m2 of one unit of relative radiance."""
    return aperture * aperture * p.saturation / (base_iso * p.lens)


def saturation_luminance(aperture: Column, iso: Column, seconds: Column, p: c.Photometry = c.Photometry()) -> Column:
    return aperture * aperture * p.saturation / (iso * seconds * p.lens)


def metered_luminance(aperture: Column, iso: Column, seconds: Column, p: c.Photometry = c.Photometry()) -> Column:
    return aperture * aperture * p.meter / (seconds * iso)


def headroom_stops(p: c.Photometry = c.Photometry()) -> Column:
    return log2(F.lit(p.saturation / (p.lens * p.meter)))


def ev100(aperture: Column, seconds: Column, iso: Column) -> Column:
    return log2(aperture * aperture / seconds) - log2(iso / 100.0)


def absolute(radiance: Column, cd_per_unit: Column) -> Column:
    """Radiance in cd/m2; a relative scale (not positive) refuses."""
    return F.when(cd_per_unit > 0, radiance * cd_per_unit).otherwise(F.raise_error(F.lit("a relative scale has no cd/m2")))


def realise(target: Column, d: c.Limits = c.Limits()) -> Column:
    """struct<seconds, iso> that meets a relative exposure: time at base ISO, then ISO, then time again."""
    hand = min(d.handheld, d.max_time)
    want = F.greatest(F.lit(1e-12), target)
    iso_at = lambda t: F.greatest(F.lit(d.min_iso), F.least(F.lit(d.max_iso), half_up(want * d.base_iso / t).cast("int")))
    beyond = want * (d.base_iso / hand) > d.max_iso
    seconds = F.when(want <= d.min_time, d.min_time).when(want <= hand, want).when(beyond, F.least(F.lit(d.max_time), want * d.base_iso / d.max_iso)).otherwise(hand)
    iso = F.when(want <= d.min_time, iso_at(F.lit(d.min_time))).when(want <= hand, d.base_iso).when(beyond, d.max_iso).otherwise(iso_at(F.lit(hand)))
    return F.struct(clamp(seconds, d.min_time, d.max_time).alias("seconds"), iso.cast("int").alias("iso"))


def suggest(clipped: Column, clipped_fraction: Column, high_value: Column, current: Column, m: c.Meter = c.Meter()) -> Column:
    """The next probe exposure: down when clipped, else towards the target, never quite the same."""
    down = F.when(clipped_fraction > 0.20, 8.0).when(clipped_fraction > 0.05, 4.0).otherwise(2.0)
    high = F.coalesce(F.nanvl(high_value, F.lit(0.0)), F.lit(0.0))
    factor = clamp(F.try_divide(F.lit(m.target), high), 1.0 / m.max_step, m.max_step)
    factor = F.when(F.abs(factor - 1.0) < 1e-9, F.when(factor < 1, 0.999).otherwise(1.001)).otherwise(factor)
    return F.when(clipped, current / down).when(high < 1e-9, current * m.max_step).otherwise(current * factor)


def viewing(median: Column, low: Column, high: Column, target: float = 0.18) -> Column:
    """The exposure that shows a scene's median, else its geometric middle, at the target; null if there is none."""
    anchor = F.when(median > 1e-9, median).otherwise(F.sqrt(low * high))
    return F.when(positive(anchor) & (anchor < float("inf")), F.lit(target) / anchor)


def huber_weight(residual: Column, delta: float) -> Column:
    return F.when(F.abs(residual) <= delta, 1.0).otherwise(F.lit(delta) / F.abs(residual))


def level(encoded: Column, n: int) -> Column:
    return half_up(clamp(encoded, 0.0, 1.0) * (n - 1)).cast("int")


def hat_weight(k: Column, n: int) -> Column:
    mid = (n - 1) / 2.0
    return F.when(k <= mid, k.cast("double")).otherwise(F.lit(n - 1.0) - k) / mid


def srgb_linear(byte: Column) -> Column:
    """The linear value of an 8-bit one, from the table of the sRGB curve."""
    curve = [(k / 255 / 12.92 if k / 255 <= 0.04045 else ((k / 255 + 0.055) / 1.055) ** 2.4) for k in range(256)]
    return F.element_at(F.array(*[F.lit(v) for v in curve]), (byte + 1).cast("int"))


def bisected(wanted: Column, encode: Callable[[Column], Column], steps: int = 60) -> Column:
    """Where a rising encoding of 0..1 reaches a value, by halving the interval."""
    ends = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(e: Column, _: Column) -> Column:
        mid = (e["low"] + e["high"]) / 2
        below = encode(mid) < wanted
        return F.struct(F.when(below, mid).otherwise(e["low"]).alias("low"), F.when(below, e["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, halve, lambda e: (e["low"] + e["high"]) / 2)


def balance(matrix: Column, red: Column, green: Column, blue: Column) -> Column:
    """A matrix of nine values after white balance: gains relative to green scale its first and last column."""
    scale = F.array(F.try_divide(red, green), F.lit(1.0), F.try_divide(blue, green))
    return F.transform(matrix, lambda m, i: m * F.get(scale, i % 3))


def relative_exposure(seconds: Column, iso: Column, base_iso: Column) -> Column:
    return seconds * iso / base_iso


def exposure_text(seconds: Column, iso: Column, aperture: Column) -> Column:
    """Like "1/125 s ISO 100 f/1.8"; from half a second on, seconds as they are."""
    time = F.when(seconds >= 0.5, F.format_string("%.1f s", seconds)).otherwise(F.format_string("1/%.0f s", F.try_divide(F.lit(1.0), seconds)))
    return F.concat(time, F.format_string(" ISO %d f/%.1f", iso.cast("int"), aperture))
