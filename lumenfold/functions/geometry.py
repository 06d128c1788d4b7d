"""Vectors, rotations, cameras and the equirectangular sphere as column expressions.

A vector is a struct of x, y, z; a matrix an array of nine doubles by rows; a quaternion a struct of w, x, y, z.
+x is the viewer's left: a longitude's x is -sin(longitude).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Lens


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a lambda variable that holds the value, so that it is worked out once however often it is named."""
    return F.transform(F.array(value), body).getItem(0)


def vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def scale(a: Column, s: Column) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def normalised(a: Column) -> Column:
    """Of length 1; a zero vector refuses."""
    unit = lambda v, n: F.when(n > 0, scale(v, F.lit(1.0) / n)).otherwise(F.raise_error(F.lit("a zero vector has no direction")))
    return bind(a, lambda v: bind(norm(v), lambda n: unit(v, n)))


def angle(a: Column, b: Column) -> Column:
    """Radians between two vectors, exact near 0 and pi."""
    return F.atan2(bind(cross(a, b), norm), dot(a, b))


def from_angles(yaw_deg: Column, pitch_deg: Column) -> Column:
    lon, lat = F.radians(yaw_deg), F.radians(pitch_deg)
    return vec(-F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat))


def longitude(u: Column, width: int) -> Column:
    return (u + 0.5) / width * (2 * math.pi) - math.pi


def latitude(v: Column, height: int) -> Column:
    return F.lit(math.pi / 2) - (v + 0.5) / height * math.pi


def direction(u: Column, v: Column, width: int, height: int) -> Column:
    if width != 2 * height:
        raise ValueError(f"an equirectangular canvas is 2:1, not {width}x{height}")
    lon, lat = longitude(u, width), latitude(v, height)
    return vec(-F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat))


def pixel(d: Column, width: int, height: int) -> Column:
    """struct<u, v> of a unit direction."""
    lon = F.atan2(-d["x"], d["z"])
    lat = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d["y"])))
    return F.struct(((lon + math.pi) / (2 * math.pi) * width - 0.5).alias("u"), ((F.lit(math.pi / 2) - lat) / math.pi * height - 0.5).alias("v"))


def row_solid_angle(y: Column, width: int, height: int) -> Column:
    edge = lambda k: F.sin(F.lit(math.pi / 2) - k / height * math.pi)
    return (edge(y) - edge(y + 1)) * (2 * math.pi / width)


def wrapped(du: Column, width: int) -> Column:
    """A longitude difference in pixels, brought to half a turn at most."""
    d = du % F.lit(float(width))
    return F.when(d > width / 2, d - width).when(d < -width / 2, d + width).otherwise(d)


def _series(r2: Column, a: Column | float, b: float, c: float) -> Column:
    """1 + a r^2 + b r^4 + c r^6."""
    return 1.0 + a * r2 + b * r2 * r2 + c * r2 * r2 * r2


def stretch(r2: Column, k: Lens, k1: Column | None = None) -> Column:
    """How far distortion moves a point outwards, as a factor of its undistorted radius."""
    return _series(r2, k.k1 if k1 is None else k1, k.k2, k.k3)


def stretch_slope(r2: Column, k: Lens, k1: Column | None = None) -> Column:
    """Derivative of the distorted radius by the undistorted one."""
    return _series(r2, 3 * (k.k1 if k1 is None else k1), 5 * k.k2, 7 * k.k3)


def project(d: Column, k: Lens = Lens()) -> Column:
    """struct<u, v>, or null behind the camera or past the fold of the distortion."""

    def at(p: Column, r2: Column) -> Column:
        f = stretch(r2, k)
        seen = p["z"] > 1e-12
        if (k.k1, k.k2, k.k3) != (0.0, 0.0, 0.0):
            seen = seen & (stretch_slope(r2, k) > 0)
        return F.when(seen, F.struct((k.cx + k.fx * p["x"] * f).alias("u"), (k.cy + k.fy * p["y"] * f).alias("v")))

    plane = bind(d, lambda v: vec(F.try_divide(v["x"], v["z"]), F.try_divide(v["y"], v["z"]), v["z"]))
    return bind(plane, lambda p: bind(p["x"] * p["x"] + p["y"] * p["y"], lambda r2: at(p, r2)))


def visible(d: Column, k: Lens = Lens()) -> Column:
    inside = lambda p: p["u"].between(-0.5 - 1e-9, k.width - 0.5 + 1e-9) & p["v"].between(-0.5 - 1e-9, k.height - 0.5 + 1e-9)
    return F.coalesce(bind(project(d, k), inside), F.lit(False))


def unproject(u: Column, v: Column, k: Lens = Lens(), steps: int = 20, k1: Column | None = None) -> Column:
    """Unit direction of a pixel; the undistorted radius by Newton steps where there is distortion. k1 may be a column."""
    x, y = (u - k.cx) / k.fx, (v - k.cy) / k.fy
    rd = F.hypot(x, y)
    if k1 is None and (k.k1, k.k2, k.k3) == (0.0, 0.0, 0.0):
        return normalised(vec(x, y, F.lit(1.0)))

    def newton(r: Column, _: Column) -> Column:
        slope = stretch_slope(r * r, k, k1)
        return F.when(F.abs(slope) < 1e-12, r).otherwise(r - (r * stretch(r * r, k, k1) - rd) / slope)

    ru = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), rd, newton)
    s = F.when(rd < 1e-15, 1.0).otherwise(ru / rd)
    return normalised(vec(x * s, y * s, F.lit(1.0)))


def fov_deg(pixels: float, focal: float) -> float:
    return math.degrees(2 * math.atan(pixels / 2 / focal))


def scaled(k: Lens, s: float) -> Lens:
    """The same camera at another size; centres of pixels stay centres."""
    at = lambda c: (c + 0.5) * s - 0.5
    size = lambda n: max(1, math.floor(n * s + 0.5))
    return Lens(size(k.width), size(k.height), k.fx * s, k.fy * s, at(k.cx), at(k.cy), k.k1, k.k2, k.k3)


# --- rotations -------------------------------------------------------------------------------------------

def rotate(m: Column, a: Column, transposed: bool = False) -> Column:
    """Matrix (or its transpose) times vector."""
    def turned(k: Column) -> Column:
        e = lambda i, j: k["m"][3 * j + i] if transposed else k["m"][3 * i + j]
        row = lambda v, i: e(i, 0) * v["x"] + e(i, 1) * v["y"] + e(i, 2) * v["z"]
        return vec(*[row(k["a"], i) for i in range(3)])

    return bind(F.struct(m.alias("m"), a.alias("a")), turned)  # a matrix that is an expression would be worked out for each entry


def multiply(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def transpose(m: Column) -> Column:
    return F.array(*[m[3 * j + i] for i in range(3) for j in range(3)])


def trace(m: Column) -> Column:
    return m[0] + m[4] + m[8]


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def rotation_angle(m: Column) -> Column:
    """Radians that a rotation matrix turns by, from both its trace and its skew part."""
    return bind(m, lambda k: F.atan2(norm(vec(k[7] - k[5], k[2] - k[6], k[3] - k[1])), trace(k) - 1.0))


def exp_so3(w: Column) -> Column:
    """The rotation matrix of a rotation vector."""

    def of(v: Column, t: Column) -> Column:
        small = t < 1e-8
        a = F.when(small, F.lit(1.0) - t * t / 6).otherwise(F.try_divide(F.sin(t), t))
        b = F.when(small, F.lit(0.5) - t * t / 24).otherwise(F.try_divide(F.lit(1.0) - F.cos(t), t * t))
        return bind(F.struct(a.alias("a"), b.alias("b")), lambda k: filled(v["x"], v["y"], v["z"], k["a"], k["b"]))

    def filled(x: Column, y: Column, z: Column, a: Column, b: Column) -> Column:
        one = F.lit(1.0)
        return F.array(
            one - b * (y * y + z * z), b * x * y - a * z, b * x * z + a * y,
            b * x * y + a * z, one - b * (x * x + z * z), b * y * z - a * x,
            b * x * z - a * y, b * y * z + a * x, one - b * (x * x + y * y),
        )

    return bind(w, lambda v: bind(norm(v), lambda t: of(v, t)))


def log_so3(m: Column) -> Column:
    """The rotation vector of a matrix that turns by less than pi."""
    factor = lambda t: F.when(F.abs(t) < 1e-8, 0.5).otherwise(F.try_divide(t, F.sin(t) * 2))
    skew = lambda k: vec(k[7] - k[5], k[2] - k[6], k[3] - k[1])
    return bind(m, lambda k: bind(bind(rotation_angle(k), factor), lambda s: scale(skew(k), s)))


def quaternion(x: Column, y: Column, z: Column, w: Column | None = None) -> Column:
    """From a rotation vector's three or four values; a missing w follows from the norm."""
    real = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - x * x - y * y - z * z))
    return F.struct((real if w is None else F.coalesce(w, real)).alias("w"), x.alias("x"), y.alias("y"), z.alias("z"))


def quaternion_product(p: Column, q: Column) -> Column:
    return F.struct(
        (p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"]).alias("w"),
        (p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"]).alias("x"),
        (p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"]).alias("y"),
        (p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"]).alias("z"),
    )


def slerp(p: Column, q: Column, t: Column) -> Column:
    """Along the shorter arc; almost equal ends go straight. The result has length 1."""

    def shares(d: Column) -> Column:
        near, th = F.abs(d) > 0.9995, F.acos(F.least(F.lit(1.0), F.abs(d)))
        a = F.when(near, F.lit(1.0) - t).otherwise(F.try_divide(F.sin((F.lit(1.0) - t) * th), F.sin(th)))
        b = F.when(near, t).otherwise(F.try_divide(F.sin(t * th), F.sin(th)))
        return F.struct(a.alias("a"), F.when(d < 0, -b).otherwise(b).alias("b"))

    def unit(v: Column) -> Column:
        n = F.sqrt(v["w"] * v["w"] + v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
        return bind(n, lambda m: F.struct(*[(v[k] / m).alias(k) for k in "wxyz"]))

    def between(e: Column) -> Column:
        u, v = e["p"], e["q"]
        d = u["w"] * v["w"] + u["x"] * v["x"] + u["y"] * v["y"] + u["z"] * v["z"]
        return bind(bind(d, shares), lambda s: bind(F.struct(*[(s["a"] * u[k] + s["b"] * v[k]).alias(k) for k in "wxyz"]), unit))

    return bind(F.struct(p.alias("p"), q.alias("q")), between)


def matrix_of(q: Column) -> Column:
    one = F.lit(1.0)

    def of(w: Column, x: Column, y: Column, z: Column) -> Column:
        return F.array(
            one - (y * y + z * z) * 2, (x * y - w * z) * 2, (x * z + w * y) * 2,
            (x * y + w * z) * 2, one - (x * x + z * z) * 2, (y * z - w * x) * 2,
            (x * z - w * y) * 2, (y * z + w * x) * 2, one - (x * x + y * y) * 2,
        )

    return bind(q, lambda k: of(k["w"], k["x"], k["y"], k["z"]))


def guidance(camera: Column) -> Column:
    """struct<yaw, pitch> in degrees towards a target given in camera coordinates."""
    yaw = lambda c: F.degrees(F.atan2(c["x"], c["z"]))
    pitch = lambda c: -F.degrees(F.atan2(c["y"], F.hypot(c["x"], c["z"])))
    return bind(camera, lambda c: F.struct(yaw(c).alias("yaw"), pitch(c).alias("pitch")))


def looking_at(yaw_deg: Column, pitch_deg: Column) -> Column:
    """Camera-to-world matrix: columns right, down, forward; near the poles, +z stands for up."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def of(f: Column) -> Column:
        up = F.when(F.abs(f["y"]) > 0.999, vec(zero, zero, one)).otherwise(vec(zero, one, zero))
        down = bind(up, lambda u: bind(dot(u, f), lambda k: normalised(vec(f["x"] * k - u["x"], f["y"] * k - u["y"], f["z"] * k - u["z"]))))
        return bind(down, lambda d: bind(cross(d, f), lambda r: F.array(*[v[a] for a in "xyz" for v in (r, d, f)])))

    return bind(from_angles(yaw_deg, pitch_deg), of)


def still(x: Column, y: Column, z: Column, threshold: float) -> Column:
    return F.coalesce(F.sqrt(x * x + y * y + z * z) < threshold, F.lit(False))


def aim_error(pose: Column, target: Column) -> Column:
    """Radians between the forward axes of two poses."""
    forward = lambda m: vec(m[2], m[5], m[8])
    return angle(forward(pose), forward(target))


def roll_error(pose: Column, target: Column) -> Column:
    """How far a pose is rolled about the target's forward axis: the z of the rotation between them, radians."""
    return log_so3(multiply(transpose(target), pose))["z"]


def max_angle(k: Lens) -> float:
    """Radians from the axis to the farthest corner of a frame, by Newton steps where there is distortion."""
    most = 0.0
    for u in (-0.5, k.width - 0.5):
        for v in (-0.5, k.height - 0.5):
            seen = r = math.hypot((u - k.cx) / k.fx, (v - k.cy) / k.fy)
            for _ in range(20):
                slope = 1 + 3 * k.k1 * r**2 + 5 * k.k2 * r**4 + 7 * k.k3 * r**6
                if abs(slope) > 1e-12:
                    r -= (r * (1 + k.k1 * r**2 + k.k2 * r**4 + k.k3 * r**6) - seen) / slope
            most = max(most, math.atan(r))
    return most


def scaled_columns(k: Lens, s: Column) -> Column:
    """struct<width, height, fx, fy, cx, cy> of a camera at another size; centres of pixels stay centres."""
    size = lambda n: F.greatest(F.lit(1), F.floor(s * n + 0.5)).cast("int")
    centre = lambda x: s * (x + 0.5) - 0.5
    return F.struct(size(k.width).alias("width"), size(k.height).alias("height"), (s * k.fx).alias("fx"), (s * k.fy).alias("fy"), centre(k.cx).alias("cx"), centre(k.cy).alias("cy"))


def sensor_intrinsics(active_width: Column, active_height: Column, sensor_width_mm: float, sensor_height_mm: float, focal_mm: float, width: Column, height: Column) -> Column:
    """struct<width, height, fx, fy, cx, cy> of an output that is a trimmed view of the active array, not a stretched one."""
    own, active = width / height, active_width / active_height
    used_width = F.when(own < active, active_height * own).otherwise(active_width)
    used_height = F.when(own > active, active_width / own).otherwise(active_height)
    focal = lambda pixels, mm, used, whole: pixels * focal_mm / (used / whole * mm)
    return F.struct(
        width.alias("width"), height.alias("height"),
        focal(width, sensor_width_mm, used_width, active_width).alias("fx"), focal(height, sensor_height_mm, used_height, active_height).alias("fy"),
        ((width - 1) / 2).alias("cx"), ((height - 1) / 2).alias("cy"),
    )


def subsampled(k: Column, factor: Column) -> Column:
    """The same camera where one pixel stands for factor x factor: the centre moves before it is scaled."""
    centre = lambda x: (x - (factor - 1) / 2) / factor
    return F.struct(F.floor(k["width"] / factor).alias("width"), F.floor(k["height"] / factor).alias("height"), (k["fx"] / factor).alias("fx"), (k["fy"] / factor).alias("fy"), centre(k["cx"]).alias("cx"), centre(k["cy"]).alias("cy"))
