"""Corners and binary descriptors of whole rasters, as Arrow kernels: a frame is one row and one task's work."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.lcg import JavaRandom
from .raster import gaussian_taps

#: The ring of 16 pixels around a corner, the descriptor's bits, patch and seed.
RING = ((0, -3), (1, -3), (2, -2), (3, -1), (3, 0), (3, 1), (2, 2), (1, 3), (0, 3), (-1, 3), (-2, 2), (-3, 1), (-3, 0), (-3, -1), (-2, -2), (-1, -3))
ARC, BITS, PATCH, SEED = 9, 256, 15, 0xB21EF


def corners(gray: np.ndarray, threshold: float = 0.05, border: int = 24, most: int = 800) -> np.ndarray:
    """Rows of (x, y, score), strongest first, raster order among equals.

    A corner has 9 neighbours in a row on the ring all brighter or all darker; its score is by how much the ring
    differs; it must not be exceeded by a neighbour.
    """
    g = gray.astype(float)
    h, w = g.shape
    b = max(3, border)
    if h <= 2 * b or w <= 2 * b:
        return np.empty((0, 3))
    mid = g[b : h - b, b : w - b]
    ring = np.stack([g[b + dy : h - b + dy, b + dx : w - b + dx] for dx, dy in RING])
    found = np.zeros(mid.shape, dtype=bool)
    for side in (ring > mid + threshold, ring < mid - threshold):
        enough = side[::4].sum(axis=0) >= 2
        twice = np.concatenate([side, side[: ARC - 1]])
        arc = np.zeros(mid.shape, dtype=bool)
        for k in range(16):
            arc |= twice[k : k + ARC].all(axis=0)
        found |= arc & enough
    score = np.zeros((h, w), dtype=np.float32)
    score[b : h - b, b : w - b] = np.where(found, np.maximum(0, np.abs(ring - mid) - threshold).sum(axis=0), 0)
    best = score > 0
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if dy or dx:
                other = np.roll(score, (-dy, -dx), axis=(0, 1))
                earlier = dy < 0 or (dy == 0 and dx < 0)
                best &= (score > other) if earlier else (score >= other)
    y, x = np.nonzero(best)
    order = np.argsort(-score[y, x], kind="stable")[:most]
    return np.column_stack([x, y, score[y, x]])[order].astype(float)


def blurred(gray: np.ndarray, sigma: float) -> np.ndarray:
    taps = np.array(gaussian_taps(sigma))
    r = len(taps) // 2
    out = gray.astype(float)
    for axis in (1, 0):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        wide = np.pad(out, pad, mode="edge")
        out = sum(t * np.take(wide, np.arange(k, k + out.shape[axis]), axis=axis) for k, t in enumerate(taps))
    return out


def bilinear(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Values between pixels; outside, the edge's."""
    h, w = img.shape
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    i, j = np.minimum(x.astype(int), max(0, w - 2)), np.minimum(y.astype(int), max(0, h - 2))
    fx, fy = x - i, y - j
    i1, j1 = np.minimum(i + 1, w - 1), np.minimum(j + 1, h - 1)
    return (img[j, i] * (1 - fx) + img[j, i1] * fx) * (1 - fy) + (img[j1, i] * (1 - fx) + img[j1, i1] * fx) * fy


@cache
def pattern() -> np.ndarray:
    """Point pairs (ax, ay, bx, by) of each bit, drawn once from the fixed seed."""
    rng = JavaRandom(SEED)
    drawn = np.array([[rng.next_gaussian() for _ in range(4)] for _ in range(BITS)]) * (PATCH / 2.6)
    return np.clip(drawn, -PATCH, PATCH).astype(np.float32).astype(float)


def describe(gray: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle, four packed words of bits) of each corner, turned with the patch's centre of brightness."""
    smooth = blurred(gray, 2.0)
    dy, dx = np.mgrid[-PATCH : PATCH + 1, -PATCH : PATCH + 1]
    disc = np.abs(dx) <= np.floor(np.sqrt(PATCH * PATCH - dy * dy))
    dx, dy = dx[disc], dy[disc]
    v = bilinear(smooth, at[:, :1] + dx, at[:, 1:2] + dy)
    angle = np.arctan2((v * dy).sum(axis=1), (v * dx).sum(axis=1))
    c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]
    p = pattern()
    spot = lambda a, b: bilinear(smooth, at[:, :1] + a * c - b * s, at[:, 1:2] + a * s + b * c)
    bits = spot(p[:, 0], p[:, 1]) < spot(p[:, 2], p[:, 3])
    words = (bits.reshape(len(at), 4, 64) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    return angle, words.view(np.int64)


def detection_image(radiance: np.ndarray, width: int = 640) -> np.ndarray:
    """Log luminance, halved until it fits, stretched between its 2nd and 98th percentile."""
    lum = radiance @ np.array([0.2126, 0.7152, 0.0722]) if radiance.ndim == 3 and radiance.shape[2] >= 3 else radiance.reshape(radiance.shape[:2])
    while lum.shape[1] > width:
        h, w = lum.shape[0] // 2 * 2, lum.shape[1] // 2 * 2
        lum = lum[:h, :w].reshape(h // 2, 2, w // 2, 2).mean(axis=(1, 3))
    log = np.log(np.maximum(lum, 1e-8))
    low, high = np.percentile(log, [2, 98])
    return np.clip((log - low) / max(high - low, 1e-3), 0, 1)


CORNERS = "frame_id long, y int, x int, score double"


def frame_corners(frames: DataFrame, threshold: float, border: int = 24, most: int = 800) -> DataFrame:
    """frames: frame_id, width, height, data, one channel -> the corners of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                at = corners(np.asarray(r.data, float).reshape(r.height, r.width), threshold, border, most)
                yield pd.DataFrame({"frame_id": r.frame_id, "y": at[:, 1].astype(int), "x": at[:, 0].astype(int), "score": at[:, 2]})

    return frames.select("frame_id", "width", "height", "data").mapInPandas(run, CORNERS)


FEATURES = "frame_id long, kp_id int, x float, y float, score float, angle float, desc array<bigint>"


def features(frames: DataFrame, threshold: float = 0.02, most: int = 500) -> DataFrame:
    """frames: frame_id, width, height, channels, data -> features of each. The threshold halves, down to a
    tenth, until a frame has 150 corners."""
    return frames.select("frame_id", "width", "height", "channels", "data").mapInPandas(_features(threshold, most), FEATURES)


def _features(threshold: float, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                gray = detection_image(np.asarray(r.data, float).reshape(r.height, r.width, r.channels))
                t = threshold
                at = corners(gray, t, most=most)
                while len(at) < 150 and t > threshold / 10:
                    t /= 2
                    at = corners(gray, t, most=most)
                angle, words = describe(gray, at) if len(at) else (np.empty(0), np.empty((0, 4), np.int64))
                yield pd.DataFrame({"frame_id": r.frame_id, "kp_id": np.arange(len(at)), "x": at[:, 0], "y": at[:, 1], "score": at[:, 2], "angle": angle, "desc": [w.tolist() for w in words]})

    return run


# --- poses as a whole -----------------------------------------------------------------------------------

def horizon(rotations: list[np.ndarray], floor: float = 0.05) -> tuple[np.ndarray, float, float]:
    """(up, confidence, RMS tilt in degrees): up is what the frames' horizontal axes have least in common with."""
    axes = np.array([r[:, 0] for r in rotations])
    own = -np.array([r[:, 1] for r in rotations]).sum(axis=0)
    _, s, vt = np.linalg.svd(axes.T @ axes)
    confidence = max(0.0, float((s[1] - s[2]) / s[0])) if s[0] > 0 else 0.0
    if confidence < floor:
        up = own / np.linalg.norm(own) if own @ own > 1e-12 else np.array([0.0, 1.0, 0.0])
    else:
        up = vt[2] if vt[2] @ own >= 0 else -vt[2]
    tilt = np.arcsin(np.clip(axes @ up, -1, 1))
    return up, confidence, math.degrees(float(np.sqrt((tilt**2).mean())))


def consensus(solved: list[np.ndarray], reference: list[np.ndarray], placed: list[bool]) -> np.ndarray | None:
    """The one rotation that best takes solved poses to reference poses; null if none is placed."""
    use = [b @ a.T for a, b, p in zip(solved, reference, placed, strict=False) if p]
    if not use:
        return None
    u, _, vt = np.linalg.svd(sum(use))
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt
