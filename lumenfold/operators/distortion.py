"""Rotations and one radial coefficient of a lens, adjusted together, for many captures at once.

A match says where a point lies in two frames, in pixels. What it misses by is the difference of its two bearings in
the world, which moves with both rotations and, as bearings are undistorted pixels, with k1. A round is one job: sums a
pair of frames, for every capture and each way of fitting it, from which the driver builds a capture's normal
equations - three unknowns a frame, tens of frames - bordered by k1, and eliminates the border.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Distortion, Lens
from .graph import settle
from .solve import damped, exp_so3

MOST_FITS = 2000  #: captures of one call; their rotations are known to the driver
ROUNDING = 1e-12  #: radians that sums of squares leave of a perfect fit; no gain is read off less


@dataclass
class Fit:
    """One way of fitting a capture: where it stands, its equations there, and what it tries next."""

    rotations: list[np.ndarray]
    k1: float
    huber: float
    free: bool  #: whether k1 may move
    cfg: Distortion
    cost: float = math.inf
    squares: float = 0.0
    count: int = 0
    equations: tuple | None = None
    damping: float = 1e-6
    failures: int = 0
    costs: list[float] = field(default_factory=list)
    trial: tuple[list[np.ndarray], float] | None = None
    moved: float = math.inf
    done: bool = False

    @property
    def rms(self) -> float:
        return math.sqrt(self.squares / self.count) if self.count else 0.0

    def take(self, equations: tuple, cost: float, squares: float, count: int) -> None:
        """What was tried has been measured: keep it if it costs no more, else try a shorter step."""
        if cost <= self.cost:
            gained = self.cost - cost
            if self.trial is not None:
                self.rotations, self.k1 = self.trial
                self.damping, self.failures = max(1e-12, self.damping / 5), 0
            self.cost, self.squares, self.count, self.equations = cost, squares, count, equations
            self.costs.append(cost)
            self.done = self.moved < self.cfg.least_step or gained <= 1e-12 * cost or len(self.costs) > self.cfg.rounds
        else:
            self.damping *= 10
            self.failures += 1
            self.done = self.failures >= self.cfg.attempts or self.moved < self.cfg.least_step
        if not self.done:
            self._next()

    def _next(self) -> None:
        room = (-self.cfg.limit - self.k1, self.cfg.limit - self.k1) if self.free else (0.0, 0.0)
        step = bordered_step(*self.equations, self.damping, room)
        if step is None:
            self.done = True
            return
        turn, shift = step
        self.moved = max(float(np.abs(turn).max(initial=0.0)), abs(shift))
        rotations = [self.rotations[0], *[exp_so3(turn[3 * k : 3 * k + 3]) @ r for k, r in enumerate(self.rotations[1:])]]
        self.trial = (rotations, self.k1 + shift)


def bordered_step(h: np.ndarray, grad: np.ndarray, border: np.ndarray, corner: float, slope: float, damping: float, room: tuple[float, float]) -> tuple[np.ndarray, float] | None:
    """Rotations' and k1's step, k1's within its room: its equation is what is left of the corner once rotations are eliminated."""
    h = h + damping * np.eye(len(h))
    both = damped(h, np.stack([grad, border], axis=1), 1e-12)
    if both is None:
        return None
    by_grad, by_border = both[:, 0], both[:, 1]
    left = corner + damping - float(border @ by_border)
    shift = min(room[1], max(room[0], -(slope - float(border @ by_grad)) / left if left > 0 else 0.0))
    return -by_grad - by_border * shift, shift


def _bearings(u: np.ndarray, v: np.ndarray, k1: np.ndarray, lens: Lens, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions of pixels, and their derivatives by k1, the pixel held: the undistorted radius gives way by r^3 over the slope there."""
    x, y = (u - lens.cx) / lens.fx, (v - lens.cy) / lens.fy
    seen = np.hypot(x, y)
    slope = lambda r2: 1 + r2 * (3 * k1 + r2 * (5 * lens.k2 + r2 * 7 * lens.k3))
    r = seen.copy()
    for _ in range(steps):
        r2 = r * r
        at = slope(r2)
        flat = np.abs(at) < 1e-12
        r = np.where(flat, r, r - (r * (1 + r2 * (k1 + r2 * (lens.k2 + r2 * lens.k3))) - seen) / np.where(flat, 1.0, at))
    s = np.where(seen < 1e-15, 1.0, r / np.where(seen < 1e-15, 1.0, seen))
    p = np.stack([x * s, y * s, np.ones_like(x)], axis=1)
    p /= np.sqrt((p * p).sum(axis=1, keepdims=True))
    r2 = (p[:, 0] ** 2 + p[:, 1] ** 2) / p[:, 2] ** 2
    turn = -r2 / (slope(r2) * (1 + r2))
    return p, np.stack([turn * p[:, 0], turn * p[:, 1], -turn * r2 * p[:, 2]], axis=1)


TERMS = [f"{m}{i}{j}" for m in ("uu", "vv", "uv") for i in range(3) for j in range(3)] + [f"{m}{i}" for m in ("ue", "ve") for i in range(3)] + ["ee", "er"]
SUMS = ["cost", "squares", *TERMS]


def _terms(u: np.ndarray, v: np.ndarray, e: np.ndarray, w: np.ndarray, huber: np.ndarray) -> np.ndarray:
    """A row of SUMS for each match: bearings in the world, how they part by k1, weights, kernels."""
    r = v - u
    miss = np.sqrt((r * r).sum(axis=1))
    near = miss <= huber
    far = np.where(near, 1.0, miss)
    k = w * np.where(near, 1.0, huber / far)
    cost = w * np.where(near, miss * miss, huber * (2 * miss - huber))
    angle = 2 * np.arcsin(np.minimum(1.0, miss / 2))
    outer = lambda a, b: (a[:, :, None] * b[:, None, :]).reshape(-1, 9)
    dot = lambda a, b: (a * b).sum(axis=1, keepdims=True)
    terms = np.hstack([outer(u, u), outer(v, v), outer(u, v), np.cross(u, e), np.cross(v, e), dot(e, e), dot(e, r)])
    return np.column_stack([cost, angle * angle, terms * k[:, None]])


def pair_sums(matches: DataFrame, states: list[tuple], lens: Lens) -> DataFrame:
    """matches: capture, a, b, ua, va, ub, vb, w; states: capture, fit, k1, huber, rotations -> sums by capture, fit, a, b.

    Batches of matches are measured as arrays where they lie; what moves is a row for each frame pair of a batch.
    """
    names = sorted({s[1] for s in states})
    kind = matches.schema["capture"].dataType.simpleString()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = []
        for name in names:
            own = [s for s in states if s[1] == name]
            most = max(len(s[4]) for s in own)
            turns = np.zeros((len(own), most, 3, 3))
            for n, s in enumerate(own):
                turns[n, : len(s[4])] = np.reshape(s[4], (-1, 3, 3))
            tables.append((name, pd.Index([s[0] for s in own]), np.array([s[2] for s in own]), np.array([s[3] for s in own]), turns))
        for batch in batches:
            for name, captures, k1, huber, turns in tables:
                at = captures.get_indexer(batch["capture"])
                part, at = batch[at >= 0], at[at >= 0]
                if part.empty:
                    continue
                a, b = part["a"].to_numpy("int64"), part["b"].to_numpy("int64")
                world = {}
                for f, frame in (("a", a), ("b", b)):
                    p, moved = _bearings(part[f"u{f}"].to_numpy("float64"), part[f"v{f}"].to_numpy("float64"), k1[at], lens)
                    m = turns[at, frame]
                    world[f] = (np.einsum("nij,nj->ni", m, p), np.einsum("nij,nj->ni", m, moved))
                (u, du), (v, dv) = world["a"], world["b"]
                values = _terms(u, v, dv - du, part["w"].to_numpy("float64"), huber[at])
                pairs, of = np.unique(np.column_stack([at, a, b]), axis=0, return_inverse=True)
                of = of.ravel()
                order = np.argsort(of, kind="stable")
                sums = np.add.reduceat(values[order], np.searchsorted(of[order], np.arange(len(pairs))), axis=0)
                out = pd.DataFrame(sums, columns=SUMS)
                out.insert(0, "capture", captures[pairs[:, 0]])
                out.insert(1, "fit", name)
                out.insert(2, "a", pairs[:, 1])
                out.insert(3, "b", pairs[:, 2])
                out.insert(4, "n", np.bincount(of))
                yield out

    schema = f"capture {kind}, fit string, a long, b long, n long, " + ", ".join(f"{c} double" for c in SUMS)
    parts = matches.select("capture", "a", "b", "ua", "va", "ub", "vb", F.col("w").cast("double").alias("w")).mapInPandas(measured, schema)
    return parts.groupBy("capture", "fit", "a", "b").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])


def _equations(rows: list, n: int) -> tuple[tuple, float, float, int]:
    """Normal equations of one fit from its pairs' sums; the first frame is held."""
    h, grad, border, corner, slope = np.zeros((3 * n, 3 * n)), np.zeros(3 * n), np.zeros(3 * n), 0.0, 0.0
    skew = lambda m: np.trace(m) * np.eye(3) - m
    for s in rows:
        a, b = slice(3 * s["a"], 3 * s["a"] + 3), slice(3 * s["b"], 3 * s["b"] + 3)
        uu, vv, uv = (np.array([[s[f"{m}{i}{j}"] for j in range(3)] for i in range(3)]) for m in ("uu", "vv", "uv"))
        h[a, a] += skew(uu)
        h[b, b] += skew(vv)
        h[a, b] -= skew(uv.T)
        h[b, a] -= skew(uv)
        twist = np.array([uv[1, 2] - uv[2, 1], uv[2, 0] - uv[0, 2], uv[0, 1] - uv[1, 0]])
        grad[a] -= twist
        grad[b] += twist
        border[a] -= [s[f"ue{i}"] for i in range(3)]
        border[b] += [s[f"ve{i}"] for i in range(3)]
        corner, slope = corner + s["ee"], slope + s["er"]
    return (h[3:, 3:], grad[3:], border[3:], corner, slope), sum(s["cost"] for s in rows), sum(s["squares"] for s in rows), sum(s["n"] for s in rows)


def _settle_all(matches: DataFrame, fits: dict[tuple, Fit], lens: Lens) -> None:
    """All fits go on until each has settled; a job measures whatever they try."""
    while live := {k: f for k, f in fits.items() if not f.done}:
        tried = {k: f.trial or (f.rotations, f.k1) for k, f in live.items()}
        states = [(capture, name, float(k1), live[capture, name].huber, np.array(rotations)) for (capture, name), (rotations, k1) in tried.items()]
        sums = {}
        for s in pair_sums(matches, states, lens).collect():
            sums.setdefault((s["capture"], s["fit"]), []).append(s)
        for key, f in live.items():
            f.take(*_equations(sums.get(key, []), len(f.rotations)))


@dataclass
class LensFit:
    """A capture's rotations and coefficient; `refused` names the gate that a coefficient failed, if one was."""

    rotations: list[np.ndarray]
    k1: float
    rms: float
    costs: list[float]
    refused: str | None
    tried_k1: float
    tried_rms: float
    straight_rms: float


def leverage(matches: DataFrame, lens: Lens) -> dict:
    """By capture, how far a unit of k1 would move matched points against each other: the mean of |ra^3 - rb^3|."""
    radius = lambda u, v: F.hypot((F.col(u) - lens.cx) / lens.fx, (F.col(v) - lens.cy) / lens.fy)
    cubed = lambda u, v: F.pow(radius(u, v), F.lit(3.0))
    return {r[0]: r[1] for r in matches.groupBy("capture").agg(F.avg(F.abs(cubed("ua", "va") - cubed("ub", "vb")))).collect()}


def adjusted(matches: DataFrame, rotations: dict, lens: Lens = Lens(), cfg: Distortion | dict = Distortion()) -> dict:
    """matches: capture, a, b, ua, va, ub, vb, w; rotations (and cfg, or one for all) by capture -> LensFit by capture.

    Each capture is fitted twice, k1 held at 0 and k1 free, with a wide kernel first and the narrow one then: an
    uncorrected lens makes misses that the narrow one takes for outliers. k1 is kept if it lowers the residual by
    `least_gain` of it, if it accounts for `least_signal_deg` of what the matches' radii let it move, and if
    it lies inside its bound; otherwise the capture keeps the straight fit. Matches without pixels take no part; a
    capture that has none keeps its rotations.
    """
    missing = {"capture", "a", "b", "ua", "va", "ub", "vb", "w"} - set(matches.columns)
    if missing:
        raise ValueError(f"distortion is solved from pixels; missing: {sorted(missing)}")
    if len(rotations) > MOST_FITS:
        raise ValueError(f"at most {MOST_FITS} captures a call")
    pixels = matches.where(F.col("w") > 0).dropna(subset=["ua", "va", "ub", "vb"])
    pixels = settle(pixels.repartition(matches.sparkSession.sparkContext.defaultParallelism), "matches")  # every round reads it anew
    rules = cfg if isinstance(cfg, dict) else dict.fromkeys(rotations, cfg)
    fits = {(c, name): Fit([m.copy() for m in r], 0.0, math.radians(rules[c].warm_deg), name == "free", rules[c]) for c, r in rotations.items() for name in ("straight", "free")}
    _settle_all(pixels, fits, lens)
    fits = {k: Fit(f.rotations, f.k1, math.radians(f.cfg.huber_deg), f.free, f.cfg) for k, f in fits.items()}
    _settle_all(pixels, fits, lens)
    lever, out = leverage(pixels, lens), {}
    for c in rotations:
        straight, free, own = fits[c, "straight"], fits[c, "free"], rules[c]
        if straight.rms - free.rms <= max(straight.rms * own.least_gain, ROUNDING):
            refused = "gain"
        elif abs(free.k1) * lever.get(c, 0.0) < math.radians(own.least_signal_deg):
            refused = "signal"
        else:
            refused = "bound" if abs(free.k1) >= own.limit * (1 - 1e-6) else None
        kept = straight if refused else free
        out[c] = LensFit(kept.rotations, kept.k1, kept.rms, kept.costs, refused, free.k1, free.rms, straight.rms)
    return out
