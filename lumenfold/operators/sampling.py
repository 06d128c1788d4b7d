"""Sample positions in frames, photometric pairs and frame-to-frame tracking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Lens, Matching
from ..functions import geometry as g
from ..functions.lcg import JavaRandom, JavaRandoms
from .bounds import small
from .matching import knn_ratio


def jittered_grid(width: int, height: int, most: int, seed: int) -> list[tuple[int, int]]:
    """At most `most` pixels, one in each cell of a grid of the frame's shape, in reading order."""
    rng = JavaRandom(seed)
    columns = max(1, math.ceil(math.sqrt(most * width / height)))
    rows = max(1, math.ceil(most / columns))
    out = []
    for cell in range(min(most, rows * columns)):
        x = (cell % columns + rng.next_double()) * width / columns
        y = (cell // columns + rng.next_double()) * height / rows
        out.append((min(width - 1, int(x)), min(height - 1, int(y))))
    return out


def grid_samples(spark: SparkSession, width: int, height: int, most: int, seed: int) -> DataFrame:
    """The same positions as rows: sample, x, y; some hundreds."""
    at = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in jittered_grid(width, height, most, seed)])
    return spark.range(1).select(F.posexplode(at).alias("sample", "p")).select("sample", "p.*")


def drawn_grids(frames: DataFrame, key: str, seed: str, width: int, height: int, most: int) -> DataFrame:
    """frames: key and a seed of its own -> key, sample, x, y: such positions for each, drawn where the frame's row is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, s in zip(batch[key], batch[seed], strict=True):
                at = jittered_grid(width, height, most, int(s))
                yield pd.DataFrame({key: [k] * len(at), "sample": range(len(at)), "x": [x for x, _ in at], "y": [y for _, y in at]})

    return frames.select(key, seed).mapInPandas(run, f"{key} {frames.schema[key].dataType.simpleString()}, sample int, x int, y int")


def shared_positions(pairs: DataFrame, positions: DataFrame, rotations: DataFrame, lens: Lens) -> DataFrame:
    """pairs: a, b; positions: sample, x, y; rotations: frame, rotation; tens of frames, broadcast.

    Each position of the first frame that the second sees, with where it falls there: a, b, sample, x, y, u, v.
    """
    r = lambda side: small(rotations.select(F.col("frame").alias(side), F.col("rotation").alias(f"r{side}")))
    met = pairs.join(r("a"), "a").join(r("b"), "b").join(small(positions))
    world = g.rotate(F.col("ra"), g.unproject(F.col("x"), F.col("y"), lens))
    seen = met.withColumn("d_", g.rotate(F.col("rb"), world, transposed=True))
    return seen.where(g.visible(F.col("d_"), lens)).withColumn("p_", g.project(F.col("d_"), lens)).select("a", "b", "sample", "x", "y", F.col("p_.u").alias("u"), F.col("p_.v").alias("v"))


DRAWN_WITHIN, SEEN_WITHIN, TRIES = 0.2, 0.15, 40  #: margins of the first frame's draws and the second's places; draws a wanted point


def drawn_positions(pairs: DataFrame, lens: Lens, most: int, seed: int) -> DataFrame:
    """pairs: a, b, pair, ra, rb (rotations) -> a, b, pair, sample, u, v, ub, vb: drawn places that both frames see well inside.

    Each pair draws from a stream of its own, so that pairs are drawn side by side and alike however they are dealt, and
    draws anew where the other frame doesn't see a place: narrow overlaps get their number too, up to TRIES a point.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ra, rb = (np.array(batch[n].tolist(), float).reshape(-1, 3, 3) for n in ("ra", "rb"))
                row, *found = draws(batch["pair"].to_numpy(np.int64), np.einsum("nji,njk->nik", rb, ra), lens, most, seed)
                yield pd.DataFrame({**{n: batch[n].to_numpy()[row] for n in ("a", "b", "pair")}, **dict(zip(("sample", "u", "v", "ub", "vb"), found, strict=True))})

    if (lens.k1, lens.k2, lens.k3) != (0.0, 0.0, 0.0):
        raise ValueError("places are drawn in straightened frames")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are few, what is drawn for them is not
    return pairs.select("a", "b", "pair", "ra", "rb").repartition(tasks, "pair").mapInPandas(run, "a long, b long, pair long, sample int, u double, v double, ub double, vb double")


def draws(pair: np.ndarray, turn: np.ndarray, lens: Lens, most: int, seed: int) -> tuple[np.ndarray, ...]:
    """row of the pair, sample, u, v, ub, vb: draws of all pairs side by side, those that have enough aside."""
    stream, count, out = JavaRandoms(seed + pair), np.zeros(len(pair), np.int64), []
    for _ in range(most * TRIES):
        on = np.flatnonzero(count < most)
        if not len(on):
            break
        u, v = (size * (DRAWN_WITHIN + (1 - 2 * DRAWN_WITHIN) * stream.next_double(on)) for size in (lens.width, lens.height))
        p, q = (u - lens.cx) / lens.fx, (v - lens.cy) / lens.fy
        x, y, z = (turn[on, i, 0] * p + turn[on, i, 1] * q + turn[on, i, 2] for i in range(3))
        ahead = z > 1e-12
        z = np.where(ahead, z, 1.0)
        ub, vb = lens.fx * x / z + lens.cx, lens.fy * y / z + lens.cy
        for at, size in ((ub, lens.width), (vb, lens.height)):
            ahead &= (SEEN_WITHIN * size <= at) & (at <= (1 - SEEN_WITHIN) * size)
        out.append((on[ahead], count[on[ahead]], u[ahead], v[ahead], ub[ahead], vb[ahead]))
        count[on[ahead]] += 1
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for c in columns)


def valued_pairs(positions: DataFrame, pixels: DataFrame, least: float = 1e-6) -> DataFrame:
    """positions: a, x, y, b, xb, yb and others; pixels: frame, y, x, v -> also va and vb, where both are above `least`."""
    value = lambda side, x, y, n: pixels.select(F.col("frame").alias(side), F.col("x").alias(x), F.col("y").alias(y), F.col("v").alias(n))
    both = positions.join(value("a", "x", "y", "va"), ["a", "x", "y"]).join(value("b", "xb", "yb", "vb"), ["b", "xb", "yb"])
    return both.where((F.col("va") > least) & (F.col("vb") > least))


def with_previous(frames: DataFrame, keys: list[str], order: str, direction: str, gate_deg: float) -> DataFrame:
    """keys, order, before, turned, parallax: each frame with the one before it, and whether the camera turned enough."""
    w = Window.partitionBy(*keys).orderBy(order)
    seen = frames.withColumns({"before": F.lag(order).over(w), "was_": F.lag(direction).over(w)}).where("before is not null")
    turned = g.angle(F.col(direction), F.col("was_"))
    return seen.select(*keys, order, "before", turned.alias("turned"), (F.degrees(turned) >= gate_deg).alias("parallax"))


def photometric_samples(shared: DataFrame, pixels: DataFrame, least: float = 1e-6) -> DataFrame:
    """shared: as above; pixels: frame, y, x, v -> a, b, va, vb, w of positions where both are above `least`."""
    value = lambda side, x, y, n: pixels.select(F.col("frame").alias(side), F.col("x").alias(x), F.col("y").alias(y), F.col("v").alias(n))
    near = shared.withColumns({"xb": F.floor(F.col("u") + 0.5).cast("int"), "yb": F.floor(F.col("v") + 0.5).cast("int")}).drop("u", "v")
    both = near.join(value("a", "x", "y", "va"), ["a", "x", "y"]).join(value("b", "xb", "yb", "vb"), ["b", "xb", "yb"])
    return both.where((F.col("va") > least) & (F.col("vb") > least)).select("a", "b", "va", "vb", F.lit(1.0).alias("w"))


def tracked(features: DataFrame, order: str = "frame", cfg: Matching = Matching(), keys: tuple[str, ...] = ()) -> DataFrame:
    """features: keys, frame, kp, desc -> keys, frame, ka, kb, distance: matches of every frame with the one before it.

    Frames follow one another within a capture, the keys; without keys the table is one capture.
    """
    before = F.lag(order).over(Window.partitionBy(*keys).orderBy(order))
    frames = features.select(*keys, order).distinct().withColumn("before", before).where("before is not null")
    now = features.join(frames.select(*keys, order), [*keys, order], "left_semi")
    old = features.join(frames.select(*keys, F.col(order).alias("now"), F.col("before").alias(order)), [*keys, order])
    return knn_ratio(old.select(*keys, F.col("now").alias(order), "kp", "desc"), now.select(*keys, order, "kp", "desc"), [*keys, order], cfg, cross_check=True)


