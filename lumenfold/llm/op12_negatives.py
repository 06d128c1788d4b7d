"""Hard negatives by ball trees and branch and bound.

Rows in the order of label and norm are cut into tiles, each with a ball tree of its own; runs of tiles are groups.
Blocks of anchors meet groups in pairs, so a task holds one block and one group, whatever the table's size. A ball
bounds inner products with an anchor above and below: c.a + r|a| and c.a - r|a|. A node is dropped for a
probe where it lies outside the probe's window of scores, or strictly beneath its current fifth. A first search
finds positives among rows of the anchor's label, a second one, with a window for each positive, the negatives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, indexed, table

EVERY, SHIFTED, LABELS = 100, 7, 10  #: ids of anchors; ids whose label moves on; labels that it moves on among
MOST, LOW_SHARE, SCALE = 5, 80, 256  #: positives and negatives; least share of a positive's score, in percent; steps of a component
TILE, LEAF, BLOCK = 1024, 32, 4096  #: rows of a tile, of a leaf at most, anchors of a block
GROUP_BYTES = 16 << 20  #: vectors of a group
SLACK = 1e-9  #: what bounds allow for rounding, as a share of what they are made of
EXACT = 1 << 53  #: sums of whole numbers below this are exact in doubles
NONE = np.iinfo(np.int64).min  #: no score yet


def _whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows that take part, with whole components."""
    for batch in batches:
        out = []
        for row, vec_id, label, v in zip(batch["row"], batch["vec_id"], batch["label"], batch["embedding"], strict=True):
            x = np.array([np.nan if c is None else c for c in v], dtype=float)
            if np.isfinite(x).all():
                x = np.floor(SCALE * x)
                out.append((row, vec_id, label, len(x), float(np.sqrt((x * x).sum())), x.tobytes()))
        yield pd.DataFrame(out, columns=["row", "vec_id", "label", "dim", "norm", "vector"])


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), dtype=float).reshape(len(vectors), dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole vectors, exact; an error where one is no long."""
    most = (np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    as_ints = lambda m: np.array([[int(c) for c in r] for r in m], dtype=object).reshape(m.shape)
    return np.dot(as_ints(a), as_ints(b).T).astype(np.int64)


def ball_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of rows; of each node, level by level from the root: rows' (start, end), centre, radius).

    Halves are of equal size along the widest axis, so levels are full; the last is that of the leaves.
    """
    order, levels = np.arange(len(x)), [[(0, len(x))]]
    while levels[-1][0][1] - levels[-1][0][0] > LEAF:
        halves = []
        for s, e in levels[-1]:
            own, mid = x[order[s:e]], (e - s + 1) // 2
            if x.shape[1] and mid < e - s:
                axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                order[s:e] = order[s:e][np.argsort(own[:, axis], kind="stable")]
            halves += [(s, s + mid), (s + mid, e)]
        levels.append(halves)
    spans = np.array([n for level in levels for n in level], dtype=np.int64)
    centre, radius = np.zeros((len(spans), x.shape[1])), np.zeros(len(spans))
    for k, (s, e) in enumerate(spans):
        own = x[order[s:e]]
        if len(own):
            centre[k] = own[0] if (own == own[0]).all() else own.mean(axis=0)
            radius[k] = np.sqrt(((own - centre[k]) ** 2).sum(axis=1).max(initial=0.0))
    return order, spans, centre, radius


def _tree_rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    dim, group, tile = key
    x = _matrix(pdf["vector"], dim)
    order, spans, centre, radius = ball_tree(x)
    pick = lambda c: pdf[c].to_numpy(np.int64)[order].tobytes()
    return pd.DataFrame(
        {"dim": [dim], "group": [group], "tile": [tile], "rows": [pick("row")], "ids": [pick("vec_id")], "labels": [pick("label")], "vectors": [x[order].tobytes()], "spans": [spans.tobytes()], "centre": [centre.tobytes()],
         "radius": [radius.tobytes()], "low_label": [pdf["label"].min()], "high_label": [pdf["label"].max()], "norm": [pdf["norm"].max()]}
    )


TREE = "dim int, group long, tile long, rows binary, ids binary, labels binary, vectors binary, spans binary, centre binary, radius binary, low_label long, high_label long, norm double"


class Probes:
    """Anchors of a block, and for each of their windows the best rows so far."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool):
        self.vectors, self.rows, self.labels, self.of, self.low, self.high, self.same = vectors, rows, labels, of, low, high, same
        self.norms = np.sqrt((vectors**2).sum(axis=1))
        self.score = np.full((len(of), MOST), NONE)
        self.found, self.row = np.zeros((len(of), MOST), dtype=np.int64), np.zeros((len(of), MOST), dtype=np.int64)
        self.visited = 0

    def least(self, at: np.ndarray) -> np.ndarray:
        """What a score must reach, of these probes: the window's lower end, and the current fifth."""
        return np.maximum(self.low[at], self.score[at, -1])

    def search(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, spans: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> None:
        """Take in the rows of one tree."""
        size = np.sqrt((centre**2).sum(axis=1))

        def bounds(anchors: np.ndarray, nodes: slice) -> tuple[np.ndarray, np.ndarray]:
            mid = self.vectors[anchors] @ centre[nodes].T
            r = radius[nodes][None, :] * (1 + SLACK) + np.where(radius[nodes] > 0, SLACK, 0.0)[None, :] * (size[nodes][None, :] + 1)
            reach = self.norms[anchors][:, None] * r
            return mid + reach, mid - reach

        alive, first, width = np.ones((len(self.of), 1), dtype=bool), 0, 1
        while True:
            live = np.flatnonzero(alive.any(axis=1))
            if not len(live):
                return
            anchors, back = np.unique(self.of[live], return_inverse=True)
            up, down = bounds(anchors, slice(first, first + width))
            up, down = up[back], down[back]
            own = alive[live] & (up >= self.least(live)[:, None]) & (down <= self.high[live][:, None])
            alive = np.zeros_like(alive)
            alive[live] = own
            if first + width == len(spans):
                break
            alive, first, width = np.repeat(alive, 2, axis=1), first + width, 2 * width
        limit = np.zeros(alive.shape)
        limit[live] = up
        for k in np.argsort(-np.where(alive, limit, -np.inf).max(axis=0, initial=-np.inf), kind="stable"):
            s, e = spans[first + k]
            at = np.flatnonzero(alive[:, k])
            at = at[limit[at, k] >= self.least(at)]
            if len(at) and e > s:
                self._leaf(at, ids[s:e], rows[s:e], labels[s:e], x[s:e])

    def _leaf(self, at: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        self.visited += len(at)
        anchors, back = np.unique(self.of[at], return_inverse=True)
        scores = products(self.vectors[anchors], x)[back]
        mine = self.of[at]
        fits = (labels[None, :] == self.labels[mine][:, None]) == self.same
        fits &= (rows[None, :] != self.rows[mine][:, None]) & (scores >= self.least(at)[:, None]) & (scores <= self.high[at][:, None])
        some = fits.any(axis=1)
        at, scores = at[some], np.where(fits[some], scores[some], NONE)
        wide = lambda now, new: np.concatenate([now[at], np.broadcast_to(new, (len(at), len(new)))], axis=1)
        score, found, row = np.concatenate([self.score[at], scores], axis=1), wide(self.found, ids), wide(self.row, rows)
        best = np.lexsort((row, found, -np.maximum(score, NONE + 1)), axis=1)[:, :MOST]
        for have, new in ((self.score, score), (self.found, found), (self.row, row)):
            have[at] = np.take_along_axis(new, best, axis=1)


def _searched(same: bool) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, anchors: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        columns = ["row", "place", "found", "score"]
        if not len(anchors) or not len(tiles):
            return pd.DataFrame([], columns=columns)
        dim = key[0]
        read = lambda v, kind=np.int64: np.frombuffer(v, dtype=kind)
        of = np.repeat(np.arange(len(anchors)), [len(w) for w in anchors["windows"]])
        windows = np.array([[w["place"], w["low"], w["high"]] for ws in anchors["windows"] for w in ws], dtype=np.int64).reshape(-1, 3)
        probes = Probes(_matrix(anchors["vector"], dim), anchors["row"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), of, windows[:, 1], windows[:, 2], same)
        for t in tiles.sort_values("tile").itertuples():
            ids, spans = read(t.ids), read(t.spans).reshape(-1, 2)
            probes.search(ids, read(t.rows), read(t.labels), read(t.vectors, float).reshape(len(ids), dim), spans, read(t.centre, float).reshape(len(spans), dim), read(t.radius, float))
        p, k = np.nonzero(probes.score != NONE)
        return pd.DataFrame({"row": probes.rows[of[p]], "place": windows[p, 0], "found": probes.found[p, k], "score": probes.score[p, k]}, columns=columns)

    return run


def _best(anchors: DataFrame, trees: DataFrame, same: bool) -> DataFrame:
    """anchors: row, dim, block, label, norm, vector, windows (place, low, high) -> row, place, rank, found, score.

    A block meets a group whose labels and longest vector may hold what one of its windows asks for.
    """
    least = F.min(F.array_min(F.transform("windows", lambda w: w["low"])))
    blocks = anchors.groupBy("dim", "block").agg(F.min("label").alias("from_label"), F.max("label").alias("to_label"), F.max("norm").alias("longest"), least.alias("least"))
    groups = trees.groupBy("dim", "group").agg(F.min("low_label").alias("low_label"), F.max("high_label").alias("high_label"), F.max("norm").alias("norm"))
    if same:
        fits = (F.col("from_label") <= F.col("high_label")) & (F.col("low_label") <= F.col("to_label"))
    else:
        alone = (F.col("from_label") == F.col("to_label")) & (F.col("low_label") == F.col("high_label")) & (F.col("from_label") == F.col("low_label"))
        fits = ~alone & (F.col("longest") * F.col("norm") * (1 + SLACK) >= F.col("least"))
    pairs = cut(blocks.join(groups, "dim").where(fits).select("dim", "block", "group"), "meetings")
    keys = ["dim", "block", "group"]
    left = anchors.join(pairs, ["dim", "block"]).select(*keys, "row", "label", "vector", "windows")
    right = trees.join(pairs, ["dim", "group"]).select(*keys, "tile", "rows", "ids", "labels", "vectors", "spans", "centre", "radius")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_searched(same), "row long, place int, found long, score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", rank).where(F.col("rank") <= MOST)


def mine(vectors: DataFrame) -> DataFrame:
    """vectors: vec_id, embedding, label -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null id, label or vector, or a null or non-finite component, take no part; vectors of different
    lengths don't meet. Ties go by vec_id; repeated rows are rows of their own that share it, and each anchor among
    them has its results. A score that is no long is an error. Other columns aren't read. An empty table gives none.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)
    given = vectors.where("vec_id is not null and label is not null and embedding is not null")
    given = given.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(given.mapInPandas(_whole, "row long, vec_id long, label long, dim int, norm double, vector binary"), "whole")
    at = cut(indexed(rows, F.col("dim"), F.col("label"), F.col("norm"), F.col("row")), "ordered")
    tiles = at.count() / TILE  # groups are small while few of them keep all cores busy
    share = max(1, int(tiles / (2 * spark.sparkContext.defaultParallelism)))
    held = F.greatest(F.lit(1), F.least(F.lit(share), F.floor(F.lit(GROUP_BYTES) / (F.greatest("dim", F.lit(1)) * (8 * TILE))))).cast("long")
    tiled = at.withColumn("tile", F.floor(F.col("index") / TILE).cast("long")).withColumn("group", F.floor(F.col("tile") / held).cast("long"))
    trees = cut(tiled.groupBy("dim", "group", "tile").applyInPandas(_tree_rows, TREE), "trees")
    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit(int(NONE)).cast("long").alias("low"), F.lit(int(np.iinfo(np.int64).max)).cast("long").alias("high")))
    anchors = indexed(rows.where(F.col("vec_id") % EVERY == 0), F.col("dim"), F.col("label"), F.col("row")).withColumn("block", F.floor(F.col("index") / BLOCK).cast("long"))
    anchors = cut(anchors.withColumn("windows", whole).drop("index"), "anchors")
    positives = cut(_best(anchors, trees, True).where("score >= 0").select("row", F.col("rank").alias("place"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low = F.expr(f"positive_score - cast(floor(cast(positive_score as decimal(20, 0)) * {100 - LOW_SHARE} / 100) as bigint)")
    windows = positives.groupBy("row").agg(F.collect_list(F.struct("place", low.alias("low"), F.col("positive_score").alias("high"))).alias("windows"))
    negatives = _best(anchors.drop("windows").join(windows, "row"), trees, False)
    out = negatives.join(positives, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.r <> b.r AND len(a.e) = len(b.e)
), p AS (SELECT r, anchor_id, other, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, other) <= {MOST}),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id, s.other) AS rank
  FROM p JOIN s ON s.r = p.r AND NOT s.same AND {LOW_SHARE} * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {MOST}
"""
