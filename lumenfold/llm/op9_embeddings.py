"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Unit vectors are turned into the principal axes of their own second moments, largest first. Halving a bounded sample
again and again along its widest leading axis gives cells; vectors in the order of cells are cut into tiles, and
runs of tiles into groups. Groups meet in pairs, so a tile moves once for each group that its own may meet, by the
boxes around leading coordinates and the norms of what follows; within a pair the boxes of tiles rule out more.
Within two tiles, products of leading coordinates accumulate stage by stage; after each, the Cauchy-Schwarz bound of
the suffix norms drops pairs that cannot reach the threshold. Pairs that come out at the threshold to within rounding
are decided on the vectors as they were before they were turned. Tasks return counts and a spanning forest of their
links, never the links themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, indexed, table
from .graph import components

COSINE = 0.9
TILE = 4096  #: vectors of a tile
GROUP_TILES = 12  #: tiles of a group at most; a task holds two groups, and the driver a box for each
SPLIT_SAMPLE, SPLIT_AXES, CELL_SAMPLE = 1 << 14, 8, 16  #: vectors that place the cells' walls, axes they stand on, vectors of a cell
BLOCK = 1024  #: vectors of a side that are multiplied at once
STAGES = (16, 32)  #: coordinates accumulated before each bound
DENSE = 0.05  #: share of pairs that survive a bound above which a block is multiplied out whole
SLACK = 1e-9  #: what bounds allow for rounding
MERGED = 32  #: sums of second moments that reach the driver
EDGE = 1e-12  #: distance from the threshold up to which a pair is decided on the vectors before they were turned


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for vec_id, v in zip(batch["vec_id"], batch["embedding"], strict=True):
            x = np.array([np.nan if c is None else c for c in v] if v is not None else [], dtype=float)
            big = np.abs(x).max() if len(x) else 0.0
            if np.isfinite(x).all() and big > 0:
                x = x / big
                x = x / math.sqrt(float(x @ x)) + 0.0
                out.append((vec_id, len(x), xxhash.xxh3_128_digest(x.tobytes()), x))
            else:
                out.append((vec_id, None, None, None))
        yield pd.DataFrame(out, columns=["vec_id", "dim", "fp", "unit"]).astype({"vec_id": "Int64", "dim": "Int32"})


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            x = np.stack(batch["unit"])
            total = x.T @ x + (0 if total is None else total)
    if total is not None:
        yield pd.DataFrame({"slot": [TaskContext.get().partitionId() % MERGED], "sums": [total.tobytes()]})


def _merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"sums": [sum(np.frombuffer(x, dtype=float) for x in pdf["sums"]).tobytes()]})


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """Columns are axes, largest moment first, from all vectors: one matrix a partition, merged before MERGED reach the driver."""
    sums = classes.select("unit").mapInPandas(_moments, "slot int, sums binary").groupBy("slot").applyInPandas(_merged, "sums binary").collect()
    moments = sum(np.frombuffer(bytes(r["sums"]), dtype=float) for r in sums).reshape(dim, dim)
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


def walls(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(axis, value) of each inner node of a balanced tree, in heap order, that halves the sample along its widest axis."""
    depth = max(0, math.ceil(math.log2(max(1, cells))))
    axis, value = np.zeros((1 << depth) - 1, dtype=np.int64), np.zeros((1 << depth) - 1)
    inside = {0: sample}
    for node in range((1 << depth) - 1):
        x = inside.pop(node, np.empty((0, sample.shape[1])))
        if len(x):
            axis[node] = int(np.argmax(x.max(axis=0) - x.min(axis=0)))
            value[node] = float(np.median(x[:, axis[node]]))
        low = x[:, axis[node]] < value[node]
        inside[2 * node + 1], inside[2 * node + 2] = x[low], x[~low]
    return axis, value


def cells_of(x: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The leaf of each row, from 0."""
    node = np.zeros(len(x), dtype=np.int64)
    while len(axis) and node[0] < len(axis):  # all leaves lie equally deep
        node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] >= value[node])
    return node - len(axis)


def _rotated(axes: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.stack(batch["unit"]) @ axes
                yield pd.DataFrame({"fp": batch["fp"], "copies": batch["copies"], "cell": cells_of(x, *tree), "first": x[:, 0], "turned": [r.tobytes() for r in x]})

    return run


def _tiles(dim: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    lead = min(STAGES[0], dim)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["turned"]), dtype=float).reshape(-1, dim)
        rest = float(np.sqrt((x[:, lead:] ** 2).sum(axis=1)).max())
        box = np.concatenate([x[:, :lead].min(axis=0), x[:, :lead].max(axis=0), [rest]])
        return pd.DataFrame({"tile": [key[0]], "ids": [pdf["index"].to_numpy(np.int64).tobytes()], "copies": [pdf["copies"].to_numpy(np.int64).tobytes()], "vectors": [x.tobytes()], "box": [box]})

    return run


def may_meet(boxes: np.ndarray, box: np.ndarray, cosine: float) -> np.ndarray:
    """Which of these boxes allow a cosine with one more."""
    lead = (boxes.shape[1] - 1) // 2
    lo, hi = boxes[:, :lead], boxes[:, lead:-1]
    corners = np.stack([lo * box[:lead], lo * box[lead:-1], hi * box[:lead], hi * box[lead:-1]])
    return corners.max(axis=0).sum(axis=1) + boxes[:, -1] * box[-1] >= cosine - SLACK


def group_boxes(tiles: DataFrame, size: int, lead: int) -> np.ndarray:
    """The box around each run of `size` tiles, from sums over the cluster; a row a group reaches the driver."""
    at = lambda k, f: f(F.col("box")[k]).alias(f"b{k}")
    rows = tiles.groupBy(F.floor(F.col("tile") / size).alias("g")).agg(*[at(k, F.min if k < lead else F.max) for k in range(2 * lead + 1)]).orderBy("g").collect()
    return np.array([r[1:] for r in rows], dtype=float)


def _fan_out(boxes: np.ndarray, size: int, cosine: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(len(batch)):
                own = int(batch["tile"].iloc[k]) // size
                for other in np.flatnonzero(may_meet(boxes, boxes[own], cosine)).tolist():
                    yield batch.iloc[k : k + 1].assign(a=min(own, other), b=max(own, other))[["a", "b", "tile", "ids", "copies", "vectors", "box"]]

    return run


def hits(x: np.ndarray, y: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks with at least this cosine, and whether they are clear of the threshold."""
    dim = x.shape[1]
    steps = [s for s in STAGES if s < dim]
    if steps:
        s = steps[0]
        part = x[:, :s] @ y[:, :s].T
        bound = part + np.outer(np.sqrt((x[:, s:] ** 2).sum(axis=1)), np.sqrt((y[:, s:] ** 2).sum(axis=1)))
        i, j = np.nonzero(bound >= cosine - SLACK)
        if len(i) <= DENSE * part.size:
            sums = part[i, j]
            for before, s in zip(steps, [*steps[1:], dim], strict=True):
                sums = sums + np.einsum("ij,ij->i", x[i, before:s], y[j, before:s])
                rest = np.sqrt((x[i, s:] ** 2).sum(axis=1) * (y[j, s:] ** 2).sum(axis=1)) if s < dim else 0.0
                alive = sums + rest >= cosine - (SLACK if s < dim else EDGE)
                i, j, sums = i[alive], j[alive], sums[alive]
            return i, j, sums >= cosine + EDGE
    whole = x @ y.T
    i, j = np.nonzero(whole >= cosine - EDGE)
    return i, j, whole[i, j] >= cosine + EDGE


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """A label for each of n nodes, the least of its component under these edges."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while (new != new[new]).any():
            new = new[new]
        label = new[label]
        open_ = label[i] != label[j]
        i, j = i[open_], j[open_]
    return label


def _compare(dim: int, size: int, cosine: float) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tile")
        read = lambda c, t: [np.frombuffer(v, dtype=t) for v in pdf[c]]
        ids, copies = read("ids", np.int64), read("copies", np.int64)
        vectors = [v.reshape(-1, dim) for v in read("vectors", float)]
        boxes, own = np.array(pdf["box"].tolist()), pdf["tile"].to_numpy() // size
        at = np.concatenate([[0], np.cumsum([len(v) for v in ids])])
        links, label, edge = np.zeros(at[-1], dtype=np.int64), np.arange(at[-1]), []
        for s in range(len(ids)):
            meets = may_meet(boxes, boxes[s], cosine)
            for t in range(s, len(ids)):
                if not meets[t] or (own[s] == own[t]) != (key[0] == key[1]):
                    continue  # tiles of one group meet where the group meets itself
                x, y = vectors[s], vectors[t]
                for a in range(0, len(x), BLOCK):
                    for b in range(a if s == t else 0, len(y), BLOCK):
                        i, j, sure = hits(x[a : a + BLOCK], y[b : b + BLOCK], cosine)
                        i, j = i + a, j + b
                        if s == t:
                            once = i < j
                            i, j, sure = i[once], j[once], sure[once]
                        edge += [(ids[s][p], ids[t][q]) for p, q in zip(i[~sure].tolist(), j[~sure].tolist(), strict=True)]
                        i, j = i[sure], j[sure]
                        if len(i):
                            links[at[s] : at[s + 1]] += np.bincount(i, weights=copies[t][j], minlength=len(x)).astype(np.int64)
                            links[at[t] : at[t + 1]] += np.bincount(j, weights=copies[s][i], minlength=len(y)).astype(np.int64)
                            label = forest(label[i + at[s]], label[j + at[t]], at[-1])[label]
        every = np.concatenate(ids)
        node = np.flatnonzero(links)
        found = pd.DataFrame({"node": every[node], "links": links[node], "to": every[label[node]], "edge": False})
        near = pd.DataFrame([(a, 0, b, True) for a, b in edge], columns=found.columns)
        return pd.concat([found, near]) if edge else found

    return run


def _decided(edge: DataFrame, placed: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """edge: node, to of pairs at the threshold -> node, links, to of those whose vectors reach it, both ways."""
    known = placed.select("fp", "index", "copies").join(classes.select("fp", "unit"), "fp")
    of = lambda n: known.select(F.col("index").alias(n), F.col("copies").alias(f"c_{n}"), F.col("unit").alias(f"u_{n}"))
    met = edge.select("node", "to").distinct().join(of("node"), "node").join(of("to"), "to")
    dot = F.aggregate(F.zip_with("u_node", "u_to", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    good = met.where(dot >= cosine)
    return good.select("node", F.col("c_to").alias("links"), "to").unionByName(good.select(F.col("to").alias("node"), F.col("c_node").alias("links"), F.col("node").alias("to")))


def _of_dim(classes: DataFrame, dim: int, cosine: float) -> DataFrame:
    spark, n = classes.sparkSession, classes.count()
    axes = principal_axes(classes, dim)
    picked = classes.orderBy(F.xxhash64("fp"), "fp").limit(SPLIT_SAMPLE).select("unit").collect()
    sample = np.array([r["unit"] for r in picked]) @ axes[:, :SPLIT_AXES]
    tree = walls(sample, min(math.ceil(n / TILE), len(sample) // CELL_SAMPLE))
    turned = classes.select("fp", "copies", "unit").mapInPandas(_rotated(axes, tree), "fp binary, copies long, cell long, first double, turned binary")
    placed = cut(indexed(turned, F.col("cell"), F.col("first"), F.col("fp")).withColumn("tile", F.floor(F.col("index") / TILE).cast("long")), "placed")
    tiles = cut(placed.groupBy("tile").applyInPandas(_tiles(dim), "tile long, ids binary, copies binary, vectors binary, box array<double>"), "tiles")
    count = math.ceil(n / TILE)
    groups = max(math.ceil(count / GROUP_TILES), min(count, math.ceil(math.sqrt(4 * spark.sparkContext.defaultParallelism))))  # few tiles still make work for all cores
    size = math.ceil(count / groups)
    boxes = group_boxes(tiles, size, min(STAGES[0], dim))
    pairs = tiles.mapInPandas(_fan_out(boxes, size, cosine), "a long, b long, tile long, ids binary, copies binary, vectors binary, box array<double>")
    found = cut(pairs.groupBy("a", "b").applyInPandas(_compare(dim, size, cosine), "node long, links long, to long, edge boolean"), "found")
    edge, found = found.where("edge"), found.where("not edge").drop("edge")
    if edge.limit(1).count():
        found = cut(found.unionByName(_decided(edge, placed, classes, cosine)), "found")
    roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left")
    return placed.select("fp", F.col("index").alias("node")).join(counts, "node", "left").select("fp", F.concat_ws(":", F.lit(dim), F.coalesce("root", "node")).alias("root"), F.coalesce("links", F.lit(0)).alias("links"))


def near(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors: vec_id, embedding -> one row per row: vec_id, n_links, component_id, kept.

    Null or zero vectors, and those with null or non-finite components, link with nothing; vectors of different
    lengths do not either. Vectors of one direction, to the last bit, are compared as one that counts several
    times; repeated rows are vectors of their own that share a vec_id. Other columns, whatever they are
    called, aren't read. An empty table gives none.
    """
    rows = cut(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInPandas(_units, "vec_id long, dim int, fp binary, unit array<double>"), "units")
    classes = cut(rows.where("fp is not null").groupBy("dim", "fp").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("unit").alias("unit")), "directions")
    found = None
    for r in classes.select("dim").distinct().orderBy("dim").collect():
        own = _of_dim(classes.where(F.col("dim") == r["dim"]), r["dim"], cosine)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(classes.select("fp", "least", "copies").join(found, "fp"), "links")
    least = found.groupBy("root").agg(F.min("least").alias("component_id"))
    known = found.join(least, "root").select("fp", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "fp").join(known, "fp", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op9_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


SQL = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), u AS (
  SELECT r, vec_id, list_transform(e, lambda x: x / n) AS e FROM (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v)
  WHERE n > 0 AND isfinite(n) AND len(list_filter(e, lambda x: x IS NULL)) = 0
), l AS (
  SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.r < b.r AND len(a.e) = len(b.e) WHERE list_inner_product(a.e, b.e) >= {COSINE}
), s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS r, a AS c FROM s UNION SELECT s.b, reach.c FROM reach JOIN s ON s.a = reach.r),
c AS (SELECT reach.r, min(v.vec_id) AS component FROM reach JOIN v ON v.r = reach.c GROUP BY 1), n AS (SELECT a AS r, count(*) AS n FROM s GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept FROM v LEFT JOIN n USING (r) LEFT JOIN c USING (r)
"""
