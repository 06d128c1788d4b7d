"""Solves: sums over samples are distributed, systems of some tens of unknowns are solved on the driver."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bind, multiply, transpose
from ..functions.radiometry import falloff, hat_weight, level
from .statistics import upper_median


def damped(a: np.ndarray, b: np.ndarray, damping: float, tries: int = 40) -> np.ndarray | None:
    """A symmetric positive system; damping grows tenfold until it can be factored."""
    for k in range(tries):
        try:
            low = np.linalg.cholesky(a + np.eye(len(a)) * (0.0 if k == 0 else damping * 10 ** (k - 1)))
        except np.linalg.LinAlgError:
            continue
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    return None


# --- gains ----------------------------------------------------------------------------------------------

def usable(samples: DataFrame) -> DataFrame:
    return samples.where((F.col("a") != F.col("b")) & (F.col("w") > 0) & (F.col("va") > 0) & (F.col("vb") > 0)).select("a", "b", "va", "vb", "w")


def gain_equations(samples: DataFrame) -> DataFrame:
    """samples: a, b, va, vb, w -> a, b, w, wr: per pair, weights and weighted log ratios; one shuffle."""
    return usable(samples).groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * (F.ln("vb") - F.ln("va"))).alias("wr"))


def _gains(n: int, equations: list, ridge: float) -> np.ndarray:
    m, rhs = np.eye(n) * max(ridge, 1e-12), np.zeros(n)
    for i, j, w, wr in equations:
        m[i, i] += w
        m[j, j] += w
        m[i, j] -= w
        m[j, i] -= w
        rhs[i] += wr
        rhs[j] -= wr
    x = damped(m, rhs, 1e-12)
    x = np.zeros(n) if x is None else x
    return x - x.mean()


def gains(samples: DataFrame, frames: int, ridge: float = 1e-6, rounds: int = 0) -> list[float]:
    """A gain for each frame, 0 to frames - 1, whose logs sum to 0. With rounds, samples far off are weighed down."""
    collect = lambda df: [tuple(r) for r in gain_equations(df).select("a", "b", "w", "wr").collect()]
    if rounds:
        from .graph import settle

        samples = settle(usable(samples), "samples")  # read three times a round
    x = _gains(frames, collect(samples), ridge)
    for _ in range(rounds):
        last, table = x, F.array(*[F.lit(float(v)) for v in x])
        miss = F.abs(F.element_at(table, F.col("a").cast("int") + 1) - F.element_at(table, F.col("b").cast("int") + 1) - (F.ln("vb") - F.ln("va")))
        seen = samples.withColumn("miss", miss)
        scale = 1.4826 * (upper_median(seen, [], "miss").first() or [0.0])[0]
        delta = max(1e-3, 2.0 * scale)
        x = _gains(frames, collect(seen.withColumn("w", F.col("w") * F.when(F.col("miss") <= delta, 1.0).otherwise(F.lit(delta) / F.col("miss")))), ridge)
        if np.abs(x - last).max(initial=0.0) < 1e-13:
            break  # another round would find the same
    return [math.exp(v) for v in x]


# --- rotations ------------------------------------------------------------------------------------------

def outer_sums(pairs: DataFrame, keys: list[str], source: str = "p", target: str = "q") -> DataFrame:
    """Nine sums of products of two vector structs, for each key."""
    return pairs.groupBy(*keys).agg(*[F.sum(F.col(f"{target}.{i}") * F.col(f"{source}.{j}")).alias(f"s_{i}{j}") for i in "xyz" for j in "xyz"])


def kabsch(sums: np.ndarray) -> np.ndarray | None:
    """The rotation that best takes source to target vectors, from their summed products; null if they are collinear."""
    u, s, vt = np.linalg.svd(sums)
    if s[1] <= 1e-12 * max(s[0], 1e-300):
        return None
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ vt))]) @ vt


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arctan2(np.linalg.norm(np.cross(a, b), axis=-1), (a * b).sum(axis=-1))


def ransac(p: np.ndarray, q: np.ndarray, limit: float, rounds: int, seed: int, refits: int = 3) -> tuple[np.ndarray | None, np.ndarray, float]:
    """(rotation, inliers, median error) that takes unit vectors p to q for most pairs; samples of two."""
    from ..functions.lcg import JavaRandom

    rng, best, best_in = JavaRandom(seed), None, np.zeros(len(p), dtype=bool)
    if len(p) < 2:
        return None, best_in, float("nan")
    for _ in range(rounds):
        i, j = rng.next_int(len(p)), rng.next_int(len(p))
        if i == j:
            continue
        r = kabsch(q[[i, j]].T @ p[[i, j]])
        if r is None:
            continue
        inside = _cross(p @ r.T, q) < limit
        if inside.sum() > best_in.sum():
            best, best_in = r, inside
    for _ in range(refits if best is not None else 0):
        r = kabsch(q[best_in].T @ p[best_in])
        if r is None:
            break
        best, best_in = r, _cross(p @ r.T, q) < limit
    if best is None or not best_in.any():
        return None, best_in, float("nan")
    errors = np.sort(_cross(p[best_in] @ best.T, q[best_in]))
    return best, best_in, float(errors[len(errors) // 2])


def pair_rotations(matches: DataFrame, keys: list[str], limit_deg: float = 0.4, rounds: int = 1000, seed: int = 12345) -> DataFrame:
    """matches: keys and px, py, pz, qx, qy, qz -> keys, matches, inliers, error_deg, rotation of each frame pair.

    With a column `pair`, the pair's number from 0, each pair draws from a seed of its own.

    Pairs are solved side by side; a pair's matches, some hundreds, are one task's.
    """
    kinds = {f.name: f.dataType.simpleString() for f in matches.schema}
    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["matches int", "inliers int", "error_deg double", "rotation array<double>"])
    return matches.groupBy(*keys).applyInPandas(_pair_solver(keys, limit_deg, rounds, seed), schema)


def _pair_solver(keys: list[str], limit_deg: float, rounds: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf[["px", "py", "pz"]].to_numpy(float), pdf[["qx", "qy", "qz"]].to_numpy(float)
        order = np.lexsort(np.hstack([p, q]).T)
        own = seed + 31 * (int(pdf["pair"].iloc[0]) + 1) if "pair" in pdf else seed
        r, inside, error = ransac(p[order], q[order], math.radians(limit_deg), rounds, own)
        row = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(row | {"matches": [len(p)], "inliers": [int(inside.sum())], "error_deg": [math.degrees(error)], "rotation": [None if r is None else r.ravel().tolist()]})

    return run


def exp_so3(w: np.ndarray) -> np.ndarray:
    t = float(np.linalg.norm(w))
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if t < 1e-8:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + math.sin(t) / t * k + (1 - math.cos(t)) / t**2 * (k @ k)


def spanning_rotations(pairs: list[tuple[int, int, int, np.ndarray]], n: int) -> dict[int, np.ndarray]:
    """(a, b, inliers, rotation from b to a) -> rotations grown from the strongest pair, strongest edges first."""
    order = sorted(range(len(pairs)), key=lambda k: (-pairs[k][2], k))
    placed: dict[int, np.ndarray] = {}
    if not order:
        return placed
    placed[pairs[order[0]][0]] = np.eye(3)
    grew = True
    while grew:
        grew = False
        for k in order:
            a, b, _, r = pairs[k]
            if (a in placed) != (b in placed):
                if a in placed:
                    placed[b] = placed[a] @ r
                else:
                    placed[a] = placed[b] @ r.T
                grew = True
                break
    return placed


def initial_rotations(pairs: list[tuple[int, int, int, np.ndarray]], priors: list[np.ndarray | None]) -> tuple[list[np.ndarray], list[bool], list[bool]]:
    """Pairs as above and a prior of each frame or null -> (rotations, placed, prior only).

    What grows from the strongest pair is turned as one onto the consensus of its priors, then the frames that it
    doesn't reach are put where their priors have them; those without one are not placed. Without pairs the first
    frame is the root.
    """
    from .features import consensus

    n = len(priors)
    grown = spanning_rotations(pairs, n)
    alone = not grown
    if alone and n:
        grown = {0: np.eye(3) if priors[0] is None else priors[0]}
    placed, prior_only = [i in grown for i in range(n)], [alone and i == 0 and priors[0] is not None for i in range(n)]
    out = [grown.get(i, np.eye(3)) for i in range(n)]
    level = consensus(out, [np.eye(3) if p is None else p for p in priors], [i in grown and priors[i] is not None for i in range(n)])
    if level is not None:
        out = [level @ r if i in grown else r for i, r in enumerate(out)]
    for i, prior in enumerate(priors):
        if not placed[i] and prior is not None:
            out[i], placed[i], prior_only[i] = prior, True, True
    return out, placed, prior_only


def _times(a: Column, b: Column) -> Column:
    """The product of two matrices, each worked out once."""
    return bind(a, lambda x: bind(b, lambda y: multiply(x, y)))


def grown(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, inliers, rotation from b to a -> frame, rotation of what grows from the strongest pair.

    Growth by strongest edges is the maximum spanning tree, of equals the first pair. Components choose their strongest
    edge out and merge (half of them or fewer are left each round); a frame keeps its rotation to its component's first
    frame, and those of merged components are composed by pointers that double. Nothing is gathered but the root.
    """
    from .graph import settle

    eye = F.array(*[F.lit(float(v)) for v in np.eye(3).ravel()])
    key = F.struct((-F.col("inliers")).alias("weakness"), "a", "b")
    pairs = settle(pairs.where("a <> b").select("a", "b", key.alias("key"), "rotation"), "pairs")
    nodes = pairs.select(F.col("a").alias("frame")).union(pairs.select("b")).distinct()
    nodes = settle(nodes.select("frame", F.col("frame").alias("part"), eye.alias("turn")), "nodes")
    side = lambda end: nodes.select(F.col("frame").alias(end), F.col("part").alias(f"{end}_part"), F.col("turn").alias(f"{end}_turn"))
    while True:
        met = pairs.join(side("a"), "a").join(side("b"), "b").where("a_part <> b_part")
        met = met.select("key", "a_part", "b_part", _times(_times(F.col("a_turn"), F.col("rotation")), transpose(F.col("b_turn"))).alias("to_a"))
        out = met.select(F.col("b_part").alias("part"), F.col("a_part").alias("up"), "key", F.col("to_a").alias("turn"))
        out = out.unionByName(met.select(F.col("a_part").alias("part"), F.col("b_part").alias("up"), "key", transpose(F.col("to_a")).alias("turn")))
        best = settle(out.groupBy("part").agg(F.min("key").alias("key"), F.min_by(F.struct("up", "turn"), "key").alias("h")).select("part", "key", "h.*"), "best")
        if not best.limit(1).count():
            break
        chosen = best.select(F.col("part").alias("up"), F.col("key").alias("up_key"))
        first = (F.col("key") == F.col("up_key")) & (F.col("part") < F.col("up"))  # of two that chose each other
        ups = best.join(chosen, "up").select("part", F.when(first, F.col("part")).otherwise(F.col("up")).alias("up"), F.when(first, eye).otherwise(F.col("turn")).alias("turn"))
        while True:
            ups = settle(ups, "ups")
            onward = ups.select(F.col("part").alias("up"), F.col("up").alias("far"), F.col("turn").alias("far_turn"))
            further = ups.join(onward, "up")
            if not further.where("far <> up").limit(1).count():
                break
            ups = further.select("part", F.col("far").alias("up"), _times(F.col("far_turn"), F.col("turn")).alias("turn"))
        moved = ups.select("part", "up", F.col("turn").alias("up_turn"))
        nodes = settle(nodes.join(moved, "part", "left").select("frame", F.coalesce("up", "part").alias("part"), F.when(F.col("up").isNull(), F.col("turn")).otherwise(_times(F.col("up_turn"), F.col("turn"))).alias("turn")), "nodes")
    root = pairs.orderBy("key").select("a").limit(1).join(nodes, F.col("a") == F.col("frame")).select("part", "turn").first()
    if root is None:
        return nodes.select(F.col("frame").cast("long").alias("frame"), F.col("turn").alias("rotation"))
    back = F.array(*[F.lit(float(v)) for v in np.array(root["turn"]).reshape(3, 3).T.ravel()])
    return nodes.where(F.col("part") == F.lit(root["part"])).select(F.col("frame").cast("long").alias("frame"), _times(back, F.col("turn")).alias("rotation"))


def strongest_first(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """pairs: keys, pair, inliers and others -> also place: most inliers first, pair order among equals."""
    return pairs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("inliers").desc(), "pair")))


def _nearest_rotation(m: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(m)
    return u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt


def orthonormal(matrices: DataFrame, name: str) -> DataFrame:
    """The rotation nearest to each matrix of nine values, in place of it."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: [_nearest_rotation(np.array(m, float).reshape(3, 3)).ravel().tolist() for m in batch[name]]})

    return matrices.mapInPandas(nearest, matrices.schema)


def _matrix_sums(products: list[Column], keys: list[str], rows: DataFrame) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(p) for p in products]).alias("sums_"))


def pose_consensus(poses: DataFrame, keys: list[str]) -> DataFrame:
    """poses: keys, solved, reference -> keys, rotation: the one that best takes solved poses to their references.

    Nine sums for each key, combined before the shuffle; no poses are gathered.
    """
    solved, reference = F.col("solved"), F.col("reference")
    product = [reference[3 * i] * solved[3 * j] + reference[3 * i + 1] * solved[3 * j + 1] + reference[3 * i + 2] * solved[3 * j + 2] for i in range(3) for j in range(3)]
    return orthonormal(_matrix_sums(product, keys, poses), "sums_").withColumnRenamed("sums_", "rotation")


def pose_horizon(poses: DataFrame, keys: list[str], floor: float = 0.05) -> DataFrame:
    """poses: keys, rotation -> keys, up, confidence, tilt_deg: up is what horizontal axes have least in common with.

    Sums for each key are combined before the shuffle; the tilt is a second pass against them.
    """
    m = F.col("rotation")
    axis = [m[0], m[3], m[6]]
    sums = _matrix_sums([axis[i] * axis[j] for i in range(3) for j in range(3)] + [-m[1], -m[4], -m[7]], keys, poses)

    def up_of(batch: pd.Series) -> pd.DataFrame:
        out = []
        for row in batch:
            x = np.array(row, float)
            moments, own = x[:9].reshape(3, 3), x[9:]
            _, s, vt = np.linalg.svd(moments)
            sure = max(0.0, float((s[1] - s[2]) / s[0])) if s[0] > 0 else 0.0
            if sure >= floor:
                up = vt[2] if vt[2] @ own >= 0 else -vt[2]
            else:
                up = own / np.linalg.norm(own) if own @ own > 1e-12 else np.array([0.0, 1.0, 0.0])
            out.append((*up, sure))
        return pd.DataFrame(out, columns=["x", "y", "z", "confidence"])

    found = sums.select(*keys, F.pandas_udf(up_of, "x double, y double, z double, confidence double")("sums_").alias("up"))
    lean = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), axis[0] * F.col("up.x") + axis[1] * F.col("up.y") + axis[2] * F.col("up.z"))))
    tilt = poses.join(found, keys).groupBy(*keys).agg(F.degrees(F.sqrt(F.avg(lean * lean))).alias("tilt_deg"))
    return found.join(tilt, keys).select(*keys, "up", F.col("up.confidence").alias("confidence"), "tilt_deg")


def rising(levels: DataFrame, keys: list[str], level: str, value: str) -> DataFrame:
    """keys, level and linear: each response table made to rise, 1 at its top."""
    w = Window.partitionBy(*keys)
    return levels.withColumn("linear", F.max(value).over(w.orderBy(level)) / F.max(value).over(w))


def min_cuts(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """nodes: key, node, source, sink; edges: key, a, b, capacity both ways -> key, flow of each network.

    A network is a row, its nodes and edges are arrays. A task solves the networks of a batch one after the other, so many
    small ones don't each cost a call.
    """
    lists = lambda df, *names: df.groupBy(key).agg(F.collect_list(F.struct(*[F.coalesce(F.col(n).cast(t), F.lit(0).cast(t)).alias(n) for n, t in names])).alias("s_")).select(key, *[F.col(f"s_.{n}").alias(n) for n, _ in names])
    own = lists(nodes, ("node", "int"), ("source", "double"), ("sink", "double"))
    tied = lists(edges, ("a", "int"), ("b", "int"), ("capacity", "double"))
    kind = nodes.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .cut import Network

        for batch in batches:
            flows = []
            for node, source, sink, a, b, capacity in zip(*[batch.column(i).to_pylist() for i in range(1, 7)], strict=True):
                net = Network(max(node) + 1)
                for p in zip(node, source, sink, strict=True):
                    net.terminal(*p)
                for p, q, c in zip(a or (), b or (), capacity or (), strict=True):
                    net.edge(p, q, c, c)
                flows.append(net.flow())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flows, pa.float64())], names=[key, "flow"])

    met = own.join(tied.withColumnRenamed(key, "of_"), F.col(key).eqNullSafe(F.col("of_")), "left").drop("of_")
    return met.mapInArrow(run, f"{key} {kind}, flow double")


def bundle_equations(matches: DataFrame, rotations: list[np.ndarray], huber: float) -> tuple[np.ndarray, np.ndarray, float]:
    """J^T J, J^T r and the robust cost of matches (a, b, px..qz, w), summed over the cluster.

    The residual of a match is the difference of its two bearings in the world; a rotation moves by a world
    vector from the left. Only sums per frame pair, 9 + 6 numbers, reach the driver.
    """
    tables = F.array(*[F.array(*[F.lit(float(v)) for v in r.ravel()]) for r in rotations])
    world = lambda f, p: [sum((F.element_at(F.element_at(tables, F.col(f).cast("int") + 1), 3 * i + j + 1) * F.col(p + "xyz"[j]) for j in range(3)), F.lit(0.0)) for i in range(3)]
    u, v = world("a", "p"), world("b", "q")
    seen = matches.select("a", "b", "w", *[x.alias(f"u{k}") for k, x in enumerate(u)], *[x.alias(f"v{k}") for k, x in enumerate(v)])
    miss = F.sqrt(sum((F.pow(F.col(f"u{k}") - F.col(f"v{k}"), F.lit(2.0)) for k in range(3)), F.lit(0.0)))
    seen = seen.withColumn("miss", miss).withColumn("k", F.col("w") * F.when(F.col("miss") <= huber, 1.0).otherwise(F.lit(huber) / F.col("miss")))
    cost = F.when(F.col("miss") <= huber, F.col("miss") * F.col("miss") / 2).otherwise((F.col("miss") - huber / 2) * huber) * F.col("w")
    col = F.col
    terms = {f"{p}{q}{i}{j}": col("k") * col(f"{p}{i}") * col(f"{q}{j}") for p, q in ("uu", "vv", "uv") for i in range(3) for j in range(3)}
    sums = seen.groupBy("a", "b").agg(F.sum(cost).alias("cost"), *[F.sum(t).alias(n) for n, t in terms.items()]).collect()
    n = len(rotations)
    h, g, total = np.zeros((3 * n, 3 * n)), np.zeros(3 * n), 0.0
    for s in sums:
        a, b = s["a"], s["b"]
        uu, vv, uv = (np.array([[s[f"{p}{i}{j}"] for j in range(3)] for i in range(3)]) for p in ("uu", "vv", "uv"))
        # du = w x u, so its matrix is -[u]x, and sums of products of skew matrices follow from sums of u v^T.
        skew = lambda m: np.trace(m) * np.eye(3) - m
        ia, ib = slice(3 * a, 3 * a + 3), slice(3 * b, 3 * b + 3)
        h[ia, ia] += skew(uu)
        h[ib, ib] += skew(vv)
        h[ia, ib] -= np.trace(uv) * np.eye(3) - uv.T
        h[ib, ia] -= np.trace(uv) * np.eye(3) - uv
        twist = np.array([uv[1, 2] - uv[2, 1], uv[2, 0] - uv[0, 2], uv[0, 1] - uv[1, 0]])  # sum of k u x v
        g[ia] -= twist
        g[ib] += twist
        total += s["cost"]
    return h, g, total


def bundle_adjust(matches: DataFrame, rotations: list[np.ndarray], huber_deg: float = 0.5, rounds: int = 60) -> tuple[list[np.ndarray], list[float]]:
    """Rotations that bring matched bearings together, the first frame held; costs never rise from round to round."""
    huber, damping = math.radians(huber_deg), 1e-6
    now = [r.copy() for r in rotations]
    h, g, cost = bundle_equations(matches, now, huber)
    costs = [cost]
    for _ in range(rounds):
        step = damped(h[3:, 3:] + damping * np.eye(len(h) - 3), -g[3:], 1e-12)
        if step is None:
            break
        trial = [now[0], *[exp_so3(step[3 * k : 3 * k + 3]) @ r for k, r in enumerate(now[1:])]]
        h2, g2, cost2 = bundle_equations(matches, trial, huber)
        if cost2 < costs[-1]:
            done = costs[-1] - cost2 <= 1e-12 * costs[-1] or float(np.abs(step).max()) < 1e-10
            now, h, g, damping = trial, h2, g2, damping / 10
            costs.append(cost2)
            if done:
                break
        else:
            damping *= 10
            if damping > 1e6:
                break
    return now, costs


def rms_angle(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean square angle between vector structs p and q, in degrees."""
    from ..functions.geometry import angle

    a = F.degrees(angle(F.col("p"), F.col("q")))
    return matches.groupBy(*keys).agg(F.sqrt(F.avg(a * a)).alias("rms_deg"))


# --- response and vignetting ----------------------------------------------------------------------------

def response_curve(samples: DataFrame, levels: int = 256, smoothness: float = 40.0) -> list[float]:
    """samples: sample, encoded, rel -> a response table, rising, 1 at white.

    Unknown radiances are eliminated sample by sample before the solve: what reaches the driver are sums
    per level and pairs of levels, at most levels squared.
    """
    k = level(F.col("encoded"), levels)
    rows = samples.select("sample", k.alias("k"), F.ln("rel").alias("t")).withColumn("w2", F.pow(hat_weight(F.col("k"), levels), F.lit(2.0))).where("w2 > 0")
    per = rows.groupBy("sample").agg(F.sum("w2").alias("s0"), F.sum(F.col("w2") * F.col("t")).alias("s1"), F.collect_list(F.struct("k", "w2", "t")).alias("obs"))
    single = per.select("s0", "s1", F.explode("obs").alias("o")).groupBy(F.col("o.k").alias("k")).agg(F.sum("o.w2").alias("d"), F.sum(F.col("o.w2") * (F.col("o.t") - F.col("s1") / F.col("s0"))).alias("r"))
    cross = per.select("s0", "obs", F.explode("obs").alias("o")).select("s0", "o", F.explode("obs").alias("p")).groupBy(F.col("o.k").alias("i"), F.col("p.k").alias("j")).agg(F.sum(F.col("o.w2") * F.col("p.w2") / F.col("s0")).alias("c"))
    a, b = np.eye(levels) * 1e-9, np.zeros(levels)
    for s in single.collect():
        a[s["k"], s["k"]] += s["d"]
        b[s["k"]] += s["r"]
    for s in cross.collect():
        a[s["i"], s["j"]] -= s["c"]
    for i in range(1, levels - 1):
        row = np.zeros(levels)
        row[i - 1 : i + 2] = (smoothness, -2 * smoothness, smoothness)
        a += np.outer(row, row)
    a[levels // 2, levels // 2] += 1.0
    x = damped(a, b, 1e-10)
    lut = np.maximum.accumulate(np.exp(x))
    return (lut / lut[-1]).tolist()


def vignette(observations: DataFrame, rounds: int = 25) -> tuple[float, float]:
    """observations: r1, r2, ratio of the values at two radii -> (a2, a4) of 1 + a2 r^2 + a4 r^4, by damped steps."""
    a2, a4, damping, last = 0.0, 0.0, 1e-6, math.inf
    for _ in range(rounds):
        f1, f2 = (falloff(F.col(r) * F.col(r), a2, a4) for r in ("r1", "r2"))
        miss = F.ln(f1) - F.ln(f2) - F.ln("ratio")
        j = [F.pow("r1", F.lit(p)) / f1 - F.pow("r2", F.lit(p)) / f2 for p in (2.0, 4.0)]
        s = observations.agg(*[F.sum(x) for x in (j[0] * j[0], j[0] * j[1], j[1] * j[1], j[0] * miss, j[1] * miss, miss * miss)]).first()
        if s[0] is None or abs(last - s[5]) <= 1e-14 * max(s[5], 1e-300):
            break
        last = s[5]
        step = np.linalg.solve(np.array([[s[0] + damping, s[1]], [s[1], s[2] + damping]]), -np.array([s[3], s[4]]))
        a2, a4 = min(1.0, max(-1.0, a2 + step[0])), min(1.0, max(-1.0, a4 + step[1]))
    return a2, a4




def vignettes(observations: DataFrame, keys: list[str], rounds: int = 25) -> DataFrame:
    """observations: keys, r1, r2, ratio -> keys, a2, a4 of each scene; all scenes take their damped steps together.

    A round is one aggregate of six sums a scene; scenes' states are joined to their observations, the larger side,
    of which none is gathered.
    """
    from .graph import settle

    col = F.col
    state = settle(observations.select(*keys).distinct().withColumns({"a2": F.lit(0.0), "a4": F.lit(0.0)}), "vignette")
    for _ in range(rounds):
        f = lambda r: falloff(col(r) * col(r), col("a2"), col("a4"))
        seen = observations.join(state, keys).withColumns({"f1": f("r1"), "f2": f("r2")})
        miss = F.ln("f1") - F.ln("f2") - F.ln("ratio")
        j2, j4 = (F.pow("r1", F.lit(p)) / col("f1") - F.pow("r2", F.lit(p)) / col("f2") for p in (2.0, 4.0))
        s = seen.groupBy(*keys, "a2", "a4").agg(*[F.sum(x).alias(n) for n, x in (("h22", j2 * j2), ("h24", j2 * j4), ("h44", j4 * j4), ("g2", j2 * miss), ("g4", j4 * miss))])
        h22, h44 = col("h22") + 1e-9, col("h44") + 1e-9
        det = h22 * h44 - col("h24") * col("h24")
        d2, d4 = (col("h24") * col("g4") - h44 * col("g2")) / det, (col("h24") * col("g2") - h22 * col("g4")) / det
        bound = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
        state = settle(s.select(*keys, bound(col("a2") + d2).alias("a2"), bound(col("a4") + d4).alias("a4"), F.greatest(F.abs(d2), F.abs(d4)).alias("step")), "vignette")
        if (state.agg(F.max("step")).first()[0] or 0.0) < 1e-9:
            break
        state = state.drop("step")
    return state.select(*keys, "a2", "a4")


def flat_fields(values: DataFrame, keys: list[str]) -> DataFrame:
    """values: keys, r2 (squared radius, 1 at the corner), v of an evenly lit frame -> keys, level, a2, a4.

    v = level * (1 + a2 r^2 + a4 r^4) is linear in level and its multiples: five moments of the radius and three with
    the value, combined before the shuffle, then a 3 x 3 system in closed form; null where radii don't tell them apart.
    """
    r2, v = F.col("r2"), F.col("v")
    power = lambda k: r2 * power(k - 1) if k else F.lit(1.0)
    s = values.groupBy(*keys).agg(*[F.sum(power(k)).alias(f"m{k}") for k in range(5)], *[F.sum(power(k) * v).alias(f"b{k}") for k in range(3)])
    m = [[F.col(f"m{i + j}") for j in range(3)] for i in range(3)]
    b = [F.col(f"b{k}") for k in range(3)]
    det = lambda a: a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1]) - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0]) + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    solved = [F.try_divide(det([[b[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), det(m)) for k in range(3)]
    out = s.select(*keys, *[x.alias(f"x{k}") for k, x in enumerate(solved)])
    return out.select(*keys, F.col("x0").alias("level"), F.try_divide("x1", "x0").alias("a2"), F.try_divide("x2", "x0").alias("a4"))
