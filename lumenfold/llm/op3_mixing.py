"""Mixing sources to target weights by pivotal dependent rounding over a reduction tree.

Every document of a source should be copied target / size times. The whole part is certain; the fractions are
rounded by pivotal steps: two fractions meet, mass moves between them at random, so that their words stay the
same in sum and on average in each, until one is 0 or 1. A block of documents leaves one fraction; those meet
in the next level's blocks, and so on to one per source. That last one is rounded at random, and what this is off
is made good by flipping others of the last block, largest first. A source thus misses its target by less than
one document, however large it is, and no task holds more than a block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, free_name, indexed, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BLOCK = 1024  #: fractions that one task rounds together
SEED = 20240607
ALIKE = 10_000  #: rows alike in doc_id, source and size that one task makes from their count in a run


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """sources: source, source_size, items -> also index and target, by raising the water level round by round.

    Only sums over sources reach the driver; each round caps every source that the level passes.
    """
    share = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("index") % len(weights) + 1).cast("int"))
    by = cut(indexed(sources, F.col("source").asc_nulls_last()).withColumn("weight", share), "sources")
    limit = F.lit(float(most)) * F.col("source_size")
    whole, weight = by.agg(F.sum("source_size").cast("double"), F.sum("weight")).first()
    level, capped = (whole or 0.0) / (weight or 1.0), -1
    while True:
        over = F.col("weight") * F.lit(level) > limit
        n, taken, left = by.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not left:
            break
        level, capped = (whole - taken) / left, n
    return by.withColumn("target", F.least(F.col("weight") * F.lit(level), limit)).drop("weight")


def pivotal(size: np.ndarray, part: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Fractions in (0, 1) of documents of these sizes -> 0, 1, and for one document at most a fraction."""
    out = part.copy()
    draws = rng.random(len(part) + 1)
    i = -1
    for j in range(len(out)):
        if not 0 < out[j] < 1:
            continue
        if i < 0:
            i = j
            continue
        si, sj, xi, xj = size[i], size[j], out[i], out[j]
        up, down = min((1 - xi) * si, xj * sj), min((1 - xj) * sj, xi * si)
        if draws[j] * (up + down) < down:  # i gains what j gives
            full, empty = (1 - xi) * si <= xj * sj, (1 - xi) * si >= xj * sj
            out[i], out[j] = (1.0 if full else min(xi + up / si, 1.0)), (0.0 if empty else max(xj - up / sj, 0.0))
        else:
            full, empty = (1 - xj) * sj <= xi * si, (1 - xj) * sj >= xi * si
            out[j], out[i] = (1.0 if full else min(xj + down / sj, 1.0)), (0.0 if empty else max(xi - down / si, 0.0))
        i = i if 0 < out[i] < 1 else j if 0 < out[j] < 1 else -1
    if last and i >= 0:
        raised = draws[-1] < out[i]
        off = ((1 - out[i]) if raised else out[i]) * size[i]
        out[i] = float(raised)
        for j in np.argsort(-size, kind="stable"):  # others of this task make good what the last one's rounding is off
            if j != i and 0 < part[j] < 1 and out[j] == float(raised) and size[j] <= off:
                out[j], off = 1.0 - out[j], off - size[j]
    return out


def _rounding(seed: int, level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def rounded(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "doc_id"], ascending=False, ignore_index=True, kind="stable")
        rng = np.random.default_rng([seed, level, int(key[0]), int(key[1])])
        return pdf.assign(part=pivotal(pdf["size"].to_numpy(float), pdf["part"].to_numpy(float), rng, last))

    return rounded


def allot(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """docs: doc_id, source, size -> these, rows (how many are alike), source_size, target and total copies of all rows.

    Null source is a source, the last; null or empty texts have size 0 and are not copied; an empty table gives
    none. Draws depend on the rows alone, not on how they are partitioned, so reruns agree.
    """
    items = cut(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), "items")
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("items"))
    by = cut(targets(sources, weights, most).withColumnRenamed("source", "of"), "targets")
    largest = by.agg(F.max("items")).first()[0] or 0
    copies = F.when(F.col("source_size") > 0, F.col("rows") * (F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    todo = (
        items.join(by, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("f", copies)
        .withColumns({"base": F.floor("f").cast("long"), "blocks": F.ceil(F.col("items") / BLOCK).cast("long")})
        .withColumns({"part": F.when(F.col("size") > 0, F.col("f") - F.col("base")).otherwise(F.lit(0.0)), "block": F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), F.col("blocks"))})
        .select("doc_id", "source", "size", "rows", "source_size", "target", "base", F.col("index").cast("long").alias("index"), "block", "part")
    )
    done = None
    blocks, level = math.ceil(largest / BLOCK), 0
    while True:
        last = blocks <= 1
        now = cut(todo.groupBy("index", "block").applyInPandas(_rounding(seed, level, last), todo.schema), "rounded")
        whole = now.where(F.col("part").isin(0.0, 1.0))
        done = whole if done is None else done.unionByName(whole)
        if last:
            break
        todo = now.where(~F.col("part").isin(0.0, 1.0)).withColumn("block", F.floor(F.col("block") / BLOCK).cast("long"))
        blocks, level = math.ceil(blocks / BLOCK), level + 1
    return done.withColumn("total", F.col("base") + F.col("part").cast("long")).drop("base", "part", "index", "block")


def _share(i: Column, rows: str = "rows", total: str = "total") -> Column:
    """The copies of the i-th of `rows` rows alike, from 1: as even as whole numbers can be."""
    return (F.floor(F.col(total) / F.col(rows)) + F.when(i <= F.col(total) % F.col(rows), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """docs: doc_id, source, size -> one row per row, repeats included: and source_size, target, taken, copies.

    Rows that are alike come back from their count, in runs of ALIKE that are dealt out anew where one has more.
    """
    sums = cut(allot(docs, weights, most, seed), "sums")
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"), F.lit(ALIKE).cast("long")))
    runs = sums.withColumn("first", first)
    if sums.where(F.col("rows") > ALIKE).limit(1).count():
        runs = runs.repartition("doc_id", "source", "size", "first")
    rows = runs.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + (ALIKE - 1), F.col("rows")))))
    copied = rows.withColumn("copies", _share(F.col("i")))
    return copied.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def apply(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED) -> DataFrame:
    """The documents, all columns, each as often as the mix copies it; 0 times leaves it out.

    Columns may have any names. Rows, nulls and empty texts as in `allot`; rows that are alike in doc_id, source
    and size share their copies as evenly as whole numbers can be, in the order of a hash of all they hold. The plan has a row per document, so it's never
    broadcast: texts move once, to where a table of the plan's rows is held, at every size. An empty table gives none.
    """
    of = {name: free_name(docs, f"mix_{name}") for name in ("id", "source", "words", "rows", "total", "size", "copies", "copy")}
    sized = docs.withColumn(of["size"], words_in(F.col("text")))
    plan = allot(sized.select("doc_id", "source", F.col(of["size"]).alias("size")), weights, most, seed).where("total > 0")
    plan = plan.select(*[F.col(a).alias(of[b]) for a, b in (("doc_id", "id"), ("source", "source"), ("size", "words"), ("rows", "rows"), ("total", "total"))])
    plan = cut(plan, "plan")
    same = F.col("doc_id").eqNullSafe(F.col(of["id"])) & F.col("source").eqNullSafe(F.col(of["source"])) & (F.col(of["size"]) == F.col(of["words"]))
    met = sized.join(plan.hint("shuffle_hash"), same)
    alike = F.lit(1)
    if plan.where(F.col(of["rows"]) > 1).limit(1).count():
        alike = F.row_number().over(Window.partitionBy("doc_id", "source", of["size"]).orderBy(F.xxhash64(*docs.columns), "text"))
    copied = met.withColumn(of["copies"], _share(alike, of["rows"], of["total"])).where(F.col(of["copies"]) > 0)
    return copied.withColumn(of["copy"], F.explode(F.sequence(F.lit(1).cast("long"), F.col(of["copies"])))).select(docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))).drop("source")
