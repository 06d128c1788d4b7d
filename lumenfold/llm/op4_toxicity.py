"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Training reads a bounded, documented sample of the labelled rows, in one streaming task; per-coordinate rates
and the L1 term leave few weights, at most 2**BITS, which are broadcast. Scoring reads every text, whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, table

BITS = 20  #: log2 of the number of coordinates, so at most 2**20 weights of 12 bytes are broadcast
MOST_POSITIVE, MOST_NEGATIVE = 6000, 9000  #: labelled rows to learn from, those of smallest hash
ALPHA, BETA, L1, L2, EPOCHS = 5.0, 1.0, 6.0, 0.01, 10
CUT = 0.7  #: least score that predicts 1
CACHE_ENTRIES = 200_000
CHUNK = 1 << 18  #: words that are hashed at once

_WORD = re.compile(r"\w+")
_MASK = np.uint64((1 << BITS) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


class Features:
    """The set of coordinates of a text: words, neighbouring pairs, and pairs with one word between."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        try:
            got = list(map(known.__getitem__, words))
        except KeyError:
            for w in words:
                if w not in known:
                    raw = w.encode()
                    known[w] = zlib.crc32(raw) | zlib.adler32(raw) << 32
            got = list(map(known.__getitem__, words))
        return np.array(got, dtype=np.uint64)

    def of(self, text: str) -> np.ndarray:
        words = _WORD.findall(text.lower())
        found = [np.empty(0, dtype=np.uint64)]
        for at in range(0, len(words), CHUNK):  # two words overlap, so no pair is lost
            h = self._hashes(words[max(0, at - 2) : at + CHUNK])
            pair = h[:-1] * np.uint64(0xFF51AFD7ED558CCD) + h[1:]
            skip = h[:-2] * np.uint64(0xC4CEB9FE1A85EC53) + h[2:] + np.uint64(1)
            found.append(np.unique(_mixed(np.concatenate([h, pair, skip]))))
        return (found[1] if len(found) == 2 else np.unique(np.concatenate(found))).astype(np.int64)


class Ftrl:
    """FTRL-proximal with a learning rate for each coordinate; a coordinate is 1 where present."""

    def __init__(self, bits: int = BITS) -> None:
        self.z = np.zeros((1 << bits) + 1)  # the last is the bias
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + math.exp(-max(-35.0, min(35.0, w.sum())))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features, model, seen = Features(), Ftrl(), []
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            seen.append((features.of(text).astype(np.int32), int(label)))
            model.learn(*seen[-1])
    for _ in range(EPOCHS - 1):
        for at, label in seen:
            model.learn(at, label)
    at = np.arange(len(model.z))
    w = model.weights(at)
    yield pd.DataFrame({"at": at[w != 0], "weight": w[w != 0]})


def train(labelled: DataFrame) -> dict[int, float]:
    """labelled: text, label (0/1), bounded by the caller -> weights other than 0; the bias is at 2**BITS."""
    rows = labelled.select("text", "label").repartition(1).sortWithinPartitions(F.xxhash64("text"), "label")
    return {r["at"]: r["weight"] for r in cut(rows.mapInPandas(_train, "at long, weight double"), "weights").collect()}


def _scorer(weights: Broadcast, bias: float) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, dense = Features(), np.zeros(1 << BITS)
        at, weight = weights.value
        dense[at] = weight
        for texts in batches:
            z = np.array([dense[features.of(t)].sum() for t in texts]) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -35, 35))))
        give_back()

    return score


def sample(labels: DataFrame) -> tuple[DataFrame, float]:
    """labels: doc_id, toxic -> (rows to learn from: doc_id, label; shift of the log odds to the true rate).

    Repeated labels of a document count once, as toxic if any says so; rows without one are left out.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.where("label = 1").orderBy(*order).limit(MOST_POSITIVE).unionByName(known.where("label = 0").orderBy(*order).limit(MOST_NEGATIVE))
    pos, neg = count.get(1, 0), count.get(0, 0)
    if not pos or not neg:
        return picked, 0.0
    return picked, math.log(pos / neg) - math.log(min(pos, MOST_POSITIVE) / min(neg, MOST_NEGATIVE))


def score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """docs: doc_id, text; labels: doc_id, toxic, only those that may be learnt from -> docs with a score,
    as a column of this name; one that was there is replaced.

    One row per row, ties and repeats included; null text counts as empty, and empty texts get the bias; texts of
    any length are read whole, in chunks. Without labels all scores are one half; an empty table gives none.
    Columns may have any names. The sample is joined by broadcast: its size is bounded above. One text per
    doc_id is learnt from, so the training task reads MOST_POSITIVE + MOST_NEGATIVE texts at most.
    """
    picked, shift = sample(labels)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))  # of rows that share a doc_id, chosen where they lie
    met = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), one.alias("one"))
    weights = train(met.select(F.col("one.text").alias("text"), "label"))
    bias = weights.pop(1 << BITS, 0.0) + shift
    shared = docs.sparkSession.sparkContext.broadcast((np.array(list(weights), dtype=np.int64), np.array(list(weights.values()), dtype=float)))
    return docs.withColumn(name, F.pandas_udf(_scorer(shared, bias), "double")(F.coalesce("text", F.lit(""))))


def held_out() -> Column:
    """Rows that are never learnt from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out())
    scored = score(table(spark, sf_dir, "documents", "doc_id", "text"), labels)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
