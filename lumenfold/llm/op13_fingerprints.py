"""Document fingerprints by content-defined chunking.

A gear hash runs over a text's UTF-8 bytes. A chunk ends where the hash meets a mask: a strict one before the normal
length, a loose one behind it, so lengths keep near the normal one, and boundaries follow the content wherever it
is moved to. A fingerprint is the set of chunk digests with their lengths; the share of a text's length whose chunks
another text has measures how far it is contained there.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

LEAST, NORMAL, MOST = 16, 64, 256  #: bytes of a chunk; the last of a text may be shorter
STRICT, LOOSE = 8, 4  #: bits of the hash that must be zero before the normal length and behind it
WINDOW = 32  #: bytes that the hash depends on, and its bits
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), seed=13) for b in range(256)], dtype=np.uint32)
STRETCH = 1 << 22  #: bytes hashed at once
FLUSH = 256  #: rows of an output batch
PER_PART = 2  #: runs of documents a partition

OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def gear(data: bytes) -> np.ndarray:
    """At each byte, the sum of the gear values of the last WINDOW bytes, each shifted by its age, modulo 2^32."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    span = 1
    while span < WINDOW:  # sums over twice as many bytes from two over half of them
        h[span:] = h[span:] + (h[:-span] << np.uint32(span))
        span *= 2
    return h


def candidates(data: bytes) -> tuple[list[int], list[int]]:
    """Ends (exclusive) at which the strict mask fits, and at which the loose one does; a stretch begins with what the hash still sees."""
    strict, loose = [], []
    for s in range(0, len(data), STRETCH):
        before = min(s, WINDOW - 1)
        top = gear(data[s - before : s + STRETCH])[before:] >> np.uint32(32 - STRICT)  # the top bits depend on the whole window
        at = np.flatnonzero(top >> np.uint32(STRICT - LOOSE) == 0)
        loose += (at + s + 1).tolist()
        strict += (at[top[at] == 0] + s + 1).tolist()
    return strict, loose


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks; the last is the text's."""
    strict, loose = candidates(data)
    ends, start, n, i, j = [], 0, len(data), 0, 0
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST, i)
        end = strict[i] if i < len(strict) and strict[i] < start + NORMAL else 0
        if not end:
            j = bisect_left(loose, start + NORMAL, j)
            end = min(loose[j] if j < len(loose) else n, start + MOST, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> dict[int, int]:
    """Length in bytes by digest of each distinct chunk."""
    data, out, start = text.encode("utf-8", "replace"), {}, 0
    for end in boundaries(data):
        out[xxhash.xxh3_64_intdigest(data[start:end])] = end - start
        start = end
    return out


def written(chunks: dict[int, int]) -> str:
    """digest:length, by digest, comma-joined."""
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the length of a's chunks that b has too; of two empty ones 1, of one 0."""
    if not a or not b:
        return float(a == b)
    return sum([n for d, n in a.items() if d in b]) / sum(a.values())


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs, each closed by a guest: the document that follows its last."""
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    done: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        done.clear()
        return out

    waiting = None  # the document before, until the one that follows it is seen
    for batch in batches:
        for k in range(batch.num_rows):
            part, guest, doc_id, text = (batch.column(c)[k].as_py() for c in range(4))
            if guest and (waiting is None or waiting[0] != part):
                continue  # of repeated guests the first one follows
            chunks = fingerprint(text)
            if waiting is not None and waiting[0] == part:
                _, own_id, own, mine = waiting
                changed = edited(own, text)
                new = fingerprint(changed)
                sha = hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest()
                done.append((own_id, len(own), sha, written(mine), written(new), containment(mine, new), containment(mine, chunks)))
                if len(done) >= FLUSH:
                    yield flushed()
            waiting = None if guest else (part, doc_id, text, chunks)
        give_back()
    if done:
        yield flushed()


def _key(doc_id: Column, text: Column) -> Column:
    """Ascending in this order, documents descend by doc_id, null last; those of one id go by a hash of the text."""
    return F.struct(doc_id.isNull().alias("none"), F.coalesce(F.bitwise_not(doc_id), F.lit(0)).cast("long").alias("id"), F.xxhash64(text).alias("hash"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty, their fingerprints too; near an empty one is only another. Documents follow each other by
    descending doc_id, null last, those of one id by a hash of the text; repeated rows follow each other; after the last comes the first,
    which a lone document follows itself. Other columns aren't read. An empty table gives none.

    Runs of that order begin with documents that exist: the first of each range of a sort of the keys alone. Texts are
    shuffled once, and the first of a run goes to the run before as well, so that it closes it.
    """
    spark = docs.sparkSession
    parts = PER_PART * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", _key(F.col("doc_id"), F.col("text")))
    ranges = rows.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("key").alias("key"))
    starts = sorted([(r["key"]["none"], r["key"]["id"], r["key"]["hash"]) for r in ranges.collect()])  # a key a range
    if not starts:
        return spark.createDataFrame([], OUT)
    firsts = F.array(*[F.struct(F.lit(a).alias("none"), F.lit(b).cast("long").alias("id"), F.lit(c).cast("long").alias("hash")) for a, b, c in starts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])  # binary search
    part = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get(firsts, low + s) <= F.col("key"), low + s).otherwise(low))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))
    guest = F.struct(((F.col("part") + (len(starts) - 1)) % len(starts)).alias("part"), F.lit(True).alias("guest"))
    placed = rows.withColumn("part", part).withColumn("at", F.explode(F.when(F.get(firsts, F.col("part")) == F.col("key"), F.array(own, guest)).otherwise(F.array(own))))
    dealt = placed.select("at.part", "at.guest", "key", "doc_id", "text").repartitionById(parts, "part").sortWithinPartitions("part", "guest", "key", "text")
    return dealt.select("part", "guest", "doc_id", "text").mapInArrow(_fingerprinted, OUT)


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))
