"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its 5-word shingles, each labelled with its occurrence number, so that all differ.
Each of BANDS hash functions samples the SAMPLE least of them and keeps these in text order: texts share such
a sample with the probability that all of it lies in both and in the same order. Texts of at most SHORT shingles
are also found by their rarest shingles: two sets of the least similarity must share one of these, as many as one may
lack of the other and one more. Texts that share a sample or such a shingle are compared with one of their bucket; where
that leaves a bucket in several groups, all texts outside the largest meet all others, block by block: exact counts of
words in common rule most pairs out, joined groups the rest, and a task returns only the links that join groups.
Similarity: words on the best common alignment over all words of both. It's never below that of aligned shingles,
and stays at 0.8 where scattered edits break many shingles. What is linked is decided by the alignment alone; shingles
only say which texts meet. An alignment of the least similarity cannot leave a diagonal band, and only the band is searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import cut, free_name, give_back, table
from .graph import components

WORDS = 5
SIMILARITY = 0.8
BANDS, SAMPLE = 64, 3  #: (1 - x**3)**64 of pairs with x of their shingles in common share no sample: 0.2 % at 0.45, 2 % at 0.38, 6 % at 0.35
SHORT = 64  #: pairs of which one has at most so many shingles are found for certain if these are 0.8 alike
TINY = 20  #: so are pairs of which one has at most so many, if these share one
LONGEST = int(SHORT / SIMILARITY + 1e-6)  #: what a short text can link with has no more
TINY_MEETS = int((TINY + WORDS - 1) / SIMILARITY + 1e-6) - WORDS + 1  #: nor has what a tiny one can link with
BROADCAST_ROWS = 1_000_000  #: ids of 24 bytes that are broadcast at most; more are joined by shuffle
CACHE_ENTRIES = 200_000
ROWS_OUT = 2000  #: rows that a task hands on at once
CHUNK = 8192
BLOCK = 512  #: texts of a side of a block
SMALL = 128  #: texts of a bucket that is compared as a whole, side by side with others
LUMP = 4096  #: texts of small buckets that a task takes at once, about
COLUMNS = 1024  #: values that a block counts at once
FEW_OWNERS = 24  #: texts up to which a value is counted pair by pair

_rng = np.random.default_rng(5)
_FACTOR = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
_TERM = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_KNOWN: dict[str, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[str]) -> np.ndarray:
    if len(_KNOWN) > CACHE_ENTRIES:
        _KNOWN.clear()
    try:
        got = list(map(_KNOWN.__getitem__, words))
    except KeyError:
        for w in words:
            if w not in _KNOWN:
                _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
        got = list(map(_KNOWN.__getitem__, words))
    return np.array(got, dtype=np.uint64)


def shingles(h: np.ndarray) -> np.ndarray:
    """64-bit hashes of the occurrence-labelled shingles of hashed words, in text order; fewer than WORDS words are one."""
    if not len(h):
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(h) - WORDS + 1)
    s = np.zeros(n, dtype=np.uint64)
    for k in range(min(WORDS, len(h))):
        s = s * _P + h[k : k + n]
    return labelled(_mixed(s))


def labelled(s: np.ndarray) -> np.ndarray:
    """Hashes that repeat are told apart by their occurrence number."""
    n = len(s)
    if len(np.unique(s)) < n:
        order = np.argsort(s, kind="stable")
        new = np.concatenate([[True], s[order][1:] != s[order][:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        occurrence = np.empty(n, dtype=np.uint64)
        occurrence[order] = (np.arange(n) - first).astype(np.uint64)
        s = _mixed(s + occurrence * np.uint64(0xD6E8FEB86659FD93))
    return s


def sketch(s: np.ndarray) -> list[int]:
    """One key for each band, of its least shingles in text order; none for a text without words."""
    if not len(s):
        return []
    picked = []
    for at in range(0, len(s), CHUNK):  # a long text leaves its least of each chunk
        part = s[at : at + CHUNK, None] * _FACTOR + _TERM
        part ^= part >> np.uint64(32)
        picked.append(np.argpartition(part, SAMPLE - 1, axis=0)[:SAMPLE] + at if len(part) > SAMPLE else np.repeat(np.arange(at, at + len(part))[:, None], BANDS, axis=1))
    rows = np.concatenate(picked)
    if len(rows) > SAMPLE:
        part = s[rows] * _FACTOR + _TERM
        part ^= part >> np.uint64(32)
        rows = np.take_along_axis(rows, np.argpartition(part, SAMPLE - 1, axis=0)[:SAMPLE], axis=0)
    rows = np.sort(rows, axis=0)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in rows:
        key = _mixed(key * _P + s[row])
    return key.astype(np.int64).tolist()


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Words on the longest common subsequence whose positions differ by at most `band`.

    What both begin and end with is taken off; the rest goes bit by bit, a whole row of the table in a few operations
    on long integers.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    lead = int(differ[0]) if len(differ) else n
    a, b, n = a[lead:], b[lead:], n - lead
    differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
    tail = n - 1 - int(differ[-1]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return lead + tail
    at: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        at[w] = at.get(w, 0) | 1 << i
    whole, reach = (1 << len(a)) - 1, (1 << 2 * band + 1) - 1
    row = whole
    for j, w in enumerate(b.tolist()):
        met = at.get(w, 0) & (reach << j - band if j >= band else reach >> band - j)
        if met:
            met &= row
            row = (row + met | row - met) & whole
    return lead + tail + len(a) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY, words: int | None = None) -> float:
    """Aligned words over all words of both, as far as it is `least` or more; else a lower figure.

    a, b: hashed words. words: those in common, in any order, if counted before.
    """
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    if words is None:
        words = len(np.intersect1d(labelled(a), labelled(b), assume_unique=True))
    if words * (1 + least) < least * (na + nb) - 1e-9:  # aligned ones can't exceed these
        return 0.0
    m = aligned(a, b, int((na + nb) * (1 - least) / (1 + least)) + 1)
    return m / (na + nb - m)


def _fingerprint(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        out = []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            words = text.lower().split()
            s = shingles(_word_hashes(words))
            bands = sketch(s)
            every = s.astype(np.int64).tolist() if len(s) <= LONGEST else []
            out.append((doc_id, part << 40 | row, _fingerprint(words), len(s), bands, every))
            row += 1
        for k in range(0, len(out), ROWS_OUT):
            yield pd.DataFrame(out[k : k + ROWS_OUT], columns=["doc_id", "row", "fp", "n", "bands", "every"]).astype({"doc_id": "Int64"})
    _KNOWN.clear()
    give_back()


def _sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, fp in zip(batch["text"], batch["fp"], strict=True):
            words = text.lower().split()
            if _fingerprint(words) == bytes(fp):  # else a row that only shares its id
                out.append((fp, (_word_hashes(words) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        yield pd.DataFrame(out, columns=["fp", "seq"])
    _KNOWN.clear()
    give_back()


def _words(seq: np.ndarray) -> np.ndarray:
    return seq.view(np.uint32).astype(np.uint64)


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hit = [similarity(_words(x), _words(y)) >= SIMILARITY for x, y in zip(batch["sa"], batch["sb"], strict=True)]
        yield batch.loc[hit, ["a", "b"]]


def common(seqs: list[np.ndarray]) -> np.ndarray:
    """How many values each two of these share; a sequence holds no value twice.

    Values of a few sequences count pair by pair, those of many as columns of a product.
    """
    n = len(seqs)
    owner = np.repeat(np.arange(n), [len(x) for x in seqs])
    _, column, count = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, of = owner[order], count[column[order]]  # values one after the other, each with its owners, rising
    out = np.zeros(n * n, dtype=np.float32)
    for k in np.unique(of[(of > 1) & (of <= FEW_OWNERS)]).tolist():
        rows = owner[of == k].reshape(-1, k)
        i, j = np.triu_indices(k, 1)
        out += np.bincount((rows[:, i] * n + rows[:, j]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    many = of > FEW_OWNERS
    owner, at = owner[many], np.cumsum(np.diff(column[order][many], prepend=-1) != 0) - 1
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        a, b = np.searchsorted(at, (first, first + COLUMNS))
        has = np.zeros((n, COLUMNS), dtype=np.float32)
        has[owner[a:b], at[a:b] - first] = 1
        out += np.triu(has @ has.T, 1)
    return out + out.T


def _linked(seqs: list[np.ndarray], own: list[np.ndarray], group: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between texts of different groups that join these; groups that were joined before need no more.

    own: the labelled words of each. Those in common, which aligned ones can't exceed, are counted for all pairs at once.
    """
    n = np.array([len(x) for x in seqs])
    both = common(own)
    apart = group[:, None] != group[None, :]
    i, j = np.nonzero(np.triu(apart, 1) & (both * (1 + SIMILARITY) >= SIMILARITY * (n[:, None] + n[None, :]) - 1e-3))
    nearest = np.argsort(-both[i, j] / (n[i] + n[j]), kind="stable")  # likely links first: they join groups
    for a, b in zip(i[nearest].tolist(), j[nearest].tolist(), strict=True):
        if group[a] != group[b] and similarity(seqs[a], seqs[b], words=int(both[a, b])) >= SIMILARITY:
            group[group == group[b]] = group[a]
            yield a, b


def _join_groups(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("fp", ignore_index=True)
    seqs = [_words(x) for x in pdf["seq"]]
    group = np.unique(pdf["root"], return_inverse=True)[1]
    out = [(pdf["fp"][a], pdf["fp"][b]) for a, b in _linked(seqs, [labelled(x) for x in seqs], group)]
    return pd.DataFrame(out, columns=["a", "b"])


def _join_small(pdf: pd.DataFrame) -> pd.DataFrame:
    """Many small buckets; a text comes once, with the keys of all that hold it."""
    pdf = pdf.sort_values("fp", ignore_index=True)
    seqs = [_words(x) for x in pdf["seq"]]
    words = [labelled(x) for x in seqs]
    group = np.unique(pdf["root"], return_inverse=True)[1]
    sizes = [len(k) for k in pdf["keys"]]
    key, row = np.concatenate(list(pdf["keys"])), np.repeat(np.arange(len(pdf)), sizes)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    out = []
    for members in np.split(row, cuts):
        own = group[members]
        if len(members) > 1 and (own != own[0]).any():
            for a, b in _linked([seqs[k] for k in members], [words[k] for k in members], own):
                x, y = members[a], members[b]
                out.append((pdf["fp"][x], pdf["fp"][y]))
                group[group == group[y]] = group[x]
    return pd.DataFrame(out, columns=["a", "b"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted rows are few; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _links(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    with_a = pairs.join(seqs.select(F.col("fp").alias("a"), F.col("seq").alias("sa")), "a")
    return with_a.join(seqs.select(F.col("fp").alias("b"), F.col("seq").alias("sb")), "b").select("a", "b", "sa", "sb").mapInPandas(_verify, "a binary, b binary")


def _rarest(classes: DataFrame) -> DataFrame:
    """fp, n, key of short texts: a bucket for each of a text's rarest shingles.

    A text of n shingles lacks at most n / 5 of those of another at 0.8, so of any n / 5 + 1 one is in both; in
    one order for all texts the first so many of both share one. A tiny text, and what it can link with, has a bucket for
    each. Shingles of one text alone come first and make no bucket, so that only their number counts.
    """
    each = classes.where(F.size("every") > 0).select("fp", "n", F.explode("every").alias("s"))
    shared = each.groupBy("s").count().where("count > 1")
    rare = each.join(shared, "s").groupBy("fp", "n").agg(F.sort_array(F.collect_list(F.struct("count", "s"))).alias("rare"))
    lacks = F.when(F.col("n") <= TINY_MEETS, F.col("n") - 1).otherwise(F.col("n") * (1 - SIMILARITY))
    first = F.floor(lacks + 1e-6).cast("int") + 1
    room = F.greatest(first - F.col("n") + F.size("rare"), F.lit(0))
    return rare.select("fp", "n", F.explode(F.slice("rare", F.lit(1), room)).alias("r")).select("fp", "n", F.xxhash64(F.lit(-1), "r.s").alias("key"))


def _sequences_of(texts: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: fp, each once -> fp, seq: the hashed words of these texts."""
    chosen = cut(classes.join(ids, "fp").select("fp", F.col("first.doc_id").alias("doc_id")), "chosen")
    named = texts.join(_few(chosen.where("doc_id is not null")), "doc_id").select("text", "fp")
    keyed = texts.where("doc_id is null").select("text").mapInPandas(_fingerprints(["text"]), "text string, dedup_fp binary")  # found by their words
    unnamed = keyed.join(_few(chosen.where("doc_id is null").select("fp")), F.col("dedup_fp") == F.col("fp")).select("text", "fp")
    return cut(named.unionByName(unnamed).mapInPandas(_sequences, "fp binary, seq array<int>").dropDuplicates(["fp"]), "sequences")


def _crossing(at: DataFrame, seqs: DataFrame) -> DataFrame:
    """at: key, hub, fp, root, main, all, most: texts of buckets in several groups -> links that join groups.

    Small buckets are compared whole, those of one hub in one task, where a text comes once. In others, texts outside a bucket's main group form blocks, and so do those in it; a task holds two blocks, of which
    one is outside, so the main group never meets itself.
    """
    few = at.where(F.col("all") <= SMALL)
    lumps = max(1, math.ceil(few.count() / LUMP))
    small = few.groupBy(F.pmod(F.xxhash64("hub"), F.lit(lumps)).alias("lump"), "fp", "root").agg(F.collect_list("key").alias("keys"))
    joined = small.join(seqs, "fp").groupBy("lump").applyInPandas(_join_small, "a binary, b binary")
    outside = F.col("root") != F.col("main")
    blocks = at.where(F.col("all") > SMALL).withColumns({"no": F.ceil((F.col("all") - F.col("most")) / BLOCK), "nm": F.ceil(F.col("most") / BLOCK)})
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("fp"), F.when(outside, F.col("no")).otherwise(F.col("nm"))))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    with_main = F.transform(upto("nm"), lambda k: pair(F.col("own"), -1 - k))
    with_others = F.transform(F.filter(upto("no"), lambda k: k != F.col("own")), lambda k: pair(F.least(k, F.col("own")), F.greatest(k, F.col("own"))))
    tasks = F.when(outside, F.concat(with_main, with_others)).otherwise(F.transform(upto("no"), lambda k: pair(k, -1 - F.col("own"))))
    dealt = blocks.select("key", "fp", "root", F.explode(tasks).alias("t"))
    return joined.unionByName(dealt.join(seqs, "fp").groupBy("key", "t.i", "t.j").applyInPandas(_join_groups, "a binary, b binary"))


def mark(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text -> doc_id, row, fp, root, class_id, group_id, kept, one row per row.

    class_id: least doc_id with the same words in lower case; group_id: least doc_id reachable over links of
    similarity 0.8 or more; texts of any length are compared whole, in time that grows with the square of theirs only
    between the first and the last word in which two differ; kept marks one row of each group. Null or empty texts, and those of white space,
    are one class, link with nothing and are all kept. Of repeated rows the first counts as least. Rows with
    a null doc_id take part, after all others of their group. root is one fp of the group, null without words. An
    empty table gives none.
    """
    texts = _texts(docs)
    rows = cut(texts.mapInPandas(_sketches, "doc_id long, row long, fp binary, n int, bands array<long>, every array<long>"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    classes = cut(rows.where("n > 0").groupBy("fp").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("every").alias("every")), "classes")
    entries = classes.select("fp", "n", F.posexplode("bands").alias("band", "key")).select("fp", "n", F.xxhash64("band", "key").alias("key"))
    entries = entries.unionByName(_rarest(classes))
    least = F.min(F.struct("fp", "n"))
    full = entries.groupBy("key").agg(least["fp"].alias("hub"), least["n"].alias("hub_n"), F.max("fp").alias("other")).where("hub <> other").drop("other")
    entries = cut(entries.join(full, "key"), "entries")  # of buckets that hold several texts
    words = lambda n: F.col(n) + (WORDS - 1)
    comparable = F.least(words("n"), words("hub_n")) >= SIMILARITY * F.greatest(words("n"), words("hub_n"))
    pairs = cut(entries.where((F.col("fp") != F.col("hub")) & comparable).select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct(), "pairs")
    met = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    links = cut(_links(pairs, _sequences_of(texts, classes, met)), "links")
    roots = components(links)

    at = entries.select("key", "hub", "fp").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = at.groupBy("key", "root").count()
    mixed = groups.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("all"), F.max("count").alias("most")).where("most < all")
    at = cut(at.join(mixed, "key"), "mixed")
    more = cut(_crossing(at, _sequences_of(texts, classes, at.select("fp").distinct())), "links")
    roots = components(links.unionByName(more))

    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    grouped = grouped.join(best, "root").select("fp", "root", F.col("first.doc_id").alias("class_id"), "best")
    least = rows.where("n = 0").agg(F.min("doc_id")).first()[0]
    worded = rows.where("n > 0").join(grouped, "fp").select("doc_id", "row", "fp", "root", "class_id", F.col("best.doc_id").alias("group_id"), (F.col("row") == F.col("best.row")).alias("kept"))
    blank = rows.where("n = 0").select("doc_id", "row", "fp", F.lit(None).cast("binary").alias("root"), F.lit(least).cast("long").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(True).alias("kept"))
    return worded.unionByName(blank)


def _fingerprints(columns: list[str], name: str = "dedup_fp"):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = [_fingerprint((t or "").lower().split()) for t in batch["text"]]
            yield batch.assign(**{name: prints})[[*columns, name]]

    return run


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents, all columns, of which one of each group stays; those without words all stay.

    It is the one that `mark` keeps, but in a group with null ids it is one of these, as such rows have always stayed.
    Rows whose doc_id is null or repeated are told apart by their words. Columns may have any names.
    """
    marks = cut(mark(docs), "marks")
    unnamed = marks.where("doc_id is null and root is not null").groupBy("root").agg(F.min("row").alias("one"))
    if unnamed.limit(1).count():
        marks = marks.join(_few(unnamed), "root", "left").withColumn("kept", F.when(F.col("one").isNull(), F.col("kept")).otherwise(F.col("row") == F.col("one")))
    several = marks.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id")
    gone = marks.where("not kept").select("doc_id").where("doc_id is not null").distinct()
    if not several.limit(1).count():
        return docs.join(_few(gone), "doc_id", "left_anti").select(docs.columns)
    name, kept_id, kept_fp = (free_name(docs, f"dedup_{k}") for k in ("fp", "id", "kept"))
    repeated = several.where("doc_id is not null")
    plain = docs.where("doc_id is not null").join(repeated, "doc_id", "left_anti").join(_few(gone), "doc_id", "left_anti")
    keep = marks.where("kept").select(F.col("doc_id").alias(kept_id), F.col("fp").alias(kept_fp)).distinct()
    kind = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    again = docs.join(repeated, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))
    again = again.mapInPandas(_fingerprints(docs.columns, name), kind)
    wordless = F.col(name) == F.lit(_fingerprint([]))
    first = again.where(~wordless).dropDuplicates(["doc_id", name])
    first = first.join(keep, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(name) == F.col(kept_fp)), "left_semi")
    return plain.select(docs.columns).unionByName(first.select(docs.columns)).unionByName(again.where(wordless).select(docs.columns))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "group_id", "kept")
