"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into pieces of a whole window, which fill one each, and a rest, cut evenly into
pieces of at most `piece`. Rests are dealt into blocks; within a block, every piece starts as a partial
partition over k windows, and the two partitions of largest imbalance merge again and again, the fullest
windows of one with the emptiest of the other, until one partition is left. If its fullest window exceeds the
capacity, the block gets more windows and starts anew. Cuts depend on a document alone, so each piece's
checksum is taken where the document is tokenized, and ids never move.
"""

from __future__ import annotations

import heapq
import math
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table

WINDOW = 2048
PIECE = 512  #: most ids of a piece of a rest
END_ID = 1
DOCS_PER_BLOCK = 512
CACHE_ENTRIES = 600_000  #: parts of about 200 bytes that a worker keeps
STRETCH = 1 << 20  #: characters that are split at once

#: What the tokenizer's splitting takes for white space, and Latin letters.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_L = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
#: Parts of a text that begin and end where the tokenizer's splitting always breaks: Latin letters, ASCII marks or
#: digits with the blank before them, if what follows can't belong to them (an apostrophe can); all but the last
#: of several white spaces; else all up to the next white space.
_PART = re.compile(
    rf" ?[{_L}]++(?=[\x00-&(-\x7f]|\Z)| ?[!-&(-/:-@\[-`{{-~]++(?=[\x00-&(-\x7f{_L}]|\Z)| ?[0-9]++(?=[\x00-\x7f]|\Z)"
    rf"|[{_WS}]++\Z|[{_WS}]+(?=[{_WS}])| ?[^{_WS}]+|[{_WS}]"
)
_BREAK = re.compile(f" (?=[^{_WS}])")
_HAS_WS = re.compile(f"[{_WS}]")


class Encoder:
    """Ids of a byte-level BPE, part by part, from a cache of parts; the same ids as of the whole text."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES) -> None:
        self.entries = entries
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: Iterable[str]) -> None:
        """New parts go by the thousand in one text, a line each: a line break between them is one id of its own."""
        known = self.known
        if len(known) > self.entries:
            known = self.known = {}
        new = [w for w in set(parts) if w not in known]
        odd = [w for w in new if w == " " or _HAS_WS.search(w, w[0] == " ")]
        known.update(zip(odd, self._encode(odd), strict=True))
        plain = [w for w in new if w not in known]
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = self._encode(["\n".join(some)])[0]
            ends = (np.flatnonzero(np.frombuffer(ids, dtype="<u4") == self.line_break) * 4).tolist()
            known.update((w, ids[a:b]) for w, a, b in zip(some, [0, *(e + 4 for e in ends)], [*ends, len(ids)], strict=True))

    def each(self, texts: Iterable[str]) -> Iterator[Iterable[bytes]]:
        """The ids of each text in turn, in runs; what texts of about a stretch in all have new is learnt at once."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= STRETCH:
                yield from self._together(held)
                held, size = [], 0
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[Iterable[bytes]]:
        split = [None if len(t) > STRETCH or any(x in t for x in self.added) else _PART.findall(t) for t in texts]
        self._learn(set().union(*(s for s in split if s is not None)))
        known = self.known  # stays whole while a long text among them is learnt
        for text, parts in zip(texts, split, strict=True):
            yield self.stretches(text) if parts is None else (b"".join(map(known.__getitem__, parts)),)

    def stretches(self, text: str) -> Iterator[bytes]:
        """The ids, little-endian unsigned 32-bit, in runs."""
        if any(t in text for t in self.added):
            yield self._encode([text])[0]
            return
        at = 0
        while at < len(text):
            cut = _BREAK.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            until = cut.start() if cut else len(text)
            parts = _PART.findall(text[at:until] if cut or at else text)
            try:
                yield b"".join(map(self.known.__getitem__, parts))
            except KeyError:
                self._learn(parts)
                yield b"".join(map(self.known.__getitem__, parts))
            at = until


def pieces_of(runs: Iterator[bytes], window: int = WINDOW, piece: int = PIECE) -> tuple[list[tuple[int, int, int]], int]:
    """((start, length, crc32) of each piece, number of ids); whole windows first, then the rest in even parts."""
    held, at, out = bytearray(), 0, []
    for run in runs:
        held += run
        whole = len(held) // (4 * window)
        for k in range(whole):
            out.append((at, window, zlib.crc32(held[4 * window * k : 4 * window * (k + 1)])))
            at += window
        del held[: 4 * window * whole]
    rest = len(held) // 4
    total = at + rest
    parts = math.ceil(rest / piece)
    for k in range(parts):
        a, b = rest * k // parts, rest * (k + 1) // parts
        out.append((at + a, b - a, zlib.crc32(held[4 * a : 4 * b])))
    return out, total


def differencing(lengths: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each piece, load of each window) by repeated merging of the two most uneven partitions."""
    n = len(lengths)
    follow = np.full(n, -1)  # chains of pieces that share a window
    tail = np.arange(n)
    parts = {i: (np.array([s], dtype=np.int64), np.array([i])) for i, s in enumerate(lengths)}
    heap = [(-int(s), i) for i, s in enumerate(lengths)]
    heapq.heapify(heap)
    fresh = n
    while len(heap) > 1:
        (la, ha), (lb, hb) = (parts.pop(heapq.heappop(heap)[1]) for _ in range(2))
        shared = len(la) + len(lb) - windows
        if shared > 0:  # emptiest of one with fullest of the other
            a, b = ha[-shared:], hb[-shared:][::-1]
            follow[tail[a]] = b
            tail[a] = tail[b]
            loads = np.concatenate([la[:-shared], la[-shared:] + lb[-shared:][::-1], lb[:-shared]])
            heads = np.concatenate([ha, hb[:-shared]])
        else:
            loads, heads = np.concatenate([la, lb]), np.concatenate([ha, hb])
        order = np.argsort(-loads, kind="stable")
        loads, heads = loads[order], heads[order]
        parts[fresh] = (loads, heads)
        heapq.heappush(heap, (-int(loads[0] - (loads[-1] if len(loads) == windows else 0)), fresh))
        fresh += 1
    loads, heads = parts[heap[0][1]]
    where = np.empty(n, dtype=np.int64)
    for k, i in enumerate(heads):
        while i >= 0:
            where[i] = k
            i = follow[i]
    return where, loads


def windows_for(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each piece; as few windows as differencing fits under the capacity, tried upwards."""
    if not len(lengths):
        return np.empty(0, dtype=np.int64)
    k = max(1, math.ceil(int(lengths.sum()) / capacity))
    while True:
        where, loads = differencing(lengths, k)
        if loads.max() <= capacity:
            return where
        k += 1 + k // 400


def _tokenize(path: str, end_id: int, window: int, piece: int, cache: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path, cache)
        end = np.array([end_id], dtype="<u4").tobytes()
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            for doc_id, runs in zip(batch["doc_id"], encoder.each(batch["text"]), strict=True):
                got, total = pieces_of(chain(runs, (end,)), window, piece)
                out += [(doc_id, s, n, crc, total, part, row) for s, n, crc in got]
                row += 1
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "row"]).astype({"doc_id": "Int64"})
        give_back()

    return run


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def _encoder(path: str, cache: int) -> Encoder:
    if (path, cache) not in _ENCODERS:
        _ENCODERS[path, cache] = Encoder(path, cache)
    return _ENCODERS[path, cache]


def _packing(window: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def pack_block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "part", "row", "start"], ascending=False, ignore_index=True)
        whole = pdf["length"].to_numpy() == window
        where = np.empty(len(pdf), dtype=np.int64)
        where[whole] = np.arange(whole.sum())
        where[~whole] = whole.sum() + windows_for(pdf["length"].to_numpy()[~whole], window)
        pdf = pdf.assign(sequence_id=(int(key[0]) << 32) + where).sort_values(["sequence_id", "part", "row", "start"], ignore_index=True)
        offset = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.assign(offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack_block


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID, cache: int = CACHE_ENTRIES) -> DataFrame:
    """docs: doc_id, text -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text is the end id alone; repeated rows are packed once each; doc_id may be null; an empty
    table gives none; other columns, whatever they are called, are left out. A window that its pieces don't fill is
    padded by whoever lays it out: to `window`, but a window whose ids end exactly at a power of two needs no padding.
    Padding takes no rows here: a window ends after its last piece, at offset + length, and `padded` says how long it gets. Texts are read in stretches and ids drained window by window. Rows are dealt to blocks
    by their place in the input, so copies and long documents spread; a block holds about DOCS_PER_BLOCK rests.
    """
    blocks = max(1, math.ceil(docs.count() / DOCS_PER_BLOCK))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, row long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = texts.mapInPandas(_tokenize(tokenizer, end_id, window, piece, cache), kind)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("part", "row", F.when(F.col("length") == window, F.col("start"))), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_packing(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def padded(length: int, window: int = WINDOW) -> int:
    """How long a window of so many ids is laid out: as it is if that is a power of two, else the whole window."""
    return length if length & (length - 1) == 0 else window


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())
