"""The trie, hard negatives and fingerprints against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest

from lumenfold.llm import op11_trie, op12_negatives, op13_fingerprints

R = np.random.default_rng(5)
CHATS = "conv_id long, turn long, role string, text string, digest string, depth string, id string, words string, class string"


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    words = lambda t: len("".join(x if x not in "\x0b\x0c" else " " for x in t).split()) if t.isascii() else len(t.split())
    kids, leaves, saved, out = defaultdict(int), defaultdict(int), defaultdict(int), set()
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(who) - 1) * (words(node[-1][1]) if node else 0)
    for node, who in members.items():
        ends = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(node))))
        out.add((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def chats(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], CHATS)


def nodes(df):
    return [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()]


def test_trie_of_odd_rows(spark):
    rows = [(c, t, "user" if t % 2 else None, str(R.choice(["a", "b c", "", None]))) for c in range(90) for t in range(int(R.integers(1, 7)))]
    rows += [(7, None, "user", "first"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "user", "other"), (-3, 1, "user", None), (None, 1, "user", "x"), (400, 0, None, None), (1 << 40, 0, "r", "x y")]
    got = nodes(op11_trie.trie(chats(spark, rows)))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows)


def test_trie_of_copies_and_long_ones(spark, monkeypatch):
    """Shared runs longer than a round, a tail longer than a block, many conversations that end at one node."""
    monkeypatch.setattr(op11_trie, "LAST_STEP", 8)
    monkeypatch.setattr(op11_trie, "CHAIN_BLOCK", 16)
    monkeypatch.setattr(op11_trie, "ENDS_BLOCK", 3)
    long = [(c, t, "user", f"{t} w") for c in (5, 6) for t in range(60 + c)]
    copies = [(c, t, "user", "same") for c in range(20, 90) for t in range(4)]
    got = nodes(op11_trie.trie(chats(spark, long + copies)))
    assert len(got) == len(set(got)) and set(got) == plain_trie(long + copies)


def test_trie_of_nothing_and_of_one(spark):
    assert op11_trie.trie(chats(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
    assert set(nodes(op11_trie.trie(chats(spark, [(1, 1, "a", "b")])))) == plain_trie([(1, 1, "a", "b")])


def plain_negatives(rows):
    kept = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v]))
    out = []
    for a, (i, label, v) in enumerate(kept):
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other == label) for b, (j, other, w) in enumerate(kept) if b != a and len(w) == len(v))
            for ps, p, _ in [s for s in scored if s[2]][:5]:
                fit = [s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
                out += [(i, p, k + 1, j, -ps, -ns) for k, (ns, j, _) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<double>, label int, row string, dim string, norm string, vector string, tile string"


def negatives(spark, rows):
    df = op12_negatives.mine(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], VECTORS))
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


@pytest.mark.parametrize("tile", [64, 1024])
def test_negatives(spark, monkeypatch, tile):
    monkeypatch.setattr(op12_negatives, "TILE", tile)
    monkeypatch.setattr(op12_negatives, "LEAF", 8)
    monkeypatch.setattr(op12_negatives, "BLOCK", 3)
    centres = R.normal(size=(10, 8))
    rows = [(int(i), (centres[i % 10] + 0.5 * R.normal(size=8)).tolist(), int(R.integers(0, 10))) for i in range(900)]
    rows += [(2000 + k, rows[0][1], k % 3) for k in range(60)] + [(k, rows[3][1], 1) for k in (100, 100, 300)]  # copies, ties, repeated ids
    rows += [(3000, None, 1), (3100, [1.0] * 8, None), (None, [1.0] * 8, 1), (3200, [1.0] * 7 + [float("nan")], 1), (3300, [1.0] * 7 + [None], 1), (3400, [0.0] * 8, 1)]
    rows += [(3500, [], 1), (3501, [], 1), (3502, [], 2), (3600, [2.0, 1.0], 3), (3601, [1.0, 1.0], 3), (3603, [1.0, 0.9], 4), (3700, [-1.0] * 8, 5)]
    assert negatives(spark, rows) == plain_negatives(rows)


def test_negatives_of_nothing_and_of_large_components(spark):
    assert negatives(spark, [(100, [1.0, 2.0], 1)]) == [] and op12_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0
    big = [(100, [2.0**22, 1.0], 1), (1, [2.0**22, 0.5], 1), (2, [2.0**22, 0.25], 2), (3, [2.0**22, -0.25], 2)]
    assert negatives(spark, big) == plain_negatives(big) != []


def test_bounds_hold_and_prune():
    x = np.floor(256 * (np.repeat(R.normal(size=(32, 16)), 32, axis=0) + 0.1 * R.normal(size=(1024, 16))))
    order, spans, centre, radius = op12_negatives.ball_tree(x)
    assert sorted(order) == list(range(1024))
    q = np.floor(256 * R.normal(size=16))
    scores = x[order] @ q
    for (s, e), c, r in zip(spans, centre, radius, strict=True):
        reach = np.sqrt(q @ q) * r
        assert scores[s:e].max() <= c @ q + reach + 1e-6 and scores[s:e].min() >= c @ q - reach - 1e-6
    probes = op12_negatives.Probes(q[None, :], np.array([-1]), np.array([0]), np.array([0]), np.array([op12_negatives.NONE]), np.array([2**62]), True)
    probes.search(np.arange(1024), np.arange(1024), np.zeros(1024, dtype=np.int64), x[order], spans, centre, radius)
    assert probes.score[0].tolist() == sorted(scores.astype(int).tolist(), reverse=True)[:5] and probes.visited < 32


def plain_chunks(data: bytes) -> list[bytes]:
    """One byte after the other, the hash shifted as it goes."""
    f, chunks, start, h = op13_fingerprints, [], 0, 0
    for i, b in enumerate(data):
        h = ((h << 1) + int(f.GEAR[b])) % (1 << f.WINDOW)
        n = i + 1 - start
        bits = 0 if n < f.LEAST else f.STRICT if n < f.NORMAL else f.LOOSE
        if n == f.MOST or bits and h >> (f.WINDOW - bits) == 0:
            chunks.append(data[start : i + 1])
            start = i + 1
    return chunks + ([data[start:]] if start < len(data) else [])


def test_chunks_are_those_of_a_rolling_hash(monkeypatch):
    texts = [bytes(R.integers(97, 123, int(n)).astype(np.uint8)) for n in [0, 1, 15, 16, 17, 64, 255, 256, 257, 5000, 9000]] + [b"a" * 3000, "é\U0001f600 ".encode() * 500]
    for stretch in (1 << 22, 100):
        monkeypatch.setattr(op13_fingerprints, "STRETCH", stretch)
        for t in texts:
            cuts = [0, *op13_fingerprints.boundaries(t)]
            assert [t[a:b] for a, b in itertools.pairwise(cuts)] == plain_chunks(t)


def test_fingerprints_shift():
    words = [str(x) for x in R.integers(0, 10**6, 3000)]
    a, moved = " ".join(words), " ".join(["put", "in", "front", *words[:1500], "between", *words[1500:]])
    f = op13_fingerprints
    assert f.containment(f.fingerprint(a), f.fingerprint(moved)) > 0.95
    assert f.containment(f.fingerprint(a), f.fingerprint(f.edited(a, "other words " * 4000))) == pytest.approx(0.5, abs=0.05)
    sizes = np.diff([0, *f.boundaries(a.encode())])
    assert 50 < sizes.mean() < 90 and (sizes[:-1] >= f.LEAST).all() and (sizes <= f.MOST).all()
    assert [f.containment(x, y) for x, y in (({}, {}), ({}, {1: 2}), ({1: 2}, {}))] == [1.0, 0.0, 0.0]


DOCS = "doc_id long, text string, key string, part string, guest string, at string, n_chars string"


def plain_fingerprints(rows):
    """As the contract has it, for documents whose ids differ."""
    f = op13_fingerprints
    order = sorted([(i, t or "") for i, t in rows], key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = f.fingerprint(t), f.fingerprint(new), f.fingerprint(nxt)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), f.written(a), f.written(b), f.containment(a, b), f.containment(a, c)))
    return out


def printed(spark, rows):
    df = op13_fingerprints.fingerprints(spark.createDataFrame([(*r, *["x"] * 5) for r in rows], DOCS))
    return [tuple(r) for r in df.collect()]


def test_fingerprints_of_odd_rows(spark):
    word = lambda: "".join(R.choice(list("abcdefgh é\U0001f600"), 5))
    rows = [(int(i), " ".join(word() for _ in range(int(R.integers(0, 200))))) for i in R.permutation(200)]
    rows += [(-5, None), (1 << 40, ""), (None, "no id"), (-(1 << 63), "least"), (777, "x" * 300_000)]
    assert sorted(printed(spark, rows), key=str) == sorted(plain_fingerprints(rows), key=str)
    assert printed(spark, [(3, "alone here")]) == plain_fingerprints([(3, "alone here")])
    assert op13_fingerprints.fingerprints(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_documents_follow_each_other(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (2, "z" * 50), (2, "z" * 50), (2, "z" * 50)]
    got = printed(spark, rows)
    assert sorted((r[0], r[1]) for r in got) == sorted((i, len(t)) for i, t in rows)
    assert sum(r[6] == 1.0 for r in got) == 3  # two of three copies and one of two precede a copy
