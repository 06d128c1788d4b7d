"""Packing, mixing, toxicity, near-duplicates, embeddings and the pipeline against plain versions, and on odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from lumenfold.llm import op1_packing, op3_mixing, op4_toxicity, op5_neardup, op9_embeddings
from lumenfold.llm.graph import components

R = np.random.default_rng(11)
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, copies string, fp string, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "x", "x", "x") for i, t, s in rows], DOCS)


def word() -> str:
    return "".join(R.choice(list("abcdefghij"), 6))


BASE = [" ".join(word() for _ in range(120)) for _ in range(6)]
ODD = [(0, None, "a"), (1, "", "a"), (2, " \n ", None), (3, "x", "b"), (4, "one two three", "b"), (5, BASE[0], "c"), (5, BASE[0], "c"), (None, BASE[1], None), (6, "é\U0001f600 " * 3000, "a"), (7, "<|endoftext|> hi", "b")]


def test_encoder_equals_the_tokenizer():
    e = op1_packing.Encoder(op1_packing.default_tokenizer())
    texts = ["".join(R.choice([" ", " ", "\n", "a", "B", "'s", "'", "1", ".", "\t", "\xa0", "é", "　", "ω", "\x1c"], 50)) for _ in range(500)]
    texts += ["", " ", "  a", "it's  a 'test'\n\n x", "<|endoftext|> a<|endoftext|>"]
    for t, runs in zip(texts, e.each(texts), strict=True):
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_in_stretches(monkeypatch):
    """Texts beyond a stretch are split where a word begins; the ids are those of the whole text."""
    monkeypatch.setattr(op1_packing, "STRETCH", 64)
    e = op1_packing.Encoder(op1_packing.default_tokenizer())
    texts = ["".join(R.choice([" ", " ", "\n", "a", "B", "'s", "1", ".", "\t", "\xa0", "é", "ω", "word", " the"], int(n))) for n in R.integers(1, 900, 150)]
    for t, runs in zip(texts, e.each(texts), strict=True):
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_padding():
    assert [op1_packing.padded(n) for n in (1, 3, 1024, 1500, 2047, 2048)] == [1, 2048, 1024, 2048, 2048, 2048]


def test_packing(spark):
    docs = docs_of(spark, ODD)
    got = op1_packing.pack(docs, op1_packing.default_tokenizer()).toPandas()
    tok = op1_packing.Encoder(op1_packing.default_tokenizer()).tokenizer
    for i, t, _ in ODD:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = got[got["doc_id"].isna() if i is None else got["doc_id"] == i].sort_values("start")
        times = sum(x[0] == i for x in ODD)
        assert mine["length"].sum() == times * len(ids) and (mine["doc_tokens"] == len(ids)).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    by = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert (by.sum() <= 2048).all() and (got.sort_values(["sequence_id", "offset"])["offset"] == by.cumsum() - by.obj).all()
    assert op1_packing.pack(docs.limit(0), op1_packing.default_tokenizer()).count() == 0


def test_differencing_is_near_even():
    lengths = R.integers(1, 512, 700)
    where = op1_packing.windows_for(lengths, 2048)
    loads = np.bincount(where, weights=lengths)
    assert loads.max() <= 2048 and lengths.sum() / (2048 * len(loads)) > 0.97
    assert op1_packing.windows_for(np.array([2047] * 5 + [1] * 5), 2048).max() == 4


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 4}") for i, n in enumerate(R.integers(0, 90, 3000))]
    docs = docs_of(spark, [*rows, *ODD]).withColumn("size", op3_mixing.words_in(__import__("pyspark").sql.functions.col("text")))
    got = op3_mixing.mix(docs).toPandas()
    assert len(got) == len(rows) + len(ODD) and (got["taken"] <= 3 * got["size"]).all()
    assert got["target"].groupby(got["source"].fillna("~")).first().sum() == pytest.approx(got["size"].sum())
    for _, g in got.groupby(got["source"].fillna("~")):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= g["size"].max() and g["target"].iloc[0] <= 3 * g["source_size"].iloc[0] + 1e-6
    again = op3_mixing.mix(docs.repartition(3)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, got[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))
    assert op3_mixing.mix(docs.limit(0)).count() == 0
    applied = op3_mixing.apply(docs_of(spark, [*rows, *ODD]))
    assert applied.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and applied.count() == got["copies"].sum()


def test_targets_by_hand(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300}
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, items long")
    got = {r["source"]: r["target"] for r in op3_mixing.targets(df).collect()}
    level = (1810 - 30) / (2 + 1 + 5)
    assert got == pytest.approx({"a": 30.0, "b": 2 * level, "c": level, None: min(900, 5 * level)} if 5 * level <= 900 else {"a": 30.0, None: 900.0, "b": (1810 - 930) / 3 * 2, "c": (1810 - 930) / 3})


def test_rows_alike_share_their_copies(spark, monkeypatch):
    monkeypatch.setattr(op3_mixing, "ALIKE", 7)
    rows = [(1, "w " * 10, "s0")] * 40 + [(None, "w " * 10, "s0")] * 33 + [(k, "w " * 9, f"s{k % 3}") for k in range(2, 300)]
    docs = docs_of(spark, rows)
    got = op3_mixing.mix(docs.withColumn("size", op3_mixing.words_in(__import__("pyspark").sql.functions.col("text")))).toPandas()
    assert got.columns.tolist() == ["doc_id", "source", "size", "source_size", "target", "taken", "copies"] and len(got) == len(rows)
    for alike in (got[got["doc_id"] == 1], got[got["doc_id"].isna()]):
        assert alike["copies"].max() - alike["copies"].min() <= 1
    applied = op3_mixing.apply(docs)
    assert applied.where("doc_id = 1").count() == got[got["doc_id"] == 1]["copies"].sum() and applied.where("doc_id is null").count() == got[got["doc_id"].isna()]["copies"].sum()


def test_pivotal_keeps_the_mean():
    size, part = R.integers(1, 50, 9).astype(float), R.uniform(0, 1, 9)
    drawn = np.mean([op3_mixing.pivotal(size, part, np.random.default_rng(k), False) for k in range(4000)], axis=0)
    assert np.allclose(drawn, part, atol=0.04)


def test_toxicity(spark):
    rows = [(i, f"{word()} {word()} {'you vile ' + word() if i % 5 == 0 else word()} {word()}", "a") for i in range(900)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i in range(600)] + [(0, 1, "x"), (None, 1, "x"), (8, None, "x")], "doc_id long, toxic int, text string")
    got = {r["doc_id"]: r["score"] for r in op4_toxicity.score(docs_of(spark, [*rows, *[(i if i is None else i + 2000, t, s) for i, t, s in ODD]]), labels).select("doc_id", "score").collect()}
    assert np.mean([(got[i] >= 0.7) == (i % 5 == 0) for i in range(600, 900)]) > 0.97
    assert all(0 <= v <= 1 for v in got.values()) and got[2000] == got[2001] == got[2002] < 0.7
    none = op4_toxicity.score(docs_of(spark, ODD), labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5]
    assert op4_toxicity.score(docs_of(spark, []), labels).count() == 0


def test_ftrl_equals_a_plain_one():
    """The update rule of FTRL-proximal, coordinate by coordinate, in dictionaries."""
    rows = [(np.unique(R.integers(0, 60, 12)), int(R.random() < 0.4)) for _ in range(400)]
    model = op4_toxicity.Ftrl(6)
    z, n = {}, {}
    a, b, l1, l2 = op4_toxicity.ALPHA, op4_toxicity.BETA, op4_toxicity.L1, op4_toxicity.L2

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((b + ni**0.5) / a + l2)

    for at, label in rows:
        model.learn(at, label)
        every = [*at.tolist(), 64]
        w = {i: weight(i) for i in every}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in every:
            sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / a
            z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    assert np.allclose(model.weights(np.arange(65)), [weight(i) for i in range(65)])


def test_features_are_words_pairs_and_skips():
    f = op4_toxicity.Features()
    words = [f"w{k}" for k in range(40)]
    assert len(f.of(" ".join(words))) == 40 + 39 + 38
    assert set(f.of("w1 w2")) < set(f.of("w0 w1 w2 w3")) and set(f.of("w1 w3")) & set(f.of("w1 w2 w3")) == set(f.of("w1")) | set(f.of("w3"))


def test_one_text_per_label_is_learnt_from(spark, monkeypatch):
    """A labelled id that very many rows share sends one text to the training task."""
    seen = {}
    monkeypatch.setattr(op4_toxicity, "train", lambda rows: seen.setdefault("n", rows.count()) and {} or {})
    docs = docs_of(spark, [(k % 2, f"text {k}", "a") for k in range(300)])
    op4_toxicity.score(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int")).count()
    assert seen["n"] == 2


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = op4_toxicity.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = got[got["predicted"] == 1]
    assert (hit["toxic"] == 1).mean() > 0.97 and (got[got["toxic"] == 1]["predicted"] == 1).mean() > 0.7


def edited(text: str, n: int) -> str:
    w = text.split()
    for k in R.choice(len(w), n, replace=False):
        w[k] = word()
    return " ".join(w)


def plain_similarity(a: list[str], b: list[str]) -> float:
    """Words of the longest common subsequence over all words of both."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1] / (len(a) + len(b) - row[-1])


def share_a_shingle(a: list[str], b: list[str]) -> bool:
    """Five words in a row, or all where a text has fewer: texts that share none don't meet."""
    parts = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a, b)]
    return bool(parts[0] & parts[1])


def brute_groups(texts: dict[int, str | None]) -> dict[int, int]:
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    at = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and at[i] != at[j] and share_a_shingle(words[i], words[j]) and plain_similarity(words[i], words[j]) >= 0.8:
                a, b = at[i], at[j]
                at = {k: min(a, b) if v in (a, b) else v for k, v in at.items()}
    return at


def test_near_copies_are_recalled(spark):
    """Pairs with scattered edits of words, replaced, left out or put in: at least 0.9 of those that a plain alignment links."""
    texts, linked, pair = {}, 0, {}
    for k in range(300):
        base = [word() for _ in range(int(R.integers(40, 300)))]
        other = []
        for w in base:
            kind = R.random() / (0.02 + 0.1 * (k % 5) / 4)
            other += [word()] if kind < 0.6 else [] if kind < 0.8 else [w, word()] if kind < 1 else [w]
        texts[2 * k], texts[2 * k + 1] = " ".join(base), " ".join(other)
        pair[k] = plain_similarity(base, other) >= 0.8
        linked += pair[k]
    got = {r["doc_id"]: r["group_id"] for r in op5_neardup.mark(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    found = [got[2 * k + 1] == 2 * k for k in range(300)]
    assert linked > 150 and not any(f and not pair[k] for k, f in enumerate(found))
    assert sum(found) >= 0.9 * linked


def test_near_copies_are_recalled_at_each_rate_of_edits(spark):
    """Single words replaced, at rates up to the one word in nine that 0.8 permits: 0.9 of the pairs of each rate."""
    rates, texts, linked = (0.03, 0.05, 0.07, 0.09, 0.105), {}, {}
    for k in range(500):
        base = [word() for _ in range(int(R.integers(100, 251)))]
        other = edited(" ".join(base), round(rates[k % 5] * len(base)))
        texts[2 * k], texts[2 * k + 1] = " ".join(base), other
        linked[k] = plain_similarity(base, other.split()) >= 0.8
    got = {r["doc_id"]: r["group_id"] for r in op5_neardup.mark(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    found = {k: got[2 * k + 1] == 2 * k for k in linked}
    assert not any(f and not linked[k] for k, f in found.items())
    for rate in range(5):
        of = [k for k in linked if k % 5 == rate and linked[k]]
        assert len(of) > 90 and sum(found[k] for k in of) >= 0.9 * len(of), rates[rate]


def test_near_duplicates(spark):
    texts = {i: t for i, t, _ in ODD if i is not None and i != 5}
    texts |= {100 + k: edited(BASE[k % 6], int(R.integers(0, 4))) for k in range(60)} | {300: BASE[2].upper(), 301: BASE[2] + " " + BASE[3]}
    chain, t = {}, BASE[4]
    for k in range(30):  # each links with the next, the ends do not
        t = edited(t, 1)
        chain[400 + k] = t
    texts |= chain
    rows = [(i, t, "a") for i, t in texts.items()]
    got = {r["doc_id"]: r for r in op5_neardup.mark(docs_of(spark, rows)).collect()}
    want = brute_groups(texts)
    assert {i: r["group_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in got.values())
    kept = op5_neardup.deduplicate(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_near_duplicates_of_short_texts(spark):
    texts, lead = {}, " ".join(word() for _ in range(12))
    for n in range(3, 31):  # more words at either end, from well above the least similarity to below it
        base = " ".join(word() for _ in range(n))
        for k, add in enumerate((0, 1, (n - 4) // 8, (n - 4) // 4, (n - 4) // 4 + 1)):
            texts[10 * n + k] = " ".join([base, *[word() for _ in range(add)]] if k % 2 else [*[word() for _ in range(add)], base])
    texts |= {1000 + k: f"{lead} {word()} {word()}" for k in range(6)} | {1100 + k: f"{lead} {word()} {word()} {word()}" for k in range(6)}
    long = " ".join(word() for _ in range(84))
    texts |= {1200: long, 1201: " ".join(long.split()[:68])}
    got = {r["doc_id"]: r["group_id"] for r in op5_neardup.mark(docs_of(spark, [(i, t, "a") for i, t in texts.items()])).collect()}
    want = brute_groups(texts)
    assert got == want and want[121] == want[120] and want[1201] == 1200 and want[1105] == 1105


def test_near_duplicates_of_odd_rows(spark):
    assert op5_neardup.mark(docs_of(spark, ODD)).where("kept").count() == len(ODD) - 1
    kept = op5_neardup.deduplicate(docs_of(spark, [*ODD, (5, BASE[1] + " more", "a")]))
    assert kept.where("doc_id = 5").count() in (1, 2) and kept.where("doc_id is null").count() == 1
    assert op5_neardup.mark(docs_of(spark, [])).count() == 0


def test_near_duplicates_without_ids(spark):
    near = edited(BASE[0], 1)
    nulls = [BASE[0], BASE[0], near, BASE[1], BASE[1].upper(), BASE[2], "", None, " "]
    docs = docs_of(spark, [*[(None, t, "a") for t in nulls], (1, edited(BASE[2], 1), "a"), (2, "", "a"), (3, BASE[5], "a")])
    marks = op5_neardup.mark(docs)
    assert marks.where("kept and doc_id is null").count() == 2 + 3
    kept = op5_neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert sorted(i for i, _ in got if i is not None) == [2, 3]  # 1 is nearly a row without id, which stays
    words = [t.lower() for i, t in got if i is None and t and t.strip()]
    assert len(got) == 2 + 3 + 3 and len(words) == 3 and {BASE[1], BASE[2]} < set(words) and (BASE[0] in words or near in words)


def test_shared_counts():
    seqs = [np.unique(R.integers(0, 9000, 700)).astype(np.int32) for _ in range(20)] + [np.array([-5], np.int32)]
    got = op5_neardup.common(seqs)
    assert all(got[i, j] == len(np.intersect1d(seqs[i], seqs[j])) for i in range(21) for j in range(21) if i != j)


def test_alignment():
    def plain(a, b, band):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y and abs(i - j) <= band else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(300):
        a = R.integers(0, 12, int(R.integers(1, 90))).astype(np.uint64)
        b = np.concatenate([a[: len(a) // 2], R.integers(0, 12, int(R.integers(0, 9))).astype(np.uint64), a[len(a) // 2 + int(R.integers(0, 9)) :]])
        band = int(R.integers(1, 20))
        assert plain(a.tolist(), b.tolist(), band) <= op5_neardup.aligned(a, b, band) <= op5_neardup.aligned(a, b, 200) == plain(a.tolist(), b.tolist(), 200)


def test_alignment_stays_in_band():
    a = np.arange(100, dtype=np.uint64)
    assert op5_neardup.similarity(a, a) == 1 and op5_neardup.similarity(a, np.concatenate([a[50:], a[:50]])) < 0.8
    assert op5_neardup.similarity(a, a[:80]) == 0.8 and op5_neardup.similarity(a, a[:79]) < 0.8


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (9, 8), (7, 8), (5, 5)] + [(k, k + 1) for k in range(100, 160)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(100, 161)}) == 1 and got[1] == got[4] and got[7] == got[9] and 5 not in got


def brute_links(vectors: dict[int, list | None]) -> tuple[dict, dict]:
    def unit(v):
        ok = v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        return np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None

    u = {i: unit(v) for i, v in vectors.items()}
    links, at = dict.fromkeys(vectors, 0), {i: i for i in vectors}
    for i in u:
        for j in u:
            if i < j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = at[i], at[j]
                at = {k: min(a, b) if v in (a, b) else v for k, v in at.items()}
    return links, at


@pytest.mark.parametrize("dim", [3, 40])
def test_embeddings(spark, dim, monkeypatch):
    monkeypatch.setattr(op9_embeddings, "TILE", 16)
    centre = R.normal(size=(8, dim))
    v = {i: (centre[i % 8] + R.normal(size=dim) * 0.25).astype(np.float32).tolist() for i in range(90)}
    v |= {200: v[3], 201: [2 * x for x in v[3]], 202: None, 203: [0.0] * dim, 204: [None] * dim, 205: [float("nan")] * dim, 206: [], 207: v[3] + [1.0], 208: [float("inf")] * dim, 209: v[3] + [1.0]}
    df = spark.createDataFrame([(i, x, 1, "x") for i, x in v.items()], "vec_id long, embedding array<float>, label int, fp string")
    got = {r["vec_id"]: r for r in op9_embeddings.near(df).collect()}
    links, at = brute_links(v)
    assert {i: r["n_links"] for i, r in got.items()} == links and {i: r["component_id"] for i, r in got.items()} == at
    assert all(r["kept"] == (i == at[i]) for i, r in got.items())
    assert op9_embeddings.near(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_decided_on_the_vectors(spark, monkeypatch):
    monkeypatch.setattr(op9_embeddings, "TILE", 8)
    v = {}
    for k in range(40):  # pairs whose cosine is 0.9 to the last bits, in planes that share nothing
        a = np.zeros(84)
        a[2 * k] = 1.0
        b = np.zeros(84)
        b[2 * k], b[2 * k + 1] = 0.9, float(np.sqrt(1 - 0.81)) * (1 + (k - 20) * 4e-16)
        v |= {2 * k: a.tolist(), 2 * k + 1: b.tolist()}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in op9_embeddings.near(df).collect()}

    def unit(x):
        x = np.array(x) / np.abs(x).max()
        return x / np.sqrt(float(x @ x))

    want = {}
    for k in range(40):
        dot = float(sum(p * q for p, q in zip(unit(v[2 * k]), unit(v[2 * k + 1]), strict=True)))
        want |= {2 * k: int(dot >= 0.9), 2 * k + 1: int(dot >= 0.9)}
    assert got == want and 0 < sum(want.values()) < 80


def test_cells_split_a_cloud_evenly():
    x = R.normal(size=(5000, 8))
    tree = op9_embeddings.walls(x[:2000], 16)
    sizes = np.bincount(op9_embeddings.cells_of(x, *tree), minlength=16)
    assert len(sizes) == 16 and sizes.min() > 150 and op9_embeddings.cells_of(x, *op9_embeddings.walls(x[:5], 1)).max() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in p.STAGES:
        out = p.cut(stage(spark, docs, sf), name)
        if name != "packing":
            assert out.columns == docs.columns
        seen[name] = (docs, out)
        docs = out
    a, b = seen["toxicity"]
    assert 0.85 * a.count() < b.count() < a.count()
    a, b = seen["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in a.collect()}
    assert sorted(r["doc_id"] for r in b.collect()) == sorted(set(brute_groups(texts).values()))
    a, b = seen["secrets"]
    assert a.count() == b.count() and b.where("text rlike 'AKIA[A-Z0-9]{16}'").count() == 0 and b.where("n_chars <> length(text)").count() == 0
    a, b = seen["mixing"]
    assert b.groupBy("doc_id").count().where("count > 3").count() == 0
    a, b = seen["packing"]
    assert b.selectExpr("sum(length)").first()[0] >= a.count() and b.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    import corpus_pipeline as p

    names = "blob findings hit others score rows total k f size fp copies row kept toxicity_score mix_size mix_id mix_copy dedup_fp dedup_id"
    rows = [(i, t, "en", s, None if t is None else len(t), *["own"] * 20) for i, t, s in [*ODD, (8, "password=hunter22 " + BASE[2], "a")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names.split()))
    spark.createDataFrame([(5, 0), (6, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in p.STAGES[:-1]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, str(tmp_path))
            assert out.columns == docs.columns and {r[n] for r in out.collect() for n in names.split()} <= {"own"}, name
    for given in (docs, docs.limit(0)):
        packed = p.packing(spark, given, str(tmp_path))
        assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        assert packed.where("start = 0").count() == given.count()
