"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans. Four labelers - validity, gazetteer, context, edges - vote 1, 0 (abstain)
or -1 on each. Votes are counted over all candidates; expectation-maximisation on these counts estimates how
reliable each labeler is and how likely each vote pattern marks personal data; those likelihoods are the targets
of a logistic span classifier over what the labelers don't see - a span's length, its share of digits and what
stands before and after it, each by kind - and over the cue words around it. It is compiled into one column
expression that decides on the added spans. Base spans stay whatever it says. What reaches the driver are
counts per kind, votes and shape: 8 x 3^4 x 4^4 patterns at most, whatever the number of texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SCAN_BLOCK, cut, let, span_list, spans, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelled_email", "ssn", "iban", "local_phone")
KINDS = BASE + ADDED

#: A match can only begin where a run of its characters begins, or where the last match ended; so each run is
#: read once. Possessive groups end a pattern only where nothing follows: the same matches, without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "spelled_email": r"(?<![A-Za-z0-9])[A-Za-z0-9._-]{1,64}\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(](?i:dot)[\])]\x20?[A-Za-z0-9-]{1,63})++",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
}

CUES = {
    "email": r"mail|contact|write|kontakt|contacter|correo",
    "ip": r"\bip\b|address|server|host|login|adresse|dirección",
    "card": r"card|visa|credit|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel|mobile|fax|anruf|appel|llam",
    "spelled_email": r"mail|contact|write|kontakt|contacter|correo",
    "ssn": r"ssn|social|security",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "local_phone": r"phone|call|tel|mobile|fax|anruf|appel|llam",
}
AGAINST = r"version|release|isbn|issn|order|build|doi|serial|part no"
DOMAINS = r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl)$"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
LABELERS = ("valid", "gazetteer", "context", "edges")
SHAPES = ("length", "digits", "lead", "tail")
CANDIDATE = "array<struct<rank:int,start:int,end:int,kind:string,valid:int,gazetteer:int,context:int,edges:int,length:int,digits:int,lead:int,tail:int>>"
AROUND = 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The contract's own tests of a match; of added kinds, what their issuers rule out."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    if kind == "iban":
        return F.length(F.replace(m, F.lit(" "))).between(15, 34)
    return F.lit(True)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind in ("email", "spelled_email"):
        return F.when(F.lower(F.regexp_replace(m, r"\x20?[\[(](?i:dot)[\])]\x20?", ".")).rlike(DOMAINS), 1).otherwise(0)
    if kind == "ip":
        return F.when(m.rlike(r"^(?:0|127|255)\."), -1).otherwise(0)
    if kind == "card":
        return F.when(m.rlike(ISSUERS), 1).otherwise(-1)
    if kind == "phone":
        return F.when(m.rlike(CALLING_CODES), 1).otherwise(-1)
    if kind == "iban":
        return F.when(m.rlike(r"^(?:DE|FR|ES|GB|IT|NL|AT|CH|BE|PT|IE)"), 1).otherwise(-1)
    return F.lit(0)


def _neighbour(ch: Column) -> Column:
    """0 nothing, 1 white space, 2 a letter or digit, 3 any other mark."""
    return F.when(F.length(ch) == 0, 0).when(ch.rlike(r"\s"), 1).when(ch.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """Every match of every pattern with the labelers' votes and its shape, by kind, then start."""

    def of(rank: int, kind: str) -> Column:
        return F.transform(
            spans(text, PATTERNS[kind], around=AROUND),
            lambda s: F.struct(
                F.lit(rank).alias("rank"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.lit(kind).alias("kind"),
                F.when(valid(kind, s["match"]), 1).otherwise(-1).alias("valid"),
                _gazetteer(kind, s["match"]).alias("gazetteer"),
                let(F.lower(s["before"]), lambda b: F.when(b.rlike(CUES[kind]), 1).when(b.rlike(AGAINST), -1).otherwise(0)).alias("context"),
                F.when(s["before"].rlike(r"[\p{L}\p{N}_]$") | s["after"].rlike(r"^[\p{L}\p{N}_@]"), -1).otherwise(1).alias("edges"),
                F.least(F.lit(3), F.floor(F.length(s["match"]) / 8)).cast("int").alias("length"),
                F.floor(F.length(_digits(s["match"])) * 3 / F.length(s["match"])).cast("int").alias("digits"),
                _neighbour(F.right(s["before"], F.lit(1))).alias("lead"),
                _neighbour(s["after"]).alias("tail"),
            ),
        )

    return F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]).cast(CANDIDATE)


@dataclass
class SpanModel:
    """What is learnt: a labeler's chance of each vote given the truth, and the classifier's weights by feature name."""

    prior: float = 0.5
    vote: dict[str, dict[int, tuple[float, float]]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)

    def probability(self, s: Column) -> Column:
        z = F.lit(self.weights.get("bias", 0.0))
        for name, w in sorted(self.weights.items()):
            column, _, value = name.partition("=")
            kind, _, level = value.rpartition(":")
            if column == "kind":
                z = z + F.when(s["kind"] == value, F.lit(w)).otherwise(F.lit(0.0))
            elif value:
                z = z + F.when((s["kind"] == kind) & (s[column] == int(level)), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def span_features(kind: str, votes: dict[str, int], shape: dict[str, int]) -> list[str]:
    return ["bias", f"kind={kind}", f"context={kind}:{votes['context']}", *[f"{k}={kind}:{v}" for k, v in shape.items()]]


def reliabilities(counts: list[tuple[dict[str, int], int]], rounds: int = 50) -> tuple[SpanModel, list[float]]:
    """counts: (votes, n). Expectation-maximisation: the model of the labelers, and how likely each pattern is personal data."""
    model = SpanModel(vote={k: {1: (0.7, 0.2), 0: (0.2, 0.3), -1: (0.1, 0.5)} for k in LABELERS})
    total = sum(n for _, n in counts)
    likely = [0.0] * len(counts)
    for _ in range(rounds if total else 0):
        for i, (votes, _) in enumerate(counts):
            yes, no = model.prior, 1 - model.prior
            for k, v in votes.items():
                yes, no = yes * model.vote[k][v][0], no * model.vote[k][v][1]
            likely[i] = yes / (yes + no)
        positive = sum(q * n for q, (_, n) in zip(likely, counts, strict=True))
        model.prior = min(0.99, max(0.01, positive / total))
        for k in LABELERS:
            for v in (-1, 0, 1):
                a = sum(q * n for q, (votes, n) in zip(likely, counts, strict=True) if votes[k] == v)
                b = sum((1 - q) * n for q, (votes, n) in zip(likely, counts, strict=True) if votes[k] == v)
                model.vote[k][v] = ((a + 1) / (positive + 3), (b + 1) / (total - positive + 3))
    return model, likely


def fit(counts: list[tuple[str, dict[str, int], dict[str, int], int]], steps: int = 400) -> SpanModel:
    """counts: (kind, votes, shape, n). EM over the votes, then logistic regression on EM's likelihoods."""
    patterns: dict[tuple, int] = {}
    for _, votes, _, n in counts:
        key = tuple(votes[k] for k in LABELERS)
        patterns[key] = patterns.get(key, 0) + n
    model, likely = reliabilities([(dict(zip(LABELERS, key, strict=True)), n) for key, n in patterns.items()])
    target = dict(zip(patterns, likely, strict=True))
    rows: dict[tuple, list[float]] = {}
    for kind, votes, shape, n in counts:
        got = rows.setdefault(tuple(span_features(kind, votes, shape)), [0.0, 0.0])
        got[0] += n
        got[1] += n * target[tuple(votes[k] for k in LABELERS)]
    total = sum(n for n, _ in rows.values())
    w = dict.fromkeys((x for row in rows for x in row), 0.0)
    for _ in range(steps):
        grad = {k: 1e-4 * v for k, v in w.items()}
        for row, (n, positive) in rows.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w[x] for x in row)))))
            for x in row:
                grad[x] += (p * n - positive) / total
        for x, g in grad.items():
            w[x] -= g
    model.weights = w
    return model


def clear_of(added: Column, base: Column) -> Column:
    """The added spans that no base span overlaps, in their order.

    One sweep over both, by where base spans begin and added ones end: an added span is overlapped if the
    furthest end of the base spans that begin before its own end lies beyond its start.
    """
    event = "struct<at:int,base:int,other:int,id:int>"
    state = "struct<furthest:int,done:array<array<int>>,now:array<int>>"
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("base"), b["end"].alias("other"), F.lit(-1).alias("id")))
    of_added = F.transform(added, lambda a, i: F.struct(a["end"].alias("at"), F.lit(0).alias("base"), a["start"].alias("other"), i.alias("id")))
    events = F.sort_array(F.concat(of_base, of_added)).cast(f"array<{event}>")

    def step(acc: Column, e: Column) -> Column:
        clear = (e["base"] == 0) & (acc["furthest"] <= e["other"])
        full = F.size(acc["now"]) >= SCAN_BLOCK
        own = F.array(e["id"])
        return F.struct(
            F.when(e["base"] == 1, F.greatest(acc["furthest"], e["other"])).otherwise(acc["furthest"]).alias("furthest"),
            F.when(clear & full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(clear & full, own).when(clear, F.concat(acc["now"], own)).otherwise(acc["now"]).alias("now"),
        ).cast(state)

    zero = F.expr(f"cast(named_struct('furthest', 0, 'done', array(), 'now', array()) as {state})")
    kept = F.aggregate(events, zero, step, lambda acc: F.sort_array(F.concat(F.flatten(acc["done"]), acc["now"])))
    return F.when(F.size(added) > 0, F.transform(kept, lambda i: F.get(added, i))).otherwise(added)


def find(docs: DataFrame, least: float = 0.5) -> tuple[DataFrame, SpanModel]:
    """docs: doc_id, text -> (doc_id, spans), one row per row, and the model.

    spans: rank, start, end, kind by kind, then start. Base kinds hold exactly the matches that pass the
    contract's tests; an added span is kept where it passes its kind's own tests, the classifier gives it `least` and no
    base span overlaps it. Null or empty text has none; texts of any length are read whole; repeated rows count and
    stay; other columns, whatever they are called, aren't read; an empty table gives none, and without candidates nothing
    is learnt. Texts are read once; candidates are written to the shared folder, and learning reads those.
    """
    found = cut(docs.select("doc_id", candidates(F.coalesce("text", F.lit(""))).alias("c")), "pii")
    by = ("kind", *LABELERS, *SHAPES)
    grouped = found.select(F.inline("c")).groupBy(*by).count().orderBy(*by).collect()
    model = fit([(r["kind"], {k: r[k] for k in LABELERS}, {k: r[k] for k in SHAPES}, r["count"]) for r in grouped])
    is_base = lambda s: s["kind"].isin(*BASE)
    base = F.filter("c", lambda s: is_base(s) & (s["valid"] == 1))
    likely = F.filter("c", lambda s: ~is_base(s) & (s["valid"] == 1) & (model.probability(s) >= least))
    parts = found.select("doc_id", base.alias("base"), likely.alias("likely"))
    return parts.select("doc_id", F.concat("base", clear_of(F.col("likely"), F.col("base"))).alias("spans")), model


def digest(found: DataFrame) -> DataFrame:
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(table(spark, sf_dir, "documents", "doc_id", "text"))[0])
