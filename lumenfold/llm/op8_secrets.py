"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a path is addressed by its content. A ledger holds which (blob, rule version) pairs have been
scanned and what was found; a run scans unseen pairs alone, once per blob however many paths hold it, adds
them to the ledger and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SCAN_BLOCK, as_table, cut, let, span_list, spans, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # characters that the match, or its group, needs
    group: int = 0


#: Rules in the order in which kinds are listed; the first three are the base.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 1),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
)
RULE_VERSION = "1"
BASE = ("assign", "access", "hex")
BROADCAST_SPANS = 500_000  #: spans, and blobs that hold them, of about 50 bytes that are broadcast at most
FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"


def findings(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<start,rank,kind,end>> by start, then rule order."""

    def of(rank: int, rule: Rule) -> Column:
        # A maximal run needs no search beyond its least length, so a fixed run is required up front: same matches.
        pattern = rule.pattern if rule.group or not rule.least else _at_least(rule)
        keep = None
        if rule.least:
            part = (lambda m: F.regexp_extract(m, rule.pattern, rule.group)) if rule.group else (lambda m: m)
            keep = lambda m: F.length(part(m)) >= rule.least
        return F.transform(
            spans(text, pattern, keep),
            lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s["end"].alias("end")),
        )

    return F.sort_array(F.concat(*[of(k, r) for k, r in enumerate(rules)])).cast(FINDING)


def _at_least(rule: Rule) -> str:
    if rule.kind == "access":
        return r"AKIA[A-Z0-9]{16,}"
    if rule.kind == "hex":
        return r"[0-9a-f]{24,}"
    return rule.pattern


def _counted(findings: DataFrame) -> DataFrame:
    """Marked for broadcast if its counted spans are few; else left to a shuffle on the blob."""
    spans_of, blobs = findings.agg(F.sum(F.size("findings")), F.count("*")).first()
    return F.broadcast(findings) if (spans_of or 0) + blobs <= BROADCAST_SPANS else findings


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(paths, entries): findings of every version, and the new ledger entries to append.

    versions: path, text and whatever else; one row out per row in, with blob and findings added, or replaced
    where columns of these names were there. ledger: blob, rule_version, findings, as `read_ledger` has it; a blob that
    runs side by side have entered twice counts once.
    Null text counts as empty; repeated rows and copies share a blob and stay; texts of any length are scanned
    whole. An empty table gives none. The text of each unseen blob moves once, for the path elected to stand for
    it. Only blobs with findings are joined back: by broadcast up to BROADCAST_SPANS counted spans, so that no text
    moves again; beyond that by a shuffle on the blob, of which one with a third of all paths meets one row, a join
    whose large side Spark splits.
    """
    addressed = versions.withColumn("blob", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    unseen = addressed.groupBy("blob").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    seen = None if ledger is None else ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
    if seen is not None:
        unseen = addressed.join(seen.select("blob"), "blob", "left_anti").groupBy("blob").agg(F.first(F.coalesce("text", F.lit(""))).alias("text"))
    entries = cut(unseen.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("text"), rules).alias("findings")), "ledger")
    known = entries if seen is None else entries.unionByName(seen)
    some = known.where(F.size("findings") > 0).select("blob", "findings")
    none = F.expr(f"cast(array() as {FINDING})")
    paths = addressed.drop("findings").join(_counted(some), "blob", "left").withColumn("findings", F.coalesce("findings", none))
    return paths, entries


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """An entry for each blob and rule version that runs have appended at this path, in a folder that driver and executors share."""
    return spark.read.schema(f"blob binary, rule_version string, findings {FINDING}").parquet(path).dropDuplicates(["blob", "rule_version"])


def scan_into(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """The paths of `scan`, against the ledger at this path, which then holds what this run has scanned as well.

    The first run makes the ledger. Spark commits an append as a whole, so a run that fails adds nothing and is
    repeated as it was.
    """
    spark = versions.sparkSession
    as_table(spark, [], f"blob binary, rule_version string, findings {FINDING}").write.mode("append").parquet(path)
    paths, entries = scan(versions, read_ledger(spark, path), rules, rule_version)
    entries.write.mode("append").parquet(path)
    return paths


def unions(found: Column) -> Column:
    """Maximal unions of overlapping or touching findings, which come by start; gathered in blocks, so in near-linear time."""
    span = "struct<start:int,end:int>"
    state = f"struct<done:array<array<{span}>>,now:array<{span}>,last:{span}>"

    def push(acc: Column, s: Column) -> Column:
        meets = acc["last"]["end"] >= s["start"]
        full = F.size(acc["now"]) >= SCAN_BLOCK
        closed = F.when(acc["last"].isNull(), acc["now"]).when(full, F.array(acc["last"])).otherwise(F.concat(acc["now"], F.array(acc["last"])))
        grown = F.struct(acc["last"]["start"].alias("start"), F.greatest(acc["last"]["end"], s["end"]).alias("end"))
        own = F.struct(s["start"].alias("start"), s["end"].alias("end"))
        return F.struct(
            F.when(~F.coalesce(meets, F.lit(False)) & full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(meets, acc["now"]).otherwise(closed).alias("now"),
            F.when(meets, grown).otherwise(own).alias("last"),
        ).cast(state)

    zero = F.expr(f"cast(named_struct('done', array(), 'now', array(), 'last', null) as {state})")
    return F.aggregate(found, zero, push, lambda acc: F.concat(F.flatten(acc["done"]), acc["now"], F.filter(F.array(acc["last"]), lambda x: x.isNotNull())))


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every maximal union of overlapping findings replaced by the mark.

    A block of unions is cut out of the text first and then cut itself, since finding a place in a string takes
    time up to there.
    """

    def block(m: Column, k: Column) -> Column:
        own = F.slice(m, k * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))
        base = F.coalesce(F.get(m, k * SCAN_BLOCK - 1)["end"], F.lit(0))
        part = F.struct(own.alias("own"), base.alias("base"), F.substr(text, base + 1, F.element_at(own, -1)["end"] - base).alias("part"))

        def piece(b: Column, s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(b["own"], i - 1)["end"], b["base"])
            return F.concat(F.substr(b["part"], before - b["base"] + 1, s["start"] - before), F.lit(mark))

        return let(part, lambda b: F.array_join(F.transform(b["own"], lambda s, i: piece(b, s, i)), ""))

    def whole(m: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / SCAN_BLOCK).cast("int")), lambda k: block(m, k))
        return F.concat(F.array_join(blocks, ""), F.substr(text, F.element_at(m, -1)["end"] + 1))

    return F.when(F.size(found) > 0, let(unions(found), whole)).otherwise(text)


def digest(paths: DataFrame, key: str) -> DataFrame:
    """The contract's columns of scanned paths."""
    of = lambda k: F.size(F.filter("findings", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return paths.select(
        key,
        *[of(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("findings")).alias("spans"),
    )


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, _ = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return digest(paths, "doc_id")


def _sql_rule(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    size = f"length(regexp_extract(h, '{pattern}', {rule.group})) >= {rule.least}"
    return f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, s, s + length(h) AS e FROM (
      SELECT r, hit[i] AS h, list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS s
      FROM (SELECT r, hit, gap, unnest(range(1, len(hit) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(text, '{pattern}') AS hit, string_split_regex(text, '{pattern}') AS gap FROM d)))
      WHERE {size}"""


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_sql_rule(k, x) for k, x in enumerate(RULES))}),
g AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (r)
"""
