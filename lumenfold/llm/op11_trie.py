"""The prefix trie of conversations by partition refinement.

All conversations start in one class. A round splits the active classes turn by turn: a conversation's next turns are
chained to its class by SHA-256, so that conversations that go on alike land in one class without a join. A class of
one conversation is retired at once: its tail is a unary chain, told by where it begins and how long it is. What
is still shared goes into the next round, which takes twice the turns. Folding back adds up subtrees over the shared
nodes alone, by pointers to ancestors at distances that double.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

FAMILY, GIVEN = 20, 4  #: conversations that may take turns of one donor; a conversation takes fewer turns than this
FIRST_STEP, LAST_STEP = 4, 256  #: turns that a round takes, doubled up to the last
CHAIN_BLOCK = 1024  #: nodes of an unary chain that one row makes
ENDS_BLOCK = 9  #: bits of conv_id within a run of ends
ROOT = bytes(32)
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), words; texts stay where they are read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), words.alias("words"))


def own_turns_given(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its donor."""
    return F.crc32(conv_id.cast("string").cast("binary")) % GIVEN


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, words of every rebuilt turn; conv_id, length of every conversation).

    Rows are sorted by ranges and numbered within a range, and ranges say how many rows of a conversation come
    before them: a conversation with a third of all turns is spread over tasks.
    """
    parts = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = cut(turns.repartitionByRange(parts, F.col("conv_id"), *order).withColumn("part", F.spark_partition_id()), "turns")
    own = Window.partitionBy("conv_id")
    runs = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = cut(runs.select("conv_id", "part", before.alias("before"), F.sum("n").over(own).alias("total")), "runs")
    known = runs.where("before = 0").select("conv_id", "total").withColumn("h", own_turns_given(F.col("conv_id"))).withColumn("donor", F.col("conv_id") - F.col("conv_id") % FAMILY)
    held = known.where(f"conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("donor"), F.col("total").alias("held"))
    known = known.join(held, "donor", "left").withColumn("taken", F.least("h", F.coalesce("held", F.lit(0))))
    known = cut(known.select("conv_id", "donor", "h", "taken", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length")), "known")
    at = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order)) + F.col("before")
    numbered = dealt.join(runs.join(known, "conv_id").select("conv_id", "part", "before", "h", "taken"), ["conv_id", "part"]).withColumn("at", at.cast("long"))
    numbered = cut(numbered.select("conv_id", "at", "h", "taken", "digest", "words"), "numbered")
    kept = numbered.where("at > h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words")
    lent = numbered.where(f"conv_id % {FAMILY} = 0 and at < {GIVEN}").select(F.col("conv_id").alias("donor"), F.col("at").alias("depth"), "digest", "words")
    given = lent.join(known.select("conv_id", "donor", "taken"), "donor").where("depth <= taken").select("conv_id", "depth", "digest", "words")
    return cut(kept.unionByName(given), "rebuilt"), known.select("conv_id", "length")


def _chained(start: Column, turns: Column) -> Column:
    """The nodes that a run of turns passes, each named by the hash of its parent's name and its turn."""
    kind = "array<struct<depth:bigint,parent:binary,id:binary,words:bigint>>"

    def onward(path: Column, turn: Column) -> Column:
        last = F.coalesce(F.get(path, F.size(path) - 1)["id"], start)
        name = F.unhex(F.sha2(F.concat(last, turn["digest"]), 256))
        return F.concat(path, F.array(F.struct(turn["depth"].alias("depth"), last.alias("parent"), name.alias("id"), turn["words"].alias("words"))))

    return F.aggregate(turns, F.expr(f"cast(array() as {kind})"), onward)


def refined(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared nodes: id, parent, depth, words, n, conv_id; tails: conv_id, depth, parent; ends: id, conv_id).

    The root counts as shared however few conversations there are. A tail begins where its conversation is alone.
    """
    spark = turns.sparkSession
    shared = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n > 0")
    shared = shared.select(F.lit(ROOT).alias("id"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "n", "conv_id")
    ends = lengths.where("length = 0").select(F.lit(ROOT).alias("id"), "conv_id")
    tails = spark.createDataFrame([], "conv_id long, depth long, parent binary")
    active = lengths.where("length > 0").select("conv_id", "length", F.lit(ROOT).alias("class"))
    depth, step = 0, FIRST_STEP
    while active.limit(1).count():
        now = turns.where((F.col("depth") > depth) & (F.col("depth") <= depth + step)).join(active, "conv_id").groupBy("conv_id", "length", "class")
        paths = now.agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns"))
        paths = cut(paths.select("conv_id", "length", _chained(F.col("class"), F.col("turns")).alias("path")), "paths")
        same = [F.first(c).alias(c) for c in ("parent", "depth", "words")]
        classes = cut(paths.select("conv_id", F.inline("path")).groupBy("id").agg(*same, F.count("*").alias("n"), F.min("conv_id").alias("conv_id")), "classes")
        shared = shared.unionByName(classes.where("n > 1"))
        alone = classes.where("n = 1").groupBy("conv_id").agg(F.min("depth").alias("depth"), F.min_by("parent", "depth").alias("parent"))
        alone = cut(alone, "retired")
        tails = tails.unionByName(alone)
        left = paths.join(alone.select("conv_id"), "conv_id", "left_anti").select("conv_id", "length", F.element_at("path", -1)["id"].alias("class"))
        left = cut(left, "left")
        depth += step
        ends = ends.unionByName(left.where(F.col("length") <= depth).select(F.col("class").alias("id"), "conv_id"))
        active = left.where(F.col("length") > depth)
        step = min(2 * step, LAST_STEP)
    return cut(shared, "shared"), tails, ends


def folded(shared: DataFrame, tails: DataFrame) -> DataFrame:
    """Shared nodes with n_children, and n_leaves and saved_tokens of their subtrees."""
    hung = tails.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("hung"))
    kids = shared.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("kids"))
    nodes = shared.join(hung, "id", "left").join(kids, "id", "left").fillna(0, ["hung", "kids"]).withColumn("n_children", F.col("hung") + F.col("kids"))
    leaf = F.col("hung") + (F.col("n_children") == 0).cast("long")
    nodes = nodes.select("id", "parent", "depth", "n", "conv_id", "n_children", F.col("parent").alias("up"), leaf.alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    nodes = cut(nodes, "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        below = nodes.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        onward = nodes.where(F.col("depth") >= reach).select(F.col("id").alias("up"), F.col("up").alias("next"))
        added = nodes.join(below, "id", "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
        far = added.where(F.col("depth") >= 2 * reach).join(onward, "up").drop("up").withColumnRenamed("next", "up")
        near = added.where(F.col("depth") < 2 * reach).withColumn("up", F.lit(None).cast("binary"))
        nodes = cut(far.unionByName(near), "nodes")
        reach *= 2
    return nodes.drop("up")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of ids, sorted by node: one hash a node, whatever its number of runs."""
    now, state = None, None
    for batch in batches:
        done = []
        for node, run in zip(batch["id"], batch["run"], strict=True):
            if node == now:
                state.update(b",")
            else:
                if state is not None:
                    done.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256()
            state.update(run.encode())
        yield pd.DataFrame(done, columns=["id", "ends_sha256"])
    if state is not None:
        yield pd.DataFrame([(now, state.hexdigest())], columns=["id", "ends_sha256"])


def hashed_ends(ends: DataFrame) -> DataFrame:
    """ends: id, conv_id -> id, ends_sha256. Ids move in runs; the hash of a node, which must be taken in order, streams."""
    run = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = ends.groupBy("id", F.shiftright("conv_id", ENDS_BLOCK).alias("block")).agg(run.alias("run"))
    return runs.repartition("id").sortWithinPartitions("id", "block").mapInPandas(_hashed, "id binary, ends_sha256 string")


def unary_chains(tails: DataFrame) -> DataFrame:
    """tails: conv_id, depth, length, parent_conv_id -> their nodes. Long chains are cut in blocks before they are written out."""
    block = lambda c: F.floor(F.col(c) / CHAIN_BLOCK).cast("long")
    cutup = tails.select("*", F.explode(F.sequence(block("depth"), block("length"))).alias("block"))
    one = F.floor(F.col("depth") / CHAIN_BLOCK) == F.floor(F.col("length") / CHAIN_BLOCK)
    spread = cutup.where(~one).repartition("conv_id", "block").unionByName(cutup.where(one))
    first, last = F.greatest("depth", F.col("block") * CHAIN_BLOCK), F.least("length", F.col("block") * CHAIN_BLOCK + (CHAIN_BLOCK - 1))
    rows = spread.select("conv_id", "length", "parent_conv_id", F.col("depth").alias("top"), F.explode(F.sequence(first, last)).alias("depth"))
    inner = F.col("depth") < F.col("length")
    return rows.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        inner.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(inner, F.lit(EMPTY)).otherwise(F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame) -> DataFrame:
    """conversations: conv_id, turn, role, text -> a row a node of the trie of rebuilt conversations.

    Rebuilt conversations begin with up to three turns of the one whose id is the next lower multiple of twenty. Turns
    go by `turn`, null first, those of one number by the hash of role and text; repeated rows are turns of their own.
    Null roles and texts are empty ones; rows without conv_id take no part; other columns, whatever they are
    called, aren't read. A conversation without turns left ends at the root. An empty table gives no node.
    """
    turns, lengths = rebuilt(turns_of(conversations))
    shared, tails, ends = refined(turns, lengths)
    nodes = folded(shared, tails)
    above = shared.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = nodes.join(above, "parent", "left").join(hashed_ends(ends), "id", "left")
    inner = inner.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    return inner.unionByName(unary_chains(tails.join(lengths, "conv_id").join(above, "parent").drop("parent")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS at, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS donor, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, x: list_reduce([xor(a, x)] || CAST(range(8) AS BIGINT[]), lambda y, i: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), given AS (SELECT c.conv_id, t.at AS depth, t.role, t.text FROM c JOIN t ON t.conv_id = c.donor AND t.at <= c.h),
r AS (
  SELECT * FROM given
  UNION ALL SELECT conv_id, t.at - h + coalesce(n, 0), role, text FROM t JOIN c USING (conv_id) LEFT JOIN (SELECT conv_id, count(*) AS n FROM given GROUP BY 1) USING (conv_id) WHERE t.at > h
), p AS (
  SELECT conv_id, depth, list(struct_pack(r := role, t := text)) OVER (PARTITION BY conv_id ORDER BY depth) AS path, text FROM r
  UNION ALL SELECT conv_id, 0, [], '' FROM c
), n AS (SELECT path, min(conv_id) AS conv_id, count(*) AS n, len(regexp_extract_all(any_value(text), '[^\x20\x09-\x0D]+')) AS words FROM p GROUP BY 1),
q AS (SELECT p.conv_id AS member, depth, n.conv_id, n.n, n.words FROM p JOIN n USING (path)),
node AS (SELECT DISTINCT conv_id, depth, n, words FROM q),
kin AS (SELECT node.*, q.conv_id AS parent_conv_id FROM node LEFT JOIN q ON q.member = node.conv_id AND q.depth = node.depth - 1),
kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM kin WHERE depth > 0 GROUP BY 1, 2),
sums AS (
  SELECT q.conv_id, q.depth, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((node.n - 1) * node.words) AS saved_tokens
  FROM node LEFT JOIN kids USING (conv_id, depth) JOIN q ON q.member = node.conv_id AND q.depth <= node.depth GROUP BY 1, 2
), ends AS (
  SELECT q.conv_id, q.depth, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS ids FROM q JOIN (SELECT conv_id AS member, max(depth) AS depth FROM p GROUP BY 1) USING (member, depth) GROUP BY 1, 2
)
SELECT conv_id, depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM kin LEFT JOIN kids USING (conv_id, depth) JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
