"""URL filters: host and path rules first, then a path-template tree per host, in DataFrame functions only.

Paths are reduced to templates level by level. Within a node, children that are rare among many become one
wildcard; then children whose share of bad labels does not differ from their node's (a two-sided z test) are
merged, and so are those clearly above it and those clearly below. A template is rejected where its smoothed
share of bad labels is so many times the overall share; how many is chosen on a fifth of the labels, kept
aside, on which the rejected templates must come out as bad as they look. Where labels don't depend on paths,
nothing is rejected. All levels work on counts per distinct path shape, never on pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: (host, path, verdict); a list up to some thousands, compiled into one expression, longest first.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 20  #: pages that a literal segment needs among many
MAX_CHILDREN = 20  #: literal segments that a node keeps without that support
Z = 1.96  #: |z| below which a branch counts as like its node
PRIOR = 20.0  #: pseudo-labels at the overall bad share
LIFTS = (1.5, 2.0, 3.0)  #: smoothed bad share of a template over the overall share from which it is rejected; the least that holds
ASIDE = 5  #: labels whose page number this divides choose the lift, the others grow and judge the tree


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits the host, or a domain above it, and the path's start."""
    out = F.lit(None)
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape_of(path: Column) -> Column:
    """The path's segments, digits as {n}; empty segments are folded."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/", -1), lambda s: s != "")


def templates(shapes: DataFrame) -> DataFrame:
    """shapes: host, shape, n, labelled, bad and others -> these and `template`, the tree node in which a shape ends.

    A node is named by its host and, for each level, the kind of its branch (like, worse or better than the node
    above), the branch, and how many more are merged with it. Where all shapes of a node go on alike, nothing can part
    them: it is followed at once to where they differ or end, by its least and its greatest shape. So there is
    a round for each time that a path branches, however deep it is; a lone path takes one.
    """
    shapes = cut(shapes.withColumns({"template": F.col("host"), "level": F.lit(0)}), "shapes")
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    while True:
        live = shapes.where(F.size("shape") > F.col("level"))
        rest = F.slice("shape", F.col("level") + 1, F.size("shape"))
        heads = live.groupBy("template").agg(F.min(rest).alias("least"), F.max(rest).alias("greatest"))
        parted = F.array_position(F.zip_with("least", "greatest", lambda a, b: a.eqNullSafe(b)), F.lit(False)).cast("int")
        heads = heads.select("template", F.slice("least", 1, F.when(parted == 0, F.size("least")).otherwise(parted - 1)).alias("same"))
        followed = shapes.where(F.size("shape") <= F.col("level")).unionByName(
            live.join(heads, "template")
            .withColumns({"template": F.concat_ws("/", "template", F.transform("same", lambda s: F.concat(F.lit("like:"), s))), "level": F.col("level") + F.size("same")})
            .drop("same")
        )
        shapes = cut(followed, "shapes")
        here = shapes.where(F.size("shape") > F.col("level")).withColumn("segment", F.get("shape", F.col("level")))
        if not here.limit(1).count():
            return shapes.drop("level")
        child = here.groupBy("template", "segment").agg(*sums)
        node = child.groupBy("template").agg(F.count("*").alias("children"), F.sum("labelled").alias("node_labelled"), F.sum("bad").alias("node_bad"))
        wild = (F.col("children") > MAX_CHILDREN) & (F.col("n") < MIN_SUPPORT)
        child = child.join(node, "template").withColumn("branch", F.when(wild, F.lit("*")).otherwise(F.col("segment")))
        branch = child.groupBy("template", "branch").agg(*sums, F.first("node_labelled").alias("node_labelled"), F.first("node_bad").alias("node_bad"))
        share = F.try_divide(F.col("node_bad").cast("double"), F.col("node_labelled").cast("double"))
        z = F.coalesce(F.try_divide(F.col("bad") - F.col("labelled") * share, F.sqrt(F.col("labelled") * share * (1 - share))), F.lit(0.0))
        merged = branch.select("template", "branch", F.when(z >= Z, F.lit("worse")).when(z <= -Z, F.lit("better")).otherwise(F.lit("like")).alias("group"))
        more = F.when(F.count("*") > 1, F.concat(F.lit("(+"), F.count("*") - 1, F.lit(")"))).otherwise(F.lit(""))
        named = merged.groupBy("template", "group").agg(F.concat(F.col("group"), F.lit(":"), F.min("branch"), more).alias("name"))
        step = child.select("template", "segment", "branch").join(merged, ["template", "branch"]).join(named, ["template", "group"])
        step = step.select("template", "segment", F.concat_ws("/", "template", "name").alias("next"))
        shapes = cut(
            shapes.withColumn("segment", F.get("shape", F.col("level")))
            .join(step, ["template", "segment"], "left")
            .withColumns({"template": F.coalesce("next", "template"), "level": F.when(F.col("next").isNotNull(), F.col("level") + 1).otherwise(F.col("level"))})
            .drop("segment", "next"),
            "shapes",
        )


def chosen_lift(purity: DataFrame, overall: float) -> float | None:
    """purity: template, bad_share, aside, aside_bad -> the least lift whose rejected templates are as bad on labels kept aside.

    Three pairs of sums reach the driver. None, for no rejection, if no lift holds or nothing is left aside of what it rejects.
    """
    over = [F.col("bad_share") >= lift * overall for lift in LIFTS]
    sums = purity.agg(*[F.sum(F.when(o, F.col(c)).otherwise(0)).alias(f"{c}_{k}") for k, o in enumerate(over) for c in ("aside", "aside_bad")]).first()
    for k, lift in enumerate(LIFTS):
        seen, bad = sums[f"aside_{k}"] or 0, sums[f"aside_bad_{k}"] or 0
        if seen and overall and bad >= lift * overall * seen:
            return lift
    return None


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages: page_id, url; labels: page_number, bad (0/1), where a url's last number names the labelled page.

    One row per row, repeats included: page_id, host, path, rule, verdict, template, bad_share. A null url or one
    without "://" has empty host and path, which no rule fits; a number beyond a long names nothing; of labels of one
    page the bad one counts; templates without any label are allowed, and so are all with an empty labels table; an
    empty pages table gives none. Urls of any length and depth are judged by all of their path, ties among rules don't
    arise, other columns aren't read. A host with a third of all pages is pre-aggregated to its shapes; only the final
    join meets pages, on (host, shape), large side split by Spark.
    """
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = at.withColumns({"shape": shape_of(F.col("path")), "r": rule_of(F.col("host"), F.col("path"), rules)})
    number = F.regexp_extract("path", r"([0-9]+)[^0-9/]*/?$", 1).try_cast("long")
    known = labels.where(F.col("page_number").isNotNull()).groupBy("page_number").agg(F.max("bad").alias("label"))
    aside = F.col("page_number") % ASIDE == 0
    count = lambda of: F.coalesce(F.sum(F.when(of, F.col("n"))), F.lit(0))
    counted = (
        at.groupBy("host", "shape", number.alias("page_number")).agg(F.count("*").alias("n"))
        .join(known, "page_number", "left")
        .groupBy("host", "shape")
        .agg(
            F.sum("n").alias("n"),
            count(F.col("label").isNotNull() & ~aside).alias("labelled"),
            count((F.col("label") == 1) & ~aside).alias("bad"),
            count(F.col("label").isNotNull() & aside).alias("aside"),
            count((F.col("label") == 1) & aside).alias("aside_bad"),
        )
    )
    tree = templates(counted)
    total = tree.agg(F.sum("labelled"), F.sum("bad")).first()
    overall = (total[1] or 0) / total[0] if total[0] else 0.0
    smoothed = ((F.sum("bad") + PRIOR * overall) / (F.sum("labelled") + PRIOR)).alias("bad_share")
    purity = cut(tree.groupBy("template").agg(smoothed, *[F.sum(c).alias(c) for c in ("labelled", "aside", "aside_bad")]), "purity")
    lift = chosen_lift(purity, overall)
    rejected = (F.col("labelled") > 0) & (F.col("bad_share") >= lift * overall) if lift else F.lit(False)
    verdicts = tree.select("host", "shape", "template").join(purity, "template").withColumnRenamed("host", "h").withColumnRenamed("shape", "s")
    return at.join(verdicts, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "template",
        F.round("bad_share", 9).alias("bad_share"),
    )


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: a url's number names the document that the page shows; bad is low quality or toxic."""
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    return judge(table(spark, sf_dir, "pages", "page_id", "url"), labels.select(F.col("doc_id").alias("page_number"), bad.alias("bad")))


def _sql(levels: int) -> str:
    """The whole filter in SQL, for paths of at most so many segments."""
    fits = [(h, p, v) for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))]
    test = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = "CASE " + " ".join(f"WHEN {test(h, p)} THEN '{h}{p}'" for h, p, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {test(h, p)} THEN '{v}'" for h, p, v in fits) + " END"
    steps, last = [], "s0"
    for k in range(1, levels + 1):
        steps.append(f"""c{k} AS (SELECT template, shape[{k}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM {last} WHERE len(shape) >= {k} GROUP BY ALL),
b{k} AS (SELECT *, CASE WHEN count(*) OVER w > {MAX_CHILDREN} AND n < {MIN_SUPPORT} THEN '*' ELSE segment END AS branch, sum(labelled) OVER w AS nl, sum(bad) OVER w AS nb FROM c{k} WINDOW w AS (PARTITION BY template)),
z{k} AS (SELECT template, branch, sum(bad) AS bad, sum(labelled) AS labelled, any_value(nb) / nullif(any_value(nl), 0) AS share FROM b{k} GROUP BY ALL),
g{k} AS (SELECT template, branch, CASE WHEN z >= {Z} THEN 'worse' WHEN z <= -{Z} THEN 'better' ELSE 'like' END AS grp
  FROM (SELECT *, coalesce((bad - labelled * share) / nullif(sqrt(labelled * share * (1 - share)), 0), 0) AS z FROM z{k})),
m{k} AS (SELECT template, grp, grp || ':' || min(branch) || CASE WHEN count(*) > 1 THEN '(+' || (count(*) - 1) || ')' ELSE '' END AS name FROM g{k} GROUP BY template, grp),
s{k} AS (SELECT s.* REPLACE (coalesce(s.template || '/' || m.name, s.template) AS template) FROM {last} s
  LEFT JOIN b{k} b ON s.template = b.template AND s.shape[{k}] = b.segment LEFT JOIN g{k} g ON g.template = b.template AND g.branch = b.branch
  LEFT JOIN m{k} m ON m.template = g.template AND m.grp = g.grp)""")
        last = f"s{k}"
    lifts = " ".join(f"WHEN sum(CASE WHEN bad_share >= {x} * overall THEN aside END) > 0 AND any_value(overall) > 0 AND sum(CASE WHEN bad_share >= {x} * overall THEN aside_bad END) >= {x} * any_value(overall) * sum(CASE WHEN bad_share >= {x} * overall THEN aside END) THEN {x}" for x in LIFTS)
    return rf"""WITH u AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), p AS (
  SELECT *, list_filter(string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/'), lambda x: x <> '') AS shape,
    try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*/?$', 1) AS BIGINT) AS number, {rule} AS rule, {verdict} AS ruled FROM u
), k AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS label FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), s0 AS (
  SELECT host, shape, host AS template, count(*) AS n, count(label) FILTER (number % {ASIDE} <> 0) AS labelled, count(*) FILTER (label = 1 AND number % {ASIDE} <> 0) AS bad,
    count(label) FILTER (number % {ASIDE} = 0) AS aside, count(*) FILTER (label = 1 AND number % {ASIDE} = 0) AS aside_bad
  FROM p LEFT JOIN k ON number = doc_id GROUP BY 1, 2
), {", ".join(steps)}, o AS (SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS overall FROM {last}),
t AS (SELECT template, (sum(bad) + {PRIOR} * any_value(overall)) / (sum(labelled) + {PRIOR}) AS bad_share, sum(labelled) AS labelled, sum(aside) AS aside, sum(aside_bad) AS aside_bad, any_value(overall) AS overall FROM {last}, o GROUP BY 1),
f AS (SELECT CASE {lifts} END AS lift FROM t)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN t.labelled > 0 AND bad_share >= lift * overall THEN 'block' ELSE 'allow' END) AS verdict, template, round(bad_share, 9) AS bad_share
FROM p LEFT JOIN {last} s ON s.host = p.host AND s.shape = p.shape LEFT JOIN t USING (template) CROSS JOIN f"""


SQL = _sql(3)
