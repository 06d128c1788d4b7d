"""Quality rules: one threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, let, table

SYMBOL = r"[#*$%&|<>]"

#: Frequent function words of the four languages, as they stand within a sentence.
STOP_WORDS = tuple(
    """the of and to a in is that for it was on with as be by are this at from or an not
    der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an
    de la le les et un du une que pour est dans qui par pas sur au en
    el los las del por con no para su al se lo como y""".split()
)

#: (measure, least, most): a text is kept if every measure lies within its bounds; None is no bound.
THRESHOLDS = (
    ("n_words", 50.0, None),
    ("mean_word_chars", 2.0, 12.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.05, None),
    ("repeat_ratio", None, 0.5),
    ("dup_line_ratio", None, 0.5),
)


def repeat_words(words: Column) -> Column:
    """Words within 3-word windows that a text holds twice or more, the first occurrence included.

    Texts whose windows all have different 64-bit hashes, the most, are settled by one distinct; the rest sort
    (hash, window, position), so that windows of one hash are still told apart, and sum up what the repeated ones cover.
    """

    def covered(keys: Column) -> Column:
        window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
        at = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), window(i).alias("w"), i.alias("i"))))
        alike = lambda s, x, i: (F.get(s, i)["k"] == x["k"]) & (F.get(s, i)["w"] == x["w"])
        repeated = let(at, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: alike(s, x, i - 1) | alike(s, x, i + 1)), lambda x: x["i"])))
        return F.aggregate(
            repeated,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + p + 3 - F.greatest(p, acc["end"])).alias("n")),
            lambda acc: acc["n"],
        )

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(windows, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(covered(k)))


def measures(text: Column) -> Column:
    """Struct of the counts that all rules are made of; the text is cut into words once."""
    dup_lines = let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    return let(
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)),
        lambda w: let(
            dup_lines,
            lambda lines: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
                lines["dup"].cast("long").alias("n_dup_lines"),
                repeat_words(w).cast("long").alias("n_repeat_words"),
                lines["all"].cast("long").alias("n_lines"),
                F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            ),
        ),
    )


def compiled(thresholds: tuple = THRESHOLDS) -> Column:
    """The table as one boolean column over the fields of `measures`."""
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"m.{a}").cast("double"), F.col(f"m.{b}").cast("double")), F.lit(0.0))
    value = {
        "n_words": F.col("m.n_words").cast("double"),
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "stop_word_ratio": share("n_stop_words", "n_words"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
    }
    kept = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            kept = kept & (value[name] >= F.lit(least))
        if most is not None:
            kept = kept & (value[name] <= F.lit(most))
    return kept


def judge(docs: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """docs: doc_id, text. One row per row, repeats included: counts, base_failed, kept.

    Null text counts as empty: no words, base_failed. An empty table gives none. Other columns aren't read. Rows never meet, so very
    frequent texts or lines shift no load; work is n log n in a text's words at most.
    """
    m = docs.select("doc_id", measures(F.coalesce("text", F.lit(""))).alias("m"))
    failed = (F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words"))
    base = [f"m.{k}" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return m.select("doc_id", *base, failed.alias("base_failed"), (~failed & compiled(thresholds)).alias("kept"), "m.n_lines", "m.n_stop_words")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n >= 2
), cov AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(words, lambda x: x IN ({", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words
  FROM w LEFT JOIN cov USING (r)
), f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT *, NOT base_failed AND coalesce(word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1
  AND n_stop_words / n_words >= 0.05 AND n_repeat_words / n_words <= 0.5 AND n_dup_lines / n_lines <= 0.5, false) AS kept
FROM f
"""
