"""Queries of merging, metering, statistics and bracket planning, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as c
from ..functions import radiometry as r
from ..operators import exposure, raster, statistics
from .common import FRAME_H as H
from .common import FRAME_W as W
from .common import FRAMES as GRID
from .common import frames, read, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- merge ----------------------------------------------------------------------------------------------

def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Brackets: an order is a pixel, a line number a rung; repeated lines are one sample, the brightest."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    one = li.groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") / 50.0).alias("v"))
    return one.select("l_orderkey", "v", F.pow(F.lit(2.0), F.col("l_linenumber") - 4.0).alias("rel"), F.lit(1.0).alias("gain"))


MERGE = """
WITH s AS (
  SELECT l_orderkey, max(l_quantity) / 50.0 AS v, power(2.0, l_linenumber - 4.0) AS rel FROM lineitem GROUP BY l_orderkey, l_linenumber
), a AS (
  SELECT *, CASE WHEN v >= 0.99 THEN 0.0 WHEN v <= 0.9 THEN 1.0 ELSE 1 - ((v - 0.9) / 0.09) * ((v - 0.9) / 0.09) * (3 - 2 * (v - 0.9) / 0.09) END AS roll FROM s
), b AS (
  SELECT *, coalesce(sum(roll * rel * rel / (1e-4 * v + 4e-6) * v / rel) OVER p / nullif(sum(roll * rel * rel / (1e-4 * v + 4e-6)) OVER p, 0), 0) AS e1
  FROM a WINDOW p AS (PARTITION BY l_orderkey)
), d AS (
  SELECT *, roll * rel * rel / (1e-4 * least(1.0, greatest(0.0, e1 * rel)) + 4e-6) AS w2 FROM b
), g AS (
  SELECT l_orderkey, sum(w2 * v / rel) / nullif(sum(w2), 0) AS e2, sum(w2) AS weight, max(e1) AS e1, arg_min(v, rel) AS dark, min(rel) AS rel,
    max(v / sqrt(1e-4 * v + 4e-6)) AS snr FROM d GROUP BY l_orderkey
), m AS (
  SELECT l_orderkey, CASE WHEN dark >= 0.99 THEN 0.99 / rel ELSE coalesce(e2, e1) END AS radiance, weight, dark >= 0.99 AS saturated, snr < 1 AS noise_limited FROM g
)
"""


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return exposure.merge(samples(spark, sf), ["l_orderkey"])


@query(MERGE + "SELECT l_orderkey, round(radiance, 6) AS radiance, round(weight, 3) AS weight, saturated, noise_limited FROM m")
def merge_radiance(spark, sf):
    return rounded(merged(spark, sf), radiance=6, weight=3)


@query(MERGE + "SELECT CAST(saturated AS INT) + 2 * CAST(noise_limited AS INT) AS flags, count(*) AS pixels, round(avg(weight), 2) AS weight FROM m GROUP BY 1")
def merge_flags(spark, sf):
    f = exposure.flags(merged(spark, sf), ["l_orderkey"])
    return rounded(f.groupBy("flags").agg(F.count("*").alias("pixels"), F.avg("weight").alias("weight")), weight=2)


@query(MERGE + "SELECT round(avg(CAST(saturated AS INT)), 9) AS saturated, round(avg(CAST(noise_limited AS INT)), 9) AS noise_limited FROM m")
def saturated_fraction(spark, sf):
    m = merged(spark, sf)
    return rounded(m.agg(F.avg(F.col("saturated").cast("int")).alias("saturated"), F.avg(F.col("noise_limited").cast("int")).alias("noise_limited")), saturated=9, noise_limited=9)


@query(MERGE + """SELECT l_orderkey, round(CASE WHEN saturated THEN greatest(1e-4, 0.15 * c) ELSE greatest(1e-4, c) END, 9) AS confidence
FROM (SELECT *, least(1.0, radiance * sqrt(weight) / 30) AS c FROM m)""")
def blend_confidence(spark, sf):
    m = merged(spark, sf)
    return rounded(m.select("l_orderkey", r.confidence(F.col("radiance") * F.sqrt("weight") / 30.0, F.col("saturated")).alias("confidence")), confidence=9)


# --- metering -------------------------------------------------------------------------------------------

def frame_values(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem", "l_suppkey", "l_extendedprice").select("l_suppkey", F.least(F.lit(1.0), F.col("l_extendedprice") / 90000.0).alias("v"))


METER = """
WITH f AS (SELECT l_suppkey, least(1.0, l_extendedprice / 90000.0) AS v FROM lineitem),
s AS (
  SELECT l_suppkey, avg(CASE WHEN v >= 0.98 THEN 1.0 ELSE 0.0 END) AS clipped_fraction, avg(CASE WHEN v <= 2e-4 THEN 1.0 ELSE 0.0 END) AS black_fraction,
    quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.5) AS med, quantile_cont(v, 0.999) AS hi FROM f GROUP BY l_suppkey
), t AS (SELECT *, clipped_fraction > 1e-4 AND hi >= 0.98 AS highlights_clipped, black_fraction > 0.02 AS shadows_crushed FROM s),
u AS (
  SELECT l_suppkey, greatest(1e-12, (CASE WHEN shadows_crushed THEN 2e-4 ELSE greatest(lo, 2e-4) END) / 0.25) AS low_radiance,
    (CASE WHEN highlights_clipped THEN 0.98 ELSE hi END) / 0.25 AS high_radiance, med / 0.25 AS median_radiance,
    clipped_fraction, black_fraction, highlights_clipped, shadows_crushed, hi AS high_value FROM t
), m AS (SELECT * REPLACE (greatest(low_radiance, high_radiance) AS high_radiance) FROM u)
"""


def metered(spark: SparkSession, sf: str) -> DataFrame:
    return exposure.meter(frame_values(spark, sf), ["l_suppkey"], "v", F.lit(0.25))


STATS = dict(low_radiance=9, high_radiance=9, median_radiance=9, clipped_fraction=9, black_fraction=9)
STATS_SQL = ", ".join(f"round({k}, 9) AS {k}" for k in STATS)


@query(METER + f"SELECT l_suppkey, {STATS_SQL}, highlights_clipped, shadows_crushed, round(high_value, 9) AS high_value FROM m")
def meter_scene(spark, sf):
    return rounded(metered(spark, sf), **STATS, high_value=9)


@query(METER + """SELECT round(min(low_radiance), 9) AS low_radiance, round(max(high_radiance), 9) AS high_radiance,
  round(exp(avg(ln(median_radiance)) FILTER (median_radiance > 0)), 9) AS median_radiance, round(max(clipped_fraction), 9) AS clipped_fraction,
  round(max(black_fraction), 9) AS black_fraction, bool_or(highlights_clipped) AS highlights_clipped, bool_or(shadows_crushed) AS shadows_crushed FROM m""")
def scene_union(spark, sf):
    return rounded(exposure.union(metered(spark, sf)), **STATS)


@query("SELECT l_suppkey, round(avg(CASE WHEN least(1.0, l_extendedprice / 90000.0) >= 0.98 THEN 1.0 ELSE 0.0 END), 9) AS clipped FROM lineitem GROUP BY 1")
def clipped_fraction(spark, sf):
    v = frame_values(spark, sf)
    return rounded(v.groupBy("l_suppkey").agg(F.avg(F.when(F.col("v") >= c.Meter().saturation, 1.0).otherwise(0.0)).alias("clipped")), clipped=9)


@query(METER + "SELECT l_suppkey, NOT highlights_clipped AND high_value BETWEEN 0.3 AND 0.9 AS well_exposed FROM m")
def well_exposed(spark, sf):
    return metered(spark, sf).select("l_suppkey", exposure.well_exposed().alias("well_exposed"))


@query(METER + """SELECT l_suppkey, round(CASE WHEN highlights_clipped THEN 0.25 / (CASE WHEN clipped_fraction > 0.2 THEN 8 WHEN clipped_fraction > 0.05 THEN 4 ELSE 2 END)
  WHEN high_value < 1e-9 THEN 0.25 * 64 WHEN abs(f - 1) < 1e-9 THEN 0.25 * (CASE WHEN f < 1 THEN 0.999 ELSE 1.001 END) ELSE 0.25 * f END, 9) AS next_exposure,
  round(0.18 / (CASE WHEN median_radiance > 1e-9 THEN median_radiance ELSE sqrt(low_radiance * high_radiance) END), 9) AS viewing,
  round(ln(high_radiance / low_radiance) / ln(2.0), 6) AS range_ev
FROM (SELECT *, greatest(1 / 64.0, least(64.0, 0.6 / nullif(high_value, 0))) AS f FROM m)""")
def suggest_exposure(spark, sf):
    col = F.col
    m = metered(spark, sf)
    out = m.select(
        "l_suppkey",
        r.suggest(col("highlights_clipped"), col("clipped_fraction"), col("high_value"), F.lit(0.25)).alias("next_exposure"),
        r.viewing(col("median_radiance"), col("low_radiance"), col("high_radiance")).alias("viewing"),
        r.log2(col("high_radiance") / col("low_radiance")).alias("range_ev"),
    )
    return rounded(out, next_exposure=9, viewing=9, range_ev=6)


# --- order statistics -----------------------------------------------------------------------------------

@query("SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.02), 6) AS p02, round(quantile_cont(o_totalprice, 0.5), 6) AS p50, round(quantile_cont(o_totalprice, 0.98), 6) AS p98 FROM orders GROUP BY 1")
def exact_percentile(spark, sf):
    p = statistics.exact_percentiles(read(spark, sf, "orders", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", [0.02, 0.5, 0.98])
    return p.select("o_orderpriority", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p02", "p50", "p98"))])


@query("""SELECT o_orderpriority, list_extract(list_sort(list(o_totalprice)), count(*) // 2 + 1) AS median FROM orders WHERE o_totalprice > 0 GROUP BY 1""")
def upper_median_positive(spark, sf):
    return statistics.upper_median(read(spark, sf, "orders", "o_orderpriority", "o_totalprice").where("o_totalprice > 0"), ["o_orderpriority"], "o_totalprice")


@query("""WITH m AS (SELECT o_orderpriority, list_extract(list_sort(list(o_totalprice)), count(*) // 2 + 1) AS med FROM orders GROUP BY 1),
d AS (SELECT o.o_orderpriority, abs(o_totalprice - med) AS x FROM orders o JOIN m USING (o_orderpriority))
SELECT o_orderpriority, round(1.4826 * list_extract(list_sort(list(x)), count(*) // 2 + 1), 6) AS scale FROM d GROUP BY 1""")
def mad_scale(spark, sf):
    o = read(spark, sf, "orders", "o_orderpriority", "o_totalprice")
    med = statistics.upper_median(o, ["o_orderpriority"], "o_totalprice")
    off = o.join(F.broadcast(med), "o_orderpriority").withColumn("x", F.abs(F.col("o_totalprice") - F.col("median")))  # a row per priority, five
    return statistics.upper_median(off.drop("median"), ["o_orderpriority"], "x").select("o_orderpriority", F.round(F.col("median") * 1.4826, 6).alias("scale"))


@query("SELECT l_suppkey, round(0.18 / exp(avg(ln(l_extendedprice + 1e-9)) FILTER (l_extendedprice > 0)), 12) AS key FROM lineitem GROUP BY 1")
def log_average_key(spark, sf):
    return rounded(statistics.log_key(read(spark, sf, "lineitem", "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice"), key=12)


@query("""SELECT l_suppkey, round(min(l_extendedprice), 6) AS min_value, round(max(l_extendedprice), 6) AS max_value, round(avg(l_extendedprice), 4) AS mean_value,
  1.0 AS covered, count(*) FILTER (l_extendedprice > 65504) AS clamped FROM lineitem GROUP BY 1""")
def output_statistics(spark, sf):
    s = statistics.output_statistics(read(spark, sf, "lineitem", "l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice")
    return rounded(s, min_value=6, max_value=6, mean_value=4)


HISTOGRAM = """
WITH h AS (SELECT CAST(greatest(0, least(511, floor((ln(l_extendedprice) / ln(2.0) + 24) / 48 * 512))) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1)
"""


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.histogram(read(spark, sf, "lineitem", "l_extendedprice"), [], "l_extendedprice")


@query(HISTOGRAM + "SELECT bin, n FROM h")
def output_histogram(spark, sf):
    return bins(spark, sf)


@query(HISTOGRAM + ", r AS (SELECT *, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h) " + " UNION ALL ".join(
    f"SELECT {p} AS share, round(power(2.0, (min(bin) + 0.5) * (48 / 512.0) - 24), 6) AS value FROM r WHERE upto >= ceil(total * {p})" for p in (0.01, 0.5, 0.99)))
def histogram_percentile(spark, sf):
    h = bins(spark, sf)
    out = None
    for p in (0.01, 0.5, 0.99):
        one = statistics.histogram_percentile(h, [], p).select(F.lit(p).alias("share"), F.round("value", 6).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


# --- projections ----------------------------------------------------------------------------------------

LINE = "WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity / 50.0 AS q, l_discount * 10 AS d, l_tax * 10 AS t FROM lineitem) "


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.0).alias("q"), (F.col("l_discount") * 10).alias("d"), (F.col("l_tax") * 10).alias("t"))


@query(LINE + "SELECT l_orderkey, l_linenumber, round(0.2126 * q + 0.7152 * d + 0.0722 * t, 9) AS luma FROM s")
def luminance(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", F.round(r.luminance(F.col("q"), F.col("d"), F.col("t")), 9).alias("luma"))


MATRIX = [1.6, -0.5, -0.1, -0.2, 1.5, -0.3, 0.0, -0.6, 1.6]
BALANCED = r.balanced(MATRIX, (2.0, 1.0, 1.5))


@query(LINE + "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(greatest(0.0, q * {BALANCED[3 * k]!r} + d * {BALANCED[3 * k + 1]!r} + t * {BALANCED[3 * k + 2]!r}), 9) AS {n}" for k, n in enumerate("rgb")) + " FROM s")
def colour_matrix_clamp(spark, sf):
    cols = r.colour(F.col("q"), F.col("d"), F.col("t"), BALANCED)
    return lines(spark, sf).select("l_orderkey", "l_linenumber", *[F.round(x, 9).alias(n) for x, n in zip(cols, "rgb", strict=True)])


FILM = "CASE WHEN x > 0 THEN greatest(0.0, least(1.0, (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14))) ELSE 0.0 END"


@query(f"WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice * 2e-5 AS x FROM lineitem), f AS (SELECT *, power({FILM}, 1 / 2.2) AS y FROM s) "
       "SELECT l_orderkey, l_linenumber, round(y, 9) AS shown, CAST(floor(y * 255 + 0.5) AS INT) AS byte FROM f")
def filmic_tonemap(spark, sf):
    y = r.display(F.col("l_extendedprice"), F.lit(2e-5))
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", F.round(y, 9).alias("shown"), r.to_byte(y).alias("byte"))


@query("""SELECT p_partkey, round(greatest(1e-3, 1 - 0.42 * x * x + 0.09 * x * x * x * x), 9) AS falloff,
  round((1e-4 * x + 4e-6), 12) AS variance, round(sqrt(1e-4 * x + 4e-6), 9) AS sigma FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)""")
def vignette_noise(spark, sf):
    x = F.col("p_size") / 50.0
    v = r.noise_variance(x, F.lit(1.0))
    out = read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", r.falloff(x * x, -0.42, 0.09).alias("falloff"), v.alias("variance"), F.sqrt(v).alias("sigma"))
    return rounded(out, falloff=9, variance=12, sigma=9)


LUT = [0.0, 0.05, 0.2, 0.45, 0.8, 1.0]


@query(f"""WITH s AS (SELECT p_partkey, least(1.0, p_size / 50.0) * 5 AS t FROM part), i AS (SELECT *, CAST(least(4, floor(t)) AS INT) AS k FROM s)
SELECT p_partkey, round({LUT}[k + 1] + ({LUT}[k + 2] - {LUT}[k + 1]) * (t - k), 9) AS linear FROM i""")
def response_lut(spark, sf):
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", F.round(r.lut_decode(F.col("p_size") / 50.0, LUT), 9).alias("linear"))


@query("""SELECT l_orderkey, l_linenumber, round(greatest(-65504.0, least(65504.0, l_extendedprice * 2)), 6) AS half,
  round(l_extendedprice * 78 * 1.8 * 1.8 / (0.65 * 100) / 1000, 6) AS kilocandela FROM lineitem""")
def file_scale(spark, sf):
    """Radiance in file units: thousands of cd/m2, and what a half float can hold."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    cd = r.absolute(F.col("l_extendedprice"), r.luminance_scale(F.lit(1.8), F.lit(100.0)))
    return li.select("l_orderkey", "l_linenumber", F.round(r.half_range(F.col("l_extendedprice") * 2), 6).alias("half"), F.round(cd / 1000.0, 6).alias("kilocandela"))


@query("""SELECT p_partkey, round(78 * 4 / (0.65 * p_size * 0.01), 6) AS saturation, round(12.5 * 4 / (0.01 * p_size), 6) AS metered,
  round(ln(4 / 0.01) / ln(2.0) - ln(p_size / 100.0) / ln(2.0), 9) AS ev100, round(ln(78 / (0.65 * 12.5)) / ln(2.0), 9) AS headroom FROM part""")
def photometric_scale(spark, sf):
    n, iso, s = F.lit(2.0), F.col("p_size"), F.lit(0.01)
    out = read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", r.saturation_luminance(n, iso, s).alias("saturation"), r.metered_luminance(n, iso, s).alias("metered"), r.ev100(n, s, iso).alias("ev100"), r.headroom_stops().alias("headroom"))
    return rounded(out, saturation=6, metered=6, ev100=9, headroom=9)


@query("""SELECT p_partkey, CAST(floor(x * 255 + 0.5) AS INT) AS level, round((CASE WHEN floor(x * 255 + 0.5) <= 127.5 THEN floor(x * 255 + 0.5) ELSE 255 - floor(x * 255 + 0.5) END) / 127.5, 9) AS hat,
  round(CASE WHEN x <= 0.3 THEN 1.0 ELSE 0.3 / x END, 9) AS huber FROM (SELECT p_partkey, p_size / 50.0 AS x FROM part)""")
def response_weights(spark, sf):
    x = F.col("p_size") / 50.0
    k = r.level(x, 256)
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", k.alias("level"), F.round(r.hat_weight(k, 256), 9).alias("hat"), F.round(r.huber_weight(x, 0.3), 9).alias("huber"))


# --- planning -------------------------------------------------------------------------------------------

D = c.Limits()


@query(f"""WITH w AS (SELECT p_partkey, greatest(1e-12, power(10.0, p_size / 8.0 - 5.0)) AS x FROM part),
s AS (SELECT *, x * {D.base_iso} / {D.handheld!r} AS want FROM w)
SELECT p_partkey, round(CASE WHEN x <= {D.min_time} THEN {D.min_time} WHEN x <= {D.handheld!r} THEN x WHEN want > {D.max_iso} THEN greatest({D.min_time}, least({D.max_time}, x * {D.base_iso} / {D.max_iso})) ELSE {D.handheld!r} END, 12) AS seconds,
CAST(CASE WHEN x <= {D.min_time} THEN greatest({D.min_iso}, least({D.max_iso}, floor({D.base_iso} * x / {D.min_time} + 0.5))) WHEN x <= {D.handheld!r} THEN {D.base_iso} WHEN want > {D.max_iso} THEN {D.max_iso}
  ELSE greatest({D.min_iso}, least({D.max_iso}, floor(want + 0.5))) END AS INT) AS iso FROM s""")
def exposure_realize(spark, sf):
    got = r.realise(F.pow(F.lit(10.0), F.col("p_size") / 8.0 - 5.0), D)
    return read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", got.alias("g")).select("p_partkey", F.round("g.seconds", 12).alias("seconds"), "g.iso")


LADDER_LOW, LADDER_HIGH = 2e-4, 0.4


@query("""WITH k AS (SELECT s_suppkey AS scene, 2e-4 * (1 + s_suppkey % 7) AS lo, 0.4 / (1 + s_suppkey % 3) AS hi FROM supplier),
m AS (SELECT *, CAST(greatest(1, ceil(log2(hi / lo) / 3 - 1e-9)) + 1 AS INT) AS n FROM k), n AS (SELECT scene, range AS i, lo * power(hi / lo, range / greatest(1.0, n - 1)) AS x FROM m, range(24) WHERE range < n),
s AS (SELECT scene, i, CASE WHEN x <= 1 / 15.0 THEN x ELSE 1 / 15.0 END AS seconds, CAST(CASE WHEN x <= 1 / 15.0 THEN 100 ELSE floor(100 * x * 15 + 0.5) END AS INT) AS iso FROM n)
SELECT scene, CAST(i AS INT) AS rung, round(seconds, 12) AS seconds, iso, round(seconds * iso / 100, 12) AS rel FROM s""")
def exposure_ladder(spark, sf):
    """The rungs between the darkest and the brightest exposure that each scene asks for."""
    k = F.col("s_suppkey")
    scenes = read(spark, sf, "supplier", "s_suppkey").select(k.alias("scene"), (2e-4 * (1 + k % 7)).alias("low"), (0.4 / (1 + k % 3)).alias("high"))
    return rounded(exposure.ladders(scenes, ["scene"], D), seconds=12, rel=12).withColumn("rung", F.col("rung").cast("int"))


RUNGS = """, n AS (SELECT CAST(range AS INT) AS i, 2e-4 * power(0.4 / 2e-4, range / 4.0) AS x FROM range(5)),
l AS (SELECT i, CASE WHEN x <= 1 / 15.0 THEN x ELSE floor(100 * x * 15 + 0.5) / 100 / 15.0 END AS rel FROM n)"""


@query(METER + RUNGS + """, a AS (
  SELECT l_suppkey, coalesce(max(i) FILTER (rel <= 0.7 / high_radiance * (1 + 1e-9)), 0) AS s, coalesce(min(i) FILTER (rel >= 0.05 / low_radiance * (1 - 1e-9)), 4) AS e FROM m, l GROUP BY l_suppkey
), br AS (SELECT l_suppkey, s, greatest(s, e) AS e FROM a), k AS (SELECT *, greatest(0, 3 - (e - s + 1)) AS short FROM br),
up_ AS (SELECT *, least(short, 4 - e) AS up FROM k), dn AS (SELECT *, least(short - up, s) AS down FROM up_)
SELECT l_suppkey, s - down AS first_rung, least(e + up, s - down + 8) AS last_rung FROM dn""")
def bracket_run(spark, sf):
    rungs = exposure.ladder(spark, LADDER_LOW, LADDER_HIGH, D).withColumn("rung", F.col("rung").cast("int"))
    return exposure.runs(metered(spark, sf).select("l_suppkey", "low_radiance", "high_radiance"), rungs).select("l_suppkey", "first_rung", "last_rung")


@query("WITH z AS (SELECT 1)" + RUNGS + """, w AS (SELECT p_partkey, power(10.0, p_size / 15.0 - 4.0) AS rel FROM part)
SELECT p_partkey, arg_min(i, [round(abs(ln(l.rel / w.rel)), 12), i]) AS rung FROM w, l GROUP BY p_partkey""")
def nearest_rung(spark, sf):
    rungs = exposure.ladder(spark, LADDER_LOW, LADDER_HIGH, D).withColumn("rung", F.col("rung").cast("int"))
    wanted = read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", F.pow(F.lit(10.0), F.col("p_size") / 15.0 - 4.0).alias("rel"))
    return exposure.nearest_rung(wanted, rungs, "p_partkey", "rel").select("p_partkey", "rung")


# --- rasters --------------------------------------------------------------------------------------------

@query(GRID + """ SELECT frame, y, x, round(greatest(0.0, least(1.0, (v * 1023 - b) / greatest(1.0, 1023 - b))), 9) AS v
FROM (SELECT *, [64.0, 60.0, 62.0, 66.0][(y % 2) * 2 + x % 2 + 1] AS b FROM g)""")
def raw_normalise(spark, sf):
    v = raster.normalise_raw(F.col("v") * 1023, F.col("x"), F.col("y"), [64, 60, 62, 66], 1023)
    return frames(spark, sf).select("frame", "y", "x", F.round(v, 9).alias("v"))


SHADE = [[1.8, 1.2, 1.7], [1.1, 1.0, 1.15]]


@query(GRID + f""", k AS (SELECT *, x / {W - 1}.0 * 2 AS gx, y / {H - 1}.0 AS gy FROM g), i AS (SELECT *, CAST(least(1, floor(gx)) AS INT) AS i, CAST(least(0, floor(gy)) AS INT) AS j FROM k),
t AS (SELECT frame, y, x, gx - i AS fx, gy - j AS fy, {SHADE}[j + 1][i + 1] AS a, {SHADE}[j + 1][i + 2] AS b, {SHADE}[j + 2][i + 1] AS c, {SHADE}[j + 2][i + 2] AS d FROM i)
SELECT frame, y, x, round((a * (1 - fx) + b * fx) * (1 - fy) + (c * (1 - fx) + d * fx) * fy, 9) AS gain FROM t""")
def shading_bilinear(spark, sf):
    return frames(spark, sf).select("frame", "y", "x", F.round(raster.shading_gain(F.col("x"), F.col("y"), W, H, SHADE), 9).alias("gain"))


@query(GRID + """ SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(v) FILTER (y % 2 = 0 AND x % 2 = 0), 9) AS r, round(avg(v) FILTER (y % 2 <> x % 2), 9) AS g,
  round(avg(v) FILTER (y % 2 = 1 AND x % 2 = 1), 9) AS b FROM g GROUP BY 1, 2, 3""")
def half_res_demosaic(spark, sf):
    return rounded(raster.half_resolution(frames(spark, sf), ["frame"]), r=9, g=9, b=9).withColumns({k: F.col(k).cast("int") for k in "yx"})


@query(GRID + " SELECT frame, y // 2 AS y, x // 2 AS x, round(avg(v), 9) AS v FROM g GROUP BY 1, 2, 3")
def box_downsample(spark, sf):
    return rounded(raster.box_reduce(frames(spark, sf), ["frame"], W, H), v=9).withColumns({k: F.col(k).cast("int") for k in "yx"})


@query(GRID + f""", t AS (SELECT range - 4 AS k, exp(-(range - 4) * (range - 4) / (2 * 1.2 * 1.2)) AS w FROM range(9)), n AS (SELECT k, w / (SELECT sum(w) FROM t) AS w FROM t),
h AS (SELECT g.frame, g.y, g.x, sum(w * s.v) AS v FROM g, n JOIN g s ON s.frame = g.frame AND s.y = g.y AND s.x = greatest(0, least({W - 1}, g.x + k)) GROUP BY 1, 2, 3)
SELECT h.frame, h.y, h.x, round(sum(w * s.v), 9) AS v FROM h, n JOIN h s ON s.frame = h.frame AND s.x = h.x AND s.y = greatest(0, least({H - 1}, h.y + k)) GROUP BY 1, 2, 3""")
def gaussian_blur(spark, sf):
    return rounded(raster.gaussian_blur(frames(spark, sf), ["frame"], W, H, 1.2), v=9).withColumns({k: F.col(k).cast("int") for k in "yx"})


def _taps(name: str, filt: tuple) -> str:
    return "(" + " + ".join(f"{w / 8!r} * {name}{dy + 2}{dx + 2}" for dy, dx, w in filt) + ")"


_MIRROR = lambda n: f"CASE WHEN {{k}} < 0 THEN -({{k}}) WHEN {{k}} >= {n} THEN {2 * n - 2} - ({{k}}) ELSE {{k}} END"
_READS = sorted({(dy, dx) for f in (raster.GREEN_AT_COLOUR, raster.SAME_ROW, raster.SAME_COLUMN, raster.OPPOSITE) for dy, dx, _ in f})


@query(GRID + ", n AS (SELECT g.frame, g.y, g.x, " + ", ".join(
    f"(SELECT v FROM g s WHERE s.frame = g.frame AND s.y = {_MIRROR(H).format(k=f'g.y + {dy}')} AND s.x = {_MIRROR(W).format(k=f'g.x + {dx}')}) AS n{dy + 2}{dx + 2}" for dy, dx in _READS) +
    " FROM g) SELECT frame, y, x, round(CASE WHEN y % 2 = 0 AND x % 2 = 0 THEN n22 WHEN y % 2 = 1 AND x % 2 = 1 THEN " + _taps("n", raster.OPPOSITE) + " WHEN y % 2 = 0 THEN " + _taps("n", raster.SAME_ROW) + " ELSE " + _taps("n", raster.SAME_COLUMN) +
    " END, 9) AS r, round(CASE WHEN y % 2 <> x % 2 THEN n22 ELSE " + _taps("n", raster.GREEN_AT_COLOUR) + " END, 9) AS g, round(CASE WHEN y % 2 = 1 AND x % 2 = 1 THEN n22 WHEN y % 2 = 0 AND x % 2 = 0 THEN " + _taps("n", raster.OPPOSITE) +
    " WHEN y % 2 = 1 THEN " + _taps("n", raster.SAME_ROW) + " ELSE " + _taps("n", raster.SAME_COLUMN) + " END, 9) AS b FROM n")
def malvar_demosaic(spark, sf):
    return rounded(raster.demosaic(frames(spark, sf), ["frame"], W, H), r=9, g=9, b=9)


@query(GRID + """ SELECT a.frame, a.y, a.x, a.v AS score FROM g a WHERE NOT EXISTS (
  SELECT 1 FROM g b WHERE b.frame = a.frame AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND (b.v > a.v OR b.v = a.v AND (b.y < a.y OR b.y = a.y AND b.x < a.x)))""")
def corner_maxima(spark, sf):
    """Non-maximum suppression over a score raster."""
    return raster.local_maxima(frames(spark, sf).withColumnRenamed("v", "score"), ["frame"]).withColumns({k: F.col(k).cast("int") for k in "yx"})


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INT) AS rank FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY q DESC, l_orderkey, l_linenumber) AS rank
  FROM (SELECT l_suppkey, l_orderkey, l_linenumber, max(l_extendedprice) AS q FROM lineitem GROUP BY 1, 2, 3)) WHERE rank <= 10""")
def top_k_corners(spark, sf):
    """The ten strongest of each frame, in raster order among equals; a top-k report."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    one = li.groupBy("l_suppkey", F.col("l_orderkey").alias("y"), F.col("l_linenumber").alias("x")).agg(F.max("l_extendedprice").alias("score"))
    return raster.top_corners(one, ["l_suppkey"], 10).select("l_suppkey", F.col("y").alias("l_orderkey"), F.col("x").alias("l_linenumber"), "rank")
