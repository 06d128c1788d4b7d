"""Queries of file formats, capture documents and the frame store, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import radiometry as r
from ..functions import text
from ..operators import exposure, raster
from ..sources import codecs, files, store
from .common import read, rounded

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- rasters as files -----------------------------------------------------------------------------------

def frames(spark: SparkSession, sf: str, *values) -> DataFrame:
    """A raster of one line for each supplier: its line items in order, one pixel each, the given values as channels."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    px = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", F.array(*[v.cast("float") for v in values]).alias("v"))
    one = li.groupBy("l_suppkey").agg(F.array_sort(F.collect_list(px)).alias("p"))
    return one.select(F.col("l_suppkey").cast("string").alias("path"), F.size("p").alias("width"), F.lit(1).alias("height"), F.lit(len(values)).alias("channels"), F.flatten(F.transform("p", lambda x: x["v"])).alias("data"))


def round_trip(spark: SparkSession, sf: str, kind: str, *values) -> DataFrame:
    back = files.exploded(files.decoded(files.encoded(frames(spark, sf, *values), kind), kind))
    return back.select(F.col("path").cast("long").alias("frame"), "x", "c", F.round(F.col("v").cast("double"), 6).alias("v"))


ORDERED = "px AS (SELECT l_suppkey AS frame, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS x, l_quantity AS q, l_discount AS d, l_partkey AS p FROM lineitem)"


@query(f"WITH {ORDERED} SELECT frame, CAST(x AS INT) AS x, 0 AS c, round(q / 64, 6) AS v FROM px")
def plane_round_trip(spark, sf):
    """Working planes of half floats, written and read; the values have exact halves."""
    return round_trip(spark, sf, "plane", F.col("l_quantity") / 64)


@query(f"WITH {ORDERED} SELECT frame, CAST(x AS INT) AS x, c, round(CASE c WHEN 0 THEN q / 64 WHEN 1 THEN p % 256 ELSE 0.5 END, 6) AS v FROM px, (SELECT CAST(range AS INT) AS c FROM range(3))")
def exr_round_trip(spark, sf):
    """Scanline files of half channels, each line packed where that makes it smaller."""
    return round_trip(spark, sf, "exr", F.col("l_quantity") / 64, F.col("l_partkey") % 256, F.lit(0.5))


@query(f"""WITH {ORDERED}, t AS (SELECT *, floor(ln(greatest(q, 1 + p % 100)) / ln(2.0) + 1e-12) + 1 AS e FROM px),
v AS (SELECT frame, x, e, [q, 1.0 + p % 100, 0.25] AS v FROM t)
SELECT frame, CAST(x AS INT) AS x, c, round((floor(v[c + 1] * 256 / power(2.0, e)) + 0.5) * power(2.0, e) / 256, 6) AS v FROM v, (SELECT CAST(range AS INT) AS c FROM range(3))""")
def rgbe_round_trip(spark, sf):
    """Shared-exponent files with run lengths; a mantissa reads as the middle of its step."""
    return round_trip(spark, sf, "rgbe", F.col("l_quantity"), F.lit(1.0) + F.col("l_partkey") % 100, F.lit(0.25))


@query(f"WITH {ORDERED} SELECT frame, CAST(x AS INT) AS x, 0 AS c, CAST(p * 7 % 65536 AS DOUBLE) AS v FROM px")
def dng_round_trip(spark, sf):
    """Uncompressed 16-bit counts in a strip."""
    return round_trip(spark, sf, "dng", F.col("l_partkey") * 7 % 65536)


@query(f"""WITH {ORDERED}, e AS (SELECT frame, x, c, CASE c WHEN 0 THEN p * 7 % 256 WHEN 1 THEN p % 256 ELSE 200 END / 255.0 AS e FROM px, (SELECT CAST(range AS INT) AS c FROM range(3)))
SELECT frame, CAST(x AS INT) AS x, c, round(CAST(CAST(CASE WHEN e <= 0.04045 THEN e / 12.92 ELSE power((e + 0.055) / 1.055, 2.4) END AS FLOAT) AS DOUBLE), 6) AS v FROM e""")
def image_linear(spark, sf):
    """8-bit images decoded to linear values."""
    return round_trip(spark, sf, "image", F.col("l_partkey") * 7 % 256, F.col("l_partkey") % 256, F.lit(200))


@query("""SELECT CAST(s_suppkey AS INT) AS frame, CAST(y.range AS INT) AS y, CAST(sum((s_suppkey * 7 + y.range * 3 + x.range) % 64) AS DOUBLE) AS total, CAST(sum((x.range + y.range) % 4 / 4.0) AS DOUBLE) AS sure
FROM supplier, range(4) y, range(6) x WHERE s_suppkey IN (1, 3, 7) GROUP BY 1, 2""")
def parked_frames(spark, sf):
    """Merged frames parked for a run, of which the reader opens three and reads them by strips."""
    from ..operators.graph import settle, shared_folder
    from ..sources.spool import Spool

    s = read(spark, sf, "supplier", "s_suppkey").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(3))))
    x = F.sequence(F.lit(0), F.lit(5))
    rows = s.select(F.col("s_suppkey").alias("frame"), "y", F.transform(x, lambda k: (F.col("s_suppkey") * 7 + F.col("y") * 3 + k) % 64).alias("radiance"), F.transform(x, lambda k: (k + F.col("y")) % 4 / 4.0).alias("confidence"))
    with Spool(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}") as spool:
        spool.put(rows, 6, 4, 1, True, read(spark, sf, "supplier", "s_suppkey").count())
        total = lambda c: F.aggregate(F.transform(c, lambda v: v.cast("double")), F.lit(0.0), lambda a, b: a + b)
        return settle(spool.read().where(F.col("frame").isin(1, 3, 7)).select("frame", "y", total("radiance").alias("total"), total("confidence").alias("sure")), "parked")


@query("""SELECT l_suppkey AS y, CAST(8 + 6 * 16 AS INT) AS bytes, CAST(coalesce(sum(8 + 6 * 16) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
FROM (SELECT DISTINCT l_suppkey FROM lineitem)""")
def exr_line_table(spark, sf):
    """Encoded scanlines of sixteen pixels and where each begins after the header: what the file's table says."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_quantity")
    px = li.select(F.col("l_suppkey").cast("int").alias("y")).distinct().withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(15))))
    px = px.select("y", "x", *[((F.col("y") * 7 + F.col("x") * k) % 64 / 64.0).alias(c) for k, c in ((3, "r"), (5, "g"), (11, "b"))])
    sizes = files.exr_lines(px, 16, codecs.EXR_NONE).select(F.col("y").cast("long").alias("y"), F.length("line").alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("y").rowsBetween(Window.unboundedPreceding, -1))  # a file's lines, some thousands
    return sizes.withColumn("before", F.coalesce(before, F.lit(0)))


@query("""SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS y, x.range AS x, CAST((s_suppkey * 7 + x.range * 3) % 64 AS DOUBLE) / 64 AS r, CAST((s_suppkey * 7 + x.range * 5) % 64 AS DOUBLE) / 64 AS g, CAST((s_suppkey * 7 + x.range * 11) % 64 AS DOUBLE) / 64 AS b
FROM supplier, range(24) x""")
def exr_file(spark, sf):
    """One EXR of a row for each supplier, its lines written by tasks, read back whole."""
    from ..operators.graph import shared_folder
    from ..sources import exr_sink

    s = read(spark, sf, "supplier", "s_suppkey")
    low, rows = s.agg(F.min("s_suppkey"), F.count("*")).first()
    px = s.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(23))))
    px = px.select((F.col("s_suppkey") - low).cast("int").alias("y"), "x", *[((F.col("s_suppkey") * 7 + F.col("x") * k) % 64 / 64.0).alias(c) for k, c in ((3, "r"), (5, "g"), (11, "b"))])
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.exr"
    exr_sink.write_exr(px, 24, rows, path)
    back = files.exploded(files.rasters(spark, path, "exr"))
    at = back.groupBy("y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])
    return at.select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *[F.col(n).cast("double").alias(n) for n in "rgb"])


# --- camera planes --------------------------------------------------------------------------------------

@query("""SELECT p_partkey, round(CASE WHEN x <= 0.04045 THEN x / 12.92 ELSE power((x + 0.055) / 1.055, 2.4) END, 7) AS linear FROM (SELECT p_partkey, (p_partkey * 7 % 256) / 255.0 AS x FROM part)""")
def srgb_linear(spark, sf):
    """8-bit values to linear ones by the table of the sRGB curve."""
    return read(spark, sf, "part", "p_partkey").select("p_partkey", F.round(r.srgb_linear(F.col("p_partkey") * 7 % 256), 7).alias("linear"))


PLANE = "pl AS (SELECT p_partkey // 256 AS frame, p_partkey // 16 % 16 AS y, p_partkey % 16 AS x, p_partkey * 37 % 256 AS luma, p_size * 5 % 256 AS u, p_partkey * 11 % 256 AS v FROM part)"


def planes(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 16 x 16 parts: a luma sample each, chroma at every second of both."""
    k = F.col("p_partkey")
    return read(spark, sf, "part", "p_partkey", "p_size").select(
        F.floor(k / 256).alias("frame"), (F.floor(k / 16) % 16).alias("y"), (k % 16).alias("x"), (k * 37 % 256).alias("luma"), (F.col("p_size") * 5 % 256).alias("u"), (k * 11 % 256).alias("v")
    )


@query(f"WITH {PLANE} SELECT frame, y // 2 AS y, x // 2 AS x, round(luma / 255.0, 9) AS v FROM pl WHERE y % 2 = 0 AND x % 2 = 0")
def luma_plane(spark, sf):
    """Every second sample of the luma plane, 0 to 1."""
    return rounded(raster.luma_plane(planes(spark, sf), ["frame"], 2), v=9)


@query(f"""WITH {PLANE}, m AS (SELECT a.frame, a.y, a.x, a.luma, b.u - 128 AS u, b.v - 128 AS v FROM pl a JOIN pl b ON a.frame = b.frame AND b.y = a.y // 2 * 2 AND b.x = a.x // 2 * 2)
SELECT frame, y, x, round(greatest(0, least(255, luma + 1.402 * v)) / 255, 9) AS r, round(greatest(0, least(255, luma - 0.344136 * u - 0.714136 * v)) / 255, 9) AS g,
  round(greatest(0, least(255, luma + 1.772 * u)) / 255, 9) AS b FROM m""")
def yuv_to_rgb(spark, sf):
    """Full-range BT.601 with chroma of half the size, clamped."""
    p = planes(spark, sf)
    chroma = p.where("y % 2 = 0 and x % 2 = 0").select("frame", F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x"), "u", "v")
    return rounded(raster.yuv_to_rgb(p.select("frame", "y", "x", "luma"), chroma, ["frame"]), r=9, g=9, b=9)


@query(f"""WITH {PLANE} SELECT frame, y, x, round(greatest(0.0, least(1.0, (luma * 4 - k) / greatest(1.0, 1023 - k))), 9) AS v
FROM (SELECT *, CASE WHEN frame % 2 = 0 THEN [64.0, 60.0, 62.0, 66.0] ELSE [63.0, 63.0, 63.5, 64.5] END[y % 2 * 2 + x % 2 + 1] AS k FROM pl)""")
def raw_plane(spark, sf):
    """Sensor counts by the black level that came with the frame, else the camera's."""
    own = F.when(F.col("frame") % 2 == 0, F.array(*[F.lit(v) for v in (64.0, 60.0, 62.0, 66.0)]))
    level = raster.black_level(own, [63.0, 63.0, 63.5, 64.5], F.col("x"), F.col("y"))
    return planes(spark, sf).select("frame", "y", "x", F.round(raster.normalise_by(F.col("luma") * 4, level, 1023.0), 9).alias("v"))


# --- documents ------------------------------------------------------------------------------------------

TAG = "capture/1"


@query(f"""SELECT CAST(s_suppkey AS VARCHAR) AS path, '{TAG}' AS format, s_name AS camera, CAST(s_suppkey * 3 AS INT) AS "imageWidth", round(s_acctbal, 2) AS "focalLengthMm",
  CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE 8 END AS gains, CASE WHEN s_suppkey % 2 = 0 THEN 3 ELSE 0 END AS neutral FROM supplier""")
def session_headers(spark, sf):
    """Headers written as JSON and read again: missing parts are null, shading of the wrong size too."""
    k = F.col("s_suppkey")
    s = read(spark, sf, "supplier", "s_suppkey", "s_name", "s_acctbal").select(
        k.cast("string").alias("path"), F.lit(TAG).alias("format"), F.col("s_name").alias("camera"), (k * 3).alias("imageWidth"), F.round("s_acctbal", 2).alias("focalLengthMm"),
        F.lit(2).alias("shadingCols"), F.lit(1).alias("shadingRows"), F.array_repeat(F.lit(1.5), F.when(k % 3 == 0, 7).otherwise(8)).alias("shadingGains"),
        F.when(k % 2 == 0, F.array(F.lit(2.0), F.lit(1.0), F.lit(1.5))).alias("neutralGains"),
    )
    back = files.parse_sessions(files.session_text(s), TAG)
    count = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).otherwise(0)
    return back.select("path", "format", "camera", "imageWidth", F.round("focalLengthMm", 2).alias("focalLengthMm"), count("shadingGains").alias("gains"), count("neutralGains").alias("neutral"))


JOURNAL = """j AS (SELECT l_suppkey AS folder, l_orderkey * 8 + l_linenumber AS pos, min(l_partkey) AS part, CAST(min(l_quantity) AS INT) AS q FROM lineitem GROUP BY 1, 2),
k AS (SELECT *, part % 20 AS target, pos % 8 AS bracket FROM j)"""


@query(f"""WITH {JOURNAL}, s AS (SELECT * FROM k WHERE part % 10 <> 0 AND q % 5 <> 0 AND q % 5 <> 1),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, target, bracket ORDER BY pos DESC) AS n FROM s)
SELECT folder, CAST(target AS INT) AS target, CAST(bracket AS INT) AS bracket, q AS iso, CASE WHEN part % 3 = 0 THEN 9 ELSE 0 END AS pose FROM n WHERE n = 1""")
def journal_records(spark, sf):
    """Journals of all suppliers: torn lines, lost files and files of a wrong length don't count, the last record wins."""
    pos = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    j = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    j = j.groupBy(F.col("l_suppkey").alias("folder"), pos.alias("pos")).agg(F.min("l_partkey").alias("part"), F.min("l_quantity").cast("int").alias("q"))
    name = F.concat(F.col("pos").cast("string"), F.lit(".hrf"))
    pose = F.array_repeat(F.lit(0.5), F.when(F.col("part") % 3 == 0, 9).otherwise(4))
    line = F.to_json(F.struct((F.col("part") % 20).alias("target"), (F.col("pos") % 8).alias("bracket"), F.col("q").alias("iso"), F.lit(4).alias("w"), F.lit(2).alias("h"), F.lit(1).alias("c"), name.alias("file"), pose.alias("pose")))
    torn = F.when(F.col("part") % 10 == 0, F.substr(line, F.lit(1), F.length(line) - 9)).otherwise(line)
    listing = j.where("q % 5 <> 0").select("folder", name.alias("file"), F.when(F.col("q") % 5 == 1, 35).otherwise(36).cast("long").alias("length"))
    got = files.parse_journal(j.select("folder", "pos", torn.alias("line")), listing, ["folder"])
    return got.select("folder", "target", "bracket", "iso", F.when(F.col("pose").isNotNull(), F.size("pose")).otherwise(0).alias("pose"))


@query("""SELECT l_orderkey AS "set", CAST(l_linenumber AS VARCHAR) || '.dng' AS path, round(l_discount, 4) AS exposure, CAST(l_quantity AS INT) AS iso, round(l_quantity / (l_quantity * 5 + l_linenumber) * 36, 9) AS sensor_mm FROM lineitem""")
def manifest_entries(spark, sf):
    """Lists of files with exposures, one JSON array an order, and the sensor's width from the crop."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    q = F.col("l_quantity")
    entry = F.struct(F.concat(F.col("l_linenumber").cast("string"), F.lit(".dng")).alias("path"), F.col("l_discount").alias("exposure"), q.cast("int").alias("iso"), q.alias("focal"), (q * 5 + F.col("l_linenumber")).alias("focal35"))
    docs = li.groupBy(F.col("l_orderkey").alias("set")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    return rounded(files.parse_manifests(docs).select("set", "path", "exposure", "iso", "sensor_mm"), exposure=4, sensor_mm=9)


@query("""WITH d AS (SELECT o_custkey, 'capture-' || (o_orderkey * 1000) AS folder, o_orderkey AS k, round(o_totalprice / 1000000, 6) AS c, o_orderpriority AS p FROM orders)
SELECT o_custkey, folder, CASE WHEN k % 3 = 0 THEN folder ELSE p END AS name, CASE WHEN k % 4 = 0 THEN 0 ELSE CAST(k % 50 AS INT) END AS directions, c AS coverage, 0.0 AS stops,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k DESC, folder) AS INT) AS place FROM d""")
def capture_catalogue(spark, sf):
    """Report documents of each customer's captures, missing keys defaulted, newest first."""
    o, k = read(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority"), F.col("o_orderkey")
    doc = F.to_json(F.struct(F.when(k % 3 != 0, F.col("o_orderpriority")).alias("name"), F.when(k % 4 != 0, k % 50).alias("directions"), F.round(F.col("o_totalprice") / 1000000, 6).alias("coverage")))
    docs = o.select("o_custkey", F.concat(F.lit("capture-"), (k * 1000).cast("string")).alias("folder"), doc.alias("value"), F.lit(None).cast("timestamp").alias("modified"))
    newest = Window.partitionBy("o_custkey").orderBy(F.col("captured").desc(), "folder")
    return files.summaries(docs).withColumn("place", F.row_number().over(newest)).drop("captured")


@query("""WITH s AS (SELECT l_suppkey AS k, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS top, count(*) FILTER (l_quantity > 45) AS bright FROM lineitem GROUP BY 1)
SELECT k AS capture, CAST(2 AS BIGINT) AS version, n AS pixels, mean, round(top, 4) AS top, bright, CAST(least(n, 5) AS INT) AS poses, round(first, 4) AS first
FROM s JOIN (SELECT l_suppkey, arg_min(l_quantity, [l_orderkey, l_linenumber, l_quantity]) AS first FROM lineitem GROUP BY 1) ON l_suppkey = k""")
def report_document(spark, sf):
    """A report of each capture as one JSON document: statistics and its first poses by frame; read back here."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    stats = li.groupBy("l_suppkey").agg(F.count("*").alias("pixels"), F.avg("l_extendedprice").alias("mean"), F.max("l_extendedprice").alias("top"), F.count_if(F.col("l_quantity") > 45).alias("bright"))
    first = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity")
    poses = li.withColumn("frame", F.row_number().over(first) - 1).where("frame < 5").select("l_suppkey", "frame", F.col("l_quantity").alias("yaw"))
    docs = store.reports(stats, poses, ["l_suppkey"])
    num = lambda path: text.json_number(F.col("report"), path)
    out = docs.select(
        F.col("l_suppkey").alias("capture"), num("$.version").cast("long").alias("version"), num("$.pixels").cast("long").alias("pixels"), F.round(num("$.mean"), 4).alias("mean"), F.round(num("$.top"), 4).alias("top"),
        num("$.bright").cast("long").alias("bright"), F.json_array_length(F.get_json_object("report", "$.poses")).alias("poses"), F.round(num("$.poses[0].yaw"), 4).alias("first"),
    )
    return out


# --- the frame store ------------------------------------------------------------------------------------

@query("""WITH f AS (SELECT l_suppkey AS capture, l_partkey % 10 AS target, l_linenumber AS bracket, l_orderkey % 4 AS batch, l_orderkey, l_quantity, (l_orderkey * 13) % 50 AS free FROM lineitem),
a AS (SELECT * FROM f WHERE free = 0 OR free >= l_quantity),
n AS (SELECT *, row_number() OVER (PARTITION BY capture, target, bracket ORDER BY batch DESC, l_orderkey DESC, l_quantity DESC) AS n FROM a)
SELECT capture, target, bracket, batch, l_orderkey AS pos, l_quantity AS bytes FROM n WHERE n = 1""")
def stored_frames(spark, sf):
    """Frames that fit (unknown free space is no obstacle), the last batch and place of each target and bracket."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_orderkey", "l_quantity")
    f = li.select(F.col("l_suppkey").alias("capture"), (F.col("l_partkey") % 10).alias("target"), F.col("l_linenumber").alias("bracket"), (F.col("l_orderkey") % 4).alias("batch"), F.col("l_orderkey").alias("pos"), F.col("l_quantity").alias("bytes"), (F.col("l_orderkey") * 13 % 50).alias("free"))
    return store.last_stored(f.where(store.has_room(F.col("free"), F.col("bytes"))), ["capture", "target", "bracket"], ["batch", "pos", "bytes"]).drop("free")


@query("""SELECT l_orderkey, l_linenumber, count(*) AS frames FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND l_linenumber < 2 + o_custkey % 4 WHERE o_orderkey IS NULL GROUP BY 1, 2""")
def plan_revision(spark, sf):
    """Stored frames whose rung a revised plan no longer wants; they are dropped."""
    records = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("bracket"))
    plan = read(spark, sf, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("target"), (F.col("o_custkey") % 4 + 2).alias("wanted"))
    gone = files.dropped_by_plan(records, plan)
    return gone.groupBy(F.col("target").alias("l_orderkey"), F.col("bracket").alias("l_linenumber")).agg(F.count("*").alias("frames"))


@query("""WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AS sphere, count(*) FILTER (l_linenumber > 3) AS whole, epoch_ms(o_orderdate) AS ms, sum(l_quantity) AS raw FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 4)
SELECT o_orderkey, CASE WHEN NOT sphere AND whole = 0 AND ms < epoch_ms(TIMESTAMP '1998-01-01') - 86400000 THEN 'folder' WHEN sphere AND raw > 0 THEN 'raw' END AS deleted FROM c
WHERE (NOT sphere AND whole = 0 AND ms < epoch_ms(TIMESTAMP '1998-01-01') - 86400000) OR (sphere AND raw > 0)""")
def retention(spark, sf):
    """What may be deleted: abandoned folders by age, unless they hold a whole direction; raw frames once there is a sphere."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.count_if(F.col("l_linenumber") > 3).alias("whole_directions"), F.sum("l_quantity").alias("raw_bytes"))
    o = read(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    c = o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("has_sphere"), "whole_directions", F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1000).alias("captured_ms"), "raw_bytes")
    old = store.to_delete(c, 883612800000, 86400000).select("o_orderkey", F.lit("folder").alias("deleted"))
    return old.unionByName(store.raw_to_delete(c).select("o_orderkey", F.lit("raw").alias("deleted")))


@query("""SELECT s_suppkey AS capture, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) AS bytes FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1""")
def bytes_on_disk(spark, sf):
    """Bytes of all files of each capture, from a listing of paths at any depth."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    listing = li.select(F.concat_ws("/", F.lit("captures"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")).alias("path"), F.col("l_quantity").cast("long").alias("length"))
    got = store.bytes_of(listing, F.split_part("path", F.lit("/"), F.lit(2)))
    return got.select(F.col("folder").cast("long").alias("capture"), "files", "bytes")


@query("""WITH f AS (SELECT l_orderkey AS target, l_linenumber AS rung, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), w AS (SELECT o_orderkey AS target, 1 + o_custkey % 3 AS wanted FROM orders),
c AS (SELECT f.* FROM f JOIN w USING (target) WHERE rung <= wanted), k AS (SELECT target FROM c JOIN w USING (target) GROUP BY target, wanted HAVING count(*) = wanted),
p AS (SELECT target, rung, q, y, x, (q + y * 4 + x) / 64 AS v FROM c SEMI JOIN k USING (target), (SELECT range AS y FROM range(4)), (SELECT range AS x FROM range(4)))
SELECT target, rung, round(avg(v) FILTER (y % 2 = 0 AND x % 2 = 0), 9) AS r, round(avg(v) FILTER (y % 2 <> x % 2), 9) AS g, round(avg(v) FILTER (y % 2 = 1 AND x % 2 = 1), 9) AS b,
  CAST(row_number() OVER (PARTITION BY target ORDER BY rung) - 1 AS INT) AS place FROM p GROUP BY target, rung""")
def bracket_reader(spark, sf):
    """Complete brackets only, by rung: mosaics of 4 x 4 taken at half resolution, then halved once more."""
    li = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")  # all later steps go by target
    li = li.groupBy(F.col("l_orderkey").alias("target"), F.col("l_linenumber").alias("rung")).agg(F.max("l_quantity").alias("q"))
    o = read(spark, sf, "orders", "o_orderkey", "o_custkey")
    plan = o.select(F.col("o_orderkey").alias("target"), F.explode(F.sequence(F.lit(1), (F.col("o_custkey") % 3 + 1).cast("int"))).alias("rung"))
    pixel = lambda y, x: F.struct(y.alias("y"), x.alias("x"), ((F.col("q") + y * 4 + x) / 64).alias("v"))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: pixel(F.floor(i / 4), i % 4))
    got = exposure.read_brackets(li, pixels, plan, 4, 4, reductions=1)
    return rounded(got, r=9, g=9, b=9).select("target", "rung", "r", "g", "b", "place")


@query("""WITH s AS (SELECT l_suppkey AS sphere, l_orderkey % 40 AS strip, max(l_extendedprice) AS top, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT sphere, strip, round(max(top) OVER w, 4) AS top, round(sum(total) OVER w, 2) AS total, CAST(sum(n) OVER w AS BIGINT) AS pixels FROM s WINDOW w AS (PARTITION BY sphere ORDER BY strip)""")
def strip_statistics(spark, sf):
    """Statistics that run along while a sphere is written strip by strip: partial sums first, then running ones."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_extendedprice")
    strips = li.select(F.col("l_suppkey").alias("sphere"), (F.col("l_orderkey") % 40).alias("strip"), F.col("l_extendedprice").alias("v"))
    s = store.running_statistics(strips, ["sphere"], "strip", "v").withColumn("total", F.col("mean") * F.col("pixels"))
    return rounded(s.drop("mean"), top=4, total=2)


@query("""WITH b AS (SELECT l_suppkey AS sphere, l_partkey // 2 % 40 AS y, l_orderkey // 2 % 20 AS x, avg(l_extendedprice) AS v, sum(l_quantity) AS c FROM lineitem GROUP BY 1, 2, 3), m AS (SELECT sphere, max(c) AS most FROM b GROUP BY 1)
SELECT sphere, y, x, CAST(floor(greatest(0.0, least(1.0, power(CASE WHEN k > 0 THEN greatest(0.0, least(1.0, (k * (2.51 * k + 0.03)) / (k * (2.43 * k + 0.59) + 0.14))) ELSE 0.0 END, 1 / 2.2))) * 255 + 0.5) AS INT) AS shown,
  CAST(floor(least(1.0, c / most) * 255 + 0.5) AS INT) AS covered FROM (SELECT *, v * 2e-5 AS k FROM b JOIN m USING (sphere))""")
def preview_images(spark, sf):
    """Bytes of a preview, halved and tone-mapped, and of the coverage map of each sphere."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_extendedprice", "l_quantity")
    cell = li.groupBy(F.col("l_suppkey").alias("sphere"), (F.floor(F.col("l_partkey") / 2) % 40).alias("y"), (F.floor(F.col("l_orderkey") / 2) % 20).alias("x")).agg(F.avg("l_extendedprice").alias("v"), F.sum("l_quantity").alias("coverage"))
    return store.preview_bytes(cell, ["sphere"], F.lit(2e-5))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Ünïc "' || p_size || '"' END AS name, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size / 4.0 END AS second, p_partkey % 5 <> 0 AS parsed FROM part""")
def json_documents(spark, sf):
    """Strings with escapes, nested arrays and numbers of documents; anything after one rejects it."""
    size = F.col("p_size").cast("string")
    doc = F.concat(F.lit('{"a": {"name": "\\u00dcn\\u00efc \\"'), size, F.lit('\\"", "v": [1e2, '), (F.col("p_size") / 4.0).cast("string"), F.lit(", null, true]}}"), F.when(F.col("p_partkey") % 5 == 0, " x").otherwise(""))
    d = read(spark, sf, "part", "p_partkey", "p_size").select("p_partkey", doc.alias("doc"))
    name, second = text.json_text(F.col("doc"), "$.a.name"), text.json_number(F.col("doc"), "$.a.v[1]")
    return d.select("p_partkey", F.coalesce(name, F.lit("")).alias("name"), F.coalesce(second, F.lit(-1.0)).alias("second"), text.json_document(F.col("doc")).isNotNull().alias("parsed"))
