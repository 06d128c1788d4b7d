"""Reading tables and small closed-form inputs for queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({k: F.round(k, n) for k, n in digits.items()})


FRAME_W, FRAME_H = 12, 8
#: SQL of the frames that `frames` reads: g has frame, y, x and v.
FRAMES = f"""WITH q AS (SELECT l_suppkey AS frame, l_orderkey % {FRAME_H} AS y, l_partkey % {FRAME_W} AS x, max(l_quantity) / 50.0 AS v FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT c.*, coalesce(q.v, (c.frame * 5 + c.y * 3 + c.x * 7) % 13 / 13.0) AS v FROM (SELECT s_suppkey AS frame, CAST(range // {FRAME_W} AS INT) AS y, CAST(range % {FRAME_W} AS INT) AS x FROM supplier, range({FRAME_W * FRAME_H})) c LEFT JOIN q USING (frame, y, x))"""


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """A small raster for each supplier: the largest quantity of the lines that fall on a pixel, a pattern where none does."""
    li = read(spark, sf, "lineitem", "l_suppkey", "l_orderkey", "l_partkey", "l_quantity")
    lit = li.groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_orderkey") % FRAME_H).cast("int").alias("y"), (F.col("l_partkey") % FRAME_W).cast("int").alias("x")).agg((F.max("l_quantity") / 50.0).alias("own"))
    i = F.explode(F.sequence(F.lit(0), F.lit(FRAME_W * FRAME_H - 1)))
    cells = read(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("frame"), i.alias("i")).select("frame", F.floor(F.col("i") / FRAME_W).cast("int").alias("y"), (F.col("i") % FRAME_W).alias("x"))
    return cells.join(lit, ["frame", "y", "x"], "left").select("frame", "y", "x", F.coalesce("own", (F.col("frame") * 5 + F.col("y") * 3 + F.col("x") * 7) % 13 / 13.0).alias("v"))


def grid(spark: SparkSession, width: int, height: int) -> DataFrame:
    """A raster in closed form: whole numbers mixed to 64 levels, so any engine makes the same."""
    i = F.col("id")
    x, y = i % width, F.floor(i / width)
    v = (x * 7 + y * 13 + (i * i) % 11) % 64 / 63.0
    return spark.range(width * height).select(y.cast("int").alias("y"), x.cast("int").alias("x"), v.alias("v"))
