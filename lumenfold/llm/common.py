"""Helpers that the training-data operators share: table access, lineage cuts, native text scans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space as the contracts write it: \x20 and \x09-\x0D.
SPACE = r"[ \t\n\x0B\f\r]"
WORD = r"[^ \t\n\x0B\f\r]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; others, whatever they are called, are left unread."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return Arrow memory that is free: a Python worker outlives its task, and an executor has several."""
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores added one that no column of the table has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a lambda variable, so that Catalyst evaluates it once however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


#: Entries that a running list holds before it is set aside whole; keeps a scan of m entries near-linear.
SCAN_BLOCK = 512


def spans(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, around: int = 0) -> Column:
    """array<struct<start,end,match,before,after>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pattern must not match the empty string. `keep` drops matches after the scan, without a second try;
    before and after hold up to `around` characters and one character of what stands between matches.
    Rows without a match pay for one search only; null text has no spans.
    """
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"
    state = f"struct<pos:int,done:array<{kind}>,now:{kind}>"

    def push(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["skip"]
        end = start + F.length(x["match"])
        new = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["before"].alias("before"), x["after"].alias("after")))
        full = F.size(acc["now"]) >= SCAN_BLOCK
        return F.struct(
            end.alias("pos"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, new).otherwise(F.concat(acc["now"], new)).alias("now"),
        ).cast(state)

    found = let(
        F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")),
        lambda p: F.aggregate(
            F.transform(
                p["hit"],
                lambda h, i: F.struct(
                    F.length(F.get(p["gap"], i)).alias("skip"),
                    h.alias("match"),
                    F.right(F.get(p["gap"], i), F.lit(around)).alias("before"),
                    (F.left(F.get(p["gap"], i + 1), F.lit(1)) if around else F.lit("")).alias("after"),
                ),
            ),
            F.expr(f"cast(named_struct('pos', 0, 'done', array(), 'now', array()) as {state})"),
            push,
            lambda acc: F.concat(F.flatten(acc["done"]), acc["now"]),
        ),
    )
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["match"]))
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as {kind})"))


def span_list(found: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs with these fields."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def indexed(df: DataFrame, *order: Column) -> DataFrame:
    """The rows with `index`, from 0 in this order; sorted by ranges, so no task sees them all."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "indexed")
    counts = dealt.groupBy("part").count()  # a row per partition
    before = counts.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("at", at).join(F.broadcast(before.drop("count")), "part").withColumn("index", F.col("at") + F.col("before")).drop("part", "at", "before")


def as_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows made on the driver, as SQL literals: no Python runs on an executor to read them."""
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])
    entries = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(entries))
