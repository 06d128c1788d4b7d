"""Connected components and match funnels."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Written to the cluster's shared folder and read again, so that iteration starts from files."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: id; edges: a, b -> id, component: the least id reachable, itself for a lone node.

    Labels sink to the least neighbour's, then to their label's label, so long chains halve; minima are
    combined before they move, so a hub is no burden. Ends when a round changes nothing.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = settle(nodes.select("id", F.col("id").alias("component")), "labels")
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        sunk = label.join(seen, F.col("id") == F.col("a"), "left").select("id", "component", F.least("component", F.coalesce("c", "component")).alias("now"))
        sunk = settle(sunk, "labels")
        if not sunk.where("now <> component").limit(1).count():
            return label
        jump = sunk.select(F.col("id").alias("i"), F.col("now").alias("onward"))
        label = settle(sunk.join(jump, F.col("now") == F.col("i"), "left").select("id", F.least("now", F.coalesce("onward", "now")).alias("component")), "labels")


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("members"))


def inlier_histogram(pairs: DataFrame, inliers: str, width: int = 4, last: int = 25) -> DataFrame:
    """Pairs by bucket of inliers; the last bucket is open."""
    return pairs.groupBy(F.least(F.lit(last), F.floor(F.col(inliers) / width)).cast("int").alias("bucket")).agg(F.count("*").alias("pairs"))


def match_funnel(pairs: DataFrame, matches: str, inliers: str, least: int = 12) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if(F.col(matches) >= least).alias("matched"),
        F.count_if(F.col(inliers) >= least).alias("verified"),
        F.count_if((F.col(matches) >= least) & (F.col(inliers) <= 3)).alias("inconsistent"),
    )
