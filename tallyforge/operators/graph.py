"""Lineage cuts in the shared folder, and connected components of an edge table
without bringing it to the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one is chosen only where it is unset,
    as in tests on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, which cuts its lineage and
    survives the loss of executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges that one task takes through a round without any exchange; more are dealt out.
LOCAL_EDGES = 1 << 16


def _sized(e: DataFrame, n: int) -> DataFrame:
    return e.coalesce(1) if n <= LOCAL_EDGES else e


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of each node of `edges`, root being its component's least node.

    Alternates large-star and small-star rounds: each links a node's neighbours
    to its least one.  The number of rounds grows with the logarithm of the
    nodes.  Each round's edges are written to the shared folder.  Null ends and
    loops are no edges; an empty table has no nodes.  A graph of LOCAL_EDGES
    edges at most stands in one partition, where no round needs an exchange;
    the rounds are the same.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = written(e)
    before, count = None, e.count()
    if count <= LOCAL_EDGES:
        e = written(_sized(e, count))  # of many small files, every scan would open each
    while True:
        e = _sized(e, count)
        both = _sized(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), count)
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u != v")
        large = _sized(large, count).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v")
        small = _sized(small, count).distinct()
        e = written(_sized(small, count))
        # a star forest has each node once on the left and no root there
        state = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
        if state == before:
            break
        before, count = state, state[0]
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
