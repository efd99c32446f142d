"""Classify-and-count: events to dense sample x channel catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def counted(rows: DataFrame, sample: str = "sample", channel: str = "channel") -> DataFrame:
    """(sample, channel, n): partial counts before the only shuffle; rows without a channel aren't counted."""
    return rows.where(F.col(channel).isNotNull()).groupBy(sample, channel).agg(F.count(F.lit(1)).alias("n"))


def dense(counts: DataFrame, channels: DataFrame, samples: DataFrame | None = None, sample: str = "sample", channel: str = "channel", n: str = "n") -> DataFrame:
    """Every sample with every channel, 0 where nothing was counted.

    The channel dimension has at most 1536 rows, so the grid is samples x a
    constant; it is broadcast into the samples.
    """
    names = (samples if samples is not None else counts).select(sample).distinct()
    grid = names.crossJoin(F.broadcast(channels.select(channel).distinct()))
    return grid.join(counts, [sample, channel], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def with_share(counts: DataFrame, sample: str = "sample", n: str = "n") -> DataFrame:
    """Adds total and share; a sample without counts has null shares."""
    total = F.sum(n).over(Window.partitionBy(sample))
    return counts.withColumn("total", total).withColumn("share", F.try_divide(F.col(n).cast("double"), F.col("total").cast("double")))


def pivoted(counts: DataFrame, samples: list[str], sample: str = "sample", channel: str = "channel", n: str = "n") -> DataFrame:
    """One row for each channel and a column for each of the given samples."""
    return counts.groupBy(channel).pivot(sample, samples).agg(F.first(n))


def ledger(rows: DataFrame, destination: Column) -> DataFrame:
    """(destination, n, n_skipped)."""
    return rows.groupBy(destination.alias("destination")).agg(F.count(F.lit(1)).alias("n"), F.count_if(destination.startswith("skipped:")).alias("n_skipped"))
