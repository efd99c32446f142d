"""Genome access: a frame of overlapping chunks, joined by chromosome and bin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN, FLANK = 1 << 16, 8


def chunked(sequences: DataFrame, size: int = BIN, flank: int = FLANK, wrap: bool = False) -> DataFrame:
    """(chrom, bin, first, seq, total) from (chrom, seq): chunk `bin` starts `flank` bases early, `first` is its 0-based start.

    With `wrap` the first chunk starts with the chromosome's last `flank` bases, at negative places.
    """
    n = F.length("seq")
    rows = sequences.select("chrom", F.translate("seq", "acgtn", "ACGTN").alias("seq"), n.alias("total"), F.explode(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int"))).alias("bin"))
    first = F.greatest(F.col("bin") * size - flank, F.lit(0))
    part = F.substring("seq", first + 1, F.least((F.col("bin") + 1) * size + flank, F.col("total")) - first)
    if wrap:
        tail, lead = F.least(F.lit(flank), F.col("total")), F.col("bin") == 0
        part = F.when(lead, F.concat(F.substring("seq", F.col("total") - tail + 1, tail), part)).otherwise(part)
        first = F.when(lead, -tail).otherwise(first)
    return rows.select("chrom", "bin", first.alias("first"), part.alias("seq"), "total")


def with_context(variants: DataFrame, chunks: DataFrame, k: int = 2, size: int = BIN) -> DataFrame:
    """Adds context: the 2k + 1 bases around `start` (1-based), null outside the chromosome.

    One equi-join on (chrom, bin); a hot bin's variants are split by the
    runtime's skew handling as the chunk is one row.
    """
    zero = F.col("start") - 1
    rows = variants.withColumn("bin", F.floor(zero / size).cast("int"))
    joined = rows.join(chunks, ["chrom", "bin"], "left")
    at = (zero - k - F.col("first")).cast("int")
    good = (zero - k >= 0) & (zero + k < F.col("total"))
    return joined.withColumn("context", F.when(good, F.substring("seq", at + 1, F.lit(2 * k + 1)))).drop("bin", "first", "seq", "total")


def context_reason(ref, context, k: int = 2):
    """Why a single-base record can't be classified in its context, or null."""
    return F.when(context.isNull(), "context_bounds").when(~context.rlike(r"^[ACGT]+\z"), "n_context").when(F.substring(context, k + 1, 1) != ref, "ref_mismatch")
