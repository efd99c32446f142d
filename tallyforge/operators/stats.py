"""Order statistics, multiplicity control and resampling in SQL form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_sum(value: str) -> Column:
    """The sum of doubles of up to 12 decimals without rounding on the way, so that equal sums are equal
    in whatever order their rows come; others are added as doubles."""
    d = F.col(value).try_cast("decimal(38,12)")
    plain = F.count_if(F.col(value).isNotNull() & ~F.coalesce(d.cast("double") == F.col(value), F.lit(False))) == 0
    return F.coalesce(F.when(plain, F.try_sum(d).cast("double")), F.sum(value))


def bh_adjusted(rows: DataFrame, keys: list[str], p: str = "p", order: str = "id") -> DataFrame:
    """Adds q: the step-up adjusted p value within each family; null p values have a null q and don't count.

    One sort of each family, from the largest p down, gives the ranks from
    behind and the running minimum, so the work is linear after the sort.
    """
    family = Window.partitionBy(*keys)
    falling = family.orderBy(F.col(p).desc_nulls_first(), F.col(order).desc())
    rank = F.count(F.lit(1)).over(family) - F.row_number().over(falling) + 1
    raw = F.col(p) * F.count(p).over(family) / rank
    least = F.min("__raw").over(falling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("__raw", raw).withColumn("q", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("__raw")


def rank_sums(rows: DataFrame, keys: list[str], value: str, first: Column) -> DataFrame:
    """(keys, n1, n2, w, z): two-sample rank sum with average ranks and the tie-corrected normal z; null when all values are tied."""
    family = Window.partitionBy(*keys)
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    ranked = rows.withColumn("__r", F.rank().over(family.orderBy(value)) + (ties - 1) / 2.0).withColumn("__t", ties.cast("double")).withColumn("__f", first)
    s = ranked.groupBy(*keys).agg(
        F.count_if("__f").alias("n1"), F.count_if(~F.col("__f")).alias("n2"), F.sum(F.when(F.col("__f"), F.col("__r"))).alias("rs"), F.sum(F.col("__t") * F.col("__t") - 1).alias("tie"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    w = F.col("rs") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("tie"), n * (n - 1)))
    return s.select(*keys, "n1", "n2", w.alias("w"), F.when(variance > 0, (w - n1 * n2 / 2) / F.sqrt(variance)).alias("z"))


def running_median(rows: DataFrame, keys: list[str], order: list[str], value: str, half: int = 12) -> DataFrame:
    """Adds run_median over 2 half + 1 places, zeros standing in beyond the ends."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    held = F.collect_list(value).over(w)
    padded = F.sort_array(F.concat(held, F.array_repeat(F.lit(0.0), F.lit(2 * half + 1) - F.size(held))))
    return rows.withColumn("run_median", padded[half])


def uniform(key: Column) -> Column:
    """A number in [0, 2^32) that depends on the key alone."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def multinomial(counts: DataFrame, draws: DataFrame, seed: int, sample: str = "sample", channel: str = "channel", n: str = "n") -> DataFrame:
    """(sample, channel, drawn): `draws` (sample, draw) numbered draws by inversion of each sample's counts.

    A draw takes the channel whose cumulative interval holds floor(u * total);
    the join is by sample, with at most 1536 intervals on its right.
    """
    w = Window.partitionBy(sample).orderBy(channel)
    lines = counts.withColumn("hi", F.sum(n).over(w)).withColumn("lo", F.col("hi") - F.col(n)).withColumn("total", F.sum(n).over(Window.partitionBy(sample)))
    u = uniform(F.concat_ws(":", F.lit(str(seed)), F.col(sample).cast("string"), F.col("draw").cast("string")))
    total = lines.groupBy(sample).agg(F.max("total").alias("t"))
    thrown = draws.join(total, sample).withColumn("at", F.floor(u.cast("double") / F.lit(4294967296.0) * F.col("t")).cast("bigint"))
    hit = thrown.join(lines.select(sample, channel, "lo", "hi"), sample).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
    return hit.groupBy(sample, channel).agg(F.count(F.lit(1)).alias("drawn"))
