"""Similarity of signatures in long form: one equi-join on the channel and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def shares(values: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Values scaled to a sum of 1 in each key; null where the sum is 0."""
    return values.withColumn(value, F.try_divide(F.col(value), F.sum(value).over(Window.partitionBy(key))))


def pairwise(est: DataFrame, ref: DataFrame) -> DataFrame:
    """(est, ref, cosine, correlation, jsd, hellinger) of all pairs of two small sets.

    Inputs are (id, channel, value), complete over the same channels and with
    shares as values.  The join is on the channel, never on nothing; the result
    has signatures x signatures rows, which don't grow with the samples.
    """
    p, q = F.col("p"), F.col("q")
    both = est.select(F.col("id").alias("est"), "channel", F.col("value").alias("p")).join(ref.select(F.col("id").alias("ref"), "channel", F.col("value").alias("q")), "channel")
    m = (p + q) / 2
    plogp = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    sums = both.groupBy("est", "ref").agg(
        F.sum(p * q).alias("pq"), F.sum(p * p).alias("pp"), F.sum(q * q).alias("qq"), F.count(F.lit(1)).alias("n"), F.sum("p").alias("sp"), F.sum("q").alias("sq"),
        F.sum(plogp(p) + plogp(q)).alias("js"), F.sum((F.sqrt("p") - F.sqrt("q")) * (F.sqrt("p") - F.sqrt("q"))).alias("he"),
    )
    vp, vq = F.col("pp") - F.col("sp") * F.col("sp") / F.col("n"), F.col("qq") - F.col("sq") * F.col("sq") / F.col("n")
    cov = F.col("pq") - F.col("sp") * F.col("sq") / F.col("n")
    flat = (vp <= 1e-12 * F.col("pp")) | (vq <= 1e-12 * F.col("qq"))
    return sums.select(
        "est", "ref", F.try_divide(F.col("pq"), F.sqrt(F.col("pp") * F.col("qq"))).alias("cosine"), F.when(~flat, cov / F.sqrt(vp * vq)).alias("correlation"),
        F.sqrt(F.greatest(F.col("js") / 2, F.lit(0.0))).alias("jsd"), F.sqrt(F.col("he") / 2).alias("hellinger"),
    )


def greedy_sweep(pairs: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, matched, total, share): estimates whose best cosine reaches each threshold."""
    best = pairs.groupBy("est").agg(F.max("cosine").alias("best"))
    t = pairs.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    rows = best.crossJoin(F.broadcast(t))
    out = rows.groupBy("threshold").agg(F.count_if(F.col("best") >= F.col("threshold")).alias("matched"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("share", F.col("matched") / F.col("total"))


def top_two(pairs: DataFrame) -> DataFrame:
    """(est, first, first_cosine, second, second_cosine); ties by name."""
    w = Window.partitionBy("est").orderBy(F.col("cosine").desc(), "ref")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where("rank <= 2")
    pick = lambda c, k: F.max(F.when(F.col("rank") == k, F.col(c)))
    return ranked.groupBy("est").agg(pick("ref", 1).alias("first"), pick("cosine", 1).alias("first_cosine"), pick("ref", 2).alias("second"), pick("cosine", 2).alias("second_cosine"))


def opportunity_converted(values: DataFrame, opportunities: DataFrame, key: str = "id") -> DataFrame:
    """(key, channel, value): value * to / from, scaled to 1; a zero column stays zero.
    `opportunities` (channel, from, to) is a channel table and is broadcast."""
    rows = values.join(F.broadcast(opportunities), "channel").withColumn("raw", F.col("value") * F.col("to") / F.col("from"))
    total = F.sum("raw").over(Window.partitionBy(key))
    return rows.withColumn("value", F.when(total > 0, F.col("raw") / total).otherwise(0.0)).select(key, "channel", "value")


def activity_scores(truth: DataFrame, fitted: DataFrame) -> DataFrame:
    """(sample, tp, fp, fn, tn, precision, recall, specificity, manhattan) from (sample, signature, exposure)."""
    both = truth.withColumnRenamed("exposure", "t").join(fitted.withColumnRenamed("exposure", "f"), ["sample", "signature"], "full").fillna(0.0, ["t", "f"])
    c = lambda a, b: F.count_if(((F.col("t") > 0) == a) & ((F.col("f") > 0) == b))
    out = both.groupBy("sample").agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"), F.sum(F.abs(F.col("t") - F.col("f"))).alias("gap"), F.sum("t").alias("total"))
    div = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    return out.select("sample", "tp", "fp", "fn", "tn", div("tp", "fp").alias("precision"), div("tp", "fn").alias("recall"), div("tn", "fp").alias("specificity"), F.try_divide(F.col("gap"), F.col("total")).alias("manhattan"))
