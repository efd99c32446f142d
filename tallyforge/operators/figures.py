"""Long frames behind the figures: what a chart of a catalog, fit or report draws, one row for each mark.

Catalogs are (sample, channel, count), exposures (sample, signature, value),
draws (sample, signature, draw, value).  Nothing is rendered here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.model import EngineError

#: The floor of bootstrap stability, and of the average and the least stability of a rank.
STABILITY_FLOOR, AVERAGE_FLOOR, LEAST_FLOOR = 0.95, 0.8, 0.2
BINS = 30


def profile(catalog: DataFrame, mode: str = "share", id: str = "sample", part: str = "channel", value: str = "count") -> DataFrame:
    """(id, part, value) of every column, as counts or shares; a column without counts has null shares."""
    if mode not in ("share", "count"):
        raise EngineError("argument", f"mode {mode} is neither share nor count")
    v = F.col(value).cast("double")
    if mode == "share":
        v = F.try_divide(v, F.sum(v).over(Window.partitionBy(id)))
    return catalog.select(id, part, v.alias("value"))


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """(channel, first, second) of two profiles (channel, value); a channel that one side lacks is 0 there."""
    a, b = first.select("channel", F.col("value").alias("first")), second.select("channel", F.col("value").alias("second"))
    return a.join(b, "channel", "full").fillna(0.0, ["first", "second"])


def scatter(first: DataFrame, second: DataFrame) -> DataFrame:
    """side_by_side() with the cosine of both profiles on each row."""
    both, every = side_by_side(first, second), Window.partitionBy()
    dot = lambda x, y: F.sum(F.col(x) * F.col(y)).over(every)
    return both.withColumn("cosine", F.try_divide(dot("first", "second"), F.sqrt(dot("first", "first") * dot("second", "second"))))


def reconstruction(catalog: DataFrame, signatures: DataFrame, exposures: DataFrame, mode: str = "share") -> DataFrame:
    """(sample, channel, which, value): observed, reconstructed and residual values; `signatures` are (signature, channel, value)."""
    fitted = exposures.select("sample", "signature", F.col("value").alias("h")).join(F.broadcast(signatures.select("signature", "channel", F.col("value").alias("w"))), "signature")
    fitted = profile(fitted.groupBy("sample", "channel").agg(F.sum(F.col("w") * F.col("h")).alias("count")), mode)
    both = profile(catalog, mode).withColumnRenamed("value", "observed").join(fitted.withColumnRenamed("value", "reconstructed"), ["sample", "channel"])
    both = both.withColumn("residual", F.col("observed") - F.col("reconstructed"))
    return both.unpivot(["sample", "channel"], ["observed", "reconstructed", "residual"], "which", "value")


def alluvium(exposures: DataFrame, mode: str = "share") -> DataFrame:
    """(sample, signature, value, low, high): the place of each signature in its sample's stack, by name."""
    rows = profile(exposures, mode, part="signature", value="value")
    high = F.sum("value").over(Window.partitionBy("sample").orderBy("signature").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("high", high).select("sample", "signature", "value", (F.col("high") - F.col("value")).alias("low"), "high")


def boot_intervals(draws: DataFrame, estimates: DataFrame, level: float = 0.95, show_zero: bool = False) -> DataFrame:
    """(sample, signature, estimate, lo, hi, stability, place): stability is the share of draws above 0; place ranks a sample's estimates."""
    tail = (1 - level) / 2
    ends = draws.groupBy("sample", "signature").agg(F.percentile("value", tail).alias("lo"), F.percentile("value", 1 - tail).alias("hi"), F.avg((F.col("value") > 0).cast("double")).alias("stability"))
    rows = estimates.select("sample", "signature", F.col("value").alias("estimate")).join(ends, ["sample", "signature"])
    rows = rows if show_zero else rows.where("estimate > 0 or hi > 0")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("sample").orderBy(F.col("estimate").desc(), "signature")))


def boot_histogram(draws: DataFrame, bins: int = BINS) -> DataFrame:
    """(sample, signature, bin, n): draws by equal widths from the least to the greatest; all in bin 0 where they are one value."""
    ends = Window.partitionBy("sample", "signature")
    low, high = F.min("value").over(ends), F.max("value").over(ends)
    bin = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("value") - low, high - low) * bins), F.lit(0)))
    return draws.select("sample", "signature", bin.cast("bigint").alias("bin")).groupBy("sample", "signature", "bin").agg(F.count(F.lit(1)).alias("n"))


def boot_stability(draws: DataFrame) -> DataFrame:
    """(sample, signature, stability, stable): the share of draws above 0, and whether it reaches the floor."""
    s = draws.groupBy("sample", "signature").agg(F.avg((F.col("value") > 0).cast("double")).alias("stability"))
    return s.withColumn("stable", F.col("stability") >= STABILITY_FLOOR)


def rank_curve(ranks: DataFrame) -> DataFrame:
    """(k, deviance, least): least marks the first k of the smallest deviance."""
    first = F.row_number().over(Window.orderBy("deviance", "k")) == 1
    return ranks.select("k", "deviance", first.alias("least"))


def rank_stability(ranks: DataFrame) -> DataFrame:
    """(k, kind, stability, floor, below) of (k, avg_stability, min_stability)."""
    rows = ranks.select("k", F.expr("stack(2, 'average', avg_stability, 'least', min_stability) as (kind, stability)"))
    floor = F.when(F.col("kind") == "average", AVERAGE_FLOOR).otherwise(LEAST_FLOOR)
    return rows.withColumn("floor", floor).withColumn("below", F.col("stability") < F.col("floor"))


def coverage_curve(hits: DataFrame, level: float = 0.95, window: float = 0.05) -> DataFrame:
    """(share, n, coverage, se, inside) of (share, n, covered): coverage with its binomial error, inside the window around the level."""
    s = hits.groupBy("share", "n").agg(F.avg(F.col("covered").cast("double")).alias("coverage"), F.count(F.lit(1)).alias("r"))
    se = F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / F.col("r"))
    return s.select("share", "n", "coverage", se.alias("se"), (F.abs(F.col("coverage") - level) <= window).alias("inside"))


def dashboard(report: DataFrame) -> DataFrame:
    """(sample, flag, metric, value) of a quality report's stored values; no threshold is applied again."""
    return report.select("sample", "flag", F.expr("stack(3, 'log10_total', log10_total, 'share_ca', share_ca, 'share_ct', share_ct) as (metric, value)"))


def contribution(artifacts: DataFrame, top: int = 3) -> DataFrame:
    """(sample, place, artifact_share, label) of (sample, signature, share): samples by their summed share, the largest
    first, labelled by the names of the `top` largest parts and + the number of others."""
    n = artifacts.groupBy("sample").agg(F.sum("share").alias("artifact_share"), F.sort_array(F.collect_list(F.when(F.col("share") > 0, F.struct((-F.col("share")).alias("s"), "signature")))).alias("parts"))
    more = F.size("parts") - top
    label = F.concat(F.array_join(F.transform(F.slice("parts", 1, top), lambda x: x["signature"]), ";"), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))
    place = F.row_number().over(Window.orderBy(F.round("artifact_share", 9).desc(), "sample"))
    return n.select("sample", place.cast("bigint").alias("place"), "artifact_share", label.alias("label"))


def burden_histogram(stratified: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, is_hyper, n, low): samples by total, in bins of one width from 0 on; `stratified` is (sample, total, is_hyper)."""
    width = stratified.agg((F.max("total").cast("double") / (bins - 1)).alias("width"))
    rows = stratified.crossJoin(F.broadcast(width))  # one row
    bin = F.coalesce(F.floor(F.try_divide(F.col("total"), F.col("width"))), F.lit(0)).cast("bigint")
    return rows.groupBy(bin.alias("bin"), "is_hyper").agg(F.count(F.lit(1)).alias("n"), F.max(bin * F.col("width")).alias("low"))


def opportunity(channels: DataFrame) -> DataFrame:
    """(channel, kind, log10_n) of (channel, n): kind is the substitution of a channel like A[C>A]A; 0 has a null logarithm."""
    return channels.select("channel", F.substring("channel", 3, 3).alias("kind"), F.when(F.col("n") > 0, F.log10(F.col("n").cast("double"))).alias("log10_n"))
