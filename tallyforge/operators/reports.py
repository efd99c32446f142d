"""Quality control, deficiency and treatment reports over long frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.model import EngineError

CALLERS = ("ASCAT", "ASCAT_NGS", "ABSOLUTE", "FACETS", "BATTENBERG", "PURPLE", "SEQUENZA", "PCAWG")


def burden_class(total):
    return F.when(total == 0, "dead").when(total < 100, "low").when(total < 10_000, "standard").otherwise("high")


#: Shares from which a sample is an artifact or watched.
ARTIFACT_SHARE, CA_SHARE, CT_SHARE = 0.05, 0.30, 0.40


def qc_flag(artifact_share, share_ca, share_ct, burden):
    """artifact, watch or ok; a null share reaches no threshold."""
    reaches = lambda c, least: F.coalesce(c >= least, F.lit(False))
    return F.when(reaches(artifact_share, ARTIFACT_SHARE) | reaches(share_ca, CA_SHARE), "artifact").when(reaches(share_ct, CT_SHARE) | (burden == "low"), "watch").otherwise("ok")


def mechanism_channels(channels: list[str]) -> list[tuple[str, str]]:
    """(channel, mechanism) of the two damage mechanisms: C>A by oxidation, C>T by formalin fixation."""
    return [(c, "oxoG" if "C>A" in c else "ffpe") for c in channels if "C>A" in c or "C>T" in c]


def qc_report(catalog: DataFrame, c_to_a: str, c_to_t: str, artifacts: DataFrame | None = None) -> DataFrame:
    """(sample, total, log10_total, burden, share_ca, share_ct, flag); `c_to_*` are patterns of channels.
    `artifacts` (sample, artifact_share) has the fitted share of artifact signatures; without it none is known."""
    part = lambda p: F.sum(F.when(F.col("channel").like(p), F.col("count")).otherwise(0.0))
    s = catalog.groupBy("sample").agg(F.sum("count").alias("total"), part(c_to_a).alias("ca"), part(c_to_t).alias("ct"))
    share = lambda c: F.try_divide(F.col(c), F.col("total"))
    out = s.select("sample", "total", F.when(F.col("total") > 0, F.log10("total")).alias("log10_total"), burden_class(F.col("total")).alias("burden"), share("ca").alias("share_ca"), share("ct").alias("share_ct"))
    out = out.join(artifacts.select("sample", "artifact_share"), "sample", "left") if artifacts is not None else out.withColumn("artifact_share", F.lit(None).cast("double"))
    return out.withColumn("flag", qc_flag(F.col("artifact_share"), F.col("share_ca"), F.col("share_ct"), F.col("burden"))).drop("artifact_share")


#: The chromosomes that count, and those whose short arm can be left out.
AUTOSOMES = tuple(str(k) for k in range(1, 23))
ACROCENTRIC = ("13", "14", "15", "21", "22")


def _bare(chromosome: str):
    """A chromosome's name without a leading chr."""
    return F.regexp_replace(chromosome, "^chr", "")


def ploh(segments: DataFrame, chr_size: float) -> DataFrame:
    """(sample, ploh): share of the genome lost, on autosomes; the smaller of both alleles decides.

    Rows with a null position, state or minor_cn count nothing; a sample
    without usable rows has 0.
    """
    minor = F.least(F.col("state") - F.col("minor_cn"), F.col("minor_cn"))
    whole = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("state").isNotNull() & F.col("minor_cn").isNotNull()
    lost = whole & _bare("chromosome").isin(*AUTOSOMES) & (F.col("state") >= 1) & (minor == 0)
    return segments.groupBy("sample").agg((F.sum(F.when(lost, F.col("end") - F.col("start") + 1).otherwise(0)) / F.lit(float(chr_size))).alias("ploh"))


def aneuploidy(segments: DataFrame, arms: DataFrame, ploidy: int = 2, rm_black_arms: bool = False) -> DataFrame:
    """(sample, aneuploidy): autosomes whose states, weighted by the share of an arm that
    they cover and added up over both arms, aren't the ploidy after rounding half to even.

    Where one segment spans the whole chromosome, each meeting of a segment and
    an arm weighs 0.5 instead.  `arms` (chromosome, arm, arm_start, arm_end) has
    a few dozen rows; `rm_black_arms` leaves out the acrocentric short arms.
    """
    s = segments.where(F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("state").isNotNull()).withColumn("chromosome", _bare("chromosome")).where(F.col("chromosome").isin(*AUTOSOMES))
    a = arms.withColumn("chromosome", _bare("chromosome"))
    ends = a.groupBy("chromosome").agg(F.min(F.when(F.col("arm") == "p", F.col("arm_start"))).alias("first"), F.max(F.when(F.col("arm") == "q", F.col("arm_end"))).alias("last"))
    if rm_black_arms:
        a = a.where(~((F.col("arm") == "p") & F.col("chromosome").isin(*ACROCENTRIC)))
    a = F.broadcast(a.join(ends, "chromosome"))
    met = s.join(a, "chromosome").where((F.col("start") <= F.col("arm_end")) & (F.col("end") >= F.col("arm_start")))
    over = F.least("end", "arm_end") - F.greatest("start", "arm_start") + 1
    # one pass: both sums, of which the whole-chromosome flag picks one
    total = met.groupBy("sample", "chromosome").agg(
        F.max((F.col("start") <= F.col("first")) & (F.col("end") >= F.col("last"))).alias("whole"), F.sum(F.col("state") * 0.5).alias("halves"),
        F.sum(F.col("state") * over / (F.col("arm_end") - F.col("arm_start") + 1)).alias("shares"),
    )
    off = F.bround(F.round(F.when(F.col("whole"), F.col("halves")).otherwise(F.col("shares")) - ploidy, 9), 0) != 0
    scored = total.groupBy("sample").agg(F.count_if(off).cast("double").alias("aneuploidy"))
    return segments.select("sample").distinct().join(scored, "sample", "left").fillna(0.0, ["aneuploidy"])


def hrd_report(segments: DataFrame, arms: DataFrame, chr_size: float, caller: str, assay: str = "wgs", experimental: bool = False) -> DataFrame:
    """(sample, ploh, aneuploidy, hrd): hrd is 1 from a lost share of 0.4 and 4 aneuploid chromosomes on."""
    if caller not in CALLERS:
        raise EngineError("input", f"caller {caller} isn't known")
    if assay == "wes" and not experimental:
        raise EngineError("input", "exome data need experimental=True")
    both = ploh(segments, chr_size).join(aneuploidy(segments, arms), "sample", "left")
    return both.withColumn("hrd", ((F.col("ploh") >= 0.4) & (F.col("aneuploidy") >= 4)).cast("int"))


def contrast(values: DataFrame, treated: DataFrame, floor: float = 50.0) -> DataFrame:
    """(signature, n_exposed, n_unexposed, difference, lower, upper, associated) from draws
    (sample, signature, draw, value): intervals of the difference of group means over draws."""
    marked = values.join(treated.select("sample").distinct().withColumn("exposed", F.lit(True)), "sample", "left").fillna(False, ["exposed"])
    by_draw = marked.groupBy("signature", "draw").agg((F.avg(F.when(F.col("exposed"), F.col("value"))) - F.avg(F.when(~F.col("exposed"), F.col("value")))).alias("d"))
    n = marked.groupBy("signature").agg(F.count_distinct(F.when(F.col("exposed"), F.col("sample"))).alias("n_exposed"), F.count_distinct(F.when(~F.col("exposed"), F.col("sample"))).alias("n_unexposed"))
    ends = by_draw.groupBy("signature").agg(F.avg("d").alias("difference"), F.percentile("d", 0.025).alias("lower"), F.percentile("d", 0.975).alias("upper"))
    return n.join(ends, "signature").withColumn("associated", (F.col("lower") > floor) | (F.col("upper") < -floor))


def stratified(totals: DataFrame, cutoff: float) -> DataFrame:
    return totals.withColumn("is_hyper", F.col("total") > cutoff)


def hyper_cutoff(totals: DataFrame, channels: int, seed: int = 1) -> tuple[float, dict]:
    """Cutoff from a two-Gaussian mixture of all totals, fitted on how many samples have each total: the mean
    plus two deviations of the lower part, rounded down, and 100 for each channel at least."""
    from tallyforge.operators import numerics as N

    import numpy as np

    rows = totals.groupBy("total").agg(F.count(F.lit(1))).orderBy("total").collect()
    x, n = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float)
    if not len(x):
        return 100.0 * channels, {"n": 0}
    while True:
        mean, var, weight, ll = N.gmm2(x, seed, count=n)
        low, high = (0, 1) if mean[0] <= mean[1] else (1, 0)
        gap = mean[high] - mean[low]
        major = int(np.argmax(weight))
        if n.sum() < 4 or gap < 4 * np.sqrt(var[major]) or major == low:
            break
        near = np.abs(x - mean[major]) <= np.abs(x - mean[1 - major])
        x, n = x[near], n[near]
        if len(x) < 2:
            break
    m = float(np.average(x, weights=n)) if len(x) else 0.0
    s = float(np.sqrt(np.average((x - m) ** 2, weights=n))) if len(x) else 0.0
    if gap >= 4 * np.sqrt(var[low]):
        m, s = float(mean[low]), float(np.sqrt(var[low]))
    return max(float(int(m + 2 * s)), 100.0 * channels), {"n": int(n.sum()), "means": mean.tolist(), "weights": weight.tolist(), "loglik": ll}
