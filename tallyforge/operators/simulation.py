"""Simulated catalogs and the null distributions of similarity.

A draw's numbers depend on the seed and the draw's own key, never on the
partition, so results are the same however rows are dealt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.model import EngineError

ARMS = ("multinomial", "poisson", "nb")
#: Largest Monte Carlo standard error of a null's mean, and the batches it comes from.
MC_SE, BATCHES = 0.01, 20


def _generator(*key) -> np.random.Generator:
    raw = hashlib.md5(":".join(map(str, key)).encode()).digest()
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(np.frombuffer(raw, "<u4").tolist())))


def _drawn(r: np.random.Generator, mu: np.ndarray, arm: str, size: float) -> np.ndarray:
    if arm == "multinomial":
        total = int(round(float(mu.sum())))
        return r.multinomial(total, mu / mu.sum()).astype(float) if total else np.zeros(len(mu))
    if arm == "nb":
        mu = np.where(mu > 0, r.gamma(size, np.maximum(mu, 1e-300) / size), 0.0)
    return r.poisson(mu).astype(float)


def expected(signatures: DataFrame, exposures: DataFrame, burden: float) -> DataFrame:
    """(sample, channel, mu) of (signature, channel, value) and (sample, signature, exposure).
    A sample whose exposures sum to between 0.9 and 1.1 has shares, which are scaled to `burden`."""
    total = F.sum("exposure").over(Window.partitionBy("sample"))
    scaled = exposures.withColumn("exposure", F.col("exposure") * F.when((total > 0.9) & (total < 1.1), F.lit(float(burden))).otherwise(1.0))
    return scaled.join(signatures, "signature").groupBy("sample", "channel").agg(F.sum(F.col("value") * F.col("exposure")).alias("mu"))


def simulate(signatures: DataFrame, exposures: DataFrame, arm: str = "multinomial", size: float = 8.0, burden: float = 1000, seed: int = 1) -> DataFrame:
    """(sample, channel, count): one task draws a sample's channels, whose number is that of the channel table."""
    if arm not in ARMS:
        raise EngineError("option", f"arm {arm} is none of {', '.join(ARMS)}")
    if not (size > 0 and burden >= 1 and burden == int(burden) and seed >= 0):
        raise EngineError("input", "size must be positive, burden a whole number of 1 at least and seed not negative")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("channel")
        name = str(pdf["sample"].iloc[0])
        return pd.DataFrame({"sample": name, "channel": pdf["channel"], "count": _drawn(_generator(seed, name), pdf["mu"].to_numpy(float), arm, size)})

    return expected(signatures, exposures, burden).groupBy("sample").applyInPandas(work, "sample string, channel string, count double")


def null_draws(spark: SparkSession, family: str, m: int = 96, burden: int = 1000, n: int = 20_000, seed: int = 1, size: float = 8.0, profile: list[float] | None = None) -> DataFrame:
    """(draw, cosine) of a null family: `signature_uniform` (two uniform profiles), `catalog_multinomial`,
    `catalog_poisson` and `catalog_nb` (a uniform truth and its reconstruction at `burden`), or `shape`
    (multinomial reconstructions of `profile`)."""
    arm = family.removeprefix("catalog_")
    if family not in ("signature_uniform", "shape") and (arm == family or arm not in ARMS):
        raise EngineError("argument", f"unknown family {family}")
    if family == "shape" and not profile:
        raise EngineError("argument", "the shape family needs a profile")
    if n < 200 or m < 2 or burden < 1:
        raise EngineError("argument", "a null needs 200 draws, 2 channels and a burden of 1 at least")
    truth = np.asarray(profile, float) / np.sum(profile) if profile else _generator(seed, family, "truth").dirichlet(np.ones(m))

    def work(batches):
        for pdf in batches:
            out = []
            for draw in pdf["id"]:
                r = _generator(seed, family, draw)
                if family == "signature_uniform":
                    x, y = r.dirichlet(np.ones(m)), r.dirichlet(np.ones(m))
                else:
                    x, y = _drawn(r, truth * burden, "multinomial" if family == "shape" else arm, size), truth
                norm = float(np.sqrt((x @ x) * (y @ y)))
                out.append(float(x @ y) / norm if norm else 0.0)
            yield pd.DataFrame({"draw": pdf["id"], "cosine": out})

    return spark.range(n).mapInPandas(work, "draw long, cosine double")


def null_summary(draws: DataFrame, quantiles: list[float], tolerance: float = MC_SE) -> dict:
    """mean, sd, mc_se (of means of 20 batches) and quantiles; too large an error is refused."""
    means = draws.groupBy((F.col("draw") % BATCHES).alias("batch")).agg(F.avg("cosine").alias("m"))
    se = means.agg((F.stddev_samp("m") / F.sqrt(F.lit(float(BATCHES)))).alias("se")).first()["se"]
    if se is None or se > tolerance:
        raise EngineError("calibration", f"the Monte Carlo error {se} exceeds {tolerance}", hint="take more draws")
    row = draws.agg(F.avg("cosine").alias("mean"), F.stddev_samp("cosine").alias("sd"), F.percentile("cosine", F.array(*[F.lit(float(q)) for q in quantiles])).alias("q")).first()
    return {"mean": row["mean"], "sd": row["sd"], "mc_se": se, "quantiles": list(row["q"])}


def conditional_p(draws: DataFrame, observed: float) -> float:
    """Share of draws at least as alike, one added to both."""
    hits, n = draws.agg(F.count_if(F.col("cosine") >= observed), F.count(F.lit(1))).first()
    return (1 + hits) / (n + 1)


def analytic_null(m: int) -> dict[str, float]:
    """Moments of two uniform profiles over m channels and the mean cosine they suggest."""
    mean = (m + 1) / (2 * m)
    return {"inner": 1 / m, "norm2": 2 / (m + 1), "mean": mean, "mean_corrected": mean + 1 / (3 * m)}


def strand_bias(uts: float, ts: float) -> dict:
    """Exact two-sided test of equal strands: p, the fraction on the untranscribed strand, the ratio and the
    direction.  Fractional masses interpolate each tail between its whole numbers."""
    if uts < 0 or ts < 0:
        raise EngineError("argument", "strand masses are negative")
    from math import exp, lgamma, log

    n, low = uts + ts, min(uts, ts)
    whole = int(round(n))
    if whole == 0 or uts == ts:
        p = 1.0
    else:
        pmf = lambda k: exp(lgamma(whole + 1) - lgamma(k + 1) - lgamma(whole - k + 1) - whole * log(2))
        floor = min(int(low), whole)
        tail = sum(pmf(k) for k in range(floor + 1))
        if floor < whole:
            tail += (low - floor) * pmf(floor + 1)
        p = min(1.0, 2 * tail)
    return {"p": p, "fraction": uts / n if n else None, "ratio": uts / ts if ts else None, "direction": "untranscribed" if uts > ts else "transcribed" if ts > uts else "symmetric"}


def sanity_curve(levels: list[int], coverage: list[float], synthetic: list[float], tolerance: float = 0.05, floor: float = 0.90) -> dict:
    """Whether a coverage curve over dilution levels follows a synthetic one, or the floor, and doesn't fall
    by more than the tolerance in most of its steps."""
    steps = [b - a for a, b in zip(coverage, coverage[1:])]
    fallen = [i + 1 for i, s in enumerate(steps) if s < -tolerance]
    inside = [abs(c - s) <= tolerance or floor <= c <= 1.0 for c, s in zip(coverage, synthetic)]
    systematic = 2 * len(fallen) > len(steps) if steps else False
    return {"levels": levels, "inside": inside, "inversions": fallen, "systematic": systematic, "ok": all(inside) and not systematic}
