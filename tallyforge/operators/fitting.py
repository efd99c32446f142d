"""Exposure fitting over samples.  A task reads samples in order and fits blocks
of them together; a sample's vector has as many entries as channels, and the
dictionary is a channel x signature matrix, so both are bounded and the latter is
broadcast."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.model import EngineError
from tallyforge.operators import numerics as N
from tallyforge.operators import runs

FIT = "sample string, signature string, exposure double, share double, active boolean, lrt_stat double, lrt_p double, se double"


def dictionary(signatures: DataFrame, channels: list[str]) -> tuple[list[str], np.ndarray]:
    """(signature names, channels x signatures) scaled to column sums of 1; labels must agree exactly."""
    rows = signatures.select("signature", "channel", "value").toPandas()
    if set(rows["channel"]) != set(channels):
        raise EngineError("fit", "dictionary and catalog have different channels")
    wide = rows.pivot(index="channel", columns="signature", values="value").reindex(channels).fillna(0.0)
    w = wide.to_numpy(float)
    return list(wide.columns), w / np.maximum(w.sum(0), 1e-300)


def fit_rows(x: np.ndarray, w: np.ndarray, method: str = "nnls", size: float = 8.0, threshold: float = 0.01, rescale: bool = True, tests: bool = True, connected: tuple[tuple[int, ...], ...] = (), errors: bool = True):
    """(exposures, statistics, p values, standard errors) of samples, the rows of `x`; all are samples x signatures."""
    total = x.sum(1)
    if method == "nnls":
        h = N.nnls_rows(w.T @ w, N.crosses(x, w))
    elif method == "likelihood_bidirectional":
        h = N.bidirectional_rows(x, w)
    elif method == "lrt":
        h = N.nb_mle_rows(x, w, size, N.log_gammas(x, size))
    else:
        raise EngineError("argument", f"unknown method {method}")
    stat, p = np.full(h.shape, np.nan), np.full(h.shape, np.nan)
    if tests and (counted := np.flatnonzero(total > 0)).size:
        stat[counted], p[counted] = N.lrt_rows(x[counted], w, size)
    for group in connected:  # a group of which one is present is present as a whole
        part = np.flatnonzero(h[:, list(group)].any(1) & ~h[:, list(group)].all(1))
        h[part] = N.nnls_rows(w.T @ w, N.times(x[part], w), (h[part] > 0) | np.isin(np.arange(h.shape[1]), group))
    if rescale:
        sums = h.sum(1)
        h = h * np.divide(total, sums, out=np.ones(len(x)), where=sums > 0)[:, None]
    h = np.where(_shares(h) < threshold, 0.0, h)
    return h, stat, p, N.fisher_se_rows(w, h) if errors else np.full(h.shape, np.nan)


def _shares(h: np.ndarray) -> np.ndarray:
    sums = h.sum(1)[:, None]
    return np.divide(h, sums, out=h.copy(), where=sums > 0)


def fit_one(x: np.ndarray, w: np.ndarray, method: str = "nnls", **options):
    """(exposures, lrt rows, standard errors) of one sample."""
    h, stat, p, se = fit_rows(x[None], w, method, **options)
    return h[0], list(zip(stat[0].tolist(), p[0].tolist())), se[0]


#: Numbers that a block of samples takes at once.
BLOCK = 1 << 20


def _by_sample(catalog: DataFrame) -> DataFrame:
    """(none, sample, channel, count) with a sample's rows one after another; `none` marks the null sample."""
    name = F.col("sample").cast("string")
    rows = catalog.select(name.isNull().alias("none"), F.coalesce(name, F.lit("None")).alias("sample"), "channel", F.col("count").cast("double").alias("count"))
    return runs.in_order(rows, ["none", "sample"], [], int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _blocks(batches, at: dict[str, int], most: int):
    """(samples, samples x channels) of at most `most` samples, from the rows of _by_sample()."""
    held = None
    for last in (False, True):
        for pdf in batches if not last else [None]:
            rows = held if pdf is None else pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if rows is None or not len(rows):
                continue
            name, none = rows["sample"].to_numpy(object), rows["none"].to_numpy(bool)
            first = np.r_[True, (name[1:] != name[:-1]) | (none[1:] != none[:-1])]
            end = len(rows) if last else int(np.flatnonzero(first)[-1])  # the last sample may go on
            held = rows.iloc[end:]
            index = rows["channel"].iloc[:end].map(at)
            if index.isna().any():
                raise EngineError("fit", "dictionary and catalog have different channels")
            index, count, place = index.to_numpy(int), rows["count"].to_numpy(float)[:end], np.cumsum(first[:end]) - 1
            names = name[:end][first[:end]]
            cuts = np.searchsorted(place, np.arange(0, len(names) + most, most))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                x = np.zeros((min(most, len(names) - i * most), len(at)))
                np.add.at(x, (place[a:b] - i * most, index[a:b]), count[a:b])
                if len(x):
                    yield names[i * most : i * most + len(x)], x


def fit(catalog: DataFrame, signatures: DataFrame, channels: list[str], method: str = "nnls", **options) -> DataFrame:
    """(signature, sample) rows of exposures and tests from a long catalog (sample, channel, count)."""
    names, w = dictionary(signatures, channels)
    shared = catalog.sparkSession.sparkContext.broadcast((names, w, {c: i for i, c in enumerate(channels)}))

    def work(batches):
        names, w, at = shared.value
        k = len(names)
        for samples, x in _blocks(batches, at, max(1, BLOCK // (k * k + k * len(at)))):
            h, stat, p, se = fit_rows(x, w, method, **options)
            columns = {"exposure": h, "share": _shares(h), "active": h > 0, "lrt_stat": stat, "lrt_p": p, "se": se}
            yield pd.DataFrame({"sample": np.repeat(samples, k), "signature": np.tile(np.array(names, object), len(x)), **{c: v.ravel() for c, v in columns.items()}})

    out = _by_sample(catalog).mapInPandas(work, FIT)
    clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("sample", "signature", "exposure", "share", "active", clean("lrt_stat"), clean("lrt_p"), clean("se"))


def bootstrap(catalog: DataFrame, signatures: DataFrame, channels: list[str], n_boot: int = 200, seed: int = 1, method: str = "nnls", bca: bool = False) -> DataFrame:
    """(sample, signature, exposure, lower, upper, stability, n_boot): resampled refits.

    Samples are the unit of work; a draw's numbers depend on seed, sample and
    draw alone.  Intervals come from all draws of a sample in its own task; the
    draws of a block of samples are fitted together.
    """
    names, w = dictionary(signatures, channels)
    shared = catalog.sparkSession.sparkContext.broadcast((names, w, {c: i for i, c in enumerate(channels)}))

    def work(batches):
        names, w, at = shared.value
        k = len(names)
        for samples, x in _blocks(batches, at, max(1, BLOCK // (k * k + k * len(at)) // n_boot)):
            point = fit_rows(x, w, method, tests=False, errors=False)[0]
            drawn = np.zeros((len(x), n_boot, len(at)))
            for i, sample in enumerate(samples):
                key, total = int.from_bytes(hashlib.md5(sample.encode()).digest()[:8], "little"), int(x[i].sum())
                share = x[i] / x[i].sum() if total else None
                for b in range(n_boot if total else 0):
                    r = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, key, b])))
                    drawn[i, b] = r.multinomial(total, share)
            draws = fit_rows(drawn.reshape(-1, len(at)), w, method, tests=False, errors=False)[0].reshape(len(x), n_boot, k)
            draws[x.sum(1).astype(int) == 0] = 0.0
            low, high = np.percentile(draws, 2.5, axis=1), np.percentile(draws, 97.5, axis=1)
            if bca:
                d = draws - draws.mean(1, keepdims=True)
                a = (d**3).sum(1) / np.maximum(6 * (d**2).sum(1) ** 1.5, 1e-300)
                for i, j in np.ndindex(*point.shape):
                    lo, hi, plain = N.bca_levels(draws[i, :, j], point[i, j], float(a[i, j]))
                    if not plain:
                        low[i, j], high[i, j] = np.percentile(draws[i, :, j], [100 * lo, 100 * hi])
            columns = {"exposure": point, "lower": low, "upper": high, "stability": (draws > 0).mean(1)}
            yield pd.DataFrame({"sample": np.repeat(samples, k), "signature": np.tile(np.array(names, object), len(x)), **{c: v.ravel() for c, v in columns.items()}, "n_boot": n_boot})

    return _by_sample(catalog).mapInPandas(work, "sample string, signature string, exposure double, lower double, upper double, stability double, n_boot long")


def presence(fits: DataFrame) -> DataFrame:
    """(signature, statistic, n_samples, p): cohort tests from each sample's statistics."""
    sums = fits.where("lrt_stat is not null").groupBy("signature").agg(F.sum("lrt_stat").alias("statistic"), F.count(F.lit(1)).alias("n_samples"))

    def work(batches):
        for pdf in batches:
            yield pdf.assign(p=[N.pooled_presence(s, int(n)) for s, n in zip(pdf["statistic"], pdf["n_samples"])])

    return sums.mapInPandas(work, "signature string, statistic double, n_samples long, p double")


def calibration(spark, w: np.ndarray, totals: list[int], shares: list[float], replicates: int = 30, n_boot: int = 50, seed: int = 1, window: tuple[float, float] = (0.930, 0.970)) -> DataFrame:
    """(n, share, replicates, covered, coverage, se, tp, fp, fn, inside): bootstrap coverage of a planted exposure."""
    cells = [(n, s, r) for n in totals for s in shares for r in range(replicates)]
    shared = spark.sparkContext.broadcast(w)
    grid = spark.createDataFrame(cells, "n int, share double, replicate int").repartition(min(len(cells), 64), "n", "share", "replicate")

    def work(batches):
        for pdf in batches:
            out = []
            w = shared.value
            for n, s, rep in zip(pdf["n"], pdf["share"], pdf["replicate"]):
                r = np.random.Generator(np.random.PCG64(np.random.SeedSequence([seed, int(n), int(round(s * 1e6)), int(rep)])))
                k = w.shape[1]
                h = np.full(k, n * (1 - s) / max(1, k - 1))
                h[0] = s * n
                p = w @ h
                x = r.multinomial(n, p / p.sum()).astype(float)
                point, _, _ = fit_one(x, w, tests=False)
                draws = np.array([fit_one(r.multinomial(n, x / n).astype(float), w, tests=False)[0] for _ in range(n_boot)])
                low, high = np.percentile(draws, [2.5, 97.5], axis=0)
                gone = (point <= 0) | ((draws > 0).mean(0) < 0.95) | (low / n < 0.01)
                true = h > 0
                out.append((int(n), float(s), bool(low[0] <= h[0] <= high[0]), int((true & ~gone).sum()), int((~true & ~gone).sum()), int((true & gone).sum())))
            yield pd.DataFrame(out, columns=["n", "share", "hit", "tp", "fp", "fn"])

    rows = grid.mapInPandas(work, "n int, share double, hit boolean, tp int, fp int, fn int")
    out = rows.groupBy("n", "share").agg(F.count(F.lit(1)).alias("replicates"), F.count_if("hit").alias("covered"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    p = F.col("covered") / F.col("replicates")
    return out.withColumn("coverage", p).withColumn("se", F.sqrt(p * (1 - p) / F.col("replicates"))).withColumn("inside", p.between(*window))
