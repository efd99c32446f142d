"""Signature extraction: replicates, ranks and folds run in parallel over a
broadcast catalog; consensus works on channels x (k * replicates) numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.model import EngineError
from tallyforge.operators import numerics as N

#: Cells of a catalog that may be broadcast; beyond, fit a random sample of columns and assign exposures by fit().
MAX_CELLS = 50_000_000


def matrix(catalog: DataFrame, channels: list[str]) -> tuple[list[str], np.ndarray]:
    """(samples, channels x samples) of a long catalog whose size is checked first."""
    n = catalog.select("sample").distinct().count()
    if n * len(channels) > MAX_CELLS:
        raise EngineError("extract", f"{n} samples of {len(channels)} channels are more than {MAX_CELLS} cells", hint="extract from a sample of the columns, then fit() all")
    rows = catalog.groupBy("sample", "channel").agg(F.sum("count").alias("count")).toPandas()
    wide = rows.pivot(index="channel", columns="sample", values="count").reindex(channels).fillna(0.0).sort_index(axis=1)
    return [str(c) for c in wide.columns], wide.to_numpy(float)


def replicated(spark: SparkSession, v: np.ndarray, k: int, replicates: int = 8, rounds: int = 200, seed: int = 1, engine: str = "kl", **options) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(W, H, objective) of each replicate, in order; results are k x (channels + samples) each."""
    shared = spark.sparkContext.broadcast(v)

    def work(batches):
        v = shared.value
        for pdf in batches:
            out = []
            for rep in pdf["id"]:
                w, h = N.starts(v, k, (seed, int(rep), k))
                if engine == "kl":
                    w, h = N.nmf_kl(v, w, h, rounds, **options)
                elif engine == "eu":
                    w, h = N.nmf_eu(v, w, h, rounds)
                elif engine == "ard":
                    w, h, alive = N.nmf_ard(v, w, h, rounds=rounds, **options)
                    w, h = w[:, alive], h[alive]
                elif engine == "volume":
                    w, h = N.nmf_volume(v, w, h, rounds=rounds, **options)
                else:
                    raise EngineError("argument", f"unknown engine {engine}")
                out.append((int(rep), w.shape[1], w.ravel().tolist(), h.ravel().tolist(), N.kl(v, w @ h)))
            yield pd.DataFrame(out, columns=["id", "k", "w", "h", "objective"])

    jobs = spark.range(replicates).repartition(replicates, "id")
    rows = jobs.mapInPandas(work, "id long, k long, w array<double>, h array<double>, objective double").collect()
    rows.sort(key=lambda r: r["id"])
    return [(np.array(r["w"]).reshape(-1, r["k"]), np.array(r["h"]).reshape(r["k"], -1), r["objective"]) for r in rows]


def cross_validated(spark: SparkSession, v: np.ndarray, ranks: list[int], folds: int = 5, seeds: int = 3, seed: int = 1) -> DataFrame:
    """(k, deviance): of each fold the seed with the least train error, summed over folds."""
    shared = spark.sparkContext.broadcast(v)
    grid = spark.createDataFrame([(k, f, s) for k in ranks for f in range(folds) for s in range(seeds)], "k int, fold int, seed int")

    def work(batches):
        for pdf in batches:
            rows = [(int(k), int(f), int(s), *N.masked_cv(shared.value, int(k), int(f), folds, seed * 1000 + int(s))) for k, f, s in zip(pdf["k"], pdf["fold"], pdf["seed"])]
            yield pd.DataFrame(rows, columns=["k", "fold", "seed", "test", "train"])

    done = grid.repartition(min(64, len(ranks) * folds * seeds), "k", "fold", "seed").mapInPandas(work, "k int, fold int, seed int, test double, train double")
    return best_seed(done)


def best_seed(rows: DataFrame) -> DataFrame:
    """(k, deviance) from (k, fold, seed, test, train)."""
    picked = rows.groupBy("k", "fold").agg(F.min_by("test", F.struct("train", "seed")).alias("test"))
    return picked.groupBy("k").agg(F.sum("test").alias("deviance"))


def arbitrated(evidence: DataFrame) -> DataFrame:
    """Adds vetoed and selected to (k, deviance, avg_stability, min_stability): of the
    ranks that are stable enough, the one of least deviance, the lowest first."""
    stable = (F.col("avg_stability") >= 0.8) & (F.col("min_stability") >= 0.2) & (F.col("avg_stability") + F.col("min_stability") >= 1.0)
    best = evidence.where(stable).agg(F.min_by("k", F.struct("deviance", "k")).alias("best"))
    return evidence.crossJoin(F.broadcast(best)).withColumn("vetoed", ~stable).withColumn("selected", F.coalesce(F.col("k") == F.col("best"), F.lit(False))).drop("best")


def extracted(spark: SparkSession, v: np.ndarray, k: int, replicates: int = 8, rounds: int = 200, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signatures, exposures, stability): replicates, consensus and a refit by non-negative least squares."""
    solutions = [w / w.sum(0) for w, _, _ in replicated(spark, v, k, replicates, rounds, seed)]
    centre, stability = N.consensus(solutions, seed)
    w = centre / centre.sum(0)
    g = w.T @ w
    return w, np.stack([N.nnls(g, w.T @ v[:, j]) for j in range(v.shape[1])], 1), stability


def selected_rank(spark: SparkSession, v: np.ndarray, ranks: list[int], **options) -> DataFrame:
    """Evidence for each rank with the chosen one."""
    rows = []
    for k in ranks:
        _, s = N.consensus([w / w.sum(0) for w, _, _ in replicated(spark, v, k, options.get("replicates", 6), 100)], 1)
        rows.append((k, float(s.mean()), float(s.min())))
    stability = spark.createDataFrame(rows, "k int, avg_stability double, min_stability double")
    return arbitrated(cross_validated(spark, v, ranks).join(stability, "k"))
