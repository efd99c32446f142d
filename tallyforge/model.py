"""Data model: schemas, validated containers and the typed error."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VARIANTS = "chrom string, start bigint, end bigint, ref string, alt string"
CATALOG = "sample string, sample_ord int, channel string, channel_ord int, count double"


class EngineError(ValueError):
    """A failure with a topic and its facts."""

    def __init__(self, topic: str, detail: str, hint: str = "", **info):
        super().__init__(f"[{topic}] {detail}" + (f" ({hint})" if hint else ""))
        self.topic, self.detail, self.hint, self.info = topic, detail, hint, info


def require(df: DataFrame, topic: str, **rules) -> DataFrame:
    """Raises for the first rule (name -> condition that must hold) that a row breaks; one pass over `df`."""
    names = list(rules)
    counts = df.agg(*[F.count_if(~F.coalesce(rules[n], F.lit(False))).alias(n) for n in names]).first()
    for n in names:
        if counts[n]:
            raise EngineError(topic, f"{counts[n]} rows break the rule {n}", rule=n, rows=counts[n])
    return df


def validate_variants(df: DataFrame) -> DataFrame:
    rules = {
        "no_null": F.col("chrom").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("ref").isNotNull() & F.col("alt").isNotNull(),
        "coordinates": (F.col("start") >= 1) & (F.col("end") >= F.col("start")), "ref_alphabet": F.col("ref").rlike(r"^[ACGTN]+\z"), "alt_alphabet": F.col("alt").rlike(r"^[ACGTN]+\z"),
    }
    if "vaf" in df.columns:
        rules["vaf_range"] = F.col("vaf").isNull() | F.col("vaf").between(0, 1)
    if "strand" in df.columns:
        rules["strand"] = F.col("strand").isNull() | F.col("strand").isin("T", "U", "B", "N")
    return require(df, "input", **rules)


def validate_catalog(df: DataFrame) -> DataFrame:
    """Finite, non-negative counts and one row for each sample and channel."""
    require(df, "catalog", finite=~F.isnan("count") & F.col("count").isNotNull() & (F.abs("count") < float("inf")), not_negative=F.col("count") >= 0)
    if df.groupBy("sample", "channel").count().where("count > 1").limit(1).count():
        raise EngineError("catalog", "a channel occurs twice in a sample")
    return df


def label_hash(labels) -> str:
    return hashlib.md5("\n".join(labels).encode()).hexdigest()


@dataclass(frozen=True)
class Catalog:
    """A long count matrix with its channel snapshot."""

    counts: DataFrame
    channels: tuple[str, ...]
    name: str = "custom"
    provenance: dict = field(default_factory=dict)

    def __post_init__(self):
        if len(set(self.channels)) != len(self.channels):
            raise EngineError("catalog", "channel labels aren't unique")

    @property
    def hash(self) -> str:
        return label_hash(self.channels)

    def validate(self) -> Catalog:
        validate_catalog(self.counts)
        other = self.counts.where(~F.col("channel").isin(list(self.channels))).limit(1).count()
        if other:
            raise EngineError("catalog", "a row's channel isn't in the channel table")
        return self


@dataclass(frozen=True)
class Signatures:
    """Signature shares (signature, channel, value) with exposures and evidence."""

    values: DataFrame
    exposures: DataFrame | None = None
    evidence: DataFrame | None = None
    engine: str = ""
    seed: int = 0

    def validate(self) -> Signatures:
        require(self.values, "signature", not_negative=F.col("value") >= 0)
        return self


@dataclass(frozen=True)
class Fit:
    """(signature, sample, exposure, share, active, lrt_stat, lrt_p, se)."""

    rows: DataFrame

    def validate(self) -> Fit:
        require(self.rows, "fit", not_negative=F.col("exposure") >= 0)
        return self


@dataclass(frozen=True)
class Benchmark:
    """(engine, scenario, metric, estimate) without null estimates."""

    rows: DataFrame

    def validate(self) -> Benchmark:
        require(self.rows, "benchmark", estimate=F.col("estimate").isNotNull())
        return self
