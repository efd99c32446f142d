"""Matrix files: wide TSV in and out, and the reference store."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.channels import TABLES
from tallyforge.model import EngineError

HEADS = {"cosmic": "Type", "sigprofiler": "MutationType"}


def read_matrix(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """(channel, channel_ord, name, value) of a wide TSV whose first column holds the channels in canonical order."""
    wide = spark.read.csv(path, sep="\t", header=True, inferSchema=False)
    head = wide.columns[0]
    if head not in HEADS.values():
        raise EngineError("parse", f"first column {head} is neither of {sorted(HEADS.values())}")
    labels = [r[0] for r in wide.select(head).collect()]  # one for each channel
    if len(set(labels)) != len(labels):
        raise EngineError("parse", "channels aren't unique")
    kinds = [k for k, f in TABLES.items() if set(f()) == set(labels)]
    if table and table not in kinds:
        raise EngineError("parse", f"the channels aren't those of {table}")
    order = {c: i for i, c in enumerate(TABLES[kinds[0]]() if kinds else labels)}
    if kinds and [order[x] for x in labels] != list(range(len(labels))):
        raise EngineError("parse", "channels aren't in canonical order")
    places = F.broadcast(spark.createDataFrame(list(order.items()), "channel string, channel_ord int"))
    return long(wide.withColumnRenamed(head, "channel"), "channel").join(places, "channel").select("channel", "channel_ord", "name", "value")


def long(wide: DataFrame, key: str) -> DataFrame:
    names = [c for c in wide.columns if c != key]
    typed = wide.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return typed.unpivot([key], names, "name", "value")


def write_matrix(values: DataFrame, path: str | None, format: str = "cosmic", names: list[str] | None = None) -> DataFrame:
    """Wide frame of (channel, channel_ord, name, value), 17 significant digits when written."""
    head = HEADS.get(format)
    if head is None:
        raise EngineError("argument", f"unknown format {format}")
    names = names or [r[0] for r in values.select("name").distinct().orderBy("name").collect()]
    if head in names:
        raise EngineError("catalog", f"a column is named {head}")
    wide = values.groupBy("channel_ord", "channel").pivot("name", names).agg(F.first("value")).orderBy("channel_ord").drop("channel_ord").withColumnRenamed("channel", head)
    if path:
        wide.select(head, *[F.format_string("%.17g", F.col(f"`{n}`")).alias(n) for n in names]).coalesce(1).write.csv(path, sep="\t", header=True, mode="overwrite")
    return wide


def verified(spark: SparkSession, folder: str, version: str, build: str | None = None) -> DataFrame:
    """A reference set of `folder`: manifest.json names each version's parquet and the sha256 of its
    sorted rows; an unknown version or a wrong digest is refused; a set without builds fits any."""
    manifest = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/manifest.json").collect()))
    if version not in manifest:
        raise EngineError("refdb", f"unknown version {version}", hint=", ".join(sorted(manifest)))
    df = spark.read.parquet(f"{folder}/{manifest[version]['path']}")
    if digest(df) != manifest[version]["sha256"]:
        raise EngineError("refdb", "the set's digest isn't the manifest's")
    return df.where((F.col("build") == build) | F.col("build").isNull()) if build and "build" in df.columns else df


def digest(df: DataFrame) -> str:
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h")).orderBy("h").collect()  # a reference set is a few thousand rows
    return hashlib.sha256("".join(r.h for r in rows).encode()).hexdigest()


def currency_verdict(registry: DataFrame, cache: DataFrame) -> DataFrame:
    """(name, verdict) of documents: inconsistent, corrupt, no-cache, drift, behind or ok, the first that holds."""
    both = registry.join(cache, "name", "left")
    verdict = (
        F.when(F.col("version").isNull() | F.col("digest").isNull(), "inconsistent").when(F.col("cached_bytes_ok") == F.lit(False), "corrupt").when(F.col("cached_digest").isNull(), "no-cache")
        .when(F.col("cached_digest") != F.col("digest"), "drift").when(F.col("latest") > F.col("version"), "behind").otherwise("ok")
    )
    return both.select("name", verdict.alias("verdict"))
