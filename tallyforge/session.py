"""Session helpers: a builder with this library's settings, and shipping the library to executors."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession


def session(name: str = "tallyforge", master: str | None = None, **conf) -> SparkSession:
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once for each context, unless it stands on
    PYTHONPATH, which executors share with the driver."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_tallyforge", False):
        return
    target = Path(mkdtemp()) / "tallyforge.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "tallyforge").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.sparkContext._tallyforge = True
