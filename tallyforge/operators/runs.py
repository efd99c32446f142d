"""Groups as a stream: rows in order, taken a batch at a time, so that a task
holds what its function keeps of a group and never the group's rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def in_order(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """`rows` with each group in one partition, sorted by `order` with nulls last; `parts` is for groups that take long, which would be put together by their bytes."""
    return rows.repartition(*([parts] if parts else []), *keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])


def pieces(batches, keys: list[str]):
    """(begins, rows of one group) of sorted batches, in order; a group can have several pieces."""
    last = None
    for pdf in batches:
        if not len(pdf):
            continue
        codes = [pd.factorize(pdf[k])[0] for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in codes])) + 1
        ends = [0, *cuts.tolist(), len(pdf)]
        for a, b in zip(ends, ends[1:]):
            key = tuple(None if pd.isna(v) else v for v in pdf[keys].iloc[a])
            yield key != last, pdf.iloc[a:b]
            last = key
