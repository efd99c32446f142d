"""Helpers that carry a frame's own columns through Arrow functions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm._text import slices
from tallyforge.operators.graph import written  # noqa: F401  the operators' lineage cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most, which bounds the buffers on both sides of the
#: pipe to a Python worker; texts have a few kilobytes on average.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows for an Arrow batch to BATCH_ROWS; a lower setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def appended(df: DataFrame, make, fields: str, size: int = 1 << 23) -> DataFrame:
    """`df` plus result columns made batch by batch on the executors.

    `make()` runs once per task and returns a function from a record batch to
    the list of result arrays in the order of `fields` (a DDL string).  An
    input column whose name equals a result's (letter case aside) gives way to
    the result.  Batches are cut to about `size` bytes first.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    kept = [f for f in df.schema.fields if f.name.lower() not in taken]
    names = [f.name for f in kept]
    schema = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in kept] + list(new))

    def run(batches):
        work = make()
        for batch in slices(batches, size=size):
            own = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays(own + work(batch), names + [f.name for f in new])

    return df.mapInArrow(run, schema)


def blocks_for(total: int, size: int) -> int:
    return max(1, -(-int(total) // size))


#: Quantiles of the ids that cells() cuts at.
CUTS = 1024


def _literal(values) -> Column:
    """A constant array of longs, quick to parse."""
    return F.split(F.lit(",".join(str(int(x)) for x in values)), ",").cast("array<bigint>")


def cells(rows: DataFrame, size: int, most: int = 1 << 40, name: str = "cell") -> tuple[DataFrame, int, bool]:
    """(rows with their cell, cells, split): a number from 0, ascending with doc_id, for parts of about `size` bytes of text.

    There are about `most` cells at most; their size grows beyond.  Ids are cut
    at CUTS quantiles.  Small neighbours share a cell, and a part of several
    sizes is cut again at equal widths, so sparse or clustered ids and long
    texts are dealt out evenly.  An id with several sizes of its own is split
    by a hash of `text`, ascending too.  Null ids have the first cells, by that
    hash.  `split` tells that a cell can begin inside an id.  Reads the rows
    twice: quantiles of the ids, then bytes by quantile.
    """
    share = (F.xxhash64("text").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / CUTS for i in range(CUTS + 1)], 10 * CUTS)).first()[0]
    low = sorted({int(x) for x in cuts or []})
    count = len(low)
    if low:
        bits = max(1, (count - 1).bit_length())
        lows = _literal(low)

        def halve(k, jump):
            return F.when((k + jump < count) & (F.col("doc_id") >= F.element_at(lows, k + jump + 1)), k + jump).otherwise(k)

        part = F.aggregate(F.array(*[F.lit(1 << (bits - 1 - j)) for j in range(bits)]), F.lit(0), halve)
        rows = rows.withColumn("__part", F.when(F.col("doc_id").isNotNull(), part))
        own = F.col("doc_id") == F.element_at(lows, F.col("__part") + 1)
    else:
        rows, own = rows.withColumn("__part", F.lit(None).cast("int")), F.lit(None).cast("boolean")
    found = rows.groupBy("__part", own.alias("own")).agg(F.sum(F.octet_length("text") + F.lit(64)).alias("bytes")).collect()
    size = max(size, -(-sum(r["bytes"] for r in found) // most))
    held = {(r["__part"], r["own"]): r["bytes"] for r in found}
    here, filled, split = 0, None, False
    start, wide = {}, {}
    for item in [(None, None), *((k, mine) for k in range(count) for mine in (True, False))]:
        b = held.get(item, 0)
        if filled is not None and (filled + b > size or item == (0, True)):
            here, filled = here + 1, None
        n = max(1, -(-b // size))
        start[item], wide[item] = here, n
        filled = (filled or 0) + b if n == 1 and b else filled
        if n > 1:
            here, filled, split = here + n, None, split or item[1] is not False
    total = max(1, here + (filled is not None))
    cell = F.floor(share * F.lit(wide[(None, None)]))
    if low:
        every = range(count)
        pick = lambda values: F.element_at(_literal(values), F.col("__part") + 1)
        width = [max(1, -(-(b - a) // wide[(k, False)])) for k, (a, b) in enumerate(zip(low, [*low[1:], low[-1] + 1]))]
        inside = F.floor((F.col("doc_id").cast("double") - pick(low).cast("double")) / pick([min(w, 2**63 - 1) for w in width]).cast("double"))
        other = pick([start[(k, False)] for k in every]) + F.least(pick([wide[(k, False)] for k in every]) - 1, F.greatest(F.lit(0), inside))
        same = pick([start[(k, True)] for k in every]) + F.floor(share * pick([wide[(k, True)] for k in every]))
        cell = F.when(F.col("doc_id").isNull(), cell).when(own, same).otherwise(other)
    # an item without rows may have a cell past the last
    return rows.withColumn(name, F.least(F.lit(total - 1), cell).cast("bigint")).drop("__part"), total, split
