"""Copy-number segments of eight callers and structural variants (BEDPE)."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.model import EngineError
from tallyforge.operators import numerics as N
from tallyforge.operators import runs

#: Columns by which a caller's table is known; the first caller that fits is taken.
SIGNATURES = {
    "PURPLE": ("chromosome", "start", "end", "minorAlleleCopyNumber", "majorAlleleCopyNumber"),
    "BATTENBERG": ("chr", "startpos", "endpos", "nMaj1_A", "nMin1_A", "frac1_A"),
    "FACETS": ("chrom", "start", "end", "tcn.em", "lcn.em"),
    "SEQUENZA": ("chromosome", "start.pos", "end.pos", "A", "B", "CNt"),
    "ABSOLUTE": ("Chromosome", "Start", "End", "Modal_HSCN_1", "Modal_HSCN_2"),
    "ASCAT_NGS": ("Chromosome", "Start Position", "End Position", "Tumour TCN", "Tumour BCN"),
    "ASCAT": ("chr", "startpos", "endpos", "nMajor", "nMinor"),
    "PCAWG": ("chromosome", "chromosome_start", "chromosome_end", "copy_number", "mutation_type"),
}
#: PCAWG's types that have lost an allele, and those that have both.
PCAWG_LOST, PCAWG_BOTH = ("copy neutral LOH", "amp LOH", "hemizygous del LOH"), ("copy neutral", "gain")


def caller_of(columns: list[str]) -> str:
    have = set(columns)
    for name, wanted in SIGNATURES.items():
        if have.issuperset(wanted):
            return name
    raise EngineError("input", "the columns are no known caller's", columns=columns)


def canonical(table: DataFrame, caller: str = "auto", chrom: str | None = None) -> DataFrame:
    """(sample, chrom, start, end, minor, major, reason) of a caller's table.

    `sample` is taken if there is one.  Battenberg's subclonal states become
    rows of their own.  reason tells why a row breaks the segment rules.
    """
    caller = caller_of(table.columns) if caller == "auto" else caller
    if caller not in SIGNATURES:
        raise EngineError("argument", f"unknown caller {caller}")
    names = SIGNATURES[caller]
    c = lambda n: F.col(f"`{n}`")
    num = lambda n: F.expr(f"try_cast(`{n}` as int)")
    sample = c("sample").cast("string") if "sample" in table.columns else F.lit("sample")
    where = [sample.alias("sample"), c(chrom or names[0]).cast("string").alias("chrom"), F.expr(f"try_cast(`{names[1]}` as bigint)").alias("start"), F.expr(f"try_cast(`{names[2]}` as bigint)").alias("end")]
    bad = F.lit(None).cast("string")
    if caller == "ASCAT":
        major, minor = num("nMajor"), num("nMinor")
    elif caller == "PCAWG":
        total, kind = num("copy_number"), F.coalesce(F.trim("mutation_type"), F.lit(""))
        lost, loss, both = kind.isin(*PCAWG_LOST), kind == "loss", kind.isin(*PCAWG_BOTH)
        minor = F.when(lost | (loss & total.isin(0, 1)), 0).when(both, 1)
        major = F.when(lost | (loss & total.isin(0, 1)), total).when(both, total - 1)
        bad = F.when(~(lost | loss | both), "unsupported_type").when((lost & (total == 0)) | (both & (total < 2)) | (loss & (total >= 2)), "type_total_mismatch")
    elif caller == "ASCAT_NGS":
        # least() passes over nulls, but a missing allele leaves both unknown
        minor = F.when(num("Tumour TCN").isNotNull() & num("Tumour BCN").isNotNull(), F.least(num("Tumour TCN") - num("Tumour BCN"), num("Tumour BCN")))
        major = num("Tumour TCN") - minor
    elif caller == "ABSOLUTE":
        major, minor = F.greatest(num("Modal_HSCN_1"), num("Modal_HSCN_2")), F.least(num("Modal_HSCN_1"), num("Modal_HSCN_2"))
    elif caller == "FACETS":
        minor = F.coalesce(num("lcn.em"), F.lit(0))
        major = num("tcn.em") - minor
    elif caller == "PURPLE":
        major, minor = F.round(F.expr("try_cast(majorAlleleCopyNumber as double)")).cast("int"), F.round(F.expr("try_cast(minorAlleleCopyNumber as double)")).cast("int")
    elif caller == "SEQUENZA":
        major, minor = F.greatest(num("A"), num("B")), F.least(num("A"), num("B"))
        bad = F.when(num("A") + num("B") != num("CNt"), "total_mismatch")
    else:
        second = "nMaj2_A" in table.columns and "nMin2_A" in table.columns
        first = table.select(*where, F.least(num("nMin1_A"), num("nMaj1_A")).alias("minor"), F.greatest(num("nMin1_A"), num("nMaj1_A")).alias("major"), bad.alias("bad"))
        if second:
            more = table.where(num("nMaj2_A").isNotNull()).select(*where, F.least(num("nMin2_A"), num("nMaj2_A")).alias("minor"), F.greatest(num("nMin2_A"), num("nMaj2_A")).alias("major"), bad.alias("bad"))
            first = first.unionByName(more)
        return _judged(first)
    return _judged(table.select(*where, minor.alias("minor"), major.alias("major"), bad.alias("bad")))


def _judged(rows: DataFrame) -> DataFrame:
    reason = (
        F.when(F.col("start").isNull() | F.col("end").isNull(), "missing_position").when(F.col("end") < F.col("start"), "negative_length").when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("minor").isNull() | F.col("major").isNull(), "missing_copy_number").when((F.col("minor") < 0) | (F.col("major") < 0), "negative_copy_number")
        .when(F.col("minor") > F.col("major"), "order")
    )
    return rows.withColumn("reason", reason).drop("bad")


def structural(table: DataFrame) -> DataFrame:
    """(sample, chrom1, start1, chrom2, start2, svtype, size_bp, reason) of a BEDPE frame.

    svclass is taken if there; else different chromosomes are a translocation,
    and strands ++, -- and mixed a deletion, a tandem duplication and an
    inversion.  Others than translocations under 1000 bases are `too_short`.
    """
    sample = F.col("sample").cast("string") if "sample" in table.columns else F.lit("sample")
    size = F.abs(F.col("start1") - F.col("start2"))
    derived = F.when(F.col("chrom1") != F.col("chrom2"), "translocation")
    kind = F.col("svclass") if "svclass" in table.columns else derived.when((F.col("strand1") == "+") & (F.col("strand2") == "+"), "deletion").when((F.col("strand1") == "-") & (F.col("strand2") == "-"), "tandem-duplication").otherwise("inversion")
    known = kind.isin("deletion", "tandem-duplication", "inversion", "translocation")
    reason = F.when(~known, "unknown_class").when((kind != "translocation") & (size < 1000), "too_short")
    return table.select(sample.alias("sample"), "chrom1", "start1", "chrom2", "start2", kind.alias("svtype"), size.alias("size_bp"), reason.alias("reason"))


def breakpoint_gaps(points: DataFrame, keys: list[str]) -> DataFrame:
    """Adds gap: distance to the breakpoint before, the first one's from 0; 0 counts as 1."""
    w = Window.partitionBy(*keys).orderBy("pos", "row")
    return points.withColumn("gap", F.greatest(F.col("pos") - F.lag("pos", 1, 0).over(w), F.lit(1)))


def hot_segments(gap: np.ndarray, kmin: int = 10) -> list[tuple[int, int]]:
    """(first, end) of the segments of at least `kmin` gaps whose mean is a tenth of all gaps'."""
    y = np.log10(gap)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(y, 12), 25)
    smooth = np.concatenate([np.median(windows[i : i + 65_536], axis=1) for i in range(0, len(y), 65_536)])
    mad, mean, out, a = np.median(np.abs(y - smooth)), gap.mean(), [], 0
    for e in N.piecewise(y, kmin, 25 * max(mad, 1e-9)):
        if e - a >= kmin and 10 ** y[a:e].mean() * 10 <= mean:
            out.append((a, e))
        a = e
    return out


def clustered(points: DataFrame, keys: list[str], kmin: int = 10) -> DataFrame:
    """Adds hot: breakpoints in segments of at least `kmin` whose mean gap is a tenth of the group's.

    A group is one sample's chromosome; a task reads its gaps in order and holds
    those numbers alone.  The hot segments are joined to the breakpoints by
    their places.
    """
    gaps = breakpoint_gaps(points, keys).withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "row")))
    slim = runs.in_order(gaps.select(*keys, "__i", F.col("gap").cast("double").alias("gap")), keys, ["__i"])
    names = [f.name for f in slim.schema.fields if f.name in keys]
    schema = T.StructType([*[f for f in slim.schema.fields if f.name in keys], T.StructField("first", T.LongType()), T.StructField("end", T.LongType())])

    def work(batches):
        head, held = None, []

        def found():
            spans = hot_segments(np.concatenate(held), kmin) if held else []
            if spans:
                out = pd.concat([head] * len(spans), ignore_index=True)
                yield out.assign(first=[a + 1 for a, _ in spans], end=[e for _, e in spans])

        for begins, pdf in runs.pieces(batches, keys):
            if begins:
                yield from found()
                head, held = pdf[names].iloc[:1], []
            held.append(pdf["gap"].to_numpy(float))
        yield from found()

    spans = slim.mapInPandas(work, schema)
    hot = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], F.explode(F.sequence("first", "end")).alias("__at"))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], F.col("__i") == F.col("__at"))
    return gaps.join(hot, same, "left").withColumn("hot", F.col("__at").isNotNull()).drop("__i", "__at", *[f"__{k}" for k in keys])
