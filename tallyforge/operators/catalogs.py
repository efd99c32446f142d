"""From variant records and a genome to a catalog in one call.

Records are routed, put in their context, classified and counted; each record's
fate is kept for the ledger.  Indels are classified by string comparisons on a
window of the genome, so everything after the routing is Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import channels as C
from tallyforge.functions import sequence as S
from tallyforge.model import EngineError
from tallyforge.operators import routing, tally
from tallyforge.sources import genome

MODES = ("SBS96", "SBS192", "SBS384", "SBS1536", "DBS78", "ID83")
#: Copies of an indel's unit beside it that a channel tells apart.
COPIES = 5


def indel_channel(seq: Column, first: Column, total: Column, pos: Column, ref: Column, alt: Column) -> tuple[Column, Column]:
    """(ID83 channel, reason without one) of an anchored indel in a window of the genome.

    `pos` is the anchor's 1-based place, `first` the window's 0-based start.
    Copies of the unit are counted on both sides, up to COPIES each; on the left
    none may start at the chromosome's first base, on the right none may end at
    its last.  Microhomology counts only where no copy is beside the unit.
    """
    deletion = F.length(ref) > F.length(alt)
    unit = F.substring(F.when(deletion, ref).otherwise(alt), F.lit(2), F.lit(1 << 30))
    n, after = F.length(unit), pos + F.when(deletion, F.length(unit)).otherwise(0)

    def bases(start: Column, size: Column) -> Column:
        return F.substring(seq, (start - first + 1).cast("int"), size.cast("int"))

    left = sum((((pos > n * k) & (bases(pos - n * k, n * k) == F.repeat(unit, F.lit(k)))).cast("int") for k in range(1, COPIES + 1)), F.lit(0))
    right = sum((((after + n * k < total) & (bases(after, n * k) == F.repeat(unit, F.lit(k)))).cast("int") for k in range(1, COPIES + 1)), F.lit(0))
    copies = F.least(F.lit(COPIES), left + right)
    sizes = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))))
    forward = F.array_max(F.filter(sizes, lambda i: bases(after, i) == F.substring(unit, F.lit(1), i)))
    backward = F.array_max(F.filter(sizes, lambda i: bases(pos - i, i) == F.substring(unit, n - i + 1, i)))
    shared = F.when((n > 1) & (copies == 0), F.greatest(F.coalesce(forward, F.lit(0)), F.coalesce(backward, F.lit(0)))).otherwise(0)
    kind, size = F.when(deletion, "Del").otherwise("Ins"), F.least(n, F.lit(5)).cast("string")
    single = F.concat(F.lit("1:"), kind, F.lit(":"), F.when(unit.isin("C", "G"), "C").otherwise("T"), F.lit(":"), copies.cast("string"))
    label = (
        F.when(n == 1, single).when(shared == 0, F.concat(size, F.lit(":"), kind, F.lit(":R:"), copies.cast("string")))
        .when(deletion, F.concat(size, F.lit(":Del:M:"), F.least(shared, F.lit(COPIES)).cast("string")))
    )
    # the step that ends the walk to the right reads one more unit, the one to the left may wrap
    outside = seq.isNull() | (pos < 1) | (pos > total) | (after + n * (right + 1) > total) | (n - pos > total)
    reason = F.when(outside, "context_bounds").when(bases(pos - 1, F.lit(1)) != F.substring(ref, 1, 1), "anchor_mismatch").when(label.isNull(), "insertion_microhomology")
    return F.when(reason.isNull(), label), reason


def indels(records: DataFrame, sequences: DataFrame, size: int = genome.BIN) -> DataFrame:
    """`records` (chrom, pos, ref, alt ..) with channel and reason.

    The chunks of the genome overlap by what the longest indel needs, so one
    join by (chrom, bin) finds each window whole.
    """
    longest = records.agg(F.max(F.greatest(F.length("ref"), F.length("alt")))).first()[0] or 1
    chunks = genome.chunked(sequences, size, (COPIES + 2) * longest, wrap=True)
    rows = records.withColumn("bin", F.floor((F.col("pos") - 1) / size).cast("int")).join(chunks, ["chrom", "bin"], "left")
    channel, reason = indel_channel(*[F.col(c) for c in ("seq", "first", "total", "pos", "ref", "alt")])
    return rows.withColumns({"channel": channel, "reason": reason}).drop("bin", "first", "seq", "total")


def _doublets(records: DataFrame) -> DataFrame:
    """One row for each pair of neighbours: `ref` and `alt` of two bases, and the reason of the first that has one."""
    order = Window.partitionBy("sample", "chrom").orderBy("pos", "ref", "alt")
    rows = records.withColumn("pair", F.floor((F.row_number().over(order) - 1) / 2))
    both = F.array_sort(F.collect_list(F.struct("pos", "ref", "alt", "reason")))
    pairs = rows.groupBy("sample", "chrom", "pair").agg(both.alias("b"))
    return pairs.select("sample", *[F.concat(F.col("b")[0][c], F.col("b")[1][c]).alias(c) for c in ("ref", "alt")], F.coalesce(F.col("b")[0]["reason"], F.col("b")[1]["reason"]).alias("reason"))


def tallied(records: DataFrame, sequences: DataFrame, mode: str, size: int = genome.BIN) -> DataFrame:
    """(sample, channel, reason, n_records) of all records of the mode's kind, and of the skipped ones.

    `records` has sample, chrom, pos, ref, alt and, for SBS192 and SBS384, strand
    (T, U, B or N; without it SBS384 takes N and SBS192 is refused).  Checks of
    the context come in the order bounds, other letters in the five bases,
    another base than `ref`.  A doublet fails as a whole, for two records.
    """
    if mode not in MODES:
        raise EngineError("input", f"mode must be one of {', '.join(MODES)}")
    if mode == "SBS192" and "strand" not in records.columns:
        raise EngineError("input", "mode SBS192 needs a strand column")
    strand = F.col("strand") if "strand" in records.columns else F.lit("N")
    rows = routing.routed(records.select("sample", "chrom", "pos", "ref", "alt", strand.alias("strand")), ["sample", "chrom"], ["pos", "ref", "alt"])
    skipped = rows.where(F.col("destination").startswith("skipped:")).select("sample", F.lit(None).cast("string").alias("channel"), F.substring("destination", 9, 100).alias("reason"), F.lit(1).alias("n_records"))
    kind = {"DBS78": "dbs", "ID83": "id83"}.get(mode, "sbs")
    own = rows.where(F.col("destination") == kind).drop("destination")
    if kind == "id83":
        out = indels(own, sequences, size).select("sample", "channel", "reason", F.lit(1).alias("n_records"))
        return out.unionByName(skipped)
    placed = genome.with_context(own.withColumn("start", F.col("pos")), genome.chunked(sequences, size), size=size)
    placed = placed.withColumn("reason", genome.context_reason(F.col("ref"), F.col("context")))
    if kind == "dbs":
        named = C.doublets(records.sparkSession).withColumnsRenamed({"ref2": "ref", "alt2": "alt"})
        out = _doublets(placed).join(F.broadcast(named), ["ref", "alt"], "left").withColumn("n_records", F.lit(2))
    else:
        three, alt, s = F.substring("context", 2, 3), F.col("alt"), F.col("strand")
        channel = {"SBS96": lambda: S.sbs96(three, alt), "SBS192": lambda: S.sbs192(three, alt, s), "SBS384": lambda: S.sbs384(three, alt, s), "SBS1536": lambda: S.sbs1536(F.col("context"), alt)}[mode]()
        out = placed.withColumns({"channel": channel, "n_records": F.lit(1)})
        out = out.withColumn("reason", F.when(F.col("reason").isNull() & F.col("channel").isNull(), "strand").otherwise(F.col("reason")))
    out = out.select("sample", F.when(F.col("reason").isNull(), F.col("channel")).alias("channel"), "reason", "n_records")
    return out.unionByName(skipped)


def catalog(records: DataFrame, sequences: DataFrame, mode: str = "SBS96", size: int = genome.BIN) -> DataFrame:
    """Dense (sample, channel, n): every sample of `records` with every channel of the mode, 0 where nothing was counted."""
    counts = tally.counted(tallied(records, sequences, mode, size))
    return tally.dense(counts, C.frame(records.sparkSession, mode), records).select("sample", "channel", "n")


def fates(records: DataFrame, sequences: DataFrame, mode: str = "SBS96", size: int = genome.BIN) -> DataFrame:
    """(reason, n): records of the mode's kind that were counted (`ok`) and those that were not, with all skipped ones."""
    return tallied(records, sequences, mode, size).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.sum("n_records").alias("n"))
