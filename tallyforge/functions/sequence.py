"""Classifiers of single records as Column expressions; all run in codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions import channels as C


def reverse_complement(s: Column) -> Column:
    return F.translate(F.reverse(s), "ACGT", "TGCA")


def base_index(b: Column) -> Column:
    return F.instr(F.lit(C.BASES), b) - 1


def _folded(context: Column, alt: Column) -> tuple[Column, Column]:
    """(context, alt) with a pyrimidine centre."""
    middle = F.substring(context, F.floor(F.length(context) / 2).cast("int") + 1, F.lit(1))
    purine = middle.isin("A", "G")
    return F.when(purine, reverse_complement(context)).otherwise(context), F.when(purine, reverse_complement(alt)).otherwise(alt)


def sbs96(trinucleotide: Column, alt: Column) -> Column:
    """Label such as A[C>T]G; null if a base isn't A, C, G or T or nothing changes."""
    c, a = _folded(trinucleotide, alt)
    good = trinucleotide.rlike(r"^[ACGT]{3}\z") & alt.rlike(r"^[ACGT]\z") & (F.substring(trinucleotide, 2, 1) != alt)
    return F.when(good, F.concat(F.substring(c, 1, 1), F.lit("["), F.substring(c, 2, 1), F.lit(">"), a, F.lit("]"), F.substring(c, 3, 1)))


def sbs96_index(trinucleotide: Column, alt: Column) -> Column:
    c, a = _folded(trinucleotide, alt)
    kind = F.array_position(F.array(*[F.lit(s) for s in C.SUBSTITUTIONS]), F.concat(F.substring(c, 2, 1), F.lit(">"), a)) - 1
    return F.when(sbs96(trinucleotide, alt).isNotNull(), base_index(F.substring(c, 1, 1)) * 24 + kind * 4 + base_index(F.substring(c, 3, 1)))


def _flipped(trinucleotide: Column, strand: Column) -> Column:
    purine = F.substring(trinucleotide, 2, 1).isin("A", "G")
    return F.when(purine, F.translate(strand, "TU", "UT")).otherwise(strand)


def sbs192(trinucleotide: Column, alt: Column, strand: Column) -> Column:
    """T and U strands only; null for others."""
    return F.when(strand.isin("T", "U"), F.concat(_flipped(trinucleotide, strand), F.lit(":"), sbs96(trinucleotide, alt)))


def sbs384(trinucleotide: Column, alt: Column, strand: Column) -> Column:
    return F.when(strand.isin(*C.STRANDS), F.concat(_flipped(trinucleotide, strand), F.lit(":"), sbs96(trinucleotide, alt)))


def sbs1536(pentanucleotide: Column, alt: Column) -> Column:
    c, a = _folded(pentanucleotide, alt)
    good = pentanucleotide.rlike(r"^[ACGT]{5}\z") & alt.rlike(r"^[ACGT]\z") & (F.substring(pentanucleotide, 3, 1) != alt)
    return F.when(good, F.concat(F.substring(c, 1, 2), F.lit("["), F.substring(c, 3, 1), F.lit(">"), a, F.lit("]"), F.substring(c, 4, 2)))


def skip_reason(ref: Column, alt: Column) -> Column:
    """Why a record can't be classified, or null."""
    return (
        F.when((F.length(ref) == 0) | (F.length(alt) == 0), "empty_allele").when(~ref.rlike(r"^[ACGT]+\z") | ~alt.rlike(r"^[ACGT]+\z"), "invalid_base").when(ref == alt, "ref_equals_alt")
    )


def ambiguous_strand(seq: Column, pyrimidine: bool = True) -> Column:
    """Whether exactly half of the bases are pyrimidines, or the other way round."""
    return F.length(F.regexp_replace(seq, "[AG]" if pyrimidine else "[CT]", "")) * 2 == F.length(seq)


def cn48(minor: Column, major: Column, length: Column) -> Column:
    total = minor + major
    size = F.when(length <= 100_000, "0-100kb").when(length <= 1_000_000, "100kb-1Mb").when(length <= 10_000_000, "1Mb-10Mb").when(length <= 40_000_000, "10Mb-40Mb").otherwise(">40Mb")
    short = F.when(length <= 100_000, "0-100kb").when(length <= 1_000_000, "100kb-1Mb").otherwise(">1Mb")
    band = F.when(total <= 1, "1").when(total == 2, "2").when(total <= 4, "3-4").when(total <= 8, "5-8").otherwise("9+")
    return F.when(minor <= major, F.when(total == 0, F.concat(F.lit("0:homdel:"), short)).when(minor == 0, F.concat(band, F.lit(":LOH:"), size)).otherwise(F.concat(band, F.lit(":het:"), size)))


def sv32(kind: Column, size: Column, clustered: Column) -> Column:
    """Null for a record under 1000 bases that is no translocation."""
    half = F.when(clustered, "clustered").otherwise("non-clustered")
    bin_ = F.when(size <= 10_000, "1-10Kb").when(size <= 100_000, "10-100Kb").when(size <= 1_000_000, "100Kb-1Mb").when(size <= 10_000_000, "1Mb-10Mb").otherwise(">10Mb")
    short = F.when(kind == "deletion", "del").when(kind == "tandem-duplication", "tds").when(kind == "inversion", "inv")
    return F.when(kind == "translocation", F.concat(half, F.lit("_trans"))).when(size >= 1000, F.concat(half, F.lit("_"), short, F.lit("_"), bin_))
