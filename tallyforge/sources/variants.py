"""Variant readers: VCF, TSV and MAF lines to the canonical variant frame with a skip ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.model import EngineError

FORMATS = {".vcf": "vcf", ".tsv": "tsv", ".txt": "tsv", ".maf": "maf"}
#: Classes of a MAF that are left out; any other class, and a null one, stays.
MAF_EXCLUDED = (
    "Frame_Shift_Del", "Frame_Shift_Ins", "In_Frame_Del", "In_Frame_Ins", "De_novo_Start_InFrame", "De_novo_Start_OutOfFrame", "Structural_Variation", "Silent", "Splice_Site",
)


def format_of(path: str, forced: str | None = None) -> tuple[str, bool]:
    """(format, gzipped) by extension; BCF is refused."""
    plain = path.lower()
    zipped = plain.endswith(".gz")
    plain = plain[:-3] if zipped else plain
    if plain.endswith(".bcf"):
        raise EngineError("io", "BCF isn't read", hint="convert it to VCF")
    if forced:
        if forced not in FORMATS.values():
            raise EngineError("argument", f"unknown format {forced}")
        return forced, zipped
    for end, name in FORMATS.items():
        if plain.endswith(end):
            return name, zipped
    raise EngineError("io", f"no format is known for {path}")


def allele_reason(ref: Column, alt: Column) -> Column:
    return (
        F.when(alt.isNull() | alt.isin("", "."), "missing_alt").when(alt == "*", "spanning_star").when(alt.startswith("<") | alt.rlike(r"[\[\]]"), "symbolic_alt")
        .when(~ref.rlike(r"^[ACGTN]+\z"), "invalid_ref").when(~alt.rlike(r"^[ACGTN]+\z"), "invalid_alt")
    )


def parse_vcf(lines: DataFrame, column: str = "value") -> DataFrame:
    """(chrom, start, end, ref, alt, filter, site, allele, reason) from VCF body lines.

    Header lines start with #.  One row for each alternative allele; reason
    tells why a row can't be used, null if it can.
    """
    body = lines.where(~F.col(column).startswith("#") & (F.length(F.trim(column)) > 0))
    p = F.split(column, "\t")
    at = lambda i: F.try_element_at(p, F.lit(i))
    rows = body.select(at(1).alias("chrom"), at(2).alias("pos"), F.upper(at(4)).alias("ref"), F.upper(at(5)).alias("alts"), at(7).alias("filter"))
    rows = rows.select("chrom", F.expr("try_cast(pos as bigint)").alias("start"), "ref", "filter", F.size(F.split("alts", ",")).alias("site"), F.posexplode(F.split("alts", ",")).alias("allele", "alt"))
    reason = F.coalesce(F.when(F.col("start").isNull(), "invalid_pos"), allele_reason(F.col("ref"), F.col("alt")))
    return rows.select("chrom", "start", (F.col("start") + F.length("ref") - 1).alias("end"), "ref", "alt", "filter", "site", "allele", reason.alias("reason"))


def parse_table(rows: DataFrame, chrom: str = "chrom", pos: str = "pos", ref: str = "ref", alt: str = "alt", end: str | None = None, kind: str | None = None) -> DataFrame:
    """(chrom, start, end, ref, alt, reason) from a TSV or MAF frame of strings; `kind` is a MAF's class column."""
    r, a = F.upper(F.col(ref)), F.upper(F.col(alt))
    start = F.expr(f"try_cast(`{pos}` as bigint)")
    last = F.coalesce(F.expr(f"try_cast(`{end}` as bigint)"), start + F.length(r) - 1) if end else start + F.length(r) - 1
    reason = F.when(start.isNull(), "invalid_pos").when(~r.rlike(r"^[ACGTN]+\z") | ~a.rlike(r"^[ACGTN]+\z"), "unusable_allele").when(last - start + 1 != F.length(r), "length_mismatch")
    if kind:
        reason = F.when(F.col(kind).isin(*MAF_EXCLUDED), "classification").otherwise(reason)
    return rows.select(F.col(chrom).alias("chrom"), start.alias("start"), last.alias("end"), r.alias("ref"), a.alias("alt"), reason.alias("reason"))


def parse_statistics(parsed: DataFrame) -> DataFrame:
    """(reason, n): `ok` for usable rows."""
    return parsed.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def read_variants(spark: SparkSession, path: str, format: str | None = None, **columns) -> DataFrame:
    """Usable variants of a file; .gz is decompressed by the reader."""
    kind, _ = format_of(path, format)
    if kind == "vcf":
        parsed = parse_vcf(spark.read.text(path))
    else:
        table = spark.read.csv(path, sep="\t", header=True, comment="#", inferSchema=False)
        maf = {"chrom": "Chromosome", "pos": "Start_Position", "end": "End_Position", "ref": "Reference_Allele", "alt": "Tumor_Seq_Allele2", "kind": "Variant_Classification"} if kind == "maf" else {}
        parsed = parse_table(table, **(maf | columns))
    return parsed.where("reason is null").select("chrom", "start", "end", "ref", "alt")
