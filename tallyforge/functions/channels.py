"""Canonical channel tables, built from their arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASES = "ACGT"
SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
STRANDS = "TUBN"


def sbs96() -> list[str]:
    return [f"{a}[{s}]{b}" for a in BASES for s in SUBSTITUTIONS for b in BASES]


def sbs192() -> list[str]:
    return [f"{t}:{c}" for t in "TU" for c in sbs96()]


def sbs384() -> list[str]:
    return [f"{t}:{c}" for t in STRANDS for c in sbs96()]


def sbs1536() -> list[str]:
    return [f"{o}{a}[{s}]{b}{p}" for o in BASES for a in BASES for s in SUBSTITUTIONS for b in BASES for p in BASES]


_PAIR = str.maketrans("ACGT", "TGCA")


def reverse_complement(s: str) -> str:
    return s[::-1].translate(_PAIR)


#: Alternatives kept for doublets that are their own reverse complement; each
#: stands for itself and its reverse complement.
_KEPT = {"AT": ("CA", "CC", "CG", "GA", "GC", "TA"), "CG": ("AT", "GC", "GT", "TA", "TC", "TT"), "GC": ("AA", "AG", "AT", "CA", "CG", "TA"), "TA": ("AT", "CG", "CT", "GC", "GG", "GT")}
_DOUBLETS = ("AC", "AT", "CC", "CG", "CT", "GC", "TA", "TC", "TG", "TT")


def dbs_pairs() -> list[tuple[str, str, str]]:
    """(ref, alt, channel) of all 144 doublet changes with both bases changed."""
    out = []
    for r in (a + b for a in BASES for b in BASES):
        for t in (a + b for a in BASES for b in BASES):
            if t[0] == r[0] or t[1] == r[1]:
                continue
            ref, alt = (r, t) if r in _DOUBLETS else (reverse_complement(r), reverse_complement(t))
            if ref in _KEPT and alt not in _KEPT[ref]:
                alt = reverse_complement(alt)
            out.append((r, t, f"{ref}>{alt}"))
    return out


def dbs78() -> list[str]:
    return sorted({c for _, _, c in dbs_pairs()})


SIZES_CN = ("0-100kb", "100kb-1Mb", "1Mb-10Mb", "10Mb-40Mb", ">40Mb")
TOTALS = ("1", "2", "3-4", "5-8", "9+")
SIZES_SV = ("1-10Kb", "10-100Kb", "100Kb-1Mb", "1Mb-10Mb", ">10Mb")


def cn48() -> list[str]:
    none = ["0:homdel:0-100kb", "0:homdel:100kb-1Mb", "0:homdel:>1Mb"]
    return none + [f"{t}:LOH:{s}" for t in TOTALS for s in SIZES_CN] + [f"{t}:het:{s}" for t in TOTALS[1:] for s in SIZES_CN]


def sv32() -> list[str]:
    return [x for half in ("clustered", "non-clustered") for x in [f"{half}_{k}_{s}" for k in ("del", "tds", "inv") for s in SIZES_SV] + [f"{half}_trans"]]


def id83() -> list[str]:
    out = [f"1:{k}:{b}:{n}" for k in ("Del", "Ins") for b in "CT" for n in range(6)]
    out += [f"{u}:{k}:R:{n}" for k in ("Del", "Ins") for u in range(2, 6) for n in range(6)]
    return out + [f"{u}:Del:M:{n}" for u in range(2, 6) for n in range(1, u if u < 5 else 6)]


TABLES = {"SBS96": sbs96, "SBS192": sbs192, "SBS384": sbs384, "SBS1536": sbs1536, "DBS78": dbs78, "CN48": cn48, "SV32": sv32, "ID83": id83}


def label(table: str, index: int) -> str:
    """Bounds-checked lookup."""
    labels = TABLES[table]()
    if not 0 <= index < len(labels):
        from tallyforge.model import EngineError

        raise EngineError("bounds", f"index {index} is outside the {len(labels)} channels of {table}", i=index + 1, j=len(labels))
    return labels[index]


def frame(spark: SparkSession, table: str) -> DataFrame:
    """(channel_ord, channel): a dimension of at most 1536 rows."""
    return spark.createDataFrame(list(enumerate(TABLES[table]())), "channel_ord int, channel string")


def doublets(spark: SparkSession) -> DataFrame:
    """(ref2, alt2, channel): 144 rows."""
    return spark.createDataFrame(dbs_pairs(), "ref2 string, alt2 string, channel string")
