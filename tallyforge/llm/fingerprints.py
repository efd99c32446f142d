"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A text's terms are its words between white space, A-Z lower-cased, weighted by
how often they occur.  Weights are whole numbers, so a term of weight w is the
pairs (term, 1) to (term, w), and each of `SAMPLES` samplers orders all pairs by
a hash and keeps the least one of the text's.  That is a consistent and uniform
sample of term and weight: two texts keep the same pair with the probability of
their generalised Jaccard similarity, so the share of equal entries estimates it.
A sampler's hash is one to one on the pairs' 64-bit hashes.

Documents are dealt into ranges of descending id and about equal bytes, with
the first document of the following range as a guest behind the last, by the
only shuffle that moves texts.  In its range a document sees the next one's
text through a window.  Words, weights and samples are then aggregated in place,
as the range is part of every grouping key.  A document's own facts (id, length,
digest) go along as numbered rows among its words', so nothing is joined back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import _text as X
from tallyforge.llm._frames import cells, table

SAMPLES = 64
#: Bytes of text in a range, about, and ranges at most; beyond, ranges grow.
RANGE, RANGES = 2 << 20, 500_000

_LOW = 0xFFFFFFFF


def _keys(samples: int) -> list[int]:
    """A signed 64-bit number for each sampler."""
    return X.mix(np.arange(1, samples + 1, dtype=X.U64) * X.U64(0x9E3779B97F4A7C15)).view(np.int64).tolist()


def in_ranges(documents: DataFrame, size: int = RANGE) -> DataFrame:
    """(range, place, doc_id, text, next, far): documents in descending order
    of id, ids that are null last, equal ids by a hash of their texts; `next`
    is the text of the following one and, for the last, of the first; `far`
    tells that it stands in another range."""
    rows = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows, ranges, split = cells(rows, size, RANGES)
    own = F.xxhash64("text")
    rows = rows.select((F.lit(ranges - 1) - F.col("cell")).alias("range"), "doc_id", "text")
    # The first document of each range: RANGES rows of a few numbers at most.
    heads = rows.groupBy("range").agg(F.max(F.struct("doc_id", (own if split else F.lit(None).cast("bigint")).alias("hash"))).alias("w"))
    order = Window.orderBy("range")
    wanted = heads.select(F.col("range").alias("guest_of"), F.coalesce(F.lead("w").over(order), F.first("w").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("w"))
    meets = F.col("doc_id").eqNullSafe(F.col("w.doc_id")) & (own == F.col("w.hash") if split else F.lit(True))
    guests = rows.join(F.broadcast(wanted) if ranges <= 40_000 else wanted, meets).groupBy("guest_of").agg(F.max_by("text", own).alias("text"))
    dealt = rows.withColumn("guest", F.lit(False)).unionByName(guests.select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("guest_of").alias("range"), F.lit(True).alias("guest")))
    dealt = dealt.repartition(min(ranges, 100_000), "range")
    along = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), own.desc())
    placed = dealt.withColumns({"place": F.row_number().over(along), "next": F.lead("text").over(along), "far": F.lead("guest").over(along)})
    return placed.where("not guest").select("range", "place", "doc_id", "text", "next", "far")


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+", -1)


def _lowered(word: Column) -> Column:
    """A-Z lower-cased; lower() does that, and quickly, where all is ASCII."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


#: Numbers of a document's rows: 0 to 2 are the words of its text, of the edited
#: and of the following one; then come id, length and the digest's 8 parts.
FACTS = 3


def signatures(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """(range, place, doc_id, n_chars, edited_sha256, sketch, edited_sketch, beyond_sketch)
    from the result of in_ranges(); beyond_sketch is the following text's where it is `far`.
    Sketches of texts without words are null."""
    none = F.expr("cast(array() as array<string>)")
    facts = F.array(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.length("text").cast("string"), *[F.substring("__sha", 8 * i + 1, 8) for i in range(8)])
    held = rows.withColumn("__e", edited(F.col("text"), F.col("next"))).withColumn("__sha", F.sha2("__e", 256))
    held = held.select("range", "place", words(F.col("text")).alias("__w0"), words(F.col("__e")).alias("__w1"), F.when(F.col("far"), words(F.col("next"))).otherwise(none).alias("__w2"), facts.alias("__f"))
    held = held.select("*", F.size("__w0").alias("__a"), (F.size("__w0") + F.size("__w1")).alias("__b"), (F.size("__w0") + F.size("__w1") + F.size("__w2")).alias("__c"))
    flat = held.select("range", "place", "__a", "__b", "__c", F.posexplode(F.concat("__w0", "__w1", "__w2", "__f")).alias("__at", "__word")).where("__word <> ''")
    number = F.when(F.col("__at") < F.col("__a"), 0).when(F.col("__at") < F.col("__b"), 1).when(F.col("__at") < F.col("__c"), 2).otherwise(F.col("__at") - F.col("__c") + FACTS)
    fact = F.when(F.col("__at") < F.col("__c") + 2, F.col("__word").cast("bigint")).otherwise(F.conv("__word", 16, 10).cast("bigint"))
    terms = flat.select("range", (F.col("place") * 16 + number).alias("row"), F.when(F.col("__at") < F.col("__c"), F.xxhash64(_lowered(F.col("__word")))).otherwise(fact).alias("term"))
    weighed = terms.groupBy("range", "row", "term").agg(F.count(F.lit(1)).alias("weight"))
    pairs = weighed.select("range", "row", "term", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("weight"))).alias("w"))
    pairs = pairs.select("range", "row", "term", F.xxhash64("term", "w").alias("pair"))
    least = pairs.groupBy("range", "row").agg(F.min("term").alias("fact"), *[F.min(F.xxhash64(F.col("pair").bitwiseXOR(F.lit(key).cast("bigint")))).alias(f"s{k}") for k, key in enumerate(_keys(samples))])
    tall = least.select("range", F.shiftright("row", 4).alias("place"), F.col("row").bitwiseAND(15).alias("number"), "fact", F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(_LOW)) for k in range(samples)]).alias("sketch"))
    pick = lambda column, i: F.first(F.when(F.col("number") == i, F.col(column)), ignorenulls=True)
    wide = tall.groupBy("range", "place").agg(
        pick("fact", FACTS).alias("doc_id"), pick("fact", FACTS + 1).alias("n_chars"),
        *[pick("fact", FACTS + 2 + i).alias(f"__{i}") for i in range(8)],
        *[pick("sketch", i).alias(n) for i, n in enumerate(("sketch", "edited_sketch", "beyond_sketch"))],
    )
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"__{i}")), 8, "0") for i in range(8)])
    return wide.select("range", "place", "doc_id", "n_chars", digest.alias("edited_sha256"), "sketch", "edited_sketch", "beyond_sketch")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two sketches."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)).cast("double") / F.size(a)


def hexed(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def fingerprints(documents: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, sketch, edited_sketch, near_edited, near_next.

    Null counts as the empty text.  A text without words has a sketch of
    zeros, which is like another such sketch and no other.  Rows with equal or
    null ids stay rows of their own; see in_ranges() for their order.  A single
    document is its own next.  Columns other than doc_id (an integer) and text
    are ignored.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    none = F.array_repeat(F.lit(0).cast("bigint"), samples)
    along = Window.partitionBy("range").orderBy("place")
    full = signatures(in_ranges(rows), samples).withColumn("far", F.lead("place").over(along).isNull())
    full = full.withColumns({n: F.coalesce(n, none) for n in ("sketch", "edited_sketch", "beyond_sketch")})
    full = full.withColumn("following", F.when(F.col("far"), F.col("beyond_sketch")).otherwise(F.lead("sketch").over(along)))
    return full.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("following")).alias("near_next"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("sketch")).alias("fingerprint"), hexed(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def brute(text: str, samples: int = SAMPLES) -> list[int]:
    """The sketch in plain Python, for tests."""
    import re
    import struct
    from collections import Counter

    import xxhash

    def hashed(raw, seed=42):
        return xxhash.xxh64_intdigest(raw, seed)

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    pairs = []
    for word, n in Counter(w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w).items():
        term = hashed(hashed(word.encode()).to_bytes(8, "little"))
        pairs += [hashed(struct.pack("<q", w), term) for w in range(1, n + 1)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [min((signed(hashed((p ^ key & (1 << 64) - 1).to_bytes(8, "little"))) for p in pairs), default=0) & _LOW for key in _keys(samples)]
