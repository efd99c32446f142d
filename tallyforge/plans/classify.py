"""Tally and classification queries on the supplied tables, each with its SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import channels as C
from tallyforge.functions import sequence as S
from tallyforge.operators import catalogs, routing, tally
from tallyforge.sources import genome, segments, variants

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("catalog_tally", """
WITH c AS (SELECT user_id AS sample, event_type AS channel, count(*) AS n FROM events GROUP BY 1, 2),
g AS (SELECT s.sample, k.channel FROM (SELECT DISTINCT user_id AS sample FROM events) s CROSS JOIN (SELECT DISTINCT event_type AS channel FROM events) k)
SELECT g.sample, g.channel, CAST(coalesce(c.n, 0) AS BIGINT) AS n, CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.sample) AS BIGINT) AS total,
round(coalesce(c.n, 0) / CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY g.sample) AS DOUBLE), 6) AS share
FROM g LEFT JOIN c ON g.sample = c.sample AND g.channel = c.channel""")
def catalog_tally(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("channel"))
    out = tally.with_share(tally.dense(tally.counted(e), e))
    return out.select("sample", "channel", "n", "total", F.round("share", 6).alias("share"))


KINDS = ("click", "error", "purchase", "signup", "view")


@query("catalog_pivot", "SELECT user_id AS sample, " + ", ".join(f"CAST(count(*) FILTER (event_type = '{k}') AS BIGINT) AS {k}" for k in KINDS) + " FROM events GROUP BY 1")
def catalog_pivot(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("sample"), F.col("event_type").alias("channel"))
    return tally.pivoted(tally.counted(e).withColumnRenamed("sample", "s").withColumnRenamed("channel", "sample").withColumnRenamed("s", "channel"), list(KINDS)).withColumnRenamed("channel", "sample").fillna(0)


def base(col):
    return F.substring(F.lit("ACGT"), (F.pmod(col, F.lit(4)) + 1).cast("int"), F.lit(1))


def calls(spark, sf):
    """Single-base records from lineitem by integer arithmetic."""
    p, o = F.col("l_partkey"), F.col("l_orderkey")
    div = lambda c, n: F.floor(c / n)
    line = t(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    return line.select(
        (F.col("l_suppkey") % 50).alias("sample"), F.substring(F.lit("TUBN"), F.col("l_linenumber") % 4 + 1, F.lit(1)).alias("strand"),
        F.concat(base(p), base(div(p, 4)), base(o), base(div(p, 16)), base(div(p, 64))).alias("penta"), base(o + 1 + F.col("l_linenumber") % 3).alias("alt"), F.col("l_quantity").cast("int").alias("quantity"),
    )


_B = "substr('ACGT', 1 + CAST(({}) % 4 AS INTEGER), 1)".format
CALLS = f"""v AS (SELECT l_suppkey % 50 AS sample, substr('TUBN', 1 + l_linenumber % 4, 1) AS strand,
{_B('l_partkey')} || {_B('l_partkey // 4')} || {_B('l_orderkey')} || {_B('l_partkey // 16')} || {_B('l_partkey // 64')} AS penta,
{_B('l_orderkey + 1 + l_linenumber % 3')} AS alt, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem),
f AS (SELECT *, CASE WHEN substr(penta, 3, 1) IN ('A', 'G') THEN translate(reverse(penta), 'ACGT', 'TGCA') ELSE penta END AS c,
CASE WHEN substr(penta, 3, 1) IN ('A', 'G') THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a,
CASE WHEN substr(penta, 3, 1) IN ('A', 'G') THEN translate(strand, 'TU', 'UT') ELSE strand END AS s FROM v)"""
_L96 = "substr(c, 2, 1) || '[' || substr(c, 3, 1) || '>' || a || ']' || substr(c, 4, 1)"


@query("sbs96_classify", f"""WITH {CALLS}, n AS (SELECT sample, {_L96} AS channel, count(*) AS n FROM f GROUP BY 1, 2),
k AS (SELECT x || '[' || m || ']' || y AS channel FROM (VALUES ('A'),('C'),('G'),('T')) p(x), (VALUES ('C>A'),('C>G'),('C>T'),('T>A'),('T>C'),('T>G')) q(m), (VALUES ('A'),('C'),('G'),('T')) r(y))
SELECT s.sample, k.channel, CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT sample FROM f) s CROSS JOIN k LEFT JOIN n ON n.sample = s.sample AND n.channel = k.channel""")
def sbs96_classify(spark, sf):
    v = calls(spark, sf)
    rows = v.select("sample", S.sbs96(F.substring("penta", 2, 3), F.col("alt")).alias("channel"))
    return tally.dense(tally.counted(rows), C.frame(spark, "SBS96"), rows).select("sample", "channel", "n")


@query("sbs96_index", f"""WITH {CALLS} SELECT CAST((instr('ACGT', substr(c, 2, 1)) - 1) * 24 + (list_position(['C>A','C>G','C>T','T>A','T>C','T>G'], substr(c, 3, 1) || '>' || a) - 1) * 4 + instr('ACGT', substr(c, 4, 1)) - 1 AS BIGINT) AS channel_index, count(*) AS n FROM f GROUP BY 1""")
def sbs96_index(spark, sf):
    return calls(spark, sf).groupBy(S.sbs96_index(F.substring("penta", 2, 3), F.col("alt")).cast("bigint").alias("channel_index")).agg(F.count(F.lit(1)).alias("n"))


@query("sbs192_classify", f"WITH {CALLS} SELECT s || ':' || {_L96} AS channel, count(*) AS n FROM f WHERE strand IN ('T', 'U') GROUP BY 1")
def sbs192_classify(spark, sf):
    rows = calls(spark, sf).select(S.sbs192(F.substring("penta", 2, 3), F.col("alt"), F.col("strand")).alias("channel"))
    return rows.where("channel is not null").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))


@query("sbs384_classify", f"WITH {CALLS} SELECT s || ':' || {_L96} AS channel, count(*) AS n FROM f GROUP BY 1")
def sbs384_classify(spark, sf):
    return calls(spark, sf).groupBy(S.sbs384(F.substring("penta", 2, 3), F.col("alt"), F.col("strand")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("sbs1536_classify", f"WITH {CALLS} SELECT sample, substr(c, 1, 2) || '[' || substr(c, 3, 1) || '>' || a || ']' || substr(c, 4, 2) AS channel, count(*) AS n FROM f GROUP BY 1, 2")
def sbs1536_classify(spark, sf):
    return calls(spark, sf).groupBy("sample", S.sbs1536(F.col("penta"), F.col("alt")).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


_DIM = "d(ref2, alt2, channel) AS (VALUES " + ", ".join(f"('{r}','{a}','{c}')" for r, a, c in C.dbs_pairs()) + ")"


@query("dbs78_classify", f"WITH {_DIM}, {CALLS} SELECT v.sample, d.channel, count(*) AS n FROM v JOIN d ON substr(v.penta, 1, 2) = d.ref2 AND substr(v.penta, 4, 2) = d.alt2 GROUP BY 1, 2")
def dbs78_classify(spark, sf):
    v = calls(spark, sf).select("sample", F.substring("penta", 1, 2).alias("ref2"), F.substring("penta", 4, 2).alias("alt2"))
    return v.join(F.broadcast(C.doublets(spark)), ["ref2", "alt2"]).groupBy("sample", "channel").agg(F.count(F.lit(1)).alias("n"))


def dirty(spark, sf):
    q, ref = F.col("quantity"), F.substring("penta", 3, 1)
    return calls(spark, sf).select("sample", F.when(q % 13 == 0, "N").when(q % 17 == 0, "").otherwise(ref).alias("ref"), F.when(q % 10 == 0, ref).when(q % 11 == 0, "AR").otherwise(F.col("alt")).alias("alt"))


@query("variant_ledger", f"""WITH {CALLS}, w AS (SELECT CASE WHEN quantity % 13 = 0 THEN 'N' WHEN quantity % 17 = 0 THEN '' ELSE substr(penta, 3, 1) END AS ref,
CASE WHEN quantity % 10 = 0 THEN substr(penta, 3, 1) WHEN quantity % 11 = 0 THEN 'AR' ELSE alt END AS alt FROM v),
r AS (SELECT CASE WHEN length(ref) = 0 OR length(alt) = 0 THEN 'skipped:empty_allele' WHEN NOT regexp_full_match(ref, '[ACGT]+') OR NOT regexp_full_match(alt, '[ACGT]+') THEN 'skipped:invalid_base' WHEN ref = alt THEN 'skipped:ref_equals_alt' ELSE 'sbs' END AS destination FROM w)
SELECT destination, count(*) AS n, CAST(count(*) FILTER (destination LIKE 'skipped:%') AS BIGINT) AS n_skipped FROM r GROUP BY 1""")
def variant_ledger(spark, sf):
    reason = S.skip_reason(F.col("ref"), F.col("alt"))
    return tally.ledger(dirty(spark, sf), F.coalesce(F.concat(F.lit("skipped:"), reason), F.lit("sbs")))


@query("strand_ambiguity", f"WITH {CALLS} SELECT sample, count(*) FILTER (length(regexp_replace(substr(penta, 1, 4), '[AG]', '', 'g')) * 2 = 4) AS ambiguous, count(*) AS n FROM v GROUP BY 1")
def strand_ambiguity(spark, sf):
    return calls(spark, sf).groupBy("sample").agg(F.count_if(S.ambiguous_strand(F.substring("penta", 1, 4))).alias("ambiguous"), F.count(F.lit(1)).alias("n"))


def stream(spark, sf):
    """Single-base records of 20 samples x 3 chromosomes, placed by day."""
    return t(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("sample"), F.col("l_returnflag").alias("chrom"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).alias("pos"),
        base(F.col("l_partkey")).alias("ref"), base(F.col("l_partkey") + 1 + F.col("l_linenumber") % 3).alias("alt"), (F.col("l_quantity").cast("int") % 9 != 0).alias("valid"),
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"),
    )


_ORDER = ["pos", "l_orderkey", "l_linenumber", "l_partkey", "price"]
_STREAM = f"""s AS (SELECT l_suppkey % 20 AS sample, l_returnflag AS chrom, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS pos, {_B('l_partkey')} AS ref, {_B('l_partkey + 1 + l_linenumber % 3')} AS alt,
CAST(l_quantity AS INTEGER) % 9 <> 0 AS valid, l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price FROM lineitem)"""
_BY = "PARTITION BY sample, chrom ORDER BY pos, l_orderkey, l_linenumber, l_partkey, price"


@query("dbs_pairing", f"""WITH {_STREAM}, l AS (SELECT *, coalesce(lead(pos) OVER ({_BY}) = pos + 1 AND lead(valid) OVER ({_BY}) AND valid, false) AS link, row_number() OVER ({_BY}) AS i FROM s),
g AS (SELECT *, i - sum(CASE WHEN link THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY i ROWS UNBOUNDED PRECEDING) AS brk FROM l),
h AS (SELECT *, link AND row_number() OVER (PARTITION BY sample, chrom, link, brk ORDER BY i) % 2 = 1 AS first FROM g),
d AS (SELECT sample, chrom, CASE WHEN NOT valid THEN 'skipped' WHEN first OR coalesce(lag(first) OVER (PARTITION BY sample, chrom ORDER BY i), false) THEN 'dbs' ELSE 'sbs' END AS destination FROM h)
SELECT sample, chrom, destination, count(*) AS n FROM d GROUP BY 1, 2, 3""")
def dbs_pairing(spark, sf):
    return routing.paired_snvs(stream(spark, sf), ["sample", "chrom"], _ORDER).groupBy("sample", "chrom", "destination").agg(F.count(F.lit(1)).alias("n"))


@query("dup_skip", f"""WITH {_STREAM}, d AS (SELECT sample, chrom, coalesce(lag(pos) OVER ({_BY}) = pos AND lag(ref) OVER ({_BY}) = ref AND lag(alt) OVER ({_BY}) = alt, false) AS duplicate FROM s)
SELECT sample, chrom, CAST(count(*) FILTER (duplicate) AS BIGINT) AS n_duplicate, count(*) AS n FROM d GROUP BY 1, 2""")
def dup_skip(spark, sf):
    return routing.repeated(stream(spark, sf), ["sample", "chrom"], _ORDER).groupBy("sample", "chrom").agg(F.count_if("duplicate").alias("n_duplicate"), F.count(F.lit(1)).alias("n"))


@query("route_stream")
def route_stream(spark, sf):
    rows = stream(spark, sf).withColumn("alt", F.when(~F.col("valid"), F.concat("alt", "ref")).otherwise(F.col("alt")))
    return routing.routed(rows, ["sample", "chrom"], _ORDER).groupBy("sample", "chrom", "destination").agg(F.count(F.lit(1)).alias("n"))


@query("cn48_classify", """WITH s AS (SELECT l_suppkey % 50 AS sample, l_linenumber % 3 AS minor, l_linenumber % 3 + CAST(l_quantity AS INTEGER) % 7 AS major, CAST(floor(l_extendedprice * 1000) AS BIGINT) AS len FROM lineitem),
c AS (SELECT *, minor + major AS cn, CASE WHEN len <= 100000 THEN '0-100kb' WHEN len <= 1000000 THEN '100kb-1Mb' WHEN len <= 10000000 THEN '1Mb-10Mb' WHEN len <= 40000000 THEN '10Mb-40Mb' ELSE '>40Mb' END AS size FROM s),
l AS (SELECT sample, CASE WHEN cn = 0 THEN '0:homdel:' || CASE WHEN len <= 100000 THEN '0-100kb' WHEN len <= 1000000 THEN '100kb-1Mb' ELSE '>1Mb' END
ELSE CASE WHEN cn <= 1 THEN '1' WHEN cn = 2 THEN '2' WHEN cn <= 4 THEN '3-4' WHEN cn <= 8 THEN '5-8' ELSE '9+' END || CASE WHEN minor = 0 THEN ':LOH:' ELSE ':het:' END || size END AS channel FROM c)
SELECT sample, channel, count(*) AS n FROM l GROUP BY 1, 2""")
def cn48_classify(spark, sf):
    minor = F.col("l_linenumber") % 3
    rows = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("sample"), S.cn48(minor, minor + F.col("l_quantity").cast("int") % 7, F.floor(F.col("l_extendedprice") * 1000)).alias("channel"))
    return tally.counted(rows)


@query("sv32_classify", """WITH o AS (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders),
s AS (SELECT o_orderstatus AS sample, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(coalesce(after, o_orderdate) AS DATE))) * 7919 AS size, o_orderkey % 3 = 0 AS cl,
CASE o_orderpriority WHEN '1-URGENT' THEN 'del' WHEN '2-HIGH' THEN 'tds' WHEN '3-MEDIUM' THEN 'inv' ELSE 'trans' END AS k FROM o),
l AS (SELECT sample, CASE WHEN cl THEN 'clustered' ELSE 'non-clustered' END || CASE WHEN k = 'trans' THEN '_trans' WHEN size < 1000 THEN NULL ELSE '_' || k || '_' || CASE WHEN size <= 10000 THEN '1-10Kb' WHEN size <= 100000 THEN '10-100Kb' WHEN size <= 1000000 THEN '100Kb-1Mb' WHEN size <= 10000000 THEN '1Mb-10Mb' ELSE '>10Mb' END END AS channel FROM s)
SELECT sample, coalesce(channel, 'too_short') AS channel, count(*) AS n FROM l GROUP BY 1, 2""")
def sv32_classify(spark, sf):
    from pyspark.sql import Window

    after = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    o = t(spark, sf, "orders").withColumn("size", F.abs(F.datediff(F.coalesce(after, "o_orderdate"), "o_orderdate")).cast("bigint") * 7919)
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "deletion").when(F.col("o_orderpriority") == "2-HIGH", "tandem-duplication").when(F.col("o_orderpriority") == "3-MEDIUM", "inversion").otherwise("translocation")
    rows = o.select(F.col("o_orderstatus").alias("sample"), F.coalesce(S.sv32(kind, F.col("size"), F.col("o_orderkey") % 3 == 0), F.lit("too_short")).alias("channel"))
    return tally.counted(rows)


@query("multiallelic_explode", """WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS pos, upper(substr('acgtn', 1 + CAST(o_orderkey % 5 AS INTEGER), 1)) AS ref,
CASE o_orderkey % 7 WHEN 0 THEN 'a,T' WHEN 1 THEN '.' WHEN 2 THEN '*,G' WHEN 3 THEN '<DEL>' WHEN 4 THEN 'AX' WHEN 5 THEN 'CG,T,A' ELSE 'C' END AS alts, o_orderstatus AS filter FROM orders),
e AS (SELECT o_orderkey, CAST(pos AS BIGINT) AS start, ref, filter, len(string_split(alts, ',')) AS site, unnest(string_split(upper(alts), ',')) AS alt FROM o)
SELECT start, start + length(ref) - 1 AS "end", ref, alt, filter, CAST(site AS BIGINT) AS site, count(*) AS n,
CASE WHEN alt IN ('', '.') THEN 'missing_alt' WHEN alt = '*' THEN 'spanning_star' WHEN starts_with(alt, '<') THEN 'symbolic_alt' WHEN NOT regexp_full_match(ref, '[ACGTN]+') THEN 'invalid_ref' WHEN NOT regexp_full_match(alt, '[ACGTN]+') THEN 'invalid_alt' END AS reason
FROM e GROUP BY ALL""")
def multiallelic_explode(spark, sf):
    o = t(spark, sf, "orders")
    k = F.col("o_orderkey") % 7
    alts = F.when(k == 0, "a,T").when(k == 1, ".").when(k == 2, "*,G").when(k == 3, "<DEL>").when(k == 4, "AX").when(k == 5, "CG,T,A").otherwise("C")
    ref = F.substring(F.lit("acgtn"), (F.col("o_orderkey") % 5 + 1).cast("int"), F.lit(1))
    lines = o.select(F.concat_ws("\t", F.lit("chr1"), F.col("o_custkey").cast("string"), F.lit("."), ref, alts, F.lit("50"), F.col("o_orderstatus"), F.lit(".")).alias("value"))
    p = variants.parse_vcf(lines)
    return p.groupBy("start", "end", "ref", "alt", "filter", F.col("site").cast("bigint").alias("site"), "reason").agg(F.count(F.lit(1)).alias("n"))


@query("parse_statistics", """WITH o AS (SELECT CASE o_orderkey % 7 WHEN 0 THEN 'A,T' WHEN 1 THEN '.' WHEN 2 THEN '*,G' WHEN 3 THEN '<DEL>' WHEN 4 THEN 'AX' WHEN 5 THEN 'CG,T,A' ELSE 'C' END AS alts FROM orders),
e AS (SELECT unnest(string_split(alts, ',')) AS alt FROM o)
SELECT CASE WHEN alt IN ('', '.') THEN 'missing_alt' WHEN alt = '*' THEN 'spanning_star' WHEN starts_with(alt, '<') THEN 'symbolic_alt' WHEN NOT regexp_full_match(alt, '[ACGTN]+') THEN 'invalid_alt' ELSE 'ok' END AS reason, count(*) AS n FROM e GROUP BY 1""")
def parse_stats(spark, sf):
    full = multiallelic_explode(spark, sf)
    return full.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.sum("n").alias("n"))


@query("tabular_filters", """WITH o AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS pos, CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN '-' ELSE 'ac' END AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'G' ELSE 'Tt' END AS alt,
CASE WHEN o_orderkey % 6 = 0 THEN CAST(o_custkey + 1 AS VARCHAR) END AS e, CASE o_orderpriority WHEN '1-URGENT' THEN 'Silent' WHEN '2-HIGH' THEN 'Missense_Mutation' WHEN '3-MEDIUM' THEN 'Intron' WHEN '5-LOW' THEN 'RNA' ELSE 'Frame_Shift_Del' END AS k FROM orders),
p AS (SELECT *, TRY_CAST(pos AS BIGINT) AS start, coalesce(TRY_CAST(e AS BIGINT), TRY_CAST(pos AS BIGINT) + length(ref) - 1) AS last FROM o)
SELECT CASE WHEN k IN ('Silent', 'Frame_Shift_Del') THEN 'classification' WHEN start IS NULL THEN 'invalid_pos' WHEN NOT regexp_full_match(upper(ref), '[ACGTN]+') THEN 'unusable_allele' WHEN last - start + 1 <> length(ref) THEN 'length_mismatch' ELSE 'ok' END AS reason, count(*) AS n FROM p GROUP BY 1""")
def tabular_filters(spark, sf):
    k, key = F.col("o_orderpriority"), F.col("o_orderkey")
    rows = t(spark, sf, "orders").select(
        F.lit("1").alias("Chromosome"), F.when(key % 5 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("Start_Position"), F.when(key % 6 == 0, (F.col("o_custkey") + 1).cast("string")).alias("End_Position"),
        F.when(key % 4 == 0, "A").when(key % 4 == 1, "-").otherwise("ac").alias("Reference_Allele"), F.when(key % 3 == 0, "G").otherwise("Tt").alias("Tumor_Seq_Allele2"),
        F.when(k == "1-URGENT", "Silent").when(k == "2-HIGH", "Missense_Mutation").when(k == "3-MEDIUM", "Intron").when(k == "5-LOW", "RNA").otherwise("Frame_Shift_Del").alias("Variant_Classification"),
    )
    return variants.parse_statistics(variants.parse_table(rows, "Chromosome", "Start_Position", "Reference_Allele", "Tumor_Seq_Allele2", "End_Position", "Variant_Classification"))


def caller_table(spark, sf):
    q = F.col("l_quantity").cast("int")
    return t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.lit("1").alias("Chromosome"), F.col("l_partkey").alias("Start Position"), (F.col("l_partkey") + F.col("l_suppkey") - 3).alias("End Position"), (q % 6).alias("Tumour TCN"), F.when(q % 7 != 0, q % 4).alias("Tumour BCN"))


@query("segments_caller", """WITH s AS (SELECT l_returnflag AS sample, l_partkey AS start, l_partkey + l_suppkey - 3 AS "end", CAST(l_quantity AS INTEGER) % 6 AS tcn, CASE WHEN CAST(l_quantity AS INTEGER) % 7 <> 0 THEN CAST(l_quantity AS INTEGER) % 4 END AS bcn FROM lineitem),
m AS (SELECT *, CASE WHEN bcn IS NOT NULL THEN least(tcn - bcn, bcn) END AS minor, CASE WHEN bcn IS NOT NULL THEN tcn - least(tcn - bcn, bcn) END AS major FROM s)
SELECT sample, coalesce(minor, -99) AS minor, coalesce(major, -99) AS major, CASE WHEN "end" < start THEN 'negative_length' WHEN minor IS NULL THEN 'missing_copy_number' WHEN minor < 0 OR major < 0 THEN 'negative_copy_number' WHEN minor > major THEN 'order' END AS reason, count(*) AS n FROM m GROUP BY 1, 2, 3, 4""")
def segments_caller(spark, sf):
    return segments.canonical(caller_table(spark, sf)).fillna(-99, ["minor", "major"]).groupBy("sample", "minor", "major", "reason").agg(F.count(F.lit(1)).alias("n"))


_TYPES = ("copy neutral LOH", "amp LOH", "hemizygous del LOH", "loss", "copy neutral", "gain", "other")


@query("segments_pcawg", """WITH s AS (SELECT l_returnflag AS sample, CAST(l_quantity AS INTEGER) % 4 AS n, CAST(l_partkey % 7 AS INTEGER) AS k FROM lineitem),
m AS (SELECT *, CASE WHEN k < 3 OR (k = 3 AND n < 2) THEN 0 WHEN k IN (4, 5) THEN 1 END AS minor, CASE WHEN k < 3 OR (k = 3 AND n < 2) THEN n WHEN k IN (4, 5) THEN n - 1 END AS major,
CASE WHEN k = 6 THEN 'unsupported_type' WHEN (k < 3 AND n = 0) OR (k IN (4, 5) AND n < 2) OR (k = 3 AND n >= 2) THEN 'type_total_mismatch' END AS reason FROM s)
SELECT sample, coalesce(minor, -99) AS minor, coalesce(major, -99) AS major, reason, count(*) AS n FROM m GROUP BY 1, 2, 3, 4""")
def segments_pcawg(spark, sf):
    names = F.element_at(F.array(*[F.lit(x) for x in _TYPES]), (F.col("l_partkey") % 7 + 1).cast("int"))
    rows = t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.lit("1").alias("chromosome"), F.lit(1).alias("chromosome_start"), F.lit(9).alias("chromosome_end"), (F.col("l_quantity").cast("int") % 4).alias("copy_number"), names.alias("mutation_type"))
    return segments.canonical(rows).fillna(-99, ["minor", "major"]).groupBy("sample", "minor", "major", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("sv_from_bedpe", """WITH s AS (SELECT o_orderstatus AS sample, o_custkey % 5 AS c1, (o_custkey + o_orderkey) % 5 AS c2, o_custkey AS s1, o_custkey + o_orderkey % 2500 AS s2, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS t1, CASE WHEN o_orderkey % 3 = 0 THEN '+' ELSE '-' END AS t2 FROM orders),
k AS (SELECT *, CASE WHEN c1 <> c2 THEN 'translocation' WHEN t1 = '+' AND t2 = '+' THEN 'deletion' WHEN t1 = '-' AND t2 = '-' THEN 'tandem-duplication' ELSE 'inversion' END AS svtype, abs(s1 - s2) AS size FROM s)
SELECT sample, svtype, CASE WHEN svtype <> 'translocation' AND size < 1000 THEN 'too_short' END AS reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bases FROM k GROUP BY 1, 2, 3""")
def sv_from_bedpe(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = t(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("sample"), (cust % 5).alias("chrom1"), ((cust + key) % 5).alias("chrom2"), cust.alias("start1"), (cust + key % 2500).alias("start2"),
        F.when(key % 2 == 0, "+").otherwise("-").alias("strand1"), F.when(key % 3 == 0, "+").otherwise("-").alias("strand2"),
    )
    return segments.structural(rows).groupBy("sample", "svtype", "reason").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bp").alias("bases"))


_LETTERS, _AS_BASES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACCATGGCATGCANTGCATTGCATGCACCATGGCATGCANTGCATTGCATGC"
_SEQ = "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACCATGGCATGCANTGCATTGCATGCACCATGGCATGCANTGCATTGCATGC') AS seq FROM documents"


def sequences(spark, sf):
    """Documents as sequences: the synthetic genome of the context queries."""
    d = t(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("chrom"), F.translate("text", _LETTERS, _AS_BASES).alias("seq"))


@query("context_lookup", f"""WITH g AS ({_SEQ}), v AS (SELECT l_orderkey % 200 AS doc, l_partkey AS pos, {_B('l_suppkey')} AS ref FROM lineitem),
c AS (SELECT v.*, CASE WHEN pos - 1 >= 2 AND pos + 1 < length(seq) THEN substr(seq, CAST(pos - 2 AS BIGINT), 5) END AS context FROM v LEFT JOIN g ON g.doc_id = v.doc)
SELECT CASE WHEN context IS NULL THEN 'context_bounds' WHEN NOT regexp_full_match(context, '[ACGT]+') THEN 'n_context' WHEN substr(context, 3, 1) <> ref THEN 'ref_mismatch' ELSE 'ok' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def context_lookup(spark, sf):
    v = t(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).cast("string").alias("chrom"), F.col("l_partkey").alias("start"), base(F.col("l_suppkey")).alias("ref"))
    small = 512
    rows = genome.with_context(v, genome.chunked(sequences(spark, sf), small), size=small)
    return rows.groupBy(F.coalesce(genome.context_reason(F.col("ref"), F.col("context")), F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("doc_trinuc_catalog", """WITH d AS (SELECT source, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACCATGGCATGCANTGCATTGCATGCACCATGGCATGCANTGCATTGCATGC') AS s FROM documents),
p AS (SELECT source, s, unnest(range(1, length(s) - 1)) AS i FROM d WHERE length(s) >= 3), m AS (SELECT source, substr(s, i, 3) AS k FROM p)
SELECT source, CASE WHEN substr(k, 2, 1) IN ('A', 'G') THEN translate(reverse(k), 'ACGT', 'TGCA') ELSE k END AS channel, count(*) AS n FROM m WHERE regexp_full_match(k, '[ACGT]{3}') GROUP BY 1, 2""")
def doc_trinuc_catalog(spark, sf):
    d = t(spark, sf, "documents").select("source", F.translate("text", _LETTERS, _AS_BASES).alias("s"))
    # three frames of non-overlapping triplets: one pass each, no position arithmetic on long strings
    frames = [d.select("source", F.explode(F.regexp_extract_all(F.substring("s", k, 1 << 30), F.lit("(?s)..."), F.lit(0))).alias("k")) for k in (1, 2, 3)]
    m = frames[0].unionByName(frames[1]).unionByName(frames[2]).where(F.col("k").rlike(r"^[ACGT]{3}\z"))
    folded = F.when(F.substring("k", 2, 1).isin("A", "G"), S.reverse_complement(F.col("k"))).otherwise(F.col("k"))
    return m.groupBy("source", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("source", folded.alias("channel")).agg(F.sum("n").alias("n"))


_INDELS = f"""g AS ({_SEQ}), o AS (SELECT o_orderstatus AS sample, o_custkey % 200 AS doc, o_orderkey % 397 + 1 AS pos, o_orderkey % 4 + 1 AS n, o_custkey % 3 AS how, o_orderkey % 11 = 0 AS wrong, {_B('o_orderkey')} || {_B('o_custkey')} || 'CA' AS other FROM orders),
j AS (SELECT o.*, seq, length(seq) AS total, substr(seq, CAST(pos AS BIGINT), 1) AS anchor FROM o JOIN g ON g.doc_id = o.doc),
a AS (SELECT *, CASE WHEN how = 2 THEN substr(other, 1, CAST(n AS BIGINT)) ELSE substr(seq, CAST(pos + 1 AS BIGINT), CAST(n AS BIGINT)) END AS unit FROM j),
r AS (SELECT *, how = 0 AS del, CASE WHEN how = 0 THEN pos + n ELSE pos END AS p0 FROM a WHERE regexp_full_match(anchor || unit, '[ACGT]+') AND length(unit) = n)"""


def indel_records(spark, sf):
    """Indels from orders: deletions of what the genome has, insertions of that or of other bases."""
    o = t(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("sample"), (F.col("o_custkey") % 200).cast("string").alias("chrom"), (F.col("o_orderkey") % 397 + 1).alias("pos"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("n"),
        (F.col("o_custkey") % 3).alias("how"), (F.col("o_orderkey") % 11 == 0).alias("wrong"), F.concat(base(F.col("o_orderkey")), base(F.col("o_custkey")), F.lit("CA")).alias("other"),
    )
    j = o.join(sequences(spark, sf), "chrom").withColumn("anchor", F.substring("seq", F.col("pos").cast("int"), F.lit(1)))
    unit = F.when(F.col("how") == 2, F.substring("other", F.lit(1), F.col("n"))).otherwise(F.substring("seq", F.col("pos").cast("int") + 1, F.col("n")))
    r = j.withColumn("unit", unit).where(F.concat("anchor", "unit").rlike(r"^[ACGT]+\z") & (F.length("unit") == F.col("n")))
    first = F.when(F.col("wrong"), F.translate("anchor", "ACGT", "CGTA")).otherwise(F.col("anchor"))
    long = F.concat(first, "unit")
    return r.select("sample", "chrom", "pos", F.when(F.col("how") == 0, long).otherwise(first).alias("ref"), F.when(F.col("how") == 0, first).otherwise(long).alias("alt"))


_LEFT = " + ".join(f"CAST(pos > n * {k} AND substr(seq, CAST(pos - n * {k} + 1 AS BIGINT), CAST(n * {k} AS BIGINT)) = repeat(unit, {k}) AS INTEGER)" for k in range(1, 6))
_RIGHT = " + ".join(f"CAST(p0 + n * {k} < total AND substr(seq, CAST(p0 + 1 AS BIGINT), CAST(n * {k} AS BIGINT)) = repeat(unit, {k}) AS INTEGER)" for k in range(1, 6))


@query("id83_classify", f"""WITH {_INDELS}, w AS (SELECT *, {_LEFT} AS lc, {_RIGHT} AS rc FROM r),
m AS (SELECT *, least(5, lc + rc) AS copies, CASE WHEN n > 1 AND lc + rc = 0 THEN greatest(
coalesce(list_max(list_filter(range(1, CAST(n AS BIGINT)), lambda i: substr(seq, CAST(p0 + 1 AS BIGINT), i) = substr(unit, 1, i))), 0),
coalesce(list_max(list_filter(range(1, CAST(n AS BIGINT)), lambda i: substr(seq || seq, CAST(total + pos AS BIGINT) - i + 1, i) = substr(unit, CAST(n AS BIGINT) - i + 1, i))), 0)) ELSE 0 END AS shared FROM w),
l AS (SELECT sample, CASE WHEN p0 + n * (rc + 1) > total THEN 'context_bounds' WHEN wrong THEN 'anchor_mismatch' WHEN shared > 0 AND NOT del THEN 'insertion_microhomology' END AS reason,
CASE WHEN n = 1 THEN '1:' || CASE WHEN del THEN 'Del' ELSE 'Ins' END || ':' || CASE WHEN unit IN ('C', 'G') THEN 'C' ELSE 'T' END || ':' || copies
WHEN shared = 0 THEN least(n, 5) || ':' || CASE WHEN del THEN 'Del' ELSE 'Ins' END || ':R:' || copies ELSE least(n, 5) || ':Del:M:' || least(shared, 5) END AS channel FROM m)
SELECT sample, coalesce(reason, channel) AS channel, count(*) AS n FROM l GROUP BY 1, 2""")
def id83_classify(spark, sf):
    rows = catalogs.indels(indel_records(spark, sf), sequences(spark, sf), 512)
    return rows.groupBy("sample", F.coalesce("reason", "channel").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("tally_face", f"""WITH g AS ({_SEQ}), v AS (SELECT l_returnflag AS sample, l_orderkey % 200 AS doc, 2 * (l_partkey % 500) + 1 AS pos, {_B('l_suppkey')} AS ref, {_B('l_suppkey + 1 + l_linenumber % 3')} AS alt FROM lineitem),
x AS (SELECT sample, ref, alt, CASE WHEN pos >= 3 AND pos + 1 < length(seq) THEN substr(seq, CAST(pos - 2 AS BIGINT), 5) END AS c5 FROM v LEFT JOIN g ON g.doc_id = v.doc),
f AS (SELECT sample, CASE WHEN ref IN ('A', 'G') THEN translate(reverse(c5), 'ACGT', 'TGCA') ELSE c5 END AS c, CASE WHEN ref IN ('A', 'G') THEN translate(alt, 'ACGT', 'TGCA') ELSE alt END AS a
FROM x WHERE regexp_full_match(c5, '[ACGT]+') AND substr(c5, 3, 1) = ref),
n AS (SELECT sample, {_L96} AS channel, count(*) AS n FROM f GROUP BY 1, 2),
k AS (SELECT x || '[' || m || ']' || y AS channel FROM (VALUES ('A'),('C'),('G'),('T')) p(x), (VALUES ('C>A'),('C>G'),('C>T'),('T>A'),('T>C'),('T>G')) q(m), (VALUES ('A'),('C'),('G'),('T')) r(y))
SELECT s.sample, k.channel, CAST(coalesce(n.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT sample FROM v) s CROSS JOIN k LEFT JOIN n ON n.sample = s.sample AND n.channel = k.channel""")
def tally_face(spark, sf):
    v = t(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("sample"), (F.col("l_orderkey") % 200).cast("string").alias("chrom"), (F.col("l_partkey") % 500 * 2 + 1).alias("pos"), base(F.col("l_suppkey")).alias("ref"), base(F.col("l_suppkey") + 1 + F.col("l_linenumber") % 3).alias("alt"),
    )
    return catalogs.catalog(v, sequences(spark, sf), "SBS96", 512)
