"""Queries of the figures' frames with their SQL forms: customers' or users' events stand for samples and signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import figures, stats
from tallyforge.plans.classify import t

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql):
    def keep(f):
        Q[name] = f
        SQL[name] = sql
        return f

    return keep


R6 = lambda c: F.round(c, 6).alias(c)
_C = 'c AS (SELECT user_id AS sample, event_type AS channel, CAST(count(*) AS DOUBLE) AS "count" FROM events GROUP BY 1, 2)'
_E = "x AS (SELECT user_id AS sample, event_type AS signature, sum(value) AS value FROM events GROUP BY 1, 2)"
_D = "d AS (SELECT user_id % 20 AS sample, event_type AS signature, CASE WHEN event_id % 9 = 0 THEN 0 ELSE value END AS value FROM events)"


def events(spark, sf):
    return t(spark, sf, "events")


def counts(spark, sf):
    return events(spark, sf).groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("channel")).agg(F.count(F.lit(1)).cast("double").alias("count"))


def exposures(spark, sf):
    return events(spark, sf).groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("signature")).agg(stats.exact_sum("value").alias("value"))


def draws(spark, sf):
    e = events(spark, sf)
    return e.select((F.col("user_id") % 20).alias("sample"), F.col("event_type").alias("signature"), F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("value")).alias("value"))


@query("fig_catalog_profile", f'WITH {_C} SELECT sample, channel, round("count" / sum("count") OVER (PARTITION BY sample), 6) AS value FROM c')
def fig_catalog_profile(spark, sf):
    return figures.profile(counts(spark, sf)).select("sample", "channel", R6("value"))


_HALF = "SELECT event_type AS channel, sum(value) AS value FROM events WHERE user_id % 2 = {k} GROUP BY 1"


def _half(spark, sf, k):
    return events(spark, sf).where(F.col("user_id") % 2 == k).groupBy(F.col("event_type").alias("channel")).agg(F.sum("value").alias("value"))


@query("fig_reference_comparison", f"WITH a AS ({_HALF.format(k=0)}), b AS ({_HALF.format(k=1)}) SELECT a.channel, round(a.value, 4) AS first, round(b.value, 4) AS second FROM a JOIN b ON a.channel = b.channel")
def fig_reference_comparison(spark, sf):
    return figures.side_by_side(_half(spark, sf, 0), _half(spark, sf, 1)).select("channel", F.round("first", 4).alias("first"), F.round("second", 4).alias("second"))


@query("fig_scatter", f"WITH a AS ({_HALF.format(k=0)}), b AS ({_HALF.format(k=1)}) SELECT a.channel, round(sum(a.value * b.value) OVER () / sqrt(sum(a.value * a.value) OVER () * sum(b.value * b.value) OVER ()), 6) AS cosine FROM a JOIN b ON a.channel = b.channel")
def fig_scatter(spark, sf):
    return figures.scatter(_half(spark, sf, 0), _half(spark, sf, 1)).select("channel", R6("cosine"))


@query("fig_reconstruction", f"""WITH {_C}, k AS (SELECT DISTINCT channel FROM c), f0 AS (SELECT c.sample, k.channel, sum("count" * CASE WHEN c.channel = k.channel THEN 3 ELSE 1 END) AS v FROM c CROSS JOIN k GROUP BY 1, 2),
f AS (SELECT *, v / sum(v) OVER (PARTITION BY sample) AS fit FROM f0), o AS (SELECT *, "count" / sum("count") OVER (PARTITION BY sample) AS obs FROM c), b AS (SELECT o.sample, o.channel, obs, fit FROM o JOIN f ON o.sample = f.sample AND o.channel = f.channel)
SELECT sample, channel, 'observed' AS which, round(obs, 6) AS value FROM b UNION ALL SELECT sample, channel, 'reconstructed', round(fit, 6) FROM b UNION ALL SELECT sample, channel, 'residual', round(obs - fit, 6) FROM b""")
def fig_reconstruction(spark, sf):
    c = counts(spark, sf)
    names = c.select("channel").distinct()
    signatures = names.select(F.col("channel").alias("signature")).crossJoin(names).withColumn("value", F.when(F.col("signature") == F.col("channel"), 3.0).otherwise(1.0))
    fit = c.select("sample", F.col("channel").alias("signature"), F.col("count").alias("value"))
    return figures.reconstruction(c, signatures, fit).select("sample", "channel", "which", (F.round("value", 6) + F.lit(0.0)).alias("value"))


@query("fig_exposure_stacked", f"WITH {_E} SELECT sample, signature, round(value / sum(value) OVER (PARTITION BY sample), 6) AS value FROM x")
def fig_exposure_stacked(spark, sf):
    return figures.profile(exposures(spark, sf), part="signature", value="value").select("sample", "signature", R6("value"))


@query("fig_riverplot", f"WITH {_E}, s AS (SELECT *, value / sum(value) OVER (PARTITION BY sample) AS v FROM x), h AS (SELECT *, sum(v) OVER (PARTITION BY sample ORDER BY signature ROWS UNBOUNDED PRECEDING) AS high FROM s) SELECT sample, signature, round(v, 6) AS value, abs(round(high - v, 6)) AS low, round(high, 6) AS high FROM h")
def fig_riverplot(spark, sf):
    return figures.alluvium(exposures(spark, sf)).select("sample", "signature", R6("value"), F.abs(F.round("low", 6)).alias("low"), R6("high"))


@query("fig_boot_ci", f"""WITH {_D}, s AS (SELECT sample, signature, avg(value) AS estimate, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS stability FROM d GROUP BY 1, 2)
SELECT sample, signature, round(estimate, 6) AS estimate, round(lo, 6) AS lo, round(hi, 6) AS hi, round(stability, 6) AS stability, CAST(row_number() OVER (PARTITION BY sample ORDER BY estimate DESC, signature) AS INTEGER) AS place FROM s WHERE estimate > 0 OR hi > 0""")
def fig_boot_ci(spark, sf):
    d = draws(spark, sf)
    mean = d.groupBy("sample", "signature").agg(F.avg("value").alias("value"))
    return figures.boot_intervals(d, mean).select("sample", "signature", R6("estimate"), R6("lo"), R6("hi"), R6("stability"), "place")


@query("fig_boot_distribution", f"WITH {_D}, r AS (SELECT *, min(value) OVER w AS lo, max(value) OVER w AS hi FROM d WINDOW w AS (PARTITION BY sample, signature)) SELECT sample, signature, CAST(CASE WHEN hi > lo THEN least(29, floor((value - lo) / (hi - lo) * 30)) ELSE 0 END AS BIGINT) AS bin, count(*) AS n FROM r GROUP BY 1, 2, 3")
def fig_boot_distribution(spark, sf):
    return figures.boot_histogram(draws(spark, sf))


@query("fig_boot_stability", f"WITH {_D}, s AS (SELECT sample, signature, avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS stability FROM d GROUP BY 1, 2) SELECT sample, signature, round(stability, 6) AS stability, stability >= 0.95 AS stable FROM s")
def fig_boot_stability(spark, sf):
    return figures.boot_stability(draws(spark, sf)).select("sample", "signature", R6("stability"), "stable")


_K = "k AS (SELECT CAST(p_size % 10 + 1 AS INTEGER) AS k, CAST(sum(p_retailprice) AS DOUBLE) AS deviance, avg(p_size / 60.0::DOUBLE) AS a, min(p_size / 60.0::DOUBLE) AS m FROM part GROUP BY 1)"


def ranks(spark, sf):
    size = F.col("p_size") / F.lit(60.0)
    return t(spark, sf, "part").groupBy((F.col("p_size") % 10 + 1).cast("int").alias("k")).agg(F.sum("p_retailprice").cast("double").alias("deviance"), F.avg(size).alias("avg_stability"), F.min(size).alias("min_stability"))


@query("fig_k_cv_curve", f"WITH {_K} SELECT k, round(deviance, 4) AS deviance, row_number() OVER (ORDER BY deviance, k) = 1 AS least FROM k")
def fig_k_cv_curve(spark, sf):
    return figures.rank_curve(ranks(spark, sf)).select("k", F.round("deviance", 4).alias("deviance"), "least")


@query("fig_k_stability", f"WITH {_K}, r AS (SELECT k, 'average' AS kind, a AS stability, 0.8::DOUBLE AS floor FROM k UNION ALL SELECT k, 'least', m, 0.2 FROM k) SELECT k, kind, round(stability, 6) AS stability, floor, stability < floor AS below FROM r")
def fig_k_stability(spark, sf):
    return figures.rank_stability(ranks(spark, sf)).select("k", "kind", R6("stability"), "floor", "below")


@query("fig_calibration_curve", "WITH s AS (SELECT o_orderstatus AS share, CAST(o_custkey % 4 AS INTEGER) AS n, avg(CASE WHEN o_orderkey % 17 > 0 THEN 1.0::DOUBLE ELSE 0 END) AS c, count(*) AS r FROM orders GROUP BY 1, 2) SELECT share, n, round(c, 6) AS coverage, round(sqrt(c * (1 - c) / r), 6) AS se, abs(c - 0.95) <= 0.05 AS inside FROM s")
def fig_calibration_curve(spark, sf):
    hits = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("share"), (F.col("o_custkey") % 4).cast("int").alias("n"), (F.col("o_orderkey") % 17 > 0).cast("int").alias("covered"))
    return figures.coverage_curve(hits).select("share", "n", R6("coverage"), R6("se"), "inside")


@query("fig_pseudosig_contribution", f"""WITH {_E}, p AS (SELECT sample, signature, CASE WHEN signature IN ('click', 'view', 'error', 'signup') THEN value / sum(value) OVER (PARTITION BY sample) ELSE 0 END AS share FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY share DESC, signature) AS i FROM p),
s AS (SELECT sample, sum(share) AS total, coalesce(string_agg(signature, ';' ORDER BY i) FILTER (i <= 2 AND share > 0), '') || CASE WHEN count(*) FILTER (share > 0) > 2 THEN ' +' || (count(*) FILTER (share > 0) - 2) ELSE '' END AS label FROM r GROUP BY 1)
SELECT sample, row_number() OVER (ORDER BY round(total, 9) DESC, sample) AS place, round(total, 6) AS artifact_share, label FROM s""")
def fig_pseudosig_contribution(spark, sf):
    parts = figures.profile(exposures(spark, sf), part="signature", value="value").select("sample", "signature", F.when(F.col("signature").isin("click", "view", "error", "signup"), F.col("value")).otherwise(0.0).alias("share"))
    return figures.contribution(parts, top=2).select("sample", "place", R6("artifact_share"), "label")


@query("fig_hypermutator_burden", 'WITH s AS (SELECT user_id AS sample, count(*) AS total FROM events GROUP BY 1), w AS (SELECT CAST(max(total) AS DOUBLE) / 29 AS width FROM s), b AS (SELECT CAST(floor(total / width) AS BIGINT) AS bin, total > 10 AS is_hyper, width FROM s CROSS JOIN w) SELECT bin, is_hyper, count(*) AS n, round(max(bin * width), 6) AS low FROM b GROUP BY 1, 2')
def fig_hypermutator_burden(spark, sf):
    s = events(spark, sf).groupBy(F.col("user_id").alias("sample")).agg(F.count(F.lit(1)).alias("total")).withColumn("is_hyper", F.col("total") > 10)
    return figures.burden_histogram(s).select("bin", "is_hyper", "n", R6("low"))


@query("fig_opportunity_distribution", "WITH s AS (SELECT 'A[' || CASE WHEN p_size % 2 = 0 THEN 'C>T' ELSE 'T>G' END || ']' || CAST(p_size % 7 AS VARCHAR) AS channel, sum(p_size) AS n FROM part GROUP BY 1) SELECT channel, substr(channel, 3, 3) AS kind, round(log10(n), 6) AS log10_n FROM s")
def fig_opportunity_distribution(spark, sf):
    name = F.concat(F.lit("A["), F.when(F.col("p_size") % 2 == 0, "C>T").otherwise("T>G"), F.lit("]"), (F.col("p_size") % 7).cast("string"))
    return figures.opportunity(t(spark, sf, "part").groupBy(name.alias("channel")).agg(F.sum("p_size").alias("n"))).select("channel", "kind", R6("log10_n"))
