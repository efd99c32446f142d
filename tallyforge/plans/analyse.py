"""Similarity, statistics, report and fitting queries on the supplied tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators import extraction, fitting, graph, reports, similarity, stats
from tallyforge.operators import numerics as N
from tallyforge.plans.classify import t
from tallyforge.sources import matrices, segments

Q: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    def keep(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


R6 = lambda c: F.round(c, 6)

# ---- signatures from the embeddings: label means of squares, as shares -------


def profiles(spark, sf, odd=None):
    """(id, channel, value): 64 channels for each of 10 labels; `odd` takes half of the vectors."""
    e = t(spark, sf, "embeddings")
    if odd is not None:
        e = e.where(F.col("vec_id") % 2 == odd)
    x = e.select("label", F.posexplode("embedding").alias("channel", "x")).withColumn("x", F.col("x").cast("double"))
    m = x.groupBy("label", "channel").agg(F.avg(F.col("x") * F.col("x")).alias("value"))
    return similarity.shares(m.withColumnRenamed("label", "id"), "id")


def _profiles(name, where=""):
    return f"""{name}0 AS (SELECT label AS id, unnest(range(0, len(embedding))) AS channel, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings {where}),
{name}1 AS (SELECT id, channel, avg(x * x) AS value FROM {name}0 GROUP BY 1, 2), {name} AS (SELECT id, channel, value / sum(value) OVER (PARTITION BY id) AS value FROM {name}1)"""


_PAIRS = f"""WITH {_profiles('e', 'WHERE vec_id % 2 = 0')}, {_profiles('r', 'WHERE vec_id % 2 = 1')},
b AS (SELECT e.id AS est, r.id AS ref, e.value AS p, r.value AS q FROM e JOIN r ON e.channel = r.channel),
m AS (SELECT est, ref, sum(p * q) / sqrt(sum(p * p) * sum(q * q)) AS cosine, corr(p, q) AS correlation,
sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)) AS jsd,
sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))) / 2) AS hellinger FROM b GROUP BY 1, 2)"""


def pairs(spark, sf):
    return similarity.pairwise(profiles(spark, sf, 0), profiles(spark, sf, 1))


def _metric(name):
    @query(f"sim_{name}", f"{_PAIRS} SELECT est, ref, round({name}, 6) AS {name} FROM m")
    def run(spark, sf, name=name):
        return pairs(spark, sf).select("est", "ref", R6(name).alias(name))


for _m in ("cosine", "correlation", "jsd", "hellinger"):
    _metric(_m)

TAUS = [0.80, 0.82, 0.84, 0.86, 0.88, 0.90, 0.95, 0.97, 0.98, 0.985, 0.99]


@query("islam_sweep", f"{_PAIRS}, x AS (SELECT est, max(cosine) AS best FROM m GROUP BY 1) SELECT k.threshold, CAST(count(*) FILTER (best >= k.threshold) AS BIGINT) AS matched, count(*) AS total, round(count(*) FILTER (best >= k.threshold) / CAST(count(*) AS DOUBLE), 6) AS share FROM x CROSS JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in TAUS)}) k(threshold) GROUP BY 1")
def islam_sweep(spark, sf):
    return similarity.greedy_sweep(pairs(spark, sf), TAUS).withColumn("share", R6("share"))


@query("top_two_matches", f"{_PAIRS}, k AS (SELECT *, row_number() OVER (PARTITION BY est ORDER BY cosine DESC, ref) AS i FROM m) SELECT est, max(ref) FILTER (i = 1) AS first, round(max(cosine) FILTER (i = 1), 6) AS first_cosine, max(ref) FILTER (i = 2) AS second, round(max(cosine) FILTER (i = 2), 6) AS second_cosine FROM k GROUP BY 1")
def top_two_matches(spark, sf):
    return similarity.top_two(pairs(spark, sf)).withColumns({"first_cosine": R6("first_cosine"), "second_cosine": R6("second_cosine")})


#: The assignment of the ten signatures in SQL: the best total for each set of references taken, one signature more at a time.
_BEST = f"{_PAIRS}, d0 AS (SELECT 0 AS mask, CAST(0 AS DOUBLE) AS total, CAST([] AS INTEGER[]) AS refs), " + ", ".join(
    f"d{k + 1} AS (SELECT d.mask | (1 << m.ref) AS mask, max(d.total + m.cosine) AS total, arg_max(list_append(d.refs, CAST(m.ref AS INTEGER)), d.total + m.cosine) AS refs FROM d{k} d JOIN m ON m.est = {k} AND d.mask & (1 << m.ref) = 0 GROUP BY 1)"
    for k in range(10)
) + ", o AS (SELECT m.est, m.ref, m.cosine FROM d10 JOIN m ON d10.refs[m.est + 1] = m.ref)"


@query("threshold_sweep", f"{_BEST} SELECT k.threshold, CAST(count(*) FILTER (cosine >= k.threshold) AS BIGINT) AS tp, CAST(count(*) FILTER (cosine < k.threshold) AS BIGINT) AS fp, CAST(10 - count(*) FILTER (cosine >= k.threshold) AS BIGINT) AS fn FROM o CROSS JOIN (VALUES {', '.join(f'(CAST({x} AS DOUBLE))' for x in TAUS)}) k(threshold) GROUP BY 1")
def threshold_sweep(spark, sf):
    own = pairs(spark, sf).select("est", "ref", "cosine").join(F.broadcast(hungarian_match(spark, sf).select("est", "ref")), ["est", "ref"])
    k = F.broadcast(spark.createDataFrame([(x,) for x in TAUS], "threshold double"))
    hit = F.count_if(F.col("cosine") >= F.col("threshold"))
    return own.crossJoin(k).groupBy("threshold").agg(hit.alias("tp"), F.count_if(F.col("cosine") < F.col("threshold")).alias("fp"), (F.lit(10) - hit).alias("fn"))


@query("hungarian_match", f"{_BEST} SELECT CAST(est AS INTEGER) AS est, CAST(ref AS INTEGER) AS ref, round(cosine, 6) AS cosine FROM o")
def hungarian_match(spark, sf):
    rows = pairs(spark, sf).collect()  # signatures x signatures
    est, ref = sorted({r.est for r in rows}), sorted({r.ref for r in rows})
    cost = np.array([[1 - next(r.cosine for r in rows if (r.est, r.ref) == (a, b)) for b in ref] for a in est])
    best = N.hungarian(cost)
    return spark.createDataFrame([(a, ref[j], round(float(1 - cost[i, j]), 6)) for i, (a, j) in enumerate(zip(est, best))], "est int, ref int, cosine double")


@query("cluster_components", f"""WITH RECURSIVE {_profiles('p')}, c AS (SELECT a.id AS a, b.id AS b, sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) AS s FROM p a JOIN p b ON a.channel = b.channel GROUP BY 1, 2),
w(a, b) AS (SELECT a, b FROM c WHERE s >= 0.975 UNION SELECT w.a, c.b FROM w JOIN c ON w.b = c.a AND c.s >= 0.975), g AS (SELECT a AS id, min(b) AS root FROM w GROUP BY 1),
k AS (SELECT root, count(*) AS n, dense_rank() OVER (ORDER BY count(*) DESC, root) AS cluster FROM g GROUP BY 1),
m AS (SELECT x.id, x.root, avg(c.s) AS mean FROM g x JOIN g y ON x.root = y.root JOIN c ON c.a = x.id AND c.b = y.id GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY round(mean, 9) DESC, id) = 1 AS medoid FROM m)
SELECT o.id, k.cluster, k.n AS size, o.medoid FROM o JOIN k ON o.root = k.root""")
def cluster_components(spark, sf):
    p = profiles(spark, sf)
    c = similarity.pairwise(p, p).select(F.col("est").alias("a"), F.col("ref").alias("b"), F.col("cosine").alias("s"))
    c = graph.written(c)
    joined = graph.components(c.where("s >= 0.975"))
    label = c.select(F.col("a").alias("id")).distinct().join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    groups = label.groupBy("root").agg(F.count(F.lit(1)).alias("size")).withColumn("cluster", F.dense_rank().over(Window.orderBy(F.col("size").desc(), "root")).cast("bigint"))
    x, y = label, label.select(F.col("id").alias("b"), "root")
    mean = x.join(y, "root").join(c.withColumnRenamed("a", "id"), ["id", "b"]).groupBy("id", "root").agg(F.avg("s").alias("mean"))
    medoid = F.row_number().over(Window.partitionBy("root").orderBy(F.round("mean", 9).desc(), "id")) == 1
    return mean.withColumn("medoid", medoid).join(groups, "root").select("id", "cluster", "size", "medoid")


@query("silhouette_cosine", f"""WITH v AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS c, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
n AS (SELECT vec_id, label, c, x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) AS x FROM v),
d AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, b.vec_id AS j, 1 - sum(a.x * b.x) AS d FROM n a JOIN n b ON a.c = b.c WHERE a.vec_id <> b.vec_id GROUP BY 1, 2, 3, 4),
m AS (SELECT i, li, lj, avg(d) AS d FROM d GROUP BY 1, 2, 3), s AS (SELECT i, li, max(d) FILTER (li = lj) AS a, min(d) FILTER (li <> lj) AS b FROM m GROUP BY 1, 2)
SELECT i AS vec_id, round(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS silhouette FROM s""")
def silhouette_cosine(spark, sf):
    """Silhouettes of all vectors: a unit vector's mean distance to a label is 1 less its product with the label's mean, so no pairs are made."""
    v = t(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("c", "x")).withColumn("x", F.col("x").cast("double"))
    n = v.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("vec_id"))))
    sums = n.groupBy(F.col("label").alias("lj"), "c").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("m"))
    met = n.join(sums, "c").groupBy(F.col("vec_id").alias("i"), F.col("label").alias("li"), "lj").agg(F.sum(F.col("x") * F.col("s")).alias("p"), F.max("m").alias("m"))
    own = F.col("li") == F.col("lj")
    # a vector's product with itself is 1
    d = met.withColumn("d", 1 - F.when(own, F.try_divide(F.col("p") - 1, F.col("m") - 1)).otherwise(F.col("p") / F.col("m")))
    s = d.groupBy("i").agg(F.max(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.col("d"))).alias("b"))
    return s.select(F.col("i").alias("vec_id"), R6(F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("silhouette"))


@query("opportunity_convert", """WITH s AS (SELECT p_type AS id, p_brand AS channel, CAST(count(*) AS DOUBLE) AS value FROM part GROUP BY 1, 2), o AS (SELECT p_brand AS channel, sum(CAST(p_size AS DOUBLE)) AS f, CAST(count(*) AS DOUBLE) + 1 AS g FROM part GROUP BY 1),
r AS (SELECT s.id, s.channel, s.value * o.g / o.f AS raw FROM s JOIN o ON s.channel = o.channel) SELECT id, channel, round(raw / sum(raw) OVER (PARTITION BY id), 6) AS value FROM r""")
def opportunity_convert(spark, sf):
    p = t(spark, sf, "part")
    s = p.groupBy(F.col("p_type").alias("id"), F.col("p_brand").alias("channel")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    o = p.groupBy(F.col("p_brand").alias("channel")).agg(F.sum(F.col("p_size").cast("double")).alias("from"), (F.count(F.lit(1)).cast("double") + 1).alias("to"))
    return similarity.opportunity_converted(s, o).withColumn("value", R6("value"))


@query("jiang_scores", """WITH a AS (SELECT user_id AS sample, event_type AS signature, count(*) FILTER (event_id % 2 = 0) AS x, count(*) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY 1, 2),
g AS (SELECT sample, signature, CASE WHEN x >= 7 THEN x ELSE 0 END AS t, CASE WHEN y >= 7 THEN y ELSE 0 END AS f FROM a),
s AS (SELECT sample, count(*) FILTER (t > 0 AND f > 0) AS tp, count(*) FILTER (t = 0 AND f > 0) AS fp, count(*) FILTER (t > 0 AND f = 0) AS fn, count(*) FILTER (t = 0 AND f = 0) AS tn, sum(abs(t - f)) AS gap, sum(t) AS total FROM g GROUP BY 1)
SELECT sample, tp, fp, fn, tn, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS "precision", round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity, round(CAST(gap AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 6) AS manhattan FROM s""")
def jiang_scores(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("signature")).agg(F.count_if(F.col("event_id") % 2 == 0).alias("x"), F.count_if(F.col("event_id") % 2 == 1).alias("y"))
    cut = lambda c: F.when(F.col(c) >= 7, F.col(c)).otherwise(0).cast("double").alias("exposure")
    out = similarity.activity_scores(e.select("sample", "signature", cut("x")), e.select("sample", "signature", cut("y")))
    return out.select("sample", "tp", "fp", "fn", "tn", *[R6(c).alias(c) for c in ("precision", "recall", "specificity", "manhattan")])


# ---- statistics ---------------------------------------------------------------


@query("bh_adjust", """WITH p AS (SELECT o_orderstatus AS family, o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN (o_custkey * 37 + o_orderkey * 101) % 9973 / 9973.0 END AS p FROM orders),
r AS (SELECT *, CAST(p AS DOUBLE) * count(p) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p NULLS LAST, id) AS raw FROM p)
SELECT family, id, round(CASE WHEN p IS NOT NULL THEN least(1.0, min(raw) OVER (PARTITION BY family ORDER BY p NULLS LAST, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END, 6) AS q FROM r""")
def bh_adjust(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    p = F.when(k % 11 != 0, ((c * 37 + k * 101) % 9973).cast("double") / 9973.0)
    rows = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("family"), k.alias("id"), p.alias("p"))
    return stats.bh_adjusted(rows, ["family"]).select("family", "id", R6("q").alias("q"))


@query("rank_sum", """WITH e AS (SELECT event_type AS family, round(value, 0) AS v, user_id % 2 = 0 AS f FROM events),
r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY v) + (count(*) OVER (PARTITION BY family, v) - 1) / 2.0 AS r, CAST(count(*) OVER (PARTITION BY family, v) AS DOUBLE) AS tt FROM e),
s AS (SELECT family, CAST(count(*) FILTER (f) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT f) AS DOUBLE) AS n2, sum(r) FILTER (f) AS rs, sum(tt * tt - 1) AS tie FROM r GROUP BY 1)
SELECT family, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(rs - n1 * (n1 + 1) / 2, 3) AS w, round((rs - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1)))), 6) AS z FROM s""")
def rank_sum(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_type").alias("family"), F.round("value", 0).alias("v"), "user_id")
    return stats.rank_sums(e, ["family"], "v", F.col("user_id") % 2 == 0).select("family", "n1", "n2", F.round("w", 3).alias("w"), R6("z").alias("z"))


@query("signed_rank", """WITH d AS (SELECT event_type AS family, round(value, 0) - 50 - user_id % 3 AS d FROM events), n AS (SELECT * FROM d WHERE d <> 0),
r AS (SELECT family, d, rank() OVER (PARTITION BY family ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, abs(d)) - 1) / 2.0 AS r FROM n)
SELECT family, count(*) AS n, round(sum(r) FILTER (d > 0), 3) AS w_plus, round(sum(r) FILTER (d < 0), 3) AS w_minus FROM r GROUP BY 1""")
def signed_rank(spark, sf):
    d = t(spark, sf, "events").select(F.col("event_type").alias("family"), (F.round("value", 0) - 50 - F.col("user_id") % 3).alias("d")).where("d <> 0").withColumn("a", F.abs("d"))
    r = d.withColumn("r", F.rank().over(Window.partitionBy("family").orderBy("a")) + (F.count(F.lit(1)).over(Window.partitionBy("family", "a")) - 1) / 2.0)
    return r.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(F.col("d") > 0, F.col("r"))), 3).alias("w_plus"), F.round(F.sum(F.when(F.col("d") < 0, F.col("r"))), 3).alias("w_minus"))


_CAT = "c AS (SELECT user_id AS sample, event_type AS channel, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2)"


def catalog(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("channel")).agg(F.count(F.lit(1)).alias("n"))


@query("fold_mask", f"WITH {_CAT}, r AS (SELECT *, dense_rank() OVER (ORDER BY channel) AS i FROM c) SELECT fold, CAST(count(*) FILTER ((i - sample - fold) % 5 = 0) AS BIGINT) AS held, CAST(sum(n) FILTER ((i - sample - fold) % 5 = 0) AS BIGINT) AS events FROM r CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) GROUP BY 1")
def fold_mask(spark, sf):
    c = catalog(spark, sf)
    order = c.select("channel").distinct().withColumn("i", F.dense_rank().over(Window.orderBy("channel")))  # channels only
    rows = c.join(F.broadcast(order), "channel").crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "fold")))
    hold = F.pmod(F.col("i") - F.col("sample") - F.col("fold"), F.lit(5)) == 0
    return rows.groupBy("fold").agg(F.count_if(hold).alias("held"), F.sum(F.when(hold, F.col("n"))).alias("events"))


@query("impute_median", f"WITH {_CAT}, m AS (SELECT *, sample % 4 = 0 AS held FROM c), d AS (SELECT channel, median(n) FILTER (NOT held) AS med FROM m GROUP BY 1) SELECT m.sample, m.channel, round(greatest(CASE WHEN held THEN med ELSE n END, 0.0001), 6) AS value FROM m JOIN d ON m.channel = d.channel")
def impute_median(spark, sf):
    m = catalog(spark, sf).withColumn("held", F.col("sample") % 4 == 0)
    med = m.groupBy("channel").agg(F.median(F.when(~F.col("held"), F.col("n"))).alias("med"))
    return m.join(F.broadcast(med), "channel").select("sample", "channel", R6(F.greatest(F.when(F.col("held"), F.col("med")).otherwise(F.col("n").cast("double")), F.lit(1e-4))).alias("value"))


@query("percentile_ci", "SELECT event_type, round(quantile_cont(value, 0.025), 6) AS lower, round(median(value), 6) AS middle, round(quantile_cont(value, 0.975), 6) AS upper FROM events GROUP BY 1")
def percentile_ci(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(R6(F.percentile("value", 0.025)).alias("lower"), R6(F.median("value")).alias("middle"), R6(F.percentile("value", 0.975)).alias("upper"))


@query("median_mad", "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT e.event_type, round(any_value(m.m), 6) AS middle, round(median(abs(e.value - m.m)), 6) AS mad, round(avg(e.value), 6) AS mean, round(stddev_pop(e.value), 6) AS sd FROM events e JOIN m ON e.event_type = m.event_type GROUP BY 1")
def median_mad(spark, sf):
    e = t(spark, sf, "events")
    m = e.groupBy("event_type").agg(F.median("value").alias("m"))
    return e.join(F.broadcast(m), "event_type").groupBy("event_type").agg(R6(F.first("m")).alias("middle"), R6(F.median(F.abs(F.col("value") - F.col("m")))).alias("mad"), R6(F.avg("value")).alias("mean"), R6(F.stddev_pop("value")).alias("sd"))


@query("batch_means_se", "WITH b AS (SELECT event_type, event_id % 20 AS batch, avg(value) AS m FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS batches, round(stddev_samp(m) / sqrt(20), 6) AS se FROM b GROUP BY 1")
def batch_means_se(spark, sf):
    b = t(spark, sf, "events").groupBy("event_type", F.col("event_id") % 20).agg(F.avg("value").alias("m"))
    return b.groupBy("event_type").agg(F.count(F.lit(1)).alias("batches"), R6(F.stddev_samp("m") / F.sqrt(F.lit(20.0))).alias("se"))


@query("coverage_verdict", """WITH r AS (SELECT user_id % 8 AS cell, (event_id * 7919) % 1000 < 935 + (user_id % 8) * 8 AS hit FROM events), s AS (SELECT cell, count(*) AS m, count(*) FILTER (hit) AS k FROM r GROUP BY 1)
SELECT cell, m, k, round(k / CAST(m AS DOUBLE), 6) AS coverage, round(sqrt(k / CAST(m AS DOUBLE) * (1 - k / CAST(m AS DOUBLE)) / m), 6) AS se, k / CAST(m AS DOUBLE) BETWEEN 0.93 AND 0.97 AS inside FROM s""")
def coverage_verdict(spark, sf):
    hit = (F.col("event_id") * 7919) % 1000 < 935 + (F.col("user_id") % 8) * 8
    s = t(spark, sf, "events").groupBy((F.col("user_id") % 8).alias("cell")).agg(F.count(F.lit(1)).alias("m"), F.count_if(hit).alias("k"))
    p = F.col("k") / F.col("m")
    return s.select("cell", "m", "k", R6(p).alias("coverage"), R6(F.sqrt(p * (1 - p) / F.col("m"))).alias("se"), p.between(0.93, 0.97).alias("inside"))


_U = "CAST(concat('0x', substring(md5({}), 1, 8)) AS BIGINT)".format


@query("multinomial_resample", f"""WITH {_CAT}, l AS (SELECT sample, channel, sum(n) OVER (PARTITION BY sample ORDER BY channel) AS hi, n, sum(n) OVER (PARTITION BY sample) AS total FROM c),
t AS (SELECT DISTINCT sample, total FROM l), d AS (SELECT sample, floor({_U("'7:' || sample || ':' || draw")} / 4294967296.0 * total) AS at FROM t CROSS JOIN (SELECT unnest(range(0, 60)) AS draw))
SELECT d.sample, l.channel, count(*) AS drawn FROM d JOIN l ON d.sample = l.sample AND d.at >= l.hi - l.n AND d.at < l.hi GROUP BY 1, 2""")
def multinomial_resample(spark, sf):
    c = catalog(spark, sf)
    draws = c.select("sample").distinct().crossJoin(F.broadcast(spark.range(60).withColumnRenamed("id", "draw")))
    return stats.multinomial(c, draws, 7)


@query("downsample", f"""WITH {_CAT}, l AS (SELECT sample, channel, sum(n) OVER (PARTITION BY sample ORDER BY channel) AS hi, n, sum(n) OVER (PARTITION BY sample) AS total FROM c),
t AS (SELECT DISTINCT sample, total FROM l), m AS (SELECT min(total) AS depth FROM t WHERE total > 0), d AS (SELECT sample, floor({_U("'11:' || sample || ':' || draw")} / 4294967296.0 * total) AS at FROM t, m, LATERAL (SELECT unnest(range(0, CAST(m.depth AS BIGINT))) AS draw) WHERE total > m.depth),
r AS (SELECT d.sample, l.channel, count(*) AS n FROM d JOIN l ON d.sample = l.sample AND d.at >= l.hi - l.n AND d.at < l.hi GROUP BY 1, 2)
SELECT sample, channel, n FROM r UNION ALL SELECT c.sample, c.channel, c.n FROM c JOIN t ON c.sample = t.sample CROSS JOIN m WHERE t.total <= m.depth""")
def downsample(spark, sf):
    c = catalog(spark, sf)
    total = c.groupBy("sample").agg(F.sum("n").alias("total"))
    depth = total.where("total > 0").agg(F.min("total")).first()[0]
    deep = total.where(F.col("total") > depth).select("sample")
    draws = deep.select("sample", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("draw"))
    drawn = stats.multinomial(c.join(deep, "sample"), draws, 11).withColumnRenamed("drawn", "n")
    return drawn.unionByName(c.join(deep, "sample", "left_anti").select("sample", "channel", "n"))


@query("dirichlet_draws", f"WITH d AS (SELECT k, j, -ln(({_U("'3:' || k || ':' || j")} + 0.5) / 4294967296.0) AS g FROM (SELECT unnest(range(0, 50)) AS k), (SELECT unnest(range(0, 6)) AS j)) SELECT k, j, round(g / sum(g) OVER (PARTITION BY k), 6) AS value FROM d")
def dirichlet_draws(spark, sf):
    d = spark.range(300).select(F.floor(F.col("id") / 6).alias("k"), (F.col("id") % 6).alias("j"))
    g = -F.log((stats.uniform(F.concat_ws(":", F.lit("3"), F.col("k").cast("string"), F.col("j").cast("string"))).cast("double") + 0.5) / 4294967296.0)
    return similarity.shares(d.withColumn("value", g), "k").select("k", "j", R6("value").alias("value"))


@query("running_median", """WITH s AS (SELECT o_orderstatus AS g, o_orderkey AS id, o_totalprice AS v FROM orders), w AS (SELECT g, id, list(v) OVER (PARTITION BY g ORDER BY id ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS l FROM s)
SELECT g, id, round(list_sort(list_concat(l, list_resize(CAST([] AS DOUBLE[]), 25 - len(l), 0.0::DOUBLE)))[13], 4) AS run_median FROM w""")
def running_median(spark, sf):
    s = t(spark, sf, "orders").select(F.col("o_orderstatus").alias("g"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    return stats.running_median(s, ["g"], ["id"], "v").select("g", "id", F.round("run_median", 4).alias("run_median"))


@query("breakpoint_distance", "WITH p AS (SELECT l_suppkey % 20 AS sample, l_returnflag AS chrom, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS pos, l_orderkey * 1000 + l_partkey AS row FROM lineitem), g AS (SELECT sample, chrom, greatest(pos - lag(pos, 1, 0) OVER (PARTITION BY sample, chrom ORDER BY pos, row), 1) AS gap FROM p) SELECT sample, chrom, CAST(sum(gap) AS BIGINT) AS total, CAST(max(gap) AS BIGINT) AS widest, count(*) AS n FROM g GROUP BY 1, 2")
def breakpoint_distance(spark, sf):
    return segments.breakpoint_gaps(points(spark, sf), ["sample", "chrom"]).groupBy("sample", "chrom").agg(F.sum("gap").cast("bigint").alias("total"), F.max("gap").cast("bigint").alias("widest"), F.count(F.lit(1)).alias("n"))


def points(spark, sf):
    return t(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("sample"), F.col("l_returnflag").alias("chrom"), F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")).cast("bigint").alias("pos"), (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("row"))


@query("breakpoint_clusters")
def breakpoint_clusters(spark, sf):
    return segments.clustered(points(spark, sf), ["sample", "chrom"]).groupBy("sample", "chrom").agg(F.count_if("hot").alias("hot"), F.count(F.lit(1)).alias("n"))


@query("monotone_scan", f"WITH s AS (SELECT user_id AS g, event_id AS n, value AS s FROM events), d AS (SELECT g, s < lag(s) OVER (PARTITION BY g ORDER BY n) AS inv FROM s) SELECT g, CAST(count(*) FILTER (inv) AS BIGINT) AS inversions, count(*) AS n FROM d GROUP BY 1")
def monotone_scan(spark, sf):
    e = t(spark, sf, "events")
    inv = F.col("value") < F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.select(F.col("user_id").alias("g"), F.coalesce(inv, F.lit(False)).alias("inv")).groupBy("g").agg(F.count_if("inv").alias("inversions"), F.count(F.lit(1)).alias("n"))


@query("empirical_null", f"{_PAIRS}, d AS (SELECT k, {_U("'5:' || k")} / 4294967296.0 AS x FROM (SELECT unnest(range(0, 2000)) AS k)), h AS (SELECT est, ref, (1 + count(*) FILTER (d.x >= m.cosine)) / CAST(2001 AS DOUBLE) AS p FROM m CROSS JOIN d GROUP BY 1, 2), z AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, est, ref) AS raw FROM h) SELECT est, ref, round(p, 6) AS p, round(least(1.0, min(raw) OVER (ORDER BY p, est, ref ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM z")
def empirical_null(spark, sf):
    m = pairs(spark, sf).select("est", "ref", "cosine")
    d = spark.range(2000).select((stats.uniform(F.concat_ws(":", F.lit("5"), F.col("id").cast("string"))).cast("double") / 4294967296.0).alias("x"))
    hit = m.crossJoin(F.broadcast(d)).groupBy("est", "ref").agg(((F.count_if(F.col("x") >= F.col("cosine")) + 1) / F.lit(2001.0)).alias("p"))
    rows = hit.withColumn("all", F.lit(1)).withColumn("id", F.struct("est", "ref"))
    return stats.bh_adjusted(rows, ["all"]).select("est", "ref", R6("p").alias("p"), R6("q").alias("q"))


# ---- reports --------------------------------------------------------------------


@query("qc_report", """WITH c AS (SELECT o_custkey AS sample, o_orderpriority AS channel, CAST(count(*) AS DOUBLE) * 13 AS n FROM orders GROUP BY 1, 2), s AS (SELECT sample, sum(n) AS total, sum(CASE WHEN channel LIKE '1-%' THEN n ELSE 0 END) AS ca, sum(CASE WHEN channel LIKE '5-%' THEN n ELSE 0 END) AS ct FROM c GROUP BY 1),
b AS (SELECT *, CASE WHEN total = 0 THEN 'dead' WHEN total < 100 THEN 'low' WHEN total < 10000 THEN 'standard' ELSE 'high' END AS burden FROM s)
SELECT sample, total, round(log10(total), 6) AS log10_total, burden, round(ca / total, 6) AS share_ca, round(ct / total, 6) AS share_ct, CASE WHEN ca / total >= 0.3 THEN 'artifact' WHEN ct / total >= 0.4 OR burden = 'low' THEN 'watch' ELSE 'ok' END AS flag FROM b""")
def qc_report(spark, sf):
    c = t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("sample"), F.col("o_orderpriority").alias("channel")).agg((F.count(F.lit(1)).cast("double") * 13).alias("count"))
    return reports.qc_report(c, "1-%", "5-%").withColumns({k: R6(k) for k in ("log10_total", "share_ca", "share_ct")})


@query("qc_burden", "WITH s AS (SELECT user_id AS sample, count(*) AS total FROM events GROUP BY 1) SELECT CASE WHEN total < 100 THEN 'low' WHEN total < 10000 THEN 'standard' ELSE 'high' END AS burden, count(*) AS samples, CAST(sum(total) AS BIGINT) AS events FROM s GROUP BY 1")
def qc_burden(spark, sf):
    s = t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return s.groupBy(reports.burden_class(F.col("total")).alias("burden")).agg(F.count(F.lit(1)).alias("samples"), F.sum("total").alias("events"))


@query("roster_share", "WITH e AS (SELECT user_id AS sample, 'SBS' || (event_id % 7) || CASE WHEN event_id % 2 = 0 THEN 'a' ELSE '' END AS signature, value FROM events) SELECT sample, round(sum(CASE WHEN regexp_extract(signature, '^(SBS[0-9]+).*$', 1) IN ('SBS1', 'SBS5') THEN value ELSE 0 END) / sum(value), 6) AS share FROM e GROUP BY 1")
def roster_share(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("sample"), F.concat(F.lit("SBS"), F.col("event_id") % 7, F.when(F.col("event_id") % 2 == 0, "a").otherwise("")).alias("signature"), "value")
    known = F.regexp_extract("signature", "^(SBS[0-9]+).*$", 1).isin("SBS1", "SBS5")
    return e.groupBy("sample").agg(R6(F.sum(F.when(known, F.col("value")).otherwise(0.0)) / F.sum("value")).alias("share"))


ARMS = [(str(c), a, s, e) for c in range(1, 6) for a, s, e in (("p", 1, 400_000), ("q", 400_001, 1_000_000))]
_SEG = """s AS (SELECT l_suppkey % 30 AS sample, 'chr' || CASE WHEN l_orderkey % 6 = 5 THEN 'X' ELSE CAST(1 + l_orderkey % 6 AS VARCHAR) END AS chromosome, CASE WHEN l_suppkey % 2 = 0 AND l_orderkey % 97 = 0 THEN 1 ELSE CAST(l_partkey % 2000 * 400 + 1 AS BIGINT) END AS start,
CASE WHEN l_suppkey % 2 = 0 AND l_orderkey % 97 = 0 THEN 1000000 ELSE CAST(l_partkey % 2000 * 400 + l_quantity * 4000 AS BIGINT) END AS "end", CASE WHEN l_linenumber < 7 THEN CAST(l_linenumber % 5 AS INTEGER) END AS state, CASE WHEN l_orderkey % 13 > 0 THEN CAST(l_linenumber % 3 AS INTEGER) END AS minor_cn FROM lineitem)"""
_ARMS = "a(chromosome, arm, s0, e0) AS (VALUES " + ", ".join(f"('chr{c}','{a}',{s},{e})" for c, a, s, e in ARMS) + ")"
_PLOH = "p AS (SELECT sample, CAST(sum(CASE WHEN chromosome <> 'chrX' AND state >= 1 AND minor_cn IS NOT NULL AND least(state - minor_cn, minor_cn) = 0 THEN \"end\" - start + 1 ELSE 0 END) AS DOUBLE) / 50000000.0 AS ploh FROM s GROUP BY 1)"
_ANEU = """w AS (SELECT sample, chromosome, bool_or(start <= 1 AND "end" >= 1000000) AS whole FROM s WHERE state IS NOT NULL GROUP BY 1, 2),
b AS (SELECT s.sample, s.chromosome, sum(state * CASE WHEN whole THEN CAST(0.5 AS DOUBLE) ELSE CAST(least("end", e0) - greatest(start, s0) + 1 AS DOUBLE) / (e0 - s0 + 1) END) AS total FROM s JOIN w ON s.sample = w.sample AND s.chromosome = w.chromosome JOIN a ON s.chromosome = a.chromosome AND start <= e0 AND "end" >= s0 WHERE state IS NOT NULL GROUP BY 1, 2),
c AS (SELECT sample, count(*) FILTER (round_even(round(total - 2, 9), 0) <> 0) AS n FROM b GROUP BY 1), n AS (SELECT d.sample, CAST(coalesce(c.n, 0) AS DOUBLE) AS aneuploidy FROM (SELECT DISTINCT sample FROM s) d LEFT JOIN c ON d.sample = c.sample)"""


def hrd_inputs(spark, sf):
    p, key = F.col("l_partkey") % 2000, F.col("l_orderkey")
    whole = (F.col("l_suppkey") % 2 == 0) & (key % 97 == 0)
    s = t(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 30).alias("sample"), F.concat(F.lit("chr"), F.when(key % 6 == 5, "X").otherwise((1 + key % 6).cast("string"))).alias("chromosome"),
        F.when(whole, 1).otherwise(p * 400 + 1).cast("bigint").alias("start"), F.when(whole, 1_000_000).otherwise(p * 400 + F.col("l_quantity") * 4000).cast("bigint").alias("end"),
        F.when(F.col("l_linenumber") < 7, F.col("l_linenumber") % 5).alias("state"), F.when(key % 13 > 0, F.col("l_linenumber") % 3).alias("minor_cn"),
    )
    return s, spark.createDataFrame(ARMS, "chromosome string, arm string, arm_start long, arm_end long")


@query("hrd_ploh", f"WITH {_SEG}, {_PLOH} SELECT sample, round(ploh, 6) AS ploh FROM p")
def hrd_ploh(spark, sf):
    return reports.ploh(hrd_inputs(spark, sf)[0], 50_000_000).withColumn("ploh", R6("ploh"))


@query("hrd_aneuploidy", f"WITH {_SEG}, {_ARMS}, {_ANEU} SELECT * FROM n")
def hrd_aneuploidy(spark, sf):
    return reports.aneuploidy(*hrd_inputs(spark, sf))


@query("hrd_composite", f"WITH {_SEG}, {_ARMS}, {_PLOH}, {_ANEU} SELECT p.sample, round(ploh, 6) AS ploh, aneuploidy, CAST(ploh >= 0.4 AND aneuploidy >= 4 AS INTEGER) AS hrd FROM p LEFT JOIN n ON p.sample = n.sample")
def hrd_composite(spark, sf):
    return reports.hrd_report(*hrd_inputs(spark, sf), 50_000_000, "ASCAT").withColumn("ploh", R6("ploh"))


@query("treatment_contrast", f"""WITH v AS (SELECT c_custkey AS sample, 'S' || (c_nationkey % 4) AS signature, draw, c_acctbal + ({_U("'9:' || c_custkey || ':' || draw")} % 1000) AS value, c_mktsegment = 'BUILDING' AS exposed FROM customer CROSS JOIN (SELECT unnest(range(0, 40)) AS draw)),
d AS (SELECT signature, draw, avg(value) FILTER (exposed) - avg(value) FILTER (NOT exposed) AS d FROM v GROUP BY 1, 2), n AS (SELECT signature, count(DISTINCT sample) FILTER (exposed) AS n_exposed, count(DISTINCT sample) FILTER (NOT exposed) AS n_unexposed FROM v GROUP BY 1),
e AS (SELECT signature, avg(d) AS difference, quantile_cont(d, 0.025) AS lower, quantile_cont(d, 0.975) AS upper FROM d GROUP BY 1)
SELECT n.signature, n_exposed, n_unexposed, round(difference, 4) AS difference, round(lower, 4) AS lower, round(upper, 4) AS upper, lower > 50 OR upper < -50 AS associated FROM n JOIN e ON n.signature = e.signature""")
def treatment_contrast(spark, sf):
    c = t(spark, sf, "customer")
    draws = F.broadcast(spark.range(40).withColumnRenamed("id", "draw"))
    u = stats.uniform(F.concat_ws(":", F.lit("9"), F.col("c_custkey").cast("string"), F.col("draw").cast("string")))
    v = c.crossJoin(draws).select(F.col("c_custkey").alias("sample"), F.concat(F.lit("S"), F.col("c_nationkey") % 4).alias("signature"), "draw", (F.col("c_acctbal") + u % 1000).alias("value"))
    out = reports.contrast(v, c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("sample")))
    return out.withColumns({k: F.round(k, 4) for k in ("difference", "lower", "upper")})


@query("artifact_topn", "WITH e AS (SELECT user_id AS sample, event_type AS channel, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, channel) AS i, count(*) OVER (PARTITION BY sample) AS n FROM e) SELECT sample, string_agg(channel, ',' ORDER BY i) FILTER (i <= 3) AS top, CAST(greatest(max(n) - 3, 0) AS BIGINT) AS more FROM r GROUP BY 1")
def artifact_topn(spark, sf):
    e = t(spark, sf, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("channel")).agg(stats.exact_sum("value").alias("v"))
    r = e.withColumn("i", F.row_number().over(Window.partitionBy("sample").orderBy(F.col("v").desc(), "channel"))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("sample")))
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("i") <= 3, F.struct("i", "channel")))), lambda x: x["channel"]), ",")
    return r.groupBy("sample").agg(names.alias("top"), F.greatest(F.max("n") - 3, F.lit(0)).alias("more"))


@query("currency_verdict", """WITH r AS (SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 17 <> 0 THEN p_size % 5 END AS version, p_size % 6 AS latest, p_brand AS digest FROM part), c AS (SELECT CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE p_brand END AS cached_digest, p_partkey % 13 <> 0 AS ok FROM part WHERE p_partkey % 3 <> 0)
SELECT CASE WHEN version IS NULL THEN 'inconsistent' WHEN ok = false THEN 'corrupt' WHEN cached_digest IS NULL THEN 'no-cache' WHEN cached_digest <> digest THEN 'drift' WHEN latest > version THEN 'behind' ELSE 'ok' END AS verdict, count(*) AS n FROM r LEFT JOIN c ON r.name = c.name GROUP BY 1""")
def currency_verdict(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    registry = p.select(k.cast("string").alias("name"), F.when(k % 17 != 0, F.col("p_size") % 5).alias("version"), (F.col("p_size") % 6).alias("latest"), F.col("p_brand").alias("digest"))
    cache = p.where(k % 3 != 0).select(k.cast("string").alias("name"), F.when(k % 5 == 0, "x").otherwise(F.col("p_brand")).alias("cached_digest"), (k % 13 != 0).alias("cached_bytes_ok"))
    return matrices.currency_verdict(registry, cache).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query("page_fields", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"?([a-z]+)', 1) AS lang FROM pages")
def page_fields(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="?([a-z]+)', 1).alias("lang"))


@query("props_keys", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def props_keys(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


# ---- factor models with fixed numbers, so that SQL can follow ----------------------

_K = 3
_WSQL = "w AS (SELECT channel, s, CAST(1 + (i * 7 + s * 3) % 5 AS DOUBLE) / 15 AS w FROM (SELECT channel, row_number() OVER (ORDER BY channel) AS i FROM (SELECT DISTINCT channel FROM c)) CROSS JOIN (SELECT unnest(range(0, 3)) AS s))"
_HSQL = "h AS (SELECT sample, s, CAST(1 + (sample * 5 + s * 2) % 7 AS DOUBLE) AS h FROM (SELECT DISTINCT sample FROM c) CROSS JOIN (SELECT unnest(range(0, 3)) AS s))"


def factors(spark, sf):
    """(catalog, w, h): fixed rational factors; w has 5 x 3 rows."""
    c = catalog(spark, sf).withColumnRenamed("n", "v")
    k = F.broadcast(spark.range(_K).withColumnRenamed("id", "s"))
    order = c.select("channel").distinct().withColumn("i", F.row_number().over(Window.orderBy("channel")))
    w = order.crossJoin(k).select("channel", "s", ((1 + (F.col("i") * 7 + F.col("s") * 3) % 5).cast("double") / 15).alias("w"))
    h = c.select("sample").distinct().crossJoin(k).select("sample", "s", (1 + (F.col("sample") * 5 + F.col("s") * 2) % 7).cast("double").alias("h"))
    return c, w, h


@query("nmf_mu_step", f"WITH {_CAT}, {_WSQL}, {_HSQL}, f AS (SELECT h.sample, w.channel, sum(w.w * h.h) AS fit FROM w JOIN h ON w.s = h.s GROUP BY 1, 2), r AS (SELECT f.sample, f.channel, coalesce(c.n, 0) / f.fit AS ratio FROM f LEFT JOIN c ON c.sample = f.sample AND c.channel = f.channel), u AS (SELECT r.sample, w.s, sum(w.w * r.ratio) / sum(w.w) AS g FROM r JOIN w ON w.channel = r.channel GROUP BY 1, 2) SELECT h.sample, h.s, round(h.h * u.g, 6) AS h FROM h JOIN u ON h.sample = u.sample AND h.s = u.s")
def nmf_mu_step(spark, sf):
    """One multiplicative update of H; W is broadcast, H and V meet by sample."""
    c, w, h = factors(spark, sf)
    fit = h.join(F.broadcast(w), "s").groupBy("sample", "channel").agg(F.sum(F.col("w") * F.col("h")).alias("fit"))
    ratio = fit.join(c, ["sample", "channel"], "left").withColumn("ratio", F.coalesce("v", F.lit(0)) / F.col("fit"))
    u = ratio.join(F.broadcast(w), "channel").groupBy("sample", "s").agg((F.sum(F.col("w") * F.col("ratio")) / F.sum("w")).alias("g"))
    return h.join(u, ["sample", "s"]).select("sample", "s", R6(F.col("h") * F.col("g")).alias("h"))


@query("eu_mu_step", f"WITH {_CAT}, {_WSQL}, {_HSQL}, f AS (SELECT h.sample, w.channel, sum(w.w * h.h) AS fit FROM w JOIN h ON w.s = h.s GROUP BY 1, 2), u AS (SELECT f.sample, w.s, sum(w.w * coalesce(c.n, 0)) AS a, sum(w.w * f.fit) AS b FROM f LEFT JOIN c ON c.sample = f.sample AND c.channel = f.channel JOIN w ON w.channel = f.channel GROUP BY 1, 2) SELECT h.sample, h.s, round(h.h * a / b, 6) AS h FROM h JOIN u ON h.sample = u.sample AND h.s = u.s")
def eu_mu_step(spark, sf):
    c, w, h = factors(spark, sf)
    fit = h.join(F.broadcast(w), "s").groupBy("sample", "channel").agg(F.sum(F.col("w") * F.col("h")).alias("fit"))
    u = fit.join(c, ["sample", "channel"], "left").join(F.broadcast(w), "channel").groupBy("sample", "s").agg(F.sum(F.col("w") * F.coalesce("v", F.lit(0))).alias("a"), F.sum(F.col("w") * F.col("fit")).alias("b"))
    return h.join(u, ["sample", "s"]).select("sample", "s", R6(F.col("h") * F.col("a") / F.col("b")).alias("h"))


@query("responsibility", f"WITH {_CAT}, {_WSQL}, {_HSQL}, p AS (SELECT c.sample, c.channel, w.s, c.n, w.w * h.h AS x, sum(w.w * h.h) OVER (PARTITION BY c.sample, c.channel) AS fit FROM c JOIN w ON w.channel = c.channel JOIN h ON h.sample = c.sample AND h.s = w.s) SELECT sample, channel, s, round(n * x / fit, 6) AS assigned, round(greatest(n - fit, 0), 6) AS unassigned FROM p")
def responsibility(spark, sf):
    c, w, h = factors(spark, sf)
    rows = c.join(F.broadcast(w), "channel").join(h, ["sample", "s"]).withColumn("x", F.col("w") * F.col("h"))
    fit = F.sum("x").over(Window.partitionBy("sample", "channel"))
    return rows.withColumn("fit", fit).select("sample", "channel", "s", R6(F.col("v") * F.col("x") / F.col("fit")).alias("assigned"), R6(F.greatest(F.col("v") - F.col("fit"), F.lit(0.0))).alias("unassigned"))


@query("poisson_deviance", f"WITH {_CAT}, {_WSQL}, {_HSQL}, f AS (SELECT h.sample, w.channel, sum(w.w * h.h) AS fit FROM w JOIN h ON w.s = h.s GROUP BY 1, 2) SELECT f.sample, round(2 * sum(CASE WHEN c.n > 0 THEN c.n * ln(c.n / fit) ELSE 0 END - coalesce(c.n, 0) + fit), 6) AS deviance FROM f LEFT JOIN c ON c.sample = f.sample AND c.channel = f.channel GROUP BY 1")
def poisson_deviance(spark, sf):
    c, w, h = factors(spark, sf)
    fit = h.join(F.broadcast(w), "s").groupBy("sample", "channel").agg(F.sum(F.col("w") * F.col("h")).alias("fit")).join(c, ["sample", "channel"], "left")
    one = F.when(F.col("v") > 0, F.col("v") * F.log(F.col("v") / F.col("fit"))).otherwise(0.0) - F.coalesce("v", F.lit(0)) + F.col("fit")
    return fit.groupBy("sample").agg(R6(2 * F.sum(one)).alias("deviance"))


@query("gram_matrix", f"WITH {_CAT}, {_WSQL} SELECT a.s AS i, b.s AS j, round(sum(a.w * b.w), 6) AS g FROM w a JOIN w b ON a.channel = b.channel GROUP BY 1, 2")
def gram_matrix(spark, sf):
    _, w, _ = factors(spark, sf)
    a, b = w.select("channel", F.col("s").alias("i"), F.col("w").alias("x")), w.select("channel", F.col("s").alias("j"), F.col("w").alias("y"))
    return a.join(b, "channel").groupBy("i", "j").agg(R6(F.sum(F.col("x") * F.col("y"))).alias("g"))


@query("cross_products", f"WITH {_CAT}, {_WSQL} SELECT c.sample, w.s, round(sum(w.w * c.n), 6) AS b FROM c JOIN w ON w.channel = c.channel GROUP BY 1, 2")
def cross_products(spark, sf):
    c, w, _ = factors(spark, sf)
    return c.join(F.broadcast(w), "channel").groupBy("sample", "s").agg(R6(F.sum(F.col("w") * F.col("v"))).alias("b"))


@query("multinomial_loglik", f"WITH {_CAT}, {_WSQL}, {_HSQL}, p AS (SELECT h.sample, w.channel, sum(w.w * h.h) AS x FROM w JOIN h ON w.s = h.s GROUP BY 1, 2), q AS (SELECT sample, channel, x / sum(x) OVER (PARTITION BY sample) AS x FROM p) SELECT c.sample, round(sum(c.n * ln(q.x + 1e-16)), 4) AS ll FROM c JOIN q ON c.sample = q.sample AND c.channel = q.channel GROUP BY 1")
def multinomial_loglik(spark, sf):
    c, w, h = factors(spark, sf)
    p = h.join(F.broadcast(w), "s").groupBy("sample", "channel").agg(F.sum(F.col("w") * F.col("h")).alias("x"))
    return c.join(similarity.shares(p, "sample", "x"), ["sample", "channel"]).groupBy("sample").agg(F.round(F.sum(F.col("v") * F.log(F.col("x") + 1e-16)), 4).alias("ll"))


@query("fisher_information", f"WITH {_CAT}, {_WSQL}, {_HSQL}, f AS (SELECT h.sample, w.channel, sum(w.w * h.h) AS fit FROM w JOIN h ON w.s = h.s GROUP BY 1, 2) SELECT f.sample, a.s AS i, b.s AS j, round(sum(a.w * b.w / fit), 6) AS h FROM f JOIN w a ON a.channel = f.channel JOIN w b ON b.channel = f.channel GROUP BY 1, 2, 3")
def fisher_information(spark, sf):
    _, w, h = factors(spark, sf)
    fit = h.join(F.broadcast(w), "s").groupBy("sample", "channel").agg(F.sum(F.col("w") * F.col("h")).alias("fit"))
    a, b = w.select("channel", F.col("s").alias("i"), F.col("w").alias("x")), w.select("channel", F.col("s").alias("j"), F.col("w").alias("y"))
    return fit.join(F.broadcast(a.join(b, "channel")), "channel").groupBy("sample", "i", "j").agg(R6(F.sum(F.col("x") * F.col("y") / F.col("fit"))).alias("h"))


@query("rescale_zero", f"WITH {_CAT}, {_HSQL}, m AS (SELECT sample, sum(n) AS total FROM c GROUP BY 1), r AS (SELECT h.sample, h.s, h.h * m.total / sum(h.h) OVER (PARTITION BY h.sample) AS e, h.h / sum(h.h) OVER (PARTITION BY h.sample) AS share FROM h JOIN m ON h.sample = m.sample) SELECT sample, s, round(CASE WHEN share < 0.2 THEN 0 ELSE e END, 6) AS exposure, share >= 0.2 AS active FROM r")
def rescale_zero(spark, sf):
    c, _, h = factors(spark, sf)
    total = c.groupBy("sample").agg(F.sum("v").alias("total"))
    share = F.col("h") / F.sum("h").over(Window.partitionBy("sample"))
    rows = h.join(total, "sample").withColumn("share", share)
    return rows.select("sample", "s", R6(F.when(F.col("share") < 0.2, 0.0).otherwise(F.col("share") * F.col("total"))).alias("exposure"), (F.col("share") >= 0.2).alias("active"))


@query("gmm_em_step", """WITH x AS (SELECT user_id AS sample, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1), r AS (SELECT *, exp(-(x - 50) * (x - 50) / 200.0) / sqrt(100.0) AS a, exp(-(x - 80) * (x - 80) / 800.0) / sqrt(400.0) AS b FROM x),
q AS (SELECT x, a / (a + b) AS ra, b / (a + b) AS rb FROM r WHERE a + b > 0), s AS (SELECT sum(ra) AS na, sum(rb) AS nb, sum(ra * x) AS sa, sum(rb * x) AS sb, sum(ra * x * x) AS qa, sum(rb * x * x) AS qb FROM q)
SELECT round(na / (na + nb), 6) AS weight_low, round(sa / na, 6) AS mean_low, round(sb / nb, 6) AS mean_high, round(qa / na - (sa / na) * (sa / na), 4) AS var_low, round(qb / nb - (sb / nb) * (sb / nb), 4) AS var_high FROM s""")
def gmm_em_step(spark, sf):
    x = t(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("x"))
    a, b = F.exp(-(F.col("x") - 50) * (F.col("x") - 50) / 200.0) / 10.0, F.exp(-(F.col("x") - 80) * (F.col("x") - 80) / 800.0) / 20.0
    q = x.withColumns({"a": a, "b": b}).where("a + b > 0").select("x", (F.col("a") / (F.col("a") + F.col("b"))).alias("ra"), (F.col("b") / (F.col("a") + F.col("b"))).alias("rb"))
    s = q.agg(*[F.sum(e).alias(n) for n, e in (("na", F.col("ra")), ("nb", F.col("rb")), ("sa", F.col("ra") * F.col("x")), ("sb", F.col("rb") * F.col("x")), ("qa", F.col("ra") * F.col("x") * F.col("x")), ("qb", F.col("rb") * F.col("x") * F.col("x")))])
    c = F.col
    return s.select(R6(c("na") / (c("na") + c("nb"))).alias("weight_low"), R6(c("sa") / c("na")).alias("mean_low"), R6(c("sb") / c("nb")).alias("mean_high"), F.round(c("qa") / c("na") - (c("sa") / c("na")) * (c("sa") / c("na")), 4).alias("var_low"), F.round(c("qb") / c("nb") - (c("sb") / c("nb")) * (c("sb") / c("nb")), 4).alias("var_high"))


_EV = "e AS (SELECT CAST(p_partkey % 12 + 1 AS INTEGER) AS k, CAST(p_partkey // 12 % 3 AS INTEGER) AS fold, CAST(p_partkey // 36 AS INTEGER) AS seed, p_retailprice AS test, CAST((p_partkey * 7919) % 1009 AS DOUBLE) AS train FROM part)"


def evidence(spark, sf):
    p = F.col("p_partkey")
    return t(spark, sf, "part").select((p % 12 + 1).cast("int").alias("k"), (F.floor(p / 12) % 3).cast("int").alias("fold"), F.floor(p / 36).cast("int").alias("seed"), F.col("p_retailprice").alias("test"), ((p * 7919) % 1009).cast("double").alias("train"))


@query("fold_seed_aggregate", f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY k, fold ORDER BY train, seed) AS i FROM e) SELECT k, round(sum(test), 6) AS deviance FROM r WHERE i = 1 GROUP BY 1")
def fold_seed_aggregate(spark, sf):
    return extraction.best_seed(evidence(spark, sf)).withColumn("deviance", R6("deviance"))


@query("k_arbitrate", f"WITH {_EV}, r AS (SELECT *, row_number() OVER (PARTITION BY k, fold ORDER BY train, seed) AS i FROM e), d AS (SELECT k, round(sum(test), 6) AS deviance, 1.02 - k * 0.03 AS a, 0.95 - k * 0.1 AS m FROM r WHERE i = 1 GROUP BY 1), v AS (SELECT *, NOT (a >= 0.8 AND m >= 0.2 AND a + m >= 1.0) AS vetoed FROM d) SELECT k, deviance, vetoed, k = (SELECT k FROM v WHERE NOT vetoed ORDER BY deviance, k LIMIT 1) AS selected FROM v")
def k_arbitrate(spark, sf):
    d = extraction.best_seed(evidence(spark, sf)).withColumn("deviance", R6("deviance"))
    k = F.col("k").cast("decimal(10,2)")
    d = d.withColumn("avg_stability", (F.lit("1.02").cast("decimal(10,2)") - k * F.lit("0.03").cast("decimal(10,2)")).cast("double")).withColumn("min_stability", (F.lit("0.95").cast("decimal(10,2)") - k * F.lit("0.10").cast("decimal(10,2)")).cast("double"))
    return extraction.arbitrated(d).select("k", "deviance", "vetoed", "selected")


# ---- dense kernels: rows only --------------------------------------------------------

CHANNELS = ["click", "error", "purchase", "signup", "view"]


def _dictionary(spark):
    rows = [(f"S{s}", c, float(1 + (i * 7 + s * 3) % 5)) for s in range(3) for i, c in enumerate(CHANNELS)]
    return spark.createDataFrame(rows, "signature string, channel string, value double")


def _counts(spark, sf):
    return catalog(spark, sf).select(F.col("sample").cast("string").alias("sample"), "channel", F.col("n").cast("double").alias("count"))


for _method in ("nnls", "likelihood_bidirectional", "lrt"):

    @query(f"fit_{_method}")
    def _fit(spark, sf, method=_method):
        return fitting.fit(_counts(spark, sf), _dictionary(spark), CHANNELS, method)


@query("fit_bootstrap")
def fit_bootstrap(spark, sf):
    return fitting.bootstrap(_counts(spark, sf), _dictionary(spark), CHANNELS, n_boot=50, bca=True)


@query("presence_test")
def presence_test(spark, sf):
    p = fitting.presence(fitting.fit(_counts(spark, sf), _dictionary(spark), CHANNELS)).withColumn("all", F.lit(1))
    return stats.bh_adjusted(p, ["all"], order="signature").drop("all")


@query("calibration_grid")
def calibration_grid(spark, sf):
    w = np.array([[5, 1, 1], [1, 5, 1], [1, 1, 5], [2, 1, 1], [1, 2, 3.0]])
    return fitting.calibration(spark, w / w.sum(0), [300, 1000], [0.1, 0.5], replicates=8, n_boot=30)


def _v(spark, sf):
    p = profiles(spark, sf).select(F.col("id").cast("string").alias("sample"), F.col("channel").cast("string").alias("channel"), (F.col("value") * 3000).alias("count"))
    return extraction.matrix(p, [str(i) for i in range(64)])[1]


def _engine(name, engine, **options):
    @query(name)
    def run(spark, sf):
        rows = extraction.replicated(spark, _v(spark, sf), 3, replicates=4, rounds=100, engine=engine, **options)
        return spark.createDataFrame([(i, w.shape[1], round(o, 4)) for i, (w, _, o) in enumerate(rows)], "replicate int, k int, objective double")


_engine("extract_kl", "kl")
_engine("extract_eu", "eu")
_engine("extract_sparse_l1", "kl", l1_h=0.1)
_engine("extract_ard", "ard")
_engine("extract_min_volume", "volume")


@query("consensus_pipeline")
def consensus_pipeline(spark, sf):
    _, h, s = extraction.extracted(spark, _v(spark, sf), 3, replicates=4, rounds=100)
    return spark.createDataFrame([(j, round(float(s[j]), 4), round(float(h[j].sum()), 3)) for j in range(len(s))], "signature int, stability double, exposure double")


@query("select_k")
def select_k(spark, sf):
    return extraction.selected_rank(spark, _v(spark, sf), [2, 3, 4], replicates=3)


@query("stratify_gmm")
def stratify_gmm(spark, sf):
    totals = _counts(spark, sf).groupBy("sample").agg(F.sum("count").alias("total"))
    cutoff, _ = reports.hyper_cutoff(totals, 5)
    return reports.stratified(totals, cutoff)


@query("kmeans_embed")
def kmeans_embed(spark, sf):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    e = t(spark, sf, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=4, seed=1, maxIter=20).fit(e)
    order = sorted(range(4), key=lambda i: float(model.clusterCenters()[i][0]))
    names = F.create_map(*[F.lit(x) for i, c in enumerate(order) for x in (c, i)])
    return model.transform(e).select("vec_id", names[F.col("prediction")].alias("cluster"))
