import pytest
from pyspark.sql import functions as F

from tallyforge import model
from tallyforge.operators import figures, reports
from tallyforge.sources import segments, variants


def test_profile_and_reconstruction(spark):
    c = spark.createDataFrame([("a", "x", 3.0), ("a", "y", 1.0), ("b", "x", 0.0), ("b", "y", 0.0)], "sample string, channel string, count double")
    got = {(r.sample, r.channel): r.value for r in figures.profile(c).collect()}
    assert got == {("a", "x"): 0.75, ("a", "y"): 0.25, ("b", "x"): None, ("b", "y"): None}
    with pytest.raises(model.EngineError):
        figures.profile(c, "other")
    w = spark.createDataFrame([("s", "x", 0.5), ("s", "y", 0.5)], "signature string, channel string, value double")
    h = spark.createDataFrame([("a", "s", 4.0)], "sample string, signature string, value double")
    rows = {(r.channel, r.which): r.value for r in figures.reconstruction(c, w, h).collect()}
    assert rows["x", "reconstructed"] == 0.5 and rows["x", "residual"] == 0.25 and rows["y", "observed"] == 0.25
    assert figures.profile(c.limit(0)).count() == 0


def test_draws(spark):
    d = spark.createDataFrame([("a", "s", i, float(i)) for i in range(11)] + [("a", "z", i, 0.0) for i in range(3)], "sample string, signature string, draw int, value double")
    e = spark.createDataFrame([("a", "s", 5.0), ("a", "z", 0.0)], "sample string, signature string, value double")
    row = figures.boot_intervals(d, e).collect()
    assert [(r.signature, round(r.lo, 9), r.hi, r.place) for r in row] == [("s", 0.25, 9.75, 1)]
    assert figures.boot_intervals(d, e, show_zero=True).count() == 2
    bins = {(r.signature, r.bin): r.n for r in figures.boot_histogram(d, 5).collect()}
    assert bins["z", 0] == 3 and bins["s", 4] == 3 and sum(bins.values()) == 14
    assert {r.signature: r.stable for r in figures.boot_stability(d).collect()} == {"s": False, "z": False}


def test_contribution_label(spark):
    a = spark.createDataFrame([("a", "p", 0.1), ("a", "q", 0.3), ("a", "r", 0.2), ("b", "p", 0.0)], "sample string, signature string, share double")
    assert [(r.sample, r.label) for r in figures.contribution(a, 2).orderBy("place").collect()] == [("a", "q;r +1"), ("b", "")]


ARMS = [("1", "p", 1, 40), ("1", "q", 41, 100), ("13", "p", 1, 50), ("13", "q", 51, 100)]


def test_aneuploidy_rules(spark):
    arms = spark.createDataFrame(ARMS, "chromosome string, arm string, arm_start long, arm_end long")
    rows = [
        ("whole", "chr1", 1, 100, 3, 1),  # half of each arm: 3, so the flag is 1
        ("even", "1", 1, 40, 1, 0), ("even", "1", 41, 100, 1, 0),  # 1 + 1 is the ploidy
        ("sex", "chrX", 1, 100, 5, 0),  # no autosome
        ("null", "1", 1, 40, None, 0), ("null", "1", 41, 100, 4, None),
        ("short", "13", 1, 50, 4, 3),
    ]
    s = spark.createDataFrame(rows, "sample string, chromosome string, start long, end long, state int, minor_cn int")
    got = {r.sample: r.aneuploidy for r in reports.aneuploidy(s, arms).collect()}
    assert got == {"whole": 1.0, "even": 0.0, "sex": 0.0, "null": 1.0, "short": 1.0}
    assert {r.sample: r.aneuploidy for r in reports.aneuploidy(s, arms, rm_black_arms=True).collect()}["short"] == 0.0
    loss = {r.sample: r.ploh for r in reports.ploh(s, 100).collect()}
    assert loss == {"whole": 0.0, "even": 1.0, "sex": 0.0, "null": 0.0, "short": 0.0}
    folded = spark.createDataFrame([("f", "2", 1, 10, 2, 2)], s.schema)  # the other allele is the lost one
    assert reports.ploh(folded, 10).first().ploh == 1.0


def test_headers_and_classes(spark):
    ngs = spark.createDataFrame([("1", 1, 9, 3, 1)], "`Chromosome` string, `Start Position` int, `End Position` int, `Tumour TCN` int, `Tumour BCN` int")
    assert [(r.minor, r.major, r.reason) for r in segments.canonical(ngs).collect()] == [(1, 2, None)]
    rows = [("1", 1, 9, n, k) for n, k in ((2, "copy neutral LOH"), (0, "amp LOH"), (1, "loss"), (2, "loss"), (3, " gain "), (1, "gain"), (2, None))]
    pcawg = spark.createDataFrame(rows, "chromosome string, chromosome_start int, chromosome_end int, copy_number int, mutation_type string")
    assert [r.reason for r in segments.canonical(pcawg).collect()] == [None, "type_total_mismatch", None, "type_total_mismatch", None, "type_total_mismatch", "unsupported_type"]
    maf = spark.createDataFrame([("1", "5", "A", "G", k) for k in ("Silent", "Splice_Site", "RNA", "Missense_Mutation", None)], "chrom string, pos string, ref string, alt string, k string")
    assert [r.reason for r in variants.parse_table(maf, kind="k").collect()] == ["classification", "classification", None, None, None]


def test_artifact_share_flags(spark):
    c = spark.createDataFrame([("a", "T>A", 20_000.0), ("b", "T>A", 20_000.0)], "sample string, channel string, count double")
    share = spark.createDataFrame([("a", 0.2)], "sample string, artifact_share double")
    assert {r.sample: r.flag for r in reports.qc_report(c, "%C>A%", "%C>T%", share).collect()} == {"a": "artifact", "b": "ok"}
    assert figures.dashboard(reports.qc_report(c, "%C>A%", "%C>T%")).where(F.col("metric") == "log10_total").count() == 2


def test_equal_sums_are_tied(spark, tmp_path):
    """0.1 + 0.2 and 0.3 are one sum: names decide, in whatever order rows are added."""
    from tallyforge.plans import analyse, figure_frames

    rows = [(1, "view", 0.1), (1, "view", 0.2), (1, "click", 0.3), (1, "error", 0.05)]
    spark.createDataFrame(rows, "user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert [r.top for r in analyse.Q["artifact_topn"](spark, str(tmp_path)).collect()] == ["click,view,error"]
    assert [r.label for r in figure_frames.Q["fig_pseudosig_contribution"](spark, str(tmp_path)).collect()] == ["click;view +1"]
