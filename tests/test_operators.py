import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge import model
from tallyforge.functions import channels as C
from tallyforge.functions import sequence as S
from tallyforge.operators import engines, fitting, graph, reports, routing, similarity, stats, tally
from tallyforge.sources import genome, matrices, segments, variants


def test_channel_tables():
    assert [len(C.TABLES[k]()) for k in ("SBS96", "SBS192", "SBS384", "SBS1536", "DBS78", "CN48", "SV32", "ID83")] == [96, 192, 384, 1536, 78, 48, 32, 83]
    assert all(len(set(f())) == len(f()) for f in C.TABLES.values())
    assert len(C.dbs_pairs()) == 144 and C.label("SBS96", 0) == "A[C>A]A"
    with pytest.raises(model.EngineError):
        C.label("SBS96", 96)


def test_classifiers(spark):
    rows = [("ACA", "T", "A[C>T]A", 8), ("TGT", "A", "A[C>T]A", 8), ("ACN", "T", None, None), ("ACA", "C", None, None)]
    got = spark.createDataFrame([r[:2] for r in rows], "c string, a string").select(S.sbs96(F.col("c"), F.col("a")), S.sbs96_index(F.col("c"), F.col("a"))).collect()
    assert [(g[0], g[1]) for g in got] == [r[2:] for r in rows]
    labels = C.sbs96()
    assert all(labels.index(g[0]) == g[1] for g in got if g[0])
    cn = spark.createDataFrame([(0, 0, 5, "0:homdel:0-100kb"), (0, 1, 100_001, "1:LOH:100kb-1Mb"), (1, 1, 40_000_001, "2:het:>40Mb"), (4, 5, 10_000_000, "9+:het:1Mb-10Mb"), (2, 1, 5, None)], "m int, j int, n long, e string")
    assert cn.where(~S.cn48(F.col("m"), F.col("j"), F.col("n")).eqNullSafe(F.col("e"))).count() == 0


def test_router_golden():
    snv = lambda p: (p, "A", "C")
    assert routing.route([snv(1), snv(2), snv(3)]) == ["dbs", "dbs", "sbs"]
    assert routing.route([snv(1), (2, "N", "C"), snv(3)]) == ["sbs", "skipped:invalid_base", "sbs"]
    assert routing.route([(1, "AC", "GT"), (3, "A", "C")]) == ["mnv", "mnv"] and routing.route([(1, "ACG", "GTA"), (4, "CGT", "ATA")]) == ["long_mnv", "long_mnv"]
    assert routing.route([(5, "AT", "A"), (5, "AT", "A"), (5, "AT", "A")]) == ["id83", "skipped:duplicate_record", "skipped:duplicate_record"]
    assert routing.route([(1, "", "A"), (2, "A", "A"), (3, "ACT", "GC")]) == ["skipped:empty_allele", "skipped:ref_equals_alt", "complex_indel"]


def test_pairing_forms_agree(spark):
    r = random.Random(1)
    rows, n = [], 0
    for s in range(6):
        pos = 0
        for _ in range(80):
            pos += r.choice([1, 1, 1, 2, 5])
            ok = r.random() < 0.9
            rows.append((s, pos, "A", "C" if ok else "A", ok, n))
            n += 1
    df = spark.createDataFrame(rows, "sample int, pos long, ref string, alt string, valid boolean, row long")
    a = {x.row: x.destination for x in routing.paired_snvs(df, ["sample"], ["pos", "row"]).collect()}
    b = {x.row: x.destination.split(":")[0] for x in routing.routed(df, ["sample"], ["pos", "row"]).collect()}
    assert a == b and {"dbs", "sbs", "skipped"} == set(a.values())


def test_dense_and_shares(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), ("c", None)], "sample string, channel string")
    d = tally.with_share(tally.dense(tally.counted(e), spark.createDataFrame([("x",), ("y",)], "channel string"), e))
    got = {(r.sample, r.channel): (r.n, r.share) for r in d.collect()}
    assert got == {("a", "x"): (2, 1.0), ("a", "y"): (0, 0.0), ("b", "x"): (0, 0.0), ("b", "y"): (1, 1.0), ("c", "x"): (0, None), ("c", "y"): (0, None)}


def test_vcf_and_formats(spark, tmp_path):
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", "1\t10\t.\ta\tC,T\t.\tPASS\t.", "1\t20\t.\tAT\t<DEL>\t.\tq\t.", "1\tx\t.\tA\t*\t.\tq\t.", "2\t5\t.\tAC\tG\t.\tPASS\t."]
    p = tmp_path / "v.vcf"
    p.write_text("\n".join(lines))
    got = variants.read_variants(spark, str(p)).collect()
    assert sorted((g.chrom, g.start, g.end, g.ref, g.alt) for g in got) == [("1", 10, 10, "A", "C"), ("1", 10, 10, "A", "T"), ("2", 5, 6, "AC", "G")]
    assert variants.format_of("a.MAF.gz") == ("maf", True)
    for bad in ("x.bcf", "x.doc"):
        with pytest.raises(model.EngineError):
            variants.format_of(bad)
    m = tmp_path / "v.maf"
    m.write_text("#v\nChromosome\tStart_Position\tEnd_Position\tReference_Allele\tTumor_Seq_Allele2\tVariant_Classification\n1\t5\t5\tA\tG\tSilent\n1\t6\t6\tA\tG\tOther\n")
    assert variants.read_variants(spark, str(m)).count() == 1


def test_validation(spark):
    good = spark.createDataFrame([("1", 1, 1, "A", "C")], "chrom string, start long, end long, ref string, alt string")
    model.validate_variants(good)
    with pytest.raises(model.EngineError) as e:
        model.validate_variants(good.withColumn("ref", F.lit("x")))
    assert e.value.info["rule"] == "ref_alphabet"
    counts = spark.createDataFrame([("s", 0, "x", 0, 1.0), ("s", 0, "x", 0, 2.0)], model.CATALOG)
    with pytest.raises(model.EngineError):
        model.Catalog(counts, ("x",)).validate()


def test_callers(spark):
    facets = spark.createDataFrame([("1", 1, 9, 3, None), ("1", 1, 9, 3, 1)], "chrom string, start int, end int, `tcn.em` int, `lcn.em` int")
    assert sorted((r.minor, r.major) for r in segments.canonical(facets).collect()) == [(0, 3), (1, 2)]
    battenberg = spark.createDataFrame([("1", 1, 9, 2, 1, 0.6, 3, 0), ("1", 10, 19, 1, 1, 1.0, None, None)], "chr string, startpos int, endpos int, nMaj1_A int, nMin1_A int, frac1_A double, nMaj2_A int, nMin2_A int")
    assert sorted((r.start, r.minor, r.major) for r in segments.canonical(battenberg).collect()) == [(1, 0, 3), (1, 1, 2), (10, 1, 1)]
    sequenza = spark.createDataFrame([("1", 1, 9, 2, 1, 4)], "chromosome string, `start.pos` int, `end.pos` int, A int, B int, CNt int")
    assert segments.canonical(sequenza).first().reason == "total_mismatch"
    with pytest.raises(model.EngineError):
        segments.canonical(facets.select("chrom"))


def test_genome(spark):
    g = spark.createDataFrame([("c", "AC" * 32 + "N" + "GT" * 20)], "chrom string, seq string")
    text = g.first().seq
    v = spark.createDataFrame([("c", i) for i in range(0, 110)] + [("d", 5)], "chrom string, start long")
    got = {(r.chrom, r.start): r.context for r in genome.with_context(v, genome.chunked(g, 16, 4), size=16).collect()}
    for (c, s), x in got.items():
        assert x == (text[s - 3 : s + 2] if c == "c" and s - 3 >= 0 and s + 2 <= len(text) else None)


def test_matrix_round_trip(spark, tmp_path):
    rows = [(c, i, n, float(i) / 3) for i, c in enumerate(C.sbs96()) for n in ("s1", "s2")]
    df = spark.createDataFrame(rows, "channel string, channel_ord int, name string, value double")
    matrices.write_matrix(df, str(tmp_path / "m"), "cosmic")
    back = matrices.read_matrix(spark, str(tmp_path / "m"), "SBS96")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(model.EngineError):
        matrices.read_matrix(spark, str(tmp_path / "m"), "DBS78")
    with pytest.raises(model.EngineError):
        matrices.write_matrix(df.withColumn("name", F.lit("Type")), None, "cosmic")


def test_bh(spark):
    p = [0.01, 0.04, 0.03, 0.5, None]
    got = {r.id: r.q for r in stats.bh_adjusted(spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, id int, p double"), ["f"]).collect()}
    assert got[4] is None and np.allclose([got[i] for i in range(4)], [0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_fit_recovers(spark):
    r = np.random.default_rng(1)
    names = [f"c{i:02d}" for i in range(24)]
    w = r.dirichlet(np.full(24, 0.3), 2).T
    h = np.array([[500.0, 0, 300], [0, 400, 300]])
    cat = spark.createDataFrame([(f"s{j}", c, float(x)) for j in range(3) for c, x in zip(names, w @ h[:, j])], "sample string, channel string, count double")
    sig = spark.createDataFrame([(f"g{k}", c, float(x)) for k in range(2) for c, x in zip(names, w[:, k])], "signature string, channel string, value double")
    for method in ("nnls", "likelihood_bidirectional", "lrt"):
        got = {(x.signature, x.sample): x for x in fitting.fit(cat, sig, names, method).collect()}
        assert all(abs(got[f"g{k}", f"s{j}"].exposure - h[k, j]) < 0.03 * h[:, j].sum() for k in range(2) for j in range(3))
    with pytest.raises(model.EngineError):
        fitting.fit(cat, sig.where("channel <> 'c00'"), names)
    p = {x.signature: x.p for x in fitting.presence(fitting.fit(cat, sig, names)).collect()}
    assert max(p.values()) < 1e-6
    b = fitting.bootstrap(cat, sig, names, n_boot=30).collect()
    assert all(x.lower <= x.upper for x in b) and sorted(map(tuple, b)) == sorted(map(tuple, fitting.bootstrap(cat.repartition(3), sig, names, n_boot=30).collect()))


def test_engines(spark):
    engines.register("mine", "extract", lambda v, k: (_ for _ in ()).throw(RuntimeError("no")), certified=False)
    assert engines.match("mine", "extract").name == "mine" and len(engines.engines("fit")) == 2
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        engines.run("mine", "extract", None, 1)
    engines.register("absent", "fit", len, packages=("no_such_package",))
    with pytest.raises(model.EngineError):
        engines.run("absent", "fit", [])
    rows = {(r.engine, r.metric): r.estimate for r in engines.benchmark(spark, ["kl", "mine"], [{"name": "a"}]).collect()}
    assert rows["mine", "cell_error"] == 1.0 and rows["kl", "recall"] > 0.6
    engines.reset()
    with pytest.raises(model.EngineError):
        engines.match("mine", "extract")


def test_hrd_gate(spark):
    s = spark.createDataFrame([("a", "1", 1, 100, 1, 0)], "sample string, chromosome string, start long, end long, state int, minor_cn int")
    arms = spark.createDataFrame([("1", "p", 1, 50), ("1", "q", 51, 100)], "chromosome string, arm string, arm_start long, arm_end long")
    got = reports.hrd_report(s, arms, 100, "ASCAT").first()
    assert (got.ploh, got.aneuploidy, got.hrd) == (1.0, 1.0, 0)
    for bad in ({"caller": "x"}, {"caller": "ASCAT", "assay": "wes"}):
        with pytest.raises(model.EngineError):
            reports.hrd_report(s, arms, 100, **bad)


def test_stratify(spark):
    t = spark.createDataFrame([(f"s{i}", 1000.0 + i) for i in range(60)] + [("h1", 90000.0), ("h2", 95000.0)], "sample string, total double")
    cut, _ = reports.hyper_cutoff(t, 5)
    assert {r.sample for r in reports.stratified(t, cut).where("is_hyper").collect()} == {"h1", "h2"}


def test_stratify_query_follows_the_fit(spark, monkeypatch):
    """The registered query flags by the fit's cutoff, and the fit covers all totals."""
    from tallyforge.plans import analyse

    t = spark.createDataFrame([(f"s{i}", "c", 1000.0 + i) for i in range(60)] + [("h1", "c", 90000.0), ("h2", "c", 95000.0)], "sample string, channel string, count double")
    monkeypatch.setattr(analyse, "_counts", lambda spark, sf: t)
    assert {r.sample for r in analyse.stratify_gmm(spark, "").where("is_hyper").collect()} == {"h1", "h2"}
    many = spark.range(150_000).select(F.col("id").cast("string").alias("sample"), (F.col("id") % 50 + 1000).cast("double").alias("total"))
    cut, fit = reports.hyper_cutoff(many, 5)
    assert fit["n"] == 150_000 and 1000 < cut < 1100


def test_graph_and_similarity(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (4, 4)], "a long, b long")
    assert {r.node: r.root for r in graph.components(e).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    p = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 0.0), ("y", 0, 0.5), ("y", 1, 0.5)], "id string, channel int, value double")
    got = {(r.est, r.ref): r for r in similarity.pairwise(p, p).collect()}
    assert abs(got["x", "y"].cosine - 0.5**0.5) < 1e-12 and got["x", "x"].jsd == 0 and got["x", "y"].correlation is None


def test_hot_breakpoints(spark):
    """Clusters are found whole, in a group whose rows come in several batches, and in time linear in the group."""
    import time

    import numpy as np

    gap = np.r_[np.full(300, 1000), np.full(20, 1), np.full(300, 1000), np.full(40, 2), np.full(300, 1000)]
    rows = [(s, "c", int(p) + s, i) for s in (1, 2) for i, p in enumerate(np.cumsum(gap))]
    got = segments.clustered(spark.createDataFrame(rows, "sample int, chrom string, pos long, row long"), ["sample", "chrom"])
    assert got.columns == ["sample", "chrom", "pos", "row", "gap", "hot"] and got.count() == len(rows)
    assert sorted(r.row for r in got.where("hot and sample = 2").collect()) == [*range(300, 320), *range(620, 660)]
    began = time.time()
    assert segments.hot_segments(np.r_[2000.0, np.ones(150_000)]) == [] and time.time() - began < 40


def test_routed_over_batches(spark):
    """A group that comes in many batches is routed as one list."""
    r = random.Random(3)
    rows = sorted((s, r.randrange(60), r.choice(["A", "C", "AC", "GTA", "N"]), r.choice(["T", "G", "GT", "CCC", "TA"]), i) for i, s in enumerate([1, 2] * 150))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        df = routing.routed(spark.createDataFrame(rows, "sample int, pos long, ref string, alt string, row int"), ["sample"], ["pos", "ref", "alt", "row"])
        assert "MapInPandas" in df._jdf.queryExecution().toString()
        got = {x.row: x.destination for x in df.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for s in (1, 2):
        own = [x for x in rows if x[0] == s]
        want |= dict(zip([x[4] for x in own], routing.route([x[1:4] for x in own])))
    assert got == want
