import numpy as np
import pytest

from tallyforge.model import EngineError
from tallyforge.operators import numerics
from tallyforge.operators import simulation as S


def test_simulate(spark):
    sig = spark.createDataFrame([(f"g{k}", f"c{i}", 0.1 if (i + k) % 2 else 0.1) for k in range(2) for i in range(10)], "signature string, channel string, value double")
    exp = spark.createDataFrame([("a", "g0", 0.5), ("a", "g1", 0.5), ("b", "g0", 300.0), ("b", "g1", 0.0)], "sample string, signature string, exposure double")
    for arm in S.ARMS:
        rows = S.simulate(sig, exp, arm, burden=5000).collect()
        total = {s: sum(r["count"] for r in rows if r["sample"] == s) for s in "ab"}
        again = S.simulate(sig.repartition(3), exp, arm, burden=5000).collect()
        assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 20
        assert total == {"a": 5000, "b": 300} if arm == "multinomial" else 2500 < total["a"] < 8000
    with pytest.raises(EngineError):
        S.simulate(sig, exp, "other")


def test_nulls(spark):
    draws = S.null_draws(spark, "signature_uniform", m=48, n=2000)
    got = S.null_summary(draws, [0.05, 0.95])
    assert abs(got["mean"] - S.analytic_null(48)["mean_corrected"]) < 0.01 and got["quantiles"][0] < got["mean"] < got["quantiles"][1]
    shape = S.null_draws(spark, "shape", burden=2000, n=400, profile=[1.0, 2.0, 7.0])
    assert S.conditional_p(shape, 0.0) == 1.0 and S.conditional_p(shape, 1.1) == 1 / 401
    with pytest.raises(EngineError):
        S.null_draws(spark, "other")
    with pytest.raises(EngineError):
        S.null_summary(draws, [0.5], tolerance=1e-9)


def test_strand_and_sanity():
    for u, t in ((3, 9), (0, 4), (5, 5), (40, 22)):
        assert np.isclose(S.strand_bias(u, t)["p"], numerics.binomial_two_sided(u, u + t))
    assert S.strand_bias(3, 9)["p"] < S.strand_bias(3.5, 8.5)["p"] < S.strand_bias(4, 8)["p"] and S.strand_bias(0, 0)["p"] == 1
    assert S.sanity_curve([1, 2, 3], [0.95, 0.94, 0.96], [0.9, 0.9, 0.9])["ok"]
    assert not S.sanity_curve([1, 2, 3], [0.95, 0.8, 0.7], [0.9, 0.9, 0.9])["ok"]


def test_qc_flags(spark):
    from tallyforge.functions.channels import sbs96
    from tallyforge.operators import reports

    rows = [("dead", "A[C>A]A", 0.0), ("low", "A[C>G]A", 50.0), ("ox", "A[C>A]A", 300.0), ("ox", "A[C>G]A", 700.0), ("ct", "A[C>T]A", 400.0), ("ct", "A[C>G]A", 600.0), ("ok", "A[C>G]A", 500.0)]
    got = {r.sample: r.flag for r in reports.qc_report(spark.createDataFrame(rows, "sample string, channel string, count double"), "%C>A%", "%C>T%").collect()}
    assert got == {"dead": "ok", "low": "watch", "ox": "artifact", "ct": "watch", "ok": "ok"}
    assert [m for _, m in reports.mechanism_channels(sbs96())].count("oxoG") == 16 and len(reports.mechanism_channels(sbs96())) == 32
