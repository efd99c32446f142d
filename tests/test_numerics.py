import itertools
import math

import numpy as np

from tallyforge.operators import numerics as N


def test_nnls_kkt():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, y = r.random((20, 6)), r.normal(size=20)
        x = N.nnls(a.T @ a, a.T @ y)
        slope = a.T @ (y - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 0]).max(initial=0) < 1e-6


def test_nnls_recovers():
    r = np.random.default_rng(2)
    a = r.random((96, 10))
    h = np.where(r.random(10) < 0.4, 0, r.random(10) * 100)
    assert np.allclose(N.nnls(a.T @ a, a.T @ (a @ h)), h, atol=1e-6)


def test_hungarian_brute_force():
    r = np.random.default_rng(3)
    for n in (1, 2, 4, 6):
        for _ in range(10):
            c = r.random((n, n))
            best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert abs(c[np.arange(n), N.hungarian(c)].sum() - best) < 1e-12


def test_monotone_objectives():
    r = np.random.default_rng(4)
    v = r.poisson(20, (24, 15)).astype(float)
    for step, loss in ((N.nmf_kl, N.kl), (N.nmf_eu, lambda v, m: float(((v - m) ** 2).sum()))):
        w, h = N.starts(v, 3, (1, 0, 3))
        values = []
        for _ in range(40):
            w, h = step(v, w, h, 1)
            values.append(loss(v, w @ h))
        assert all(b <= a * (1 + 1e-9) for a, b in zip(values, values[1:]))
    w, h = N.starts(v, 3, (1, 0, 3))
    before = 0.5 * ((v - w @ h) ** 2).sum()
    w, h = N.nmf_volume(v, w, h, rounds=60)
    assert 0.5 * ((v - w @ h) ** 2).sum() < before


def planted(m=96, n=30, k=3, seed=5):
    r = np.random.default_rng(seed)
    w = np.zeros((m, k))
    for j in range(k):
        w[j * m // k : (j + 1) * m // k, j] = r.random(m // k)
    w /= w.sum(0)
    h = r.random((k, n)) * 3000
    return w, h, np.round(w @ h)


def test_recovery_and_consensus():
    w, _, v = planted()
    solutions = [N.nmf_kl(v, *N.starts(v, 3, (1, i, 3)), rounds=200)[0] for i in range(5)]
    centre, s = N.consensus([x / x.sum(0) for x in solutions], 1)
    cos = N.cosines(w, centre)
    assert cos[np.arange(3), N.hungarian(1 - cos)].min() > 0.98 and s.min() > 0.9


def test_ard_finds_rank():
    _, _, v = planted()
    _, _, alive = N.nmf_ard(v / v.mean(), *N.starts(v / v.mean(), 6, (1, 0, 6)), rounds=1500)
    assert 2 <= alive.sum() <= 6


def test_nndsvd():
    _, _, v = planted()
    w, h = N.nndsvd(v, 3)
    assert (w >= 0).all() and (h >= 0).all() and np.linalg.norm(v - w @ h) < np.linalg.norm(v)


def test_tails():
    assert abs(N.chi2_upper(3.841458820694124, 1) - 0.05) < 1e-9 and abs(N.chi2_upper(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(N.chi2_upper(0.5, 1) - math.erfc(math.sqrt(0.25))) < 1e-12
    assert abs(N.pooled_presence(2.7055434540954, 1) - 0.05) < 1e-6
    assert abs(N.binomial_two_sided(3, 10) - 0.34375) < 1e-12


def test_nb_mle_beats_neighbours():
    r = np.random.default_rng(6)
    w = r.dirichlet(np.ones(24), 3).T
    x = r.poisson(w @ np.array([200.0, 50, 0])).astype(float)
    h = N.nb_mle(x, w, 8.0)
    best = N.nb_loglik(x, w @ h, 8.0)
    for _ in range(50):
        assert N.nb_loglik(x, w @ np.maximum(h + r.normal(size=3), 0), 8.0) <= best + 1e-5


def test_bidirectional_support():
    w, h, _ = planted(n=1)
    h[2] = 0
    x = np.round(w @ h[:, 0])
    assert (N.bidirectional(x, w) > 0).tolist() == [True, True, False]


def test_piecewise_and_mixture():
    y = np.concatenate([np.zeros(30), np.full(25, 8.0), np.zeros(20)])
    assert N.piecewise(y, 10, 5.0) == [30, 55, 75]
    r = np.random.default_rng(7)
    mean, _, _, _ = N.gmm2(np.concatenate([r.normal(100, 5, 200), r.normal(1000, 30, 20)]), 1)
    assert abs(min(mean) - 100) < 3 and abs(max(mean) - 1000) < 30


def test_silhouette():
    x = np.array([[1, 0.9, 0.0, 0.1], [0, 0.1, 1, 0.9]])
    assert N.silhouette(x, np.array([0, 0, 1, 1])).min() > 0.8 and N.silhouette(x, np.zeros(4, int)).tolist() == [1] * 4 and N.silhouette(x, np.array([0, 1, 1, 1]))[0] == 0


def test_indels():
    seq = "GGCAAAATCACACGTTTACGGTAC"
    assert N.indel83(seq, 2, "CA", "C") == "1:Del:T:3" and N.indel83(seq, 2, "C", "CA") == "1:Ins:T:4"
    assert N.indel83(seq, 7, "TCA", "T") == "2:Del:R:1" and N.indel83(seq, 0, "C", "CA") is None
    assert N.indel83("TTACGACTT", 1, "TACG", "T") == "3:Del:M:2" and N.indel83("GGTACGTTT", 2, "TACG", "T") == "3:Del:R:0"
    assert N.indel83("GGGTCATCC", 2, "G", "GCC") in (None, "2:Ins:R:0")


def test_bca():
    r = np.random.default_rng(8)
    d = r.normal(size=4000)
    low, high, plain = N.bca_levels(d, 0.0, 0.0)
    assert not plain and abs(low - 0.025) < 0.02 and abs(high - 0.975) < 0.02
    assert N.bca_levels(d, 10.0, 0.0)[2]


def test_rows_are_the_kernels():
    """Samples fitted together have the numbers that each has alone, whatever stands beside it."""
    r = np.random.default_rng(9)
    w = r.random((12, 4)) ** 2
    w /= w.sum(0)
    x = r.poisson(np.where(r.random((40, 4)) < 0.5, 0, r.random((40, 4)) * 200) @ w.T).astype(float)
    assert np.allclose(N.nnls_rows(w.T @ w, N.crosses(x, w)), [N.nnls(w.T @ w, w.T @ v) for v in x])
    assert np.allclose(N.bidirectional_rows(x, w), [N.bidirectional(v, w) for v in x])
    stat, p = N.lrt_rows(x, w, 8.0)
    one = np.array([N.lrt(v, w, 8.0) for v in x])
    assert np.allclose(stat, one[:, :, 0], atol=1e-4) and np.allclose(p, one[:, :, 1], atol=1e-4)
    assert (N.lrt_rows(x[5:9], w, 8.0)[0] == stat[5:9]).all()


def test_presence_of_many():
    """The tails of 100,000 samples, in time linear in them; the mean statistic is a half."""
    import time

    began = time.time()
    assert 0.49 < N.pooled_presence(50_000.0, 100_000) < 0.51 and N.pooled_presence(53_000.0, 100_000) < 1e-6
    assert time.time() - began < 20
    direct = sum(math.comb(30, m) / 2**30 * (N.chi2_upper(20.0, m) if m else 0.0) for m in range(31))
    assert abs(N.pooled_presence(20.0, 30) - direct) < 1e-12
