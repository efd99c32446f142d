"""Dense kernels on small matrices; numpy only, no Spark."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

TINY = 1e-12


def nnls(gram: np.ndarray, cross: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Least squares with x >= 0 by active sets, from the Gram matrix and A'y."""
    k = len(cross)
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), TINY))
    g = gram * scale[:, None] * scale + np.eye(k) * 1e-12
    b = cross * scale
    x, active = np.zeros(k), np.zeros(k, bool)
    for _ in range(rounds or 3 * k + 30):
        slope = b - g @ x
        slope[active] = -np.inf
        j = int(np.argmax(slope)) if k else 0
        if not k or slope[j] <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        active[j] = True
        while True:
            at = np.flatnonzero(active)
            z = np.linalg.solve(g[np.ix_(at, at)], b[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            bad = z <= 0
            old = x[at]
            step = np.min(old[bad] / np.maximum(old[bad] - z[bad], 1e-300))
            moved = old + step * (z - old)
            moved[bad & (moved <= 1e-14)] = 0
            if not (bad & (moved == 0)).any():
                moved[np.argmin(np.where(bad, moved, np.inf))] = 0
            x[at] = moved
            active[at] = moved > 0
    return x * scale


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a cheapest one-to-one assignment; rows <= columns."""
    n, m = cost.shape
    u, v, p = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        p[0], j0 = i, 0
        least, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            i0 = p[j0]
            free = np.flatnonzero(~used[1:]) + 1
            cur = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = cur < least[free]
            least[free[better]], way[free[better]] = cur[better], j0
            j1 = int(free[np.argmin(least[free])])
            delta = least[j1]
            u[p[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if p[j0] == 0:
                break
        while j0:
            p[j0] = p[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    for j in range(1, m + 1):
        if p[j]:
            out[p[j] - 1] = j - 1
    return out


def nb_loglik(x: np.ndarray, mu: np.ndarray, size: float) -> float:
    mu = mu + 1e-16
    lg = np.array([math.lgamma(a + size) - math.lgamma(a + 1) for a in x])
    return float(np.sum(lg - math.lgamma(size) + size * np.log(size / (size + mu)) + x * np.log(mu / (size + mu))))


def multinomial_loglik(x: np.ndarray, p: np.ndarray) -> float:
    return float(np.sum(x * np.log(p + 1e-16)))


def nb_mle(x: np.ndarray, w: np.ndarray, size: float, start: np.ndarray | None = None) -> np.ndarray:
    """Exposures of largest negative binomial likelihood: projected Newton with Armijo steps."""
    k = w.shape[1]
    h = start.astype(float).copy() if start is not None else nnls(w.T @ w, w.T @ x)
    if not h.any():
        h = np.full(k, x.sum() / max(1, k))
    h = np.maximum(h, 0) + 1e-9
    f, first = nb_loglik(x, w @ h, size), None
    for _ in range(300):
        mu = w @ h
        g = w.T @ (x / (1e-16 + mu) - (size + x) / (size + mu))
        pg = np.where((h > 0) | (g > 0), g, 0.0)
        first = np.abs(pg).max() if first is None else first
        if np.abs(pg).max() <= 1e-8 * (1 + first):
            break
        free = (h > 0) | (g > 0)
        c = np.maximum(x / np.maximum(mu, 1e-16) ** 2 - (size + x) / (size + mu) ** 2, x / (size + mu) ** 2 + 1e-12)
        a = w[:, free]
        d = np.zeros(k)
        d[free] = np.linalg.solve((a * c[:, None]).T @ a + 1e-10 * np.eye(free.sum()), g[free])
        if g @ d <= 0:
            d = pg
        step, moved = 1.0, False
        for _ in range(80):
            new = np.maximum(h + step * d, 0)
            value = nb_loglik(x, w @ new, size)
            if value >= f + 1e-4 * g @ (new - h):
                moved = True
                break
            step /= 2
        if not moved or abs(value - f) <= 1e-10 * (1 + abs(f)):
            h = new if moved else h
            break
        h, f = new, value
    return h


def bidirectional(x: np.ndarray, w: np.ndarray, eps: float = 1e-3, rounds: int = 1000) -> np.ndarray:
    """Support search on the mean multinomial likelihood: one removal, then one addition, until neither pays."""
    n = max(x.sum(), 1.0)

    def fitted(s):
        a = w[:, s]
        h = nnls(a.T @ a, a.T @ x)
        p = a @ h
        return multinomial_loglik(x, p / max(p.sum(), 1e-300)) / n, h

    k = w.shape[1]
    full = nnls(w.T @ w, w.T @ x)
    support = [j for j in range(k) if full[j] > 0]
    best = fitted(support)[0] if support else -np.inf
    for _ in range(rounds):
        changed = False
        if len(support) > 1:
            trials = [(best - fitted([s for s in support if s != j])[0], j) for j in support]
            cost, j = min(trials)
            if cost < eps:
                support.remove(j)
                best -= cost
                changed = True
        trials = [(fitted(sorted([*support, j]))[0] - best, -j) for j in range(k) if j not in support]
        if trials:
            gain, j = max(trials)
            if gain > eps:
                support = sorted([*support, -j])
                best += gain
                changed = True
        if not changed:
            break
    out = np.zeros(k)
    if support:
        out[support] = fitted(support)[1]
    return out


def chi2_upper(x: float, dof: int) -> float:
    """P(chi-squared > x)."""
    if x <= 0:
        return 1.0
    a, z = dof / 2, x / 2
    if z < a + 1:
        term = total = 1 / a
        for i in range(1, 2000):
            term *= z / (a + i)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a)))
    b, c = z + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-z + a * math.log(z) - math.lgamma(a))


def pooled_presence(total: float, n: int) -> float:
    """P of a sum of n independent half-zero, half chi-squared(1) statistics being as large.

    P(chi-squared of m + 2 > total) adds one Poisson-like term to that of m, so
    all n tails take one pass; the weights are binomial ones by logarithms.
    """
    if total <= 0:
        return 1.0
    z, half = total / 2, n * math.log(2)
    log_z, top = math.log(z), math.lgamma(n + 1)
    tails = [0.0, math.erfc(math.sqrt(z))]  # of an even and an odd number of degrees
    sums = []
    for m in range(1, n + 1):
        a = m / 2 - 1
        if m > 1:
            tails[m % 2] += math.exp(a * log_z - z - math.lgamma(a + 1))
        sums.append(math.exp(top - math.lgamma(m + 1) - math.lgamma(n - m + 1) - half) * min(1.0, tails[m % 2]))
    return math.fsum(sums)


def lrt(x: np.ndarray, w: np.ndarray, size: float) -> list[tuple[float, float]]:
    """(statistic, p) of each signature's presence."""
    full = nb_loglik(x, w @ nb_mle(x, w, size), size)
    out = []
    for j in range(w.shape[1]):
        rest = np.delete(w, j, 1)
        d = max(0.0, 2 * (full - nb_loglik(x, rest @ nb_mle(x, rest, size) if rest.shape[1] else np.zeros(len(x)), size)))
        out.append((d, 0.5 * math.erfc(math.sqrt(d / 2))))
    return out


def fisher_se(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Standard errors on the interior support, NaN elsewhere."""
    out, at = np.full(len(h), np.nan), np.flatnonzero(h > 0)
    if len(at):
        a, mu = w[:, at], np.maximum(w @ h, 1e-16)
        out[at] = np.sqrt(np.maximum(np.diag(np.linalg.pinv((a / mu[:, None]).T @ a)), 0))
    return out


def starts(v: np.ndarray, k: int, key: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Uniform factors scaled to the mean; a function of the key alone, whatever the task."""
    r = np.random.Generator(np.random.PCG64(np.random.SeedSequence(list(key))))
    s = math.sqrt(max(v.mean(), TINY) / k)
    return r.random((v.shape[0], k)) * s + TINY, r.random((k, v.shape[1])) * s + TINY


def kl(v: np.ndarray, wh: np.ndarray) -> float:
    return float(np.sum(np.where(v > 0, v * np.log(np.maximum(v, TINY) / np.maximum(wh, TINY)), 0) - v + wh))


def nmf_kl(v, w, h, rounds=200, l1_w=0.0, l1_h=0.0):
    """Multiplicative Kullback-Leibler updates, H then W; with penalties for sparse factors."""
    for _ in range(rounds):
        h = np.maximum(h * (w.T @ (v / np.maximum(w @ h, TINY))) / (w.sum(0)[:, None] + l1_h + TINY), TINY)
        w = np.maximum(w * ((v / np.maximum(w @ h, TINY)) @ h.T) / (h.sum(1)[None, :] + l1_w + TINY), TINY)
    return w, h


def nmf_eu(v, w, h, rounds=200):
    for _ in range(rounds):
        h = np.maximum(h * (w.T @ v) / (w.T @ w @ h + TINY), TINY)
        w = np.maximum(w * (v @ h.T) / (w @ (h @ h.T) + TINY), TINY)
    return w, h


def nmf_ard(v, w, h, a0=10.0, b0=5.0, rounds=500, tol=1e-5):
    """Automatic rank: components whose relevance falls to the floor die.  Returns (w, h, alive)."""
    m, n = v.shape
    c = (m + n) / 2 + a0 + 1
    lam = (0.5 * (w**2).sum(0) + 0.5 * (h**2).sum(1) + b0) / c
    for _ in range(rounds):
        h = h * (w.T @ (v / np.maximum(w @ h, TINY))) / (w.sum(0)[:, None] + h / lam[:, None] + TINY)
        w = w * ((v / np.maximum(w @ h, TINY)) @ h.T) / (h.sum(1)[None, :] + w / lam[None, :] + TINY)
        new = (0.5 * (w**2).sum(0) + 0.5 * (h**2).sum(1) + b0) / c
        done = np.max(np.abs(new - lam) / lam) < tol
        lam = new
        if done:
            break
    return w, h, (lam > 1.25 * b0 / c) & (w.sum(0) > 1e-5)


def nmf_volume(v, w, h, weight=0.1, delta=1.0, rounds=200):
    """Frobenius factors with a log-determinant penalty on W; steps shrink until the objective falls."""
    k = w.shape[1]

    def loss(w, h):
        return 0.5 * np.sum((v - w @ h) ** 2) + weight * np.linalg.slogdet(w.T @ w + delta * np.eye(k))[1]

    step, now = 1e-2, loss(w, h)
    for _ in range(rounds):
        h = np.maximum(h * (w.T @ v) / (w.T @ w @ h + TINY), TINY)
        now = loss(w, h)
        grad = (w @ h - v) @ h.T + 2 * weight * w @ np.linalg.inv(w.T @ w + delta * np.eye(k))
        while step > 1e-12:
            new = np.maximum(w - step * grad, TINY)
            if (value := loss(new, h)) <= now:
                w, now, step = new, value, step * 1.2
                break
            step *= 0.8
        else:
            break
    return w, h


def nndsvd(v: np.ndarray, k: int, fill: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic start from singular vectors; `fill` replaces zeros."""
    u, s, vt = np.linalg.svd(v, full_matrices=False)
    w, h = np.zeros((v.shape[0], k)), np.zeros((k, v.shape[1]))
    for j in range(min(k, len(s))):
        x, y = u[:, j], vt[j]
        up, vp, un, vn = np.maximum(x, 0), np.maximum(y, 0), np.maximum(-x, 0), np.maximum(-y, 0)
        a, b = np.linalg.norm(up) * np.linalg.norm(vp), np.linalg.norm(un) * np.linalg.norm(vn)
        p, q, z = (up, vp, a) if a >= b or j == 0 else (un, vn, b)
        if z > 0:
            w[:, j], h[j] = p / np.linalg.norm(p) * math.sqrt(s[j] * z), q / np.linalg.norm(q) * math.sqrt(s[j] * z)
    return np.where(w == 0, fill, w), np.where(h == 0, fill, h)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = np.linalg.norm(a, axis=0), np.linalg.norm(b, axis=0)
    return (a.T @ b) / np.maximum(np.outer(na, nb), 1e-300)


def silhouette(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Cosine silhouettes of columns; a singleton has 0, one cluster 1."""
    names = np.unique(labels)
    if len(names) == 1:
        return np.ones(x.shape[1])
    d, out = 1 - cosines(x, x), np.zeros(x.shape[1])
    for i in range(x.shape[1]):
        own = labels == labels[i]
        if own.sum() == 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in names if c != labels[i])
        out[i] = (b - a) / max(a, b, 1e-300)
    return out


def consensus(solutions: list[np.ndarray], seed: int, restarts: int = 20, rounds: int = 11):
    """(centroids, silhouette of each): replicates' columns matched one to one to centroids."""
    k = solutions[0].shape[1]
    flat = np.concatenate(solutions, 1)
    r = np.random.Generator(np.random.PCG64(seed))
    best = None
    for _ in range(restarts):
        centre = flat[:, r.choice(flat.shape[1], k, replace=False)]
        before = 0.0
        for _ in range(rounds):
            labels = np.concatenate([np.argsort(hungarian((1 - cosines(centre, s)))) for s in solutions])
            centre = np.stack([flat[:, labels == c].mean(1) for c in range(k)], 1)
            s = silhouette(flat, labels)
            if s.mean() == before:
                break
            before = s.mean()
        if best is None or before > best[0]:
            best = (before, centre, np.array([s[labels == c].mean() for c in range(k)]))
    return best[1], best[2]


def poisson_deviance(v: np.ndarray, mu: np.ndarray) -> float:
    return 2 * kl(v, np.maximum(mu, TINY))


def masked_cv(v: np.ndarray, k: int, fold: int, folds: int, seed: int, rounds: int = 300) -> tuple[float, float]:
    """(held-out deviance, train error) of one fold: held cells are refilled by the fit."""
    mask = (np.add.outer(np.arange(v.shape[0]), -np.arange(v.shape[1])) - fold) % folds == 0
    work = np.where(mask, np.nan, v)
    with np.errstate(all="ignore"):
        middle = np.nan_to_num(np.nanmedian(work, axis=1))
    work = np.maximum(np.where(mask, middle[:, None], v), 1e-4)
    w, h = starts(work, k, (seed, k, fold))
    before = None
    for _ in range(rounds):
        w, h = nmf_kl(work, w, h, 1)
        fit = w @ h
        error = math.sqrt(np.sum((v - fit)[~mask] ** 2) / max(1, (~mask).sum()))
        if before is not None and abs(before - error) < 1e-5 * max(before, TINY):
            break
        before = error
        work = np.maximum(np.where(mask, fit, v), 1e-4)
    return poisson_deviance(v[mask], (w @ h)[mask]), error


def piecewise(y: np.ndarray, kmin: int = 10, gamma: float = 25.0) -> list[int]:
    """Ends of the cheapest piecewise-constant segments: squares plus a penalty for each piece.

    A start is dropped for good when a cut at a later place costs no more, `kmin`
    places after that (when the later one is a start too).  This changes no least
    cost; the work is linear where the values change level or stay equal.
    """
    n = len(y)
    if not n:
        return []
    s, q = np.concatenate([[0], np.cumsum(y)]), np.concatenate([[0], np.cumsum(y * y)])
    cost, back = [np.inf] * (n + 1), np.zeros(n + 1, int)
    cost[0] = 0.0
    sums, squares = s.tolist(), q.tolist()
    # places, costs and sums of the starts in use, and where each is dropped
    at, until, used = np.zeros((4, 64)), np.zeros(64, int), 0
    for e in range(min(kmin, n), n + 1):
        new = max(e - kmin, 0)
        if cost[new] < np.inf:
            if used == at.shape[1]:
                keep = np.flatnonzero(until[:used] > e)
                at[:, : len(keep)], until[: len(keep)], used = at[:, keep], until[keep], len(keep)
                if 2 * used > at.shape[1]:
                    at, until = np.concatenate([at, np.zeros_like(at)], 1), np.concatenate([until, np.zeros_like(until)])
            at[:, used], until[used] = (new, cost[new], sums[new], squares[new]), n + 1
            used += 1
        place, before, sa, qa = at[:, :used]
        d = sums[e] - sa
        d *= d
        d /= e - place
        c = before + (squares[e] - qa)
        c -= d
        c += gamma
        j = int(c.argmin())
        cost[e], back[e] = float(c[j]), int(place[j])
        if e % 8 == 0:  # seldom is enough
            until[:used][(c - gamma >= cost[e]) & (until[:used] > n)] = e + kmin
    ends, e = [], n
    while e > 0:
        ends.append(e)
        e = back[e]
    return ends[::-1]


def gmm2(x: np.ndarray, seed: int, rounds: int = 200, count: np.ndarray | None = None):
    """(means, variances, weights, log likelihood) of two Gaussians in one dimension; `count` tells how often each value occurs."""
    count = np.ones(len(x)) if count is None else np.asarray(count, float)
    size = count.sum()
    a = x[np.searchsorted(np.cumsum(count), np.random.Generator(np.random.PCG64(seed)).integers(int(size)), side="right")]
    b = x[np.argmax(np.abs(x - a))]
    spread = np.average((x - np.average(x, weights=count)) ** 2, weights=count)
    mean, var, weight = np.array(sorted((a, b)), float), np.full(2, spread + 1e-6), np.full(2, 0.5)
    before = -np.inf
    for _ in range(rounds):
        logp = np.log(weight) - 0.5 * np.log(2 * np.pi * var) - 0.5 * (x[:, None] - mean) ** 2 / var
        top = logp.max(1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logp - top).sum(1))
        r = np.exp(logp - total[:, None]) * count[:, None]
        n = r.sum(0) + 1e-12
        weight, mean = n / size, (r * x[:, None]).sum(0) / n
        var = (r * (x[:, None] - mean) ** 2).sum(0) / n + 1e-6
        now = np.average(total, weights=count)
        if abs(now - before) < 1e-8:
            break
        before = now
    return mean, var, weight, float(before)


def bca_levels(draws: np.ndarray, point: float, acceleration: float, alpha: float = 0.05) -> tuple[float, float, bool]:
    """Percentile levels corrected for bias and skew; True if it falls back to plain levels."""
    nd, share = NormalDist(), float(np.mean(draws < point))
    if not 0.05 < share < 0.95:
        return alpha / 2, 1 - alpha / 2, True
    z0, out = nd.inv_cdf(share), []
    for z in (nd.inv_cdf(alpha / 2), nd.inv_cdf(1 - alpha / 2)):
        d = 1 - acceleration * (z0 + z)
        if d <= 0:
            return alpha / 2, 1 - alpha / 2, True
        out.append(nd.cdf(z0 + (z0 + z) / d))
    return out[0], out[1], False


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided test of k of n against one half."""
    if n == 0:
        return 1.0
    p = [math.comb(n, i) / 2**n for i in range(n + 1)]
    return min(1.0, sum(x for x in p if x <= p[k] * (1 + 1e-7)))


def indel83(seq: str, at: int, ref: str, alt: str) -> str | None:
    """ID83 label of an anchored indel; `at` is the anchor's index in `seq`.
    None if the anchor differs or an insertion only has microhomology."""
    if not 0 <= at < len(seq) or seq[at] != ref[0] or ref[0] != alt[0]:
        return None
    deletion = len(ref) > len(alt)
    unit = (ref if deletion else alt)[1:]
    n = len(unit)
    start = at + 1
    copies, i = 0, start + (n if deletion else 0)
    while seq[i : i + n] == unit:
        copies, i = copies + 1, i + n
    i = start
    while i - n >= 0 and seq[i - n : i] == unit:
        copies, i = copies + 1, i - n
    kind = "Del" if deletion else "Ins"
    if n == 1:
        return f"1:{kind}:{'C' if unit in 'CG' else 'T'}:{min(copies, 5)}"
    if not copies:
        after = seq[start + (n if deletion else 0) :][: n - 1]
        before = seq[max(0, start - n + 1) : start]
        forward = next((k for k in range(min(n - 1, len(after)), 0, -1) if after[:k] == unit[:k]), 0)
        backward = next((k for k in range(min(n - 1, len(before)), 0, -1) if before[-k:] == unit[-k:]), 0)
        micro = max(forward, backward)
        if micro:
            return f"{min(n, 5)}:Del:M:{min(micro, 5 if n >= 5 else n - 1)}" if deletion else None
    return f"{min(n, 5)}:{kind}:R:{min(copies, 5)}"


# ---- many samples at once: the kernels above, in step; rows are samples -------------


def times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, added up in one order, so that a row's numbers don't depend on the rows beside it."""
    out = np.zeros((len(x), w.shape[1]))
    for j in range(w.shape[0]):
        out += x[:, j, None] * w[j]
    return out


def crosses(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """w.T @ each row of `x`, to the last bit: draws are compared for equality with their sample's fit."""
    turned = w.T
    return np.array([turned @ row for row in x]).reshape(len(x), w.shape[1])


def nnls_rows(gram: np.ndarray, cross: np.ndarray, allowed: np.ndarray | None = None) -> np.ndarray:
    """nnls() of each row of `cross`; `allowed` (rows x k) leaves columns out of a row's problem."""
    rows, k = cross.shape
    ok = np.ones((rows, k), bool) if allowed is None else np.broadcast_to(allowed, (rows, k))
    scale = 1.0 / np.sqrt(np.maximum(np.diag(gram), TINY))
    g = gram * scale[:, None] * scale + np.eye(k) * 1e-12
    b = np.where(ok, cross * scale, 0.0)
    floor = 1e-10 * np.maximum(1.0, np.abs(b).max(1, initial=0))
    limit = 3 * ok.sum(1) + 30
    x, active, eye = np.zeros((rows, k)), np.zeros((rows, k), bool), np.eye(k)
    live = np.arange(rows) if k else np.zeros(0, int)
    step = 0
    while len(live):
        slope = np.where(ok[live] & ~active[live], b[live] - times(x[live], g), -np.inf)
        j = slope.argmax(1)
        go = (slope[np.arange(len(live)), j] > floor[live]) & (step < limit[live])
        live, j = live[go], j[go]
        active[live, j] = True
        todo = live
        while len(todo):
            on = active[todo]
            z = np.linalg.solve(np.where(on[:, :, None] & on[:, None, :], g, eye), np.where(on, b[todo], 0.0)[:, :, None])[:, :, 0]
            bad = on & (z <= 0)
            done = ~bad.any(1)
            x[todo[done]] = np.where(on[done], z[done], 0.0)
            todo, on, z, bad = todo[~done], on[~done], z[~done], bad[~done]
            if not len(todo):
                break
            old = x[todo]
            part = np.where(bad, old / np.maximum(old - z, 1e-300), np.inf).min(1)
            moved = np.where(on, old + part[:, None] * (z - old), 0.0)
            moved[bad & (moved <= 1e-14)] = 0
            stuck = np.flatnonzero(~(bad & (moved == 0)).any(1))
            moved[stuck, np.where(bad, moved, np.inf)[stuck].argmin(1)] = 0
            x[todo], active[todo] = moved, on & (moved > 0)
        step += 1
    return x * scale


def log_gammas(x: np.ndarray, size: float) -> np.ndarray:
    """log(gamma(x + size) / gamma(x + 1)) of each number; equal ones are worked out once."""
    one, at = np.unique(x, return_inverse=True)
    return np.array([math.lgamma(a + size) - math.lgamma(a + 1) for a in one.tolist()])[at.reshape(x.shape)]


def nb_loglik_rows(x: np.ndarray, mu: np.ndarray, size: float, lg: np.ndarray) -> np.ndarray:
    mu = mu + 1e-16
    return np.sum(lg - math.lgamma(size) + size * np.log(size / (size + mu)) + x * np.log(mu / (size + mu)), 1)


def nb_mle_rows(x: np.ndarray, w: np.ndarray, size: float, lg: np.ndarray) -> np.ndarray:
    """nb_mle() of each row of `x`."""
    k = w.shape[1]
    h = nnls_rows(w.T @ w, times(x, w))
    none = ~h.any(1)
    h[none] = (x[none].sum(1) / max(1, k))[:, None]
    h = np.maximum(h, 0) + 1e-9
    f, first, live = nb_loglik_rows(x, times(h, w.T), size, lg), None, np.arange(len(x))
    top = np.zeros(len(x))
    for turn in range(300):
        xs, hs = x[live], h[live]
        mu = times(hs, w.T)
        g = times(xs / (1e-16 + mu) - (size + xs) / (size + mu), w)
        free = (hs > 0) | (g > 0)
        pg = np.where(free, g, 0.0)
        most = np.abs(pg).max(1, initial=0)
        if turn == 0:
            top = most
        go = most > 1e-8 * (1 + top[live])
        live, xs, hs, mu, g, free, pg = live[go], xs[go], hs[go], mu[go], g[go], free[go], pg[go]
        if not len(live):
            break
        c = np.maximum(xs / np.maximum(mu, 1e-16) ** 2 - (size + xs) / (size + mu) ** 2, xs / (size + mu) ** 2 + 1e-12)
        a = np.matmul(w.T[None] * c[:, None, :], w) + 1e-10 * np.eye(k)
        d = np.linalg.solve(np.where(free[:, :, None] & free[:, None, :], a, np.eye(k)), pg[:, :, None])[:, :, 0]
        back = (g * d).sum(1) <= 0
        d[back] = pg[back]
        length, value, new = np.ones(len(live)), f[live].copy(), hs.copy()
        moved, todo = np.zeros(len(live), bool), np.arange(len(live))
        for _ in range(80):
            at = live[todo]
            new[todo] = np.maximum(hs[todo] + length[todo, None] * d[todo], 0)
            value[todo] = nb_loglik_rows(x[at], times(new[todo], w.T), size, lg[at])
            fine = value[todo] >= f[at] + 1e-4 * (g[todo] * (new[todo] - hs[todo])).sum(1)
            moved[todo[fine]] = True
            todo = todo[~fine]
            if not len(todo):
                break
            length[todo] /= 2
        stop = ~moved | (np.abs(value - f[live]) <= 1e-10 * (1 + np.abs(f[live])))
        h[live[moved]] = new[moved]
        f[live] = np.where(moved, value, f[live])
        live = live[~stop]
        if not len(live):
            break
    return h


def bidirectional_rows(x: np.ndarray, w: np.ndarray, eps: float = 1e-3, rounds: int = 1000) -> np.ndarray:
    """bidirectional() of each row of `x`."""
    k, gram, cross, n = w.shape[1], w.T @ w, times(x, w), np.maximum(x.sum(1), 1.0)

    def fitted(at, on):
        h = nnls_rows(gram, cross[at], on)
        p = times(h, w.T)
        return np.sum(x[at] * np.log(p / np.maximum(p.sum(1), 1e-300)[:, None] + 1e-16), 1) / n[at], h

    support = nnls_rows(gram, cross) > 0
    best = np.full(len(x), -np.inf)
    some = np.flatnonzero(support.any(1))
    best[some] = fitted(some, support[some])[0]
    live = np.arange(len(x))
    for _ in range(rounds):
        changed = np.zeros(len(x), bool)
        for add in (False, True):
            rows = live if add else live[support[live].sum(1) > 1]
            trial = np.full((len(rows), k), np.inf)
            for j in range(k):
                at = np.flatnonzero(support[rows, j] != add)
                on = support[rows[at]]
                on[:, j] = add
                if len(at):
                    trial[at, j] = best[rows[at]] - fitted(rows[at], on)[0]
            if not len(rows) or not k:
                continue
            j = trial.argmin(1)
            cost = trial[np.arange(len(rows)), j]
            good = -cost > eps if add else cost < eps
            at, j, cost = rows[good], j[good], cost[good]
            support[at, j] = add
            with np.errstate(invalid="ignore"):  # a row without counts
                best[at] -= cost
            changed[at] = True
        live = live[changed[live]]
        if not len(live):
            break
    out = np.zeros((len(x), k))
    some = np.flatnonzero(support.any(1))
    out[some] = fitted(some, support[some])[1]
    return out


def lrt_rows(x: np.ndarray, w: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """lrt() of each row of `x`: statistics and p values, rows x signatures."""
    lg, k = log_gammas(x, size), w.shape[1]
    full, stat = nb_loglik_rows(x, times(nb_mle_rows(x, w, size, lg), w.T), size, lg), np.zeros((len(x), k))
    for j in range(k):
        rest = np.delete(w, j, 1)
        mu = times(nb_mle_rows(x, rest, size, lg), rest.T) if rest.shape[1] else np.zeros(x.shape)
        stat[:, j] = np.maximum(0.0, 2 * (full - nb_loglik_rows(x, mu, size, lg)))
    return stat, np.array([0.5 * math.erfc(v) for v in np.sqrt(stat / 2).ravel().tolist()]).reshape(stat.shape)


def fisher_se_rows(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """fisher_se() of each row of `h`; rows of one support are inverted together."""
    out = np.full(h.shape, np.nan)
    kinds, kind = np.unique(h > 0, axis=0, return_inverse=True)
    mu = np.maximum(times(h, w.T), 1e-16)
    for i, on in enumerate(kinds):
        at = np.flatnonzero(on)
        if len(at):
            rows = np.flatnonzero(kind.ravel() == i)
            a = w[:, at]
            inverse = np.linalg.pinv(np.matmul(a.T[None] / mu[rows][:, None, :], a))
            out[np.ix_(rows, at)] = np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0))
    return out
