"""Extension point: engines that users register, and a benchmark over them."""

from __future__ import annotations

import importlib.util
import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tallyforge.model import EngineError
from tallyforge.operators import numerics as N


@dataclass(frozen=True)
class Engine:
    name: str
    mode: str
    fit: Callable
    packages: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    certified: bool | None = None


_ENGINES: dict[tuple[str, str], Engine] = {}
_WARNED: set[str] = set()


def register(name: str, mode: str, fit: Callable, packages=(), tags=(), certified: bool | None = None) -> Engine:
    if mode not in ("extract", "fit"):
        raise EngineError("argument", f"mode {mode} is neither extract nor fit")
    if not callable(fit):
        raise EngineError("argument", "fit isn't callable")
    engine = Engine(name, mode, fit, tuple(packages), tuple(tags), certified)
    _ENGINES[mode, name] = engine
    return engine


def match(name: str, mode: str) -> Engine:
    try:
        return _ENGINES[mode, name]
    except KeyError:
        raise EngineError("argument", f"no {mode} engine {name}", hint=", ".join(n for m, n in _ENGINES if m == mode)) from None


def engines(mode: str | None = None) -> list[Engine]:
    return [e for (m, _), e in sorted(_ENGINES.items()) if mode in (None, m)]


def required_packages(name: str, mode: str) -> dict[str, bool]:
    return {p: importlib.util.find_spec(p) is not None for p in match(name, mode).packages}


def run(name: str, mode: str, *args, **kwargs):
    """Dispatch; a missing package is an error, an uncertified engine warns once."""
    engine = match(name, mode)
    missing = [p for p, there in required_packages(name, mode).items() if not there]
    if missing:
        raise EngineError("package", f"{name} needs {', '.join(missing)}")
    if engine.certified is False and name not in _WARNED:
        _WARNED.add(name)
        warnings.warn(f"engine {name} isn't certified", stacklevel=2)
    return engine.fit(*args, **kwargs)


def reset() -> None:
    _ENGINES.clear()
    _WARNED.clear()
    for kind, kernel in (("kl", N.nmf_kl), ("eu", N.nmf_eu), ("volume", N.nmf_volume)):
        register(kind, "extract", lambda v, k, seed=1, rounds=200, f=kernel: f(v, *N.starts(v, k, (seed, 0, k)), rounds=rounds), certified=True)
    register("ard", "extract", lambda v, k, seed=1, rounds=500: N.nmf_ard(v, *N.starts(v, k, (seed, 0, k)), rounds=rounds)[:2], certified=True)
    register("nnls", "fit", lambda x, w: N.nnls(w.T @ w, w.T @ x), certified=True)
    register("likelihood_bidirectional", "fit", N.bidirectional, certified=True)


reset()


def benchmark(spark, names: list[str], scenarios: list[dict]):
    """(engine, scenario, metric, estimate) of extraction on planted data; a failing cell has only cell_error."""
    rows = []
    for s in scenarios:
        r = np.random.Generator(np.random.PCG64(s.get("seed", 1)))
        m, k, n = s.get("channels", 24), s.get("k", 3), s.get("n_samples", 20)
        w = r.dirichlet(np.full(m, 0.2), k).T
        h = r.dirichlet(np.ones(k), n).T * s.get("burden", 3000)
        v = r.poisson(w @ h).astype(float)
        for name in names:
            try:
                began = time.time()
                got, _ = run(name, "extract", v, k)
                cos = N.cosines(w, got)
                best = cos[np.arange(k), N.hungarian(1 - cos)] if got.shape[1] >= k else np.zeros(k)
                tp = int((best >= 0.9).sum())
                p, q = tp / max(1, got.shape[1]), tp / k
                found = {"precision": p, "recall": q, "f1": 2 * p * q / (p + q) if tp else 0.0, "runtime": time.time() - began}
            except Exception as error:  # one cell's failure is its own result
                found = {"cell_error": float(bool(str(error)))}
            rows += [(name, s["name"], metric, float(x)) for metric, x in found.items()]
    return spark.createDataFrame(rows, "engine string, scenario string, metric string, estimate double")
