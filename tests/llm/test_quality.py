"""The quality model's parts against plain versions."""

import math
from collections import Counter

import numpy as np

from loamwork.llm.quality import DIMS, dual_descent, log_count_ratios


def sample(seed, n=60):
    rng = np.random.default_rng(seed)
    y = np.where(rng.random(n) < 0.5, 1, -1)
    rows = [np.unique(np.r_[rng.integers(0, 40, 8), rng.integers(40, 60, 4) + (20 if v > 0 else 0)]) for v in y]
    return rows, y


def test_log_count_ratios():
    rows, y = sample(1)
    got = log_count_ratios(rows, y, smooth=1.0, least=4)
    counts = {c: Counter(int(k) for x, v in zip(rows, y, strict=True) if v == c for k in x) for c in (1, -1)}
    total = {c: sum(counts[c].values()) + DIMS for c in counts}
    for k in range(90):
        p, q = ((counts[c][k] + 1) / total[c] for c in (1, -1))
        want = math.log(p / q) if counts[1][k] + counts[-1][k] >= 4 else 0.0
        assert abs(got[k] - want) < 1e-9, k
    assert not got[90:].any()


def test_dual_descent_reaches_the_optimum():
    rows, y = sample(2)
    y[:6] *= -1  # some rows no plane can part
    r = log_count_ratios(rows, y)
    w = dual_descent(rows, r, y, np.full(len(y), 1.0), epochs=200)
    x = np.zeros((len(rows), 91))
    for i, k in enumerate(rows):
        x[i, k] = r[k] / math.sqrt(len(k))
    x[:, 90] = 1
    u = np.r_[np.where(r[:90] != 0, w[:90] / np.where(r[:90] != 0, r[:90], 1), 0), w[-1]]
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    a = np.zeros(len(y))
    for _ in range(40_000):  # plain projected gradient on the dual
        a = np.clip(a + 0.5 / np.linalg.norm(gram, 2) * (1 - gram @ a), 0, 1)
    dual = a.sum() - a @ gram @ a / 2
    primal = u @ u / 2 + np.maximum(0, 1 - y * (x @ u)).sum()
    assert dual - 1e-6 <= primal <= dual * 1.001
