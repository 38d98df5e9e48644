"""Slow, direct numpy versions of the estimators; risk sets are rebuilt for every event."""

import math

import numpy as np


def loans(seed=0, n=600, p=3, zero_entry=False):
    """Random loans with delayed entry, tied months and known effects on two causes."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    entry = np.zeros(n, int) if zero_entry else rng.integers(0, 10, n)
    rate1 = 0.02 * np.exp(x @ np.linspace(0.5, -0.5, p))
    rate2 = 0.03 * np.exp(x @ np.linspace(-0.3, 0.3, p))
    t1, t2 = rng.exponential(1 / rate1), rng.exponential(1 / rate2)
    c = rng.uniform(5, 40, n)
    time = np.minimum(np.minimum(t1, t2), c)
    code = np.where(time == t1, 1, np.where(time == t2, 2, 0))
    exit_ = entry + 1 + np.floor(time).astype(int)
    return entry, exit_, code, x


def curves(entry, exit_, code, weights=None):
    """Survival and both incidences per month with entry < t <= exit."""
    w = np.ones(len(entry)) if weights is None else weights
    s, f, out = 1.0, {1: 0.0, 2: 0.0}, {}
    for t in range(entry.min(), exit_.max() + 1):
        risk = (entry < t) & (exit_ >= t)
        n = w[risk].sum()
        d = {k: w[risk & (exit_ == t) & (code == k)].sum() for k in (1, 2)}
        if n > 0:
            for k in (1, 2):
                f[k] += s * d[k] / n
            s *= 1 - (d[1] + d[2]) / n
        out[t] = (s, f[1], f[2], int(n))
    return out


def kaplan_meier(entry, exit_, event):
    s, green, out = 1.0, 0.0, {}
    for t in range(entry.min(), exit_.max() + 1):
        n = ((entry < t) & (exit_ >= t)).sum()
        d = ((exit_ == t) & (event == 1)).sum()
        if n > 0:
            s *= 1 - d / n
            if d and n > d:
                green += d / (n * (n - d))
        out[t] = (s, green)
    return out


def efron(entry, exit_, event, x, beta, weights=None, penalty=0.0):
    """Log-likelihood, gradient, information and per-row score residuals."""
    eta = x @ beta
    w = np.exp(eta) * (1 if weights is None else weights)
    p = x.shape[1]
    ll, grad, info, resid = 0.0, np.zeros(p), np.zeros((p, p)), np.zeros(x.shape)
    for t in np.unique(exit_[event == 1]):
        risk = (entry < t) & (exit_ >= t)
        dead = (exit_ == t) & (event == 1)
        d = dead.sum()
        ll += eta[dead].sum()
        grad += x[dead].sum(0)
        for k in range(d):
            ww = w * risk * np.where(dead, 1 - k / d, 1.0)
            s0 = ww.sum()
            m = ww @ x / s0
            ll -= math.log(s0)
            grad -= m
            info += (x * ww[:, None]).T @ x / s0 - np.outer(m, m)
            resid -= (ww / s0)[:, None] * (x - m)
            resid[dead] += (x[dead] - m) / d
    ll -= 0.5 * penalty * beta @ beta
    return ll, grad - penalty * beta, info + penalty * np.eye(p), resid


def fit(entry, exit_, event, x, weights=None, penalty=0.0):
    beta = np.zeros(x.shape[1])
    for _ in range(25):
        _, grad, info, _ = efron(entry, exit_, event, x, beta, weights, penalty)
        beta = beta + np.linalg.solve(info, grad)
    return beta, *efron(entry, exit_, event, x, beta, weights, penalty)


def concordance(score, exit_, event):
    good = ties = pairs = 0
    for i in np.flatnonzero(event == 1):
        later = (exit_ > exit_[i]) | ((exit_ == exit_[i]) & (event == 0))
        pairs += later.sum()
        good += (score[later] < score[i]).sum()
        ties += (score[later] == score[i]).sum()
    return good, ties, pairs
