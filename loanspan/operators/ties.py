"""Efron's sums over the tied events of a month, in a time that hardly depends on their number.

With d events of total weight D in a risk set of weight T, the k-th step (k = 0 .. d-1) has the
weight x = T - k D / d. The fit needs the sums of log x, 1/x and 1/x^2, the latter two also times
k/d and (k/d)^2. The last `LAST` steps, next to where x may vanish, are added one by one. The others
are smooth in k, so Euler and Maclaurin's formula gives their sum: the integral, half of the two
ends, and a few odd derivatives. The integral is taken by Gauss's rule on pieces that double with
the distance from the zero of x. All terms but the logarithm are positive and nothing cancels,
however small D is against T.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial

import numpy as np

from loanspan.contracts import ContractError

#: Steps added one by one.
LAST = 32
#: Bernoulli numbers B2, B4, .. over (2j)!.
CORRECTIONS = [b / factorial(2 * j) for j, b in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66), 1)]
NODES, WEIGHTS = np.polynomial.legendre.leggauss(16)


@dataclass
class TieTerms:
    """Efron sums over the d steps of one tied event month."""

    log_d: float
    inv: float
    inv_f: float
    inv2: float
    inv2_f: float
    inv2_ff: float


def _terms(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    inv = 1.0 / x
    return np.stack([np.log(x), inv, f * inv, inv**2, f * inv**2, f * f * inv**2])


def _derivative(n: int, x: float, f: float, step: float, d: int) -> np.ndarray:
    """n-th derivative of the terms by k, n odd."""

    def log(m):
        return -factorial(m - 1) * (step / x) ** m

    def inv(m):
        return factorial(m) * (step / x) ** m / x

    def square(m):
        return factorial(m + 1) * (step / x) ** m / x**2

    # f = k / d is linear, so a product with it has two terms and one with its square three.
    once = [f * g(n) + n / d * g(n - 1) for g in (inv, square)]
    twice = f * f * square(n) + 2 * n * f / d * square(n - 1)
    if n > 1:
        twice += n * (n - 1) / d**2 * square(n - 2)
    return np.array([log(n), inv(n), once[0], square(n), once[1], twice])


def _smooth(total: float, step: float, d: int, count: int) -> np.ndarray:
    """Sum of the terms of k = 0 .. count-1, at least `LAST` steps before x may vanish."""
    edges = [float(count)]
    while edges[-1] > 0:
        # As far again from the zero of x, at k = total / step.
        away = total - edges[-1] * step
        edges.append(max(0.0, edges[-1] - away / step) if step > 0 else 0.0)
    ends = np.array(edges[::-1])
    half, middle = np.diff(ends)[:, None] / 2, (ends[1:] + ends[:-1])[:, None] / 2
    k = (middle + half * NODES).ravel()
    found = _terms(total - k * step, k / d) @ (half * WEIGHTS).ravel()
    low, high = np.array([0.0]), np.array([float(count)])
    found += ((_terms(total - low * step, low / d) - _terms(total - high * step, high / d)) / 2)[:, 0]
    for j, factor in enumerate(CORRECTIONS, 1):
        n = 2 * j - 1
        found += factor * (
            _derivative(n, total - count * step, count / d, step, d) - _derivative(n, total, 0.0, step, d)
        )
    return found


def tie_terms(total: float, tied: float, d: int) -> TieTerms:
    """Sums over the steps of `d` events of weight `tied` in a risk set of weight `total`."""
    step = tied / d
    if not total - (d - 1) * step > 0:
        raise ContractError("A risk set lost its weight; the fit cannot continue.")
    count = d - LAST if d > 2 * LAST else 0
    k = np.arange(count, d)
    found = _terms(total - k * step, k / d).sum(1)
    if count:
        found += _smooth(total, step, d, count)
    return TieTerms(*found.tolist())
