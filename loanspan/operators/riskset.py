"""Risk-set sums for the Cox family, computed on executors one month at a time.

With month clocks the risk set of an event month t is entry < t <= exit. Its sums of w, w z and
w z z' are the sums over loans entered before t minus the sums over loans gone before t, so one
scan grouped by entry month and by (exit month, cause) is all a Newton step needs. At most a few
hundred month rows reach the driver, whatever the number of loans; hot months are combined
map-side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanspan.contracts import ContractError
from loanspan.operators.ties import TieTerms, tie_terms

MAX_MONTH_ROWS = 100_000


@dataclass
class Scaling:
    """Means and standard deviations the predictors are standardized with."""

    names: list[str]
    mean: np.ndarray
    std: np.ndarray
    rows: int


def scale(frame: DataFrame, names: list[str], center: bool = True) -> Scaling:
    """One aggregate for the row count, means and sample standard deviations."""
    row = frame.agg(
        F.count("*").alias("rows"),
        *[F.avg(F.col(n).cast("double")).alias(f"m_{n}") for n in names],
        *[F.stddev_samp(F.col(n).cast("double")).alias(f"s_{n}") for n in names],
    ).first()
    mean = np.array([row[f"m_{n}"] for n in names], dtype=float)
    std = np.array([row[f"s_{n}"] or 0.0 for n in names], dtype=float)
    if not np.isfinite(mean).all() or not np.isfinite(std).all() or (std <= 0).any():
        raise ContractError(f"A predictor of {names} is constant or not finite.")
    return Scaling(names, mean, std, row["rows"])


def standardized(frame: DataFrame, scaling: Scaling, keep: list[Column]) -> DataFrame:
    """Clock columns plus z0..zk, the table every Newton step scans."""
    return frame.select(
        *keep,
        *[
            ((F.col(n).cast("double") - float(m)) / float(s)).alias(f"z{i}")
            for i, (n, m, s) in enumerate(zip(scaling.names, scaling.mean, scaling.std))
        ],
    )


def linear_score(beta: np.ndarray) -> Column:
    score = F.lit(0.0)
    for i, b in enumerate(beta):
        score = score + F.col(f"z{i}") * float(b)
    return score


@dataclass
class MonthSums:
    """Dense arrays over months 0..T.

    `entry` and `exit[code]` hold (w, w z, w z z') rows; the counts and the unweighted predictor
    sums do not depend on the coefficients.
    """

    p: int
    months: int
    entry: np.ndarray
    entry_n: np.ndarray
    exit: dict[int, np.ndarray] = field(default_factory=dict)
    exit_n: dict[int, np.ndarray] = field(default_factory=dict)
    exit_z: dict[int, np.ndarray] = field(default_factory=dict)

    def count(self, code: int) -> np.ndarray:
        return self.exit_n.get(code, np.zeros(self.months))

    def gone(self) -> np.ndarray:
        """Loans leaving in each month for any reason."""
        return sum(self.exit_n.values())


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def month_sums(table: DataFrame, betas: list[np.ndarray]) -> list[MonthSums]:
    """Scan `table(entry, exit, code, z0..)` once for all given coefficient vectors."""
    p = len(betas[0])
    weighted = table.withColumns({f"w{b}": F.exp(linear_score(v)) for b, v in enumerate(betas)})
    sums = [F.count("*").alias("n")] + [F.sum(f"z{i}").alias(f"e{i}") for i in range(p)]
    for b in range(len(betas)):
        w = F.col(f"w{b}")
        sums.append(F.sum(w).alias(f"s{b}"))
        sums += [F.sum(w * F.col(f"z{i}")).alias(f"s{b}_{i}") for i in range(p)]
        sums += [
            F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{b}_{i}_{j}") for i, j in _pairs(p)
        ]
    # Rows meet one hash aggregate per step; only its cells, a few thousand, are grouped twice.
    cells = weighted.groupBy("entry", "exit", "code").agg(*sums)
    again = [F.sum(c).alias(c) for c in cells.columns if c not in ("entry", "exit", "code")]
    grouped = cells.groupingSets(
        [[F.col("entry")], [F.col("exit"), F.col("code")]],
        F.col("entry"),
        F.col("exit"),
        F.col("code"),
    ).agg(*again)
    rows = grouped.limit(MAX_MONTH_ROWS + 1).collect()
    if len(rows) > MAX_MONTH_ROWS:
        raise ContractError("The clock has too many distinct months for month sums.")
    return [_dense(rows, b, p) for b in range(len(betas))]


def _dense(rows, b: int, p: int) -> MonthSums:
    months = 1 + max(max(r["entry"] or 0, r["exit"] or 0) for r in rows)
    width = 1 + p + p * p

    def blank():
        return np.zeros((months, width))

    out = MonthSums(p, months, blank(), np.zeros(months))
    for r in rows:
        vec = np.zeros(width)
        vec[0] = r[f"s{b}"]
        vec[1 : 1 + p] = [r[f"s{b}_{i}"] for i in range(p)]
        square = np.zeros((p, p))
        for i, j in _pairs(p):
            square[i, j] = square[j, i] = r[f"s{b}_{i}_{j}"]
        vec[1 + p :] = square.ravel()
        if r["exit"] is None:
            out.entry[r["entry"]] += vec
            out.entry_n[r["entry"]] += r["n"]
            continue
        code, month = int(r["code"]), r["exit"]
        out.exit.setdefault(code, blank())[month] += vec
        out.exit_n.setdefault(code, np.zeros(months))[month] += r["n"]
        out.exit_z.setdefault(code, np.zeros((months, p)))[month] += [
            r[f"e{i}"] for i in range(p)
        ]
    return out


def _between(entered: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Sums over entry < t <= exit for every month t."""
    risk = np.zeros_like(entered)
    risk[1:] = np.cumsum(entered, axis=0)[:-1] - np.cumsum(left, axis=0)[:-1]
    return risk


def at_risk_sums(sums: MonthSums) -> np.ndarray:
    return _between(sums.entry, sum(sums.exit.values()))


def at_risk_counts(sums: MonthSums) -> np.ndarray:
    return _between(sums.entry_n, sums.gone())


@dataclass
class EventMonth:
    """Likelihood pieces of one event month."""

    month: int
    deaths: int
    loglik: float
    residual: np.ndarray
    mean: np.ndarray
    information: np.ndarray
    total: np.ndarray
    tied: np.ndarray
    terms: TieTerms


def event_months(sums: MonthSums, risk: np.ndarray, code: int, beta: np.ndarray) -> list[EventMonth]:
    """Efron log-likelihood, residual and information contributions per event month of a cause."""
    p = sums.p
    result = []
    for t in np.nonzero(sums.count(code))[0]:
        d = int(sums.count(code)[t])
        total, tied = risk[t], sums.exit[code][t]
        s0, s1, s2 = total[0], total[1 : 1 + p], total[1 + p :].reshape(p, p)
        d0, d1, d2 = tied[0], tied[1 : 1 + p], tied[1 + p :].reshape(p, p)
        k = tie_terms(s0, d0, d)
        mean_sum = s1 * k.inv - d1 * k.inv_f
        cross = np.outer(s1, d1)
        outer = (
            np.outer(s1, s1) * k.inv2 - (cross + cross.T) * k.inv2_f + np.outer(d1, d1) * k.inv2_ff
        )
        event_z = sums.exit_z[code][t]
        result.append(
            EventMonth(
                int(t),
                d,
                float(event_z @ beta) - k.log_d,
                event_z - mean_sum,
                mean_sum / d,
                s2 * k.inv - d2 * k.inv_f - outer,
                total,
                tied,
                k,
            )
        )
    return result


@dataclass
class Fit:
    """Maximum of a (penalized) Efron partial likelihood in standardized units."""

    beta: np.ndarray
    information: np.ndarray
    loglik: float
    converged: bool
    iterations: int
    sums: MonthSums
    months: list[EventMonth]


def newton(p: int, code: int, risk_of=at_risk_sums, penalty=0.0, tolerance=1e-20, max_steps=50):
    """Newton's method with step halving, as a generator.

    It yields the coefficients it wants evaluated and is sent their `MonthSums`, so several fits
    can share one scan of the rows. Its return value is a `Fit`. It stops when a step would gain
    less than `tolerance` of a chi-square value, that is move no coefficient by more than its root
    in standard errors; rounding in sums of n rows stays below 1e-31 n of that.
    """

    def state(b, sums):
        try:
            months = event_months(sums, risk_of(sums), code, b)
        except ContractError:
            return None
        gradient = sum((m.residual for m in months), np.zeros(p)) - penalty * b
        info = sum((m.information for m in months), np.zeros((p, p))) + penalty * np.eye(p)
        ll = sum(m.loglik for m in months) - 0.5 * penalty * float(b @ b)
        return (gradient, info, ll, sums, months) if np.isfinite(ll) else None

    beta = np.zeros(p)
    current = state(beta, (yield beta))
    if current is None:
        raise ContractError("A risk set of the data has no weight.")
    for step_number in range(1, max_steps + 1):
        gradient, info, ll, sums, months = current
        try:
            step = np.linalg.solve(info, gradient)
        except np.linalg.LinAlgError as error:
            raise ContractError("The predictors are linearly dependent.") from error
        if float(gradient @ step) < tolerance:
            return Fit(beta, info, ll, True, step_number, sums, months)
        size, trial = 1.0, None
        while size > 1e-4:
            candidate = beta + size * step
            trial = state(candidate, (yield candidate))
            if trial is not None and trial[2] >= ll - 1e-9 * abs(ll):
                break
            size, trial = size / 2, None
        if trial is None:
            return Fit(beta, info, ll, False, step_number, sums, months)
        beta, current = candidate, trial
    return Fit(beta, current[1], current[2], False, max_steps, current[3], current[4])


def run_fits(table: DataFrame, fits: list) -> list[Fit]:
    """Drive several `newton` generators in step: one scan serves all that are still running."""
    wanted = {i: next(fit) for i, fit in enumerate(fits)}
    done: dict[int, Fit] = {}
    while wanted:
        order = sorted(wanted)
        answers = month_sums(table, [wanted[i] for i in order])
        for i, sums in zip(order, answers):
            try:
                wanted[i] = fits[i].send(sums)
            except StopIteration as stop:
                done[i] = stop.value
                del wanted[i]
    return [done[i] for i in range(len(fits))]


def raw_units(fit: Fit, scaling: Scaling) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and model-based covariance in the predictors' own units."""
    covariance = np.linalg.inv(fit.information) / np.outer(scaling.std, scaling.std)
    return fit.beta / scaling.std, covariance
