"""Non-parametric curves against direct computation."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loanspan.contracts import ContractError
from loanspan.operators import aalen_johansen as aj
from loanspan.operators import kaplan_meier as km
from tests import brute

Z95 = 1.959963984540054
KINDS = ["CENSOR", "DEFAULT", "PREPAYMENT"]


def frame(spark, entry, exit_, code, group=None):
    rows = [
        (f"L{i}", 2020, int(e), int(x), int(x), int(c == 1), int(c), KINDS[c],
         "a" if group is None else str(group[i]))
        for i, (e, x, c) in enumerate(zip(entry, exit_, code))
    ]
    return spark.createDataFrame(
        rows,
        "loan_id string, vintage_year smallint, entry_time_month int, exit_time_month int, "
        "duration_months int, km_default_event tinyint, cr_event_code tinyint, event_type string, "
        "g string",
    )


def test_kaplan_meier_matches(spark):
    e, x, c, _ = brute.loans(1, 300)
    truth = brute.kaplan_meier(e, x, (c == 1).astype(int))
    got = km.validate_km_results(km.fit_kaplan_meier(frame(spark, e, x, c))).collect()
    assert [r.analysis_time for r in sorted(got, key=lambda r: r.analysis_time)] == list(truth)
    for r in got:
        s, g = truth[r.analysis_time]
        assert r.survival == pytest.approx(s, abs=1e-12)
        present = ((e <= r.analysis_time) & (x >= r.analysis_time)).sum()
        assert r.n_at_risk == present
        if 0 < s < 1:
            theta = Z95 * math.sqrt(g) / abs(math.log(s))
            assert r.ci_lower == pytest.approx(s ** math.exp(theta), abs=1e-10)
            assert r.ci_upper == pytest.approx(s ** math.exp(-theta), abs=1e-10)


def test_survival_zero_has_zero_limits(spark):
    e, x, c = np.array([0, 0, 1]), np.array([2, 3, 3]), np.array([1, 1, 1])
    last = max(km.fit_kaplan_meier(frame(spark, e, x, c)).collect(), key=lambda r: r.analysis_time)
    assert (last.survival, last.ci_lower, last.ci_upper) == (0.0, 0.0, 0.0)


def test_incidence_and_limits_match_jackknife_derivative(spark):
    e, x, c, _ = brute.loans(2, 80)
    got = {
        (r.endpoint, r.analysis_time): r
        for r in aj.validate_aj_results(aj.fit_aalen_johansen(frame(spark, e, x, c))).collect()
    }
    truth = brute.curves(e, x, c)
    n = len(e)
    step = 1e-5
    influence = {}
    for i in range(n):
        up, down = np.ones(n), np.ones(n)
        up[i] += step
        down[i] -= step
        a, b = brute.curves(e, x, c, up), brute.curves(e, x, c, down)
        influence[i] = {
            t: ((a[t][1] - b[t][1]) / (2 * step), (a[t][2] - b[t][2]) / (2 * step)) for t in truth
        }
    assert {t for _, t in got} == set(x.tolist())
    for (endpoint, t), r in got.items():
        k = 0 if endpoint == "DEFAULT" else 1
        f = truth[t][1 + k]
        assert r.cumulative_incidence == pytest.approx(f, abs=1e-12)
        assert r.n_at_risk == truth[t][3]
        if 0 < f < 1:
            se = math.sqrt(sum(influence[i][t][k] ** 2 for i in range(n)))
            theta = Z95 * se / (f * abs(math.log(f)))
            assert r.ci_lower == pytest.approx(f ** math.exp(theta), abs=1e-7)
            assert r.ci_upper == pytest.approx(f ** math.exp(-theta), abs=1e-7)


def test_groups_equal_separate_fits(spark):
    e, x, c, _ = brute.loans(3, 200)
    g = np.arange(200) % 3
    df = frame(spark, e, x, c, g)
    together = aj.fit_aalen_johansen(df, "g").collect()
    for value in "012":
        alone = aj.fit_aalen_johansen(df.filter(f"g = '{value}'")).collect()
        a = {(r.endpoint, r.analysis_time): r for r in alone}
        b = {(r.endpoint, r.analysis_time): r for r in together if r.group_value == value}
        assert a.keys() == b.keys()
        for key in a:
            for col in ("cumulative_incidence", "ci_lower", "ci_upper"):
                assert a[key][col] == pytest.approx(b[key][col], abs=1e-9)


@settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(st.integers(0, 5), st.integers(1, 6), st.integers(0, 2)), min_size=3, max_size=25
    ).filter(lambda rows: any(r[2] for r in rows))
)
def test_incidences_and_survival_sum_to_one(spark, loans):
    e = np.array([r[0] for r in loans])
    x = e + np.array([r[1] for r in loans])
    c = np.array([r[2] for r in loans])
    truth = brute.curves(e, x, c)
    rows = aj.fit_aalen_johansen(frame(spark, e, x, c).repartition(3), validate=False).collect()
    total = {}
    for r in rows:
        total[r.analysis_time] = total.get(r.analysis_time, 0.0) + r.cumulative_incidence
        assert r.ci_lower <= r.cumulative_incidence + 1e-12 <= r.ci_upper + 2e-12
    for t, value in total.items():
        assert value + truth[t][0] == pytest.approx(1.0, abs=1e-12)


def test_contracts(spark):
    e, x, c, _ = brute.loans(4, 20)
    df = frame(spark, e, x, c)
    for bad in (0.0, 1.0, True, "x"):
        with pytest.raises(ContractError):
            km.fit_kaplan_meier(df, confidence_level=bad)
    with pytest.raises(ContractError, match="invalid_time"):
        km.fit_kaplan_meier(frame(spark, x, x, c))
    with pytest.raises(ContractError, match="duplicate"):
        aj.fit_aalen_johansen(df.unionByName(df))
    with pytest.raises(ContractError, match="no default or prepayment"):
        aj.fit_aalen_johansen(frame(spark, e, x, c * 0))
