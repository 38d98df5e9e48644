"""Regression models against direct numpy fits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanspan.contracts import CORE_PREDICTORS, ContractError
from loanspan.functions.stats import chi2_sf, two_sided_p
from loanspan.operators import concordance, cox, fine_gray, ph_test
from loanspan.operators.ties import LAST, tie_terms
from tests import brute

KINDS = ["CENSOR", "DEFAULT", "PREPAYMENT"]
SCHEMA = (
    "loan_id string, vintage_year smallint, entry_time_month int, exit_time_month int, "
    "duration_months int, default_event tinyint, prepayment_event tinyint, cr_event_code tinyint, "
    "event_type string, fico smallint, original_ltv double, original_dti double, "
    "original_interest_rate double, original_loan_term smallint"
)


def predictors(x):
    """Five predictors in loan-like units; whole numbers where the schema wants them."""
    return np.column_stack(
        [
            np.round(700 + 50 * x[:, 0]),
            75 + 10 * x[:, 1],
            35 + 8 * x[:, 2],
            4 + x[:, 3],
            np.round(300 + 40 * x[:, 4]),
        ]
    )


def make(spark, seed, n, **kw):
    entry, exit_, code, x = brute.loans(seed, n, 5, **kw)
    raw = predictors(x)
    rows = [
        (f"L{i:05d}", 2020, int(e), int(t), int(t), int(c == 1), int(c == 2), int(c), KINDS[c],
         int(v[0]), float(v[1]), float(v[2]), float(v[3]), int(v[4]))
        for i, (e, t, c, v) in enumerate(zip(entry, exit_, code, raw))
    ]
    return spark.createDataFrame(rows, SCHEMA), entry, exit_, code, raw


def scaled(raw):
    return (raw - raw.mean(0)) / raw.std(0, ddof=1), raw.std(0, ddof=1)


@pytest.fixture(scope="module")
def data(spark):
    return make(spark, 11, 700)


@pytest.fixture(scope="module")
def model(data):
    return cox.fit_cox(data[0])


def test_cox_matches(data, model):
    _, e, t, c, raw = data
    z, sd = scaled(raw)
    beta, ll, _, info, _ = brute.fit(e, t, (c == 1).astype(int), z)
    assert np.allclose(model.beta, beta / sd, rtol=1e-8, atol=1e-12)
    rows = {r.variable: r for r in model.coefficients.collect()}
    se = np.sqrt(np.diag(np.linalg.inv(info))) / sd
    for i, name in enumerate(CORE_PREDICTORS):
        r = rows[name]
        assert r.standard_error == pytest.approx(se[i], rel=1e-7)
        assert r.hazard_ratio == pytest.approx(math.exp(r.coefficient))
        assert r.p_value == pytest.approx(two_sided_p(r.coefficient / r.standard_error))
        assert r.ci_lower == pytest.approx(math.exp(r.coefficient - 1.959963984540054 * se[i]))
    d = model.diagnostics.first()
    assert d.log_likelihood == pytest.approx(ll, abs=1e-7)
    assert d.partial_aic == pytest.approx(-2 * ll + 10, abs=1e-6)
    good, ties, pairs = brute.concordance(-(-raw @ model.beta), t, (c == 1).astype(int))
    assert d.concordance_index == pytest.approx((good + ties / 2) / pairs, abs=1e-12)
    assert (d.n_observations, d.n_events) == (len(e), int((c == 1).sum()))
    assert d.delayed_entry_count == int((e > 0).sum())
    assert d.convergence_status == "PASS"
    for check in (cox.check_coefficients(model.coefficients), cox.check_diagnostics(model.diagnostics)):
        assert all(v == 0 for v in check.first().asDict().values())


def test_row_order_and_partitions_do_not_matter(data, model):
    other = cox.fit_cox(
        data[0].orderBy(F.rand(3)).repartition(5), validate=False, with_concordance=False
    )
    assert np.allclose(other.beta, model.beta, rtol=1e-9)


def test_cause_specific_shares_scans_and_matches(data):
    df, e, t, c, raw = data
    z, sd = scaled(raw)
    models = cox.fit_cause_specific(df, with_concordance=False)
    for k, cause in [(1, "DEFAULT"), (2, "PREPAYMENT")]:
        beta, ll, *_ = brute.fit(e, t, (c == k).astype(int), z)
        assert np.allclose(models[cause].beta, beta / sd, rtol=1e-8, atol=1e-12)
        assert models[cause].diagnostics.first().log_likelihood == pytest.approx(ll, abs=1e-7)


def test_no_delayed_entry(spark):
    df, e, t, c, raw = make(spark, 5, 300, zero_entry=True)
    z, sd = scaled(raw)
    beta, *_ = brute.fit(e, t, (c == 1).astype(int), z)
    got = cox.fit_cox(df, with_concordance=False)
    assert np.allclose(got.beta, beta / sd, rtol=1e-8)
    assert got.diagnostics.first().delayed_entry_count == 0


def test_time_varying_ridge(spark):
    rng = np.random.default_rng(3)
    rows, flat = [], []
    for i in range(250):
        start, cov = int(rng.integers(0, 5)), rng.normal(size=2)
        for _ in range(int(rng.integers(1, 6))):
            stop = start + int(rng.integers(1, 4))
            rare = int(rng.random() < 0.03)
            v = (float(cov[0]), float(rng.normal()), rare)
            event = int(rng.random() < 0.08 * math.exp(0.5 * v[1]))
            rows.append((f"L{i}", start, stop, stop - start, stop - start > 1, event, *v))
            flat.append((start, stop, event, *v))
            start = stop
            if event:
                break
    df = spark.createDataFrame(
        rows,
        "loan_id string, start_time_month int, stop_time_month int, interval_length_months int, "
        "gap_interval_flag boolean, default_event tinyint, a double, b double, rare tinyint",
    )
    arr = np.array(flat)
    z, sd = scaled(arr[:, 3:])
    for per_row in (True, False):
        weight = 0.1 * (len(arr) if per_row else 1)
        beta, ll, _, info, _ = brute.fit(
            arr[:, 0].astype(int), arr[:, 1].astype(int), arr[:, 2].astype(int), z, penalty=weight
        )
        got = cox.fit_time_varying(df, penalty_per_row=per_row, names=["a", "b", "rare"])
        assert np.allclose(got.beta, beta / sd, rtol=1e-7)
        se = np.sqrt(np.diag(np.linalg.inv(info))) / sd
        assert np.allclose([r.standard_error for r in got.coefficients.collect()], se, rtol=1e-7)
        assert got.diagnostics.first().log_likelihood == pytest.approx(ll, abs=1e-7)
    assert cox.information_rank(df, ["a", "b", "rare"])["initial_information_matrix_rank"] == 3
    doubled = df.withColumn("c", F.col("a") * 2 + 1)
    assert cox.information_rank(doubled, ["a", "b", "c"])["initial_information_matrix_rank"] == 2


def test_proportional_hazards_score_test(data, model):
    _, e, t, c, raw = data
    z, _ = scaled(raw)
    event = (c == 1).astype(int)
    beta = model.fit.beta
    w = np.exp(z @ beta)
    survival = brute.kaplan_meier(e, t, event)
    transforms = {
        "rank": pd.Series(t).rank().to_numpy(),
        "km": np.array([1 - survival.get(m - 1, (1.0, 0))[0] for m in t]),
    }
    variables, overall = ph_test.ph_tests(model)
    got = {(r.time_transform, r.variable): r for r in variables.collect()}
    total = {r.time_transform: r for r in overall.collect()}
    for name, g in transforms.items():
        g = g - g[event == 1].mean()
        info, score = np.zeros((10, 10)), np.zeros(5)
        for m in np.unique(t[event == 1]):
            risk, dead = (e < m) & (t >= m), (t == m) & (event == 1)
            d, gm = dead.sum(), g[dead][0]
            for k in range(d):
                ww = w * risk * np.where(dead, 1 - k / d, 1)
                mean = ww @ z / ww.sum()
                v = (z * ww[:, None]).T @ z / ww.sum() - np.outer(mean, mean)
                info += np.kron([[1, gm], [gm, gm * gm]], v)
                score += gm * (z[dead].mean(0) - mean)
        u = np.r_[np.zeros(5), score]
        chi2 = u @ np.linalg.solve(info, u)
        assert total[name].test_statistic == pytest.approx(chi2, rel=1e-7)
        assert total[name].p_value == pytest.approx(chi2_sf(chi2, 5), rel=1e-6)
        for j, variable in enumerate(CORE_PREDICTORS):
            keep = [0, 1, 2, 3, 4, 5 + j]
            uj = np.r_[np.zeros(5), score[j]]
            expected = uj @ np.linalg.solve(info[np.ix_(keep, keep)], uj)
            row = got[(name, variable)]
            assert row.test_statistic == pytest.approx(expected, rel=1e-7)
            assert row.ph_status == ("FLAGGED" if row.p_value < 0.05 else "PASS")
    assert all(v == 0 for v in ph_test.check_ph_variables(variables).first().asDict().values())
    assert all(v == 0 for v in ph_test.check_ph_global(overall).first().asDict().values())


def test_schoenfeld_residuals(data, model):
    df, e, t, c, raw = data
    event = c == 1
    rows = ph_test.schoenfeld_residuals(model, df).toPandas()
    n = int(event.sum())
    assert len(rows) == n * 10
    assert sorted(rows.event_row.unique()) == list(range(1, n + 1))
    times = rows.drop_duplicates("event_row").sort_values("event_row").analysis_time.to_numpy()
    assert (np.diff(times) >= 0).all()
    w = np.exp(raw @ model.beta - (raw @ model.beta).mean())
    expected = []
    for m in np.unique(t[event]):
        risk, dead = (e < m) & (t >= m), (t == m) & event
        d = dead.sum()
        means = []
        for k in range(d):
            ww = w * risk * np.where(dead, 1 - k / d, 1)
            means.append(ww @ raw / ww.sum())
        expected.append((raw[dead] - np.mean(means, axis=0)) @ model.covariance * n + model.beta)
    expected = np.vstack(expected)
    for j, name in enumerate(CORE_PREDICTORS):
        part = rows[(rows.variable == name) & (rows.time_transform == "rank")]
        assert np.allclose(
            np.sort(part.scaled_schoenfeld_residual), np.sort(expected[:, j]), rtol=1e-6, atol=1e-9
        )
    assert ph_test.check_model_matches(model, df).first().asDict() == {
        "observations": 0, "events": 0, "delayed_entry": 0
    }


def direct_weight(e, t, c, u, s):
    """g(s) / g(u) of a loan prepaid at u, month by month from the loans themselves."""
    weight = 1.0
    for m in range(u, s):
        present = ((e < m) & (t >= m)).sum()
        events = ((t == m) & (c > 0)).sum()
        censored = ((t == m) & (c == 0)).sum()
        after = ((e <= m) & (t > m)).sum()
        entered = (e == m).sum()
        stay = 1 - censored / (present - events) if present > events else 1.0
        weight *= stay / (1 - entered / after if after else 1.0)
    return weight


def test_fine_gray_matches_weighted_expansion(spark):
    df, e, t, c, raw = make(spark, 21, 260)
    z, sd = scaled(raw)
    got = fine_gray.fit_fine_gray(df)
    start, stop, status, weight, who = [], [], [], [], []
    months = np.unique(t[c == 1])
    for i in range(len(e)):
        start.append(e[i]); stop.append(t[i]); status.append(int(c[i] == 1))
        weight.append(1.0); who.append(i)
        if c[i] == 2:
            last = t[i]
            for m in months[months > t[i]]:
                start.append(last); stop.append(m); status.append(0)
                weight.append(direct_weight(e, t, c, t[i], m)); who.append(i)
                last = m
    start, stop, status = map(np.array, (start, stop, status))
    who, weight = np.array(who), np.array(weight)
    beta, ll, _, info, resid = brute.fit(start, stop, status, z[who], weight)
    assert np.allclose(got.beta, beta / sd, rtol=1e-7)
    assert got.fit.loglik == pytest.approx(ll, abs=1e-6)
    per_loan = np.zeros((len(e), 5))
    np.add.at(per_loan, who, resid)
    bread = np.linalg.inv(info)
    robust = np.sqrt(np.diag(bread @ (per_loan.T @ per_loan) @ bread)) / sd
    assert np.allclose([r.standard_error for r in got.coefficients.collect()], robust, rtol=1e-7)
    expanded = fine_gray.expand_fine_gray(df, got.fit.sums)
    audit = fine_gray.audit_expansion(expanded, df).first().asDict()
    assert audit["n_expanded_rows"] == got.diagnostics.first().n_expanded_rows
    assert 0 < audit["n_competing_extended"] <= (c == 2).sum()
    assert sum(v for k, v in audit.items() if not k.startswith("n_")) == 0
    assert all(
        v == 0 for v in fine_gray.check_fine_gray_results(got.coefficients).first().asDict().values()
    )
    assert all(
        v == 0
        for v in fine_gray.check_fine_gray_diagnostics(got.diagnostics).first().asDict().values()
    )


def test_concordance_with_ties_across_partitions(spark):
    rng = np.random.default_rng(9)
    n = 900
    # A third of all rows share one score.
    score = np.where(np.arange(n) % 3 == 0, 0.5, np.round(rng.normal(size=n), 1))
    month, event = rng.integers(1, 12, n), rng.integers(0, 2, n)
    df = spark.createDataFrame(
        [(float(a), int(b), int(c)) for a, b, c in zip(score, month, event)],
        "s double, m int, e int",
    )
    got = concordance.concordance_counts(df.repartition(6), F.col("s"), F.col("m"), F.col("e"))
    good, ties, pairs = brute.concordance(score, month, event)
    assert (got["concordant"], got["tied"], got["comparable"]) == (good, ties, pairs)


def test_input_contracts(spark, data):
    df = data[0]
    with pytest.raises(ContractError, match="incomplete_predictors"):
        cox.fit_cox(df.withColumn("original_dti", F.lit(None).cast("double")))
    with pytest.raises(ContractError, match="both events"):
        cox.fit_cox(df.filter("default_event = 0"))
    with pytest.raises(ContractError, match="constant"):
        cox.fit_cox(df.withColumn("original_ltv", F.lit(80.0)))
    with pytest.raises(ContractError, match="Unknown cause"):
        cox.fit_cause_specific(df, causes=["OTHER"])
    with pytest.raises(ContractError, match="defaults and prepayments"):
        fine_gray.fit_fine_gray(df.filter("cr_event_code <> 2"))


def test_tail_functions():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(11.070497693516351, 5) == pytest.approx(0.05, abs=1e-12)
    assert chi2_sf(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-12)
    assert two_sided_p(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    k = tie_terms(10.0, 4.0, 3)
    d = 10 - 4 * np.arange(3) / 3
    assert k.log_d == pytest.approx(np.log(d).sum()) and k.inv == pytest.approx((1 / d).sum())


def test_horizons_before_the_first_step_are_kept(spark):
    from loanspan.operators import scoring

    hazards = scoring.Hazards([40, 41], [0.01, 0.02], [0.03, 0.0], [0.0] * 5, [0.0] * 5, [0.0] * 5)
    profiles = spark.createDataFrame(
        [("A", 700, 80.0, 30.0, 4.0, 360)], ["loan_id", *scoring.CORE_PREDICTORS]
    )
    found = {
        r["horizon_months"]: (r["default_cif"], r["prepay_cif"], r["survival"])
        for r in scoring.score_horizons(profiles, hazards, [0, 12, 36, 40]).collect()
    }
    assert [found[h] for h in (0, 12, 36)] == [(0.0, 0.0, 1.0)] * 3
    assert found[40][0] == pytest.approx(0.01 / 0.04 * -np.expm1(-0.04))


@pytest.mark.parametrize(
    "total, tied, d",
    [(10.0, 10.0, 5), (10.0, 10.0, 2 * LAST + 1), (100.0, 100.0, 1000), (1e9, 1e-3, 100_000),
     (5.0, 1e-9, 3000), (2e6, 1.9e6, 1_000_000), (7.0, 0.0, 100), (1.0, 0.5, 1)],
)
def test_tie_sums_equal_the_sums_step_by_step(total, tied, d):
    f = np.arange(d, dtype=np.longdouble) / d
    x = np.longdouble(total) - f * np.longdouble(tied)
    k = tie_terms(total, tied, d)
    found = [k.log_d, k.inv, k.inv_f, k.inv2, k.inv2_f, k.inv2_ff]
    expected = [np.log(x), 1 / x, f / x, 1 / x**2, f / x**2, f * f / x**2]
    for got, terms in zip(found, expected, strict=True):
        assert got == pytest.approx(float(terms.sum()), rel=1e-12, abs=1e-12)


def test_tie_sums_of_very_many_events_take_no_longer():
    k = tie_terms(1e12, 9e11, 10**12)
    # As many steps as there are events: the sums are integrals over the steps' share f.
    assert k.inv == pytest.approx(np.log(10) / 0.9, rel=1e-10)
    assert k.inv2 * 1e12 == pytest.approx(10, rel=1e-10)
    with pytest.raises(ContractError, match="lost its weight"):
        tie_terms(1.0, 2.0, 10)


@pytest.mark.parametrize("scores, months", [(40, 6), (100_000, 30), (3, 900)])
def test_outlasting_counts_of_large_batches(scores, months):
    """Counts of a batch, worked by block, against a comparison of all rows."""
    random = np.random.default_rng(scores)
    n = 3 * concordance.BLOCK + 17
    score = np.sort(random.integers(0, scores, n))
    key, count = random.integers(0, 2 * months, n), random.integers(1, 5, n).astype(float)
    passed = random.integers(0, 9, 2 * months + 2).astype(float)
    counts = concordance.PassedCounts(passed, key, count)
    place = np.searchsorted(score, score, "left")
    found = counts.outlasting(place, key)
    lower = (score[None, :] < score[:, None]) & (key[None, :] > key[:, None])
    before = np.array([passed[k + 1 :].sum() for k in key])
    assert (found == lower @ count + before).all()
    assert counts.total.sum() == passed.sum() + count.sum()


def test_concordance_of_rows_over_many_batches(spark):
    random = np.random.default_rng(8)
    n = 3000
    score, month = random.integers(0, 700, n) / 7, random.integers(1, 40, n)
    event = (random.random(n) < 0.4).astype(int)
    rows = [(float(s), int(m), int(e)) for s, m, e in zip(score, month, event, strict=True)]
    df = spark.createDataFrame(rows, "s double, m int, e int").repartition(3)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        found = concordance.concordance_counts(df, F.col("s"), F.col("m"), F.col("e"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    good, ties, pairs = brute.concordance(score, month, event)
    assert (found["concordant"], found["tied"], found["comparable"]) == (good, ties, pairs)
