"""Validation, panel, intervals, samples, horizons, reads and scoring on small fixtures."""

import datetime
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanspan.contracts import CORE_PREDICTORS, EVENT_TYPES, ContractError, horizons_of
from loanspan.functions import months as M
from loanspan.functions.codes import delinquency_label, event_label, truthy_text
from loanspan.operators import (
    clock, dataset, horizons, intervals, sampling, scoring, outcomes, validate,
)
from loanspan.plans import reads


def test_month_arithmetic(spark):
    row = spark.range(1).select(
        M.month_index(F.lit(202001)).alias("a"),
        M.index_to_yyyymm(M.month_index(F.lit(201912))).alias("b"),
        M.yyyymm_to_date(F.lit("202013")).alias("c"),
        M.yyyymm_to_date(F.lit("202002")).alias("d"),
        horizons.add_calendar_months(F.lit("2020-01-31").cast("date"), 1).alias("e"),
    ).first()
    assert (row.a, row.b, row.c) == (24241, 201912, None)
    assert row.d == datetime.date(2020, 2, 1) and row.e == datetime.date(2020, 2, 29)


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 20])
def test_order_violations_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(1)
    # One loan holds a third of the file.
    rows = [
        ("hot" if i % 3 == 0 else f"L{rng.integers(0, 20)}", int(rng.integers(1, 30)), i)
        for i in range(400)
    ]
    expected, last = 0, {}
    for loan, period, _ in rows:
        expected += period < last.get(loan, period)
        last[loan] = period
    df = spark.createDataFrame(rows, "loan_id string, p int, source_row bigint").repartition(5)
    assert validate.order_violations(df, "p", chunk=chunk).first()[0] == expected


def test_panel_with_repeated_months(spark):
    perf = spark.createDataFrame(
        [("a", 202001, 0, 1), ("a", 202001, 0, 2), ("a", 202004, 3, 3), ("a", 202005, 4, 4)],
        "loan_id string, reporting_period_num int, loan_age int, source_row int",
    )
    survival = spark.createDataFrame(
        [("a", 2019, datetime.date(2020, 1, 1), datetime.date(2019, 12, 1), 1, 5, 4, 202004,
          "CENSOR", 0, True, None)],
        "loan_id string, vintage_year smallint, first_payment_month date, "
        "operational_origination_date date, entry_time_month int, exit_time_month int, "
        "observed_duration_months int, event_month int, event_type string, event_code tinyint, "
        "survival_eligible boolean, survival_exclusion_reason string",
    )
    panel = clock.build_loan_age_panel(perf, survival, row_order="source_row")
    got = {r.row_order: r for r in panel.collect()}
    assert [got[i].month_step for i in (1, 2, 3, 4)] == [None, 0, 3, 1]
    assert got[2].duplicate_or_order_flag and got[3].reporting_gap_flag and got[4].after_exit_flag
    assert [got[i].within_observation_window for i in (1, 2, 3, 4)] == [True, False, True, False]
    check = clock.check_loan_age_panel(panel).first()
    assert (check.duplicate_keys, check.order_error_rows, check.status) == (1, 1, "FAIL")


def test_static_columns_must_not_vary(spark, tables):
    from loanspan.plans.registry import _loan_months

    monthly = _loan_months(tables)
    dataset.validate_loan_months(monthly)
    some = monthly.agg(F.max("loan_id")).first()[0]
    first = monthly.filter(F.col("loan_id") == some).agg(F.min("reporting_period_num")).first()[0]
    odd = monthly.withColumn(
        "fico",
        F.when(
            (F.col("loan_id") == some) & (F.col("reporting_period_num") == first),
            F.lit(None).cast("smallint"),
        ).otherwise(F.coalesce("fico", F.lit(1).cast("smallint"))),
    )
    with pytest.raises(ContractError, match="varying_static"):
        dataset.validate_loan_months(odd)
    with pytest.raises(ContractError, match="incompatible column types"):
        dataset.check_loan_months(monthly.withColumn("fico", F.col("fico").cast("int")))


def test_intervals_cover_every_complete_case(tables):
    rows = intervals.build_intervals(tables.perf, tables.model)
    intervals.validate_intervals(rows, tables.model)
    some = rows.agg(F.min("loan_id")).first()[0]
    broken = rows.withColumn(
        "stop_time_month",
        F.when(F.col("loan_id") == some, F.col("stop_time_month") + 1).otherwise(
            F.col("stop_time_month")
        ),
    )
    with pytest.raises(ContractError):
        intervals.validate_intervals(broken, tables.model)


def loans_of(spark, counts):
    rows, i = [], 0
    for kind, n in counts.items():
        for _ in range(n):
            rows.append((f"loan-{i}", kind, i % 3))
            i += 1
    return spark.createDataFrame(rows, "loan_id string, event_type string, entry_time_month int")


def test_nested_samples_are_prefixes(spark):
    df = loans_of(spark, {"CENSOR": 61, "DEFAULT": 7, "PREPAYMENT": 23})
    previous = set()
    for size in (3, 10, 40, 91):
        got = {r.loan_id for r in sampling.nested_sample(df, size).collect()}
        assert len(got) == size and previous <= got
        previous = got
    kinds = {r.event_type for r in sampling.nested_sample(df, 3).collect()}
    assert kinds == set(EVENT_TYPES)
    for bad in (2, 92, True):
        with pytest.raises(ContractError):
            sampling.nested_sample(df, bad)


def test_enriched_quota_equals_cumulative_rounding(spark):
    counts = {"CENSOR": 37, "DEFAULT": 5, "PREPAYMENT": 18}
    df = loans_of(spark, counts)
    n = counts["CENSOR"] + counts["PREPAYMENT"]
    for size in (7, 20, 33, 60):
        taken, prior = {"CENSOR": 0, "PREPAYMENT": 0}, 0
        for k in range(1, size - 5 + 1):
            total = (2 * k * counts["CENSOR"] + n) // (2 * n)
            taken["CENSOR" if total > prior else "PREPAYMENT"] += 1
            prior = total
        rows = sampling.enriched_sample(df, size).groupBy("event_type").count().collect()
        got = {r.event_type: r["count"] for r in rows}
        assert got.pop("DEFAULT") == 5
        assert got == {k: v for k, v in taken.items() if v}


def test_step_values_do_not_extrapolate(spark):
    rows = [("DEFAULT", "g", "a", t, v) for t, v in [(13, 0.1), (24, 0.2), (30, 0.3)]]
    curves = spark.createDataFrame(
        rows,
        "endpoint string, group_name string, group_value string, analysis_time int, "
        "cumulative_incidence double",
    )
    got = {r.horizon_months: r.cif for r in horizons.step_values(curves).collect()}
    assert got == {12: 0.0, 24: 0.2, 36: None, 60: None}
    for bad in ([], [12, 12], [13], [True]):
        with pytest.raises(ContractError):
            horizons_of(bad)


def test_bands(spark):
    df = spark.createDataFrame(
        [(649.0,), (650.0,), (750.0,), (60.0,), (60.5,), (None,), (float("nan"),)], "x double"
    )
    fico = [r[0] for r in df.select(horizons.band(F.col("x"), "fico_band")).collect()]
    ltv = [r[0] for r in df.select(horizons.band(F.col("x"), "ltv_band")).collect()]
    assert fico == ["<650", "650–699", "750+", "<650", "<650", "Missing", "Missing"]
    assert ltv[3:] == ["≤60%", ">60–70%", "Missing", "Missing"]


def test_labels_and_flags(spark):
    codes = spark.createDataFrame(
        [("00",), ("1",), ("02",), ("07",), ("RA",), (" xx ",), (None,), ("Q",)], "c string"
    )
    got = [r[0] for r in codes.select(delinquency_label(F.col("c"))).collect()]
    assert got == [
        "00 CURRENT", "01 DPD_30", "02 DPD_60", "07 DPD_90_PLUS", "RA_SPECIAL_STATUS",
        "NO_DELINQUENCY_DATA", "NO_DELINQUENCY_DATA", "Q SOURCE_CODE",
    ]
    flags = spark.createDataFrame(
        [("True",), (" yes",), ("1",), ("y",), ("False",), ("0",), (None,), ("maybe",)], "f string"
    )
    assert [r[0] for r in flags.select(truthy_text(F.col("f"))).collect()] == [True] * 4 + [False] * 4
    row = codes.limit(1).select(
        event_label(F.lit(" "), F.lit("VOLUNTARY_PREPAYMENT")).alias("a"),
        event_label(F.lit("default"), F.lit("CENSORED")).alias("b"),
        event_label(F.lit(None).cast("string"), F.lit("RIGHT_CENSOR")).alias("c"),
        event_label(F.lit("?"), F.lit("DEFAULT")).alias("d"),
    ).first()
    assert tuple(row) == ("PREPAYMENT", "DEFAULT", "END_OF_FOLLOW_UP", "UNKNOWN")


def test_read_helpers(spark):
    text = spark.createDataFrame([("12M", 1.0, 1), ("12", 2.0, 2), ("24 months", 3.0, 1),
                                  ("none", 9.0, 1)], "h string, v double, o int")
    got = {r.horizon: r.v for r in reads.per_horizon(text, "h", "v", "o").collect()}
    assert got == {12: 2.0, 24: 3.0}
    points = spark.createDataFrame([("p", 12, 0.12), ("p", 24, 0.2)], "k string, horizon int, cif double")
    line = {r.month: (r.cif, r.is_published) for r in
            reads.interpolate_cif(points, [6, 12, 18, 30], ["k"]).collect()}
    assert line[6] == (pytest.approx(0.06), False) and line[12] == (0.12, True)
    assert line[18] == (pytest.approx(0.16), False) and line[30] == (None, False)
    evidence = spark.createDataFrame(
        [(0.01, 1.1, 1.2), (0.2, 0.9, 1.2), (0.01, 0.9, 1.2), (None, 1.1, 1.2)],
        "p double, lo double, hi double",
    ).select(reads.evidence_label(F.col("p"), F.col("lo"), F.col("hi")))
    assert [r[0] for r in evidence.collect()] == [
        "NOMINAL_EVIDENCE", "INSUFFICIENT_EVIDENCE", "P_VALUE_AND_CI_DISAGREE", "INCOMPLETE"
    ]
    rate = spark.createDataFrame([(1, 0), (1, 4), (1, None)], "a int, b int").select(
        reads.safe_rate(F.col("a"), F.col("b"))
    )
    assert [r[0] for r in rate.collect()] == [None, 0.25, None]
    years = spark.createDataFrame([("2019.0",), (" 2020 ",), ("All",), ("1999",)], "v string")
    assert {r.label for r in reads.available_vintages(years).collect()} == {"2019", "2020"}
    other = spark.createDataFrame([("early",), ("nan",)], "v string")
    assert {r.label for r in reads.available_vintages(other).collect()} == {"early"}


def test_status_rank(spark):
    df = spark.createDataFrame(
        [("RA", None, None), ("05", 5, False), ("00", 0, False), ("XX", None, False),
         ("01", 1, True)],
        "current_delinquency_status string, delinquency_num smallint, is_ra boolean",
    )
    assert [r[0] for r in df.select(reads.status_rank()).collect()] == [4, 3, 0, None, 4]


def test_datasets_are_registered(spark):
    reads.register_datasets({"pd_results": spark.range(2)})
    status = reads.dataset_status(spark)
    assert status["pd_results"] and not status["loan_timeline"]
    assert reads.load_dataset(spark, "pd_results").count() == 2


def test_scores_match_the_recursion(spark):
    hz = scoring.Hazards(
        [1, 5, 12, 20], [0.01, 0.0, 0.02, 0.03], [0.02, 0.03, 0.0, 0.01],
        [0.01, 0.0, 0.0, 0.0, 0.0], [0.0, 0.02, 0.0, 0.0, 0.0], [700.0, 80.0, 35.0, 4.0, 360.0],
    )
    profile = spark.createDataFrame([(720, 90.0, 30.0, 4.0, 360), (650, 60.0, 40.0, 5.0, 12)],
                                    ", ".join(f"{c} double" if i in (1, 2, 3) else f"{c} int"
                                              for i, c in enumerate(CORE_PREDICTORS)))
    rows = scoring.score_horizons(profile, hz).collect()
    assert len(rows) == 6
    for r in rows:
        ed, ep = math.exp(0.01 * (r.fico - 700)), math.exp(0.02 * (r.original_ltv - 80))
        s = d = p = None
        s, d, p = 1.0, 0.0, 0.0
        for m, a, b in zip(hz.months, hz.default_steps, hz.prepay_steps):
            if m <= r.horizon_months:
                total = a * ed + b * ep
                d += s * (1 - math.exp(-total)) * (a * ed / total)
                p += s * (1 - math.exp(-total)) * (b * ep / total)
                s *= math.exp(-total)
        assert (r.survival, r.default_cif, r.prepay_cif) == pytest.approx((s, d, p), abs=1e-12)
        assert r.survival + r.default_cif + r.prepay_cif == pytest.approx(1.0, abs=1e-12)
    kept = scoring.supported_horizons(scoring.score_horizons(profile, hz), hz).collect()
    assert {(r.fico, r.horizon_months) for r in kept} == {(720, 12), (650, 12)}
    with pytest.raises(ContractError):
        scoring.Hazards([1], [-0.1], [0.1], [0] * 5, [0] * 5, [0] * 5).check()


def test_overdue_labels(spark):
    rows = [
        ("same", 10, "PREPAYMENT", 10), ("later", 10, "PREPAYMENT", None),
        ("early_censor", 5, "CENSOR", None), ("after_end", 8, "PREPAYMENT", 9),
        ("none", 40, "CENSOR", None), ("late", 40, "DEFAULT", 30), ("negative", 40, "CENSOR", 0),
    ]
    df = spark.createDataFrame(
        rows, "loan_id string, duration_months int, event_type string, first_30dpd_age int"
    )
    got = {r.loan_id: r.target for r in outcomes.horizon_labels(df, 12).collect()}
    assert got == {"same": 0, "later": 1, "after_end": 1, "none": 2, "late": 2, "negative": 2}


def interval_rows(spark, spans):
    """Interval table of one default loan per list of (start, stop) spans."""
    rows = []
    for i, loan in enumerate(spans):
        end = max(t for _, t in loan)
        for s, t in loan:
            last = t == end
            rows.append(
                (f"L{i}", 2020, datetime.date(2020, 1, 1), 202001, s, t, t - s, t - s > 1, last,
                 int(last), "DEFAULT", 700, 80.0, 30.0, 4.0, 360, 1.0, 4.0, 0, 0, 0, 0, 0)
            )
    from loanspan.contracts import INTERVALS

    return spark.createDataFrame(rows, INTERVALS)


def test_broken_interval_chains_are_found(spark):
    good = [(0, 2), (2, 3), (3, 7)]
    spans = [
        good,
        [(0, 2), (1, 3), (4, 5)],  # overlap and gap of equal length
        [(0, 2), (3, 5)],
        [(0, 2), (0, 2), (2, 4)],
        [(0, 3), (2, 4)],
        list(reversed(good)),
    ]
    check = intervals.check_intervals(interval_rows(spark, spans)).first().asDict()
    assert check["noncontiguous_loans"] == 4
    assert check["rows"] == sum(map(len, spans)) and check["invalid_interval"] == 0
    fine = intervals.check_intervals(interval_rows(spark, [good, [(4, 9)]])).first().asDict()
    assert all(v == 0 for k, v in fine.items() if k != "rows")


def test_interval_chain_check_equals_direct_check(spark):
    rng = np.random.default_rng(4)
    spans, expected = [], 0
    for _ in range(300):
        cuts = np.cumsum(rng.integers(1, 4, size=rng.integers(2, 6)))
        loan = [[int(a), int(b)] for a, b in zip(cuts, cuts[1:])]
        if rng.random() < 0.5:
            loan[rng.integers(len(loan))][0] += int(rng.integers(-1, 1))
        ordered = sorted(loan)
        expected += any(a[1] != b[0] for a, b in zip(ordered, ordered[1:]))
        spans.append([tuple(x) for x in loan])
    check = intervals.check_intervals(interval_rows(spark, spans)).first()
    assert check.noncontiguous_loans == expected


def test_final_validation_finds_broken_tables(spark, tables):
    base = (tables.raw_orig, tables.raw_perf, tables.clean_orig, tables.clean_perf)
    good = validate.final_validation(*base).first()
    # The panel has gaps and months after the cutoff, which only a filtered table lacks.
    assert good.duplicate_loans == good.perf_ids_not_in_orig == good.duplicate_loan_months == 0
    assert good.status == "FAIL" and good.after_cutoff > 0
    early = tables.clean_perf.filter("reporting_period_num <= 202603 and loan_age >= 0")
    raw = tables.raw_perf.filter("monthly_reporting_period <= '202603' and loan_age >= 0")
    row = validate.final_validation(tables.raw_orig, raw, tables.clean_orig, early).first()
    assert row.status == "PASS_WITH_WARNING" and row.loans_with_gaps > 0
    gaps = validate.reporting_gaps(early).first()
    assert (row.loans_with_gaps, row.missing_months) == (gaps.loans_with_gaps, gaps.missing_months)
    one = tables.raw_orig.limit(1)
    broken = validate.final_validation(
        tables.raw_orig.unionByName(one), raw.unionByName(raw), tables.clean_orig, early
    ).first()
    assert broken.duplicate_loans == 1 and broken.duplicate_loan_months == raw.count()
    orphan = validate.final_validation(one, raw, tables.clean_orig, early).first()
    assert orphan.perf_ids_not_in_orig == raw.select("loan_id").distinct().count() - 1
    with pytest.raises(ContractError):
        validate.require_pass(validate.final_validation(*base))


def test_a_hot_loan_is_spread_over_tasks(spark):
    hot = spark.range(9000).select(
        F.lit("hot").alias("loan_id"),
        (F.lit(202001) + (F.col("id") % 2 == 0).cast("int")).alias("reporting_period_num"),
        F.lit(0).alias("loan_age"),
        F.col("id").alias("source_row"),
    )
    others = spark.range(9000, 27000).select(
        F.concat(F.lit("l"), (F.col("id") % 6000).cast("string")),
        F.lit(202001),
        F.lit(0),
        F.col("id"),
    )
    survival = hot.union(others).select("loan_id").distinct().selectExpr(
        "loan_id", "2019S vintage_year", "date'2020-01-01' first_payment_month",
        "date'2019-12-01' operational_origination_date", "1 entry_time_month", "5 exit_time_month",
        "4 observed_duration_months", "202004 event_month", "'CENSOR' event_type", "0Y event_code",
        "true survival_eligible", "cast(null as string) survival_exclusion_reason",
    )
    conf = {
        "spark.sql.adaptive.skewJoin.enabled": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "40",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        panel = clock.build_loan_age_panel(hot.union(others), survival, row_order="source_row", chunk=300)
        rows = panel.withColumn("task", F.spark_partition_id()).select("task", "loan_id", "month_step").collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(rows) == 27000
    by_task = Counter(r.task for r in rows)
    # A third of all rows are one loan's, and half of those one month's.
    assert max(by_task.values()) < 27000 / 8
    steps = Counter(r.month_step for r in rows if r.loan_id == "hot")
    assert steps == {None: 1, 1: 1, 0: 8998}


@pytest.mark.parametrize("seed", range(3))
def test_chains_are_decided_exactly(spark, seed):
    random = np.random.default_rng(seed)
    spans = []
    for _ in range(60):
        cuts = np.sort(random.choice(200, random.integers(2, 9), replace=False)).tolist()
        rows = list(zip(cuts, cuts[1:], strict=False))
        kind = random.integers(0, 5)
        if kind == 1 and len(rows) > 2:
            rows.pop(1)
        elif kind == 2:
            rows.append(rows[0])
        elif kind == 3 and len(rows) > 1:
            # Same sums of starts and of stops, other pairs.
            (a, b), (c, d) = rows[0], rows[1]
            rows[:2] = [(a, d), (c, b)] if c < b else [(a, b + 1), (c, d - 1)]
        elif kind == 4:
            rows = [(a, b) for a, b in rows] + [(cuts[0] + 300, cuts[0] + 301)]
        spans.append([(a, b) for a, b in rows if a < b])
    broken = 0
    for rows in spans:
        ordered = sorted(rows)
        broken += any(stop != start for (_, stop), (start, _) in zip(ordered, ordered[1:], strict=False))
    check = intervals.check_intervals(interval_rows(spark, spans)).first()
    assert check.noncontiguous_loans == broken > 0


def test_stored_order(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5000).selectExpr("concat('k', lpad(id div 3, 5, '0')) k", "cast(id % 3 as int) m")
    rows.coalesce(1).sortWithinPartitions("k", "m").write.option("maxRecordsPerFile", 700).parquet(path)
    found = validate.stored_order(spark, path, ["k", "m"]).first()
    assert (found.table_rows, found.order_violations) == (5000, 0)
    damaged = str(tmp_path / "d")
    swapped = rows.withColumn("m", F.when(F.col("k") == "k00500", 2 - F.col("m")).otherwise(F.col("m")))
    late = spark.createDataFrame([("a", 1), (None, 1)], "k string, m int")
    ordered = swapped.coalesce(1).sortWithinPartitions("k", F.when(F.col("k") == "k00500", -F.col("m")).otherwise(F.col("m")))
    ordered.write.parquet(damaged)
    late.coalesce(1).write.mode("append").parquet(damaged)
    files = sorted(r.f for r in spark.read.parquet(damaged).select(F.col("_metadata.file_name").alias("f")).distinct().collect())
    small = spark.read.parquet(f"{damaged}/{files[0]}").count() == 2
    found = validate.stored_order(spark, damaged, ["k", "m"]).first()
    # Two descents within k00500, and one where the files meet unless the small one comes first.
    assert (found.table_rows, found.order_violations) == (5001, 2 + (not small))
    empty = str(tmp_path / "e")
    rows.limit(0).write.parquet(empty)
    assert tuple(validate.stored_order(spark, empty, ["k", "m"]).first()) == (0, 0)
