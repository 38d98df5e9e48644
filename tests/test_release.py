"""A whole release on the smallest study, its checks, and the current-run switch."""

import pytest
from pyspark.sql import functions as F

from loanspan.contracts import ContractError
from loanspan.operators import sampling
from loanspan.plans import projections, reads, release
from loanspan.sources.tables import (
    point,
    pointed,
    publish_snapshot,
    read_snapshot,
    write_parquet,
)


@pytest.fixture(scope="module")
def root(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("release"))
    written = release.build_release(tables.model, tables.perf, folder, "r1")
    assert sorted(written) == sorted(release.RESULT_TABLES)
    return folder


def test_states_and_publication(spark, tables, root):
    assert release.run_status(spark, root, "r1") == "RUNNING"
    with pytest.raises(ContractError, match="No run is published"):
        release.current_run(spark, root)
    with pytest.raises(ContractError, match="Only a VALIDATED"):
        release.publish(spark, root, "r1")
    with pytest.raises(ContractError, match="Illegal"):
        release.transition(spark, root, "r1", "PUBLISHED")
    report = release.validate_release(spark, root, "r1", tables.model)
    assert {r.status for r in report.collect()} == {"PASS"}
    release.publish(spark, root, "r1")
    assert release.current_run(spark, root) == "r1"
    assert release.run_status(spark, root, "r1") == "PUBLISHED"

    views = release.published_views(spark, root, tables.model)
    for name, df in views.items():
        assert df.schema.names == projections.SCHEMAS[name].names
        assert df.count() > 0
    drivers = reads.driver_view(views["risk_driver_results"])
    by_model = {r.model: r.n for r in drivers.groupBy("model").agg(F.count("*").alias("n")).collect()}
    assert by_model == {
        "BASELINE_COX": 5, "TV_COX": 9, "FINE_GRAY_DEFAULT": 5, "CAUSE_SPECIFIC_DEFAULT": 5,
        "CAUSE_SPECIFIC_PREPAYMENT": 5,
    }
    assert drivers.filter(F.col("hr_shr").isNull()).count() == 0
    assert reads.driver_view(views["risk_driver_results"], "fine-gray").count() == 5
    diagnostics = reads.diagnostics_view(views["model_diagnostics"])
    assert diagnostics.filter(F.col("interpretation").isNull()).count() == 0
    assert reads.diagnostics_view(views["model_diagnostics"], "Cox PH").count() == 13


def test_failed_checks_are_all_reported(spark, tables, root):
    release.transition(spark, root, "r2", "CREATED")
    release.transition(spark, root, "r2", "RUNNING")
    for name, df in release.load_tables(spark, root, "r1").items():
        if name == "km_results":
            df = df.withColumn("survival", F.lit(2.0))
        if name == "overall_pd_horizons":
            df = df.withColumn("loan_count", F.col("loan_count") + 1)
        if name != "ph_diagnostics":
            write_parquet(df, release.table_path(root, "r2", name))
    with pytest.raises(ContractError, match="failed"):
        release.validate_release(spark, root, "r2", tables.model)
    assert release.run_status(spark, root, "r2") == "FAILED"
    report = spark.read.parquet(release.table_path(root, "r2", "validation_report")).collect()
    failed = {r.check_name for r in report if r.status == "FAIL"}
    assert failed == {"inventory", "km_results", "ph_diagnostics", "count_reconciliation"}


def test_failed_build_is_marked(spark, tables, tmp_path):
    folder = str(tmp_path / "bad")
    with pytest.raises(Exception):
        release.build_release(tables.model.filter("event_type = 'CENSOR'"), tables.perf, folder, "x")
    assert release.run_status(spark, folder, "x") == "FAILED"


def test_fingerprints(tables):
    a = release.fingerprint(tables.model, "m").first()
    b = release.fingerprint(tables.model.repartition(7), "m").first()
    assert a.content_hash == b.content_hash
    changed = tables.model.withColumn("fico", F.col("fico") + F.lit(1).cast("smallint"))
    assert release.fingerprint(changed, "m").first().content_hash != a.content_hash
    one = release.fingerprint(tables.model, "m")
    assert release.reconcile_fingerprint(one, {"row_count": a.row_count}) == {}
    assert "row_count" in release.reconcile_fingerprint(one, {"row_count": -1})


def test_nonfinite_values_are_not_published(spark):
    bad = spark.createDataFrame([(12, float("nan"))], "horizon_months int, pd double")
    with pytest.raises(ContractError, match="nonfinite"):
        projections.attach(bad, projections.PD)
    fine = projections.attach(bad.withColumn("pd", F.lit(0.1)), projections.PD)
    assert fine.columns == projections.PD.names and fine.first().loan_count is None


def test_sampled_histories_keep_all_months(tables):
    sampled = sampling.nested_sample(tables.model, 30)
    kept = sampling.complete_histories(tables.perf, sampled)
    ids = [r.loan_id for r in sampled.collect()]
    assert kept.count() == tables.perf.filter(F.col("loan_id").isin(ids)).count()


def test_publications_in_one_moment_keep_their_order(spark, tmp_path):
    root = str(tmp_path / "runs")
    for run in ("a", "b", "c"):
        for status in ("CREATED", "RUNNING", "VALIDATED"):
            release.transition(spark, root, run, status)
    for run in ("c", "a", "b"):
        release.publish(spark, root, run)
        assert release.current_run(spark, root) == run
    # A pointer whose run never got its status, and one that was not written to its end.
    assert point(spark, f"{root}/current", "ghost") == 4
    (tmp_path / "runs" / "current" / "pointers" / "0000000005").write_text("half")
    assert release.current_run(spark, root) == "b"
    assert point(spark, f"{root}/current", "later") == 6


def test_snapshots_switch_at_once(spark, tmp_path):
    root = str(tmp_path / "table")
    with pytest.raises(ContractError, match="no such version"):
        read_snapshot(spark, root)
    assert publish_snapshot(spark.range(3), root, lambda df: None) == 1
    before = read_snapshot(spark, root)

    def refuse(df):
        raise ContractError("no")

    with pytest.raises(ContractError, match="^no$"):
        publish_snapshot(spark.range(9), root, refuse)
    with pytest.raises(ContractError, match="empty"):
        publish_snapshot(spark.range(0), root, lambda df: None)
    assert read_snapshot(spark, root).count() == 3
    assert publish_snapshot(spark.range(5), root, lambda df: None, expected=1) == 2
    with pytest.raises(ContractError, match="expected pointer 1, found 2"):
        publish_snapshot(spark.range(7), root, lambda df: None, expected=1)

    def overtaken(df):
        point(spark, root, pointed(spark, root)[0][1])

    # The other publication comes between this one's check and its switch.
    with pytest.raises(ContractError, match="expected pointer 2, found 3"):
        publish_snapshot(spark.range(7), root, overtaken, expected=2)
    assert read_snapshot(spark, root).count() == 5 and read_snapshot(spark, root, 1).count() == 3
    assert before.count() == 3
