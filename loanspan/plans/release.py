"""Release build: every result of a run, its checks, and the switch of the current run.

A run is a folder `run_id=<id>` of tables under the release root. Its status moves
CREATED -> RUNNING -> VALIDATED -> PUBLISHED, or to FAILED; only a validated run can become current.
Statuses are appended rows, so no file is ever edited in place.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanspan.contracts import (
    TV_PREDICTORS,
    ContractError,
    merge_rows,
    require_zero,
    schema_of,
    small_frame,
)
from loanspan.functions.durable import durable
from loanspan.operators import aalen_johansen as aj
from loanspan.operators import cox, dataset, fine_gray, horizons, intervals
from loanspan.operators import kaplan_meier as km
from loanspan.operators import ph_test
from loanspan.plans import projections
from loanspan.sources.tables import path_exists, point, pointed, write_parquet

TRANSITIONS = {
    None: {"CREATED"},
    "CREATED": {"RUNNING", "FAILED"},
    "RUNNING": {"VALIDATED", "FAILED"},
    "VALIDATED": {"PUBLISHED"},
    "FAILED": set(),
    "PUBLISHED": set(),
}
STATUS = schema_of("run_id string, step int, status string, changed_at string")
CHECKS = schema_of("run_id string, check_name string, status string, detail string")
FINGERPRINT = schema_of(
    "input string, row_count bigint, default_count bigint, prepayment_count bigint, "
    "censor_count bigint, delayed_entry_count bigint, content_hash string"
)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def run_path(root: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/run_id={run_id}"


def table_path(root: str, run_id: str, name: str) -> str:
    return f"{run_path(root, run_id)}/{name}"


def run_status(spark: SparkSession, root: str, run_id: str) -> str | None:
    path = f"{root.rstrip('/')}/status"
    if not path_exists(spark, path):
        return None
    row = (
        spark.read.schema(STATUS)
        .parquet(path)
        .filter(F.col("run_id") == run_id)
        .agg(F.max_by("status", "step").alias("status"))
        .first()
    )
    return row["status"]


def transition(spark: SparkSession, root: str, run_id: str, status: str) -> None:
    """Record a legal status change; an illegal one is an error."""
    old = run_status(spark, root, run_id)
    if status not in TRANSITIONS[old]:
        raise ContractError(f"Illegal run status change: {old} -> {status}.")
    steps = {"CREATED": 0, "RUNNING": 1, "VALIDATED": 2, "PUBLISHED": 3, "FAILED": 4}
    row = small_frame(spark, [(run_id, steps[status], status, _now())], STATUS)
    write_parquet(row, f"{root.rstrip('/')}/status", mode="append")


def content_hash(df: DataFrame):
    """Order-insensitive hash of all rows: one map-side combined sum, no sort.

    Decimal sums cannot overflow the way long sums can.
    """
    return F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string")


def fingerprint(df: DataFrame, name: str, with_hash: bool = True) -> DataFrame:
    """Row count, event counts, delayed entries and content hash of an input."""
    kinds = {"default": "DEFAULT", "prepayment": "PREPAYMENT", "censor": "CENSOR"}
    none = F.lit(None).cast("long")
    has_event, has_entry = "event_type" in df.columns, "entry_time_month" in df.columns
    return df.agg(
        F.count("*").alias("row_count"),
        *[
            (F.count_if(F.col("event_type") == v) if has_event else F.max(none)).alias(f"{k}_count")
            for k, v in kinds.items()
        ],
        (F.count_if(F.col("entry_time_month") > 0) if has_entry else F.max(none)).alias(
            "delayed_entry_count"
        ),
        (content_hash(df) if with_hash else F.max(F.lit(None).cast("string"))).alias(
            "content_hash"
        ),
    ).select(F.lit(name).alias("input"), *FINGERPRINT.names[1:])


def reconcile_fingerprint(observed: DataFrame, expected: dict[str, int | str]) -> dict:
    """Differences between an observed fingerprint row and expected values."""
    row = observed.first().asDict()
    return {
        k: {"observed": row.get(k), "expected": v} for k, v in expected.items() if row.get(k) != v
    }


def build_tables(
    analysis: DataFrame, performance: DataFrame, confidence_level: float = 0.95
) -> dict[str, Callable[[], dict[str, DataFrame]]]:
    """Named build steps in dependency order; each returns the tables it produces."""
    complete = analysis.filter("core_covariates_complete_flag")
    built: dict = {}

    def baseline():
        built["cox"] = cox.fit_cox(complete, confidence_level)
        return {
            "cox_results": built["cox"].coefficients,
            "cox_diagnostics": built["cox"].diagnostics,
        }

    def proportional_hazards():
        variables, overall = ph_test.ph_tests(built["cox"])
        return {"ph_diagnostics": variables, "ph_global_diagnostics": overall}

    def cause_specific():
        models = cox.fit_cause_specific(complete, confidence_level=confidence_level)
        return {
            f"cause_specific_{cause.lower()}_{kind}": table
            for cause, model in models.items()
            for kind, table in [
                ("results", model.coefficients),
                ("diagnostics", model.diagnostics),
            ]
        }

    def fine_gray_default():
        model = fine_gray.fit_fine_gray(complete, confidence_level)
        return {
            "fine_gray_default_results": model.coefficients,
            "fine_gray_default_diagnostics": model.diagnostics,
        }

    def time_varying():
        # Checks and fit read the intervals several times: join and window run once.
        with durable(intervals.build_intervals(performance, analysis)) as rows:
            intervals.validate_intervals(rows, analysis)
            model = cox.fit_time_varying(rows, confidence_level)
        return {
            "time_varying_cox_results": model.coefficients,
            "time_varying_cox_diagnostics": model.diagnostics,
        }

    return {
        "kaplan_meier": lambda: {
            "km_results": km.fit_kaplan_meier(
                dataset.survival_view(analysis), confidence_level=confidence_level
            )
        },
        "cox": baseline,
        "proportional_hazards": proportional_hazards,
        "cause_specific": cause_specific,
        "aalen_johansen": lambda: {
            "aalen_johansen_results": aj.fit_aalen_johansen(
                analysis, confidence_level=confidence_level
            )
        },
        "pd_vintage": lambda: horizons.fit_pd_vintage(analysis, confidence_level=confidence_level),
        "grouped": lambda: {
            "grouped_cif_results": horizons.grouped_curves(analysis, confidence_level),
            "grouped_pd_horizons": horizons.grouped_pd(analysis),
        },
        "fine_gray": fine_gray_default,
        "time_varying": time_varying,
    }


RESULT_TABLES = [
    "km_results", "cox_results", "cox_diagnostics", "ph_diagnostics", "ph_global_diagnostics",
    "cause_specific_default_results", "cause_specific_default_diagnostics",
    "cause_specific_prepayment_results", "cause_specific_prepayment_diagnostics",
    "aalen_johansen_results", "overall_pd_horizons", "vintage_cif_results",
    "vintage_horizon_results", "grouped_cif_results", "grouped_pd_horizons",
    "fine_gray_default_results", "fine_gray_default_diagnostics", "time_varying_cox_results",
    "time_varying_cox_diagnostics",
]


def build_release(
    analysis: DataFrame, performance: DataFrame, root: str, run_id: str
) -> list[str]:
    """Build and write all results of a run; it ends RUNNING, or FAILED on any error."""
    spark = analysis.sparkSession
    transition(spark, root, run_id, "CREATED")
    transition(spark, root, run_id, "RUNNING")
    written = []
    try:
        inputs = fingerprint(analysis, "analysis_loans").unionByName(
            fingerprint(performance, "performance")
        )
        write_parquet(inputs, table_path(root, run_id, "input_fingerprint"))
        for step in build_tables(analysis, performance).values():
            for name, df in step().items():
                write_parquet(df, table_path(root, run_id, name))
                written.append(name)
    except Exception:
        transition(spark, root, run_id, "FAILED")
        raise
    return written


def load_tables(
    spark: SparkSession, root: str, run_id: str, partial: bool = False
) -> dict[str, DataFrame]:
    """Result tables of a run; a missing one fails unless `partial` is set."""
    paths = {name: table_path(root, run_id, name) for name in RESULT_TABLES}
    missing = [name for name, path in paths.items() if not path_exists(spark, path)]
    if missing and not partial:
        raise ContractError(f"Run {run_id} lacks {missing}.")
    return {n: spark.read.parquet(p) for n, p in paths.items() if n not in missing}


def count_reconciliation(
    analysis: DataFrame, overall: DataFrame, vintage: DataFrame, grouped: DataFrame
) -> DataFrame:
    """Loan and event counts of the horizon tables against the analysis population."""
    kind = F.col("event_type")
    expected = analysis.agg(
        F.count("*").alias("loans"),
        F.count_if(kind == "DEFAULT").alias("defaults"),
        F.count_if(kind == "PREPAYMENT").alias("prepayments"),
    )
    names = {"loan_count": "loans", "default_count": "defaults", "prepayment_count": "prepayments"}

    def totals(df, keys):
        return df.groupBy(*keys).agg(*[F.sum(c).alias(v) for c, v in names.items()])

    parts = [
        overall.select(
            F.lit("portfolio").alias("table_name"),
            *[F.col(c).alias(v) for c, v in names.items()],
        ),
        totals(vintage, ["horizon_months"]).withColumn("table_name", F.lit("vintage_year")),
        totals(grouped, ["feature", "horizon_months"]).withColumn("table_name", F.col("feature")),
    ]
    columns = ["table_name", *names.values()]
    stacked = reduce(DataFrame.unionByName, [p.select(columns) for p in parts])
    loans, defaults, prepayments = (
        expected.select(c).scalar() for c in ("loans", "defaults", "prepayments")
    )
    return stacked.groupBy("table_name").agg(
        F.count("*").alias("horizon_rows"),
        F.count_if(F.col("loans") != loans).alias("loan_mismatches"),
        F.count_if(F.col("defaults") != defaults).alias("default_mismatches"),
        F.count_if(F.col("prepayments") != prepayments).alias("prepayment_mismatches"),
    )


def model_reconciliation(complete: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Absolute differences between the models' own counts and the complete cases."""
    kind = F.col("event_type")
    truth = complete.agg(
        F.count("*").alias("rows"),
        F.count_if(kind == "DEFAULT").alias("defaults"),
        F.count_if(kind == "PREPAYMENT").alias("prepayments"),
        F.count_if(F.col("entry_time_month") > 0).alias("delayed"),
    )

    def counts(name, prefix):
        return tables[name].select(
            F.col("n_observations").alias(f"{prefix}_rows"),
            F.col("n_events").alias(f"{prefix}_events"),
            F.col("delayed_entry_count").alias(f"{prefix}_delayed"),
        )

    merged = merge_rows(
        truth,
        counts("cox_diagnostics", "cox"),
        counts("cause_specific_default_diagnostics", "csd"),
        counts("cause_specific_prepayment_diagnostics", "csp"),
        tables["fine_gray_default_diagnostics"].select(
            F.col("n_input_loans").alias("fg_rows"),
            F.col("n_default").alias("fg_events"),
            F.col("n_prepayment").alias("fg_prepayments"),
            F.col("n_delayed_entry").alias("fg_delayed"),
        ),
    )
    pairs = {"fg_prepayments": "prepayments"}
    for prefix, events in [
        ("cox", "defaults"), ("csd", "defaults"), ("csp", "prepayments"), ("fg", "defaults")
    ]:
        pairs |= {
            f"{prefix}_rows": "rows", f"{prefix}_events": events, f"{prefix}_delayed": "delayed"
        }
    return merged.select(*[F.abs(F.col(a) - F.col(b)).alias(a) for a, b in pairs.items()])


def release_checks(tables: dict[str, DataFrame], analysis: DataFrame) -> dict[str, Callable]:
    """Named checks; each raises on failure."""
    complete = analysis.filter("core_covariates_complete_flag")

    def zero(check, name, ignore=("rows",)):
        return lambda: require_zero(check(tables[name]), name, ignore)

    def inventory():
        missing = [name for name in RESULT_TABLES if name not in tables]
        if missing:
            raise ContractError(f"Missing result tables: {missing}.")

    def time_varying(df):
        return cox.check_coefficients(df, TV_PREDICTORS)

    def counts():
        table = count_reconciliation(
            analysis,
            tables["overall_pd_horizons"],
            tables["vintage_horizon_results"],
            tables["grouped_pd_horizons"],
        )
        names = ["loan_mismatches", "default_mismatches", "prepayment_mismatches"]
        require_zero(table.agg(*[F.sum(n).alias(n) for n in names]), "Count reconciliation")

    return {
        "inventory": inventory,
        "km_results": zero(km.check_km_results, "km_results"),
        "aalen_johansen_results": zero(aj.check_aj_results, "aalen_johansen_results"),
        "grouped_cif_results": zero(aj.check_aj_results, "grouped_cif_results"),
        "vintage_cif_results": zero(horizons.check_vintage_cif, "vintage_cif_results"),
        "overall_pd_horizons": zero(horizons.check_overall_pd, "overall_pd_horizons"),
        "vintage_horizon_results": zero(
            horizons.check_vintage_horizons, "vintage_horizon_results"
        ),
        "grouped_pd_horizons": zero(horizons.check_grouped_pd, "grouped_pd_horizons"),
        "cox_results": zero(cox.check_coefficients, "cox_results"),
        "cox_diagnostics": zero(cox.check_diagnostics, "cox_diagnostics"),
        "cause_specific_default_results": zero(
            cox.check_coefficients, "cause_specific_default_results"
        ),
        "cause_specific_prepayment_results": zero(
            cox.check_coefficients, "cause_specific_prepayment_results"
        ),
        "time_varying_cox_results": zero(time_varying, "time_varying_cox_results"),
        "fine_gray_default_results": zero(
            fine_gray.check_fine_gray_results, "fine_gray_default_results"
        ),
        "fine_gray_default_diagnostics": zero(
            fine_gray.check_fine_gray_diagnostics, "fine_gray_default_diagnostics"
        ),
        "ph_diagnostics": zero(ph_test.check_ph_variables, "ph_diagnostics"),
        "ph_global_diagnostics": zero(ph_test.check_ph_global, "ph_global_diagnostics"),
        "count_reconciliation": counts,
        "model_reconciliation": lambda: require_zero(
            model_reconciliation(complete, tables), "Model reconciliation"
        ),
    }


def validate_release(spark: SparkSession, root: str, run_id: str, analysis: DataFrame) -> DataFrame:
    """Run every check even after a failure, write the report, and set VALIDATED or FAILED."""
    if run_status(spark, root, run_id) != "RUNNING":
        raise ContractError("Only a RUNNING run can be validated.")
    rows = []
    for name, check in release_checks(
        load_tables(spark, root, run_id, partial=True), analysis
    ).items():
        try:
            check()
            rows.append((run_id, name, "PASS", ""))
        except Exception as error:  # every failure becomes a report row
            rows.append((run_id, name, "FAIL", str(error)))
    report = small_frame(spark, rows, CHECKS)
    write_parquet(report, table_path(root, run_id, "validation_report"))
    passed = all(row[2] == "PASS" for row in rows)
    transition(spark, root, run_id, "VALIDATED" if passed else "FAILED")
    if not passed:
        raise ContractError(f"Release {run_id} failed: {[r[1] for r in rows if r[2] == 'FAIL']}.")
    return report


def publish(spark: SparkSession, root: str, run_id: str) -> None:
    """Make a validated run the current one."""
    if run_status(spark, root, run_id) != "VALIDATED":
        raise ContractError("Only a VALIDATED run can be published.")
    # A run counter orders publications, however close in time; a reader never meets a gap.
    point(spark, f"{root.rstrip('/')}/current", run_id)
    transition(spark, root, run_id, "PUBLISHED")


def current_run(spark: SparkSession, root: str) -> str:
    """The last published run."""
    pointers = pointed(spark, f"{root.rstrip('/')}/current")
    if not pointers:
        raise ContractError("No run is published.")
    for _, run_id in pointers:
        if run_status(spark, root, run_id) == "PUBLISHED":
            return run_id
    raise ContractError("The current pointer names no published run.")


def current_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return load_tables(spark, root, current_run(spark, root))


def published_views(
    spark: SparkSession, root: str, analysis: DataFrame, prov: projections.Provenance | None = None
) -> dict[str, DataFrame]:
    """The seven projections of the current run."""
    run_id = current_run(spark, root)
    tables = load_tables(spark, root, run_id)
    prov = prov or projections.Provenance(run_id)
    return {
        "portfolio_summary": projections.portfolio_summary(analysis, prov),
        "pd_results": projections.pd_results(tables["overall_pd_horizons"], prov),
        "survival_results": projections.survival_results(
            tables["km_results"], tables["aalen_johansen_results"], prov
        ),
        "risk_driver_results": projections.risk_driver_results(tables, prov),
        "vintage_results": projections.vintage_results(tables["vintage_horizon_results"], prov),
        "grouped_pd_results": projections.grouped_pd_results(tables["grouped_pd_horizons"], prov),
        "model_diagnostics": projections.model_diagnostics(tables, prov),
    }
