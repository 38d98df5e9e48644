"""Registered queries against their reference SQL, and the driver contract."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

# One query per operator family; tools/compare.py runs all of them.
CHECKED = [
    "origination_cleaned", "performance_standardized", "performance_key_check", "final_validation",
    "yearly_audit", "special_values", "conflict_summary", "duration_audit", "sample_flow",
    "event_map", "survival_clock", "loan_age_panel_with_duplicates", "model_dataset",
    "time_varying_intervals", "kaplan_meier_by_vintage", "grouped_cif", "vintage_horizons",
    "grouped_pd", "published_survival", "pd_view", "band_ranking", "interpolated_cif",
    "dense_timelines", "nested_sample", "enriched_sample", "profile_scores", "score_validation",
    "overdue_labels", "file_order_violations",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(
        tuple(0.0 if isinstance(r[i], float) and r[i] == 0 else r[i] for i in order) for r in rows
    )


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert bag(df.columns, map(tuple, df.collect())) == bag(names, result.fetchall())


def test_driver_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 140
    assert entry.entry(spark).count() > 0
