"""Raw text, archives, table sinks and incremental ingestion."""

import tracemalloc
import zipfile

import pytest
from pyspark.sql import functions as F

from loanspan.contracts import ORIGINATION_FIELDS, PERFORMANCE_FIELDS, ContractError, schema_of
from loanspan.functions.months import yyyymm_to_date
from loanspan.operators.standardize import (
    clean_origination,
    standardize_origination,
    standardize_performance,
)
from loanspan.sources.archives import member_lines, scan_archives, write_archives
from loanspan.sources.tables import (
    export_checked,
    path_exists,
    read_any,
    write_csv,
    write_parquet,
    write_vintages,
)
from loanspan.sources.text import numbered_lines, scan_text, scan_typed_text
from loanspan.streaming.ingest import ingest_new_files


def line(fields, **values):
    return "|".join(str(values.get(f, "")) for f in fields)


def orig_line(**values):
    base = dict(
        loan_id="F20Q10000001", fico="700", first_payment_date="202002", maturity_date="205001",
        original_dti="35", original_ltv="80", original_cltv="999", original_upb="100000",
        original_interest_rate="3.5", original_loan_term="360", number_borrowers="2",
        occupancy_status="9", property_type="99", loan_purpose="P", vantagescore_4="9999",
        seller_name='A "B" C',
    )
    return line(ORIGINATION_FIELDS, **{**base, **values})


def perf_line(**values):
    base = dict(
        loan_id="F20Q10000001", monthly_reporting_period="202003", current_actual_upb="99000.5",
        delinquency_status="00", loan_age="1", current_interest_rate="3.5",
    )
    return line(PERFORMANCE_FIELDS, **{**base, **values})


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_scan_text_keeps_strings(spark, tmp_path):
    path = write(tmp_path / "sample_orig_2020.txt", [orig_line(), orig_line(loan_id="B", fico="")])
    df = scan_text(spark, path, "origination", 2020)
    assert len(df.columns) == 18 and all(t == "string" for _, t in df.dtypes)
    rows = {r.loan_id: r for r in df.collect()}
    assert rows["B"].fico is None and rows["F20Q10000001"].vintage_year == "2020"


@pytest.mark.parametrize("text", ["a|b|c", orig_line() + "|extra"])
def test_scan_text_rejects_wrong_field_count(spark, tmp_path, text):
    path = write(tmp_path / "bad.txt", [orig_line(), text])
    with pytest.raises(Exception):
        scan_text(spark, path, "origination", 2020).collect()


def test_typed_text(spark, tmp_path):
    lines = ["﻿" + perf_line(loan_id=" A "), perf_line(loan_id="B", loan_age=" 7 ")]
    path = write(tmp_path / "sample_perf_2020.txt", lines)
    rows = {r.loan_id: r for r in scan_typed_text(spark, path, "performance").collect()}
    assert rows["A"].source_row == 1 and rows["B"].source_row == 2
    assert rows["B"].source_loan_age == 7.0 and rows["B"].source_loan_age_raw == " 7 "
    assert str(rows["A"].performance_month) == "2020-03-01"
    assert rows["A"].source_file == "sample_perf_2020.txt"


@pytest.mark.parametrize(
    "change",
    [{"loan_id": " "}, {"monthly_reporting_period": "202013"}, {"current_actual_upb": "x"}],
)
def test_typed_text_is_strict(spark, tmp_path, change):
    path = write(tmp_path / "p.txt", [perf_line(**change)])
    with pytest.raises(Exception):
        scan_typed_text(spark, path, "performance").collect()


def test_line_numbers_across_splits(spark, tmp_path):
    path = write(tmp_path / "many.txt", [perf_line(loan_id=f"L{i}") for i in range(3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = scan_typed_text(spark, path, "performance")
        bad = df.filter(F.col("loan_id") != F.concat(F.lit("L"), F.col("source_row") - 1))
        assert df.count() == 3000 and bad.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_archives(spark, tmp_path):
    path = tmp_path / "sample_2020.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in/sample_orig_2020.txt", "\n".join([orig_line(), orig_line(loan_id="B")]))
        z.writestr("in/sample_perf_2020.txt", perf_line())
    assert scan_archives(spark, str(path), "origination", 2020).count() == 2
    perf = scan_archives(spark, str(path), "performance", 2020).first()
    assert perf.current_actual_upb == "99000.5" and perf.zero_balance_code is None
    with pytest.raises(Exception, match="no member"):
        scan_archives(spark, str(path), "performance", 2021).collect()


def test_cleaning_rules(spark, tmp_path):
    lines = [
        orig_line(loan_id="F18Q10000001", fico="9999", original_dti="70"),
        orig_line(loan_id="F18Q20000001", fico="299", number_borrowers="99"),
        orig_line(loan_id="F17Q40000001", number_borrowers="1", original_ltv="120"),
    ]
    path = write(tmp_path / "o.txt", lines)
    raw = scan_text(spark, path, "origination", 2018)
    clean = clean_origination(raw)
    rows = {r.loan_id: r for r in clean.collect()}
    first, second, third = (rows[k] for k in ("F18Q10000001", "F18Q20000001", "F17Q40000001"))
    assert first.fico is None and first.fico_not_available_flag
    assert first.legacy_number_borrowers_encoding_flag and first.number_borrowers is None
    assert first.multiple_borrowers_flag
    assert not second.legacy_number_borrowers_encoding_flag
    assert second.number_borrowers is None and second.multiple_borrowers_flag is None
    assert third.ltv_above_100_flag and third.original_cltv is None
    assert third.occupancy_status is None and third.property_type is None
    std = {r.loan_id: r for r in standardize_origination(clean).collect()}
    assert std["F18Q10000001"].original_dti is None
    assert std["F18Q10000001"].qc_dti_out_of_range
    assert std["F18Q20000001"].fico is None and std["F18Q20000001"].qc_credit_score_out_of_range
    assert str(std["F18Q10000001"].operational_origination_date) == "2020-01-01"
    assert std["F18Q10000001"].qc_proxy_year_differs_from_vintage


@pytest.mark.parametrize("month", [None, "202013", "20200"])
@pytest.mark.parametrize("stored", [False, True])
def test_bad_reporting_months_fail_whatever_is_read(spark, tables, tmp_path, month, stored):
    column = "monthly_reporting_period"
    bad = F.lit(month).cast("string")
    if stored:
        some = F.when(F.crc32(F.col("loan_id").cast("binary")) % 5 == 0, bad).otherwise(F.col(column))
        path = str(tmp_path / "p")
        tables.clean_perf.withColumn(column, some).write.parquet(path)
        perf = spark.read.parquet(path)
    else:
        perf = tables.clean_perf.withColumn(column, bad)
    result = standardize_performance(perf)
    for read in (
        lambda: result.select("loan_id").collect(),
        lambda: result.select("performance_month").collect(),
        lambda: result.count(),
    ):
        with pytest.raises(Exception, match="month"):
            read()


def test_strict_standardization_fails(spark, tables, tmp_path):
    bad = tables.clean_perf.withColumn("monthly_reporting_period", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="performance_month is missing"):
        standardize_performance(bad).select("performance_month").collect()
    path = write(tmp_path / "o.txt", [orig_line(fico="abc")])
    clean = clean_origination(scan_text(spark, path, "origination", 2020))
    with pytest.raises(Exception, match="fico is not numeric"):
        standardize_origination(clean).collect()


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, 2020), (2, 2021)], "x int, vintage_year int")
    out = str(tmp_path / "v")
    write_vintages(a, out)
    b = spark.createDataFrame([(9, 2020), (3, 2022)], "x int, vintage_year int")
    write_vintages(b, out)
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [1, 2, 3]
    write_vintages(b, out, force=True)
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == [2, 3, 9]

    schema = schema_of("x int, y string")
    base = str(tmp_path / "named")
    assert read_any(spark, base, schema).count() == 0
    write_parquet(spark.createDataFrame([(1, "p")], schema), f"{base}.parquet")
    assert read_any(spark, base, schema).first().y == "p"
    write_csv(spark.createDataFrame([(2, "c")], schema), f"{base}.csv")
    assert read_any(spark, base, schema).first().y == "c"


def test_export_checked_keeps_old_table_on_failure(spark, tmp_path):
    out = str(tmp_path / "t")
    export_checked(spark.range(3), out, lambda df: None)

    def refuse(df):
        raise ContractError("no")

    with pytest.raises(ContractError):
        export_checked(spark.range(9), out, refuse)
    with pytest.raises(ContractError, match="empty"):
        export_checked(spark.range(0), out, lambda df: None)
    assert spark.read.parquet(out).count() == 3
    export_checked(spark.range(5), out, lambda df: None)
    assert spark.read.parquet(out).count() == 5 and path_exists(spark, out)


def test_incremental_ingestion_reads_each_file_once(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    write(folder / "sample_orig_2020.txt", [orig_line()])
    ingest_new_files(spark, str(folder), "origination", out, state)
    write(folder / "sample_orig_2021.txt", [orig_line(loan_id="F21Q10000002")])
    ingest_new_files(spark, str(folder), "origination", out, state)
    ingest_new_files(spark, str(folder), "origination", out, state)
    got = sorted((r.vintage_year, r.loan_id) for r in spark.read.parquet(out).collect())
    assert got == [(2020, "F20Q10000001"), (2021, "F21Q10000002")]


def test_members_larger_than_a_chunk_are_streamed(tmp_path):
    path = str(tmp_path / "a.zip")
    line = b"0123456789" * 20
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        with archive.open("in/sample_perf_2020.txt", "w") as member:
            member.write(b"\xef\xbb\xbf")
            for _ in range(600):
                member.write((line + b"\r\n") * 1000)
            member.write(b"last")
    tracemalloc.start()
    rows = 0
    for batch in member_lines(path, "sample_perf_2020.txt", "2020"):
        values = batch.column(0)
        assert values[0].as_py() in (line.decode(), "last")
        rows += len(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 120 MB of text pass through a few chunks of 4 MB.
    assert rows == 600_001 and peak < 48 << 20


def test_archives_round_trip(spark, tmp_path):
    rows = [(orig_line(loan_id=f"F20Q1000{i:04}"),) for i in range(500)]
    lines = spark.createDataFrame(rows, "value string").repartition(3)
    folder = str(tmp_path / "zips")
    write_archives(lines, "origination", 2020, folder)
    write_archives(lines.filter("false"), "origination", 2021, str(tmp_path / "none"))
    assert len(list((tmp_path / "zips").glob("*.zip"))) == 3 and not (tmp_path / "none").exists()
    found = scan_archives(spark, folder, "origination", 2020)
    text_path = str(tmp_path / "plain")
    lines.write.text(text_path)
    expected = scan_text(spark, text_path, "origination", 2020)
    assert sorted(found.collect()) == sorted(expected.select(found.columns).collect())


def test_numbering_lines_exchanges_no_text(spark, tmp_path):
    path = str(tmp_path / "long.txt")
    with open(path, "w") as file:
        file.writelines(f"{i}|{'x' * 90}\n" for i in range(20_000))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        numbered = numbered_lines(spark, [path])
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        rows = numbered.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(rows) == 20_000
    assert all(r.value.startswith(f"{r.source_row - 1}|") and r.source_file == "long.txt" for r in rows)
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


@pytest.mark.parametrize(
    "text, month",
    [("202001", "2020-01-01"), ("202013", None), ("202000", None), ("20201", None), ("2020012", None),
     ("", None), (None, None), ("abcdef", None), ("+20201", None), ("-20201", None), ("999912", "9999-12-01")],
)
def test_month_text(spark, text, month):
    row = spark.createDataFrame([(text,)], "t string").select(yyyymm_to_date(F.col("t")).alias("d")).first()
    assert (None if row.d is None else str(row.d)) == month
