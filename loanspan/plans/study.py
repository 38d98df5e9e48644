"""The study tables over one data folder, each written once per application.

Raw tables, the event map, the model table and the intervals are the materialization points; the
cleaning and clock steps between them are projections that Spark fuses into the scans. Fitted models
are kept too: a few coefficients and month sums each.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanspan.functions.durable import shared_folder
from loanspan.operators import cox, fine_gray
from loanspan.operators.clock import build_survival
from loanspan.operators.dataset import build_model_dataset
from loanspan.operators.events import build_event_map
from loanspan.operators.intervals import build_intervals
from loanspan.operators.standardize import (
    clean_origination,
    clean_performance,
    standardize_origination,
    standardize_performance,
)
from loanspan.sources import order_panel
from loanspan.sources.archives import write_archives
from loanspan.sources.tables import path_exists, remove_path
from loanspan.sources.text import kind_fields

_STUDIES: dict[tuple[str, str], "Study"] = {}


class Study:
    """Lazily built tables; use `study` to share them within an application."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        name = sf_dir.strip("/").replace("/", "_")
        self.folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}-{name}"

    def written_path(self, name: str, df: DataFrame) -> str:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return path

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.written_path(name, df))

    def drop(self) -> None:
        """Remove the written tables; the study is unusable afterwards."""
        remove_path(self.spark, self.folder)
        _STUDIES.pop((self.spark.sparkContext.applicationId, self.sf_dir), None)

    @cached_property
    def feed(self) -> DataFrame:
        return order_panel.report_feed(self.spark, self.sf_dir)

    @cached_property
    def raw_orig(self) -> DataFrame:
        return self._written("raw_orig", order_panel.raw_origination(self.spark, self.sf_dir))

    @cached_property
    def raw_perf(self) -> DataFrame:
        return self._written("raw_perf", order_panel.raw_performance(self.spark, self.sf_dir))

    def text_folder(self, kind: str) -> str:
        """The raw table of a kind as header-less pipe text, one folder per vintage."""
        path = f"{self.folder}/text_{kind}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            table = self.raw_orig if kind == "origination" else self.raw_perf
            fields, _ = kind_fields(kind)
            present = set(table.columns)
            line = F.concat_ws(
                "|",
                *[
                    F.coalesce(F.col(f), F.lit("")) if f in present else F.lit("") for f in fields
                ],
            )
            table.select(line.alias("value"), "vintage_year").write.mode("overwrite").partitionBy(
                "vintage_year"
            ).text(path)
        return path

    def archive_folder(self, kind: str) -> str:
        """The text of a kind as archives, one folder per vintage."""
        path = f"{self.folder}/archives_{kind}"
        if not path_exists(self.spark, f"{path}/complete"):
            for year in self.vintages:
                lines = self.spark.read.text(f"{self.text_folder(kind)}/vintage_year={year}")
                write_archives(lines.coalesce(2), kind, year, f"{path}/{year}")
            self.spark.range(0).write.parquet(f"{path}/complete")
        return path

    @cached_property
    def vintages(self) -> list[int]:
        rows = self.raw_orig.select("vintage_year").distinct().collect()
        return sorted(int(r["vintage_year"]) for r in rows)

    @cached_property
    def clean_orig(self) -> DataFrame:
        return clean_origination(self.raw_orig)

    @cached_property
    def clean_perf(self) -> DataFrame:
        return clean_performance(self.raw_perf)

    @cached_property
    def orig(self) -> DataFrame:
        return standardize_origination(self.clean_orig)

    @cached_property
    def perf(self) -> DataFrame:
        return standardize_performance(self.clean_perf)

    @cached_property
    def events(self) -> DataFrame:
        return self._written("events", build_event_map(self.clean_orig, self.clean_perf))

    @cached_property
    def survival(self) -> DataFrame:
        return build_survival(self.events)

    @cached_property
    def model(self) -> DataFrame:
        return self._written("model", build_model_dataset(self.orig, self.survival))

    @cached_property
    def complete(self) -> DataFrame:
        return self.model.filter("core_covariates_complete_flag")

    @cached_property
    def intervals(self) -> DataFrame:
        built = build_intervals(self.perf, self.model, validate=False)
        return self._written("intervals", built)

    @cached_property
    def baseline(self) -> cox.CoxModel:
        return cox.fit_cox(self.complete)

    @cached_property
    def cause_specific(self) -> dict[str, cox.CoxModel]:
        return cox.fit_cause_specific(self.complete)

    @cached_property
    def time_varying(self) -> cox.CoxModel:
        return cox.fit_time_varying(self.intervals)

    @cached_property
    def fine_gray(self) -> fine_gray.FineGrayModel:
        return fine_gray.fit_fine_gray(self.complete)


def study(spark: SparkSession, sf_dir: str) -> Study:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STUDIES:
        _STUDIES[key] = Study(spark, sf_dir)
    return _STUDIES[key]
