"""Raw to clean to daily tables, with contracts, quarantine, reconciliation, metrics, quality gate and drift."""

from __future__ import annotations

import calendar as months_of
import json
from dataclasses import dataclass
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import in_month
from tidemark.operators import drift, rules, transforms
from tidemark.operators.upsert import incremental_merge
from tidemark.sources import contracts
from tidemark.sources.session import raw_rows
from tidemark.sources.store import TableStore

CONTRACTS = Path(__file__).resolve().parents[1] / "contracts"
METRICS_SCHEMA = "run_ts timestamp, run_id string, pipeline_name string, dataset string, contract_version int, metrics_json string"
RAW, CLEAN, DAILY = "bronze.events_raw", "silver.trips_clean", "gold.fct_trips_daily"
SUMMARY, METRICS = "quality.violations_summary", "quality.pipeline_metrics"


@dataclass
class Pipeline:
    spark: SparkSession
    store: TableStore
    run_id: str
    run_ts: datetime = datetime(1970, 1, 1, tzinfo=timezone.utc)
    year: int | None = None
    month: int | None = None
    max_invalid_ratio: float = 0.001
    strict_quality: bool = True
    folder: Path = CONTRACTS
    #: Enforce the contract on all candidates, not only those that pass the validity filter.
    enforce_unfiltered: bool = False
    #: Gate and drift over the month alone; otherwise it is only noted in their rows.
    quality_in_window: bool = False
    #: Keep earlier runs' gate summaries.
    append_summary: bool = False
    strict_defaults: bool = False
    #: Enforce the raw contract as well: a missing column, a wrong type or too many bad rows end the run.
    enforce_raw: bool = False
    #: A NaN breaks a range rule.
    reject_nan: bool = False

    def metrics(self, name: str, dataset: str, version: Any, values: dict[str, Any]) -> None:
        row = [(self.run_ts, self.run_id, name, dataset, int(version), json.dumps(values, sort_keys=True, default=str))]
        self.store.append(METRICS, self.spark.createDataFrame(row, METRICS_SCHEMA))

    def quarantine(self, df: DataFrame, contract: contracts.Contract) -> None:
        """A table for each dataset, so that different columns never meet."""
        records = rules.quarantine_records(df, contract.dataset, contract.version, self.run_id, F.lit(self.run_ts))
        if not records.isEmpty():
            self.store.append(f"quality.quarantine_{contract.dataset.replace('.', '_')}", records)

    def staged(self, dataset: str, df: DataFrame) -> DataFrame:
        """The rows written once and read again, so that the counts, the quarantine, the upsert and the reconciliation
        don't each work them out anew."""
        table = f"work.{dataset.replace('.', '_')}"
        self.store.overwrite(table, df)
        self.store.vacuum(table)
        return self.store.read(self.spark, table)

    def load(self, name: str, dataset: str, df: DataFrame, before: DataFrame | None, day: str) -> dict[str, Any]:
        contract = contracts.load(self.folder, dataset)
        done = rules.enforce(df, contract, self.max_invalid_ratio, reject_nan=self.reject_nan, stage=lambda tags: self.staged(dataset, tags))
        self.quarantine(done.quarantine, contract)
        merged = incremental_merge(self.store, done.valid, dataset, contract.primary_key, contract.watermark, contract.late_arrival_days, partition_by=day)
        target = self.store.read(self.spark, dataset).filter(in_month(day, self.year, self.month))
        report = rules.reconcile(done.valid if before is None else before, target, 0.0, strict=False)
        values = {"enforcement": done.summary, "merge": merged, "reconciliation": report}
        self.metrics(name, dataset, contract.version, values)
        return values

    def raw(self, path: str) -> None:
        rows = raw_rows(self.spark, path, year=self.year, month=self.month)
        if self.enforce_raw:
            contract = contracts.load(self.folder, RAW)
            done = rules.enforce(rows, contract, self.max_invalid_ratio, reject_nan=self.reject_nan, stage=lambda tags: self.staged(RAW, tags))
            self.quarantine(done.quarantine, contract)
            self.metrics("raw", RAW, contract.version, {"enforcement": done.summary})
            rows = done.valid
        self.store.overwrite(RAW, rows)

    def clean(self) -> dict[str, Any]:
        trips = transforms.canonical(self.store.read(self.spark, RAW)).filter(in_month("pickup_date", self.year, self.month))
        if not self.enforce_unfiltered:
            trips = transforms.valid_trips(trips)
        return self.load("clean", CLEAN, transforms.latest(trips, ["trip_id"], "updated_at"), None, "pickup_date")

    def daily(self) -> dict[str, Any]:
        trips = self.store.read(self.spark, CLEAN).filter(in_month("pickup_date", self.year, self.month))
        kpi = transforms.daily_kpi(trips)
        if self.year and self.month:
            covered = rules.day_coverage(kpi, "trip_date", months_of.monthrange(self.year, self.month)[1]).first()
            if not covered["passed"]:
                raise ValueError(f"only {covered['days']} days in {self.year}-{self.month:02d}")
        values = self.load("daily", DAILY, kpi, None, "trip_date")
        self.store.overwrite("gold.dim_vendor", transforms.vendor_dim(trips))
        for kind in ("payment_type", "rate_code"):
            self.store.overwrite(f"gold.dim_{kind}", transforms.lookup_dim(self.spark, kind))
        return values

    def quality(self) -> dict[str, Any]:
        silver, gold = self.store.read(self.spark, CLEAN), self.store.read(self.spark, DAILY)
        if self.quality_in_window:
            silver, gold = silver.filter(in_month("pickup_date", self.year, self.month)), gold.filter(in_month("trip_date", self.year, self.month))
        write = self.store.append if self.append_summary else self.store.overwrite
        contract = contracts.load(self.folder, CLEAN)
        rules.quality_gate(silver, gold, dataset=CLEAN, run_id=self.run_id, run_ts=self.run_ts, contract=contract, window=(self.year, self.month), strict=self.strict_quality, write=lambda s: write(SUMMARY, s), strict_defaults=self.strict_defaults)
        common = {"run_id": self.run_id, "run_ts": self.run_ts, "window": (self.year, self.month)}
        return {
            CLEAN: drift.detect(self.store, silver, dataset=CLEAN, metrics=drift.grain_metrics("trip"), distribution="passenger_count", **common),
            DAILY: drift.detect(self.store, gold, dataset=DAILY, metrics=drift.grain_metrics("day"), **common),
        }

    def all(self, path: str) -> dict[str, Any]:
        self.raw(path)
        return {"clean": self.clean(), "daily": self.daily(), "quality": self.quality()}

    def report(self) -> str:
        """Key figures of the window as text."""
        silver = self.store.read(self.spark, CLEAN).filter(in_month("pickup_date", self.year, self.month))
        gold = self.store.read(self.spark, DAILY).filter(in_month("trip_date", self.year, self.month))
        total = gold.agg(F.sum("trips").alias("trips"), F.sum("total_fare").alias("fare"), F.try_divide(F.sum("total_fare"), F.sum("trips")).cast(transforms.MONEY).alias("average")).first()
        days = gold.groupBy("trip_date").agg(F.sum("trips").alias("trips"), F.sum("total_fare").cast(transforms.MONEY).alias("fare")).orderBy("trip_date").limit(5).collect()
        head = f"clean rows: {silver.count()}\ntrips: {total['trips']}\nfare: {total['fare']}\naverage fare: {total['average']}\n"
        return head + "".join(f"{r['trip_date']} {r['trips']} {r['fare']}\n" for r in days)
