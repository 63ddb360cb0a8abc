"""Profiles of a table and their drift between runs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative changes that warn and fail.
THRESHOLDS = {
    "volume_ratio": (0.20, 0.35),
    "avg_fare_amount_ratio": (0.20, 0.35),
    "avg_fare_per_trip_ratio": (0.20, 0.35),
    "avg_trip_distance_ratio": (0.20, 0.35),
    "passenger_distribution_l1": (0.15, 0.25),
}
EVENT_SCHEMA = "dataset string, run_id string, run_ts timestamp, window_year int, window_month int, event_type string, metric_name string, severity string, baseline_value string, observed_value string, delta_ratio double, warn_threshold double, error_threshold double, details_json string"
BASELINE_SCHEMA = "dataset string, run_id string, run_ts timestamp, metric_name string, metric_value double, distribution_json string"


def merged_thresholds(own: dict[str, dict[str, float]] | None) -> dict[str, tuple[float, float]]:
    """The defaults with a dataset's own ones; unknown metrics are ignored."""
    return {k: (float((own or {}).get(k, {}).get("warn", w)), float((own or {}).get(k, {}).get("error", e))) for k, (w, e) in THRESHOLDS.items()}


def weighted_average(numerator: str, denominator: str) -> Column:
    den = F.sum(F.col(denominator).cast("double"))
    return F.when(den > 0, F.sum(F.col(numerator).cast("double")) / den)


def profile(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric_name, metric_value): all scalar metrics in one aggregate."""
    one = df.agg(*[c.cast("double").alias(m) for m, c in metrics.items()])
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return one.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric_name, metric_value)")


def shares(df: DataFrame, column: str) -> DataFrame:
    """(category, share), nulls as a category of their own; the total comes from the counts."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("__null__")).alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("category", (F.col("n") / F.col("total")).alias("share"))  # total is one row


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """(l1): summed differences of shares over the categories of either, missing ones as 0."""
    both = a.withColumnRenamed("share", "x").join(b.withColumnRenamed("share", "y"), "category", "full_outer")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("l1"))


def delta(current: Column, baseline: Column) -> Column:
    """The change relative to the baseline; from 0 to anything else is 1; unknown values give none."""
    change = F.abs(current - baseline) / F.nullif(F.abs(baseline), F.lit(0.0))
    return F.when(baseline == 0, F.when(current == 0, 0.0).when(current.isNotNull(), 1.0)).otherwise(change)


def severity(change: Column, warn: Column, error: Column) -> Column:
    return F.when(change >= error, "error").when(change >= warn, "warn")


def compared(current: DataFrame, baseline: DataFrame, thresholds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(metric_name, baseline_value, observed_value, delta_ratio, severity) of two profiles; severity null: no drift."""
    limits = THRESHOLDS if thresholds is None else thresholds
    warn, error = (F.element_at(F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, v[i])]), F.col("metric_name")) for i in (0, 1))
    both = current.withColumnRenamed("metric_value", "observed_value").join(baseline.withColumnRenamed("metric_value", "baseline_value"), "metric_name")
    changed = both.withColumn("delta_ratio", delta(F.col("observed_value"), F.col("baseline_value")))
    return changed.select("metric_name", "baseline_value", "observed_value", "delta_ratio", severity(F.col("delta_ratio"), warn, error).alias("severity"))


def listing(events: DataFrame) -> DataFrame:
    """Events of all runs for reading: latest run first, then by severity (warn before error), dataset and metric."""
    return events.orderBy(F.desc("run_ts"), F.desc("severity"), "dataset", "metric_name")


def detect(store: Any, df: DataFrame, *, dataset: str, run_id: str, run_ts: Any, metrics: dict[str, Column], distribution: str | None = None, thresholds: dict[str, dict[str, float]] | None = None, window: tuple[int | None, int | None] = (None, None), events_table: str = "quality.drift_events", baseline_table: str = "quality.drift_baseline_metrics") -> dict[str, Any]:
    """Compares with the dataset's latest stored profile, writes events, and always stores the new profile."""
    spark = df.sparkSession
    if unknown := sorted(set(metrics) - set(THRESHOLDS)):
        raise ValueError(f"Unsupported drift metrics configured for '{dataset}': {unknown}")
    limits = merged_thresholds(thresholds)
    now: dict[str, Any] = {r["metric_name"]: r["metric_value"] for r in profile(df, metrics).collect()}
    # categories of a distribution are few by nature (counts of passengers and the like)
    parts = {r["category"]: r["share"] for r in shares(df, distribution).collect()} if distribution else None
    old: dict[str, Any] = {}
    if store.exists(baseline_table):
        past = store.read(spark, baseline_table).filter(F.col("dataset") == dataset)
        last = past.orderBy(F.desc("run_ts"), F.desc("run_id")).select("run_id", "run_ts").first()
        if last:
            old = {r["metric_name"]: r for r in past.filter((F.col("run_id") == last["run_id"]) & (F.col("run_ts") == last["run_ts"])).collect()}
    events = []

    def event(kind: str, metric: str, level: str, before: Any, after: Any, change: float | None, details: dict) -> None:
        warn, error = limits.get(metric, (0.0, 0.0))
        events.append((dataset, run_id, run_ts, *window, kind, metric, level, None if before is None else str(before), None if after is None else str(after), change, warn, error, json.dumps(details, sort_keys=True)))

    if not old:
        event("baseline_initialized", "baseline_initialized", "info", None, None, None, {"note": "first profile; drift is judged from the next run on"})
    else:
        base_run = next(iter(old.values()))["run_id"]
        # a handful of rows each: the metrics of this run, of the run before, and the limits
        past_values = spark.createDataFrame([(m, r["metric_value"]) for m, r in old.items()], "metric_name string, metric_value double")
        own_values = spark.createDataFrame(list(now.items()), "metric_name string, metric_value double")
        found_drift = {r["metric_name"]: r for r in compared(own_values, past_values, limits).filter("severity IS NOT NULL").collect()}
        for m in now:
            if r := found_drift.get(m):
                event("drift_detected", m, r["severity"], r["baseline_value"], r["observed_value"], r["delta_ratio"], {"baseline_run_id": base_run})
        m = "passenger_distribution_l1"
        if parts is not None and m in old:
            past_parts = json.loads(old[m]["distribution_json"] or "{}")
            a, b = (spark.createDataFrame(list(x.items()), "category string, share double") for x in (parts, past_parts))
            distance = l1_distance(a, b)
            change, level = distance.select("l1", severity(F.col("l1"), *map(F.lit, limits[m])).alias("severity")).first()
            if level:
                event("drift_detected", m, level, json.dumps(past_parts, sort_keys=True), json.dumps(parts, sort_keys=True), change, {"baseline_run_id": base_run})
    if events:
        store.append(events_table, spark.createDataFrame(events, EVENT_SCHEMA))
    rows = [(dataset, run_id, run_ts, m, v, None) for m, v in now.items()]
    if parts is not None:
        rows.append((dataset, run_id, run_ts, "passenger_distribution_l1", None, json.dumps(parts, sort_keys=True)))
    store.append(baseline_table, spark.createDataFrame(rows, BASELINE_SCHEMA))
    found = [e for e in events if e[5] == "drift_detected"]
    return {"dataset": dataset, "drift_detected_count": len(found), "metrics": [e[6] for e in found], "baseline_initialized_count": len(events) - len(found), "profile": now | ({"distribution": parts} if parts is not None else {})}


def grain_metrics(grain: str, columns: Sequence[str] = ()) -> dict[str, Column]:
    """The metrics of a table by its grain: single trips, or days with weighted averages."""
    if grain == "trip":
        return {"volume_ratio": F.count("*"), "avg_fare_amount_ratio": F.avg(F.col("fare_amount").cast("double")), "avg_trip_distance_ratio": F.avg("trip_distance")}
    return {"volume_ratio": F.count("*"), "avg_fare_per_trip_ratio": weighted_average("total_fare", "trips")}
