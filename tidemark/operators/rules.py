"""Contract enforcement, quarantine, reconciliation and the quality gate, each with its counts from one pass."""

from __future__ import annotations

import json
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tidemark.functions.columns import count_where
from tidemark.operators.transforms import duplicate_rows
from tidemark.sources.contracts import Contract, Rule

LABELS = ("rule_id", "rule_name", "reason_code", "severity")


def fails(rule: Rule, nan: Collection[str] = ()) -> Column | None:
    """True where a row breaks the rule; None for rules that aren't about single rows. A NaN is above every number, so it
    passes a range without a greatest value, unless its column is among `nan`."""
    if rule.type == "not_null" and rule.columns:
        found = F.lit(False)
        for c in rule.columns:
            found |= F.col(c).isNull()
        return found
    if rule.type == "range":
        c = F.col(rule.columns[0])
        found = c.isNull()
        if rule.min is not None:
            found |= c < F.lit(rule.min)
        if rule.max is not None:
            found |= c > F.lit(rule.max)
        if rule.columns[0] in nan:
            found |= F.isnan(c)
        return found
    return None


def check_schema(df: DataFrame, contract: Contract) -> None:
    have = {f.name: f.dataType.simpleString().lower() for f in df.schema.fields}
    if missing := sorted(f.name for f in contract.schema if f.name not in have):
        raise ValueError(f"Missing required columns: {missing}")
    if wrong := [f"{f.name}: expected={f.type.lower()} actual={have[f.name]}" for f in contract.schema if have[f.name] != f.type.strip().lower()]:
        raise ValueError(f"Type mismatches found: {wrong}")


def tagged(df: DataFrame, contract: Contract, reject_nan: bool = False) -> DataFrame:
    """Adds struct `__failed` (the first error rule that a row breaks, in the contract's order; else null) and
    whether it breaks any warn or info rule."""
    nan = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))} if reject_nan else ()
    by = {s: [(r, x) for r in contract.rules if r.severity == s and (x := fails(r, nan)) is not None] for s in ("error", "warn", "info")}
    label = F.lit(None).cast("struct<rule_id:string,rule_name:string,reason_code:string,severity:string>")
    for r, x in reversed(by["error"]):
        own = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(f"{r.type}_violation").alias("reason_code"), F.lit(r.severity).alias("severity"))
        label = F.when(x, own).otherwise(label)
    flags = {}
    for s in ("warn", "info"):
        found = F.lit(False)
        for _, x in by[s]:
            found |= x
        flags[f"__{s}"] = found
    return df.withColumns({"__failed": label} | flags)


def valid_rows(tags: DataFrame) -> DataFrame:
    return tags.filter("__failed IS NULL").drop("__failed", "__warn", "__info")


def quarantined_rows(tags: DataFrame) -> DataFrame:
    return tags.filter("__failed IS NOT NULL").select("*", *[F.col(f"__failed.{c}").alias(c) for c in LABELS]).drop("__failed", "__warn", "__info")


def enforcement_counts(tags: DataFrame) -> DataFrame:
    return tags.agg(F.count("*").alias("total_count"), F.count_if(F.col("__failed").isNotNull()).alias("invalid_count"), count_where(F.col("__warn")).alias("warn_count"), count_where(F.col("__info")).alias("info_count"))


def key_uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(valid_count, keys, repeated_keys, duplicate_rows) of a key, nulls equal to nulls."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return counts.agg(F.coalesce(F.sum("n"), zero).alias("valid_count"), F.count("*").alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_rows"))


@dataclass(frozen=True)
class Enforced:
    valid: DataFrame
    quarantine: DataFrame
    summary: dict[str, Any]


def enforce(df: DataFrame, contract: Contract, max_invalid_ratio: float = 0.001, reject_nan: bool = False, stage: Callable[[DataFrame], DataFrame] = lambda tags: tags) -> Enforced:
    """Schema, rows, key, ratio, in this order; a ValueError for any but single bad rows. `stage` may write the rows
    with their tags and read them again: all that follows comes from what it returns."""
    check_schema(df, contract)
    tags = stage(tagged(df, contract, reject_nan))
    valid = valid_rows(tags)
    if contract.primary_key and key_uniqueness(valid, contract.primary_key).first()["repeated_keys"]:
        raise ValueError(f"Primary key uniqueness violated for PK={list(contract.primary_key)}")
    counts = enforcement_counts(tags).first().asDict()
    ratio = counts["invalid_count"] / counts["total_count"] if counts["total_count"] else 0.0
    if ratio > max_invalid_ratio:
        raise ValueError(f"Invalid ratio exceeded: invalid_ratio={ratio:.6f} threshold={max_invalid_ratio:.6f}")
    summary = {"dataset": contract.dataset, "contract_version": contract.version, **counts, "invalid_ratio": ratio, "pk_checked": bool(contract.primary_key), "pk_violations": 0}
    return Enforced(valid, quarantined_rows(tags), summary)


def quarantine_records(df: DataFrame, dataset: str, contract_version: Any, run_id: str, run_ts: Column) -> DataFrame:
    """Labels filled where missing, then what the run adds."""
    default = {"rule_id": "contract_violation", "rule_name": "contract_violation", "reason_code": "contract_violation", "severity": "error"}
    filled = {k: F.coalesce(F.col(k).cast("string"), F.lit(v)) if k in df.columns else F.lit(v) for k, v in default.items()}
    return df.withColumns(filled | {"dataset": F.lit(dataset), "contract_version": F.lit(contract_version), "run_id": F.lit(run_id), "run_ts": run_ts.cast("timestamp")})


def reconciliation(source: DataFrame, target: DataFrame, max_diff_ratio: float) -> DataFrame:
    """One row: both counts, their relative difference, and whether it is allowed."""
    counts = source.agg(F.count("*").alias("source_rows")).crossJoin(target.agg(F.count("*").alias("target_rows")))  # one row each
    ratio = F.abs(F.col("source_rows") - F.col("target_rows")) / F.greatest("source_rows", F.lit(1))
    return counts.select("*", ratio.alias("diff_ratio"), (ratio <= max_diff_ratio).alias("passed"))


def reconcile(source: DataFrame, target: DataFrame, max_diff_ratio: float = 0.0, strict: bool = True) -> dict[str, Any]:
    report = reconciliation(source, target, max_diff_ratio).first().asDict()
    if strict and not report["passed"]:
        raise ValueError(f"Reconciliation failed: {report}")
    return report


#: The gate's rules with their ids, in order.
GATE_RULES = {
    "invalid_pickup_date_window": "QG001",
    "non_positive_trip_duration": "QG002",
    "negative_fare_or_distance": "QG003",
    "pk_duplicates_detected": "QG004",
    "gold_non_positive_volume": "QG005",
    "gold_avg_fare_per_trip_out_of_range": "QG006",
}
SUMMARY_COLUMNS = ("dataset", "run_id", "run_ts", "window_year", "window_month", "contract_version", "rule_id", "rule_name", "severity", "passed", "failed_count", "sample_values", "threshold", "details_json")
SUMMARY_SCHEMA = "dataset string, run_id string, run_ts timestamp, window_year int, window_month int, contract_version int, rule_id string, rule_name string, severity string, passed boolean, failed_count long, sample_values string, threshold long, details_json string"


def gate_counts(silver: DataFrame, gold: DataFrame, low: float = 0.5, high: float = 500.0) -> DataFrame:
    """(rule_id, rule_name, failed_count) of the six rules, from one pass over each table: gold at once, silver when read."""
    if low > high:
        raise ValueError("the least average fare is above the greatest")
    pair = gold.groupBy("trip_date", "vendor_id").agg(F.count("*").alias("n"), F.sum("total_fare").alias("fare"), F.sum("trips").alias("trips"))
    # one row for the driver, so that neither table is worked out twice
    g = pair.agg(F.min("trip_date").alias("first"), F.max("trip_date").alias("last"), F.sum("n").alias("rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"), F.try_divide(F.sum("fare").cast("double"), F.sum("trips")).alias("average")).first()
    day = F.col("pickup_date")
    out_of_window = F.lit(False) if g["first"] is None else day.isNull() | (day < F.lit(g["first"])) | (day > F.lit(g["last"]))
    flags = {
        "r1": out_of_window,
        "r2": F.col("pickup_ts").isNull() | F.col("dropoff_ts").isNull() | F.coalesce(F.col("dropoff_ts") <= F.col("pickup_ts"), F.lit(False)),
        "r3": (F.col("fare_amount") < 0) | (F.col("trip_distance") < 0),
    }
    # the key's rows and their flags are added up before the shuffle
    keys = silver.groupBy("trip_id").agg(F.count("*").alias("n"), *[count_where(c).alias(k) for k, c in flags.items()])
    one = keys.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeats"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags])
    counts = [F.col("r1"), F.col("r2"), F.col("r3"), F.col("repeats") + F.lit(g["repeats"]), F.lit(0 if g["rows"] else 1), F.lit(0 if g["average"] is not None and low <= g["average"] <= high else 1)]
    rows = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(n).alias("rule_name"), c.cast("long").alias("failed_count")) for (n, i), c in zip(GATE_RULES.items(), counts, strict=True)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def threshold_of(rule: str, thresholds: dict[str, float], total_rows: int, strict_defaults: bool = False) -> int:
    """The caller's threshold for the rule, else its ratio of the rows, else the general ratio, else none allowed.
    With strict defaults no ratio counts: a rule without its own threshold allows none."""
    if rule in thresholds:
        return int(thresholds[rule])
    if strict_defaults:
        return 0
    for k in (f"{rule}_ratio", "max_invalid_ratio"):
        if k in thresholds:
            return int(thresholds[k] * total_rows)
    return 0


def samples(df: DataFrame, value: Column, n: int = 5) -> str | None:
    """Up to n values in order, as JSON; null if there are none."""
    found = [r[0] for r in df.select(value.cast("string").alias("v")).filter("v IS NOT NULL").orderBy("v").limit(n).collect()]
    return json.dumps(found) if found else None


def quality_gate(silver: DataFrame, gold: DataFrame, *, dataset: str, run_id: str, run_ts: Any, contract: Contract | None = None, thresholds: dict[str, float] | None = None, window: tuple[int | None, int | None] = (None, None), strict: bool = True, write: Any = None, strict_defaults: bool = False) -> DataFrame:
    """The summary in its fixed columns, given to `write` before a failed error rule raises."""
    thresholds = dict(thresholds or {})
    low, high = thresholds.pop("gold_min_avg_fare_per_trip", 0.5), thresholds.pop("gold_max_avg_fare_per_trip", 500.0)
    own = {r.name: r for r in contract.rules} if contract else {}
    counts = {r["rule_name"]: r["failed_count"] for r in gate_counts(silver, gold, low, high).collect()}
    total = silver.count() if any(k.endswith("_ratio") for k in thresholds) else 0
    bad = {
        "non_positive_trip_duration": (silver.filter("pickup_ts IS NULL OR dropoff_ts IS NULL OR dropoff_ts <= pickup_ts"), F.col("trip_id")),
        "negative_fare_or_distance": (silver.filter("fare_amount < 0 OR trip_distance < 0"), F.concat_ws("|", "trip_id", F.col("fare_amount").cast("string"), F.col("trip_distance").cast("string"))),
        "pk_duplicates_detected": (silver.groupBy("trip_id").count().filter("count > 1"), F.col("trip_id")),
    }
    rows, failed = [], []
    for name, rule_id in GATE_RULES.items():
        severity = own[name].severity if name in own else "error"
        limit = threshold_of(name, thresholds, total, strict_defaults)
        passed = counts[name] <= limit
        shown = samples(*bad[name]) if name in bad and counts[name] else None
        rows.append((dataset, run_id, run_ts, *window, int(contract.version) if contract else None, own[name].rule_id if name in own else rule_id, name, severity, passed, counts[name], shown, limit, json.dumps({"low": low, "high": high} if name == "gold_avg_fare_per_trip_out_of_range" else {}, sort_keys=True)))
        if not passed and severity == "error":
            failed.append(f"{name}(failed_count={counts[name]}, threshold={limit})")
    summary = silver.sparkSession.createDataFrame(rows, SUMMARY_SCHEMA)
    if write:
        write(summary)
    if strict and failed:
        raise ValueError(f"Quality gate failed: {failed}")
    return summary


def day_coverage(df: DataFrame, day: str, days_in_month: int, least: int = 28) -> DataFrame:
    n = F.count_distinct(day)
    return df.agg(n.alias("days"), n.between(least, days_in_month).alias("passed"))


def judged(tests: DataFrame, warn: Collection[tuple[str, str]] = ()) -> DataFrame:
    """Column tests with a severity ('warn' for the given pairs of test and column, else 'error') and whether they passed."""
    level = F.lit("error")
    for t, c in warn:
        level = F.when((F.col("test") == t) & (F.col("column_name") == c), "warn").otherwise(level)
    return tests.withColumns({"severity": level, "passed": F.col("failures") == 0})


def require_passed(tests: DataFrame) -> list[str]:
    """A ValueError where a test of severity error failed; else the failed ones of severity warn."""
    failed = [r.asDict() for r in tests.filter("NOT passed").collect()]
    named = {s: [f"{r['test']}({r['column_name']}): {r['failures']}" for r in failed if r["severity"] == s] for s in ("error", "warn")}
    if named["error"]:
        raise ValueError(f"Column tests failed: {named['error']}")
    return named["warn"]


def severity_outcomes(summary: DataFrame) -> DataFrame:
    """(severity, rules_checked, rules_failed) of a gate summary, in order of severity."""
    return summary.groupBy("severity").agg(F.count("*").alias("rules_checked"), F.count_if(~F.col("passed")).alias("rules_failed")).orderBy("severity")


def column_tests(df: DataFrame, not_null: Sequence[str] = (), unique: Sequence[str] = (), accepted: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """(test, column_name, failures): all in one aggregate, but uniqueness, which needs one for each column."""
    checks = [("not_null", c, F.count_if(F.col(c).isNull())) for c in not_null]
    checks += [("accepted_values", c, F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v))) for c, v in (accepted or {}).items()]
    one = df.agg(*[x.alias(f"c{k}") for k, (_, _, x) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(t).alias("test"), F.lit(c).alias("column_name"), F.col(f"c{k}").alias("failures")) for k, (t, c, _) in enumerate(checks)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    for c in unique:
        repeated = df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1")
        out = out.unionByName(repeated.agg(F.count("*").alias("failures")).select(F.lit("unique").alias("test"), F.lit(c).alias("column_name"), "failures"))
    return out
