from __future__ import annotations

import random
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import month_bounds, stable_number
from tidemark.operators import diagnostics, drift, rules, transforms, upsert
from tidemark.sources.contracts import Contract, Field, Rule
from tidemark.sources.store import TableStore, is_schema_conflict, quoted

T = datetime(2024, 1, 31, tzinfo=timezone.utc)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(str(tmp_path / "w"), spark)


def trips(spark, *rows):
    return spark.createDataFrame(rows, "trip_id string, vendor_id string, pickup_ts timestamp, updated_at timestamp")


def at(text):
    return datetime.fromisoformat(text)


def test_normalise(spark):
    df = spark.sql("SELECT CAST(1 AS INT) VendorID, CAST(2 AS INT) PULocationID, CAST(3 AS INT) payment_type, TIMESTAMP_NTZ '2024-01-01 10:00:00' tpep_pickup_datetime, 1.5D trip_distance")
    out, report = transforms.normalise(df)
    kinds = dict(out.dtypes)
    assert kinds == {"VendorID": "int", "PULocationID": "int", "payment_type": "bigint", "tpep_pickup_datetime": "timestamp", "trip_distance": "double"}
    assert report == {"timestamps": ["tpep_pickup_datetime"], "casts": ["payment_type:bigint"]}


def test_null_text_of_numbers(spark):
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) x").select(stable_number("x", 2)).first()[0] == "__null__"


def test_latest_breaks_ties_by_row_hash(spark):
    df = trips(spark, ("a", "1", at("2024-01-01"), at("2024-01-02")), ("a", "2", at("2024-01-01"), at("2024-01-02")), ("a", "3", None, None), (None, "4", None, None), (None, "5", None, None))
    out = transforms.latest(df, ["trip_id"], "updated_at").collect()
    again = transforms.latest(df.repartition(5), ["trip_id"], "updated_at").collect()
    assert len(out) == 2 and sorted(map(str, out)) == sorted(map(str, again))


def test_merge_twice_changes_nothing(spark, store):
    rows = trips(spark, ("trip_1", "1", at("2024-01-01T08:00"), at("2024-01-01T08:00")), ("trip_2", "2", at("2024-01-01T09:00"), at("2024-01-01T09:00")))
    for _ in range(2):
        done = upsert.incremental_merge(store, rows, "silver.t", ["trip_id"], "updated_at", 7)
        assert done["rows_deduped"] == 2
        assert store.read(spark, "silver.t").count() == 2
    assert store.vacuum("silver.t") == 1


def test_merge_within_lateness(spark, store):
    upsert.incremental_merge(store, trips(spark, ("trip_a", "1", None, at("2024-01-10T10:00")), ("trip_b", "1", None, at("2024-01-10T11:00"))), "silver.t", ["trip_id"], "updated_at", 2)
    source = trips(spark, ("trip_old", "1", None, at("2024-01-07T09:00")), ("trip_in_window", "1", None, at("2024-01-08T10:30")), ("trip_new", "1", None, at("2024-01-12T08:00")), ("no_time", "1", None, None), ("trip_a", "9", None, at("2024-01-11T08:00")))
    done = upsert.incremental_merge(store, source, "silver.t", ["trip_id"], "updated_at", 2)
    assert (done["max_watermark_target"], done["lower_bound"], done["rows_source_filtered"], done["rows_rejected_late"]) == ("2024-01-10 11:00:00", "2024-01-08", 3, 2)
    found = {r["trip_id"]: r["vendor_id"] for r in store.read(spark, "silver.t").collect()}
    assert found == {"trip_a": "9", "trip_b": "1", "trip_in_window": "1", "trip_new": "1"}
    with pytest.raises(ValueError, match="schemas"):
        upsert.incremental_merge(store, source.withColumn("more", F.lit(1)), "silver.t", ["trip_id"], "updated_at", 2)


def test_upsert_null_keys(spark):
    target, source = trips(spark, (None, "1", None, at("2024-01-01"))), trips(spark, (None, "2", None, at("2024-01-02")))
    assert [r["vendor_id"] for r in upsert.upsert_result(target, source, ["trip_id"], "updated_at", 7).collect()] == ["2"]


CONTRACT = Contract("d", "o", 1, (Field("k", "string"), Field("x", "double")), ("k",), None, None, (Rule("need", "A", "error", "not_null", ("k",)), Rule("size", "B", "error", "range", ("x",), 0, 10), Rule("high", "C", "warn", "range", ("x",), None, 5)))


def test_enforcement(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 10.0), ("c", None), (None, 11.0), ("d", 11.0)], "k string, x double")
    done = rules.enforce(df, CONTRACT, max_invalid_ratio=0.6)
    labels = sorted((r["k"] or "", r["rule_id"], r["reason_code"]) for r in done.quarantine.collect())
    assert labels == [("", "A", "not_null_violation"), ("c", "B", "range_violation"), ("d", "B", "range_violation")]
    assert sorted(r["k"] for r in done.valid.collect()) == ["a", "b"]
    assert (done.summary["invalid_count"], done.summary["warn_count"], done.summary["info_count"]) == (3, 4, 0)
    rules.enforce(df, CONTRACT, max_invalid_ratio=0.6)
    with pytest.raises(ValueError, match="Invalid ratio"):
        rules.enforce(df, CONTRACT, max_invalid_ratio=0.59)


def test_enforcement_errors(spark):
    with pytest.raises(ValueError, match="Missing"):
        rules.enforce(spark.createDataFrame([("a",)], "k string"), CONTRACT)
    with pytest.raises(ValueError, match="Type"):
        rules.enforce(spark.createDataFrame([("a", 1)], "k string, x int"), CONTRACT)
    with pytest.raises(ValueError, match="Primary key"):
        rules.enforce(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "k string, x double"), CONTRACT)
    assert rules.enforce(spark.createDataFrame([], "k string, x double"), CONTRACT).summary["invalid_ratio"] == 0.0


def test_quarantine_defaults(spark):
    out = rules.quarantine_records(spark.createDataFrame([("a",)], "trip_id string"), "d", 1, "run", F.lit(T)).first()
    assert (out["rule_id"], out["reason_code"], out["severity"], out["run_id"]) == ("contract_violation", "contract_violation", "error", "run")


def gate_tables(spark, dropoff="2024-01-01T10:15", trips_=10, fare="125.00"):
    silver = spark.createDataFrame([("t1", date(2024, 1, 1), at("2024-01-01T10:00"), at(dropoff), 12.5, 2.1)], "trip_id string, pickup_date date, pickup_ts timestamp, dropoff_ts timestamp, f double, trip_distance double").withColumn("fare_amount", F.col("f").cast("decimal(18,2)"))
    gold = spark.createDataFrame([(date(2024, 1, 1), "1", trips_, fare)], "trip_date date, vendor_id string, trips long, t string").withColumn("total_fare", F.col("t").cast("decimal(18,2)"))
    return silver, gold


@pytest.mark.parametrize(("severity", "raises"), [("warn", False), ("error", True)])
def test_gate_severity(spark, severity, raises):
    silver, gold = gate_tables(spark, dropoff="2024-01-01T09:59")
    contract = Contract("d", "o", 2, (), rules=(Rule("non_positive_trip_duration", "QG002", severity, "quality_gate"),))
    written = []
    call = lambda: rules.quality_gate(silver, gold, dataset="d", run_id="r", run_ts=T, contract=contract, write=written.append)
    if raises:
        with pytest.raises(ValueError, match="non_positive_trip_duration"):
            call()
    else:
        call()
    assert written[0].columns == list(rules.SUMMARY_COLUMNS) and written[0].count() == 6
    assert written[0].filter("rule_id = 'QG002'").first()["sample_values"] == '["t1"]'


def test_gate_average_fare(spark):
    silver, gold = gate_tables(spark, trips_=1, fare="1000000.00")
    with pytest.raises(ValueError, match="out_of_range"):
        rules.quality_gate(silver, gold, dataset="d", run_id="r", run_ts=T)
    with pytest.raises(ValueError, match="least"):
        rules.gate_counts(silver, gold, 2.0, 1.0)


def test_gate_of_empty_gold(spark):
    silver, gold = gate_tables(spark)
    found = {r["rule_id"]: r["failed_count"] for r in rules.gate_counts(silver, gold.limit(0)).collect()}
    assert found == {"QG001": 0, "QG002": 0, "QG003": 0, "QG004": 0, "QG005": 1, "QG006": 1}


def test_strict_defaults():
    assert rules.threshold_of("r", {"r_ratio": 0.5, "max_invalid_ratio": 0.1}, 100, True) == 0
    assert rules.threshold_of("r", {"r": 3}, 100, True) == 3


def test_dimension_without_fan_out(spark):
    rows, dim = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, name string")
    found = transforms.joined_once(rows, dim, "k").collect()
    assert sorted((str(r["k"]), r["name"]) for r in found) == [("1", "a"), ("2", None), ("None", None)]
    with pytest.raises(ValueError, match="equal k"):
        transforms.joined_once(rows, dim.unionByName(dim.limit(1)).na.fill(1, ["k"]), "k")


def test_null_profile_order(spark):
    df = spark.createDataFrame([(1, None, None), (2, "x", None)], "b int, a string, c string")
    assert [r["column_name"] for r in transforms.null_profile(df).collect()] == ["c", "a", "b"]


def test_thresholds():
    assert rules.threshold_of("r", {"r": 3, "r_ratio": 0.5}, 100) == 3
    assert rules.threshold_of("r", {"r_ratio": 0.5, "max_invalid_ratio": 0.1}, 100) == 50
    assert rules.threshold_of("r", {"max_invalid_ratio": 0.1}, 100) == 10
    assert rules.threshold_of("r", {}, 100) == 0


def test_drift_of_daily_table(spark, store):
    def gold(*rows):
        return spark.createDataFrame([(date(2024, 1, 1), "1", *r) for r in rows], "trip_date date, vendor_id string, trips long, total_fare double")

    limits = dict.fromkeys(("volume_ratio", "avg_fare_per_trip_ratio"), {"warn": 0.01, "error": 0.02})
    run = lambda df, k: drift.detect(store, df, dataset="gold.d", run_id=k, run_ts=T, metrics=drift.grain_metrics("day"), thresholds=limits)
    first = run(gold((100, 2000.0), (80, 1680.0)), "r1")
    assert (first["drift_detected_count"], first["baseline_initialized_count"]) == (0, 1)
    assert first["profile"]["avg_fare_per_trip_ratio"] == pytest.approx(20.444444, abs=1e-6)
    second = run(gold((120, 2520.0), (90, 1980.0), (60, 1200.0)), "r2")
    assert second["metrics"] == ["volume_ratio", "avg_fare_per_trip_ratio"]
    assert second["profile"]["avg_fare_per_trip_ratio"] == pytest.approx(21.111111, abs=1e-6)
    assert store.read(spark, "quality.drift_events").count() == 3


def test_drift_of_categories(spark, store):
    def df(*n):
        return spark.createDataFrame([(10.0, 2.5, k) for k in n], "fare_amount double, trip_distance double, passenger_count long")

    run = lambda x, k: drift.detect(store, x, dataset="s", run_id=k, run_ts=T, metrics=drift.grain_metrics("trip"), distribution="passenger_count")
    run(df(1, 2), "a")
    assert run(df(1, 1), "b")["metrics"] == ["passenger_distribution_l1"]
    assert drift.l1_distance(drift.shares(df(1, None), "passenger_count"), drift.shares(df(1, 2), "passenger_count")).first()[0] == pytest.approx(1.0)


def test_delta(spark):
    df = spark.sql("SELECT * FROM VALUES (1D, 0D), (0D, 0D), (2D, 1D), (NULL, 1D), (1D, NULL) t(c, b)")
    assert [r[0] for r in df.select(drift.delta(F.col("c"), F.col("b"))).collect()] == [1.0, 0.0, 1.0, None, None]


def test_store(spark, store):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    store.write("a.b", df, "append")
    store.write("a.b", df, "append")
    assert store.read(spark, "a.b").count() == 2
    store.overwrite("a.b", store.read(spark, "a.b").limit(1))
    assert store.read(spark, "a.b").count() == 1 and store.tables() == ["a.b"]
    with pytest.raises(ValueError, match="schema"):
        store.append("a.b", df.withColumn("z", F.lit(1)))
    with pytest.raises(ValueError, match="mode"):
        store.write("a.b", df, "merge")
    store.drop("a.b")
    assert not store.exists("a.b")
    assert quoted("a.b`c") == "`a`.`b``c`"


def test_reconcile(spark):
    a, b = spark.range(10), spark.range(9)
    assert rules.reconcile(a, b, 0.1)["passed"]
    with pytest.raises(ValueError):
        rules.reconcile(a, b, 0.09)
    assert rules.reconcile(a.limit(0), a.limit(0))["passed"]


def test_month_bounds():
    assert month_bounds(2024, 12) == (date(2024, 12, 1), date(2025, 1, 1))
    assert month_bounds(None, None) is None
    with pytest.raises(ValueError):
        month_bounds(2024, None)


def test_column_drift(spark):
    assert transforms.column_drift(spark.range(1), ["id2"]) == {"missing": ["id2"], "extra": ["id"]}


def test_unknown_vendor_and_names(spark):
    df = spark.createDataFrame([("1", 2.0), (None, 3.0), ("9", 1.0)], "vendor_id string, fare_amount double").withColumn("pickup_date", F.lit(date(2024, 1, 1)))
    assert {r["vendor_id"] for r in transforms.daily_kpi(df).collect()} == {"1", "9", "UNKNOWN"}
    assert {r["vendor_id"]: r["vendor_name"] for r in transforms.vendor_dim(df).collect()} == {"1": "Creative Mobile Technologies", "9": "Unknown/Other"}


def test_upsert_by_partition(spark, store):
    def rows(*r):
        return spark.createDataFrame([(k, v, None if d is None else date(2024, 5, d), datetime(2024, 5, t)) for k, v, d, t in r], "k string, v int, day date, at timestamp")

    def files():
        return {"/".join(f.split("/")[-3:]) for f in store.read(spark, "s.t").inputFiles()}

    merge = lambda df: upsert.incremental_merge(store, df, "s.t", ["k"], "at", 30, partition_by="day")
    merge(rows(("a", 1, 1, 1), ("b", 1, 2, 2), ("c", 1, 3, 3), ("n", 1, None, 3)))
    before = {r["day"]: r["f"] for r in store.read(spark, "s.t").select("day", F.concat_ws("/", F.slice(F.split(F.input_file_name(), "/"), -3, 3)).alias("f")).collect()}
    # b moves to another day, d is new; the days of a and of c and the null day stay as they are
    done = merge(rows(("b", 2, 4, 4), ("d", 2, 4, 4)))
    found = {r["k"]: (r["v"], r["day"]) for r in store.read(spark, "s.t").collect()}
    assert found == {"a": (1, date(2024, 5, 1)), "b": (2, date(2024, 5, 4)), "c": (1, date(2024, 5, 3)), "d": (2, date(2024, 5, 4)), "n": (1, None)}
    assert done["partitions_written"] == 2 and files() > {before[date(2024, 5, 1)], before[date(2024, 5, 3)], before[None]}
    assert before[date(2024, 5, 2)] not in files()
    merge(rows(("n", 3, None, 5)))
    store.append("s.t", rows(("e", 5, 1, 5)))
    want = [("a", 1), ("b", 2), ("c", 1), ("d", 2), ("e", 5), ("n", 3)]
    assert sorted((r["k"], r["v"]) for r in store.read(spark, "s.t").collect()) == want
    assert store.vacuum("s.t") > 0 and store.vacuum("s.t") == 0
    assert sorted((r["k"], r["v"]) for r in store.read(spark, "s.t").collect()) == want
    assert store.read(spark, "s.t", [date(2024, 5, 4)]).count() == 2 and store.read(spark, "s.t", [date(2030, 1, 1)]).isEmpty()
    assert store.read(spark, "s.t").schema == rows().schema
    with pytest.raises(ValueError, match="other values"):
        store.replace("s.t", rows(("z", 1, 9, 9)), [date(2024, 5, 1)])
    with pytest.raises(ValueError, match="whole number"):
        store.overwrite("s.u", rows(("z", 1, 9, 9)), "k")
    assert upsert.incremental_merge(store, rows(), "s.t", ["k"], "at", 30)["rows_deduped"] == 0


def test_safe_write(spark, store):
    one, other = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("a",)], "x string")
    store.safe_write("a.b", one, "append")
    store.safe_write("a.b", one)
    for refused in ("overwrite", "append"):
        with pytest.raises(ValueError, match="schema"):
            store.safe_write("a.b", other, refused)
    store.safe_write("a.b", other, overwrite_schema=True)
    store.safe_write("a.b", one, "append", recreate_on_schema_mismatch=True)
    store.safe_write("a.b", one, "append", recreate_on_schema_mismatch=True)
    assert store.read(spark, "a.b").count() == 2
    store.safe_write("a.b", other, "append", recreate_on_schema_conflict=True)
    assert [tuple(r) for r in store.read(spark, "a.b").collect()] == [("a",)]
    store.safe_write("a.b", other, "append", force_recreate=True)
    assert store.read(spark, "a.b").count() == 1
    with pytest.raises(ValueError, match="mode"):
        store.safe_write("a.b", one, "merge")
    assert not is_schema_conflict(ValueError("other")) and is_schema_conflict(ValueError("schema of a.b differs"))
    store.view("s.v", one.filter("x > 0"))
    assert spark.table("s__v").count() == 1


def test_nan_in_ranges(spark):
    df = spark.createDataFrame([("a", float("nan")), ("b", 3.0)], "k string, x double")
    open_range = Contract("d", "o", 1, (Field("k", "string"), Field("x", "double")), (), None, None, (Rule("size", "B", "error", "range", ("x",), 0, None),))
    assert rules.enforce(df, open_range).summary["invalid_count"] == 0
    assert rules.enforce(df, open_range, 0.5, reject_nan=True).summary["invalid_count"] == 1


def test_staged_rows_are_worked_out_once(spark, store):
    calls = []

    def stage(tags):
        calls.append(tags)
        store.overwrite("w.x", tags)
        return store.read(spark, "w.x")

    done = rules.enforce(spark.createDataFrame([("a", 1.0), (None, 2.0)], "k string, x double"), CONTRACT, 0.5, stage=stage)
    assert len(calls) == 1 and done.valid.inputFiles() and [r["rule_id"] for r in done.quarantine.collect()] == ["A"]


def test_column_test_severity(spark):
    tests = rules.column_tests(spark.createDataFrame([(1, "x"), (1, None)], "k int, s string"), ["s"], ["k"])
    found = rules.judged(tests, [("not_null", "s"), ("unique", "k")])
    assert sorted(rules.require_passed(found)) == ["not_null(s): 1", "unique(k): 1"]
    with pytest.raises(ValueError, match="unique"):
        rules.require_passed(rules.judged(tests, [("not_null", "s")]))


def test_quality_summary(spark):
    raw = spark.createDataFrame([(1, -2.0), (2, 5.0), (3, None)], "k int, fare double")
    gold = spark.createDataFrame([(1, 2)], "day int, trips long")
    rows = diagnostics.summary(raw, raw.filter("k < 3"), gold, {"negative": "fare < 0", "missing": "fare IS NULL"}, ["k", "fare", "tip"])
    found = {(r["category"], r["metric_name"]): (r["metric_value"], r["metric_rate"]) for r in rows.collect()}
    assert found["reconciliation", "drop_rows"] == (1.0, None) and found["reconciliation", "drop_rate"] == (pytest.approx(1 / 3, abs=1e-6), None)
    assert found["validity", "negative"] == (1.0, 0.5) and found["drift", "missing_columns"] == (1.0, None)
    assert found["reconciliation", "gold_trips"] == (2.0, None) and len(found) == 10
    empty = diagnostics.summary(raw.limit(0), raw.limit(0), gold.limit(0), {"negative": "fare < 0"}, ["k", "fare"])
    assert {r["metric_value"] for r in empty.collect()} == {0.0}


@pytest.mark.parametrize("decimals", [2, 6])
def test_stable_numbers(spark, decimals):
    """Against the formatter, over ties, signs, zeros, extremes and values that are none."""
    rng = random.Random(7)
    values = [0.0, -0.0, 0.005, -0.004, 1.005, 2.675, -2.675, 0.125, 1e-9, -1e-9, 1e12, 1e15, 1e300, -1e22, 999999999999.995, float("nan"), float("inf"), float("-inf"), None, 0.0000005, 0.0000015]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 14) for _ in range(20_000)] + [rng.randint(-(10**9), 10**9) / 2000 for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    plain = F.when(F.col("x").isNull(), "__null__").otherwise(F.format_string(f"%.{decimals}f", "x"))
    assert df.select("x", stable_number("x", decimals).alias("a"), plain.alias("b")).filter("a IS DISTINCT FROM b").collect() == []
