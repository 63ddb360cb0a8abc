from __future__ import annotations

from datetime import datetime, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import cli
from tidemark.plans import backfill
from tidemark.plans.pipeline import CLEAN, DAILY, METRICS, METRICS_SCHEMA, RAW, SUMMARY, Pipeline
from tidemark.sources.session import raw_rows, resolve_input
from tidemark.sources.store import TableStore
from tidemark.streaming import sinks


def sample(spark, path):
    def at(d, h, m=0):
        return datetime(2024, 1, d, h, m)

    rows = [
        (6, at(3, 23, 50), at(4, 0, 21), 1, 3, 7, 263, 9.75, Decimal("38.40"), 4),
        (2, at(4, 6, 5), at(4, 6, 11), 1, 2, 48, 48, 0.6, Decimal("6.10"), 1),
        (6, at(9, 17), at(9, 18, 2), 3, 1, 132, 7, 17.3, Decimal("70.00"), 2),
    ]
    spark.createDataFrame(rows, "VendorID long, tpep_pickup_datetime timestamp, tpep_dropoff_datetime timestamp, RatecodeID long, payment_type long, PULocationID long, DOLocationID long, trip_distance double, fare_amount decimal(38,18), passenger_count long").coalesce(1).write.parquet(str(path))
    return str(path)


def test_all_stages(spark, tmp_path):
    store = TableStore(str(tmp_path / "w"), spark)
    path = sample(spark, tmp_path / "in.parquet")
    for run in ("r1", "r2"):
        done = Pipeline(spark, store, run, datetime(2024, 2, 1, tzinfo=timezone.utc)).all(path)
    counts = {t: store.read(spark, t).count() for t in (RAW, CLEAN, DAILY, METRICS, SUMMARY)}
    assert counts == {RAW: 3, CLEAN: 3, DAILY: 3, METRICS: 4, SUMMARY: 6}
    assert done["quality"][CLEAN]["drift_detected_count"] == 0
    assert store.read(spark, METRICS).columns == [c.split()[0] for c in METRICS_SCHEMA.split(", ")]
    assert "average fare" in Pipeline(spark, store, "r", year=2024, month=1).report()
    with pytest.raises(ValueError, match="days"):
        Pipeline(spark, store, "r3", year=2024, month=1).daily()


def test_options(spark, tmp_path):
    store, path = TableStore(str(tmp_path / "w"), spark), sample(spark, tmp_path / "in.parquet")
    bad = spark.read.parquet(path).limit(1).withColumn("fare_amount", -F.col("fare_amount"))
    spark.read.parquet(path).unionByName(bad).coalesce(1).write.parquet(str(tmp_path / "more.parquet"))
    at = datetime(2024, 2, 1, tzinfo=timezone.utc)
    run = Pipeline(spark, store, "r", at, max_invalid_ratio=0.5, enforce_unfiltered=True, append_summary=True)
    for _ in range(2):
        run.all(str(tmp_path / "more.parquet"))
    assert store.read(spark, CLEAN).count() == 3 and store.read(spark, SUMMARY).count() == 12
    assert store.read(spark, "quality.quarantine_silver_trips_clean").filter("rule_id = 'SLV003'").count() == 2
    other = Pipeline(spark, store, "s", at, 2023, 5, quality_in_window=True, strict_quality=False).quality()
    assert other[CLEAN]["profile"]["volume_ratio"] == 0


def test_backfill_resumes(tmp_path):
    settings, seen = {"a": 1}, []

    def each(month, run):
        if month == (2024, 2) and not seen.count("failed"):
            seen.append("failed")
            raise RuntimeError
        seen.append(month)

    planned = backfill.resolve_range("2024-01", "2024-03")
    with pytest.raises(RuntimeError):
        backfill.run(tmp_path, "r1", planned, settings, each)
    assert backfill.unfinished(tmp_path, settings).pending() == ["2024-02", "2024-03"]
    assert backfill.unfinished(tmp_path, {"a": 2}) is None
    done = backfill.run(tmp_path, "r2", planned, settings, each)
    assert done.run_id == "r1" and seen == [(2024, 1), "failed", (2024, 2), (2024, 3)]
    assert backfill.unfinished(tmp_path, settings) is None and backfill.purge(tmp_path) == 1


@pytest.mark.parametrize("bad", ["2024-13", "2024-1", "24-01", "2024/01", "invalid"])
def test_bad_months(bad):
    with pytest.raises(ValueError):
        backfill.parse_month(bad)


def test_mixed_range():
    with pytest.raises(ValueError):
        backfill.resolve_range("2024-01", "2024-02", 2024, 1)


def test_input_resolution(tmp_path, capsys):
    with pytest.raises(FileNotFoundError):
        resolve_input(tmp_path, None, 2024, 1)
    (tmp_path / "yellow_tripdata_2024-01.parquet").write_bytes(b"x")
    assert resolve_input(tmp_path, None, 2024, 1).name == "yellow_tripdata_2024-01.parquet"
    assert resolve_input("hdfs://name/lake/", None, 2024, 1) == "hdfs://name/lake/yellow_tripdata_2024-01.parquet"
    assert resolve_input(tmp_path, "s3a://b/x.parquet") == "s3a://b/x.parquet"
    with pytest.raises(ValueError):
        resolve_input(tmp_path)
    del capsys


def test_raw_rows_by_place(spark, tmp_path):
    path = sample(spark, tmp_path / "in.parquet")
    rows = raw_rows(spark, f"file://{path}", year=2024, month=1).collect()
    assert {r["source_file"] for r in rows} == {"in.parquet"} and len(rows) == 3
    assert all(abs(r["ingest_ts"].timestamp() - datetime.now().timestamp()) < 600 for r in rows)


def test_raw_contract(spark, tmp_path):
    store, path = TableStore(str(tmp_path / "w"), spark), sample(spark, tmp_path / "in.parquet")
    with pytest.raises(ValueError, match="Missing required"):
        Pipeline(spark, store, "r", enforce_raw=True).raw(path)
    assert not store.exists(RAW)


def test_layers_keep_untouched_days(spark, tmp_path):
    store, path = TableStore(str(tmp_path / "w"), spark), sample(spark, tmp_path / "in.parquet")
    run = Pipeline(spark, store, "r", datetime(2024, 2, 1, tzinfo=timezone.utc), strict_quality=False)
    run.all(path)
    assert store.partition_of(CLEAN) == "pickup_date" and store.partition_of(DAILY) == "trip_date"
    before = set(store.read(spark, CLEAN).inputFiles())
    late = spark.read.parquet(path).filter("tpep_pickup_datetime >= '2024-01-09'").withColumn("passenger_count", F.lit(5).cast("long"))
    late.coalesce(1).write.parquet(str(tmp_path / "late.parquet"))
    run.all(str(tmp_path / "late.parquet"))
    after = set(store.read(spark, CLEAN).inputFiles())
    assert len(before & after) == 2 and store.read(spark, CLEAN).count() == 4


def test_cli_exit_code(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["run-bronze", "--warehouse", str(tmp_path / "w"), "--year", "2024", "--month", "1"]) == 2
    assert "no input file" in capsys.readouterr().err
    path = sample(spark, tmp_path / "in.parquet")
    assert cli.main(["run-all", "--warehouse", str(tmp_path / "w"), "--input", path]) == 0
    assert cli.main(["inspect", "--warehouse", str(tmp_path / "w")]) == 0
    assert "silver.trips_clean 3" in capsys.readouterr().out
    assert cli.main(["inspect", "--warehouse", str(tmp_path / "w"), "--input", path]) == 0
    shown = capsys.readouterr().out
    assert shown.startswith("struct<") and shown.rstrip().endswith(f"{path} 3")
    assert cli.main(["report", "--warehouse", str(tmp_path / "w"), "--output", str(tmp_path / "out" / "kpi.txt")]) == 0
    assert (tmp_path / "out" / "kpi.txt").read_text() == capsys.readouterr().out


def test_cli_switches(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    path, w = sample(spark, tmp_path / "in.parquet"), str(tmp_path / "w")
    assert cli.main(["run-bronze", "--warehouse", w, "--input", path, "--enforce-raw"]) == 2
    assert "Missing required" in capsys.readouterr().err
    for _ in range(2):
        assert cli.main(["run-all", "--warehouse", w, "--input", path, "--append-summary", "--strict-defaults"]) == 0
    store = TableStore(w, spark)
    assert store.read(spark, SUMMARY).count() == 12
    assert cli.main(["clean", "--warehouse", w, "--root", str(tmp_path)]) == 0
    assert store.vacuum(CLEAN) == 0 and store.read(spark, CLEAN).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    store = TableStore(str(tmp_path / "w"), spark)
    rows = spark.createDataFrame([("a", 1, datetime(2024, 1, 1)), ("a", 2, datetime(2024, 1, 2)), ("b", 1, datetime(2024, 1, 1))], "k string, v int, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing to do
        sinks.run_available(sinks.upsert_sink(stream, store, "s.t", ["k"], "at", 7, str(tmp_path / "c")))
    assert sorted((r["k"], r["v"]) for r in store.read(spark, "s.t").collect()) == [("a", 2), ("b", 1)]
    sinks.run_available(sinks.daily_counts(stream, "at", "k", "v").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")))
    assert spark.table("counts").count() == 3


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
