"""The query catalogue: each operator applied to the driver's tables, with its SQL twin.

A trip is a line item with its order: supplier, order date, ship date, quantity, price, line number. An
event is a trip of one time. Every query is free of side effects and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import date_key, in_month, require
from tidemark.operators import diagnostics, drift, rules, transforms, upsert
from tidemark.sources.contracts import Contract, Field, Rule

Query = Callable[[SparkSession, str], DataFrame]
AT = transforms.TripColumns("l_suppkey", "o_orderdate", "l_shipdate", "l_quantity", "l_extendedprice", "l_linenumber")
TIES = ("fare_amount", "trip_distance", "passenger_count", "dropoff_ts")
KNOWN = {"1": "One", "2": "Two"}
TRIP_TYPES = {"trip_id": "string", "vendor_id": "string", "pickup_ts": "timestamp_ntz", "dropoff_ts": "timestamp_ntz", "pickup_date": "date", "trip_distance": "double", "fare_amount": "decimal(18,2)", "passenger_count": "bigint", "updated_at": "timestamp_ntz"}
CONTRACT = Contract(
    "trips",
    "engine",
    1,
    tuple(Field(n, t) for n, t in TRIP_TYPES.items()),
    (),
    "updated_at",
    7,
    (
        Rule("required", "R1", "error", "not_null", ("trip_id", "pickup_ts")),
        Rule("distance_range", "R2", "error", "range", ("trip_distance",), 2, 48),
        Rule("fare_range", "R3", "error", "range", ("fare_amount",), 1000, None),
        Rule("few_passengers", "R4", "warn", "range", ("passenger_count",), 1, 5),
        Rule("short_distance", "R5", "info", "range", ("trip_distance",), None, 40),
    ),
)

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_trips(spark: SparkSession, d: str) -> DataFrame:
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"])


def canonical_trips_of(spark: SparkSession, d: str) -> DataFrame:
    return transforms.canonical(raw_trips(spark, d), AT, "timestamp_ntz")


def clean_trips_of(spark: SparkSession, d: str) -> DataFrame:
    return transforms.latest(transforms.valid_trips(canonical_trips_of(spark, d)), ["trip_id"], "updated_at", TIES)


def events_as_trips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("vendor_id"), F.col("ts").cast("date").alias("pickup_date"), F.col("value").try_cast("decimal(18,2)").alias("fare_amount"), "ts", "user_id", "event_id")


def event_days(spark: SparkSession, d: str) -> DataFrame:
    return transforms.daily_kpi(events_as_trips(spark, d))


# --- SQL shared by the twins
def exact_ratio(total: str, n: str) -> str:
    """A non-negative amount over a count, rounded half up in whole numbers, as DuckDB divides decimals in floating point."""
    cents = f"CAST({total} * 100 AS HUGEINT)"
    return f"CAST(CAST((2 * {cents} + {n}) // (2 * {n}) AS DECIMAL(38,0)) / 100 AS DECIMAL(18,2))"


BASE = """base AS (SELECT CAST(l_suppkey AS VARCHAR) AS vendor_id, o_orderdate AS pickup_ts, l_shipdate AS dropoff_ts, CAST(o_orderdate AS DATE) AS pickup_date,
  CAST(l_quantity AS DOUBLE) AS trip_distance, CAST(l_extendedprice AS DECIMAL(18,2)) AS fare_amount, CAST(l_linenumber AS BIGINT) AS passenger_count, o_orderdate AS updated_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
CANONICAL = BASE + """, canonical AS (SELECT sha256(concat_ws('||', coalesce(vendor_id, '__null__'), coalesce(strftime(pickup_ts, '%Y-%m-%d %H:%M:%S.%f'), '__null__'),
  coalesce(strftime(dropoff_ts, '%Y-%m-%d %H:%M:%S.%f'), '__null__'), coalesce(printf('%.6f', trip_distance), '__null__'), coalesce(printf('%.2f', CAST(fare_amount AS DOUBLE)), '__null__'),
  coalesce(CAST(passenger_count AS VARCHAR), '__null__'))) AS trip_id, * FROM base)"""
VALID = CANONICAL + """, valid AS (SELECT * FROM canonical WHERE pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL AND dropoff_ts > pickup_ts AND fare_amount >= 0 AND trip_distance >= 0)"""
CLEAN = VALID + """, clean AS (SELECT * FROM valid QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY updated_at DESC NULLS LAST, fare_amount DESC, trip_distance DESC, passenger_count DESC, dropoff_ts DESC) = 1)"""
EVENTS = """ev AS (SELECT event_type AS vendor_id, CAST(ts AS DATE) AS pickup_date, CAST(value AS DECIMAL(18,2)) AS fare_amount, ts, user_id, event_id FROM events)"""
DAYS = EVENTS + """, days AS (SELECT pickup_date AS trip_date, coalesce(vendor_id, 'UNKNOWN') AS vendor_id, CAST(count(*) AS BIGINT) AS trips, CAST(sum(fare_amount) AS DECIMAL(18,2)) AS total_fare FROM ev GROUP BY 1, 2)"""
GOLD = CLEAN + """, gold AS (SELECT pickup_date AS trip_date, coalesce(vendor_id, 'UNKNOWN') AS vendor_id, CAST(count(*) AS BIGINT) AS trips, CAST(sum(fare_amount) AS DECIMAL(18,2)) AS total_fare FROM clean GROUP BY 1, 2)"""
MART = CLEAN + """, mart AS (SELECT concat(CAST(pickup_date AS VARCHAR), '_', vendor_id) AS daily_vendor_key, pickup_date AS trip_date, vendor_id, CAST(count(*) AS BIGINT) AS trips,
  CAST(sum(fare_amount) AS DECIMAL(18,2)) AS total_fare, """ + exact_ratio("sum(fare_amount)", "count(*)") + """ AS avg_fare_per_trip FROM clean WHERE vendor_id IS NOT NULL GROUP BY pickup_date, vendor_id)"""
TRIP_COLUMNS = "trip_id, vendor_id, pickup_ts, dropoff_ts, pickup_date, trip_distance, fare_amount, passenger_count, updated_at"


@query("WITH " + DAYS + " SELECT * FROM days")
def daily_kpi(spark: SparkSession, d: str) -> DataFrame:
    return event_days(spark, d)


@query("SELECT event_id, ts, CAST(user_id AS INTEGER) AS user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value, props FROM events")
def normalize_cast(spark: SparkSession, d: str) -> DataFrame:
    df, _ = transforms.normalise(table(spark, d, "events"), {"user_id": "int", "value": "decimal(18,2)"})
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'")
def month_window_ts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").filter(in_month("ts", 2024, 1, "timestamp_ntz")).select("event_id", "ts", "event_type")


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) < DATE '1996-04-01'")
def month_window_date(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("order_date")).filter(in_month("order_date", 1996, 3))


@query("SELECT event_id, DATE '2024-06-01' AS ingest_date, 'events.parquet' AS source_file FROM events")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.lit("2024-06-01").cast("date").alias("ingest_date"), F.lit("events.parquet").alias("source_file"))


@query(f"WITH {CANONICAL} SELECT {TRIP_COLUMNS} FROM canonical")
def canonical_trips(spark: SparkSession, d: str) -> DataFrame:
    return canonical_trips_of(spark, d)


@query(f"WITH {CANONICAL} SELECT trip_id FROM canonical")
def stable_key(spark: SparkSession, d: str) -> DataFrame:
    return canonical_trips_of(spark, d).select("trip_id")


@query(f"WITH {VALID} SELECT {TRIP_COLUMNS} FROM valid")
def validity_filter(spark: SparkSession, d: str) -> DataFrame:
    return transforms.valid_trips(canonical_trips_of(spark, d))


@query(f"WITH {CANONICAL} SELECT {TRIP_COLUMNS} FROM canonical WHERE dropoff_ts > pickup_ts AND fare_amount >= 0 AND trip_distance > 0 AND (passenger_count IS NULL OR passenger_count >= 1)")
def strict_validity_filter(spark: SparkSession, d: str) -> DataFrame:
    return transforms.strict_trips(canonical_trips_of(spark, d))


@query(f"WITH {CLEAN} SELECT {TRIP_COLUMNS} FROM clean")
def clean_trips(spark: SparkSession, d: str) -> DataFrame:
    return clean_trips_of(spark, d)


@query("SELECT nullif(trim(CAST(c_custkey AS VARCHAR)), '') AS c_custkey, nullif(trim(c_name), '') AS c_name, CAST(c_acctbal AS DECIMAL(18,2)) AS c_acctbal, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM customer")
def stage_trim_cast(spark: SparkSession, d: str) -> DataFrame:
    return transforms.staged(table(spark, d, "customer"), ["c_custkey", "c_name"], {"c_acctbal": "decimal(18,2)", "c_nationkey": "bigint"})


@query("SELECT event_id, CAST(coalesce(value, 0.0) AS DOUBLE) AS total_revenue FROM events")
def safe_col_revenue(spark: SparkSession, d: str) -> DataFrame:
    return transforms.with_revenue(table(spark, d, "events"), ("value", "tip_amount", "tolls_amount")).select("event_id", "total_revenue")


@query(f"WITH {CANONICAL} SELECT trip_id, CAST(epoch(dropoff_ts) - epoch(pickup_ts) AS BIGINT) AS trip_duration_sec, round((epoch(dropoff_ts) - epoch(pickup_ts)) / 60.0, 6) AS trip_duration_min FROM canonical")
def trip_duration(spark: SparkSession, d: str) -> DataFrame:
    return transforms.with_duration(canonical_trips_of(spark, d)).select("trip_id", "trip_duration_sec", F.round("trip_duration_min", 6).alias("trip_duration_min"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC, l_suppkey DESC) = 1")
def dedup_latest(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return transforms.latest(items, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey"])


OVERVIEW = CLEAN + """, overview AS (SELECT pickup_date, CAST(count(*) AS BIGINT) AS trips, CAST(sum(fare_amount) AS DECIMAL(18,2)) AS total_fare, round(avg(trip_distance), 3) AS avg_trip_distance,
  round(avg(CAST((epoch(dropoff_ts) - epoch(pickup_ts)) AS DOUBLE) / 60.0), 3) AS avg_trip_duration_min, round(avg(passenger_count), 3) AS avg_passenger_count FROM clean GROUP BY 1)"""


def overview_of(spark: SparkSession, d: str) -> DataFrame:
    df = transforms.daily_overview(transforms.with_duration(transforms.with_revenue(clean_trips_of(spark, d))))
    return df.select("pickup_date", "trips", F.col("total_fare").cast("decimal(18,2)").alias("total_fare"), "avg_trip_distance", "avg_trip_duration_min", "avg_passenger_count")


@query(f"WITH {OVERVIEW} SELECT * FROM overview")
def daily_overview(spark: SparkSession, d: str) -> DataFrame:
    return overview_of(spark, d)


@query(f"WITH {OVERVIEW} SELECT *, CAST(year(pickup_date) AS INTEGER) AS year, CAST(month(pickup_date) AS INTEGER) AS month FROM overview")
def overview_mart(spark: SparkSession, d: str) -> DataFrame:
    return transforms.overview_mart(overview_of(spark, d))


@query(f"WITH {MART} SELECT * FROM mart")
def daily_revenue_mart(spark: SparkSession, d: str) -> DataFrame:
    return transforms.revenue_mart(clean_trips_of(spark, d))


@query(f"WITH {MART} SELECT vendor_id, CASE WHEN vendor_id IN ('1', '2') THEN 'known_tlc_vendor' ELSE 'other_vendor' END AS vendor_tier, count(DISTINCT trip_date) AS active_days, CAST(sum(trips) AS BIGINT) AS total_trips, CAST(sum(total_fare) AS DECIMAL(18,2)) AS total_fare FROM mart GROUP BY 1, 2")
def vendor_profile(spark: SparkSession, d: str) -> DataFrame:
    return transforms.vendor_profile(transforms.revenue_mart(clean_trips_of(spark, d)))


@query(f"WITH {DAYS} SELECT CAST(date_trunc('month', trip_date) AS DATE) AS trip_month, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(total_fare) AS DECIMAL(18,2)) AS total_fare, {exact_ratio('sum(total_fare)', 'sum(trips)')} AS avg_fare_per_trip FROM days GROUP BY 1 ORDER BY 1")
def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return transforms.monthly_rollup(event_days(spark, d)).orderBy("trip_month")


@query(f"WITH {DAYS} SELECT CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(total_fare) AS DECIMAL(18,2)) AS total_fare, {exact_ratio('sum(total_fare)', 'sum(trips)')} AS avg_fare FROM days WHERE trip_date >= DATE '2024-01-01' AND trip_date < DATE '2024-02-01'")
def month_kpi(spark: SparkSession, d: str) -> DataFrame:
    one = event_days(spark, d).filter(in_month("trip_date", 2024, 1))
    return one.agg(F.sum("trips").alias("trips"), F.sum("total_fare").cast("decimal(18,2)").alias("total_fare"), F.try_divide(F.sum("total_fare"), F.sum("trips")).cast("decimal(18,2)").alias("avg_fare"))


@query(f"WITH {DAYS} SELECT trip_date, CAST(sum(trips) AS BIGINT) AS trips, CAST(sum(total_fare) AS DECIMAL(18,2)) AS total_fare FROM days GROUP BY 1 ORDER BY 1 LIMIT 5")
def first_days_kpi(spark: SparkSession, d: str) -> DataFrame:
    return event_days(spark, d).groupBy("trip_date").agg(F.sum("trips").alias("trips"), F.sum("total_fare").cast("decimal(18,2)").alias("total_fare")).orderBy("trip_date").limit(5)


@query("SELECT 'events' AS layer, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-01' UNION ALL SELECT 'days', count(DISTINCT CAST(ts AS DATE)) FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-02-01'")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    window = F.expr("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-02-01'")
    return diagnostics.counts_in_window(table(spark, d, "events"), window, F.col("ts").cast("date"), ("events", "days"))


@query(f"WITH {GOLD} SELECT g.trip_date, g.vendor_id, s_name AS vendor_name, g.trips, g.total_fare FROM gold g LEFT JOIN supplier ON g.vendor_id = CAST(s_suppkey AS VARCHAR) ORDER BY g.total_fare DESC, g.trip_date, g.vendor_id LIMIT 20")
def top_vendor_days(spark: SparkSession, d: str) -> DataFrame:
    days = transforms.daily_kpi(clean_trips_of(spark, d))
    # the top is taken first, so the join meets twenty rows
    top = days.orderBy(F.desc("total_fare"), "trip_date", "vendor_id").limit(20)
    names = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("k"), F.col("s_name").alias("vendor_name"))
    return top.join(names, top["vendor_id"] == names["k"], "left").select("trip_date", "vendor_id", "vendor_name", "trips", "total_fare").orderBy(F.desc("total_fare"), "trip_date", "vendor_id")


CALENDAR = """cal AS (SELECT CAST(x AS DATE) AS date, CAST(strftime(x, '%Y%m%d') AS INTEGER) AS date_key, CAST(year(x) AS INTEGER) AS year, CAST(month(x) AS INTEGER) AS month, CAST(day(x) AS INTEGER) AS day,
  CAST(dayofweek(x) + 1 AS INTEGER) AS day_of_week, dayname(x) AS day_name, monthname(x) AS month_name, dayofweek(x) IN (0, 6) AS is_weekend FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS x))"""


@query(f"WITH {CALENDAR} SELECT * FROM cal")
def calendar_dim(spark: SparkSession, d: str) -> DataFrame:
    return transforms.calendar(spark, "2024-01-01", "2024-12-31")


@query(f"WITH {CALENDAR} SELECT event_id, c.date_key, c.day_name, c.is_weekend FROM events LEFT JOIN cal c ON CAST(strftime(ts, '%Y%m%d') AS INTEGER) = c.date_key")
def calendar_join(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", date_key("ts").alias("k"))
    days = transforms.calendar(spark, "2024-01-01", "2024-12-31")  # 366 rows
    return e.join(F.broadcast(days), e["k"] == days["date_key"], "left").select("event_id", "date_key", "day_name", "is_weekend")


@query(f"WITH {VALID}, a AS (SELECT pickup_date AS day, count(*) AS n FROM canonical GROUP BY 1), b AS (SELECT pickup_date AS day, count(*) AS n FROM valid GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, coalesce(a.n, 0) AS source_rows, coalesce(b.n, 0) AS target_rows, coalesce(a.n, 0) - coalesce(b.n, 0) AS diff FROM a FULL OUTER JOIN b ON a.day = b.day")
def layer_recon_full_outer(spark: SparkSession, d: str) -> DataFrame:
    rows = canonical_trips_of(spark, d)
    day = F.col("pickup_date").alias("day")
    return transforms.day_counts_compared(rows.select(day), transforms.valid_trips(rows).select(day))


@query("SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS vendor_id, CASE CAST(l_suppkey AS VARCHAR) WHEN '1' THEN 'One' WHEN '2' THEN 'Two' ELSE 'Unknown/Other' END AS vendor_name, l_suppkey IN (1, 2) AS is_known_vendor FROM lineitem WHERE l_suppkey IS NOT NULL")
def vendor_dim(spark: SparkSession, d: str) -> DataFrame:
    return transforms.vendor_dim(table(spark, d, "lineitem"), KNOWN, "l_suppkey")


def _values(rows: tuple[tuple[int, str], ...], kind: str) -> str:
    return f"SELECT CAST(a AS BIGINT) AS {kind}_id, b AS {kind}_name FROM (VALUES {', '.join(map(str, rows))}) t(a, b)"


@query(_values(transforms.PAYMENT_TYPES, "payment_type"))
def payment_type_dim(spark: SparkSession, d: str) -> DataFrame:
    return transforms.lookup_dim(spark, "payment_type")


@query(_values(transforms.RATE_CODES, "rate_code"))
def rate_code_dim(spark: SparkSession, d: str) -> DataFrame:
    return transforms.lookup_dim(spark, "rate_code")


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS null_rate FROM orders" for c in ORDER_COLUMNS))
def null_profile(spark: SparkSession, d: str) -> DataFrame:
    return transforms.null_profile(table(spark, d, "orders").select(*ORDER_COLUMNS))


CONDITIONS = {"null_dropoff": "dropoff_ts IS NULL", "non_positive_duration": "dropoff_ts <= pickup_ts", "negative_fare": "fare_amount < 0", "zero_distance": "trip_distance = 0", "no_passengers": "passenger_count < 1", "long_distance": "trip_distance > 45"}


@query(f"WITH {CANONICAL} SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in CONDITIONS.items()) + " FROM canonical")
def conditional_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.condition_counts(canonical_trips_of(spark, d), CONDITIONS)


@query(f"WITH {CANONICAL}, one AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in CONDITIONS.items()) + " FROM canonical) " + " UNION ALL ".join(f"SELECT 'validity' AS category, '{n}' AS metric_name, {n} AS metric_value, round({n} / n, 6) AS metric_rate FROM one" for n in CONDITIONS))
def dq_summary(spark: SparkSession, d: str) -> DataFrame:
    one = diagnostics.condition_counts(canonical_trips_of(spark, d), CONDITIONS)
    long = one.selectExpr("n", f"stack({len(CONDITIONS)}, {', '.join(f"'{c}', {c}" for c in CONDITIONS)}) AS (metric_name, metric_value)")
    return long.select(F.lit("validity").alias("category"), "metric_name", "metric_value", F.round(F.try_divide("metric_value", "n"), 6).alias("metric_rate"))


@query("SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def dup_rows(spark: SparkSession, d: str) -> DataFrame:
    return transforms.duplicate_rows(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query(f"WITH {CANONICAL} SELECT CAST(min(pickup_date) AS DATE) AS first_date, max(pickup_date) AS last_date, count(*) AS n, CAST(sum(fare_amount) AS DECIMAL(18,2)) AS fare, count(DISTINCT vendor_id) AS vendors FROM canonical")
def table_bounds(spark: SparkSession, d: str) -> DataFrame:
    return canonical_trips_of(spark, d).agg(F.min("pickup_date").alias("first_date"), F.max("pickup_date").alias("last_date"), F.count("*").alias("n"), F.sum("fare_amount").cast("decimal(18,2)").alias("fare"), F.count_distinct("vendor_id").alias("vendors"))


@query(f"WITH {VALID} SELECT (SELECT count(*) FROM canonical) AS rows_in, (SELECT count(*) FROM valid) AS rows_out, round(1.0 - (SELECT count(*) FROM valid) / (SELECT count(*) FROM canonical), 6) AS drop_rate")
def drop_rate(spark: SparkSession, d: str) -> DataFrame:
    kept = (F.col("dropoff_ts") > F.col("pickup_ts")) & (F.col("fare_amount") >= 0) & (F.col("trip_distance") >= 0)
    return diagnostics.drop_rate(canonical_trips_of(spark, d), kept)


@query(f"WITH {GOLD} SELECT (SELECT count(*) FROM clean) AS silver_rows, CAST((SELECT sum(trips) FROM gold) AS BIGINT) AS gold_trips, CAST((SELECT count(*) FROM clean) - (SELECT sum(trips) FROM gold) AS BIGINT) AS diff")
def cross_layer_sum(spark: SparkSession, d: str) -> DataFrame:
    silver = clean_trips_of(spark, d)
    return diagnostics.cross_layer_sum(silver, transforms.daily_kpi(silver))


SUMMARY_COLUMNS = ("trip_id", "vendor_id", "pickup_ts", "tip_amount")


@query(f"""WITH {GOLD}, r AS (SELECT count(*) AS n FROM canonical), s AS (SELECT count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in CONDITIONS.items())} FROM clean), g AS (SELECT count(*) AS n, sum(trips) AS t FROM gold),
  x AS (SELECT 'reconciliation' AS category, 'raw_rows' AS metric_name, r.n AS metric_value, NULL AS metric_rate FROM r UNION ALL SELECT 'reconciliation', 'silver_rows', n, NULL FROM s UNION ALL SELECT 'reconciliation', 'drop_rows', r.n - s.n, NULL FROM r, s
  UNION ALL SELECT 'reconciliation', 'drop_rate', round((r.n - s.n) / r.n, 6), NULL FROM r, s UNION ALL SELECT 'reconciliation', 'gold_rows', n, NULL FROM g UNION ALL SELECT 'reconciliation', 'gold_trips', t, NULL FROM g
  {" ".join(f"UNION ALL SELECT 'validity', '{n}', {n}, round({n} / n, 6) FROM s" for n in CONDITIONS)} UNION ALL SELECT 'drift', 'missing_columns', 1, NULL UNION ALL SELECT 'drift', 'extra_columns', {len(TRIP_TYPES) - 3}, NULL)
  SELECT category, metric_name, CAST(metric_value AS DOUBLE) AS metric_value, CAST(metric_rate AS DOUBLE) AS metric_rate FROM x""")
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    """All three categories, of raw, clean and daily trips."""
    silver = clean_trips_of(spark, d)
    return diagnostics.summary(canonical_trips_of(spark, d), silver, transforms.daily_kpi(silver), CONDITIONS, SUMMARY_COLUMNS)


FAILED = "CASE WHEN trip_id IS NULL OR pickup_ts IS NULL THEN 'R1' WHEN trip_distance IS NULL OR trip_distance < 2 OR trip_distance > 48 THEN 'R2' WHEN fare_amount IS NULL OR fare_amount < 1000 THEN 'R3' END"


def tags_of(spark: SparkSession, d: str) -> DataFrame:
    rows = canonical_trips_of(spark, d)
    rules.check_schema(rows, CONTRACT)
    return rules.tagged(rows, CONTRACT)


@query(f"WITH {CANONICAL} SELECT {TRIP_COLUMNS} FROM canonical WHERE {FAILED} IS NULL")
def contract_valid(spark: SparkSession, d: str) -> DataFrame:
    return rules.valid_rows(tags_of(spark, d))


@query(f"WITH {CANONICAL}, f AS (SELECT *, {FAILED} AS rule_id FROM canonical) SELECT {TRIP_COLUMNS}, rule_id, CASE rule_id WHEN 'R1' THEN 'required' WHEN 'R2' THEN 'distance_range' ELSE 'fare_range' END AS rule_name, CASE rule_id WHEN 'R1' THEN 'not_null_violation' ELSE 'range_violation' END AS reason_code, 'error' AS severity FROM f WHERE rule_id IS NOT NULL")
def contract_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return rules.quarantined_rows(tags_of(spark, d))


@query(f"WITH {CANONICAL} SELECT count(*) AS total_count, count(*) FILTER (WHERE {FAILED} IS NOT NULL) AS invalid_count, count(*) FILTER (WHERE passenger_count IS NULL OR passenger_count < 1 OR passenger_count > 5) AS warn_count, count(*) FILTER (WHERE trip_distance IS NULL OR trip_distance > 40) AS info_count FROM canonical")
def contract_summary(spark: SparkSession, d: str) -> DataFrame:
    return rules.enforcement_counts(tags_of(spark, d))


@query(f"WITH {CANONICAL}, f AS (SELECT * FROM canonical WHERE {FAILED} IS NULL), k AS (SELECT vendor_id, pickup_date, count(*) AS n FROM f GROUP BY 1, 2) SELECT (SELECT count(*) FROM f) AS valid_count, count(*) AS keys, count(*) FILTER (WHERE n > 1) AS repeated_keys, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM k")
def contract_key(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness of a contract's key (vendor and day here) over the rows that break no rule."""
    return rules.key_uniqueness(rules.valid_rows(tags_of(spark, d)), ["vendor_id", "pickup_date"])


# whole rows are equal where the hash ties, so any of them is the same row
@query("SELECT DISTINCT l_suppkey, CAST(l_shipdate AS DATE) AS day, l_returnflag FROM (SELECT *, rank() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS n FROM lineitem) WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256('{\"day\":\"' || strftime(CAST(l_shipdate AS DATE), '%Y-%m-%d') || '\",\"l_returnflag\":\"' || l_returnflag || '\",\"l_suppkey\":' || l_suppkey || '}') DESC) = 1")
def dedup_by_row_hash(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of a supplier; ties go by the hash of the whole row as JSON."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_returnflag")
    return transforms.latest(rows, ["l_suppkey"], "day")


TARGET, SOURCE = "o_orderdate < TIMESTAMP '1997-01-01'", "o_orderdate >= TIMESTAMP '1996-12-01'"
COLUMNS = "o_orderkey, o_custkey, o_orderdate, version"
SPLIT = f"""t AS (SELECT o_orderkey, o_custkey, o_orderdate, 1 AS version FROM orders WHERE {TARGET}), s AS (SELECT o_orderkey, o_custkey, o_orderdate, 2 AS version FROM orders WHERE {SOURCE}),
  late AS (SELECT * FROM s WHERE CAST(o_orderdate AS DATE) >= (SELECT CAST(max(o_orderdate) AS DATE) - 7 FROM t)), fresh AS (SELECT * FROM late QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, o_custkey DESC) = 1)"""


def split_orders(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return o.filter("o_orderdate < TIMESTAMP_NTZ '1997-01-01'").withColumn("version", F.lit(1)), o.filter("o_orderdate >= TIMESTAMP_NTZ '1996-12-01'").withColumn("version", F.lit(2))


@query(f"WITH {SPLIT} SELECT {COLUMNS} FROM late")
def late_arrival_filter(spark: SparkSession, d: str) -> DataFrame:
    target, source = split_orders(spark, d)
    return upsert.within_lateness(source, target, "o_orderdate", 7)


@query(f"WITH {SPLIT} SELECT {COLUMNS} FROM t WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.o_orderkey IS NOT DISTINCT FROM t.o_orderkey) UNION ALL SELECT {COLUMNS} FROM fresh")
def upsert_result(spark: SparkSession, d: str) -> DataFrame:
    target, source = split_orders(spark, d)
    return upsert.upsert_result(target, source, ["o_orderkey"], "o_orderdate", 7, ["o_custkey"])


@query(f"WITH {VALID} SELECT (SELECT count(*) FROM canonical) AS source_rows, (SELECT count(*) FROM valid) AS target_rows, round(abs((SELECT count(*) FROM canonical) - (SELECT count(*) FROM valid)) / greatest((SELECT count(*) FROM canonical), 1), 6) AS diff_ratio, abs((SELECT count(*) FROM canonical) - (SELECT count(*) FROM valid)) / greatest((SELECT count(*) FROM canonical), 1) <= 0.6 AS passed")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = canonical_trips_of(spark, d)
    return rules.reconciliation(rows, transforms.valid_trips(rows), 0.6).withColumn("diff_ratio", F.round("diff_ratio", 6))


GATE = CANONICAL + """, g AS (SELECT pickup_date AS trip_date, vendor_id, count(*) AS trips, sum(fare_amount) AS total_fare FROM canonical WHERE year(pickup_date) < 1998 GROUP BY 1, 2),
  b AS (SELECT min(trip_date) AS f, max(trip_date) AS l, count(*) AS n, sum(total_fare) AS fare, sum(trips) AS trips FROM g),
  gate AS (SELECT 'QG001' AS rule_id, 'invalid_pickup_date_window' AS rule_name, (SELECT count(*) FROM canonical, b WHERE pickup_date IS NULL OR pickup_date < f OR pickup_date > l) AS failed_count
  UNION ALL SELECT 'QG002', 'non_positive_trip_duration', (SELECT count(*) FROM canonical WHERE pickup_ts IS NULL OR dropoff_ts IS NULL OR dropoff_ts <= pickup_ts)
  UNION ALL SELECT 'QG003', 'negative_fare_or_distance', (SELECT count(*) FROM canonical WHERE fare_amount < 0 OR trip_distance < 0)
  UNION ALL SELECT 'QG004', 'pk_duplicates_detected', CAST((SELECT count(*) - count(DISTINCT trip_id) FROM canonical) AS BIGINT)
  UNION ALL SELECT 'QG005', 'gold_non_positive_volume', (SELECT CASE WHEN n > 0 THEN 0 ELSE 1 END FROM b)
  UNION ALL SELECT 'QG006', 'gold_avg_fare_per_trip_out_of_range', (SELECT CASE WHEN CAST(fare AS DOUBLE) / trips BETWEEN 0.5 AND 500.0 THEN 0 ELSE 1 END FROM b))"""


def gate_of(spark: SparkSession, d: str) -> DataFrame:
    silver = canonical_trips_of(spark, d)
    return rules.gate_counts(silver, transforms.daily_kpi(silver.filter("pickup_date < DATE '1998-01-01'")))


@query(f"WITH {GATE} SELECT rule_id, rule_name, CAST(failed_count AS BIGINT) AS failed_count FROM gate")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    return gate_of(spark, d)


@query(f"WITH {GATE} SELECT CASE rule_id WHEN 'QG004' THEN 'warn' ELSE 'error' END AS severity, count(*) AS rules_checked, CAST(sum(CASE WHEN failed_count <= 0 THEN 0 ELSE 1 END) AS BIGINT) AS rules_failed FROM gate GROUP BY 1 ORDER BY 1")
def gate_by_severity(spark: SparkSession, d: str) -> DataFrame:
    level = F.when(F.col("rule_id") == "QG004", "warn").otherwise("error")
    return gate_of(spark, d).groupBy(level.alias("severity")).agg(F.count("*").alias("rules_checked"), F.count_if(F.col("failed_count") > 0).alias("rules_failed")).orderBy("severity")


HALF = "TIMESTAMP '2024-01-16'"
METRICS = ("volume_ratio", "avg_fare_amount_ratio")
PROFILES = f"""h AS (SELECT ts < {HALF} AS first, value, event_type, user_id FROM events),
  p AS (SELECT first, CAST(count(*) AS DOUBLE) AS v, avg(value) AS a FROM h GROUP BY 1)"""


def halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    return e.filter("ts < TIMESTAMP_NTZ '2024-01-16'"), e.filter("ts >= TIMESTAMP_NTZ '2024-01-16'")


def profile_of(df: DataFrame) -> DataFrame:
    return drift.profile(df, {"volume_ratio": F.count("*"), "avg_fare_amount_ratio": F.avg("value")})


@query(f"WITH {PROFILES} SELECT 'volume_ratio' AS metric_name, v AS metric_value FROM p WHERE NOT first UNION ALL SELECT 'avg_fare_amount_ratio', round(a, 6) FROM p WHERE NOT first")
def drift_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile_of(halves(spark, d)[1]).withColumn("metric_value", F.round("metric_value", 6))


@query(f"""WITH {PROFILES}, m AS (SELECT 'volume_ratio' AS metric_name, (SELECT v FROM p WHERE first) AS b, (SELECT v FROM p WHERE NOT first) AS c UNION ALL SELECT 'avg_fare_amount_ratio', (SELECT a FROM p WHERE first), (SELECT a FROM p WHERE NOT first)),
  x AS (SELECT *, abs(c - b) / abs(b) AS r FROM m) SELECT metric_name, round(b, 6) AS baseline_value, round(c, 6) AS observed_value, round(r, 6) AS delta_ratio, CASE WHEN r >= 0.02 THEN 'error' WHEN r >= 0.01 THEN 'warn' END AS severity FROM x""")
def drift_events(spark: SparkSession, d: str) -> DataFrame:
    before, after = halves(spark, d)
    found = drift.compared(profile_of(after), profile_of(before), dict.fromkeys(METRICS, (0.01, 0.02)))
    return found.select("metric_name", *[F.round(c, 6).alias(c) for c in ("baseline_value", "observed_value", "delta_ratio")], "severity")


WEEKS = """w AS (SELECT event_type AS dataset, CAST(date_trunc('week', ts) AS DATE) AS run_ts, CAST(count(*) AS DOUBLE) AS v, avg(value) AS a FROM events GROUP BY 1, 2),
  m AS (SELECT dataset, run_ts, 'volume_ratio' AS metric_name, v AS x FROM w UNION ALL SELECT dataset, run_ts, 'avg_fare_amount_ratio', a FROM w),
  c AS (SELECT n.dataset, n.metric_name, n.run_ts, o.x AS b, n.x AS c, abs(n.x - o.x) / abs(o.x) AS r FROM m n JOIN m o ON n.dataset = o.dataset AND n.metric_name = o.metric_name AND n.run_ts = o.run_ts + 7)"""


@query(f"WITH {WEEKS} SELECT dataset, metric_name, CASE WHEN r >= 0.2 THEN 'error' ELSE 'warn' END AS severity, run_ts, round(r, 6) AS delta_ratio, round(b, 6) AS baseline_value, round(c, 6) AS observed_value FROM c WHERE r >= 0.1 ORDER BY run_ts DESC, severity DESC, dataset, metric_name")
def drift_listing(spark: SparkSession, d: str) -> DataFrame:
    """Each week of an event type against the week before, as the listing of drift events."""
    week = F.date_trunc("week", F.col("ts").cast("timestamp")).cast("date")
    weeks = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset"), week.alias("run_ts")).agg(F.count("*").cast("double").alias("volume_ratio"), F.avg("value").alias("avg_fare_amount_ratio"))
    now = weeks.unpivot(["dataset", "run_ts"], list(METRICS), "metric_name", "observed_value")
    past = now.select("dataset", "metric_name", F.date_add("run_ts", 7).alias("run_ts"), F.col("observed_value").alias("baseline_value"))
    change = drift.delta(F.col("observed_value"), F.col("baseline_value"))
    events = now.join(past, ["dataset", "metric_name", "run_ts"]).select("dataset", "metric_name", drift.severity(change, F.lit(0.1), F.lit(0.2)).alias("severity"), "run_ts", F.round(change, 6).alias("delta_ratio"), *[F.round(c, 6).alias(c) for c in ("baseline_value", "observed_value")])
    return drift.listing(events.filter("severity IS NOT NULL"))


@query("SELECT coalesce(event_type, '__null__') AS category, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1")
def category_shares(spark: SparkSession, d: str) -> DataFrame:
    return drift.shares(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 9))


@query(f"""WITH h AS (SELECT ts < {HALF} AS first, coalesce(event_type, '__null__') AS k FROM events), a AS (SELECT k, count(*) / (SELECT count(*) FROM h WHERE first) AS s FROM h WHERE first GROUP BY 1), b AS (SELECT k, count(*) / (SELECT count(*) FROM h WHERE NOT first) AS s FROM h WHERE NOT first GROUP BY 1)
  SELECT round(sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))), 9) AS l1 FROM a FULL OUTER JOIN b ON a.k = b.k""")
def distribution_l1(spark: SparkSession, d: str) -> DataFrame:
    before, after = halves(spark, d)
    return drift.l1_distance(drift.shares(before, "event_type"), drift.shares(after, "event_type")).withColumn("l1", F.round("l1", 9))


@query(f"WITH {DAYS} SELECT CASE WHEN sum(trips) > 0 THEN round(CAST(sum(total_fare) AS DOUBLE) / sum(trips), 6) END AS avg_fare_per_trip FROM days")
def weighted_average(spark: SparkSession, d: str) -> DataFrame:
    return event_days(spark, d).agg(F.round(drift.weighted_average("total_fare", "trips"), 6).alias("avg_fare_per_trip"))


@query(f"WITH {DAYS} SELECT count(DISTINCT trip_date) AS days, count(DISTINCT trip_date) BETWEEN 28 AND 31 AS passed FROM days WHERE trip_date >= DATE '2024-01-01' AND trip_date < DATE '2024-02-01'")
def day_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.day_coverage(event_days(spark, d).filter(in_month("trip_date", 2024, 1)), "trip_date", 31)


@query("""SELECT 'not_null' AS test, 'o_orderkey' AS column_name, count(*) FILTER (WHERE o_orderkey IS NULL) AS failures FROM orders
  UNION ALL SELECT 'accepted_values', 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('O', 'F')) FROM orders
  UNION ALL SELECT 'unique', 'o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)""")
def column_tests(spark: SparkSession, d: str) -> DataFrame:
    return rules.column_tests(table(spark, d, "orders"), ["o_orderkey"], ["o_orderkey"], {"o_orderstatus": ["O", "F"]})


@query("SELECT event_type, CAST(ts AS DATE) AS day, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    require(e, ["event_type", "ts"])
    return transforms.latest(e, ["event_type"], "ts", ["event_id"]).select("event_type", F.col("ts").cast("date").alias("day"), "event_id", "value")
