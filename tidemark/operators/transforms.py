"""From raw rows to clean ones, daily figures and dimensions: one projection or aggregate each."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tidemark.functions.columns import clean_id, guarded_ratio, require, safe_col, stable_key, stable_number, stable_text, stable_time

MONEY = "decimal(18,2)"
#: The types that raw columns are brought to.
RAW_TYPES = {
    "VendorID": "int",
    "passenger_count": "bigint",
    "RatecodeID": "bigint",
    "PULocationID": "int",
    "DOLocationID": "int",
    "payment_type": "bigint",
    "tpep_pickup_datetime": "timestamp",
    "tpep_dropoff_datetime": "timestamp",
}


def normalise(df: DataFrame, types: dict[str, str] | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """Zone-less times become timestamps, listed columns get their types, all in one projection; and a report."""
    types = RAW_TYPES if types is None else types
    report: dict[str, list[str]] = {"timestamps": [], "casts": []}
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), types.get(f.name)
        now = f.dataType.simpleString()
        if isinstance(f.dataType, TimestampNTZType):
            report["timestamps"].append(f.name)
            c, now = c.cast("timestamp"), "timestamp"
        if kind and now != kind:
            report["casts"].append(f"{f.name}:{kind}")
            c = c.try_cast(kind)
        out.append(c.alias(f.name))
    return df.select(*out), report


@dataclass(frozen=True)
class TripColumns:
    """Where a raw table holds the parts of a trip."""

    vendor: str = "VendorID"
    pickup: str = "tpep_pickup_datetime"
    dropoff: str = "tpep_dropoff_datetime"
    distance: str = "trip_distance"
    fare: str = "fare_amount"
    passengers: str = "passenger_count"


def canonical(df: DataFrame, at: TripColumns | None = None, time: str = "timestamp") -> DataFrame:
    """The nine columns of a clean trip, with its deterministic key."""
    at = at or TripColumns()
    require(df, vars(at).values(), "raw input")
    base = df.select(
        F.col(at.vendor).cast("string").alias("vendor_id"),
        F.col(at.pickup).try_cast(time).alias("pickup_ts"),
        F.col(at.dropoff).try_cast(time).alias("dropoff_ts"),
        F.col(at.pickup).try_cast("date").alias("pickup_date"),
        F.col(at.distance).try_cast("double").alias("trip_distance"),
        F.col(at.fare).try_cast(MONEY).alias("fare_amount"),
        F.col(at.passengers).try_cast("bigint").alias("passenger_count"),
        F.col(at.pickup).try_cast(time).alias("updated_at"),
    )
    key = stable_key(stable_text("vendor_id"), stable_time("pickup_ts"), stable_time("dropoff_ts"), stable_number("trip_distance", 6), stable_number("fare_amount", 2), stable_text("passenger_count"))
    return base.select(key.alias("trip_id"), *base.columns)


def valid_trips(df: DataFrame, reject_nan: bool = False) -> DataFrame:
    """Known times in order, no negative fare or distance; a null in any of these drops the row."""
    kept = df.filter("pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL AND dropoff_ts > pickup_ts AND pickup_date IS NOT NULL AND fare_amount >= 0 AND trip_distance >= 0")
    return kept.filter(~F.isnan("trip_distance")) if reject_nan else kept


def strict_trips(df: DataFrame) -> DataFrame:
    """The stricter variant: a distance above zero, and at least one passenger where the number is known."""
    return df.filter("dropoff_ts > pickup_ts AND fare_amount >= 0 AND trip_distance > 0 AND (passenger_count IS NULL OR passenger_count >= 1)")


def latest(df: DataFrame, keys: Sequence[str], watermark: str, ties: Sequence[str] | None = None) -> DataFrame:
    """One row for each key: the latest, ties by a hash of the whole row (or the given columns, descending)."""
    require(df, [*keys, watermark], "dedup input")
    tie = [F.col(c).desc() for c in ties] if ties else [F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).desc()]
    order = Window.partitionBy(*keys).orderBy(F.col(watermark).desc_nulls_last(), *tie)
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def clean_trips(raw: DataFrame, at: TripColumns | None = None, time: str = "timestamp") -> DataFrame:
    return latest(valid_trips(canonical(raw, at, time)), ["trip_id"], "updated_at")


def staged(df: DataFrame, ids: Sequence[str], casts: dict[str, str]) -> DataFrame:
    """Ids trimmed and emptied to null, other columns cast."""
    return df.select(*[clean_id(c).alias(c) for c in ids], *[F.col(c).try_cast(k).alias(c) for c, k in casts.items()])


def daily_kpi(df: DataFrame, date: str = "pickup_date", vendor: str = "vendor_id", fare: str = "fare_amount") -> DataFrame:
    return df.groupBy(F.col(date).alias("trip_date"), F.coalesce(F.col(vendor), F.lit("UNKNOWN")).alias("vendor_id")).agg(F.count("*").alias("trips"), F.sum(fare).cast(MONEY).alias("total_fare"))


REVENUE_PARTS = ("fare_amount", "tip_amount", "tolls_amount", "extra", "mta_tax", "improvement_surcharge", "congestion_surcharge", "airport_fee")


def with_revenue(df: DataFrame, parts: Sequence[str] = REVENUE_PARTS) -> DataFrame:
    """total_revenue: the sum of the parts, missing ones as 0."""
    total = F.lit(0.0)
    for p in parts:
        total += safe_col(df, p)
    return df.withColumn("total_revenue", total)


def with_duration(df: DataFrame, start: str = "pickup_ts", end: str = "dropoff_ts") -> DataFrame:
    seconds = F.unix_timestamp(end) - F.unix_timestamp(start)
    return df.withColumns({"trip_duration_sec": seconds, "trip_duration_min": seconds / 60.0})


def daily_overview(df: DataFrame) -> DataFrame:
    """By day, of rows with revenue and duration: count, sums, averages to three decimals."""
    return df.groupBy("pickup_date").agg(
        F.count("*").alias("trips"),
        F.sum(safe_col(df, "fare_amount")).alias("total_fare"),
        F.sum(safe_col(df, "tip_amount")).alias("total_tip"),
        F.sum("total_revenue").alias("total_revenue"),
        *[F.round(F.avg(c), 3).alias(n) for n, c in (("avg_trip_distance", "trip_distance"), ("avg_trip_duration_min", "trip_duration_min"), ("avg_passenger_count", "passenger_count"))],
    )


def overview_mart(overview: DataFrame) -> DataFrame:
    return overview.select("*", F.year("pickup_date").alias("year"), F.month("pickup_date").alias("month"))


def revenue_mart(df: DataFrame) -> DataFrame:
    """By day and known vendor: trips, fare, average fare."""
    total = F.sum("fare_amount")
    return (
        df.filter("vendor_id IS NOT NULL")
        .groupBy(F.col("pickup_date").alias("trip_date"), "vendor_id")
        .agg(F.count("*").alias("trips"), total.cast(MONEY).alias("total_fare"), guarded_ratio(total, F.count("*")).alias("avg_fare_per_trip"))
        .select(F.concat(F.col("trip_date").cast("string"), F.lit("_"), F.col("vendor_id")).alias("daily_vendor_key"), "*")
    )


def vendor_profile(mart: DataFrame, known: Sequence[str] = ("1", "2")) -> DataFrame:
    tier = F.when(F.col("vendor_id").isin(*known), "known_tlc_vendor").otherwise("other_vendor")
    return mart.groupBy("vendor_id", tier.alias("vendor_tier")).agg(F.count_distinct("trip_date").alias("active_days"), F.sum("trips").alias("total_trips"), F.sum("total_fare").cast(MONEY).alias("total_fare"))


def monthly_rollup(daily: DataFrame) -> DataFrame:
    trips, fare = F.sum("trips"), F.sum("total_fare")
    return daily.groupBy(F.trunc("trip_date", "month").alias("trip_month")).agg(trips.alias("trips"), fare.cast(MONEY).alias("total_fare"), F.when(trips == 0, 0).otherwise(guarded_ratio(fare, trips)).cast(MONEY).alias("avg_fare_per_trip"))


def vendor_dim(df: DataFrame, names: dict[str, str] | None = None, vendor: str = "vendor_id") -> DataFrame:
    """Distinct known ids with a name and whether it is one of the named."""
    #: Fixed values
    names = {"1": "Creative Mobile Technologies", "2": "VeriFone Inc."} if names is None else names
    name = F.lit(None).cast("string")
    for k, v in names.items():
        name = F.when(F.col("vendor_id") == k, v).otherwise(name)
    ids = df.select(F.col(vendor).cast("string").alias("vendor_id")).distinct().filter("vendor_id IS NOT NULL")
    return ids.select("vendor_id", F.coalesce(name, F.lit("Unknown/Other")).alias("vendor_name"), F.col("vendor_id").isin(*names).alias("is_known_vendor"))


#: Codes of payments and rates.
PAYMENT_TYPES = ((0, "Flex Fare trip"), (1, "Credit card"), (2, "Cash"), (3, "No charge"), (4, "Dispute"), (5, "Unknown"), (6, "Voided trip"))
RATE_CODES = ((1, "Standard rate"), (2, "JFK"), (3, "Newark"), (4, "Nassau or Westchester"), (5, "Negotiated fare"), (6, "Group ride"), (99, "Unknown"))


def lookup_dim(spark: SparkSession, kind: str) -> DataFrame:
    rows = {"payment_type": PAYMENT_TYPES, "rate_code": RATE_CODES}[kind]
    return spark.createDataFrame([list(r) for r in rows], f"{kind}_id long, {kind}_name string")


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """A row for each day, both ends included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.select(
        "date",
        F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"),
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.dayofweek("date").alias("day_of_week"),
        F.date_format("date", "EEEE").alias("day_name"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.dayofweek("date").isin(1, 7).alias("is_weekend"),
    )


def joined_once(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """df with the dimension's columns beside it; a ValueError where a row of df would come out more than once."""
    if has_duplicates(dim.filter(F.col(key).isNotNull()), [key]):
        raise ValueError(f"the dimension has rows of equal {key}")
    return df.join(dim, key, "left")


def day_counts_compared(left: DataFrame, right: DataFrame, day: str = "day") -> DataFrame:
    """Both sides' rows by day, missing days as 0, largest difference first."""
    a, b = (x.groupBy(day).agg(F.count("*").alias(n)) for x, n in ((left, "source_rows"), (right, "target_rows")))
    both = a.join(b, day, "full_outer").na.fill(0, ["source_rows", "target_rows"])
    return both.withColumn("diff", F.col("source_rows") - F.col("target_rows")).orderBy(F.abs("diff").desc(), day)


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls and their rate for each column, in one pass; the highest rate first."""
    one = df.agg(F.count("*").alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    long = one.selectExpr("__rows", f"stack({len(df.columns)}, {pairs}) AS (column_name, null_count)")
    return long.select("column_name", "null_count", F.round(F.coalesce(F.try_divide("null_count", "__rows"), F.lit(0.0)), 6).alias("null_rate")).orderBy(F.desc("null_rate"), "column_name")


def column_drift(df: DataFrame, expected: Sequence[str]) -> dict[str, list[str]]:
    have, want = set(df.columns), set(expected)
    return {"missing": sorted(want - have), "extra": sorted(have - want)}


def duplicate_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many rows are beyond the first of their key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def has_duplicates(df: DataFrame, keys: Sequence[str]) -> bool:
    return not df.groupBy(*keys).count().filter("count > 1").isEmpty()
