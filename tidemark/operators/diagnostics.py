"""Figures about tables and between layers: conditions, drops, windows, and the summary of all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import count_where
from tidemark.operators.transforms import column_drift


def condition_counts(df: DataFrame, conditions: dict[str, str | Column]) -> DataFrame:
    """(n, one column for each condition): the rows, and those that meet each, in one pass; unknown counts as not met."""
    return df.agg(F.count("*").alias("n"), *[count_where(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in conditions.items()])


def drop_rate(df: DataFrame, kept: Column) -> DataFrame:
    """(rows_in, rows_out, drop_rate): how many rows a filter would keep, from one pass over its input."""
    one = df.agg(F.count("*").alias("rows_in"), count_where(kept).alias("rows_out"))
    return one.select("*", F.round(1.0 - F.try_divide("rows_out", "rows_in"), 6).alias("drop_rate"))


def counts_in_window(df: DataFrame, window: Column, day: Column, names: tuple[str, str] = ("rows", "days")) -> DataFrame:
    """(layer, n): rows and distinct days within a window, in one pass."""
    one = df.filter(window).agg(F.count("*").alias("a"), F.count_distinct(day).alias("b"))
    return one.select(F.expr(f"stack(2, '{names[0]}', a, '{names[1]}', b) AS (layer, n)"))


def cross_layer_sum(silver: DataFrame, gold: DataFrame, trips: str = "trips") -> DataFrame:
    """(silver_rows, gold_trips, diff): rows of the one against summed counts of the other."""
    one = silver.agg(F.count("*").alias("silver_rows")).crossJoin(gold.agg(F.sum(trips).alias("gold_trips")))  # one row each
    return one.select("*", (F.col("silver_rows") - F.col("gold_trips")).alias("diff"))


def summary(raw: DataFrame, silver: DataFrame, gold: DataFrame, conditions: dict[str, str], expected: Sequence[str], trips: str = "trips") -> DataFrame:
    """(category, metric_name, metric_value, metric_rate): reconciliation of the layers, validity of silver by condition
    (with its rate of silver's rows), and drift of silver's columns; one pass over each table."""
    columns = column_drift(silver, expected)
    one = (
        raw.agg(F.count("*").alias("raw"))
        .crossJoin(condition_counts(silver, conditions))
        .crossJoin(gold.agg(F.count("*").alias("gold_rows"), F.coalesce(F.sum(trips), F.lit(0)).alias("trips")))  # one row each
    )
    dropped = F.col("raw") - F.col("n")
    figures = [
        ("reconciliation", "raw_rows", F.col("raw"), None),
        ("reconciliation", "silver_rows", F.col("n"), None),
        ("reconciliation", "drop_rows", dropped, None),
        ("reconciliation", "drop_rate", F.round(F.coalesce(F.try_divide(dropped, F.col("raw")), F.lit(0.0)), 6), None),
        ("reconciliation", "gold_rows", F.col("gold_rows"), None),
        ("reconciliation", "gold_trips", F.col("trips"), None),
        *[("validity", k, F.col(k), F.round(F.coalesce(F.try_divide(F.col(k), F.col("n")), F.lit(0.0)), 6)) for k in conditions],
        ("drift", "missing_columns", F.lit(len(columns["missing"])), None),
        ("drift", "extra_columns", F.lit(len(columns["extra"])), None),
    ]
    rows = [F.struct(F.lit(c).alias("category"), F.lit(m).alias("metric_name"), v.cast("double").alias("metric_value"), (F.lit(None) if r is None else r).cast("double").alias("metric_rate")) for c, m, v, r in figures]
    return one.select(F.inline(F.array(*rows)))
