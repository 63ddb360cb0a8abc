"""Incremental upsert bounded by a watermark, as joins: late rows out, latest version in, the rest kept."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import count_where, require, same_keys
from tidemark.operators.transforms import latest
from tidemark.sources.store import TableStore, schema_difference


def within_lateness(source: DataFrame, target: DataFrame, watermark: str, days: int) -> DataFrame:
    """Source rows not older than the target's latest day less `days`; all rows if the target has none.
    A null watermark is dropped once the target has one."""
    bound = target.agg(F.date_sub(F.max(watermark).cast("date"), days).alias("__bound"))
    return source.crossJoin(F.broadcast(bound)).filter("__bound IS NULL OR CAST(`" + watermark + "` AS DATE) >= __bound").drop("__bound")  # bound is one row


def merged(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target with the source's rows in place of those of equal key, nulls equal to nulls."""
    kept = target.join(source.select(*keys), same_keys(target, source, list(keys)), "left_anti")
    return kept.unionByName(source)


def upsert_result(target: DataFrame, source: DataFrame, keys: Sequence[str], watermark: str, days: int, ties: Sequence[str] | None = None) -> DataFrame:
    return merged(target, latest(within_lateness(source, target, watermark, days), keys, watermark, ties), keys)


def touched_values(target: DataFrame, source: DataFrame, keys: Sequence[str], by: str) -> list[Any]:
    """Values of the partition column (a list as long as the table has partitions, at most) whose rows an upsert may
    change: the source's own and, where a key can move between partitions, those of the target's rows of these keys."""
    found = source.select(by)
    if by not in keys:
        # only the keys and the partition column are read, and nothing of the target is written for it
        found = found.union(target.join(source.select(*keys), same_keys(target, source, list(keys)), "left_semi").select(by))
    return [r[0] for r in found.distinct().collect()]


def incremental_merge(store: TableStore, source: DataFrame, table: str, keys: Sequence[str], watermark: str, days: int, partition_by: str | None = None) -> dict[str, Any]:
    """Upserts into a stored table; figures of what happened. Nothing is written if no row is left.

    A partitioned table (its first upsert names the column) has only those partitions written that the source's rows
    touch; another is written whole."""
    if not keys or not watermark or days < 0:
        raise ValueError("an upsert needs a key, a watermark and a number of days from 0")
    require(source, [*keys, watermark, *([partition_by] if partition_by else [])], "merge source")
    spark = source.sparkSession
    out: dict[str, Any] = {"max_watermark_target": None, "lower_bound": None}
    target = store.read(spark, table) if store.exists(table) else None
    in_time = F.lit(True)
    if target is not None:
        if found := schema_difference(target, source):
            raise ValueError(f"schemas of merge source and {table} differ: {found}")
        top = target.agg(F.max(watermark).alias("m"), F.date_sub(F.max(watermark).cast("date"), days).alias("b")).first()
        out |= {"max_watermark_target": None if top["m"] is None else str(top["m"]), "lower_bound": None if top["b"] is None else str(top["b"])}
        if top["b"] is not None:
            in_time = F.col(f"`{watermark}`").cast("date") >= F.lit(top["b"])
    rows = latest(source.filter(in_time), keys, watermark).persist()
    try:
        counts = source.agg(F.count("*").alias("rows_source"), count_where(in_time).alias("rows_source_filtered")).first().asDict()
        out |= counts | {"rows_deduped": rows.count(), "rows_rejected_late": counts["rows_source"] - counts["rows_source_filtered"]}
        if out["rows_deduped"]:
            by = store.partition_of(table)
            if target is None:
                store.overwrite(table, rows, partition_by)
            elif by is None:
                store.overwrite(table, merged(target, rows, keys))
            else:
                values = touched_values(target, rows, keys, by)
                out["partitions_written"] = len(values)
                store.replace(table, merged(store.read(spark, table, values), rows, keys), values)
    finally:
        rows.unpersist()
    return out
