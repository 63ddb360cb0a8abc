"""Session factory and input resolution."""

from __future__ import annotations

import json
import logging
import re
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import in_month
from tidemark.operators.transforms import normalise


#: A place that has a file system's name before it.
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]+:/")


def session(name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, and nothing that ties the session to one machine unless a master is given."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def input_name(year: int, month: int) -> str:
    return f"yellow_tripdata_{year:04d}-{month:02d}.parquet"


def resolve_input(root: str | Path, explicit: str | None = None, year: int | None = None, month: int | None = None) -> str | Path:
    """The given file, or the month's under the root; it must exist and hold something. A place with a scheme
    (hdfs://, s3a://, file:/) is left to Spark, which fails if nothing is there."""
    if explicit:
        if SCHEME.match(explicit):
            return explicit
        candidates = [Path(explicit)]
    elif year and month:
        name = input_name(year, month)
        if SCHEME.match(str(root)):
            return f"{str(root).rstrip('/')}/{name}"
        candidates = [Path(root) / name, Path(root) / "data" / "raw" / name]
    else:
        raise ValueError("give a file, or a year and a month")
    for p in candidates:
        if p.exists() and (p.is_dir() or p.stat().st_size):
            return p
    raise FileNotFoundError(f"no input file; looked at {', '.join(map(str, candidates))}. Put the month's parquet there, or name a file.")


def raw_rows(spark: SparkSession, path: str, pickup: str = "tpep_pickup_datetime", year: int | None = None, month: int | None = None) -> DataFrame:
    """The file's rows of the month, typed, with where and from when they are (each file of a folder has its own)."""
    read = spark.read.parquet(str(path))
    columns = [c for c in read.columns if c not in ("ingest_ts", "source_file")]
    df, _ = normalise(read.select(*[F.col(f"`{c}`") for c in columns], F.col("_metadata.file_modification_time").alias("ingest_ts"), F.lit(str(path).rstrip("/").rpartition("/")[2]).alias("source_file")))
    kept = df.filter(in_month(pickup, year, month, "timestamp"))
    return kept.select("ingest_ts", "source_file", *[f"`{c}`" for c in columns])


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        extra = getattr(record, "fields", {})
        return json.dumps({"ts": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname, "event": record.getMessage(), **extra}, sort_keys=True, default=str)


def log_to(path: str | Path) -> logging.Logger:
    """A logger that writes a JSON object a line."""
    logger = logging.getLogger(f"tidemark.{path}")
    if not logger.handlers:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handler = logging.FileHandler(path)
        handler.setFormatter(JsonLines())
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return logger
