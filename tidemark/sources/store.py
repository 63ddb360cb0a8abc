"""Tables as versioned folders: a write makes a new version and then points to it, so a table can be read while it is replaced.

A table `layer.name` is the folder `<root>/layer/name` with one folder for each version and a file `_current`
that names the live one (written last, by rename). Readers that began before keep their version until
`vacuum` removes it. Plain Spark writers and readers do the rest; no table format is needed. The root may be any
file system that Spark can reach.

A table may be partitioned by one column of dates or whole numbers. `_current` then names, for each of the column's
values, the folders that hold its rows, so that `replace` writes the values it is given and leaves the files of the
others where they are. That list grows with the number of values (days), not of rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DateType, IntegerType, LongType, ShortType, StructType

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?")
#: The name that Spark gives the folder of null values.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
#: The column that a version's folder stands for beside the partition column; never part of a table.
VERSION = "__version"


def quoted(name: str) -> str:
    """A dotted name with each part in backticks."""
    return ".".join("`" + p.replace("`", "``") + "`" for p in name.split("."))


def schema_difference(now: DataFrame, new: DataFrame) -> list[str]:
    """What differs between two schemas, by name; the order of columns doesn't matter."""
    a, b = ({f.name: f.dataType.simpleString() for f in x.schema.fields} for x in (now, new))
    return [f"missing column {c}" for c in sorted(a.keys() - b.keys())] + [f"extra column {c}" for c in sorted(b.keys() - a.keys())] + [f"{c}: {a[c]} became {b[c]}" for c in sorted(a.keys() & b.keys()) if a[c] != b[c]]


def is_schema_conflict(error: Exception) -> bool:
    """Whether a write failed because of the schemas, by the error's class; the wording of others' messages doesn't count."""
    if isinstance(error, AnalysisException):
        condition = error.getCondition() or ""
        return condition.startswith(("INCOMPATIBLE", "DATATYPE_MISMATCH", "CAST_", "INSERT_COLUMN_ARITY", "UNRESOLVED_COLUMN", "_LEGACY_ERROR_TEMP"))
    return isinstance(error, ValueError) and str(error).startswith("schema of ")


def _value(v: Any) -> str:
    return NULL_FOLDER if v is None else str(v)


@dataclass
class TableStore:
    root: str
    spark: SparkSession

    def _fs(self, path: str) -> tuple[Any, Any]:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def folder(self, table: str) -> str:
        if not NAME.fullmatch(table):
            raise ValueError(f"not a table name: {table!r}")
        return f"{self.root.rstrip('/')}/{table.replace('.', '/')}"

    def _live(self, table: str) -> dict[str, Any] | None:
        """What `_current` says: {version}, or {schema, partition, parts} of a partitioned table."""
        fs, p = self._fs(f"{self.folder(table)}/_current")
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()
        return json.loads(text) if text.startswith("{") else {"version": text}

    def exists(self, table: str) -> bool:
        return self._live(table) is not None

    def partition_of(self, table: str) -> str | None:
        """The column that the table is partitioned by."""
        return (self._live(table) or {}).get("partition")

    def read(self, spark: SparkSession, table: str, only: Sequence[Any] | None = None) -> DataFrame:
        """The live rows; of a partitioned table only those of the given values, where given."""
        live = self._live(table)
        if live is None:
            raise FileNotFoundError(f"no table {table}")
        if "version" in live:
            if only is not None:
                raise ValueError(f"{table} isn't partitioned")
            return spark.read.parquet(f"{self.folder(table)}/{live['version']}")
        schema = StructType.fromJson(live["schema"])
        wanted = live["parts"] if only is None else {v: live["parts"].get(v, []) for v in map(_value, only)}
        paths = [f"{self.folder(table)}/{f}" for folders in wanted.values() for f in folders]
        if not paths:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("basePath", self.folder(table)).parquet(*paths).select(*[f"`{c}`" for c in schema.names])

    def _point(self, table: str, version: str) -> None:
        """Names the live version: a new file takes the old one's place in one step."""
        jvm = self.spark._jvm
        fs, live = self._fs(f"{self.folder(table)}/_current")
        _, fresh = self._fs(f"{self.folder(table)}/_current-{uuid.uuid4().hex}")
        out = fs.create(fresh, True)
        out.write(bytearray(version.encode()))
        out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, live, options)

    def _write_parts(self, table: str, df: DataFrame, by: str) -> dict[str, list[str]]:
        """Writes the rows to a new version's folder; the folders by value."""
        if not isinstance(df.schema[by].dataType, (DateType, ByteType, ShortType, IntegerType, LongType)):
            raise ValueError(f"{table} can be partitioned by a date or a whole number, not by {by}")
        folder = f"{VERSION}=v-{uuid.uuid4().hex}"
        # a day's rows go to few files; adaptive execution splits a day that is too large for a task
        df.hint("rebalance", F.col(f"`{by}`")).write.partitionBy(by).parquet(f"{self.folder(table)}/{folder}")
        fs, p = self._fs(f"{self.folder(table)}/{folder}")
        names = [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith(f"{by}=")}

    def overwrite(self, table: str, df: DataFrame, partition_by: str | None = None, same_schema: bool = False) -> None:
        if same_schema and self.exists(table) and (found := schema_difference(self.read(self.spark, table), df)):
            raise ValueError(f"schema of {table} differs: {found}")
        if partition_by is not None:
            parts = self._write_parts(table, df, partition_by)
            return self._point(table, json.dumps({"schema": df.schema.jsonValue(), "partition": partition_by, "parts": parts}))
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder(table)}/{version}")
        return self._point(table, version)

    def replace(self, table: str, df: DataFrame, values: Sequence[Any]) -> None:
        """The rows take the place of all rows of the given values of the partition column, and must have no other."""
        live = self._live(table)
        if live is None or "partition" not in live:
            raise ValueError(f"{table} isn't partitioned")
        old = StructType.fromJson(live["schema"])
        fresh = self._write_parts(table, df.select(*[f"`{c}`" for c in old.names]), live["partition"])
        gone = set(map(_value, values))
        if other := sorted(fresh.keys() - gone):
            raise ValueError(f"rows of other values of {live['partition']}: {other[:5]}")
        kept = {v: f for v, f in live["parts"].items() if v not in gone}
        self._point(table, json.dumps(live | {"parts": kept | fresh}))

    def append(self, table: str, df: DataFrame, partition_by: str | None = None) -> None:
        """Adds rows to the live version; the first append makes the table."""
        live = self._live(table)
        if live is None:
            return self.overwrite(table, df, partition_by)
        now = self.read(self.spark, table)
        if found := schema_difference(now, df):
            raise ValueError(f"schema of {table} differs: {found}")
        df = df.select(*[f"`{c}`" for c in now.columns])
        if "version" in live:
            df.write.mode("append").parquet(f"{self.folder(table)}/{live['version']}")
            return None
        fresh = self._write_parts(table, df, live["partition"])
        parts = {v: live["parts"].get(v, []) + fresh.get(v, []) for v in live["parts"].keys() | fresh.keys()}
        return self._point(table, json.dumps(live | {"parts": parts}))

    def safe_write(self, table: str, df: DataFrame, mode: str = "overwrite", *, overwrite_schema: bool = False, force_recreate: bool = False, recreate_on_schema_mismatch: bool = False, recreate_on_schema_conflict: bool = False) -> None:
        """A write that never changes a table's schema unless told to: by making the table anew always, where the
        schemas differ, or where the write fails for its schema; or, for an overwrite, by taking the new schema."""
        if mode not in ("overwrite", "append"):
            raise ValueError(f"unsupported mode {mode!r}")
        found = schema_difference(self.read(self.spark, table), df) if self.exists(table) else []
        if force_recreate or (found and recreate_on_schema_mismatch):
            # the pointer moves to the new version in one step; the old files stay until vacuum
            return self.overwrite(table, df)
        try:
            if mode == "append":
                return self.append(table, df)
            return self.overwrite(table, df, same_schema=not overwrite_schema)
        except (AnalysisException, ValueError) as e:
            if recreate_on_schema_conflict and is_schema_conflict(e):
                return self.overwrite(table, df)
            raise

    def write(self, table: str, df: DataFrame, mode: str) -> None:
        if mode not in ("overwrite", "append"):
            raise ValueError(f"unsupported mode {mode!r}")
        (self.overwrite if mode == "overwrite" else self.append)(table, df)

    def drop(self, table: str) -> None:
        fs, p = self._fs(self.folder(table))
        fs.delete(p, True)

    def tables(self) -> list[str]:
        fs, p = self._fs(self.root)
        found = []
        for layer in fs.listStatus(p) if fs.exists(p) else []:
            if layer.isDirectory():
                found += [f"{layer.getPath().getName()}.{t.getPath().getName()}" for t in fs.listStatus(layer.getPath()) if t.isDirectory()]
        return sorted(t for t in found if self.exists(t))

    def vacuum(self, table: str) -> int:
        """Removes the versions, and the partitions of versions, that are no longer live; how many."""
        live = self._live(table) or {}
        keep = {live["version"]} if "version" in live else {f for folders in live.get("parts", {}).values() for f in folders}
        fs, p = self._fs(self.folder(table))
        gone = []
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if not s.isDirectory() or name in keep:
                continue
            inside = [q.getPath() for q in fs.listStatus(s.getPath()) if q.isDirectory()]
            used = [q for q in inside if f"{name}/{q.getName()}" in keep]
            gone += [q for q in inside if q not in used] if used else [s.getPath()]
        for q in gone:
            fs.delete(q, True)
        return len(gone)

    def view(self, name: str, df: DataFrame) -> DataFrame:
        """A view of the session: nothing is written, and each use works the rows out again."""
        if not NAME.fullmatch(name):
            raise ValueError(f"not a view name: {name!r}")
        df.createOrReplaceTempView(name.replace(".", "__"))
        return df
