"""What the operators share: the cluster's shared folder, cut lineage, shipped code, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and the master is local (as in tests), a temporary folder is set; on a
    cluster an unset folder is an error, as a machine-local one would lose files.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder once; what follows reads it there and never recomputes it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a small intermediate result that one task takes.
TASK_ROWS = 50_000


def compact(df: DataFrame, rows: int) -> DataFrame:
    """df in no more parts than so many rows need, so that a round over few rows costs few tasks and files."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Writes df as Parquet to the shared folder once; what follows reads only the columns it needs there."""
    folder = new_folder(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def discard(*frames: DataFrame) -> None:
    """Deletes the folders of stored frames that nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors, once a session's context."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._tidemark_shipped = True


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so others can't clash with its output."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


#: Bytes of a slice's rows, unless a single row has more.
SLICE_BYTES = 1 << 21


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Small slices of Arrow batches, in rows and in bytes, so that a task holds few texts as Python objects at
    once; what the batch took is given back to the system after it."""
    for batch in batches:
        k = 0
        while k < batch.num_rows:
            n = min(rows, batch.num_rows - k)
            while n > 1 and batch.slice(k, n).nbytes > SLICE_BYTES:
                n //= 2
            yield batch.slice(k, n)
            k += n
        give_back()


def give_back() -> None:
    """Free memory that the worker's allocators hold goes back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def one_thread() -> None:
    """Keeps libraries in a Python worker to the core that Spark gave it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("OMP_NUM_THREADS", "1")


class Kept(dict):
    """Learns what it lacks; of two halves, the one that was filled longer ago goes when the other is full.
    Keys of over `LONG` characters are learnt each time, so the size is bounded."""

    LONG = 256

    def __init__(self, learn: Callable, entries: int):
        self.learn, self.entries, self.older = learn, entries, {}

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.learn(key)
        if len(key) <= self.LONG:
            self[key] = found
        return found
