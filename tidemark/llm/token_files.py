"""Token files: flat unsigned integers beside 64-bit document offsets, read by memory map.

A folder holds, for each part, `part-NNNNN.bin` (ids, little-endian, uint16 where the vocabulary
allows, else uint32) and `part-NNNNN.idx` (int64 document ids, one byte each for a null id,
uint64 offsets with one more than the documents, in this order; document ids that aren't whole numbers stand
in `part-NNNNN.txt` instead, one JSON text a line in the order of the documents, and come back as texts), and `manifest.json` with the parts
in order and the prefix sums of their documents and ids: a part's base. Documents stand in
ascending id order (null ids first, equal ids by their text's hash), so a document's place in the
whole is its part's base plus its offset there.

Nulls: a null text has no ids but its end id; a null document id comes back as null. Repeated rows are
repeated documents. An empty table gives a manifest without parts and no rows. Other columns of
the input are ignored.
"""

from __future__ import annotations

import io
import json
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.common import pick, ship, slices, utf8
from tidemark.llm.word_tokens import chunk_encoder

#: Documents that one reading task takes at most.
READ_DOCS = 20_000


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encodes every text, writes the folder, returns its manifest. One shuffle, by ranges of ids.

    A task writes under a name of its own attempt and then moves the file, so a task that is run
    again leaves the same part.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    whole = isinstance(rows.schema["doc_id"].dataType, IntegralType)
    if not whole:
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = chunk_encoder(tokenizer_path)
        dtype = np.dtype(encoder.dtype).newbyteorder("<")
        place, root = _place(folder)
        own, name = f"{root}/.{task.taskAttemptId()}", f"part-{task.partitionId():05d}"
        end = np.array([end_id], dtype).tobytes()
        ids, nulls, lengths, sink, names = [], [], [], None, None
        for b in slices(batches):
            if sink is None:
                place.create_dir(root, recursive=True)
                sink = place.open_output_stream(f"{own}.bin")
                names = None if whole else place.open_output_stream(f"{own}.txt")
            coded = encoder.encode(utf8(b.column(1)))
            sink.write(b"".join(x for c in coded for x in (c, end)))
            lengths.append(np.array([len(c) // dtype.itemsize + 1 for c in coded], np.uint64))
            nulls.append(b.column(0).is_null().to_numpy(zero_copy_only=False))
            if whole:
                ids.append(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            else:
                ids.append(np.zeros(b.num_rows, "<i8"))
                names.write(b"".join(json.dumps(x).encode() + b"\n" for x in b.column(0).to_pylist()))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.concatenate(lengths), dtype=np.uint64)])
        with place.open_output_stream(f"{own}.idx") as f:
            f.write(np.concatenate(ids).tobytes() + np.concatenate(nulls).astype(np.uint8).tobytes() + offsets.astype("<u8").tobytes())
        if names:
            names.close()
        # the index last: a part that has one is whole
        for kind in ("bin", "idx") if whole else ("txt", "bin", "idx"):
            place.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "docs": [len(offsets) - 1], "tokens": [int(offsets[-1])], "dtype": [dtype.str]})

    # one row for each part: bounded by the number of tasks
    parts = sorted(rows.mapInArrow(write, "part long, name string, docs long, tokens long, dtype string").collect())
    bases = {k: [0, *accumulate(p[k] for p in parts)] for k in ("docs", "tokens")}
    manifest = {
        "end_id": end_id,
        "text_ids": not whole,
        "docs": bases["docs"][-1],
        "tokens": bases["tokens"][-1],
        "parts": [p.asDict() | {"first_doc": d, "first_token": t} for p, d, t in zip(parts, bases["docs"], bases["tokens"], strict=False)],
    }
    place, root = _place(folder)
    place.create_dir(root, recursive=True)
    with place.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def _map(place: pafs.FileSystem, path: str, dtype: str, offset: int, count: int) -> np.ndarray:
    """A stretch of a file: memory-mapped where the folder is local to all, else read by range."""
    if isinstance(place, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r", offset, (count,)) if count else np.zeros(0, dtype)
    with place.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * np.dtype(dtype).itemsize, offset), dtype)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32[, ids]) of a folder's documents, read from its files.

    start counts the ids of all documents before it; ids_crc32 is taken over the ids as
    little-endian unsigned 32-bit integers.
    """
    ship(spark)
    place, root = _place(folder)
    with place.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    text_ids = manifest.get("text_ids", False)
    pieces = [(p["name"], p["dtype"], p["docs"], p["first_token"], k, min(READ_DOCS, p["docs"] - k)) for p in manifest["parts"] for k in range(0, p["docs"], READ_DOCS)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = _place(folder)
        for b in batches:
            for name, dtype, docs, base, first, count in zip(*(c.to_pylist() for c in b.columns), strict=True):
                path = f"{root}/{name}"
                ids = _map(place, f"{path}.idx", "<i8", 8 * first, count)
                nulls = _map(place, f"{path}.idx", "<u1", 8 * docs + first, count).astype(bool)
                offsets = np.array(_map(place, f"{path}.idx", "<u8", 9 * docs + 8 * first, count + 1)).astype(np.int64)
                tokens = _map(place, f"{path}.bin", dtype, int(offsets[0]) * np.dtype(dtype).itemsize, int(offsets[-1] - offsets[0]))
                cuts = (offsets - offsets[0]).tolist()
                wide = [tokens[x:y].astype("<u4") for x, y in zip(cuts, cuts[1:], strict=False)] if with_ids else None
                crc = [zlib.crc32(w.tobytes()) for w in wide] if with_ids else [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)]
                if text_ids:
                    with place.open_input_file(f"{path}.txt") as f:
                        lines = islice(io.TextIOWrapper(f, "utf-8", newline="\n"), first, first + count)
                        named = pa.array(list(map(json.loads, lines)), pa.string())
                else:
                    named = pa.array(np.array(ids), mask=nulls)
                out = [named, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([w.astype(np.int64) for w in wide], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    schema = f"doc_id {'string' if text_ids else 'long'}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    source = spark.createDataFrame(pieces, "name string, dtype string, docs long, base long, first long, count long")
    return source.repartition(max(1, len(pieces))).mapInArrow(read, schema)
