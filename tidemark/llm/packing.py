"""Packing of token pieces into sequences by a configuration linear program over their lengths.

Only the histogram of lengths (at most `capacity` entries) reaches the driver. The program chooses
how often to use each configuration (a multiset of lengths that fits a sequence); multiplicative
weights raise the price of lengths that lag behind, and a knapsack dynamic program over the capacity
finds the best configurations at these prices, one led by each lagging length. Rounding commits
configurations in order of their weight while pieces of each length last; the program is solved again
for what is left, and a best-fit pass over the last histogram places the rest. The plan is a table
of slots by length, bounded by the configurations, not by the documents; the k-th piece of a length
goes to that length's k-th slot, found by binary search on the executors.

Nulls: a null text is an empty one. An empty text still has its end id, so it is one piece of length 1. A
null document id stays null. Repeated rows are packed each for itself. Pieces of equal length are
told apart by task and order in the task. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, pick, ship, slices, utf8
from tidemark.llm.word_tokens import chunk_encoder

STEPS, ROUNDS = 8, 4
#: How sharply the price of a length falls with its coverage.
RATE = 2.0


def knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value at each capacity and the index of an item to take there (-1: leave one unit free)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            value = best[c - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], take[c] = value[k], k
    return best, take


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[float, dict[int, int]]]:
    """A fractional solution: (weight, {index of length: copies})."""
    covered, found = np.zeros(len(lengths)), {}
    for step in range(1, STEPS + 1):
        done = covered / counts
        prices = lengths / capacity * np.exp(-RATE * (done - done.mean()))
        best, take = knapsack(lengths, prices, capacity)
        fill: list[dict[int, int]] = [{}]  # the best use of each capacity, within the pieces there are
        for c in range(1, capacity + 1):
            k = int(take[c])
            rest = fill[c - int(lengths[k])] if k >= 0 else None
            fill.append(rest | {k: rest.get(k, 0) + 1} if rest is not None and rest.get(k, 0) < counts[k] else fill[c - 1])
        for lead in range(len(lengths) - 1, -1, -1):
            lag = counts[lead] * step / STEPS - covered[lead]
            if lag <= 0:
                continue
            rest = fill[capacity - int(lengths[lead])]
            use = rest | {lead: rest.get(lead, 0) + 1}
            weight = lag / use[lead]
            for k, n in use.items():
                covered[k] += weight * n
            key = tuple(sorted(use.items()))
            found[key] = found.get(key, 0.0) + weight
    return sorted(((w, dict(key)) for key, w in found.items()), key=lambda x: (-x[0], sorted(x[1].items())))


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """The rest, longest first, each to the fullest sequence it fits; equal sequences move together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by free space: groups of equal sequences
    for k in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[k]), int(left[k])
        for free in sorted(f for f in open_ if f >= size):
            groups, kept = open_.pop(free), []
            for many, use in groups:
                fit = free // size
                whole = min(many, n // fit)
                rest = min(n - whole * fit, fit - 1) if whole < many else 0
                for times, copies in ((whole, fit), (1 if rest else 0, rest)):
                    if times:
                        open_.setdefault(free - copies * size, []).append((times, use | {k: use.get(k, 0) + copies}))
                        n -= times * copies
                if idle := many - whole - (1 if rest else 0):
                    kept.append((idle, use))
            if kept:
                open_.setdefault(free, []).extend(kept)
            if not n:
                break
        fit = capacity // size
        if whole := n // fit:
            open_.setdefault(capacity - fit * size, []).append((whole, {k: fit}))
        if rest := n - whole * fit:
            open_.setdefault(capacity - rest * size, []).append((1, {k: rest}))
    return [g for groups in open_.values() for g in groups]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: copies in each}) that use up the histogram exactly."""
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    chosen: dict[tuple, int] = {}
    for _ in range(ROUNDS):
        live = np.flatnonzero(left)
        if not len(live):
            break
        before, now = int((left * lengths).sum()), lengths[live]
        for weight, use in configurations(now, left[live].astype(float), capacity):
            if sum(int(now[k]) * n for k, n in use.items()) < capacity * 0.999:
                continue  # loose ones are left to the next program or the best fit
            times = min(int(np.ceil(weight)), *(int(left[live[k]]) // n for k, n in use.items()))
            if times > 0:
                for k, n in use.items():
                    left[live[k]] -= times * n
                key = tuple(sorted((int(now[k]), n) for k, n in use.items()))
                chosen[key] = chosen.get(key, 0) + times
        if int((left * lengths).sum()) > 0.98 * before:
            break
    out = [(times, dict(key)) for key, times in chosen.items()]
    live = np.flatnonzero(left)
    out += [(times, {int(lengths[live[k]]): n for k, n in use.items()}) for times, use in best_fit(lengths[live], left[live], capacity)]
    return out


def slots(chosen: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, copies in a sequence, first sequence, first offset), by first rank."""
    out: dict[int, list] = {}
    next_rank: dict[int, int] = {}
    sequence = 0
    for times, use in chosen:
        offset = 0
        for size, copies in sorted(use.items(), reverse=True):
            rank = next_rank.get(size, 0)
            out.setdefault(size, []).append((rank, copies, sequence, offset))
            next_rank[size] = rank + times * copies
            offset += size * copies
        sequence += times
    return {size: np.array(rows, np.int64) for size, rows in out.items()}


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): every document's pieces, rank counting those of
    a length within the task. Written to the shared folder, so texts are encoded once."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encoder, seen = TaskContext.get().partitionId(), chunk_encoder(tokenizer_path), [0] * (capacity + 1)
        for b in slices(batches):
            row, out = [], [[] for _ in range(5)]
            for k, coded in enumerate(encoder.encode(utf8(b.column(1)))):
                ids = np.append(np.frombuffer(coded, encoder.dtype), np.uint32(end_id)).astype("<u4")
                for n, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, x in zip(out, (n, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]), strict=True):
                        column.append(x)
                    seen[len(part)] += 1
                    row.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:4]), pa.array([task] * len(row), pa.int32()), pa.array(out[4], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return cut(rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, rank long"))


def pack(parts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to rows of `pieces` (those with length, task and rank)."""
    spark = parts.sparkSession
    counts = parts.groupBy("task", "length").agg((F.max("rank") + 1).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(slots(plan(histogram, capacity)))
    # ranks over all tasks: prefix sums of the tasks' counts, for each length by itself
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select(F.col("task").alias("b_task"), F.col("length").alias("b_length"), F.coalesce(before, F.lit(0)).alias("base"))
    ranked = parts.join(bases, (parts["task"] == bases["b_task"]) & (parts["length"] == bases["b_length"]))
    columns = [c for c in parts.columns if c not in ("task", "rank")]
    ranked = ranked.select(*[parts[c] for c in columns], (parts["rank"] + bases["base"]).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = table.value
        for b in batches:
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(size) else []:
                rows = by_length[int(size[own[0]])]
                first, copies, start, at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                sequence[own] = start + (rank[own] - first) // copies
                offset[own] = at + (rank[own] - first) % copies * size[own]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, cuts documents longer than a sequence, and packs: (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return pack(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity)
