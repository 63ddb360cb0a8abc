"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Law `bytes`: the shards' sizes come out near equal. Documents with equal texts form a group that stays
together, unless the group alone is larger than a shard should be; such a group (there are at most as
many as shards) is cut into pieces of whole documents, each no larger than a shard.

Differencing keeps partial partitions, each a vector of shard sums, and always joins the two with the
largest spread, one in falling and one in rising order, until one is left. It runs by layers of size: on
the driver over the heavy pieces alone, then in each task over the task's groups together with its share of
the imbalance that heavier layers left, and on the driver once more over the tasks' vectors. A layer's pieces are
those above a small part of a share of a shard in a task of the next layer. The driver's layer is cut for `FIRST`
tasks at most, so its pieces are bounded by the shards, however many tasks there are; where the session has more tasks,
a layer of `FIRST` tasks stands between. Only vectors of shard sums travel; groups stay where they are.

Sizes are UTF-8 bytes plus a constant for each document. Nulls: a null text has no bytes and is in a
group with the empty ones; a null document id stays null. Repeated rows are each placed. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, pick, ship

OVERHEAD = 8
#: Pieces above this part of a task's share of a shard are placed before the task's own.
HEAVY = 0.25
#: Tasks that the driver's layer is cut for; it holds `shards * FIRST / HEAVY` pieces at most, beside the cuts.
FIRST = 256


def difference(vectors: list[list[int]], shards: int) -> tuple[list[int], list[list[int]]]:
    """Joins partial partitions into one. Returns the sums, and for each vector which shard its k-th entry goes to.

    A number to be placed is the vector (number, 0, ..., 0); shorter vectors are filled with zeros.
    """
    flat = range(shards)
    heap, children, place = [], [], []
    for k, v in enumerate(vectors):
        v = list(v) + [0] * (shards - len(v))
        order = sorted(flat, key=v.__getitem__, reverse=True)
        sums = [v[i] for i in order]
        children.append((k, -1))
        place.append(order)  # position in the sorted vector -> entry of the original
        heap.append((sums[-1] - sums[0], k, sums))
    if not heap:
        return [0] * shards, []
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        joined = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(flat, key=joined.__getitem__, reverse=True)
        sums = [joined[i] for i in order]
        children.append((a, b))
        place.append(bytes(order) if shards <= 256 else order)
        heapq.heappush(heap, (sums[-1] - sums[0], len(children) - 1, sums))
    total, out = heap[0][2], [[] for _ in vectors]
    stack = [(heap[0][1], list(flat))]
    while stack:
        node, shard_of = stack.pop()
        a, b = children[node]
        entry = [0] * shards
        for position, old in enumerate(place[node]):
            entry[old] = shard_of[position]
        if b < 0:
            out[node] = entry
        else:
            stack += [(a, entry), (b, entry[::-1])]
    return total, out


def sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, text_crc32, key, task), written once: the key tells equal texts, task the part a row is in."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    return cut(rows.select("doc_id", (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"), F.spark_partition_id().alias("task")))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot is gapless from 0 in each shard."""
    spark = docs.sparkSession
    ship(spark)
    rows = sized(docs, id_col, text_col)
    groups = cut(rows.groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size")))
    total = groups.agg(F.sum(F.col("n") * F.col("size"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = -(-total // shards) or 1
    layers = [tasks] if tasks <= FIRST else [FIRST, tasks]
    floors = [max(1, int(HEAVY * total / (shards * t))) for t in layers]
    heavy_from = floors[0]

    # heavy groups, cut into pieces no larger than a shard: at most shards * FIRST / HEAVY of them, plus the cuts
    heavy = groups.filter(F.col("n") * F.col("size") >= heavy_from).sort("key").collect()
    per_piece = {bytes(g["key"]): max(1, most // g["size"]) for g in heavy}
    pieces = [(bytes(g["key"]), k, min(per, g["n"] - k * per) * g["size"]) for g in heavy for per in [per_piece[bytes(g["key"])]] for k in range(-(-g["n"] // per))]
    loads, places = difference([[p[2]] for p in pieces], shards)
    heavy_shards: dict[bytes, list[int]] = {}
    for (key, _, _), at in zip(pieces, places, strict=True):
        heavy_shards.setdefault(key, []).append(at[0])

    # where a cut group's rows begin in each task: tasks * shards counts at most
    divided = [k for k, at in heavy_shards.items() if len(at) > 1]
    begin: dict[tuple[int, bytes], int] = {}
    if divided:
        at_task = rows.filter(F.col("key").isin([bytearray(k) for k in divided])).groupBy("task", "key").count()
        upto = dict.fromkeys(divided, 0)
        for r in sorted(at_task.collect(), key=lambda r: r["task"]):
            key = bytes(r["key"])
            begin[r["task"], key] = upto[key]
            upto[key] += r["count"]
    known = spark.sparkContext.broadcast((heavy_shards, per_piece, begin))

    def place_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (at, per, begin), seen = known.value, {}
        for b in batches:
            out = []
            for key, task in zip(b.column("key").to_pylist(), b.column("task").to_pylist(), strict=True):
                found = at.get(key)
                if found is not None and len(found) > 1:
                    rank = begin[task, key] + seen.get(key, 0)
                    seen[key] = seen.get(key, 0) + 1
                    out.append(found[rank // per[key]])
                else:
                    out.append(found and found[0])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "shard"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    tagged = rows.mapInArrow(place_heavy, f"doc_id {kind}, size long, text_crc32 long, key binary, task int, shard int")

    # the rest, layer by layer; in the last one every group is placed
    weight = F.col("n") * F.col("size")
    placed = []
    for k, ceiling in enumerate(floors):
        own = groups.filter(weight < ceiling)
        if k + 1 < len(floors):
            own = own.filter(weight >= floors[k + 1]).repartition(layers[k], "key")
        else:
            own = own.repartition("key")
        rest = total - sum(loads) if k + 1 == len(floors) else own.agg(F.sum(weight)).first()[0] or 0
        units, loads = place_layer(own, loads, rest, shards)
        placed.append(units)
    named = placed[0]
    for more in placed[1:]:
        named = named.unionByName(more)
    plain = tagged.filter("shard IS NULL")
    light_rows = plain.join(named, plain["key"] == named["k"]).select("doc_id", "size", "text_crc32", F.col("light_shard").alias("shard"))
    return with_slots(light_rows.unionByName(tagged.filter("shard IS NOT NULL").select("doc_id", "size", "text_crc32", "shard")))


def place_layer(groups: DataFrame, loads: list[int], rest: int, shards: int) -> tuple[DataFrame, list[int]]:
    """(k, light_shard) of each group, and the shards' loads with them; `rest` is the groups' size in all. Every task
    levels its own share of what the loads have uneven."""
    spark = groups.sparkSession
    low = min(loads)
    uneven = [x - low for x in loads]

    def place_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found)
        sizes = (table["n"].to_numpy() * table["size"].to_numpy()).tolist()
        share = [x * sum(sizes) // rest for x in uneven]
        sums, at = difference([share, *([s] for s in sizes)], shards)
        # the share's own entries tell which shard is which
        shard_of = dict(zip(at[0], range(shards), strict=True))
        out = pa.array([shard_of[x[0]] for x in at[1:]], pa.int32())
        yield pa.RecordBatch.from_arrays([table["key"].combine_chunks(), pa.array(sizes, pa.int64()), pa.array([TaskContext.get().partitionId()] * len(sizes), pa.int32()), out], names=["key", "bytes", "task", "local"])

    units = cut(groups.mapInArrow(place_rest, "key binary, bytes long, task int, local int"))
    # a vector of shard sums for each task
    sums: dict[int, list[int]] = {}
    for r in units.groupBy("task", "local").agg(F.sum("bytes").alias("bytes")).collect():
        sums.setdefault(r["task"], [0] * shards)[r["local"]] = r["bytes"]
    # tasks' vectors may be turned among shards that the heavier pieces load alike
    turn = {t: list(range(shards)) for t in sums}
    for load in set(loads):
        own = [k for k in range(shards) if loads[k] == load]
        if len(own) > 1:
            order = sorted(sums)
            _, at = difference([[sums[t][k] for k in own] for t in order], len(own))
            for t, to in zip(order, at, strict=True):
                for k, j in zip(own, to, strict=True):
                    turn[t][k] = own[j]
    after = list(loads)
    for t, row in turn.items():
        for k, to in enumerate(row):
            after[to] += sums[t][k]
    turns = spark.createDataFrame([(t, k, to) for t, row in turn.items() for k, to in enumerate(row)], "t int, l int, light_shard int")
    named = units.join(F.broadcast(turns), (units["task"] == turns["t"]) & (units["local"] == turns["l"])).select(F.col("key").alias("k"), "light_shard")
    return named, after


def with_slots(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0: prefix sums of the tasks' counts, then a count within the task.
    The rows are written with the task they are in, so that both passes see the same."""
    spark = rows.sparkSession
    placed = cut(rows.withColumn("task", F.spark_partition_id()))
    base: dict[tuple[int, int], int] = {}
    upto: dict[int, int] = {}
    for r in sorted(placed.groupBy("task", "shard").count().collect(), key=lambda r: r["task"]):
        base[r["task"], r["shard"]] = upto.get(r["shard"], 0)
        upto[r["shard"]] = upto.get(r["shard"], 0) + r["count"]
    known, columns = spark.sparkContext.broadcast(base), rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto: dict[int, int] = {}
        for b in batches:
            shard = b.column("shard").to_numpy()
            slot = np.zeros(len(shard), np.int64)
            task = b.column("task")[0].as_py() if len(shard) else None
            for s in np.unique(shard).tolist():
                own = shard == s
                n = int(own.sum())
                first = upto.get(s, known.value[task, s])
                slot[own] = np.arange(first, first + n)
                upto[s] = first + n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(slot)], names=[*columns, "slot"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return placed.mapInArrow(number, f"{kinds}, slot long")
