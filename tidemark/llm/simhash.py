"""SimHash near-duplicates: exact links of fingerprints within two bits, by a grid over segment popcounts.

A fingerprint is cut into 16 segments of 4 bits and mapped to their bit counts. The Manhattan distance
of two such vectors is never above the Hamming distance of the fingerprints, so linked fingerprints
lie within 2 on the grid and then share a cell that is within 1 of both: each distinct fingerprint
goes to its own cell and the (up to 32) next to it, and a join on cells finds every candidate. A cell of
two is verified by counting differing bits. In a cell of more, the fingerprints are refined to
segments of one bit: the same join on the fingerprint and its 64 one-bit neighbours, where sharing a
cell already proves a distance of 2 or less, so links to a cell's smallest member suffice and a
cell holds 65 members at most. Neither all pairs of a group nor a large cell is ever built.

Texts that differ in a few words may lie further apart than two bits. `similar` links those whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more. Candidates share a band of `ROWS` minimum hashes over the whole set;
with `BANDS` bands, a pair at 0.8 is missed with a chance of 3 in a million. Two bits of each minimum hash make a signature:
candidates that differ in more than `DIFFER` of its bits are no links (one at 0.8 does with a chance below one in a hundred million). The signature
also has the parities of a set's hashes over `PARITIES` places: sets that differ in d shingles differ in d of these at most, and a
similarity of 0.8 leaves a ninth of both sizes. Each candidate left is verified on the whole sets (shingles by 40 bits of their hashes), which are only made for texts that share a band. `one_of_each` joins both
kinds of links.

Components are taken over distinct fingerprints; documents with one fingerprint share its row.

Nulls: a null text has no words, so its fingerprint is zero, linked like any other. A null document id
never names a component; a component without any other id has a null name. Repeated rows share a
fingerprint. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import compact, cut, pick, ship, slices, stored, utf8
from tidemark.llm.graph import components

SEED, SHINGLE, DISTANCE = 42, 3, 2


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_of(texts: list[bytes], size: int) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text."""
    from xxhash import xxh64_intdigest

    hashes, ends, total = [], [], 0
    for text in texts:
        words = text.lower().split()
        if len(words) < size:
            shingles = [b" ".join(words)] if words else []
        elif size == 3:
            spaced = [w + b" " for w in words]
            shingles = [a + b + c for a, b, c in zip(spaced, spaced[1:], words[2:], strict=False)]
        else:
            shingles = [b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
        hashes.append(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))
        total += len(shingles)
        ends.append(total)
    ends_ = np.array(ends, np.int64)
    bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sizes = np.diff(ends_, prepend=0)
    set_ = np.zeros((len(texts), 64), np.int64)
    if some := np.flatnonzero(sizes).tolist():
        set_[some] = np.add.reduceat(bits, (ends_ - sizes)[some], axis=0, dtype=np.int64)
    over = 2 * set_ > sizes[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of every row, fp as a signed long. No shuffle."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprint_of(utf8(b.column(1)), size).astype(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _counts(fp: Column) -> Column:
    """Bit counts of the sixteen 4-bit segments, each in its own four bits (no sum carries out of them)."""
    fives, threes = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    high, low = F.shiftrightunsigned(fp, 1).bitwiseAND(fives), fp.bitwiseAND(fives)
    pairs = high.bitwiseXOR(low).bitwiseOR(F.shiftleft(high.bitwiseAND(low), 1))
    return F.shiftrightunsigned(pairs, 2).bitwiseAND(threes) + pairs.bitwiseAND(threes)


def _cells(counts: Column) -> Column:
    """The vector's own cell and those next to it on the grid; a count stays within 0 and 4."""
    cells = [counts]
    for k in range(0, 64, 4):
        own = F.shiftrightunsigned(counts, k).bitwiseAND(F.lit(15).cast("long"))
        for by, inside in ((1, own < 4), (-1, own > 0)):
            cells.append(F.when(inside, counts.bitwiseXOR(F.shiftleft(own.bitwiseXOR(own + by), k))))
    return F.array_compact(F.array(*cells))


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) with a < b: links among distinct fingerprints `fp` that connect just those linked within two bits."""
    cells = nodes.select("fp", _counts(F.col("fp")).alias("v")).select("fp", F.explode(_cells(F.col("v"))).alias("cell"))
    met = cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1")
    met = cut(met)
    pairs = met.filter((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    crowded = met.filter("n > 2").select("cell")
    some = cells.join(crowded, "cell", "left_semi").select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    fine = some.select("fp", F.explode(flips).alias("cell"))
    stars = fine.select("fp", F.min("fp").over(Window.partitionBy("cell")).alias("a")).filter("fp > a")
    return pairs.unionByName(stars.select("a", F.col("fp").alias("b"))).distinct()


def classes(prints: DataFrame) -> DataFrame:
    """(fp, root): every distinct fingerprint of rows with fp and the smallest one of its component."""
    nodes = cut(prints.select("fp").distinct())
    roots = components(links(nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: 16 hex digits, and the component's smallest document id."""
    prints = cut(fingerprints(docs, id_col, text_col, size))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    by_print = classes(prints).join(first, "fp")
    named = by_print.groupBy("root").agg(F.min("first").alias("component_id"))
    table = by_print.select("fp", "root").join(named, "root").select(F.col("fp").alias("k"), "component_id")
    return prints.join(table, prints["fp"] == table["k"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Minimum hashes in a band, and bands; (1 - 0.8^5)^32 is 3e-6.
ROWS, BANDS = 5, 32
#: Longs of a signature, 64 bits each: first two bits of every minimum hash (at a similarity of 0.8, 32 differ on average,
#: deviation 6.5), then the parities.
LONGS, DIFFER, PARITIES = 5, 76, 1024
#: Bytes of a shingle's hash in a set.
SET_BYTES = 5
#: All pairs of a band of so many texts are taken at once; how fast the texts that the others are compared with grow in number.
FEW, GROWTH = 8, 16
#: Keys (of 16 bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows that a pair to be verified counts as.
PAIR_WEIGHT = 50


def sets_of(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    from xxhash import xxh64_intdigest

    out = []
    for text in texts:
        words = text.lower().split()
        shingles = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
        out.append(np.unique(h & np.uint64((1 << 8 * SET_BYTES) - 1)))
    return out


def bands_of(sets: list[np.ndarray]) -> tuple[list[list[int]], list[list[int]]]:
    """The bands of each set, as signed numbers that also tell which band it is, and its signature; none for an empty set."""
    some = [k for k, h in enumerate(sets) if len(h)]
    bands: list[list[int]] = [[] for _ in sets]
    signs: list[list[int]] = [[0] * (LONGS + PARITIES // 64) for _ in sets]
    if not some:
        return bands, signs
    rng = np.random.default_rng(SEED)
    xor, times = rng.integers(0, 1 << 32, (2, ROWS * BANDS), np.uint32)
    h = np.concatenate([sets[k] for k in some])
    h = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    sizes = np.array([len(sets[k]) for k in some])
    starts = np.cumsum(sizes) - sizes
    key = np.zeros((len(some), BANDS), np.uint64)
    sign = np.zeros((len(some), LONGS), np.uint64)
    for k in range(ROWS * BANDS):
        x = (h ^ xor[k]) * (times[k] | np.uint32(1))
        x ^= x >> np.uint32(15)
        least = np.minimum.reduceat(x * np.uint32(0x2C1B3C6D), starts).astype(np.uint64)
        band = k // ROWS
        key[:, band] = (key[:, band] ^ (least + np.uint64(band + 1))) * np.uint64(0x9E3779B97F4A7C15)
        key[:, band] ^= key[:, band] >> np.uint64(29)
        sign[:, 2 * k // 64] |= (least & np.uint64(3)) << np.uint64(2 * k % 64)
    odd = np.bincount(np.repeat(np.arange(len(some)), sizes) * PARITIES + (h >> np.uint32(3)) % np.uint32(PARITIES), minlength=len(some) * PARITIES) & 1
    parities = np.packbits(odd.astype(bool), bitorder="little").view("<u8").reshape(len(some), -1)
    sign = np.concatenate([sign, parities], axis=1)
    for k, row, bits in zip(some, key.astype(np.int64).tolist(), sign.astype(np.int64).tolist(), strict=True):
        bands[k], signs[k] = row, bits
    return bands, signs


def alike(n: tuple[str, str], sign: tuple[str, str]) -> Column:
    """Whether sizes and signatures leave a similarity of 0.8 open."""
    differ = [F.bit_count(F.get(sign[0], F.lit(k)).bitwiseXOR(F.get(sign[1], F.lit(k)))) for k in range(LONGS + PARITIES // 64)]
    add = lambda x: reduce(operator.add, x)
    sizes = 5 * F.least(*n) >= 4 * F.greatest(*n)
    return sizes & (add(differ[:LONGS]) <= DIFFER) & (9 * add(differ[LONGS:]) <= F.col(n[0]) + F.col(n[1]))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, ok) of pairs (a, b): whether the Jaccard similarity of their whole sets (id, shingles) is 0.8 or more."""
    one, other = (sets.select(F.col("id").alias(k), F.col("shingles").alias(f"of_{k}")) for k in ("a", "b"))
    met = pairs.join(one, "a").join(other, "b").select("a", "b", "of_a", "of_b")

    def wide(data: bytes) -> np.ndarray:
        out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
        out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
        return out.view("<u8").reshape(-1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(wide(x), wide(y), assume_unique=True))
                ok.append(5 * both >= 4 * ((len(x) + len(y)) // SET_BYTES - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return met.mapInArrow(run, "a long, b long, ok boolean")


def similar(dealt: DataFrame, known: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links that connect just those ids whose sets have a similarity of 0.8 or more and share a band.

    dealt has rows (id, part), each id's distinct bands, known has (id, n, sign), the size of its set and its signature; sets gives
    (id, shingles) for a table of ids.
    In rounds, a band's texts are compared with one of them, the one that shares the most bands, later with `GROWTH`
    times as many in each round, first those that the fewest texts of the band are linked with; these then leave the
    band. A band is done when all its texts are linked with each other, over whatever others. So every pair that shares a band is either
    verified or already linked, while a group of copies costs its own number of rows.
    """
    several = dealt.groupBy("part").agg(F.count("*").alias("m")).filter("m > 1").select("part")
    shared = cut(dealt.join(several, "part", "left_semi").select("id", "part"))
    rows = shared.count()
    shared = compact(shared, rows)
    degrees = shared.groupBy("id").agg(F.count("*").alias("degree"))
    of_id = cut(compact(known.join(degrees, "id"), rows))
    held = stored(sets(of_id.select("id")), "sets")
    live = cut(compact(shared.join(of_id, "id"), rows).select("id", "n", "sign", "part", "degree", F.col("id").alias("label")))
    found = judged = live.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    columns, centres_each = ["id", "n", "sign", "part", "degree"], 1
    second = ["part", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "sign", "label")]]
    while True:
        open_ = live.groupBy("part").agg(F.count("*").alias("m"), F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("part", "m")
        live = cut(compact(live.join(open_, "part"), rows))
        rows = live.count()
        if not rows:
            return found
        live = compact(live, rows)
        few, many = live.filter(F.col("m") <= FEW), live.filter(F.col("m") > FEW)
        groups = compact(many.groupBy("part", "label").agg(F.count("*").alias("size")), rows)
        order = Window.partitionBy("part").orderBy("size", F.desc("degree"), "id")
        ranked = many.join(groups, ["part", "label"]).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= centres_each)
        centres = cut(compact(ranked.select(second), rows))
        met = few.join(few.select(second), "part").filter("id < id2").unionByName(many.join(centres, "part").filter("id != id2"))
        met = met.filter((F.col("label") != F.col("label2")) & alike(("n", "n2"), ("sign", "sign2"))).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
        met = cut(met.join(judged, ["a", "b"], "left_anti"))
        n = met.count()
        # a pair meets two whole sets, so a task takes fewer pairs than other rows; what is left of a pair is small again
        fresh = compact(cut(compact(verified(compact(met, n), held), PAIR_WEIGHT * n)), n)
        judged = judged.unionByName(fresh.filter("NOT ok").select("a", "b"))
        found = found.unionByName(fresh.filter("ok").select("a", "b"))
        live = many.join(centres.select("part", F.col("id2").alias("id")), ["part", "id"], "left_anti").select(*columns, "label")
        if many.isEmpty():
            return found
        roots = components(found)
        live = cut(compact(live.drop("label").join(roots, live["id"] == roots["node"], "left").select(*columns, F.coalesce("root", "id").alias("label")), rows))
        centres_each *= GROWTH


def bounded(keys: DataFrame) -> DataFrame:
    """Keys to be joined with, marked for broadcast if there are few."""
    keys = cut(keys)
    n = keys.count()
    return F.broadcast(compact(keys, n)) if n <= BROADCAST_KEYS else keys


def unused(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, part_size: int = 5) -> DataFrame:
    """The rows of docs, all columns, less all but one of each component of both kinds of links: the one with the
    smallest id (null ids last, then the smallest hash of the text; of rows equal in both, any one)."""
    ship(docs.sparkSession)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    row = F.struct(id_.isNull().alias("last"), id_.alias("id"), F.xxhash64(text).alias("text"))
    rows = docs.select(row.alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def prints_and_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            texts = utf8(b.column(1))
            sets = sets_of(texts, part_size)
            bands, signs = bands_of(sets)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fingerprint_of(texts, size).astype(np.int64)), pa.array([name_of(h) for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), pa.array(bands, longs), pa.array(signs, longs)],
                names=["row", "fp", "set", "n", "parts", "sign"],
            )

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            sets = sets_of(utf8(b.column(1)), part_size)
            blobs = [h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(h) for h in sets], pa.int64()), pa.array(blobs, pa.binary())], names=["id", "shingles"])

    seen = stored(rows.mapInArrow(prints_and_bands, f"row {kind}, fp long, set long, n long, parts array<long>, sign array<long>"), "prints")
    nodes = cut(seen.groupBy("fp").agg(F.min("row").alias("row")))
    # texts with one set are one in the search, and all their fingerprints are linked
    by_set = stored(seen.groupBy("set").agg(F.min("fp").alias("a"), F.max("fp").alias("last"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("parts").alias("parts"), F.first("sign").alias("sign")), "sets")
    several = by_set.filter("a < last AND n > 0").select("set", "a")
    same = seen.select("set", "fp").join(several, "set").filter("fp > a").select("a", F.col("fp").alias("b")).distinct()

    def sets(ids: DataFrame) -> DataFrame:
        """The sets of some texts, made anew from one text of each."""
        wanted = bounded(by_set.join(ids, by_set["set"] == ids["id"], "left_semi").select(F.xxhash64("row").alias("key")))
        return rows.join(wanted, F.xxhash64("row") == wanted["key"], "left_semi").mapInArrow(whole_sets, "id long, shingles binary").dropDuplicates(["id"])

    dealt = by_set.select(F.col("set").alias("id"), F.explode(F.array_distinct("parts")).alias("part"))
    found = similar(dealt, by_set.select(F.col("set").alias("id"), "n", "sign"), sets)
    prints = cut(by_set.join(found.select(F.explode(F.array("a", "b")).alias("set")).distinct(), "set", "left_semi").select("set", "a"))
    one, other = (prints.select(F.col("set").alias(k), F.col("a").alias(f"fp_{k}")) for k in ("a", "b"))
    near = found.join(one, "a").join(other, "b").select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    roots = components(links(nodes.select("fp")).unionByName(near).unionByName(same))
    by_print = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "row", F.coalesce("root", "fp").alias("root"))
    chosen = by_print.groupBy("root").agg(F.min("row").alias("chosen"))
    of_print = by_print.join(chosen, "root").select("fp", "chosen")
    gone = seen.select("row", "fp").join(of_print, "fp").filter(F.col("row") != F.col("chosen")).select(F.xxhash64("row").alias("key")).distinct()
    gone, key = bounded(gone), unused(docs, "row_key")
    kept = docs.withColumn(key, F.xxhash64(row))
    kept = kept.join(gone, kept[key] == gone["key"], "left_anti")
    if not seen.groupBy("row").count().filter("count > 1").isEmpty():  # rows that repeat, so one key has several
        kept = kept.dropDuplicates([key])
    return kept.drop(key)


def name_of(shingles: np.ndarray) -> int:
    """A set's name: a hash of all it holds."""
    from xxhash import xxh64_intdigest

    return _signed(xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED))
