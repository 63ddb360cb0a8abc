"""N-gram scores from a log-frequency Bloom filter.

Model. P(w|h) = (c(h,w) - D) / c(h) + b(h) P(w), the first part for pairs of the training texts, with
P(w) = (c(w) + 1) / (N + V + 1) and b(h) the probability that discounting leaves over for
history h. A text is its words and one end; the end also stands before the first word.

Store. Every training pair is in the filter, whatever its count and whatever the size of the corpus. Counts are quantised
on a log scale: level j stands for counts from r^(j-1) up to r^j. A key with level q is entered in the filter at
levels 1 to q, and a reader probes levels upwards until one misses. Words have their exact counts and b(h) beside it.

Scale. The filter grows with the corpus, so it has no bound under which it could be broadcast: its segments stay apart.
The texts are cut into slices of about `SLICE` tokens and written once, as numbers of words. A slice sends each of its
distinct pairs once, to the pair's segment, with the count that its training texts have of it: that is what the
segment is built from, and the question that it answers with a level. Words go the same way for their counts. What a
segment gets is bounded by `HOME_BYTES` of text and by one entry a slice for each key, so a pair that fills the corpus costs
no more than the others. All documents are counted and scored whole. Pairs are known by 32 bits of each word's hash,
words by 64.

Nulls: a null text is empty (one end, no words); a null id is treated as the empty string by the split
and comes back null. Repeated rows are counted and scored each for itself. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import pick, ship, slices, stored, utf8

#: No word holds white space, so this can stand for the end.
END = b"\n"
RATIO, DISCOUNT = 1.25, 0.75
BITS_PER_ENTRY, PROBES, SEGMENT_BITS = 12, 6, 1 << 19
WORD, PAIR = range(2)
#: Words that a worker numbers before it starts afresh.
VOCABULARY = 600_000
#: Tokens of a slice, and bytes of text whose keys meet in one task, about.
SLICE, HOME_BYTES = 2_000_000, 16_000_000
SEED = 42
GOLD = 0x9E3779B97F4A7C15
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def salt(k: int) -> np.uint64:
    return np.uint64(GOLD * k & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """What `mix` was given."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def home_of(base: np.ndarray, homes: int) -> np.ndarray:
    """Equal ranges of the keys: what is sorted by key is sorted by home."""
    return ((base >> np.uint64(32)) * np.uint64(homes)) >> np.uint64(32)


class LogFrequencyFilter:
    """Bits in segments; all entries of a key lie in one segment, so segments are built apart."""

    def __init__(self, segments: int, bits: np.ndarray | None = None, size: int = SEGMENT_BITS):
        self.segments, self.bits, self.size = segments, bits, size

    @classmethod
    def of(cls, base: np.ndarray, levels: np.ndarray) -> LogFrequencyFilter:
        """One segment that holds these keys, of the size that their entries need."""
        size = 1 << max(10, int(int(levels.sum()) * BITS_PER_ENTRY - 1).bit_length())
        return cls(1, cls(1, size=size).segment(base, levels), size)

    def home(self, keys: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        base = mix(keys + salt(kind + 1))
        return base, home_of(base, self.segments)

    def places(self, base: np.ndarray, level: int) -> Iterator[np.ndarray]:
        g = mix(base + salt(level + 16))
        at, step = g >> np.uint64(32), (g & LOW) | np.uint64(1)
        for k in range(PROBES):
            yield (at + np.uint64(k) * step) & np.uint64(self.size - 1)

    def segment(self, base: np.ndarray, levels: np.ndarray) -> np.ndarray:
        """The bytes of one segment that holds these keys."""
        flags = np.zeros(self.size, bool)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for p in self.places(base[levels >= level], level):
                flags[p.astype(np.int64)] = True
        return np.packbits(flags, bitorder="little")

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The level of each key, 0 where it isn't kept, by probing upwards."""
        return self.levels_of(*self.home(keys, kind))

    def levels_of(self, base: np.ndarray, home: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros(len(base), np.int64)
        first = np.zeros(len(base), np.uint64) if home is None else home * np.uint64(self.size)
        live, level = np.arange(len(base)), 1
        while len(live):
            own = live
            for k, p in enumerate(self.places(base[live], level)):
                # the first probe goes to all keys, the next ones to those that are still in
                at = (first[live] + p).astype(np.int64) if k == 0 else (first[own] + p[kept]).astype(np.int64)
                hit = ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
                kept = np.flatnonzero(hit) if k == 0 else kept[hit]
                own = own[hit]
            live = own
            out[live] = level
            level += 1
        return out


def level_counts(least: int, top: int = 200) -> np.ndarray:
    """The count that each level stands for: the mean of the whole numbers in its range; none at level 0."""
    low = np.ceil(least * RATIO ** np.arange(top, dtype=float))
    high = np.maximum(low, np.ceil(least * RATIO ** np.arange(1, top + 1, dtype=float)) - 1)
    return np.concatenate([[0.0], (low + high) / 2])


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(RATIO) + 1e-9).astype(np.int64)


class Vocabulary(dict):
    """Numbers the words that a worker meets, with their hashes."""

    def __init__(self):
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.hash = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def number(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers of all texts, an end after each; tokens of each text). The end is number 0."""
        if not self:
            self[END]  # noqa: B018
        split = [t.lower().split() for t in texts]
        sizes = np.array([len(x) + 1 for x in split], np.int64)
        for x in split:
            x.append(END)
        flat = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        if self.new:
            from xxhash import xxh64_intdigest

            h = np.fromiter((xxh64_intdigest(w, SEED) for w in self.new), np.uint64, len(self.new))
            self.hash = np.concatenate([self.hash, h])
            self.new = []
        return flat, sizes


def pair_keys(hashes: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The key of each word with the one before it; an end stands before the first."""
    before = np.concatenate([np.zeros(1, flat.dtype), flat[:-1]])
    return (hashes[before] & HIGH) | (hashes[flat] & LOW)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def squeezed(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def unsqueezed(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def planes(x: np.ndarray) -> np.ndarray:
    """Whole numbers as their lowest bytes, then their next ones and so on: those that are all zero compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unplanes(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data.reshape(8, -1).T).view("<u8").reshape(-1)


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    return squeezed(planes(np.diff(x, prepend=np.uint64(0)) if rising else x))


def unpacked(data: bytes, rising: bool = False) -> np.ndarray:
    x = unplanes(unsqueezed(data, np.uint8))
    return np.cumsum(x, dtype=np.uint64) if rising else x


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the sum of each one's counts, the place of every key among them)."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64), at


#: What goes between slices and segments: keys (rising) and counts, or answers in the order of the keys.
PARCEL = "home int, slice long, kind int, a binary, b binary, c binary"
PARCEL_NAMES = [x.split()[0] for x in PARCEL.split(", ")]
#: Kinds of parcel beside words and pairs.
FOLLOWERS, TYPES, TEXT = 2, 3, 4


def parcels(rows: list[tuple], names: list[str] = PARCEL_NAMES) -> pa.Table:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def by_home(keys: np.ndarray, homes: int) -> Iterator[tuple[int, slice]]:
    """(home, the stretch of the rising keys that lies there)."""
    home = home_of(keys, homes)
    first = np.flatnonzero(np.diff(home, prepend=np.uint64(homes))).tolist()
    for f, t in zip(first, [*first[1:], len(keys)], strict=True):
        yield int(home[f]), slice(f, t)


class Slice:
    """The texts of a slice as numbers of words, with the distinct words and pairs that it asks for, rising."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, hashes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.word_order = np.argsort(hashes)
        self.words = hashes[self.word_order]
        self.pairs, self.pair_at = np.unique(mix(pair_keys(hashes, flat) + salt(PAIR + 1)), return_inverse=True)

    @classmethod
    def read(cls, flat: bytes, sizes: bytes, hashes: bytes) -> Slice:
        return cls(unsqueezed(flat, np.int32), unsqueezed(sizes, np.int64), unsqueezed(hashes, np.uint64))

    def counts(self, training: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and each pair stands in the training texts."""
        weight = np.repeat(training, self.sizes)
        words = np.bincount(self.flat, weight, len(self.words))[self.word_order]
        return words.astype(np.int64), np.bincount(self.pair_at, weight, len(self.pairs)).astype(np.int64)

    def scores(self, n: np.ndarray, histories: np.ndarray, followers: np.ndarray, levels: np.ndarray, whole: int) -> list[np.ndarray]:
        """(known words, base score, score) of each text, from what the segments know of the slice's words and pairs."""
        order = np.argsort(self.word_order)
        n, histories, followers = n[order].astype(float), np.maximum(histories[order], 1), followers[order]
        left = np.where(n > 0, followers * DISCOUNT / histories, 1.0)
        flat, before = self.flat, np.concatenate([np.zeros(1, self.flat.dtype), self.flat[:-1]])
        found = level_counts(1)[levels][self.pair_at]
        plain = (n[flat] + 1.0) / whole
        # a pair that the filter claims of a history never seen is none
        seen = np.where((found > 0) & (n[before] > 0), np.maximum(found - DISCOUNT, 0.0) / np.maximum(n[before], 1.0), 0.0)
        starts = np.cumsum(self.sizes) - self.sizes
        return [np.add.reduceat(x, starts) for x in ((n[flat] > 0).astype(np.int64), np.log10(plain), np.log10(np.minimum(seen + left[before] * plain, 1.0)))]


def cut_into_slices(rows: DataFrame) -> DataFrame:
    """(slice, ids, flat, sizes, words, training, n): every slice's texts as numbers of words; n counts its training tokens.

    Written once, so that all that follows sees the same slices whatever is run again."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, held, size, number = Vocabulary(), [], 0, TaskContext.get().partitionId() << 32

        def out() -> pa.RecordBatch:
            ids = pa.concat_arrays([x[0] for x in held])
            flat, sizes, training = (np.concatenate([x[k] for x in held]) for k in (1, 2, 3))
            blobs = [pa.array([squeezed(x)], pa.binary()) for x in (flat, sizes, known.hash, training)]
            n = int(sizes[training].sum())
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *blobs, pa.array([n])], names=["slice", "ids", "flat", "sizes", "words", "training", "n"])

        for b in slices(batches):
            flat, sizes = known.number(utf8(b.column(1)))
            held.append((b.column(0), flat, sizes, ~b.column(2).to_numpy(zero_copy_only=False)))
            size += len(flat)
            if size > SLICE or len(known) > VOCABULARY:
                yield out()
                known.fresh()
                held, size, number = [], 0, number + 1
        if held:
            yield out()

    asked = rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("out"))
    return stored(asked.mapInArrow(run, f"slice long, ids array<{kind}>, flat binary, sizes binary, words binary, training binary, n long"), "lm-slices")


def ask(texts: DataFrame, homes: int) -> DataFrame:
    """Parcels of each slice's distinct words and pairs to their homes, with their training counts in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                number, flat, sizes, words, training = (b.column(c)[k].as_py() for c in range(5))
                own = Slice.read(flat, sizes, words)
                counts = own.counts(unsqueezed(training, bool))
                for kind, keys, n in ((WORD, own.words, counts[0]), (PAIR, own.pairs, counts[1])):
                    yield from parcels([(home, number, kind, packed(keys[at], True), packed(n[at]), None) for home, at in by_home(keys, homes)]).to_batches()

    return texts.select("slice", "flat", "sizes", "words", "training").mapInArrow(run, PARCEL)


def opened(rows: pa.Table, kind: int) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(slices, keys, counts) of the parcels of a kind."""
    own = rows.filter(pa.compute.equal(rows["kind"], kind))
    return own["slice"].to_pylist(), [unpacked(x, True) for x in own["a"].to_pylist()], [unpacked(x) for x in own["b"].to_pylist()]


def answers(home: int, numbers: list[int], keys: list[np.ndarray], kind: int, at: np.ndarray, *known: np.ndarray) -> list[tuple]:
    """A parcel back to each slice that asked, with what is known of its keys."""
    out, first = [], 0
    for number, x in zip(numbers, keys, strict=True):
        own = at[first : first + len(x)]
        first += len(x)
        out.append((home, number, kind, *[packed(k[own].astype(np.uint64)) for k in known], *[None] * (3 - len(known))))
    return out


def meet_pairs(homes: int):
    """Builds a segment of the filter and answers from it; also sends on how many followers each history has there."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        numbers, keys, counts = opened(rows, PAIR)
        base, n, at = summed(keys, counts)
        present = n > 0
        levels = LogFrequencyFilter.of(base[present], level_of(n[present])).levels_of(base)
        out = answers(key[0].as_py(), numbers, keys, PAIR, at, levels)
        histories, followers = np.unique((unmix(base[present]) - salt(PAIR + 1)) & HIGH, return_counts=True)
        out += [(home, -1, FOLLOWERS, packed(histories[own], True), packed(followers[own]), None) for home, own in by_home(histories, homes)]
        return parcels(out)

    return run


def meet_words(key: tuple, rows: pa.Table) -> pa.Table:
    """Counts words, and tells for each the count of its history and how many followers that has."""
    home = key[0].as_py()
    numbers, keys, counts = opened(rows, WORD)
    words, n, at = summed(keys, counts)
    heads, which = np.unique(words & HIGH, return_inverse=True)
    history = np.bincount(which, n, len(heads)).astype(np.int64)[which] if len(words) else n
    _, met, kinds = opened(rows, FOLLOWERS)
    known, followers, _ = summed(met, kinds)
    place = np.minimum(np.searchsorted(known, words & HIGH), max(len(known) - 1, 0))
    some = known[place] == words & HIGH if len(known) else np.zeros(len(words), bool)
    of_word = np.where(some, followers[place], 0) if len(known) else np.zeros(len(words), np.int64)
    types = int(np.count_nonzero(n)).to_bytes(8)
    return parcels([*answers(home, numbers, keys, WORD, at, n, history - n, of_word), (home, -1, TYPES, types, None, None)])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    ship(spark)
    rows = pick(docs, doc_id=id_col, text=text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # homes send to each other, so there are no more than tasks, unless they would grow too large
    homes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // HOME_BYTES))
    kind = rows.schema["doc_id"].dataType.simpleString()

    texts = cut_into_slices(rows)
    total = texts.agg(F.sum("n")).first()[0] or 0
    asked = ask(texts, homes)
    pairs = stored(asked.filter(F.col("kind") == PAIR).groupBy("home").applyInArrow(meet_pairs(homes), PARCEL), "lm-pairs")
    questions = asked.filter(F.col("kind") == WORD).unionByName(pairs.filter(F.col("kind") == FOLLOWERS))
    words = stored(questions.groupBy("home").applyInArrow(meet_words, PARCEL), "lm-words")
    types = words.filter(F.col("kind") == TYPES).agg(F.sum(F.conv(F.hex("a"), 16, 10).cast("long"))).first()[0] or 0
    whole = total + types + 1

    def finish(key: tuple, rows_: pa.Table) -> pa.Table:
        """The figures of a slice's texts from all its answers."""
        rows_ = rows_.sort_by([("kind", "ascending"), ("home", "ascending")])
        sets = {k: rows_.filter(pa.compute.equal(rows_["kind"], k)) for k in (WORD, PAIR, TEXT)}
        joined = lambda k, c: np.concatenate([unpacked(x) for x in sets[k][c].to_pylist()])
        own = Slice.read(*(sets[TEXT][c][0].as_py() for c in "abc"))
        n = joined(WORD, "a").astype(np.int64)
        figures = own.scores(n, n + joined(WORD, "b").astype(np.int64), joined(WORD, "c"), joined(PAIR, "a").astype(np.int64), whole)
        ids = sets[TEXT]["ids"].combine_chunks()
        ids = (ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids).flatten()
        return pa.table([ids, *map(pa.array, (own.sizes, *figures))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    of_text = texts.select(F.lit(0).alias("home"), "slice", F.lit(TEXT).alias("kind"), F.col("flat").alias("a"), F.col("sizes").alias("b"), F.col("words").alias("c"), "ids")
    known = pairs.filter(F.col("kind") == PAIR).unionByName(words.filter(F.col("kind") == WORD)).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    scored = of_text.unionByName(known).groupBy("slice").applyInArrow(finish, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
