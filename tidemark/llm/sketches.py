"""Document fingerprints: threshold-scaled sketches of word shingles, in native expressions.

A sketch holds every hash of a text's five-word shingles below a fixed fraction of the hash range. Its
size follows the text's, so it estimates how much of a short text is contained in a very long one,
and the sketch of a union is the union of the sketches. So that short texts are never left with an
empty sketch, one without any hash below the threshold holds its least hash instead (which a union
drops again as soon as another hash is below). Likeness is the part of the smaller sketch that the other holds.

Words are parted by ASCII white space. A text of fewer words than a shingle is one shingle. A null text
counts as empty; a text without words has an empty sketch and the fingerprint ''. Two empty
sketches are alike (1), an empty and another one are not (0). Repeated rows get equal fingerprints. Empty
tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

SHINGLE = 5
#: One in so many hashes is kept.
SCALE = 8
WHITE = "\t\n\x0b\x0c\r "
BUCKETS_PER_TASK = 4
#: Rows read for each range where the ids' quantiles come from a sample.
SAMPLE = 20


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shingle_hashes(words: Column, size: int) -> Column:
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < size, F.array(F.xxhash64(words))).otherwise(many)


def with_sketches(df: DataFrame, scale: int = SCALE, size: int = SHINGLE, **texts: str) -> DataFrame:
    """Adds a sketch (sorted array of long) under each given name, of the text column named.

    The steps stand in projections of their own, so that no array is computed twice.
    """
    least = -(1 << 63) + (1 << 64) // scale
    old = [F.col(f"`{c}`") for c in df.columns if c not in texts]
    at = list(enumerate(texts.items()))
    df = df.select(*old, *[words_of(F.col(f"`{text}`")).alias(f"__w{k}") for k, (_, text) in at])
    df = df.select(*old, *[shingle_hashes(F.col(f"__w{k}"), size).alias(f"__h{k}") for k, _ in at])
    df = df.select(*old, *[F.col(f"__h{k}") for k, _ in at], *[F.filter(f"__h{k}", lambda x: x < least).alias(f"__k{k}") for k, _ in at])
    kept = [F.when(F.size(f"__k{k}") > 0, F.col(f"__k{k}")).when(F.size(f"__h{k}") > 0, F.array(F.array_min(f"__h{k}"))).otherwise(F.col(f"__h{k}")) for k, _ in at]
    return df.select(*old, *[F.array_sort(F.array_distinct(x)).alias(name) for x, (_, (name, _)) in zip(kept, at, strict=True)])


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: its hashes as 16 hex digits each, joined."""
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    smaller = F.least(F.size(a), F.size(b))
    both_empty = F.when(F.greatest(F.size(a), F.size(b)) == 0, 1.0).otherwise(0.0)
    return F.when(smaller == 0, both_empty).otherwise(F.size(F.array_intersect(a, b)) / smaller)


def merge(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    least = -(1 << 63) + (1 << 64) // scale
    both = F.array_union(a, b)
    below = F.filter(both, lambda x: x < least)
    return F.array_sort(F.when(F.size(below) > 0, below).when(F.size(both) > 0, F.array(F.array_min(both))).otherwise(both))


def quantiles(df: DataFrame, id_col: str, n: int) -> tuple[list, int]:
    """Up to n - 1 quantiles of the ids, repeated where an id fills more than one part, and the number of null ids. Of
    ids that aren't whole numbers, they are those of the `SAMPLE` times n rows with the least hashes of their whole
    row: the bound holds at any size, and only the balance of the ranges hangs on them, no result."""
    held = F.col(id_col)
    nulls = F.count_if(held.isNull()).alias("nulls")
    if isinstance(df.schema[id_col].dataType, IntegralType):
        seen = df.agg(F.percentile_approx(held, [k / n for k in range(1, n)], 20 * n).alias("q"), nulls).first()
        return seen["q"] or [], seen["nulls"]
    order = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    ids = sorted(r[0] for r in df.filter(held.isNotNull()).select(held, order.alias("__order")).orderBy("__order").limit(SAMPLE * n).collect())
    return [ids[k * len(ids) // n] for k in range(1, n)] if ids else [], df.agg(nulls).first()["nulls"]


def with_next(df: DataFrame, id_col: str, prepare: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """Adds what `prepare` makes of each row, once a row, and `next_<c>` for each column: its value in the next row by descending id, after the last in the first.

    Rows are dealt to ranges of ids in one shuffle; within a range a window looks ahead, and each range
    also holds the first row of the range below it (one row, found from the ranges' greatest ids), so no
    task sees more than a range. Ranges come from quantiles of the ids, a few for each task. Ids of any type that
    has an order will do. Null ids come last, in order of the hash of their row's other columns, and are dealt to as
    many ranges of that hash; so are the rows of an id that fills more than a range. Other rows of one id are
    in order of the hash of `columns`.
    """
    spark = df.sparkSession
    n = BUCKETS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = F.col(id_col)
    cuts, nulls = quantiles(df, id_col, n)
    kind = df.schema[id_col].dataType.simpleString()
    values = sorted(set(cuts))
    bounds = F.lit(values).cast(f"array<{kind}>") if cuts else F.array().cast(f"array<{kind}>")
    steps = F.lit([1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))])
    # an id that is a quantile more than once fills at least a range
    often = sorted(v for v, k in Counter(cuts).items() if k > 1)
    hot = held.isin(often) if often else F.lit(False)
    by_hash = bool(nulls or often)

    def onward(at: Column, step: Column) -> Column:
        return F.when(at + step > F.size(bounds), at).when(F.get(bounds, at + step - 1) <= held, at + step).otherwise(at)

    # the texts are only read for this where there are null ids or hot ones
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if c != id_col]) if by_hash else F.lit(0).cast("long")
    hash_range = F.shiftright((F.shiftright(tie, 32) + (1 << 31)) * n, 32).cast("int")
    # downwards: the rows above a range's hot id, that id's hashes from the least on, the range below
    width = n + 1 if often else 1
    at = F.aggregate(steps, F.lit(0), onward) * width
    bucket = F.when(held.isNull(), -1 - hash_range).when(hot, at + (n - 1) - hash_range).otherwise(at + (width - 1))
    # the first row of each range, that of the greatest id or the least hash: at most (1 + the hot ids) n rows, 2 n for them all
    pair = F.struct(held.alias("i"), F.bitwise_not(tie).alias("r"))
    # a greatest struct needs sorted rows, so it is only taken where there are hashes
    first = F.max(pair) if by_hash else F.struct(F.max(held).alias("i"), F.lit(-1).cast("long").alias("r"))
    tops = sorted(((r["b"], r["top"]["i"], ~r["top"]["r"]) for r in df.groupBy(bucket.alias("b")).agg(first.alias("top")).collect()), key=lambda x: x[0])
    if not tops:
        return prepare(df).select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    above = [(tops[(k + 1) % len(tops)][0], *top) for k, (_, *top) in enumerate(tops)]
    kinds = {"to_bucket": "int", "top": kind, "top_tie": "long"}
    ghosts = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).cast(kind).alias(c) for x, (c, kind) in zip(row, kinds.items(), strict=True)]) for row in above])))
    own = df.withColumns({"__bucket": bucket, "__ghost": F.lit(False), "__tie": tie})
    sent = df.withColumn("__tie", tie).join(F.broadcast(ghosts), held.eqNullSafe(ghosts["top"]) & (F.col("__tie") == ghosts["top_tie"]))
    sent = sent.withColumns({"__bucket": F.col("to_bucket"), "__ghost": F.lit(True)}).drop(*kinds)
    order = Window.partitionBy("__bucket").orderBy("__ghost", F.col(id_col).desc_nulls_last(), "__tie", F.xxhash64(*columns))
    looked = prepare(own.unionByName(sent)).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    return looked.filter("NOT __ghost").drop("__bucket", "__ghost", "__tie")


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited, sketch, next_sketch): the edited text has its second half replaced from the next one's start."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    seen = with_next(rows, "doc_id", lambda df: with_sketches(df, sketch="text"), ["text", "sketch"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    return seen.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    rows = with_edits(docs, id_col, text_col).withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_sketches(rows, edited_sketch="edited")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
