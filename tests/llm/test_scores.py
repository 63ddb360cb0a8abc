"""Language-model scores, compression bands, shards and licences against plain versions."""

from __future__ import annotations

import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import licences, lm, quality, queries, sharding

words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def check_scores(rows, texts, tolerance):
    split = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    token = [(d, [*words_of(lower(t)), "\n"]) for d, t in texts]
    counts, pair = Counter(), Counter()
    for d, w in token:
        if not split(d):
            counts.update(w)
            pair.update(zip(["\n", *w], w, strict=False))
    total, kinds = sum(counts.values()), len(counts)
    mass = Counter()
    for (h, _), n in pair.items():
        mass[h] += n - lm.DISCOUNT
    whole = total + kinds + 1

    def p(h, w):
        left = 1 - mass[h] / counts[h] if counts[h] else 1.0
        seen = max(pair[h, w] - lm.DISCOUNT, 0) / counts[h] if counts[h] else 0.0
        return seen + left * (counts[w] + 1) / whole

    want = defaultdict(list)
    for d, w in token:
        base = sum(math.log10((counts[x] + 1) / whole) for x in w)
        want[d, len(w), sum(counts[x] > 0 for x in w), round(base, 4)].append(sum(math.log10(p(h, x)) for h, x in zip(["\n", *w], w, strict=False)))
    assert len(rows) == len(texts)
    off = []
    for r in rows:
        assert r["train_tokens"] == total and r["held_out"] == split(r["doc_id"])
        scores = want[r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)]
        off.append(min(abs(s - r["score"]) / abs(s) for s in scores))
    assert np.mean(off) < tolerance
    return rows


def test_scores_of_table(docs):
    rows = check_scores(lm.score(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 0.03)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_scores_of_awkward_rows(small, nothing):
    check_scores(lm.score(small).collect(), [(r["doc_id"], r["text"]) for r in small.collect()], 0.1)
    assert lm.score(nothing).count() == 0


def test_filter_keeps_all_levels():
    rng = np.random.default_rng(1)
    keys, levels = rng.integers(0, 1 << 63, 4000).astype(np.uint64), rng.integers(1, 9, 4000)
    store = lm.LogFrequencyFilter(1)
    base, home = store.home(keys, lm.PAIR)
    store = lm.LogFrequencyFilter(1, store.segment(base, levels))
    found = store.levels(keys, lm.PAIR)
    assert (found >= levels).all() and (found > levels).mean() < 0.05 and not home.any()
    assert (store.levels(rng.integers(0, 1 << 63, 4000).astype(np.uint64), lm.PAIR) > 0).mean() < 0.05


def plain_figures(text):
    text = text or ""
    words = words_of(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(k, k + 5))
    lines, past, dup = text.split("\n"), set(), 0
    for x in lines:
        if words_of(x):
            dup += x in past
            past.add(x)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_figures(docs, small, nothing):
    for df in (docs, small):
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.verdicts(df).collect())
        assert got == Counter((r["doc_id"], *plain_figures(r["text"])) for r in df.collect())
    assert quality.verdicts(nothing).count() == 0
    assert quality.keep(nothing).columns == nothing.columns


def test_quality_bands(docs):
    judge = quality.Judge()
    noise = np.random.default_rng(0).integers(33, 126, 6000).astype(np.uint8).tobytes()
    spaced = b" ".join(noise[k : k + 9] for k in range(0, 6000, 9))
    assert not judge(spaced)[-1] and not judge(b"ab cd ef gh " * 500)[-1]
    for r in quality.verdicts(docs).collect():
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in quality.keep(docs).collect()}
    assert kept == {r["doc_id"] for r in quality.verdicts(docs).collect() if r["kept"]}
    text = docs.filter("length(text) > 9000").first()["text"].encode()
    size = len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(text)) / len(text)
    assert judge(text)[6] == size
    mixed = text[:8000] + b" again" * 800 + text[8000:]
    assert judge(mixed)[7] < quality.CHUNK_BAND[0] and not judge(mixed)[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), max_size=60), st.integers(2, 7))
def test_differencing(numbers, shards):
    sums, at = sharding.difference([[n] for n in numbers], shards)
    again = [0] * shards
    for n, places in zip(numbers, at, strict=True):
        assert sorted(places) == list(range(shards))
        again[places[0]] += n
    assert again == sums
    greedy = [0] * shards
    for n in sorted(numbers, reverse=True):
        greedy[greedy.index(min(greedy))] += n
    assert max(sums, default=0) - min(sums, default=0) <= max(greedy) - min(greedy) + max(numbers, default=0)


def check_shards(df, rows, shards):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    load, slot = Counter(), defaultdict(list)
    for r in rows:
        load[r["shard"]] += r["size"]
        slot[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slot.values())
    assert set(load) <= set(range(shards))
    return load


def test_shards(docs, small, nothing):
    rows = sharding.assign(docs, 24).collect()
    load = check_shards(docs, rows, 24)
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 0.02 * max(load.values())
    check_shards(small, sharding.assign(small, 3).collect(), 3)
    assert sharding.assign(nothing, 24).count() == 0


def test_hot_group_is_cut(spark):
    df = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('same text ', 20) ELSE repeat(concat('x', id), 20 + id % 30) END AS text")
    load = check_shards(df, sharding.assign(df, 24).collect(), 24)
    assert max(load.values()) < 1.05 * min(load.values())


def test_layers_of_pieces(spark, docs, nothing, monkeypatch):
    """More tasks than the driver's layer is cut for: a layer stands between, and nothing else changes."""
    monkeypatch.setattr(sharding, "FIRST", 2)
    skewed = spark.range(900).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('same text ', 20) ELSE repeat(concat('x', id), 20 + id % 30) END AS text")
    for df in (docs, skewed):
        load = check_shards(df, sharding.assign(df, 24).collect(), 24)
        assert len(load) == 24 and max(load.values()) < 1.05 * min(load.values())
    for df in (docs, skewed):
        shards_of = {}
        for r in sharding.assign(df, 3).join(df, "doc_id").collect():
            shards_of.setdefault(r["text"], set()).add(r["shard"])
        assert sum(len(v) > 1 for v in shards_of.values()) <= 1
    assert sharding.assign(nothing, 24).count() == 0


def test_licences(spark, small, nothing):
    rows = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame([(1, "Some text here.\nReleased under the MIT License.\nmore"), (2, "released UNDER the mit license"), (3, "nothing of the kind, really"), (4, None)], "doc_id long, text string")).collect()}
    assert [rows[k]["licence"] for k in (1, 2, 3, 4)] == ["MIT", "MIT", None, None]
    assert rows[1]["score"] == rows[2]["score"] == 1.0 and rows[3]["score"] == 0.0 and rows[1]["passages"] == 1
    assert licences.scan(small).count() == small.count() and licences.scan(nothing).count() == 0


def test_licences_within_texts(spark):
    """Inside a longer line, wrapped over lines in a longer text, two in one text, none in prose that shares words with one."""
    prose = "the quick brown fox jumps over the lazy dog and runs through the green fields until night falls on the software again "
    mit = licences.TEMPLATES["MIT text"]
    wrapped = "Readme.\n" + prose * 5 + "\nCopyright (c) someone\n\n" + textwrap.fill(mit, 70) + "\n" + prose * 9
    grant = "Readme.\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction.\n" + prose
    texts = [prose + "Licensed under the Apache License, Version 2.0. " + prose, wrapped, grant, f"{prose}released under the MIT license {prose} licensed under CC BY 4.0 {prose}", prose * 3, prose + "under the license of version 2 and the license of the software"]
    rows = sorted(licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r["licence"] for r in rows] == ["Apache-2.0", rows[1]["licence"], "MIT grant", rows[3]["licence"], None, None]
    assert rows[1]["licences"] == "MIT grant, MIT text"
    assert rows[3]["licences"] == "MIT, CC-BY-4.0" and rows[4]["licences"] == rows[5]["licences"] == ""


@pytest.mark.parametrize("text", ["Licensed under the Apache License, Version 2.0!", "this work is licensed under the gnu general public license version 3", "Licensed under CC BY 4.0", "of no licence at all"])
def test_licence_score(spark, text):
    own = set(licences.bigrams_of(text))
    dice = {n: 2 * len(own & set(licences.bigrams_of(t))) / (len(own) + len(licences.bigrams_of(t))) for n, t in licences.TEMPLATES.items()}
    best = max(dice.values())
    row = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["score"] == pytest.approx(best if best >= 0.8 else 0.0)


def test_queries_with_sql(spark):
    from oracle import connect, rows_of_frame, rows_of_sql

    con = connect(SF)
    for name, sql in queries.oracle_sql().items():
        assert rows_of_frame(queries.queries()[name](spark, SF)) == rows_of_sql(con, sql)


def test_model_keeps_rare_pairs_of_a_large_corpus(spark):
    """Over 2^22 training tokens: a pair and words seen once still count."""
    held = next(k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 7 == 2)
    train = next(k for k in range(10_000, 20_000) if zlib.crc32(str(k).encode()) % 7 != 2)
    bulk = spark.range(2600).selectExpr("id AS doc_id", "repeat('a b ', 1000) AS text")
    own = spark.createDataFrame([(train, "rareone raretwo"), (held, "rareone raretwo")], "doc_id long, text string")
    row = lm.score(bulk.unionByName(own)).filter(f"doc_id = {held}").first()
    n = row["train_tokens"]
    assert n > 1 << 22 and row["n_known"] == 3
    texts = sum(zlib.crc32(str(k).encode()) % 7 != 2 for k in range(2600)) + 1
    whole = n + 5 + 1
    left = lambda kinds, c: lm.DISCOUNT * kinds / c
    want = math.log10(0.25 / texts + left(2, texts) * 2 / whole) + math.log10(0.25 + left(1, 1) * 2 / whole) + math.log10(0.25 + left(1, 1) * (texts + 1) / whole)
    assert row["score"] == pytest.approx(want, rel=0.01)
