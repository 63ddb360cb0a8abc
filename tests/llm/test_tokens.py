"""Encoders, packing and token files against the libraries themselves."""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe, packing, token_files
from tidemark.llm.common import new_folder
from tidemark.llm.word_tokens import ChunkEncoder

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def exact():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs():
    return byte_bpe.byte_pairs(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def chunks():
    return ChunkEncoder(WORDS)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_byte_pairs_equal_library(pairs, exact, text):
    ids = pairs.encode(text)
    assert ids == exact.encode_ordinary(text)
    assert pairs.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(piece=st.text(alphabet="aabbcnteéß ", min_size=1, max_size=40))
def test_one_piece(pairs, exact, piece):
    assert list(pairs.encode_piece(piece)) == exact._encode_single_piece(piece)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAeéÉ .,'̌̈jJthH0123\n")), max_size=60))
def test_chunks_equal_library(chunks, library, text):
    assert np.frombuffer(chunks.encode([text.encode()])[0], chunks.dtype).tolist() == library(text)


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from(["T", "j", "h", "A", ".", ",", " ", "\u0344", "\u0308", "\u0331", "\u0130", "\ufb46", "\u0f57", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>x"])), max_size=12))
def test_marks_and_special_tokens_equal_library(chunks, library, parts):
    text = "".join(parts)
    assert np.frombuffer(chunks.encode([text.encode()])[0], chunks.dtype).tolist() == library(text)


def test_byte_pairs_of_table(small, nothing, exact, pairs):
    out = byte_bpe.round_trip(small, RANKS, P.PATTERN).collect()
    want = Counter((r["doc_id"], r["text"] or "") for r in small.collect())
    ids_of = lambda t: exact.encode_ordinary(t)
    figures = lambda d, t: (d, len(ids_of(t)), sha256(" ".join(map(str, ids_of(t))).encode()).hexdigest(), sha256(t.encode()).hexdigest())
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == Counter(figures(d, t) for d, t in want.elements())
    assert byte_bpe.round_trip(nothing, RANKS, P.PATTERN).count() == 0
    coded = byte_bpe.encode(small, RANKS, P.PATTERN)
    back = byte_bpe.decode(coded, RANKS, P.PATTERN)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in back.collect()) == Counter((d, t.encode()) for d, t in want.elements())
    assert pairs.encode("") == []


def check_packing(rows, texts, library, capacity):
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for d, t in texts.items():
        ids = library(t) + [1]
        own = sorted(pieces[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // capacity)))
        for k, r in enumerate(own):
            part = ids[k * capacity : (k + 1) * capacity]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k * capacity, len(part), crc(part))
    for rows_ in sequences.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


def test_packing_of_table(docs, library):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    n = check_packing(packing.pack_documents(docs, WORDS).collect(), texts, library, 4096)
    total = sum(len(library(t)) + 1 for t in texts.values())
    assert n <= 1.02 * -(-total // 4096) + 1


def test_packing_of_awkward_rows(small, nothing, library):
    out = packing.pack_documents(small, WORDS, capacity=64)
    rows = out.collect()
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    want = Counter((r["doc_id"], len(library(r["text"])) + 1) for r in small.collect())
    assert sum(r["length"] for r in rows) == sum(n * k for (_, n), k in want.items())
    assert Counter(r["doc_id"] for r in rows) == Counter({d: sum(-(-n // 64) * k for (x, n), k in want.items() if x == d) for d in {x for x, _ in want}})
    assert packing.pack_documents(nothing, WORDS).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=20))
def test_plan_uses_each_piece_once(histogram):
    chosen, used = packing.plan(histogram, 50), Counter()
    for times, use in chosen:
        assert times > 0 and sum(k * n for k, n in use.items()) <= 50
        for k, n in use.items():
            used[k] += times * n
    assert used == histogram
    best_fit = packing.best_fit(np.array(sorted(histogram)), np.array([histogram[k] for k in sorted(histogram)]), 50)
    assert sum(t for t, _ in chosen) <= 1.1 * sum(t for t, _ in best_fit) + 1


def test_knapsack_is_exact():
    lengths, prices = np.array([3, 5, 7]), np.array([2.0, 4.0, 5.5])
    best, _ = packing.knapsack(lengths, prices, 20)
    want = [max(2 * a + 4 * b + 5.5 * c for a in range(8) for b in range(5) for c in range(4) if 3 * a + 5 * b + 7 * c <= n) for n in range(21)]
    assert best.tolist() == want


def test_token_files(spark, small, nothing, library):
    folder = new_folder(spark, "t")
    manifest = token_files.write_token_files(small, folder, WORDS, 1)
    rows = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r["doc_id"] for r in small.collect()), key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(r["ids"]), crc(r["ids"]))
        at += r["n_tokens"]
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == Counter((r["doc_id"], (*library(r["text"]), 1)) for r in small.collect())
    assert (manifest["docs"], manifest["tokens"]) == (len(rows), at)
    folder = new_folder(spark, "t")
    token_files.write_token_files(nothing, folder, WORDS, 1)
    assert token_files.read_token_files(spark, folder).count() == 0


def test_text_ids(spark, library):
    df = spark.createDataFrame([("b\n2", "second one"), ("a", "first"), (None, "no id"), ("é", None)], "name string, body string").repartition(3)
    folder = new_folder(spark, "t")
    token_files.write_token_files(df, folder, WORDS, 1, id_col="name", text_col="body")
    rows = sorted(token_files.read_token_files(spark, folder, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, "a", "b\n2", "é"]
    assert [r["ids"] for r in rows] == [[*library(t), 1] for t in ("no id", "first", "second one", "")]
    out = packing.pack_documents(df, WORDS, id_col="name", text_col="body").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(["b\n2", "a", None, "é"])


def test_packing_is_close_to_the_least(spark):
    """Of many pieces, the sequences are within 1 % of what their tokens need at least."""
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6, 1.1, 60_000).astype(int) + 1)
    histogram = dict(Counter(lengths.tolist()))
    chosen = packing.plan(histogram, 4096)
    assert sum(times for times, _ in chosen) <= 1.01 * lengths.sum() / 4096 + 1
