"""Byte-level BPE by ranks: exact merges in linear time, without replaying the merges.

The bytes of a piece are read as Latin-1 characters, so one Aho-Corasick automaton over the
vocabulary finds every token that starts anywhere in it. From the left the longest token is taken
that is compatible with the token before it; where none is left, the last choice is undone. Two
tokens are compatible when merging their joined bytes would leave just these two; the answer is
kept for each pair. A prefix has one valid chain of tokens at most, so a position that failed once
needs no second visit, and the work is linear in the piece.

Nulls: a null text counts as empty. Empty texts have no ids and decode to no bytes. Texts of any
length are encoded whole. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import Kept, pick, ship, slices

#: Pieces (in each of two halves) and token pairs that a worker keeps.
CACHE_ENTRIES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class BytePairs:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.token = dict(zip(ranks.values(), ranks, strict=True))
        self.find = regex.compile(pattern).findall
        self.length = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.spines: dict[int, tuple[list, list]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Kept(self.encode_piece, CACHE_ENTRIES)

    def _halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            joined = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            k = joined.index(min(joined))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0], parts[1]

    def _spine(self, i: int) -> tuple[list, list]:
        """A token's right-hand and left-hand parts, each with the rank of the merge that uses it up."""
        if i not in self.spines:
            right, left = [(self.token[i], 1 << 60)], [(self.token[i], 1 << 60)]
            for side, k in ((right, 1), (left, 0)):
                while len(part := side[-1][0]) > 1:
                    side.append((self._halves(part)[k], self.ranks[part]))
            self.spines[i] = (right, left)
        return self.spines[i]

    def compatible(self, a: int, b: int) -> bool:
        """No merge across the seam comes before both sides have become whole tokens."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            get = self.ranks.get
            # at one rank the leftmost merge goes first: that within the left token, that across before one in the right
            found = self.pairs[a, b] = not any(
                (rank := get(u + v)) is not None and rank < u_ends and rank <= v_ends
                for u, u_ends in self._spine(a)[0]
                for v, v_ends in self._spine(b)[1]
            )
        return found

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        size, length = len(data), self.length
        starting: list[list[int]] = [[] for _ in range(size + 1)]
        for end, i in self.automaton.iter(data.decode("latin-1")):
            starting[end + 1 - length[i]].append(i)  # shorter tokens end sooner
        at, out, tried, failed = 0, [], [], bytearray(size + 1)
        k = len(starting[0]) - 1
        while at < size:
            here = starting[at]
            while k >= 0 and (failed[at + length[here[k]]] or (out and not self.compatible(out[-1], here[k]))):
                k -= 1
            if k >= 0:
                out.append(here[k])
                tried.append(k)
                at += length[here[k]]
                k = len(starting[at]) - 1
            else:
                failed[at] = 1
                at -= length[out.pop()]
                k = tried.pop() - 1
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        """The ids of a text: each match of the pattern by itself, no special tokens."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_loaded: dict[tuple[str, str], BytePairs] = {}


def byte_pairs(path: str, pattern: str) -> BytePairs:
    """The worker's encoder; it and its tables outlive a task."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs(read_ranks(path), pattern)
    return _loaded[path, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row. No shuffle."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(ranks_path, pattern)
        for b in slices(batches):
            ids = [coder.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary) of every row of ids; null ids decode to no bytes. No shuffle."""
    ship(coded.sparkSession)
    rows = pick(coded, doc_id=id_col, ids=ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_pairs(ranks_path, pattern)
        for b in slices(batches):
            out = [coder.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes every text and decodes the ids in one pass."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder = byte_pairs(ranks_path, pattern)
        decimal = {i: str(i) for i in coder.token}.__getitem__
        for b in slices(batches, 128):
            out: list[list] = [[], [], []]
            for t in b.column(1).to_pylist():
                ids = coder.encode(t or "")
                out[0].append(len(ids))
                out[1].append(sha256(" ".join(map(decimal, ids)).encode()).hexdigest())
                out[2].append(sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), *(pa.array(x, pa.string()) for x in out[1:])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
