from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, fp long, shard int, sequence_id string, score string, rank int"


@pytest.fixture(scope="session")
def small(spark):
    """Rows of every awkward kind; columns that clash with the operators' own."""
    words = "the quick brown fox jumps over the lazy dog and runs through all of the green fields until night falls again".split()
    long = " ".join(words[k * 7 % len(words)] + str(k % 97) for k in range(30_000))
    texts = [None, "", "  \n\t ", "one", "Two words", " ".join(words), " ".join(words), "Été naïve straße 中文 \U0001f600 don't 12.5!", long, "a\x00b <|endoftext|> x y"]
    rows = [(k, t, None, 1, 2, "s", "z", 3) for k, t in enumerate(texts)]
    rows += [(3, "one", "xx", None, None, None, None, None), (5, " ".join(words), None, 1, 2, "s", "z", 3), (None, "no id here at all", None, 1, 2, "s", "z", 3), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def nothing(small):
    return small.limit(0)
