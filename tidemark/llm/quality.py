"""Quality rules by compression: texts that compress too well repeat themselves, those that hardly compress are noise.

Each whole text and each of its fixed chunks (the last one taken from the end, so that every byte is
in a chunk) is compressed with zstandard. A text is kept if its ratio of compressed to plain bytes
lies in the band of its length and every chunk's ratio lies in the chunk band. Short texts compress
badly whatever they say, so their bands are wider.

Before that the base rules hold: at least `MIN_WORDS` words, and at most a fifth of the words in 5-word
windows that stand in the text more than once.

Nulls: a null text has no words and is rejected, as an empty one is. Texts of any length are compressed
whole. Repeated rows get equal verdicts, each for itself. An empty table gives no rows. Other columns
are ignored (`verdicts`) or passed on unchanged under their own names (`keep`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pick, ship, slices

MIN_WORDS, WINDOW = 10, 5
LEVEL, CHUNK = 3, 4096
#: (bytes from, least ratio, greatest ratio) of whole texts; prose of a length lies well inside, so the greatest
#: ratio stands about a tenth above what it reaches and the least one a fifth below.
BANDS = (
    (0, 0.00, 9.00),
    (64, 0.40, 1.20),
    (128, 0.40, 1.00),
    (256, 0.40, 0.85),
    (512, 0.38, 0.76),
    (1024, 0.34, 0.66),
    (2048, 0.34, 0.60),
    (4096, 0.30, 0.56),
    (8192, 0.28, 0.54),
    (16384, 0.26, 0.52),
)
CHUNK_BAND = (0.30, 0.58)
SYMBOLS = b"#*$%&|<>"
FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, least_chunk double, greatest_chunk double, kept boolean"
NAMES = [x.split()[0] for x in FIGURES.split(", ")]


class Judge:
    def __init__(self) -> None:
        import zstandard

        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress

    def __call__(self, text: bytes) -> tuple:
        """The figures of one UTF-8 text, in the order of NAMES."""
        words = text.split()
        n = len(words)
        white = len(text) - sum(map(len, words))
        lines = [x for x in text.split(b"\n") if x.strip()] if b"\n" in text else []
        repeated = self.repeat_words(words)
        failed = n < MIN_WORDS or 100 * repeated > 20 * n
        ratio, least, greatest = self.ratios(text)
        low, high = next(b[1:] for b in reversed(BANDS) if len(text) >= b[0])
        fits = low <= ratio <= high and (len(text) < CHUNK or (CHUNK_BAND[0] <= least and greatest <= CHUNK_BAND[1]))
        symbols = len(text) - len(text.translate(None, SYMBOLS))
        return n, len(text.decode()) - white, symbols, len(lines) - len(set(lines)), repeated, failed, ratio, least, greatest, not failed and fits

    @staticmethod
    def repeat_words(words: list[bytes]) -> int:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        covered, until = 0, 0
        for k, w in enumerate(windows):
            if seen[w] > 1:
                covered += k + WINDOW - max(until, k)
                until = k + WINDOW
        return covered

    def ratios(self, text: bytes) -> tuple[float, float, float]:
        """Of the whole text, its best and its worst compressed chunk."""
        if not text:
            return 1.0, 1.0, 1.0
        whole = len(self.compress(text)) / len(text)
        if len(text) <= CHUNK:
            return whole, whole, whole
        starts = [*range(0, len(text) - CHUNK, CHUNK), len(text) - CHUNK]
        each = [len(self.compress(text[k : k + CHUNK])) / CHUNK for k in starts]
        return whole, min(each), max(each)


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, figures, kept) of every row. No shuffle."""
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for b in slices(batches):
            figures = list(zip(*map(judge, _texts(b.column(1))), strict=True))
            kinds = [pa.int64()] * 5 + [pa.bool_()] + [pa.float64()] * 3 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, k) for x, k in zip(figures, kinds, strict=True))], names=["doc_id", *NAMES])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FIGURES}")


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes, with all their columns. No shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for b in slices(batches):
            passed = pa.array([judge(t)[-1] for t in _texts(b.column(at))], pa.bool_())
            yield b.filter(passed)

    return docs.mapInArrow(run, docs.schema)
