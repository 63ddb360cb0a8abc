"""Token ids of whole texts by a `tokenizers` file whose tokens never span ASCII white space."""

from __future__ import annotations

from array import array
from unicodedata import is_normalized, normalize

import numpy as np

from tidemark.llm.common import Kept, one_thread

#: Chunks held in each half of the cache.
CACHE_ENTRIES = 400_000


def byte_names() -> dict[int, int]:
    """The usual printable characters for the 256 bytes: themselves where printable, else from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: b if b in plain else next(rest) for b in range(256)}


class ChunkEncoder:
    """Encodes texts chunk by chunk, a chunk being what stands between ASCII white space.

    The tokenizer drops white space before its merges and its normaliser works within a chunk
    (no canonical composition crosses a white-space starter, lower-casing is by character), so a
    text's ids are its chunks' ids in order. Each distinct chunk is encoded by the library once and
    kept. An unseen chunk of lower-case letters is one word to the tokenizer and goes straight to the
    library's merges; a full stop or comma that ends it is a word of its own; any other chunk is encoded
    by the library as a text, which also finds the special tokens that a text spells out.
    """

    def __init__(self, path: str):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] or t.isalpha() for t in added):
            raise ValueError(f"{path}: a special token has white space or is a word; encode whole texts instead")
        #: What texts that may spell out a special token, in whatever case, have in them.
        self.marks = {min(t.lower(), key=str.isalnum).encode() for t in added}
        self.dtype, self.code = (np.uint16, "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else (np.uint32, "I")
        alone = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", "b", "a\n\tb", "a b")]
        if alone[2] != alone[0] + alone[1] or alone[3] != alone[2]:
            raise ValueError(f"{path}: tokens may span white space; encode whole texts instead")
        self.merges = self.tokenizer.model.tokenize
        self.byte_names = byte_names()
        self.closing = {p: np.array(self.tokenizer.encode(p.decode(), add_special_tokens=False).ids, self.dtype).tobytes() for p in (b".", b",")}
        words = ["straße", "naïve", "the", "él", "x"]
        if any([t.id for t in self.merges(w.encode().decode("latin-1").translate(self.byte_names))] != self.tokenizer.encode(w, add_special_tokens=False).ids for w in words):
            raise ValueError(f"{path}: words are not merged over byte names")
        self.cache = Kept(self._learn, CACHE_ENTRIES)

    def _learn(self, x: bytes) -> bytes:
        end = self.closing.get(x[-1:], b"")
        word = x[:-1] if end else x
        text = word.decode()
        if end and normalize("NFC", text).lower()[-1:].isalpha():
            return self.cache[word] + end
        if not end and text.isalpha() and text == text.lower() and is_normalized("NFC", text):
            return array(self.code, [t.id for t in self.merges(word.decode("latin-1").translate(self.byte_names))]).tobytes()
        ids = self.tokenizer.encode(x.decode(), add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as flat integers of self.dtype."""
        get = self.cache.__getitem__
        return [b"".join(map(get, self.lowered(t).split())) for t in texts]

    def lowered(self, text: bytes) -> bytes:
        """The text in small letters where that leaves its ids the same: the tokenizer lower-cases too, but after it has composed
        characters (marks may compose with small letters only) and looked for special tokens."""
        small = text.lower()
        if any(m in text for m in self.marks) and small != text:
            return text
        if text.isascii() or (is_normalized("NFC", text.decode()) and is_normalized("NFC", small.decode())):
            return small
        return text


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for the file; it and its cache outlive a task."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
