"""ids of whole texts, each distinct white-space chunk merged once per worker by the tokenizer library."""

from __future__ import annotations

import functools
import os
from array import array

from txlog.llm.vocab import UNSAFE, Bounded, to_chars, vocabulary, word_pieces


class ChunkEncoder:
    """For word-level vocabularies, whose pre-tokens hold no white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.vocab = vocabulary(path)
        self._merge = self.vocab.library.model.tokenize
        self.cache = Bounded(self._chunk)

    def _chunk(self, chunk: str) -> bytes:
        return array("I", [t.id for p in word_pieces(chunk) for t in self._merge(to_chars(p))]).tobytes()

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers; null is the empty text."""
        text = text or ""
        self.cache.trim()
        if UNSAFE.search(text) or any(s in text for s in self.vocab.special):
            return array("I", self.vocab.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.cache.__getitem__, text.split()))


@functools.cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
