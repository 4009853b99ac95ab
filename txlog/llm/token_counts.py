"""Token counts with a whole-token shortcut.

Before any text is read, each vocabulary string that ends a word is merged from its bytes; those
that come out as one token are proven to encode alone as one.  A pre-token among them counts 1;
only the others are merged (by the tokenizer library's merge step).

Nulls: a null text counts as the empty one (0 bytes, 0 tokens).  Repeated rows each give a row;
extra columns of the input are dropped.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from txlog.llm.common import documents, id_type, map_rows
from txlog.llm.vocab import UNSAFE, Bounded, Vocabulary, to_chars, vocabulary, word_pieces


class TokenCounter:
    """Counts tokens of a word-level (``</w>``) BPE vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        pieces = (t.removesuffix(vocab.end) for t in vocab.ids if t.endswith(vocab.end))
        self.whole = frozenset(p for p in pieces if p and len(vocab.merge(p)) == 1)
        self._merge = vocab.library.model.tokenize
        self.chunks = Bounded(self._chunk)

    def piece(self, chars: str) -> int:
        return 1 if chars in self.whole else len(self._merge(chars))

    def _chunk(self, chunk: str) -> int:
        return sum([self.piece(to_chars(p)) for p in word_pieces(chunk)])

    def count(self, text: str | None) -> int:
        n = 0
        for part in self.vocab.segments(text or ""):
            if part in self.vocab.special:
                n += 1
            elif UNSAFE.search(part):
                n += sum(map(self.piece, self.vocab.library_pieces(part)))
            else:  # no pre-token holds white space
                n += sum(map(self.chunks.__getitem__, part.split()))
        self.chunks.trim()
        return n


@functools.cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(vocabulary(path))


def token_counts(df: DataFrame, path: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``."""

    def run(batches):
        c = counter(path)
        for b in batches:
            n = [c.count(t) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in b["text"]],
                "n_tokens": n,
                "over_limit": [k > limit for k in n],
            }

    return map_rows(df.select("doc_id", "text"), run, f"doc_id {id_type(df)}, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 2048)
