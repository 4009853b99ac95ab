"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token there is exactly one last token of its encoding.  An automaton
over the vocabulary gives the tokens that are suffixes of each prefix; of those, the last token
is the one that may follow the last token of what precedes it.  Following the back-pointers
from the end emits the ids.  Pre-tokens are solved once per worker and cached.

Nulls: a null text encodes as the empty one.  Empty texts give no ids, and the digests of
empty strings.  Repeated rows each give a row.  Extra columns of the input are dropped.
"""

from __future__ import annotations

import functools
import hashlib
from array import array

import ahocorasick
from pyspark.sql import DataFrame, SparkSession

from txlog.llm.common import documents, id_type, map_rows
from txlog.llm.vocab import CHUNK, UNSAFE, Bounded, Vocabulary, byte_level_pieces, char_bytes, to_chars, vocabulary

_INF = 1 << 60


class PrefixEncoder:
    """Encoder and decoder of a byte-level BPE vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for pair, (rank, token) in vocab.merges.items():
            self.parts.setdefault(token, pair)
            self.born.setdefault(token, rank)
        self.follows: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.whole: set[int] = set()
        for text, token in sorted(vocab.ids.items(), key=lambda x: self.born.get(x[1], -1)):
            pair = self.parts.get(token)
            if pair is None or (pair[0] in self.whole and pair[1] in self.whole and self._meets(*pair, final=True)):
                self.whole.add(token)
                self.automaton.add_word(text, (len(text), token))
        self.automaton.make_automaton()
        self.chunks = Bounded(self._chunk)
        b = char_bytes()
        self.bytes_of = {i: bytes(b[c] for c in t) for t, i in vocab.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in vocab.special.items()}

    def _meets(self, a: int, b: int, final: bool = False) -> bool:
        """Whether ``a`` and ``b`` both form before any merge crosses their border.  The merges are
        undone from the last: at each moment the tokens at the border are alive together, and a merge
        of the two that ranks before the end of both would have come first.  ``final`` allows the
        merge of the whole two."""
        born, parts, merges = self.born, self.parts, self.vocab.merges
        end_a = end_b = _INF
        if final:
            end_a = end_b = merges[a, b][0]
        while True:
            cross = merges.get((a, b))
            if cross is not None and cross[0] < end_a and (cross[0] < end_b if final else cross[0] <= end_b):
                return False
            final = False
            fa, fb = born.get(a, -1), born.get(b, -1)
            if fa < 0 and fb < 0:
                return True
            if fb >= fa:
                b, end_b = parts[b][0], fb
            else:
                a, end_a = parts[a][1], fa

    def piece(self, chars: str) -> array:
        """ids of one pre-token given in byte characters."""
        n = len(chars)
        last, start = [-1] * (n + 1), [0] * (n + 1)
        follows = self.follows
        for end, (size, token) in self.automaton.iter(chars):
            end += 1
            if last[end] >= 0:
                continue
            begin = end - size
            if begin:
                before = last[begin]
                if before < 0:
                    continue
                key = before << 20 | token
                ok = follows.get(key)
                if ok is None:
                    if len(follows) > 2_000_000:
                        follows.clear()
                    ok = follows[key] = self._meets(before, token)
                if not ok:
                    continue
            last[end], start[end] = token, begin
        out, at = array("I"), n
        while at:
            out.append(last[at])
            at = start[at]
        out.reverse()
        return out

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.piece(to_chars(p)).tobytes() for p in byte_level_pieces(chunk)])

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.vocab.segments(text or ""):
            if part in self.vocab.special:
                out.append(self.vocab.special[part].to_bytes(4, "little"))
            elif UNSAFE.search(part):
                out += [self.piece(p).tobytes() for p in self.vocab.library_pieces(part)]
            else:
                out += map(self.chunks.__getitem__, CHUNK.findall(part))
        self.chunks.trim()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens as their strings."""
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


@functools.cache
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary(path))


def encode_column(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (binary, little-endian unsigned 32-bit integers) of every text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield {id_col: b[id_col], "ids": [enc.encode(t) for t in b[text_col]]}

    return map_rows(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids binary")


def decode_column(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``text`` of a frame with ``ids``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path)
        for b in batches:
            yield {id_col: b[id_col], "text": [enc.decode(i) for i in b["ids"]]}

    return map_rows(df.select(id_col, "ids"), run, f"`{id_col}` {kind}, text string")


def codec_digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the text decoded from them."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            ids = [enc.encode(t) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(enc.decode(i).encode()).hexdigest() for i in ids],
            }

    return map_rows(df.select("doc_id", "text"), run, f"doc_id {id_type(df)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return codec_digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
