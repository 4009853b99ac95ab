"""BPE vocabularies read from a tokenizer file, and the splitting that precedes the merges.

Texts whose characters all lie below U+0250 (less a few) are split here with explicit
character classes; others are normalised and split by the tokenizer library itself, whose
Unicode tables may differ from Python's.  Either way the merges are this module's.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata

#: Where each library's own white space lies below U+0250.
SPACES = "\t\n\x0b\x0c\r \x85\xa0"
#: Lower-casing may lead up to here.
_LIMIT = 0x2B0
#: Characters from U+0250, those that lower-case to such, and controls that Python takes for white space.
UNSAFE = re.compile("[^\x00-\x1b\x20-įı-ȹȻ-Ƚȿ-ɏ]")
#: A run of pre-tokens: an optional space and what is not space, or white space as the byte-level pattern cuts it.
CHUNK = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def _cls(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LIMIT) if unicodedata.category(chr(c))[0] == kind)


@functools.cache
def _byte_level() -> re.Pattern:
    l, n = _cls("L"), _cls("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{l}]+| ?[{n}]+| ?[^{SPACES}{l}{n}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@functools.cache
def _word_level() -> re.Pattern:
    l, n = _cls("L"), _cls("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{l}]+|[{n}]|[^{SPACES}{l}{n}]+")


def byte_level_pieces(chunk: str) -> list[str]:
    """Pre-tokens of a run without inner white space, with an optional space before it."""
    return [chunk] if chunk[chunk[0] == " " :].isalpha() else _byte_level().findall(chunk)


def word_pieces(chunk: str) -> list[str]:
    """Lower-case pre-tokens of a run without white space."""
    chunk = chunk.lower()
    return [chunk] if chunk.isalpha() else _word_level().findall(chunk)


@functools.cache
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


@functools.cache
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


class Vocabulary:
    """ids, merges in rank order and special tokens of a ``.json`` BPE tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        self._special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: (left id, right id) -> (rank, id of the merged token)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            joined = a.removesuffix(self.end) + b if self.end else a + b
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[joined])
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()

    def segments(self, text: str) -> list[str]:
        """The text cut at special strings, which stay as items of their own."""
        return [s for s in self._special_cut.split(text) if s]

    def library_pieces(self, text: str) -> list[str]:
        """Pre-tokens of any text, in byte characters."""
        norm = self.library.normalizer
        text = norm.normalize_str(text) if norm is not None else text
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def merge(self, piece: str) -> list[int]:
        """ids of one pre-token (in byte characters): the lowest-ranked pair first, leftmost first."""
        symbols = [self.ids[c] for c in piece[:-1]] + [self.ids[piece[-1] + self.end]]
        merges = self.merges
        while len(symbols) > 1:
            best = min(((merges[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges), default=None)
            if best is None:
                break
            a, b = symbols[best[1]], symbols[best[1] + 1]
            new, out, i = merges[a, b][1], [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """One per process and file."""
    return Vocabulary(path)


def to_chars(piece: str) -> str:
    """A pre-token's UTF-8 bytes in byte characters."""
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    t = byte_chars()
    return "".join([t[b] for b in piece.encode("utf-8", "surrogatepass")])


class Bounded(dict):
    """A cache that fills itself and starts over when ``trim`` finds it too large."""

    def __init__(self, make, limit: int = 800_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.limit:
            self.clear()
