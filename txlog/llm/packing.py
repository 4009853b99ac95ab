"""Vector bin packing of token sequences.

An example has a demand vector (tokens, one segment, loss-bearing tokens); a sequence has a
capacity for each.  The dot-product heuristic fills a sequence with the example of which the part
that fits, from its first open token on, has the largest dot product with what is left of the
capacities, both in units of the capacities.  A part ends where the example, the tokens or the
loss-bearing tokens of the sequence end.  A sequence that ends before its tokens do, as its segments
or loss-bearing tokens ran out or the group had nothing left, is cut at powers of two, which need
no padding.

The first ``prompt`` share of an example's tokens bears no loss, all others do.  By default that is a
quarter, and a sequence holds 3584 loss-bearing tokens of 4096, so that the ends of long examples
have to be placed along with beginnings.

A group is a bounded stretch of one input partition (``GROUP_DOCS`` rows or ``GROUP_TOKENS``
tokens), so packing needs no shuffle, and no task holds more than a group and one text.

Nulls: a null text is the empty one (its end id remains); a null id is kept.  Repeated rows are
packed each; extra columns of the input are dropped; no rows give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from txlog.llm.common import documents, id_type, map_rows
from txlog.llm.encode import chunk_encoder

GROUP_DOCS = 2048
GROUP_TOKENS = 4_000_000
PROMPT = 0.25
PIECES = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 64
    loss: int = 3584


def pack_group(tokens: np.ndarray, loss: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (example, start, length).

    ``loss`` counts each example's loss-bearing tokens, which are its last ones (an answer
    after its prompt)."""
    which = np.flatnonzero(tokens > 0)
    rest = tokens[which].astype(np.int64)  # tokens not placed yet; an example is placed from its start
    free = rest - np.minimum(rest, loss[which])  # of them, before the loss-bearing ones
    out: list[list[tuple[int, int, int]]] = []
    n = len(which)
    while n:
        left, segments, left_loss = limits.tokens, limits.segments, limits.loss
        sequence: list[tuple[int, int, int]] = []
        while left > 0 and segments > 0 and n:
            fits = np.minimum(np.minimum(rest[:n], left), free[:n] + left_loss)
            bears = np.maximum(0, fits - free[:n])
            score = fits * (left / limits.tokens**2) + segments / limits.segments**2 + bears * (left_loss / limits.loss**2)
            at = int(np.argmax(np.where(fits > 0, score, -1.0)))
            length = int(fits[at])
            if length == 0:
                break
            i = int(which[at])
            sequence.append((i, int(tokens[i] - rest[at]), length))
            left, segments, left_loss = left - length, segments - 1, left_loss - int(bears[at])
            rest[at] -= length
            free[at] = max(0, int(free[at]) - length)
            if rest[at] == 0:
                n -= 1
                which[at], rest[at], free[at] = which[n], rest[n], free[n]
        out.append(sequence)
    return [s for seq in out for s in ([seq] if sum(p[2] for p in seq) == limits.tokens else _at_powers(seq))]


def _at_powers(sequence: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The pieces of a short sequence dealt to sequences whose lengths are powers of two, largest first."""
    todo = list(sequence[::-1])
    total = sum(p[2] for p in todo)
    while total:
        room = size = 1 << (total.bit_length() - 1)
        part = []
        while room:
            i, start, length = todo.pop()
            take = min(room, length)
            part.append((i, start, take))
            if take < length:
                todo.append((i, start + take, length - take))
            room -= take
        total -= size
        yield part


def pack(df: DataFrame, path: str, end_id: int, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", prompt: float = PROMPT) -> DataFrame:
    """One row per piece: its example and place in it, its sequence and offset there, its ids' crc32, and
    its loss-bearing tokens: those beyond the first ``prompt`` share of the example."""

    def run(batches):
        from pyspark import TaskContext

        enc, end = chunk_encoder(path), end_id.to_bytes(4, "little")
        base, docs, ids, held = TaskContext.get().partitionId() << 32, [], [], 0

        def flush():
            nonlocal base, docs, ids, held
            tokens = np.array([len(x) // 4 for x in ids], np.int64)
            loss = tokens - (tokens * prompt).astype(np.int64)
            rows: list[tuple] = []
            for sequence in pack_group(tokens, loss, limits):
                offset = 0
                for i, start, length in sequence:
                    n = int(tokens[i])
                    bears = max(0, start + length - max(n - int(loss[i]), start))
                    rows.append((docs[i], start, length, zlib.crc32(ids[i][4 * start : 4 * (start + length)]), n, base, offset, bears))
                    offset += length
                base += 1
            docs, ids, held = [], [], 0
            names = [c.split(" ")[0] for c in PIECES.split(", ")]
            return dict(zip(names, zip(*rows)))

        for b in batches:
            for d, text in zip(b[id_col], b[text_col]):
                docs.append(d)
                ids.append(enc.encode(text) + end)
                held += len(ids[-1]) // 4
                if len(docs) >= GROUP_DOCS or held >= GROUP_TOKENS:
                    yield flush()
        if docs:
            yield flush()

    return map_rows(df.select(id_col, text_col), run, PIECES.format(id_type(df, id_col)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
