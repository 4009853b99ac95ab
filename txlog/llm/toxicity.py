"""Toxicity scores from a convolutional text classifier trained in numpy.

Words (lower case, without punctuation at their ends) are hashed: a word's embedding is the sum of
those of its own bucket and of the buckets of its first 4 and 5 letters, so that unseen forms of a
stem are known.  Filters of several widths run over the word sequence, their largest activations over the whole
text feed a logistic layer.  The score is shifted so that 0.5 is the best cut on labelled rows
kept from the fit, and per language a threshold on the score is calibrated on them as well; the
language only picks that threshold for the column ``flagged``, it is no input of the score.

The fit uses every row with a label, of texts of any length, but never rows whose crc32(doc_id as text) mod 5
is 0.  They are dealt by hash into shards of about ``SHARD_BYTES`` of text.  In each pass every shard is
trained on from the same weights; Spark averages what the shards make of each weight (embeddings by how much
gradient each shard had for them), in whole numbers, so that the order of rows does not matter.  The number of
passes falls with the number of rows, from 10 to 3, towards ``VISITS`` in all.  One row in five (one of
each class at least) calibrates and is not fitted: their scores are counted in cells of 1 / 1024.  A class with one
row leaves no model.  Rows that share an id all count, with the id's greatest label.  Scoring covers every row.

Nulls: a null text is the empty one; it gets the score of a text without known words.  A null
doc_id is not held out.  Without any usable labels all scores are that of the prior, sigmoid(-20).
Repeated rows each give a row; extra columns of the input are dropped.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.llm.common import documents, id_type, map_rows, materialize, scratch_scope, words
from txlog.llm.vocab import Bounded

#: Of a shard's text, on average; a block of twice as much is closed.
SHARD_BYTES = 16 << 20
#: Rows times passes to come to, with no fewer passes than the first and no more than the second of PASSES.
VISITS, PASSES = 160_000, (3, 10)
#: Labels of at most so many ids are sent to the scan, more are joined.
BROADCAST_IDS = 2_000_000
#: Cells of a score, per unit of its logit.
_FINE = 1024
#: Places that filters run over at a time.
_PLACES = 1 << 18
#: Rows that the cut of all languages counts for in a language's own.
PRIOR = 20
BUCKETS = 1 << 20
MIN_DOCS = 3
WIDTHS, FILTERS, DIM = (1, 2, 3), 8, 16
PREFIXES = (4, 5)
#: Share of a text's words hidden at each step of the fit: max pooling passes the gradient to the strongest word only, and
#: words that come along with a stronger one would never be learned.
DROPPED = 0.5
_PARTS = 1 + len(PREFIXES)
_PAD = max(WIDTHS) - 1
_STRIP = string.punctuation + "«»“”„’¡¿"


def buckets(word: str) -> tuple[int, ...]:
    """A word's buckets: its own, and those of its first letters; -1 where it has none."""
    w = word.lower().strip(_STRIP)
    own = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
    return (own, *[zlib.crc32(f"{n}:{w[:n]}".encode("utf-8", "surrogatepass")) % BUCKETS if len(w) > n else -1 for n in PREFIXES])


@dataclass
class Model:
    #: The known buckets in order: bucket ``kept[i]`` has row i + 1 of the embeddings; row 0 holds for the rest and stays zero
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    embedding: np.ndarray = field(default_factory=lambda: np.zeros((1, DIM), np.float32))
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out_bias: float = -20.0
    thresholds: dict[str, float] = field(default_factory=dict)

    @property
    def index(self) -> dict[int, int]:
        return {int(b): i + 1 for i, b in enumerate(self.kept)}

    def place(self) -> np.ndarray:
        """The row of the embeddings of each bucket; the last one, 0, is for parts that a word doesn't have (-1)."""
        place = np.zeros(BUCKETS + 1, np.int32)
        place[self.kept] = np.arange(1, len(self.kept) + 1)
        return place

    def tables(self) -> dict[int, list[np.ndarray]]:
        """What each word adds to each filter at each of its places."""
        return {w: [self.embedding @ k for k in f] for w, f in self.filters.items()}


def _layout(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows (words by parts, or by one number) in one sequence with padding after each; starts and ends of the rows
    (at least one place)."""
    sizes = np.array([max(1, len(r)) for r in rows])
    starts = np.r_[0, np.cumsum(sizes + _PAD)[:-1]]
    seq = np.zeros((int((sizes + _PAD).sum()) + _PAD, rows[0].shape[1] if rows else _PARTS), np.int32)
    for s, r in zip(starts, rows):
        seq[s : s + len(r)] = r
    return seq, starts, starts + sizes


def _convolve(tables: list[np.ndarray], seq: np.ndarray) -> np.ndarray:
    n = len(seq) - _PAD
    out = np.zeros((n, FILTERS), np.float32)
    for k, t in enumerate(tables):
        for part in range(seq.shape[1]):
            out += t[seq[k : k + n, part]]
    return out


def logits(model: Model, rows: list[np.ndarray], tables: dict[int, list[np.ndarray]] | None = None) -> np.ndarray:
    if not model.filters:
        return np.full(len(rows), model.out_bias)
    tables = tables or model.tables()
    seq, starts, ends = _layout(rows)
    cut = np.c_[starts, ends].ravel()
    pooled = [np.maximum.reduceat(np.vstack([_convolve(t, seq), np.full((1, FILTERS), -np.inf, np.float32)]), cut, axis=0)[::2] + model.bias[w] for w, t in tables.items()]
    return np.maximum(np.hstack(pooled), 0) @ model.out + model.out_bias


@dataclass
class Learner:
    """A model that is being fitted, with the sums of squared gradients (AdaGrad) of its weights."""

    model: Model
    sq_e: np.ndarray
    sq_f: dict[int, np.ndarray]
    sq_b: dict[int, np.ndarray]
    sq_o: np.ndarray
    sq_ob: float = 1e-3

    def head(self) -> np.ndarray:
        """All but the embeddings, as one row of numbers."""
        m = self.model
        own = [*(m.filters[w] for w in WIDTHS), *(m.bias[w] for w in WIDTHS), m.out, np.array([m.out_bias])]
        squares = [*(self.sq_f[w] for w in WIDTHS), *(self.sq_b[w] for w in WIDTHS), self.sq_o, np.array([self.sq_ob])]
        return np.concatenate([np.ravel(x) for x in own + squares])

    def set_head(self, numbers: np.ndarray) -> None:
        m, at = self.model, 0

        def take(like: np.ndarray) -> np.ndarray:
            nonlocal at
            at += like.size
            return numbers[at - like.size : at].reshape(like.shape).astype(np.float32)

        for f, b, part in ((m.filters, m.bias, "out"), (self.sq_f, self.sq_b, "sq_o")):
            own = m if part == "out" else self
            f |= {w: take(f[w]) for w in WIDTHS}
            b |= {w: take(b[w]) for w in WIDTHS}
            setattr(own, part, take(getattr(own, part)))
            setattr(own, f"{part}_bias" if part == "out" else "sq_ob", float(take(np.zeros(1))[0]))

    def part(self, rows: np.ndarray) -> Learner:
        """A copy with these rows of the embeddings only."""
        m = self.model
        own = replace(m, embedding=m.embedding[rows], filters={w: f.copy() for w, f in m.filters.items()}, bias={w: b.copy() for w, b in m.bias.items()}, out=m.out.copy())
        return Learner(own, self.sq_e[rows], {w: f.copy() for w, f in self.sq_f.items()}, {w: b.copy() for w, b in self.sq_b.items()}, self.sq_o.copy(), self.sq_ob)


def begin(kept: np.ndarray, rng: np.random.Generator) -> Learner:
    """Before the first pass; ``kept``: the known buckets in order."""
    m = Model(kept=kept)
    m.embedding = np.zeros((len(kept) + 1, DIM), np.float32)
    for k in range(1, len(kept) + 1, 65536):
        m.embedding[k : k + 65536] = rng.normal(0, 0.1, m.embedding[k : k + 65536].shape)
    m.filters = {w: rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    m.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
    m.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
    m.out_bias = 0.0
    squares = {w: np.full_like(m.filters[w], 1e-3) for w in WIDTHS}
    return Learner(m, np.full((len(kept) + 1, 1), 1e-3, np.float32), squares, {w: np.full(FILTERS, 1e-3, np.float32) for w in WIDTHS}, np.full_like(m.out, 1e-3))


def _peaks(tables: list[np.ndarray], seq: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text and filter the first place of the largest activation, and that."""
    peak, top = np.zeros((len(starts), FILTERS), int), np.full((len(starts), FILTERS), -np.inf, np.float32)
    for low in range(0, len(seq) - _PAD, _PLACES):
        c = _convolve(tables, seq[low : low + _PLACES + _PAD])
        for i in range(np.searchsorted(ends, low, "right"), np.searchsorted(starts, low + len(c))):
            begin_at = max(starts[i] - low, 0)
            part = c[begin_at : ends[i] - low]
            at = part.argmax(axis=0)
            value = part[at, np.arange(FILTERS)]
            peak[i] = np.where(value > top[i], low + begin_at + at, peak[i])
            top[i] = np.maximum(value, top[i])
    return peak, top


def one_pass(learner: Learner, parts: np.ndarray, docs: list[np.ndarray], toxic: np.ndarray, rng: np.random.Generator, batch: int = 64, rate: float = 0.08) -> None:
    """Train once on rows of numbers of words with labels 0 or 1 (AdaGrad on the cross-entropy); ``parts`` has the places of each
    word's parts in the embeddings."""
    m = learner.model
    parts = np.vstack([np.zeros((1, _PARTS), parts.dtype), parts])  # 0: hidden, or no word
    order = rng.permutation(len(docs))
    for k in range(0, len(order), batch):
        part = order[k : k + batch]
        seq, starts, ends = _layout([((docs[i] + 1) * (rng.random(len(docs[i])) >= DROPPED))[:, None] for i in part])
        used, seq = np.unique(seq, return_inverse=True)
        own, seq = parts[used], seq.reshape(-1, 1)
        summed = m.embedding[own].sum(axis=1)
        tables = {w: [summed @ k for k in f] for w, f in m.filters.items()}
        peak, act = {}, []
        for w in WIDTHS:
            peak[w], top = _peaks(tables[w], seq, starts, ends)
            act.append(top + m.bias[w])
        hidden = np.maximum(np.hstack(act), 0)
        d = (1 / (1 + np.exp(-(hidden @ m.out + m.out_bias))) - toxic[part]) / len(part)
        g_hidden = np.where(hidden > 0, d[:, None] * m.out[None, :], 0).astype(np.float32)
        g = (hidden.T @ d).astype(np.float32) + 1e-5 * m.out
        learner.sq_o += g * g
        learner.sq_ob += d.sum() ** 2
        m.out -= rate * g / np.sqrt(learner.sq_o)
        m.out_bias -= rate * d.sum() / np.sqrt(learner.sq_ob)
        touched, grads = [], []
        for at, w in enumerate(WIDTHS):
            gw = g_hidden[:, at * FILTERS : (at + 1) * FILTERS]
            learner.sq_b[w] += gw.sum(0) ** 2
            m.bias[w] -= rate * gw.sum(0) / np.sqrt(learner.sq_b[w])
            for j in range(w):
                ids = own[seq[peak[w] + j, 0]]
                touched.append(ids.ravel())
                grads.append(np.repeat((gw[:, :, None] * m.filters[w][j].T[None]).reshape(-1, DIM), _PARTS, axis=0))
                gf = np.einsum("bf,bfd->df", gw, m.embedding[ids].sum(axis=2)) + 1e-5 * m.filters[w][j]
                learner.sq_f[w][j] += gf * gf
                m.filters[w][j] -= rate * gf / np.sqrt(learner.sq_f[w][j])
        ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        ge = np.zeros((len(ids), DIM), np.float32)
        np.add.at(ge, inverse, np.concatenate(grads))
        ge[ids == 0] = 0
        learner.sq_e[ids] += (ge * ge).mean(axis=1, keepdims=True)
        m.embedding[ids] -= rate * ge / np.sqrt(learner.sq_e[ids])


def train(rows: list[np.ndarray], toxic: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.08, seed: int = 7) -> Model:
    """Fit on rows of buckets with labels 0 or 1, as one shard."""
    seen = np.zeros(BUCKETS, np.int32)
    for r in rows:
        seen[np.unique(r[r >= 0])] += 1
    rng = np.random.default_rng(seed)
    learner = begin(np.flatnonzero(seen >= MIN_DOCS), rng)
    place = learner.model.place()
    parts, numbers = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
    docs = np.split(numbers.ravel(), np.cumsum([len(r) for r in rows])[:-1])
    for _ in range(epochs):
        one_pass(learner, place[parts], docs, toxic, rng, batch, rate)
    return learner.model


_BLOCK = "shard long, held boolean, toxic array<int>, lang array<string>, sizes array<int>, words binary, parts binary"


class _Words(dict):
    """Words of a block, numbered as they come, and the buckets of each."""

    def __init__(self):
        super().__init__()
        self.parts: list[tuple[int, ...]] = []

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        self.parts.append(buckets(word))
        return self[word]


def _blocks(rows: DataFrame) -> DataFrame:
    """Labelled rows with ``held`` and ``shard`` as blocks, one or more a shard, of rows in the order of their ids."""

    def build(batches):
        key, known, size, out = None, _Words(), 0, {"toxic": [], "lang": [], "words": []}

        def close():
            nonlocal known, size, out
            sizes, parts = [len(w) for w in out["words"]], np.array(known.parts, "<i4").reshape(-1, _PARTS)
            packed = np.concatenate(out["words"]).astype("<i4")
            row = {"shard": [key[1]], "held": [key[0]], "toxic": [out["toxic"]], "lang": [out["lang"]], "sizes": [sizes], "words": [packed.tobytes()], "parts": [parts.tobytes()]}
            known, size, out = _Words(), 0, {"toxic": [], "lang": [], "words": []}
            return row

        for b in batches:
            for held, shard, toxic, lang, text in zip(b["held"], b["shard"], b["toxic"], b["lang"], b["text"]):
                if out["toxic"] and ((held, shard) != key or size >= 2 * SHARD_BYTES):
                    yield close()
                key = held, shard
                out["toxic"].append(toxic)
                out["lang"].append(lang)
                out["words"].append(np.fromiter(map(known.__getitem__, words(text)), np.int32))
                size += len(text or "")
        if out["toxic"]:
            yield close()

    dealt = rows.repartition("held", "shard").sortWithinPartitions("held", "shard", "doc_id", F.xxhash64("text", "lang"))
    return map_rows(dealt.select("held", "shard", "toxic", "lang", "text"), build, _BLOCK)


def _unpacked(batches):
    """Of each block: shard, labels, languages, the buckets of its words, its words, and the ends of its rows among those."""
    for b in batches:
        for shard, toxic, lang, sizes, packed, parts in zip(*(b[c] for c in ("shard", "toxic", "lang", "sizes", "words", "parts"))):
            yield shard, np.array(toxic, np.float32), lang, np.frombuffer(parts, "<i4").reshape(-1, _PARTS), np.frombuffer(packed, "<i4"), np.cumsum(sizes)


def _known_buckets(blocks: DataFrame) -> np.ndarray:
    """Buckets with MIN_DOCS rows or more, in order."""

    def count(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for *_, parts, packed, ends in _unpacked(batches):
            for r in np.split(packed, ends[:-1]):
                found = np.unique(parts[np.unique(r)])
                seen[found[found >= 0]] += 1
        there = np.flatnonzero(seen)
        yield {"bucket": there, "n": seen[there]}

    counted = map_rows(blocks, count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return np.sort(counted.where(F.col("n") >= MIN_DOCS).select("bucket").toArrow()["bucket"].to_numpy()).astype(np.int64)  # of BUCKETS


#: Weights are averaged as whole numbers, whose sums don't depend on their order.
_UNIT = float(1 << 16)


def _turn(blocks: DataFrame, learner: Learner, turn: int, seed: int) -> None:
    """A pass over all blocks from the same weights, which become the average of what they make of them."""
    shipped = blocks.sparkSession.sparkContext.broadcast(learner)  # at most BUCKETS rows of DIM numbers
    values = [f"v{i}" for i in range(DIM + 1)]

    def learn(batches):
        whole = shipped.value
        place = whole.model.place()
        for shard, toxic, _, parts, packed, ends in _unpacked(batches):
            here, local = np.unique(np.append(place[parts].ravel(), 0), return_inverse=True)  # 0 stays 0
            local = local[:-1].reshape(-1, _PARTS).astype(np.int32)
            own = whole.part(here)
            before = own.sq_e.copy()
            one_pass(own, local, np.split(packed, ends[:-1]), toxic, np.random.default_rng([seed, turn, shard]))
            gain = (own.sq_e - before).ravel()
            moved = np.flatnonzero(gain > 0)
            head = own.head()
            head = np.append(head, np.zeros(-len(head) % DIM)).reshape(-1, DIM)
            key = np.r_[here[moved], -1 - np.arange(len(head))]
            table = np.r_[np.c_[own.model.embedding[moved], own.sq_e[moved]], np.c_[head, np.zeros(len(head))]].astype(np.float64)
            weight = np.r_[np.maximum(np.rint(gain[moved] * _UNIT * 256.0), 1), np.full(len(head), _UNIT)].astype(np.int64)
            sums = np.rint(table * weight[:, None] * _UNIT).astype(np.int64)
            yield {"key": key, "weight": weight} | {v: sums[:, i] for i, v in enumerate(values)}

    got = map_rows(blocks, learn, ", ".join(["key long, weight long", *(f"{v} long" for v in values)]))
    mean = [(F.sum(v) / F.sum("weight") / _UNIT).cast("float").alias(v) for v in values]
    table = got.groupBy("key").agg(*mean).toArrow()  # a row per known bucket at most, and the head
    key, table = table["key"].to_numpy(), np.column_stack([table[v].to_numpy() for v in values])
    shipped.destroy()
    rows, head = key > 0, np.argsort(-key)[np.sort(-key) > 0]
    learner.model.embedding[key[rows]] = table[rows, :DIM]
    learner.sq_e[key[rows]] = table[rows, DIM:]
    learner.set_head(table[head, :DIM].ravel())


def _best_cut(cell: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> float:
    """The middle of the range of cuts with the best F1, from numbers of toxic and other rows per cell."""
    order = np.argsort(-cell)
    cell, toxic, clean = cell[order], toxic[order], clean[order]
    hit = np.cumsum(toxic)
    best = int(np.argmax(2 * hit / (hit + np.cumsum(clean) + toxic.sum())))
    below = cell[best + 1] if best + 1 < len(cell) else cell[best] - _FINE
    return float((cell[best] + below + 1) / 2 / _FINE)


def _cells(blocks: DataFrame, model: Model):
    """Numbers of rows per language, cell of the score, and label."""
    shipped = blocks.sparkSession.sparkContext.broadcast(model)

    def count(batches):
        m = shipped.value
        place, tables, held = m.place(), m.tables(), Counter()
        for _, toxic, lang, parts, packed, ends in _unpacked(batches):
            # 0 stays what stands for no word
            local = place[np.vstack([np.full((1, _PARTS), -1), parts])]
            summed = {w: [t[local].sum(axis=1) for t in ts] for w, ts in tables.items()}
            rows = np.split(packed[:, None] + 1, ends[:-1])
            for k in range(0, len(rows), 64):
                x = logits(m, rows[k : k + 64], summed)
                held.update(zip(lang[k : k + 64], np.floor(np.clip(x, -50, 50) * _FINE).astype(int).tolist(), toxic[k : k + 64].tolist()))
        yield {"lang": [l for l, _, _ in held], "cell": [c for _, c, _ in held], "toxic": [int(t) for *_, t in held], "n": [*held.values()]}

    got = map_rows(blocks, count, "lang string, cell int, toxic int, n long").groupBy("lang", "cell")
    found = got.agg(*[F.sum(F.when(F.col("toxic") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((1, "toxic"), (0, "clean"))]).toArrow().to_pandas()
    shipped.destroy()
    return found


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> Model:
    """Train on every labelled row and calibrate on the fifth of them that the fit doesn't see."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    usable = materialize(usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)"), "toxicity-labels")
    if usable.count() <= BROADCAST_IDS:
        usable = F.broadcast(usable)
    drawn = F.crc32(F.concat(F.lit("calibrate "), F.col("doc_id").cast("string")))
    rows = docs.select("doc_id", "text", "lang").join(usable, "doc_id").withColumn("drawn", F.struct((drawn % 5).alias("rest"), drawn.alias("crc"), "doc_id"))
    # One row in five by a hash of the id calibrates, and of each class the one that comes nearest to it.
    classes = rows.groupBy("toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"), F.min("drawn").alias("first")).collect()
    if len(classes) < 2:
        return Model()
    shards = -(-sum(r["size"] for r in classes) // SHARD_BYTES) or 1
    held = F.col("drawn.rest") == 0
    for r in classes:
        held = held | (F.col("doc_id") == F.lit(r["first"]["doc_id"]))
    rows = rows.withColumns({"held": held, "shard": F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))})
    blocks = materialize(_blocks(rows), "toxicity-blocks")
    fitted, calibrating = blocks.where(~F.col("held")), blocks.where("held")
    sizes = fitted.select(F.sum(F.size("toxic")).alias("n"), F.sum(F.aggregate("toxic", F.lit(0), lambda a, x: a + x)).alias("toxic")).first()
    if not sizes["n"] or not 0 < sizes["toxic"] < sizes["n"]:
        return Model()
    learner = begin(_known_buckets(fitted), np.random.default_rng(seed))
    for turn in range(min(max(-(-VISITS // sizes["n"]), PASSES[0]), PASSES[1])):
        _turn(fitted, learner, turn, seed)
    model = learner.model
    cells = _cells(calibrating, model)
    every = cells.groupby("cell", as_index=False)[["toxic", "clean"]].sum()
    cut = _best_cut(*(every[c].to_numpy() for c in ("cell", "toxic", "clean")))
    model.out_bias -= cut
    for lang, own in cells.dropna(subset=["lang"]).groupby("lang"):
        # A language's own cut counts by the rarer of its classes, that of all languages as PRIOR rows.
        n = min(own["toxic"].sum(), own["clean"].sum())
        best = (n * _best_cut(*(own[c].to_numpy() for c in ("cell", "toxic", "clean"))) + PRIOR * cut) / (n + PRIOR) if n else cut
        model.thresholds[str(lang)] = float(1 / (1 + np.exp(cut - best)))
    return model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and flagged by the language's threshold, for every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most BUCKETS rows of DIM numbers

    def run(batches):
        m = shipped.value
        tables, place, none = m.tables(), memoryview(m.place()), (0,) * _PARTS
        combinations: dict[tuple[int, ...], int] = {none: 0}
        sums: dict[int, list[np.ndarray]] = {}  # by width: of each combination, what its parts add to the filters

        def look_up(word: str) -> int:
            """The place of the word's combination of known parts."""
            return combinations.setdefault(tuple([place[b] for b in buckets(word)]), len(combinations))

        def summed() -> dict[int, list[np.ndarray]]:
            have = len(sums[WIDTHS[0]][0]) if sums else 0
            if have < len(combinations):
                new = np.array([*islice(combinations, have, None)], np.int32)
                for w, ts in tables.items():
                    old = sums.get(w, [np.zeros((0, FILTERS), np.float32)] * len(ts))
                    sums[w] = [np.vstack([o, t[new].sum(axis=1)]) for o, t in zip(old, ts)]
            return sums

        known = Bounded(look_up)
        for b in batches:
            out, part, size, last = [], [], 0, len(b["text"]) - 1
            for i, t in enumerate(b["text"]):
                part.append(np.array([*map(known.__getitem__, words(t))], np.int32).reshape(-1, 1))
                size += len(part[-1])
                if size > 200_000 or i == last:
                    out.append(logits(m, part, summed() if tables else None))
                    part, size = [], 0
                    if len(known) > known.limit:
                        known.clear()
                        combinations.clear()
                        sums.clear()
                        combinations[none] = 0
            p = 1 / (1 + np.exp(-np.clip(np.concatenate(out or [np.zeros(0)]).astype(np.float64), -50, 50)))
            flagged = [bool(s >= m.thresholds.get(g, 0.5)) for s, g in zip(p, b["lang"])]
            yield {"doc_id": b["doc_id"], "score": p, "flagged": flagged}

    got = map_rows(docs.select("doc_id", "text", "lang"), run, f"doc_id {id_type(docs)}, score double, flagged boolean")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return got.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "flagged")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with scratch_scope():  # the model is fitted when this is left
        model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores(docs, model)
