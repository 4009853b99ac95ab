"""Repeated word windows, by compaction of a sparse De Bruijn graph.

A window of ``window`` words is represented by its smallest-hash ``k``-mer (leftmost on ties), so
equal windows anywhere choose the same k-mer at the same place.  The k-mers so chosen are the
graph's nodes; the maximal stretch of windows that share one occurrence of a k-mer is a segment,
an edge through it with everything that its windows reach.

1. One scan emits each text's segments: k-mer, hash of the segment's whole span, source coordinate.
2. Nodes that occur once are dropped.  A repeated node through which only one segment passes is
   nonbranching: all its windows are repeated, and runs of such segments compact into one path.
3. At branching nodes segments are counted by content.  Those that occur again are whole parts
   of repeated paths; for the others the source coordinates lead back to the texts, and each
   window's own hash is compared with those of all segments of that node.
4. Words covered by a repeated window are removed.

All groupings are aggregates that combine before they shuffle, or joins that Spark may split, so
a passage that a third of all texts share makes no large task.  Tables that grow with the corpus are
joined by a shuffle at any size, so that plans are alike at every size.

Nulls: a null text has no words (0 words, digest of the empty string).  Texts shorter than a
window keep all words.  Rows are told apart by their places in the table, so null, repeated or shared
ids make no difference, and rows that repeat entirely count as two places.  Extra columns, whatever
their names, are dropped by ``removed`` and kept by ``dedup_documents``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.llm.common import FILE, ROW, documents, id_type, keyed, map_rows, materialize, scratch_scope, words
from txlog.llm.vocab import Bounded

WINDOW, K = 35, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SLICE = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of word spans of one sequence, any length at once."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)].astype(np.uint64))
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE_INV)].astype(np.uint64))
        self.sums = np.r_[np.uint64(0), np.cumsum(h * power[:n])]

    def spans(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * self.inverse[a])


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def segments(h: Hashes, sizes: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, k-mer, span hash) of all segments of texts laid in a row."""
    n = int(sizes.sum())
    if n < window:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    at = np.arange(n - k + 1)
    low, place = h.spans(at, at + k), at
    size, width = 1, window - k + 1
    while size < width:
        step = min(size, width - size)
        left = low[:-step] <= low[step:]
        low, place = np.where(left, low[:-step], low[step:]), np.where(left, place[:-step], place[step:])
        size += step
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(low)]
    start = np.arange(len(low))
    ok = start + window <= ends[owner]
    start, place, low, owner = start[ok], place[ok], low[ok], owner[ok]
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    a = start[first]
    span = h.spans(a, a + count - 1 + window)
    return owner[first], a - (ends - sizes)[owner[first]], count, low[first].view(np.int64), span.view(np.int64)


def _cache() -> Bounded:
    return Bounded(word_hash, 500_000)


def _hashed(cache: Bounded, w: list[str]) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))


def segment_table(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(kmer, span, file, row, at, n) of every segment of keyed documents."""

    def run(batches):
        cache = _cache()
        for b in batches:
            part, ids, size = [], [], 0
            last = len(b["text"]) - 1
            for i, (file, row, text) in enumerate(zip(b[FILE], b[ROW], b["text"])):
                w = words(text)
                if len(w) >= window:
                    part.append(_hashed(cache, w))
                    ids.append((file, row))
                    size += len(w)
                if part and (size > _SLICE or i == last):
                    own, at, n, kmer, span = segments(Hashes(np.concatenate(part)), np.array([len(p) for p in part]), window, k)
                    key = np.array(ids, np.int64)[own]
                    yield {"kmer": kmer, "span": span, "file": key[:, 0], "row": key[:, 1], "at": at.astype(np.int32), "n": n.astype(np.int32)}
                    part, ids, size = [], [], 0
                    cache.trim()

    return map_rows(docs.select(FILE, ROW, "text"), run, "kmer long, span long, file long, row long, at int, n int")


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(file, row, spans) of keyed documents: the stretches (first window, windows) whose windows occur again."""
    with scratch_scope():
        table = materialize(segment_table(docs, window, k), "segments")
        nodes = table.groupBy("kmer").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
        # Written first: were they aggregated in the same job, on the same key, Spark could not split a hot k-mer in the join.
        nodes = materialize(nodes.where("n > 1").select("kmer", (F.col("lo") != F.col("hi")).alias("branching")), "nodes")
        live = materialize(table.join(nodes.hint("merge"), "kmer"), "repeated-segments")
        paths = live.where("not branching").select("file", "row", "at", "n")

        edges = live.where("branching").groupBy("kmer", "span", "n").agg(F.count("*").alias("copies"), F.min(F.struct("file", "row", "at")).alias("source"))
        edges = materialize(edges, "edges")
        again = live.where("branching").join(edges.where("copies > 1").select("kmer", "span", "n"), ["kmer", "span", "n"], "left_semi").select("file", "row", "at", "n")

        asked = edges.select("source.file", "source.row", F.struct(F.col("source.at").alias("at"), "n", "copies", "kmer").alias("s"))
        asked = asked.groupBy("file", "row").agg(F.collect_list("s").alias("asked"))  # a text's own segments: no more than it has words

        def window_hashes(batches):
            cache = _cache()
            for b in batches:
                for file, row, text, spans in zip(b["file"], b["row"], b["text"], b["asked"]):
                    h = Hashes(_hashed(cache, words(text)))
                    n = np.array([s["n"] for s in spans])
                    first = np.repeat([s["at"] for s in spans], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    copies, kmer = np.repeat([s["copies"] for s in spans], n), np.repeat([s["kmer"] for s in spans], n)
                    hashes = h.spans(first, first + window).view(np.int64)
                    yield {"kmer": kmer, "hash": hashes, "copies": copies, "file": np.full(len(first), file), "row": np.full(len(first), row), "at": first.astype(np.int32)}
                cache.trim()

        texts = docs.select(F.col(FILE).alias("file"), F.col(ROW).alias("row"), "text").join(asked.hint("merge"), ["file", "row"])
        found = materialize(map_rows(texts, window_hashes, "kmer long, hash long, copies long, file long, row long, at int"), "windows")
        twice = found.groupBy("kmer", "hash").agg(F.sum("copies").alias("c")).where("c > 1").select("kmer", "hash")
        twice = materialize(twice, "repeated-windows")
        single = found.where("copies = 1").join(twice.hint("merge"), ["kmer", "hash"], "left_semi").select("file", "row", "at", F.lit(1).alias("n"))

        marks = paths.union(again).union(single)
        spans = marks.groupBy("file", "row").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"))
        return materialize(spans, "spans", keep=True)


def _covered(n: int, spans: list | None, window: int) -> np.ndarray:
    """Words of a text that some repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans or []:
        if s["at"] < n:
            edge[s["at"]] += 1
            edge[min(n, s["at"] + s["n"] - 1 + window)] -= 1
    return np.cumsum(edge[:n]) > 0


def removed(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words kept, of every text."""

    def run(batches):
        for b in batches:
            out = []
            for text, spans in zip(b["text"], b["spans"]):
                w = words(text)
                gone = _covered(len(w), spans, window)
                kept = " ".join([x for x, g in zip(w, gone) if not g]) if spans else " ".join(w)
                out.append((len(w), int(gone.sum()), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
            yield {"doc_id": b["doc_id"]} | dict(zip(("n_words", "n_removed", "kept_sha256"), zip(*out)))

    rows = keyed(docs)
    spans = repeated_spans(rows, window, k)
    texts = rows.select(F.col(FILE).alias("file"), F.col(ROW).alias("row"), "doc_id", "text").join(spans.hint("merge"), ["file", "row"], "left")
    return map_rows(texts.select("doc_id", "text", "spans"), run, f"doc_id {id_type(rows)}, n_words long, n_removed long, kept_sha256 string")


def dedup_documents(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Documents, all columns, with the repeated words cut out of their texts (words then joined by one
    space) and n_chars, where there is one, counted again; texts without repeats stay as they are."""
    names = docs.columns
    own = [f"v{i}" for i in range(len(names))]  # columns go by their places, whatever they are called
    at = own[names.index("text")]

    def run(batches):
        for b in batches:
            texts = b[at]
            for i, (text, spans) in enumerate(zip(texts, b["spans"])):
                if spans:
                    w = words(text)
                    texts[i] = " ".join([x for x, g in zip(w, _covered(len(w), spans, window)) if not g])
            yield {v: b[v] for v in own}

    rows = keyed(docs)
    placed = rows.select(F.col(FILE).alias("file"), F.col(ROW).alias("row"), *[F.col("`" + c.replace("`", "``") + "`").alias(v) for c, v in zip(names, own)])
    texts = placed.join(repeated_spans(rows, window, k).hint("merge"), ["file", "row"], "left").select(*own, "spans")
    out = map_rows(texts, run, ", ".join(f"{v} {f.dataType.simpleString()}" for v, f in zip(own, docs.schema))).toDF(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
i as (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35),
s as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as s from i),
twice as (select s from s group by s having count(*) > 1),
hit as (select doc_id, i from s semi join twice using (s)),
gone as (select distinct doc_id, i + o as pos from hit, (select unnest(range(0, 35)) as o)),
x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos from d),
k as (select x.doc_id, count(gone.pos) as n_removed, string_agg(word, ' ' order by x.pos) filter (where gone.pos is null) as kept from x left join gone using (doc_id, pos) group by x.doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(documents(spark, sf_dir))
