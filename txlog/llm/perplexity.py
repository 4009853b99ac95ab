"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

Texts are streams of characters with white space runs as one space; an event is a character
after the four before it.  A character is its code point, of 21 bits: the last three characters of
a 5-gram are the integer ``lo``, the two before them ``hi``, and suffixes and contexts are bit
operations.  Within a worker, a 63-bit hash of both stands for the pair.

1. One scan gathers every distinct 5-gram of all documents with its count in trusted text
   (documents that labels call good; a language without any is not judged).
2. Counts of lower orders are numbers of distinct left extensions; discounts come from counts
   of counts per language and order.  Joining the corpus' n-grams with counts and contexts, order
   by order, gives the probability of every 5-gram of the corpus.
3. The probabilities are split by hash into shards of a bounded size (``SHARD_ROWS``).  A scan
   per shard adds up each document's log-probabilities in that shard; the sums give perplexities.
4. Per language, a document is rejected where its perplexity exceeds the ``QUANTILE`` of the
   trusted documents that were left out of the counts (one in ``HELD``, by text), with room for the
   straying of a quantile of that many values, and more room for short texts.  A language that leaves
   none out is not judged.  The rule is the same at every size.

Nulls: a null text or one without words has no perplexity and is not kept; a null language is a
language of its own; a null doc_id is never trusted.  Repeated rows each give a row; extra
columns of the input are dropped.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txlog.llm.common import FILE, ROW, documents, drop_rows, id_type, keyed, map_rows, materialize, scratch_scope, words

ORDER, BITS = 5, 21
ALPHABET = 0x110000
LOW = 3  # characters in lo
SHARD_ROWS = 2_000_000
#: Ids of trusted documents go to every scan only up to this number (16 MB); beyond, they are joined by a shuffle.
BROADCAST_IDS = 2_000_000
QUANTILE = 0.99
#: One in HELD trusted documents, by its text, is left out of the counts; the logarithm of a quantile of n of them gets
#: STRAY / sqrt(n) of room.
HELD, STRAY = 5, 0.5
_CHARS = 1_000_000
_MERGE = 1_500_000


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """5-grams (hi, lo) of all texts in a row, and how many each text has."""
    pad = " " * (ORDER - 1)
    streams = [pad + " ".join(w) if w else "" for w in map(words, texts)]
    sizes = np.array([max(0, len(s) - len(pad)) for s in streams], np.int64)
    c = np.frombuffer("".join(streams).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(c):
        return c, c, sizes
    hi, lo = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    for k in range(ORDER):  # the k-th character before the last
        (lo if k < LOW else hi)[k:] |= c[: len(c) - k] << (BITS * (k % LOW))
    own = np.ones(len(c), bool)
    full = sizes > 0
    starts = np.r_[0, np.cumsum(sizes[full] + len(pad))[:-1]]
    for k in range(len(pad)):
        own[starts + k] = False
    return hi[own], lo[own], sizes


def key_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of 63 bits."""
    h = hi.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    h = (h ^ h >> np.uint64(29) ^ lo.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ h >> np.uint64(32)) >> np.uint64(1)).astype(np.int64)


def _summed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 5-grams with the sums of n."""
    key = key_of(hi, lo)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    if not len(first):
        return hi, lo, n
    at = order[first]
    return hi[at], lo[at], np.add.reduceat(n[order], first)


def _slices(texts: list[str | None]):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _CHARS:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def corpus_grams(docs: DataFrame) -> DataFrame:
    """(lang, hi, lo, n): every 5-gram of documents (lang, text, trusted) with its count in trusted ones."""

    def run(batches):
        held: dict[str | None, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        rows = 0

        def merged(parts):
            return _summed(*map(np.concatenate, zip(*parts)))

        def flush():
            for lang, parts in held.items():
                hi, lo, n = merged(parts)
                for k in range(0, len(n), 200_000):
                    h = hi[k : k + 200_000]
                    yield {"lang": [lang] * len(h), "hi": h, "lo": lo[k : k + 200_000], "n": n[k : k + 200_000]}

        for b in batches:
            for part in _slices(b["text"]):
                langs, trusted = b["lang"][part], b["trusted"][part]
                for lang, good in {*zip(langs, trusted)}:
                    hi, lo, _ = codes([t for t, g, k in zip(b["text"][part], langs, trusted) if g == lang and k == good])
                    found = _summed(hi, lo, np.full(len(lo), 1 if good else 0, np.int64))
                    held.setdefault(lang, []).append(found)
                    rows += len(found[0])
                if rows > _MERGE:
                    held = {lang: [merged(parts)] for lang, parts in held.items()}
                    rows = sum(len(p[0][0]) for p in held.values())
                    if rows > _MERGE // 2:
                        yield from flush()
                        held, rows = {}, 0
        yield from flush()

    found = map_rows(docs.select("lang", "text", "trusted"), run, "lang string, hi long, lo long, n long")
    return found.groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n"))


def _suffix(order: int, hi: str = "hi", lo: str = "lo") -> list[Column]:
    """The last characters of (hi, lo), under the given names."""
    low = F.col("lo") if order >= LOW else F.col("lo").bitwiseAND(F.lit((1 << (BITS * order)) - 1).cast("long"))
    high = F.col("hi").bitwiseAND(F.lit((1 << (BITS * max(0, order - LOW))) - 1).cast("long"))
    return [high.alias(hi), low.alias(lo)]


def _context() -> list[Column]:
    """All characters of (hi, lo) but the last, as chi and clo."""
    moved = F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << BITS) - 1).cast("long")), BITS * (LOW - 1))
    return [F.shiftright("hi", BITS).alias("chi"), F.shiftright("lo", BITS).bitwiseOR(moved).alias("clo")]


def _join(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null languages match."""
    right = b.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [a[k].eqNullSafe(right[f"_{k}"]) for k in keys]
    return a.join(right, on, how).drop(*[f"_{k}" for k in keys])


def probabilities(grams: DataFrame) -> DataFrame:
    """(lang, hi, lo, p): the probability of the last character of every 5-gram of (lang, hi, lo, n)."""
    count = grams.where("n > 0").select(F.lit(ORDER).alias("k"), "lang", "hi", "lo", "n")
    tables = [count]
    for k in range(ORDER - 1, 0, -1):
        count = count.groupBy("lang", *_suffix(k)).agg(F.count("*").alias("n"))
        count = count.select(F.lit(k).alias("k"), "lang", "hi", "lo", "n")
        tables.append(count)
    counts = tables[0]
    for t in tables[1:]:
        counts = counts.union(t)
    counts = materialize(counts, "kn-counts")

    m = [F.count(F.when(F.col("n") == i, 1)).cast("double") for i in range(1, 5)]
    few = counts.groupBy("k", "lang").agg(*[c.alias(f"m{i}") for i, c in enumerate(m, 1)])
    y = F.col("m1") / (F.col("m1") + 2 * F.col("m2"))
    usual = (F.col("m1") > 0) & (F.col("m2") > 0) & (F.col("m3") > 0) & (F.col("m4") > 0)
    # Where a count of counts is missing, half of what is usual at most is taken off.
    d = [F.when(usual, F.greatest(F.lit(0.1), F.least(F.lit(0.95 * i), i - (i + 1) * y * F.try_divide(F.col(f"m{i + 1}"), F.col(f"m{i}"))))).otherwise(0.5 * i) for i in range(1, 4)]
    discounts = materialize(few.select("k", "lang", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)]), "kn-discounts")

    n = F.col("n")
    cut = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
    parts = _join(counts, discounts, ["k", "lang"], "inner").select("k", "lang", "hi", "lo", *_context(), "n", cut.alias("cut"))
    context = parts.groupBy("k", "lang", "chi", "clo").agg(F.sum("n").alias("total"), F.sum("cut").alias("left"))
    seen = materialize(_join(parts, context, ["k", "lang", "chi", "clo"], "inner").select("k", "lang", "hi", "lo", ((n - F.col("cut")) / F.col("total")).alias("own")), "kn-seen")
    weights = materialize(context.select("k", "lang", "chi", "clo", (F.col("left") / F.col("total")).alias("weight")), "kn-weights")

    lower = None
    for k in range(1, ORDER + 1):
        asked = grams.select("lang", *_suffix(k))
        asked = asked.distinct() if k < ORDER else asked
        asked = asked.select("lang", "hi", "lo", *_context(), *_suffix(k - 1, "rhi", "rlo"))
        got = _join(asked, seen.where(F.col("k") == k).drop("k"), ["lang", "hi", "lo"], "left")
        got = _join(got, weights.where(F.col("k") == k).drop("k"), ["lang", "chi", "clo"], "left")
        if lower is None:
            got = got.withColumn("below", F.lit(1.0 / ALPHABET))
        else:
            got = _join(got, lower.select("lang", F.col("hi").alias("rhi"), F.col("lo").alias("rlo"), F.col("p").alias("below")), ["lang", "rhi", "rlo"], "inner")
        p = F.coalesce("own", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("below")
        lower = materialize(got.select("lang", "hi", "lo", p.alias("p")), f"kn-{k}")
    return lower


class Lookup:
    """log-probabilities by gram: direct slots, and a further level for grams whose slot is taken."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.levels = []
        while len(grams):
            bits = max(4, int(np.ceil(np.log2(1.5 * len(grams)))))
            at = self._slot(grams, bits)
            keys, vals = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.float32)
            keys[at], vals[at] = grams, values
            self.levels.append((bits, keys, vals))
            lost = keys[at] != grams
            grams, values = grams[lost], values[lost]

    @staticmethod
    def _slot(grams: np.ndarray, bits: int) -> np.ndarray:
        return (grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        """0 for grams that are not here (they lie in another shard)."""
        out = np.zeros(len(grams), np.float64)
        todo = np.arange(len(grams))
        for bits, keys, vals in self.levels:
            g = grams[todo]
            at = self._slot(g, bits)
            hit = keys[at] == g
            out[todo[hit]] = vals[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out


class Table:
    """A shard as packed arrays; a worker builds the lookups when it first needs them."""

    def __init__(self, parts: dict[str | None, tuple[np.ndarray, np.ndarray]]):
        self.parts = parts
        self._lookups: dict | None = None

    def __getstate__(self):
        return {"parts": self.parts, "_lookups": None}

    @property
    def lookups(self) -> dict[str | None, Lookup]:
        if self._lookups is None:
            self._lookups = {lang: Lookup(g, v) for lang, (g, v) in self.parts.items()}
            self.parts = {}
        return self._lookups


def _collect(shard: DataFrame) -> Table:
    """SHARD_ROWS grams or a little more, 12 bytes each."""

    def pack(batches):
        for b in batches:
            langs = {*b["lang"]}
            which = {lang: [i for i, g in enumerate(b["lang"]) if g == lang] for lang in langs}
            g, p = key_of(np.array(b["hi"], np.int64), np.array(b["lo"], np.int64)), np.log(np.array(b["p"]))
            yield {"lang": [*which], "grams": [g[i].tobytes() for i in which.values()], "logs": [p[i].astype("<f4").tobytes() for i in which.values()]}

    parts: dict[str | None, list[tuple[bytes, bytes]]] = {}
    for r in map_rows(shard.select("lang", "hi", "lo", "p"), pack, "lang string, grams binary, logs binary").collect():
        parts.setdefault(r["lang"], []).append((bytes(r["grams"]), bytes(r["logs"])))
    joined = {k: (b"".join(g for g, _ in v), b"".join(x for _, x in v)) for k, v in parts.items()}
    return Table({k: (np.frombuffer(g, "<i8"), np.frombuffer(v, "<f4")) for k, (g, v) in joined.items()})


def _score_shard(docs: DataFrame, shard: DataFrame) -> DataFrame:
    """The documents' sums over one shard, written, so that no shard outlives its scan."""
    shipped = docs.sparkSession.sparkContext.broadcast(_collect(shard))

    def run(batches):
        tables = shipped.value.lookups
        for b in batches:
            sums, sizes = [], []
            for part in _slices(b["text"]):
                hi, lo, n = codes(b["text"][part])
                grams = key_of(hi, lo)
                owner = np.repeat(np.arange(len(n)), n)
                langs = b["lang"][part]
                total = np.zeros(len(n))
                if len(grams):
                    value = np.zeros(len(grams))
                    for lang in {*langs} & {*tables}:
                        mine = np.array([g == lang for g in langs])[owner]
                        value[mine] = tables[lang](grams[mine])
                    total = np.bincount(owner, value, len(n))
                sums.append(total)
                sizes.append(n)
            empty = np.zeros(0)
            yield {k: b[k] for k in (FILE, ROW, "doc_id", "lang", "trusted", "held")} | {"logp": np.concatenate(sums or [empty]), "n_chars": np.concatenate(sizes or [empty.astype(np.int64)])}

    rows = docs.select(FILE, ROW, "doc_id", "lang", "text", "trusted", "held")
    sums = materialize(map_rows(rows, run, f"{FILE} long, {ROW} long, doc_id {id_type(docs)}, lang string, trusted boolean, held boolean, logp double, n_chars long"), "kn-sums")
    shipped.destroy()
    return sums


def with_trust(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The key, doc_id, lang, text, whether labels call the document good, and whether it is held back from the counts."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct().withColumn("good", F.lit(True))
    if good.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    docs = docs.select(FILE, ROW, "doc_id", "lang", "text").join(good, "doc_id", "left")
    docs = docs.select(FILE, ROW, "doc_id", "lang", "text", F.coalesce("good", F.lit(False)).alias("trusted"))
    return docs.withColumn("held", F.col("trusted") & (F.pmod(F.xxhash64("text"), F.lit(HELD)) == 0))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The key, doc_id, lang, trusted, held, n_chars and perplexity of every keyed document (null without words)."""
    rows = with_trust(docs, labels)
    grams = materialize(corpus_grams(rows.withColumn("trusted", F.expr("trusted and not held"))), "grams")
    p = probabilities(grams)
    shards = -(-p.count() // SHARD_ROWS) or 1
    place = F.pmod(F.xxhash64("hi", "lo", "lang"), F.lit(shards))
    parts = [_score_shard(rows, p.where(place == s)) for s in range(shards)]
    got = parts[0]
    if shards > 1:
        for x in parts[1:]:
            got = got.union(x)
        got = got.groupBy(FILE, ROW, "doc_id", "lang", "trusted", "held").agg(F.sum("logp").alias("logp"), F.max("n_chars").alias("n_chars"))
    ppl = F.when(F.col("n_chars") > 0, F.exp(-F.col("logp") / F.col("n_chars")))
    return materialize(got.select(FILE, ROW, "doc_id", "lang", "trusted", "held", "n_chars", ppl.alias("perplexity")), "perplexity")


def judge(scored: DataFrame) -> DataFrame:
    """Perplexities with the language's ``threshold`` and ``kept``."""
    cells = scored.where("held and perplexity is not null").groupBy("lang", F.floor(F.log("perplexity") * 1000).alias("cell")).agg(F.count("*").alias("n"))
    run, every = Window.partitionBy("lang").orderBy("cell"), Window.partitionBy("lang")  # some thousand cells a language
    ranked = cells.withColumn("upto", F.sum("n").over(run)).withColumn("all", F.sum("n").over(every))
    cut = ranked.where(F.col("upto") >= QUANTILE * F.col("all")).groupBy("lang")
    cut = cut.agg(F.exp((F.min("cell") + 1) / 1000 + STRAY / F.sqrt(F.max("all"))).alias("threshold"))
    out = _join(scored, cut, ["lang"], "left")
    # A mean over n characters strays by some 2 / sqrt(n): short texts get that much more room.
    room = F.exp(2 / F.sqrt(F.greatest("n_chars", F.lit(1))))
    return out.withColumn("kept", F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold") * room, F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(documents(spark, sf_dir))
    return judge(perplexities(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).drop(FILE, ROW)


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, all columns.  Each row is judged for itself, also where ids
    are null or repeat."""
    rows = keyed(docs)
    with scratch_scope():
        losers = materialize(judge(perplexities(rows, labels)).where(~F.col("kept")).select(FILE, ROW), "dropped", keep=True)
    return drop_rows(rows, losers)
