"""Collocations: phrases that occur more often than their parts let expect, found in an FM-index per shard.

A shard is a bounded run of one language's texts as numbers of words, cut at punctuation.  Words that
are too rare for any phrase cut it as well.  Over the rest each shard has an FM-index of both
directions: the Burrows-Wheeler transforms of the sequence and of its mirror image, of suffixes
sorted by as many words as a phrase may have.  A phrase is a pair of intervals, one in each.  Phrases
of two words come from extending words to the left, those of three from extending to the right, and
so on in turn: an extension moves one interval by the transform's rank and narrows the other by what
sorts before it.  The phrase of equal length that the longer one shares all but a word with is the
one whose interval holds the new interval.

Counts are summed across shards after each length, and only phrases that reach ``least`` are extended
further; as no part of a phrase is rarer than the phrase, that loses none.  A level of at most ``BROADCAST``
phrases is sent to the tasks; of larger ones each shard is sent what it holds, by joins.  A phrase is the
pair of the phrases that it begins and ends with, all by number; their counts give the parts' counts of
every cut.

Nulls: a null text is empty, a null language ``und``.  Repeated rows count each; empty texts and an empty
table give no phrases; a text of any length lies whole in one shard; extra columns are not used.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txlog.llm.common import _ODD_SPACE, documents, map_rows, materialize, scratch_scope

#: Words of a shard; it is closed behind the text that reaches them.
SHARD_WORDS = 2_000_000
#: Levels of at most so many rows of three integers are sent to the tasks; larger ones are joined by a shuffle.
BROADCAST = 1_000_000
SALTS = 32
_CUT = re.compile("[.,;:!?\n-\r]")
_UPPER = re.compile("[A-Z]+")
_WORD = re.compile("[^ \t]+")
#: Rows of phrases (the shard's ``at``th, with its ends and how often it occurs), and one row per shard with its packed arrays.
_ROWS = "shard long, at int, n int, prefix long, suffix long, left binary, right binary, main binary, other binary, counts binary, heads binary, tails binary"


class _Numbers(dict):
    """Words numbered as they come; a lone full stop, which no word is, is 0."""

    def __init__(self):
        self["."] = 0

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return self[word]


def pack(numbers: np.ndarray) -> bytes:
    """Integers as compressed planes of their first, second, ... bytes."""
    planes = np.ascontiguousarray(numbers, "<i8" if numbers.max(initial=0) >= 1 << 31 else "<i4")
    width = planes.itemsize
    return bytes([width]) + zstandard.compress(planes.view(np.uint8).reshape(-1, width).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<i{data[0]}").ravel().astype(np.int64)


def phrase_words(text: str) -> list[str]:
    """Words, with A-Z in lower case, and a full stop where pieces end."""
    text = text.lower() if text.isascii() else _UPPER.sub(lambda m: m.group().lower(), text)
    text = _CUT.sub(" . ", text)
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, lang, n, words, counts, sequence): the words of a shard, how often each occurs, and the texts as numbers
    (1 for the first of ``words``) with 0 between pieces."""

    def cut(batches):
        part, closed, held = TaskContext.get().partitionId(), 0, {}

        def close(lang):
            nonlocal closed
            numbers, runs, _ = held.pop(lang)
            seq = np.concatenate(runs)
            counts = np.bincount(seq, minlength=len(numbers))[1:]
            closed += 1
            return {"shard": [part << 32 | closed], "lang": [lang], "n": [int(counts.sum())], "words": [[*numbers][1:]], "counts": [counts.tolist()], "sequence": [pack(seq)]}

        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                found = phrase_words(text or "")
                own = held.setdefault("und" if lang is None else lang, [_Numbers(), [], 0])
                own[1].append(np.fromiter(map(own[0].__getitem__, [*found, "."]), np.int32, len(found) + 1))
                own[2] += len(found)
                if own[2] >= shard_words:
                    yield close("und" if lang is None else lang)
        for lang in [*held]:
            yield close(lang)

    return map_rows(docs.select("lang", "text"), cut, "shard long, lang string, n long, words array<string>, counts array<long>, sequence binary")


def transform(symbols: np.ndarray, depth: int) -> np.ndarray:
    """The symbol before each suffix, in the order of the suffixes' first ``depth`` symbols up to a 0; ``symbols`` end with 0."""
    n, alive, packed = len(symbols), np.ones(len(symbols), bool), []
    for k in range(0, depth, 2):
        pair = np.zeros(n, np.int64)
        for at in range(k, min(k + 2, depth)):
            key = np.zeros(n, np.int64)
            key[: max(n - at, 0)] = symbols[at:]
            alive &= key > 0
            key *= alive
            pair |= key << 31 if at == k else key
        packed.append(pair)
    order = np.lexsort(packed[::-1])
    order -= 1
    return symbols[order].astype(np.int32)


def extend(bwt: np.ndarray, main: np.ndarray, other: np.ndarray, n: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """All phrases of a word more: intervals of length ``n`` from ``main`` in the transform and from ``other`` in the mirrored
    one.  Gives main, other, n, the number of the phrase that was extended, and that of the phrase at the other end; phrases
    whose other end is none of those given are left out."""
    order = np.argsort(main)
    main, other, n, number = main[order], other[order], n[order], number[order]
    starts, total = np.cumsum(n) - n, int(n.sum())
    kind = np.int32 if max(total, len(bwt)) < 1 << 31 else np.int64  # a shard's arrays are what takes the memory
    rows = np.arange(total, dtype=kind)
    rows += np.repeat((main - starts).astype(kind), n)
    width = int(bwt.max(initial=0)) + 1
    key = np.repeat(np.arange(len(n)) * width, n)
    key += bwt[rows]
    by = np.argsort(key, kind="stable")
    key = key[by]
    heads = np.flatnonzero(np.append(total > 0, key[1:] != key[:-1]))
    found, first, count = key[heads], rows[by[heads]], np.diff(np.append(heads, total))
    del key, by, rows, heads
    of = found // width
    lower = np.cumsum(count) - count - starts[of]  # of the interval, what is followed by smaller symbols
    step = np.empty(len(bwt), kind)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt), dtype=kind)
    moved = step[first].astype(np.int64)
    del step
    at = np.maximum(np.searchsorted(main, moved, "right") - 1, 0)
    keep = (found % width > 0) & (moved >= main[at]) & (moved < main[at] + n[at])
    return moved[keep], (other[of] + lower)[keep], count[keep], number[of][keep], number[at][keep]


def _compact(symbols: np.ndarray) -> np.ndarray:
    """Without symbols between two zeros, nor zeros next to each other; ends with 0."""
    symbols = np.append(symbols, 0)
    before, after = np.append(0, symbols[:-1]), np.append(symbols[1:], 0)
    symbols = symbols[(symbols > 0) & ((before > 0) | (after > 0)) | (symbols == 0) & (before > 0)]
    before = np.append(0, symbols[:-1])
    return np.append(symbols[(symbols > 0) | (before > 0)], 0)


def mirrored(symbols: np.ndarray) -> np.ndarray:
    return np.append(symbols[-2::-1], 0)


def _rows(shard: int, got: tuple[np.ndarray, ...], to_left: bool, **index: bytes) -> pa.Table:
    """The rows of what ``extend`` has given."""
    main, other, n, near, far = got
    if not to_left:
        main, other, near, far = other, main, far, near
    size = len(n)
    grams = {"shard": np.full(size, shard), "at": np.arange(size), "n": n, "prefix": far, "suffix": near}
    state = {"shard": shard} | index | {k: pack(v) for k, v in {"main": main, "other": other, "counts": n, "heads": far, "tails": near}.items()}
    # Straight into Arrow: a frame would hold the rows several times.
    parts = [[pa.array(grams[f.name], f.type) if f.name in grams else pa.nulls(size, f.type) for f in _FIELDS], [pa.array([state.get(f.name)], f.type) for f in _FIELDS]]
    return pa.concat_tables([pa.Table.from_arrays(x, schema=_FIELDS) for x in parts])


_FIELDS = pa.schema([(name, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for name, kind in map(str.split, _ROWS.split(", "))])


def _indexed(parts: DataFrame, known: DataFrame, depth: int) -> DataFrame:
    """Per shard its two transforms and the phrases of two words."""

    def build(shard_rows: pa.Table, words: pa.Table) -> pa.Table:
        shard, seq = shard_rows["own"][0].as_py(), unpack(shard_rows["sequence"][0].as_py())
        local, number = (words[c].to_numpy() for c in ("local", "number"))
        order = np.argsort(local)
        local, number = local[order], number[order]
        symbol = np.zeros(max(int(seq.max(initial=0)), int(local.max(initial=0))) + 1, np.int32)
        symbol[local] = np.arange(1, len(local) + 1)
        symbols = _compact(symbol[seq])
        del seq
        left, right = transform(symbols, depth), transform(mirrored(symbols), depth)
        n = np.bincount(symbols, minlength=len(local) + 1)
        start, there = (np.cumsum(n) - n)[1:], n[1:] > 0
        got = extend(left, start[there], start[there], n[1:][there], number[there])
        return _rows(shard, got, True, left=pack(left), right=pack(right))

    both = parts.select(F.col("shard").alias("own"), "sequence").groupBy("own").cogroup(known.groupBy("shard"))
    return both.applyInArrow(build, _ROWS)


def _grow(row: dict, at: np.ndarray, number: np.ndarray, left: bool, last: bool) -> pa.Table:
    """Extends the shard's phrases ``at``, which have these numbers."""
    main, other, n = (unpack(row[x])[at] for x in ("main", "other", "counts"))
    if not left:
        main, other = other, main
    got = extend(unpack(row["left" if left else "right"]).astype(np.int32), main, other, n, number)
    return _rows(row["shard"], got, left, **({} if last else {"left": row["left"], "right": row["right"]}))


class Lookup:
    """Numbers of the phrases of a level, by their ends."""

    def __init__(self, prefix: np.ndarray, suffix: np.ndarray, number: np.ndarray):
        self.ends = np.unique(prefix), np.unique(suffix)
        key = np.searchsorted(self.ends[0], prefix) * len(self.ends[1]) + np.searchsorted(self.ends[1], suffix)
        order = np.argsort(key)
        self.key, self.number = key[order], number[order]

    def find(self, prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs are there, and their numbers."""
        if not len(self.key):
            return np.zeros(0, int), np.zeros(0, int)
        at = [np.minimum(np.searchsorted(ends, x), len(ends) - 1) for ends, x in zip(self.ends, (prefix, suffix))]
        there = (self.ends[0][at[0]] == prefix) & (self.ends[1][at[1]] == suffix)
        key = at[0] * len(self.ends[1]) + at[1]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        found = np.flatnonzero(there & (self.key[place] == key))
        return found, self.number[place[found]]


def _extended(state: DataFrame, level: DataFrame, left: bool, last: bool) -> DataFrame:
    """The phrases of a word more than ``level``'s, of the shards whose rows ``state`` holds."""
    grams, index = state.where("n is not null").select("shard", "at", "prefix", "suffix"), state.where("counts is not null").drop("at", "n", "prefix", "suffix")
    if level.count() <= BROADCAST:
        table = level.select("prefix", "suffix", "number").toPandas()
        shipped = level.sparkSession.sparkContext.broadcast(Lookup(*(table[c].to_numpy(np.int64) for c in table.columns)))

        def grow_each(batches):
            for b in batches:
                for i in range(b.num_rows):
                    row = b.slice(i, 1).to_pylist()[0]
                    yield from _grow(row, *shipped.value.find(unpack(row["heads"]), unpack(row["tails"])), left, last).to_batches()

        return index.mapInArrow(grow_each, _ROWS)

    def grow(shard_rows: pa.Table, known: pa.Table) -> pa.Table:
        if not shard_rows.num_rows:
            return _FIELDS.empty_table()
        row = shard_rows.rename_columns(["shard", *shard_rows.column_names[1:]]).to_pylist()[0]
        return _grow(row, known["at"].to_numpy().astype(np.int64), known["number"].to_numpy(), left, last)

    known = grams.join(level.select("prefix", "suffix", "number"), ["prefix", "suffix"]).select("shard", "at", "number")
    return index.select(F.col("shard").alias("own"), *index.columns[1:]).groupBy("own").cogroup(known.groupBy("shard")).applyInArrow(grow, _ROWS)


def _numbered(level: DataFrame, name: str) -> DataFrame:
    """With ``number`` from 0 on."""
    level = materialize(level.withColumn("place", F.monotonically_increasing_id()), name)
    task = F.shiftrightunsigned("place", 33).alias("task")
    sizes = sorted((r["task"], r["count"]) for r in level.groupBy(task).count().collect())
    start, first = {}, 0
    for k, n in sizes:
        start[k], first = first, first + n
    # One entry per task that wrote rows.
    starts = F.broadcast(level.sparkSession.createDataFrame([(k, v) for k, v in start.items()], "task long, start long"))
    inner = F.col("place").bitwiseAND((1 << 33) - 1)
    return level.withColumn("task", task).join(starts, "task").withColumn("number", F.col("start") + inner).drop("task", "start", "place")


def phrase_levels(parts: DataFrame, least: int, depth: int) -> list[DataFrame]:
    """For 1 to ``depth`` words the phrases that occur ``least`` times or more in their language: number, lang, phrase,
    last (word), f, heads and tails (counts of the first and of the last 1, 2, ... words), prefix and suffix (numbers of
    the phrases without the last and without the first word)."""
    words = parts.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    words = words.select("shard", "lang", (F.col("at") + 1).alias("local"), F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    one = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    none = F.lit(None).cast("long")
    one = one.select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), none.alias("prefix"), none.alias("suffix"))
    levels = [_numbered(one, "words")]
    numbers = levels[0].select("lang", F.col("phrase").alias("word"), "number")
    known = words.join(numbers, ["lang", "word"]).select("shard", "local", "number")
    state = materialize(_indexed(parts, known, depth), "index")
    for size in range(2, depth + 1):
        below = levels[-1]
        total = state.where("n is not null").groupBy("prefix", "suffix").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
        heads = below.select(F.col("number").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("heads").alias("h"))
        tails = below.select(F.col("number").alias("suffix"), "last", F.col("tails").alias("t"))
        phrase = F.concat_ws(" ", "head", "last").alias("phrase")
        level = total.join(heads, "prefix").join(tails, "suffix")
        level = level.select("lang", phrase, "last", "f", F.concat("h", F.array("f")).alias("heads"), F.concat("t", F.array("f")).alias("tails"), "prefix", "suffix")
        levels.append(_numbered(level, f"phrases-{size}"))
        if size < depth:
            state = materialize(_extended(state, levels[-1], left=size % 2 == 1, last=size + 1 == depth), f"phrases-{size + 1}-of-shards")
    return levels


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = 30, depth: int = 4, top: int = 2000, keep_percent: int = 80, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's first ``top`` phrases of 2 to ``depth`` words: lang, rank, phrase, a (its count), l and r (those of the two
    parts of the cut with the lowest score), n (words of the language) and score, floor(2000000 a / (l + r)).

    Phrases inside a longer one that occurs ``keep_percent`` % as often are dropped.  No phrase between the two lengths is rarer
    than the longer one, so that the phrases with one more word decide."""
    parts = materialize(shards(docs, shard_words), "shards")
    levels = phrase_levels(parts, least, depth)
    kept = None
    for k, level in enumerate(levels[1:], 2):
        if k < depth:
            longer = levels[k].select(F.explode(F.array("prefix", "suffix")).alias("number"), F.col("f").alias("longer")).groupBy("number").agg(F.max("longer").alias("longer"))
            level = level.join(longer, "number", "left").where(F.col("longer").isNull() | (100 * _wide(F.col("longer")) < keep_percent * _wide(F.col("f"))))
        score = lambda l, r: F.call_function("div", _wide(F.lit(2_000_000)) * _wide(F.col("f")), _wide(l) + _wide(r))
        cuts = [(F.lit(i), F.col("heads")[i - 1], F.col("tails")[k - i - 1]) for i in range(1, k)]
        scored = F.array(*[F.struct(score(l, r).alias("score"), i.alias("k"), l.alias("l"), r.alias("r")) for i, l, r in cuts])
        level = level.select("lang", "phrase", F.col("f").alias("a"), F.array_min(scored).alias("cut"))
        kept = level if kept is None else kept.unionByName(level)
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of each of many parts of a language, then the first of those.
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = parts.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch_scope():
        return materialize(collocations(documents(spark, sf_dir)), "collocations", keep=True)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = rf"""
with p as (select row_number() over () as piece, lang, piece_text from (select coalesce(lang, 'und') as lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) as piece_text from documents)),
w as (select piece, lang, regexp_extract_all(piece_text, '[^\x20\x09]+') as words from p),
n as (select lang, cast(sum(len(words)) as bigint) as n from w group by lang),
g as (select lang, k, words[i:i + k - 1] as g from (select lang, words, k, unnest(range(1, len(words) - k + 2)) as i from w, (select unnest([1, 2, 3, 4]) as k) where len(words) >= k)),
f as (select lang, k, g, cast(count(*) as hugeint) as f from g group by all having count(*) >= 30),
cuts as (select c.lang, c.k, c.g, c.f, s, a.f as l, b.f as r, (2000000 * c.f) // (a.f + b.f) as score
  from (select *, unnest(range(1, k)) as s from f where k > 1) c join f a on a.lang = c.lang and a.g = c.g[:s] join f b on b.lang = c.lang and b.g = c.g[s + 1:]),
best as (select * from cuts qualify row_number() over (partition by lang, g order by score, s) = 1),
sub as (select lang, g[i:i + m - 1] as g, max(f) as longer from (select *, unnest(range(1, k - m + 2)) as i from (select *, unnest(range(2, k)) as m from f where k > 2)) group by all),
kept as (select best.*, array_to_string(best.g, ' ') as phrase from best left join sub on sub.lang = best.lang and sub.g = best.g where longer is null or 100 * longer < 80 * best.f)
select lang, rank, phrase, cast(f as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, f desc, phrase) as rank from kept) join n using (lang) where rank <= 2000
"""
