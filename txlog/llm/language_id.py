"""Language identification, words first: known words score by their frequency in each language, unseen
words by the longest of their character n-grams that are known.

A word is a run of letters, in lower case.  The counts of words per language, and from them of the
n-grams (one to five characters, a blank at each end of the word) are taken over every learnable row
and added up by Spark.  An entry is known where it makes up a given share of its language's words,
or of its n-grams of that length.  The share is the number of languages over ``max_words`` (or
``max_grams``), so that the model never holds more entries than that, whatever the corpus, and one
rule holds at every size.  What is not known counts half of what it may have at most.

A text's score of a language is the sum over its words; an unseen word adds the mean over its
known n-grams of the greatest length that has any.  The prediction is the language with the
greatest sum (ties: the smallest name), its score the share of it after exponentiating.

Nulls: a null text, or one without a letter, is ``und`` with score 0, as is every text where nothing
could be learned (an empty table, or no row with a language).  A null doc_id is neither learned from
nor held out.  Languages with less than a millionth of all words are not learned.  Repeated rows
each give a row; texts of any length are read whole, a block of words at a time; extra columns of
the input are dropped.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.llm.common import documents, map_rows, materialize, scratch_scope

MAX_WORDS = 400_000
#: Of each length.
MAX_GRAMS = 100_000
#: Entries that a task counts before it gives them out, and scores (words times languages) that a process keeps.
HELD, SCORES = 100_000, 800_000
ORDER = 5
LEAST_SHARE = 1e-6
UNDETERMINED = "und"
#: Numerals that are no digits are in it, too; a run of those alone is no word.
_RUN = re.compile(r"[^\W\d_]+")


def grams(word: str, n: int) -> list[str]:
    padded = word if n == 1 else f" {word} "
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Known words and n-grams; entry ``i``'s languages and gains over being unknown lie at ``starts[i]:starts[i + 1]``."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    starts: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    #: By length of n-gram (0: words): the score of an unknown entry, per language.
    floors: np.ndarray
    _scorer: Scorer | None = None

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row of scores by language for each word."""
        sizes, entries, owner, weight = np.zeros(len(words), int), [], [], []
        floors = np.vstack([self.floors, np.zeros(len(self.langs))])
        for i, word in enumerate(words):
            at = self.words.get(word)
            if at is not None:
                entries.append(at)
                owner.append(i)
                weight.append(1.0)
                continue
            sizes[i] = -1
            for n in range(ORDER, 0, -1):
                known = [self.grams[g] for g in grams(word, n) if g in self.grams]
                if known:
                    sizes[i] = n
                    entries += known
                    owner += [i] * len(known)
                    weight += [1 / len(known)] * len(known)
                    break
        entries, shape = np.array(entries, int), (len(words), len(self.langs))
        length = self.starts[entries + 1] - self.starts[entries]
        within = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length) + np.repeat(self.starts[entries], length)
        cell = np.repeat(np.array(owner, int) * shape[1], length) + self.lang[within]
        gains = np.bincount(cell, self.gain[within] * np.repeat(np.array(weight, float), length), shape[0] * shape[1])
        return floors[sizes] + gains.reshape(shape)

    def scorer(self) -> Scorer:
        """One per process, which keeps what it has found."""
        if self._scorer is None:
            self._scorer = Scorer(self)
        return self._scorer


class Scorer(dict):
    """Rows of a table of bounded size by word; row 0 is that of runs without a letter."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.size = model, max(64, SCORES // max(len(model.langs), 1))
        self.table, self.used, self.new = np.zeros((self.size, len(model.langs))), 0, []

    def __missing__(self, run: str) -> int:
        at = 0
        if any(map(str.isalpha, run)):
            self.used += 1
            self.new.append(run)
            at = self.used
        self[run] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        runs = _RUN.findall((text or "").lower()) if self.model.langs else []
        total, lettered = np.zeros(len(self.model.langs)), False
        for k in range(0, len(runs), self.size // 2):
            part = runs[k : k + self.size // 2]
            if max(self.used, len(self)) + len(part) >= self.size:
                self.clear()
                self.used = 0
            rows = np.fromiter(map(self.__getitem__, part), np.int64, len(part))
            if self.new:
                self.table[self.used - len(self.new) + 1 : self.used + 1] = self.model.vectors(self.new)
                self.new.clear()
            total += self.table[rows].sum(axis=0)
            lettered = lettered or bool(rows.any())
        if not lettered:
            return UNDETERMINED, 0.0
        best = int(total.argmax())
        return self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


class _Counts(defaultdict):
    """Counters by language, given out and started over when they hold many entries."""

    def __init__(self, entry: str):
        super().__init__(Counter)
        self.entry = entry

    def full(self) -> bool:
        return sum(map(len, self.values())) > HELD

    def take(self) -> dict[str, list]:
        out = {"lang": [l for l, c in self.items() for _ in c], self.entry: [w for c in self.values() for w in c], "n": [n for c in self.values() for n in c.values()]}
        self.clear()
        return out


def _count_words(batches):
    held = _Counts("word")
    for b in batches:
        for lang, text in zip(b["lang"], b["text"]):
            held[lang].update(_RUN.findall(text.lower()))
            if held.full():
                yield held.take()
    yield held.take()


def _count_grams(batches):
    held = _Counts("gram")
    for b in batches:
        for lang, word, n in zip(b["lang"], b["word"], b["n"]):
            own = held[lang]
            for k in range(1, ORDER + 1):
                for g in grams(word, k):
                    own[g] += n
            if len(own) > HELD or len(held) > 1 and held.full():
                yield held.take()
    yield held.take()


def _known(counts: DataFrame, langs: int, entries: int) -> tuple:
    """What counts ``n`` of (lang, entry, size) sum to per language and size, and the entries that make up the share: at
    most ``entries`` of a size."""
    totals = materialize(counts.groupBy("lang", "size").agg(F.sum("n").alias("total")), "totals")
    known = counts.join(totals, ["lang", "size"]).where(F.col("n") * F.lit(float(entries)) >= F.col("total") * F.lit(float(langs)))
    return {(r["lang"], r["size"]): r["total"] for r in totals.collect()}, known.select("lang", "size", "entry", "n").toPandas()


def fit(rows: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """From rows with ``lang`` and ``text``; rows without either are not used."""
    counted = map_rows(rows.where("lang is not null and text is not null").select("lang", "text"), _count_words, "lang string, word string, n long")
    words = materialize(counted.where(F.col("word").rlike(r"\p{L}")).groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    every = sizes.agg(F.sum("n")).first()[0] or 0
    learned = sizes.where(F.col("n") >= every * LEAST_SHARE).select("lang")  # a millionth each: bounded
    langs = sorted(r["lang"] for r in learned.collect())
    words = words.join(F.broadcast(learned), "lang", "left_semi")
    pieces = map_rows(words, _count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    pieces = materialize(pieces.select("lang", F.col("gram").alias("entry"), "n", F.length("gram").alias("size")), "grams")
    whole = words.select("lang", F.col("word").alias("entry"), "n", F.lit(0).alias("size"))
    return _model(langs, [(*_known(t, len(langs), n), n) for t, n in ((whole, max_words), (pieces, max_grams))])


def _model(langs: list[str], parts: list[tuple]) -> Model:
    """From (totals by language and size, known entries, limit) of the words and of the n-grams."""
    number = {l: i for i, l in enumerate(langs)}
    places: list[dict[str, int]] = [{}, {}]
    at, lang, gain = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    floors = np.zeros((ORDER + 1, len(langs)))
    for place, (totals, table, limit) in zip(places, parts):
        kinds = table.groupby("size")["entry"].nunique()
        unknown = {k: 0.5 + 0.5 * t * len(langs) / limit for k, t in totals.items()}
        for (name, size), total in totals.items():
            floors[size, number[name]] = np.log(unknown[name, size] / (total + unknown[name, size] * (kinds.get(size, 0) + 1)))
        for (name, size), own in table.groupby(["lang", "size"]):
            at.append(np.array([place.setdefault(e, len(places[0]) * (place is not places[0]) + len(place)) for e in own["entry"]]))
            lang.append(np.full(len(own), number[name]))
            gain.append(np.log(own["n"].to_numpy(float) / unknown[name, size] + 1))
    floors = np.where(floors < 0, floors, floors.min(axis=1, keepdims=True, initial=0))  # a language without n-grams of a length
    at, lang, gain = map(np.concatenate, (at, lang, gain))
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(places[0]) + len(places[1]) + 1))
    return Model(langs, *places, starts, lang[order], gain[order], floors)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_WORDS + ORDER * MAX_GRAMS entries
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        scorer = shipped.value.scorer()
        for b in batches:
            found = [scorer.predict(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "lang_pred": [l for l, _ in found], "score": [s for _, s in found]}

    return map_rows(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    with scratch_scope():  # the model is fitted when this is left
        model = fit(docs.where(~held))
    found = predictions(docs, model)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
