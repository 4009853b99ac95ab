"""Phrases from the FM-index against plain counting, and against SQL."""

import collections
import random
import re
import tracemalloc

import duckdb
import numpy as np
import pytest

from txlog.llm import collocations as C

SF = "/root/testdata/sf0.001"


def pieces(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", text)]


def brute(rows, least, depth, top, percent):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, g), a in f.items():
        if len(g) > 1:
            longer = [c for (l, h), c in f.items() if l == lang and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if not any(100 * c >= percent * a for c in longer):
                score, _, l, r = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
                out.append((lang, score, a, " ".join(g), l, r, n[lang]))
    want = set()
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[1], -x[2], x[3].encode()))
        want |= {(lang, k + 1, p, a, l, r, n, s) for k, (_, s, a, p, l, r, n) in enumerate(mine[:top])}
    return want


@pytest.mark.parametrize("depth", [2, 3, 4, 5])
def test_against_plain_counts(spark, depth):
    rng = random.Random(depth)
    words = ["the", "The", "of", "new", "york", "city", "é", "x\xa0y", "a1", "-", "  ", "\t", ". ", ", ", "\n", "!", "\x0b", "zz"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""])) for _ in range(250)]
    rows += [(None, "en"), ("", "en"), ("New York City " * 3000, "fr"), ("city of new york", "en"), *[("city of new york", "en")] * 20]
    docs = spark.createDataFrame([(t, l, 1, 2) for t, l in rows], "text string, lang string, shard long, n int").repartition(5)
    got = {tuple(r) for r in C.collocations(docs, least=3, depth=depth, top=40, shard_words=150).collect()}
    assert got == brute(rows, 3, depth, 40, 80) and len({r[0] for r in got}) >= 5


def test_levels_by_shuffle_are_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {tuple(r) for r in C.collocations(docs, least=10, shard_words=3000).collect()}
    monkeypatch.setattr(C, "BROADCAST", 0)
    assert {tuple(r) for r in C.collocations(docs, least=10).collect()} == want and len(want) > 50


def test_intervals_of_an_index():
    """Every phrase of up to four words has as many rows in its interval of either transform as it occurs."""
    rng = np.random.default_rng(5)
    symbols = np.append(rng.integers(0, 5, 400), 0).astype(np.int32)
    left, right = C.transform(symbols, 4), C.transform(C.mirrored(symbols), 4)
    n = np.bincount(symbols, minlength=5)
    start = (np.cumsum(n) - n)[1:]
    phrases = {i: (i + 1,) for i in range(4)}
    main, other, count, number = start, start, n[1:], np.arange(4)
    for size in (2, 3, 4):
        if size % 2 == 0:
            main, other, count, suffix, prefix = C.extend(left, main, other, count, number)
        else:
            other, main, count, prefix, suffix = C.extend(right, other, main, count, number)
        phrases = {k: phrases[p] + phrases[s][-1:] for k, (p, s) in enumerate(zip(prefix, suffix))}
        number = np.arange(len(main))
        want = collections.Counter(w for i in range(len(symbols) - size + 1) if 0 not in (w := tuple(symbols[i : i + size].tolist())))
        assert {tuple(map(int, phrases[k])): int(c) for k, c in enumerate(count)} == want


def test_packed_numbers():
    for numbers in ([], [0], [1, 2**31 - 1, 7], [5, 2**40, 3]):
        assert C.unpack(C.pack(np.array(numbers, np.int64))).tolist() == numbers


def test_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(docs).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), (" . ", "en"), ("once only", "en")], "text string, lang string")).count() == 0


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(map(tuple, db.execute(C.ORACLE_SQL).fetchall()))
    assert sorted(map(tuple, C.query(spark, SF).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want


def test_shards_take_little_memory():
    """Sorting a shard and extending its words takes a bounded number of bytes a word (before: 73 and 53)."""
    rng = np.random.default_rng(3)
    symbols = np.append(rng.zipf(1.3, 400_000) % 5000, 0).astype(np.int32)
    symbols = C._compact(symbols)
    n = np.bincount(symbols, minlength=5000)
    start = np.cumsum(n) - n
    there = np.flatnonzero(n[1:]) + 1
    tracemalloc.start()
    left = C.transform(symbols, 4)
    sorting = tracemalloc.get_traced_memory()[1] / len(symbols)
    tracemalloc.reset_peak()
    C.extend(left, start[there], start[there], n[there], there)
    extending = tracemalloc.get_traced_memory()[1] / len(symbols)
    tracemalloc.stop()
    print("bytes a word", sorting, extending)
    assert sorting < 60 and extending < 45
