"""Language identification against a plain version of its model and on held-out rows; the filter audit against loops over documents."""

import collections
import itertools
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from txlog.llm import filter_audit, language_id
from txlog.llm.common import documents

SF = "/root/testdata/sf0.001"


def plain_model(rows, limits):
    """lang -> function of a word, by the same rules in plain loops."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(language_id.ORDER + 1)]
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            counts[0][lang][w] += 1
            for n in range(1, language_id.ORDER + 1):
                p = f" {w} " if n > 1 else w
                for k in range(len(p) - n + 1):
                    counts[n][lang][p[k : k + n]] += 1
    langs = sorted(counts[0])
    known, kinds = [], []
    for n, by in enumerate(counts):
        share = len(langs) / limits[n > 0]
        known.append({l: {e: c for e, c in by[l].items() if c >= share * sum(by[l].values())} for l in langs})
        kinds.append(len({e for l in langs for e in known[n][l]}))

    def logp(n, lang, entry):
        total = sum(counts[n][lang].values())
        unknown = 0.5 + 0.5 * total * len(langs) / limits[n > 0]
        return math.log((known[n][lang].get(entry, 0) + unknown) / (total + unknown * (kinds[n] + 1)))

    def word(lang, w):
        if any(w in known[0][l] for l in langs):
            return logp(0, lang, w)
        for n in range(language_id.ORDER, 0, -1):
            p = f" {w} " if n > 1 else w
            found = [g for g in (p[k : k + n] for k in range(len(p) - n + 1)) if any(g in known[n][l] for l in langs)]
            if found:
                return sum(logp(n, lang, g) for g in found) / len(found)
        return 0.0

    return langs, word


@pytest.mark.parametrize("limits", [(400_000, 100_000), (60, 200)])  # all entries known; only the frequent ones
def test_language_model(spark, limits):
    rows = [(r.text, r.lang) for r in documents(spark, SF).limit(40).collect()]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3), *limits)
    langs, word = plain_model(rows, limits)
    assert model.langs == langs
    assert limits[0] > 60 or len(model.words) <= 60
    some = ["the", "der", "xyzzy", "qqq", "ß", "жж", "thtion", *re.findall(r"[^\W\d_]+", rows[0][0].lower())[:40]]
    for w, got in zip(some, model.vectors(some), strict=True):
        assert got == pytest.approx([word(l, w) for l in langs], abs=1e-9)


def test_a_small_table_starts_over(spark):
    rows = [(r.text, r.lang) for r in documents(spark, SF).limit(40).collect()]
    model = language_id.fit(spark.createDataFrame(rows, "text string, lang string"))
    want, scorer = [language_id.Scorer(model).predict(t) for t, _ in rows], language_id.Scorer(model)
    scorer.size = 64
    assert [scorer.predict(t)[0] for t, _ in rows] == [l for l, _ in want] and len(scorer) < 64


def test_language_on_held_out_rows(spark):
    got = language_id.query(spark, "/root/testdata/sf0.01")
    docs = documents(spark, "/root/testdata/sf0.01").select("doc_id", "lang")
    held = got.where("held_out").join(docs, "doc_id").selectExpr("count(*) as n", "count_if(lang = lang_pred) as right").first()
    assert held["n"] > 300 and held["right"] >= 0.99 * held["n"]
    assert got.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_of_odd_texts(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("bonjour", None)], "text string, lang string")
    model = language_id.fit(train)
    rows = [(1, None), (2, ""), (3, "12 _ ²"), (4, "The THE"), (5, "Hunde " * 200_000), (6, "Кот"), (6, "Кот"), (None, "und")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang_pred string")
    got = [tuple(r) for r in language_id.predictions(docs, model).collect()]
    by = {i: (l, s) for i, l, s in got}
    assert by[1] == by[2] == by[3] == ("und", 0.0) and by[4][0] == "en" and by[5][0] == "de" and by[None][0] == "de"
    assert by[6] == ("de", 0.5) and len(got) == len(rows)  # nothing known: a tie, the smallest name
    text_ids = spark.createDataFrame([("a", "the")], "doc_id string, text string")
    assert language_id.predictions(text_ids, model).first()["doc_id"] == "a"
    assert language_id.predictions(docs, language_id.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0


def brute_audit(docs, labels):
    texts = collections.defaultdict(list)
    for i, t, _ in docs:
        if i is not None:
            texts[t or ""].append(i)
    masks = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and min(texts[t]) < i}
        masks.append((lang or "", {k for k, v in fails.items() if v}, *labels.get(i, (0, 0))))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m[1:] for m in masks if m[0] == part]
        removed_in_all = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [m for m in own if f in m[0] and not m[0] & before]
                removed_in_all[f] += len(here)
                kept = sum(not m[0] & (before | {f}) for m in own)
                out[part, "".join(order), k + 1] = [kept, len(here), sum(f in m[0] and bool(m[0] & before) for m in own), sum(m[0] == {f} for m in own), sum(m[1] for m in here), sum(m[2] for m in here), f]
        for key in out:
            if key[0] == part:
                out[key] = [*out[key][:6], removed_in_all[out[key][6]]] if len(out[key]) == 7 and isinstance(out[key][6], str) else out[key]
    return out


def audited(spark, docs, labels, **how):
    docs = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({"block": F.lit("x"), "mask": F.lit(1), "hash": F.lit(0)}).repartition(3)
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = filter_audit.audit(filter_audit.mask_counts(docs, labels, **how)).collect()
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}


@pytest.mark.parametrize("max_blocks", [1, 1 << 21])  # everything a possible repeat; next to nothing
def test_filter_audit(spark, max_blocks):
    long = " ".join(f"w{i}" for i in range(150))
    docs = [
        (1, long, "en"), (2, long, "de"), (3, long, None), (3, long, None), (4, None, "en"), (5, "", "en"), (None, long, "en"), (6, "A" * 500_000, "de"), (7, long + " #", "de"),
        (8, long.upper(), "en"), (9, "the " * 200, "en"), (9, long + " x", "en"), *[(100 + k, long + " copy", "en") for k in range(300)], *[(1000 + k, f"short {k} $", "de") for k in range(50)],
    ]
    labels = [(2, 1, 0), (2, 0, 1), (4, None, 1), (5, 1, None), (None, 1, 1), (200, 1, 0), (9, 1, 1)]
    marks = {2: (1, 1), 4: (0, 1), 5: (1, 0), 200: (1, 0), 9: (1, 1)}
    assert audited(spark, docs, labels, max_blocks=max_blocks) == brute_audit(docs, marks)


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}


def test_filter_audit_against_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(filter_audit.ORACLE_SQL).fetchdf()
    got = filter_audit.query(spark, SF).toPandas()[list(want.columns)]
    by = ["part", "filter_order", "step"]
    assert got.sort_values(by).to_numpy().tolist() == want.sort_values(by).to_numpy().tolist() and len(got) == 600 * got["part"].nunique()


def test_counts_are_given_out_before_they_are_many():
    """Neither many rows of a batch nor many languages let a task hold many entries; none is lost."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: "".join(letters[i // 26**k % 26] for k in range(5))
    texts = [" ".join(word(i * 300 + k) for k in range(300)) for i in range(1000)]
    given = list(language_id._count_words(iter([{"lang": ["en", "de"] * 500, "text": texts}])))
    assert max(len(t["word"]) for t in given) <= language_id.HELD + 300
    assert sum(len(set(t["word"])) for t in given) == 300_000 == sum(sum(t["n"]) for t in given)
    words = [word(i * 7) for i in range(60_000)]
    given = list(language_id._count_grams(iter([{"lang": ["en", "de"] * 30_000, "word": words, "n": [2] * 60_000}])))
    assert max(len(t["gram"]) for t in given) <= language_id.HELD + 40
    assert sum(sum(t["n"]) for t in given) == 2 * sum(len(language_id.grams(w, n)) for w in words for n in range(1, 6))
