"""Quality rules, classifier and toxicity against brute force and on held-out rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from txlog.llm import perplexity as kn
from txlog.llm import quality_rules as rules
from txlog.llm import toxicity
from txlog.llm.common import keyed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def base_counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    count, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(set(w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def statistics(counts):
    n, chars, distinct, symbols, lines, repeats = counts
    n = max(n, 1)
    return np.array([math.log1p(chars / n), math.log(max(distinct, 1) / n), math.log(n), *[math.sqrt(v / n * (n + rules.SHORT) / n) for v in (symbols + lines, repeats)]])


def brute_mcd(x):
    """Size, mean, covariance and scale of one group: the steps of the operator, in numpy."""
    floor, x = np.array(rules.FLOOR), np.unique(x, axis=0)

    def edge(v, part=0.5, res=rules._RES):  # the upper edge of the cell that holds a part of the values
        cells = np.sort(np.floor(v * res))
        return (cells[math.ceil(part * len(cells)) - 1] + 1) / res

    def moments(half):
        return half.mean(axis=0), np.cov(half.T, bias=True).reshape(x.shape[1], -1)

    def distance(m, c):
        return ((np.linalg.inv(np.linalg.cholesky(c + np.diag(floor**2))) @ (x - m).T) ** 2).sum(axis=0)

    fine = rules._FINE
    median = np.array([edge(v, 0.5, fine) - 0.5 / fine for v in x.T])
    spread = np.array([(edge(v, 0.75, fine) - edge(v, 0.25, fine)) / 1.349 for v in x.T])
    distances = [((x - median) ** 2 / (spread**2 + floor**2)).sum(axis=1), distance(*moments(x))]
    for _ in range(rules.STEPS):
        fits = [moments(x[np.log(d + 1e-9) < edge(np.log(d + 1e-9))]) for d in distances]
        distances = [distance(*f) for f in fits]
    size = [np.linalg.slogdet(c + np.diag(floor**2))[1] for _, c in fits]
    best = 0 if size[0] <= size[1] else 1
    radius = math.exp(edge(np.log(distances[best] + 1e-9)))
    return len(x), *fits[best], max(radius / rules.MIDDLE, 0.25)


def drawn(own, wide):
    n = own[0]
    mean = lambda a, b: (n * a + rules.PRIOR * b) / (n + rules.PRIOR)
    return n, mean(own[1], wide[1]), mean(own[2], wide[2]), math.exp(mean(math.log(own[3]), math.log(wide[3])))


def brute_rules(docs, shape=lambda c: c):
    """doc_id -> kept, for rows with doc_id, text, lang, source; ``shape`` may change the covariance."""
    stats = {r.doc_id: base_counts(r.text) for r in docs}
    failed = {d: s[0] < 50 or 100 * s[-1] > 50 * s[0] for d, s in stats.items()}
    vec = {d: statistics(s) for d, s in stats.items()}
    groups = collections.defaultdict(list)
    for r in docs:
        if not failed[r.doc_id]:
            for key in ((0, r.lang, r.source), (1, r.lang), (2,)):
                groups[key].append(vec[r.doc_id])
    fits = {k: brute_mcd(np.array(v)) for k, v in groups.items()}
    kept = {}
    for r in docs:
        fit = fits.get((2,))
        for key in ((1, r.lang), (0, r.lang, r.source)):
            fit = drawn(fits[key], fit) if key in fits else fit
        _, m, c, scale = fit
        c, z = shape(c + np.diag(np.array(rules.FLOOR) ** 2)), vec[r.doc_id] - m
        n = stats[r.doc_id][0]
        far = z @ np.linalg.solve(c, z) / scale * n / (n + rules.SHORT)
        lean = z / np.sqrt(np.diag(c) * scale)
        bad = max(abs(v) if b == 2 else b * v for v, b in zip(lean, rules.BAD)) > 2
        kept[r.doc_id] = not failed[r.doc_id] and not (far > rules.CUTOFF and bad)
    return kept


def test_base_record(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b c a b c", "x\n\ny\nx\n x\n", "a#b*c%d | <e>", "w " * 3000, "é\x1cf\xa0g ü\x0bh"]
    texts += ["".join(rng.choices(["a", "b", "cc", " ", " ", "\n", "\t", "%"], k=rng.randrange(0, 300))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    for r in rules.base_record(df).collect():
        want = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_distinct"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, texts[r["doc_id"]]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[-1] > 50 * want[0])


def test_rules_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(rules.records(docs)).collect()}
    assert got == brute_rules(docs.collect())
    assert 0 < sum(not k for k in got.values()) < len(got)


def test_rules_equal_brute_force_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(rules.records(docs)).collect()}
    assert got == brute_rules(docs.collect())


def test_the_estimated_covariance_decides(spark):
    """Many words and many distinct ones go together, as do long and few words: texts against that are rejected, though each of
    their statistics is usual, and would be kept if the covariance were diagonal."""
    rng = random.Random(4)
    new = lambda n: ["".join(rng.choices("abcdefgh", k=rng.randrange(3, 10))) for _ in range(int(n))]
    rows = []
    for i in range(400):
        n = rng.randrange(300, 1500)
        words = new(n * (0.9 - 0.5 * math.log(n / 300) / math.log(5) + rng.gauss(0, 0.01)))
        rows.append(words + rng.choices(words, k=n - len(words)))
    for n in (320, 340, 360):  # short, with as few distinct words as a long one
        words = new(n * 0.36)
        rows.append(words + rng.choices(words, k=n - len(words)))
    for w in rows:
        rng.shuffle(w)
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s") for i, w in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(rules.records(docs)).collect()}
    assert got == brute_rules(docs.collect())
    diagonal = brute_rules(docs.collect(), lambda c: np.diag(np.diag(c)))
    assert not any(got[i] for i in range(400, 403)) and all(diagonal[i] for i in range(400, 403))
    assert sum(got[i] for i in range(400)) >= 380


def test_rules_are_not_tied_to_copies(spark):
    """More than half of the rows are one text: they count once, and the others are not judged by it."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    texts = [" ".join(word() for _ in range(rng.randrange(60, 200))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts + [texts[0]] * 600)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(rules.records(docs)).collect()}
    assert sum(kept[i] for i in range(150)) >= 148 and kept == brute_rules(docs.collect())


def test_rules_on_groups_with_nulls(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    rows = []
    for i in range(300):
        w = [word() for _ in range(rng.randrange(50, 120))]
        if i % 10 == 0:
            w = [f"%%{x}##" for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", None]), rng.choice(["s1", "s1", None, f"s{i}"])))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(rules.records(df)).collect()}
    assert got == brute_rules(df.collect())
    assert all(got[i] == (i % 10 != 0) for i in got)
    assert rules.judge(rules.records(df.limit(0))).count() == 0
    assert rules.keep_documents(df).columns == df.columns


def test_rules_reject_moderate_outliers(spark):
    rng = random.Random(3)
    word = lambda a, b: "".join(rng.choices("abcdefgh", k=rng.randrange(a, b)))
    plain = [[word(2, 9) for _ in range(rng.randrange(100, 200))] for _ in range(200)]
    signs = [[x + "#" if k % 6 == 0 else x for k, x in enumerate(w)] for w in plain[:10]]  # one word of 6
    again = [w + w[:30] for w in plain[10:20] if len(w) < 160]  # 60 words of fewer than 190
    long = [[word(10, 18) for _ in range(100)] for _ in range(10)]
    one = [[*w[:50], "5%"] for w in plain[20:40]]  # a single symbol
    texts = [(" ".join(w), k) for k, part in enumerate([plain, signs, again, long, one]) for w in part]
    df = spark.createDataFrame([(i, t, "en", "s") for i, (t, _) in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in rules.judge(rules.records(df)).collect()}
    assert len(again) > 2 and [got[i] for i in range(len(texts))] == [k in (0, 4) for _, k in texts]


def test_stages_judge_rows_whatever_their_ids(spark):
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    good = [" ".join(rng.choices(words, k=60)) for _ in range(150)]
    rows = [(None, "too short", 0), (1, good[0], 1), (1, "too short", 0), (None, good[1], 1), (None, None, 0), (2, good[2], 1), (2, good[2], 1), *[(10 + i, t, 1) for i, t in enumerate(good)]]
    df = spark.createDataFrame([(*r, "en", "s", "x", 1.5) for r in rows], "doc_id long, text string, keep int, lang string, source string, kept string, distance double").repartition(3)
    key = lambda frame: sorted(((str(r["doc_id"]), str(r["text"])) for r in frame.collect()))
    got = rules.keep_documents(df)
    assert got.columns == df.columns and key(got) == key(df.where("keep = 1"))
    assert rules.keep_documents(df.limit(0)).count() == 0
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=300)) for _ in range(4)]
    more = spark.createDataFrame([(i, t, 0, "en", "s", "x", 1.5) for i, t in zip([None, 1, 2, 10], junk)], df.schema)
    labels = spark.createDataFrame([(10 + i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    docs = df.where("keep = 1").union(more)  # label 10 names a good text and a bad one
    got = kn.keep_documents(docs, labels)
    assert got.columns == df.columns and {r["text"] for r in got.collect()} >= {t for t in good} and not {r["text"] for r in got.collect()} & {*junk[:3]}
    assert got.count() >= len(good) + 4
    assert kn.keep_documents(df.limit(0), labels).count() == kn.keep_documents(df.where("text is null"), labels).count() == 0


def brute_perplexity(docs, trusted):
    """doc_id -> perplexity: interpolated modified Kneser-Ney with dictionaries, per language."""
    code = lambda c: c if c < 592 else 592 + (c >> 7) % (kn.ALPHABET - 592)
    grams = {}
    for r in docs:
        w = WORD.findall(r.text or "")
        s = [code(ord(c)) for c in "    " + " ".join(w)] if w else []
        grams[r.doc_id] = [tuple(s[i - 4 : i + 1]) for i in range(4, len(s))]
    out = {}
    for lang in {r.lang for r in docs}:
        own = [r.doc_id for r in docs if r.lang == lang]
        counts = {5: collections.Counter(g for d in own if d in trusted for g in grams[d])}
        for k in (4, 3, 2, 1):
            counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        discount, context = {}, {}
        for k, c in counts.items():
            m = [0, *[sum(v == i for v in c.values()) for i in range(1, 5)]]
            if all(m[1:]):
                y = m[1] / (m[1] + 2 * m[2])
                discount[k] = [max(0.1, min(0.95 * i, i - (i + 1) * y * m[i + 1] / m[i])) for i in (1, 2, 3)]
            else:
                discount[k] = [0.5, 1.0, 1.5]
            total, left = collections.Counter(), collections.Counter()
            for g, n in c.items():
                total[g[:-1]] += n
                left[g[:-1]] += discount[k][min(n, 3) - 1]
            context[k] = {h: (t, left[h] / t) for h, t in total.items()}

        def p(g):
            k = len(g)
            if k == 0:
                return 1 / kn.ALPHABET
            total, weight = context[k].get(g[:-1], (1, 1.0))
            n = counts[k].get(g, 0)
            return (n - discount[k][min(n, 3) - 1] if n else 0) / total + weight * p(g[1:])

        for d in own:
            out[d] = math.exp(-sum(math.log(p(g)) for g in grams[d]) / len(grams[d])) if grams[d] else None
    return out


@pytest.mark.parametrize("shard", [2_000_000, 20_000])
def test_perplexity_equals_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(kn, "SHARD_ROWS", shard)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = [(900, None, "en", None, 0), (901, " ", None, None, 0), (902, "日本語 text", None, None, 0), (903, "日本語 text", None, None, 0), (902, "日本語 text", None, None, 0)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").union(spark.createDataFrame(extra, schema))
    labels = spark.createDataFrame([(d, int(d % 7 > 0), 0) for d in range(0, 60, 2)] + [(None, 1, 0), (902, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = kn.judge(kn.perplexities(keyed(docs), labels)).collect()
    got = {r["doc_id"]: r["perplexity"] for r in rows}
    trusted = {d for d in range(0, 60, 2) if d % 7 > 0} | {902}
    single = {r.doc_id: r for r in docs.collect()}
    once = list(single.values()) + [single[902]]  # the repeated row counts twice
    held = {r["doc_id"] for r in docs.where("pmod(xxhash64(text), 5) = 0").collect()}
    assert {r["doc_id"] for r in rows if r["held"]} == trusted & held and 0 < len(trusted & held) < len(trusted)
    want = brute_perplexity(once, trusted - held)
    assert len(rows) == len(single) + 1 and set(got) == set(want)
    for d, v in want.items():
        assert (v is None) == (got[d] is None) and (v is None or abs(got[d] / v - 1) < 1e-5)
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert not kept[900] and not kept[901]


def test_classifier_separates_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = kn.judge(kn.perplexities(keyed(docs), labels)).join(labels, "doc_id").where("n_chars > 100").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99
    assert (~got[got.quality == 0].kept).mean() > 0.6


def test_quantile_of_held_out_rows_decides(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = kn.judge(kn.perplexities(keyed(docs), labels)).join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    held = good[good.held]
    print("bad rejected", (~bad.kept).sum(), len(bad), "held-out good rejected", (~held.kept).sum(), len(held), "counted", (~good[~good.held].kept).sum())
    assert 0.15 < len(held) / len(good) < 0.25
    assert held.kept.mean() > 0.98
    assert (~bad.kept).mean() > 0.85
    for _, g in held.groupby("lang"):
        room = kn.STRAY / np.sqrt(len(g))
        assert abs(np.log(g.threshold.iloc[0] / g.perplexity.quantile(kn.QUANTILE, interpolation="higher")) - room) < 0.005


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрстуфхцчшыья", "αβγδεζηθικλμνξοπρστυφχψω", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"])
def test_perplexity_tells_letters_of_one_block_apart(spark, letters):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices(letters, k=n))
    vocabulary = [word(rng.randrange(3, 9)) for _ in range(60)]
    good = [rng.choices(vocabulary, k=60) for _ in range(160)]
    junk = [[word(len(x)) for x in w] for w in good[:20]]
    docs = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(good + junk)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"]: r["kept"] for r in kn.judge(kn.perplexities(keyed(docs), labels)).collect()}
    assert all(kept[i] for i in range(160)) and not any(kept[i] for i in range(160, 180))


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        w = rng.choices(vocabulary, k=rng.randrange(5, 80))
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["Grobble,", "snark", "FLEM"]))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), "x"))
        labels.append((i, 1, toxic))
    rows += [(None, "no id", None, "x"), (2000, None, None, "x"), (2001, "", "en", "x")]
    labels += [(None, 1, 1), (2000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs, toxicity.fit(docs, table)).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(table.toPandas(), on="doc_id")
    assert len(held) > 100 and (held.predicted == held.toxic).mean() > 0.95
    clean = toxicity.scores(docs, toxicity.fit(docs, table.limit(0))).toPandas()
    assert (clean.predicted == 0).all()


def test_convolution_equals_plain_loops():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 500, (int(n), toxicity._PARTS)).astype(np.int32) for n in [0, 1, 2, 3, 40, 7]]
    m = toxicity.train(rows * 10, np.tile([0.0, 1.0, 0.0, 1.0, 1.0, 0.0], 10), epochs=2)
    place = {b: i for b, i in m.index.items()}
    known = [np.array([[place.get(int(b), 0) for b in w] for w in r], np.int32).reshape(-1, toxicity._PARTS) for r in rows]
    for r, got in zip(known, toxicity.logits(m, known)):
        words = [sum((m.embedding[b] for b in w), np.zeros(toxicity.DIM)) for w in r] or [np.zeros(toxicity.DIM)]
        hidden = []
        for width in toxicity.WIDTHS:
            for f in range(toxicity.FILTERS):
                best = max(sum(float(words[i + j] @ m.filters[width][j][:, f]) for j in range(width) if i + j < len(words)) for i in range(len(words)))
                hidden.append(max(0.0, best + float(m.bias[width][f])))
        want = sum(h * float(o) for h, o in zip(hidden, m.out)) + m.out_bias
        assert abs(want - got) < 1e-3


def test_toxicity_finds_held_out_rows(spark):
    """Rows never used in the fit or its calibration: most toxic ones found, hardly a clean one flagged."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs, toxicity.fit(docs, labels)).where("held_out").join(labels.where("toxic is not null"), "doc_id").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    print("toxic found", toxic.predicted.sum(), len(toxic), "clean flagged", clean.predicted.sum(), len(clean))
    assert toxic.predicted.mean() >= 0.9 and clean.predicted.mean() < 0.01


def test_toxicity_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, score string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.scores(docs, toxicity.fit(docs, labels)).count() == 0


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """Each toxic word marks too few rows to be in a sample of all; long texts are learned from as well, shards change little."""
    rng = random.Random(9)
    vocabulary = [f"word{i}" for i in range(200)]
    marks = ["grobble", "snark", "flem", "quaddle"]
    rows, labels = [], []
    for i in range(9000):
        w = rng.choices(vocabulary, k=rng.randrange(3, 9))
        if i % 8 == 0:
            w.insert(0, marks[i // 8 % 4])
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(i % 8 == 0)))
    for i in range(9000, 9400):  # a mark that only long texts have
        long = i % 2 == 0
        rows.append((i, " ".join((["zzyzx"] if i % 4 == 0 else []) + rng.choices(vocabulary, k=4100 if long and i < 9100 else 5)), "en"))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    usable = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i, _ in labels)
    for size in (16 << 20, 200_000):
        monkeypatch.setattr(toxicity, "SHARD_BYTES", size)
        seen, blocks = [], toxicity._blocks
        monkeypatch.setattr(toxicity, "_blocks", lambda r: seen.append(r.count()) or blocks(r))  # noqa: B023
        got = toxicity.scores(docs, toxicity.fit(docs, table)).where("held_out").toPandas().merge(table.toPandas(), on="doc_id")
        monkeypatch.setattr(toxicity, "_blocks", blocks)
        assert seen == [usable]
        assert (got.predicted == got.toxic).mean() > 0.97


def test_rules_plans_stay_narrow(spark):
    """Distances need few columns and steps, as the driver holds the plans (before: 32 columns more than were given); they are right."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5)) @ rng.normal(size=(5, 5))
    d = range(5)
    c, m = np.cov(x.T, bias=True), x.mean(axis=0)
    row = {f"c{i}{j}{s}": float(c[i, j]) for s in ("_0", "_1") for i in d for j in range(i + 1)} | {f"m{j}{s}": float(m[j]) for s in ("_0", "_1") for j in d} | {f"x{j}": float(x[0, j]) for j in d}
    got = rules._inverse(spark.createDataFrame([row]), ["_0", "_1"])
    assert len(got.columns) <= len(row) + 4 and len(got._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    found = got.select("logdet_0", rules._distance("_1").alias("d")).first()
    whole = c + np.diag(np.array(rules.FLOOR) ** 2)
    assert abs(found["d"] - (x[0] - m) @ np.linalg.inv(whole) @ (x[0] - m)) < 1e-6 and abs(found["logdet_0"] - 0.5 * np.linalg.slogdet(whole)[1]) < 1e-9


def test_rules_plans_are_short(spark, monkeypatch):
    """The driver holds the plans of every step (before: 65 thousand characters for each concentration step, 242 for all on these rows)."""
    sizes, real = [], rules.materialize

    def noted(df, name, keep=False):
        sizes.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        return real(df, name, keep)

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(rules, "materialize", noted)
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        records = docs.select("doc_id", "lang", "source", *[F.lit(n).cast("long").alias(c) for c, n in (("n_words", 60), ("word_chars", 300), ("n_distinct", 50), ("n_symbols", 0), ("n_dup_lines", 0), ("n_repeat_words", 0))], F.lit(False).alias("base_failed"))
        rules.judge(records)
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert len(sizes) > 2 * rules.STEPS and max(sizes) < 20_000 and sum(sizes) < 100_000
