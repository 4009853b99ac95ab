"""Duplicate operators against brute force."""

import collections
import hashlib
import itertools
import pathlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from txlog.llm import embedding_dups, jaccard_join, substring_dedup
from txlog.llm.common import FILE, ROW, drop_rows, keyed, materialize
from txlog.llm.components import components
from txlog.scratch import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def union(n, pairs):
    root = {i: i for i in n}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


def corpus(seed):
    """Copies, edited copies, texts around shared passages, short and repetitive texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    fresh = lambda n: rng.choices(vocabulary, k=n)
    passage, out = fresh(60), []
    for _ in range(12):
        base = fresh(rng.randrange(40, 160))
        out.append(base)
        for _ in range(rng.randrange(0, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(copy if rng.random() < 0.7 else [x.upper() for x in copy])
    for _ in range(30):
        k = rng.randrange(0, 80)
        out.append(fresh(k) + passage + fresh(rng.randrange(0, 80)))
    out += [["same"] * 90, ["same"] * 80, ["a", "b", "c"], ["a", "b", "c"], ["a", "b"], ["x"] * 34, ["x"] * 35]
    texts = [" ".join(x) if rng.random() < 0.8 else "\n".join(x) for x in out] + [None, "", " \t\n"]
    rng.shuffle(texts)
    return texts


def docs(spark, texts):
    rows = [(1000 - i, t, "en", "s", 0) for i, t in enumerate(texts)]  # copies come before the smallest id
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 4, 85), (3, 5, 80)])
def test_jaccard_join(spark, seed, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_TOKENS", 700 if seed == 2 else 1_000_000)
    texts = corpus(seed)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").translate(lower))
        sets[1000 - i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = union(sets, pairs)
    df = docs(spark, texts).repartition(3)
    got = {r["doc_id"]: r for r in jaccard_join.join(df, width, percent).collect()}
    assert len(pairs) > 50
    assert {d: r["component_id"] for d, r in got.items()} == want
    assert all(got[d]["n_shingles"] == len(s) for d, s in sets.items())
    if seed == 1:
        kept = jaccard_join.keep_documents(df, width, percent)
        assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, c in want.items() if d == c}


def row_components(texts, width, percent):
    """Per row the smallest row that links reach."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, union(range(len(sets)), pairs)


def shared_ids(texts, seed):
    """Ids that are null, or that several rows (equal ones, and others) share."""
    rng = random.Random(seed)
    rows = [(rng.choice([None, rng.randrange(60), 100 + i]), t) for i, t in enumerate(texts)]
    return rows + rng.sample(rows, 20)


def test_jaccard_on_null_and_shared_ids(spark):
    rows = shared_ids(corpus(6), 6)
    schema = "doc_id long, text string, component_id string, spans int, rid int, block string"
    df = spark.createDataFrame([(*r, "x", 1, i, "y") for i, r in enumerate(rows)], schema).repartition(3)
    sets, root = row_components([t for _, t in rows], 4, 85)
    members = collections.defaultdict(list)
    for i, r in root.items():
        members[r].append(rows[i][0])
    smallest = {r: min((d for d in ids if d is not None), default=None) for r, ids in members.items()}
    want = sorted((str(d), len(sets[i]), str(smallest[root[i]] if sets[i] else d)) for i, (d, _) in enumerate(rows))
    assert sorted((str(a), n, str(c)) for a, n, c in map(tuple, jaccard_join.join(df).collect())) == want
    kept = jaccard_join.keep_documents(df, 4, 85)
    assert kept.columns == df.columns
    got = collections.Counter(root[r["rid"]] for r in kept.collect())
    assert got == collections.Counter({r: 1 for r in root.values()})
    assert {root[r["rid"]]: r["doc_id"] for r in kept.collect()} == smallest | {i: d for i, (d, _) in enumerate(rows) if not sets[i]}


def test_jaccard_edges(spark):
    schema = "doc_id long, text string, component_id string"
    df = spark.createDataFrame([(None, "a b c d e", "x"), (1, "a b c d e", "x"), (7, "a b c d e", "x"), (7, "a b c d e", "x"), (None, None, "x"), (3, "", "x"), (8, "z " * 60000 + "y", "x")], schema)
    got = sorted(map(tuple, jaccard_join.join(df).collect()), key=str)
    assert got == [(1, 2, 1), (3, 0, 3), (7, 2, 1), (7, 2, 1), (8, 2, 8), (None, 0, None), (None, 2, 1)]
    assert jaccard_join.join(spark.createDataFrame([], schema)).count() == 0
    assert jaccard_join.keep_documents(spark.createDataFrame([], schema), 5, 80).count() == 0


def test_keys_of_tables_as_read_and_of_others(spark, tmp_path):
    spark.range(50).withColumn("text", F.lit("x")).repartition(3).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for df in (read, read.where("id < 20"), read.union(read), read.join(read.select("id"), "id")):
        rows = keyed(df)
        assert rows.select(FILE, ROW).distinct().count() == df.count()
        assert drop_rows(rows, rows.where("id >= 10")).columns == df.columns
    assert "rows-" not in str(keyed(read).inputFiles()) and "rows-" in str(keyed(read.union(read)).inputFiles())


def brute_spans(texts, window):
    w = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    for x in w:
        gone = [False] * len(x)
        for i in range(len(x) - window + 1):
            if count[tuple(x[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        yield x, gone


@pytest.mark.parametrize("seed,window,k", [(1, 35, 8), (2, 12, 4), (3, 9, 9)])
def test_substring_dedup(spark, seed, window, k):
    texts = corpus(seed)
    df = docs(spark, texts).repartition(3)
    got = {r["doc_id"]: r for r in substring_dedup.removed(df, window, k).collect()}
    new = {r["doc_id"]: r for r in substring_dedup.dedup_documents(df, window, k).collect()}
    total = 0
    for i, (w, gone) in enumerate(brute_spans(texts, window)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        r = got[1000 - i]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert new[1000 - i]["text"] == (kept if any(gone) else texts[i])
        total += sum(gone)
    assert total > 500


def test_substring_on_null_and_shared_ids(spark):
    rows = shared_ids(corpus(7), 7)
    df = spark.createDataFrame([(*r, "x", i, 2) for i, r in enumerate(rows)], "doc_id long, text string, spans string, rid int, `odd.name` int").repartition(3)
    want, texts = [], {}
    for i, (w, gone) in enumerate(brute_spans([t for _, t in rows], 35)):
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((str(rows[i][0]), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
        texts[i] = kept if any(gone) else rows[i][1]
    assert sorted((str(a), *r) for a, *r in map(tuple, substring_dedup.removed(df).collect())) == sorted(want)
    new = substring_dedup.dedup_documents(df)
    assert new.columns == df.columns and {r["rid"]: r["text"] for r in new.collect()} == texts


def test_substring_edges(spark):
    text = " ".join(f"w{i}" for i in range(50))
    long = " ".join(f"v{i}" for i in range(200_000))
    schema = "doc_id long, text string, spans string"
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, "only here", "x"), (None, None, "x"), (2, long, "x"), (3, "a b " + long, "x")], schema)
    got = sorted((r["n_words"], r["n_removed"]) for r in substring_dedup.removed(df).collect())
    assert got == [(0, 0), (2, 0), (50, 50), (50, 50), (200_000, 200_000), (200_002, 200_000)]
    for empty in (spark.createDataFrame([], schema), df.where("doc_id = 7")):
        assert substring_dedup.removed(empty).count() == substring_dedup.dedup_documents(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 10), (10, 30), (30, 40), (5, 5)] + [(100, 100 + i) for i in range(1, 50)] + [(500 + i, 501 + i) for i in range(40)]
    got = {r["v"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union({x for e in edges for x in e}, edges)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("tile", [16, 1024])
def test_embeddings(spark, tile, monkeypatch):
    monkeypatch.setattr(embedding_dups, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x = rng.normal(size=16)
        label = int(rng.integers(0, 3))
        for _ in range(int(rng.choice([1, 1, 1, 2, 6]))):
            rows.append((len(rows), [float(v) for v in np.float32(x + rng.normal(size=16) * rng.choice([0, 0.02, 0.05, 0.1]))], label))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [1.0] * 15 + [None], 1), (n + 5, rows[0][1], None), (n + 6, rows[0][1][:8], rows[0][2]), (n + 7, rows[0][1], rows[0][2])]
    links = collections.Counter()
    pairs = []
    good = [r for r in rows if r[0] < n or r[0] >= n + 6]
    for a, b in itertools.combinations(good, 2):
        x, y = np.array(a[1]), np.array(b[1])
        if a[2] == b[2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
            pairs.append((a[0], b[0]))
            links[a[0]] += 1
            links[b[0]] += 1
    want = union({r[0] for r in rows}, pairs)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, links string")
    got = {r["vec_id"]: r for r in embedding_dups.links(df).collect()}
    assert len(pairs) > 50
    assert {v: (r["n_links"], r["component_id"], r["kept"]) for v, r in got.items()} == {v: (links[v], c, v == c) for v, c in want.items()}


@pytest.mark.parametrize("scale", [1e200, 1e-200, 5e-324])
def test_embeddings_of_any_size(spark, scale):
    x = [3.0, 4.0, 1.0]
    rows = [(1, [v * scale for v in x], 1), (2, [v * scale * 2 for v in x], 1), (3, [-v * scale for v in x], 1), (4, x, 1), (5, [float("inf"), 1.0, 1.0], 1), (None, x, 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dups.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    tied = {1: (2, 1), 2: (2, 1), 4: (2, 1)}
    assert got == tied | {3: (0, 3), 5: (0, 5), None: (0, None)}


def test_pivots_exclude_tiles_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(embedding_dups, "TILE", 8)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    x = np.repeat(centres, 26, axis=0) + rng.normal(size=(312, 24)) * 0.08
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.98
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<double>, label string")
    sent = []
    plain = embedding_dups.materialize
    monkeypatch.setattr(embedding_dups, "materialize", lambda df, name: sent.append((name, plain(df, name))) or sent[-1][1])
    got = {r["vec_id"]: r["n_links"] for r in embedding_dups.links(df).collect()}
    assert got == {i: int(n) - 1 for i, n in enumerate(near.sum(axis=1))}
    tables = dict(sent)
    tiles = tables["tile-angles"].count()
    assert tables["tile-pairs"].count() < 0.5 * tiles * (tiles + 1) / 2


def test_empty_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int, n_links long, kept string")
    assert embedding_dups.links(empty).count() == 0


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, scale, err = embedding_dups.quantise(x)
    near = (q.astype(np.float64) @ q.T) * scale[:, None] * scale
    assert (np.abs(near - x @ x.T) <= err[:, None] + err + err[:, None] * err + 1e-12).all()


def test_each_step_of_the_join_deletes_its_tables(spark, monkeypatch):
    """When the next step begins, nothing is left but what it reads."""
    root, seen = pathlib.Path(shared_dir(spark).removeprefix("file://"), "txlog"), {}
    before = {*root.iterdir()} if root.exists() else set()

    def looked(df, name, *a, **how):
        seen.setdefault(name, []).append({p.name.rsplit("-", 1)[0] for p in root.iterdir() if p not in before} if root.exists() else set())
        return materialize(df, name, *a, **how)

    monkeypatch.setattr(jaccard_join, "materialize", looked)
    words = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(k, " ".join(words[k // 2 : k // 2 + 40])) for k in range(30)], "doc_id long, text string")
    assert jaccard_join.join(docs).count() == 30
    assert not seen["heads"][0] & {"common", "shared", "prefixes", "first-texts", "edges"} and not seen["chosen"][0] & {"heads", "forest", "edges"}
    assert not seen["named"][0] & {"heads", "members", "forest", "edges"}
