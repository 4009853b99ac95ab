"""The pipeline against brute-force versions of its stages, each on the stage's own input."""

import itertools
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_duplicates import WORD, brute_spans, union
from tests.llm.test_quality import brute_perplexity, brute_rules
from txlog.llm import perplexity as kn
from txlog.llm.common import materialize

SF = "/root/testdata/sf0.001"


def brute_classifier(rows, trusted, held):
    """``held`` are documents that are not counted if they are trusted, and then say what is usual."""
    ppl = brute_perplexity(rows, trusted - held)
    kept = set()
    for lang in {r.lang for r in rows}:
        cells = sorted(int(np.floor(np.log(ppl[r.doc_id]) * 1000)) for r in rows if r.lang == lang and r.doc_id in trusted & held and ppl[r.doc_id])
        limit = np.exp((cells[int(np.ceil(kn.QUANTILE * len(cells))) - 1] + 1) / 1000 + kn.STRAY / np.sqrt(len(cells))) if cells else np.inf
        for r in rows:
            if r.lang == lang and ppl[r.doc_id]:
                n = len(" ".join(WORD.findall(r.text)))
                if ppl[r.doc_id] <= limit * np.exp(2 / np.sqrt(n)):
                    kept.add(r.doc_id)
    return kept


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    held = {r["doc_id"] for r in docs.where("pmod(xxhash64(text), 5) = 0").collect()}
    columns, given = docs.columns, docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        got = docs.collect()
        if name == "quality_rules":
            assert {r.doc_id for r in got} == {d for d, k in brute_rules(given).items() if k}
        elif name == "quality_classifier":
            assert {r.doc_id for r in got} == brute_classifier(given, good, held)
        elif name == "jaccard_join":
            sets = {}
            for r in given:
                w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(r.text)]
                sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
            pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            assert {r.doc_id for r in got} == {d for d, c in union(sets, pairs).items() if d == c}
        elif name == "substring_dedup":
            want = {}
            for r, (w, gone) in zip(given, brute_spans([r.text for r in given], 35)):
                want[r.doc_id] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r.text
            assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
        else:
            library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
            ids = {r.doc_id: np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4") for r in given}
            assert sum(r.length for r in got) == sum(map(len, ids.values()))
            assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in got)
        if name != "packing":
            assert docs.columns == columns and len(got) <= len(given)
        given = got


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
