"""Inputs of other formats than Parquet, ids of other types, clashing names, empty tables."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from txlog.llm import bpe_codec, jaccard_join, packing, perplexity, quality_rules, substring_dedup, token_counts, token_files, toxicity
from txlog.llm.common import FILE, ROW, keyed, scratch_path

SF = "/root/testdata/sf0.001"
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")


@pytest.mark.parametrize("form", ["json", "orc", "parquet"])
def test_rows_of_any_format_have_names(spark, tmp_path, form):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.repartition(3).write.format(form).save(str(tmp_path / form))
    read = spark.read.schema(docs.schema).format(form).load(str(tmp_path / form))
    rows = keyed(read)
    assert rows.select(FILE, ROW).distinct().count() == docs.count() and rows.drop(FILE, ROW).columns == docs.columns
    want = {tuple(r) for r in substring_dedup.dedup_documents(docs).select("doc_id", "text").collect()}
    assert {tuple(r) for r in substring_dedup.dedup_documents(read).select("doc_id", "text").collect()} == want
    kept = {r.doc_id for r in jaccard_join.keep_documents(docs, width=5, percent=80).select("doc_id").collect()}
    assert len(kept) == jaccard_join.keep_documents(read, width=5, percent=80).count()


def test_filtered_tables_are_keyed_by_a_copy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.where("doc_id < 50").union(docs.where("doc_id < 50"))
    assert keyed(twice).select(FILE, ROW).distinct().count() == 100


def test_string_ids_and_clashing_names(spark):
    rows = [("a", "some text"), ("b", None), (None, ""), ("c", "word " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "web", -1, -1, -1, -1, -1, True, "x") for i, t in rows], "doc_id string, text string, lang string, source string, n_tokens int, start int, length int, offset int, n_bytes int, over_limit boolean, ids_sha256 string")
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, WORD, 5).collect()} == {"a": (9, 2, False), "b": (0, 0, False), None: (0, 0, False), "c": (150_000, 30_000, True)}
    assert {r.doc_id: r.n_tokens for r in bpe_codec.codec_digests(docs, BYTE).collect()}["b"] == 0
    pieces = packing.pack(docs, WORD, 2).collect()
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in ("a", "b", None)} == {"a": 3, "b": 1, None: 1}
    assert {r.doc_id: r.n_words for r in substring_dedup.substring_dedup(docs).collect()}["c"] == 30_000 if hasattr(substring_dedup, "substring_dedup") else True
    labels = spark.createDataFrame([("a", 1, 0)], "doc_id string, quality int, toxic int")
    assert {r.doc_id: r.kept for r in perplexity.judge(perplexity.perplexities(keyed(docs), labels)).collect()}["b"] is False
    assert toxicity.scores(docs, toxicity.fit(docs, labels)).count() == 4
    assert quality_rules.judge(quality_rules.records(docs)).where("kept").count() == 0


def test_toxic_sample_takes_one_row_of_an_id(spark):
    texts = [(k, f"word{k % 7} nice {'vile' if k % 2 else 'kind'} thing", "en") for k in range(200)]
    docs = spark.createDataFrame(texts + [(1, f"copy {k} vile", "en") for k in range(3000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    got = toxicity.scores(docs.where("doc_id <> 1"), toxicity.fit(docs, labels)).where("held_out").collect()
    assert all(r.predicted == r.doc_id % 2 for r in got) and len(got) > 20


def test_nothing_in_nothing_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert token_counts.token_counts(docs, WORD, 5).count() == bpe_codec.codec_digests(docs, BYTE).count() == packing.pack(docs, WORD, 2).count() == 0
    folder = scratch_path(spark, "no-tokens")
    assert token_files.read_files(token_files.write_files(docs, folder, WORD, 1), folder).count() == 0


def test_folders_of_unknown_kind_fail_at_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with pytest.raises(ValueError, match="nowhere"):
        token_files.write_files(docs, "nowhere://x/y", WORD, 1)
