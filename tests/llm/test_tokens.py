"""Token operators against the tokenizer library, and exact round trips."""

import hashlib
import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from txlog.llm import bpe_codec, packing, token_counts, token_files
from txlog.llm.common import scratch_path, words
from txlog.llm.encode import chunk_encoder

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a  b\n\n c\t", "hello<|endoftext|> world<|startoftext|>x", "it's we'll I'M 123 ½ ²", "\x1c a\x1db \x85 c\xa0d", "İstanbul Ⱥ ΣΑΣ é é",
    "日本語 テスト 🙂👍", "a" * 5000, "aaaa bbb'''s", "Der Der Der", "x | y | z%%%", "Ɔ Ɩ ǅ ſ",
]


def texts(n=300):
    rng = random.Random(5)
    pools = [[chr(i) for i in range(0x20, 0x7F)], [chr(i) for i in range(0, 0x250)], ["a", "b", " ", "\n", "e", "'"], [chr(rng.randrange(1, 0x2FF0)) for _ in range(60)] + [" "] * 10, ["th", "ing", "er", " ", "on", "s'", "the", "<|endoftext|>"]]
    return ODD + ["".join(rng.choices(rng.choice(pools), k=rng.randrange(1, 60))) for _ in range(n)]


def test_codec_equals_library():
    library, own = Tokenizer.from_file(BYTE), bpe_codec.encoder(BYTE)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == ids, t
        assert own.decode(got) == library.decode(ids, skip_special_tokens=False)


def test_counts_and_ids_equal_library():
    library, count, own = Tokenizer.from_file(WORD), token_counts.counter(WORD), chunk_encoder(WORD)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert count.count(t) == len(ids), t
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, t


def test_whole_tokens_are_proven():
    library, count = Tokenizer.from_file(WORD), token_counts.counter(WORD)
    for piece in sorted(count.whole)[::500]:
        assert len(library.model.tokenize(piece)) == 1


def frame(spark, values):
    rows = [(i, t, "en", "s") for i, t in enumerate(values)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_codec_query_with_nulls_and_extra_columns(spark):
    values = [None, "", "two words", "two words"]
    got = {r["doc_id"]: r for r in bpe_codec.codec_digests(frame(spark, values), BYTE).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and got[0]["n_tokens"] == got[1]["n_tokens"] == 0 and got[0]["ids_sha256"] == got[0]["decoded_sha256"] == empty
    assert got[2]["ids_sha256"] == got[3]["ids_sha256"] and got[2]["decoded_sha256"] == hashlib.sha256(b"two words").hexdigest()
    back = bpe_codec.decode_column(bpe_codec.encode_column(frame(spark, values), BYTE), BYTE).collect()
    assert sorted((r["doc_id"], r["text"]) for r in back) == [(0, ""), (1, ""), (2, "two words"), (3, "two words")]


def test_count_query(spark):
    got = token_counts.token_counts(frame(spark, [None, "é", "word " * 3000]), WORD, 2048).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, False), (1, 2, 1, False), (2, 15000, 3000, True)]
    assert token_counts.token_counts(frame(spark, []), WORD, 2048).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 40), packing.Limits(64, 256, 64), packing.Limits(32, 1, 32)])
def test_groups_respect_limits(limits):
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 200, 300)
    loss = (tokens * rng.random(300)).astype(int)
    seen = [np.zeros(n, int) for n in tokens]
    for seq in packing.pack_group(tokens, loss, limits):
        assert len(seq) <= limits.segments and sum(n for _, _, n in seq) <= limits.tokens
        bears = 0
        for i, start, n in seq:
            seen[i][start : start + n] += 1
            bears += max(0, start + n - max(tokens[i] - loss[i], start))
        assert bears <= limits.loss
    assert all((s == 1).all() for s in seen)


def brute_pack(tokens, loss, limits):
    """The dot-product heuristic in plain loops, before short sequences are cut; the last open example
    takes the place of one that is finished."""
    open_ = [[i, 0] for i, t in enumerate(tokens) if t > 0]
    capacity, out = (limits.tokens, limits.segments, limits.loss), []
    while open_:
        room, sequence = [*capacity], []
        while min(room[:2]) > 0 and open_:
            best = None
            for at, (i, start) in enumerate(open_):
                n = 0
                while start + n < tokens[i] and n < room[0] and max(0, start + n + 1 - (tokens[i] - min(tokens[i], loss[i]))) - max(0, start - (tokens[i] - min(tokens[i], loss[i]))) <= room[2]:
                    n += 1
                bears = max(0, start + n - (tokens[i] - loss[i])) - max(0, start - (tokens[i] - loss[i]))
                score = sum(d / c * r / c for d, r, c in zip((n, 1, bears), room, capacity))
                if n and (best is None or score > best[0] + 1e-12):
                    best = (score, at, n, bears)
            if best is None:
                break
            _, at, n, bears = best
            i, start = open_[at]
            sequence.append((i, start, n))
            room = [room[0] - n, room[1] - 1, room[2] - bears]
            open_[at][1] += n
            if open_[at][1] == tokens[i]:
                open_[at] = open_[-1]
                open_.pop()
        out.append(sequence)
    return out


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 40), packing.Limits(64, 3, 64), packing.Limits(100, 64, 90), packing.Limits(32, 1, 32)])
def test_packing_equals_brute_force(limits, monkeypatch):
    """Each of the three limits is what ends some sequence."""
    monkeypatch.setattr(packing, "_at_powers", lambda seq: [seq])
    rng = np.random.default_rng(5)
    ended = set()
    for _ in range(8):
        tokens = rng.integers(0, int(rng.choice([10, 40, 200])), 80)
        loss = np.maximum(0, tokens - int(rng.choice([0, 3, 30])))
        got = packing.pack_group(tokens, loss, limits)
        assert got == brute_pack(tokens.tolist(), loss.tolist(), limits)
        for seq in got[:-1]:
            bears = sum(max(0, s + n - max(tokens[i] - loss[i], s)) for i, s, n in seq)
            full = (sum(n for _, _, n in seq) == limits.tokens, len(seq) == limits.segments, bears == limits.loss)
            assert any(full)
            ended |= {k for k, f in enumerate(full) if f}
    if limits.tokens == 64:
        assert ended == {0, 1, 2} or limits.loss == 64


def test_default_limits_bind(spark):
    values = ["word " * n for n in [*range(1, 40), *[5] * 1000, *[20_000] * 3, *[300] * 60]]
    rows = packing.pack(frame(spark, values).coalesce(1), WORD, 2).collect()
    per = {}
    for r in rows:
        s = per.setdefault(r["sequence_id"], [0, 0, 0])
        s[0], s[1], s[2] = s[0] + r["length"], s[1] + 1, s[2] + r["loss_tokens"]
        first = int(r["doc_tokens"] * packing.PROMPT)
        assert r["loss_tokens"] == max(0, r["start"] + r["length"] - first) - max(0, r["start"] - first)
    limits = packing.Limits()
    assert all(t <= limits.tokens and n <= limits.segments and b <= limits.loss for t, n, b in per.values())
    assert any(t == limits.tokens and b == limits.loss for t, n, b in per.values())
    assert sum(t for t, _, _ in per.values()) == sum(len(v.split()) + 1 for v in values)


def test_most_tokens_lie_in_full_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs, WORD, 2).groupBy("sequence_id").agg({"length": "sum", "loss_tokens": "sum"}).toPandas()
    full = got[got["sum(length)"] == packing.Limits().tokens]
    print("share", full["sum(length)"].sum() / got["sum(length)"].sum(), len(got), "loss bound", (got["sum(loss_tokens)"] == packing.Limits().loss).sum())
    assert full["sum(length)"].sum() > 0.9 * got["sum(length)"].sum()


def test_packing_places_every_id_once(spark):
    values = [None, "", "short text", "long " * 9000, *["some words of a text " * k for k in range(1, 40)]]
    rows = packing.pack(frame(spark, values).repartition(3), WORD, 2).collect()
    library = Tokenizer.from_file(WORD)
    ids = [library.encode(t or "", add_special_tokens=False).ids + [2] for t in values]
    placed = {}
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and len(piece) == r["length"] > 0
        placed.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for d, spans in placed.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert set(placed) == set(range(len(values)))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    used = padded = 0
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
        used, padded = used + at, padded + (at if at & (at - 1) == 0 else 4096)
    assert padded == used
    assert packing.pack(frame(spark, []), WORD, 2).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bit_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack_bits(ids, bits)
    assert len(data) == -(-1001 * bits // 64) * 8
    assert (token_files.unpack_bits(data, bits, 0, 1001) == ids).all() and (token_files.unpack_bits(data, bits, 37, 500) == ids[37:537]).all()
    assert token_files.pack_bits(ids[:0], bits) == b""


def test_file_random_access():
    rng = np.random.default_rng(0)
    docs = [(None if i == 0 else i, rng.integers(0, 99999, int(rng.integers(0, 9000))).astype(np.uint32)) for i in range(60)]
    stream = io.BytesIO()
    writer = token_files.FileWriter(stream, 17)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    reader = token_files.FileReader(stream, len(stream.getvalue()))
    assert all((reader.read(i) == ids).all() for i, (_, ids) in enumerate(docs))
    assert all(d == e and (a == b).all() for (d, _, a), (e, b) in zip(reader, docs))


def test_files_in_order_of_ids(spark):
    values = [None, "", "b c", "a", "long text " * 500, "b c"]
    df = frame(spark, values).orderBy("text").unionAll(spark.createDataFrame([(None, "no id", "en", "s")], "doc_id long, text string, lang string, source string"))
    folder = scratch_path(spark, "t")
    got = sorted(token_files.read_files(token_files.write_files(df, folder, WORD, 1), folder).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(WORD), 0
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 4, 5]
    for r, t in zip(got, ["no id", *values]):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    folder = scratch_path(spark, "t")
    assert token_files.read_files(token_files.write_files(frame(spark, []), folder, WORD, 1), folder).count() == 0


def test_files_split_hot_ids(spark, monkeypatch):
    """Rows without an id, and equal rows, go to several files of about the size asked for."""
    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    df = spark.createDataFrame([(None if i % 3 else 7, "same text " * 20, "x", i, "y") for i in range(600)], "doc_id long, text string, n_tokens string, start int, file string")
    folder = scratch_path(spark, "t")
    manifest = token_files.write_files(df, folder, WORD, 1)
    assert manifest.count() >= 4 and manifest.selectExpr("max(n_docs)").first()[0] < 250
    got = sorted(token_files.read_files(manifest, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 400 + [7] * 200
    assert [r["start"] for r in got] == [41 * i for i in range(600)]


def test_words():
    assert words(None) == [] and words(" \t\n") == []
    assert words("a\x1cb\xa0c d\x0be f") == ["a\x1cb\xa0c", "d", "e f"]
