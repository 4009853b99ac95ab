"""Token ids in files of fixed-width packed bits.

A file holds blocks of whole documents.  Every id takes the least number of bits that the
vocabulary needs, ids of a block are packed without gaps, and an index at the end has, for every
block, its byte offset, first document and first token: any document is read by one seek, and a
block is unpacked by numpy at once.

Layout (little-endian): ids' bits by block, each block padded to 8 bytes | doc ids (int64, with
-2**63 for null) | token counts (int64) | per block (byte offset, first document, first token;
int64) | footer: n_docs, n_tokens, n_blocks, bits (int64), b"TXIDS001".

Files lie in a folder that driver and executors share.  A task writes under a name of its own
and renames at the end, so a task that runs again leaves the same file.

Nulls: a null text is the empty one; rows with a null doc_id come first.  Ties in doc_id follow
the rows' places in the table, and go on in the next file where one is full.  Extra columns are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txlog.llm.common import FILE, ROW, documents, keyed, map_rows, materialize, scratch_path
from txlog.llm.encode import chunk_encoder

MAGIC = b"TXIDS001"
BLOCK_TOKENS = 1 << 16
#: Bytes of text (and of index) that go to a file; with little text, files are smaller so that all cores have some.
FILE_BYTES, LEAST_BYTES = 64 << 20, 4 << 20
_READ_DOCS = 4096  # rows given on at once when files are read
_NULL = -(1 << 63)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """ids (below 2**bits, bits <= 32) as a gapless bit string, padded to 8 bytes."""
    n = len(ids)
    out = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    v = ids.astype(np.uint64)
    low = v << shift
    spill = shift + np.uint64(bits) > np.uint64(64)
    high = v[spill] >> (np.uint64(64) - shift[spill])
    if n:
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[starts]] = np.bitwise_or.reduceat(low, starts)
    out[word[spill] + 1] |= high
    return out[:-1].astype("<u8").tobytes()


def unpack_bits(data: bytes, bits: int, first: int, n: int) -> np.ndarray:
    """ids first .. first+n of a packed block."""
    words = np.r_[np.frombuffer(data, "<u8"), np.zeros(1, np.uint64)].astype(np.uint64)
    at = np.arange(first, first + n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    high = np.where(shift > 0, words[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    return (((words[word] >> shift) | high) & np.uint64((1 << bits) - 1)).astype("<u4")


class FileWriter:
    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.docs: list[int] = []
        self.counts: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []
        self._held: list[np.ndarray] = []
        self._n = self._at = self._tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if not self._held:
            self.blocks.append((self._at, len(self.docs), self._tokens))
        self.docs.append(_NULL if doc_id is None else doc_id)
        self.counts.append(len(ids))
        self._held.append(ids)
        self._n += len(ids)
        self._tokens += len(ids)
        if self._n >= BLOCK_TOKENS:
            self._flush()

    def _flush(self) -> None:
        if self._held:
            data = pack_bits(np.concatenate(self._held), self.bits)
            self.stream.write(data)
            self._at += len(data)
            self._held, self._n = [], 0

    def close(self) -> tuple[int, int]:
        self._flush()
        for x in (self.docs, self.counts, self.blocks, [len(self.docs), self._tokens, len(self.blocks), self.bits]):
            self.stream.write(np.array(x, "<i8").tobytes())
        self.stream.write(MAGIC)
        return len(self.docs), self._tokens


class FileReader:
    """Random access to a token file given as a seekable stream of known size."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 40)
        tail = stream.read(40)
        if tail[32:] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_tokens, n_blocks, self.bits = map(int, np.frombuffer(tail[:32], "<i8"))
        index = 16 * n_docs + 24 * n_blocks
        self.end = size - 40 - index
        stream.seek(self.end)
        raw = np.frombuffer(stream.read(index), "<i8")
        self.docs, self.counts = raw[:n_docs], raw[n_docs : 2 * n_docs]
        self.blocks = raw[2 * n_docs :].reshape(n_blocks, 3)
        self.starts = np.r_[0, np.cumsum(self.counts)]

    def _block(self, k: int) -> bytes:
        end = self.blocks[k + 1][0] if k + 1 < len(self.blocks) else self.end
        self.stream.seek(int(self.blocks[k][0]))
        return self.stream.read(int(end - self.blocks[k][0]))

    def read(self, i: int) -> np.ndarray:
        """ids of the i-th document of the file."""
        k = int(np.searchsorted(self.blocks[:, 1], i, side="right")) - 1
        return unpack_bits(self._block(k), self.bits, int(self.starts[i] - self.blocks[k][2]), int(self.counts[i]))

    def __iter__(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of all documents, a block at a time."""
        for k, (_, first, token) in enumerate(self.blocks):
            last = self.blocks[k + 1][1] if k + 1 < len(self.blocks) else len(self.docs)
            ids = unpack_bits(self._block(k), self.bits, 0, int(self.starts[last] - token))
            for i in range(int(first), int(last)):
                at = int(self.starts[i] - token)
                d = int(self.docs[i])
                yield (None if d == _NULL else d), int(self.starts[i]), ids[at : at + int(self.counts[i])]


#: Schemes of folders that token files can lie in, and what pyarrow calls them.
_SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _file_system(url: str):
    from pyarrow import fs

    scheme, colon, rest = url.partition(":")
    if not colon:
        scheme, rest = "file", f"//{url}"
    elif scheme not in _SCHEMES:
        raise ValueError(f"token files can't be written to {scheme} folders")
    elif rest.startswith("/") and not rest.startswith("//"):
        rest = f"//{rest}"
    return fs.FileSystem.from_uri(f"{_SCHEMES[scheme]}:{rest}")


def write_files(df: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Write the ids of all texts in ascending doc_id order; returns the manifest
    (file, ordinal, n_docs, n_tokens, start: tokens of all files before)."""
    _file_system(folder)  # fails here rather than in the tasks
    rows = keyed(df).select("doc_id", "text", FILE, ROW)
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 1
    parts = max(-(-size // FILE_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)))
    # Files are ranges of a total order, so that rows without an id, or with the same, may be split.
    rows = rows.repartitionByRange(parts, "doc_id", FILE, ROW).sortWithinPartitions("doc_id", FILE, ROW).select("doc_id", "text")

    def run(batches):
        from pyspark import TaskContext

        batches = (b for b in batches if b["doc_id"])
        first = next(batches, None)
        if first is None:
            return
        enc, ordinal = chunk_encoder(path), TaskContext.get().partitionId()
        bits = max(1, (enc.vocab.size - 1).bit_length())
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        target, own = f"{root}/part-{ordinal:06d}.ids", f"{root}/.{uuid.uuid4().hex}"
        with files.open_output_stream(own) as stream:
            out = FileWriter(stream, bits)
            batch = first
            while batch is not None:
                for d, text in zip(batch["doc_id"], batch["text"]):
                    ids = np.frombuffer(enc.encode(text), "<u4")
                    out.add(d, np.append(ids, np.uint32(end_id)))
                batch = next(batches, None)
            n_docs, n_tokens = out.close()
        files.move(own, target)
        yield {"file": [f"part-{ordinal:06d}.ids"], "ordinal": [ordinal], "n_docs": [n_docs], "n_tokens": [n_tokens]}

    manifest = materialize(map_rows(rows, run, "file string, ordinal int, n_docs long, n_tokens long"), "manifest")
    # One row per file: small by construction, whatever the files hold.
    before = Window.orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document, read back from the files: doc_id, global start, n_tokens, crc32 of the ids."""

    def run(batches):
        for b in batches:
            for name, base in zip(b["file"], b["start"]):
                files, root = _file_system(folder)
                size = files.get_file_info(f"{root}/{name}").size
                with files.open_input_file(f"{root}/{name}") as stream:
                    rows = ((d, base + s, len(x), zlib.crc32(x.tobytes())) for d, s, x in FileReader(stream, size))
                    while some := [*islice(rows, _READ_DOCS)]:
                        yield dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), zip(*some)))

    # As many tasks as files: one row each, however small the manifest is.
    files = manifest.select("file", "start").repartition(max(1, manifest.count()), "file")
    return map_rows(files, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    manifest = write_files(documents(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_files(manifest, folder)
