"""A growing folder of JSON lines as a stream with positions: (file, byte), so that a stream starts at the head or at the tail and
goes on after a restart where its checkpoint says, within a file that has grown as well as in newer files.

The folder is append-only: files are taken in the order of their names, and only grow at their ends.  A line counts once its newline
is there.  Spark asks the driver for positions and deals ranges of bytes to tasks; each task reads the lines that begin in its own.

Files named ``.gz`` are compressed lines, positions in them compressed bytes.  They are moved into the folder when they are whole, and
what is new of one is one task's: write them in pieces."""

from __future__ import annotations

import base64
import datetime as dt
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from txlog.schema import RECORD_SCHEMA

#: Bytes of a range.
RANGE = 64 << 20
_PIECE = 1 << 16
#: The end of the names of compressed files.
PACKED = ".gz"


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


class FolderReader(DataSourceStreamReader):
    """Positions are ``{"file": name, "byte": n}``: all of the files before ``name`` and n bytes of it."""

    def __init__(self, path: str, from_start: bool):
        self.path, self.from_start = path, from_start

    def _files(self, after: str = "") -> list[tuple[str, int]]:
        from pyarrow import fs

        files, root = _open(self.path)
        found = files.get_file_info(fs.FileSelector(root))
        return sorted((x.base_name, x.size) for x in found if x.is_file and x.base_name >= after and not x.base_name.startswith((".", "_")))

    def _whole_lines(self, name: str, size: int, start: int = 0) -> int:
        """The end of the last line that is complete."""
        if name.endswith(PACKED):
            return size
        files, root = _open(self.path)
        with files.open_input_file(f"{root}/{name}") as f:
            end = size
            while end > start:
                at = max(start, end - _PIECE)
                f.seek(at)
                cut = f.read(end - at).rfind(b"\n")
                if cut >= 0:
                    return at + cut + 1
                end = at
        return start

    def _tail(self) -> dict:
        files = self._files()
        return {"file": files[-1][0], "byte": self._whole_lines(*files[-1])} if files else {"file": "", "byte": 0}

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0} if self.from_start else self._tail()

    def latestOffset(self) -> dict:
        return self._tail()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in self._files(start["file"]):
            if name > end["file"]:
                break
            low = start["byte"] if name == start["file"] else 0
            high = end["byte"] if name == end["file"] else size
            if name.endswith(PACKED):
                out += [Range(name, low, high)] if low < high else []
            else:
                out += [Range(name, k, min(k + RANGE, high)) for k in range(low, high, RANGE)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        files, root = _open(self.path)
        with files.open_input_file(f"{root}/{partition.file}") as f:
            if partition.file.endswith(PACKED):
                rest = b""
                for piece in _unpacked(f, partition.start, partition.end):
                    *lines, rest = (rest + piece).split(b"\n")
                    for line in lines:
                        yield from _record(line)
                yield from _record(rest)
                return
            at, rest = partition.start, b""
            if at:  # a line that began before belongs to the range before
                f.seek(at - 1)
                skip = f.read(1) != b"\n"
            else:
                skip = False
            while at - len(rest) < partition.end:
                piece = f.read(_PIECE)
                at += len(piece)
                *lines, rest = (rest + piece).split(b"\n")
                begin = at - len(rest) - sum(len(x) + 1 for x in lines)
                for line in lines:
                    if not skip and begin < partition.end:
                        yield from _record(line)
                    skip, begin = False, begin + len(line) + 1
                if not piece:
                    if rest and not skip and begin < partition.end:  # the last line of a file that an other follows
                        yield from _record(rest)
                    return

    def commit(self, end: dict) -> None:
        """Nothing to release: the folder keeps its files."""


def _unpacked(f, start: int, end: int) -> Iterator[bytes]:
    """What lies between two positions of a compressed file, which may have several members."""
    f.seek(start)
    stream, left = zlib.decompressobj(wbits=31), end - start
    while left and (piece := f.read(min(left, _PIECE))):
        left -= len(piece)
        while piece:
            yield stream.decompress(piece)
            piece = stream.unused_data
            if stream.eof:
                stream = zlib.decompressobj(wbits=31)


def _record(line: bytes) -> Iterator[tuple]:
    """The record of a line; what is no JSON object with a tag gives none."""
    try:
        r = json.loads(line)
        if not isinstance(r, dict) or r.get("tag") is None:
            return
        at = r.get("ts")
        ts = None if at is None else dt.datetime.fromisoformat(at)
        ts = ts.replace(tzinfo=dt.timezone.utc) if ts is not None and ts.tzinfo is None else ts
        raw = None if r.get("raw") is None else base64.b64decode(r["raw"])
        yield tuple({"ts": ts, "raw": raw}.get(f.name, r.get(f.name)) for f in RECORD_SCHEMA)
    except ValueError:
        return


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "txlog_folder"

    def schema(self) -> T.StructType:
        return RECORD_SCHEMA

    def streamReader(self, schema: T.StructType) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("from_start", "false") == "true")


def stream_folder(spark: SparkSession, path: str, from_start: bool = False) -> DataFrame:
    """Records of a growing folder of JSON lines (``raw`` in base64, times in ISO 8601): from its head, or only what comes from now
    on; after a restart from the checkpoint's position, either way."""
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("txlog_folder").option("from_start", str(from_start).lower()).load(path)
