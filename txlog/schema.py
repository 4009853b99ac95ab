"""The record table that every job starts from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("instance", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("vxid", T.LongType()),
        T.StructField("pvxid", T.LongType()),
        T.StructField("side", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("raw", T.BinaryType()),
    ]
)
#: A transaction's key.
KEY = ["instance", "vxid"]
CLIENT, BACKEND, RAW = "c", "b", "-"


@dataclass(frozen=True, order=True)
class Slot:
    """The first record of a tag, or of a tag with a header, in a transaction."""

    tag: str
    header: str = ""

    @property
    def column(self) -> str:
        # A backtick would have to be doubled wherever the column is named; a backslash is no header character.
        return f"slot:{self.tag}:{self.header.lower()}".replace("`", "\\") if self.header else f"slot:{self.tag}"
