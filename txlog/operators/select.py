"""Selections of records, and of transactions by their records."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlog.functions import field, header_name, header_value
from txlog.schema import KEY

MAX_RECLEN = 255


def filter_side(records: DataFrame, sides: Iterable[str]) -> DataFrame:
    return records.where(F.col("side").isin(*sides))


def filter_tags(records: DataFrame, tags: Iterable[str]) -> DataFrame:
    """Only records of the tags that are needed; the condition reaches the scan."""
    return records.where(F.col("tag").isin(*sorted(tags)))


def filter_headers(records: DataFrame, headers: Mapping[str, Iterable[str]]) -> DataFrame:
    """For the tags in ``headers`` only payloads that carry one of the tag's header names; other tags stay."""
    return records.where(header_condition(headers))


def header_condition(headers: Mapping[str, Iterable[str]]) -> Column:
    name = header_name(F.col("payload"))
    keep = ~F.col("tag").isin(*headers) if headers else F.lit(True)
    for tag, names in headers.items():
        keep = keep | ((F.col("tag") == tag) & name.isin(*sorted({n.upper() for n in names})))
    return F.coalesce(keep, F.lit(False))


def truncate_payload(records: DataFrame, max_reclen: int = MAX_RECLEN) -> DataFrame:
    """Payloads of at most ``max_reclen`` - 1 bytes (one byte is the terminator's); a character that the cut
    would split goes as a whole.  Bytes that are not UTF-8 are cut where they stand."""
    room = max_reclen - 1
    p = F.col("payload")
    raw = p.cast("binary")
    cut = F.substring(raw, 1, room)
    # The cut may fall behind the first, second or third byte of a character; continuation bytes are 80 to BF.
    for back in range(min(3, room), -1, -1):
        starts = ~F.hex(F.substring(raw, room + 1 - back, 1)).between("80", "BF")
        cut = F.when(starts, F.substring(raw, 1, room - back)).otherwise(cut)
    ascii_cut = F.substring(p, 1, room)
    fits = F.octet_length(p) <= room
    return records.withColumn("payload", F.when(fits, p).when(F.octet_length(p) == F.length(p), ascii_cut).otherwise(cut.cast("string")))


def has(tag: str) -> Column:
    """Predicate: the record has the tag."""
    return F.col("tag") == tag


def matches(tag: str, regex: str, header: str | None = None, n: int | None = None, caseless: bool = False) -> Column:
    """Predicate: the tag's payload (or its header's value, or a field of either) matches."""
    p = F.col("payload")
    found = F.col("tag") == tag
    if header is not None:
        found &= header_name(p) == header.upper()
        p = header_value(p)
    if n is not None:
        p = field(p, n)
    return F.coalesce(found & p.rlike(f"(?i){regex}" if caseless else regex), F.lit(False))


def equals(tag: str, value: str, caseless: bool = False) -> Column:
    """Predicate: the tag's payload is ``value``."""
    p, v = (F.lower("payload"), value.lower()) if caseless else (F.col("payload"), value)
    return F.coalesce((F.col("tag") == tag) & (p == v), F.lit(False))


def query_records(records: DataFrame, pred: Column) -> DataFrame:
    """Records that satisfy the predicate, each for itself (raw grouping)."""
    return records.where(pred)


def query_transactions(records: DataFrame, pred: Column, frequent: bool = False) -> DataFrame:
    """All records of the transactions in which some record satisfies the predicate.

    The keys that satisfy it are found first (pre-aggregated per task) and joined to the records; while they
    are few, Spark broadcasts them and the log itself is not shuffled.  Where most transactions satisfy it,
    ``frequent`` flags them over one exchange of the log instead, which is then read once.  Where the
    transactions are assembled anyway, pass the predicate to ``assemble``: it then costs no shuffle."""
    if frequent:
        found = F.max(F.coalesce(pred, F.lit(False))).over(Window.partitionBy(*KEY))
        return records.where("side <> '-'").withColumn("_wanted", found).where("_wanted").select(records.columns)
    hits = records.where((F.col("side") != "-") & pred).select(*KEY).distinct()
    return records.where("side <> '-'").join(hits, KEY, "left_semi").select(records.columns)
