"""Statistics over a log: per run, or per monitor interval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txlog.operators.select import MAX_RECLEN

COUNTS = ["seen", "submitted", "writes", "bytes", "len_hi", "len_overflows"]

def stats_columns() -> list[Column]:
    """The aggregates over transactions with submitted, line, len_hi and len_overflows."""
    sent = F.count(F.when(F.col("submitted"), 1))
    size = F.when(F.col("submitted"), F.octet_length("line") + 1)
    zero = F.lit(0).cast("long")
    return [
        F.count("*").alias("seen"), sent.alias("submitted"), sent.alias("writes"), F.coalesce(F.sum(size), zero).alias("bytes"),
        F.coalesce(F.max("len_hi"), zero).alias("len_hi"), F.coalesce(F.sum("len_overflows"), zero).alias("len_overflows"),
    ]


def log_stats(records: DataFrame, formats: dict[str, str], interval: str | None = None, max_reclen: int = MAX_RECLEN, running: bool = False) -> DataFrame:
    """seen, submitted, writes, bytes, len_hi, len_overflows of the sides in ``formats`` (side -> format), for
    the log or for each ``interval`` in which transactions begin.

    All are columns of the one assembly that makes the lines.  len_hi is the longest payload that fills a slot, before it
    is cut; len_overflows counts such payloads over ``max_reclen``, which later records of a filled slot are not.
    ``running`` adds totals up to each interval, over the few rows already aggregated."""
    from txlog.plans.formats import format_lines, plan

    formats = {s: f for s, f in formats.items() if f}
    tx = format_lines(plan(records, formats, max_reclen=max_reclen, keep_all=True, measured=True), formats)
    if not interval:
        return tx.agg(*stats_columns())
    out = tx.groupBy(F.window("ts", interval)["start"].alias("start")).agg(*stats_columns())
    if running:
        upto = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumns({f"total_{c}": F.sum(c).over(upto) for c in ("seen", "submitted", "writes", "bytes")})
    return out
