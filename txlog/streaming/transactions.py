"""Transactions, lines and statistics of a stream of records.

``stream_transactions_windowed`` consists of built-in operators only and is the one to prefer where a
transaction may be emitted some time after its last record; ``stream_transactions`` emits it at its End.
Records that arrive behind the watermark are dropped; ``late_records`` counts them."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txlog.functions import header_name
from txlog.operators.assemble import DISPOSITION_TAGS, TIMEOUT_S, _first, _slot_condition, disposition
from txlog.operators.select import MAX_RECLEN
from txlog.operators.stats import COUNTS, stats_columns
from txlog.plans.formats import BINARY_TAGS, cut_records, format_lines, format_needs, format_raw, submitted
from txlog.schema import BACKEND, CLIENT, KEY, Slot
from txlog.scratch import scratch_path
from txlog.streaming.assembly import Assembly

_LINE = ["instance", "vxid", "pvxid", "side", "ts", "seq", "line"]


def stream_transactions(records: DataFrame, slots: Iterable[Slot], timeout_s: int = TIMEOUT_S, delay: str = "10 seconds", remember_s: int = 3600, with_late: bool = False) -> DataFrame:
    """A transaction when its End arrives, or, with ``forced``, when ``timeout_s`` have passed since its
    Begin.  The state holds, per open transaction, each slot's lowest seq and payload: its size is
    bounded by the slots, its number by the timeout.  seq decides what is first, not arrival.

    Each transaction is given once: records after the timeout, and those that come when it was given, are
    dropped; ``with_late`` adds rows of status ``late`` that count them, given when ``remember_s`` have passed."""
    a = Assembly(tuple(sorted(set(slots))), timeout_s=timeout_s, delay=delay, remember_s=remember_s)
    found = a.columns(a.run(records)).withColumn("forced", F.col("status") == "forced")
    return found if with_late else found.where("status <> 'late'").drop("status", "late")


def pending_transactions(spark: SparkSession, checkpoint: str, slots: Iterable[Slot]) -> DataFrame:
    """What ``stream_transactions`` over the same slots had open when it stopped, with status and late as of ``with_late``."""
    return Assembly(tuple(sorted(set(slots)))).pending(spark, checkpoint)


def _format_assembly(formats: dict[str, str], wanted: bool, max_reclen: int | None, **how) -> Assembly:
    slots, dispo = format_needs(formats)
    return Assembly(tuple(sorted(slots)), dispo, BINARY_TAGS, wanted, max_reclen, **how)


def _lines(tx: DataFrame, formats: dict[str, str]) -> DataFrame:
    tx = tx.where(F.col("status") != "late").withColumn("pvxid", F.lit(0).cast("long"))
    return format_lines(tx.where(submitted(formats)), formats).select(*_LINE, "status")


def stream_events(records: DataFrame, cformat: str, bformat: str = "", max_reclen: int | None = MAX_RECLEN, where: Column | None = None, keep_tags: Iterable[str] = (), **how) -> DataFrame:
    """Lines of a stream's client and backend transactions, as ``format_events`` gives those of a log, each when its transaction
    is complete or forced.  Sides, tags, headers and payloads are cut to what the formats need before the one stateful exchange;
    ``where`` (a condition on records; ``keep_tags`` are the tags it looks at) keeps whole transactions."""
    formats = {s: f for s, f in ((CLIENT, cformat), (BACKEND, bformat)) if f}
    a = _format_assembly(formats, where is not None, None, **how)
    rows = cut_records(records, formats, max_reclen, where, {*keep_tags, "Begin", "End"})
    return _lines(a.columns(a.run(rows)), formats)


def pending_events(spark: SparkSession, checkpoint: str, cformat: str, bformat: str = "") -> DataFrame:
    """Lines of the transactions that ``stream_events`` had open when it stopped, as they are."""
    formats = {s: f for s, f in ((CLIENT, cformat), (BACKEND, bformat)) if f}
    return _lines(_format_assembly(formats, False, None).pending(spark, checkpoint), formats)


def _figures(tx: DataFrame, formats: dict[str, str], interval: str) -> DataFrame:
    tx = tx.where("status <> 'late'").withColumn("pvxid", F.lit(0).cast("long")).withColumn("submitted", submitted(formats))
    return format_lines(tx, formats).groupBy(F.window("ts", interval)["start"].alias("start")).agg(*stats_columns())


def stream_log_stats(records: DataFrame, formats: dict[str, str], path: str, checkpoint: str, interval: str = "30 seconds", max_reclen: int = MAX_RECLEN, available_now: bool = False, **how) -> StreamingQuery:
    """The figures of ``log_stats`` per interval of a stream.  Each batch writes what its transactions add, in a folder of its own
    number, so that a batch that runs again replaces itself; ``read_log_stats`` adds them up."""
    formats = {s: f for s, f in formats.items() if f}
    a = _format_assembly(formats, False, max_reclen, **how)
    found = a.columns(a.run(cut_records(records, formats, max_reclen, keep_all=True)))
    out = found.writeStream.foreachBatch(lambda df, k: _figures(df, formats, interval).write.mode("overwrite").parquet(f"{path}/batch={k}"))
    out = out.outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def flush_log_stats(spark: SparkSession, checkpoint: str, formats: dict[str, str], path: str, interval: str = "30 seconds", max_reclen: int = MAX_RECLEN) -> None:
    """Adds what the stopped stream had open."""
    formats = {s: f for s, f in formats.items() if f}
    rows = _format_assembly(formats, False, max_reclen).pending(spark, checkpoint)
    _figures(rows, formats, interval).write.mode("overwrite").parquet(f"{path}/batch=-1")


def read_log_stats(spark: SparkSession, path: str) -> DataFrame:
    """start, seen, submitted, writes, bytes, len_hi and len_overflows of the intervals so far."""
    sums = [F.max(c).alias(c) if c == "len_hi" else F.sum(c).alias(c) for c in COUNTS]
    return spark.read.parquet(path).groupBy("start").agg(*sums)


def stream_transactions_windowed(records: DataFrame, slots: Iterable[Slot], gap: str = "2 minutes", delay: str = "10 seconds") -> DataFrame:
    """Built-in operators only: a transaction is emitted after ``gap`` without records.  Those still open
    at the last watermark are left to ``drain``."""
    slots = sorted(set(slots))
    payload = F.coalesce("payload", F.lit(""))
    rows = records.where("side <> '-'").withColumn("hname", header_name(F.col("payload"))).withWatermark("ts", delay)
    needed = F.col("tag").isin(*DISPOSITION_TAGS)
    for s in slots:
        needed = needed | _slot_condition(s)
    aggs = [F.max("pvxid").alias("pvxid"), F.min("seq").alias("seq"), F.count(F.when(F.coalesce(needed, F.lit(False)), 1)).alias("n_recs"), disposition().alias("disposition")]
    aggs += [_first(payload, _slot_condition(s)).alias(s.column) for s in slots]
    return rows.groupBy(*KEY, "side", F.session_window("ts", gap).alias("session")).agg(*aggs).withColumn("ts", F.col("session.start")).drop("session")


def stream_stats(records: DataFrame, interval: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """Records, bytes and longest payload per interval of a stream."""
    size = F.octet_length(F.coalesce("payload", F.lit(""))) + 1
    by = F.window("ts", interval)
    return records.withWatermark("ts", delay).groupBy(by).agg(F.count("*").alias("records"), F.sum(size).alias("bytes"), F.max(size).alias("len_hi")).select(F.col("window.start").alias("start"), "records", "bytes", "len_hi")


def stream_raw(records: DataFrame, rformat: str) -> DataFrame:
    """Raw lines of a stream; stateless."""
    return format_raw(records, rformat)


def late_records(query: StreamingQuery) -> int:
    """How many rows the query's stateful operators dropped as too late, over the progress reports that Spark
    keeps (spark.sql.streaming.numRecentProgressUpdates).  After an aggregate that combines first, a row is
    one key's combined records of one task."""
    reports = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in reports for op in p["stateOperators"])


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Process what is there, then stop: the rows that the stream emits, read back as a table.  What is open stays in
    the state under ``checkpoint``."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), checkpoint or scratch_path(spark, f"{name}-checkpoint")
    if mode == "append":
        out = stream.writeStream.format("parquet").option("path", path).outputMode(mode)
    else:  # the last of a complete result is the result
        out = stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).outputMode(mode)
    query = out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
