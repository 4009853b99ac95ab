"""Streams over several batches: each transaction once, what is late, what was open, lines and statistics as of the batch."""

import datetime as dt
import os
from types import SimpleNamespace

from pyspark.sql import functions as F

from txlog import queries
from txlog import streaming as S
from txlog.operators import assemble, has, log_stats
from txlog.plans import DEFAULT_FORMAT, format_events
from txlog.schema import RECORD_SCHEMA, Slot
from txlog.scratch import scratch_path
from txlog.sources import read_records, stream_records

T0 = dt.datetime(2024, 1, 1)


def rec(seq, s, vxid, tag, payload="", side="c", raw=None):
    return ("main", seq, T0 + dt.timedelta(seconds=s), vxid, 0, side, tag, payload, raw)


def log_of(spark, path, batches):
    """A log whose files follow each other in time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, RECORD_SCHEMA).coalesce(1).write.parquet(f"{path}/part={k}")
        os.utime(next(p for p in (os.path.join(f"{path}/part={k}", f) for f in os.listdir(f"{path}/part={k}")) if p.endswith(".parquet")), (1_700_000_000 + 60 * k,) * 2)
    return stream_records(spark, str(path), from_start=True, max_files=1)


def test_an_end_after_a_forced_emission_opens_no_second_transaction(spark, tmp_path):
    batches = [[rec(1, 0, 1, "Begin"), rec(2, 0, 1, "ReqURL", "/x")], [rec(10, 250, 2, "Begin")], [rec(11, 260, 3, "Begin")], [rec(20, 300, 1, "End"), rec(21, 301, 1, "ReqURL", "/late")]]
    got = S.drain(S.stream_transactions(log_of(spark, tmp_path / "log", batches), [Slot("ReqURL")], with_late=True), "t", checkpoint=str(tmp_path / "c")).collect()
    assert [(r["vxid"], r["seq"], r["slot:ReqURL"], r["status"]) for r in got] == [(1, 1, "/x", "forced")]
    rest = {(r["vxid"], r["status"]): r["late"] for r in S.pending_transactions(spark, str(tmp_path / "c"), [Slot("ReqURL")]).collect()}
    assert rest == {(1, "late"): 2, (2, "open"): 0, (3, "open"): 0}


def test_late_rows_come_when_the_mark_expires(spark, tmp_path):
    batches = [[rec(1, 0, 1, "Begin"), rec(2, 1, 1, "End")], [rec(3, 2, 1, "ReqURL", "/x"), rec(4, 2, 1, "ReqURL", "/y")], [rec(9, 9000, 7, "Begin")], [rec(10, 9001, 8, "Begin")]]
    got = S.drain(S.stream_transactions(log_of(spark, tmp_path / "log", batches), [Slot("ReqURL")], remember_s=60, with_late=True), "t", checkpoint=str(tmp_path / "c")).collect()
    assert sorted((r["vxid"], r["status"], r["late"]) for r in got) == [(1, "complete", 0), (1, "late", 2)]
    assert {r["vxid"] for r in S.pending_transactions(spark, str(tmp_path / "c"), [Slot("ReqURL")]).collect()} == {7, 8}


def test_lines_keep_bytes_cuts_and_bare_transactions(spark, tmp_path):
    fmt = "%{vxid}x %{tag:Debug}x %{Host}i %{tag:ReqHeader}x %{VCL_Log:k}x %u %{Varnish:handling}x %D"
    one = [
        rec(1, 0, 1, "Begin"), rec(2, 0, 1, "Debug", "x", raw=b"foo\x00\xff"), rec(3, 0, 1, "ReqHeader", "Foo: " + "é" * 300), rec(4, 0, 1, "ReqHeader", " hOST\t: a"), rec(5, 0, 1, "VCL_call", "PASS"),
        rec(6, 0, 2, "Begin"), rec(7, 0, 3, "Begin", side="b"), rec(8, 0, 3, "BereqMethod", "GET", side="b"),
    ]
    two = [rec(11, 1, 1, "ReqHeader", "Host: b"), rec(12, 1, 1, "VCL_Log", "k: v"), rec(13, 1, 1, "Timestamp", "Resp: 1.0 0.5 0.1"), rec(14, 1, 1, "End"), rec(15, 1, 2, "End")]
    stream = log_of(spark, tmp_path / "log", [one, two])
    lines = S.drain(S.stream_events(stream, fmt, "%m"), "l", checkpoint=str(tmp_path / "c"))
    rest = S.pending_events(spark, str(tmp_path / "c"), fmt, "%m")
    batch = format_events(spark.createDataFrame(one + two, RECORD_SCHEMA), fmt, "%m")
    assert sorted(r["line"] for r in lines.union(rest.select(lines.columns)).collect()) == sorted(r["line"] for r in batch.collect())
    assert [r["line"] for r in rest.collect()] == ["GET"] and {r["status"] for r in lines.collect()} == {"complete"}


def test_predicates_keep_whole_transactions(spark, tmp_path):
    batches = [[rec(1, 0, 1, "Begin"), rec(2, 0, 1, "ReqURL", "/a"), rec(3, 0, 2, "Begin"), rec(4, 0, 2, "ReqURL", "/b")], [rec(5, 1, 2, "PipeAcct", "1"), rec(6, 1, 1, "End"), rec(7, 1, 2, "End")]]
    lines = S.stream_events(log_of(spark, tmp_path / "log", batches), "%U", where=has("PipeAcct"), keep_tags=["PipeAcct"])
    assert [r["line"] for r in S.drain(lines, "l").collect()] == ["/b"]


def test_statistics_are_those_of_the_batch_and_a_batch_again_replaces_itself(spark, tmp_path):
    rows = [rec(100 * v + k, 60 * v + k, v, tag, payload) for v in range(1, 9) for k, (tag, payload) in enumerate([("Begin", ""), ("ReqURL", "/" + "u" * (40 * v)), ("ReqURL", "z" * 999), ("End", "")]) if not (v == 8 and tag == "End")]
    stream = log_of(spark, tmp_path / "log", [rows[:10], rows[10:20], rows[20:]])
    path, checkpoint, formats = str(tmp_path / "figures"), str(tmp_path / "c"), {"c": "%U"}
    S.stream_log_stats(stream, formats, path, checkpoint, "2 minutes", 255, available_now=True).awaitTermination()
    for _ in range(2):
        S.flush_log_stats(spark, checkpoint, formats, path, "2 minutes", 255)
    want = log_stats(spark.createDataFrame(rows, RECORD_SCHEMA), formats, interval="2 minutes")
    assert sorted(map(tuple, S.read_log_stats(spark, path).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert want.agg(F.max("len_hi")).first()[0] == 322


def test_default_format_over_a_shuffled_log(spark, tmp_path):
    """Within a file records lie in any order."""
    rows = [rec(10 * v + k, v, v, tag, p) for v in range(20) for k, (tag, p) in enumerate([("Begin", ""), ("ReqURL", f"/{v}"), ("ReqURL", "/second"), ("End", "")])]
    stream = log_of(spark, tmp_path / "log", [rows[:40][::-1], rows[40:][::-1]])
    got = S.drain(S.stream_events(stream, DEFAULT_FORMAT), "l").collect()
    want = format_events(spark.createDataFrame(rows, RECORD_SCHEMA), DEFAULT_FORMAT).collect()
    assert sorted((r["vxid"], r["line"]) for r in got) == sorted((r["vxid"], r["line"]) for r in want) and len(got) == 20


def test_late_records_are_counted_over_restarts(spark, tmp_path):
    """More batches than progress reports are kept, in two runs of one query."""
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "c")
    listener = S.LateRecords(spark, str(tmp_path / "late"))
    spark.streams.addListener(listener)
    try:
        for part, seconds in enumerate([[0, 3600, 7200, 5], [9000, 6, 7, 10000]]):
            for k, second in enumerate(seconds):
                spark.createDataFrame([rec(10 * part + k, second, 100 * part + k, "Begin")], RECORD_SCHEMA).coalesce(1).write.parquet(f"{path}/part={4 * part + k}")
                folder = f"{path}/part={4 * part + k}"
                os.utime(next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".parquet")), (1_700_000_000 + 60 * (4 * part + k),) * 2)
            stream = S.stream_transactions(stream_records(spark, path, from_start=True, max_files=1), [Slot("ReqURL")])
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(listener)
    assert S.late_records(query) == 2
    assert S.late_records_so_far(spark, str(tmp_path / "late"), query.id) == 3 and S.late_records_so_far(spark, str(tmp_path / "late"), "none") == 0


def test_a_vxid_that_comes_back(spark):
    rows = [rec(1, 0, 1, "ReqURL", "/stray"), rec(2, 0, 1, "Begin"), rec(3, 0, 1, "ReqURL", "/a"), rec(4, 1, 1, "End"), rec(10, 900, 1, "Begin"), rec(11, 900, 1, "ReqURL", "/b"), rec(12, 900, 1, "ReqURL", "/c")]
    log = spark.createDataFrame(rows[::-1], RECORD_SCHEMA).repartition(3)
    got = assemble(log, [Slot("ReqURL")], with_disposition=False, reused=True)
    assert sorted((r["epoch"], r["slot:ReqURL"]) for r in got.collect()) == [(0, "/stray"), (1, "/a"), (2, "/b")]
    log.write.parquet(path := scratch_path(spark, "reused"))
    plan = assemble(read_records(spark, path), [Slot("ReqURL")], with_disposition=False, reused=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_transactions_share_state_entries_and_keep_their_own_deadlines(spark, tmp_path):
    """Runs of vxids are one state entry each; a run's transactions are complete, forced, late or open on their own, whatever their vxid."""
    vxids = [None, -1, -5000, *range(4090, 4103), 10**12 + 1, *range(8000, 9000)]
    one = [rec(10 * i + k, i / 100, v, tag, f"/{v}", side=s) for i, v in enumerate(vxids) for s in ("c", "b") for k, tag in enumerate(("Begin", "ReqURL"))]
    two = [rec(10 * i + 5, 20 + i / 100, v, "End") for i, v in enumerate(vxids) if i % 2 == 0]
    three = [rec(10**6, 400, 1, "Begin"), *[rec(10**6 + i, 401, v, "ReqURL", "/late") for i, v in enumerate(vxids[:20])]]
    stream = S.stream_transactions(log_of(spark, tmp_path / "log", [one, two, [rec(10**6 - 1, 300, 2, "Begin")], three]), [Slot("ReqURL"), Slot("ReqURL", "a")], with_late=True)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    want = sorted((str(v), s, "complete" if s == "c" and i % 2 == 0 else "forced", f"/{v}") for i, v in enumerate(vxids) for s in ("c", "b"))
    assert sorted((str(r["vxid"]), r["side"], r["status"], r["slot:ReqURL"]) for r in got) == want
    rest = S.pending_transactions(spark, str(tmp_path / "c"), [Slot("ReqURL")]).collect()
    assert sorted((str(r["vxid"]), r["status"], r["late"]) for r in rest) == sorted([("1", "open", 0), ("2", "open", 0), *[(str(v), "late", 1) for v in vxids[:20]]])
    runs = {None if v is None else v >> 12 for v in [*vxids, 1, 2]}
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) == len(runs) == 7


def test_parts_of_several_files_are_batches_that_follow_in_time(spark, monkeypatch):
    monkeypatch.setattr(queries, "PART_ROWS", 1500)
    stream = queries._stream(queries.records(spark, "/root/testdata/sf0.001"), queries.FILES)
    seen = []
    look = lambda df, _: seen.append(df.agg(F.min("ts"), F.max("ts"), F.count("*")).first())
    stream.writeStream.foreachBatch(look).option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == queries.FILES and all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    assert sum(r[2] for r in seen) == queries.records(spark, "/root/testdata/sf0.001").count()


def test_batches_of_the_windowed_query_are_bounded(spark, monkeypatch):
    """The state holds the transactions of a batch, not of the log; the rows are the same."""
    sf, batches = "/root/testdata/sf0.001", []
    drain = lambda stream, name: (stream.writeStream.foreachBatch(lambda df, _: batches.append(df.count())).option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination(), S.drain(stream, name))[1]
    whole = queries.QUERIES["h3_stream_windowed"](spark, sf).collect()
    monkeypatch.setattr(queries, "BATCH_ROWS", 6000)
    monkeypatch.setattr(queries, "S", SimpleNamespace(drain=drain, stream_transactions_windowed=S.stream_transactions_windowed))
    got = queries.QUERIES["h3_stream_windowed"](spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(batches) >= 5 and max(batches) < len(whole) / 3
