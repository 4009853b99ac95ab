"""Streams drained at once: complete and forced transactions, and what the batch gives."""

import datetime as dt
import os

from txlog import streaming as S
from txlog.schema import RECORD_SCHEMA, Slot
from txlog.sources import stream_records

T0 = dt.datetime(2024, 1, 1)


def test_complete_forced_and_duplicate_headers(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rec = lambda seq, s, vxid, tag, payload="": ("main", seq, at(s), vxid, 0, "c", tag, payload, None)
    rows = [
        rec(3, 2, 1, "ReqHeader", "foo: late"), rec(1, 0, 1, "Begin"), rec(2, 1, 1, "ReqHeader", "Foo: first"), rec(4, 3, 1, "VCL_call", "HIT"), rec(5, 4, 1, "End"),
        rec(10, 0, 2, "Begin"), rec(11, 1, 2, "ReqHeader", "Foo: open"),
        rec(20, 0, 3, "Begin"), rec(21, 300, 3, "End"),
        rec(30, 1000, 4, "Begin"),
    ]
    spark.createDataFrame(rows, RECORD_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream = stream_records(spark, str(tmp_path / "log"), from_start=True)
    got = {r["vxid"]: r for r in S.drain(S.stream_transactions(stream, [Slot("ReqHeader", "Foo")]), "t").collect()}
    assert got[1]["slot:ReqHeader:foo"] == "Foo: first" and got[1]["disposition"] == "hit" and not got[1]["forced"]
    assert got[2]["forced"] and got[2]["slot:ReqHeader:foo"] == "Foo: open"
    assert got[3]["forced"] and 4 not in got


def test_only_new_files_without_from_start(spark, tmp_path):
    rows = [("main", 1, T0, 0, 0, "-", "Backend_health", "old", None)]
    spark.createDataFrame(rows, RECORD_SCHEMA).write.parquet(str(tmp_path / "log"))
    stream = stream_records(spark, str(tmp_path / "log"))
    assert S.drain(S.stream_raw(stream, "%{tag:Backend_health}x"), "r").count() == 0


def test_since_names_a_time_to_go_on_from(spark, tmp_path):
    rows = [("main", 1, T0, 0, 0, "-", "Backend_health", "old", None)]
    spark.createDataFrame(rows, RECORD_SCHEMA).write.parquet(str(tmp_path / "log"))
    stream = stream_records(spark, str(tmp_path / "log"), since=dt.datetime(2020, 1, 1))
    assert S.drain(S.stream_raw(stream, "%{tag:Backend_health}x"), "r").count() == 1


def test_late_records_are_counted(spark, tmp_path):
    for k, second in enumerate([0, 3600, 7200, 5]):  # the last file comes an hour and more behind the watermark
        rows = [("main", k, T0 + dt.timedelta(seconds=second), 100 + k, 0, "c", "Begin", "", None)]
        spark.createDataFrame(rows, RECORD_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "log" / f"part={k}"))
        os.utime(next((tmp_path / "log" / f"part={k}").glob("*.parquet")), (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema(RECORD_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    query = S.stream_transactions(stream, [Slot("ReqURL")]).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert S.late_records(query) == 1
    assert {r["vxid"] for r in spark.table("late").collect()} == {100, 101}
