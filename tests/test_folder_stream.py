"""A growing folder of lines: from the head, from the tail, and on after a restart, with no record lost or read twice."""

import gzip
import json
import pathlib

import pytest

from txlog import queries
from txlog.scratch import count_files, move_files
from txlog.sources import folder, stream_folder


def line(seq, **more):
    return json.dumps({"instance": "main", "seq": seq, "ts": "2024-01-01T00:00:00.000123", "vxid": 1, "pvxid": 0, "side": "c", "tag": "ReqURL", "payload": f"/é{seq}"} | more, ensure_ascii=False) + "\n"


def run(stream, path, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_head_growth_and_restart(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", tmp_path / "out", tmp_path / "c"
    log.mkdir()
    (log / "a.json").write_text("".join(line(k) for k in range(5)) + line(5)[:20], encoding="utf-8")  # the last line is not complete
    seqs = lambda: sorted(r["seq"] for r in spark.read.parquet(str(out)).collect())
    run(stream_folder(spark, str(log), from_start=True), out, checkpoint)
    assert seqs() == list(range(5))
    with (log / "a.json").open("a", encoding="utf-8") as f:
        f.write(line(5)[20:] + line(6))
    (log / "b.json").write_text(line(7, raw="AP8=") + "no json\n[1]\n" + line(8, tag=None) + line(9, ts=None, payload=None), encoding="utf-8")
    run(stream_folder(spark, str(log), from_start=True), out, checkpoint)
    assert seqs() == [*range(8), 9]
    run(stream_folder(spark, str(log), from_start=True), out, checkpoint)
    assert seqs() == [*range(8), 9]
    rows = {r["seq"]: r for r in spark.read.parquet(str(out)).collect()}
    assert rows[7]["raw"] == b"\x00\xff" and rows[6]["payload"] == "/é6" and rows[9]["ts"] is None and rows[0]["ts"].microsecond == 123


def test_tail_starts_behind_what_is_there(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", tmp_path / "out", tmp_path / "c"
    log.mkdir()
    (log / "a.json").write_text(line(0) + line(1))
    run(stream_folder(spark, str(log)), out, checkpoint)
    with (log / "a.json").open("a") as f:
        f.write(line(2))
    run(stream_folder(spark, str(log)), out, checkpoint)
    assert [r["seq"] for r in spark.read.parquet(str(out)).collect()] == [2]


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_ranges_share_out_the_lines(tmp_path, monkeypatch, size):
    """Whatever the ranges and pieces, each line is read by one of them."""
    monkeypatch.setattr(folder, "RANGE", size)
    monkeypatch.setattr(folder, "_PIECE", 16)
    (tmp_path / "a").write_text("".join(line(k, payload="x" * (k % 50)) for k in range(30)))
    (tmp_path / "b").write_text(line(30) + line(31).rstrip("\n"))
    (tmp_path / "c").write_text(line(32) + '{"seq')
    reader = folder.FolderReader(str(tmp_path), True)
    parts = reader.partitions(reader.initialOffset(), end := reader.latestOffset())
    assert [r[1] for p in parts for r in reader.read(p)] == list(range(33)) and end["file"] == "c"
    assert reader.partitions(end, end) == [] and list(reader._files("b")) == reader._files()[1:]


def test_compressed_files(spark, tmp_path, monkeypatch):
    """Files of several members, one that ends without a newline, an empty one, and what is appended to the last one."""
    monkeypatch.setattr(folder, "_PIECE", 16)
    log, out, checkpoint = tmp_path / "log", tmp_path / "out", tmp_path / "c"
    log.mkdir()
    pack = lambda *seqs: gzip.compress("".join(line(k) for k in seqs).encode())
    (log / "a.json.gz").write_bytes(pack(0, 1) + pack(2))
    (log / "b.json").write_text(line(3))
    (log / "c.json.gz").write_bytes(gzip.compress(line(4).rstrip("\n").encode()))
    (log / "d.json.gz").write_bytes(gzip.compress(b""))
    (log / "e.json.gz").write_bytes(pack(5))
    reader = folder.FolderReader(str(log), True)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert [r[1] for p in parts for r in reader.read(p)] == list(range(6))
    run(stream_folder(spark, str(log), from_start=True), out, checkpoint)
    with (log / "e.json.gz").open("ab") as f:
        f.write(pack(6, 7))
    (log / "f.json.gz").write_bytes(pack(8))
    run(stream_folder(spark, str(log), from_start=True), out, checkpoint)
    assert sorted(r["seq"] for r in spark.read.parquet(str(out)).collect()) == list(range(9))


def test_the_folder_of_the_query_is_small(spark, monkeypatch):
    """Its files are compressed and bounded in rows."""
    monkeypatch.setattr(queries, "FILE_ROWS", 2000)
    moved = []
    monkeypatch.setattr(queries, "move_files", lambda s, source, *a: (moved.append(count_files(s, source)), move_files(s, source, *a)))
    monkeypatch.setattr(queries, "stream_folder", lambda s, path, **how: (paths.append(path), stream_folder(s, path, **how))[1])
    paths = []
    rows = queries.QUERIES["a2_stream_folder"](spark, "/root/testdata/sf0.001")
    assert rows.count() == queries.records(spark, "/root/testdata/sf0.001").count() and sum(moved) > 10
    found = [p for p in pathlib.Path(paths[0].removeprefix("file://")).iterdir() if not p.name.startswith(".")]
    assert {p.suffix for p in found} == {".gz"} and sum(p.stat().st_size for p in found) < 40 * rows.count()
