"""Tables in the folder that the cluster's machines share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Open ``scratch_scope``s of this thread, innermost last: the folders made in each.
_SCOPES: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("scratch_scopes", default=())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, on a single machine, a folder made here where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = "file://" + tempfile.mkdtemp(prefix="txlog-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder; it goes with the innermost ``scratch_scope``, or with ``keep`` with the one around that."""
    path = f"{shared_dir(spark)}/txlog/{name}-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    for scope in scopes[max(len(scopes) - 1 - keep, 0) : len(scopes) - keep]:
        scope.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = scratch_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _visible(files, folder) -> list:
    return [f for f in (files.listStatus(folder) if files.exists(folder) else []) if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


def count_files(spark: SparkSession, path: str) -> int:
    """How many files Spark has written to a folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return len(_visible(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where))


def move_files(spark: SparkSession, source: str, target: str, prefix: str, second: int | None = None, fill: tuple[str, int] | None = None) -> None:
    """Move what Spark has written to ``source`` into the folder ``target``, under names that begin with ``prefix``; with ``second``
    they are dated that long after a fixed time, and with ``fill`` copies of the file in a folder make up a number of files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    here, there = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    files = here.getFileSystem(conf)
    files.mkdirs(there)
    moved = [(f.getPath(), jvm.org.apache.hadoop.fs.Path(there, prefix + f.getPath().getName())) for f in _visible(files, here)]
    for old, new in moved:
        files.rename(old, new)
    if fill:
        copied = _visible(files, jvm.org.apache.hadoop.fs.Path(fill[0]))[0].getPath()
        for k in range(fill[1] - len(moved)):
            moved.append((copied, jvm.org.apache.hadoop.fs.Path(there, f"{prefix}none-{k}.parquet")))
            jvm.org.apache.hadoop.fs.FileUtil.copy(files, copied, files, moved[-1][1], False, conf)
    if second is not None:
        for _, new in moved:
            files.setTimes(new, 1000 * (1_700_000_000 + second), -1)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Scratch tables made inside are deleted at the end: what is read later was made with ``keep``.  Spark deletes the shuffle files
    of plans that its driver has collected, which a driver with room to spare would put off: it is asked to."""
    own: list[tuple[SparkSession, str]] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for spark, path in own:
            discard(spark, path)
        if own:
            gc.collect()  # frames that refer to plans
            own[0][0].sparkContext._jvm.System.gc()
