"""Counts of what streams drop as too late, over the whole life of a query: a query keeps its id across restarts."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


class LateRecords(StreamingQueryListener):
    """Notes each batch's drops as an empty file ``<query id>/<batch>-<drops>`` in a folder that outlives the run, so that a batch
    that runs again counts once; batches without drops leave nothing.  Add it with ``spark.streams.addListener``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def onQueryStarted(self, event) -> None:
        """Nothing to note."""

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        dropped = sum(op.get("numRowsDroppedByWatermark", 0) for op in p["stateOperators"])
        if dropped:
            files, folder = _folder(self.spark, f"{self.path}/{p['id']}")
            files.mkdirs(folder)
            files.create(folder.suffix(f"/{p['batchId']}-{dropped}"), True).close()

    def onQueryIdle(self, event) -> None:
        """Nothing to note."""

    def onQueryTerminated(self, event) -> None:
        """Nothing to note."""


def late_records_so_far(spark: SparkSession, path: str, query_id: str) -> int:
    """Rows that a query has dropped since its checkpoint was made."""
    files, folder = _folder(spark, f"{path.rstrip('/')}/{query_id}")
    if not files.exists(folder):
        return 0
    by_batch: dict[str, int] = {}
    for f in files.listStatus(folder):
        batch, dropped = f.getPath().getName().split("-")
        by_batch[batch] = max(by_batch.get(batch, 0), int(dropped))
    return sum(by_batch.values())
