"""Text files of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One line per event; a path that exists is replaced unless ``append``."""
    df.select("line").write.mode("append" if append else "overwrite").text(path)


def stream_lines(df: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Continuous lines in files by date and hour of ``ts`` (in place of rotating one file)."""
    rows = df.select("line", F.date_format("ts", "yyyy-MM-dd").alias("dt"), F.date_format("ts", "HH").alias("hr"))
    out = rows.writeStream.format("text").partitionBy("dt", "hr").outputMode("append").option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start(path)
