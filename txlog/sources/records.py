"""Records from saved logs and from growing ones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.schema import RECORD_SCHEMA


def read_records(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A saved log (parquet, json or csv); json and csv carry ``raw`` in base64."""
    if format not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown format {format}")
    if format == "csv":
        text = ", ".join(f"{f.name} {'string' if f.name == 'raw' else f.dataType.simpleString()}" for f in RECORD_SCHEMA)
        return spark.read.schema(text).csv(path, header=True).withColumn("raw", F.unbase64("raw"))
    return spark.read.schema(RECORD_SCHEMA).format(format).load(path)


def stream_records(spark: SparkSession, path: str, from_start: bool = False, format: str = "parquet", since: dt.datetime | None = None, max_files: int | None = None) -> DataFrame:
    """New files of a growing log; with ``from_start`` those that are there already, too; at most ``max_files`` in a batch.

    A file is new if it was written after ``since`` (default: now).  A job that is to go on after a restart
    gives the same ``since`` again, or else loses the files of the time in between; its checkpoint knows
    which it has read."""
    reader = spark.readStream.schema(RECORD_SCHEMA).format(format)
    stream = (reader if max_files is None else reader.option("maxFilesPerTrigger", max_files)).load(path)
    if from_start:
        return stream
    began = since or spark.sql("select current_timestamp() as t").first()["t"]
    # The stream's file index knows when a file was written; older files give no rows.
    return stream.where(F.col("_metadata.file_modification_time") >= F.lit(began)).select(*RECORD_SCHEMA.names)


def stream_topic(spark: SparkSession, servers: str, topic: str, from_start: bool = False, **options: str) -> DataFrame:
    """Records of a topic of JSON messages, by offset: from its head, or only what comes from now on (after a
    restart: from the checkpoint's offsets).  Needs Spark's connector for such topics on the class path."""
    wanted = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if from_start else "latest"} | options
    return records_of_messages(spark.readStream.format("kafka").options(**wanted).load())


def records_of_messages(messages: DataFrame) -> DataFrame:
    """Records from a column ``value`` of JSON bytes (``raw`` in base64); messages that are no JSON object are dropped."""
    parsed = messages.select(F.from_json(F.col("value").cast("string"), RECORD_SCHEMA).alias("r"))
    return parsed.where("r.tag is not null").select("r.*")


def filter_instance(records: DataFrame, name: str) -> DataFrame:
    """Records of one log instance (a partition column where the table has one)."""
    return records.where(F.col("instance") == name)
