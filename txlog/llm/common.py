"""Helpers shared by the operators: words, rows to Arrow, tables in the shared folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txlog.scratch import materialize, scratch_path, scratch_scope

__all__ = ["FILE", "ROW", "documents", "drop_rows", "id_type", "keyed", "map_rows", "materialize", "scratch_path", "scratch_scope", "words"]

#: The columns that name a row of a keyed table; tables given to operators have none of these names.
FILE, ROW = "_txlog_file", "_txlog_row"

#: Python's str.split() also splits at these characters; a word keeps them.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_ROWS = 1024
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    """Runs of anything but space and \\t\\n\\v\\f\\r; a null text has none."""
    if not text:
        return []
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def map_rows(df: DataFrame, fn: Callable[[Iterator[dict[str, list]]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """mapInArrow with batches as dicts of Python lists (or numpy arrays on the way out).  Only ``_ROWS`` rows
    at a time become Python objects."""
    fields = _arrow_schema(df.sparkSession, schema)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for whole in batches:
            for k in range(0, whole.num_rows, _ROWS):
                b = whole.slice(k, _ROWS)
                yield {n: b.column(n).to_pylist() for n in b.schema.names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in fields], schema=fields)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with two more columns, FILE and ROW, that name each row, whatever its columns hold.

    A table as read from files of a format that numbers rows (Parquet) is taken as it stands: a hash of the file's path,
    and the place in it.  Anything else is written to the shared folder first, so that a name stays with its row."""
    if docs._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation") and "_metadata" not in docs.columns:
        try:
            return docs.withColumns({FILE: F.xxhash64("_metadata.file_path"), ROW: F.col("_metadata.row_index")})
        except AnalysisException:  # other formats have no row_index
            pass
    return materialize(docs.withColumns({FILE: F.lit(0).cast("long"), ROW: F.monotonically_increasing_id()}), "rows")


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    """The type of the ids, which operators hand through as they are."""
    return docs.schema[column].dataType.simpleString()


def drop_rows(rows: DataFrame, losers: DataFrame) -> DataFrame:
    """The keyed ``rows`` without those that ``losers``, a written table, names, and without the two columns
    of the key.  Spark broadcasts the names only while that table is small."""
    columns = ["`" + c.replace("`", "``") + "`" for c in rows.columns if c not in (FILE, ROW)]
    return rows.join(losers.select(FILE, ROW), [FILE, ROW], "left_anti").select(columns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
