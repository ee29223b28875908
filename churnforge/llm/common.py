"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.session import scratch_path
from churnforge.sources.tables import table_path

#: Regex classes as the contracts write them (ASCII white space only).
WS = r"[\x20\x09-\x0D]+"
SLICE_ROWS = 1024


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    Cuts lineage in a form every executor can read again after a loss, and
    gives the planner the true size of what was written.
    """
    return materialise_at(df, name, compression)[0]


def materialise_at(df: DataFrame, name: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """:func:`materialise`, with the place of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a materialised table that nothing will read again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_slices(batches: Iterator[pa.RecordBatch], text_index: int, max_chars: int = 4_000_000,
                field: str | None = None) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches so that one slice holds about ``max_chars`` of text
    (always at least one row); nulls come out as empty strings. ``field`` names
    the text inside a struct column."""
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE_ROWS):
            batch = whole.slice(at, SLICE_ROWS)      # only these rows become Python strings at a time
            column = batch.column(text_index)
            texts = [t or "" for t in (column if field is None else column.field(field)).to_pylist()]
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= max_chars:
                    yield batch.slice(start, i + 1 - start), texts[start:i + 1]
                    start, size = i + 1, 0
            if start < len(texts):
                yield batch.slice(start), texts[start:]
