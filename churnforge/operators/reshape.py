"""Wide <-> long reshaping shared by the profiling operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str],
            value_type: str = "string", name_col: str = "column",
            value_col: str = "value") -> DataFrame:
    """Unpivot ``value_cols`` into (id_cols..., column, value) rows.

    One narrow Expand per row, no shuffle; downstream groupBy(column, ...)
    then runs a single partial+final aggregation for every column at once.
    """
    casted = df.select(*id_cols, *[F.col(c).cast(value_type).alias(c) for c in value_cols])
    return casted.unpivot(list(id_cols), list(value_cols), name_col, value_col)
