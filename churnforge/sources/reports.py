"""Report sinks and readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_kv_report(lines: DataFrame, path: str) -> str:
    """Write one `key: value` line per row of the ``value`` column."""
    lines.select("value").write.mode("overwrite").text(path)
    return path


def parse_kv_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines containing ':' -> (key, value), split at the first ':' and trimmed."""
    t = spark.read.text(path).where(F.col("value").contains(":"))
    parts = F.split(F.col("value"), ":", 2)
    return t.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", header: bool = True) -> str:
    w = df.write.mode("overwrite")
    if fmt == "csv":
        # keep blank-but-present text (" ") intact, as the raw customer export has it
        w = (w.option("header", header).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False))
    w.format(fmt).save(path)
    return path
