"""Streaming scoring (C2, C3): file-source stream -> validation -> two sinks.

Arriving records are validated inside the stream: valid ones are scored into
one sink, the others go to a reject sink with their reason. Both are row-local
(no aggregation, no state), so no watermark is needed; each query has its own
checkpoint location, and file source plus checkpoint give exactly-once output
across restarts and lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from churnforge.plans.scoring import ChurnScorer


def score_stream(spark: SparkSession, scorer: ChurnScorer, source_dir: str, schema: T.StructType,
                 sink_dir: str, reject_dir: str, checkpoint_dir: str, available_now: bool = True,
                 max_files_per_trigger: int = 100) -> list:
    """Start the scoring and the rejecting query; returns both handles."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    valid, rejected = scorer.split(stream)

    def start(df: DataFrame, sink: str, name: str):
        writer = (df.writeStream.format("parquet").option("path", sink)
                  .option("checkpointLocation", f"{checkpoint_dir}/{name}").outputMode("append"))
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
        return writer.start()

    return [start(scorer.score(valid), sink_dir, "scored"), start(rejected, reject_dir, "rejected")]


def run_to_completion(spark: SparkSession, scorer: ChurnScorer, source_dir: str, schema: T.StructType,
                      sink_dir: str, reject_dir: str, checkpoint_dir: str) -> tuple[DataFrame, DataFrame]:
    """(scored, rejected) once all records present have gone through."""
    for query in score_stream(spark, scorer, source_dir, schema, sink_dir, reject_dir, checkpoint_dir):
        query.awaitTermination()
    return spark.read.parquet(sink_dir), spark.read.parquet(reject_dir)
