"""Op 4: exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over (first characters and
digest of the normalised text, length, id) and sorted inside each partition,
so equal texts end up side by side with the row to keep first. Neighbours are
then compared in full. Because length and id are part of the range key, a
group of any size spreads over as many partitions as its rows need; the runs
that touch a partition's edges are stitched by comparing the two edge texts of
every partition, a table of two rows a partition.

Of equal texts, the row with the most code points in its original text stays,
then the smallest id. Edge cases: null counts as empty; texts of white space
only equal the empty text; null ids come after all others; of wholly repeated
rows exactly one is kept (each row has its own decision); an empty table gives
an empty one. The filter's columns travel inside one struct, so their names
cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import WS, materialise
from churnforge.session import map_in_arrow

KEY_CHARS = 24


def normalised(text: Column) -> Column:
    """Text without [\\x20\\x09-\\x0D]; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS, "")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, digest, text) of one partition -> rows with the
    run's first id, its size, and marks on the first and last run.

    Holds ids and digests of one open run, and one text; a closed run is
    emitted at once.
    """
    part = TaskContext.get().partitionId()
    number, held, text, names = 0, [], None, ("id", "digest", "keep_id", "group_size", "first",
                                              "part", "edge", "edge_text")

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number
        size = sum(b.num_rows for b in held)
        keep = held[0].column(0).slice(0, 1)
        edge = number if last or number == 0 else None
        for k, b in enumerate(held):
            n = b.num_rows
            first = np.zeros(n, bool)
            first[0] = k == 0
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), keep.take(pa.array(np.zeros(n, np.int64))), pa.array([size] * n, pa.int64()),
                pa.array(first), pa.array([part] * n, pa.int64()), pa.array([edge] * n, pa.int64()),
                pa.array([text if f and edge is not None else None for f in first], pa.string())], names=names)
        number += 1

    for batch in batches:
        if not batch.num_rows:
            continue
        texts, rows = batch.column(2), batch.select([0, 1])
        same = np.zeros(batch.num_rows, bool)
        same[1:] = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        same[0] = bool(held) and texts[0].as_py() == text
        cuts = np.flatnonzero(~same)
        if held and same[0]:
            end = cuts[0] if len(cuts) else batch.num_rows
            held.append(rows.slice(0, end))
        if not len(cuts):
            continue
        if held:
            yield from close(False)
        # runs of one row that lie inside the batch leave together
        sizes = np.diff(np.append(cuts, batch.num_rows))
        alone = cuts[:-1][sizes[:-1] == 1]
        if number == 0 and len(alone) and alone[0] == cuts[0]:
            alone = alone[1:]
        if len(alone):
            b = rows.take(pa.array(alone))
            n = len(alone)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), b.column(0), pa.array(np.ones(n, np.int64)),
                pa.array(np.ones(n, bool)), pa.array(np.full(n, part, np.int64)), pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.string())], names=names)
        skip = set(alone.tolist())
        for k, at in enumerate(cuts):
            if at in skip:
                number += 1
                continue
            held, text = [rows.slice(at, sizes[k])], texts[at].as_py()
            if k < len(cuts) - 1:
                yield from close(False)
    if held:
        yield from close(True)


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (item, digest, text) of one partition -> the first row of
    every run (item, digest, part, first, last), the partition's first and last
    run marked. Holds a batch, one text and one row."""
    part = TaskContext.get().partitionId()
    text, begun, waiting = None, False, None

    def marked(rows: pa.RecordBatch, first: bool, last: bool) -> pa.RecordBatch:
        n = rows.num_rows
        firsts, lasts = np.zeros(n, bool), np.zeros(n, bool)
        firsts[0], lasts[-1] = first, last
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(np.full(n, part, np.int64)), pa.array(firsts),
                                           pa.array(lasts)], names=["item", "digest", "part", "first", "last"])

    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(2)
        new = np.ones(batch.num_rows, bool)
        new[1:] = ~pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
        new[0] = not begun or texts[0].as_py() != text
        text = texts[len(texts) - 1].as_py()
        heads = batch.select([0, 1]).take(pa.array(np.flatnonzero(new)))
        if not heads.num_rows:
            continue
        if waiting is not None:                    # a later run has begun: this one was not the last
            yield marked(waiting[0], waiting[1], False)
        if heads.num_rows > 1:
            yield marked(heads.slice(0, heads.num_rows - 1), not begun, False)
        waiting = (heads.slice(heads.num_rows - 1), not begun and heads.num_rows == 1)
        begun = True
    if waiting is not None:
        yield marked(waiting[0], waiting[1], True)


def _continued(ends: DataFrame) -> DataFrame:
    """(part) of the partitions whose first run goes on from the partition
    before. ``ends``: part, first, last, digest, text of the first and last
    runs. Neighbours are found by their digests alone, two short rows a
    partition; the texts of those that agree meet in a join and decide."""
    place = F.when(F.col("first"), 0).otherwise(1)
    in_order = Window.orderBy("part", place)       # of bounded rows, two a partition
    short = ends.select("part", "first", "last", "digest").select(
        "part", "first", "digest", F.lag("digest").over(in_order).alias("before"), F.lag("part").over(in_order).alias("from"))
    alike = materialise(short.filter(F.col("first") & (F.col("digest") == F.col("before")) & (F.col("part") != F.col("from")))
                        .select(F.col("part").alias("p"), "from"), "exact-ends")
    right = alike.join(ends.filter("first").select("part", F.col("text").alias("here")), F.col("p") == F.col("part")).select("p", "from", "here")
    left = ends.filter("last").select(F.col("part").alias("q"), F.col("text").alias("there"))
    return materialise(right.join(left, F.col("from") == F.col("q")).filter("here = there").select("p"), "exact-continued")


def _sorted(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Rows (id, digest, norm and more) in content order, dealt by sampled splitters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.sha2(norm.cast("binary"), 256).alias("digest"),
                        F.substring(norm, 1, KEY_CHARS).alias("head"), (-F.length(text)).alias("size"), *more)
    order = [F.col("head"), F.col("digest"), F.col("size"), F.col("id").asc_nulls_last()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def exact_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of each group of equal normalised texts that stays, with all its columns."""
    dealt = _sorted(docs, id_col, text_col, F.struct(*[F.col(c) for c in docs.columns]).alias("item"))
    own = F.col(f"item.`{text_col}`")
    schema = T.StructType([dealt.schema["item"], T.StructField("digest", T.StringType()), T.StructField("part", T.LongType()),
                           T.StructField("first", T.BooleanType()), T.StructField("last", T.BooleanType())])
    heads = materialise(map_in_arrow(dealt.select("item", "digest", normalised(own).alias("text")), _first_of_runs, schema),
                        "exact-heads")
    ends = heads.filter("first or last").select("part", "first", "last", "digest", normalised(own).alias("text"))
    gone = _continued(ends)
    return heads.join(gone, F.col("first") & (F.col("part") == F.col("p")), "left_anti").select("item.*")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id (under the id column's name), keep_id,
    group_size, kept, text_sha256."""
    dealt = _sorted(docs, id_col, text_col, normalised(F.col(text_col)).alias("norm"))
    schema = T.StructType([dealt.schema["id"], T.StructField("digest", T.StringType()),
                           T.StructField("keep_id", dealt.schema["id"].dataType),
                           T.StructField("group_size", T.LongType()), T.StructField("first", T.BooleanType()),
                           T.StructField("part", T.LongType()), T.StructField("edge", T.LongType()),
                           T.StructField("edge_text", T.StringType())])
    runs = materialise(map_in_arrow(dealt.select("id", "digest", F.col("norm").alias("text")), _runs, schema), "exact-runs")
    # at most two runs of each partition: few rows whatever the size of the data
    edges = runs.filter("edge is not null and first").select("part", "edge", "digest", "edge_text", "keep_id", "group_size")
    last = F.max("edge").over(Window.partitionBy("part"))
    ends = edges.select("part", (F.col("edge") == 0).alias("first"), (F.col("edge") == last).alias("last"), "digest",
                        F.col("edge_text").alias("text"))
    by_place = Window.orderBy("part", "edge")
    short = edges.drop("edge_text", "digest").join(_continued(ends), (F.col("edge") == 0) & (F.col("part") == F.col("p")), "left")
    chains = short.withColumn("begins", F.when(F.col("p").isNotNull(), 0).otherwise(1)).drop("p").withColumn(
        "chain", F.sum("begins").over(by_place))
    in_chain = Window.partitionBy("chain").orderBy("part", "edge")
    whole = in_chain.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = materialise(chains.select(
        F.col("part").alias("p"), F.col("edge").alias("e"), F.first("keep_id").over(whole).alias("chain_keep"),
        F.sum("group_size").over(whole).alias("chain_size"), (F.row_number().over(in_chain) == 1).alias("leads")),
        "exact-edges")
    out = runs.join(stitched, (F.col("part") == F.col("p")) & (F.col("edge") == F.col("e")), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("p").isNotNull(), F.col("chain_keep")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("chain_size", "group_size").alias("group_size"),
        (F.col("first") & F.coalesce("leads", F.lit(True))).alias("kept"), F.col("digest").alias("text_sha256"))
