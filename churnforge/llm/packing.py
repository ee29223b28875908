"""Op 7: best-fit packing of token sequences by hierarchical residual packing.

Round 0: every partition packs its items best-fit decreasing (streamed in
order of falling length; state is one counter list per free space). After it a
partition has at most one bin that is filled to half or less. Bins with
``nearly_full`` or fewer tokens free are final; underfull bins become items of
the next round, where ``fan_in`` partitions meet in one, best-fit again, until
one task is left.

What climbs the tree is bounded by a constant, not by the data, and loses
nothing: two bins over half full never share a bin, so each merge uses one of
the at most ``fan_in`` smaller bins that meet in a node, and of the bins over
half full no node ever needs more than ``fan_in`` of one fill a round. The
others are final where they are.

Edge cases: items of length 0 (null counts as 0) take a place in any bin;
an item longer than the capacity is an error; equal items are placed in order
of the caller's tie columns; an empty table gives an empty one. Carried
columns travel inside one struct, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.byte_bpe import worker_bpe
from churnforge.llm.common import materialise, text_slices
from churnforge.session import map_in_arrow


class _BestFit:
    """Bins of one task by free space; a bit set finds the tightest one."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0

    def place(self, length: int, new_bin: int) -> tuple[int, int]:
        """(bin, offset) for an item; opens ``new_bin`` if none has room."""
        fitting = self.some >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            where = self.free[room].pop()
            if not self.free[room]:
                self.some &= ~(1 << room)
        else:
            room, where = self.capacity, new_bin
        left = room - length
        self.free[left].append(where)
        self.some |= 1 << left
        return where, self.capacity - room


def _open_bins(fit: _BestFit, nearly_full: int, keep: int) -> tuple[list[int], list[int]]:
    """Bins (and fills) that climb: all up to half full, at most ``keep`` of
    each fill over half."""
    bins, fills = [], []
    for room in range(nearly_full + 1, fit.capacity + 1):
        group = sorted(fit.free[room])
        group = group if 2 * room >= fit.capacity else group[:keep]
        bins += group
        fills += [fit.capacity - room] * len(group)
    return bins, fills


def _pack_items(capacity: int, nearly_full: int, keep: int):
    """(item, length) rows, longest first -> placements (item, bin, offset) and
    climbing bins (null item, bin, fill)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fit, opened = _BestFit(capacity), part << 40
        names = ["item", "bin", "offset", "fill"]
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            lengths = batch.column(1).to_pylist()
            bins, offsets = [], []
            for n in lengths:
                if n > capacity:
                    raise ValueError(f"an item of {n} tokens does not fit a sequence of {capacity}")
                if n == capacity:
                    where, at = opened, 0
                else:
                    where, at = fit.place(n, opened)
                opened += where == opened
                bins.append(where)
                offsets.append(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bins, pa.int64()), pa.array(offsets, pa.int64()),
                 pa.nulls(len(bins), pa.int64())], names=names)
        bins, fills = _open_bins(fit, nearly_full, keep)
        if bins:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(bins), kind), pa.array(bins, pa.int64()), pa.nulls(len(bins), pa.int64()),
                 pa.array(fills, pa.int64())], names=names)

    return run


def _pack_bins(capacity: int, nearly_full: int, keep: int):
    """(bin, fill) rows, fullest first -> moves (bin, into, offset) and climbing
    bins (bin, null, null, fill)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, moved = _BestFit(capacity), []
        for batch in batches:
            for b, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                where, at = fit.place(n, b)
                if where != b:
                    moved.append((b, where, at))
        bins, fills = _open_bins(fit, nearly_full, keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in moved] + bins, pa.int64()),
             pa.array([m[1] for m in moved] + [None] * len(bins), pa.int64()),
             pa.array([m[2] for m in moved] + [None] * len(bins), pa.int64()),
             pa.array([None] * len(moved) + fills, pa.int64())], names=["bin", "into", "offset", "fill"])

    return run


def pack_best_fit(items: DataFrame, length_col: str, capacity: int, tie_cols: list[str], fan_in: int = 8,
                  nearly_full: int | None = None, leaf_items: int = 20_000) -> DataFrame:
    """items with sequence_id and offset: which sequence an item lies in, and
    where. Returns (item struct of all columns of items, sequence_id, offset).

    Round 0 has one partition for every ``leaf_items`` items, up to the
    session's shuffle partitions: best fit needs company to pack well.
    ``nearly_full`` is a 128th of the capacity by default.
    """
    spark = items.sparkSession
    nearly_full = capacity // 128 if nearly_full is None else nearly_full
    items = materialise(items, "packing-given")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // leaf_items)))
    rounds, nodes = 0, parts
    while nodes > 1:
        rounds, nodes = rounds + 1, -(-nodes // fan_in)
    keep = fan_in * max(rounds, 1)
    item = F.struct(*[F.col(c) for c in items.columns])
    given = items.select(item.alias("item"), F.coalesce(F.col(length_col), F.lit(0)).cast("long").alias("length"))
    dealt = given.repartition(parts).sortWithinPartitions(
        F.desc("length"), *[F.col(f"item.`{c}`") for c in tie_cols])
    schema = T.StructType([T.StructField("item", given.schema["item"].dataType), T.StructField("bin", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField("fill", T.LongType())])
    placed = materialise(map_in_arrow(dealt, _pack_items(capacity, nearly_full, keep), schema), "packing-items")
    up = placed.filter("fill is not null").select("bin", "fill", F.shiftright("bin", 40).alias("node"))
    moves: dict[int, tuple[int, int]] = {}
    for _ in range(rounds):
        up = up.withColumn("node", F.floor(F.col("node") / fan_in))
        nodes = -(-parts // fan_in)
        met = up.repartition(nodes, "node").sortWithinPartitions(F.desc("fill"), "bin") if nodes > 1 else (
            up.coalesce(1).sortWithinPartitions(F.desc("fill"), "bin"))
        tree = materialise(map_in_arrow(met.select("bin", "fill"), _pack_bins(capacity, nearly_full, keep),
                                        "bin bigint, into bigint, offset bigint, fill bigint"), "packing-bins")
        # at most fan_in moves a node, so fewer than two a partition in the whole tree
        moves |= {r["bin"]: (r["into"], r["offset"]) for r in tree.filter("into is not null").collect()}
        at_node = up.select(F.col("bin").alias("b"), "node")
        up = tree.filter("fill is not null").select("bin", "fill").join(
            at_node, F.col("bin") == F.col("b")).select("bin", "fill", "node")
        parts = nodes
    resolved = []
    for b in moves:
        into, at = moves[b]
        while into in moves:
            into, more = moves[into][0], moves[into][1]
            at += more
        resolved.append((b, into, at))
    moved = spark.createDataFrame(resolved, "b bigint, into bigint, shift bigint")
    out = placed.filter("fill is null").join(F.broadcast(moved), F.col("bin") == F.col("b"), "left")
    return out.select("item", F.coalesce("into", "bin").alias("sequence_id"),
                      (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): every text's ids and the end id, in
    pieces of ``capacity`` ids of which the first may be shorter. ``ids`` holds
    unsigned little-endian 32-bit integers. Null and empty texts have the end
    id alone. Map-only."""
    with open(tokenizer_path, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([docs.schema[id_col], T.StructField("piece", T.IntegerType(), False),
                           T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False),
                           T.StructField("ids", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(data.value)
        for batch, texts in text_slices(batches, 1, 2_000_000):
            coded = [bpe.ids(t) for t in texts]
            flat = np.concatenate([x for ids in coded for x in (ids, [end_id])]).astype("<u4")
            total = np.array([len(ids) + 1 for ids in coded], np.int64)
            first = (total - 1) % capacity + 1
            pieces = -(-total // capacity)
            doc = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            ends = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int32)
            ids = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start),
                 pa.array(length), ids], names=schema.names)

    return map_in_arrow(docs.select(id_col, text_col), run, schema)
