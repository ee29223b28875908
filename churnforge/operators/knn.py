"""Exact k-nearest neighbours by bounded leaves.

1. Equal vectors collapse to one: of each group the first k + 1 members in
   md5 order can be anybody's neighbours (no point needs more of a group
   whose members are all equally far from it), so a vector held by a third
   of the rows is one vector with k + 1 members.
2. The vectors are sorted into an order in which neighbours are near: by the
   cell of a small k-d tree over a bounded sample, then by interleaved bits of
   the cell's widest dimensions. Every ``leaf_vectors`` vectors in that order
   are a leaf, whatever the number of vectors; every ``BLOCK_LEAVES`` leaves in
   a row are a block, every ``FAN`` blocks a node with a bounding box, and so on
   until few nodes are left. Only those few boxes reach the driver.
3. A leaf's vectors are compared with each other. The (k + 1)-th distance
   bounds how far a neighbour can be, and a vector descends only into nodes
   whose box is no farther. Visits to a node are grouped by where they come
   from (a run of leaves, so a group is bounded), and a group meets the node's
   row once. A vector travels to a block and not to each leaf in it: the leaves
   within its bound are found and compared there, one matrix operation a leaf.
4. The best k + 1 candidates of all visits are kept; each point drops itself.

The answer is exact: a box that is not visited holds nothing nearer. There is
no cap on candidates; sample, order and fan decide only how work is dealt. Ties
between equidistant neighbours are broken by md5('<seed>:' || id), then id. A
point with a null or NaN feature has no distance to anything: it is nobody's
neighbour and comes out with one row whose nn_rank, nn_id and dist2 are null.

With many dimensions the (k + 1)-th distance is comparable to the spread of
the data, and any exact search has to look at much of it: see lsh.py.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions.exprs import hash_hex, null_safe_join, number
from churnforge.operators.ranking import hash_rank
from churnforge.session import cut_lineage, map_in_arrow, ship_package

LEAF_VECTORS = 32
TREE_SAMPLE = 16_384
#: Leaves of a block, children of a node, boxes the driver sees at most, leaves whose visits travel together.
BLOCK_LEAVES, FAN, TOP_NODES, RUN_LEAVES = 16, 64, 1024, 128
_PART = 1 << 32                            # a leaf's number is partition * _PART + place in it
_CODE_DIMS, _CODE_BITS = 8, 6
_FOUND = "vid bigint, dist2 double, nh string, nid bigint"


@dataclass
class Tree:
    """Inner nodes split at (dimension, value); a leaf has dimension -1."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def build(sample: np.ndarray, leaf_size: int) -> Tree:
        rows: list[list] = []
        leaves = 0
        todo = [(np.arange(len(sample)), -1, 0)]
        while todo:
            members, parent, side = todo.pop()
            me = len(rows)
            if parent >= 0:
                rows[parent][2 + side] = me
            points = sample[members]
            spread = points.max(axis=0) - points.min(axis=0) if len(members) else np.zeros(sample.shape[1])
            d = int(spread.argmax())
            if len(members) <= leaf_size or spread[d] <= 0:
                rows.append([-1, 0.0, -1, -1, leaves])
                leaves += 1
                continue
            values = np.sort(points[:, d])
            cut = values[len(values) // 2]
            if cut == values[0]:               # at least one value goes to each side
                cut = values[values > values[0]][0]
            rows.append([d, float(cut), -1, -1, -1])
            low = points[:, d] < cut
            todo += [(members[low], me, 0), (members[~low], me, 1)]
        cols = list(zip(*rows))
        return Tree(*(np.array(cols[i], float if i == 1 else np.int64) for i in range(5)))

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if self.dim[node] < 0:
                out[at] = self.leaf[node]
                continue
            low = x[at, self.dim[node]] < self.cut[node]
            todo += [(self.left[node], at[low]), (self.right[node], at[~low])]
        return out


def _sq(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of y, summed column by
    column in order (as the SQL does)."""
    total = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        d = x[:, j, None] - y[None, :, j]
        total += d * d
    return total


def _gap2(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to boxes."""
    total = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j, None], x[:, j, None] - high[None, :, j]), 0)
        total += gap * gap
    return total


def _within(x: np.ndarray, bound2: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, box) pairs whose box is within the row's bound."""
    rows, boxes = [], []
    step = max(1, (1 << 21) // max(1, len(low)))
    for a in range(0, len(x), step):
        # the sums here may round differently from the distances: leave a little room
        r, b = np.nonzero(_gap2(x[a:a + step], low, high) <= bound2[a:a + step, None] * (1 + 1e-9))
        rows.append(r + a)
        boxes.append(b)
    return (np.concatenate(rows), np.concatenate(boxes)) if rows else (np.zeros(0, np.int64),) * 2


class _Order:
    """Cells of the sample's tree, and a place inside the cell: interleaved bits
    of its widest dimensions."""

    def __init__(self, sample: np.ndarray, leaf_vectors: int):
        self.tree = Tree.build(sample, leaf_vectors)
        n = int(self.tree.leaf.max()) + 1
        cell = self.tree.leaves_of(sample)
        self.low, self.span = np.zeros((n, sample.shape[1])), np.ones((n, sample.shape[1]))
        for c in range(n if len(sample) else 0):
            members = sample[cell == c]
            self.low[c], self.span[c] = members.min(axis=0), np.ptp(members, axis=0)
        self.dims = np.argsort(-self.span, axis=1, kind="stable")[:, :_CODE_DIMS]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = self.tree.leaves_of(x)
        dims = self.dims[cell]
        low, span = np.take_along_axis(self.low[cell], dims, 1), np.take_along_axis(self.span[cell], dims, 1)
        part = np.clip((np.take_along_axis(x, dims, 1) - low) / np.where(span > 0, span, 1), 0, 1)
        steps = np.minimum((part * (1 << _CODE_BITS)).astype(np.int64), (1 << _CODE_BITS) - 1)
        code = np.zeros(len(x), np.int64)
        for bit in range(_CODE_BITS - 1, -1, -1):
            for j in range(steps.shape[1]):
                code = (code << 1) | ((steps[:, j] >> bit) & 1)
        return cell, code


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _rows(m: np.ndarray) -> pa.Array:
    offsets = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def _make_leaves(dims: int, leaf_vectors: int):
    """Sorted (vid, x, members) -> one row a leaf (leaf, low, high, vids, flat,
    sizes, nh, nid); holds at most a batch and a leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() * _PART, None

        def leaf_rows(table: pa.Table, sizes: list[int]) -> pa.RecordBatch:
            nonlocal number
            batch = table.combine_chunks().to_batches()[0]
            x, vids, members = _matrix(batch.column(1), dims), batch.column(0), batch.column(2)
            count = members.value_lengths().to_numpy()
            flat = members.flatten()
            ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
            member_ends = np.append(0, np.cumsum(count))[ends].astype(np.int32)
            numbers = number + np.arange(len(sizes))
            number += len(sizes)
            lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends), values)
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers), _rows(np.minimum.reduceat(x, ends[:-1])), _rows(np.maximum.reduceat(x, ends[:-1])),
                 lists(ends, vids), lists(ends * dims, pa.array(x.ravel())), lists(ends, pa.array(count.astype(np.int32))),
                 lists(member_ends, flat.field(0)), lists(member_ends, flat.field(1))],
                names=["leaf", "low", "high", "vids", "flat", "sizes", "nh", "nid"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            whole = table.num_rows // leaf_vectors
            if whole:
                yield leaf_rows(table.slice(0, whole * leaf_vectors), [leaf_vectors] * whole)
            held = table.slice(whole * leaf_vectors)
        if held is not None and held.num_rows:
            yield leaf_rows(held, [held.num_rows])

    return run


def _best(row: np.ndarray, d2: np.ndarray, nh: np.ndarray, nid: np.ndarray, want: int) -> np.ndarray:
    """Places of every row's ``want`` nearest members, by (distance, hash, id)."""
    order = np.lexsort((nid, nh, d2, row))
    heads = np.flatnonzero(np.diff(row[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[place < want]


def _members(d2: np.ndarray, bound2: np.ndarray, leaf: dict, want: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, distance, hash, id) of the nearest members within every row's bound."""
    row, v = np.nonzero(d2 <= np.minimum(bound2, _kth(d2, want))[:, None])
    count = leaf["sizes"][v]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    member = np.repeat((np.cumsum(leaf["sizes"]) - leaf["sizes"])[v], count) + nth
    row, dist, nh, nid = np.repeat(row, count), np.repeat(d2[row, v], count), leaf["nh"][member], leaf["nid"][member]
    keep = _best(row, dist, nh, nid, want)
    return row[keep], dist[keep], nh[keep], nid[keep]


def _kth(d2: np.ndarray, k: int) -> np.ndarray:
    if d2.shape[1] <= k:
        return np.full(len(d2), np.inf)
    return np.partition(d2, k - 1, axis=1)[:, k - 1]


def _leaf(batch: pa.RecordBatch, at: int, dims: int) -> dict:
    get = lambda name: batch.column(name)[at].values
    return {"x": get("flat").to_numpy(zero_copy_only=False).reshape(-1, dims), "vids": get("vids").to_numpy(),
            "sizes": get("sizes").to_numpy(), "nid": get("nid").to_numpy(), "nh": np.array(get("nh").to_pylist(), "S32")}


def _found(vid: np.ndarray, d2: np.ndarray, nh: np.ndarray, nid: np.ndarray) -> list[pa.Array]:
    return [pa.array(vid), pa.array(d2), pa.array(nh.astype(str)), pa.array(nid)]


def _inside(dims: int, want: int):
    """Leaves -> every vector's nearest members in its own leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                leaf = _leaf(batch, at, dims)
                row, d2, nh, nid = _members(_sq(leaf["x"], leaf["x"]), np.full(len(leaf["x"]), np.inf), leaf, want)
                yield pa.RecordBatch.from_arrays(_found(leaf["vids"][row], d2, nh, nid), names=["vid", "dist2", "nh", "nid"])

    return run


def _visits(dims: int, boxes):
    """(vid, x, bound, own) -> the same with a node, for each of the few top
    nodes within the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, low, high = boxes.value
        for batch in batches:
            row, box = _within(_matrix(batch.column(1), dims), batch.column(2).to_numpy(), low, high)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in batch.columns] + [pa.array(node[box])],
                                             names=["vid", "x", "bound", "own", "node"])

    return run


def _descend(dims: int):
    """(visits, kids) of a node -> a row for each visit and kid within its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                visits = pa.RecordBatch.from_struct_array(batch.column("visits")[at].values)
                kids = pa.RecordBatch.from_struct_array(batch.column("kids")[at].values)
                row, kid = _within(_matrix(visits.column(1), dims), visits.column(2).to_numpy(),
                                   _matrix(kids.column(1), dims), _matrix(kids.column(2), dims))
                yield pa.RecordBatch.from_arrays([c.take(pa.array(row)) for c in visits.columns] +
                                                 [kids.column(0).take(pa.array(kid))], names=["vid", "x", "bound", "own", "node"])

    return run


def _compare(dims: int, want: int):
    """(visits, leaves) of a block -> every visiting vector's nearest members of
    the leaves within its bound, its own leaf aside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                visits = pa.RecordBatch.from_struct_array(batch.column("visits")[at].values)
                leaves = pa.RecordBatch.from_struct_array(batch.column("leaves")[at].values)
                x, bound2 = _matrix(visits.column(1), dims), visits.column(2).to_numpy()
                row, place = _within(x, bound2, _matrix(leaves.column("low"), dims), _matrix(leaves.column("high"), dims))
                away = visits.column(3).to_numpy()[row] != leaves.column("leaf").to_numpy()[place]
                row, place, found = row[away], place[away], []
                for n in np.unique(place):
                    who, leaf = row[place == n], _leaf(leaves, int(n), dims)
                    r, *member = _members(_sq(x[who], leaf["x"]), bound2[who], leaf, want)
                    found.append((who[r], *member))
                if found:
                    row, d2, nh, nid = (np.concatenate(c) for c in zip(*found))
                    keep = _best(row, d2, nh, nid, want)
                    yield pa.RecordBatch.from_arrays(_found(visits.column(0).to_numpy()[row[keep]], d2[keep], nh[keep], nid[keep]),
                                                     names=["vid", "dist2", "nh", "nid"])

    return run


def first_rows(key: str, want: int):
    """Sorted rows -> the first ``want`` of every key; holds one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            heads = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            place = np.arange(len(keys)) - np.repeat(heads, np.diff(np.append(heads, len(keys))))
            if keys[0] == last:
                end = heads[1] if len(heads) > 1 else len(keys)
                place[:end] += seen
            last, seen = keys[-1], int(place[-1]) + 1
            yield batch.filter(pa.array(place < want))

    return run


def _elementwise(lists: str, pick) -> F.Column:
    return F.aggregate(F.slice(lists, 2, F.greatest(F.size(lists) - 1, F.lit(0))), F.get(lists, F.lit(0)),
                       lambda a, b: F.zip_with(a, b, lambda x, y: pick(x, y)))


def make_blocks(leaves: DataFrame, block_leaves: int = BLOCK_LEAVES) -> DataFrame:
    """(block, low, high, leaves): neighbouring leaves of a partition."""
    block = F.floor(F.col("leaf") / _PART) * _PART + F.floor(F.col("leaf") % _PART / block_leaves)
    rows = leaves.groupBy(block.cast("bigint").alias("block")).agg(F.collect_list(F.struct(*leaves.columns)).alias("leaves"))
    return rows.select("block", _elementwise("leaves.low", F.least).alias("low"), _elementwise("leaves.high", F.greatest).alias("high"), "leaves")


def box_levels(leaves: DataFrame, fan: int = FAN, top_nodes: int = TOP_NODES) -> tuple[list, list[DataFrame]]:
    """(top rows of (node, low, high), levels from the top down): a level's row
    is a node and its kids (node, low, high), at most ``fan`` of them."""
    level, levels = leaves.select(F.col("leaf").alias("node"), "low", "high"), []
    while (found := level.agg(F.count(F.lit(1)).alias("n"), F.max(F.col("node") % _PART).alias("place")).first())["n"] > top_nodes:
        part, place = F.floor(F.col("node") / _PART), F.col("node") % _PART
        parent = part * _PART + F.floor(place / fan) if found["place"] else F.floor(part / fan) * _PART
        kids = level.groupBy(parent.cast("bigint").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("node", "low", "high"))).alias("kids"))
        kids = cut_lineage(kids.select(F.col("parent").alias("node"), "kids"))
        levels.insert(0, kids)
        level = kids.select("node", _elementwise("kids.low", F.least).alias("low"), _elementwise("kids.high", F.greatest).alias("high"))
    return level.collect(), levels


def exact_knn(points: DataFrame, id_col: str, cols: Sequence[str], k: int = 5, seed: int = 42,
              leaf_vectors: int = LEAF_VECTORS, tree_sample: int = TREE_SAMPLE, fan: int = FAN,
              top_nodes: int = TOP_NODES, run_leaves: int = RUN_LEAVES, queries: DataFrame | None = None) -> DataFrame:
    """(id, nn_rank 1..k, nn_id, dist2) for every point, or for those whose id is
    in the first column of ``queries``, among all points.

    tree_sample bounds the vectors the driver sees to place the cells, top_nodes
    the boxes; like fan and run_leaves they decide only how the work is dealt,
    never the result.
    """
    cols = list(cols)
    dims, want = len(cols), k + 1              # a member may find itself among them
    spark = points.sparkSession
    ship_package(spark)
    given = points.select(F.col(id_col).cast("long").alias("pid"), *[number(c).alias(c) for c in cols])
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    pts = cut_lineage(given.where(whole))
    if queries is None:
        asked = lambda rows: rows
    else:
        ids = cut_lineage(queries.select(F.col(queries.columns[0]).cast("long").alias("_asked")).distinct())
        asked = lambda rows: rows.join(ids, F.col("pid") == F.col("_asked"), "left_semi")
    broken = asked(given.where(~whole)).select(
        F.col("pid").alias("id"), F.lit(None).cast("int").alias("nn_rank"), F.lit(None).cast("long").alias("nn_id"),
        F.lit(None).cast("double").alias("dist2"))

    # -- 1. one row per distinct vector, with its first k + 1 members -------------
    firsts = hash_rank(pts, cols, "pid", seed, rank_col="_r").where(F.col("_r") <= k)
    vectors = (firsts.withColumn("nh", hash_hex("pid", seed)).groupBy(*cols)
               .agg(F.sort_array(F.collect_list(F.struct("nh", F.col("pid").alias("nid")))).alias("members")))
    vectors = cut_lineage(vectors.select(F.col("members")[0]["nid"].alias("vid"), "members", F.array(*cols).alias("x"), *cols))
    n = vectors.count()
    if n == 0:
        return broken

    # -- 2. order, leaves, nodes ----------------------------------------------------
    leaves = cut_lineage(make_leaves(vectors, n, dims, leaf_vectors, tree_sample))
    blocks = cut_lineage(make_blocks(leaves))
    top, levels = box_levels(blocks.select(F.col("block").alias("leaf"), "low", "high"), fan, top_nodes)
    boxes = spark.sparkContext.broadcast((np.array([r["node"] for r in top]), np.array([r["low"] for r in top], float),
                                          np.array([r["high"] for r in top], float)))

    # -- 3. own leaf, then the blocks within the bound ----------------------------
    own = cut_lineage(map_in_arrow(leaves, _inside(dims, want), _FOUND))
    if queries is not None:
        seeking = null_safe_join(vectors.select("vid", *cols), asked(pts).select(*cols).distinct(), cols).select(F.col("vid").alias("_v"))
        own = cut_lineage(own.join(seeking, F.col("vid") == F.col("_v"), "left_semi"))
    bounds = own.groupBy("vid").agg(F.when(F.count(F.lit(1)) >= want, F.max("dist2")).otherwise(F.lit(float("inf"))).alias("bound"))
    placed = leaves.select(F.col("leaf").alias("own"), F.posexplode("vids").alias("_i", "v"), "flat").select(
        "own", "v", F.slice("flat", F.col("_i") * dims + 1, F.lit(dims)).alias("x"))
    seekers = placed.join(bounds, F.col("v") == F.col("vid")).select("vid", "x", "bound", "own")
    schema = "vid bigint, x array<double>, bound double, own bigint, node bigint"
    visits = map_in_arrow(seekers, _visits(dims, boxes), schema)
    for level in levels:
        visits = map_in_arrow(_gathered(visits, run_leaves).join(level.withColumnRenamed("node", "met"), F.col("node") == F.col("met"))
                              .select("visits", "kids"), _descend(dims), schema)
    away = map_in_arrow(_gathered(visits, run_leaves).join(blocks, F.col("node") == F.col("block")).select("visits", "leaves"),
                        _compare(dims, want), _FOUND)

    # -- 4. best of all visits; each point drops itself ---------------------------
    ranked = own.unionByName(away).repartition("vid").sortWithinPartitions("vid", "dist2", "nh", "nid")
    best = map_in_arrow(ranked, first_rows("vid", want), _FOUND).groupBy("vid").agg(
        F.sort_array(F.collect_list(F.struct("dist2", "nh", "nid"))).alias("top"))
    answers = cut_lineage(best.join(vectors.select(F.col("vid").alias("v"), *cols), F.col("vid") == F.col("v"))
                          .select("top", *cols))
    mine = null_safe_join(asked(pts), answers, cols)
    others = F.slice(F.filter("top", lambda t: t["nid"] != F.col("pid")), 1, k)
    found = mine.select("pid", F.posexplode(others).alias("_r", "t"))
    return found.select(F.col("pid").alias("id"), (F.col("_r") + 1).alias("nn_rank"), F.col("t.nid").alias("nn_id"),
                        F.col("t.dist2").alias("dist2")).unionByName(broken)


def make_leaves(vectors: DataFrame, n: int, dims: int, leaf_vectors: int, tree_sample: int) -> DataFrame:
    """(vid, x, members) -> leaves of at most ``leaf_vectors`` vectors each."""
    spark = vectors.sparkSession
    share = min(1.0, tree_sample / n)
    picked = vectors.where(F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = np.array([r["x"] for r in picked.select("x").orderBy("vid").limit(tree_sample).collect()], float).reshape(-1, dims)
    order = spark.sparkContext.broadcast(_Order(sample, leaf_vectors))

    @F.pandas_udf("struct<cell:bigint,code:bigint>")
    def place_of(x: pd.Series) -> pd.DataFrame:
        cell, code = order.value.place(np.array(x.tolist(), float).reshape(-1, dims))
        return pd.DataFrame({"cell": cell, "code": code})

    # the order's columns are written, so that sampling the range bounds runs no Python
    placed = cut_lineage(vectors.select("vid", "x", "members", place_of("x").alias("at")).select("vid", "x", "members", "at.*"))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (8 * leaf_vectors))))
    dealt = placed.repartitionByRange(parts, "cell", "code", "vid").sortWithinPartitions("cell", "code", "vid")
    return map_in_arrow(dealt.select("vid", "x", "members"), _make_leaves(dims, leaf_vectors),
                        "leaf bigint, low array<double>, high array<double>, vids array<bigint>, flat array<double>, "
                        "sizes array<int>, nh array<string>, nid array<bigint>")


def _gathered(visits: DataFrame, run_leaves: int) -> DataFrame:
    """(node, visits) of at most a run's vectors each: a vector visits a node
    once, and a run of leaves holds a bounded number of vectors. The visits are
    dealt by node alone, as the join with the nodes wants them, and travel once."""
    run = F.floor(F.col("own") / F.lit(run_leaves))
    return visits.repartition("node").groupBy("node", run.alias("run")).agg(F.collect_list(F.struct("vid", "x", "bound", "own")).alias("visits"))
