"""Approximate k-nearest neighbours by random projections (J2, many dimensions).

Every vector gets the cells of ``tables`` hash tables; a table's cell is made of
``width`` bucketed random projections (``BucketedRandomProjectionLSH``). A query
meets the vectors that share a cell with it in any table; distances of these
candidates are exact and the k nearest stay.

The bucket length is chosen on a bounded, documented sample: the smallest of a
row of lengths at which the sample's own nearest neighbours (found by brute
force) meet often enough. On the whole table neighbours are nearer than in the
sample, so they meet more often than that. Every vector is indexed.

A crowded cell is no group in one task: cells are dealt by (table, cell, part)
with as many parts as the cell has blocks of ``cell_rows`` vectors, and the
few queries of a cell go to each of its parts. Candidates are not capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.operators.knn import first_rows
from churnforge.session import cut_lineage, map_in_arrow

SAMPLE_ROWS, SAMPLE_QUERIES = 4000, 200
_ROWS = "qid bigint, dist2 double, nid bigint"


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def _projections(seed: int, dims: int, count: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((dims, count))
    return m / np.linalg.norm(m, axis=0)


def choose_cells(sample: np.ndarray, k: int, tables: int, width: int, recall: float, queries: int = SAMPLE_QUERIES,
                 seed: int = 42) -> tuple[float, float]:
    """(bucket length, shift): the smallest length at which ``recall`` of the
    true k nearest neighbours of some sample rows share a cell with them. A
    component of the constant ``shift`` moves every projection's cuts to places
    that do not depend on where the data's middle lies."""
    spread = 2 * float(np.linalg.norm(sample - sample.mean(axis=0), axis=1).max()) or 1.0
    shift = 64 * spread
    if len(sample) <= k + 1:
        return 2 * spread, shift
    q = sample[:queries]
    d2 = _squared(q, sample)
    d2[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argpartition(d2, k - 1, axis=1)[:, :k]
    projected = np.hstack([sample, np.full((len(sample), 1), shift)]) @ _projections(seed, sample.shape[1] + 1, tables * width)
    for length in spread * np.geomspace(0.02, 2, 60):
        cell = np.floor(projected / length).reshape(len(sample), tables, width)
        meet = (cell[:len(q), None] == cell[near]).all(axis=3).any(axis=2)
        if meet.mean() >= recall:
            return float(length), shift
    return 2 * spread, shift


def _nearest(dims: int, k: int):
    """(queries, vectors) of a cell's part -> each query's k nearest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for at in range(batch.num_rows):
                q = pa.RecordBatch.from_struct_array(batch.column("queries")[at].values)
                v = pa.RecordBatch.from_struct_array(batch.column("vectors")[at].values)
                qid, vid = q.column(0).to_numpy(), v.column(0).to_numpy()
                x, y = (b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) for b in (q, v))
                d2 = np.zeros((len(x), len(y)))
                for j in range(dims):
                    d = x[:, j, None] - y[None, :, j]
                    d2 += d * d
                d2[qid[:, None] == vid[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(vid, d2.shape), d2), axis=1)[:, :k]
                row = np.repeat(np.arange(len(x)), order.shape[1])
                place = order.ravel()
                ok = np.isfinite(d2[row, place])
                out.append((qid[row[ok]], d2[row[ok], place[ok]], vid[place[ok]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["qid", "dist2", "nid"])

    return run


def _whole_points(points: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(vid, x) of the points that take part, their number and their dimensions."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c))
    good = points.where(F.col(vector_col).isNotNull() & ~bad).select(F.col(id_col).cast("long").alias("vid"), x.alias("x"))
    dims = good.agg(F.max(F.size("x"))).first()[0] or 0
    pts = cut_lineage(good.where(F.size("x") == dims))   # written: no later step may see the others
    return pts, pts.count() if dims else 0, dims


def lsh_knn(points: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 5, tables: int = 8, width: int = 2,
            recall: float = 0.97, seed: int = 42, sample_rows: int = SAMPLE_ROWS, cell_rows: int = 2048, query_rows: int = 512
            ) -> DataFrame:
    """(id, nn_rank 1..k, nn_id, dist2) for the ids in ``queries`` (one column,
    the ids), against all points. Points whose vector is null, holds a null or NaN
    or is shorter than the longest take no part. Ids are taken to be unique."""
    pts, n, dims = _whole_points(points, id_col, vector_col)
    spark = points.sparkSession
    if not n:
        return spark.createDataFrame([], "id bigint, nn_rank int, nn_id bigint, dist2 double")
    share = min(1.0, sample_rows / n)
    picked = pts.where(F.pmod(F.xxhash64("vid", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = np.array([r["x"] for r in picked.select("x").limit(sample_rows).collect()], float)
    length, shift = choose_cells(sample, k, tables, width, recall, seed=seed)

    # one random projection is a hash table of the library's model; ``width`` of them are a cell
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", numHashTables=tables * width,
                                        bucketLength=length, seed=seed)
    shifted = pts.select("vid", "x", array_to_vector(F.concat("x", F.array(F.lit(shift)))).alias("v"))
    hashed = model.fit(shifted.limit(1)).transform(shifted)
    numbers = F.flatten(F.array(*[vector_to_array(F.col("h")[i]) for i in range(tables * width)]))
    cells = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(F.slice(numbers, t * width + 1, width)).alias("cell"))
                      for t in range(tables)])
    hashed = hashed.select("vid", "x", cells.alias("cells"))
    rows = cut_lineage(hashed.select("vid", "x", F.explode("cells").alias("c")).select("vid", "x", "c.*"))
    asked = queries.select(F.col(queries.columns[0]).cast("long").alias("qid")).distinct()
    seekers = rows.join(asked, F.col("vid") == F.col("qid")).drop("vid")

    # a crowded cell is cut into parts of bounded size, and so are its queries; they meet part by part
    size = rows.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("table").alias("t"), F.col("cell").alias("c"), F.ceil(F.col("n") / cell_rows).cast("int").alias("parts"))
    here = (F.col("table") == F.col("t")) & (F.col("cell") == F.col("c"))
    vectors = rows.join(size, here).groupBy(
        "table", "cell", F.pmod(F.xxhash64("vid"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("vid", "x")).alias("vectors"))
    many = seekers.groupBy("table", "cell").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("table").alias("t"), F.col("cell").alias("c"), F.ceil(F.col("n") / query_rows).cast("int").alias("parts"))
    asking = seekers.join(many, here).groupBy(
        "table", "cell", F.pmod(F.xxhash64("qid"), F.col("parts")).alias("block")).agg(F.collect_list(F.struct("qid", "x")).alias("queries"))
    asking = asking.select(F.col("table").alias("t"), F.col("cell").alias("c"), "queries")
    near = map_in_arrow(asking.join(vectors, here).select("queries", "vectors"), _nearest(dims, k), _ROWS)
    ranked = near.distinct().repartition("qid").sortWithinPartitions("qid", "dist2", "nid")
    best = map_in_arrow(ranked, first_rows("qid", k), _ROWS).groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("dist2", "nid"))).alias("top"))
    return best.select(F.col("qid").alias("id"), F.posexplode("top").alias("_r", "t")).select(
        "id", (F.col("_r") + 1).alias("nn_rank"), F.col("t.nid").alias("nn_id"), F.col("t.dist2").alias("dist2"))


def _all_rows(dims: int, k: int, block):
    """All vectors against one block of queries: its k nearest in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, x = block.value
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(qid)
        for batch in batches:
            vid = batch.column(0).to_numpy()
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for a in range(0, len(vid), 4096):
                d2 = np.zeros((len(x), len(y[a:a + 4096])))
                for j in range(dims):
                    d = x[:, j, None] - y[None, a:a + 4096, j]
                    d2 += d * d
                d2[qid[:, None] == vid[None, a:a + 4096]] = np.inf
                for i in range(len(qid)):
                    dist, ids = np.append(best[i][0], d2[i]), np.append(best[i][1], vid[a:a + 4096])
                    keep = np.lexsort((ids, dist))[:k]
                    best[i] = dist[keep], ids[keep]
        rows = [(q, d, v) for q, (dist, ids) in zip(qid, best) for d, v in zip(dist, ids) if np.isfinite(d)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["qid", "dist2", "nid"])

    return run


def brute_force_knn(points: DataFrame, id_col: str, vector_col: str, queries: DataFrame, k: int = 5, block: int = 1024) -> DataFrame:
    """The same by comparing a stated set of queries with all points, a bounded
    block of queries at a time: for measuring recall."""
    spark = points.sparkSession
    pts, _, _ = _whole_points(points, id_col, vector_col)
    asked = pts.join(queries.select(F.col(queries.columns[0]).alias("q")).distinct(), F.col("vid") == F.col("q")).select("vid", "x")
    blocks = max(1, -(-asked.count() // block))
    asked = cut_lineage(asked.withColumn("b", F.pmod(F.xxhash64("vid"), F.lit(blocks))))
    out = None
    for b in range(blocks):
        rows = asked.where(F.col("b") == b).orderBy("vid").collect()
        if not rows:
            continue
        held = spark.sparkContext.broadcast((np.array([r["vid"] for r in rows]), np.array([r["x"] for r in rows], float)))
        near = cut_lineage(map_in_arrow(pts, _all_rows(len(rows[0]["x"]), k, held), _ROWS))
        out = near if out is None else out.unionByName(near)
    if out is None:
        return spark.createDataFrame([], "id bigint, nn_rank int, nn_id bigint, dist2 double")
    best = map_in_arrow(out.repartition("qid").sortWithinPartitions("qid", "dist2", "nid"), first_rows("qid", k), _ROWS)
    tops = best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("dist2", "nid"))).alias("top"))
    return tops.select(F.col("qid").alias("id"), F.posexplode("top").alias("_r", "t")).select(
        "id", (F.col("_r") + 1).alias("nn_rank"), F.col("t.nid").alias("nn_id"), F.col("t.dist2").alias("dist2"))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(id, hits, wanted): how many of a query's exact neighbours were found."""
    f = found.select(F.col("id").alias("_id"), F.col("nn_id").alias("_nn"))
    met = exact.join(f, (F.col("id") == F.col("_id")) & (F.col("nn_id") == F.col("_nn")), "left")
    return met.groupBy("id").agg(F.count("_nn").alias("hits"), F.count(F.lit(1)).alias("wanted"))
