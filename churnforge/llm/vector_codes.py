"""Op 12: product codes of vectors by ball k-means.

A vector's components become integers, the vector is cut into equal parts, and
each part position has a codebook that rounds of exact k-means refine. A part
starts a round inside the ball of the entry it had. The ball's radius defines
its neighbour entries (those less than two radii away), a part nearer to its
entry than half the way to the next one is in the stable core and not looked
at, and the others fall into annular rings: a part at distance d meets only
the neighbours within 2d. Rings and ties are decided in whole numbers, so the
result is that of comparing every part with every entry, ties to the lower
index. The balls are those of the rows of an Arrow batch: a radius over fewer
parts is never larger.

Every round is one map over the rows, written with the codes, and one
pre-aggregated sum an entry; what reaches the driver is the codebook, which is
bounded by entries times components, and so is what goes out to the tasks.

Edge cases: rows whose vector is null or holds a null or non-finite component
are dropped; a vector of another length than the first kept one is kept with
null code and error and trains nothing; a first vector that cannot be cut into
equal parts is an error, as are components so large that a squared distance
does not fit a long. Null ids come last where entries are chosen, equal ids
are ordered by their vectors. Fewer rows than entries make a smaller codebook,
an empty table gives an empty one. Carried columns travel inside one struct,
so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.llm.common import discard, materialise_at
from churnforge.session import map_in_arrow

RING_GROUPS, PAIRS = 4, 1 << 22


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x (int64) to the rows of y."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:       # doubles hold every sum on the way exactly
        x, y = x.astype(np.float64), y.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)).astype(np.int64)


def _lowest(d2: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest distance, lowest of the entries that have it) of every row."""
    low = d2.min(axis=1)
    return low, np.where(d2 == low[:, None], entry, np.iinfo(np.int64).max).min(axis=1)


class Balls:
    """One part position's codebook: entries, and for each entry all entries by
    their squared distance from it."""

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        apart = squared_distances(centres, centres)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, axis=1)

    def all_pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of parts that have no ball yet."""
        step = max(1, PAIRS // len(self.centres))
        found = [_lowest(squared_distances(x[a:a + step], self.centres), np.arange(len(self.centres)))
                 for a in range(0, len(x), step)]
        return np.concatenate([f[1] for f in found]), np.concatenate([f[0] for f in found])

    def reassign(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The same for parts that lie in the balls ``own``; and how many exact
        distances to other entries it took."""
        gap = x - self.centres[own]
        entry, best, pairs = own.copy(), (gap * gap).sum(axis=1), 0
        order = np.argsort(own, kind="stable")
        for members in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            i = own[members[0]]
            radius2 = best[members].max()
            neighbours = int(np.searchsorted(self.apart[i], 4 * radius2, side="right"))
            if neighbours <= 1:
                continue                           # no entry is near enough to take a part of this ball
            ring = np.searchsorted(self.apart[i, :neighbours], 4 * best[members], side="right")
            moving = members[ring > 1]             # the others are the stable core
            ring = ring[ring > 1]
            by_ring = np.argsort(ring, kind="stable")
            for group in np.array_split(by_ring, min(RING_GROUPS, len(by_ring)) or 1):
                if not len(group):
                    continue
                rows, most = moving[group], int(ring[group].max())
                entries = self.near[i, :most]
                d2 = squared_distances(x[rows], self.centres[entries])
                d2[np.arange(most) >= ring[group][:, None]] = np.iinfo(np.int64).max
                best[rows], entry[rows] = _lowest(d2, entries)
                pairs += d2.size
        return entry, best, pairs


def integer_vectors(df: DataFrame, vector_col: str, scale: int, carry: Sequence[Column]) -> DataFrame:
    """The rows with a whole, finite vector: the carried columns and v, the
    floors of the scaled components."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return df.filter(x.isNotNull() & ~bad).select(
        *carry, F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def _assign(balls: list[Balls], dims: int):
    """(row, v, code, error) -> the same with new codes."""
    width, limit = dims // len(balls), isqrt((1 << 61) // dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, old = batch.column(1), batch.column(2)
            fits = pc.equal(pc.list_value_length(lists), dims)
            v = lists.filter(fits).flatten().to_numpy().astype(np.int64).reshape(-1, dims)
            if np.abs(v).max(initial=0) > limit:
                raise ValueError(f"a scaled component is larger than {limit}: squared distances would not fit a long")
            own = old.filter(fits)
            codes, error = np.zeros((len(v), len(balls)), np.int32), np.zeros(len(v), np.int64)
            known = None if own.null_count else own.flatten().to_numpy().reshape(-1, len(balls))
            for p, ball in enumerate(balls if len(v) else []):
                part = np.ascontiguousarray(v[:, p * width:(p + 1) * width])
                entry, d2 = (ball.all_pairs(part) if known is None
                             else ball.reassign(part, known[:, p].astype(np.int64))[:2])
                codes[:, p] = entry
                error += d2
            # rows of another length get no code
            place = np.cumsum(fits.to_numpy(zero_copy_only=False)) - 1
            at = pa.array(place, mask=~fits.to_numpy(zero_copy_only=False))
            made = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), len(balls)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, made.take(at), pa.array(error).take(at)],
                                             names=["row", "v", "code", "error"])

    return run


def _means(coded: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry's floored mean of its parts; entries without parts stay."""
    width = books[0].shape[1]
    part = coded.filter(F.col("code").isNotNull()).select("v", F.posexplode("code").alias("part", "entry")).select(
        "part", "entry", F.slice("v", F.col("part") * width + 1, F.lit(width)).alias("x"))
    sums = part.groupBy("part", "entry").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("x", F.lit(j)).cast("bigint")).alias(f"s{j}") for j in range(width)])
    books = [b.copy() for b in books]
    for r in sums.collect():                       # at most entries rows a part
        books[r["part"]][r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return books


def compress_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 4,
                     entries: int = 256, rounds: int = 4, scale: int = 1024, carry: Sequence[str] = ()
                     ) -> tuple[DataFrame, list[np.ndarray]]:
    """(id, row struct of the carried columns, code array<int>, error bigint)
    per kept row, and the final codebook (entries x components) of each part.

    Codebooks start as the parts of the ``entries`` smallest kept ids. ``error``
    is the squared distance to the coded vector.
    """
    spark = df.sparkSession
    ship = F.struct(F.col(id_col).alias("id"), F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("carried"))
    table, path = materialise_at(
        integer_vectors(df, vector_col, scale, [ship.alias("row")])
        .select("row", "v", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("bigint").alias("error")),
        "vectors")
    by_id = [F.col("row.id").asc_nulls_last(), F.col("v")]
    head = [r["v"] for r in table.select("row", "v").orderBy(*by_id).limit(1).collect()]
    dims = len(head[0]) if head else parts
    if dims % parts or not dims:
        raise ValueError(f"a vector of {dims} components has no {parts} equal parts")
    chosen = table.filter(F.size("v") == dims).select("row.id", "v", "row").orderBy(*by_id).limit(entries).collect()
    first = np.array([r["v"] for r in chosen], np.int64).reshape(-1, dims)
    width = dims // parts
    books = [first[:, p * width:(p + 1) * width] for p in range(parts)]
    schema = T.StructType([table.schema["row"], table.schema["v"], T.StructField("code", T.ArrayType(T.IntegerType())),
                           T.StructField("error", T.LongType())])
    for n in range(rounds + 1 if len(first) else 0):
        assigned = map_in_arrow(table, _assign([Balls(b) for b in books], dims), schema)
        table, last = materialise_at(assigned, "vectors")
        discard(spark, path)
        path = last
        if n < rounds:
            books = _means(table, books)
    return table.select(F.col("row.id").alias(id_col), F.col("row.carried").dropFields("_").alias("row")
                        if carry else F.lit(None).alias("row"), "code", "error"), books
