"""Distributed ranks, prefix sums and exact quantiles.

None of these uses an un-partitioned window or Spark's exact
``percentile`` aggregate (which buffers a whole group in one task).
Work is split into buckets whose boundaries are cheap to find
(md5 prefixes for hash ranks, a bounded quantile sketch for values);
per-bucket counts form a small table whose running sums give each
bucket's offset, and rows are then ranked inside their own bucket.

Joins on part columns are null-safe: a null part is a part like any
other, and no row is ever lost to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnforge.functions.exprs import hash_hex, null_safe_join, number

_UNB = Window.unboundedPreceding
#: Parameter tables of up to so many rows go through the driver and are broadcast:
#: the rows they are joined to stay where they are. Larger ones stay frames.
PARAM_ROWS = 10_000


def small_table(df: DataFrame) -> DataFrame:
    """``df`` as a broadcast table if it has at most PARAM_ROWS rows, else ``df``
    itself. A frame made of rows has no size the planner knows: without the hint
    it sorts the other side, which has a handful of keys, into as many tasks."""
    rows = df.limit(PARAM_ROWS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= PARAM_ROWS else df


def _default_buckets(df: DataFrame) -> int:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(16, 4 * parts)


def _with_parts(df: DataFrame, part_cols: Sequence[str]) -> tuple[DataFrame, list[str], bool]:
    """A constant part where none is asked for, so that one code path serves."""
    part_cols = list(part_cols)
    return (df, part_cols, False) if part_cols else (df.withColumn("_all", F.lit(0)), ["_all"], True)


def hash_rank(df: DataFrame, part_cols: Sequence[str], id_col: str = "id",
              seed: int = 42, bits: int = 16, rank_col: str = "rank") -> DataFrame:
    """0-based rank of each row within ``part_cols`` ordered by (md5(seed:id), id).

    The md5 prefix of ``bits`` bits is the bucket: counts per bucket
    (at most 2**bits rows per part) give offsets, and row_number runs
    only inside a bucket, so no task sees more than ~n / 2**bits rows.
    """
    df, part_cols, glob = _with_parts(df, part_cols)
    hex_digits = max(1, bits // 4)
    b = (df.withColumn("_h", hash_hex(id_col, seed))
         .withColumn("_bkt", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("long")))
    counts = b.groupBy(*part_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(_UNB, -1)
    offsets = counts.select(*part_cols, "_bkt",
                            F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    w_in = Window.partitionBy(*part_cols, "_bkt").orderBy("_h", id_col)
    ranked = b.withColumn("_in", F.row_number().over(w_in) - 1)
    out = null_safe_join(ranked, offsets, [*part_cols, "_bkt"])
    out = (out.withColumn(rank_col, (F.col("_off") + F.col("_in")).cast("long"))
           .drop("_h", "_bkt", "_in", "_off"))
    return out.drop("_all") if glob else out


def hash_prefix_sums(df: DataFrame, part_cols: Sequence[str], weight_cols: Sequence[str], id_col: str = "id",
                     seed: int = 42, bits: int = 16, suffix: str = "_before") -> DataFrame:
    """Add ``<w>_before`` = sum of ``w`` over the rows of the part that come
    strictly before in the order (md5(seed:id), id). Buckets and offsets are
    those of :func:`hash_rank`: a part that holds all rows is ordered in as many
    tasks as there are buckets."""
    df, part_cols, glob = _with_parts(df, part_cols)
    b = (df.withColumn("_h", hash_hex(id_col, seed))
         .withColumn("_bkt", F.conv(F.substring("_h", 1, max(1, bits // 4)), 16, 10).cast("long")))
    totals = b.groupBy(*part_cols, "_bkt").agg(*[F.sum(w).alias(f"_t_{w}") for w in weight_cols])
    w_off = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(_UNB, -1)
    offsets = totals.select(*part_cols, "_bkt", *[F.coalesce(F.sum(f"_t_{w}").over(w_off), F.lit(0)).alias(f"_o_{w}")
                                                  for w in weight_cols])
    w_in = Window.partitionBy(*part_cols, "_bkt").orderBy("_h", id_col).rowsBetween(_UNB, -1)
    inside = b.withColumns({f"_i_{w}": F.coalesce(F.sum(w).over(w_in), F.lit(0)) for w in weight_cols})
    out = null_safe_join(inside, offsets, [*part_cols, "_bkt"])
    out = out.withColumns({f"{w}{suffix}": F.col(f"_o_{w}") + F.col(f"_i_{w}") for w in weight_cols})
    out = out.drop("_h", "_bkt", *[f"_o_{w}" for w in weight_cols], *[f"_i_{w}" for w in weight_cols])
    return out.drop("_all") if glob else out


def hash_rank_below(df: DataFrame, quotas: DataFrame, part_cols: Sequence[str], id_col: str = "id",
                    seed: int = 42, bits: int = 16, out_col: str = "_below") -> DataFrame:
    """Flag rows whose hash rank within their part is below the part's quota.

    Same order as :func:`hash_rank`, but only the md5-prefix bucket of each
    part that straddles the quota is ordered. That bucket - one row a part -
    is all the rows need to know: buckets before it are below, those after
    it are not. ``quotas``: part_cols + quota.
    """
    df, part_cols, glob = _with_parts(df, part_cols)
    if glob:
        quotas = quotas.withColumn("_all", F.lit(0))
    hex_digits = max(1, bits // 4)
    b = (df.withColumn("_h", hash_hex(id_col, seed))
         .withColumn("_bkt", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("long")))
    counts = b.groupBy(*part_cols, "_bkt").agg(F.count(F.lit(1)).alias("_n"))
    w_off = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(_UNB, -1)
    offs = null_safe_join(
        counts.withColumn("_off", F.coalesce(F.sum("_n").over(w_off), F.lit(0))),
        small_table(quotas.select(*part_cols, "quota")), part_cols)
    straddles = (F.col("_off") <= F.col("quota")) & (F.col("quota") < F.col("_off") + F.col("_n"))
    # a quota of all rows straddles no bucket: everything is below it
    edge = small_table(offs.groupBy(*part_cols).agg(
        F.max(F.when(straddles, F.col("_bkt"))).alias("_edge"),
        F.max(F.when(straddles, F.col("quota") - F.col("_off"))).alias("_left")))
    j = null_safe_join(b, edge, part_cols)
    w_in = Window.partitionBy(*part_cols, "_bkt").orderBy("_h", id_col)
    at_edge = F.col("_bkt").eqNullSafe(F.col("_edge"))
    decided = j.where(~at_edge).withColumn(out_col, F.coalesce(F.col("_bkt") < F.col("_edge"), F.lit(True)))
    ranked = j.where(at_edge).withColumn(out_col, F.row_number().over(w_in) <= F.col("_left"))
    out = decided.unionByName(ranked).drop("_h", "_bkt", "_edge", "_left")
    return out.drop("_all") if glob else out


def prefix_sums(df: DataFrame, part_cols: Sequence[str], order_col: str,
                weight_cols: Sequence[str], n_buckets: int | None = None,
                accuracy: int = 10000, suffix: str = "_before") -> DataFrame:
    """Add ``<w>_before`` = sum of ``w`` over rows ordered strictly before.

    Rows must be unique on (part_cols, order_col) — callers aggregate to
    distinct values first, which also absorbs any hot value. The order is cut
    into buckets by a quantile sketch; a value finds its bucket by halving
    steps over the sorted bucket bounds.
    """
    df, part_cols, glob = _with_parts(df, part_cols)
    n_buckets = n_buckets or _default_buckets(df)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    splits = small_table(df.groupBy(*part_cols).agg(
        F.percentile_approx(F.col(order_col).cast("double"), probs, accuracy).alias("_splits")))
    b = null_safe_join(df, splits, part_cols).withColumn(
        "_bkt", _bucket(F.col(order_col).cast("double"), F.col("_splits"), n_buckets)).drop("_splits")
    counts = b.groupBy(*part_cols, "_bkt").agg(
        *[F.sum(w).alias(f"_t_{w}") for w in weight_cols])
    w_off = Window.partitionBy(*part_cols).orderBy("_bkt").rowsBetween(_UNB, -1)
    offsets = counts.select(
        *part_cols, "_bkt",
        *[F.coalesce(F.sum(f"_t_{w}").over(w_off), F.lit(0)).alias(f"_o_{w}")
          for w in weight_cols])
    w_in = Window.partitionBy(*part_cols, "_bkt").orderBy(order_col).rowsBetween(_UNB, -1)
    for w in weight_cols:
        b = b.withColumn(f"_i_{w}", F.coalesce(F.sum(w).over(w_in), F.lit(0)))
    out = null_safe_join(b, offsets, [*part_cols, "_bkt"])
    for w in weight_cols:
        out = out.withColumn(f"{w}{suffix}", F.col(f"_o_{w}") + F.col(f"_i_{w}"))
    out = out.drop("_bkt", *[f"_o_{w}" for w in weight_cols], *[f"_i_{w}" for w in weight_cols])
    return out.drop("_all") if glob else out


def _bucket(v, splits, n_buckets: int):
    """Number of splits below ``v``, by halving steps over the sorted array."""
    at = F.lit(0)
    step = 1 << max(0, (n_buckets - 1).bit_length() - 1)
    while step:
        at = at + F.when(F.get(splits, at + (step - 1)) < v, F.lit(step)).otherwise(F.lit(0))
        step //= 2
    return at


#: Distinct values of an interval that may be ordered in one task.
MOST_ORDERED = 10_000
_CUTS = 256


def _narrowed(vals: DataFrame, targets: DataFrame, part_cols: Sequence[str], most: int) -> DataFrame:
    """Intervals with at most ``most`` distinct values, or a single one, that
    still hold the target ranks. A stage counts the rows in every interval's 256
    sub-intervals and descends into those that hold the two ranks around the
    target; ends are values of the data, so every stage gets nearer to them."""
    # a value's sub-interval; the last one takes the upper end
    wide = F.col("_hi_v") > F.col("_lo_v")
    step = F.floor((F.col("_v") / 2 - F.col("_lo_v") / 2) / (F.col("_hi_v") / 2 - F.col("_lo_v") / 2) * _CUTS)
    sub = F.when(F.col("_v") < F.col("_lo_v"), -1).when(wide, F.least(step, F.lit(_CUTS - 1))).otherwise(0).cast("int")
    while True:
        met = null_safe_join(vals, targets, part_cols).where(F.col("_v") <= F.col("_hi_v"))
        size = met.where((F.col("_v") >= F.col("_lo_v")) & wide).groupBy(*part_cols, "_q").agg(
            F.approx_count_distinct("_v", 0.05).alias("_d")).agg(F.max("_d")).first()[0]
        if not size or size <= most:
            return targets
        counts = met.groupBy(*part_cols, "_q", "_pos", sub.alias("_sub")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        # at most 257 rows a target
        before = Window.partitionBy(*part_cols, "_q").orderBy("_sub").rowsBetween(_UNB, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).where("_sub >= 0")
        holds = (F.col("_before") <= F.ceil("_pos")) & (F.floor("_pos") < F.col("_before") + F.col("_c"))
        new = counts.where(holds).groupBy(*part_cols, "_q", "_pos").agg(F.min("_a").alias("_lo_v"), F.max("_b").alias("_hi_v"))
        new = small_table(new.select(*targets.columns))
        # where two neighbouring values are ends of far sub-intervals nothing between them is left to order
        same = null_safe_join(new, targets.select(*part_cols, "_q", F.col("_lo_v").alias("_l"), F.col("_hi_v").alias("_h")), [*part_cols, "_q"])
        if not same.where((F.col("_l") != F.col("_lo_v")) | (F.col("_h") != F.col("_hi_v"))).limit(1).count():
            return targets
        targets = new


def exact_quantiles(long_df: DataFrame, part_cols: Sequence[str], value_col: str,
                    probs: dict[str, float], accuracy: int = 10000, most_ordered: int = MOST_ORDERED) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy/pandas default) per part.

    ``long_df`` holds one value per row; nulls and NaN are ignored. A sketch
    gives a narrow interval that must hold each target rank. An interval of more
    than ``most_ordered`` distinct values is narrowed in stages that only count
    (:func:`_narrowed`); then one scan counts the rows below every interval and
    the distinct values inside it, and only those are ordered, so the largest
    sort is bounded by a constant. Output: one row per part with one column per
    entry of ``probs``.
    """
    long_df, part_cols, glob = _with_parts(long_df, part_cols)
    vals = long_df.select(*part_cols, number(value_col).alias("_v")).where(F.col("_v").isNotNull())
    eps = 4.0 / accuracy
    around = [(k, p, max(0.0, p - eps), min(1.0, p + eps)) for k, p in probs.items()]
    sketch = vals.groupBy(*part_cols).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [x for _, _, lo, hi in around for x in (lo, hi)], accuracy).alias("_s"))
    # the ends of the order are known exactly: no interval stops short of a rank near them
    picks = F.array(*[F.struct(
        F.lit(k).alias("_q"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("_pos"),
        (F.col("_min") if lo <= 0 else F.get("_s", F.lit(2 * i))).alias("_lo_v"),
        (F.col("_max") if hi >= 1 else F.get("_s", F.lit(2 * i + 1))).alias("_hi_v"))
        for i, (k, p, lo, hi) in enumerate(around)])
    # a part of few rows has both ranks' neighbours anywhere: widen by the whole range
    few = F.col("_n") <= accuracy
    targets = sketch.select(*part_cols, "_n", "_min", "_max", F.explode(picks).alias("_t")).select(
        *part_cols, "_t._q", "_t._pos", F.when(few, F.col("_min")).otherwise(F.col("_t._lo_v")).alias("_lo_v"),
        F.when(few, F.col("_max")).otherwise(F.col("_t._hi_v")).alias("_hi_v"), "_n")
    targets = small_table(targets)
    # an interval of at most as many rows as may be ordered needs no stage, and its rows no further scan
    most_rows = targets.agg(F.max(F.when(F.col("_n") <= accuracy, F.col("_n")).otherwise(F.ceil(4 * eps * F.col("_n"))))).first()[0]
    targets = targets.drop("_n")
    if most_rows and most_rows > most_ordered:
        targets = _narrowed(vals, targets, part_cols, most_ordered)
    x = null_safe_join(vals, targets, part_cols).where(F.col("_v") <= F.col("_hi_v"))
    inside = F.col("_v") >= F.col("_lo_v")
    counted = x.groupBy(*part_cols, "_q", "_pos", F.when(inside, F.col("_v")).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    w_in = Window.partitionBy(*part_cols, "_q").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(_UNB, -1)
    cum = counted.withColumn("_before", F.coalesce(F.sum("_c").over(w_in), F.lit(0))).where(F.col("_v").isNotNull())
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    end = F.col("_before") + F.col("_c")
    has_lo, has_hi = (F.col("_before") <= lo) & (lo < end), (F.col("_before") <= hi) & (hi < end)
    g = cum.groupBy(*part_cols, "_q").agg(
        F.max(F.when(has_lo, F.col("_v"))).alias("_vlo"), F.max(F.when(has_hi, F.col("_v"))).alias("_vhi"),
        F.first("_pos").alias("_pos"))
    missed = F.col("_vlo").isNull() | F.col("_vhi").isNull()
    quantile = F.when(missed, F.raise_error(F.lit("the sketch missed a rank; raise accuracy")).cast("double")).otherwise(
        F.col("_vlo") + (F.col("_pos") - F.floor("_pos")) * (F.col("_vhi") - F.col("_vlo")))
    wide = g.withColumn("_qv", quantile).groupBy(*part_cols).agg(
        *[F.max(F.when(F.col("_q") == k, F.col("_qv"))).alias(k) for k in probs])
    return wide.drop("_all") if glob else wide
