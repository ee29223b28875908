"""Profiling and label-association operators.

Pattern: unpivot once, aggregate once. Per-column statistics for any
number of columns cost one scan and one partial+final aggregation;
hot values are absorbed by map-side combine. Rankings over values use
min_by/max_by aggregates rather than windows over whole columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnforge.functions.exprs import null_safe_join, number
from churnforge.operators.ranking import exact_quantiles, small_table
from churnforge.operators.reshape import to_long
from churnforge.session import map_in_arrow

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def _stack(row_df: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One-row wide aggregate named ``<stat>__<col>`` -> (column, stat...)."""
    structs = [F.struct(F.lit(c).alias("column"),
                        *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols]
    return row_df.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def describe_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles, max per column; NaN is missing."""
    aggs = []
    for c in cols:
        x = number(c)
        aggs += [F.count(x).alias(f"count__{c}"), F.avg(x).alias(f"mean__{c}"),
                 F.stddev_samp(x).alias(f"std__{c}"), F.min(x).alias(f"min__{c}"),
                 F.max(x).alias(f"max__{c}")]
    base = _stack(df.agg(*aggs), cols, ["count", "mean", "std", "min", "max"])
    q = exact_quantiles(to_long(df, [], cols, "double"), ["column"], "value", QUARTILES)
    return base.join(q, on="column", how="left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-adjusted sample skewness G1 and excess kurtosis G2 (pandas: 0 for a
    constant column with enough values)."""
    aggs = []
    for c in cols:
        x = number(c)
        aggs += [F.count(x).alias(f"n__{c}"), F.skewness(x).alias(f"g1__{c}"),
                 F.kurtosis(x).alias(f"g2__{c}"), (F.min(x) == F.max(x)).alias(f"flat__{c}")]
    m = _stack(df.agg(*aggs), cols, ["n", "g1", "g2", "flat"])
    n = F.col("n").cast("double")
    g1 = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return m.select("column", F.when((n > 2) & F.col("flat"), 0.0).otherwise(g1).alias("skewness"),
                    F.when((n > 3) & F.col("flat"), 0.0).otherwise(g2).alias("kurtosis"))


def column_overview(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
                    rsd: float = 0.02) -> DataFrame:
    """dtype, n_unique (non-null), n_missing, missing_pct per column.

    ``approx=True`` replaces the exact distinct count (a shuffle of every
    distinct (column, value) pair) by HyperLogLog++ sketches merged in the
    same single wide aggregation as the missing counts (relative error ``rsd``).
    """
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    n_total = df.select(F.count(F.lit(1))).scalar()
    if approx:
        row = df.agg(*[F.approx_count_distinct(c, rsd).alias(f"n_unique__{c}") for c in cols])
        uniq = _stack(row, cols, ["n_unique"]).withColumn("n_unique", F.col("n_unique").cast("long"))
    else:
        long = to_long(df, [], cols)
        per_value = (long.where(F.col("value").isNotNull())
                     .groupBy("column", "value").agg(F.count(F.lit(1)).alias("_n")))
        uniq = per_value.groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_unique"))
    gone = {c: F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull() for c in cols}
    miss = df.agg(*[F.count(F.when(gone[c], 1)).alias(f"n_missing__{c}") for c in cols])
    miss = _stack(miss, cols, ["n_missing"])
    dtypes = df.sparkSession.createDataFrame([(c, types[c]) for c in cols], "column string, dtype string")
    out = dtypes.join(miss, "column").join(uniq, "column", "left")
    return out.select(
        "column", "dtype", F.coalesce("n_unique", F.lit(0)).cast("long").alias("n_unique"),
        F.col("n_missing").cast("long").alias("n_missing"),
        (F.col("n_missing") / n_total * 100).alias("missing_pct"))


def unique_profile(df: DataFrame, cols: Sequence[str], max_list: int = 12,
                   null_token: str = "0") -> DataFrame:
    """n_unique per column (nulls counted as the token) and the sorted
    values joined by ',' when there are at most ``max_list`` of them.

    One scan of distinct-count sketches tells which columns can have a list.
    Only these are unpivoted with their values, which partial aggregation has
    reduced to a few before anything is shuffled; of all others the exact count
    is taken, a column at a time, so that a value travels without its column's
    name and once a task."""
    cols = list(cols)
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(null_token)) for c in cols}
    sketch = df.agg(*[F.approx_count_distinct(text[c]).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    near = [c for i, c in enumerate(cols) if sketch[f"c{i}"] <= 2 * max_list]
    out = None
    if near:
        values = to_long(df, [], near).select("column", F.coalesce("value", F.lit(null_token)).alias("value")).distinct()
        out = values.groupBy("column").agg(F.count(F.lit(1)).cast("long").alias("n_unique"),
                                           F.array_sort(F.collect_list("value")).alias("values"))
        out = out.select("column", "n_unique", F.when(F.col("n_unique") <= max_list, F.array_join("values", ",")).alias("values"))
    for c in (c for c in cols if c not in near):
        one = df.select(text[c].alias("value")).distinct().agg(F.count(F.lit(1)).cast("long").alias("n_unique"))
        one = one.select(F.lit(c).alias("column"), "n_unique", F.lit(None).cast("string").alias("values"))
        out = one if out is None else out.unionByName(one)
    return out


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count (non-null), unique, top (ties -> smallest value), freq."""
    long = to_long(df, [], cols).where(F.col("value").isNotNull())
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    key = F.struct((-F.col("n")).alias("k"), F.col("value").alias("v"))
    return vc.groupBy("column").agg(
        F.sum("n").cast("long").alias("count"),
        F.count(F.lit(1)).cast("long").alias("unique"),
        F.min_by("value", key).alias("top"),
        F.min_by("n", key).cast("long").alias("freq"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count, share) — share of all rows, nulls included in the total."""
    total = df.select(F.count(F.lit(1))).scalar()
    vc = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return vc.withColumn("share", F.col("count") / total)


def category_counts(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """(column, value, label, count) for every categorical column at once."""
    long = to_long(df, [label], cols)
    return long.groupBy("column", "value", label).agg(F.count(F.lit(1)).alias("count"))


def crosstab_label(df: DataFrame, cols: Sequence[str], label: str,
                   classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Feature x label crosstab with fixed label columns n_<class>."""
    long = to_long(df, [label], cols).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(
        *[F.count(F.when(F.col(label) == k, 1)).alias(f"n_{k}") for k in classes])


def churn_rate_by(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Row-normalised crosstab: share of label==1 per category value, in %."""
    long = to_long(df, [label], cols).where(F.col("value").isNotNull() & F.col(label).isNotNull())
    return long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(F.col(label).cast("double")) * 100).alias("churn_rate"))


def category_odds(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """round(churned / (not_churned + 1e-6) * 100, 2) per category value."""
    ct = crosstab_label(df, cols, label)
    return ct.select("column", "value", F.col("n_1").alias("churned"), F.col("n_0").alias("not_churned"),
                     F.round(F.col("n_1") / (F.col("n_0") + 1e-6) * 100, 2).alias("odds_pct"))


def boxplot_stats(df: DataFrame, cols: Sequence[str], label: str | None = None,
                  whisker: float = 1.5) -> DataFrame:
    """Quartiles, IQR fences, whisker ends (farthest points inside the
    fences) and outlier counts per column, overall (``overall`` = 1, ``group``
    null) and per non-null label value.

    The overall group is a flag, not a reserved label, so no label value can
    be taken for it. Rows stay where they are: quartiles come from sketches
    and narrow intervals, fences from a table of one row a (column, group).
    """
    long = to_long(df, [label] if label else [], cols, "double")
    long = long.withColumn("value", number("value")).where(F.col("value").isNotNull())
    own = F.struct(F.lit(0).alias("overall"), F.col(label).cast("string").alias("grp")) if label else None
    both = F.array(F.struct(F.lit(1).alias("overall"), F.lit(None).cast("string").alias("grp")),
                   *([own] if label else []))
    g = long.select("column", "value", F.explode(both).alias("_g")).select("column", "value", "_g.*")
    g = g.where((F.col("overall") == 1) | F.col("grp").isNotNull())
    keys = ["column", "overall", "grp"]
    q = exact_quantiles(g, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    q = small_table(q.withColumn("iqr", F.col("q3") - F.col("q1"))
                    .withColumn("lower_fence", F.col("q1") - whisker * F.col("iqr"))
                    .withColumn("upper_fence", F.col("q3") + whisker * F.col("iqr")))
    j = null_safe_join(g, q.select(*keys, "lower_fence", "upper_fence"), keys)
    inside = (F.col("value") >= F.col("lower_fence")) & (F.col("value") <= F.col("upper_fence"))
    w = j.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    return null_safe_join(q, w, keys).select(
        "column", "overall", F.col("grp").alias("group"), F.col("n").cast("long").alias("n"), "q1", "median", "q3", "iqr",
        "lower_fence", "upper_fence", "whisker_low", "whisker_high", F.col("n_outliers").cast("long").alias("n_outliers"))


def histogram_by_label(df: DataFrame, col: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed) stacked by label."""
    x = number(col)
    rng = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo = rng.select("lo").scalar()
    hi = rng.select("hi").scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width), F.lit(bins - 1))).cast("int")
    h = (df.where(x.isNotNull()).withColumn("bin", b)
         .groupBy("bin", label).agg(F.count(F.lit(1)).alias("count")))
    return h.select("bin", (lo + F.col("bin") * width).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_end"), label, "count")


def corr_matrix(df: DataFrame, cols: Sequence[str], upper: bool = False) -> DataFrame:
    """Pairwise-complete Pearson r for each pair i<j in one aggregation.

    Long form (col_a, col_b, corr) with col_a earlier in ``cols``
    (``upper`` swaps the pair to give the other triangle).
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}")
                   for i, (a, b) in enumerate(pairs)])
    structs = [F.struct(F.lit(b if upper else a).alias("col_a"), F.lit(a if upper else b).alias("col_b"),
                        F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def wide_corr(df: DataFrame, vector_col: str, dims: int) -> DataFrame:
    """(dim_a, dim_b, corr), dim_a < dim_b: pairwise-complete Pearson r of all
    dimensions of an array column, by block Gramians.

    Every task adds up the products of its rows in matrix form: counts, sums,
    squares and cross products of the pairs in which neither is null or NaN.
    What leaves a task is one row a dimension whatever its rows; the rows are
    added by key. Values are taken relative to the column means, so that large
    offsets cost no digits. A row shorter than ``dims`` lacks the rest."""
    gaps = F.array_repeat(F.lit(None).cast("double"), dims)
    known = F.slice(F.concat(F.transform(vector_col, lambda c: number(c)), gaps), 1, dims)
    cells = df.select(F.posexplode(vector_col).alias("i", "x")).where(F.col("i") < dims).select("i", number("x").alias("x"))
    found = {r["i"]: r["m"] for r in cells.groupBy("i").agg(F.avg("x").alias("m")).collect()}     # a row a dimension
    centre = [found.get(i) or 0.0 for i in range(dims)]
    parts = ["n", "sx", "sxx", "sxy"]

    def gramians(batches):
        total = np.zeros((4, dims, dims))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims) - centre
            there = ~np.isnan(v)
            v, there = np.where(there, v, 0.0), there.astype(float)
            total += [there.T @ there, v.T @ there, (v * v).T @ there, v.T @ v]
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(dims + 1, dtype=np.int32) * dims), pa.array(t.ravel())) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), *lists], names=["a", *parts])

    sums = map_in_arrow(df.where(F.col(vector_col).isNotNull()).select(known.alias("x")), gramians,
                        "a int, n array<double>, sx array<double>, sxx array<double>, sxy array<double>")
    cells = sums.select(
        "a", F.posexplode(F.arrays_zip(*parts)).alias("b", "s")).select("a", "b", "s.*")
    g = cells.groupBy("a", "b").agg(*[F.sum(p).alias(p) for p in parts])
    # the other dimension's sums over the same pairs stand in the mirrored cell
    m = g.select(F.col("a").alias("_b"), F.col("b").alias("_a"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    both = g.where("a < b").join(m, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    n = F.col("n")
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / n
    va, vb = F.col("sxx") - F.col("sx") * F.col("sx") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    r = F.when((n > 1) & (va > 0) & (vb > 0), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cov / F.sqrt(va * vb))))
    return both.select(F.col("a").alias("dim_a"), F.col("b").alias("dim_b"), r.alias("corr"))


def label_correlation(df: DataFrame, cols: Sequence[str], label: str, k: int | None = 10) -> DataFrame:
    """Features ranked by signed Pearson r with the label (desc), all or the top k."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(c) for c in cols])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr")) for c in cols]
    long = row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")
    ranked = long.orderBy(F.col("corr").desc_nulls_last(), "feature")
    return ranked if k is None else ranked.limit(k)


def high_corr_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Later columns with |r| > threshold against any earlier column."""
    cm = corr_matrix(df, cols)
    hit = cm.where(F.abs("corr") > threshold)
    return hit.groupBy(F.col("col_b").alias("column")).agg(
        F.max(F.abs("corr")).alias("max_abs_corr"),
        F.array_join(F.array_sort(F.collect_set("col_a")), ",").alias("correlated_with"))


def category_association(df: DataFrame, cols: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """Chi-square and Cramer's V of each categorical column vs the label,
    plus the positive share, ranked by V (top k)."""
    ct = crosstab_label(df, cols, label)
    ct = ct.withColumn("_cell_n", F.col("n_0") + F.col("n_1"))
    col_tot = ct.groupBy("column").agg(
        F.sum("_cell_n").alias("_tot"), F.sum("n_0").alias("_c0"), F.sum("n_1").alias("_c1"),
        F.count(F.lit(1)).alias("_rows"))
    j = ct.join(col_tot, "column")
    e0 = F.col("_cell_n") * F.col("_c0") / F.col("_tot")
    e1 = F.col("_cell_n") * F.col("_c1") / F.col("_tot")
    cell = (F.when(e0 > 0, F.pow(F.col("n_0") - e0, 2) / e0).otherwise(0.0) +
            F.when(e1 > 0, F.pow(F.col("n_1") - e1, 2) / e1).otherwise(0.0))
    chi = j.groupBy("column").agg(F.sum(cell).alias("chi2"), F.first("_tot").alias("_tot"),
                                  F.first("_c1").alias("_c1"), F.first("_rows").alias("_rows"))
    kmin = F.least(F.col("_rows"), F.lit(2)) - 1
    v = F.when(kmin > 0, F.sqrt(F.col("chi2") / (F.col("_tot") * kmin))).otherwise(F.lit(0.0))
    out = chi.select("column", (F.col("_c1") / F.col("_tot")).alias("share"), "chi2", v.alias("cramers_v"))
    return out.orderBy(F.col("cramers_v").desc(), "column").limit(k)


def numeric_association(df: DataFrame, cols: Sequence[str], label: str, k: int = 3) -> DataFrame:
    """|Pearson r| with the label (undefined -> 0), top k."""
    row = df.agg(*[F.coalesce(F.abs(F.corr(F.col(c).cast("double"), F.col(label).cast("double"))),
                              F.lit(0.0)).alias(c) for c in cols])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("abs_corr")) for c in cols]
    long = row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")
    return long.orderBy(F.col("abs_corr").desc(), "feature").limit(k)


def dataset_summary(df: DataFrame, label: str, numeric: Sequence[str], k: int | None = None) -> DataFrame:
    """Long (section, key, value): row count, label shares, missing counts,
    correlations with the label (all, or the top k)."""
    total = df.select(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("records").alias("section"), F.lit("total").alias("key"), "value")
    shares = value_counts(df, label).select(
        F.lit("label_share").alias("section"), F.col("value").cast("string").alias("key"),
        F.col("share").alias("value"))
    cols = df.columns
    miss = _stack(df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"m__{c}") for c in cols]),
                  cols, ["m"]).select(F.lit("missing").alias("section"), F.col("column").alias("key"),
                                      F.col("m").cast("double").alias("value"))
    corr = label_correlation(df, numeric, label, k).select(
        F.lit("label_corr").alias("section"), F.col("feature").alias("key"), F.col("corr").alias("value"))
    return total.unionByName(shares).unionByName(miss).unionByName(corr)


def split_distribution(df: DataFrame, label: str, split_col: str = "split",
                       splits: Sequence[str] = ("train", "test")) -> DataFrame:
    """Label counts and shares per split side by side (pivot with fixed values)."""
    tot = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("_t"))
    c = df.groupBy(label, split_col).agg(F.count(F.lit(1)).alias("_n"))
    c = null_safe_join(c, tot, [split_col]).withColumn("_s", F.col("_n") / F.col("_t"))
    return c.groupBy(label).agg(
        *[F.coalesce(F.sum(F.when(F.col(split_col) == s, F.col("_n"))), F.lit(0)).cast("long").alias(f"n_{s}")
          for s in splits],
        *[F.coalesce(F.sum(F.when(F.col(split_col) == s, F.col("_s"))), F.lit(0.0)).alias(f"share_{s}")
          for s in splits])
