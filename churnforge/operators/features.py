"""Feature fitting and transforms.

Fit = one aggregation over the training rows returning a small
parameter table (per-column mean/std, min/max, or the vocabulary).
Parameters are collected (bounded: two numbers per column, or a
vocabulary under a checked cap) and applied as literal expressions,
so transforms stay inside whole-stage codegen with no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions.exprs import safe_name, unique_names


@dataclass
class ScalerParams:
    kind: str                       # 'standard' | 'minmax'
    cols: list[str]
    a: dict[str, float]             # mean or min
    b: dict[str, float]             # std (population) or max

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(self.kind, c, self.a[c], self.b[c]) for c in self.cols]
        return spark.createDataFrame(rows, "kind string, column string, a double, b double")

    @staticmethod
    def from_df(df: DataFrame) -> ScalerParams:
        rows = df.collect()
        return ScalerParams(rows[0]["kind"], [r["column"] for r in rows],
                            {r["column"]: r["a"] for r in rows}, {r["column"]: r["b"] for r in rows})


def fit_standard(train: DataFrame, cols: Sequence[str]) -> ScalerParams:
    """Mean and population std per column (zero std -> unit scale)."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    return ScalerParams("standard", list(cols), {c: row[f"m_{i}"] for i, c in enumerate(cols)},
                        {c: row[f"s_{i}"] for i, c in enumerate(cols)})


def fit_minmax(train: DataFrame, cols: Sequence[str]) -> ScalerParams:
    row = train.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{i}") for i, c in enumerate(cols)],
                    *[F.max(F.col(c).cast("double")).alias(f"hi_{i}") for i, c in enumerate(cols)]).first()
    return ScalerParams("minmax", list(cols), {c: row[f"lo_{i}"] for i, c in enumerate(cols)},
                        {c: row[f"hi_{i}"] for i, c in enumerate(cols)})


def scale_expr(p: ScalerParams, c: str) -> Column:
    x = F.col(c).cast("double")
    a, b = p.a[c], p.b[c]
    if p.kind == "standard":
        scale = b if (b is not None and b != 0.0) else 1.0
        return (x - F.lit(a)) / F.lit(scale)
    rng = (b - a) if (a is not None and b is not None and b != a) else 1.0
    return (x - F.lit(a)) / F.lit(rng)


def apply_scaler(df: DataFrame, p: ScalerParams, suffix: str = "") -> DataFrame:
    return df.withColumns({f"{c}{suffix}": scale_expr(p, c) for c in p.cols})


@dataclass
class Vocabulary:
    cols: list[str]
    values: dict[str, list[str]] = field(default_factory=dict)   # sorted per column
    taken: list[str] = field(default_factory=list)               # names of other feature columns

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(c, v, i) for c in self.cols for i, v in enumerate(self.values[c])]
        return spark.createDataFrame(rows, "column string, value string, idx int")

    def feature_names(self, drop_first: bool = True) -> list[tuple[str, str, str]]:
        """(feature, column, value); names are unique even where two values, or
        two columns and values, read alike once made into names. A value has
        the same name whether or not the first one is dropped."""
        every = [(c, v) for c in self.cols for v in self.values[c]]
        names = unique_names((f"{c}_{safe_name(v)}" for c, v in every), self.taken)
        first = {(c, self.values[c][0]) for c in self.cols if self.values[c]}
        return [(n, c, v) for n, (c, v) in zip(names, every) if not (drop_first and (c, v) in first)]


def vocabulary_df(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value) distinct non-null values: a distributed fit."""
    from churnforge.operators.reshape import to_long
    long = to_long(train, [], cols).where(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def fit_onehot(train: DataFrame, cols: Sequence[str], max_categories: int = 1000) -> Vocabulary:
    """Sorted vocabulary per column; refuses columns above the cardinality cap
    (one-hot of an unbounded column is not a feature encoding)."""
    vals: dict[str, list[str]] = {c: [] for c in cols}
    # one scan; a column over the cap shows itself before much is collected
    for r in vocabulary_df(train, cols).select("column", "value").limit(len(cols) * max_categories + 1).collect():
        vals[r["column"]].append(r["value"])
    too_big = [c for c, vs in vals.items() if len(vs) > max_categories]
    if too_big:
        raise ValueError(f"one-hot cardinality above {max_categories}: {too_big}")
    return Vocabulary(list(cols), {c: sorted(vs) for c, vs in vals.items()}, [c for c in train.columns if c not in cols])


def apply_onehot(df: DataFrame, vocab: Vocabulary, drop_first: bool = True,
                 handle_unknown: str = "ignore", keep_source: bool = False) -> DataFrame:
    """0/1 double columns named ``<col>_<value>``; unknown values give all
    zeros ('ignore') or fail the task ('error')."""
    exprs = {}
    for name, c, v in vocab.feature_names(drop_first):
        e = F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0)
        if handle_unknown == "error":
            unknown = F.col(c).isNotNull() & ~F.col(c).isin(*vocab.values[c])
            e = F.when(unknown, F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.col(c)))
                       .cast("double")).otherwise(e)
        exprs[name] = e
    out = df.withColumns(exprs)
    return out if keep_source else out.drop(*vocab.cols)


def feature_table(spark: SparkSession, numeric: Sequence[str], vocab: Vocabulary,
                  drop_first: bool = True) -> DataFrame:
    """(idx, feature, role, source, category): names follow the fitted vocabulary."""
    rows = [(i, c, "numeric", c, None) for i, c in enumerate(numeric)]
    base = len(rows)
    rows += [(base + j, name, "onehot", c, v) for j, (name, c, v) in enumerate(vocab.feature_names(drop_first))]
    return spark.createDataFrame(rows, "idx int, feature string, role string, source string, category string")
