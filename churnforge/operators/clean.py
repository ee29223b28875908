"""Cleaning, coercion, validation and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.functions.exprs import coerce_numeric, label_map, number
from churnforge.operators.ranking import exact_quantiles
from churnforge.operators.reshape import to_long

_NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                  T.FloatType, T.DoubleType, T.DecimalType)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist; absent names are ignored."""
    return df.drop(*[c for c in cols if c in df.columns])


def columns_of_kind(df: DataFrame, kind: str, exclude: Sequence[str] = ()) -> list[str]:
    """Column names by type class: 'numeric' or 'categorical' (strings)."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        is_num = isinstance(f.dataType, _NUMERIC_TYPES)
        is_cat = isinstance(f.dataType, T.StringType)
        if (kind == "numeric" and is_num) or (kind == "categorical" and is_cat):
            out.append(f.name)
    return out


def select_kind(df: DataFrame, kind: str, keep: Sequence[str] = (),
                exclude: Sequence[str] = ()) -> DataFrame:
    cols = [c for c in columns_of_kind(df, kind, exclude) if c not in keep]
    return df.select(*keep, *cols)


def cast_columns(df: DataFrame, cols: Sequence[str], to: str = "double") -> DataFrame:
    return df.withColumns({c: F.col(c).cast(to) for c in cols})


def coerce_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """{out_col: text_col}: lenient parse, unparsable text -> null."""
    return df.withColumns({out: coerce_numeric(src) for out, src in mapping.items()})


def encode_label(df: DataFrame, src: str, out: str, positive: str = "Yes",
                 negative: str = "No") -> DataFrame:
    return df.withColumn(out, label_map(src, positive, negative))


def impute_product(df: DataFrame, target: str, a: str, b: str) -> DataFrame:
    """Null ``target`` := a * b (formula fill)."""
    return df.withColumn(target, F.coalesce(F.col(target), F.col(a) * F.col(b)))


def median_of(df: DataFrame, col: str):
    """Exact median of a column as a lazy scalar (distributed quantile)."""
    return exact_quantiles(df, [], col, {"q50": 0.5}).select("q50").scalar()


def impute_median(df: DataFrame, col: str, out: str | None = None,
                  flag: str | None = "was_missing", median_source: DataFrame | None = None) -> DataFrame:
    """Fill nulls and NaN with the exact median of ``median_source`` (default: ``df``)."""
    med = median_of(median_source if median_source is not None else df, col)
    res = df
    if flag:
        res = res.withColumn(flag, number(col).isNull().cast("int"))
    return res.withColumn(out or col, F.coalesce(number(col), med))


def validate_records(df: DataFrame, required: Sequence[str],
                     strict_numeric: Sequence[str] = ()) -> DataFrame:
    """Per-record validation columns.

    missing_fields: comma list of required fields that are null or that the
    records do not have at all.
    bad_numeric: comma list of fields whose non-null text is not a number.
    is_valid: 1 when both are empty.
    """
    have = set(df.columns)
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) if c in have else F.lit(c) for c in required])
    bad = F.concat_ws(",", *[F.when(F.col(c).isNotNull() & coerce_numeric(c).isNull(), F.lit(c))
                             for c in strict_numeric if c in have])
    return (df.withColumn("missing_fields", missing)
            .withColumn("bad_numeric", bad)
            .withColumn("is_valid", ((F.col("missing_fields") == "") &
                                     (F.col("bad_numeric") == "")).cast("int")))


def unknown_categories(records: DataFrame, vocab: DataFrame, cols: Sequence[str],
                       id_col: str = "id") -> DataFrame:
    """(id, column, value) for record values absent from the fitted vocabulary.

    ``vocab`` is (column, value); a left-anti join keeps it distributed
    (the planner broadcasts it when its runtime size allows).
    """
    long = to_long(records, [id_col], cols).where(F.col("value").isNotNull())
    return long.join(vocab.select("column", "value"), on=["column", "value"], how="left_anti")


def constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, is_constant) — constant = at most one distinct non-null value.

    Smallest equals largest: one scan and one small aggregation, no shuffle
    of the values.
    """
    row = df.agg(*[F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias(f"_k{i}") for i, c in enumerate(cols)])
    out = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_k{i}").cast("int").alias("is_constant"))
                    for i, c in enumerate(cols)])
    return row.select(F.explode(out).alias("_r")).select("_r.*")


def drop_constant_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop those of ``cols`` that hold at most one distinct value."""
    return df.drop(*[r["column"] for r in constant_columns(df, cols).where("is_constant = 1").collect()])


def align_features(df: DataFrame, feature_cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Reorder to the training feature list; missing features become 0.0."""
    present = set(df.columns)
    return df.select(*keep, *[F.col(c).cast("double").alias(c) if c in present
                              else F.lit(0.0).alias(c) for c in feature_cols])
