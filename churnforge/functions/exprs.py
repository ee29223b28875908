"""Column-expression helpers. All JVM-side built-ins; no Python UDFs."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_POW_52 = 4503599627370496.0

#: What counts as a number in text: a plain decimal, with an optional exponent.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c) -> Column:
    """Lenient number parse: blanks and junk become null (never an error).

    Only plain decimals count; 'nan', '5d', '7f' and '0x1p3' are junk.
    """
    text = F.trim(col_(c).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number(c) -> Column:
    """A numeric column as double, NaN as null: both are missing values."""
    x = col_(c).cast("double")
    return F.when(~F.isnan(x), x)


def label_map(c, positive: str = "Yes", negative: str = "No") -> Column:
    """Yes/No -> 1/0; any other value -> null (like a dict map)."""
    c = col_(c)
    return (F.when(c == positive, F.lit(1))
            .when(c == negative, F.lit(0))
            .otherwise(F.lit(None).cast("int")))


def hash_hex(id_col, seed: int = 42) -> Column:
    """Portable row hash md5('<seed>:' || id); same string in Spark and SQL.
    A null id hashes like the text 'null', so that its row is never lost."""
    text = F.coalesce(col_(id_col).cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def hash_uniform(id_col, seed: int = 42) -> Column:
    """Uniform [0,1) from the first 13 hex digits (52 bits) of the row hash."""
    h = hash_hex(id_col, seed)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(TWO_POW_52)


def safe_name(s: str) -> str:
    """Feature-column name: non-alphanumerics collapse to '_'."""
    return re.sub(r"[^0-9A-Za-z]+", "_", str(s)).strip("_")


def unique_names(names: Iterable[str], taken: Iterable[str] = ()) -> list[str]:
    """The names in order; one already used gets the first free '__2', '__3', ..."""
    used, out = set(taken), []
    for name in names:
        pick, k = name, 2
        while pick in used:
            pick, k = f"{name}__{k}", k + 1
        used.add(pick)
        out.append(pick)
    return out


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys (NaN as well) meet each other; the key
    columns come from the left side."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_on_{c}"]) for c in on])
    return left.join(renamed, cond, how).drop(*[f"_on_{c}" for c in on])
