"""Small Column-expression helpers shared by operators (all JVM-side)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text read as missing on input (the published pipeline adds
# "?", "NA", "N/A", "null" to the pandas defaults, which include the rest).
NA_MARKERS = (
    "", "?", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "-nan", "-NaN",
    "None", "<NA>", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN",
    "1.#IND", "1.#QNAN",
)

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def c(name: str) -> Column:
    """Column by exact name (names such as ``1stFlrSF`` need quoting)."""
    return F.col(f"`{name}`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC_TYPES)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def nan_to_null(col: Column) -> Column:
    """NaN and +-inf become NULL (Spark aggregates treat NaN as a value)."""
    return F.when(F.isnan(col) | (F.abs(col) == float("inf")), F.lit(None)).otherwise(col)


def floats_to_null(df: DataFrame, skip: Iterable[str] = ()) -> DataFrame:
    """Every float column with NaN and +-inf as NULL: the one rule for what is
    missing, applied where rows enter cleaning, imputation, fit and transform."""
    skip = set(skip)
    todo = {f.name: nan_to_null(c(f.name)) for f in df.schema.fields
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)) and f.name not in skip}
    return df.withColumns(todo) if todo else df


def marker_to_null(col: Column, markers: Iterable[str] = NA_MARKERS) -> Column:
    trimmed = F.trim(col)
    return F.when(trimmed.isin(list(markers)), F.lit(None).cast("string")).otherwise(col)


def typed_from_text(name: str, dtype: T.DataType) -> Column:
    """A text column read as ``dtype``: markers are NULL, and so are texts that
    do not parse and the non-finite numbers that Spark's cast would accept."""
    text = marker_to_null(c(name), NA_MARKERS)
    if isinstance(dtype, T.StringType):
        return text.alias(name)
    value = text.try_cast(dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = nan_to_null(value)
    return value.alias(name)


def safe_div(a: Column, b: Column) -> Column:
    """a / b with NULL instead of an error or infinity on a zero divisor."""
    return nan_to_null(F.try_divide(a.cast("double"), b.cast("double")))


def clip(col: Column, lo: float | Column | None = None, hi: float | Column | None = None) -> Column:
    """Null-preserving clip (``least``/``greatest`` skip nulls, so avoid them)."""
    out = col
    if hi is not None:
        hi_c = hi if isinstance(hi, Column) else F.lit(float(hi))
        out = F.when(out > hi_c, hi_c).otherwise(out)
    if lo is not None:
        lo_c = lo if isinstance(lo, Column) else F.lit(float(lo))
        out = F.when(out < lo_c, lo_c).otherwise(out)
    return out


def log_target(col: Column) -> Column:
    return F.log1p(col)


def inverse_log_target(col: Column) -> Column:
    return F.expm1(col)


def pct_text(col: Column, digits: int = 2) -> Column:
    """100 * x as text with ``digits`` decimals and a percent sign."""
    return F.format_string(f"%.{digits}f%%", col * F.lit(100.0))


def zero_sign(col: Column) -> Column:
    """-0.0 becomes 0.0 so that equal values hash equally."""
    return F.when(col == 0, F.lit(0.0)).otherwise(col)


def round_doubles(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double column (for comparisons across engines)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(zero_sign(F.round(c(f.name), digits)).alias(f.name))
        else:
            cols.append(c(f.name))
    return df.select(*cols)
