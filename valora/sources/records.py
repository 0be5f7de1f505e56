"""Records to tables, scoring schema, input checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valora.functions.exprs import c
from valora.spec import ColumnSpec


def records_to_frame(spark: SparkSession, data, schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame, a pandas frame, one dict or a list of dicts; else TypeError."""
    if isinstance(data, DataFrame):
        return data
    try:
        import pandas as pd
        if isinstance(data, pd.DataFrame):
            return spark.createDataFrame(data, schema) if schema else spark.createDataFrame(data)
    except ImportError:  # pragma: no cover
        pass
    if isinstance(data, dict):
        data = [data]
    if isinstance(data, (list, tuple)):
        if not data:
            raise ValueError("no records")
        if schema is not None:
            return spark.createDataFrame(list(data), schema)
        return _records(spark, list(data))
    raise TypeError(f"records must be a frame, a dict or a list of dicts, not {type(data).__name__}")


def _records(spark: SparkSession, data: list[dict]) -> DataFrame:
    """One frame of all records: fields in order of first sight, absent ones
    null; whole and fractional numbers mix to double, other mixtures to text."""
    kinds: dict[str, set] = {}
    for rec in data:
        for k, v in rec.items():
            kinds.setdefault(k, set())
            if v is not None:
                kinds[k].add(type(v) if type(v) in (bool, int, float) else str)
    types = {k: {frozenset([bool]): T.BooleanType(), frozenset([int]): T.LongType()}.get(
        frozenset(v), T.DoubleType() if v and v <= {int, float} else T.StringType()) for k, v in kinds.items()}

    def value(k: str, v):
        if v is None:
            return None
        return float(v) if isinstance(types[k], T.DoubleType) else str(v) if isinstance(types[k], T.StringType) else v

    rows = [tuple(value(k, rec.get(k)) for k in types) for rec in data]
    return spark.createDataFrame(rows, T.StructType([T.StructField(k, t) for k, t in types.items()]))


def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from some inputs becomes NULL there."""
    frames = list(frames)
    if not frames:
        raise ValueError("no frames")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def apply_scoring_schema(df: DataFrame, spec: ColumnSpec, drop_unset: bool = True) -> DataFrame:
    """A10 + A11: defaults for unset scoring fields, range flag ``valid``.

    Numerics with a default take it when unset or absent (a record schema
    fills its defaults); the other fields stay unset.  With ``drop_unset`` a column that is null in every row is
    dropped (so later steps treat it as absent, not as null), except the
    ``always_present`` columns, which are added at 0.0 when missing.
    """
    out = df
    fills = {k: (F.coalesce(c(k).cast("double"), F.lit(float(v))) if k in df.columns
                 else F.lit(float(v)))
             for k, v in spec.scoring_defaults.items()}
    if fills:
        out = out.withColumns(fills)
    add = {k: F.lit(0.0) for k in spec.always_present if k not in out.columns}
    if add:
        out = out.withColumns(add)
    checks = [F.coalesce(c(k).between(lo, hi), F.lit(True))
              for k, (lo, hi) in spec.range_checks.items() if k in out.columns]
    valid = reduce(lambda a, b: a & b, checks) if checks else F.lit(True)
    out = out.withColumn("valid", valid)
    if drop_unset:
        cand = [x for x in out.columns if x not in spec.always_present and x != "valid"]
        row = out.agg(*[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(cand)]).first()
        empty = [x for i, x in enumerate(cand) if row[f"n{i}"] == 0]
        if empty:
            out = out.drop(*empty)
    return out


def split_valid(df: DataFrame, spec: ColumnSpec) -> tuple[DataFrame, DataFrame]:
    """Rows passing the range checks, and the quarantined rest."""
    marked = apply_scoring_schema(df, spec, drop_unset=False)
    return marked.where("valid").drop("valid"), marked.where(~F.col("valid")).drop("valid")


def check_row_limit(df: DataFrame, max_rows: int) -> DataFrame:
    """Refuse inputs with more than ``max_rows`` rows (reads at most
    ``max_rows + 1`` rows)."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"Too many rows; max is {max_rows}")
    return df
