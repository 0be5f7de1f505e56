"""Declared derived features compiled to one projection.

Each feature is added only when all the columns it requires exist; inputs
that name earlier features are inlined, so the whole list becomes a single
``select`` inside one whole-stage-codegen span.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.exprs import c, clip, nan_to_null, safe_div
from valora.spec import ColumnSpec, FeatureDef


def _flag(cond: Column, null_as: bool) -> Column:
    return F.coalesce(cond, F.lit(null_as)).cast("int")


def feature_expr(fd: FeatureDef, inputs: list[Column]) -> Column:
    k = fd.kind
    if k == "sum":
        out = inputs[0].cast("double")
        for x in inputs[1:]:
            out = out + x
        return out
    if k == "sum_nullzero":
        out = F.coalesce(inputs[0].cast("double"), F.lit(0.0))
        for x in inputs[1:]:
            out = out + F.coalesce(x.cast("double"), F.lit(0.0))
        return out
    if k == "weighted_sum":
        out = None
        for w, x in zip(fd.weights, inputs, strict=True):
            term = x.cast("double") if w == 1.0 else F.lit(float(w)) * x
            out = term if out is None else out + term
        return out
    if k == "ratio_p1":
        return safe_div(inputs[0], inputs[1] + F.lit(1.0))
    if k == "gt0_flag":
        return _flag(inputs[0] > 0, False)
    if k == "diff":
        return inputs[0].cast("double") - inputs[1]
    if k == "diff_clip0":
        return clip(inputs[0].cast("double") - inputs[1], lo=0.0)
    if k == "ne_flag":
        return _flag(inputs[0] != inputs[1], True)
    if k == "eq_flag":
        return _flag(inputs[0] == inputs[1], False)
    if k == "product":
        return inputs[0].cast("double") * inputs[1]
    raise ValueError(f"unknown feature kind {k!r}")


def feature_columns(columns: Iterable[str], features: Iterable[FeatureDef]) -> dict[str, Column]:
    """Expressions of the features that can be derived from ``columns``."""
    present = set(columns)
    exprs: dict[str, Column] = {}
    for fd in features:
        if not all(n in present or n in exprs for n in fd.needed):
            continue
        if not all(n in present or n in exprs for n in fd.inputs):
            continue
        ins = [exprs[n] if n in exprs else c(n) for n in fd.inputs]
        exprs[fd.name] = nan_to_null(feature_expr(fd, ins))
    return exprs


def engineer_features(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Add the spec's derived features; input columns are left untouched.

    Every derived value is finite or NULL (division by zero and infinities
    become NULL, so later imputation handles them).
    """
    exprs = feature_columns(df.columns, spec.features)
    if not exprs:
        return df
    keep = [c(n) for n in df.columns if n not in exprs]
    return df.select(*keep, *[e.alias(n) for n, e in exprs.items()])
