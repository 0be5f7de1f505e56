"""Projections, known-error removal, capping, winsorizing and imputation.

All statistics of one phase are gathered in as few jobs as possible (one
null-count pass, one quantile pass, one value-count pass); the results are
small dictionaries folded into a single projection as literals.  Group
statistics are joined back instead of a window over possibly skewed groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from valora.functions.exprs import c, clip, floats_to_null, nan_to_null, numeric_columns, string_columns
from valora.operators.quantiles import group_medians, modes, quantile_dict
from valora.session import cut_lineage
from valora.spec import SETTINGS, ColumnSpec, Settings


# ---------------------------------------------------------------- projections

def drop_columns(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """B1: drop the listed columns that exist."""
    present = [x for x in cols if x in df.columns]
    return df.drop(*present) if present else df


def keep_existing(df: DataFrame, cols: Iterable[str]) -> list[str]:
    """B2: the listed columns that exist, in list order."""
    have = set(df.columns)
    return [x for x in cols if x in have]


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename for a result view (absent names are ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in a stated order (a top-k report)."""
    return (df.orderBy(*[c(x) for x in order_by]) if order_by else df).limit(n)


def absent_coded_columns(df: DataFrame, spec: ColumnSpec) -> dict[str, bool]:
    """Listed absence-coded columns that hold a null or the text "None"."""
    cols = keep_existing(df, spec.none_fill_categorical)
    if not cols:
        return {}
    row = df.agg(*[
        F.coalesce(F.bool_or(F.coalesce(c(x).cast("string"), F.lit("None")) == "None"), F.lit(False))
        .alias(x) for x in cols
    ]).first()
    return {x: bool(row[x]) for x in cols}


def absent_coded_table(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """B11 as a table ``column, has_absent`` (one aggregate pass)."""
    cols = keep_existing(df, spec.none_fill_categorical)
    flags = [F.coalesce(F.bool_or(F.coalesce(c(x).cast("string"), F.lit("None")) == "None"),
                        F.lit(False)).alias(f"k{i}") for i, x in enumerate(cols)]
    arr = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"k{i}").alias("has_absent"))
                    for i, x in enumerate(cols)])
    return df.agg(*flags).select(F.inline(arr))


# ------------------------------------------------------------------- outliers

def drop_known_errors(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """Drop ``col > a AND target < b``; only with a target; nulls keep."""
    ke = spec.known_error
    if ke is None or spec.target_col not in df.columns or ke.column not in df.columns:
        return df
    value, target = (nan_to_null(c(x).cast("double")) for x in (ke.column, spec.target_col))
    bad = (value > F.lit(ke.above)) & (target < F.lit(ke.target_below))
    return df.where(~F.coalesce(bad, F.lit(False)))


def cap_columns(df: DataFrame, caps: dict[str, float]) -> DataFrame:
    """Cap columns above at a constant; nulls stay null."""
    todo = {k: v for k, v in caps.items() if k in df.columns}
    if not todo:
        return df
    return df.withColumns({k: clip(c(k), hi=v) for k, v in todo.items()})


@dataclass
class OutlierBounds:
    """Winsorizing bounds fitted on one frame and applicable to any other."""

    tails: dict[str, tuple[float, float]] = field(default_factory=dict)
    target_cap: float | None = None
    target_col: str | None = None

    def to_json(self) -> dict:
        return {"tails": {k: list(v) for k, v in self.tails.items()},
                "target_cap": self.target_cap, "target_col": self.target_col}


def fit_outlier_bounds(df: DataFrame, spec: ColumnSpec, settings: Settings = SETTINGS) -> OutlierBounds:
    """Quartiles of the tail columns and of the target, in one pass."""
    tails = keep_existing(df, spec.tail_cols)
    target = spec.target_col if spec.target_col in df.columns else None
    cols = tails + ([target] if target and target not in tails else [])
    q = quantile_dict(df, cols, [0.25, 0.75], settings)
    bounds = OutlierBounds(target_col=target)
    m = settings.iqr_multiplier
    for x in tails:
        q1, q3 = q[x]
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        bounds.tails[x] = (q1 - m * iqr, q3 + m * iqr)
    if target:
        q1, q3 = q[target]
        if q1 is not None and q3 is not None:
            bounds.target_cap = q3 + settings.target_iqr_multiplier * (q3 - q1)
    return bounds


def apply_outlier_bounds(df: DataFrame, bounds: OutlierBounds, keep_flags: bool = False) -> DataFrame:
    """Clip tails to their fences (optionally flag), cap the target above.

    Flag deviation: a null value is not flagged (the pandas original flags
    nulls because NaN differs from itself).
    """
    exprs: dict[str, Column] = {}
    for x, (lo, hi) in bounds.tails.items():
        if x not in df.columns:
            continue
        clipped = clip(c(x), lo=lo, hi=hi)
        if keep_flags:
            exprs[f"{x}_was_outlier"] = (~c(x).eqNullSafe(clipped)).cast("int")
        exprs[x] = clipped
    if bounds.target_cap is not None and bounds.target_col in df.columns:
        exprs[bounds.target_col] = clip(c(bounds.target_col), hi=bounds.target_cap)
    return df.withColumns(exprs) if exprs else df


def remove_outliers(df: DataFrame, spec: ColumnSpec, settings: Settings = SETTINGS,
                    keep_flags: bool = False, fit_on: DataFrame | None = None) -> DataFrame:
    """B3 -> B4 -> B5/B6 -> B7.

    Bounds are fitted on the cleaned frame itself (parity) or, with
    ``fit_on``, on another frame (e.g. training rows only) after the same
    B3/B4 steps.
    """
    out = cap_columns(drop_known_errors(floats_to_null(df), spec), spec.caps)
    base = out if fit_on is None else cap_columns(drop_known_errors(floats_to_null(fit_on), spec), spec.caps)
    return apply_outlier_bounds(out, fit_outlier_bounds(base, spec, settings), keep_flags)


def clean_and_count(df: DataFrame, clean: Callable[[DataFrame], DataFrame],
                    store: Callable[[DataFrame], DataFrame] = cut_lineage) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, stored once by ``store``, and a one-row table of
    rows before, after and percent kept.  Both counts are by-products of the
    pass that stores the rows; where ``clean`` makes passes of its own first,
    hand it a frame to fit on (``fit_on``)."""
    seen, kept = Observation(), Observation()
    one = F.count(F.lit(1)).alias("n")
    out = store(clean(df.observe(seen, one)).observe(kept, one))
    before, after = seen.get["n"], kept.get["n"]
    return out, out.sparkSession.range(1).select(
        F.lit(before).cast("long").alias("rows_before"), F.lit(after).cast("long").alias("rows_after"),
        F.round(F.lit(after) * 100.0 / F.lit(max(before, 1)), 1).alias("pct_kept"))


# ----------------------------------------------------------------- imputation

def fill_absent(df: DataFrame, spec: ColumnSpec) -> DataFrame:
    """C1 + C2: absence-coded categories -> "None", absent numbers -> 0.0."""
    exprs: dict[str, Column] = {}
    for x in keep_existing(df, spec.none_fill_categorical):
        exprs[x] = F.coalesce(c(x).cast("string"), F.lit("None"))
    for x in keep_existing(df, spec.none_fill_numeric):
        exprs[x] = F.coalesce(nan_to_null(c(x).cast("double")), F.lit(0.0))
    return df.withColumns(exprs) if exprs else df


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, int]:
    """Nulls per column, plus the row count under the key ``None``."""
    cols = list(cols if cols is not None else df.columns)
    row = df.agg(F.count(F.lit(1)).alias("__rows"),
                 *[F.count_if(c(x).isNull()).alias(f"n{i}") for i, x in enumerate(cols)]).first()
    out: dict = {x: int(row[f"n{i}"]) for i, x in enumerate(cols)}
    out[None] = int(row["__rows"])
    return out


def attach_group_value(df: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """Left-join a per-group value; Spark broadcasts the group table if its
    measured size is small, and splits hot groups otherwise."""
    t = table.select(c(key).alias("_gk"), c(value).alias(value))
    return df.join(t, c(key) == F.col("_gk"), "left").drop("_gk")


def fill_group_median(df: DataFrame, col: str, by: str, settings: Settings = SETTINGS,
                      fallback: float | None = None, compute_fallback: bool = False,
                      row_bound: int | None = None) -> DataFrame:
    """Nulls -> median of the row's group, else the overall median.

    Both medians are taken before filling.  The per-group table is joined
    back rather than computed with a window, which would put each, possibly
    huge, group into one task.
    """
    if compute_fallback:
        fallback = quantile_dict(df, [col], [0.5], settings, row_bound=row_bound)[col][0]
    gm = cut_lineage(group_medians(df, col, [by], settings, row_bound=row_bound))
    small = gm.limit(_LITERAL_GROUPS + 1).collect()
    if len(small) <= _LITERAL_GROUPS:
        # few groups: a literal map lookup, no join at all
        lookup = _literal_lookup({r[by]: r["median"] for r in small if r[by] is not None}, c(by))
        out = df.withColumn("_gmed", lookup)
    else:
        # stored once: later passes over the filled rows don't join them again
        out = cut_lineage(attach_group_value(df, gm.withColumnRenamed("median", "_gmed"), by, "_gmed"))
    filled = F.coalesce(nan_to_null(c(col).cast("double")), F.col("_gmed"))
    if fallback is not None:
        filled = F.coalesce(filled, F.lit(float(fallback)))
    return out.withColumn(col, filled).drop("_gmed").select(*[c(x) for x in df.columns])


_LITERAL_GROUPS = 5_000


def _literal_lookup(mapping: dict, key: Column) -> Column:
    if not mapping:
        return F.lit(None).cast("double")
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v).cast("double")]
    return F.element_at(F.create_map(*kv), key)


def fill_missing_values(df: DataFrame, spec: ColumnSpec, settings: Settings = SETTINGS) -> DataFrame:
    """C1-C5 on one frame (statistics taken from the frame itself)."""
    out = fill_absent(floats_to_null(df), spec)
    cols = out.columns
    nulls = null_counts(out)
    gi = spec.group_impute
    gi_col = gi[0] if gi and gi[0] in cols and gi[1] in cols else None

    num = numeric_columns(out)
    num_fill = [x for x in num if nulls[x] > 0 and x != gi_col]
    want = num_fill + ([gi_col] if gi_col else [])
    rows = nulls[None]
    med = {k: v[0] for k, v in quantile_dict(out, want, [0.5], settings, row_bound=rows).items()}

    if gi_col and nulls[gi_col] > 0:
        out = fill_group_median(out, gi_col, gi[1], settings, fallback=med.get(gi_col), row_bound=rows)

    strs = [x for x in string_columns(out) if nulls.get(x, 0) > 0]
    mode = modes(out, strs)
    num_values = {x: med[x] for x in num_fill if med.get(x) is not None}
    if num_values or mode:
        out = out.withColumns({
            **{x: F.coalesce(c(x).cast("double"), F.lit(float(v))) for x, v in num_values.items()},
            **{x: F.coalesce(c(x), F.lit(v)) for x, v in mode.items()},
        })
    return out.select(*[c(x) for x in cols])


def add_missing_columns(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add known columns absent from the input, each at its given value."""
    missing = {k: v for k, v in defaults.items() if k not in df.columns}
    return df.withColumns(missing) if missing else df
