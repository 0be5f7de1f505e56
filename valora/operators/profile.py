"""Profile tables (F1-F13): shape, target statistics, missing values,
correlations, histograms, grouped box statistics and medians.

Each function returns a DataFrame.  Whole-table statistics are single
aggregates (map-side partial aggregation, one row out); grouped medians and
quartiles go through the bounded exact-quantile operator.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.exprs import c, floats_to_null, nan_to_null, numeric_columns, string_columns
from valora.operators.quantiles import medians, quantiles
from valora.spec import SETTINGS, ColumnSpec, Settings


def shape(df: DataFrame) -> DataFrame:
    """F1 + F12: rows, columns, numeric and string column counts."""
    n_num = len(numeric_columns(df))
    n_str = len(string_columns(df))
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(len(df.columns)).cast("long").alias("columns"),
        F.lit(n_num).cast("long").alias("n_numeric"), F.lit(n_str).cast("long").alias("n_categorical"))


def dtype_counts(df: DataFrame) -> DataFrame:
    """column count by type (schema only)."""
    counts: dict[str, int] = {}
    for f in df.schema.fields:
        counts[f.dataType.simpleString()] = counts.get(f.dataType.simpleString(), 0) + 1
    return df.sparkSession.createDataFrame(sorted(counts.items()), "dtype string, n long")


def target_stats(df: DataFrame, target: str, settings: Settings = SETTINGS) -> DataFrame:
    """mean, median, sample std, min, max, bias-corrected skewness."""
    t = nan_to_null(c(target).cast("double"))
    med = medians(df, [target], settings).get(target)
    n = F.count(t)
    g1 = F.skewness(t)
    corrected = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    return df.agg(
        F.avg(t).alias("mean"),
        F.lit(med).cast("double").alias("median"),
        F.stddev_samp(t).alias("std"),
        F.min(t).alias("min"),
        F.max(t).alias("max"),
        corrected.alias("skew"),
    )


def missing_values(df: DataFrame) -> DataFrame:
    """F3 + F4: missing count (null or NaN) and percentage per column, >0 only,
    descending."""
    df = floats_to_null(df)
    total = F.count(F.lit(1))
    row = df.agg(total.alias("__n"), *[F.count_if(c(x).isNull()).alias(f"m{i}")
                                       for i, x in enumerate(df.columns)])
    arr = F.array(*[F.struct(F.lit(x).alias("column"), F.col(f"m{i}").alias("n_missing"))
                    for i, x in enumerate(df.columns)])
    return (row.select("__n", F.inline(arr))
            .where(F.col("n_missing") > 0)
            .select("column", "n_missing",
                    F.bround(F.col("n_missing") * 100.0 / F.col("__n"), 2).alias("pct_missing"))
            .orderBy(F.desc("n_missing"), "column"))


def pairwise_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson correlation per pair over rows where both are non-null:
    ``a, b, corr`` (NULL when a side has no variance).

    Two passes whatever the number of columns: the means, then per Arrow batch
    four matrix products over mean-shifted values and their null masks (counts,
    sums, squares, cross products of all pairs at once), added up per cell.
    Shifting by the mean keeps the sums free of cancellation.
    """
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    cols = list(dict.fromkeys([x for p in pairs for x in p]))
    src = df.select(*[nan_to_null(c(x).cast("double")).alias(f"v{i}") for i, x in enumerate(cols)])
    means = src.agg(*[F.avg(f"v{i}") for i in range(len(cols))]).first()
    shift = np.array([m or 0.0 for m in means])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, len(shift), len(shift)))
        for b in batches:
            x = np.column_stack([col.to_numpy(zero_copy_only=False) for col in b.columns]) if b.num_rows else np.zeros((0, len(shift)))
            there = ~np.isnan(x)
            z, m = np.where(there, x - shift, 0.0), there.astype(float)
            total += np.stack([m.T @ m, z.T @ m, (z * z).T @ m, z.T @ z])
        at = np.indices(total.shape[1:]).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                                          *[pa.array(t.reshape(-1)) for t in total]], names=["i", "j", "n", "s", "q", "p"])

    cells = src.mapInArrow(products, "i int, j int, n double, s double, q double, p double")
    sums = {(r["i"], r["j"]): r for r in cells.groupBy("i", "j").agg(
        *[F.sum(x).alias(x) for x in ("n", "s", "q", "p")]).collect()}  # one row per pair of columns
    place = {x: i for i, x in enumerate(cols)}
    out = []
    for a, b in pairs:
        ab, ba = sums[place[a], place[b]], sums[place[b], place[a]]
        n, corr = ab["n"], None
        if n > 1:
            va, vb = ab["q"] - ab["s"] ** 2 / n, ba["q"] - ba["s"] ** 2 / n
            if va > 0 and vb > 0:
                corr = max(-1.0, min(1.0, (ab["p"] - ab["s"] * ba["s"] / n) / math.sqrt(va * vb)))
        out.append((a, b, corr))
    return df.sparkSession.createDataFrame(out, "a string, b string, corr double")


def correlations(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson matrix, pairwise-complete, long form ``a, b, corr``.

    The upper triangle comes from :func:`pairwise_correlations`; the lower
    triangle by symmetry; a diagonal cell is 1 unless the column has no
    variance.
    """
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    upper = pairwise_correlations(df, pairs)
    diag = F.col("a") == F.col("b")
    upper = upper.select("a", "b", F.when(diag & F.col("corr").isNotNull(), F.lit(1.0))
                         .when(diag, F.lit(None)).otherwise(F.col("corr")).alias("corr"))
    lower = upper.where(~diag).select(F.col("b").alias("a"), F.col("a").alias("b"), "corr")
    return upper.unionByName(lower)


def target_correlations(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``feature, corr, abs_corr`` of every numeric column with the target."""
    cols = [x for x in (cols or numeric_columns(df)) if x != target]
    pc = pairwise_correlations(df, [(x, target) for x in cols])
    return pc.select(F.col("a").alias("feature"), "corr", F.abs("corr").alias("abs_corr"))


def top_correlations(df: DataFrame, target: str, k: int = 20, cols: Sequence[str] | None = None) -> DataFrame:
    """top ``k`` absolute correlations with the target, 4 decimals."""
    tc = target_correlations(df, target, cols).where(F.col("abs_corr").isNotNull())
    return (tc.orderBy(F.desc("abs_corr"), "feature").limit(k)
            .select("feature", F.round("abs_corr", 4).alias("abs_corr")))


def correlation_submatrix(df: DataFrame, target: str, k: int = 15,
                          cols: Sequence[str] | None = None) -> DataFrame:
    """correlation matrix of the target and its top ``k`` columns."""
    top = [r["feature"] for r in top_correlations(df, target, k, cols).collect()]
    return correlations(df, [target] + top)


def histogram(df: DataFrame, col: str, bins: int = 30, log: bool = False) -> DataFrame:
    """F8: equal-width histogram over [min, max]: ``bin, lo, hi, n``."""
    v = nan_to_null(c(col).cast("double"))
    if log:
        v = F.log1p(v)
    vals = df.select(v.alias("v")).where(F.col("v").isNotNull())
    mm = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(bins))
    counts = vals.select(b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("bin", (F.lit(lo) + (F.col("bin") - 1) * F.lit(width)).alias("lo"),
                         (F.lit(lo) + F.col("bin") * F.lit(width)).alias("hi"), "n")


def box_stats(df: DataFrame, target: str, by: str, settings: Settings = SETTINGS) -> DataFrame:
    """per group quartiles, whiskers (extreme values inside the 1.5 IQR
    fences) and the number of points outside them."""
    q = quantiles(df, [target], [0.25, 0.5, 0.75], [by], settings)
    wide = q.groupBy(by).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("p") == 0.75, F.col("value"))).alias("q3"))
    wide = wide.withColumn("iqr", F.col("q3") - F.col("q1"))
    m = settings.iqr_multiplier
    v = nan_to_null(c(target).cast("double"))
    j = (df.select(c(by).alias("_g"), v.alias("_v")).where(F.col("_v").isNotNull())
         .join(wide, F.col("_g") == c(by)))
    lo_f = F.col("q1") - m * F.col("iqr")
    hi_f = F.col("q3") + m * F.col("iqr")
    return j.groupBy(c(by), "q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("_v") >= lo_f, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= hi_f, F.col("_v"))).alias("whisker_hi"),
        F.count_if((F.col("_v") < lo_f) | (F.col("_v") > hi_f)).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )


def median_by_group(df: DataFrame, target: str, by: str, settings: Settings = SETTINGS) -> DataFrame:
    """median target per group, descending."""
    q = quantiles(df, [target], [0.5], [by], settings)
    return q.select(c(by), F.col("value").alias("median_target")).orderBy(F.desc("median_target"), c(by))


def point_density(df: DataFrame, x: str, y: str, color: str, bins: int = 50) -> DataFrame:
    """all points as counts per (x bin, y bin, color), with the extremes of
    each cell; what a plot can show of any number of rows."""
    cols = [nan_to_null(c(x).cast("double")).alias("x"), nan_to_null(c(y).cast("double")).alias("y")]
    v = df.select(*cols, c(color).alias(color)).where("x IS NOT NULL AND y IS NOT NULL")
    m = v.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()

    def cell(name: str, lo: float | None, hi: float | None) -> Column:
        lo, hi = lo or 0.0, hi or 0.0
        width = (hi - lo) / bins if hi > lo else 1.0
        return F.least(F.floor((F.col(name) - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(bins))

    return v.groupBy(cell("x", m[0], m[1]).alias("x_bin"), cell("y", m[2], m[3]).alias("y_bin"), c(color)).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        F.min("y").alias("y_min"), F.max("y").alias("y_max"))


def profile(df: DataFrame, spec: ColumnSpec, settings: Settings = SETTINGS,
            bins: int = 30) -> dict[str, DataFrame]:
    """the whole report as named tables."""
    t = spec.target_col
    out = {
        "shape": shape(df),
        "dtypes": dtype_counts(df),
        "target": target_stats(df, t, settings),
        "missing": missing_values(df),
        "top_correlations": top_correlations(df, t, 20),
        "correlation_matrix": correlation_submatrix(df, t, 15),
        "target_histogram": histogram(df, t, bins),
        "log_target_histogram": histogram(df, t, bins, log=True),
    }
    if spec.box_group and spec.box_group in df.columns:
        out["target_by_group"] = box_stats(df, t, spec.box_group, settings)
    if spec.group_impute and spec.group_impute[1] in df.columns:
        out["median_by_group"] = median_by_group(df, t, spec.group_impute[1], settings)
    if spec.scatter and all(x in df.columns for x in spec.scatter):
        out["points"] = point_density(df, *spec.scatter)
    return out
