"""Regression metrics (J1-J4) as single-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.exprs import c
from valora.operators.quantiles import quantile_dict


def _r2(y: Column, e: Column) -> Column:
    ss_res = F.sum(e * e)
    ss_tot = F.var_pop(y) * F.count(y)
    return F.when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))) \
        .otherwise(F.lit(1.0) - ss_res / ss_tot)


def regression_metric_exprs(y: Column, p: Column) -> list[Column]:
    """RMSE, MAE (2 decimals), R2 (4), MAPE % (3), price scale."""
    e = y - p
    return [
        F.round(F.sqrt(F.avg(e * e)), 2).alias("rmse"),
        F.round(F.avg(F.abs(e)), 2).alias("mae"),
        F.round(_r2(y, e), 4).alias("r2"),
        F.round(F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(1.0))) * 100.0, 3).alias("mape_pct"),
    ]


def log_metric_exprs(y: Column, p_log: Column) -> list[Column]:
    """RMSE (5 decimals) and R2 (4) on the log1p scale."""
    ly = F.log1p(y)
    e = ly - p_log
    return [F.round(F.sqrt(F.avg(e * e)), 5).alias("rmse_log"),
            F.round(_r2(ly, e), 4).alias("r2_log")]


def regression_metrics(df: DataFrame, y: str, pred: str) -> DataFrame:
    return df.agg(*regression_metric_exprs(c(y).cast("double"), c(pred).cast("double")))


def merged_metrics(df: DataFrame, y: str, pred: str, log_target: bool = True) -> DataFrame:
    """J1 on the price scale and J2 on the log scale, one pass.  ``pred`` is
    on the log1p scale, or on the price scale with ``log_target=False``."""
    yy, p = c(y).cast("double"), c(pred).cast("double")
    price, logged = (F.expm1(p), p) if log_target else (p, F.log1p(F.greatest(p, F.lit(0.0))))
    return df.agg(*regression_metric_exprs(yy, price), *log_metric_exprs(yy, logged))


def diagnostics(df: DataFrame, id_col: str, y: str, pred: str) -> DataFrame:
    """Actual, predicted and residual per row."""
    return df.select(c(id_col), c(y).cast("double").alias("actual"),
                     c(pred).cast("double").alias("predicted"),
                     (c(y) - c(pred)).cast("double").alias("residual"))


def residual_deciles(df: DataFrame, y: str, pred: str, bins: int = 10) -> DataFrame:
    """Rows, mean actual, mean predicted and RMSE per decile of the
    prediction; a value at a decile belongs to the bin below it."""
    cuts = quantile_dict(df, [pred], [i / bins for i in range(1, bins)])[pred]
    b = F.lit(1)
    for x in cuts:
        b = b + F.when(c(pred) > F.lit(x), 1).otherwise(0)
    e = c(y) - c(pred)
    return df.where(c(pred).isNotNull()).groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(c(y)).alias("mean_actual"),
        F.avg(c(pred)).alias("mean_predicted"), F.sqrt(F.avg(e * e)).alias("rmse"))
