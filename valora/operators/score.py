"""Scoring (L1-L5): fitted transform + regressor + inverse target.

``predict`` is one narrow stage: scan -> literal-map imputation and
encoding -> model -> price.  Row ids come from the input's id column; only
when it is missing are ids 1..n assigned, in the order of the input's
partitions, or of files and their rows with ``files.load_raw(row_id=...)``.
"""

from __future__ import annotations

from pyspark.ml import Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.functions.exprs import c
from valora.operators.encode import PreprocessorModel
from valora.operators.explain import attributions, local_explanations
from valora.session import cut_lineage


class PriceFromLog(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """prediction -> price with 2 decimals: clamped at 0 and ``expm1`` if the
    model was fitted on ``log1p`` of the target, as it is otherwise."""

    inputCol = Param(Params._dummy(), "inputCol", "prediction", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "price", typeConverter=TypeConverters.toString)
    logTarget = Param(Params._dummy(), "logTarget", "fitted on log1p", typeConverter=TypeConverters.toBoolean)

    def __init__(self, inputCol: str = "prediction", outputCol: str = "predicted_price", logTarget: bool = True):
        super().__init__()
        self._setDefault(inputCol="prediction", outputCol="predicted_price", logTarget=True)
        self._set(inputCol=inputCol, outputCol=outputCol, logTarget=logTarget)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.col(self.getOrDefault(self.inputCol))
        if self.getOrDefault(self.logTarget):
            p = F.expm1(F.greatest(p, F.lit(0.0)))
        return df.withColumn(self.getOrDefault(self.outputCol), F.bround(p, 2))


def with_row_index(df: DataFrame, col: str = "Id", start: int = 1) -> DataFrame:
    """Consecutive ids in the input's partition order without a global window.

    The rows are written once, so that counting and numbering see the same
    partitions; one count per partition is summed up and joined back.
    """
    marked = cut_lineage(df.withColumn("__pid", F.spark_partition_id())
                         .withColumn("__mid", F.monotonically_increasing_id()))
    counts = marked.groupBy("__pid").agg(F.count(F.lit(1)).alias("n"), F.min("__mid").alias("__first"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    idx = F.col("__offset") + F.col("__mid") - F.col("__first") + F.lit(start)
    return (marked.join(F.broadcast(offsets), "__pid")  # one row per partition
            .withColumn(col, idx.cast("long")).drop("__pid", "__mid", "__first", "__offset"))


def raw_pipeline(prep: PreprocessorModel, regressor_model, log_target: bool = True) -> PipelineModel:
    """Raw columns in, ``predicted_price`` out, as one ``PipelineModel``."""
    return PipelineModel(stages=[prep, regressor_model, PriceFromLog(logTarget=log_target)])


def predict(pipeline: PipelineModel, df: DataFrame, id_col: str = "Id") -> DataFrame:
    """L1/L3: ``id, predicted_price`` for every input row."""
    src = df if id_col in df.columns else with_row_index(df, id_col)
    return pipeline.transform(src).select(c(id_col), F.col("predicted_price").cast("double"))


def predict_with_explanation(pipeline: PipelineModel, df: DataFrame, means: list[float] | None = None,
                             id_col: str = "Id", model_name: str = "best_model", top: int = 15) -> DataFrame:
    """L2: prediction, base value and top attributions per row, plus the model
    name; ``means`` are needed by linear models only."""
    prep, reg = pipeline.stages[0], pipeline.stages[1]
    src = df if id_col in df.columns else with_row_index(df, id_col)
    scored = pipeline.transform(src)
    out = local_explanations(attributions(reg, scored, means), prep.feature_names, top)
    return out.select(c(id_col), F.col("predicted_price"), "base_value", "explanation",
                      F.lit(model_name).alias("model"))


class LazyScorer:
    """L4: loads a saved model once, on first use."""

    def __init__(self, path: str):
        self.path = path
        self._pipeline: PipelineModel | None = None
        self.metadata: dict = {}

    def load(self) -> LazyScorer:
        if self._pipeline is None:
            from valora.sources.registry import load_artifacts
            art = load_artifacts(self.path)
            self._pipeline, self.metadata = art["pipeline"], art["metadata"]
        return self

    def is_loaded(self) -> bool:
        return self._pipeline is not None

    def predict(self, df: DataFrame, id_col: str = "Id") -> DataFrame:
        return predict(self.load()._pipeline, df, id_col)


__all__ = ["PriceFromLog", "with_row_index", "raw_pipeline", "predict", "predict_with_explanation",
           "LazyScorer", "Pipeline", "Model"]
