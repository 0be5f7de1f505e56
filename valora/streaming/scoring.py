"""Batch scoring of files as they arrive (A7 on Structured Streaming).

The fitted transform is a narrow projection (literal-map lookups, no joins
or aggregates) and the regressor scores row by row, so the same
``PipelineModel`` runs unchanged on a streaming source: no state, no
watermark.  Each input row must carry its id (positional ids are not
defined on an unbounded stream).  ``availableNow`` processes what is there
and stops; the checkpoint makes restarts exactly-once per file.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from valora.functions.exprs import c, typed_from_text
from valora.sources.files import CSV_OPTIONS


def score_stream(spark: SparkSession, pipeline: PipelineModel, input_dir: str, output_dir: str,
                 checkpoint: str, schema: T.StructType, id_col: str = "Id",
                 available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Read CSV files from ``input_dir`` and append ``id, predicted_price``
    parquet rows to ``output_dir``."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    reader = spark.readStream.schema(text_schema).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(input_dir)
    typed = raw.select(*[typed_from_text(f.name, f.dataType) for f in schema.fields])
    scored = pipeline.transform(typed).select(c(id_col), F.col("predicted_price"))
    writer = (scored.writeStream.format("parquet").option("path", output_dir)
              .option("checkpointLocation", checkpoint).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
