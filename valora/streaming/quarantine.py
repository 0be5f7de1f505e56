"""Scoring schema and range check on a stream (A10, A11): one read, two sinks.

Every micro-batch is marked once and written to two tables, the rows that pass
and the quarantined rest.  Each batch owns the folder ``batch=<id>`` of both and
overwrites it, so a batch that is replayed after a failure between the two
writes, or after both, leaves the same rows as one run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from valora.functions.exprs import typed_from_text
from valora.sources.files import CSV_OPTIONS
from valora.sources.records import apply_scoring_schema
from valora.spec import ColumnSpec


def write_checked(spec: ColumnSpec, valid_dir: str, quarantine_dir: str) -> Callable[[DataFrame, int], None]:
    """The work on one micro-batch."""
    def write(batch: DataFrame, number: int) -> None:
        marked = apply_scoring_schema(batch, spec, drop_unset=False).persist()
        try:
            for folder, rows in ((valid_dir, marked.where("valid")), (quarantine_dir, marked.where(~F.col("valid")))):
                rows.drop("valid").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        finally:
            marked.unpersist()
    return write


def check_stream(spark: SparkSession, input_dir: str, valid_dir: str, quarantine_dir: str, checkpoint: str,
                 schema: T.StructType, spec: ColumnSpec, available_now: bool = True,
                 max_files_per_trigger: int | None = None) -> StreamingQuery:
    """CSV files of ``input_dir``, as they arrive, into valid and quarantined rows."""
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    reader = spark.readStream.schema(text_schema).options(**CSV_OPTIONS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    typed = reader.csv(input_dir).select(*[typed_from_text(f.name, f.dataType) for f in schema.fields])
    writer = (typed.writeStream.foreachBatch(write_checked(spec, valid_dir, quarantine_dir))
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
