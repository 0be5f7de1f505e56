"""File sources and sinks.

CSV is read with every column as text, every missing-value marker nulled in
one projection, then cast with ``try_cast`` to the inferred or declared
type (Spark's ``nullValue`` accepts a single string only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valora.functions.exprs import NA_MARKERS, c, marker_to_null, nan_to_null, typed_from_text
from valora.sources.registry import _fs_exists, write_json

# A quote inside a quoted field is doubled.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"'}


def _numbered(raw: DataFrame, row_id: str) -> DataFrame:
    """Adds 1..n in the order of files (by path) and of the rows in them.

    Rows are ranked within their file block and blocks are added up, so the
    numbers don't depend on how blocks are packed into tasks."""
    block = ["__path", "__start"]
    rows = raw.select("*", F.col("_metadata.file_path").alias("__path"),
                      F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("__at"))
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).select(
        *block, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    return (rows.withColumn("__rank", rank).join(offsets, block)
            .withColumn(row_id, F.col("__offset") + F.col("__rank")).drop(*block, "__at", "__rank", "__offset"))


def load_raw(spark: SparkSession, path: str, schema: T.StructType | None = None,
             markers=NA_MARKERS, infer: bool = True, row_id: str | None = None,
             multiline: bool = False) -> DataFrame:
    """A1: CSV with header; markers -> NULL; typed columns.

    With ``multiline`` quoted fields may hold line breaks; a file is then read
    by one task, so large tables should be many files.  With ``row_id`` a file without that column gets it, 1..n in file order.
    Types come from ``schema`` when given; otherwise one aggregate pass
    decides per column whether every non-null value parses as a long, else
    a double, else it stays a string.
    """
    if not _fs_exists(spark, path):
        raise FileNotFoundError(f"no CSV input under {path}")
    raw = spark.read.options(**CSV_OPTIONS).option("inferSchema", False).option("multiLine", multiline).csv(path)
    if row_id is not None and row_id not in raw.columns:
        raw = _numbered(raw, row_id).withColumn(row_id, F.col(row_id).cast("string"))
        if schema is not None and row_id not in schema.names:
            schema = T.StructType([T.StructField(row_id, T.LongType()), *schema.fields])
    if schema is not None:
        return raw.select(*[typed_from_text(f.name, f.dataType) if f.name in raw.columns
                            else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
    cleaned = raw.select(*[marker_to_null(c(x), markers).alias(x) for x in raw.columns])
    if not infer:
        return cleaned
    checks = []
    for i, x in enumerate(cleaned.columns):
        v = c(x)
        checks.append(F.bool_and(v.isNull() | F.expr(f"try_cast(`{x}` AS BIGINT)").isNotNull()).alias(f"l{i}"))
        checks.append(F.bool_and(v.isNull() | F.expr(f"try_cast(`{x}` AS DOUBLE)").isNotNull()).alias(f"d{i}"))
        checks.append(F.count(v).alias(f"n{i}"))
    row = cleaned.agg(*checks).first()
    out = []
    for i, x in enumerate(cleaned.columns):
        if row[f"n{i}"] and row[f"l{i}"]:
            out.append(F.expr(f"try_cast(`{x}` AS BIGINT)").alias(x))
        elif row[f"n{i}"] and row[f"d{i}"]:
            out.append(nan_to_null(F.expr(f"try_cast(`{x}` AS DOUBLE)")).alias(x))
        elif not row[f"n{i}"]:
            out.append(F.lit(None).cast("double").alias(x))
        else:
            out.append(c(x))
    return cleaned.select(*out)


def load_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A2: read a cleaned table back."""
    if fmt == "csv":
        return spark.read.options(**CSV_OPTIONS).option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """A3: write a table (the target stays in the row)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.options(**CSV_OPTIONS).csv(path)
    else:
        w.parquet(path)
    return path


def save_splits(cleaned: DataFrame, train: DataFrame, test: DataFrame, root: str,
                fmt: str = "parquet") -> dict[str, str]:
    """A3: cleaned, train and test tables."""
    return {name: save_table(df, f"{root}/{name}", fmt)
            for name, df in (("dataset", cleaned), ("train", train), ("test", test))}


def save_profile(tables: dict[str, DataFrame], root: str) -> dict[str, str]:
    """A4: each profile table as JSON lines; all are bounded by columns, groups
    or bins, and each becomes one file but for the point density."""
    out = {}
    for name, df in tables.items():
        (df if name == "points" else df.coalesce(1)).write.mode("overwrite").json(f"{root}/{name}")
        out[name] = f"{root}/{name}"
    return out


def save_leaderboard(board: DataFrame, path: str) -> str:
    """A5: leaderboard as one CSV with header."""
    board.orderBy("rank").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def save_summary(spark: SparkSession, summary: dict, path: str) -> str:
    """Training summary (best model, params, CV, hold-out, importance)."""
    write_json(spark, summary, path)
    return path


def score_file(spark: SparkSession, pipeline, input_path: str, output_path: str | None = None,
               id_col: str = "Id", schema: T.StructType | None = None) -> str:
    """CSV in -> predictions CSV out (``<input>_predictions`` by default)."""
    from valora.operators.score import predict
    output_path = output_path or f"{input_path.rsplit('.', 1)[0]}_predictions"
    df = load_raw(spark, input_path, schema, row_id=id_col)
    if df.limit(1).count() == 0:
        raise ValueError(f"no rows to score in {input_path}")
    predict(pipeline, df, id_col).write.mode("overwrite").option("header", True).csv(output_path)
    return output_path
