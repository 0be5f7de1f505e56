"""Group medians beside the model, counts as by-products, versions claimed by
several writers, checked streams, quoted line breaks."""

import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from valora.operators import clean, encode
from valora.operators.encode import Preprocessor, PreprocessorModel
from valora.sources import registry
from valora.sources.files import load_raw
from valora.spec import SALES_SPEC, ColumnSpec
from valora.streaming.quarantine import check_stream, write_checked

SPEC = ColumnSpec(name="g", id_col="id", target_col="none", numeric=("v", "k"), group_impute=("v", "grp"))


def test_a_million_groups(spark, scratch, monkeypatch):
    """Fitted, saved, loaded and applied without the groups on the driver."""
    rows = spark.range(0, 2_000_000, 1, 8).select(
        "id", F.when(F.col("id") % 4 != 0, (F.col("id") % 1000).cast("double")).alias("v"),
        F.concat(F.lit("g"), F.floor(F.col("id") / 2)).alias("grp"), (F.col("id") % 3).cast("double").alias("k"))
    collect, most = DataFrame.collect, []

    def counted(self):
        out = collect(self)
        most.append(len(out))
        return out

    monkeypatch.setattr(DataFrame, "collect", counted)
    model = Preprocessor(SPEC, scale=False).fit(rows)
    assert max(most) <= encode._LITERAL_MAP_MAX + 1 and len(model.getOrDefault(model.statsJson)) < 10_000
    model.write().overwrite().save(f"{scratch}/million")
    again = PreprocessorModel.load(f"{scratch}/million")
    assert again.stats["group_table"] == f"{scratch}/million/groups"
    out = again.transform_columns(rows, keep=["id"])
    # id 4m lacks v; its group is that of 4m and 4m + 1
    wrong = out.where(F.when(F.col("id") % 4 == 0, F.col("v") != (F.col("id") + 1) % 1000).otherwise(F.col("v") != F.col("id") % 1000))
    assert out.count() == 2_000_000 and wrong.count() == 0


def test_few_and_many_groups_are_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), None if i % 11 == 0 else f"g{i % 9}", 1.0) for i in range(200)],
                                 "id long, v double, grp string, k double")
    few = Preprocessor(SPEC, scale=True).fit(rows)
    monkeypatch.setattr(encode, "_LITERAL_MAP_MAX", 3)
    many = Preprocessor(SPEC, scale=True).fit(rows)
    assert few.stats["group_map"] and not few.stats["group_table"] and many.stats["group_table"] and not many.stats["group_map"]
    show = lambda m: sorted(map(tuple, m.transform_columns(rows, keep=["id"]).collect()))
    assert show(few) == show(many)


def test_counts_come_from_the_one_pass(spark):
    runs = spark.sparkContext.accumulator(0)

    def tally(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    rows = spark.range(0, 1000, 1, 3).mapInArrow(tally, "id long")
    out, counts = clean.clean_and_count(rows, lambda df: df.where("id % 4 = 0"))
    assert tuple(counts.first()) == (1000, 250, 25.0) and out.count() == 250 and runs.value == 1000
    empty = clean.clean_and_count(spark.range(0), lambda df: df)[1].first()
    assert tuple(empty) == (0, 0, 0.0)


def test_versions_are_claimed_once(spark, scratch):
    with ThreadPoolExecutor(8) as ex:
        got = list(ex.map(lambda _: registry.claim_version(spark, f"{scratch}/claims", "m"), range(24)))
    assert sorted(got) == list(range(1, 25))


def test_stream_of_checked_rows(spark, scratch):
    """Several batches; one of them replayed leaves the same rows."""
    column, (low, high) = next(iter(SALES_SPEC.range_checks.items()))
    schema = spark.createDataFrame([], f"o_orderkey long, `{column}` double").schema
    root = f"{scratch}/stream"
    for part in range(3):
        rows = spark.range(part * 10, part * 10 + 10).select(
            F.col("id").alias("o_orderkey"), F.when(F.col("id") % 5 == 0, float(high) + 1).otherwise(float(low)).alias(column))
        rows.coalesce(1).write.mode("append").option("header", True).csv(f"{root}/in")
    check_stream(spark, f"{root}/in", f"{root}/ok", f"{root}/bad", f"{root}/state", schema, SALES_SPEC,
                 max_files_per_trigger=1).awaitTermination()

    def keys(k):
        return sorted(r["o_orderkey"] for r in spark.read.parquet(f"{root}/{k}").collect())

    assert len([f for f in os.listdir(f"{root}/ok") if f.startswith("batch=")]) == 3
    assert keys("bad") == [i for i in range(30) if i % 5 == 0] and keys("ok") == [i for i in range(30) if i % 5]
    again = spark.read.parquet(f"{root}/ok/batch=1").unionByName(spark.read.parquet(f"{root}/bad/batch=1"))
    again = spark.createDataFrame(again.collect(), again.schema)
    write_checked(SALES_SPEC, f"{root}/ok", f"{root}/bad")(again.select(schema.names), 1)
    assert keys("bad") == [i for i in range(30) if i % 5 == 0] and keys("ok") == [i for i in range(30) if i % 5]


def test_quoted_line_breaks(spark, scratch):
    path = f"{scratch}/breaks.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write('id,note\n1,"two\nlines, quoted"\n2,plain\n')
    assert [tuple(r) for r in load_raw(spark, path, multiline=True).orderBy("id").collect()] == [(1, "two\nlines, quoted"), (2, "plain")]
    with pytest.raises(FileNotFoundError):
        load_raw(spark, f"{scratch}/no-such.csv")
