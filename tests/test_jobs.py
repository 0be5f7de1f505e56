import os

from valora.operators.models import LINEAR
from valora.plans.jobs import load_and_split, run_training
from valora.sources import registry
from valora.spec import HOUSE_SPEC as H


def test_load_and_split_writes_tables(spark, house, scratch):
    out = os.path.join(scratch, "m1")
    cleaned, train, test, report = load_and_split(house, H, out_root=f"{out}/data", profile_root=f"{out}/profile")
    assert train.count() + test.count() == cleaned.count()
    assert {"shape", "target", "missing", "top_correlations", "target_by_group"} <= set(report)
    assert spark.read.parquet(f"{out}/data/train").count() == train.count()
    t = spark.read.json(f"{out}/profile/target").first()
    assert t["min"] <= t["median"] <= t["max"]


def test_run_training_end_to_end(spark, house_signal, scratch):
    root = os.path.join(scratch, "m2")
    summary = run_training(spark, house_signal, H, tune=True, n_trials=2, families=LINEAR,
                           artifacts_root=f"{root}/artifacts", registry_root=f"{root}/registry")
    assert summary["best_model"] in LINEAR
    assert summary["holdout_metrics"]["r2"] > 0.5
    assert len(summary["importance"]) > 0
    art = registry.load_artifacts(summary["artifacts_dir"])
    assert art["metadata"]["n_test"] > 0
    board = spark.read.option("header", True).csv(f"{root}/artifacts/reports/model_leaderboard")
    assert board.count() == 3
    assert registry.list_versions(spark, f"{root}/registry", "price_model").count() == 1


def test_cli_profile_sales(spark, scratch):
    from valora.plans.cli import main
    out = os.path.join(scratch, "cli_profile")
    assert main(["profile", "--spec", "sales", "--sf-dir", "/root/testdata/sf0.001", "--out", out]) == 0
    assert spark.read.json(f"{out}/median_by_group").count() == 25


def counted(df):
    """``df``, and an accumulator of the rows that have been computed."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(each, df.schema), seen


def test_load_and_split_computes_its_rows_once(spark, house, scratch):
    raw, seen = counted(house)
    cleaned, train, test, _ = load_and_split(raw, H, out_root=os.path.join(scratch, "once"), skip_profile=True)
    assert seen.value == house.count() and cleaned.count() == train.count() + test.count()


def test_missing_nan_fill_computes_its_rows_once(spark, monkeypatch):
    from valora.plans import queries
    rows = queries._sales_nan(spark, "/root/testdata/sf0.001").cache()
    raw, seen = counted(rows)
    monkeypatch.setattr(queries, "_sales_nan", lambda *a: raw)
    assert queries.q_nan_fill(spark, "").count() == rows.count() == seen.value


def test_rows_of_many_groups_are_joined_once(spark, monkeypatch):
    from pyspark.sql import functions as F
    from valora.operators import clean
    raw, seen = counted(spark.range(600).select(F.concat(F.lit("g"), F.col("id") % 50).alias("g"),
                                                F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v")).cache())
    monkeypatch.setattr(clean, "_LITERAL_GROUPS", 3)
    out = clean.fill_group_median(raw, "v", "g", row_bound=600)
    before = seen.value
    assert out.where("v IS NULL").count() == 0 and out.count() == 600 and seen.value == before
