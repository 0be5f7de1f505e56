import pytest
from pyspark.sql import functions as F

from valora.operators.clean import (absent_coded_columns, fill_missing_values, remove_outliers,
                                    clean_and_count)
from valora.operators.encode import Preprocessor, PreprocessorModel
from valora.spec import HOUSE_SPEC as H


def test_no_nulls_after_fill(house):
    df = house.withColumn("LotFrontage", F.when(F.col("Id") % 3 == 0, None).otherwise(F.col("LotFrontage"))) \
        .withColumn("KitchenQual", F.when(F.col("Id") % 4 == 0, None).otherwise(F.col("KitchenQual"))) \
        .withColumn("PoolQC", F.lit(None).cast("string"))
    out = fill_missing_values(df, H)
    nulls = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in out.columns]).first()
    assert all(v == 0 for v in nulls.asDict().values())


def test_all_null_absence_coded_becomes_none(house):
    out = fill_missing_values(house.withColumn("PoolQC", F.lit(None).cast("string")), H)
    assert [r[0] for r in out.select("PoolQC").distinct().collect()] == ["None"]


def test_cap_extreme_lot_area(house):
    out = remove_outliers(house.withColumn("LotArea", F.lit(1_000_000.0)), H)
    assert out.agg(F.max("LotArea")).first()[0] <= 100_000


def test_known_errors_dropped_only_with_target(spark, house):
    bad = house.withColumn("GrLivArea", F.when(F.col("Id") <= 3, 5000.0).otherwise(F.col("GrLivArea"))) \
        .withColumn("SalePrice", F.when(F.col("Id") <= 3, 100000.0).otherwise(F.col("SalePrice")))
    cleaned = remove_outliers(bad, H)
    n_bad = bad.where("GrLivArea > 4000 AND SalePrice < 300000").count()
    assert n_bad >= 3
    assert cleaned.count() == 300 - n_bad
    s = clean_and_count(bad, lambda df: remove_outliers(df, H, fit_on=bad))[1].first()
    assert (s["rows_before"], s["rows_after"]) == (300, 300 - n_bad)
    assert remove_outliers(bad.drop("SalePrice"), H).count() == 300


def test_winsorized_and_flags(house):
    out = remove_outliers(house, H, keep_flags=True)
    assert "GrLivArea_was_outlier" in out.columns
    assert out.agg(F.max("SalePrice")).first()[0] <= house.agg(F.max("SalePrice")).first()[0]


def test_same_columns_for_both_splits(house):
    first = house.where("Id <= 200")
    last = house.where("Id > 200")
    model = Preprocessor(H).fit(first)
    a = model.transform_columns(first)
    b = model.transform_columns(last)
    assert a.columns == b.columns == model.feature_names
    n = len(H.numeric) + len(H.features)
    assert model.feature_names[:n] == list(H.numeric) + [f.name for f in H.features]
    assert model.feature_names[n:n + len(H.ordinal)] == list(H.ordinal)
    assert "MSSubClass_30.0" in model.feature_names and "MSSubClass_20.0" not in model.feature_names


def test_unseen_category_and_no_nulls(house):
    model = Preprocessor(H).fit(house)
    new = house.limit(5).withColumn("Neighborhood", F.lit("BrandNewTown"))
    out = model.transform_columns(new)
    assert out.count() == 5
    row = out.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(out.columns)]).first()
    assert sum(row) == 0
    hot = [c for c in out.columns if c.startswith("Neighborhood_")]
    assert out.select(*[F.col(f"`{c}`") for c in hot]).distinct().collect()[0] == tuple([0.0] * len(hot))


def test_transform_before_fit_fails(house):
    with pytest.raises(RuntimeError):
        PreprocessorModel().transform_columns(house)


def test_no_feature_columns_fails(spark):
    with pytest.raises(ValueError):
        Preprocessor(H).fit(spark.createDataFrame([(1, 2.0)], "Id long, SalePrice double"))


def test_missing_columns_get_training_centers(house):
    model = Preprocessor(H).fit(house)
    one = house.limit(1).select("Id", "OverallQual")
    out = model.transform_columns(one)
    assert out.columns == model.feature_names
    assert out.count() == 1


def test_scaling_population_std(house):
    model = Preprocessor(H).fit(house)
    s = model.stats
    out = model.transform_columns(house.where("Id > 0"))
    # transform of the fit data: GrLivArea has no nulls, so it is exactly standardised
    row = out.agg(F.avg("GrLivArea").alias("m"), F.stddev_pop("GrLivArea").alias("s")).first()
    assert abs(row["m"]) < 1e-9 and abs(row["s"] - 1) < 1e-9
    assert s["std"]["GrLivArea"] > 0


def test_absent_coded_helper(house):
    flags = absent_coded_columns(house, H)
    assert flags["PoolQC"] is True and set(flags) <= set(H.none_fill_categorical)


def test_stage_of_a_pipeline(house):
    from pyspark.ml import Pipeline
    from pyspark.ml.regression import LinearRegression
    stages = [Preprocessor(H), LinearRegression(featuresCol="features", labelCol="SalePrice", regParam=1.0)]
    out = Pipeline(stages=stages).fit(house).transform(house)
    assert out.where("prediction IS NULL OR isnan(prediction)").count() == 0 and out.count() == 300
