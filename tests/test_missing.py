"""NaN, markers and kept columns end to end."""

import os

from pyspark.sql import functions as F

from valora.operators.clean import fill_missing_values, remove_outliers
from valora.operators.encode import Preprocessor
from valora.operators.profile import missing_values
from valora.sources.files import load_raw
from valora.spec import HOUSE_SPEC as H
from valora.spec import ColumnSpec

NAN = float("nan")


def with_nan(house):
    return house.withColumns({
        x: F.when(F.col("Id") % 5 == 0, F.lit(NAN)).otherwise(F.col(x)) for x in ("LotFrontage", "GrLivArea", "GarageArea")})


def as_null(house):
    return house.withColumns({
        x: F.when(F.col("Id") % 5 != 0, F.col(x)) for x in ("LotFrontage", "GrLivArea", "GarageArea")})


def test_nan_is_null_everywhere(house):
    a, b = with_nan(house), as_null(house)
    assert sorted(missing_values(a).collect()) == sorted(missing_values(b).collect())
    for f in (lambda x: fill_missing_values(x, H), lambda x: remove_outliers(x, H, keep_flags=True)):
        assert f(a).exceptAll(f(b)).count() == 0 and f(a).count() == f(b).count()
    ma, mb = Preprocessor(H).fit(a), Preprocessor(H).fit(b)
    assert ma.stats == mb.stats
    out = ma.transform_columns(a, keep=["Id"])
    bad = out.agg(*[F.count_if(F.isnan(F.col(f"`{x}`")) | F.col(f"`{x}`").isNull()).alias(f"c{i}")
                    for i, x in enumerate(ma.feature_names)]).first()
    assert sum(bad) == 0
    assert out.exceptAll(mb.transform_columns(b, keep=["Id"])).count() == 0


def test_transform_hands_back_its_input(house):
    model = Preprocessor(H).fit(house)
    df = house.withColumn("note", F.when(F.col("Id") % 3 == 0, None).otherwise(F.lit("x"))).withColumn(
        "extra", F.when(F.col("Id") % 4 == 0, F.lit(NAN)).otherwise(F.lit(1.0)))
    out = model.transform(df).drop("features")
    assert out.columns == df.columns and out.exceptAll(df).count() == 0 and df.exceptAll(out).count() == 0


def test_csv_with_doubled_quotes_and_text_numbers(spark, scratch):
    path = os.path.join(scratch, "quotes.csv")
    with open(path, "w") as f:
        f.write('a,b,c\n"x ""y"", z",2,NaN\nplain,?,1.5\n"q,r",3,inf\n')
    rows = load_raw(spark, path).collect()
    assert [tuple(r) for r in rows] == [('x "y", z', 2, None), ("plain", None, 1.5), ("q,r", 3, None)]
    typed = load_raw(spark, path, spark.createDataFrame([], "a string, b long, c double, d int").schema).collect()
    assert [tuple(r) for r in typed] == [('x "y", z', 2, None, None), ("plain", None, 1.5, None), ("q,r", 3, None, None)]


def test_integer_categories_and_many_groups(spark):
    n = 7000
    spec = ColumnSpec(name="t", id_col="id", target_col="y", drop_cols=("id",), group_impute=("v", "g"),
                      nominal=("k",), numeric=("v",))
    df = spark.range(n).select("id", F.concat(F.lit("g"), F.col("id")).alias("g"), (F.col("id") % 3 * 10).alias("k"),
                               F.when(F.col("id") % 2 == 0, F.col("id").cast("double")).alias("v"), F.lit(1.0).alias("y"))
    model = Preprocessor(spec, scale=False).fit(df)
    assert model.feature_names == ["v", "k_10", "k_20"] and len(model.stats["group_map"]) == n
    new = df.withColumn("v", F.lit(None).cast("double"))
    got = model.transform_columns(new, keep=["id"]).where("id IN (4000, 4001)").orderBy("id").collect()
    assert got[0]["v"] == 4000.0 and got[1]["v"] == 3499.0 and (got[0]["k_10"], got[1]["k_20"]) == (1.0, 1.0)
