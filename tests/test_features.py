from pyspark.sql import functions as F

from valora.functions.features import engineer_features
from valora.spec import HOUSE_SPEC

ROWS = {
    "TotalBsmtSF": (1000, 0), "1stFlrSF": (1200, 800), "2ndFlrSF": (800, 0), "GrLivArea": (2000, 800),
    "FullBath": (2, 1), "HalfBath": (1, 0), "BsmtFullBath": (1, 0), "BsmtHalfBath": (0, 0),
    "YrSold": (2010, 2008), "YearBuilt": (2000, 1950), "YearRemodAdd": (2005, 1950),
    "GarageYrBlt": (2005, 0), "PoolArea": (0, 400), "GarageArea": (600, 0), "Fireplaces": (1, 0),
    "OverallQual": (7, 4), "OverallCond": (5, 6), "BedroomAbvGr": (3, 2), "TotRmsAbvGrd": (8, 5),
    "LotFrontage": (60, 50), "LotArea": (9000, 5000), "WoodDeckSF": (200, 0), "OpenPorchSF": (100, 0),
    "EnclosedPorch": (0, 0), "3SsnPorch": (0, 0), "ScreenPorch": (0, 0),
}


def _frame(spark):
    names = list(ROWS)
    data = [tuple(float(ROWS[n][i]) for n in names) for i in range(2)]
    return spark.createDataFrame(data, ", ".join(f"`{n}` double" for n in names))


def test_expected_values(spark):
    out = engineer_features(_frame(spark), HOUSE_SPEC).collect()
    got = {k: [r[k] for r in out] for k in ("TotalSF", "TotalBath", "HasPool", "HasGarage",
                                             "HasFireplace", "IsNew", "HouseAge", "Remodelled")}
    assert got["TotalSF"] == [3000, 800]
    assert got["TotalBath"] == [3.5, 1.0]
    assert got["HasPool"] == [0, 1]
    assert got["HasGarage"] == [1, 0]
    assert got["HasFireplace"] == [1, 0]
    assert got["IsNew"] == [0, 0]
    assert got["HouseAge"] == [10, 58]
    assert got["Remodelled"] == [1, 0]


def test_all_features_and_input_unchanged(spark):
    df = _frame(spark)
    out = engineer_features(df, HOUSE_SPEC)
    for fd in HOUSE_SPEC.features:
        assert fd.name in out.columns
    a = sorted(tuple(r) for r in df.collect())
    b = sorted(tuple(r) for r in out.select(*[F.col(f"`{c}`") for c in df.columns]).collect())
    assert a == b
    r = out.orderBy("YrSold").collect()
    assert r[0]["GarageAge"] > 2000 - 1  # "no garage" year 0 gives about 2000
    assert abs(r[1]["QualPerSF"] - 7 / 3001) < 1e-12


def test_missing_inputs_skip_feature_and_nulls(spark):
    df = spark.createDataFrame([(None, 5.0, 0.0)], "YearRemodAdd double, YearBuilt double, `2ndFlrSF` double")
    out = engineer_features(df, HOUSE_SPEC)
    assert "TotalSF" not in out.columns  # needs TotalBsmtSF and 1stFlrSF
    assert "Has2ndFloor" not in out.columns  # requires 1stFlrSF too
    row = out.first()
    assert row["Remodelled"] == 1  # null differs from anything


def test_division_by_zero_is_null(spark):
    df = spark.createDataFrame([(3.0, -1.0)], "LotFrontage double, LotArea double")
    assert engineer_features(df, HOUSE_SPEC).first()["LotFrontagePerArea"] is None
