"""Many categories: looked up, and one sparse vector."""

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from valora.operators import encode
from valora.operators.encode import Preprocessor, PreprocessorModel
from valora.spec import HOUSE_SPEC, ColumnSpec

SPEC = ColumnSpec(name="wide", id_col="id", target_col="none", numeric=("v",), nominal=("word", "code", "part.no"))


def both(monkeypatch, model, df):
    """The vectors of either form, by row."""
    out = []
    for most in (10**9, 0):
        monkeypatch.setattr(encode, "_DENSE_MAX", most)
        out.append(sorted(model.transform(df).select("id", vector_to_array("features").alias("x")).collect()))
    return out


def test_same_values_as_expressions(spark, monkeypatch):
    rows = [(i, float(i % 5), f"w{i % 13}" if i % 9 else None, [0, -3, 7, 10**12][i % 4], [0.0, 0.1, 1e16, -2.5, 1e-320][i % 5]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v double, word string, code long, `part.no` double")
    model = Preprocessor(SPEC, scale=True).fit(df)
    odd = df.union(spark.createDataFrame([(900, None, "new", None, None), (901, float("nan"), "", 5, -0.0), (902, 1.0, None, 7, float("inf"))], df.schema))
    dense, sparse = both(monkeypatch, model, odd)
    assert dense == sparse and len(dense) == 123
    assert {sum(r["x"][1:]) for r in dense} >= {0.0, 1.0, 3.0}
    # an absent column
    dense, sparse = both(monkeypatch, model, odd.drop("part.no").withColumn("word", F.lit("w3")))
    assert dense == sparse
    dense, sparse = both(monkeypatch, model, odd.limit(0))
    assert dense == sparse == []


def test_house_table(spark, house, monkeypatch):
    model = Preprocessor(HOUSE_SPEC).fit(house)
    dense, sparse = both(monkeypatch, model, house)
    assert dense == sparse and len(dense) == 300


def test_twenty_thousand_categories(spark, scratch):
    df = spark.range(0, 60_000, 1, 8).select(
        "id", (F.col("id") % 7).cast("double").alias("v"), F.format_string("c%05d", F.col("id") % 20_000).alias("word"),
        (F.col("id") % 3).alias("code"), F.lit(1.5).alias("part.no"), F.lit("kept").alias("__valora_tokens_of"))
    model = Preprocessor(SPEC, scale=False).fit(df)
    assert len(model.feature_names) == 1 + 19_999 + 2
    model.write().overwrite().save(f"{scratch}/wide")
    model = PreprocessorModel.load(f"{scratch}/wide")
    out = model.transform(df)
    assert out.columns == [*df.columns, "features"]
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    for r in out.where(F.col("id").isin(0, 1, 19_999, 20_000, 59_999)).collect():
        word, code = r["id"] % 20_000, r["id"] % 3
        expected = {0: float(r["id"] % 7)} | ({word: 1.0} if word else {}) | ({19_999 + code: 1.0} if code else {})
        x = r["features"]
        assert isinstance(x, SparseVector) and x.size == 20_002
        assert {int(i): v for i, v in zip(x.indices, x.values, strict=True)} == {i: v for i, v in expected.items() if v}
    total = out.select(F.sum(F.size(F.filter(vector_to_array("features"), lambda v: v == 1.0)).cast("long"))).first()[0]
    ones = (F.col("v") == 1.0).cast("long") + (F.col("word") != "c00000").cast("long") + (F.col("code") != 0).cast("long")
    assert total == df.agg(F.sum(ones)).first()[0]
