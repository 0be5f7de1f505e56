"""Attribution, scoring, registry, streaming and file sources."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.operators.encode import Preprocessor
from valora.operators.explain import (attributions, feature_means, global_importance,
                                      local_explanations)
from valora.operators.models import model_table, train_final_model
from valora.operators.score import (LazyScorer, predict, predict_with_explanation, raw_pipeline,
                                    with_row_index)
from valora.sources import registry
from valora.sources.files import load_raw, score_file
from valora.sources.records import (apply_scoring_schema, check_row_limit, records_to_frame,
                                    union_records)
from valora.spec import HOUSE_SPEC as H


@pytest.fixture(scope="module")
def fitted(house_signal):
    prep = Preprocessor(H).fit(house_signal)
    table = model_table(prep, house_signal, "Id", "SalePrice")
    model, _ = train_final_model("ElasticNet", table)
    return prep, table, model


def test_attributions_add_up(fitted):
    prep, table, model = fitted
    means = feature_means(table)
    att = model.transform(attributions(model, table, means))
    rows = att.select("prediction", "base_value", "attributions").collect()
    for r in rows[:50]:
        assert abs(r["base_value"] + sum(r["attributions"]) - r["prediction"]) < 1e-8
    imp, base = global_importance(att, prep.feature_names, 30)
    got = imp.collect()
    assert 0 < len(got) <= 30 and got[0]["mean_abs_value"] >= got[-1]["mean_abs_value"]
    assert got[0]["feature"] in ("GrLivArea", "OverallQual", "TotalFinSF", "TotalSF", "OverallGrade")
    assert np.isfinite(base)
    loc = local_explanations(att, prep.feature_names, 15).first()
    assert 0 < len(loc["explanation"]) <= 15


def test_predict_positive_and_ids(spark, fitted, house_signal):
    prep, _, model = fitted
    pipe = raw_pipeline(prep, model)
    out = predict(pipe, house_signal.limit(20), "Id")
    rows = out.collect()
    assert len(rows) == 20 and all(r["predicted_price"] > 0 for r in rows)
    no_id = house_signal.limit(20).drop("Id")
    ids = sorted(r["Id"] for r in predict(pipe, no_id, "Id").collect())
    assert ids == list(range(1, 21))


def test_partial_records(spark, fitted):
    prep, _, model = fitted
    pipe = raw_pipeline(prep, model)
    # dict path: absent columns take the training centres
    for rec in ({"OverallQual": 7}, {"OverallQual": 6, "GrLivArea": 1500.0, "LotArea": 8000.0}):
        assert predict(pipe, records_to_frame(spark, rec), "Id").first()["predicted_price"] > 0
    two = records_to_frame(spark, [{"OverallQual": 8, "GrLivArea": 2200.0, "Neighborhood": "NridgHt"},
                                   {"OverallQual": 5}])
    scored = predict_with_explanation(pipe, two, feature_means(fitted[1]), "Id")
    got = scored.collect()
    assert len(got) == 2 and all(r["predicted_price"] > 0 and len(r["explanation"]) > 0 for r in got)
    # record-schema path: unset numerics are 0.0, prices are clamped at >= 0
    api = predict(pipe, apply_scoring_schema(two, H), "Id").collect()
    assert len(api) == 2 and all(r["predicted_price"] >= 0 for r in api)
    with pytest.raises(TypeError):
        records_to_frame(spark, 42)


def test_scoring_schema_defaults_and_range(spark):
    df = records_to_frame(spark, [{"OverallQual": 11, "GrLivArea": None, "LotFrontage": 50.0}])
    out = apply_scoring_schema(df, H).first()
    assert out["valid"] is False and out["OverallCond"] == 5.0 and out["LotArea"] == 0.0
    assert out["1stFlrSF"] == 0.0 and out["GrLivArea"] == 0.0
    assert "YearBuilt" not in out.asDict() and "MSZoning" not in out.asDict()


def test_union_and_row_limit(spark):
    a = spark.createDataFrame([(1, 2.0)], "Id long, x double")
    b = spark.createDataFrame([(2, "s")], "Id long, y string")
    u = union_records([a, b]).orderBy("Id").collect()
    assert u[0]["y"] is None and u[1]["x"] is None
    with pytest.raises(ValueError):
        check_row_limit(spark.range(11), 10)
    assert check_row_limit(spark.range(10), 10).count() == 10


def test_row_index_is_consecutive(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("v", F.rand(1))
    ids = sorted(r["Id"] for r in with_row_index(df.drop("id")).collect())
    assert ids == list(range(1, 1001))


def test_registry_round_trip(spark, fitted, scratch, house_signal):
    prep, _, model = fitted
    pipe = raw_pipeline(prep, model)
    root = os.path.join(scratch, "registry")
    registry.save_artifacts(pipe, {"model_name": "ElasticNet", "holdout": {"rmse": 1.0}}, f"{root}/best")
    art = registry.load_artifacts(f"{root}/best")
    assert art["metadata"]["model_name"] == "ElasticNet"
    a = predict(pipe, house_signal.limit(5), "Id").orderBy("Id").collect()
    b = predict(art["pipeline"], house_signal.limit(5), "Id").orderBy("Id").collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        registry.load_artifacts(f"{root}/missing")
    run = registry.log_run(spark, root, "r", {"a": 1}, {"rmse": 2.0}, {"stage": "x"})
    assert registry.runs(spark, root).where(F.col("run_id") == run).count() == 3
    assert registry.list_versions(spark, root, "m").count() == 0
    assert registry.register_model(pipe, root, "m", run) == 1
    assert registry.register_model(pipe, root, "m", run) == 2
    v = registry.list_versions(spark, root, "m").collect()
    assert [r["version"] for r in v] == [1, 2] and set(v[0].asDict()) == {"version", "stage", "run_id",
                                                                         "status", "created"}
    assert len(registry.load_version(root, "m").stages) == 3
    lazy = LazyScorer(f"{root}/best")
    assert not lazy.is_loaded()
    assert lazy.predict(house_signal.limit(3), "Id").count() == 3 and lazy.is_loaded()
    registry.log_run(spark, root, "other", metrics={"mae": 12345.678, "best_cv_rmse_log": 0.25})
    ov = {r["model"]: tuple(r)[1:] for r in registry.model_overview(spark, root).collect()}
    assert ov["other"] == ("0.25000", "N/A", "$12,345.68", "N/A")


def test_csv_source_markers_and_scoring(spark, fitted, scratch, house_signal):
    prep, _, model = fitted
    pipe = raw_pipeline(prep, model)
    path = os.path.join(scratch, "in.csv")
    pdf = house_signal.limit(5).toPandas()
    pdf.loc[0, "MSZoning"] = "NA"
    pdf.loc[1, "LotArea"] = None
    pdf.to_csv(path, index=False, na_rep="?")
    raw = load_raw(spark, path)
    assert raw.where("MSZoning IS NULL").count() == 1 and raw.where("LotArea IS NULL").count() == 1
    assert dict(raw.dtypes)["LotArea"] in ("double", "bigint")
    out = score_file(spark, pipe, path)
    assert spark.read.option("header", True).csv(out).count() == 5
    empty = os.path.join(scratch, "empty.csv")
    with open(empty, "w") as fh:
        fh.write(",".join(pdf.columns) + "\n")
    with pytest.raises(ValueError):
        score_file(spark, pipe, empty)
    with pytest.raises(FileNotFoundError):
        load_raw(spark, os.path.join(scratch, "nope.csv"))


def test_streaming_scoring(spark, fitted, scratch, house_signal):
    from valora.streaming.scoring import score_stream
    prep, _, model = fitted
    pipe = raw_pipeline(prep, model)
    src = os.path.join(scratch, "stream_in")
    os.makedirs(src, exist_ok=True)
    house_signal.limit(7).toPandas().to_csv(os.path.join(src, "a.csv"), index=False)
    house_signal.where("Id > 390").toPandas().to_csv(os.path.join(src, "b.csv"), index=False)
    schema = house_signal.schema
    q = score_stream(spark, pipe, src, os.path.join(scratch, "stream_out"),
                     os.path.join(scratch, "stream_ckpt"), schema, "Id")
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(scratch, "stream_out"))
    assert out.count() == 17 and out.where("predicted_price > 0").count() == 17
