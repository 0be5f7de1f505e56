"""End-to-end jobs (M1-M6): clean + profile + split, training, scoring."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from valora.operators.clean import remove_outliers
from valora.operators.encode import Preprocessor
from valora.operators.explain import attributions, feature_means, global_importance
from valora.operators.metrics import merged_metrics
from valora.operators.models import FAMILIES, compare_models, model_table, train_final_model, tune_model
from valora.operators.profile import profile
from valora.operators.score import raw_pipeline
from valora.operators.split import train_test_split
from valora.session import cut_lineage
from valora.sources.files import save_leaderboard, save_profile, save_splits, save_summary
from valora.sources.registry import log_run, register_model, save_artifacts
from valora.spec import SETTINGS, ColumnSpec, Settings

log = logging.getLogger("valora")


def load_and_split(raw: DataFrame, spec: ColumnSpec, settings: Settings = SETTINGS,
                   out_root: str | None = None, profile_root: str | None = None,
                   skip_outliers: bool = False, skip_profile: bool = False):
    """M1: clean -> profile -> hold-out split (-> saved tables).  The rows are
    written once, before the bounds are fitted on them; the cleaned rows are a
    projection of these, which profile, split and sinks read."""
    stored = cut_lineage(raw)
    cleaned = stored if skip_outliers else remove_outliers(stored, spec, settings)
    report = {} if skip_profile else profile(cleaned, spec, settings)
    if profile_root:
        save_profile(report, profile_root)
    train, test = train_test_split(cleaned, spec.id_col, settings)
    if out_root:
        save_splits(cleaned, train, test, out_root)
    return cleaned, train, test, report


def run_training(spark: SparkSession, raw: DataFrame, spec: ColumnSpec, settings: Settings = SETTINGS,
                 tune: bool = True, n_trials: int | None = None, families=FAMILIES,
                 artifacts_root: str | None = None, registry_root: str | None = None,
                 model_name: str = "price_model", timeout_seconds: float | None = None,
                 parallelism: int = 4) -> dict:
    """M2: split -> fit transform -> compare -> tune -> final fit -> hold-out
    -> importance -> save, log and register."""
    cleaned, train, test, _ = load_and_split(raw, spec, settings, skip_profile=True)
    prep = Preprocessor(spec, scale=True, settings=settings).fit(train)
    train_t = model_table(prep, train, spec.id_col, spec.target_col, settings)
    test_t = model_table(prep, test, spec.id_col, spec.target_col, settings)

    board = compare_models(train_t, families, settings, parallelism=parallelism)
    top = board.where("rank = 1").first()
    if top is None:
        raise RuntimeError(f"every candidate failed: {[r['error'] for r in board.collect()]}")
    best, best_cv = top["model"], float(top["cv_rmse_log_mean"])
    if tune:
        params, tuned = tune_model(best, train_t, n_trials, timeout_seconds, settings, parallelism)
    else:
        params, tuned = {}, {"best_cv_rmse_log": best_cv}
    model, _ = train_final_model(best, train_t, params, settings=settings)
    holdout = merged_metrics(model.transform(test_t), "y", "prediction", settings.use_log_target).first().asDict()

    importance, base = {}, None
    try:
        imp, base = global_importance(attributions(model, train_t, feature_means(train_t)), prep.feature_names, 30)
        importance = {r["feature"]: r["mean_abs_value"] for r in imp.collect()}
    except NotImplementedError as exc:  # attribution not available for this family
        log.warning("attribution skipped: %s", exc)

    pipeline = raw_pipeline(prep, model, settings.use_log_target)
    metadata = {
        "model_name": f"{best}_tuned" if tune else best, "best_params": params,
        "cv_rmse_log": tuned.get("best_cv_rmse_log"), "holdout": holdout,
        "n_train": train_t.count(), "n_test": test_t.count(), "random_state": settings.seed,
        "importance": {"feature_importance": importance, "base_value": base},
        "use_log_target": settings.use_log_target,
    }
    summary = {"best_model": best, "best_params": params, "cv_rmse_log": tuned.get("best_cv_rmse_log"),
               "holdout_metrics": holdout, "importance": importance,
               "leaderboard": [r.asDict() for r in board.collect()]}
    if artifacts_root:
        save_artifacts(pipeline, metadata, f"{artifacts_root}/best_model")
        save_leaderboard(board, f"{artifacts_root}/reports/model_leaderboard")
        save_summary(spark, summary, f"{artifacts_root}/reports/training_summary")
        summary["artifacts_dir"] = f"{artifacts_root}/best_model"
    if registry_root:
        run_id = log_run(spark, registry_root, metadata["model_name"],
                         params={"best_model": best, **params},
                         metrics={**{k: v for k, v in holdout.items()}, **tuned},
                         tags={"stage": "production", "framework": best})
        summary["run_id"] = run_id
        summary["version"] = register_model(pipeline, registry_root, model_name, run_id, "Production")
    summary["pipeline"] = pipeline
    summary["leaderboard_df"] = board
    return summary
