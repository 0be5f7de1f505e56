"""Command-line jobs (M3-M5), for ``spark-submit`` or ``python -m``.

    python -m valora.plans.cli profile --input data.csv --out reports [--skip-outliers]
    python -m valora.plans.cli train   --input data.csv --artifacts out [--no-tune] [--trials N]
    python -m valora.plans.cli score   --model out/best_model --input new.csv [--output path]

``--spec sales --sf-dir DIR`` uses the star-schema test tables instead of a CSV.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from valora.spec import HOUSE_SPEC, SALES_SPEC, SETTINGS


def _source(spark: SparkSession, args):
    if args.spec == "sales":
        from valora.sources.tables import sales_table
        return sales_table(spark, args.sf_dir), SALES_SPEC
    from valora.sources.files import load_raw
    return load_raw(spark, args.input), HOUSE_SPEC


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="valora")
    sub = ap.add_subparsers(dest="cmd", required=True)
    for name in ("profile", "train", "score"):
        p = sub.add_parser(name)
        p.add_argument("--input")
        p.add_argument("--spec", choices=["house", "sales"], default="house")
        p.add_argument("--sf-dir", help="folder of the star-schema tables")
    sub.choices["profile"].add_argument("--out", required=True)
    sub.choices["profile"].add_argument("--skip-outliers", action="store_true")
    sub.choices["train"].add_argument("--artifacts", required=True)
    sub.choices["train"].add_argument("--registry")
    sub.choices["train"].add_argument("--no-tune", action="store_true")
    sub.choices["train"].add_argument("--trials", type=int, default=SETTINGS.n_trials)
    sub.choices["score"].add_argument("--model", required=True)
    sub.choices["score"].add_argument("--output")
    sub.choices["score"].add_argument("--id-col", default="Id")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"valora-{args.cmd}").getOrCreate()
    if args.cmd == "profile":
        from valora.operators.clean import remove_outliers
        from valora.operators.profile import profile
        from valora.sources.files import save_profile
        df, spec = _source(spark, args)
        if not args.skip_outliers:
            df = remove_outliers(df, spec)
        print(json.dumps(save_profile(profile(df, spec), args.out)))
    elif args.cmd == "train":
        from valora.plans.jobs import run_training
        df, spec = _source(spark, args)
        summary = run_training(spark, df, spec, tune=not args.no_tune, n_trials=args.trials,
                               artifacts_root=args.artifacts, registry_root=args.registry)
        print(json.dumps({k: v for k, v in summary.items() if k not in ("pipeline", "leaderboard_df")},
                         default=str))
    else:
        from valora.sources.files import score_file
        from valora.sources.registry import load_artifacts
        pipe = load_artifacts(args.model)["pipeline"]
        print(score_file(spark, pipe, args.input, args.output, args.id_col))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
