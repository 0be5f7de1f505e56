"""Fitted feature transform shared by training and scoring.

``Preprocessor.fit`` gathers every statistic in three bounded jobs (one
moment aggregate, one quantile pass, one value-count pass) and returns a
``PreprocessorModel``: a Spark ML ``Model`` whose state is a small JSON
document (medians, modes, group medians, categories, means, deviations and
the feature order).  ``transform`` is then a single narrow projection —
literal maps for lookups, no shuffle — so scoring runs in one stage.

Order differs between fit and transform on purpose (parity): fit fills
first and derives features afterwards; transform fills absent-coded values,
derives features, adds missing known columns, then imputes from the
training statistics.

The assembled vector is dense up to ``_DENSE_MAX`` one-hot features; beyond,
categories are looked up in a broadcast table and the vector is sparse, with
the same values in the same places.  Unknown categories are all zero in both.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.ml import Estimator, Model
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable,
                             MLWriter)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.storagelevel import StorageLevel

from valora.functions.exprs import c, floats_to_null, is_numeric, string_columns
from valora.functions.features import engineer_features
from valora.operators.clean import (add_missing_columns, attach_group_value, drop_columns, fill_absent,
                                    fill_missing_values, keep_existing)
from valora.operators.quantiles import group_medians, modes_from_counts, quantile_dict, value_counts
from valora.session import cut_lineage, ensure_checkpoint_dir
from valora.spec import SETTINGS, ColumnSpec, FeatureDef, KnownError, Settings

_LITERAL_MAP_MAX = 10_000
_DENSE_MAX = 512  # one-hot features that are expressions of one dense vector; more are looked up
_KEPT = "__valora_in_"
_GROUP = "__valora_group"


def spec_to_json(spec: ColumnSpec) -> dict:
    d = asdict(spec)
    d["ordinal"] = {k: list(v) for k, v in spec.ordinal.items()}
    return d


def spec_from_json(d: dict) -> ColumnSpec:
    d = dict(d)
    d["features"] = tuple(FeatureDef(f["name"], f["kind"], tuple(f["inputs"]), tuple(f["weights"]),
                                     tuple(f["requires"])) for f in d["features"])
    d["known_error"] = KnownError(**d["known_error"]) if d.get("known_error") else None
    d["ordinal"] = {k: tuple(v) for k, v in d["ordinal"].items()}
    d["group_impute"] = tuple(d["group_impute"]) if d.get("group_impute") else None
    d["range_checks"] = {k: tuple(v) for k, v in d.get("range_checks", {}).items()}
    for k in ("drop_cols", "none_fill_categorical", "none_fill_numeric", "nominal", "numeric",
              "tail_cols", "scatter", "always_present"):
        d[k] = tuple(d.get(k, ()))
    return ColumnSpec(**d)


def _category_key(v):
    return (0, float(v), "") if isinstance(v, (int, float)) else (1, 0.0, str(v))


def _number_text(v: float) -> str:
    """``v`` as Java's ``%a`` writes it."""
    digits, power = (v + 0.0).hex().split("p")
    head, _, tail = digits.partition(".")
    return f"{head}.{tail.rstrip('0') or '0'}p{int(power)}"


def _lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup (no join) for small maps."""
    if not mapping:
        return F.lit(None)
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*kv), key)


class Preprocessor(Estimator):
    """Estimator: ``fit(df) -> PreprocessorModel``; a stage of any ``Pipeline``."""

    def __init__(self, spec: ColumnSpec, scale: bool = True, settings: Settings = SETTINGS):
        super().__init__()
        self.spec = spec
        self.scale = scale
        self.settings = settings

    def _fit(self, df: DataFrame) -> PreprocessorModel:
        spec = self.spec
        base = floats_to_null(df.drop(spec.target_col) if spec.target_col in df.columns else df)
        # The statistics below make several passes: keep the input cached
        # for the duration of the fit (recomputed from lineage if lost).
        base = base.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._model(base)
        finally:
            base.unpersist()

    def _model(self, base: DataFrame) -> PreprocessorModel:
        spec, st = self.spec, self.settings
        x = drop_columns(fill_missing_values(base, spec, st), spec.drop_cols)
        x = engineer_features(x, spec)

        numeric = keep_existing(x, spec.model_numeric())
        ordinal = keep_existing(x, list(spec.ordinal))
        nominal = keep_existing(x, spec.nominal)
        if not (numeric or ordinal or nominal):
            raise ValueError("none of the spec's feature columns is in the input")

        # Job 1: means and population deviations.
        row = x.agg(F.count(F.lit(1)).alias("__rows"),
                    *[F.avg(c(n)).alias(f"m{i}") for i, n in enumerate(numeric)],
                    *[F.stddev_pop(c(n)).alias(f"s{i}") for i, n in enumerate(numeric)]).first()
        mom = {n: (row[f"m{i}"], row[f"s{i}"]) for i, n in enumerate(numeric)}
        n_rows = int(row["__rows"])

        # Job 2: medians (and group medians of the group-imputed column).
        med = {k: v[0] for k, v in quantile_dict(x, numeric, [0.5], st, row_bound=n_rows).items()}
        gmap, gfall, gtable = {}, None, None
        gi = spec.group_impute
        if gi and gi[0] in x.columns and gi[1] in x.columns:
            gm = group_medians(x, gi[0], [gi[1]], st, row_bound=n_rows).where(c(gi[1]).isNotNull())
            gm = cut_lineage(gm.select(c(gi[1]).cast("string").alias(_GROUP), F.col("median").alias(f"{_GROUP}_value")))
            # few groups are literals of the projection; more stay a table beside the model
            few = gm.limit(_LITERAL_MAP_MAX + 1).collect()
            if len(few) <= _LITERAL_MAP_MAX:
                gmap = {r[0]: r[1] for r in few}
            else:
                gtable = f"{ensure_checkpoint_dir(base.sparkSession)}/groups-{uuid.uuid4().hex}"
                gm.write.parquet(gtable)
            gfall = (med.get(gi[0]) if gi[0] in med else
                     quantile_dict(x, [gi[0]], [0.5], st, row_bound=n_rows)[gi[0]][0])

        # Job 3: value counts -> modes of every string column and one-hot categories.
        strings = string_columns(x)
        count_cols = list(dict.fromkeys(strings + nominal))
        obj_mode: dict[str, str] = {}
        cats: dict[str, list] = {}
        if count_cols:
            counts = value_counts(x, count_cols)
            if strings:
                obj_mode = {r["column"]: r["mode"] for r in
                            modes_from_counts(counts.where(F.col("column").isin(strings))).collect()}
            if nominal:
                # one feature per category is part of the model's state
                crow = counts.where(F.col("column").isin(nominal)).select("column", "value").collect()
                for r in crow:
                    cats.setdefault(r["column"], []).append(r["value"])
                for n in nominal:
                    vals = cats.get(n, [])
                    if st.max_categories is not None and len(vals) > st.max_categories:
                        raise ValueError(f"{n} has more than {st.max_categories} categories")
                    if isinstance(x.schema[n].dataType, T.IntegralType):
                        vals = [int(v) for v in vals]
                    elif is_numeric(x.schema[n].dataType):
                        vals = [float(v) for v in vals]
                    cats[n] = sorted(vals, key=_category_key)

        onehot_names = [f"{n}_{v}" for n in nominal for v in cats.get(n, [])[1:]]
        stats = {
            "spec": spec_to_json(spec),
            "scale": self.scale,
            "numeric": numeric,
            "ordinal": ordinal,
            "nominal": nominal,
            "numeric_center": med,
            "object_center": obj_mode,
            "group_map": gmap,
            "group_fallback": gfall,
            "group_table": gtable,
            "categories": cats,
            "mean": {k: v[0] for k, v in mom.items()},
            "std": {k: v[1] for k, v in mom.items()},
            "onehot_names": onehot_names,
            "feature_names": numeric + ordinal + onehot_names,
            "input_types": {f.name: f.dataType.simpleString() for f in x.schema.fields},
        }
        return PreprocessorModel(stats)


class PreprocessorModel(Model, MLReadable, MLWritable):
    """Fitted transform; state is one JSON parameter so it persists with
    ``PipelineModel`` and loads without the training data.  Medians of more than
    ``_LITERAL_MAP_MAX`` groups are a table, which is saved beside it."""

    statsJson = Param(Params._dummy(), "statsJson", "fitted statistics as JSON",
                      typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", typeConverter=TypeConverters.toString)

    def __init__(self, stats: dict | None = None, outputCol: str = "features"):
        super().__init__()
        self._setDefault(outputCol="features", statsJson="{}")
        self._set(outputCol=outputCol)
        if stats is not None:
            self._set(statsJson=json.dumps(stats))
        self._stats_cache = None
        self._vocabularies: dict[tuple, CountVectorizerModel] = {}

    @property
    def stats(self) -> dict:
        raw = self.getOrDefault(self.statsJson)
        if self._stats_cache is None or self._stats_cache[0] != raw:
            self._stats_cache = (raw, json.loads(raw))
        return self._stats_cache[1]

    @property
    def fitted(self) -> bool:
        return bool(self.stats.get("feature_names"))

    @property
    def spec(self) -> ColumnSpec:
        return spec_from_json(self.stats["spec"])

    @property
    def feature_names(self) -> list[str]:
        return list(self.stats["feature_names"])

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader(cls)

    def _prepare(self, df: DataFrame) -> DataFrame:
        """Imputed, derived, complete input columns (before encoding)."""
        if not self.fitted:
            raise RuntimeError("this transform has no fitted state")
        s, spec = self.stats, self.spec
        kept = [n for n in df.columns if n.startswith(_KEPT)]  # copies to hand back as they came
        x = drop_columns(df, [d for d in spec.drop_cols])
        x = fill_absent(floats_to_null(x, skip=kept), spec)
        x = engineer_features(x, spec)
        known = s["numeric"] + s["ordinal"] + s["nominal"]
        x = add_missing_columns(x, {
            n: F.lit(s["object_center"].get(n, "None")) if n in s["ordinal"] or n in s["nominal"]
            else F.lit(s["numeric_center"].get(n, 0.0)).cast("double") for n in known})

        fill: dict[str, Column] = {}
        gi = spec.group_impute
        if gi and gi[0] in x.columns and s["group_map"] is not None and s["group_fallback"] is not None:
            key = c(gi[1]).cast("string") if gi[1] in x.columns else F.lit(None).cast("string")
            gmap = s["group_map"]
            if not s.get("group_table"):
                gv = _lookup(gmap, key)
            else:  # too many for a literal map: a join with the table of groups
                table = x.sparkSession.read.parquet(s["group_table"])
                x = attach_group_value(x.withColumn(_GROUP, key), table, _GROUP, f"{_GROUP}_value")
                gv = F.col(f"{_GROUP}_value")
            fill[gi[0]] = F.coalesce(c(gi[0]).cast("double"), gv, F.lit(float(s["group_fallback"])))
        for n, v in s["numeric_center"].items():
            if n in x.columns and n not in fill and v is not None:
                fill[n] = F.coalesce(c(n).cast("double"), F.lit(float(v)))
        for n, v in s["object_center"].items():
            if n in x.columns and v is not None:
                fill[n] = F.coalesce(c(n).cast("string"), F.lit(v))
        # Final safety: encoders never see a null.
        for f in x.schema.fields:
            if f.name in fill or f.name in kept:
                continue
            if isinstance(f.dataType, T.StringType):
                fill[f.name] = F.coalesce(c(f.name), F.lit(s["object_center"].get(f.name, "None")))
            elif is_numeric(f.dataType) and f.name in known:
                fill[f.name] = F.coalesce(c(f.name).cast("double"),
                                          F.lit(float(s["numeric_center"].get(f.name) or 0.0)))
        return x.withColumns(fill) if fill else x

    def feature_exprs(self, x: DataFrame, onehot: bool = True) -> list[Column]:
        s, spec = self.stats, self.spec
        out: list[Column] = []
        for n in s["numeric"]:
            v = c(n).cast("double")
            if s["scale"]:
                mean = s["mean"].get(n)
                std = s["std"].get(n)
                mean = 0.0 if mean is None else float(mean)
                std = 1.0 if (std is None or std == 0.0) else float(std)
                v = (v - F.lit(mean)) / F.lit(std)
            out.append(v.alias(n))
        for n in s["ordinal"]:
            ranks = {cat: float(i) for i, cat in enumerate(spec.ordinal[n])}
            out.append(F.coalesce(_lookup(ranks, c(n).cast("string")), F.lit(-1.0)).alias(n))
        for n in s["nominal"] if onehot else []:
            cats = s["categories"].get(n, [])
            numeric_col = is_numeric(x.schema[n].dataType)
            for v in cats[1:]:
                lit = F.lit(float(v)) if numeric_col else F.lit(str(v))
                col = c(n).cast("double") if numeric_col else c(n).cast("string")
                out.append(F.coalesce(col == lit, F.lit(False)).cast("double").alias(f"{n}_{v}"))
        return out

    def transform_columns(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """Named feature columns in fitted order, plus ``keep`` columns."""
        keep = [k for k in (keep or []) if k in df.columns]
        x = self._prepare(df.withColumns({f"{_KEPT}{i}": c(k) for i, k in enumerate(keep)})
                          if keep else df)
        kept = [F.col(f"`{_KEPT}{i}`").alias(k) for i, k in enumerate(keep)]
        return x.select(*kept, *self.feature_exprs(x))

    def _transform(self, df: DataFrame) -> DataFrame:
        """Input columns kept, plus the assembled vector ``outputCol``."""
        x = self._prepare(df.withColumns({f"{_KEPT}{i}": c(n) for i, n in enumerate(df.columns)}))
        kept = [F.col(f"`{_KEPT}{i}`") for i in range(len(df.columns))]
        if len(self.stats["onehot_names"]) > _DENSE_MAX:
            x, vec = self._looked_up(x, kept)
        else:
            vec = array_to_vector(F.array(*self.feature_exprs(x))).alias(self.getOrDefault(self.outputCol))
        return x.select(*[k.alias(n) for k, n in zip(kept, df.columns, strict=True)], vec)

    def _looked_up(self, x: DataFrame, kept: list[Column]) -> tuple[DataFrame, Column]:
        """The same features where categories are many: each row's categories are
        tokens, found in a broadcast table of categories, and the vector is sparse."""
        s = self.stats
        numeric = tuple(is_numeric(x.schema[n].dataType) for n in s["nominal"])
        if numeric not in self._vocabularies:
            words = [f"{i}:{_number_text(float(v)) if numeric[i] else v}"
                     for i, n in enumerate(s["nominal"]) for v in s["categories"].get(n, [])[1:]]
            self._vocabularies[numeric] = CountVectorizerModel.from_vocabulary(
                words, inputCol="__valora_tokens", outputCol="__valora_onehot")
        tokens = []
        for i, n in enumerate(s["nominal"]):
            v = c(n).cast("double") + F.lit(0.0) if numeric[i] else c(n).cast("string")
            text = F.when(v.isNotNull(), F.format_string("%a", v)) if numeric[i] else v
            tokens.append(F.concat(F.lit(f"{i}:"), text))
        scalars = [f.alias(f"__valora_f{i}") for i, f in enumerate(self.feature_exprs(x, onehot=False))]
        x = x.select(*kept, *scalars, F.array_compact(F.array(*tokens)).alias("__valora_tokens"))
        x = self._vocabularies[numeric].transform(x)
        inputs = [f"__valora_f{i}" for i in range(len(scalars))] + ["__valora_onehot"]
        x = VectorAssembler(inputCols=inputs, outputCol="__valora_vector", handleInvalid="keep").transform(x)
        # a name for each of many features would be most of the schema: their number only
        size = {"ml_attr": {"num_attrs": len(s["feature_names"])}}
        return x, F.col("__valora_vector").alias(self.getOrDefault(self.outputCol), metadata=size)


class _ModelWriter(MLWriter):
    def __init__(self, model: PreprocessorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        if self.model.stats.get("group_table"):
            spark.read.parquet(self.model.stats["group_table"]).write.parquet(f"{path}/groups")


class _ModelReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> PreprocessorModel:
        meta = DefaultParamsReader.loadMetadata(path, SparkSession.getActiveSession())
        model = self.cls()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        if model.stats.get("group_table"):
            model._set(statsJson=json.dumps(model.stats | {"group_table": f"{path}/groups"}))
        return model
