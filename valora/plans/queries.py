"""Registered queries over the driver's tables, with DuckDB oracle SQL.

Every query reads the whole given tables (through the one-row-per-order
"sales" table or lineitem directly) and exercises one operator family.
Double outputs are rounded to 4 decimals on both sides, since summation
order differs between engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from valora.functions.exprs import c, inverse_log_target, log_target, pct_text, round_doubles
from valora.functions.features import engineer_features
from valora.operators import clean, profile
from valora.operators.encode import Preprocessor
from valora.operators.metrics import diagnostics, merged_metrics, residual_deciles
from valora.operators.quantiles import quantiles
from valora.operators.split import fold_salt, rank_sql, split_salt, train_test_split, with_folds, with_split
from valora.plans.sql import feature_sql, features_sql, linear_fit_sql, mode_sql, q, r4
from valora.session import cut_lineage, ensure_checkpoint_dir
from valora.sources.files import load_processed, load_raw, save_leaderboard, save_profile, save_splits, save_summary, save_table, score_file
from valora.sources.records import apply_scoring_schema, check_row_limit, records_to_frame, union_records
from valora.sources.registry import save_artifacts
from valora.sources.tables import SALES_SQL, read_table, sales_table
from valora.spec import SALES_SPEC, SETTINGS, ColumnSpec, FeatureDef

SPEC = SALES_SPEC
ID, TARGET = SPEC.id_col, SPEC.target_col

SALES_TYPES = {
    "o_orderkey": "long", "o_totalprice": "double", "o_orderstatus": "string",
    "o_orderpriority": "string", "order_year": "int", "order_month": "int",
    "c_acctbal": "double", "c_mktsegment": "string", "n_name": "string", "n_lines": "long",
    "line_qty": "double", "line_price": "double", "max_discount": "double", "max_tax": "double",
    "line_status": "string", "last_ship_year": "int", "ship_lag_days": "int",
}
SALES_COLS = list(SALES_TYPES)

# Derived lineitem columns for the row-wise feature query.
LINE_FEATURES = (
    FeatureDef("unit_price", "ratio_p1", ("l_extendedprice", "l_quantity")),
    FeatureDef("is_discounted", "gt0_flag", ("l_discount",)),
    FeatureDef("tax_minus_discount", "weighted_sum", ("l_tax", "l_discount"), (1.0, -1.0)),
    FeatureDef("tax_amount", "product", ("l_extendedprice", "l_tax")),
    FeatureDef("line_and_qty", "sum", ("l_linenumber", "l_quantity")),
)

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def _sel(types: dict[str, str], alias: str = "") -> str:
    pre = f"{alias}." if alias else ""
    return ", ".join(f"{r4(pre + q(k))} AS {q(k)}" if t == "double" else f"{pre}{q(k)}"
                     for k, t in types.items())


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sales_table(spark, sf_dir)


def _sales_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales table written once, for queries that pass over it several times."""
    return cut_lineage(_sales(spark, sf_dir))


# ------------------------------------------------------------------ flagship

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read -> group-median imputation -> derived features -> median target
    per group, descending."""
    s = clean.fill_group_median(_sales_once(spark, sf_dir), "c_acctbal", "n_name", compute_fallback=True)
    s = engineer_features(s, SPEC)
    long = quantiles(s, [TARGET, "c_acctbal", "gross_per_line"], [0.5], ["n_name"])
    wide = long.groupBy("n_name").agg(
        F.max(F.when(F.col("column") == TARGET, F.col("value"))).alias("median_target"),
        F.max(F.when(F.col("column") == "c_acctbal", F.col("value"))).alias("median_acctbal"),
        F.max(F.when(F.col("column") == "gross_per_line", F.col("value"))).alias("median_gross_per_line"))
    return round_doubles(wide).orderBy(F.desc("median_target"), "n_name")


_GPL = features_sql(SALES_COLS, SPEC.features, "s")["gross_per_line"]
register("flagship_median_by_group", f"""
WITH {SALES_SQL},
gm AS (SELECT n_name, median(c_acctbal) AS g FROM sales GROUP BY n_name),
f AS (SELECT s.n_name, s.o_totalprice,
             coalesce(s.c_acctbal, gm.g, (SELECT median(c_acctbal) FROM sales)) AS c_acctbal,
             {_GPL} AS gross_per_line
      FROM sales s LEFT JOIN gm ON s.n_name = gm.n_name)
SELECT n_name, {r4('median(o_totalprice)')} AS median_target,
       {r4('median(c_acctbal)')} AS median_acctbal,
       {r4('median(gross_per_line)')} AS median_gross_per_line
FROM f GROUP BY n_name ORDER BY median_target DESC, n_name
""")(flagship)


# ------------------------------------------------------------------- sources

@register("source_sales_table", f"WITH {SALES_SQL} SELECT {_sel(SALES_TYPES)} FROM sales")
def q_sales(spark, d):
    return round_doubles(_sales(spark, d))


@register("source_records_union", f"""
WITH {SALES_SQL}
SELECT o_orderkey, n_lines, {r4('c_acctbal')} AS c_acctbal, NULL::VARCHAR AS o_orderstatus,
       NULL::DOUBLE AS line_qty FROM sales
UNION ALL
SELECT o_orderkey, NULL::BIGINT, NULL::DOUBLE, o_orderstatus, {r4('line_qty')} FROM sales
""")
def q_union(spark, d):
    s = sales_table(spark, d, merge=True)
    u = union_records([s.select(ID, "n_lines", "c_acctbal"), s.select(ID, "o_orderstatus", "line_qty")])
    return round_doubles(u.select(ID, "n_lines", "c_acctbal", "o_orderstatus", "line_qty"))


_SCORING_TYPES = dict(SALES_TYPES)
for _k in SPEC.scoring_defaults:
    _SCORING_TYPES[_k] = "double"
_SCORING_SEL = ", ".join(
    (f"{r4(f'coalesce(CAST({q(k)} AS DOUBLE), {SPEC.scoring_defaults[k]!r})')} AS {q(k)}"
     if k in SPEC.scoring_defaults else
     (f"{r4(q(k))} AS {q(k)}" if t == "double" else q(k)))
    for k, t in SALES_TYPES.items())
_RANGE_SQL = " AND ".join(f"coalesce({q(k)} BETWEEN {lo!r} AND {hi!r}, true)"
                          for k, (lo, hi) in SPEC.range_checks.items())


@register("source_scoring_schema", f"""
WITH {SALES_SQL}
SELECT {_SCORING_SEL}, ({_RANGE_SQL}) AS valid FROM sales
""")
def q_scoring(spark, d):
    out = apply_scoring_schema(_sales(spark, d), SPEC, drop_unset=False)
    return round_doubles(out.select(*SALES_COLS, "valid"))


# ------------------------------------------------------------------ cleaning

_KE = SPEC.known_error
_KE_SQL = f"NOT coalesce({q(_KE.column)} > {_KE.above!r} AND {q(TARGET)} < {_KE.target_below!r}, false)"
_CAP_COL, _CAP = next(iter(SPEC.caps.items()))
_CAPPED = f"CASE WHEN {q(_CAP_COL)} > {_CAP!r} THEN {_CAP!r} ELSE {q(_CAP_COL)} END"


@register("clean_drop_known_errors", f"WITH {SALES_SQL} SELECT {_sel(SALES_TYPES)} FROM sales WHERE {_KE_SQL}")
def q_known(spark, d):
    return round_doubles(clean.drop_known_errors(_sales(spark, d), SPEC))


_CAP_TYPES = ", ".join(f"{r4(_CAPPED)} AS {q(k)}" if k == _CAP_COL else
                       (f"{r4(q(k))} AS {q(k)}" if t == "double" else q(k))
                       for k, t in SALES_TYPES.items())


@register("clean_cap_columns", f"WITH {SALES_SQL} SELECT {_CAP_TYPES} FROM sales")
def q_cap(spark, d):
    return round_doubles(clean.cap_columns(_sales(spark, d), SPEC.caps))


def _bounds_ctes() -> str:
    """``base`` (known errors dropped, cap applied) and ``bnd`` (fences)."""
    qs = []
    for x in SPEC.tail_cols + (TARGET,):
        qs.append(f"quantile_cont({q(x)}, 0.25) AS {q('q1_' + x)}")
        qs.append(f"quantile_cont({q(x)}, 0.75) AS {q('q3_' + x)}")
    m, tm = SETTINGS.iqr_multiplier, SETTINGS.target_iqr_multiplier
    fences = []
    for x in SPEC.tail_cols:
        q1, q3 = q("q1_" + x), q("q3_" + x)
        fences.append(f"{q1} - {m!r} * ({q3} - {q1}) AS {q('lo_' + x)}")
        fences.append(f"{q3} + {m!r} * ({q3} - {q1}) AS {q('hi_' + x)}")
    q1, q3 = q("q1_" + TARGET), q("q3_" + TARGET)
    fences.append(f"{q3} + {tm!r} * ({q3} - {q1}) AS {q('hi_' + TARGET)}")
    return f"""
base AS (SELECT * REPLACE ({_CAPPED} AS {q(_CAP_COL)}) FROM sales WHERE {_KE_SQL}),
qs AS (SELECT {', '.join(qs)} FROM base),
bnd AS (SELECT {', '.join(fences)} FROM qs)"""


def _clipped(x: str) -> str:
    v, lo, hi = q(x), q("lo_" + x), q("hi_" + x)
    return f"(CASE WHEN {v} < {lo} THEN {lo} WHEN {v} > {hi} THEN {hi} ELSE {v} END)"


_OUT_TYPES = dict(SALES_TYPES)
for _k in SPEC.tail_cols:
    _OUT_TYPES[_k] = "double"
_RO_SEL = ", ".join(
    f"{r4(_clipped(k))} AS {q(k)}" if k in SPEC.tail_cols else
    (f"{r4(f'CASE WHEN {q(k)} > {q('hi_' + k)} THEN {q('hi_' + k)} ELSE {q(k)} END')} AS {q(k)}"
     if k == TARGET else (f"{r4(q(k))} AS {q(k)}" if t == "double" else q(k)))
    for k, t in SALES_TYPES.items())


@register("clean_remove_outliers", f"WITH {SALES_SQL}, {_bounds_ctes()} SELECT {_RO_SEL} FROM base, bnd")
def q_remove_outliers(spark, d):
    return round_doubles(clean.remove_outliers(_sales_once(spark, d), SPEC))


_FLAG_SEL = ", ".join(
    f"CAST(NOT ({q(x)} IS NOT DISTINCT FROM {_clipped(x)}) AS INTEGER) AS {q(x + '_was_outlier')}"
    for x in SPEC.tail_cols)


@register("clean_outlier_flags", f"WITH {SALES_SQL}, {_bounds_ctes()} SELECT o_orderkey, {_FLAG_SEL} FROM base, bnd")
def q_flags(spark, d):
    out = clean.remove_outliers(_sales_once(spark, d), SPEC, keep_flags=True)
    return out.select(ID, *[f"{x}_was_outlier" for x in SPEC.tail_cols])


@register("clean_summary", f"""
WITH {SALES_SQL}
SELECT count(*) AS rows_before, count_if({_KE_SQL}) AS rows_after,
       round(count_if({_KE_SQL}) * 100.0 / count(*), 1) AS pct_kept FROM sales
""")
def q_summary(spark, d):
    """Both counts come out of the pass that stores the cleaned rows."""
    return clean.clean_and_count(_sales(spark, d), lambda df: clean.drop_known_errors(df, SPEC))[1]


@register("clean_absent_coded", f"""
WITH {SALES_SQL}
SELECT 'line_status' AS "column", coalesce(bool_or(coalesce(line_status, 'None') = 'None'), false) AS has_absent
FROM sales
""")
def q_absent(spark, d):
    return clean.absent_coded_table(_sales(spark, d), SPEC)


@register("clean_preview_top5", f"WITH {SALES_SQL} SELECT {_sel(SALES_TYPES)} FROM sales ORDER BY o_orderkey LIMIT 5")
def q_preview(spark, d):
    return round_doubles(clean.preview(_sales(spark, d), 5, [ID]))


# ---------------------------------------------------------------- imputation

def _absent_replace() -> str:
    parts = [f"coalesce(CAST({q(x)} AS VARCHAR), 'None') AS {q(x)}" for x in SPEC.none_fill_categorical]
    parts += [f"coalesce(CAST({q(x)} AS DOUBLE), 0.0) AS {q(x)}" for x in SPEC.none_fill_numeric]
    return ", ".join(parts)


_ABSENT_TYPES = dict(SALES_TYPES)
for _k in SPEC.none_fill_numeric:
    _ABSENT_TYPES[_k] = "double"


@register("impute_absent", f"""
WITH {SALES_SQL}, s1 AS (SELECT * REPLACE ({_absent_replace()}) FROM sales)
SELECT {_sel(_ABSENT_TYPES)} FROM s1""")
def q_absent_fill(spark, d):
    return round_doubles(clean.fill_absent(_sales(spark, d), SPEC))


@register("impute_group_median", f"""
WITH {SALES_SQL},
gm AS (SELECT n_name, median(c_acctbal) AS g FROM sales GROUP BY n_name),
s2 AS (SELECT s.* REPLACE (coalesce(s.c_acctbal, gm.g, (SELECT median(c_acctbal) FROM sales)) AS c_acctbal)
       FROM sales s LEFT JOIN gm ON s.n_name = gm.n_name)
SELECT {_sel(SALES_TYPES)} FROM s2""")
def q_group_median(spark, d):
    s = _sales_once(spark, d)
    return round_doubles(clean.fill_group_median(s, "c_acctbal", "n_name", compute_fallback=True))


# NaN put in by key modulus, for the queries that show it is read as missing.
_NAN_MOD = {"c_acctbal": 13, "line_price": 19, "max_tax": 11}


def _sales_nan(spark: SparkSession, d: str) -> DataFrame:
    return _sales(spark, d).withColumns({
        k: F.when(F.col(ID) % m == 0, F.lit(float("nan"))).otherwise(c(k)) for k, m in _NAN_MOD.items()})


# The same in SQL: ``sales`` is the table with NaN, read as NULL.
SALES_NAN_SQL = SALES_SQL.replace("sales AS (", "sales_raw AS (", 1) + f""",
sales_nan AS (SELECT * REPLACE ({', '.join(
    f"CASE WHEN o_orderkey % {m} = 0 THEN 'NaN'::DOUBLE ELSE {q(k)} END AS {q(k)}" for k, m in _NAN_MOD.items())})
  FROM sales_raw),
sales AS (SELECT * REPLACE ({', '.join(
    f"CASE WHEN isnan({q(k)}) THEN NULL ELSE {q(k)} END AS {q(k)}" for k in _NAN_MOD)}) FROM sales_nan)"""


# Columns that hold nulls after C1-C3 at every driver scale (orders without
# lines, injected nulls).
_C4_COLS = ("max_discount", "max_tax", "last_ship_year", "ship_lag_days")
_C5_COLS = ("o_orderpriority", "c_mktsegment")


def _fill_ctes(src: str, prefix: str) -> str:
    """C1-C5 on table ``src`` as CTEs ``{prefix}1`` .. ``{prefix}3``."""
    p1, p2, p3 = f"{prefix}1", f"{prefix}2", f"{prefix}3"
    c4 = ", ".join(f"coalesce(CAST({q(x)} AS DOUBLE), (SELECT median(CAST({q(x)} AS DOUBLE)) FROM {p1})) AS {q(x)}"
                   for x in _C4_COLS)
    c5 = ", ".join(f"coalesce({q(x)}, {mode_sql(p1, x)}) AS {q(x)}" for x in _C5_COLS)
    return f"""
{p1} AS (SELECT * REPLACE ({_absent_replace()}) FROM {src}),
{prefix}gm AS (SELECT n_name, median(c_acctbal) AS g FROM {p1} GROUP BY n_name),
{p2} AS (SELECT t.* REPLACE (coalesce(t.c_acctbal, g.g, (SELECT median(c_acctbal) FROM {p1})) AS c_acctbal)
        FROM {p1} t LEFT JOIN {prefix}gm g ON t.n_name = g.n_name),
{p3} AS (SELECT * REPLACE ({c4}, {c5}) FROM {p2})"""


_FILLED_TYPES = dict(_ABSENT_TYPES)
for _k in _C4_COLS:
    _FILLED_TYPES[_k] = "double"


@register("impute_fill_missing", f"WITH {SALES_SQL}, {_fill_ctes('sales', 'f')} SELECT {_sel(_FILLED_TYPES)} FROM f3")
def q_fill(spark, d):
    return round_doubles(clean.fill_missing_values(_sales_once(spark, d), SPEC))


@register("missing_nan_fill", f"WITH {SALES_NAN_SQL}, {_fill_ctes('sales', 'f')} SELECT {_sel(_FILLED_TYPES)} FROM f3")
def q_nan_fill(spark, d):
    return round_doubles(clean.fill_missing_values(cut_lineage(_sales_nan(spark, d)), SPEC))


# ------------------------------------------------------------------ features

_FEAT = features_sql(SALES_COLS, SPEC.features)
_FEAT_TYPES = {fd.name: ("int" if fd.kind in ("gt0_flag", "ne_flag", "eq_flag") else "double")
               for fd in SPEC.features}
_FEAT_SEL = ", ".join(f"{r4(e)} AS {q(n)}" if _FEAT_TYPES[n] == "double" else f"CAST({e} AS INTEGER) AS {q(n)}"
                      for n, e in _FEAT.items())


@register("features_sales", f"WITH {SALES_SQL} SELECT {_sel(SALES_TYPES)}, {_FEAT_SEL} FROM sales")
def q_features(spark, d):
    return round_doubles(engineer_features(_sales(spark, d), SPEC))


_LCOLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LFEAT = features_sql(_LCOLS, LINE_FEATURES)
_LFEAT_SEL = ", ".join(f"{r4(e)} AS {q(n)}" if fd.kind not in ("gt0_flag",) else f"CAST({e} AS INTEGER) AS {q(n)}"
                       for fd, (n, e) in zip(LINE_FEATURES, _LFEAT.items(), strict=True))


@register("features_lineitem", f"""
SELECT l_orderkey, l_linenumber, {_LFEAT_SEL},
       {r4('ln(1 + l_extendedprice)')} AS log_price,
       {r4('exp(ln(1 + l_extendedprice)) - 1')} AS price_back,
       printf('%.1f%%', l_discount * 100.0) AS discount_pct
FROM lineitem""")
def q_line_features(spark, d):
    li = read_table(spark, d, "lineitem").select(*_LCOLS)
    from valora.spec import ColumnSpec
    spec = ColumnSpec(name="lineitem", id_col="l_orderkey", target_col="l_extendedprice",
                      features=LINE_FEATURES)
    f = engineer_features(li, spec)
    out = f.select("l_orderkey", "l_linenumber", *[fd.name for fd in LINE_FEATURES],
                   log_target(F.col("l_extendedprice")).alias("log_price"),
                   inverse_log_target(log_target(F.col("l_extendedprice"))).alias("price_back"),
                   pct_text(F.col("l_discount"), 1).alias("discount_pct"))
    return round_doubles(out)


# ------------------------------------------------------------------- profile

@register("profile_shape", f"""
WITH {SALES_SQL}
SELECT count(*) AS "rows", CAST(17 AS BIGINT) AS "columns", CAST(12 AS BIGINT) AS n_numeric,
       CAST(5 AS BIGINT) AS n_categorical FROM sales""")
def q_shape(spark, d):
    return profile.shape(_sales(spark, d))


@register("profile_target_stats", f"""
WITH {SALES_SQL}
SELECT {r4('avg(o_totalprice)')} AS mean, {r4('median(o_totalprice)')} AS median,
       {r4('stddev_samp(o_totalprice)')} AS std, {r4('min(o_totalprice)')} AS min,
       {r4('max(o_totalprice)')} AS max, {r4('skewness(o_totalprice)')} AS skew FROM sales""")
def q_target(spark, d):
    return round_doubles(profile.target_stats(_sales_once(spark, d), TARGET))


_MISSING_UNION = " UNION ALL ".join(
    f"SELECT '{k}' AS \"column\", count(*) - count({q(k)}) AS n_missing, count(*) AS n FROM sales"
    for k in SALES_COLS)


@register("profile_missing", f"""
WITH {SALES_SQL}, m AS ({_MISSING_UNION})
SELECT "column", n_missing, {r4('round(n_missing * 100.0 / n, 2)')} AS pct_missing
FROM m WHERE n_missing > 0 ORDER BY n_missing DESC, "column" """)
def q_missing(spark, d):
    return round_doubles(profile.missing_values(_sales(spark, d)))


@register("missing_nan_profile", f"""
WITH {SALES_NAN_SQL}, m AS ({_MISSING_UNION})
SELECT "column", n_missing, {r4('round(n_missing * 100.0 / n, 2)')} AS pct_missing
FROM m WHERE n_missing > 0 ORDER BY n_missing DESC, "column" """)
def q_nan_missing(spark, d):
    return round_doubles(profile.missing_values(_sales_nan(spark, d)))


_NUM = [k for k, t in SALES_TYPES.items() if t in ("long", "int", "double")]
_CORR_UNION = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, "
    + (f"CASE WHEN corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE)) IS NULL OR "
       f"isnan(corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE))) THEN NULL ELSE 1.0 END"
       if a == b else
       f"CASE WHEN isnan(corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE))) THEN NULL ELSE "
       f"corr(CAST({q(a)} AS DOUBLE), CAST({q(b)} AS DOUBLE)) END")
    + " AS v FROM sales"
    for a in _NUM for b in _NUM)


@register("profile_correlations", f"WITH {SALES_SQL}, cm AS ({_CORR_UNION}) SELECT a, b, {r4('v')} AS corr FROM cm")
def q_corr(spark, d):
    return round_doubles(profile.correlations(_sales(spark, d), _NUM))


_TOP_UNION = " UNION ALL ".join(
    f"SELECT '{a}' AS feature, abs(corr(CAST({q(a)} AS DOUBLE), o_totalprice)) AS v FROM sales"
    for a in _NUM if a != TARGET)


@register("profile_top_correlations", f"""
WITH {SALES_SQL}, tc AS ({_TOP_UNION})
SELECT feature, {r4('round(v, 4)')} AS abs_corr FROM tc WHERE v IS NOT NULL AND NOT isnan(v)
ORDER BY v DESC, feature LIMIT 20""")
def q_topcorr(spark, d):
    return round_doubles(profile.top_correlations(_sales(spark, d), TARGET, 20, _NUM))


def _hist_sql(expr: str, bins: int = 30) -> str:
    return f"""
WITH {SALES_SQL},
v AS (SELECT {expr} AS v FROM sales WHERE o_totalprice IS NOT NULL),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
w AS (SELECT lo, CASE WHEN hi > lo THEN (hi - lo) / {bins} ELSE 1.0 END AS width FROM mm),
b AS (SELECT least(CAST(floor((v - lo) / width) AS INTEGER) + 1, {bins}) AS bin FROM v, w)
SELECT bin, {r4('lo + (bin - 1) * width')} AS lo, {r4('lo + bin * width')} AS hi, count(*) AS n
FROM b, w GROUP BY bin, lo, width"""


@register("profile_histogram", _hist_sql("o_totalprice"))
def q_hist(spark, d):
    return round_doubles(profile.histogram(_sales(spark, d), TARGET, 30))


@register("profile_log_histogram", _hist_sql("ln(1 + o_totalprice)"))
def q_loghist(spark, d):
    return round_doubles(profile.histogram(_sales(spark, d), TARGET, 30, log=True))


@register("profile_box_by_group", f"""
WITH {SALES_SQL},
qt AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1, median(o_totalprice) AS med,
              quantile_cont(o_totalprice, 0.75) AS q3 FROM sales
       WHERE o_totalprice IS NOT NULL GROUP BY o_orderpriority),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo_f, q3 + 1.5 * (q3 - q1) AS hi_f FROM qt)
SELECT f.o_orderpriority, {r4('q1')} AS q1, {r4('med')} AS median, {r4('q3')} AS q3, {r4('iqr')} AS iqr,
       {r4('min(CASE WHEN s.o_totalprice >= lo_f THEN s.o_totalprice END)')} AS whisker_lo,
       {r4('max(CASE WHEN s.o_totalprice <= hi_f THEN s.o_totalprice END)')} AS whisker_hi,
       count_if(s.o_totalprice < lo_f OR s.o_totalprice > hi_f) AS n_outliers, count(*) AS n
FROM sales s JOIN f ON s.o_orderpriority = f.o_orderpriority
WHERE s.o_totalprice IS NOT NULL
GROUP BY f.o_orderpriority, q1, med, q3, iqr""")
def q_box(spark, d):
    return round_doubles(profile.box_stats(_sales_once(spark, d), TARGET, "o_orderpriority"))


@register("profile_point_density", f"""
WITH {SALES_SQL},
v AS (SELECT CAST(line_price AS DOUBLE) AS x, CAST(o_totalprice AS DOUBLE) AS y, n_lines FROM sales
      WHERE line_price IS NOT NULL AND o_totalprice IS NOT NULL),
m AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v),
w AS (SELECT x0, y0, CASE WHEN x1 > x0 THEN (x1 - x0) / 50 ELSE 1.0 END AS dx,
             CASE WHEN y1 > y0 THEN (y1 - y0) / 50 ELSE 1.0 END AS dy FROM m)
SELECT least(CAST(floor((x - x0) / dx) AS INTEGER) + 1, 50) AS x_bin,
       least(CAST(floor((y - y0) / dy) AS INTEGER) + 1, 50) AS y_bin, n_lines,
       count(*) AS n, {r4('min(x)')} AS x_min, {r4('max(x)')} AS x_max, {r4('min(y)')} AS y_min, {r4('max(y)')} AS y_max
FROM v, w GROUP BY x_bin, y_bin, n_lines""")
def q_points(spark, d):
    return round_doubles(profile.point_density(_sales(spark, d), *SPEC.scatter))


@register("split_row_conservation", f"""
WITH {SALES_SQL}, s AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey END AS id FROM sales),
n AS (SELECT count(*) AS n, count(*) FILTER (id IS NULL) AS gone FROM s)
SELECT n AS rows_in, n AS rows_out, gone AS null_ids FROM n""")
def q_conserved(spark, d):
    """Rows in and out of the split when a third of the ids are null."""
    s = _sales(spark, d).select(F.when(F.col(ID) % 3 != 0, F.col(ID)).alias(ID), TARGET)
    train, test = train_test_split(s, ID, SETTINGS)
    both = s.select(F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("z")).union(
        train.union(test).select(F.lit(0), F.lit(1), c(ID).isNull().cast("int")))
    return both.agg(F.sum("i").alias("rows_in"), F.sum("o").alias("rows_out"), F.sum("z").alias("null_ids"))


@register("profile_median_by_group", f"""
WITH {SALES_SQL}
SELECT n_name, {r4('median(o_totalprice)')} AS median_target FROM sales
WHERE o_totalprice IS NOT NULL GROUP BY n_name ORDER BY median_target DESC, n_name""")
def q_median_group(spark, d):
    return round_doubles(profile.median_by_group(_sales(spark, d), TARGET, "n_name"))


# --------------------------------------------------------------------- split

_TEST_SQL = f"{rank_sql('o_orderkey', split_salt())} < ceil({SETTINGS.test_size!r} * count(*) OVER ())"


@register("split_holdout", f"WITH {SALES_SQL} SELECT o_orderkey, {_TEST_SQL} AS is_test FROM sales")
def q_split(spark, d):
    return with_split(_sales_once(spark, d), ID, SETTINGS).select(ID, "is_test")


@register("split_folds", f"""
WITH {SALES_SQL}
SELECT o_orderkey, CAST({rank_sql('o_orderkey', fold_salt())} * {SETTINGS.cv_folds} // count(*) OVER () AS INTEGER) AS fold
FROM sales""")
def q_folds(spark, d):
    return with_folds(_sales_once(spark, d), ID, SETTINGS.cv_folds, SETTINGS).select(ID, "fold")


# ------------------------------------------------------------------- metrics

_BASELINE_CTES = f"""
sp AS (SELECT *, {_TEST_SQL} AS is_test FROM sales),
gm AS (SELECT n_name, avg(ln(1 + o_totalprice)) AS p FROM sp WHERE NOT is_test GROUP BY n_name),
scored AS (SELECT s.o_orderkey, s.o_totalprice AS y,
                  coalesce(gm.p, (SELECT avg(ln(1 + o_totalprice)) FROM sp WHERE NOT is_test)) AS p
           FROM sp s LEFT JOIN gm ON s.n_name = gm.n_name WHERE s.is_test)"""


def _baseline_scored(spark: SparkSession, d: str) -> DataFrame:
    """Hold-out rows scored by the training mean of log1p(target) per group."""
    marked = with_split(_sales_once(spark, d), ID, SETTINGS)
    train = marked.where(~F.col("is_test"))
    gm = train.groupBy("n_name").agg(F.avg(log_target(c(TARGET))).alias("_p"))
    glob = train.agg(F.avg(log_target(c(TARGET)))).first()[0]
    test = marked.where(F.col("is_test"))
    scored = test.join(gm, "n_name", "left")
    return scored.select(ID, c(TARGET).alias("y"), F.coalesce(F.col("_p"), F.lit(glob)).alias("p"))


@register("metrics_holdout", f"""
WITH {SALES_SQL}, {_BASELINE_CTES},
e AS (SELECT y, p, exp(p) - 1 AS yp FROM scored),
a AS (SELECT round(sqrt(avg((y - yp) * (y - yp))), 2) AS rmse, round(avg(abs(y - yp)), 2) AS mae,
             round(1 - sum((y - yp) * (y - yp)) / (var_pop(y) * count(y)), 4) AS r2,
             round(avg(abs(y - yp) / greatest(abs(y), 1.0)) * 100.0, 3) AS mape_pct,
             round(sqrt(avg((ln(1 + y) - p) * (ln(1 + y) - p))), 5) AS rmse_log,
             round(1 - sum((ln(1 + y) - p) * (ln(1 + y) - p)) / (var_pop(ln(1 + y)) * count(y)), 4) AS r2_log
      FROM e)
SELECT {r4('rmse')} AS rmse, {r4('mae')} AS mae, {r4('r2')} AS r2, {r4('mape_pct')} AS mape_pct,
       {r4('rmse_log', 5)} AS rmse_log, {r4('r2_log')} AS r2_log FROM a""")
def q_metrics(spark, d):
    m = merged_metrics(_baseline_scored(spark, d), "y", "p")
    return m.select(*[F.col(k) for k in ("rmse", "mae", "r2", "mape_pct")],
                    "rmse_log", "r2_log").transform(lambda x: round_doubles(x, 5))


@register("metrics_diagnostics", f"""
WITH {SALES_SQL}, {_BASELINE_CTES}
SELECT o_orderkey, {r4('y')} AS actual, {r4('exp(p) - 1')} AS predicted, {r4('y - (exp(p) - 1)')} AS residual
FROM scored""")
def q_diag(spark, d):
    s = _baseline_scored(spark, d).withColumn("pred", inverse_log_target(F.col("p")))
    return round_doubles(diagnostics(s, ID, "y", "pred"))


@register("metrics_residual_deciles", f"""
WITH {SALES_SQL}, {_BASELINE_CTES},
d AS (SELECT y, exp(p) - 1 AS yp FROM scored),
k AS (SELECT {', '.join(f"quantile_cont(yp, {i / 10!r}) AS q{i}" for i in range(1, 10))} FROM d),
b AS (SELECT y, yp, 1 + {' + '.join(f"CASE WHEN yp > q{i} THEN 1 ELSE 0 END" for i in range(1, 10))} AS bin FROM d, k)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, {r4('avg(y)', 2)} AS mean_actual, {r4('avg(yp)', 2)} AS mean_predicted,
       {r4('sqrt(avg((y - yp) * (y - yp)))', 2)} AS rmse FROM b GROUP BY bin""")
def q_deciles(spark, d):
    # the predictions are group means, so many rows tie at the deciles
    s = _baseline_scored(spark, d).withColumn("pred", inverse_log_target(F.col("p")))
    return round_doubles(residual_deciles(s, "y", "pred"), 2)


@register("quantiles_multi_pass", f"""
WITH {SALES_SQL}
{' UNION ALL '.join(f"""SELECT o_orderpriority, '{x}' AS "column", CAST({p!r} AS DOUBLE) AS p, {r4(f'quantile_cont({q(x)}, {p!r})')} AS value
FROM sales WHERE {q(x)} IS NOT NULL GROUP BY o_orderpriority""" for x in ('o_totalprice', 'line_price') for p in (0.25, 0.5, 0.9))}""")
def q_multi_pass(spark, d):
    """The selection that large groups take, on groups of a few thousand rows."""
    small = replace(SETTINGS, exact_group_rows=200)
    return round_doubles(quantiles(_sales_once(spark, d), ["o_totalprice", "line_price"], [0.25, 0.5, 0.9],
                                   ["o_orderpriority"], small))


# ----------------------------------------------------- fitted transform (E)

def _fit_ctes() -> str:
    """Training rows filled (C1-C5) and derived (``tr4``); test rows prepared
    (``te2``) for the transform."""
    tr_cols = [k for k in SALES_COLS if k not in (TARGET,)]
    feats_tr = features_sql([k for k in tr_cols if k != ID], SPEC.features)
    tr4_feats = ", ".join(f"{e} AS {q(n)}" for n, e in feats_tr.items())
    te_feats = ", ".join(f"{e} AS {q(n)}" for n, e in features_sql(SALES_COLS, SPEC.features).items())
    return f"""
sp AS (SELECT *, {_TEST_SQL} AS is_test FROM sales),
tr0 AS (SELECT * EXCLUDE (o_totalprice, is_test) FROM sp WHERE NOT is_test),
{_fill_ctes('tr0', 'tr')},
tr4 AS (SELECT * EXCLUDE (o_orderkey), {tr4_feats} FROM tr3),
te0 AS (SELECT * EXCLUDE (is_test) FROM sp WHERE is_test),
te1 AS (SELECT * REPLACE ({_absent_replace()}) FROM te0),
te2 AS (SELECT *, {te_feats} FROM te1),
fgm AS (SELECT n_name, median(c_acctbal) AS g FROM tr4 GROUP BY n_name)"""


_MODEL_NUM = list(SPEC.numeric) + [fd.name for fd in SPEC.features]
_STRINGS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "n_name", "line_status"]
# Category domains of the nominal columns in the test tables.
_CATEGORIES = {
    "c_mktsegment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "o_orderstatus": ["F", "O", "P"],
    "n_name": sorted(f"NATION_{i}" for i in range(25)),
}


def _stats_sql() -> str:
    med = ", ".join(f"median(CAST({q(n)} AS DOUBLE)) AS {q('med_' + n)}" for n in _MODEL_NUM)
    avg = ", ".join(f"avg(CAST({q(n)} AS DOUBLE)) AS {q('avg_' + n)}" for n in _MODEL_NUM)
    sd = ", ".join(f"stddev_pop(CAST({q(n)} AS DOUBLE)) AS {q('sd_' + n)}" for n in _MODEL_NUM)
    modes = ", ".join(f"{mode_sql('tr4', n)} AS {q('mode_' + n)}" for n in _STRINGS)
    return f"st AS (SELECT {med}, {avg}, {sd}, {modes} FROM tr4)"


@register("fit_numeric_stats", f"""
WITH {SALES_SQL}, {_fit_ctes()}, {_stats_sql()},
u AS ({' UNION ALL '.join(
    f"SELECT '{n}' AS \"column\", {q('med_' + n)} AS median, {q('avg_' + n)} AS mean, {q('sd_' + n)} AS std FROM st"
    for n in _MODEL_NUM)})
SELECT "column", {r4('median')} AS median, {r4('mean')} AS mean, {r4('std')} AS std FROM u""")
def q_fit_numeric(spark, d):
    model = _fit_model(spark, d)
    s = model.stats
    rows = [(n, s["numeric_center"].get(n), s["mean"].get(n), s["std"].get(n)) for n in s["numeric"]]
    return round_doubles(spark.createDataFrame(rows, "column string, median double, mean double, std double"))


@register("missing_nan_fit", f"""
WITH {SALES_NAN_SQL}, {_fit_ctes()}, {_stats_sql()},
u AS ({' UNION ALL '.join(
    f"SELECT '{n}' AS \"column\", {q('med_' + n)} AS median, {q('avg_' + n)} AS mean, {q('sd_' + n)} AS std FROM st"
    for n in _MODEL_NUM)})
SELECT "column", {r4('median')} AS median, {r4('mean')} AS mean, {r4('std')} AS std FROM u""")
def q_nan_fit(spark, d):
    s = _fit_model(spark, d, _sales_nan).stats
    rows = [(n, s["numeric_center"].get(n), s["mean"].get(n), s["std"].get(n)) for n in s["numeric"]]
    return round_doubles(spark.createDataFrame(rows, "column string, median double, mean double, std double"))


@register("fit_modes", f"""
WITH {SALES_SQL}, {_fit_ctes()}, {_stats_sql()}
{' UNION ALL '.join(f"SELECT '{n}' AS \"column\", {q('mode_' + n)} AS mode FROM st" for n in _STRINGS)}""")
def q_fit_modes(spark, d):
    s = _fit_model(spark, d).stats
    return spark.createDataFrame(sorted(s["object_center"].items()), "column string, mode string")


@register("fit_group_medians", f"""
WITH {SALES_SQL}, {_fit_ctes()}
SELECT n_name, {r4('g')} AS median FROM fgm""")
def q_fit_groups(spark, d):
    s = _fit_model(spark, d).stats
    return round_doubles(spark.createDataFrame(sorted(s["group_map"].items()), "n_name string, median double"))


def _fit_model(spark: SparkSession, d: str, source=_sales):
    marked = with_split(cut_lineage(source(spark, d)), ID, SETTINGS)
    return Preprocessor(SPEC, scale=True).fit(marked.where(~F.col("is_test")).drop("is_test"))


def _encode_sql(rounded: bool = True) -> str:
    show = r4 if rounded else str
    fill = []
    for n in _MODEL_NUM:
        if n == "c_acctbal":
            fill.append(f"coalesce(CAST(te2.c_acctbal AS DOUBLE), fgm.g, st.{q('med_c_acctbal')})")
        else:
            fill.append(f"coalesce(CAST(te2.{q(n)} AS DOUBLE), st.{q('med_' + n)})")
    num = []
    for n, f in zip(_MODEL_NUM, fill, strict=True):
        sd = f"(CASE WHEN st.{q('sd_' + n)} = 0 OR st.{q('sd_' + n)} IS NULL THEN 1.0 ELSE st.{q('sd_' + n)} END)"
        num.append(f"{show(f'({f} - coalesce(st.{q('avg_' + n)}, 0.0)) / {sd}')} AS {q(n)}")
    filled_str = {n: f"coalesce(te2.{q(n)}, st.{q('mode_' + n)})" for n in _STRINGS}
    ords = []
    for n, ranks in SPEC.ordinal.items():
        cases = " ".join(f"WHEN '{v}' THEN {float(i)!r}" for i, v in enumerate(ranks))
        ords.append(f"{show(f'CASE {filled_str[n]} {cases} ELSE -1.0 END')} AS {q(n)}")
    hots = []
    for n in SPEC.nominal:
        for v in _CATEGORIES[n][1:]:
            hots.append(f"CASE WHEN {filled_str[n]} = '{v}' THEN 1.0 ELSE 0.0 END AS {q(n + '_' + v)}")
    return (f"SELECT te2.o_orderkey, {', '.join(num)}, {', '.join(ords)}, {', '.join(hots)} "
            f"FROM te2 LEFT JOIN fgm ON te2.n_name = fgm.n_name, st")


@register("encode_transform", f"WITH {SALES_SQL}, {_fit_ctes()}, {_stats_sql()} {_encode_sql()}")
def q_encode(spark, d):
    return _encoded(spark, d, _sales)


def _encoded(spark: SparkSession, d: str, source) -> DataFrame:
    marked = with_split(cut_lineage(source(spark, d)), ID, SETTINGS)
    model = Preprocessor(SPEC, scale=True).fit(marked.where(~F.col("is_test")).drop("is_test"))
    test = marked.where(F.col("is_test")).drop("is_test")
    return round_doubles(model.transform_columns(test, keep=[ID]))


@register("missing_nan_encode", f"WITH {SALES_NAN_SQL}, {_fit_ctes()}, {_stats_sql()} {_encode_sql()}")
def q_nan_encode(spark, d):
    return _encoded(spark, d, _sales_nan)


_CATEGORY_UNION = " UNION ALL ".join(
    f"SELECT {k + 1} AS grp, row_number() OVER (ORDER BY v) - 1 AS ord, '{n}_' || v AS feature "
    f"FROM (SELECT DISTINCT {q(n)} AS v FROM tr4)" for k, n in enumerate(SPEC.nominal))
_PLAIN_UNION = " UNION ALL ".join(
    f"SELECT 0 AS grp, {i + 1} AS ord, '{n}' AS feature" for i, n in enumerate([*_MODEL_NUM, *SPEC.ordinal]))


@register("fit_feature_names", f"""
WITH {SALES_SQL}, {_fit_ctes()},
f AS (SELECT * FROM ({_PLAIN_UNION}) UNION ALL SELECT * FROM ({_CATEGORY_UNION}) WHERE ord > 0)
SELECT CAST(row_number() OVER (ORDER BY grp, ord) - 1 AS INTEGER) AS position, feature FROM f""")
def q_feature_names(spark, d):
    names = _fit_model(spark, d).feature_names
    return spark.createDataFrame(list(enumerate(names)), "position int, feature string")


# -------------------------------------------- models, attribution, scoring
# Model fits have no SQL counterpart; the driver checks their row counts.

def _model_tables(spark: SparkSession, d: str):
    from valora.operators.models import model_table
    marked = with_split(_sales_once(spark, d), ID, SETTINGS)
    train = marked.where(~F.col("is_test")).drop("is_test")
    test = marked.where(F.col("is_test")).drop("is_test")
    prep = Preprocessor(SPEC, scale=True).fit(train)
    return (prep, model_table(prep, train, ID, TARGET),
            model_table(prep, test, ID, TARGET, reuse=False), test)


def _linear_fit(spark: SparkSession, d: str):
    from valora.operators.models import train_final_model
    prep, trt, tet, test = _model_tables(spark, d)
    model, _ = train_final_model("ElasticNet", trt)
    return prep, trt, tet, test, model


_FEATURES = [*_MODEL_NUM, *SPEC.ordinal, *(f"{n}_{v}" for n in SPEC.nominal for v in _CATEGORIES[n][1:])]
_TRAIN_ENCODED = f"""
ts1 AS (SELECT * REPLACE ({_absent_replace()}) FROM (SELECT * EXCLUDE (is_test) FROM sp WHERE NOT is_test)),
ts2 AS (SELECT *, {", ".join(f"{e} AS {q(n)}" for n, e in features_sql(SALES_COLS, SPEC.features).items())} FROM ts1),
etr AS ({_encode_sql(rounded=False).replace("te2", "ts2")}),
xy AS (SELECT etr.*, ln(1 + sp.o_totalprice) AS y FROM etr JOIN sp ON etr.o_orderkey = sp.o_orderkey)"""


def _linear_sql(l1: float, l2: str, exact: bool = True) -> str:
    """Everything up to the fitted coefficients ``sol``, by SQL alone."""
    return (f"WITH RECURSIVE {SALES_SQL}, {_fit_ctes()}, {_stats_sql()}, {_TRAIN_ENCODED}, "
            f"{linear_fit_sql('xy', _FEATURES, l1, l2, exact=exact)}")


def _optimality_sql(l1: float, l2: str, exact: bool = True) -> str:
    names = ", ".join(f"'{n}'" for n in _FEATURES)
    shown = f"{r4('w[i]', 3)} AS coefficient, {r4('r[i]', 4)} AS gradient" if exact else f"abs(r[i]) >= {l1 - 1e-5!r} AS binding"
    return f"""{_linear_sql(l1, l2, exact)}
SELECT [{names}][i] AS feature, {shown},
       CASE WHEN w[i] <> 0 THEN abs(r[i] - l2 * w[i] - {l1!r} * sign(w[i])) ELSE greatest(abs(r[i]) - {l1!r}, 0) END <= 1e-5 AS holds
FROM sol, lam, range(1, {len(_FEATURES) + 1}) AS t(i)"""


def _optimality(spark: SparkSession, d: str, family: str) -> DataFrame:
    from valora.operators.models import label_stats, make_model, optimality, penalty
    prep, trt, _, _ = _model_tables(spark, d)
    ls = label_stats(trt)
    return optimality(make_model(family, ls).fit(trt), trt, prep.feature_names, *penalty(family, ls.n))


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    out = df.withColumns({k: F.round(k, n) for k, n in digits.items()})
    return out.withColumns({k: F.when(F.col(k) == 0, 0.0).otherwise(F.col(k)) for k in digits})


@register("model_optimality_ridge", _optimality_sql(0.0, "1.0 / n"))
def q_ridge(spark, d):
    """H1: coefficients, gradient and optimality condition of the preset."""
    return _rounded(_optimality(spark, d, "Ridge"), {"coefficient": 3, "gradient": 4})


@register("model_optimality_lasso", _optimality_sql(0.001, "0.0", exact=False))
def q_lasso(spark, d):
    """H2: its coefficients are not unique where features are collinear, as some
    here are; which features' gradients are at the bound is."""
    return _optimality(spark, d, "Lasso").select("feature", (F.abs("gradient") >= 0.001 - 1e-5).alias("binding"), "holds")


@register("model_optimality_elasticnet", _optimality_sql(0.0005, "0.0005"))
def q_elasticnet(spark, d):
    """H3."""
    return _rounded(_optimality(spark, d, "ElasticNet"), {"coefficient": 3, "gradient": 4})


@register("model_leaderboard")
def q_board(spark, d):
    """All eight candidates at their presets."""
    from valora.operators.models import FAMILIES, compare_models
    _, trt, _, _ = _model_tables(spark, d)
    return compare_models(trt, FAMILIES)


@register("model_tuning_elasticnet")
def q_tune(spark, d):
    import json
    from valora.operators.models import tune_model
    _, trt, _, _ = _model_tables(spark, d)
    params, best = tune_model("ElasticNet", trt, SETTINGS.n_trials)
    return spark.createDataFrame([("ElasticNet", float(best["best_cv_rmse_log"]), json.dumps(params))],
                                 "family string, best_cv_rmse_log double, params string")


# The ElasticNet that SQL has fitted itself, and the hold-out rows scored by it.
_NAMES = "[" + ", ".join(f"'{n}'" for n in _FEATURES) + "]"
_BY_SQL = f"""{_linear_sql(0.0005, "0.0005")},
xm AS (SELECT j, avg(v) AS m FROM cells GROUP BY j),
wl AS (SELECT unnest(w) AS w, generate_subscripts(w, 1) AS j FROM sol),
wx AS (SELECT wl.j, {_NAMES}[wl.j] AS feature, wl.w, xm.m FROM wl JOIN xm ON wl.j = xm.j),
ete AS ({_encode_sql(rounded=False)}),
tl AS (SELECT o_orderkey, unnest([{', '.join(q(n) for n in _FEATURES)}]) AS v, unnest(range(1, {len(_FEATURES) + 1})) AS j FROM ete),
pr AS (SELECT tl.o_orderkey, (SELECT m FROM xm WHERE j = {len(_FEATURES) + 1}) + sum(wx.w * (tl.v - wx.m)) AS p
       FROM tl JOIN wx ON tl.j = wx.j GROUP BY tl.o_orderkey)"""


@register("model_holdout_metrics", f"""{_BY_SQL},
e AS (SELECT sp.o_totalprice AS y, exp(p) - 1 AS yp, ln(1 + sp.o_totalprice) AS ly, p AS lp
      FROM pr JOIN sp ON pr.o_orderkey = sp.o_orderkey)
SELECT {r4('sqrt(avg((y - yp) * (y - yp)))', 2)} AS rmse, {r4('avg(abs(y - yp))', 2)} AS mae,
       {r4('1 - sum((y - yp) * (y - yp)) / (count(*) * var_pop(y))', 4)} AS r2,
       {r4('100 * avg(abs(y - yp) / greatest(abs(y), 1))', 3)} AS mape_pct,
       {r4('sqrt(avg((ly - lp) * (ly - lp)))', 5)} AS rmse_log,
       {r4('1 - sum((ly - lp) * (ly - lp)) / (count(*) * var_pop(ly))', 4)} AS r2_log FROM e""")
def q_model_metrics(spark, d):
    _, _, tet, _, model = _linear_fit(spark, d)
    return merged_metrics(model.transform(tet), "y", "prediction")


@register("score_predict")
def q_predict(spark, d):
    from valora.operators.score import predict, raw_pipeline
    prep, _, _, test, model = _linear_fit(spark, d)
    return predict(raw_pipeline(prep, model), test, ID)


@register("explain_global_importance", f"""{_BY_SQL},
g AS (SELECT wx.feature, avg(abs(wx.w * (cells.v - wx.m))) AS v FROM cells JOIN wx ON cells.j = wx.j
      GROUP BY wx.feature ORDER BY v DESC, wx.feature LIMIT 30)
SELECT feature, {r4('v', 3)} AS mean_abs_value FROM g""")
def q_importance(spark, d):
    from valora.operators.explain import attributions, feature_means, global_importance
    prep, trt, _, _, model = _linear_fit(spark, d)
    imp, _ = global_importance(attributions(model, trt, feature_means(trt)), prep.feature_names, 30)
    return round_doubles(imp, 3)


@register("explain_local_top15")
def q_local(spark, d):
    from valora.operators.explain import (attributions, explode_explanations, feature_means,
                                          local_explanations)
    prep, trt, tet, _, model = _linear_fit(spark, d)
    att = attributions(model, tet, feature_means(trt))
    return explode_explanations(local_explanations(att, prep.feature_names, 15), [ID])


# A model with given coefficients, so that SQL can restate scoring and
# attribution in full.  Fixed values: a rule for the coefficients, an intercept.
_FIXED_NAMES = [*_MODEL_NUM, *SPEC.ordinal, *(f"{n}_{v}" for n in SPEC.nominal for v in _CATEGORIES[n][1:])]
_FIXED_INTERCEPT = 11.5
_FIXED_COEFS = {n: ((37 * i) % 101 - 50) / 1000 + i / 100000 for i, n in enumerate(_FIXED_NAMES)}
_FIXED_SQL = f"""
WITH {SALES_SQL}, {_fit_ctes()}, {_stats_sql()}, enc AS ({_encode_sql(rounded=False)}),
sc AS (SELECT o_orderkey, {_FIXED_INTERCEPT!r} + {' + '.join(f"{w!r} * {q(n)}" for n, w in _FIXED_COEFS.items())} AS p
       FROM enc),
att AS ({' UNION ALL '.join(f"SELECT o_orderkey, '{n}' AS feature, {w!r} * {q(n)} AS value FROM enc"
                            for n, w in _FIXED_COEFS.items())})"""


def _fixed_pipeline(spark: SparkSession, d: str):
    """The fitted transform, the given model, the hold-out rows."""
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.regression import LinearRegressionModel
    from pyspark.ml.common import _py2java
    from valora.operators.score import raw_pipeline
    marked = with_split(_sales_once(spark, d), ID, SETTINGS)
    prep = Preprocessor(SPEC, scale=True).fit(marked.where(~F.col("is_test")).drop("is_test"))
    sc = spark.sparkContext
    coefs = _py2java(sc, Vectors.dense([_FIXED_COEFS[n] for n in prep.feature_names]))
    model = LinearRegressionModel(sc._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        "fixed", coefs, _FIXED_INTERCEPT))
    return raw_pipeline(prep, model), marked.where(F.col("is_test")).drop("is_test")


@register("score_fixed_model", f"""{_FIXED_SQL}
SELECT o_orderkey, {r4('exp(greatest(p, 0.0)) - 1', 2)} AS predicted_price FROM sc""")
def q_fixed_predict(spark, d):
    from valora.operators.score import predict
    return round_doubles(predict(*_fixed_pipeline(spark, d), ID), 2)


@register("explain_fixed_model_top15", f"""{_FIXED_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(value) DESC, feature DESC) AS position FROM att)
SELECT o_orderkey, {r4(repr(_FIXED_INTERCEPT))} AS base_value, CAST(position AS INTEGER) AS position, feature,
       {r4('value')} AS value FROM r WHERE position <= 15""")
def q_fixed_local(spark, d):
    from valora.operators.explain import explode_explanations
    from valora.operators.score import predict_with_explanation
    pipe, rows = _fixed_pipeline(spark, d)
    out = predict_with_explanation(pipe, rows, [0.0] * len(_FIXED_NAMES), ID)
    return round_doubles(explode_explanations(out, [ID]))


@register("explain_fixed_model_global", f"""{_FIXED_SQL},
g AS (SELECT feature, avg(abs(value)) AS v FROM att GROUP BY feature ORDER BY v DESC, feature LIMIT 30)
SELECT feature, {r4('v')} AS mean_abs_value FROM g""")
def q_fixed_global(spark, d):
    from valora.operators.explain import attributions, global_importance
    pipe, rows = _fixed_pipeline(spark, d)
    prep, model = pipe.stages[0], pipe.stages[1]
    att = attributions(model, prep.transform(rows), [0.0] * len(_FIXED_NAMES))
    return round_doubles(global_importance(att, prep.feature_names, 30)[0])


@register("explain_forest_additivity", f"""
WITH {SALES_SQL}, sp AS (SELECT *, {_TEST_SQL} AS is_test FROM sales)
SELECT o_orderkey, 0.0::DOUBLE AS gap FROM sp WHERE is_test""")
def q_forest_sums(spark, d):
    """Base value plus attributions less the preset forest's prediction, per row."""
    from valora.operators.explain import attributions
    from valora.operators.models import label_stats, make_model
    _, trt, tet, _ = _model_tables(spark, d)
    model = make_model("RandomForest", label_stats(trt)).fit(trt)
    att = attributions(model, model.transform(tet))
    total = F.aggregate("attributions", F.col("base_value"), lambda a, v: a + v)
    return att.select(ID, F.abs(F.round(total - F.col("prediction"), 8)).alias("gap"))


# ------------------------------------------------ files and artifacts, round trips

def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("source_csv_round_trip", f"WITH {SALES_SQL} SELECT {_sel(SALES_TYPES)} FROM sales")
def q_csv(spark, d):
    """A3 and A1: the table written as CSV and read back with its types."""
    sales = _sales(spark, d)
    path = save_table(sales, _folder(spark, "csv"), "csv")
    return round_doubles(load_raw(spark, path, sales.schema))


@register("source_split_files", f"""
WITH {SALES_SQL}, sp AS (SELECT *, {_TEST_SQL} AS is_test FROM sales)
SELECT 'dataset' AS name, count(*) AS n, {r4('sum(o_totalprice)', 2)} AS total FROM sp
UNION ALL SELECT 'train', count(*), {r4('sum(o_totalprice)', 2)} FROM sp WHERE NOT is_test
UNION ALL SELECT 'test', count(*), {r4('sum(o_totalprice)', 2)} FROM sp WHERE is_test""")
def q_split_files(spark, d):
    """A3 and A2: cleaned, train and test tables written and read back."""
    sales = _sales_once(spark, d)
    paths = save_splits(sales, *train_test_split(sales, ID, SETTINGS), _folder(spark, "splits"))
    total = F.sum(F.col(TARGET).cast("decimal(38, 2)")).cast("double")
    frames = [load_processed(spark, path).agg(F.count(F.lit(1)).alias("n"), total.alias("total"))
              .select(F.lit(name).alias("name"), "n", "total") for name, path in paths.items()]
    return round_doubles(reduce(DataFrame.union, frames), 2)


@register("score_csv_file", f"""{_FIXED_SQL}
SELECT o_orderkey, {r4('exp(greatest(p, 0.0)) - 1', 2)} AS predicted_price FROM sc""")
def q_score_file(spark, d):
    """CSV in, predictions out."""
    pipe, rows = _fixed_pipeline(spark, d)
    path = save_table(rows, _folder(spark, "score"), "csv")
    out = score_file(spark, pipe, path, f"{path}-predictions", ID, rows.schema)
    return round_doubles(load_raw(spark, out), 2)


@register("score_saved_model", f"""{_FIXED_SQL}
SELECT o_orderkey, {r4('exp(greatest(p, 0.0)) - 1', 2)} AS predicted_price FROM sc""")
def q_saved(spark, d):
    """Artifacts saved, loaded on first use, and applied."""
    from valora.operators.score import LazyScorer
    pipe, rows = _fixed_pipeline(spark, d)
    return round_doubles(LazyScorer(save_artifacts(pipe, {}, _folder(spark, "model"))).predict(rows, ID), 2)


# A table with many groups: one group per customer and priority.
_GROUP_SPEC = ColumnSpec(name="groups", id_col="o_orderkey", target_col="none", numeric=("price", "n"),
                         none_fill_numeric=(), group_impute=("price", "grp"))
_GROUPED_SQL = """
g0 AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price,
              o_custkey || '-' || o_orderpriority AS grp, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 13 END AS n FROM orders),
g1 AS (SELECT grp, median(price) AS m FROM g0 GROUP BY grp),
g2 AS (SELECT g0.grp, coalesce(g0.price, g1.m, (SELECT median(price) FROM g0)) AS price,
              coalesce(n, (SELECT median(n) FROM g0)) AS n FROM g0 JOIN g1 ON g0.grp = g1.grp),
g3 AS (SELECT grp, median(price) AS m FROM g2 GROUP BY grp)"""


@register("fit_many_groups", f"""
WITH {_GROUPED_SQL}
SELECT o_orderkey, {r4('coalesce(g0.price, g3.m)')} AS price, {r4('coalesce(n, (SELECT median(n) FROM g2))')} AS n
FROM g0 JOIN g3 ON g0.grp = g3.grp""")
def q_many_groups(spark, d):
    """Medians of about as many groups as customers are a
    table beside the model; fitted, saved, loaded and applied unscaled."""
    from valora.operators import encode
    rows = read_table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice").cast("double")).alias("price"),
        F.concat_ws("-", F.col("o_custkey").cast("string"), "o_orderpriority").alias("grp"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 13).cast("double").alias("n"))
    path = _folder(spark, "groups-model")
    Preprocessor(_GROUP_SPEC, scale=False).fit(rows).write().overwrite().save(path)
    return round_doubles(encode.PreprocessorModel.load(path).transform_columns(rows, keep=[ID]).select(ID, "price", "n"))


@register("registry_overview", f"""
WITH {SALES_SQL}, m AS (SELECT avg(o_totalprice) AS a, avg(o_totalprice) / 2 AS b FROM sales),
e AS (SELECT 'constant mean' AS model, o_totalprice AS y, a AS p FROM sales, m UNION ALL
      SELECT 'half the mean', o_totalprice, b FROM sales, m)
SELECT model, 'N/A' AS cv_rmse_log, format('${{:,.2f}}', round(sqrt(avg((y - p) * (y - p))), 2)) AS holdout_rmse,
       format('${{:,.2f}}', round(avg(abs(y - p)), 2)) AS holdout_mae,
       CASE model WHEN 'constant mean' THEN 'N/A' ELSE format('{{:,.4f}}', round(1 - sum((y - p) * (y - p)) / (count(*) * var_pop(y)), 4))
       END AS holdout_r2, CASE model WHEN 'constant mean' THEN 2 ELSE 1 END AS n_runs FROM e GROUP BY model""")
def q_overview(spark, d):
    """Runs logged, the latest of each model shown, N/A where absent."""
    from valora.operators.metrics import regression_metrics
    from valora.sources.registry import log_run, model_overview, runs
    sales, root = _sales_once(spark, d), _folder(spark, "registry")
    mean = sales.agg(F.avg(TARGET)).first()[0]
    log_run(spark, root, "constant mean", {"value": 0.0}, {"rmse": 1.0, "r2": 0.5})
    for name, value, hidden in (("constant mean", mean, "r2"), ("half the mean", mean / 2, "")):
        found = regression_metrics(sales.withColumn("p", F.lit(float(value))), TARGET, "p").first().asDict()
        log_run(spark, root, name, {"value": float(value)}, {k: v for k, v in found.items() if k != hidden}, {"stage": "test"})
    counts = runs(spark, root).groupBy(F.col("run_name").alias("model")).agg(F.countDistinct("run_id").cast("int").alias("n_runs"))
    return model_overview(spark, root).join(counts, "model")


@register("registry_versions", f"""
WITH {SALES_SQL}, sp AS (SELECT *, {_TEST_SQL} AS is_test FROM sales)
SELECT t.*, (SELECT count(*) FROM sp WHERE is_test) AS scored
FROM (VALUES (1, 'None', 'READY'), (2, 'Production', 'READY')) AS t(version, stage, status)""")
def q_versions(spark, d):
    """A model registered twice, listed, and both versions applied."""
    from valora.sources.registry import list_versions, load_version, register_model
    root, (pipe, rows) = _folder(spark, "versions"), _fixed_pipeline(spark, d)
    found = [(register_model(pipe, root, "fixed", None, stage), load_version(root, "fixed").transform(rows).count())
             for stage in ("None", "Production")]
    counts = spark.createDataFrame(found, "version int, scored long")
    return list_versions(spark, root, "fixed").join(counts, "version").select("version", "stage", "status", "scored")


@register("stream_quarantine", f"""
WITH {SALES_SQL}
SELECT {_SCORING_SEL}, ({_RANGE_SQL}) AS valid FROM sales""")
def q_stream(spark, d):
    """A10 and A11 on a stream: valid and quarantined rows of CSV files."""
    from valora.streaming.quarantine import check_stream
    sales, root = _sales(spark, d), _folder(spark, "stream")
    save_table(sales, f"{root}/in", "csv")
    check_stream(spark, f"{root}/in", f"{root}/valid", f"{root}/bad", f"{root}/state", sales.schema, SPEC).awaitTermination()
    parts = [spark.read.option("basePath", f"{root}/{k}").parquet(f"{root}/{k}").withColumn("valid", F.lit(k == "valid"))
             for k in ("valid", "bad")]
    return round_doubles(parts[0].unionByName(parts[1]).select(*SALES_COLS, "valid"))


@register("profile_correlation_submatrix", f"""
WITH {SALES_SQL}, tc AS ({_TOP_UNION}), cm AS ({_CORR_UNION}),
top AS (SELECT feature FROM tc WHERE v IS NOT NULL AND NOT isnan(v) ORDER BY v DESC, feature LIMIT 5),
kept AS (SELECT feature FROM top UNION ALL SELECT '{TARGET}')
SELECT a, b, {r4('v')} AS corr FROM cm WHERE a IN (SELECT feature FROM kept) AND b IN (SELECT feature FROM kept)""")
def q_submatrix(spark, d):
    """the target and the five columns closest to it."""
    return round_doubles(profile.correlation_submatrix(_sales(spark, d), TARGET, 5, _NUM))


def _of(name: str) -> str:
    return f"({REGISTRY[name][1]})"


_REPORT = {   # table of the report -> item, value, the query that restates it
    "shape": ("'rows'", "rows", "profile_shape"),
    "target": ("'median'", "median", "profile_target_stats"),
    "missing": ("`column`", "n_missing", "profile_missing"),
    "top_correlations": ("feature", "abs_corr", "profile_top_correlations"),
    "target_histogram": ("bin", "n", "profile_histogram"),
    "log_target_histogram": ("bin", "n", "profile_log_histogram"),
    "target_by_group": ("o_orderpriority", "n_outliers", "profile_box_by_group"),
    "median_by_group": ("n_name", "median_target", "profile_median_by_group"),
}
_REPORT_SQL = " UNION ALL ".join(
    f"""SELECT '{k}' AS report, CAST({item.replace('`', '"')} AS VARCHAR) AS item, CAST({q(value)} AS DOUBLE) AS value FROM {_of(name)}"""
    for k, (item, value, name) in _REPORT.items())


@register("profile_report", f"SELECT report, item, {r4('value')} AS value FROM ({_REPORT_SQL})")
def q_report(spark, d):
    """The whole report written as JSON lines and read back."""
    paths = save_profile(profile.profile(_sales_once(spark, d), SPEC), _folder(spark, "profile"))
    parts = [spark.read.json(paths[k]).selectExpr(
        f"'{k}' AS report", f"CAST({item} AS STRING) AS item", f"CAST(`{value}` AS DOUBLE) AS value")
        for k, (item, value, _) in _REPORT.items()]
    return round_doubles(reduce(DataFrame.union, parts))


@register("source_records", f"""
WITH {SALES_SQL}
SELECT n_name, count(*) AS n, {r4('avg(c_acctbal)')} AS balance,
       CASE WHEN count(*) % 2 = 0 THEN max(order_year) END AS last_year
FROM sales GROUP BY n_name""")
def q_records(spark, d):
    """One record per nation, without its unset fields, as a table
    within the row limit."""
    per = _sales(spark, d).groupBy("n_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("balance"),
        F.when(F.count(F.lit(1)) % 2 == 0, F.max("order_year")).alias("last_year"))
    records = [{k: v for k, v in r.asDict().items() if v is not None} for r in per.collect()]
    frame = check_row_limit(records_to_frame(spark, records), 10_000)
    absent = [F.lit(None).cast("int").alias(x) for x in ("last_year",) if x not in frame.columns]
    return round_doubles(frame.select("*", *absent).select("n_name", "n", "balance", F.col("last_year").cast("int").alias("last_year")))


@register("sink_leaderboard", f"""
WITH {SALES_SQL}, m AS (SELECT avg(o_totalprice) AS a, median(o_totalprice) AS b FROM sales),
e AS (SELECT 'mean' AS model, o_totalprice AS y, a AS p FROM sales, m UNION ALL
      SELECT 'median', o_totalprice, b FROM sales, m UNION ALL SELECT 'zero', o_totalprice, 0.0 FROM sales),
s AS (SELECT model, round(sqrt(avg((y - p) * (y - p))), 2) AS rmse, round(avg(abs(y - p)), 2) AS mae FROM e GROUP BY model),
r AS (SELECT *, row_number() OVER (ORDER BY rmse, model) AS rank FROM s)
SELECT CAST(rank AS INTEGER) AS rank, model, {r4('rmse', 2)} AS rmse, {r4('mae', 2)} AS mae, rank = 1 AS best,
       {r4('first_value(mae) OVER (ORDER BY rank)', 2)} AS best_mae FROM r""")
def q_leaderboard_files(spark, d):
    """Ranked constant predictions as CSV and their summary as JSON, read back."""
    from valora.operators.metrics import regression_metric_exprs
    from valora.sources.registry import read_json
    sales, folder = _sales_once(spark, d), _folder(spark, "board")
    mean, median = sales.agg(F.avg(TARGET), F.median(TARGET)).first()
    guesses = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(float(v)).alias("p"))
                        for k, v in (("mean", mean), ("median", median), ("zero", 0.0))])
    scored = sales.select(F.col(TARGET).cast("double").alias("y"), F.inline(guesses))
    board = scored.groupBy("model").agg(*regression_metric_exprs(F.col("y"), F.col("p")))
    board = board.withColumn("rank", F.row_number().over(Window.orderBy("rmse", "model")))
    back = load_raw(spark, save_leaderboard(board, f"{folder}/leaderboard"))
    top = back.where("rank = 1").first().asDict()
    save_summary(spark, {"best_model": top["model"], "holdout_metrics": {"mae": top["mae"]}}, f"{folder}/summary")
    summary = read_json(spark, f"{folder}/summary")
    return back.select(F.col("rank").cast("int").alias("rank"), "model", F.col("rmse").cast("double").alias("rmse"),
                       F.col("mae").cast("double").alias("mae"), (F.col("model") == summary["best_model"]).alias("best"),
                       F.lit(float(summary["holdout_metrics"]["mae"])).alias("best_mae"))


_ABSENT_SPEC = ColumnSpec(name="absent", id_col=ID, target_col="none", none_fill_numeric=(),
                          numeric=("o_totalprice", "line_qty"), nominal=("o_orderstatus",))


@register("encode_absent_columns", f"""
WITH {SALES_SQL}
SELECT o_orderkey, {r4('coalesce(o_totalprice, (SELECT median(o_totalprice) FROM sales))')} AS o_totalprice,
       {r4('(SELECT median(line_qty) FROM sales)')} AS line_qty,
       CAST({mode_sql('sales', 'o_orderstatus')} = 'O' AS DOUBLE) AS "o_orderstatus_O",
       CAST({mode_sql('sales', 'o_orderstatus')} = 'P' AS DOUBLE) AS "o_orderstatus_P" FROM sales""")
def q_absent_columns(spark, d):
    """Columns that the rows lack get the median or mode of the fit."""
    rows = _sales_once(spark, d).select(ID, "o_totalprice", "line_qty", "o_orderstatus")
    model = Preprocessor(_ABSENT_SPEC, scale=False).fit(rows)
    return round_doubles(model.transform_columns(rows.drop("line_qty", "o_orderstatus"), keep=[ID]))


@register("job_load_and_split", f"""
WITH {SALES_SQL}, {_bounds_ctes()}, cl AS (SELECT {_RO_SEL} FROM base, bnd),
sp AS (SELECT *, {_TEST_SQL} AS is_test, CAST(o_totalprice AS DECIMAL(38, 2)) AS cents FROM cl)
SELECT 'dataset' AS name, count(*) AS n, CAST(sum(cents) AS DOUBLE) AS total FROM sp
UNION ALL SELECT 'train', count(*), CAST(sum(cents) AS DOUBLE) FROM sp WHERE NOT is_test
UNION ALL SELECT 'test', count(*), CAST(sum(cents) AS DOUBLE) FROM sp WHERE is_test""")
def q_load_and_split(spark, d):
    """M1: cleaned, split and stored; the stored tables read back."""
    from valora.plans.jobs import load_and_split
    root = _folder(spark, "job")
    load_and_split(_sales(spark, d), SPEC, out_root=root, skip_profile=True)
    total = F.sum(F.round(TARGET, 4).cast("decimal(38, 2)")).cast("double").alias("total")
    return reduce(DataFrame.union, [
        load_processed(spark, f"{root}/{k}").agg(F.count(F.lit(1)).alias("n"), total).select(F.lit(k).alias("name"), "n", "total")
        for k in ("dataset", "train", "test")])


@register("explain_forest_local_top15")
def q_forest_local(spark, d):
    """TreeSHAP attributions of the preset forest for every hold-out row."""
    from valora.operators.explain import attributions, explode_explanations, local_explanations
    from valora.operators.models import label_stats, make_model
    prep, trt, tet, _ = _model_tables(spark, d)
    model = make_model("RandomForest", label_stats(trt)).fit(trt)
    att = attributions(model, tet)
    return explode_explanations(local_explanations(att, prep.feature_names, 15), [ID])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}
