"""Declared column roles and settings.

Operators read roles from a :class:`ColumnSpec`; no operator names a column
of a particular table.  Two instances ship with the package: ``HOUSE_SPEC``
for the 81-column house-sale table and ``SALES_SPEC`` for the one-row-per-order
table built from the star-schema test tables (see
:mod:`valora.sources.tables`).
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FeatureDef:
    """One derived column.

    ``kind`` is one of:

    * ``sum``          a + b + ...            (null in -> null out)
    * ``sum_nullzero`` row sum, nulls count 0
    * ``weighted_sum`` sum of w_i * x_i
    * ``ratio_p1``     a / (b + 1); division by zero -> null
    * ``gt0_flag``     1 if a > 0 else 0 (null -> 0)
    * ``diff``         a - b
    * ``diff_clip0``   max(a - b, 0)
    * ``ne_flag``      1 if a != b else 0 (null -> 1)
    * ``eq_flag``      1 if a == b else 0 (null -> 0)
    * ``product``      a * b

    ``requires`` lists the columns that must be present for the feature to be
    added (defaults to ``inputs``); inputs may name earlier features.
    """

    name: str
    kind: str
    inputs: tuple[str, ...]
    weights: tuple[float, ...] = ()
    requires: tuple[str, ...] = ()

    @property
    def needed(self) -> tuple[str, ...]:
        return self.requires or self.inputs


@dataclass(frozen=True)
class KnownError:
    """Drop rows where ``column > above`` and ``target < target_below``."""

    column: str
    above: float
    target_below: float


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    id_col: str
    target_col: str
    drop_cols: tuple[str, ...] = ()
    none_fill_categorical: tuple[str, ...] = ()
    none_fill_numeric: tuple[str, ...] = ()
    group_impute: tuple[str, str] | None = None          # (column, group column)
    ordinal: dict[str, tuple[str, ...]] = field(default_factory=dict)
    nominal: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    features: tuple[FeatureDef, ...] = ()
    tail_cols: tuple[str, ...] = ()
    known_error: KnownError | None = None
    caps: dict[str, float] = field(default_factory=dict)
    box_group: str | None = None                          # profile: target by this column
    scatter: tuple[str, ...] = ()                         # profile: point sample columns
    scoring_defaults: dict[str, float] = field(default_factory=dict)
    always_present: tuple[str, ...] = ()
    range_checks: dict[str, tuple[float, float]] = field(default_factory=dict)

    @property
    def engineered(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.features)

    def model_numeric(self) -> tuple[str, ...]:
        return tuple(self.numeric) + self.engineered


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    cv_folds: int = 5
    test_size: float = 0.2
    n_trials: int = 30
    use_log_target: bool = True
    iqr_multiplier: float = 1.5
    target_iqr_multiplier: float = 3.0
    # Exact quantiles hold a group's values in one task only below this size;
    # larger groups go through the bounded multi-pass selection.
    exact_group_rows: int = 1_000_000
    # If set, one-hot fails above this many categories in one column.
    max_categories: int | None = None
    round_digits: int = 4


SETTINGS = Settings()


# --------------------------------------------------------------------------
# House-sale table.  Fixed values: these role lists, rank lists, thresholds
# and scoring defaults must equal the published pipeline's for equal results.
# --------------------------------------------------------------------------

_QUALITY = ("None", "Po", "Fa", "TA", "Gd", "Ex")
_FIN_TYPE = ("None", "Unf", "LwQ", "Rec", "BLQ", "ALQ", "GLQ")
_CONDITION = ("Artery", "Feedr", "Norm", "RRNn", "RRAn", "PosN", "PosA", "RRNe", "RRAe")

HOUSE_SPEC = ColumnSpec(
    name="house",
    id_col="Id",
    target_col="SalePrice",
    drop_cols=("Id", "PID", "Order"),
    none_fill_categorical=(
        "PoolQC", "MiscFeature", "Alley", "Fence", "FireplaceQu",
        "GarageType", "GarageFinish", "GarageQual", "GarageCond",
        "BsmtQual", "BsmtCond", "BsmtExposure", "BsmtFinType1",
        "BsmtFinType2", "MasVnrType",
    ),
    none_fill_numeric=(
        "BsmtFullBath", "BsmtHalfBath", "BsmtFinSF1", "BsmtFinSF2",
        "BsmtUnfSF", "TotalBsmtSF", "GarageCars", "GarageArea",
        "GarageYrBlt", "MasVnrArea",
    ),
    group_impute=("LotFrontage", "Neighborhood"),
    ordinal={
        "ExterQual": _QUALITY,
        "ExterCond": _QUALITY,
        "BsmtQual": _QUALITY,
        "BsmtCond": _QUALITY,
        "HeatingQC": _QUALITY,
        "KitchenQual": _QUALITY,
        "FireplaceQu": _QUALITY,
        "GarageQual": _QUALITY,
        "GarageCond": _QUALITY,
        "PoolQC": _QUALITY,
        "BsmtExposure": ("None", "No", "Mn", "Av", "Gd"),
        "BsmtFinType1": _FIN_TYPE,
        "BsmtFinType2": _FIN_TYPE,
        "GarageFinish": ("None", "Unf", "RFn", "Fin"),
        "Fence": ("None", "MnWw", "GdWo", "MnPrv", "GdPrv"),
        "MiscFeature": ("None", "Othr", "Shed", "TenC", "Gar2", "Elev"),
        "Functional": ("Sal", "Sev", "Maj2", "Maj1", "Mod", "Min2", "Min1", "Typ"),
        "LandSlope": ("Sev", "Mod", "Gtl"),
        "PavedDrive": ("N", "P", "Y"),
        "Street": ("Grvl", "Pave"),
        "LotShape": ("IR3", "IR2", "IR1", "Reg"),
        "Utilities": ("NoSeWa", "NoSewr", "AllPub"),
        "CentralAir": ("N", "Y"),
        "LandContour": ("Low", "HLS", "Bnk", "Lvl"),
        "Condition1": _CONDITION,
        "Condition2": _CONDITION,
    },
    nominal=(
        "MSZoning", "MSSubClass", "Neighborhood", "BldgType", "HouseStyle",
        "RoofStyle", "RoofMatl", "Exterior1st", "Exterior2nd", "MasVnrType",
        "Foundation", "Heating", "GarageType", "SaleType",
        "SaleCondition", "LotConfig", "Electrical", "Alley",
    ),
    numeric=(
        "LotFrontage", "LotArea", "YearBuilt", "YearRemodAdd", "MasVnrArea",
        "BsmtFinSF1", "BsmtFinSF2", "BsmtUnfSF", "TotalBsmtSF", "1stFlrSF",
        "2ndFlrSF", "LowQualFinSF", "GrLivArea", "BsmtFullBath", "BsmtHalfBath",
        "FullBath", "HalfBath", "BedroomAbvGr", "KitchenAbvGr", "TotRmsAbvGrd",
        "Fireplaces", "GarageYrBlt", "GarageCars", "GarageArea", "WoodDeckSF",
        "OpenPorchSF", "EnclosedPorch", "3SsnPorch", "ScreenPorch", "PoolArea",
        "MiscVal", "MoSold", "YrSold", "OverallQual", "OverallCond",
    ),
    features=(
        FeatureDef("TotalSF", "sum", ("TotalBsmtSF", "1stFlrSF", "2ndFlrSF")),
        FeatureDef("TotalFinSF", "sum", ("GrLivArea", "TotalBsmtSF")),
        FeatureDef("Has2ndFloor", "gt0_flag", ("2ndFlrSF",), requires=("1stFlrSF", "2ndFlrSF")),
        FeatureDef("LotFrontagePerArea", "ratio_p1", ("LotFrontage", "LotArea")),
        FeatureDef("TotalBath", "weighted_sum",
                   ("FullBath", "HalfBath", "BsmtFullBath", "BsmtHalfBath"), (1.0, 0.5, 1.0, 0.5)),
        FeatureDef("TotalPorchSF", "sum_nullzero",
                   ("OpenPorchSF", "3SsnPorch", "EnclosedPorch", "ScreenPorch", "WoodDeckSF")),
        FeatureDef("HouseAge", "diff", ("YrSold", "YearBuilt")),
        FeatureDef("RemodAge", "diff", ("YrSold", "YearRemodAdd")),
        FeatureDef("Remodelled", "ne_flag", ("YearRemodAdd", "YearBuilt")),
        FeatureDef("IsNew", "eq_flag", ("YearBuilt", "YrSold")),
        FeatureDef("GarageAge", "diff_clip0", ("YrSold", "GarageYrBlt")),
        FeatureDef("HasPool", "gt0_flag", ("PoolArea",)),
        FeatureDef("HasGarage", "gt0_flag", ("GarageArea",)),
        FeatureDef("HasBasement", "gt0_flag", ("TotalBsmtSF",)),
        FeatureDef("HasFireplace", "gt0_flag", ("Fireplaces",)),
        FeatureDef("OverallGrade", "product", ("OverallQual", "OverallCond")),
        FeatureDef("QualPerSF", "ratio_p1", ("OverallQual", "TotalSF")),
        FeatureDef("BedroomRatio", "ratio_p1", ("BedroomAbvGr", "TotRmsAbvGrd")),
    ),
    tail_cols=(
        "LotArea", "MasVnrArea", "BsmtFinSF1", "BsmtFinSF2", "TotalBsmtSF",
        "GrLivArea", "GarageArea", "WoodDeckSF", "OpenPorchSF", "PoolArea",
    ),
    known_error=KnownError("GrLivArea", 4000.0, 300000.0),
    caps={"LotArea": 100000.0},
    box_group="OverallQual",
    scatter=("GrLivArea", "SalePrice", "OverallQual"),
    scoring_defaults={
        "MSSubClass": 0.0, "LotArea": 0.0, "MasVnrArea": 0.0, "BsmtFinSF1": 0.0,
        "BsmtFinSF2": 0.0, "BsmtUnfSF": 0.0, "TotalBsmtSF": 0.0, "1stFlrSF": 0.0,
        "2ndFlrSF": 0.0, "LowQualFinSF": 0.0, "GrLivArea": 0.0, "BsmtFullBath": 0.0,
        "BsmtHalfBath": 0.0, "FullBath": 0.0, "HalfBath": 0.0, "BedroomAbvGr": 0.0,
        "KitchenAbvGr": 0.0, "TotRmsAbvGrd": 0.0, "Fireplaces": 0.0, "GarageCars": 0.0,
        "GarageArea": 0.0, "WoodDeckSF": 0.0, "OpenPorchSF": 0.0, "EnclosedPorch": 0.0,
        "3SsnPorch": 0.0, "ScreenPorch": 0.0, "PoolArea": 0.0, "MiscVal": 0.0,
        "OverallQual": 5.0, "OverallCond": 5.0,
    },
    always_present=("1stFlrSF", "2ndFlrSF", "3SsnPorch"),
    range_checks={"OverallQual": (0.0, 10.0), "OverallCond": (0.0, 10.0)},
)


# --------------------------------------------------------------------------
# One row per order, built from orders, customer, nation and lineitem.
# --------------------------------------------------------------------------

SALES_SPEC = ColumnSpec(
    name="sales",
    id_col="o_orderkey",
    target_col="o_totalprice",
    drop_cols=("o_orderkey",),
    none_fill_categorical=("line_status",),
    none_fill_numeric=("n_lines", "line_qty", "line_price"),
    group_impute=("c_acctbal", "n_name"),
    ordinal={
        "o_orderpriority": ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"),
        "line_status": ("None", "O", "F"),
    },
    nominal=("c_mktsegment", "o_orderstatus", "n_name"),
    numeric=(
        "n_lines", "line_qty", "line_price", "max_discount", "max_tax",
        "c_acctbal", "order_year", "order_month", "last_ship_year", "ship_lag_days",
    ),
    features=(
        FeatureDef("gross_per_line", "ratio_p1", ("line_price", "n_lines")),
        FeatureDef("qty_per_line", "ratio_p1", ("line_qty", "n_lines")),
        FeatureDef("has_lines", "gt0_flag", ("n_lines",)),
        FeatureDef("positive_balance", "gt0_flag", ("c_acctbal",)),
        FeatureDef("tax_minus_discount", "weighted_sum", ("max_tax", "max_discount"), (1.0, -1.0)),
        FeatureDef("lines_and_units", "sum_nullzero", ("n_lines", "line_qty")),
        FeatureDef("month_index", "weighted_sum", ("order_year", "order_month"), (12.0, 1.0)),
        FeatureDef("years_to_ship", "diff_clip0", ("last_ship_year", "order_year")),
        FeatureDef("ship_year_changed", "ne_flag", ("last_ship_year", "order_year")),
        FeatureDef("same_year_ship", "eq_flag", ("last_ship_year", "order_year")),
        FeatureDef("year_gap", "diff", ("last_ship_year", "order_year")),
        FeatureDef("balance_x_lines", "product", ("c_acctbal", "n_lines")),
        FeatureDef("qty_share", "ratio_p1", ("line_qty", "lines_and_units")),
        FeatureDef("price_and_qty", "sum", ("line_price", "line_qty")),
    ),
    tail_cols=("line_qty", "line_price", "c_acctbal", "ship_lag_days", "max_discount"),
    known_error=KnownError("n_lines", 7.0, 100000.0),
    caps={"line_qty": 300.0},
    box_group="o_orderpriority",
    scatter=("line_price", "o_totalprice", "n_lines"),
    scoring_defaults={"n_lines": 0.0, "line_qty": 0.0, "line_price": 0.0, "max_discount": 0.0},
    always_present=("n_lines",),
    range_checks={"order_month": (1.0, 12.0)},
)
