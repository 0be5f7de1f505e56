"""Column expressions: feature derivation, null handling, metric terms."""

from valora.functions.exprs import (
    NA_MARKERS,
    c,
    clip,
    inverse_log_target,
    log_target,
    nan_to_null,
    pct_text,
    round_doubles,
    safe_div,
)
from valora.functions.features import engineer_features, feature_columns

__all__ = [
    "NA_MARKERS", "c", "clip", "inverse_log_target", "log_target", "nan_to_null",
    "pct_text", "round_doubles", "safe_div", "engineer_features", "feature_columns",
]
