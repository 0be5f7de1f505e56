"""valora: a Spark-first engine for preparing, profiling, modelling and
scoring wide tables with a numeric target.

Every operator takes and returns Spark DataFrames; fitted operators keep a
small, JSON-serialisable statistics object beside the data.  Column roles come
from a declared :class:`valora.spec.ColumnSpec`, never from operator code.
"""

from valora.spec import HOUSE_SPEC, SALES_SPEC, ColumnSpec, Settings

__all__ = ["ColumnSpec", "Settings", "HOUSE_SPEC", "SALES_SPEC"]
__version__ = "0.1.0"
