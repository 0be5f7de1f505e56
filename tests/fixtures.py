"""Synthetic house table generated in Spark from ``range(n)``.

Column names come from the declared spec; ordinal values from its rank lists,
nominal values and number ranges from the rules below.  Values are derived by
hash per (row, column, seed), so the table is the same for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.spec import HOUSE_SPEC as H

# Own number ranges, low to high inclusive, by the first part that a name has.
RANGES = [
    ("Overall", 1, 10), ("YrSold", 2001, 2012), ("MoSold", 1, 12), ("Year", 1930, 2000), ("Yr", 1930, 2000),
    ("LotArea", 2000, 60_000), ("LotFrontage", 15, 140), ("GrLivArea", 600, 3900), ("AbvGr", 1, 9),
    ("Bath", 0, 3), ("Cars", 0, 3), ("Fireplaces", 0, 2), ("MiscVal", 0, 500), ("", 0, 1500),
]
MISSING = 0.04     # of the columns whose missing values have a meaning or a group to fill from
NOMINAL = 5        # values of a nominal column


def attributes() -> dict[str, tuple]:
    """``name: values`` for text columns and ``name: (low, high)`` for numbers."""
    out: dict[str, tuple] = {}
    for name, ranks in H.ordinal.items():
        out[name] = tuple(ranks)
    for name in H.nominal:
        out[name] = tuple(f"{name}-{chr(97 + i)}" for i in range(NOMINAL))
    out["MSSubClass"] = tuple(float(20 + 10 * i) for i in range(NOMINAL))
    for name in H.numeric:
        out[name] = next((lo, hi) for part, lo, hi in RANGES if part in name)
    return out


def _u(i: int, seed: int, salt: int = 0) -> Column:
    h = F.xxhash64(F.col("id"), F.lit(seed), F.lit(i), F.lit(salt))
    return F.pmod(h, F.lit(1 << 30)).cast("double") / float(1 << 30)


def house_table(spark: SparkSession, n: int = 300, seed: int = 7, signal: bool = False) -> DataFrame:
    """``Id`` 1..n, the attributes of the spec and the target.

    With ``signal`` the target follows living area and quality with a little
    noise, so that model quality can be judged; otherwise it is noise."""
    holed = {*H.none_fill_categorical, *H.none_fill_numeric, H.group_impute[0]}
    cols = [F.col("id").alias("Id")]
    for i, (name, domain) in enumerate(attributes().items()):
        u = _u(i, seed)
        if name in H.numeric:
            low, high = domain
            v = F.floor(F.lit(float(low)) + u * float(high - low + 1)).cast("double")
        else:
            v = F.element_at(F.array(*[F.lit(x) for x in domain]), (F.floor(u * len(domain)) + 1).cast("int"))
        if name in holed:
            v = F.when(_u(i, seed, 1) >= MISSING, v)
        cols.append(v.alias(name))
    df = spark.range(1, n + 1).select(*cols)
    noise = _u(len(cols), seed)
    if signal:
        price = 40_000.0 + 55.0 * F.col("GrLivArea") + 12_000.0 * F.col("OverallQual") + 15_000.0 * noise
    else:
        price = F.floor(70_000.0 + noise * 500_000.0)
    return df.withColumn(H.target_col, price.cast("double"))
