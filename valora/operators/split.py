"""Deterministic hold-out split and k-fold assignment (G1, G2) with exact sizes.

A row's place is its rank by (hash of the id, id as text): the first
``ceil(test_size * n)`` ranks are the hold-out, and fold ``i`` holds the ranks
from ``ceil(i * n / k)`` on.  No row is ranked: the hash values at those ranks
are found digit by digit.  Hashes are counted in ``CELLS`` cells by their first
bits, then only the cells that hold a wanted rank by their next bits, until one
hash value is left per rank; its distinct ids (more than one only where 48 bits
collide) give the place.  The driver sees at most ``CELLS`` counts per rank and
level, however many rows there are; cells of at most ``CELLS`` rows in all are
settled by their ids at once.  Every row is then placed by a
comparison, without a shuffle.  The hash is part of an MD5 digest under a salt of its own per use, so
split and folds are independent; it works for ids of any type, and SQL can
restate it.

A null id counts as the empty text: such rows are placed like any other and
none is lost.  Rows with equal ids have one place, and stay together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.functions.exprs import c
from valora.spec import SETTINGS, Settings

CELLS = 1 << 16
HEX_DIGITS = 12  # of the digest: 48 bits


def split_salt(settings: Settings = SETTINGS) -> str:
    return f"split-{settings.seed}"


def fold_salt(settings: Settings = SETTINGS) -> str:
    return f"fold-{settings.seed}"


def _id_text(id_col: Column) -> Column:
    return F.coalesce(id_col.cast("string"), F.lit(""))


def hash_int(id_col: Column, salt: str) -> Column:
    """48 bits of the MD5 digest of the salt and the id."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), _id_text(id_col)).cast("binary"))
    return F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("long")


def hash_int_sql(id_sql: str, salt: str) -> str:
    """The same hash as SQL text (for the oracle)."""
    digest = f"md5('{salt}:' || coalesce(CAST({id_sql} AS VARCHAR), ''))"
    return f"CAST('0x' || substr({digest}, 1, {HEX_DIGITS}) AS BIGINT)"


def rank_sql(id_sql: str, salt: str) -> str:
    """The 0-based rank as SQL text."""
    return (f"(row_number() OVER (ORDER BY {hash_int_sql(id_sql, salt)}, "
            f"coalesce(CAST({id_sql} AS VARCHAR), '')) - 1)")


def _places_at(df: DataFrame, id_col: str, salt: str,
               ranks_of: Callable[[int], list[int]]) -> tuple[int, list[tuple[int, str]]]:
    """The row count ``n``, and ``(hash, id as text)`` at the 0-based ranks
    ``ranks_of(n)``."""
    rows = df.select(hash_int(c(id_col), salt).alias("h"), _id_text(c(id_col)).alias("t"))
    bits, step = 4 * HEX_DIGITS, int(math.log2(CELLS))

    def counted(part: DataFrame, key: list[str]) -> list:
        return sorted(tuple(r) for r in part.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).collect())

    def holding(counts: list, offsets: dict[int, int], ranks: list[int], inside: Callable) -> dict[int, tuple]:
        """For each rank the counted entry that holds it, and the rows before that
        entry; ``offsets`` has the rows before each entry's parent ``inside(entry)``."""
        out, at = {}, dict(offsets)
        for *entry, size in counts:
            parent = inside(entry)
            before = at[parent]
            out.update({r: (entry, before) for r in ranks if before <= r < before + size and under[r] == parent})
            at[parent] = before + size
        return out

    shift = bits - step
    counts = counted(rows.select(F.shiftright("h", shift).alias("cell")), ["cell"])
    n = sum(size for _, size in counts)
    ranks = ranks_of(n)
    under = dict.fromkeys(ranks, 0)   # the cell found for each rank so far
    found = holding(counts, {0: 0}, ranks, lambda e: 0)
    while ranks:
        under = {r: found[r][0][0] for r in ranks}
        offsets = {cell: before for (cell, *_), before in found.values()}
        own = rows.where(F.shiftright("h", shift).isin(list(offsets)))
        held = {e[0]: size for *e, size in counts if e[0] in offsets}
        if shift == 0 or sum(held.values()) <= CELLS:  # one hash value per rank, or few rows: their ids are counted
            found = holding(counted(own, ["h", "t"]), offsets, ranks, lambda e, by=shift: e[0] >> by)
            break
        finer = max(0, shift - step)
        counts = counted(own.select(F.shiftright("h", finer).alias("cell")), ["cell"])
        found = holding(counts, offsets, ranks, lambda e, by=shift - finer: e[0] >> by)
        shift = finer
    return n, [tuple(found[r][0]) for r in ranks]


def _at_or_after(id_col: Column, salt: str, place: tuple[int, str]) -> Column:
    h, t = hash_int(id_col, salt), _id_text(id_col)
    return (h > F.lit(place[0])) | ((h == F.lit(place[0])) & (t >= F.lit(place[1])))


def with_split(df: DataFrame, id_col: str, settings: Settings = SETTINGS,
               col: str = "is_test") -> DataFrame:
    """G1: add ``is_test``, true for exactly ``ceil(test_size * n)`` rows (fewer
    only where equal ids straddle the cut)."""
    salt = split_salt(settings)
    n, places = _places_at(df, id_col, salt, lambda n: [
        r for r in [math.ceil(settings.test_size * n - 1e-9)] if 0 < r < n])
    if not places:
        return df.withColumn(col, F.lit(n > 0 and settings.test_size >= 1))
    return df.withColumn(col, ~_at_or_after(c(id_col), salt, places[0]))


def train_test_split(df: DataFrame, id_col: str, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    marked = with_split(df, id_col, settings, "__is_test")
    return (marked.where(~F.col("__is_test")).drop("__is_test"),
            marked.where(F.col("__is_test")).drop("__is_test"))


def with_folds(df: DataFrame, id_col: str, k: int | None = None, settings: Settings = SETTINGS,
               col: str = "fold") -> DataFrame:
    """Integer fold in [0, k); sizes differ by at most one."""
    k, salt = k or settings.cv_folds, fold_salt(settings)

    def starts(n: int) -> dict[int, int]:
        """First rank of each fold that has rows; of empty folds the last counts."""
        return {-(-i * n // k): i for i in range(1, k) if -(-i * n // k) < n}

    n, places = _places_at(df, id_col, salt, lambda n: sorted(starts(n)))
    fold = F.lit(0)
    for (_, i), place in zip(sorted(starts(n).items()), places, strict=True):
        fold = F.when(_at_or_after(c(id_col), salt, place), F.lit(i)).otherwise(fold)
    return df.withColumn(col, fold.cast("int"))
