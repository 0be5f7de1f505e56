"""Merkle manifest of a dataset by butterfly exchange.

Every row is a leaf, the digest of its columns.  The leaves of one group ascend
by id; every ``arity`` consecutive nodes, the last of them fewer, become their
digest until one, the group's subroot, remains.  The subroots, ordered by group,
give the root in the same way.  A row's *path* lists, level by level, its place
among its siblings and their digests, which is all it takes to check the row
against the root later (``fold``).

1. *Places.*  Leaves, not texts, are dealt by ranges of (group, id); counts per
   range and group turn places in a range into places in the group.
2. *Blocks.*  ``block`` consecutive leaves, an aligned subtree, are one block,
   read as a stream; of each block one row with the subtree's root is left.
3. *Butterfly.*  Blocks have seats.  In each round the seats whose numbers
   differ in one digit (base ``exchange``) only swap their subtrees' roots;
   every seat then hashes the ancestors of that group itself, notes its own
   siblings, and stands for the larger subtree.  After ``log(blocks)`` rounds
   every seat has its whole upper path, and nothing is sent down again.  Where
   the last subtree is not full, empty seats, fewer than there are blocks, take
   part, so that no seat lacks a partner.
4. Paths within a block and above it are joined on the block.

Work per row is one digest and its share of the levels; a task holds one block
or one group of an exchange.  Nothing is collected but the number of rounds.

Defined cases: a null value is ``-``, also a null group, which comes first; null
ids come before others; rows with equal ids ascend by leaf, so repeated rows are
leaves side by side; an empty table gives an empty result; columns of other
names are not part of a leaf, and none of them can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 2
BLOCK = 1024
EXCHANGE = 16


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: list[Column]) -> Column:
    """Digest of a row; every value goes with its length, so none run together."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def height_of(n: int, arity: int) -> int:
    """Levels above ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def tree(nodes: list[str], levels: int, arity: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def step(nodes: list[str], i: int, arity: int) -> str:
    """One level of a path: the place of node ``i`` in its run, and the others."""
    first = i - i % arity
    return f"{i % arity}:{''.join(nodes[first:i])}{''.join(nodes[i + 1:first + arity])}"


def path_of(levels: list[list[str]], i: int, arity: int) -> str:
    """The path of leaf ``i`` to the last of ``levels``."""
    return ",".join(step(nodes, i // arity ** k, arity) for k, nodes in enumerate(levels[:-1]))


def fold_path(leaf: str, path: str) -> tuple[str, str]:
    """The root that a leaf and its path lead to, and the digest of all siblings."""
    siblings = []
    for level in path.split(",") if path else []:
        place, others = level.split(":")
        siblings.append(others)
        at = 64 * int(place)
        leaf = digest([others[:at], leaf, others[at:]])
    return leaf, digest(siblings)


def _strings(col: pa.Array) -> list:
    return col.to_pylist()


def _places(leaves: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``, the rank within the group, and ``total``, its size."""
    keys = [F.col("grp"), *order, F.col("leaf"), F.col("tie")]
    dealt = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = dealt.drop("tie").withColumns({"part": F.spark_partition_id(), "nth": F.lit(0).cast("long")})
    at = marked.columns.index("nth")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, count = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            groups = np.array(_strings(b.column("grp")), dtype=object)
            first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            begin = np.zeros(len(groups), np.int64)
            begin[first] = first
            nth = np.arange(len(groups)) - np.maximum.accumulate(begin)
            if groups[0] == group:
                nth[:first[1] if len(first) > 1 else len(nth)] += count
            group, count = groups[-1], int(nth[-1]) + 1
            yield b.set_column(at, b.schema.field(at), pa.array(nth))

    placed = cut_lineage(marked.mapInArrow(number, marked.schema))
    counts = placed.groupBy("grp", "part").agg((F.max("nth") + 1).alias("n"))
    whole = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("grp", "part", before.alias("before"), F.sum("n").over(whole).alias("total"))
    return placed.join(starts, ["grp", "part"]).withColumn("place", F.col("before") + F.col("nth")).drop("part", "nth", "before")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """``(group, block, total)`` and its rows, from a stream sorted by block."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        groups = np.array(_strings(b.column("grp")), dtype=object)
        block = b.column("block").to_numpy()
        new = np.flatnonzero((groups[1:] != groups[:-1]) | (block[1:] != block[:-1])) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(block)], strict=True):
            own = groups[lo], int(block[lo]), b.column("total")[lo].as_py()
            if own != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = own
            held.append(b.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def _block_height(total: int, block: int, arity: int) -> int:
    return height_of(min(total, block), arity)


def _block_roots(members: DataFrame, arity: int, block: int, exchange: int) -> DataFrame:
    """A seat per block, with the root of its subtree, and the empty seats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, number, total), rows in _by_block(batches):
            root = tree(_strings(rows["leaf"]), _block_height(total, block, arity), arity)[-1][0]
            blocks = -(-total // block)
            seats, wide = blocks, exchange ** max(0, height_of(blocks, exchange) - 1)
            seats = -(-blocks // wide) * wide
            numbers, roots = [number], [root]
            if blocks + number < seats:
                numbers.append(blocks + number)
                roots.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group] * len(numbers)), pa.array(numbers, pa.int64()), pa.array([blocks] * len(numbers), pa.int64()),
                 pa.array(roots, pa.string()), pa.array([""] * len(numbers))], names=["grp", "seat", "blocks", "root", "path"])

    return members.select("grp", "block", "total", "leaf").mapInArrow(run, "grp string, seat long, blocks long, root string, path string")


def _exchange_round(seats: DataFrame, turn: int, arity: int, exchange: int) -> DataFrame:
    """All seats that differ in digit ``turn`` only swap roots and go on as the
    root of what they stand for together."""
    per_round, wide = height_of(exchange, arity), exchange ** turn
    low, high = F.col("seat") % wide, F.floor(F.col("seat") / (wide * exchange))
    digit = F.floor(F.col("seat") / wide) % exchange
    partners = Window.partitionBy("grp", high, low)
    swapped = F.sort_array(F.collect_list(F.when(F.col("root").isNotNull(), F.struct(digit.alias("digit"), "root"))).over(partners))
    dealt = seats.select("grp", "seat", "blocks", "path", digit.alias("digit"), F.col("root").alias("own"),
                         F.transform(swapped, lambda x: x["root"]).alias("roots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots, paths = [], []
            for blocks, path, d, nodes in zip(*(_strings(b.column(c)) for c in ("blocks", "path", "digit", "roots")), strict=True):
                levels = min(per_round, max(0, height_of(blocks, arity) - turn * per_round))
                above = tree(nodes, levels, arity) if nodes else [[None]]
                own = path_of(above, d, arity) if d < len(nodes) else ""
                roots.append(above[-1][0])
                paths.append(",".join(x for x in (path, own) if x))
            yield pa.RecordBatch.from_arrays([b.column("grp"), b.column("seat"), b.column("blocks"), pa.array(roots, pa.string()),
                                              pa.array(paths, pa.string())], names=["grp", "seat", "blocks", "root", "path"])

    return dealt.mapInArrow(run, seats.schema)


def prove(leaves: DataFrame, order: list[Column], arity: int = ARITY, block: int = BLOCK,
          exchange: int = EXCHANGE) -> tuple[DataFrame, DataFrame]:
    """Trees over the rows of each ``grp`` (a string, never null) by ``order``.

    Returns ``leaves`` with ``block`` and ``path``, the path within the block,
    and ``grp, block, subroot, upper``: the tree's root and the path to it from
    the block.  ``block`` must be a power of ``arity``, ``exchange`` as well.
    """
    if arity ** height_of(block, arity) != block or arity ** height_of(exchange, arity) != exchange:
        raise ValueError("block and exchange must be powers of arity")
    own = leaves.columns
    members = cut_lineage(_places(leaves, order).withColumn("block", F.floor(F.col("place") / block))
                          .repartition("grp", "block").sortWithinPartitions("grp", "block", "place").drop("place"))
    seats = cut_lineage(_block_roots(members, arity, block, exchange))
    most = seats.agg(F.max("blocks")).first()[0] or 0
    for turn in range(height_of(most, exchange)):
        seats = _exchange_round(seats, turn, arity, exchange)
    upper = cut_lineage(seats.where(F.col("seat") < F.col("blocks")).select(
        "grp", F.col("seat").alias("block"), F.col("root").alias("subroot"), F.col("path").alias("upper")))
    shown = members.select(*own, "block", "total", F.lit("").alias("path"))
    at = shown.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, total), rows in _by_block(batches):
            levels = tree(_strings(rows["leaf"]), _block_height(total, block, arity), arity)
            paths = [path_of(levels, i, arity) for i in range(rows.num_rows)]
            yield from rows.set_column(at, rows.schema.field(at), pa.array(paths, pa.string())).combine_chunks().to_batches()

    return shown.mapInArrow(run, shown.schema).drop("total"), upper


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang",
             also: dict[str, Column] | None = None, arity: int = ARITY, block: int = BLOCK,
             exchange: int = EXCHANGE) -> DataFrame:
    """``id, group, leaf, subroot, root, path`` of every row, and the columns
    ``also`` made from the row."""
    group = F.col(f"`{group_col}`").cast("string")
    leaves = cut_lineage(docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("grp"), F.col(f"`{id_col}`").alias("id"),
        leaf_of([F.col(f"`{c}`") for c in columns]).alias("leaf"),
        *[v.alias(k) for k, v in (also or {}).items()]))
    rows, upper = prove(leaves, [F.col("id").asc_nulls_first()], arity, block, exchange)
    tops, above = prove(upper.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("of"), F.col("subroot").alias("leaf")),
                        [F.col("of")], arity, block, exchange)
    tops = tops.join(above, ["grp", "block"]).select(
        F.col("of").alias("grp"), F.col("subroot").alias("root"), _joined("path", "upper").alias("top"))
    whole = upper.join(tops, "grp").select("grp", "block", "subroot", "root", _joined("upper", "top").alias("upper"))
    return rows.join(whole, ["grp", "block"]).select(
        F.col("id").alias(id_col), F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30)).alias("group"), "leaf", "subroot",
        "root", _joined("path", "upper").alias("path"), *(also or {}))


def _joined(*paths: str) -> Column:
    return F.concat_ws(",", *[F.nullif(F.col(p), F.lit("")) for p in paths])


def fold(rows: DataFrame, leaf_col: str = "leaf") -> DataFrame:
    """Adds ``folded_root``, which ``leaf_col`` and the row's ``path`` lead to,
    and ``proof_sha256``, the digest of the path's siblings."""
    shown = rows.withColumns({"folded_root": F.lit("").cast("string"), "proof_sha256": F.lit("").cast("string")})
    at = shown.columns.index("folded_root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [fold_path(*x) for x in zip(_strings(b.column(leaf_col)), _strings(b.column("path")), strict=True)]
            for k in (0, 1):
                b = b.set_column(at + k, b.schema.field(at + k), pa.array([x[k] for x in out], pa.string()))
            yield b

    return shown.mapInArrow(run, shown.schema)


def verify(docs: DataFrame, kept: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id") -> DataFrame:
    """``id, verified`` of documents against a kept manifest (``manifest``) of
    unique ids: whether the row as it is now leads to the kept root."""
    now = docs.select(F.col(f"`{id_col}`").alias(id_col), leaf_of([F.col(f"`{c}`") for c in columns]).alias("now"))
    known = now.join(kept.select(id_col, "root", "path"), id_col, "left")
    lost = F.col("path").isNull()
    found = fold(known.where(~lost), "now").select(id_col, (F.col("folded_root") == F.col("root")).alias("verified"))
    return found.unionAll(known.where(lost).select(id_col, F.lit(False).alias("verified")))


def tamper_check(docs: DataFrame, divisor: int = 7, id_col: str = "doc_id", group_col: str = "lang",
                 changed: str = "n_chars") -> DataFrame:
    """The manifest, with rows checked after one value of some of them grew by
    one: those whose id's CRC-32 ``divisor`` divides."""
    own = F.col(f"`{id_col}`")
    hit = F.coalesce(F.crc32(own.cast("string").cast("binary")) % divisor == 0, F.lit(False))
    other = leaf_of([F.try_add(F.col(f"`{c}`"), F.lit(1)) if c == changed else F.col(f"`{c}`") for c in COLUMNS])
    rows = manifest(docs, COLUMNS, id_col, group_col, also={"other": F.when(hit, other)})
    out = fold(rows.withColumn("claimed", F.coalesce("other", "leaf")), "claimed")
    return out.select(id_col, "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), "path")
