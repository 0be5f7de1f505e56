"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: bit ``i`` of a text's 64 bits is set if it is set in over half
of the XXH64 hashes of its word shingles.

Links: two fingerprints link at ``radius`` or fewer differing bits.  A
covering family (published by Pagh, "CoveringLSH", 2016) gives each bit
position a vector of ``radius + 1`` bits; each of the ``2^(radius + 1) - 1``
non-zero vectors ``v`` makes one table, whose mask holds the positions with an
odd product with ``v``.  Any ``radius`` positions have vectors that leave some
``v`` orthogonal to all of them, so a pair within the radius agrees on that
table's whole mask: no pair is missed.

Distinct fingerprints, not documents, enter the tables, so copies cost
nothing.  A bucket is compared inside one task, up to ``BUCKET`` fingerprints,
and gives a spanning forest of its links rather than pairs; a larger bucket
goes on to the next level, where a second, independent family of masks splits
it further, with the same guarantee.  As a bucket holds distinct values of the
bits outside its mask, a few levels bound it.  Components come from star
contraction over the forest.

Defined cases: a null or empty text, or one without words, has fingerprint 0,
which links like any other; a text with fewer words than the shingle length is
one shingle; repeated rows keep a row each; null ids keep a row, do not count
as smallest id, and a component with null ids only has a null id; columns
besides id and text take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.components import components
from valora.llm.text import column_bytes
from valora.session import cut_lineage

BUCKET = 1024
LEVELS = 4


def fingerprint(text: bytes, shingle: int, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    hash_of = xxhash.xxh64_intdigest
    if len(words) < shingle:
        h = [hash_of(joined, seed)]
    else:
        h = [hash_of(joined[s:e], seed) for s, e in zip(starts, ends[shingle - 1:].tolist(), strict=False)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.array(h[i:i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, mark, fp``: a hash of the text, which tells rows with one id apart,
    and the fingerprint as a long; one pass, no shuffle."""
    text = F.col(f"`{text_col}`").cast("string")
    doc = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    kind = doc.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b.column(2))
            at = off.tolist()
            fp = np.fromiter((fingerprint(data[at[i]:at[i + 1]].tobytes(), shingle) for i in range(b.num_rows)),
                             np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["id", "mark", "fp"])

    return doc.mapInArrow(run, f"id {kind}, mark long, fp long")


def covering_masks(radius: int, level: int = 0) -> list[int]:
    """Masks of one covering family over 64 bits; levels are independent."""
    size = (1 << (radius + 1)) - 1
    order = np.random.default_rng(1000 + level).permutation(64)
    vector = [0] * 64
    for rank, position in enumerate(order.tolist()):
        vector[position] = rank % size + 1
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a bucket as ``(fingerprint, smallest linked one)``."""
    u = x.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(x))
    return x[moved], x[label[moved]]


def _compare(rows: DataFrame, radius: int, last: bool) -> DataFrame:
    """``a, b, mask`` from rows ``mask, fp`` sorted by bucket: links (mask 0),
    and the rows of buckets that are too large (a is the fingerprint)."""
    bucket: Column = F.col("mask").bitwiseAND(F.col("fp"))
    dealt = rows.repartition("mask", bucket).sortWithinPartitions("mask", bucket, "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        over: tuple[int, int] | None = None  # the bucket that has been found too large

        def settle(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal mask, fp, over
            key = mask & fp
            edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            start = np.concatenate([[0], edge]).astype(np.int64)
            end = np.append(edge, len(fp))
            a, b, m = [], [], []
            keep = len(fp)
            seen = (end - start > 1) | (end == len(fp))
            seen[0] |= len(fp) > 0 and over == (int(mask[0]), int(key[0]))  # the rest of a large bucket, if one row
            for i in np.flatnonzero(seen).tolist() if len(fp) else []:
                s, e = int(start[i]), int(end[i])
                own = (int(mask[s]), int(key[s]))
                if not last and (own == over or e - s > BUCKET):
                    over = own
                    a.append(fp[s:e])
                    b.append(fp[s:e])
                    m.append(mask[s:e])
                elif e == len(fp) and not final:
                    keep = s  # may go on in the next batch
                elif e - s > 1:
                    x, y = _forest(fp[s:e], radius)
                    a.append(x)
                    b.append(y)
                    m.append(np.zeros(len(x), np.int64))
            mask, fp = mask[keep:], fp[keep:]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (a, b, m)], names=["a", "b", "mask"])

        for batch in batches:
            mask = np.concatenate([mask, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
            yield from settle(False)
        yield from settle(True)

    return dealt.mapInArrow(run, "a long, b long, mask long")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints that span all components."""
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius)])
    rows = fps.select(F.explode(masks).alias("mask"), "fp")
    edges = None
    for level in range(1, LEVELS + 1):
        found = cut_lineage(_compare(rows, radius, last=level == LEVELS))
        part = found.where("mask = 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
        edges = part if edges is None else edges.union(part)
        large = found.where("mask <> 0")
        if level == LEVELS or large.isEmpty():
            break
        finer = F.array(*[F.lit(_signed(m)).cast("long") for m in covering_masks(radius, level)])
        rows = large.select("mask", F.explode(finer).alias("more"), F.col("a").alias("fp")).select(
            F.col("mask").bitwiseOR(F.col("more")).alias("mask"), "fp").distinct()
    return edges


def _rooted(docs: DataFrame, shingle: int, radius: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows ``id, mark, fp``, and ``fp, first, root`` per distinct
    fingerprint: its smallest id, and the fingerprint its component is named by."""
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    first = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("first")))
    roots = components(links(first.select("fp"), radius))
    joined = (first.join(roots, first["fp"] == roots["node"], "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    return rows, joined


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``id, fingerprint, component_id`` for every row; see the module's text."""
    rows, joined = _rooted(docs, shingle, radius, id_col, text_col)
    smallest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    component = joined.join(smallest, "root").select("fp", "component_id")
    return (rows.join(component, "fp")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    "component_id"))


def representatives(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns as they are: that with the
    smallest id (null last), then text hash; one of rows that agree on both."""
    rows, joined = _rooted(docs, shingle, radius, id_col, text_col)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "mark")
    own = rows.groupBy("fp").agg(F.min(order).alias("least"))
    least = own.join(joined, "fp").groupBy("root").agg(F.min("least").alias("least")).select("least.id", "least.mark")
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                         F.col(f"`{id_col}`").alias("id"),
                         F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("mark"))
    kept = marked.alias("m").join(least.alias("l"), F.expr("m.id <=> l.id AND m.mark = l.mark"), "left_semi")
    once = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.lit(1)))
    return kept.withColumn("__once", once).where("__once = 1").select(*columns)
