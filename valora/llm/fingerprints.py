"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash
range (``1 / scale``).  Sketches of one scale merge by union, and the part of
one that lies in another estimates containment, however unequal the two
documents are.  A fingerprint is that sketch as text, headed by a digest of
the whole word sequence, so texts with equal words, and only those, have equal
fingerprints even where a short text keeps no hash.

``edited_fingerprints`` also fingerprints an edited form of each text that
takes its second half from the next document in id order.  For that the rows
are dealt by ranges of (id, text hash): the ids' range is cut into at most
``CELLS`` equal cells; a cell that holds more than a part is cut again over the
range of its own ids, or of its text hashes if it has one id only, until none
does.  Neighbouring cells form parts of about ``PART_BYTES`` of text (a share
of ``1 / CELLS`` of very large tables), and the first row of each part is also
sent to the part before it.  Each part is then a sorted stream in which a row
meets the next one; the texts are shuffled once and no part has to fit in
memory.  Only rows that repeat entirely, id and text, cannot be parted.

Defined cases: a null text is an empty one; an empty text, or one without
words, has no shingles; fewer words than a shingle's length are one shingle;
A-Z are lowered for shingles; two sketches without any hash are alike (1) if
the fingerprints are equal and unlike (0) otherwise; rows with equal ids
follow each other by text hash, null ids come last; a single row is its own
next; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm import text as tx
from valora.session import cut_lineage

SHINGLE = 5
SCALE = 4
CELLS = 1 << 16
PART_BYTES = 8 << 20
SLICE_BYTES = 4 << 20


def _word_hashes(b: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    low = b._replace(buf=tx.lower_ascii(b.buf))
    w = tx.words(low)
    return tx.span_hash(tx.prefix_hash(low.buf), w.starts, w.ends), w.first


def sketches(col: pa.Array, shingle: int = SHINGLE, scale: int = SCALE) -> list[tuple[str, np.ndarray]]:
    """``(fingerprint, sorted distinct hashes below the threshold)`` per text."""
    top = np.uint64((1 << 64) // scale - 1)
    none = np.zeros(0, np.uint64)
    out: list[tuple[str, np.ndarray]] = [("0" * 16, none)] * len(col)
    for row, h, first in tx.row_values(col, _word_hashes):
        counts = np.diff(first)
        rolled = tx.roll(h, shingle)
        kept = np.flatnonzero(rolled <= top)
        kept = kept[kept + shingle <= first[np.searchsorted(first, kept, "right")]]  # within one row
        value, at = rolled[kept], np.searchsorted(kept, first)
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], counts).astype(np.uint64)
        digest = tx.mix(tx.segment_sums(tx.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first))
        for k in np.flatnonzero(counts).tolist():
            if counts[k] < shingle:
                own = digest[k:k + 1]
                own = own[own <= top]
            else:
                own = np.unique(value[at[k]:at[k + 1]])
            code = base64.b64encode(own.astype("<u8").tobytes()).decode()
            out[row + k] = (f"{int(digest[k]):016x}{code}", own)
    return out


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray]) -> tuple[float, float]:
    """Estimated Jaccard likeness, and containment of the first in the second."""
    if a[0] == b[0]:
        return 1.0, 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0, 0.0
    shared = int(np.isin(a[1], b[1], assume_unique=True).sum())
    return shared / (len(a[1]) + len(b[1]) - shared), shared / len(a[1])


Place = tuple[int, int, int]   # null id, id (0 if null), text hash: the order of the rows
LEAST = -(1 << 63)


def _cell_of(bounds: list[Place]):
    """A function of Arrow-backed columns: twice the number of the last bound at
    or before a row, and 1 more if the row is at it."""
    keys = np.array(bounds, np.int64).reshape(-1, 3)

    @F.pandas_udf("long")
    def cell(null: pd.Series, i: pd.Series, mark: pd.Series) -> pd.Series:
        rows = np.stack([null.to_numpy(np.int64), i.to_numpy(np.int64), mark.to_numpy(np.int64)], 1)
        both = np.concatenate([keys, rows])
        row = np.arange(len(both)) >= len(keys)
        order = np.lexsort((row, both[:, 2], both[:, 1], both[:, 0]))   # a bound comes before its rows
        at = np.empty(len(both), np.int64)
        at[order] = np.cumsum(~row[order]) - 1
        at = at[len(keys):]
        return pd.Series(2 * at + (keys[at] == rows).all(1))

    return cell


def _cut(least: int, most: int, pieces: int) -> list[int]:
    """Starts of the second and further of equal ranges from ``least`` to ``most``."""
    width = (most - least) // pieces + 1
    return list(range(least + width, most + 1, width))


def _parts(rows: DataFrame) -> list[Place]:
    """The first row of each part of ``null, id, mark, bytes``.  The driver sees
    cells only, at most a small multiple of ``CELLS``."""
    total, low, high = rows.agg(F.sum("bytes"), F.min(F.when(F.col("null") == 0, F.col("id"))),
                                F.max(F.when(F.col("null") == 0, F.col("id")))).first()
    if not total:
        return []
    limit = max(PART_BYTES, total // CELLS)
    bounds = [(0, low, LEAST), *[(0, x, LEAST) for x in _cut(low, high, CELLS)]] if low is not None else []
    bounds.append((1, 0, LEAST))
    cells: list[tuple[Place, int]] = []   # first row and bytes of those that are small enough
    place = F.struct("null", "id", "mark")
    while bounds:
        cell = _cell_of(bounds)
        dealt = rows.select("*", F.shiftright(cell("null", "id", "mark"), 1).alias("cell"))
        found = dealt.where("cell >= 0").groupBy("cell").agg(
            F.sum("bytes"), F.min(place), F.max(place), F.min("mark"), F.max("mark")).collect()
        bounds, heavy = [], []
        for _, size, least, most, low_mark, high_mark in sorted(found, key=lambda r: r["cell"]):
            pieces = 2 * -(-size // limit) + 2
            if size <= limit or tuple(least) == tuple(most):
                cells.append((tuple(least), size))
            elif least["id"] < most["id"]:
                heavy.append((tuple(least), tuple(most)))
                bounds += [tuple(least), *[(least["null"], x, LEAST) for x in _cut(least["id"], most["id"], pieces)]]
            else:
                heavy.append((tuple(least), tuple(most)))
                bounds += [tuple(least), *[(least["null"], least["id"], x) for x in _cut(low_mark, high_mark, pieces)]]
        if heavy:   # only their rows are looked at again
            ends = _cell_of([x for pair in heavy for x in pair])("null", "id", "mark")
            rows = rows.where(ends.isNotNull() & (ends >= 0) & ((F.shiftright(ends, 1) % 2 == 0) | (ends % 2 == 1)))
    firsts, size = [], limit
    for first, own in sorted(cells):
        if size >= limit:
            firsts.append(first)
            size = 0
        size += own
    return firsts


def edited_fingerprints(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, id_col: str = "doc_id",
                        text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, containment_edited, containment_next``."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("mark"), F.col("id").isNull().cast("long").alias("null"))
    key = (F.col("null"), F.coalesce("id", F.lit(0)), F.col("mark"))
    firsts = _parts(cut_lineage(rows.select("null", key[1].alias("id"), "mark", (F.octet_length("text") + 1).alias("bytes"))))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(firsts) // 4)
    home = F.struct(F.shiftright("cell", 1).alias("part"), F.lit(False).alias("guest"))
    # the part before the first is the last one
    away = F.struct(F.pmod(F.shiftright("cell", 1) - 1, F.lit(max(1, len(firsts)))).alias("part"), F.lit(True).alias("guest"))
    dealt = (rows.select("id", "text", "mark", _cell_of(firsts or [(0, 0, LEAST)])(*key).alias("cell"))
             .select(F.explode(F.when(F.col("cell") % 2 == 1, F.array(home, away)).otherwise(F.array(home))).alias("at"),
                     "id", "mark", "text")
             .select("at.part", "at.guest", "id", "mark", "text").repartition(tasks, "part")
             .sortWithinPartitions("part", "guest", F.col("id").asc_nulls_last(), "mark")
             .select("part", "guest", "id", "text"))

    def rows_of(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Results of all but the last, which is only a next one."""
        edited, n = [], []
        for a, b in zip(texts, texts[1:], strict=False):
            half = len(a) // 2
            edited.append(a[:len(a) - half] + b[:half])
            n.append(len(a))
        own = sketches(pa.array(texts, pa.large_string()), shingle, scale)
        changed = sketches(pa.array(edited, pa.large_string()), shingle, scale)
        to_edited = [likeness(a, b) for a, b in zip(own, changed, strict=False)]
        to_next = [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], pa.int64()), pa.array(n, pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited], pa.string()),
            pa.array([x[0] for x in own[:-1]], pa.string()), pa.array([x[0] for x in changed], pa.string()),
            *[pa.array([x[i] for x in pairs], pa.float64()) for i in (0, 1) for pairs in (to_edited, to_next)]], names=names)

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "containment_edited", "containment_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, over, size = None, False, 0
        ids: list = []
        texts: list[str] = []
        for b in batches:
            for p, guest, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(),
                                      b.column(3), strict=True):
                if p != part:
                    if len(ids) > 1:
                        yield rows_of(ids, texts)
                    part, over, size, ids, texts = p, False, 0, [], []
                elif over:
                    continue  # further copies of the next part's first row
                over = guest
                t = t.as_py()
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > SLICE_BYTES and len(ids) > 1:
                    yield rows_of(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(t)
        if len(ids) > 1:
            yield rows_of(ids, texts)

    return dealt.mapInArrow(run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double, "
                                 "containment_edited double, containment_next double")
