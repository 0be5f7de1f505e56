"""Byte-level duplicate removal with suffix arrays built by two-stage sorting.

``suffix_array`` sorts the suffixes of one block: those smaller than their
successor are sorted directly, all others are induced from them by one scan
over the buckets of first bytes (Itoh and Tanaka, 1999).  Adjacent common
prefixes then tell which windows of ``LENGTH`` bytes are equal.  Which
contexts a block holds, and how equal windows of different blocks meet, is
``repeats``'s part.

Defined cases: a null text is empty; a text shorter than a window keeps all
bytes; bytes are those of UTF-8 and a cut may split a character, so the kept
bytes are given as a checksum or as binary; rows with one id and text are one
document, each of which gets its result; different texts with one id follow
each other by text hash; the null id counts as the largest; columns besides id
and text take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm import repeats
from valora.llm import text as tx

LENGTH = 100
GRAM = 32


def _lanes(t: np.ndarray, depth: int) -> np.ndarray:
    """Big-endian 8-byte words that start at every byte, for a padded text."""
    padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded, (len(t) + depth, 8), (1, 1)).view(">u8")[:, 0]


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``t`` (uint8) in order of their first ``depth`` bytes at
    least; suffixes that agree on more than that may come in any order."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    # small: smaller than its successor.  Runs of one byte are as their end is.
    step = np.sign(np.diff(t.astype(np.int16)))
    end = np.flatnonzero(np.append(step != 0, True))
    small = np.append(step, -1)[end[np.searchsorted(end, np.arange(n))]] > 0
    direct = np.flatnonzero(small)
    lanes = _lanes(t, depth)
    keys = [lanes[direct + k].astype(np.uint64) for k in range(0, depth, 8)]
    direct = direct[np.lexsort(keys[::-1])]
    first = t[direct]
    edges = np.searchsorted(first, np.arange(257))
    # scan the buckets; each suffix leads to the one before it, if that is larger
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[t[before] == c]
        bucket.append(direct[edges[c]:edges[c + 1]])
        bucket = np.concatenate(bucket)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = t[before]
        before, byte = before[byte > c], byte[byte > c]
        if len(before):
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            cuts = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cuts):
                waiting[t[part[0]]].append(part)
    return np.concatenate(out)


def adjacent_prefixes(t: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each suffix in ``order`` with the one
    before it; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    lanes = _lanes(t, depth)
    left = np.arange(1, len(order))
    for k in range(0, depth, 8):
        a, b = lanes[order[left - 1] + k].astype(np.uint64), lanes[order[left] + k].astype(np.uint64)
        same = a == b
        x = (a ^ b)[~same]
        byte = np.zeros(len(x), np.int64)
        for shift in (8, 16, 24, 32, 40, 48, 56):
            byte += x < (np.uint64(1) << np.uint64(64 - shift))
        out[left[~same]] = np.minimum(k + byte, depth)
        left = left[same]
        out[left] = min(k + 8, depth)
    # the text ends
    out[1:] = np.minimum(out[1:], np.minimum(len(t) - order[1:], len(t) - order[:-1]))
    return out


def classes(symbols: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of contexts that have an equal one: context, place, class."""
    t = np.frombuffer(b"".join(symbols), np.uint8)
    start = np.concatenate([[0], np.cumsum([len(s) for s in symbols])])[:-1].astype(np.int64)
    order = suffix_array(t, LENGTH)
    window = np.zeros(len(t), bool)
    window[tx.ranges(start, n.astype(np.int64))] = True
    order = order[window[order]]
    equal = adjacent_prefixes(t, order, LENGTH) >= LENGTH
    some = equal.copy()
    some[:-1] |= equal[1:]
    group = np.cumsum(~equal)[some]
    at = order[some]
    which = np.searchsorted(start, at, "right") - 1
    return which, at - start[which], group


def _symbols(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    data, off = tx.column_bytes(col)
    i, n = 0, len(off) - 1
    size = tx.BLOCK_BYTES
    while i < n:
        j = max(int(np.searchsorted(off, off[i] + size, "right")) - 1, i + 1)
        j = min(j, n)
        # one text that is longer comes in parts that overlap by a window
        for at in range(int(off[i]), max(int(off[j]) - LENGTH + 1, int(off[i]) + 1), size if j == i + 1 else 1 << 62):
            end = min(int(off[j]), at + size + LENGTH - 1)
            first = np.append(off[i:j], off[j]) - off[i] if j > i + 1 else np.array([0, end - at])
            yield i, tx.byte_symbols(data[at:end]), first, at - int(off[i]) if j == i + 1 else 0
        i = j


METHOD = repeats.Method(
    length=LENGTH, gram=GRAM, by_id=False, symbols=_symbols,
    cut=lambda raw, spans: [raw[a:a + n] for a, n in spans], classes=classes, per_block=8000)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    rows = repeats.prepare(docs, id_col, text_col)
    joined = repeats.apply(rows, repeats.spans(rows, METHOD))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(b.column(2))
            some = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            size, removed, runs, digest = [], [], [], []
            for i in range(b.num_rows):
                raw = data[off[i]:off[i + 1]]
                gone = np.zeros(0, bool)
                if some[i]:
                    gone = repeats.covered(b.column(3)[i].as_py(), len(raw))
                    raw = raw[~gone]
                size.append(int(off[i + 1] - off[i]))
                removed.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                digest.append(hashlib.sha256(raw.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(v, pa.int64()) for v in (size, removed, runs)], pa.array(digest, pa.string())],
                names=names)

    out = joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    i = F.col(f"`{id_col}`")
    return out.withColumn(id_col, F.when(i != repeats.NULL_ID, i))


# The contract in SQL, by brute force.
ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), p AS (
  SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200
), g AS (
  SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM p
), f AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM g
), s AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE nth > 1
), n AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END)
           OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s
), r AS (
  SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM n GROUP BY doc_id, run
), k AS (
  SELECT r.doc_id, r.lo, r.hi, coalesce(lag(r.hi) OVER (PARTITION BY r.doc_id ORDER BY r.lo), 0) AS at FROM r
), c AS (
  SELECT k.doc_id, sum(k.hi - k.lo) AS n_removed, count(*) AS n_spans,
         string_agg(substr(d.x, 2 * k.at + 1, 2 * (k.lo - k.at)), '' ORDER BY k.lo) AS head, max(k.hi) AS at
  FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id
)
SELECT d.doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN c.doc_id IS NULL THEN d.x ELSE c.head || substr(d.x, 2 * c.at + 1) END)) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id
"""
