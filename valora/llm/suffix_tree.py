"""Word-level duplicate removal with prefix-partitioned suffix trees.

The suffixes of a block's contexts are split by prefixes of variable length:
a prefix is lengthened until the suffixes that begin with it are few enough
for one subtree.  Each subtree is made from its sorted suffixes and their
adjacent common prefixes, as published for disk-based suffix trees (Mansour
et al., "ERA", 2011); its internal nodes of at least ``LENGTH`` words are the
repeats.  Which contexts a block holds is ``repeats``'s part: they are dealt by
the words at their anchor, so all suffixes that can share a deep node meet.

A word is removed if a window of ``LENGTH`` words that covers it also starts
in a document with a smaller id.

Defined cases: a null text has no words; a text with fewer words than a window
keeps all; rows with one id, whatever their texts, are one document, so they
do not shorten each other, and each gets its result; the null id counts as the
largest; columns besides id and text take no part; an empty table gives an
empty result.
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

LENGTH = 50
GRAM = 10
SUBTREE = 4096


def word_hashes(b: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    w = tx.words(b)
    return tx.span_hash(tx.prefix_hash(b.buf), w.starts, w.ends), w.first


def _ranks(t: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """``(k, rank of the first k symbols of each suffix)`` for k = 1, 2, 4, ...,
    depth; a suffix that is shorter goes on in the next context, unharmed, as
    windows never do."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    out, k = [(1, rank)], 1
    while k < depth:
        step = min(k, depth - k)
        n = len(rank) - step
        if n <= 0:
            break
        pair = rank[:n] * (int(rank.max()) + 1) + rank[step:step + n]
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        k += step
        out.append((k, rank))
    return out


def subtree(prefixes: np.ndarray, deep: int) -> list[tuple[int, int, int]]:
    """The topmost internal nodes of at least ``deep`` symbols of the tree over
    sorted suffixes with these adjacent common prefixes (the first is ignored):
    ``(depth, first leaf, last leaf)``."""
    out, stack = [], [(0, 0)]  # open nodes: depth, first leaf
    for i in range(1, len(prefixes) + 1):
        depth, first = (int(prefixes[i]) if i < len(prefixes) else 0), i - 1
        while stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= deep and max(stack[-1][0], depth) < deep:
                out.append((d, first, i - 1))
        if stack[-1][0] < depth:
            stack.append((depth, first))
    return out


def classes(symbols: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of contexts that have an equal one: context, place, class."""
    t = np.frombuffer(b"".join(symbols), np.uint64)
    start = np.concatenate([[0], np.cumsum([len(s) // 8 for s in symbols])])[:-1].astype(np.int64)
    ranks = _ranks(t, LENGTH)
    suffix = tx.ranges(start, n.astype(np.int64))
    # the shortest prefix that few enough suffixes share
    prefix = np.zeros(len(suffix), np.int64)
    chosen = np.zeros(len(suffix), bool)
    for level, (k, rank) in enumerate(ranks):
        own = rank[suffix]
        fits = ~chosen & ((np.bincount(own)[own] <= SUBTREE) | (k == LENGTH))
        prefix[fits] = own[fits] * len(ranks) + level
        chosen |= fits
    last = ranks[-1][1]
    order = np.lexsort((suffix, last[suffix], prefix))
    suffix, prefix = suffix[order], prefix[order]
    # adjacent common prefixes, by the longest power of two that still agrees
    common = np.zeros(len(suffix), np.int64)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    found = np.zeros(len(a), np.int64)
    whole = last[a] == last[b]
    for k, rank in reversed(ranks[:-1]):
        inside = (np.maximum(a, b) < len(rank)) & (found + k <= LENGTH)
        same = inside & (rank[np.minimum(a, len(rank) - 1)] == rank[np.minimum(b, len(rank) - 1)])
        a[same] += k
        b[same] += k
        found[same] += k
    common[1:] = np.where(whole, LENGTH, np.minimum(found, LENGTH - 1))
    new = np.ones(len(suffix), bool)
    new[1:] = prefix[1:] != prefix[:-1]
    common[new] = 0
    edges = np.append(np.flatnonzero(new), len(suffix))
    which, place, group = [], [], []
    number = 0
    for g in np.unique(np.searchsorted(edges, np.flatnonzero(common >= LENGTH), "right") - 1).tolist():
        lo, hi = int(edges[g]), int(edges[g + 1])
        for _, first, final in subtree(common[lo:hi], LENGTH):
            own = suffix[lo + first:lo + final + 1]
            c = np.searchsorted(start, own, "right") - 1
            which.append(c)
            place.append(own - start[c])
            group.append(np.full(len(own), number))
            number += 1
    if not which:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(which), np.concatenate(place), np.concatenate(group)


def _symbols(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    for row, h, first in tx.row_values(col, word_hashes):
        yield row, h, first, 0


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    for _, h, _ in tx.row_values(pa.array([raw], pa.large_binary()), word_hashes):
        return [h[a:a + n].tobytes() for a, n in spans]
    return [b"" for _ in spans]


METHOD = repeats.Method(length=LENGTH, gram=GRAM, by_id=True, symbols=_symbols, cut=_cut, classes=classes, per_block=2000)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, n_removed, kept_sha256`` for every row."""
    rows = repeats.prepare(docs, id_col, text_col)
    joined = repeats.apply(rows, repeats.spans(rows, METHOD))
    names = [id_col, "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(b.column(2))
            some = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            n, removed, digest = [], [], []
            for i in range(b.num_rows):
                words = data[off[i]:off[i + 1]].tobytes().split()  # of bytes: ASCII white space
                kept = words
                if some[i]:
                    gone = repeats.covered(b.column(3)[i].as_py(), len(words)).tolist()
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())],
                names=names)

    out = joined.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string")
    i = F.col(f"`{id_col}`")
    return out.withColumn(id_col, F.when(i != repeats.NULL_ID, i))


def shorten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows with all columns, their texts without the repeated words: the
    kept words joined by one space.  A text that loses nothing stays as it is;
    a row that loses all of its words goes.  ``chars_col``, if there, is set to
    the new length in code points where the text changed."""
    names = docs.columns
    rest = [c for c in names if c != text_col]
    base = repeats.prepare(docs, id_col, text_col)
    found = repeats.spans(base, METHOD)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(repeats.NULL_ID)).alias("id"),
                       F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), text.alias("text"),
                       F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))
    joined = repeats.apply(rows, found, ["rest"]).select("rest", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = np.flatnonzero(b.column(2).is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(b.num_rows, bool)
            changed = np.zeros(b.num_rows, bool)
            texts = b.column(1)
            if len(some):
                texts = texts.to_pylist()
                for i in some.tolist():
                    words = (texts[i] or "").encode().split()
                    gone = repeats.covered(b.column(2)[i].as_py(), len(words)).tolist()
                    kept = [w for w, g in zip(words, gone, strict=True) if not g]
                    texts[i] = b" ".join(kept).decode()
                    keep[i], changed[i] = bool(kept), True
                texts = pa.array(texts, b.column(1).type)
            out = pa.RecordBatch.from_arrays([b.column(0), texts, pa.array(changed)], names=["rest", "text", "changed"])
            yield out.filter(pa.array(keep))

    from pyspark.sql.types import BooleanType, StringType, StructType

    schema = StructType().add("rest", rows.schema["rest"].dataType).add("text", StringType()).add("changed", BooleanType())
    out = joined.mapInArrow(run, schema)

    def column(c: str):
        if c == text_col:
            return F.col("text").alias(c)
        own = F.col(f"rest.`{c}`")
        if c == chars_col:
            own = F.when(F.col("changed"), F.char_length("text").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return out.select(*[column(c) for c in names])


# The contract in SQL, by brute force.
ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50
), g AS (
  SELECT p.doc_id, p.i, md5(array_to_string(list_slice(d.w, p.i, p.i + 49), ' ')) AS h FROM p JOIN d USING (doc_id)
), f AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM g
), r AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM f WHERE first < doc_id GROUP BY doc_id
), k AS (
  SELECT d.doc_id, d.w, coalesce(r.gone, []) AS gone FROM d LEFT JOIN r USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(gone, x)), lambda x: w[x]), ' ')) AS kept_sha256
FROM k
"""
