"""Packing documents into fixed-length sequences by harmonic classes.

A document is its token ids and an end id.  It is cut into pieces: as many
whole sequences as it fills, then halves, quarters and so on of a sequence
down to ``min_piece``, then the rest.  A piece of length ``n`` belongs to the
class ``j = capacity // n``, that is, its length lies in ``(capacity / (j + 1),
capacity / j]``, and every ``j`` pieces of that class make one sequence.  Whole
sequences, halves, quarters ... fill theirs exactly; only sequences of rests
(``j >= capacity / min_piece``) leave some padding, below one part in ``j``.

Tokens are made and cut in one pass over the texts; nothing but piece lengths
is shuffled.  Pieces are numbered within their class by counts per (class,
block) and ranks within the block, so workers fill bins independently of each
other.  The pieces that do not fill a last bin are fewer than ``j`` per class,
which bounds them for all inputs (about 11,000 at 2,048 tokens); those are
packed by best-fit-decreasing on the driver.

Defined cases: a null or empty text is the end id alone; a very long text is
tokenised in parts cut at white space, which this vocabulary drops; repeated
rows are documents of their own; a null id is kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.llm import text as tx
from valora.llm.sharding import best_fit_decreasing
from valora.session import cut_lineage

ROWS_PER_BLOCK = 5_000
CACHE_UNITS = 1_500_000

# Byte classes of ASCII: letters, digits, punctuation; 0 for all other bytes
# and for the apostrophe, which contractions such as 's begin with.
_CLASS = np.zeros(256, np.uint8)
for _c in range(0x21, 0x7F):
    _CLASS[_c] = 1 if chr(_c).isalpha() else 2 if chr(_c).isdigit() else 3
_CLASS[ord("'")] = 0


class UnitTokenizer:
    """Token ids of texts, by way of the distinct units that they consist of.

    A unit is a part of a word between places where this vocabulary's
    pre-tokenizer always cuts: white space, and ASCII letters, digits and
    punctuation next to each other.  Upper and lower case ASCII are one, as
    the vocabulary lowers them.  Ids of units are kept from block to block, up
    to ``CACHE_UNITS`` of them; then the store starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.index = tx.HashIndex()
        self.ends = np.zeros(1 << 12, np.int64)   # of each unit's ids
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def __call__(self, b: tx.Block) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block, and where each row's begin."""
        kind = _CLASS[b.buf]
        cut = np.zeros(len(kind), bool)
        if len(kind):
            left, right = kind[:-1], kind[1:]
            cut[1:] = (left > 0) & (right > 0) & ((left != right) | (left == 2))
            raw = b.buf.tobytes()
            for s in self.special:
                p = raw.find(s)
                while p >= 0:
                    cut[p + 1:p + len(s)] = False
                    cut[p] = True
                    if p + len(s) < len(cut):
                        cut[p + len(s)] = True
                    p = raw.find(s, p + len(s))
        u = tx.words(b, cut)
        low = tx.lower_ascii(b.buf)
        h = tx.span_hash(tx.prefix_hash(low), u.starts, u.ends)
        distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, n = self._find(distinct, low, u.starts[first], u.ends[first])
        lengths = n[inverse]
        ids = self.ids[tx.ranges(at[inverse], lengths)]
        done = np.concatenate([[0], np.cumsum(lengths)])
        return ids, done[u.first]

    def _find(self, h: np.ndarray, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > CACHE_UNITS:
            self._clear()
        new = self.index.missing(h)
        if len(new):
            raw = low.tobytes()
            units = [raw[i:j].decode("utf-8", "replace") for i, j in zip(s[new].tolist(), e[new].tolist(), strict=True)]
            got = self.tokenizer.encode(units, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(got.ids, np.uint32)
            n = np.bincount(np.array(got.word_ids, np.int64), minlength=len(units))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            at = len(self.index)
            while at + len(new) > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.ids[self.used:self.used + len(ids)] = ids
            self.ends[at:at + len(new)] = self.used + np.cumsum(n)
            self.used += len(ids)
            self.index.add(h[new], at + np.arange(len(new)))
        rows = self.index.rows(h)
        start = np.where(rows > 0, self.ends[rows - 1], 0)
        return start, self.ends[rows] - start


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def unit_tokenizer(vocabulary: str) -> UnitTokenizer:
    """One tokenizer per Python worker and vocabulary file."""
    if vocabulary not in _TOKENIZERS:
        import public_tokenizers

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        _TOKENIZERS[vocabulary] = UnitTokenizer(path)
    return _TOKENIZERS[vocabulary]


def cut_lengths(n: int, capacity: int, min_piece: int) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    n %= capacity
    part = capacity // 2
    while part >= min_piece:
        if n >= part:
            out.append(part)
            n -= part
        part //= 2
    return [*out, n] if n else out


def pieces(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, capacity: int, min_piece: int,
           end_id: int) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` per piece; no shuffle."""
    doc = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = doc.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = unit_tokenizer(vocabulary)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            row, start, length, crc, total = [], [], [], [], []
            for r, ids, first in tx.row_values(batch.column(1), tokenize):
                edges = first.tolist()
                for k in range(len(edges) - 1):
                    own = np.concatenate([ids[edges[k]:edges[k + 1]], end]).astype("<u4").tobytes()
                    n, at = len(own) // 4, 0
                    for x in cut_lengths(n, capacity, min_piece):
                        row.append(r + k)
                        start.append(at)
                        length.append(x)
                        crc.append(zlib.crc32(own[4 * at:4 * (at + x)]))
                        total.append(n)
                        at += x
            cols = [batch.column(0).take(pa.array(row, pa.int64())),
                    *[pa.array(v, pa.int64()) for v in (start, length, crc, total)]]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return doc.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = "word_bpe_49k.json", end_id: int = 1,
         min_piece: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece."""
    spark = docs.sparkSession
    p = cut_lineage(pieces(docs, id_col, text_col, vocabulary, capacity, min_piece, end_id)
                    .withColumn("j", F.floor(F.lit(capacity) / F.col("length")).cast("int")))
    blocks = max(1, p.count() // ROWS_PER_BLOCK)
    p = p.withColumn("block", F.pmod(F.xxhash64(F.col("id").cast("string"), "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    counts = p.groupBy("j", "block").count()
    before = Window.partitionBy("j").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("j", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("j", "block").orderBy("id", "start", "ids_crc32")) - 1
    ranked = cut_lineage(p.withColumn("in_block", rank).join(offsets, ["j", "block"])
                         .withColumn("rank", F.col("offset") + F.col("in_block"))
                         .drop("block", "offset", "in_block"))
    # one row per class, of which there are at most `capacity`
    classes = sorted((r["j"], r["count"]) for r in counts.groupBy("j").agg(F.sum("count").alias("count")).collect())
    base, sequences = {}, 0
    for j, n in classes:
        base[j] = sequences
        sequences += n // j
    table = spark.createDataFrame([(j, n // j * j, base[j]) for j, n in classes], "j int, whole long, base long")
    placed = ranked.join(F.broadcast(table), "j")
    rest = placed.where(F.col("rank") >= F.col("whole")).select("j", "rank", "length").collect()
    rest.sort(key=lambda r: (-r["length"], r["j"], r["rank"]))
    bins = best_fit_decreasing([r["length"] for r in rest], capacity)
    late = spark.createDataFrame([(r["j"], r["rank"], sequences + b) for r, b in zip(rest, bins, strict=True)],
                                 "j int, rank long, late long")
    placed = (placed.join(F.broadcast(late), ["j", "rank"], "left")
              .withColumn("sequence_id", F.coalesce("late", F.col("base") + F.floor(F.col("rank") / F.col("j")))))
    earlier = (Window.partitionBy("sequence_id").orderBy("j", "rank")
               .rowsBetween(Window.unboundedPreceding, -1))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))
