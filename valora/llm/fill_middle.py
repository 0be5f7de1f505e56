"""Fill-in-middle transformation over a Roaring-style set of line ends.

The ends of all lines of a block of texts are one set of integers, kept as a
Roaring bitmap keeps them: the values with the same upper bits form a container
of 65,536 places, which is a sorted array, a bitmap, or a list of runs, whichever
is smallest; cumulative cardinalities stand beside the containers.  ``select(k)``
finds the container of the ``k``-th line end by them and then selects within it;
``rank`` counts line ends before a place.  A document's number of lines is a
difference of ranks, and both its cuts are selects, so no text is split into
lines, and a text of nothing but line breaks takes one run.

A line is ``[^\\n]*\\n|[^\\n]+``.  Documents of ``n`` lines are cut after two of
0 to ``n`` lines, drawn from a digest of the seed and the id.  The parts are
joined as prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``),
each after its sentinel; the draw also says which, and whether a document stays
plain.  ``restore`` undoes it.

Everything is one pass over the texts without a shuffle.  Defined cases: a null
text is an empty one; empty texts and those with a sentinel in them stay plain; a
null id is drawn as an empty one; rows with equal ids are cut by the same draw;
very long texts are handled whole, one at a time; an empty table gives an empty
result; further columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valora.llm import text as tx

SEED = 7
RATE = 100       # per cent of the documents that are transformed
SPM = 50         # per cent of those that are spm
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BATCH_BYTES = 4 << 20

ARRAY, BITMAP, RUNS = 0, 1, 2
_WORDS = 1024    # 64-bit words of a bitmap


class BoundarySet:
    """Sorted, distinct, non-negative integers in containers."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        high, low = values >> 16, (values & 0xFFFF).astype(np.uint16)
        first = np.flatnonzero(np.append(True, high[1:] != high[:-1])) if len(values) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(values))
        self.keys = high[first]
        self.before = np.append(0, np.cumsum(last - first))           # cumulative cardinalities
        begins = np.append(True, (values[1:] != values[:-1] + 1) | (high[1:] != high[:-1]))[:len(values)]
        cards, runs = last - first, np.add.reduceat(begins, first, dtype=np.int64) if len(first) else first
        self.kind = np.argmin(np.stack([2 * cards, np.full(len(cards), 8 * _WORDS), 4 * runs + 2]), axis=0)
        of = np.repeat(self.kind, cards)
        # arrays: the lower bits end to end
        self.array = low[of == ARRAY]
        self.array_at = self._starts(np.where(self.kind == ARRAY, cards, 0))
        # runs: starts and cumulative lengths
        starts = np.flatnonzero(begins & (of == RUNS))
        self.run = low[starts]
        lengths = np.diff(np.append(np.flatnonzero(begins), len(values)))[of[begins] == RUNS]
        self.run_before = np.append(0, np.cumsum(lengths))
        self.run_at = self._starts(np.where(self.kind == RUNS, runs, 0))
        # bitmaps: words and cumulative numbers of their bits
        maps = np.flatnonzero(self.kind == BITMAP)
        bits = np.zeros((len(maps), _WORDS * 64), bool)
        for i, c in enumerate(maps.tolist()):
            bits[i, low[first[c]:last[c]]] = True
        self.words = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view("<u8").reshape(-1)
        self.word_before = np.append(0, np.cumsum(np.bitwise_count(self.words).astype(np.int64)))
        self.map_at = self._starts(np.where(self.kind == BITMAP, _WORDS, 0))

    @staticmethod
    def _starts(sizes: np.ndarray) -> np.ndarray:
        return np.cumsum(sizes) - sizes

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: np.ndarray) -> np.ndarray:
        """The ``k``-th smallest values, counted from 0."""
        k = np.asarray(k, np.int64)
        c = np.searchsorted(self.before, k, "right") - 1
        local, kind = k - self.before[c], self.kind[c]
        out = self.keys[c] << 16
        own = kind == ARRAY
        out[own] += self.array[self.array_at[c[own]] + local[own]]
        own = kind == RUNS
        nth = self.run_before[self.run_at[c[own]]] + local[own]
        r = np.searchsorted(self.run_before, nth, "right") - 1
        out[own] += self.run[r] + (nth - self.run_before[r])
        own = kind == BITMAP
        nth = self.word_before[self.map_at[c[own]]] + local[own]
        w = np.searchsorted(self.word_before, nth, "right") - 1
        bits = np.unpackbits(self.words[w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1, dtype=np.int16) > (nth - self.word_before[w])[:, None], axis=1)
        out[own] += 64 * (w - self.map_at[c[own]]) + inside
        return out

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many values are smaller than each of ``places``."""
        places = np.asarray(places, np.int64)
        if not len(self.keys):
            return np.zeros(len(places), np.int64)
        c = np.searchsorted(self.keys, places >> 16, "right") - 1
        inside = (c >= 0) & (self.keys[c] == places >> 16)
        out = np.where(inside, self.before[np.maximum(c, 0)], self.before[c + 1])
        for kind in (ARRAY, BITMAP, RUNS):
            own = np.flatnonzero(inside & (self.kind[c] == kind))
            if not len(own):
                continue
            low, own_c = places[own] & 0xFFFF, c[own]
            if kind == BITMAP:
                w = self.map_at[own_c] + (low >> 6)
                below = self.words[w] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
                out[own] += (self.word_before[w] - self.word_before[self.map_at[own_c]]
                             + np.bitwise_count(below).astype(np.int64))
                continue
            for x in np.unique(own_c).tolist():   # one search per container
                at = own[own_c == x]
                low = places[at] & 0xFFFF
                if kind == ARRAY:
                    a = self.array_at[x]
                    out[at] += np.searchsorted(self.array[a:a + self.before[x + 1] - self.before[x]], low)
                else:
                    a, total = self.run_at[x], self.before[x + 1] - self.before[x]
                    n = np.searchsorted(self.run_before, self.run_before[a] + total) - a
                    r = np.searchsorted(self.run[a:a + n], low)   # runs that begin before
                    passed = self.run_before[a + r] - self.run_before[a]
                    tail = np.maximum(r - 1, 0)
                    end = self.run[a + tail].astype(np.int64) + self.run_before[a + tail + 1] - self.run_before[a + tail]
                    out[at] += passed - np.where(r > 0, np.maximum(end - low, 0), 0)
        return out


def line_ends(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> BoundarySet:
    """Places in ``buf`` after each line of the texts ``buf[start:end]``."""
    breaks = np.flatnonzero(buf == 0x0A) + 1
    full = ends[ends > starts]
    return BoundarySet(np.union1d(breaks, full))


def draws(id_: object, seed: int) -> list[int]:
    """Four integers of 32 bits."""
    code = hashlib.sha256(f"{seed}:{'' if id_ is None else id_}".encode()).hexdigest()
    return [int(code[i:i + 8], 16) for i in (0, 8, 16, 24)]


def _blocks(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows of about ``BATCH_BYTES`` of text; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + BATCH_BYTES, "right")) - 1)
        yield i, min(j, n)
        i = j


def transform_block(ids: list, buf: np.ndarray, off: np.ndarray, seed: int, rate: int, spm: int) -> list[tuple]:
    """``n, form, prefix_chars, middle_chars, output`` of each text."""
    starts, ends = off[:-1], off[1:]
    marks = line_ends(buf, starts, ends)
    first = marks.rank(starts + 1)
    n = marks.rank(ends + 1) - first
    n[ends == starts] = 0
    drawn = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    a, b = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    cuts = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        cut = starts.copy()
        some = k > 0
        cut[some] = marks.select(first[some] + k[some] - 1)
        cuts.append(cut)
    raw, out = buf.tobytes(), []
    for i, (s, p, m, e) in enumerate(zip(starts.tolist(), cuts[0].tolist(), cuts[1].tolist(), ends.tolist(), strict=True)):
        whole = raw[s:e]
        if not whole or drawn[i, 2] % 100 >= rate or any(x in whole for x in (PREFIX, SUFFIX, MIDDLE)):
            out.append((int(n[i]), "plain", None, None, whole))
            continue
        prefix, middle, suffix = raw[s:p], raw[p:m], raw[m:e]
        chars = [len(x.decode()) for x in (prefix, middle)]
        if drawn[i, 3] % 100 < spm:
            out.append((int(n[i]), "spm", *chars, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))))
        else:
            out.append((int(n[i]), "psm", *chars, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))))
    return out


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, output`` of every row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            named = ids.to_pylist()
            data, off = tx.column_bytes(batch.column(1))
            for i, j in _blocks(data, off):
                out = transform_block(named[i:j], data[off[i]:off[j]], off[i:j + 1] - off[i], seed, rate, spm)
                n, form, prefix, middle, text = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                    names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  No part holds a sentinel, and a
    sentinel can only begin where one was put, so the parts are those between."""
    parts = F.split(output, "<P>|<S>|<M>", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, places in order.items():
        out = out.when(form == name, F.concat(*[F.get(parts, i) for i in places]))
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM e),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM p
"""
