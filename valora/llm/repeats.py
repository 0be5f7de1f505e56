"""What the two repeat finders share: which windows of ``length`` symbols start
earlier somewhere else, over a corpus whose windows are far too many to sort.

1. *Anchors.*  Every window picks its smallest ``gram``-symbol hash (the last
   of equal ones).  Equal windows pick the same gram at the same place, so
   windows only have to be compared if their anchors agree.  Neighbouring
   windows mostly share an anchor; the run of windows of one anchor, the
   *context*, is one row: its gram hash, a hash of all its symbols, and where
   it stands.  That is a few rows per hundred symbols, and no texts.
2. *Equal contexts.*  Rows are dealt by gram and read as a sorted stream with
   constant state.  Of equal contexts all but the first are repeats as a
   whole; those within one batch are settled before the shuffle, so a text
   with very many copies is no hot group.  A gram with one context is done.
   Where only other ids count as earlier, an equal context of the first one's
   id is a *copy*: it is not looked at again but gets what the first one gets.
   Copies in one batch and at places next to each other are one row, dealt by
   place, so a text of one repeated word is no hot group either.
3. *Different contexts of one gram* are where copies begin, end or differ.
   Their symbols are fetched from the texts and given, in blocks of bounded
   size, to the operator's own index (a suffix array, a suffix tree), which
   finds the equal windows among them.  A gram with more than ``CHUNK``
   different contexts is spread over several blocks; the first of each
   distinct window of such a block then meets those of the other blocks in one
   more aggregation by window.

Positions are ordered by (id, text hash, place); a null id counts as the
largest.  Nothing is capped, and every result is exact but for collisions of
128 bits of hashes (64 of the gram, 64 of the context).
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm import text as tx
from valora.session import cut_lineage

CHUNK = 4096
NULL_ID = (1 << 63) - 1

_ROW = "key long, context long, id long, mark long, at int, n int"
_OPEN = "id long, mark long, at int, n int, key long, chunk int, of_mark long, of int"
_SPAN = "id long, mark long, lo int, hi int, of int"
COPIES = 1 << 30      # n of a row of copies is below minus this, by their number
BATCH_COPY, COPY = -2, -1   # `chunk` of copies found within a batch, and of others


@dataclass(frozen=True)
class Method:
    """What an operator adds to the scheme."""

    length: int      # symbols of a window
    gram: int        # symbols of an anchor
    by_id: bool      # only other ids count as earlier
    symbols: Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray, int]]]
    # (row, symbols as 64-bit hashes, first of each row and the end, place of the first)
    cut: Callable[[bytes, list[tuple[int, int]]], list[bytes]]
    # the symbols of spans (from, number) of a text
    classes: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    # contexts and their numbers of windows -> context, window in it, class of
    # all windows that have an equal one
    per_block: int   # contexts of a block


def smallest_of(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of every ``w`` consecutive values, the last of equals."""
    value, place, m = g, np.arange(len(g), dtype=np.int32), 1

    def halves(step: int) -> None:
        nonlocal value, place
        take = value[step:] <= value[:-step]
        value = np.where(take, value[step:], value[:-step])
        place = np.where(take, place[step:], place[:-step])

    while 2 * m <= w:
        halves(m)
        m *= 2
    if w > m:
        halves(w - m)
    return place


def contexts(h: np.ndarray, first: np.ndarray, method: Method) -> tuple[np.ndarray, ...]:
    """``row, key, context, at, n``: the contexts of rows of symbol hashes."""
    total = len(h) - method.length + 1
    if total <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    c = tx.prefix_sums(h)
    all_grams = np.arange(len(h) - method.gram + 1)
    g = tx.span_hash(c, all_grams, all_grams + method.gram)
    anchor = smallest_of(g, method.length - method.gram + 1)
    ends = np.repeat(first[1:], np.diff(first))[:total]
    p = np.flatnonzero(np.arange(total) + method.length <= ends)
    a = anchor[p]
    begin = np.ones(len(p), bool)
    begin[1:] = (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(begin)
    n = np.diff(np.append(at, len(p)))
    lo, a = p[at], a[at]
    shape = (a - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    context = tx.mix(tx.span_hash(c, lo, lo + n + method.length - 1) ^ shape)
    row = np.searchsorted(first, lo, "right") - 1
    return row, g[a].view(np.int64), context.view(np.int64), lo - first[row], n


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def _repeated(key, context, id_, mark, at, by_id: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that an equal context elsewhere precedes, whatever order the rows
    are in; rows that are the first of their context once more: those of a
    repeated document, which nothing precedes, or with ``by_id`` copies in the
    same document; and the first row of each row's context."""
    out, twice, first_of = np.zeros(len(key), bool), np.zeros(len(key), bool), np.arange(len(key))
    both = tx.mix(key.view(np.uint64) * np.uint64(31) ^ context.view(np.uint64))
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    some = np.zeros(len(key), bool)
    some[1:] |= same
    some[:-1] |= same
    own = order[some]
    if len(own):
        own = own[_order(key[own], context[own], id_[own], mark[own], at[own])]
        equal = (key[own][1:] == key[own][:-1]) & (context[own][1:] == context[own][:-1])
        first = np.maximum.accumulate(np.where(np.append(False, equal), 0, np.arange(len(own))))
        first_of[own] = own[first]
        if by_id:
            out[own] = id_[own] != id_[own[first]]
            twice[own] = ~out[own] & (mark[own] == mark[own[first]]) & (first != np.arange(len(own)))
        else:
            out[own] = _elsewhere(id_[own], mark[own], at[own], first)
            twice[own] = ~out[own] & (first != np.arange(len(own)))
    return out, twice, first_of


def _copies(id_, mark, at, of) -> tuple[np.ndarray, ...]:
    """Copies of the context at ``of`` of the same document, those next to each
    other as one row: the place of the first, and their number in ``n``."""
    o = _order(id_, mark, of, at)
    id_, mark, at, of = id_[o], mark[o], at[o], of[o]
    new = np.ones(len(o), bool)
    if len(o):
        new[1:] = (id_[1:] != id_[:-1]) | (mark[1:] != mark[:-1]) | (of[1:] != of[:-1]) | (at[1:] > at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o)) - 1 if len(first) else first
    spread = tx.mix(id_[first].view(np.uint64) * np.uint64(31) + at[first].astype(np.uint64)).view(np.int64)
    return spread, of[first], id_[first], mark[first], at[first], -COPIES - 1 - (at[last] - at[first])


def _elsewhere(id_, mark, at, first) -> np.ndarray:
    """Rows that stand at another place than the row ``first`` names for each."""
    return (id_ != id_[first]) | (mark != mark[first]) | (at != at[first])


def _merged(id_, mark, at, n, length: int) -> tuple[np.ndarray, ...]:
    """Contexts that are known to repeat, joined where they touch, as rows with
    a negative number of windows and a key that spreads them evenly."""
    o = _order(id_, mark, at)
    id_, mark, at = id_[o], mark[o], at[o]
    end = at + n[o] + length - 1
    new = np.ones(len(o), bool)
    if len(o):
        # contexts of a document end in the order in which they begin
        new[1:] = (id_[1:] != id_[:-1]) | (mark[1:] != mark[:-1]) | (at[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(o)) - 1 if len(first) else first
    id_, mark, at = id_[first], mark[first], at[first]
    spread = tx.mix(id_.view(np.uint64) * np.uint64(31) + at.astype(np.uint64)).view(np.int64)
    return spread, np.zeros(len(first), np.int64), id_, mark, at, -(end[last] - at - length + 1)


def _batch(cols: list[np.ndarray], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_INTS = [pa.int64()] * 4 + [pa.int32()] * 2


def _anchor_rows(docs: DataFrame, method: Method) -> DataFrame:
    """Rows of step 1.  A negative ``n`` marks a context that is known to repeat,
    or, below ``-COPIES``, copies of the context at place ``context``."""
    names = ["key", "context", "id", "mark", "at", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            marks = b.column(1).to_numpy(zero_copy_only=False)
            parts = []
            for r, h, first, place in method.symbols(b.column(2)):
                row, key, context, at, n = contexts(h, first, method)
                parts.append((key, context, ids[r + row], marks[r + row], at + place, n))
            if parts:
                key, context, i, m, at, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                again, twice, first = _repeated(key, context, i, m, at, method.by_id)
                known = _merged(i[again], m[again], at[again], n[again], method.length)
                more = _copies(i[twice], m[twice], at[twice], at[first[twice]]) if method.by_id else [a[:0] for a in known]
                rest = ~(again | twice)
                key, context, i, m, at, n = (
                    np.concatenate([a[rest], b, c]) for a, b, c in zip((key, context, i, m, at, n), known, more, strict=True))
                for s in range(0, len(key), 1 << 17):
                    e = slice(s, s + (1 << 17))
                    yield _batch([key[e], context[e], i[e], m[e], at[e].astype(np.int32), n[e].astype(np.int32)], names, _INTS)

    return docs.select("id", "mark", "text").mapInArrow(run, _ROW)


def _settle(rows: DataFrame, method: Method) -> DataFrame:
    """Step 2: spans of repeated contexts (``key`` null; ``at`` to ``n``), the
    contexts that are left open, numbered in chunks per gram, and copies (a
    negative ``chunk``; ``n`` of them from ``at`` on) of the context at ``of``."""
    dealt = rows.repartition("key").sortWithinPartitions("key", "context", "id", "mark", "at")
    names = ["id", "mark", "at", "n", "key", "chunk", "of_mark", "of"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the first row of the last gram and of its last context, if they were
        # given out, and how many contexts of that gram came before the last
        held = [np.zeros(0, np.int64) for _ in range(6)]
        given = np.zeros(0, bool)
        number = 0
        for b in batches:
            new = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns]
            known = new[5] < 0
            more = new[5] < -COPIES
            if more.any():
                key, of, id_, mark, at, n = (c[more] for c in new)
                yield _batch([id_, mark, at, -n - COPIES, key, np.full(len(n), BATCH_COPY), mark, of], names, kinds)
            done = [c[known & ~more] for c in new]
            cols = [np.concatenate([h, c[~known]]) for h, c in zip(held, new, strict=True)]
            key, context, id_, mark, at, n = cols
            size, ghosts = len(key), len(given)
            if size:
                new_key = np.ones(size, bool)
                new_key[1:] = key[1:] != key[:-1]
                new_context = new_key.copy()
                new_context[1:] |= context[1:] != context[:-1]
                line = np.arange(size)
                run_first = np.maximum.accumulate(np.where(new_context, line, 0))
                key_first = np.maximum.accumulate(np.where(new_key, line, 0))
                ordinal = np.cumsum(new_context)
                ordinal -= ordinal[key_first]
                if ghosts > 1:  # the second of them stands for context `number` of its gram
                    ordinal += np.where((key == key[0]) & (line > 0), number - 1, 0)
                contexts_of_key = np.maximum.reduceat(ordinal, np.flatnonzero(new_key))[np.cumsum(new_key) - 1]
                if method.by_id:
                    repeat = id_ != id_[run_first]
                    inner = ~repeat & ~new_context   # of the same id
                else:
                    repeat = _elsewhere(id_, mark, at, run_first)
                    inner = np.zeros(size, bool)
                sent = np.zeros(size, bool)
                sent[:ghosts] = given
                open_ = new_context & (contexts_of_key > 0) & ~sent
                repeat[:ghosts] = False
                inner[:ghosts] = False
                if inner.any():
                    f = run_first[inner]
                    yield _batch([id_[inner], mark[inner], at[inner], np.ones(len(f), np.int64), key[inner],
                                  np.full(len(f), COPY), mark[f], at[f]], names, kinds)
                done = [np.concatenate([d, c[repeat]]) for d, c in zip(done, cols, strict=True)]
                if open_.any():
                    yield _batch([id_[open_], mark[open_], at[open_], n[open_], key[open_], ordinal[open_] // CHUNK,
                                  mark[open_], at[open_]], names, kinds)
                keep = [int(key_first[-1])]
                if int(run_first[-1]) != keep[0]:
                    keep.append(int(run_first[-1]))
                number = int(ordinal[-1])
                held = [c[keep] for c in cols]
                given = np.full(len(keep), contexts_of_key[-1] > 0)
            if len(done[0]):
                lo, width = done[4], np.abs(done[5]) + method.length - 1
                none = np.zeros(len(lo), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(done[2]), pa.array(done[3]), pa.array(lo, pa.int32()), pa.array(lo + width, pa.int32()),
                     pa.nulls(len(lo), pa.int64()), pa.array(none, pa.int32()), pa.array(done[3]), pa.array(lo, pa.int32())], names=names)

    return dealt.mapInArrow(run, _OPEN)


def _fetch(docs: DataFrame, opened: DataFrame, blocks: int, method: Method) -> DataFrame:
    """The open contexts with their symbols and block."""
    block = F.pmod(F.xxhash64("key", "chunk"), F.lit(blocks)).cast("int")
    wanted = opened.groupBy("id", "mark").agg(
        F.collect_list(F.struct(block.alias("block"), "key", "chunk", "at", "n")).alias("wanted"))
    joined = docs.join(wanted, ["id", "mark"]).select("id", "mark", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                if own == before:
                    continue  # a repeated row is the same document
                before = own
                rows = b.column(3)[i].as_py()
                raw = (b.column(2)[i].as_py() or "").encode()
                cut = method.cut(raw, [(r["at"], r["n"] + method.length - 1) for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in rows], t) for k, t in
                     (("block", pa.int32()), ("key", pa.int64()), ("chunk", pa.int32()))]
                    + [pa.array([own[0]] * len(rows), pa.int64()), pa.array([own[1]] * len(rows), pa.int64())]
                    + [pa.array([r[k] for r in rows], pa.int32()) for k in ("at", "n")] + [pa.array(cut, pa.binary())],
                    names=["block", "key", "chunk", "id", "mark", "at", "n", "symbols"])

    return joined.mapInArrow(run, "block int, key long, chunk int, id long, mark long, at int, n int, symbols binary")


def _resolve(fetched: DataFrame, method: Method) -> DataFrame:
    """Step 3: spans (``key`` null) and, for grams in several chunks, the first
    of each distinct window as ``key, window``."""

    def run(t: pa.Table) -> pa.Table:
        cols = {c: t[c].to_numpy() for c in ("key", "chunk", "id", "mark", "at", "n")}
        order = _order(cols["id"], cols["mark"], cols["at"])
        # a document whose rows came to several tasks is fetched by each of them
        once = np.ones(len(order), bool)
        once[1:] = _elsewhere(*(cols[c][order] for c in ("id", "mark", "at")), np.maximum(np.arange(len(order)) - 1, 0))[1:]
        order = order[once]
        t = t.take(pa.array(order))
        key, chunk, id_, mark, at, n = (cols[c][order] for c in ("key", "chunk", "id", "mark", "at", "n"))
        symbols = [x.as_py() for x in t["symbols"]]
        which, window, group = method.classes(symbols, n)
        # contexts are in order of position, so the smallest of a class is its first
        where = _order(group, which)
        which, window, group = which[where], window[where], group[where]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        first = which[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] if len(new) else which
        again = (id_[which] != id_[first]) if method.by_id else ~new
        w, p = which[again], window[again]
        o = _order(w, p)
        w, p = w[o], p[o]
        begin = np.ones(len(w), bool)
        begin[1:] = (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)
        s = np.flatnonzero(begin)
        e = np.append(s[1:], len(w)) - 1 if len(s) else s
        out = [id_[w[s]], mark[w[s]], at[w[s]] + p[s], at[w[s]] + p[e] + method.length]
        spans = pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()),
                          pa.array(out[3], pa.int32()), pa.array(at[w[s]], pa.int32()), pa.nulls(len(s), pa.int64()),
                          pa.nulls(len(s), pa.int64())], names=names)
        # grams that go on in other blocks
        grams, of_gram = np.unique(key, return_inverse=True)
        more = (chunk > 0) | (np.bincount(of_gram, chunk == 0, len(grams)) >= CHUNK)[of_gram]
        if not more.any():
            return spans
        base = np.cumsum(n, dtype=np.int64) - n   # of each context's windows, among all
        left = np.ones(int(n.sum()), bool)
        left[base[w] + p] = False
        own, place, value = [], [], []
        for c in np.flatnonzero(more).tolist():
            k = np.flatnonzero(left[base[c]:base[c] + n[c]])
            width = len(symbols[c]) // (n[c] + method.length - 1)
            h = tx.prefix_hash(np.frombuffer(symbols[c], np.uint8))
            own.append(np.full(len(k), c))
            place.append(at[c] + k)
            value.append(tx.span_hash(h, k * width, (k + method.length) * width).view(np.int64))
        c, lo, value = np.concatenate(own), np.concatenate(place), np.concatenate(value)
        extra = pa.table([pa.array(id_[c], pa.int64()), pa.array(mark[c], pa.int64()), pa.array(lo, pa.int32()),
                          pa.array(lo + method.length, pa.int32()), pa.array(at[c], pa.int32()), pa.array(key[c], pa.int64()),
                          pa.array(value, pa.int64())], names=names)
        return pa.concat_tables([spans, extra])

    names = ["id", "mark", "lo", "hi", "of", "key", "window"]
    return fetched.groupBy("block").applyInArrow(run, f"{_SPAN}, key long, window long")


def prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, mark, text`` with the null id as the largest and the text's hash."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.xxhash64(text).alias("mark"), text.alias("text"))


def _let_go(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of finished steps now: it does so when
    the driver collects its garbage, and here they are as large as the input."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spans(docs: DataFrame, method: Method) -> DataFrame:
    """``id, mark, lo, hi``: what is covered by windows that start earlier too.
    ``docs`` comes from ``prepare``."""
    state = cut_lineage(_settle(_anchor_rows(docs, method), method))
    _let_go(docs.sparkSession)
    opened = state.where("key IS NOT NULL AND chunk >= 0")
    n, most, copies, twice = state.agg(
        F.count_if(F.expr("key IS NOT NULL AND chunk >= 0")), F.max("chunk"), F.count_if(F.col("chunk") == BATCH_COPY),
        F.count_if(F.col("chunk") == COPY)).first()
    out = state.where("key IS NULL").select("id", "mark", F.col("at").alias("lo"), F.col("n").alias("hi"), "of")
    if n:
        found = cut_lineage(_resolve(_fetch(docs, opened, n // method.per_block + 1, method), method))
        _let_go(docs.sparkSession)
        if most:
            reps = found.where("key IS NOT NULL")
            place = F.struct("id") if method.by_id else F.struct("id", "mark", "lo")
            least = reps.groupBy("key", "window").agg(F.min(place).alias("least"))
            late = reps.join(least, ["key", "window"]).where(F.col("least") < place).select("id", "mark", "lo", "hi", "of")
            out = out.union(late)
        out = out.union(found.where("key IS NULL").select("id", "mark", "lo", "hi", "of"))
    # what is found for a context holds for its copies; those of a batch may be copies of copies
    for number, chunk in ((twice, COPY), (copies, BATCH_COPY)):
        if number:
            own = state.where(F.col("chunk") == chunk).select(
                "id", F.col("of_mark").alias("mark"), "of", F.col("mark").alias("to_mark"), "at", (F.col("n") - 1).alias("further"))
            shift = F.col("at") - F.col("of")
            got = own.join(out, ["id", "mark", "of"]).select(
                "id", F.col("to_mark").alias("mark"), (F.col("lo") + shift).alias("lo"),
                (F.col("hi") + shift + F.col("further")).alias("hi"), F.col("at").alias("of"))
            out = out.union(got)
    return out.select("id", "mark", "lo", "hi")


def apply(docs: DataFrame, found: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``id, mark, text, spans`` for every row; ``spans`` is null where nothing
    repeats."""
    per_doc = found.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(per_doc, ["id", "mark"], "left").select("id", "mark", "text", "spans", *(extra or []))


def covered(rows: list[dict] | None, n: int) -> np.ndarray:
    """Which of ``n`` symbols the spans cover."""
    step = np.zeros(n + 1, np.int64)
    if rows:
        np.add.at(step, [r["lo"] for r in rows], 1)
        np.add.at(step, [r["hi"] for r in rows], -1)
    return np.cumsum(step[:-1]) > 0
